"""Cutting lineage with tables in the cluster's shared folder.

``spark.checkpoint.dir`` names that folder.  Only where it is unset (a laptop,
the tests) a temporary folder is used instead.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Most rows and bytes of an Arrow batch.  Texts can be long, and each running task holds a few batches on both sides.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of bounded size."""
    for name, value in BATCHES.items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only if none is configured and Spark runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/narrata/{name}-{uuid.uuid4().hex}"


def uri(spark: SparkSession, path: str) -> str:
    """The URI of a folder in the store that holds it, for what opens files without Spark; the folder is made.

    A path without a scheme lies in Hadoop's default store, and one of a mount
    table (``viewfs``) in the store that it leads to.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    store.mkdirs(folder)
    return re.sub("^file:/+", "file:///", store.resolvePath(folder).toUri().toString())


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The files outlive any executor, so a lost one costs no recomputation of
    what lies before, and the plan behind starts with a plain scan.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
