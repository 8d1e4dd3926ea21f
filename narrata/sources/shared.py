"""Tables in the cluster's shared folder, which ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Most rows and bytes of an Arrow batch: a page or a block can be long, and a worker holds a batch, its texts and what is made of them.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of bounded size."""
    for name, value in BATCHES.items():
        spark.conf.set(name, value)
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses; a folder of this machine only if none is set and Spark runs on it alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        folder = _LOCAL[app]
    return f"{folder.rstrip('/')}/narrata/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet into the shared folder and read back, so that what reads them more than once makes them once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
