"""Tables of which a write replaces some buckets, whole or not at all.

Rows are dealt to buckets by a hash of their key.  A bucket has one file in one
of two generations; a new version is written beside the newest one, into the
generation that is older, so readers and a write that stops halfway always have
a whole version.  A version that is there already is not written again, so a
write may be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Buckets:
    """A table at ``path`` with columns ``schema``, dealt by ``key`` to ``count`` buckets."""

    path: str
    schema: str
    key: tuple[str, ...]
    count: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.count)).cast("int")

    def _files(self, spark: SparkSession) -> DataFrame | None:
        schema = T.StructType([*T.StructType.fromDDL(self.schema).fields, *T.StructType.fromDDL("version long, bucket int, generation int").fields])
        try:
            return spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def newest(self, spark: SparkSession) -> dict[int, tuple[int, int]]:
        """Newest version of each bucket, and its generation."""
        files = self._files(spark)
        if files is None:
            return {}
        rows = files.groupBy("bucket", "generation").agg(F.max("version").alias("version")).collect()  # two for each bucket
        return {r["bucket"]: (r["version"], r["generation"]) for r in sorted(rows, key=lambda r: r["version"])}

    def read(self, spark: SparkSession, newest: dict[int, tuple[int, int]] | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The newest version of all buckets, or of some; no other file is read."""
        newest = self.newest(spark) if newest is None else newest
        files = self._files(spark)
        if files is None:
            return spark.createDataFrame([], self.schema)
        kept = [f"{b}-{g}" for b, (_, g) in sorted(newest.items()) if only is None or b in only]
        names = [f.name for f in T.StructType.fromDDL(self.schema).fields]
        return files.filter(F.concat_ws("-", F.col("bucket").cast("string"), F.col("generation").cast("string")).isin(kept)).select(*names)

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that some rows belong to, ``count`` at most."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def write(self, rows: DataFrame, version: int, newest: dict[int, tuple[int, int]], only: Sequence[int]) -> None:
        """Replace the buckets ``only`` by ``rows``, their whole new contents; those that have the version stay."""
        if not (due := [b for b in only if newest.get(b, (-1, 1))[0] < version]):
            return
        other = F.element_at(F.array(*[F.lit(1 - newest.get(b, (-1, 1))[1]) for b in range(self.count)]), F.col("bucket") + 1)
        dealt = rows.withColumn("bucket", self.bucket()).filter(F.col("bucket").isin(due)).withColumn("generation", other).withColumn("version", F.lit(version).cast("long"))
        dealt.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "generation").parquet(self.path)
