"""Versioned blocks as a table on disk: commits rewrite only the buckets of the books they change.

Current rows are in buckets of books; rows that a commit closes go to the
history, one partition a revision and bucket.  A commit writes the history
first, which no reader sees before the bucket itself has the new version, so a
commit that stops halfway changes nothing and may be repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.operators.revisions import BLOCK
from narrata.sources.buckets import Buckets


class Stale(ValueError):
    """Someone else has written since the revision that a commit starts from."""


@dataclass(frozen=True)
class BlockTable:
    """Blocks (book_id, chapter_id, block_index, text, valid_from, valid_to) under ``path``."""

    path: str
    key: str = "book_id string, chapter_id long, block_index int"
    count: int = 64

    @property
    def _current(self) -> Buckets:
        return Buckets(f"{self.path}/current", f"{self.key}, text string, valid_from int", ("book_id",), self.count)

    def current(self, spark: SparkSession, books: list | None = None) -> DataFrame:
        """Rows that hold now, of all books or of some, whose buckets alone are read."""
        open_rows = lambda rows: rows.withColumn("valid_to", F.lit(None).cast("int"))
        if books is None:
            return open_rows(self._current.read(spark))
        named = spark.createDataFrame([(b,) for b in books], T.StructType([T.StructType.fromDDL(self.key)["book_id"]]))
        return open_rows(self._current.read(spark, only=self._current.touched(named)).filter(F.col("book_id").isin(books)))

    def as_of(self, spark: SparkSession, revision: int) -> DataFrame:
        """Blocks as they were at a revision; of the history only later revisions are read."""
        newest = self._current.newest(spark)
        now = self._current.read(spark, newest).filter(F.col("valid_from") <= revision).withColumn("valid_to", F.lit(None).cast("int"))
        past = self._history(spark)
        if past is None:
            return now
        done = F.element_at(F.array(*[F.lit(newest.get(b, (-1, 0))[0]) for b in range(self.count)]), F.col("bucket") + 1)
        then = past.filter((F.col("valid_to") > revision) & (F.col("valid_from") <= revision) & (F.col("valid_to") <= done))
        return now.unionByName(then.select(*now.columns))

    def _history(self, spark: SparkSession) -> DataFrame | None:
        schema = T.StructType.fromDDL(f"{self.key}, text string, valid_from int, valid_to int, bucket int")
        try:
            return spark.read.schema(schema).parquet(f"{self.path}/history")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def commit(self, changes: DataFrame, revision: int, base: int | None = None) -> None:
        """Close current rows that ``changes`` (key, text) alters and add the new ones.

        Equal texts change nothing, unknown keys are new blocks.  With
        ``base``, a changed book with a row newer than it fails the commit.
        A revision that a bucket has already is not applied to it again.
        """
        spark, table = changes.sparkSession, self._current
        new = changes.select(*BLOCK, F.col("text").alias("new_text"))
        only, newest = table.touched(changes), table.newest(spark)
        only = [b for b in only if newest.get(b, (-1, 0))[0] < revision]
        now = table.read(spark, newest, only)
        if base is not None and not now.filter(F.col("valid_from") > base).join(new, "book_id", "left_semi").isEmpty():
            raise Stale(f"a changed book has revisions after {base}")
        new = new.filter(table.bucket().isin(only))
        joined = now.join(new, BLOCK, "full_outer")
        altered = F.col("new_text").isNotNull() & ~F.col("text").eqNullSafe(F.col("new_text"))
        closed = joined.filter(altered & F.col("valid_from").isNotNull()).select(*BLOCK, "text", "valid_from", F.lit(revision).alias("valid_to"), table.bucket().alias("bucket"))
        closed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("valid_to", "bucket").parquet(f"{self.path}/history")
        held = joined.select(*BLOCK, F.when(altered, F.col("new_text")).otherwise(F.col("text")).alias("text"), F.when(altered, revision).otherwise(F.col("valid_from")).cast("int").alias("valid_from"))
        table.write(held, revision, newest, only)
