"""The corpus pipeline: from raw documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.

Edge cases are those of the operators.  Beyond them: a document with a null
key is judged by its text, but is no one's duplicate and is never found to be
contaminated; rows that share a key are one document, of which the second
stage keeps one row; every stage makes an empty table of an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm import decontam, mixing, ngram_join, quality, token_files
from narrata.llm.graph import small
from narrata.llm.queries import held_out, tokenizer_path
from narrata.llm.scratch import bounded_batches, cut


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    It learns from the labelled documents that are not held out.
    """
    labels = bounded_batches(spark).read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    return quality.score(docs, quality.fit(docs, labels)).filter("predicted = 1").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest key."""
    bounded_batches(spark)
    linked = cut(ngram_join.link(docs), "linked")
    if not linked.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        docs = docs.filter("doc_id IS NULL").unionByName(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    return _without(docs, linked.filter("component_id <> doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    bounded_batches(spark)
    return _without(docs, decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; those of which it takes none go."""
    bounded_batches(spark)
    mixed = mixing.pareto_mix(docs.withColumn("__words", mixing.word_count(F.col("text"))), size="__words")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.filter("copies > 0").withColumn("__copy", copies).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in the token files, as read back from them."""
    bounded_batches(spark)
    return token_files.tokens(docs, tokenizer_path())


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    gone = cut(found.select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(small(gone), docs["doc_id"] == F.col("__gone"), "left_anti")


STAGES = [
    ("quality", keep_quality),
    ("near duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token files", write_tokens),
]

#: SQL cannot express the classifier, the retrieval or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
