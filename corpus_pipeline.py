"""A training-data pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

run() applies the stages to `documents`; each stage's result is written as Parquet to the
shared folder and read again as the next one's documents.
"""

from pyspark.sql import DataFrame, SparkSession

from cueloom.llm.common import scratch, table
from cueloom.llm.decontamination import drop_contaminated
from cueloom.llm.jaccard_join import keep_one
from cueloom.llm.language_id import keep_identified
from cueloom.llm.mixing import mixed_documents
from cueloom.llm.sharding import shard_rows


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised (those without any letters go)."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near-duplicates, the one of the least doc_id."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with shard and slot."""
    return shard_rows(docs, "doc_id")


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mixture), ("sharding", shards)]

ORACLE_SQL = None  # trained profiles and hash-based rounding have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
