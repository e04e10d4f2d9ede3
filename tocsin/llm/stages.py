"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and works on all rows that the one before kept."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from tocsin.llm import leaks, lines, mixing, near, sharding

LEAST_QUALITY, SHARDS = 0.3, 24


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score reaches the limit."""
    field = lines.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return lines.scored(docs, field, docs.columns, LEAST_QUALITY).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the least doc_id."""
    return near.representatives(docs)


def leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item."""
    return leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed(docs, mixing.by_code_point((5, 2, 1)), budget=1.5, most=2)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size and check sum of each row with its shard and its place there."""
    return sharding.shard(sharding.sizes(docs), SHARDS, ["doc_id", "size", "text_crc32"])


STAGES = [("quality classifier", quality), ("near copies", near_copies), ("decontamination", leaked), ("mixture", mixture), ("sharding", shards)]
