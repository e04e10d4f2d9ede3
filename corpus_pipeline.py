"""The corpus pipeline: stages applied in turn, each written as Parquet and read again as the next one's documents."""
import uuid

from pyspark.sql import DataFrame, SparkSession

from tocsin.llm import stages
from tocsin.llm.shared import documents, shared_folder

STAGES = stages.STAGES
#: SQL can't express the fitted classifier or the ring; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
