"""Appending exactly once: every micro-batch owns a folder of rows, and a ledger of finished batches stands beside the rows.

A batch that is tried again, whole or after half of it was written, replaces its own folder and is entered again under the same number, so the log does not
change. Readers see entered batches only. A chained log takes its start from the batches before it, never from its own earlier try.
"""
from pyspark.sql import DataFrame, SparkSession, functions as F

from tocsin.operators import record

ENTRY = "rows long, batch long"


def entered(spark: SparkSession, path: str) -> DataFrame:
    """rows, batch: the ledger; none before the first batch."""
    try:
        return spark.read.schema(ENTRY).option("basePath", f"{path}/ledger").parquet(f"{path}/ledger")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ENTRY)


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all entered batches, with the batch's number."""
    done = entered(spark, path)
    if done.isEmpty():
        return spark.createDataFrame([], f"{schema}, batch long")
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.join(done.select("batch"), "batch", "left_semi")


def append_once(path: str):
    """foreachBatch writer of plain rows."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        n = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/rows/batch={number}").count()
        _enter(batch.sparkSession, path, number, n)
    return write


def append_chain(path: str, order: str, fields, by: str):
    """foreachBatch writer of hash chains, one for every value of `by`. The new rows go on from the newest hash of each chain; the ends of the
    chains are kept per batch, so that a start is found without reading the log."""
    fields = list(fields)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = f"{by} {batch.schema[by].dataType.simpleString()}, seq long, hash string, batch long"
        before = entered(spark, path).where(F.col("batch") < number)
        rows = batch.withColumns({"_start": F.lit(record.GENESIS), "_base": F.lit(0).cast("long")})
        if not before.isEmpty():
            ends = spark.read.schema(schema).option("basePath", f"{path}/ends").parquet(f"{path}/ends").join(before.select("batch"), "batch", "left_semi")
            last = ends.groupBy(by).agg(F.max(F.struct("seq", "hash")).alias("_l"))
            rows = batch.join(last, by, "left").withColumns({"_start": F.coalesce("_l.hash", F.lit(record.GENESIS)), "_base": F.coalesce(F.col("_l.seq") + 1, F.lit(0).cast("long"))}).drop("_l")
        out = record.chain(rows, order, [*fields, "_base"], [by], F.col("_start"), body=fields)
        out = out.select(by, *[f for f in fields if f != by], (F.col("seq") + F.col("_base")).alias("seq"), "prev_hash", "hash")
        out.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        kept = spark.read.schema(out.schema).parquet(f"{path}/rows/batch={number}")
        kept.groupBy(by).agg(F.max(F.struct("seq", "hash")).alias("l")).select(by, "l.seq", "l.hash").write.mode("overwrite").parquet(f"{path}/ends/batch={number}")
        _enter(spark, path, number, kept.count())
    return write


def _enter(spark: SparkSession, path: str, number: int, rows: int) -> None:
    spark.createDataFrame([(rows,)], "rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")
