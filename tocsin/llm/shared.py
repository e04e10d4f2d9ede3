"""Helpers of all operators of this package: tables in the shared folder, and names that clash with nothing."""
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPACES = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; only where none is named, one below the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back, so that lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text, 0 for null: each run of words becomes one letter, trailing separators go."""
    letters = F.rtrim(F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x"), F.lit(SPACES))
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Carried:
    """Columns that travel through a Python stage under place names, so that none can clash; the text comes last."""

    def __init__(self, docs: DataFrame, columns: list[str]):
        self.columns = columns
        self.df = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col("text").alias("t"))
        self.schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(self.df.schema.fields[:-1]))

    def back(self, out: DataFrame, *new: str) -> DataFrame:
        """The columns under their names, then the stage's own; one of the columns that has such a name gives way to it."""
        taken = {n.lower() for n in new}
        return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(self.columns) if c.lower() not in taken], *new)
