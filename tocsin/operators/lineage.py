"""Cutting lineage where a result is read several times, so it is computed once and survives the loss of executors."""
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str = "checkpoints") -> str:
    """The folder the cluster names in spark.checkpoint.dir; where it names none, one below the warehouse, which executors share too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return f"{(named or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{name}"


def stable(df: DataFrame) -> DataFrame:
    """Checkpoint below the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
