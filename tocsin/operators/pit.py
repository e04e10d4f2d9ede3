"""Point-in-time access: what was public on each day, and as-of joins."""
from pyspark.sql import DataFrame, Window, functions as F


def available(points: DataFrame, lag_days) -> DataFrame:
    """Adds `avail`, the day each point became public."""
    lag = F.lit(lag_days) if isinstance(lag_days, int) else lag_days
    return points.withColumn("avail", F.date_add("day", lag))


def as_of(asks: DataFrame, states: DataFrame, keys, ask="day", at="avail", cols=("value",)) -> DataFrame:
    """For each ask the newest state dated on or before it: both sides in one ordered scan per key, no range join.

    A state dated on the ask's own day counts. NULL before the first state.
    """
    keys = list(keys)
    a = asks.select(*keys, F.col(ask).alias("_t"), F.lit(1).alias("_ask"), *[c for c in asks.columns if c not in keys and c != ask])
    packed = F.struct(*[F.col(c) for c in cols])
    s = states.select(*keys, F.col(at).alias("_t"), F.lit(0).alias("_ask"), packed.alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_t", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    u = a.unionByName(s, allowMissingColumns=True).withColumn("_s", F.last("_s", ignorenulls=True).over(w))
    return u.where("_ask = 1").withColumnRenamed("_t", ask).select(*asks.columns, *[F.col(f"_s.{c}").alias(c) for c in cols])


def next_after(asks: DataFrame, states: DataFrame, keys, ask="day", at="day", name="next") -> DataFrame:
    """For each ask the first state strictly after it."""
    a = asks.withColumn("_t", F.col(ask)).withColumn("_ask", F.lit(1))
    s = states.select(*keys, F.col(at).alias("_t"), F.lit(0).alias("_ask"))
    w = Window.partitionBy(*keys).orderBy("_t", "_ask").rowsBetween(1, Window.unboundedFollowing)
    u = a.unionByName(s, allowMissingColumns=True)
    return u.withColumn(name, F.min(F.when(F.col("_ask") == 0, F.col("_t"))).over(w)).where("_ask = 1").drop("_t", "_ask")


def replay(scores: DataFrame, calendar_days: DataFrame, keys, lag_days, cols=("z",)) -> DataFrame:
    """Every series' newest public score on each replay day."""
    return as_of(calendar_days, available(scores, lag_days), keys, cols=cols)
