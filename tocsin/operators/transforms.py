"""Series transforms and the registry that maps a transform or scale name to its column builder."""
from pyspark.sql import DataFrame, Window, functions as F

from tocsin.functions import scoring as S

# Fixed values of the published rules.
CHANGE_LAG = {"daily": 20, "monthly": 3}
STEP_DAYS, STEP_GAP, STEP_Z = 14, 30, 3.0
EVENT_Z = 2.5


def chg(points: DataFrame, keys=("series_id",), kind="daily", order="day") -> DataFrame:
    """Percent change over 20 points (daily) or 3 (monthly), where the earlier value is positive."""
    was = F.lag("value", CHANGE_LAG[kind]).over(Window.partitionBy(*keys).orderBy(order))
    return (points.withColumn("_was", was).where(F.col("_was") > 0)
            .withColumn("value", 100.0 * (F.col("value") / F.col("_was") - 1)).drop("_was"))


def step(points: DataFrame, keys=("series_id",)) -> DataFrame:
    """Change since the last point 14 to 44 days back, three z per unit, clipped."""
    p = points.withColumn("_d", F.datediff("day", F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy(*keys).orderBy("_d").rangeBetween(-(STEP_DAYS + STEP_GAP), -STEP_DAYS)
    raw = STEP_Z * (F.col("value") - F.last("value").over(w))
    return (p.withColumn("z_raw", raw).where(F.col("z_raw").isNotNull()).drop("_d")
            .withColumn("z", S.clip(F.col("z_raw"), -S.WINSOR, S.WINSOR)))


def event(points: DataFrame, keys=("series_id",)) -> DataFrame:
    """2.5 z per unit of the reading itself."""
    raw = EVENT_Z * F.col("value")
    return points.withColumn("z_raw", raw).withColumn("z", S.clip(raw, -S.WINSOR, S.WINSOR))


TRANSFORMS = {"chg": chg, "step": step, "event": event}


def apply(points: DataFrame, name: str, **kw) -> DataFrame:
    return points if name is None else TRANSFORMS[name](points, **kw)


def step_up(points: DataFrame, keys, per_unit=2.5, days=31, publish_lag=7) -> DataFrame:
    """Rise above the trailing minimum, scaled, capped at 5 and dated to the day it became public."""
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(-(days - 1), 0)
    rise = F.greatest(F.col("value") - F.min("value").over(w), F.lit(0.0))
    return points.select(*keys, F.date_add("day", publish_lag).alias("day"), F.least(per_unit * rise, F.lit(5.0)).alias("e"))


def prefix_lookup(rows: DataFrame, prefixes: DataFrame, key="series_id", attr="setting") -> DataFrame:
    """First matching prefix by priority decides the setting. `prefixes` (prefix, priority, setting) is a small fixed table."""
    hit = rows.join(F.broadcast(prefixes), F.col(key).startswith(F.col("prefix")), "left")
    return hit.groupBy(*rows.columns).agg(F.min_by(attr, "priority").alias(attr))


def drop_newest(points: DataFrame, keys, n) -> DataFrame:
    """Leave out the newest n points of each series (not yet complete)."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("day")))
    return points.withColumn("_rn", rn).where(F.col("_rn") > n).drop("_rn")


def drop_partial_day(points: DataFrame, now) -> DataFrame:
    """Leave out the day of `now` (a timestamp column or literal), which is not over, and any later one; days are those of the session's time zone."""
    return points.where(F.col("day") < F.to_date(now))


def newest(points: DataFrame, keys, n) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("day")))
    return points.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")
