"""Calendars: gap filling, zero filling, carried values."""
from pyspark.sql import DataFrame, Window, functions as F


def by_series(df: DataFrame, keys) -> DataFrame:
    """Hash the rows by series once, on the session's full shuffle width.

    Scoring is heavy per byte, so the adaptive coalescing of small partitions would leave most cores idle; a stated
    width is kept as is, and every window over the same keys reuses it.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *keys)


def bind(df: DataFrame, **named) -> DataFrame:
    """Add columns through a generator, which the optimizer does not inline into later expressions or filters."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in named.items()]))))


def span(points: DataFrame, keys, day="day", step="1 day") -> DataFrame:
    """One row per key and calendar step between the key's first and last point."""
    return (points.groupBy(*keys).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
            .select(*keys, F.explode(F.expr(f"sequence(_lo, _hi, interval {step})")).alias(day)))


def fill(points: DataFrame, keys=("series_id",), day="day", value="value", max_carry=2) -> DataFrame:
    """Calendar-complete series. A hole carries the last value for at most `max_carry` days, then stays NULL."""
    keys = list(keys)
    past = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    last_day = F.last(F.when(F.col("_v").isNotNull(), F.col(day)), ignorenulls=True).over(past)
    carried = F.when(F.datediff(F.col(day), last_day) <= max_carry, F.last("_v", ignorenulls=True).over(past))
    src = points.select(*keys, day, F.col(value).alias("_v"))
    return (by_series(span(points, keys, day).join(src, [*keys, day], "left"), keys)
            .select(*keys, day, carried.alias(value), F.col("_v").isNotNull().alias("observed"),
                    (F.col("_v").isNull() & carried.isNotNull()).alias("filled")))


def zero_fill(counts: DataFrame, key_rows: DataFrame, keys, bounds: DataFrame, measures, day="day", step="1 day") -> DataFrame:
    """Every key on every step of a shared calendar, with 0 where nothing was counted.

    `bounds` has one row with `lo` and `hi`; the calendar is generated per key, so no cross join is planned.
    """
    keys = list(keys)
    ends = bounds.select(F.struct("lo", "hi").alias("ends")).scalar()  # one pass for both
    grid = key_rows.select(*keys).withColumn(
        day, F.explode(F.sequence(ends.getField("lo"), ends.getField("hi"), F.expr(f"interval {step}"))))
    return (grid.join(counts, [*keys, day], "left")
            .select(*keys, day, *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures]))


def carry(points: DataFrame, keys, day="day", value="value", until=None, max_carry=None) -> DataFrame:
    """Carry each value to the next point (or to `until`), at most `max_carry` days: intervals exploded to days."""
    nxt = F.lead(day).over(Window.partitionBy(*keys).orderBy(day))
    stop = F.date_sub(nxt, 1)
    stop = F.coalesce(stop, F.lit(until).cast("date") if until is not None else F.col(day))
    if max_carry is not None:
        stop = F.least(stop, F.date_add(F.col(day), max_carry))
    return (points.withColumn("_stop", F.greatest(stop, F.col(day)))
            .select(*keys, F.explode(F.sequence(F.col(day), F.col("_stop"))).alias(day), value,
                    F.col(day).alias("known_since")))
