"""Labels and event features of an entity-day panel."""
from pyspark.sql import DataFrame, Window, functions as F

from tocsin.functions import scoring as S

HORIZON = 30
AFTER = 30


def _around(events, key, lo, hi, cols=()):
    """Each event copied to the days lo..hi from its date (negative = before): a linear interval join key."""
    return events.select(key, *cols, F.col("day").alias("event_day"),
                         F.explode(F.sequence(F.date_add("day", lo), F.date_add("day", hi))).alias("day"))


def build(days: DataFrame, events: DataFrame, through: DataFrame, key="theatre", horizon=HORIZON, after=AFTER) -> DataFrame:
    """y = an event follows within 1..horizon days; excl = 0..after days after one; unk = the window ahead is not fully known;
    eid = the lowest event id ahead. `through` has one row, column d: the last day the event list is complete for."""
    ahead = _around(events, key, -horizon, -1, ["event_id"]).groupBy(key, "day").agg(F.min("event_id").alias("eid"))
    past = _around(events, key, 0, after).groupBy(key, "day").agg(F.lit(True).alias("excl"))
    return (days.join(ahead, [key, "day"], "left").join(past, [key, "day"], "left")
            .withColumn("y", F.col("eid").isNotNull().cast("int"))
            .withColumn("excl", F.coalesce("excl", F.lit(False)))
            .withColumn("unk", F.col("day") > F.date_sub(through.select("d").scalar(), horizon)))


def site_copies(events: DataFrame, key="theatre", site="site") -> DataFrame:
    """Each event for its own theatre, and one copy (dup) for every sub-theatre listed in `site` (';'-joined)."""
    own = events.withColumn("dup", F.lit(False))
    copies = (events.where(F.col(site) != "").withColumn(key, F.explode(F.split(site, ";"))).withColumn("dup", F.lit(True)))
    return own.unionByName(copies)


def history(days: DataFrame, events: DataFrame, key="theatre") -> DataFrame:
    """Scaled conflict history from strictly earlier events: capped counts over one and three years, log days since the last.

    One event count per day is attached to the calendar and summed over day ranges, so the cost does not grow with
    days times events.
    """
    per_day = events.groupBy(key, "day").agg(F.count(F.lit(1)).alias("_k"))
    n = F.datediff("day", F.lit("1970-01-01").cast("date"))
    both = (days.select(key, "day").withColumn("_ask", F.lit(True))
            .join(per_day, [key, "day"], "full").withColumn("_d", n))
    w = Window.partitionBy(key).orderBy("_d")
    k = F.coalesce("_k", F.lit(0))
    last = F.last(F.when(F.col("_k") > 0, F.col("_d")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    h1 = F.coalesce(F.sum(k).over(w.rangeBetween(-365, -1)), F.lit(0))
    h3 = F.coalesce(F.sum(k).over(w.rangeBetween(-1095, -1)), F.lit(0))
    since = F.least(F.coalesce(F.col("_d") - last, F.lit(3650)), F.lit(3650))
    return (both.select(key, "day", "_ask", h1.alias("n_1y"), h3.alias("n_3y"), since.alias("since"))
            .where("_ask").drop("_ask")
            .withColumn("h1", F.least("n_1y", F.lit(3)) / 3).withColumn("h3", F.least("n_3y", F.lit(5)) / 5)
            .withColumn("hs", F.log1p("since") / F.log1p(F.lit(3650.0))))


def recent_counts(days: DataFrame, events: DataFrame, groups: DataFrame, key="theatre") -> DataFrame:
    """Own events 30..90 days back, the linked group's and everyone else's in the last 90 (1..90 days back).

    groups: (key, linked): which other entities are linked to each one.
    """
    own = _around(events, key, 30, 90).groupBy(key, "day").agg(F.count(F.lit(1)).alias("own_30_90"))
    own90 = _around(events, key, 1, 90).groupBy(key, "day").agg(F.count(F.lit(1)).alias("_own90"))
    linked = (_around(events, key, 1, 90).withColumnRenamed(key, "linked").groupBy("linked", "day").agg(F.count(F.lit(1)).alias("_n"))
              .join(groups, "linked").groupBy(key, "day").agg(F.sum("_n").alias("linked_90")))
    world = _around(events, key, 1, 90).groupBy("day").agg(F.count(F.lit(1)).alias("_all"))
    out = days.join(own, [key, "day"], "left").join(own90, [key, "day"], "left").join(linked, [key, "day"], "left").join(world, "day", "left")
    z = F.lit(0).cast("long")
    return out.select(key, "day", F.coalesce("own_30_90", z).alias("own_30_90"), F.coalesce("linked_90", z).alias("linked_90"),
                      (F.coalesce("_all", z) - F.coalesce("_own90", z) - F.coalesce("linked_90", z)).alias("elsewhere_90"))


def decay_history(days: DataFrame, events: DataFrame, half_lives, key="theatre") -> DataFrame:
    """log1p of the sum of 2^(-age / h) over strictly earlier events, per half-life.

    The sum over the past is a running total of 2^(d/h) rescaled by today's 2^(-d/h): one cumulative window, no event-day pairs.
    """
    per_day = events.groupBy(key, "day").agg(F.count(F.lit(1)).alias("_k"))
    both = days.select(key, "day").withColumn("_ask", F.lit(True)).join(per_day, [key, "day"], "full")
    w = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    d = F.datediff("day", F.min("day").over(Window.partitionBy(key)))
    both = both.withColumn("_d", d)
    cols = [F.log1p(F.coalesce(F.sum(F.coalesce("_k", F.lit(0)) * F.pow(F.lit(2.0), F.col("_d") / h)).over(w), F.lit(0.0))
                    * F.pow(F.lit(2.0), -F.col("_d") / h)).alias(f"decay_{h}") for h in half_lives]
    return both.select(key, "day", "_ask", *cols).where("_ask").drop("_ask")


def calm_windows(days: DataFrame, events: DataFrame, key="theatre", before=30, after=30) -> DataFrame:
    """The days with no event from `before` days ahead of an event to `after` days past it."""
    return days.join(_around(events, key, -before, after).select(key, "day").distinct(), [key, "day"], "left_anti")


def onsets(events: DataFrame, key="theatre", gap=30) -> DataFrame:
    """Events more than `gap` days after the previous event of the same key (kept or not)."""
    prev = F.lag("day").over(Window.partitionBy(key).orderBy("day", "event_id"))
    return events.withColumn("_p", prev).where(F.col("_p").isNull() | (F.datediff("day", "_p") > gap)).drop("_p")


def forward_exceeds(series: DataFrame, key="theatre", past=365, ahead=30, need=180, prob=0.9) -> DataFrame:
    """Proxy label: does the 7-day count top, in the next 30 days, its own trailing-year quantile?"""
    w = Window.partitionBy(key).orderBy("day")
    d = series.withColumn("c7", F.when(F.count("value").over(w.rowsBetween(-6, 0)) >= 4, F.sum("value").over(w.rowsBetween(-6, 0))))
    d = d.withColumn("_n", F.count("c7").over(w.rowsBetween(-past, -1)))
    d = d.withColumn("cut", F.when(F.col("_n") >= need, S.array_quantile(F.collect_list("c7").over(w.rowsBetween(-past, -1)), prob)))
    nxt = w.rowsBetween(1, ahead)
    d = d.withColumn("_m", F.max("c7").over(nxt)).withColumn("_c", F.count(F.lit(1)).over(nxt))
    ok = F.col("cut").isNotNull() & (F.col("_c") == ahead) & F.col("_m").isNotNull()
    return d.where(ok).select(key, "day", "c7", "cut", (F.col("_m") > F.col("cut")).cast("int").alias("y"))
