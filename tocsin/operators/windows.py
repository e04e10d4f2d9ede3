"""Window operators over daily series: runs, onsets, trailing counts, tell primitives, smoothing, thresholds."""
import math

from pyspark.sql import DataFrame, Window, functions as F

from tocsin.functions import scoring as S


def _n(day="day"):
    return F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))


def _range(keys, lo, hi):
    return Window.partitionBy(*keys).orderBy(_n()).rangeBetween(lo, hi)


# ------------------------------------------------------------------ tell primitives (Columns over a daily series)
def rose(keys, value="value", days=7, back=60):
    """The newest value is above the last one dated days+1 .. days+back days before."""
    now = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(_n()).rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(now > F.last(value, ignorenulls=True).over(_range(keys, -(days + back), -(days + 1))), F.lit(False))


def _median(keys, value, lo, hi):
    return S.median(F.collect_list(value).over(_range(keys, lo, hi)))


def surge(keys, mult, floor, recent=3, base=90, need=30, value="value"):
    """Recent mean at least `mult` times the median of the days before, and at least `floor`."""
    r, b = _range(keys, -(recent - 1), 0), _range(keys, -(recent + base - 1), -recent)
    m = F.avg(value).over(r)
    ok = (F.count(value).over(r) >= max(1, recent - 1)) & (F.count(value).over(b) >= need)
    return F.coalesce(ok & (m >= floor) & (m >= mult * _median(keys, value, -(recent + base - 1), -recent)), F.lit(False))


def slump(keys, frac, recent=7, base=60, need=30, value="value"):
    """Recent mean at most `frac` of a positive median of the days before."""
    r, b = _range(keys, -(recent - 1), 0), _range(keys, -(recent + base - 1), -recent)
    med = _median(keys, value, -(recent + base - 1), -recent)
    ok = (F.count(value).over(r) >= recent - 2) & (F.count(value).over(b) >= need)
    return F.coalesce(ok & (med > 0) & (F.avg(value).over(r) <= frac * med), F.lit(False))


# rule name -> builder(keys) of a boolean Column over the rule's series; two-series rules read value and value2.
TELLS = {
    "departure": lambda k: rose(k),
    "leave": lambda k: rose(k) & (F.coalesce(F.sum("value2").over(_range(k, -6, 0)), F.lit(0)) > 0),
    "airlines": lambda k: slump(k, 0.6),
    "tankers": lambda k: surge(k, 3, 4),
    "airspace": lambda k: rose(k) | surge(k, 1.5, 10, recent=1, base=30, need=14, value="value2"),
    "sea": lambda k: surge(k, 2, 3, recent=1),
    "wave": lambda k: surge(k, 2, 5, recent=1),
    "bases": lambda k: F.col("value") >= 1,
    "diverted": lambda k: surge(k, 3, 3, recent=2),
    "bizjets": lambda k: surge(k, 2, 5),
    "dark": lambda k: surge(k, 1.5, 30, recent=1, base=90, need=10),
}


def fires(series: DataFrame, tell: str, keys) -> DataFrame:
    return series.withColumn("fired", TELLS[tell](list(keys)))


def fresh_onsets(flags: DataFrame, keys, flag="fired", quiet=7) -> DataFrame:
    """Days a flag turns on after `quiet` days off, on a gap-free calendar (a series start counts as quiet)."""
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(-quiet, -1)
    return (flags.withColumn("_on", F.coalesce(F.max(F.col(flag).cast("int")).over(w), F.lit(0)))
            .where(F.col(flag) & (F.col("_on") == 0)).drop("_on"))


def runs(flags: DataFrame, keys, flag="on", bridge=7, measures=None) -> DataFrame:
    """Runs of true days, bridging up to `bridge` false days: keys, start, end, days."""
    w = Window.partitionBy(*keys).orderBy("day")
    on = flags.where(F.col(flag))
    gap = F.datediff("day", F.lag("day").over(w)) - 1
    on = on.withColumn("_new", F.when(gap > bridge, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    return on.groupBy(*keys, "_run").agg(
        F.min("day").alias("start"), F.max("day").alias("end"), *(measures or [])
    ).withColumn("days", F.datediff("end", "start") + 1).drop("_run")


def trailing_count(events: DataFrame, keys, days, calendar_days: DataFrame, inclusive=True) -> DataFrame:
    """How many dated events fall in the last `days` days of each calendar day, from the first day the archive covers fully.

    inclusive: also count the event exactly `days` days old.
    """
    span = days if inclusive else days - 1
    per = events.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("_k"))
    d = calendar_days.join(per, [*keys, "day"], "left")
    first = F.min(F.when(F.col("_k").isNotNull(), F.col("day"))).over(Window.partitionBy(*keys))
    n = F.coalesce(F.sum("_k").over(_range(keys, -span, 0)), F.lit(0))
    return (d.withColumn("n", n).withColumn("_first", first).where(F.col("day") >= F.date_add("_first", days))
            .select(*keys, "day", "n"))


def window_max(z: DataFrame, keys, lead=30, value="z", need=None) -> DataFrame:
    """Highest z in the `lead` days before each day; NULL when fewer than `need` of them (half, if not given) are scored."""
    w = _range(keys, -lead, -1)
    return z.withColumn("wmax", F.when(F.count(value).over(w) >= (lead // 2 if need is None else need), F.max(value).over(w)))


def rolling_max(z: DataFrame, keys, days=30, need=15, value="z") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(-(days - 1), 0)
    return z.withColumn("rmax", F.when(F.count(value).over(w) >= need, F.max(value).over(w)))


def ewma(points: DataFrame, keys, alpha=0.3, value="value") -> DataFrame:
    """Exponentially weighted mean, seeded with the first value.

    A fold over a frame of fixed length: points before it weigh less than a double can tell (exp(-40)), so the seed matters only
    where it is inside the frame."""
    frame = math.ceil(-40 / math.log(1 - alpha))
    arr = F.collect_list(value).over(Window.partitionBy(*keys).orderBy("day").rowsBetween(-frame, 0))
    return (points.withColumn("_a", arr)
            .withColumn("ewma", F.aggregate(F.slice("_a", 2, frame), F.element_at("_a", 1).cast("double"),
                                            lambda s, v: alpha * v + (1 - alpha) * s)).drop("_a"))


def change_points(points: DataFrame, keys, value="value", seam=None) -> DataFrame:
    """Days on which the value differs from the previous one, leaving out the day the method changed."""
    prev = F.lag(value).over(Window.partitionBy(*keys).orderBy("day"))
    out = points.withColumn("was", prev).where(F.col("was").isNotNull() & (F.col("was") != F.col(value)))
    return out if seam is None else out.where(F.col("day") != F.lit(seam).cast("date"))


def week_change(points: DataFrame, keys, days=7) -> DataFrame:
    """Newest value and its change against the newest point at least `days` days older, else against the oldest point."""
    last = points.groupBy(*keys).agg(F.max("day").alias("_last"))
    p = points.join(last, keys)
    old = F.col("day") <= F.date_sub("_last", days)
    return p.groupBy(*keys).agg(
        F.max("day").alias("day"), F.max_by("value", "day").alias("now"),
        F.coalesce(F.max_by(F.when(old, F.col("value")), F.when(old, F.col("day"))), F.min_by("value", "day")).alias("then")
    ).withColumn("change", F.col("now") - F.col("then"))


def downsample(points: DataFrame, keys, n) -> DataFrame:
    """At most n points, evenly spread, first and last kept."""
    w = Window.partitionBy(*keys)
    p = points.withColumn("_i", F.row_number().over(w.orderBy("day")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    slot = F.round(F.col("_i") * (n - 1) / (F.col("_n") - 1))
    back = F.bround(slot * (F.col("_n") - 1) / (n - 1))
    return p.where((F.col("_n") <= n) | (back == F.col("_i"))).drop("_i", "_n")


def round_robin(rows: DataFrame, group, order, n) -> DataFrame:
    """At most n rows in all, taken in turn from each group in order (the cap is the feature).

    No group can give more than n rows, so the rank filter lets every task keep only its own first n per group.
    """
    rn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("turn", rn).where(F.col("turn") <= n).orderBy("turn", group).limit(n)


def weekly_first(rows: DataFrame, keys, ts="ts", digest="digest") -> DataFrame:
    """The first row of each week, kept when its digest differs from the previous examined week's."""
    p = rows.withColumn("week", F.to_date(F.date_trunc("week", ts)))
    first = p.groupBy(*keys, "week").agg(F.min(F.struct(ts, digest)).alias("_f")).select(*keys, "week", "_f.*")
    prev = F.lag(digest).over(Window.partitionBy(*keys).orderBy("week"))
    return first.withColumn("_p", prev).where(F.col("_p").isNull() | (F.col("_p") != F.col(digest))).drop("_p")


def expanding_level(points: DataFrame, keys, need=365) -> DataFrame:
    """z of the log 30-day mean against the median / MAD of everything before it."""
    w = Window.partitionBy(*keys).orderBy("day")
    m = w.rowsBetween(-29, 0)
    d = points.withColumn("x", F.when(F.count("value").over(m) >= 20, F.log1p(F.avg("value").over(m))))
    d = d.withColumn("_s", F.collect_list("x").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.where((F.size("_s") >= need) & F.col("x").isNotNull()).select(*keys, "day", "x", "_s")
    d = d.select("*", F.inline(F.array(S.spread(F.col("_s"))))).where(F.col("mad") > 0)
    return d.select(*keys, "day", S.clip(S.MAD_TO_SD * (F.col("x") - F.col("base_med")) / F.col("mad"), 0.0, 5.0).alias("e"))


def short_acceleration(points: DataFrame, keys, base=60, need=40) -> DataFrame:
    """7-day mean against the median / MAD of the 60 days that end a week earlier."""
    w = Window.partitionBy(*keys).orderBy("day")
    m = w.rowsBetween(-6, 0)
    d = points.withColumn("x", F.when(F.count("value").over(m) >= 4, F.avg("value").over(m)))
    d = d.withColumn("_s", F.collect_list("value").over(w.rowsBetween(-(base + 6), -7)))
    d = d.where((F.size("_s") >= need) & F.col("x").isNotNull()).select(*keys, "day", "x", "_s")
    d = d.select("*", F.inline(F.array(S.spread(F.col("_s"))))).where(F.col("mad") > 0)
    return d.select(*keys, "day", S.clip(S.MAD_TO_SD * (F.col("x") - F.col("base_med")) / F.col("mad"), 0.0, 5.0).alias("e"))


def trade_z(monthly: DataFrame, keys) -> DataFrame:
    """3-month sum against the 3-month sums that ended 12 to 35 months back."""
    w = Window.partitionBy(*keys).orderBy("month")
    d = monthly.withColumn("s3", F.when(F.count("value").over(w.rowsBetween(-2, 0)) == 3, F.sum("value").over(w.rowsBetween(-2, 0))))
    b = w.rowsBetween(-35, -12)
    d = d.withColumn("mu", F.avg("s3").over(b)).withColumn("sd", F.stddev_pop("s3").over(b)).withColumn("c", F.count("s3").over(b))
    sd = F.greatest(F.col("sd"), 0.25 * F.col("mu"), F.lit(1.0))
    return d.where((F.col("c") == 24) & F.col("s3").isNotNull()).select(*keys, "month", ((F.col("s3") - F.col("mu")) / sd).alias("z"))


def alert_rules(panel: DataFrame, key="theatre") -> DataFrame:
    """Alternative alert readings of a probability: over its own one-year median, 14-day rise, 7-day mean and max, own-year
    percentile, and half-life smoothing left to `ewma`."""
    w = Window.partitionBy(key).orderBy("day")
    d = panel.withColumn("_y", F.collect_list("p").over(w.rowsBetween(-365, -1)))
    d = d.withColumn("_q", F.collect_list("p").over(w.rowsBetween(-364, -1)))
    below = F.size(F.filter("_q", lambda x: x < F.col("p")))
    return d.select(key, "day", "p", F.when(F.size("_y") >= 120, F.col("p") / S.median(F.col("_y"))).alias("over_median"),
                    (F.col("p") - F.lag("p", 14).over(w)).alias("rise_14"), F.max("p").over(w.rowsBetween(-6, 0)).alias("max_7"),
                    F.when(F.size("_q") >= 119, below / F.size("_q")).alias("own_pct"))
