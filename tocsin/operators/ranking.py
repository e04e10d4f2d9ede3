"""Ordered scans over tables of any size.

A global rank or running total normally needs one unpartitioned window, that is, one task. Here the distinct values are
first reduced, then cut into ranges at approximate quantiles; a short window over the range totals gives each range its
starting offset, and the scan inside each range runs in parallel. Results are exact: the quantiles only place the cuts.
"""
from pyspark.sql import DataFrame, Window, functions as F

from tocsin.operators.lineage import stable

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def ordered_scan(df: DataFrame, order: str, measures: dict, by=(), reverse=False, ranges=None) -> DataFrame:
    """Totals per distinct (by, order) value plus, as `<name>_before`, the running total of all values ahead of it.

    measures: name -> (kind, Column) with kind one of sum / min / max. reverse scans from the largest value down.
    A NULL `_before` (nothing ahead) becomes 0 for sums. There are as many ranges as the session has shuffle partitions, if not told.
    """
    by = list(by)
    ranges = ranges or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    compact = stable(df.groupBy(*by, order).agg(*[_AGG[k](c).alias(n) for n, (k, c) in measures.items()]))
    cuts = compact.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10000).alias("c")).scalar()
    cut = compact.withColumn("_cuts", cuts).withColumn(
        "_r", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    if reverse:
        cut = cut.withColumn("_r", -F.col("_r"))
    offsets = cut.groupBy(*by, "_r").agg(*[_AGG[k](n).alias(n) for n, (k, _) in measures.items()])
    ahead = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(*by, "_r", *[_AGG[k](n).over(ahead).alias(f"_o_{n}") for n, (k, _) in measures.items()])
    inside = (Window.partitionBy(*by, "_r").orderBy(F.desc(order) if reverse else F.asc(order))
              .rowsBetween(Window.unboundedPreceding, -1))
    out = cut.join(offsets, [*by, "_r"])

    def before(n, kind):
        here, off = _AGG[kind](n).over(inside), F.col(f"_o_{n}")
        if kind == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce(off, F.lit(0))
        return F.least(here, off) if kind == "min" else F.greatest(here, off)   # both skip NULLs
    return out.select(*by, order, *measures, *[before(n, k).alias(f"{n}_before") for n, (k, _) in measures.items()])


def average_ranks(df: DataFrame, value: str, by=(), ranges=None) -> DataFrame:
    """Distinct values with their tie-averaged rank (1-based), count and group size."""
    s = ordered_scan(df.where(F.col(value).isNotNull()), value, {"n": ("sum", F.lit(1))}, by, ranges=ranges)
    size = F.max(F.col("n_before") + F.col("n")).alias("group_n")
    s = s.join(s.groupBy(*by).agg(size), list(by)) if by else s.withColumn("group_n", s.agg(size).scalar())
    return s.select(*by, value, "n", "group_n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"))


def exact_quantiles(df: DataFrame, value: str, probs, by=(), method="linear", ranges=None) -> DataFrame:
    """Exact quantiles per group, one column q0, q1, ... per entry of probs.

    method 'linear' interpolates between order statistics; 'index' takes the value at floor(p * n), capped at the last.
    """
    by = list(by)
    r = average_ranks(df, value, by, ranges).withColumn("_lo", F.col("rank") - (F.col("n") + 1) / 2)
    picks = []
    for i, p in enumerate(probs):
        if method == "index":
            at = F.least(F.floor(F.lit(p) * F.col("group_n")), F.col("group_n") - 1)
            picks.append(F.max(F.when((F.col("_lo") <= at) & (at < F.col("_lo") + F.col("n")), F.col(value))).alias(f"q{i}"))
            continue
        h = (F.col("group_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        at_lo = F.max(F.when((F.col("_lo") <= lo) & (lo < F.col("_lo") + F.col("n")), F.col(value)))
        at_hi = F.max(F.when((F.col("_lo") <= hi) & (hi < F.col("_lo") + F.col("n")), F.col(value)))
        frac = F.max(h - lo)
        picks.append((at_lo + (at_hi - at_lo) * frac).alias(f"q{i}"))
    return r.groupBy(*by).agg(*picks)


def islands(df: DataFrame, keys, ts: str, gap_seconds: int, bucket_seconds: int = 86400) -> DataFrame:
    """Runs of rows whose consecutive times differ by at most `gap_seconds`: (keys, started, ended, rows).

    Two levels, so one busy key never sits in one task: runs are found inside each (key, time bucket) first, and only the
    bucket runs are chained across buckets.
    """
    keys = list(keys)
    sec = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))
    base = df.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("_t"), sec.alias("_u"))
    base = base.groupBy(*keys, "_u").agg(F.first("_t").alias("_t"), F.count(F.lit(1)).alias("_n"))
    base = base.withColumn("_b", F.floor(F.col("_u") / (bucket_seconds * 1000000)))

    def runs(d, part, start, stop, count):
        w = Window.partitionBy(*part).orderBy(start[0])
        new = F.when(F.col(start[0]) - F.lag(stop[0]).over(w) > gap_seconds * 1000000, 1).otherwise(0)
        marked = d.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
        return marked.groupBy(*part, "_run").agg(
            F.min(start[0]).alias("_u0"), F.max(stop[0]).alias("_u1"),
            F.min(start[1]).alias("started"), F.max(stop[1]).alias("ended"), F.sum(count).alias("rows"))
    local = runs(base, [*keys, "_b"], ("_u", "_t"), ("_u", "_t"), "_n").drop("_run", "_b")
    whole = runs(local, keys, ("_u0", "started"), ("_u1", "ended"), "rows")
    return whole.select(*keys, "started", "ended", "rows")
