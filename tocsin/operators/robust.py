"""Robust anomaly scores of daily and monthly series.

The input is one row per series and day: raw facts are aggregated first, so a window partition is as long as the
series' calendar and no longer, however many raw rows stand behind it.
"""
from pyspark.sql import DataFrame, Window, functions as F

from tocsin.functions import scoring as S
from tocsin.operators import calendar

# Fixed values of the published rule.
YEAR, GUARD, SHORT = 365, 30, 90
YEAR_MIN, SHORT_MIN = 120, 45
KEEP = 450


def _rows(keys, lo, hi):
    return Window.partitionBy(*keys).orderBy("day").rowsBetween(lo, hi)


def weekly_means(filled: DataFrame, keys=("series_id",)) -> DataFrame:
    """7-day mean and how many of the 7 days have a value."""
    w = _rows(keys, -6, 0)
    return filled.withColumn("m7", F.avg("value").over(w)).withColumn("c7", F.count("value").over(w))


def _summary(df, arr):
    """Adds base_med, mad and mean_ad of an array column. The generator keeps later filters from re-evaluating them."""
    return df.select("*", F.inline(F.array(S.spread(F.col(arr)))))


def _finish(df, value, scale, share_point):
    raw = S.modified_z_raw(value, F.col("base_med"), F.col("mad"), F.col("mean_ad"))
    sd = S.base_spread(F.col("mad"), F.col("mean_ad"))
    floor = S.noise_floor(scale, F.col("base_med"), share_point)
    low = floor > sd
    return (df.withColumn("z_raw", F.when(low, (value - F.col("base_med")) / floor).otherwise(raw))
            .withColumn("base_sd", F.when(low, floor).otherwise(sd))
            .withColumn("z", S.clip(F.col("z_raw"), -S.WINSOR, S.WINSOR)))


def score_daily(points: DataFrame, keys=("series_id",), scale=None, share_point=None, base_days=None, newest_only=False,
                since=None, carry_cols=()) -> DataFrame:
    """Score every day with a point as if it were the newest: the last 7-day mean against the 7-day means of the year
    before the newest 30 days, or of the plain last 90 days for a short history.

    scale / share_point: Column or literal for the noise floor. base_days: plain trailing window of that length instead.
    newest_only keeps one row per series and reads only the last KEEP days; `since` drops older output rows.
    """
    keys = list(keys)
    scale = F.lit(scale) if scale is None or isinstance(scale, str) else scale
    share_point = F.lit(share_point).cast("double") if share_point is None or isinstance(share_point, (int, float)) else share_point
    if newest_only:
        newest = points.groupBy(*keys).agg(F.max("day").alias("_newest"))
        points = points.join(newest, keys).where(F.col("day") > F.date_sub("_newest", KEEP)).drop("_newest")
    df = weekly_means(calendar.fill(points, keys), keys)
    df = df.withColumn("_b", F.when(F.col("c7") >= 5, F.col("m7")))
    short = base_days or SHORT
    n_win = YEAR + 7 + GUARD
    have = (F.col("observed") | F.col("filled")).cast("int")
    if newest_only:
        # only the last row is asked for: one hash aggregate over days-back ranges instead of a frame per day
        df = df.join(newest, keys).withColumn("_k", F.datediff("_newest", "day"))
        def back(lo, hi, c):
            return F.when(F.col("_k").between(lo, hi), c)
        df = df.groupBy(*keys).agg(
            F.max("day").alias("day"), F.max(back(0, 0, F.col("m7"))).alias("m7"), F.max(back(0, 0, F.col("c7"))).alias("c7"),
            F.collect_list(back(GUARD, n_win - 7, F.col("_b"))).alias("_year"), F.collect_list(back(0, short, F.col("_b"))).alias("_short"),
            F.sum(F.col("observed").cast("int")).alias("_n"), F.sum(back(0, short + 6, have)).alias("_have"),
            F.sum(back(0, n_win - 1, have)).alias("_have_y"), F.lit(True).alias("observed"))
    else:
        df = df.withColumn("_n", F.sum(F.col("observed").cast("int")).over(_rows(keys, -KEEP + 1, 0)))
        if base_days is None:
            df = df.withColumn("_year", F.collect_list("_b").over(_rows(keys, -(n_win - 7), -GUARD)))
            df = df.withColumn("_have_y", F.sum(have).over(_rows(keys, -(n_win - 1), 0)))
        df = df.withColumn("_short", F.collect_list("_b").over(_rows(keys, -short, 0)))
        df = df.withColumn("_have", F.sum(have).over(_rows(keys, -(short + 6), 0)))
    if base_days is None:
        use_year = (F.col("_n") >= YEAR_MIN) & (F.size("_year") >= YEAR_MIN)
        df = df.withColumn("frame", F.when(use_year, F.lit("year")).otherwise(F.lit("short")))
        df = df.withColumn("_arr", F.when(use_year, F.col("_year")).otherwise(F.col("_short")))
        df = df.withColumn("miss", F.round(1 - F.when(use_year, F.col("_have_y") / n_win).otherwise(F.col("_have") / (short + 7)), 3))
    else:
        df = df.withColumn("frame", F.lit("short")).withColumn("_arr", F.col("_short"))
        df = df.withColumn("miss", F.round(1 - F.col("_have") / (short + 7), 3))
    enough = F.when(F.col("frame") == "year", True).otherwise(
        (F.size("_arr") >= short // 2) & (F.col("_n") >= short // 2 + 7))
    df = df.where(F.col("observed") & (F.col("c7") >= 4) & enough & (F.size("_arr") >= S.MIN_BASE))
    if since is not None:
        df = df.where(F.col("day") >= F.lit(since).cast("date"))
    df = df.select(*keys, "day", "m7", "frame", "miss", "_arr")
    df = _finish(_summary(df, "_arr"), F.col("m7"), scale, share_point)
    return df.select(*keys, "day", F.col("m7").alias("value"), "frame", "base_med", "base_sd",
                     F.size("_arr").alias("base_n"), "miss", "z_raw", "z")


def score_monthly(points: DataFrame, keys=("series_id",), min_points=40, base=36) -> DataFrame:
    """Score each month as if it were the newest: log level, minus the centred annual mean, minus a leave-one-out median
    for the calendar position, against the `base` months before.

    The seasonal factor depends on how long the series was at that month, so each as-of month gets its own copy of its
    past. A monthly series is short, so the copies are bounded by months squared.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("month")
    p = points.select(*keys, "month", F.log1p(F.greatest(F.col("value"), F.lit(0.0))).alias("l"), "value")
    p = p.withColumn("i", F.row_number().over(w) - 1)
    hist = calendar.by_series(p, keys).withColumn("_ls", F.collect_list("l").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hist = hist.where(F.size("_ls") >= min_points)
    n = F.size("_ls")
    # centred annual deviations of the copy that ends at this month
    hist = calendar.bind(hist, _dev=F.transform("_ls", lambda x, j: x - S.mean(F.slice(
        F.col("_ls"), F.greatest(j - 6, F.lit(0)) + 1, F.least(j + 7, F.size("_ls")) - F.greatest(j - 6, F.lit(0))))))
    only = F.filter(F.sequence(F.lit(0), n - 1), lambda j: j >= n - 1 - base)
    hist = calendar.bind(hist, _res=F.transform(only, lambda j: F.get(F.col("_ls"), j) - F.coalesce(S.median(F.transform(
        F.filter(F.sequence(F.lit(0), F.size("_ls") - 2), lambda q: (q % 12 == j % 12) & (q != j)),
        lambda q: F.get(F.col("_dev"), q))), F.lit(0.0))))
    hist = hist.withColumn("_x", F.element_at("_res", -1)).withColumn("_arr", F.slice("_res", 1, base))
    hist = _finish(_summary(hist, "_arr"), F.col("_x"), F.lit(None).cast("string"), F.lit(None).cast("double"))
    return hist.select(*keys, "month", "value", F.col("_x").alias("residual"), "base_med", "base_sd", "z_raw", "z")


def _mean_sd_z(df, keys, x, need, floor_share):
    base = _rows(keys, -180, -31)
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("day"))
    df = (df.withColumn("_i", pos).withColumn("_mu", F.avg(need).over(base)).withColumn("_sd", F.stddev_pop(need).over(base))
          .withColumn("_c", F.count(need).over(base)))
    sd = F.greatest(F.col("_sd"), floor_share * F.abs("_mu"), F.lit(0.5))
    return (df.where((F.col("_i") > 180) & (F.col("_c") >= 90) & F.col(x).isNotNull())
            .select(*keys, "day", ((F.col(x) - F.col("_mu")) / sd).alias("z")))


def lead_z(points: DataFrame, keys=("series_id",)) -> DataFrame:
    """7-day mean (4 of 7 days) against mean and spread of the raw days 180 to 31 before; holes stay holes."""
    df = calendar.fill(points, keys, max_carry=0)
    df = weekly_means(df, keys).withColumn("_x", F.when(F.col("c7") >= 4, F.col("m7")))
    return _mean_sd_z(df, list(keys), "_x", "value", 0.25)


def accel_z(points: DataFrame, keys=("series_id",)) -> DataFrame:
    """7-day minus 30-day mean, against that gap's own past."""
    keys = list(keys)
    df = weekly_means(calendar.fill(points, keys, max_carry=0), keys)
    w30 = _rows(keys, -29, 0)
    m30 = F.when(F.count("value").over(w30) >= 16, F.avg("value").over(w30))
    df = df.withColumn("_g", F.when(F.col("c7") >= 4, F.col("m7")) - m30)
    return _mean_sd_z(df, keys, "_g", "_g", 0.15)


def slow_z(points: DataFrame, keys=("series_id",), mean_days=30, base_from=760, base_to=31, min_days=20, min_base=365) -> DataFrame:
    """30-day mean against median / MAD of the 30-day means over two years ending 31 days earlier."""
    keys = list(keys)
    w = _rows(keys, -(mean_days - 1), 0)
    df = calendar.fill(points, keys, max_carry=0)
    df = df.withColumn("m", F.when(F.count("value").over(w) >= min_days, F.avg("value").over(w)))
    df = df.withColumn("_arr", F.collect_list("m").over(_rows(keys, -base_from, -base_to)))
    df = df.where(F.col("m").isNotNull() & (F.size("_arr") >= min_base)).select(*keys, "day", "m", "_arr")
    df = _summary(df, "_arr").where(F.col("mad") > 0)
    z = S.MAD_TO_SD * (F.col("m") - F.col("base_med")) / F.col("mad")
    return df.select(*keys, "day", S.clip(z, -S.WINSOR, S.WINSOR).alias("z"))


def weekly_block_score(points: DataFrame, keys=("series_id",), weeks=26) -> DataFrame:
    """The older score of the newest week: against up to 26 whole weekly means before it, clamped at 12."""
    keys = list(keys)
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("day"))) - 1
    df = points.withColumn("_k", back).where(F.col("_k") < 7 * (weeks + 1))
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    df = df.join(n, keys).where(F.col("_n") >= 84)
    # blocks are cut from the oldest kept point, so a part week next to the newest one is dropped
    first = F.col("_n") - 1 - F.col("_k")
    block = F.when(F.col("_k") >= 7, F.floor(first / 7)).otherwise(F.lit(-1))
    blocks = df.groupBy(*keys, block.alias("_blk")).agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("c"),
                                                          F.max("day").alias("d")).where(F.col("c") == 7)
    agg = blocks.groupBy(*keys).agg(F.max(F.when(F.col("_blk") == -1, F.col("m"))).alias("recent"), F.max("d").alias("day"),
                                    F.collect_list(F.when(F.col("_blk") >= 0, F.col("m"))).alias("_arr"))
    agg = _summary(agg, "_arr").where(F.size("_arr") >= S.MIN_BASE)
    scale = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.col("mean_ad"))
    flat = F.when(F.col("recent") == F.col("base_med"), 0.0).when(F.col("recent") > F.col("base_med"), 6.0).otherwise(-6.0)
    z = F.when(scale == 0, flat).otherwise(S.clip((F.col("recent") - F.col("base_med")) / scale, -12.0, 12.0))
    return agg.select(*keys, "day", F.col("recent").alias("value"), "base_med", scale.alias("base_sd"),
                      F.size("_arr").alias("base_n"), z.alias("z"))
