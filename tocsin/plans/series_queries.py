"""Queries on daily and monthly series: filling, scoring, transforms, windows, tells."""
from pyspark.sql import Window, functions as F

from tocsin.functions import scoring as S
from tocsin.operators import calendar, labels, robust, transforms, windows
from tocsin.plans import bindings as B
from tocsin.plans.bindings import with_ctes
from tocsin.plans.registry import query

R = 6


def rnd(*names, digits=R):
    return [F.round(F.col(n), digits).alias(n) for n in names]


def scored_sql(src, keys, scale="NULL"):
    """SQL of the guarded yearly score over (keys, day, value) rows in `src`; `scale` is an SQL expression over src."""
    k = ", ".join(keys)
    on = " AND ".join(f"f.{x} = s.{x}" for x in keys)
    return f"""
      (SELECT {k}, day, frame, m7, list_aggregate(arr, 'median') AS med, arr, miss, scale FROM (
        SELECT *, CASE WHEN n >= 120 AND len(year) >= 120 THEN 'year' ELSE 'short' END AS frame,
               CASE WHEN n >= 120 AND len(year) >= 120 THEN year ELSE short END AS arr,
               round(1 - CASE WHEN n >= 120 AND len(year) >= 120 THEN have_y / 402.0 ELSE have / 97.0 END, 3) AS miss FROM (
          SELECT *, list(b) FILTER (WHERE b IS NOT NULL) OVER (w ROWS BETWEEN 395 PRECEDING AND 30 PRECEDING) AS year,
                 list(b) FILTER (WHERE b IS NOT NULL) OVER (w ROWS BETWEEN 90 PRECEDING AND CURRENT ROW) AS short,
                 sum(obs) OVER (w ROWS BETWEEN 449 PRECEDING AND CURRENT ROW) AS n,
                 sum((value IS NOT NULL)::INT) OVER (w ROWS BETWEEN 96 PRECEDING AND CURRENT ROW) AS have,
                 sum((value IS NOT NULL)::INT) OVER (w ROWS BETWEEN 401 PRECEDING AND CURRENT ROW) AS have_y
          FROM (SELECT *, CASE WHEN c7 >= 5 THEN m7 END AS b FROM (
            SELECT *, avg(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m7,
                   count(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS c7 FROM filled
            WINDOW w AS (PARTITION BY {k} ORDER BY day)))
          WINDOW w AS (PARTITION BY {k} ORDER BY day)))
        WHERE obs = 1 AND c7 >= 4 AND (frame = 'year' OR (n >= 52 AND len(arr) >= 45)))"""


def filled_sql(src, keys, carry=2):
    k = ", ".join(keys)
    return f"""
      SELECT c.*, (v IS NOT NULL)::INT AS obs,
             CASE WHEN c.day - last_value(CASE WHEN v IS NOT NULL THEN c.day END IGNORE NULLS) OVER w <= {carry}
                  THEN last_value(v IGNORE NULLS) OVER w END AS value,
             last_value(sc IGNORE NULLS) OVER w AS scale
      FROM (SELECT {", ".join("g." + x for x in keys)}, g.day, s.value AS v, s.scale AS sc FROM
              (SELECT {k}, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM {src} GROUP BY {k}) g
              LEFT JOIN {src} s ON {" AND ".join(f"g.{x} = s.{x}" for x in keys)} AND g.day = s.day) c
      WINDOW w AS (PARTITION BY {k} ORDER BY day ROWS UNBOUNDED PRECEDING)"""


def final_z_sql(body):
    """z columns from (med, arr, m7, scale)."""
    return f"""
      SELECT *, least(greatest(z_raw, -5), 5) AS z FROM (
        SELECT *, CASE WHEN floor_ > sd THEN (m7 - med) / floor_
                       WHEN mad > 0 THEN 0.6745 * (m7 - med) / mad
                       WHEN mean_ad = 0 THEN CASE WHEN m7 = med THEN 0 WHEN m7 > med THEN 10 ELSE -10 END
                       ELSE (m7 - med) / (1.2533 * mean_ad) END AS z_raw,
               CASE WHEN floor_ > sd THEN floor_ ELSE sd END AS base_sd FROM (
          SELECT *, CASE WHEN mad > 0 THEN mad / 0.6745 ELSE mean_ad * 1.2533 END AS sd,
                 CASE scale WHEN 'count' THEN sqrt(greatest(med, 1) / 7) WHEN 'window' THEN sqrt(greatest(med, 1)) ELSE 0 END AS floor_
          FROM (SELECT *, list_aggregate(list_transform(arr, lambda x: abs(x - med)), 'median') AS mad,
                       list_aggregate(list_transform(arr, lambda x: abs(x - med)), 'avg') AS mean_ad FROM {body})))"""


ORD_SERIES = ("src", "SELECT nation, day, n::DOUBLE AS value, 'count' AS scale FROM daily")


def order_series(spark, sf):
    return B.daily(spark, sf).select("nation", "day", F.col("n").cast("double").alias("value"))


@query("newest_daily_scores", with_ctes(["daily"], f"""
  SELECT nation, day, frame, round(m7, 6) AS value, round(med, 6) AS base_med, round(base_sd, 6) AS base_sd, len(arr)::INT AS base_n,
         round(z_raw, 6) AS z_raw, round(z, 6) AS z, round(greatest(z, 0), 6) AS evidence
  FROM ({final_z_sql("scored")}) WHERE day = (SELECT max(day) FROM daily)""",
       [ORD_SERIES, ("filled", filled_sql("src", ["nation"])), ("scored", scored_sql("src", ["nation"])[7:])]))
def newest_daily_scores(spark, sf):
    """The flagship: newest guarded yearly robust z per series with its noise floor, turned to its warning direction."""
    s = robust.score_daily(order_series(spark, sf), ["nation"], scale="count", newest_only=True)
    return s.select("nation", "day", "frame", *rnd("value", "base_med", "base_sd"), "base_n", *rnd("z_raw", "z"),
                    F.round(S.one_sided(F.col("z"), F.lit("up")), R).alias("evidence"))


@query("daily_score_history", with_ctes(["daily"], f"""
  SELECT nation, day, frame, round(z, 6) AS z FROM ({final_z_sql("scored")})""",
       [ORD_SERIES, ("filled", filled_sql("src", ["nation"])), ("scored", scored_sql("src", ["nation"])[7:])]))
def daily_score_history(spark, sf):
    """Every day scored as if it were the newest, in one window pass."""
    return robust.score_daily(order_series(spark, sf), ["nation"], scale="count").select("nation", "day", "frame", *rnd("z"))


@query("sparse_series_scores", with_ctes(["raw_points"], f"""
  SELECT nation, day, frame, round(miss, 3) AS miss, round(z, 6) AS z FROM ({final_z_sql("scored")})""",
       [("src", "SELECT nation, day, value, NULL AS scale FROM raw_points"), ("filled", filled_sql("src", ["nation"])),
        ("scored", scored_sql("src", ["nation"])[7:])]))
def sparse_series_scores(spark, sf):
    """Scores of a series with calendar holes: short gaps carried, the short baseline where the year is too thin."""
    s = robust.score_daily(B.raw_points(spark, sf), ["nation"])
    return s.select("nation", "day", "frame", "miss", *rnd("z"))


@query("calendar_fill", with_ctes(["raw_points"], """
  SELECT nation, day, round(value, 6) AS value, obs = 1 AS observed, obs = 0 AND value IS NOT NULL AS filled FROM filled""",
       [("src", "SELECT nation, day, value, NULL AS scale FROM raw_points"), ("filled", filled_sql("src", ["nation"]))]))
def calendar_fill(spark, sf):
    return calendar.fill(B.raw_points(spark, sf), ["nation"]).select("nation", "day", *rnd("value"), "observed", "filled")


@query("carried_values", with_ctes(["raw_points", "bounds"], """
  SELECT nation, unnest(generate_series(day, greatest(day, least(day + 10, coalesce(nxt - 1, (SELECT hi FROM bounds)))), INTERVAL 1 DAY))::DATE AS day,
         round(value, 6) AS value, day AS known_since
  FROM (SELECT *, lead(day) OVER (PARTITION BY nation ORDER BY day) AS nxt FROM raw_points)"""))
def carried_values(spark, sf):
    """Each reading carried to the next one, at most ten days."""
    p = B.raw_points(spark, sf).withColumn("hi", B.bounds(spark, sf).select("hi").scalar())
    nxt = F.coalesce(F.date_sub(F.lead("day").over(Window.partitionBy("nation").orderBy("day")), 1), F.col("hi"))
    p = p.withColumn("stop", F.greatest("day", F.least(F.date_add("day", 10), nxt)))
    return p.select("nation", F.explode(F.sequence("day", "stop")).alias("day"), *rnd("value"), F.col("day").alias("known_since"))


@query("weekly_means", with_ctes(["raw_points"], """
  SELECT nation, day, round(CASE WHEN c7 >= 5 THEN m7 END, 6) AS baseline_mean, round(CASE WHEN c7 >= 4 THEN m7 END, 6) AS newest_mean
  FROM (SELECT *, avg(value) OVER w AS m7, count(value) OVER w AS c7 FROM filled
        WINDOW w AS (PARTITION BY nation ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))""",
       [("src", "SELECT nation, day, value, NULL AS scale FROM raw_points"), ("filled", filled_sql("src", ["nation"]))]))
def weekly_means(spark, sf):
    d = robust.weekly_means(calendar.fill(B.raw_points(spark, sf), ["nation"]), ["nation"])
    return d.select("nation", "day", F.round(F.when(F.col("c7") >= 5, F.col("m7")), R).alias("baseline_mean"),
                    F.round(F.when(F.col("c7") >= 4, F.col("m7")), R).alias("newest_mean"))


@query("short_baseline_scores", with_ctes(["ship_daily"], """
  SELECT nation, day, round(m7, 6) AS value, round(list_aggregate(arr, 'median'), 6) AS base_med, len(arr)::INT AS base_n FROM (
    SELECT nation, day, m7, list(CASE WHEN c7 >= 5 THEN m7 END) FILTER (WHERE c7 >= 5) OVER (w ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS arr,
           count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS np FROM (
      SELECT nation, day, avg(n) OVER w AS m7, count(n) OVER w AS c7 FROM ship_daily
      WINDOW w AS (PARTITION BY nation ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    WINDOW w AS (PARTITION BY nation ORDER BY day)) WHERE len(arr) >= 30 AND np >= 37"""))
def short_baseline_scores(spark, sf):
    """An explicit 60-day baseline."""
    p = B.ship_daily(spark, sf).select("nation", "day", F.col("n").cast("double").alias("value"))
    return robust.score_daily(p, ["nation"], base_days=60).select("nation", "day", *rnd("value", "base_med"), "base_n")


@query("noise_floors", with_ctes(["ship_daily"], """
  SELECT nation, round(median(n), 6) AS med, round(sqrt(greatest(median(n), 1) / 7), 6) AS count_floor,
         round(sqrt(greatest(median(n), 1)), 6) AS window_floor, 0.5 AS share_floor, 0.0 AS no_floor FROM ship_daily GROUP BY nation"""))
def noise_floors(spark, sf):
    d = B.ship_daily(spark, sf).groupBy("nation").agg(F.median("n").alias("med"))
    point = F.lit(0.5)
    return d.select("nation", *rnd("med"), *[F.round(S.noise_floor(F.lit(k), F.col("med"), point), R).alias(n) for k, n in (
        ("count", "count_floor"), ("window", "window_floor"), ("share", "share_floor"), (None, "no_floor"))])


@query("monthly_scores", with_ctes(["monthly"], """
  SELECT nation, month, round(x, 6) AS residual, round(z, 6) AS z FROM (
    SELECT *, least(greatest(CASE WHEN mad > 0 THEN 0.6745 * (x - med) / mad WHEN mean_ad = 0 THEN CASE WHEN x = med THEN 0 WHEN x > med THEN 10 ELSE -10 END
                     ELSE (x - med) / (1.2533 * mean_ad) END, -5), 5) AS z FROM (
      SELECT nation, month, x, med, median(abs(r - med)) AS mad, avg(abs(r - med)) AS mean_ad FROM (
        SELECT nation, month, x, r, median(r) OVER (PARTITION BY nation, month) AS med FROM (
          SELECT a.nation, a.month, a.i, a.r, m.r AS x FROM res a JOIN res m ON a.nation = m.nation AND a.month = m.month AND m.i = m.n - 1
          WHERE a.i BETWEEN a.n - 37 AND a.n - 2))
      GROUP BY nation, month, x, med))""", [
    ("pts", "SELECT nation, month, ln(1 + value) AS l, row_number() OVER (PARTITION BY nation ORDER BY month) - 1 AS i FROM monthly"),
    ("copies", "SELECT p.nation, e.month, e.i + 1 AS n, p.i, p.l FROM pts p JOIN pts e ON p.nation = e.nation AND p.i <= e.i WHERE e.i >= 39"),
    ("devs", "SELECT *, l - avg(l) OVER (PARTITION BY nation, month ORDER BY i ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS dev FROM copies"),
    ("res", """SELECT a.nation, a.month, a.n, a.i, a.l - coalesce(median(b.dev), 0) AS r FROM devs a LEFT JOIN devs b
       ON a.nation = b.nation AND a.month = b.month AND a.i % 12 = b.i % 12 AND a.i <> b.i AND b.i < a.n - 1 GROUP BY 1, 2, 3, 4, a.l""")]))
def monthly_scores(spark, sf):
    """Deseasonalised monthly z of every month, each seen from its own past."""
    p = B.monthly(spark, sf).select("nation", "month", F.col("value").cast("double").alias("value"))
    return robust.score_monthly(p, ["nation"]).select("nation", "month", *rnd("residual", "z"))


@query("percent_change_transform", with_ctes(["raw_points"], """
  SELECT nation, day, round(100.0 * (value / was - 1), 6) AS value FROM (
    SELECT *, lag(value, 20) OVER (PARTITION BY nation ORDER BY day) AS was FROM raw_points) WHERE was > 0"""))
def percent_change_transform(spark, sf):
    return transforms.apply(B.raw_points(spark, sf), "chg", keys=["nation"]).select("nation", "day", *rnd("value"))


@query("step_transform", with_ctes(["daily"], """
  SELECT nation, day, round(z_raw, 6) AS z_raw, round(least(greatest(z_raw, -5), 5), 6) AS z FROM (
    SELECT nation, day, 3.0 * (n - last_value(n) OVER (PARTITION BY nation ORDER BY day RANGE BETWEEN INTERVAL 44 DAY PRECEDING AND INTERVAL 14 DAY PRECEDING)) AS z_raw
    FROM daily) WHERE z_raw IS NOT NULL"""))
def step_transform(spark, sf):
    return transforms.apply(order_series(spark, sf), "step", keys=["nation"]).select("nation", "day", *rnd("z_raw", "z"))


@query("event_transform", with_ctes(["daily"], """
  SELECT nation, day, 2.5 * urgent AS z_raw, least(2.5 * urgent, 5) AS z FROM daily"""))
def event_transform(spark, sf):
    p = B.daily(spark, sf).select("nation", "day", F.col("urgent").alias("value"))
    return transforms.apply(p, "event").select("nation", "day", "z_raw", "z")


@query("weekly_block_scores", with_ctes(["daily"], """
  SELECT nation, day, round(recent, 6) AS value, round(med, 6) AS base_med, n::INT AS base_n,
         round(CASE WHEN scale = 0 THEN CASE WHEN recent = med THEN 0 WHEN recent > med THEN 6 ELSE -6 END
                    ELSE least(greatest((recent - med) / scale, -12), 12) END, 6) AS z FROM (
    SELECT *, CASE WHEN mad > 0 THEN 1.4826 * mad ELSE mean_ad END AS scale FROM (
      SELECT b.nation, r.recent, r.day, b.med, median(abs(b.m - b.med)) AS mad, avg(abs(b.m - b.med)) AS mean_ad, count(*) AS n
      FROM (SELECT *, median(m) OVER (PARTITION BY nation) AS med FROM (
              SELECT nation, i // 7 AS blk, avg(n) AS m FROM ranked WHERE k BETWEEN 7 AND 188 GROUP BY 1, 2 HAVING count(*) = 7)) b
      JOIN (SELECT nation, avg(n) AS recent, max(day) AS day FROM ranked WHERE k < 7 GROUP BY 1) r ON b.nation = r.nation
      GROUP BY 1, 2, 3, 4))""", [
    ("ranked", """SELECT nation, day, n, k, least(c, 189) - 1 - k AS i FROM (
        SELECT nation, day, n, row_number() OVER (PARTITION BY nation ORDER BY day DESC) - 1 AS k, count(*) OVER (PARTITION BY nation) AS c FROM daily)
        WHERE k < 189""")]))
def weekly_block_scores(spark, sf):
    return robust.weekly_block_score(order_series(spark, sf), ["nation"]).select(
        "nation", "day", *rnd("value", "base_med"), "base_n", *rnd("z"))


@query("lead_scores", with_ctes(["lead"], "SELECT nation, day, round(z, 6) AS z FROM lead"))
def lead_scores(spark, sf):
    return B.lead(spark, sf).select("nation", "day", *rnd("z"))


@query("acceleration_scores", with_ctes(["daily"], """
  SELECT nation, day, round((g - mu) / greatest(sd, 0.15 * abs(mu), 0.5), 6) AS z FROM (
    SELECT nation, day, g, i, avg(g) OVER b AS mu, stddev_pop(g) OVER b AS sd, count(g) OVER b AS c FROM (
      SELECT nation, day, row_number() OVER (PARTITION BY nation ORDER BY day) AS i,
             CASE WHEN count(n) OVER w7 >= 4 THEN avg(n) OVER w7 END - CASE WHEN count(n) OVER w30 >= 16 THEN avg(n) OVER w30 END AS g FROM daily
      WINDOW w7 AS (PARTITION BY nation ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
             w30 AS (PARTITION BY nation ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
    WINDOW b AS (PARTITION BY nation ORDER BY day ROWS BETWEEN 180 PRECEDING AND 31 PRECEDING))
  WHERE i > 180 AND c >= 90 AND g IS NOT NULL"""))
def acceleration_scores(spark, sf):
    return robust.accel_z(order_series(spark, sf), ["nation"]).select("nation", "day", *rnd("z"))


SLOW = """
  SELECT {k}, day, round(least(greatest(0.6745 * (m - med) / mad, -5), 5), 6) AS z FROM (
    SELECT *, list_aggregate(list_transform(arr, lambda x: abs(x - med)), 'median') AS mad FROM (
      SELECT *, list_aggregate(arr, 'median') AS med FROM (
        SELECT {k}, day, m, list(m) FILTER (WHERE m IS NOT NULL) OVER (PARTITION BY {k} ORDER BY day ROWS BETWEEN {lo} PRECEDING AND 31 PRECEDING) AS arr
        FROM m30) WHERE m IS NOT NULL AND len(arr) >= {need})) WHERE mad > 0"""


@query("slow_scores", with_ctes(["daily"], SLOW.format(k="nation", lo=760, need=365), [
    ("m30", """SELECT nation, day, CASE WHEN count(value) OVER w >= 20 THEN avg(value) OVER w END AS m FROM daily
       WINDOW w AS (PARTITION BY nation ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")]))
def slow_scores(spark, sf):
    p = B.daily(spark, sf).select("nation", "day", "value")
    return robust.slow_z(p, ["nation"]).select("nation", "day", *rnd("z"))


@query("share_scores", with_ctes(["ship_daily"], SLOW.format(k="nation", lo=395, need=120).replace(", 6)", ", 10)"), [
    ("s7", """SELECT nation, day, sum(n) OVER (PARTITION BY nation ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS s,
       count(n) OVER (PARTITION BY nation ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS c FROM ship_daily"""),
    ("m30", """SELECT nation, day, s / total AS m FROM (SELECT *, sum(s) OVER (PARTITION BY day) AS total FROM s7 WHERE c >= 4) WHERE total > 0""")]))
def share_scores(spark, sf):
    """A nation's share of all nations' 7-day shipments against its own past shares."""
    w = Window.partitionBy("nation").orderBy("day").rowsBetween(-6, 0)
    s = B.ship_daily(spark, sf).withColumn("s", F.sum("n").over(w))
    s = s.withColumn("i", F.row_number().over(Window.partitionBy("nation").orderBy("day"))).where("i >= 4")
    total = s.groupBy("day").agg(F.sum("s").alias("total"))
    p = s.join(total, "day").where("total > 0").select("nation", "day", (F.col("s") / F.col("total")).alias("value"))
    return robust.slow_z(p, ["nation"], mean_days=1, base_from=395, min_days=1, min_base=120).select("nation", "day", *rnd("z", digits=10))


@query("expanding_level_evidence", with_ctes(["monthly", "daily"], """
  SELECT nation, day, round(least(greatest(0.6745 * (x - med) / mad, 0), 5), 6) AS e FROM (
    SELECT *, list_aggregate(list_transform(arr, lambda v: abs(v - med)), 'median') AS mad FROM (
      SELECT *, list_aggregate(arr, 'median') AS med FROM (
        SELECT nation, day, x, list(x) FILTER (WHERE x IS NOT NULL) OVER (PARTITION BY nation ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS arr
        FROM lx) WHERE x IS NOT NULL AND len(arr) >= 24)) WHERE mad > 0""", [
    ("weekly", "SELECT nation, date_trunc('week', day)::DATE AS day, sum(value) AS value FROM daily GROUP BY 1, 2"),
    ("lx", """SELECT nation, day, CASE WHEN count(value) OVER w >= 20 THEN ln(1 + avg(value) OVER w) END AS x FROM weekly
       WINDOW w AS (PARTITION BY nation ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")]))
def expanding_level_evidence(spark, sf):
    """Log level against everything before it, on weekly totals."""
    p = B.daily(spark, sf).groupBy("nation", F.to_date(F.date_trunc("week", "day")).alias("day")).agg(F.sum("value").alias("value"))
    return windows.expanding_level(p, ["nation"], need=24).select("nation", "day", *rnd("e"))


@query("short_acceleration_evidence", with_ctes(["ship_daily"], """
  SELECT nation, day, round(least(greatest(0.6745 * (x - med) / mad, 0), 5), 6) AS e FROM (
    SELECT *, list_aggregate(list_transform(arr, lambda v: abs(v - med)), 'median') AS mad FROM (
      SELECT *, list_aggregate(arr, 'median') AS med FROM (
        SELECT nation, day, CASE WHEN count(n) OVER w7 >= 4 THEN avg(n) OVER w7 END AS x, list(n) OVER w60 AS arr FROM ship_daily
        WINDOW w7 AS (PARTITION BY nation ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
               w60 AS (PARTITION BY nation ORDER BY day ROWS BETWEEN 66 PRECEDING AND 7 PRECEDING))
      WHERE x IS NOT NULL AND len(arr) >= 40)) WHERE mad > 0"""))
def short_acceleration_evidence(spark, sf):
    p = B.ship_daily(spark, sf).select("nation", "day", F.col("n").cast("double").alias("value"))
    return windows.short_acceleration(calendar.by_series(p, ["nation"]), ["nation"]).select("nation", "day", *rnd("e"))


@query("trade_scores", with_ctes(["monthly"], """
  SELECT nation, month, round((s3 - mu) / greatest(sd, 0.25 * mu, 1), 6) AS z FROM (
    SELECT nation, month, s3, avg(s3) OVER b AS mu, stddev_pop(s3) OVER b AS sd, count(s3) OVER b AS c FROM (
      SELECT nation, month, CASE WHEN count(value) OVER w = 3 THEN sum(value) OVER w END AS s3 FROM monthly
      WINDOW w AS (PARTITION BY nation ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    WINDOW b AS (PARTITION BY nation ORDER BY month ROWS BETWEEN 35 PRECEDING AND 12 PRECEDING)) WHERE c = 24 AND s3 IS NOT NULL"""))
def trade_scores(spark, sf):
    p = B.monthly(spark, sf).select("nation", "month", F.col("value").cast("double").alias("value"))
    return windows.trade_z(p, ["nation"]).select("nation", "month", *rnd("z"))


@query("step_up_evidence", with_ctes(["daily"], """
  SELECT nation, day + 7 AS day, least(2.5 * greatest(urgent - min(urgent) OVER (PARTITION BY nation ORDER BY day ROWS BETWEEN 30 PRECEDING AND CURRENT ROW), 0), 5) AS e FROM daily"""))
def step_up_evidence(spark, sf):
    p = B.daily(spark, sf).select("nation", "day", F.col("urgent").alias("value"))
    return transforms.step_up(p, ["nation"])


@query("smoothed_counts", with_ctes(["daily"], """
  SELECT nation, day, round(list_reduce(list(n::DOUBLE) OVER (PARTITION BY nation ORDER BY day), lambda a, x: 0.3 * x + 0.7 * a), 6) AS ewma
  FROM (SELECT nation, date_trunc('week', day)::DATE AS day, sum(n) AS n FROM daily GROUP BY 1, 2)"""))
def smoothed_counts(spark, sf):
    """Exponentially weighted weekly order counts."""
    p = B.daily(spark, sf).groupBy("nation", F.to_date(F.date_trunc("week", "day")).alias("day")).agg(F.sum("n").alias("value"))
    return windows.ewma(p, ["nation"]).select("nation", "day", *rnd("ewma"))


TRAIL = """
  SELECT nation, day, n FROM (
    SELECT d.nation, d.day, coalesce(sum(h.k) OVER (PARTITION BY d.nation ORDER BY d.day RANGE BETWEEN INTERVAL {span} DAY PRECEDING AND CURRENT ROW), 0)::BIGINT AS n,
           min(h.day) OVER (PARTITION BY d.nation) AS first_day
    FROM daily d LEFT JOIN (SELECT nation, day, count(*) AS k FROM facts WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2) h
    ON d.nation = h.nation AND d.day = h.day) WHERE day >= first_day + {days}"""


def urgent_events(spark, sf):
    return B.order_facts(spark, sf).where("o_orderpriority = '1-URGENT'").select("nation", "day")


@query("trailing_30_day_counts", with_ctes(["daily", "facts"], TRAIL.format(span=30, days=30)))
def trailing_30_day_counts(spark, sf):
    return windows.trailing_count(urgent_events(spark, sf), ["nation"], 30, B.daily(spark, sf).select("nation", "day"))


@query("trailing_7_day_counts", with_ctes(["daily", "facts"], TRAIL.format(span=6, days=7)))
def trailing_7_day_counts(spark, sf):
    return windows.trailing_count(urgent_events(spark, sf), ["nation"], 7, B.daily(spark, sf).select("nation", "day"), inclusive=False)


# ------------------------------------------------------------------ tells
def tell_sql(cond):
    return f"SELECT nation, day, coalesce({cond}, FALSE) AS fired FROM t"


_ROSE = "(last_value(value IGNORE NULLS) OVER (PARTITION BY nation ORDER BY day ROWS UNBOUNDED PRECEDING) > last_value(value IGNORE NULLS) OVER (PARTITION BY nation ORDER BY day RANGE BETWEEN INTERVAL 67 DAY PRECEDING AND INTERVAL 8 DAY PRECEDING))"


def _frames(v, recent, base):
    r = f"OVER (PARTITION BY nation ORDER BY day RANGE BETWEEN INTERVAL {recent - 1} DAY PRECEDING AND CURRENT ROW)"
    b = f"OVER (PARTITION BY nation ORDER BY day RANGE BETWEEN INTERVAL {recent + base - 1} DAY PRECEDING AND INTERVAL {recent} DAY PRECEDING)"
    return f"avg({v}) {r}", f"count({v}) {r}", f"median({v}) {b}", f"count({v}) {b}"


def surge_sql(mult, floor, recent=3, base=90, need=30, v="value"):
    m, c, med, n = _frames(v, recent, base)
    return f"({c} >= {max(1, recent - 1)} AND {n} >= {need} AND {m} >= {floor} AND {m} >= {mult} * {med})"


def slump_sql(frac, recent=7, base=60, need=30, v="value"):
    m, c, med, n = _frames(v, recent, base)
    return f"({c} >= {recent - 2} AND {n} >= {need} AND {med} > 0 AND {m} <= {frac} * {med})"


TELL_SQL = {
    "departure": _ROSE,
    "leave": f"({_ROSE} AND coalesce(sum(value2) OVER (PARTITION BY nation ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 0) > 0)",
    "airlines": slump_sql(0.6),
    "tankers": surge_sql(3, 4),
    "airspace": f"({_ROSE} OR {surge_sql(1.5, 10, 1, 30, 14, 'value2')})",
    "sea": surge_sql(2, 3, 1),
    "wave": surge_sql(2, 5, 1),
    "bases": "(value >= 1)",
    "diverted": surge_sql(3, 3, 2),
    "bizjets": surge_sql(2, 5),
    "dark": surge_sql(1.5, 30, 1, 90, 10),
}
TELL_SRC = ("t", """SELECT s.nation, s.day, s.qty::DOUBLE / 10 AS value, s.n::DOUBLE AS value2 FROM ship_daily s""")


def tell_series(spark, sf):
    return B.ship_daily(spark, sf).select("nation", "day", (F.col("qty").cast("double") / 10).alias("value"),
                                          F.col("n").cast("double").alias("value2"))


def _register_tells():
    for name, cond in TELL_SQL.items():
        @query(f"tell_{name}", with_ctes(["ship_daily"], tell_sql(cond), [TELL_SRC]))
        def run(spark, sf, name=name):
            return windows.fires(tell_series(spark, sf), name, ["nation"]).select("nation", "day", "fired")


_register_tells()

WAVE_FIRES = ("fl", tell_sql(TELL_SQL["wave"]).replace("FROM t", "FROM t"))
ONSET_SQL = """
  SELECT nation, day FROM (SELECT *, coalesce(max(fired::INT) OVER (PARTITION BY nation ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS was FROM fl)
  WHERE fired AND was = 0"""


@query("strike_wave_onsets", with_ctes(["ship_daily"], ONSET_SQL, [TELL_SRC, WAVE_FIRES]))
def strike_wave_onsets(spark, sf):
    f = windows.fires(tell_series(spark, sf), "wave", ["nation"])
    return windows.fresh_onsets(f, ["nation"]).select("nation", "day")


ALL_TELLS_SQL = ("ft", " UNION ALL ".join(f"SELECT '{name}' AS tell, * FROM ({tell_sql(cond)})" for name, cond in TELL_SQL.items()))


def all_tells(spark, sf):
    """Every rule on every nation's series in one pass: nation, day, tell, fired."""
    d = tell_series(spark, sf)
    d = d.select("nation", "day", *[rule(["nation"]).alias(f"_{name}") for name, rule in windows.TELLS.items()])
    return d.select("nation", "day", F.inline(F.array(*[F.struct(F.lit(name).alias("tell"), F.col(f"_{name}").alias("fired")) for name in windows.TELLS])))


@query("tell_last_fired", with_ctes(["ship_daily", "nat"], f"""
  SELECT k.nation, k.tell, max(f.day) FILTER (WHERE fired) AS last_day, CASE WHEN count(f.day) = 0 THEN NULL ELSE coalesce(bool_or(fired), FALSE) END AS is_on
  FROM (SELECT nation, tell FROM nat CROSS JOIN (VALUES {', '.join(f"('{n}')" for n in [*TELL_SQL, 'civil'])}) v(tell)) k
  LEFT JOIN ft f ON f.nation = k.nation AND f.tell = k.tell AND f.day > (SELECT max(day) FROM ship_daily) - 7
  GROUP BY 1, 2""", [TELL_SRC, ALL_TELLS_SQL]))
def tell_last_fired(spark, sf):
    """Whether each rule fired in the last seven days and when; NULL where no series watches the rule."""
    recent = all_tells(spark, sf).where(F.col("day") > F.date_sub(B.bounds(spark, sf).select("hi").scalar(), 7))
    agg = recent.groupBy("nation", "tell").agg(F.max(F.when(F.col("fired"), F.col("day"))).alias("last_day"),
                                               F.bool_or("fired").alias("is_on"))
    want = B.nations(spark, sf).select("nation", F.explode(F.array(*[F.lit(n) for n in [*windows.TELLS, "civil"]])).alias("tell"))
    return want.join(agg, ["nation", "tell"], "left")


# ------------------------------------------------------------------ runs, thresholds, steps
@query("bridged_runs", with_ctes(["lead"], """
  SELECT nation, min(day) AS start, max(day) AS "end", (max(day) - min(day) + 1)::INT AS days FROM (
    SELECT *, sum(CASE WHEN day - prev - 1 > 7 THEN 1 ELSE 0 END) OVER (PARTITION BY nation ORDER BY day) AS run FROM (
      SELECT nation, day, lag(day) OVER (PARTITION BY nation ORDER BY day) AS prev FROM lead WHERE z >= 1.5))
  GROUP BY nation, run"""))
def bridged_runs(spark, sf):
    z = B.lead(spark, sf).withColumn("on", F.col("z") >= 1.5)
    return windows.runs(z, ["nation"]).select("nation", "start", "end", "days")


@query("rolling_maximum", with_ctes(["lead"], """
  SELECT nation, day, round(CASE WHEN count(z) OVER w >= 15 THEN max(z) OVER w END, 6) AS rmax FROM lead
  WINDOW w AS (PARTITION BY nation ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""))
def rolling_maximum(spark, sf):
    return windows.rolling_max(B.lead(spark, sf), ["nation"]).select("nation", "day", *rnd("rmax"))


@query("forward_exceedance_label", with_ctes(["ship_daily"], """
  SELECT nation, day, c7::DOUBLE AS c7, round(cut, 6) AS cut, (m > cut)::INT AS y FROM (
    SELECT *, CASE WHEN count(c7) OVER p >= 180 THEN quantile_cont(c7, 0.9) OVER p END AS cut, max(c7) OVER f AS m, count(*) OVER f AS c FROM (
      SELECT nation, day, CASE WHEN count(n) OVER w >= 4 THEN sum(n) OVER w END::DOUBLE AS c7 FROM ship_daily
      WINDOW w AS (PARTITION BY nation ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    WINDOW p AS (PARTITION BY nation ORDER BY day ROWS BETWEEN 365 PRECEDING AND 1 PRECEDING),
           f AS (PARTITION BY nation ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING))
  WHERE cut IS NOT NULL AND c = 30"""))
def forward_exceedance_label(spark, sf):
    p = B.ship_daily(spark, sf).select("nation", "day", F.col("n").cast("double").alias("value"))
    return labels.forward_exceeds(calendar.by_series(p, ["nation"]), "nation").select("nation", "day", "c7", *rnd("cut"), "y")


@query("alert_rule_readings", with_ctes(["forecast"], """
  SELECT nation, day, p, round(CASE WHEN len(y1) >= 120 THEN p / list_aggregate(y1, 'median') END, 6) AS over_median,
         round(p - p14, 6) AS rise_14, max_7, round(CASE WHEN len(q) >= 119 THEN len(list_filter(q, lambda x: x < p)) / len(q)::DOUBLE END, 6) AS own_pct
  FROM (SELECT nation, day, p, list(p) OVER (w ROWS BETWEEN 365 PRECEDING AND 1 PRECEDING) AS y1, lag(p, 14) OVER w AS p14,
               max(p) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS max_7, list(p) OVER (w ROWS BETWEEN 364 PRECEDING AND 1 PRECEDING) AS q
        FROM forecast WINDOW w AS (PARTITION BY nation ORDER BY day))"""))
def alert_rule_readings(spark, sf):
    return windows.alert_rules(calendar.by_series(B.forecast(spark, sf), ["nation"]), "nation").select("nation", "day", "p", *rnd("over_median", "rise_14"), "max_7", *rnd("own_pct"))


@query("value_steps", with_ctes(["daily"], """
  SELECT nation, day, was, urgent AS value FROM (SELECT *, lag(urgent) OVER (PARTITION BY nation ORDER BY day) AS was FROM daily)
  WHERE was IS NOT NULL AND was <> urgent AND day <> DATE '1998-01-05'"""))
def value_steps(spark, sf):
    p = B.daily(spark, sf).select("nation", "day", F.col("urgent").alias("value"))
    return windows.change_points(p, ["nation"], seam="1998-01-05").select("nation", "day", "was", "value")


@query("change_over_week", with_ctes(["forecast"], """
  SELECT nation, max(day) AS day, arg_max(p, day) AS now, coalesce(arg_max(p, day) FILTER (WHERE day <= last - 7), arg_min(p, day)) AS "then",
         round(arg_max(p, day) - coalesce(arg_max(p, day) FILTER (WHERE day <= last - 7), arg_min(p, day)), 6) AS change
  FROM (SELECT *, max(day) OVER (PARTITION BY nation) AS last FROM forecast) GROUP BY nation"""))
def change_over_week(spark, sf):
    p = B.forecast(spark, sf).select("nation", "day", F.col("p").alias("value"))
    return windows.week_change(p, ["nation"]).select("nation", "day", "now", "then", *rnd("change"))


@query("downsampled_series", with_ctes(["daily"], """
  SELECT d.nation, d.day, d.n FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY nation) AS c FROM daily) d
  WHERE i IN (SELECT round_even(k * (c - 1) / 89.0, 0)::BIGINT FROM (SELECT unnest(range(90)) AS k))"""))
def downsampled_series(spark, sf):
    return windows.downsample(B.daily(spark, sf), ["nation"], 90).select("nation", "day", "n")


@query("weekly_tempo", with_ctes(["ship_daily"], """
  SELECT nation, day, value, CASE WHEN cb >= 30 THEN greatest(5.0, 2 * med) END AS threshold FROM (
    SELECT nation, day, n AS value, median(n) OVER b AS med, count(n) OVER b AS cb, max(day) OVER (PARTITION BY nation) AS last FROM ship_daily
    WINDOW b AS (PARTITION BY nation ORDER BY day RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
  WHERE (last - day) % 7 = 0 AND last - day <= 77"""))
def weekly_tempo(spark, sf):
    """The last twelve weekly readings with the rule's own threshold on each day."""
    w = Window.partitionBy("nation").orderBy("day").rowsBetween(-90, -1)
    p = B.ship_daily(spark, sf).where(F.col("day") >= F.date_sub(B.bounds(spark, sf).select("hi").scalar(), 77 + 90))
    p = p.withColumn("_a", F.collect_list("n").over(w)).withColumn("_last", F.max("day").over(Window.partitionBy("nation")))
    ago = F.datediff("_last", "day")
    return p.where((ago % 7 == 0) & (ago <= 77)).select(
        "nation", "day", F.col("n").alias("value"),
        F.when(F.size("_a") >= 30, F.greatest(F.lit(5.0), 2 * S.median(F.col("_a")))).alias("threshold"))


@query("recent_alert_level", with_ctes(["forecast"], """
  SELECT nation, day, p, p_alert, ['Normal', 'Watch', 'Elevated', 'Critical'][1 + (p_alert >= 0.05)::INT + (p_alert >= 0.10)::INT + (p_alert >= 0.25)::INT] AS level
  FROM (SELECT *, max(p) OVER (PARTITION BY nation ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS p_alert FROM forecast)"""))
def recent_alert_level(spark, sf):
    """Level from the highest probability of the last seven logged days."""
    w = Window.partitionBy("nation").orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(-6, 0)
    f = B.forecast(spark, sf).withColumn("p_alert", F.max("p").over(w))
    return f.select("nation", "day", "p", "p_alert", S.level(F.col("p_alert")).alias("level"))


@query("prefix_settings", with_ctes([], """
  SELECT s.series_id, arg_min(p.setting, p.priority) AS setting FROM (SELECT DISTINCT 'ord_n_nation_' || n_nationkey AS series_id FROM nation UNION SELECT DISTINCT 'ship_n_nation_' || n_nationkey FROM nation) s
  LEFT JOIN (VALUES ('ord_n_nation_2', 1, 'floor'), ('ord_', 2, 'count'), ('ship_n_nation_1', 3, 'window')) p(prefix, priority, setting) ON starts_with(s.series_id, p.prefix)
  GROUP BY 1"""))
def prefix_settings(spark, sf):
    """Per-series settings looked up by id prefix, first match by priority."""
    rules = spark.createDataFrame([("ord_n_nation_2", 1, "floor"), ("ord_", 2, "count"), ("ship_n_nation_1", 3, "window")],
                                  "prefix string, priority int, setting string")
    n = B.nations(spark, sf)
    ids = n.select(F.explode(F.array(F.concat(F.lit("ord_n_nation_"), "nation"), F.concat(F.lit("ship_n_nation_"), "nation"))).alias("series_id"))
    return transforms.prefix_lookup(ids, rules)


@query("without_newest_points", with_ctes(["raw_points"], """
  SELECT nation, day, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY day DESC) AS rn FROM raw_points) WHERE rn > 2"""))
def without_newest_points(spark, sf):
    return transforms.drop_newest(B.raw_points(spark, sf), ["nation"], 2).select("nation", "day", *rnd("value"))


@query("complete_event_days", with_ctes([], """
  SELECT user_id, ts::DATE AS day, count(*) AS n FROM events WHERE ts::DATE < (SELECT max(ts)::DATE FROM events) GROUP BY 1, 2"""))
def complete_event_days(spark, sf):
    """Events per user and day without the day of the newest event, which is not over."""
    e = B.table(spark, sf, "events")
    days = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return transforms.drop_partial_day(days, e.agg(F.max("ts")).scalar())


@query("newest_points", with_ctes(["raw_points"], """
  SELECT nation, day, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY day DESC) AS rn FROM raw_points) WHERE rn <= 30"""))
def newest_points(spark, sf):
    return transforms.newest(B.raw_points(spark, sf), ["nation"], 30).select("nation", "day", *rnd("value"))
