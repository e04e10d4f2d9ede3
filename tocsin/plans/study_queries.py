"""Queries on the studies: candidates, applied levels, feed tables, schemes, forward gates, stratified tests."""
from pyspark.sql import functions as F

from tocsin.functions import scoring as S
from tocsin.operators import evaluate as E, labels as L, panel as P, ranking, studies as ST, windows
from tocsin.operators.lineage import stable
from tocsin.plans import bindings as B
from tocsin.plans.bindings import with_ctes
from tocsin.plans.composite_queries import HIST, OFFSETS, PANEL, W, evidence, labelled, model_rows, test_years
from tocsin.plans.label_queries import days, with_cluster
from tocsin.plans.registry import query
from tocsin.plans.series_queries import ALL_TELLS_SQL, TELL_SRC, all_tells, rnd
from tocsin.plans.spatial_queries import DET, KM, detections

CANDS = ("cands", "SELECT nation, day FROM daily WHERE n >= 2 AND day >= DATE '1997-01-01'")


def cands(spark, sf):
    return B.daily(spark, sf).where("n >= 2 and day >= '1997-01-01'").select("nation", "day")


THIN = [("mk", """SELECT c.nation, c.day, CASE WHEN count(h.day) = 0 THEN 'extra' WHEN bool_or(abs(c.day - h.day) <= 3) THEN 'match' ELSE 'continuation' END AS kind FROM cands c
   LEFT JOIN hits h ON h.nation = c.nation AND c.day - h.day BETWEEN -3 AND 30 GROUP BY 1, 2"""),
        ("th", """SELECT nation, min(day) AS day FROM mk WHERE kind = 'extra' GROUP BY 1 UNION ALL SELECT nation, day FROM (
   SELECT t.nation, (SELECT min(m.day) FROM mk m WHERE m.kind = 'extra' AND m.nation = t.nation AND m.day > t.day + 30) AS day FROM th t) WHERE day IS NOT NULL""")]


@query("candidate_matching", with_ctes(["daily", "hits"], "SELECT nation, day, kind FROM mk WHERE kind <> 'extra' UNION ALL SELECT nation, day, 'extra' FROM th", [CANDS, *THIN])
       .replace("WITH ", "WITH RECURSIVE ", 1).replace("th AS MATERIALIZED", "th AS"))
def candidate_matching(spark, sf):
    """Candidates against listed events; extras thinned to one per thirty days from the last one kept."""
    return ST.match_candidates(cands(spark, sf), B.hits(spark, sf), "nation")


@query("operator_prefixes", with_ctes([], """
  SELECT event_id, arg_max(o.name, length(o.prefix)) AS operator FROM (SELECT event_id, upper(event_type) || user_id AS call FROM events) e LEFT JOIN (VALUES ('SIGN', 'short'), ('SIGNUP', 'long'), ('VIEW1', 'views'), ('PURCHASE', 'shop')) o(prefix, name)
  ON starts_with(e.call, o.prefix) GROUP BY 1"""))
def operator_prefixes(spark, sf):
    """Longest matching callsign prefix names the operator."""
    ops = spark.createDataFrame([("SIGN", "short"), ("SIGNUP", "long"), ("VIEW1", "views"), ("PURCHASE", "shop")], "prefix string, name string")
    e = B.table(spark, sf, "events").select("event_id", F.concat(F.upper("event_type"), F.col("user_id").cast("string")).alias("call"))
    j = e.join(F.broadcast(ops), F.col("call").startswith(F.col("prefix")), "left")
    return j.groupBy("event_id").agg(F.max_by("name", F.length("prefix")).alias("operator"))


@query("applied_levels", with_ctes(["forecast", "nat"], """
  SELECT theatre, day, CASE WHEN held THEN NULL ELSE pa END AS p_alert, CASE WHEN held THEN 'Normal' ELSE ['Normal', 'Watch', 'Elevated', 'Critical'][1 + (pa >= 0.05)::INT + (pa >= 0.1)::INT + (pa >= 0.25)::INT] END AS level, held FROM (
    SELECT nation AS theatre, day, nation % 5 = 4 AS held, max(p) OVER (PARTITION BY nation ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS pa FROM forecast)"""))
def applied_levels(spark, sf):
    """Levels set from today's probability and the last week's log; unvalidated sub-theatres are held out."""
    f = stable(B.forecast(spark, sf).select(F.col("nation").alias("theatre"), "day", "p"))
    n = B.nations(spark, sf).select(F.col("nation").alias("theatre"))
    return ST.apply_levels(f.withColumn("p_blend", F.lit(None).cast("double")), f, n.withColumn("level_composite", F.lit("Normal")), n.where("theatre % 5 = 4")).select("theatre", "day", "p_alert", "level", "held")


@query("fast_feed_table", with_ctes(["lead", "labels"], """
  SELECT 'ord_n' AS family, count(*) FILTER (WHERE k = 'ev') AS events, round(avg(v) FILTER (WHERE k = 'ev'), 6) AS hit, round(avg(v) FILTER (WHERE k = 'calm'), 6) AS false_alarm FROM (
    SELECT 'ev' AS k, (coalesce(arg_max(rmax, day), arg_max(coalesce(rmax, -9), day)) >= 2)::INT::DOUBLE AS v FROM fe WHERE y = 1 GROUP BY nation, eid
    UNION ALL SELECT 'calm', (rmax >= 2)::INT::DOUBLE FROM fe WHERE y = 0 AND rmax IS NOT NULL)""",
       [("fe", """SELECT l.nation, l.day, z, y, eid, rmax FROM (SELECT *, CASE WHEN count(z) OVER w >= 15 THEN max(least(greatest(z, 0), 5)) OVER w END AS rmax FROM lead
          WINDOW w AS (PARTITION BY nation ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) l JOIN labels USING (nation, day) WHERE NOT excl AND NOT unk""")]))
def fast_feed_table(spark, sf):
    z = B.lead(spark, sf).withColumn("c", S.clip(F.col("z"), 0.0, 5.0))
    z = windows.rolling_max(z, ["nation"], value="c")
    lab = L.build(days(spark, sf), B.hits(spark, sf), B.through(spark, sf), "nation").where("not excl and not unk")
    t = ST.feed_table(z.join(lab, ["nation", "day"]).withColumnRenamed("z", "e").withColumn("family", F.lit("ord_n")), key="nation")
    return t.select("family", "events", *rnd("hit", "false_alarm"))


@query("case_detection_sweep", with_ctes([], f"""
  SELECT s::DOUBLE AS setting, (SELECT count(*) FROM (SELECT c.case_id, max(d.frp) AS best FROM cs c JOIN det d ON d.day = c.day AND abs(d.lat - c.lat) < 0.04 AND {KM.format(a='d', b='c')} <= 3 GROUP BY 1) WHERE best >= s) AS caught,
         (SELECT count(*) FROM det WHERE frp >= s) AS flagged FROM (VALUES (50), (100), (200)) t(s)""", [DET, ("cs", "SELECT det_id AS case_id, lat, lon, day FROM det WHERE event_type = 'error'")]))
def case_detection_sweep(spark, sf):
    """Known cases against detections within three kilometres, at several score settings."""
    d = detections(spark, sf).withColumn("score", F.col("frp"))
    return ST.case_detection(d.where("event_type = 'error'").withColumnRenamed("det_id", "case_id"), d, (50, 100, 200))


@query("sliding_forward_skill", with_ctes(["forecast"], """
  SELECT w AS "window", count(*) AS n, round(1 - avg((p - y) ** 2) / avg((base - y) ** 2), 6) AS skill FROM (SELECT *, (day - (SELECT min(day) FROM forecast WHERE lab))::INT AS i FROM forecast WHERE lab) f, (SELECT unnest(range(0, 40))::INT AS w) x
  WHERE i BETWEEN w * 90 AND w * 90 + 364 GROUP BY 1"""))
def sliding_forward_skill(spark, sf):
    s = ST.sliding_skill(stable(B.forecast(spark, sf).where("lab")))
    return s.select("window", "n", *rnd("skill"))


@query("flagged_month_test", with_ctes(["daily", "hits"], """
  SELECT sum(a + c)::BIGINT AS n, sum(a)::BIGINT AS k, round(sum(b) / (sum(b) + sum(d)), 6) AS calm_rate, round(sum(a * d / t) / sum(b * c / t), 6) AS odds_ratio FROM (
    SELECT nation, count(*) FILTER (WHERE f AND e)::DOUBLE AS a, count(*) FILTER (WHERE f AND NOT e)::DOUBLE AS b, count(*) FILTER (WHERE NOT f AND e)::DOUBLE AS c, count(*) FILTER (WHERE NOT f AND NOT e)::DOUBLE AS d, count(*)::DOUBLE AS t FROM (
      SELECT d.nation, date_trunc('month', d.day) AS m, max(d.n) >= 3 AS f, count(h.day) > 0 AS e FROM daily d LEFT JOIN hits h ON h.nation = d.nation AND h.day = d.day GROUP BY 1, 2) GROUP BY 1)"""))
def flagged_month_test(spark, sf):
    """Months with a flag against months with an event, per nation and stratified."""
    h = B.hits(spark, sf).select("nation", "day").withColumn("h", F.lit(1))
    m = B.daily(spark, sf).join(h, ["nation", "day"], "left").groupBy("nation", F.trunc("day", "month").alias("m")).agg((F.max("n") >= 3).alias("flag"), (F.count("h") > 0).alias("event"))
    return ST.flagged_months(m, "nation").select("n", "k", *rnd("calm_rate", "odds_ratio"))


@query("outside_benchmark")
def outside_benchmark(spark, sf):
    """Own forecast and an outside monthly index on the same days, and both together."""
    f = B.forecast(spark, sf).where("lab").select("nation", "day", "p", "y")
    o = B.monthly(spark, sf).select("nation", F.add_months("month", 1).alias("day"), F.col("value").cast("double").alias("value"))
    return ST.combined_with_outside(f, o, "nation").select("source", *rnd("auc"), "positives", "negatives")


@query("base_state_event_study", with_ctes(["ship_daily", "hits"], """
  SELECT count(*) FILTER (WHERE ev) AS n, count(*) FILTER (WHERE ev AND f) AS hits, count(*) FILTER (WHERE NOT ev) AS calm, count(*) FILTER (WHERE NOT ev AND f) AS calm_hits FROM (
    SELECT nation, day, EXISTS (SELECT 1 FROM hits h WHERE h.nation = s.nation AND h.day = s.day) AS ev,
           coalesce(max((n >= 4)::INT) OVER (PARTITION BY nation ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 0) = 1 AS f FROM ship_daily s)
  WHERE ev OR NOT EXISTS (SELECT 1 FROM hits h WHERE h.nation = nation_ AND FALSE)""".replace("WHERE ev OR NOT EXISTS (SELECT 1 FROM hits h WHERE h.nation = nation_ AND FALSE)", "x WHERE ev OR NOT EXISTS (SELECT 1 FROM hits h WHERE h.nation = x.nation AND x.day BETWEEN h.day - 14 AND h.day + 30)")))
def base_state_event_study(spark, sf):
    """Whether a base state fired in the fourteen days before events, against calm days."""
    z = windows.window_max(B.ship_daily(spark, sf).select("nation", "day", F.col("n").cast("double").alias("z")), ["nation"], lead=14, need=1)
    h = B.hits(spark, sf)
    w = E.event_windows(z.withColumn("wmax", F.coalesce("wmax", F.lit(0.0))), h, L.calm_windows(days(spark, sf), h, "nation", before=14), "nation")
    return E.hit_test(w, [], cut=4.0).select("n", "hits", "calm", "calm_hits")


@query("grouped_box_evidence", with_ctes(["points", "catalog", "nat"], "SELECT a.theatre, day, family, round(max(e), 6) AS e FROM ev JOIN (SELECT region AS theatre, nation AS box FROM nat) a ON a.box = ev.nation GROUP BY 1, 2, 3", PANEL[:2]))
def grouped_box_evidence(spark, sf):
    """A theatre read as a group of boxes takes its strongest box."""
    alias = B.nations(spark, sf).select(F.col("region").alias("theatre"), F.col("nation").alias("box"))
    return ST.group_members(evidence(spark, sf), alias).select("theatre", "day", "family", *rnd("e"))


@query("monthly_index_to_days", with_ctes(["monthly", "bounds"], """
  SELECT nation, unnest(generate_series((month + INTERVAL 1 MONTH)::DATE, coalesce((nxt + INTERVAL 1 MONTH)::DATE - 1, (month + INTERVAL 1 MONTH)::DATE), INTERVAL 1 DAY))::DATE AS day, least(2.5 * value, 5) AS e
  FROM (SELECT *, lead(month) OVER (PARTITION BY nation ORDER BY month) AS nxt FROM monthly)"""))
def monthly_index_to_days(spark, sf):
    """A monthly reading becomes daily evidence from the day it is published until the next one."""
    from tocsin.operators import calendar
    m = B.monthly(spark, sf).select("nation", F.add_months("month", 1).alias("day"), F.least(2.5 * F.col("value"), F.lit(5.0)).alias("value"))
    return calendar.carry(m, ["nation"]).select("nation", "day", F.col("value").alias("e"))


@query("attached_family_columns", with_ctes(["forecast", "raw_points"], "SELECT f.nation, f.day, p, round(r.value, 6) AS value FROM forecast f LEFT JOIN raw_points r USING (nation, day)"))
def attached_family_columns(spark, sf):
    f = B.forecast(spark, sf).select("nation", "day", "p")
    return P.attach(f, B.raw_points(spark, sf), ("nation", "day")).select("nation", "day", "p", *rnd("value"))


@query("single_family_timing_null")
def single_family_timing_null(spark, sf):
    """One family's reading judged inside nation and nation-year against its own shifted timing."""
    f = with_cluster(B.forecast(spark, sf)).drop("nation").withColumnRenamed("cluster", "stratum")
    return E.shift_control(f, "stratum", edge=30, least=100)


@query("rolling_recalibration")
def rolling_recalibration(spark, sf):
    """Shift-only recalibration of each year fitted on the years before it."""
    from tocsin.operators import model as M
    f = stable(B.forecast(spark, sf).where("lab").select("nation", "day", "p", "y", F.year("day").alias("year")))
    years = f.select(F.collect_set("year")).scalar()  # one number per year
    past = f.withColumn("_years", years).withColumn("target", F.explode(F.filter("_years", lambda t: t > F.col("year")))).withColumn("theatre", F.col("target").cast("string"))
    u = M.sub_offset(past, S.logit(F.col("p")), ridge=0.0).select(F.col("theatre").cast("int").alias("year"), "u")
    q = f.join(u, "year").withColumn("q", S.sigmoid(F.col("u") + S.logit(F.col("p"))))
    return q.groupBy("year").agg(F.avg("p").alias("mean_p"), F.avg("q").alias("mean_q"), F.avg("y").alias("rate"))


@query("weighting_schemes")
def weighting_schemes(spark, sf):
    """Published Brier score, skill and AUC over all test years under each weighting scheme."""
    from tocsin.operators import model as M
    rows = model_rows(spark, sf)
    doms = {}
    for f in B.FAMILIES:
        if f"w_{f[0]}" in W:
            doms.setdefault(f[1], []).append(f"w_{f[0]}")
    years = test_years(rows)
    oos = stable(ST.schemes(rows, OFFSETS, HIST, W, 3.0, years, doms))
    u = stable(M.nested_publish(oos, years[0], by=("scheme",)))
    sq = lambda c: F.avg(F.pow(F.col(c) - F.col("y"), 2))      # noqa: E731
    k = u.groupBy("scheme").agg(F.count(F.lit(1)).alias("n"), sq("p").alias("brier"), sq("raw").alias("brier_raw"), (1 - sq("p") / sq("base")).alias("skill"))
    return k.join(E.auc(u, "p", "y", ["scheme"]).select("scheme", "auc"), "scheme")


KINDS = {"all": ("strike", "raid", "standoff"), "force": ("strike", "raid"), "strike": ("strike",), "standoff": ("standoff",)}


@query("training_by_event_kind")
def training_by_event_kind(spark, sf):
    """Trained on each of four event lists and judged on each of the four, over all test years, on the days that both lists judge."""
    from tocsin.operators import model as M
    rows = model_rows(spark, sf)
    for name, kinds in KINDS.items():
        rows = labelled(rows, spark, sf, kinds, name)
    rows, years = stable(rows), test_years(rows)
    v = [M.Variant(n, tuple(f"{c}_{n}" for c in HIST), {c: 3.0 for c in W}, f"y_{n}", f"lab_{n}") for n in KINDS]
    pub = M.nested_publish(stable(M.rolling_many(rows, v, OFFSETS, years)), years[0], by=("variant",)).select("theatre", "day", F.col("variant").alias("trained"), "p")
    judged = rows.select("theatre", "day", F.inline(F.array(*[F.struct(F.lit(n).alias("judged"), F.col(f"y_{n}").alias("yy"), F.col(f"lab_{n}").alias("_lab")) for n in KINDS])))
    j = stable(pub.join(judged.where("_lab"), ["theatre", "day"]))
    a = E.auc(j, "p", "yy", ["trained", "judged"]).select("trained", "judged", "auc", "positives")
    top = ranking.exact_quantiles(j, "p", [0.9], ["trained", "judged"])
    lift = j.join(top, ["trained", "judged"]).groupBy("trained", "judged").agg((F.avg(F.when(F.col("p") >= F.col("q0"), F.col("yy"))) / F.avg("yy")).alias("lift"))
    return a.join(lift, ["trained", "judged"]).select("trained", "judged", *rnd("auc", "lift"), "positives")


@query("thirty_day_history", with_ctes(["forecast", "ship_daily"], """
  SELECT f.nation, f.day, (20000 * round(p * 1000)::BIGINT + round(base * 10000)::BIGINT * 10) // (20 * round(base * 10000)::BIGINT) / 100.0 AS usual, round(p, 4) AS p,
         CASE WHEN p >= 0.25 THEN 'Critical' WHEN p >= 0.10 THEN 'Elevated' WHEN p >= 0.05 THEN 'Watch' ELSE 'Normal' END AS level, coalesce(lit, '') AS lit
  FROM forecast f LEFT JOIN (SELECT nation, day, string_agg(tell, ',' ORDER BY tell) AS lit FROM ft WHERE fired GROUP BY 1, 2) l ON l.nation = f.nation AND l.day = f.day
  WHERE f.day > (SELECT max(day) FROM forecast) - 30""", [TELL_SRC, ALL_TELLS_SQL]))
def thirty_day_history(spark, sf):
    """Per nation and day of the last thirty: the probability, times usual, level, and the rules lit that day. Times usual is rounded half up in whole
    numbers (p in thousandths, the base rate in ten-thousandths), so exact halves don't depend on how a fraction is stored."""
    pk, bk = F.round(F.col("p") * 1000).cast("long"), F.round(F.col("base") * 10000).cast("long")
    f = B.forecast(spark, sf)
    since = F.date_sub(f.agg(F.max("day")).scalar(), 30)
    lit = all_tells(spark, sf).where("fired").groupBy("nation", "day").agg(F.array_join(F.array_sort(F.collect_list("tell")), ",").alias("lit"))
    return f.where(F.col("day") > since).join(lit, ["nation", "day"], "left").select(
        "nation", "day", (F.floor((20000 * pk + 10 * bk) / (20 * bk)) / 100).alias("usual"), F.round("p", 4).alias("p"), S.level(F.col("p")).alias("level"), F.coalesce("lit", F.lit("")).alias("lit"))


@query("aligned_histories", with_ctes(["facts", "nat"], """
  SELECT n.nation, string_agg(coalesce(c.n::VARCHAR, '-'), ',' ORDER BY d.day) AS history FROM nat n CROSS JOIN (
    SELECT unnest(generate_series((SELECT max(o_orderdate)::DATE FROM orders) - 59, (SELECT max(o_orderdate)::DATE FROM orders), INTERVAL 1 DAY))::DATE AS day) d
  LEFT JOIN (SELECT nation, day, count(*) AS n FROM facts GROUP BY 1, 2) c ON c.nation = n.nation AND c.day = d.day GROUP BY 1"""))
def aligned_histories(spark, sf):
    """Each nation's last sixty days aligned to one calendar, with a gap where there was no reading."""
    hi = B.bounds(spark, sf).select("hi").scalar()
    c = B.order_facts(spark, sf).where(F.col("day") > F.date_sub(hi, 60)).groupBy("nation", "day").agg(F.count(F.lit(1)).alias("n"))
    c = c.groupBy("nation").agg(F.map_from_entries(F.collect_list(F.struct("day", "n"))).alias("by_day"))
    at = F.transform("_days", lambda d: F.coalesce(F.try_element_at("by_day", d).cast("string"), F.lit("-")))
    return B.nations(spark, sf).join(c, "nation", "left").withColumn("_days", F.sequence(F.date_sub(hi, 59), hi)).select("nation", F.array_join(
        F.when(F.col("by_day").isNull(), F.array_repeat(F.lit("-"), 60)).otherwise(at), ",").alias("history"))
