"""Queries on labels, event features, episodes and the evaluation of scores."""
from pyspark.sql import Window, functions as F

from tocsin.functions import scoring as S, tails
from tocsin.operators.lineage import stable
from tocsin.operators import evaluate as E, labels as L, ranking, windows
from tocsin.plans import bindings as B
from tocsin.plans.bindings import with_ctes
from tocsin.plans.registry import query
from tocsin.plans.series_queries import ALL_TELLS_SQL, TELL_SRC, all_tells, rnd


def days(spark, sf):
    return B.daily(spark, sf).select("nation", "day")


# ------------------------------------------------------------------ labels and features
@query("labelled_events", with_ctes(["hits"], "SELECT event_id, nation, day, kind, market_moving, buildup, site FROM hits"))
def labelled_events(spark, sf):
    return B.hits(spark, sf)


@query("panel_labels", with_ctes(["labels"], "SELECT nation, day, y, excl, unk, eid FROM labels"))
def panel_labels(spark, sf):
    return L.build(days(spark, sf), B.hits(spark, sf), B.through(spark, sf), "nation").select("nation", "day", "y", "excl", "unk", "eid")


@query("short_horizon_labels", with_ctes(["daily", "hits"], """
  SELECT d.nation, d.day, coalesce(bool_or(h.day - d.day BETWEEN 1 AND 7), FALSE)::INT AS y, coalesce(bool_or(d.day - h.day BETWEEN 0 AND 7), FALSE) AS excl
  FROM daily d LEFT JOIN hits h ON h.nation = d.nation AND abs(h.day - d.day) <= 7 GROUP BY 1, 2"""))
def short_horizon_labels(spark, sf):
    return L.build(days(spark, sf), B.hits(spark, sf), B.through(spark, sf), "nation", horizon=7, after=7).select("nation", "day", "y", "excl")


@query("event_site_copies", with_ctes(["hits"], """
  SELECT event_id, 'n' || nation AS theatre, FALSE AS dup FROM hits UNION ALL SELECT event_id, site, TRUE FROM hits WHERE site <> ''"""))
def event_site_copies(spark, sf):
    h = B.hits(spark, sf).withColumn("theatre", F.concat(F.lit("n"), "nation"))
    return L.site_copies(h).select("event_id", "theatre", "dup")


@query("event_history_terms", with_ctes(["daily", "hits"], """
  SELECT d.nation, d.day, round(least(count(h.day) FILTER (WHERE d.day - h.day <= 365), 3) / 3.0, 6) AS h1,
         round(least(count(h.day) FILTER (WHERE d.day - h.day <= 1095), 5) / 5.0, 6) AS h3,
         round(ln(1 + least(coalesce(d.day - max(h.day), 3650), 3650)) / ln(3651), 6) AS hs
  FROM daily d LEFT JOIN hits h ON h.nation = d.nation AND h.day < d.day GROUP BY 1, 2"""))
def event_history_terms(spark, sf):
    return L.history(days(spark, sf), B.hits(spark, sf), "nation").select("nation", "day", *rnd("h1", "h3", "hs"))


@query("recent_event_counts", with_ctes(["daily", "hits", "nat"], """
  SELECT d.nation, d.day, count(*) FILTER (WHERE h.nation = d.nation AND d.day - h.day BETWEEN 30 AND 90) AS own_30_90,
         count(*) FILTER (WHERE h.nation <> d.nation AND hn.region = dn.region AND d.day - h.day BETWEEN 1 AND 90) AS linked_90,
         count(*) FILTER (WHERE h.nation <> d.nation AND hn.region <> dn.region AND d.day - h.day BETWEEN 1 AND 90) AS elsewhere_90
  FROM daily d JOIN nat dn ON dn.nation = d.nation LEFT JOIN hits h ON d.day - h.day BETWEEN 1 AND 90 LEFT JOIN nat hn ON hn.nation = h.nation GROUP BY 1, 2"""))
def recent_event_counts(spark, sf):
    """Own events a month or more back, events of the linked group, events elsewhere."""
    n = B.nations(spark, sf)
    other = n.select(F.col("nation").alias("linked"), "region")
    groups = n.join(other, "region").where("nation <> linked").select("nation", "linked")
    return L.recent_counts(days(spark, sf), B.hits(spark, sf), groups, "nation")


@query("decayed_event_history", with_ctes(["daily", "hits"], """
  SELECT d.nation, d.day, round(ln(1 + coalesce(sum(pow(2, -(d.day - h.day) / 90.0)), 0)), 6) AS decay_90,
         round(ln(1 + coalesce(sum(pow(2, -(d.day - h.day) / 365.0)), 0)), 6) AS decay_365
  FROM daily d LEFT JOIN hits h ON h.nation = d.nation AND h.day < d.day GROUP BY 1, 2"""))
def decayed_event_history(spark, sf):
    return L.decay_history(days(spark, sf), B.hits(spark, sf), [90, 365], "nation").select("nation", "day", *rnd("decay_90", "decay_365"))


@query("calm_days", with_ctes(["daily", "hits"], """
  SELECT nation, day FROM daily d WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.nation = d.nation AND d.day BETWEEN h.day - 30 AND h.day + 30)"""))
def calm_days(spark, sf):
    return L.calm_windows(days(spark, sf), B.hits(spark, sf), "nation")


@query("event_onsets", with_ctes(["hits"], """
  SELECT event_id, nation, day FROM (SELECT *, lag(day) OVER (PARTITION BY nation ORDER BY day, event_id) AS prev FROM hits) WHERE prev IS NULL OR day - prev > 30"""))
def event_onsets(spark, sf):
    return L.onsets(B.hits(spark, sf), "nation").select("event_id", "nation", "day")


@query("selected_event_kinds", with_ctes(["hits"], "SELECT event_id, nation, day, kind FROM hits WHERE kind IN ('strike', 'raid')"))
def selected_event_kinds(spark, sf):
    """Events restricted to a list of kinds by semi join."""
    keep = spark.createDataFrame([("strike",), ("raid",)], "kind string")
    return B.hits(spark, sf).join(keep, "kind", "left_semi").select("event_id", "nation", "day", "kind")


# ------------------------------------------------------------------ ranking skill and calibration
JUDGED = ("ok", "SELECT * FROM forecast WHERE lab")


def judged(spark, sf):
    return B.forecast(spark, sf).where("lab")


AUC_SQL = """
  SELECT {sel} (sum(CASE WHEN y = 1 THEN rk END) - n1 * (n1 + 1) / 2.0) / (n1 * n0)"""


@query("forecast_auc", with_ctes(["forecast"], """
  SELECT round((sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
               / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6) AS auc,
         count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y = 0) AS negatives
  FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM ok)""", [JUDGED]))
def forecast_auc(spark, sf):
    return E.auc(judged(spark, sf)).select(*rnd("auc"), "positives", "negatives")


BY_NATION_AUC = ("a", """
  SELECT nation, (sum(rk) FILTER (WHERE y = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS auc, n1 FROM (
    SELECT *, rank() OVER (PARTITION BY nation ORDER BY p) + (count(*) OVER (PARTITION BY nation, p) - 1) / 2.0 AS rk,
           sum(y) OVER (PARTITION BY nation) AS n1, sum(1 - y) OVER (PARTITION BY nation) AS n0 FROM ok)
  WHERE n1 > 0 AND n0 > 0 GROUP BY nation, n1, n0""")


@query("within_nation_auc", with_ctes(["forecast"], "SELECT round(sum(auc * n1) / sum(n1), 6) AS within_auc, count(*) AS groups FROM a", [JUDGED, BY_NATION_AUC]))
def within_nation_auc(spark, sf):
    return E.within_auc(judged(spark, sf), "nation").select(*rnd("within_auc"), "groups")


@query("brier_skill", with_ctes(["forecast"], """
  SELECT nation, count(*) AS n, round(avg((p - y) ** 2), 6) AS brier, round(avg((base - y) ** 2), 6) AS brier_base,
         round(avg(-ln(least(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-6), 1))), 6) AS log_loss,
         round(1 - avg((p - y) ** 2) / avg((base - y) ** 2), 6) AS skill FROM ok GROUP BY nation""", [JUDGED]))
def brier_skill(spark, sf):
    return E.skill(judged(spark, sf), ["nation"]).select("nation", "n", *rnd("brier", "brier_base", "log_loss", "skill"))


@query("murphy_decomposition", with_ctes(["forecast"], """
  SELECT round(sum(n * (mp - my) ** 2) / sum(n), 6) AS reliability, round(sum(n * (my - m) ** 2) / sum(n), 6) AS resolution, round(max(m * (1 - m)), 6) AS uncertainty
  FROM (SELECT bin, count(*) AS n, avg(p) AS mp, avg(y) AS my, max(m) AS m FROM (
    SELECT p, y, least(floor((rk - 0.5) * 10 / c), 9) AS bin, m FROM (
      SELECT p, y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk, count(*) OVER () AS c, avg(y) OVER () AS m FROM ok)) GROUP BY bin)""", [JUDGED]))
def murphy_decomposition(spark, sf):
    return E.murphy(judged(spark, sf)).select(*rnd("reliability", "resolution", "uncertainty"))


EDGES = (0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3)


@query("reliability_table", with_ctes(["forecast"], f"""
  SELECT band, {list(EDGES)}[band + 1]::DOUBLE AS low, n, round(mp, 6) AS mean_p, round(my, 6) AS event_rate FROM (
    SELECT ({" + ".join(f"(p >= {e})::INT" for e in EDGES[1:])})::INT AS band, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM ok GROUP BY 1) WHERE n >= 30""", [JUDGED]))
def reliability_table(spark, sf):
    return E.reliability(judged(spark, sf), EDGES).select("band", "low", "n", *rnd("mean_p", "event_rate"))


@query("top_decile_lift_and_recall", with_ctes(["forecast"], """
  SELECT round(avg(y) FILTER (WHERE p >= ca) / avg(y), 6) AS lift, count(DISTINCT eid) FILTER (WHERE y = 1 AND p >= cc) AS flagged,
         count(DISTINCT eid) FILTER (WHERE y = 1) AS events
  FROM ok, (SELECT quantile_cont(p, 0.9) AS ca, quantile_cont(p, 0.9) FILTER (WHERE y = 0) AS cc FROM ok)""", [JUDGED]))
def top_decile_lift_and_recall(spark, sf):
    return E.lift_and_recall(judged(spark, sf)).select(*rnd("lift"), "flagged", "events")


@query("noise_to_signal", with_ctes(["lead", "labels"], """
  SELECT region, threshold, round(hit, 6) AS hit, round(fa, 6) AS false_alarm, round(fa / hit, 6) AS nsr FROM (
    SELECT *, row_number() OVER (PARTITION BY region ORDER BY fa / hit, threshold) AS rn FROM (
      SELECT n_regionkey AS region, c AS threshold, sum((z >= c AND y = 1)::INT)::DOUBLE / sum(y) AS hit, sum((z >= c AND y = 0)::INT)::DOUBLE / sum(1 - y) AS fa, sum(y) AS pos
      FROM lead JOIN labels USING (nation, day) JOIN nation ON n_nationkey = nation, (VALUES (1.0), (1.5), (2.0), (2.5), (3.0)) t(c)
      WHERE NOT excl AND NOT unk GROUP BY 1, 2) WHERE pos >= 50 AND hit > 0) WHERE rn = 1"""))
def noise_to_signal(spark, sf):
    lab = L.build(days(spark, sf), B.hits(spark, sf), B.through(spark, sf), "nation")
    d = B.lead(spark, sf).join(lab, ["nation", "day"]).join(B.nations(spark, sf), "nation").where("not excl and not unk")
    return E.noise_to_signal(d, by=("region",), x="z").select("region", "threshold", *rnd("hit", "false_alarm", "nsr"))


@query("exact_quantiles", with_ctes([], """
  SELECT round(quantile_cont(o_totalprice, 0.1), 6) AS q0, round(quantile_cont(o_totalprice, 0.5), 6) AS q1, round(quantile_cont(o_totalprice, 0.99), 6) AS q2 FROM orders"""))
def exact_quantiles(spark, sf):
    """Exact quantiles of a raw fact column without one task ever holding the column."""
    return ranking.exact_quantiles(B.table(spark, sf, "orders"), "o_totalprice", [0.1, 0.5, 0.99]).select(*rnd("q0", "q1", "q2"))


@query("index_quantiles", with_ctes([], """
  SELECT o_orderstatus, list_sort(list(o_totalprice))[(floor(0.9 * count(*)))::INT + 1] AS q0, list_sort(list(o_totalprice))[(floor(0.95 * count(*)))::INT + 1] AS q1,
         list_sort(list(o_totalprice))[(floor(0.99 * count(*)))::INT + 1] AS q2 FROM orders GROUP BY 1"""))
def index_quantiles(spark, sf):
    return ranking.exact_quantiles(B.table(spark, sf, "orders"), "o_totalprice", [0.9, 0.95, 0.99], ["o_orderstatus"], method="index")


@query("averaged_ranks", with_ctes([], """
  SELECT l_quantity, count(*) AS n, min(rk) AS rank FROM (
    SELECT l_quantity, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rk FROM lineitem) GROUP BY 1"""))
def averaged_ranks(spark, sf):
    return ranking.average_ranks(B.table(spark, sf, "lineitem"), "l_quantity").select("l_quantity", "n", "rank")


@query("percent_rank_within_nation", with_ctes(["forecast"], """
  SELECT nation, day, round((rank() OVER (PARTITION BY nation ORDER BY p) + (count(*) OVER (PARTITION BY nation, p) - 1) / 2.0) / count(*) OVER (PARTITION BY nation), 6) AS pct
  FROM forecast"""))
def percent_rank_within_nation(spark, sf):
    f = B.forecast(spark, sf).select("nation", "day", "p")
    w = Window.partitionBy("nation").orderBy("p")
    ties = F.count(F.lit(1)).over(Window.partitionBy("nation", "p"))
    return f.select("nation", "day", F.round((F.rank().over(w) + (ties - 1) / 2) / F.count(F.lit(1)).over(Window.partitionBy("nation")), 6).alias("pct"))


@query("rank_correlation", with_ctes(["forecast"], """
  SELECT nation, round(corr(a, b), 6) AS spearman FROM (
    SELECT nation, row_number() OVER (PARTITION BY nation ORDER BY p, day) AS a, row_number() OVER (PARTITION BY nation ORDER BY y, day) AS b FROM forecast) GROUP BY 1"""))
def rank_correlation(spark, sf):
    f = B.forecast(spark, sf).withColumn("tie", F.col("day"))
    return E.spearman_no_ties(f, "p", "y", ["nation"]).select("nation", *rnd("spearman"))


# ------------------------------------------------------------------ resampling and timing controls (seeded: rows only)
def with_cluster(f):
    return f.withColumn("cluster", F.concat_ws("-", "nation", F.year("day"))).withColumn("ok", F.col("lab"))


@query("cluster_bootstrap_auc")
def cluster_bootstrap_auc(spark, sf):
    return E.cluster_bootstrap_auc(with_cluster(B.forecast(spark, sf)).where("ok"), "cluster")


#: The same rolls in SQL: the offset comes from the md5 of entity, shift and seed.
SHIFTS = [("num", """SELECT nation, day, p, y, lab, row_number() OVER (PARTITION BY nation ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY nation) AS n FROM forecast"""),
          ("offs", """SELECT nation, n, s, CASE WHEN s = 0 OR n <= 200 THEN 0 ELSE 60 + floor(('0x' || substr(md5(nation || '|' || s || '|2'), 1, 8))::BIGINT / 4294967296.0 * greatest(n - 120, 1)) END::BIGINT AS o
             FROM (SELECT DISTINCT nation, n FROM num), (SELECT unnest(range(301)) AS s)"""),
          ("moved", "SELECT o.s, a.nation, (a.i - o.o + a.n) % a.n AS j, a.y FROM num a JOIN offs o USING (nation) WHERE a.lab"),
          ("cells", "SELECT a.s, a.nation, b.p, sum(a.y) AS pos, sum(1 - a.y) AS neg FROM moved a JOIN num b ON b.nation = a.nation AND b.i = a.j GROUP BY 1, 2, 3"),
          ("tot", "SELECT s, p, sum(pos) AS pos, sum(neg) AS neg FROM cells GROUP BY 1, 2"),
          ("ctl", """SELECT s AS shift, a.auc, w.auc AS within_auc, skill FROM (
             SELECT s, sum(pos * (coalesce(nb, 0) + neg / 2)) / sum(pos) / sum(neg) AS auc, 1 - sum(pos * (p - 1) ** 2 + neg * p ** 2) / sum(pos + neg) / (sum(pos) / sum(pos + neg) * (1 - sum(pos) / sum(pos + neg))) AS skill
             FROM (SELECT *, sum(neg) OVER (PARTITION BY s ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM tot) GROUP BY 1) a JOIN (
             SELECT s, sum(u / g) / sum(pos) AS auc FROM (SELECT s, nation, sum(pos * (coalesce(nb, 0) + neg / 2)) AS u, sum(pos) AS pos, sum(neg) AS g FROM (
               SELECT *, sum(neg) OVER (PARTITION BY s, nation ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM cells) GROUP BY 1, 2) WHERE pos > 0 AND g > 0 GROUP BY 1) w USING (s)""")]


@query("shifted_timing_control", with_ctes(["forecast"], "SELECT shift, round(auc, 6) AS auc, round(within_auc, 6) AS within_auc, round(skill, 6) AS skill FROM ctl", SHIFTS))
def shifted_timing_control(spark, sf):
    return E.shift_control(with_cluster(B.forecast(spark, sf)), "nation").select("shift", *rnd("auc", "within_auc", "skill"))


@query("shifted_timing_p_values", with_ctes(["forecast"], """
  SELECT round(r.auc, 6) AS auc, round(r.within_auc, 6) AS within_auc, avg((c.auc >= r.auc)::INT) AS p_auc, avg((c.within_auc >= r.within_auc)::INT) AS p_within, round(r.skill, 6) AS skill_of_rate,
         avg((c.skill >= r.skill)::INT) AS p_skill FROM ctl c, (SELECT * FROM ctl WHERE shift = 0) r WHERE c.shift > 0 GROUP BY r.auc, r.within_auc, r.skill""", SHIFTS))
def shifted_timing_p_values(spark, sf):
    return E.shift_p_values(E.shift_control(with_cluster(B.forecast(spark, sf)), "nation")).select(*rnd("auc", "within_auc"), "p_auc", "p_within", *rnd("skill_of_rate"), "p_skill")


@query("paired_brier_bootstrap")
def paired_brier_bootstrap(spark, sf):
    return E.paired_bootstrap(with_cluster(B.forecast(spark, sf)).where("ok"), "cluster")


@query("release_gates")
def release_gates(spark, sf):
    return E.gates(with_cluster(B.forecast(spark, sf)), "nation")


@query("release_gates_by_region")
def release_gates_by_region(spark, sf):
    """The three gates for every region on its own rows."""
    f = with_cluster(B.forecast(spark, sf)).join(B.nations(spark, sf), "nation")
    return E.gates(f, "nation", by=["region"])


@query("bootstrap_region_reports", with_ctes(["forecast", "nat"], """
  SELECT region, days, pos, events, round(skill, 6) AS skill, round(u / pos / (days - pos), 6) AS auc FROM (
    SELECT region, count(*) AS days, sum(y) AS pos, count(DISTINCT eid) AS events, 1 - avg((p - y) ** 2) / avg((base - y) ** 2) AS skill FROM ok GROUP BY 1) JOIN (
    SELECT region, sum(pos * (coalesce(nb, 0) + neg / 2)) AS u FROM (SELECT *, sum(neg) OVER (PARTITION BY region ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM (
      SELECT region, p, sum(y) AS pos, sum(1 - y) AS neg FROM ok GROUP BY 1, 2)) GROUP BY 1) USING (region)""", [("ok", "SELECT f.*, region FROM forecast f JOIN nat USING (nation) WHERE lab")]))
def bootstrap_region_reports(spark, sf):
    """Per region the judged days, positives, events, skill and AUC (nothing is resampled; release_gates_by_region does that)."""
    f = stable(judged(spark, sf).join(B.nations(spark, sf), "nation"))
    n = f.groupBy("region").agg(F.count(F.lit(1)).alias("days"), F.sum("y").alias("pos"), F.count_distinct("eid").alias("events"))
    return n.join(E.skill(f, ["region"]).select("region", *rnd("skill")), "region").join(E.auc(f, by=["region"]).select("region", *rnd("auc")), "region")


# ------------------------------------------------------------------ windows before events against calm windows
WMAX = ("wm", """SELECT nation, day, CASE WHEN count(z) OVER w >= 15 THEN max(z) OVER w END AS wmax FROM lead
  WINDOW w AS (PARTITION BY nation ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
STUDY = [WMAX,
         ("ons", "SELECT event_id, nation, day FROM (SELECT *, lag(day) OVER (PARTITION BY nation ORDER BY day, event_id) AS prev FROM hits) WHERE prev IS NULL OR day - prev > 30"),
         ("calm", "SELECT nation, day FROM daily d WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.nation = d.nation AND d.day BETWEEN h.day - 30 AND h.day + 30)"),
         ("win", """SELECT w.nation, w.day, wmax, is_event FROM wm w JOIN (SELECT nation, day, TRUE AS is_event FROM ons UNION ALL SELECT nation, day, FALSE FROM calm) s
            ON w.nation = s.nation AND w.day = s.day"""),
         ("tested", """SELECT region, n, hits, calm, calm_hits, hits::DOUBLE / greatest(n, 1) AS hit_rate, fa AS false_alarm,
            CASE WHEN hits <= 0 THEN 1 WHEN fa <= 0 THEN 0 WHEN fa >= 1 THEN 1 ELSE least(1, list_sum(list_transform(range(hits, n + 1),
              lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(fa) + (n - i) * ln(1 - fa))))) END AS p_value
            FROM (SELECT *, calm_hits::DOUBLE / greatest(calm, 1) AS fa FROM (
              SELECT region, count(*) FILTER (WHERE is_event) AS n, count(*) FILTER (WHERE is_event AND wmax >= 1) AS hits,
                     count(*) FILTER (WHERE NOT is_event) AS calm, count(*) FILTER (WHERE NOT is_event AND wmax >= 1) AS calm_hits
              FROM win JOIN nat USING (nation) WHERE wmax IS NOT NULL GROUP BY 1))""")]


def study_windows(spark, sf):
    z = windows.window_max(B.lead(spark, sf), ["nation"])
    h = B.hits(spark, sf)
    return E.event_windows(z, L.onsets(h, "nation"), L.calm_windows(days(spark, sf), h, "nation"), "nation").join(B.nations(spark, sf), "nation")


@query("window_maximum", with_ctes(["lead"], "SELECT nation, day, round(wmax, 6) AS wmax FROM wm", [WMAX]))
def window_maximum(spark, sf):
    return windows.window_max(B.lead(spark, sf), ["nation"]).select("nation", "day", *rnd("wmax"))


@query("hit_rate_test", with_ctes(["lead", "hits", "nat"], """
  SELECT region, n, hits, calm, calm_hits, round(hit_rate, 6) AS hit_rate, round(false_alarm, 6) AS false_alarm, round(p_value, 6) AS p_value FROM tested""", STUDY))
def hit_rate_test(spark, sf):
    return E.hit_test(study_windows(spark, sf), ["region"], cut=1.0).select(
        "region", "n", "hits", "calm", "calm_hits", *rnd("hit_rate", "false_alarm", "p_value"))


@query("indicator_study", with_ctes(["lead", "hits", "nat"], """
  SELECT t.region, t.n, round(t.p_value, 6) AS p_value, round(q.q, 6) AS q, round(h.p_holm, 6) AS p_holm FROM tested t JOIN (
    SELECT region, least(1, min(raw) OVER (ORDER BY p_value DESC RANGE UNBOUNDED PRECEDING)) AS q FROM (
      SELECT region, p_value, p_value * count(*) OVER () / max(rn) OVER (PARTITION BY p_value) AS raw FROM (SELECT *, row_number() OVER (ORDER BY p_value) AS rn FROM tested))) q USING (region)
  JOIN (SELECT region, least(1, max(raw) OVER (ORDER BY p_value RANGE UNBOUNDED PRECEDING)) AS p_holm FROM (
      SELECT region, p_value, p_value * (count(*) OVER () - min(rn) OVER (PARTITION BY p_value) + 1) AS raw FROM (SELECT *, row_number() OVER (ORDER BY p_value) AS rn FROM tested))) h USING (region)""", STUDY))
def indicator_study(spark, sf):
    """The generic study: onset windows against calm windows, binomial tail, then both multiplicity corrections."""
    t = E.hit_test(study_windows(spark, sf), ["region"], cut=1.0)
    return E.holm(E.benjamini_hochberg(t)).select("region", "n", *rnd("p_value", "q", "p_holm"))


@query("fisher_exact_study", with_ctes(["lead", "hits", "nat"], """
  SELECT region, a, b, c, d, round(least(1, list_sum(list_transform(range(a, least(a + b, a + c) + 1), lambda i:
      exp(lgamma(a + c + 1) - lgamma(i + 1) - lgamma(a + c - i + 1) + lgamma(b + d + 1) - lgamma(a + b - i + 1) - lgamma(b + d - a - b + i + 1)
          - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1))))), 6) AS p_value
  FROM (SELECT region, hits AS a, n - hits AS b, calm_hits AS c, calm - calm_hits AS d FROM tested)""", STUDY))
def fisher_exact_study(spark, sf):
    t = E.hit_test(study_windows(spark, sf), ["region"], cut=1.0).select(
        "region", F.col("hits").alias("a"), (F.col("n") - F.col("hits")).alias("b"), F.col("calm_hits").alias("c"), (F.col("calm") - F.col("calm_hits")).alias("d"))
    return E.fisher(t, "a", "b", "c", "d").select("region", "a", "b", "c", "d", *rnd("p_value"))


@query("stratified_two_by_two", with_ctes(["lead", "hits", "nat"], """
  SELECT round(sum(a * d / n) / sum(b * c / n), 6) AS odds_ratio, round((abs(sum(a - (a + b) * (a + c) / n)) - 0.5) ** 2 / sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))), 6) AS chi2
  FROM (SELECT hits::DOUBLE AS a, (n - hits)::DOUBLE AS b, calm_hits::DOUBLE AS c, (calm - calm_hits)::DOUBLE AS d, (n + calm)::DOUBLE AS n FROM tested)""", STUDY))
def stratified_two_by_two(spark, sf):
    t = E.hit_test(study_windows(spark, sf), ["region"], cut=1.0).select(
        "region", F.col("hits").alias("a"), (F.col("n") - F.col("hits")).alias("b"), F.col("calm_hits").alias("c"), (F.col("calm") - F.col("calm_hits")).alias("d"))
    return E.mantel_haenszel(t).select(*rnd("odds_ratio", "chi2"))


@query("regime_split", with_ctes(["lead", "hits", "nat", "labels"], """
  SELECT recent, count(*) FILTER (WHERE is_event) AS n, count(*) FILTER (WHERE is_event AND wmax >= 1) AS hits, count(*) FILTER (WHERE NOT is_event) AS calm,
         count(*) FILTER (WHERE NOT is_event AND wmax >= 1) AS calm_hits
  FROM (SELECT w.*, EXISTS (SELECT 1 FROM hits h WHERE h.nation = w.nation AND w.day - h.day BETWEEN 1 AND 365) AS recent FROM win w WHERE wmax IS NOT NULL) GROUP BY 1""", STUDY))
def regime_split(spark, sf):
    """The hit-rate table split by whether the nation had an event in the year before."""
    w = study_windows(spark, sf)
    h = L.history(days(spark, sf), B.hits(spark, sf), "nation").select("nation", "day", (F.col("n_1y") > 0).alias("recent"))
    return E.hit_test(w.join(h, ["nation", "day"]), ["recent"], cut=1.0).select("recent", "n", "hits", "calm", "calm_hits")


@query("event_profile", with_ctes(["lead", "hits"], """
  SELECT (z.day - o.day)::INT AS k, round(avg(z), 6) AS mean, count(z) AS n FROM ons o JOIN lead z ON z.nation = o.nation AND z.day - o.day BETWEEN -60 AND 0 GROUP BY 1""", STUDY[1:2]))
def event_profile(spark, sf):
    return E.profile(B.lead(spark, sf), L.onsets(B.hits(spark, sf), "nation"), "nation").select("k", *rnd("mean"), "n")


# ------------------------------------------------------------------ episodes and per-event readouts
EPISODES = [("pr", "SELECT *, row_number() OVER (PARTITION BY nation ORDER BY day) AS i FROM forecast"),
            ("runs", """SELECT nation, min(day) AS start, max(day) AS stop, min(i) AS a, max(i) AS z FROM (
               SELECT *, sum(CASE WHEN i - prev - 1 > 7 THEN 1 ELSE 0 END) OVER (PARTITION BY nation ORDER BY day) AS run FROM (
                 SELECT *, lag(i) OVER (PARTITION BY nation ORDER BY day) AS prev FROM pr WHERE p >= 0.15 AND lab)) GROUP BY nation, run"""),
            ("eps", """SELECT r.nation, r.start, r.stop, (r.stop - r.start + 1)::INT AS days, (SELECT max(p) FROM pr WHERE pr.nation = r.nation AND pr.i BETWEEN r.a AND r.z) AS peak,
               (SELECT min(day) FROM hits h WHERE h.nation = r.nation AND h.day > r.start) AS nxt FROM runs r""")]


@query("alert_episodes", with_ctes(["forecast", "hits"], """
  SELECT nation, start, stop AS "end", days, peak, (nxt - start)::INT AS days_to_event, CASE WHEN nxt - stop <= 30 THEN 'hit' ELSE 'false alarm' END AS outcome FROM eps""", EPISODES))
def alert_episodes(spark, sf):
    return E.episodes(B.forecast(spark, sf), B.hits(spark, sf), 0.15, "nation")


@query("episode_summary", with_ctes(["forecast", "hits"], """
  SELECT count(*) AS n, count(*) FILTER (WHERE nxt - stop <= 30) AS hits, count(*) FILTER (WHERE nxt IS NULL OR nxt - stop > 30) AS false_alarms,
         count(*) FILTER (WHERE days > 60) AS long, median(days) AS median_days, sum(days)::BIGINT AS total_days FROM eps""", EPISODES))
def episode_summary(spark, sf):
    e = stable(E.episodes(B.forecast(spark, sf), B.hits(spark, sf), 0.15, "nation"))
    m = ranking.exact_quantiles(e, "days", [0.5]).select("q0").scalar()
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "hit").alias("hits"),
                 F.count_if(F.col("outcome") != "hit").alias("false_alarms"), F.count_if(F.col("days") > 60).alias("long"),
                 F.sum("days").alias("total_days")).withColumn("median_days", m)


PER_EVENT = ("pe", """
  SELECT *, (SELECT count(*) FROM forecast c WHERE c.nation = g.nation AND c.lab AND c.y = 0 AND c.p < p_day1) AS below,
         (SELECT count(*) FROM forecast c WHERE c.nation = g.nation AND c.lab AND c.y = 0) AS calm_n FROM (
    SELECT h.nation, h.event_id, h.day AS event_day, count(*) FILTER (WHERE f.lab) AS days_scored, arg_max(f.p, f.day) FILTER (WHERE f.lab) AS p_day1,
           max(f.p) FILTER (WHERE h.day - f.day = 7) AS p_day7, max(f.p) FILTER (WHERE h.day - f.day = 30) AS p_day30, max(f.p) FILTER (WHERE f.lab) AS p_max,
           arg_max(f.base, f.day) FILTER (WHERE f.lab) AS base,
           (SELECT CASE WHEN max(x.day) = h.day - 1 THEN 0 ELSE h.day - 1 - coalesce(max(x.day), (SELECT min(day) FROM forecast m WHERE m.nation = h.nation) - 1) END
            FROM forecast x WHERE x.nation = h.nation AND x.day < h.day AND x.p < 0.1) AS run
    FROM hits h LEFT JOIN forecast f ON f.nation = h.nation AND h.day - f.day BETWEEN 1 AND 30 GROUP BY 1, 2, 3) g""")


@query("event_readouts", with_ctes(["forecast", "hits"], """
  SELECT nation, event_id, event_day, days_scored, CASE WHEN ok THEN 'scored' ELSE 'not scored' END AS status, CASE WHEN ok THEN p_day1 END AS p_day1, CASE WHEN ok THEN p_day7 END AS p_day7,
         CASE WHEN ok THEN p_day30 END AS p_day30, CASE WHEN ok THEN p_max END AS p_max, round(CASE WHEN ok THEN p_day1 / base END, 6) AS lift_day1,
         round(CASE WHEN ok THEN 100.0 * below / calm_n END, 6) AS pctile_day1, (CASE WHEN ok THEN least(run, 30) END)::INT AS lead, CASE WHEN ok THEN run > 30 END AS up_before
  FROM (SELECT *, days_scored >= 10 AS ok FROM pe)""", [PER_EVENT]))
def event_readouts(spark, sf):
    return E.per_event(B.forecast(spark, sf), B.hits(spark, sf), 0.1, "nation").select(
        "nation", "event_id", "event_day", "days_scored", "status", "p_day1", "p_day7", "p_day30", "p_max", *rnd("lift_day1", "pctile_day1"), "lead", "up_before")


@query("event_summary", with_ctes(["forecast", "hits"], """
  SELECT count(*) AS events, count(*) FILTER (WHERE days_scored >= 10) AS scored, count(*) FILTER (WHERE days_scored >= 10 AND run > 0) AS hit,
         median(least(run, 30)) FILTER (WHERE days_scored >= 10 AND run > 0) AS median_lead FROM pe""", [PER_EVENT]))
def event_summary(spark, sf):
    e = stable(E.per_event(B.forecast(spark, sf), B.hits(spark, sf), 0.1, "nation"))
    ok = F.col("status") == "scored"
    m = ranking.exact_quantiles(e.where(ok & (F.col("lead") > 0)), "lead", [0.5]).select("q0").scalar()
    return e.agg(F.count(F.lit(1)).alias("events"), F.count_if(ok).alias("scored"), F.count_if(ok & (F.col("lead") > 0)).alias("hit")).withColumn("median_lead", m)


@query("event_grouping_sets", with_ctes(["hits"], """
  SELECT nation, kind, buildup, market_moving, count(*) AS n FROM hits GROUP BY GROUPING SETS ((nation), (kind), (buildup), (market_moving))"""))
def event_grouping_sets(spark, sf):
    return B.hits(spark, sf).groupingSets([["nation"], ["kind"], ["buildup"], ["market_moving"]], "nation", "kind", "buildup", "market_moving").agg(
        F.count(F.lit(1)).alias("n"))


@query("tell_replay_record", with_ctes(["ship_daily", "hits"], """
  SELECT s.nation, s.tell, count(*) AS episodes, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM hits h WHERE h.nation = s.nation AND h.day - s.day BETWEEN 1 AND 7)) AS hits,
         any_value(coalesce(e.events, 0)) AS events, any_value((SELECT count(*) FROM hits h WHERE h.nation = s.nation AND h.day >= (SELECT lo FROM seen)
           AND EXISTS (SELECT 1 FROM st o WHERE o.nation = h.nation AND o.tell = s.tell AND h.day - o.day BETWEEN 1 AND 7))) AS caught
  FROM st s LEFT JOIN (SELECT nation, count(*) AS events FROM hits WHERE day >= (SELECT lo FROM seen) GROUP BY 1) e USING (nation) GROUP BY 1, 2""",
       [TELL_SRC, ALL_TELLS_SQL, ("seen", "SELECT min(day) + 59 AS lo FROM ship_daily"),
        ("st", """SELECT nation, tell, day FROM (SELECT *, coalesce(max(fired::INT) OVER (PARTITION BY nation, tell ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS was FROM ft
            WHERE day >= (SELECT lo FROM seen)) WHERE fired AND was = 0""")]))
def tell_replay_record(spark, sf):
    """Every rule replayed over its history: episodes after seven quiet days, how many had an event within a week, and how many events were so announced."""
    lo = F.date_add(B.bounds(spark, sf).select("lo").scalar(), 59)
    starts = stable(windows.fresh_onsets(all_tells(spark, sf).where(F.col("day") >= lo), ["nation", "tell"]).select("nation", "tell", "day"))
    h = stable(B.hits(spark, sf).select("nation", "day", "event_id"))
    near = h.select("nation", F.explode(F.sequence(F.date_sub("day", 7), F.date_sub("day", 1))).alias("day")).distinct().withColumn("hit", F.lit(True))
    record = starts.join(near, ["nation", "day"], "left").groupBy("nation", "tell").agg(F.count(F.lit(1)).alias("episodes"), F.count_if("hit").alias("hits"))
    seen = h.where(F.col("day") >= lo)
    after = starts.select("nation", "tell", F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", 7))).alias("day")).distinct()
    caught = seen.join(after, ["nation", "day"]).groupBy("nation", "tell").agg(F.count(F.lit(1)).alias("caught"))
    events = seen.groupBy("nation").agg(F.count(F.lit(1)).alias("events"))
    out = record.join(events, "nation", "left").join(caught, ["nation", "tell"], "left")
    return out.select("nation", "tell", "episodes", "hits", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "caught")])


@query("forward_record_scores", with_ctes(["forecast"], """
  SELECT date_trunc('year', day)::DATE AS year, count(*) AS n, sum(y)::BIGINT AS positives, round(avg((p - y) ** 2), 6) AS brier FROM forecast WHERE NOT excl AND NOT unk GROUP BY 1"""))
def forward_record_scores(spark, sf):
    """Matured forecasts only, leaving out the days after an event."""
    return B.forecast(spark, sf).where("not excl and not unk").groupBy(F.trunc("day", "year").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("brier"))


@query("replay_metrics", with_ctes(["forecast", "hits"], """
  SELECT nation, count(*) FILTER (WHERE y = 0) AS calm, round(avg((p >= 0.15)::INT) FILTER (WHERE y = 0), 6) AS false_positive_rate,
         max(h.lead)::INT AS best_first_crossing FROM forecast f LEFT JOIN (
    SELECT h.nation AS hn, max(h.day - f.day) AS lead FROM hits h JOIN forecast f ON f.nation = h.nation AND h.day - f.day BETWEEN 1 AND 60 AND f.p >= 0.15 GROUP BY 1) h ON h.hn = f.nation
  WHERE lab GROUP BY 1"""))
def replay_metrics(spark, sf):
    """False-positive rate on calm days and the earliest crossing in the sixty days before any event."""
    f = B.forecast(spark, sf)
    pre = B.hits(spark, sf).select("nation", F.col("day").alias("on"), F.explode(F.sequence(F.date_sub("day", 60), F.date_sub("day", 1))).alias("day"))
    first = pre.join(f.where("p >= 0.15"), ["nation", "day"]).groupBy("nation").agg(F.max(F.datediff("on", "day")).alias("best_first_crossing"))
    r = f.where("lab").groupBy("nation").agg(F.count_if(F.col("y") == 0).alias("calm"),
                                             F.round(F.avg(F.when(F.col("y") == 0, (F.col("p") >= 0.15).cast("int"))), 6).alias("false_positive_rate"))
    return r.join(first, "nation", "left")


@query("blocked_calm_windows", with_ctes(["forecast", "hits"], """
  SELECT nation, blk::INT AS block, count(*) AS days, max(p) AS peak FROM (SELECT *, (day - DATE '1995-01-01') // 7 AS blk FROM forecast f
    WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.nation = f.nation AND f.day BETWEEN h.day - 30 AND h.day + 30)) GROUP BY 1, 2 HAVING count(*) >= 4"""))
def blocked_calm_windows(spark, sf):
    """Seven-day calm blocks with at least four data days."""
    c = L.calm_windows(B.forecast(spark, sf), B.hits(spark, sf), "nation")
    return c.groupBy("nation", F.floor(F.datediff("day", F.lit("1995-01-01").cast("date")) / 7).cast("int").alias("block")).agg(
        F.count(F.lit(1)).alias("days"), F.max("p").alias("peak")).where("days >= 4")


@query("segment_tails", with_ctes([], """
  SELECT segment, k, n, p, round(least(1, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))))), 6) AS p_value
  FROM (SELECT c_mktsegment AS segment, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) t(p)"""))
def segment_tails(spark, sf):
    """The same chance on thousands of orders, below, at and above the mode."""
    o = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    c = o.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("k"), F.count(F.lit(1)).alias("n"))
    c = c.withColumn("p", F.explode(F.array(*[F.lit(p) for p in (0.1, 0.2, 0.3)])))
    return c.select("segment", "k", "n", "p", F.round(tails.binomial_tail(F.col("k"), F.col("n"), F.col("p")), 6).alias("p_value"))


@query("binomial_tails", with_ctes([], """
  SELECT k, n, round(CASE WHEN k <= 0 THEN 1 ELSE least(1, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.3) + (n - i) * ln(0.7))))) END, 6) AS p_value
  FROM (SELECT count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS k, count(*) AS n FROM orders GROUP BY o_custkey)"""))
def binomial_tails(spark, sf):
    """Chance of a customer's share of urgent orders or more, per customer."""
    c = B.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("k"), F.count(F.lit(1)).alias("n"))
    return c.select("k", "n", F.round(tails.binomial_tail(F.col("k"), F.col("n"), F.lit(0.3)), 6).alias("p_value"))


@query("verdict_rules", with_ctes(["forecast"], """
  SELECT nation, CASE WHEN auc >= 0.6 AND n1 >= 30 THEN 'keep' WHEN auc >= 0.5 THEN 'watch' ELSE 'drop' END AS verdict FROM a""", [JUDGED, BY_NATION_AUC]))
def verdict_rules(spark, sf):
    a = E.auc(judged(spark, sf), by=["nation"]).where(F.col("auc").isNotNull())
    return a.select("nation", F.when((F.col("auc") >= 0.6) & (F.col("positives") >= 30), "keep").when(F.col("auc") >= 0.5, "watch").otherwise("drop").alias("verdict"))


@query("stability_by_half", with_ctes(["forecast"], """
  SELECT half, round(sum(auc * n1) / sum(n1), 6) AS within_auc, count(*) AS groups FROM (
    SELECT half, nation, (sum(rk) FILTER (WHERE y = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS auc, n1 FROM (
      SELECT *, rank() OVER (PARTITION BY half, nation ORDER BY p) + (count(*) OVER (PARTITION BY half, nation, p) - 1) / 2.0 AS rk,
             sum(y) OVER (PARTITION BY half, nation) AS n1, sum(1 - y) OVER (PARTITION BY half, nation) AS n0 FROM (SELECT *, (year(day) >= 1999)::INT AS half FROM ok))
    WHERE n1 > 0 AND n0 > 0 GROUP BY half, nation, n1, n0) GROUP BY half""", [JUDGED]))
def stability_by_half(spark, sf):
    f = judged(spark, sf).withColumn("half", (F.year("day") >= 1999).cast("int"))
    return E.within_auc(f, "nation", by=["half"]).select("half", *rnd("within_auc"), "groups")
