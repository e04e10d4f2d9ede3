"""Queries on the composite index, point-in-time replay, the evidence panel and the probability model."""
from pyspark.sql import Window, functions as F

from tocsin.functions import scoring as S
from tocsin.operators import composite as C, evaluate as E, labels as L, model as M, panel as P, pit, robust
from tocsin.operators.lineage import stable
from tocsin.plans import bindings as B
from tocsin.plans.bindings import with_ctes
from tocsin.plans.registry import query
from tocsin.plans.series_queries import filled_sql, final_z_sql, rnd, scored_sql

WEIGHTS = {"demand": 0.5, "alarm": 0.3, "supply": 0.2}
LINES = (0.6, 1.0, 2.0)

# ------------------------------------------------------------------ items shared by the composite queries
LAST = ("pts450", "SELECT * FROM points WHERE day > (SELECT hi FROM bounds) - 450")
SRC = ("src", "SELECT p.series_id, p.day, p.value, c.scale FROM pts450 p JOIN catalog c USING (family)")
ITEMS = [LAST, SRC, ("filled", filled_sql("src", ["series_id"])), ("scored", scored_sql("src", ["series_id"])[7:]),
         ("items", f"""SELECT s.series_id, p.nation, c.domain, c.direction, c.late, s.z, s.miss, zf AS zfull, zf * CASE WHEN late THEN 0.25 ELSE 1 END AS ze,
            CASE WHEN late THEN 0.25 ELSE 1.0 END AS k, CASE WHEN direction = 'down' THEN -1 ELSE 1 END AS sign, direction NOT IN ('up', 'down') AS "both"
            FROM (SELECT *, regexp_extract(series_id, '^(.*)_nation_', 1) AS family FROM ({final_z_sql("scored")}) WHERE day = (SELECT hi FROM bounds)) s
            JOIN catalog c USING (family) JOIN (SELECT DISTINCT series_id, nation FROM points) p USING (series_id),
            LATERAL (SELECT greatest(0, CASE direction WHEN 'up' THEN z WHEN 'down' THEN -z ELSE abs(z) END) AS zf)"""),
         ("pairs", """SELECT a.nation, a.domain, a.series_id, b.series_id AS other, count(*) AS n, corr(a.ch, b.ch) AS r FROM ch a JOIN ch b
            ON a.nation = b.nation AND a.domain = b.domain AND a.day = b.day AND a.series_id < b.series_id GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10 AND corr(a.ch, b.ch) > 0.8
            AND NOT isnan(corr(a.ch, b.ch))"""),
         ("lab", "SELECT i.*, coalesce(p.series_id, i.series_id) AS grp FROM items i LEFT JOIN pairs p ON p.other = i.series_id"),
         ("groups", "SELECT nation, domain, grp, avg(ze) AS z, bool_or(NOT late) AS fast, count(*) AS members, arg_max(series_id, ze + (rank_id * 1e-12)) AS best FROM (SELECT *, rank() OVER (ORDER BY series_id) AS rank_id FROM lab) GROUP BY 1, 2, 3"),
         ("doms", """SELECT nation, domain, sum(z * CASE WHEN n = 1 THEN 0.7 WHEN rn = 1 THEN 0.7 ELSE 0.3 END) AS score, max(n) AS groups, arg_min(fast, rn) AS fast FROM (
            SELECT *, row_number() OVER (PARTITION BY nation, domain ORDER BY z DESC, grp) AS rn, count(*) OVER (PARTITION BY nation, domain) AS n FROM groups) GROUP BY 1, 2"""),
         ("comp", """SELECT nation, m, sd, m + sd * sd / m AS idx, (m + sd * sd / m - 100) / 10 AS zc, firing, ff FROM (
            SELECT nation, sum(w * x) / sum(w) AS m, sqrt(greatest(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2, 0)) AS sd,
                   coalesce(list_sort(list(domain) FILTER (WHERE score >= 2)), []) AS firing, coalesce(bool_or(score >= 2 AND fast), FALSE) AS ff FROM (
              SELECT *, 100 + 10 * score AS x, CASE domain WHEN 'demand' THEN 0.5 WHEN 'alarm' THEN 0.3 ELSE 0.2 END AS w FROM doms) GROUP BY 1)"""),
         ("lev", f"""SELECT nation AS theatre, region, zc, firing, 1 + (zc >= {LINES[0]})::INT + (zc >= {LINES[1]})::INT + (zc >= {LINES[2]})::INT AS rk,
            ['Normal', 'Watch', 'Elevated', 'Critical'][1 + (zc >= {LINES[0]})::INT + (zc >= {LINES[1]})::INT + (zc >= {LINES[2]})::INT] AS level,
            100 / (1 + exp(least(greatest(-(zc - {LINES[0]}) / (({LINES[2]} - {LINES[0]}) / ln(9)), -50), 50))) AS reading, idx, sd, ff FROM comp JOIN nat USING (nation)"""),
         ("reg", """SELECT region, arg_max(level, rk * 1000 + reading) AS level, max(reading) AS reading, avg(100 + 10 * zc) + var_pop(100 + 10 * zc) / avg(100 + 10 * zc) AS idx, count(*) AS children FROM lev GROUP BY 1""")]
CH = ("ch", """SELECT series_id, nation, domain, day, (value - was) * CASE WHEN direction = 'down' THEN -1 ELSE 1 END AS ch FROM (
   SELECT p.*, c.domain, c.direction, lag(value) OVER (PARTITION BY series_id ORDER BY day) AS was FROM points p JOIN catalog c USING (family)
   WHERE day > (SELECT hi FROM bounds) - 31) WHERE was IS NOT NULL""")
ITEMS.insert(5, CH)
NEED = ["points", "catalog", "bounds", "nat"]


def items(spark, sf):
    """Newest scored item of every catalogue series."""
    hi = B.bounds(spark, sf).select("hi").scalar()
    p = B.points(spark, sf).where(F.col("day") > F.date_sub(hi, 450)).join(B.catalog(spark), "family")
    p = p.withColumn("scale", F.coalesce("scale", F.lit("none")))
    keys = ["series_id", "nation", "domain", "direction", "late", "scale"]
    s = robust.score_daily(p, keys, scale=F.col("scale"), newest_only=True)
    return stable(C.items(s.withColumnRenamed("nation", "theatre")))


def recent_points(spark, sf):
    hi = B.bounds(spark, sf).select("hi").scalar()
    return B.points(spark, sf).where(F.col("day") > F.date_sub(hi, 31)).select("series_id", "day", "value")


def meta(its):
    return its.select("series_id", "theatre", "domain", F.lit("daily").alias("kind"), "sign")


def edges(spark, sf, its):
    return C.correlated_pairs(recent_points(spark, sf), meta(its))


def groups(spark, sf):
    its = items(spark, sf)
    return its, stable(C.groups(its, C.components(its, edges(spark, sf, its))))


def weights(spark):
    return spark.createDataFrame(list(WEIGHTS.items()), "domain string, weight double")


def fixed_lines(spark, sf):
    return B.nations(spark, sf).select(F.col("nation").alias("theatre"), *[F.lit(v).alias(n) for n, v in zip(("t_watch", "t_elevated", "t_critical"), LINES)])


def levels(spark, sf):
    its, g = groups(spark, sf)
    c = C.with_level(C.composite(C.domain_scores(g), weights(spark)), fixed_lines(spark, sf))
    return its, c.join(B.nations(spark, sf).withColumnRenamed("nation", "theatre"), "theatre")


@query("composite_items", with_ctes(NEED, "SELECT series_id, nation AS theatre, domain, round(ze, 6) AS ze, round(zfull, 6) AS zfull, k, sign, \"both\" FROM items", ITEMS))
def composite_items(spark, sf):
    return items(spark, sf).select("series_id", "theatre", "domain", *rnd("ze", "zfull"), "k", "sign", "both")


@query("correlated_series_pairs", with_ctes(NEED, "SELECT nation AS theatre, domain, series_id, other, n, round(r, 6) AS r FROM pairs", ITEMS))
def correlated_series_pairs(spark, sf):
    return edges(spark, sf, items(spark, sf)).select("theatre", "domain", "series_id", "other", "n", *rnd("r"))


@query("redundancy_groups", with_ctes(NEED, "SELECT nation AS theatre, domain, grp, round(z, 6) AS z, fast, members FROM groups", ITEMS))
def redundancy_groups(spark, sf):
    return groups(spark, sf)[1].select("theatre", "domain", "grp", *rnd("z"), "fast", "members")


@query("domain_scores", with_ctes(NEED, "SELECT nation AS theatre, domain, round(score, 6) AS score, groups, fast FROM doms", ITEMS))
def domain_scores(spark, sf):
    return C.domain_scores(groups(spark, sf)[1]).select("theatre", "domain", *rnd("score"), "groups", "fast")


@query("composite_index", with_ctes(NEED, """SELECT theatre, region, level, round(zc, 6) AS zc, round(idx, 6) AS "index", round(sd, 4) AS imbalance, round(reading, 6) AS reading, array_to_string(firing, ',') AS firing,
  CASE WHEN level NOT IN ('Elevated', 'Critical') THEN '' WHEN ff THEN 'leading and lagging' ELSE 'lagging only' END AS basis FROM lev""", ITEMS))
def composite_index(spark, sf):
    c = levels(spark, sf)[1]
    return c.select("theatre", "region", "level", *rnd("zc", "index"), F.round("imbalance", 4).alias("imbalance"), *rnd("reading"),
                    F.concat_ws(",", "firing").alias("firing"), "basis")


@query("region_rollup", with_ctes(NEED, 'SELECT region, level, round(reading, 6) AS reading, round(idx, 6) AS "index", children FROM reg', ITEMS))
def region_rollup(spark, sf):
    return C.rollup(levels(spark, sf)[1]).select("region", "level", *rnd("reading", "index"), "children")


@query("world_rollup", with_ctes(NEED, """
  SELECT round(least(100, avg(reading) + var_pop(reading) / avg(reading)), 6) AS reading, arg_max(level, list_position(['Normal', 'Watch', 'Elevated', 'Critical'], level) * 1000 + reading) AS level,
         count(*) FILTER (WHERE level = 'Normal') AS n_normal, count(*) FILTER (WHERE level = 'Watch') AS n_watch, count(*) FILTER (WHERE level = 'Elevated') AS n_elevated,
         count(*) FILTER (WHERE level = 'Critical') AS n_critical FROM reg""", ITEMS))
def world_rollup(spark, sf):
    return C.world(C.rollup(levels(spark, sf)[1])).select(*rnd("reading"), "level", "n_normal", "n_watch", "n_elevated", "n_critical")


@query("composite_confidence", with_ctes(NEED, """SELECT nation AS theatre, round(1.0 * (count(*) / 6.0) * (1 - avg(miss)), 3) AS confidence, round(1 - count(*) / 6.0, 3) AS missing,
  CASE WHEN round(1 - count(*) / 6.0, 3) > 0.2 THEN 'Low' WHEN round(1 - count(*) / 6.0, 3) > 0.1 THEN 'Medium' ELSE 'High' END AS label FROM items GROUP BY 1""", ITEMS))
def composite_confidence(spark, sf):
    its, g = groups(spark, sf)
    total = B.nations(spark, sf).select(F.col("nation").alias("theatre"), F.lit(len(B.FAMILIES)).alias("total"))
    return C.confidence(its, total, C.composite(C.domain_scores(g), weights(spark)))


@query("legacy_levels", with_ctes(NEED, """
  SELECT nation AS theatre, live, signals, watching, CASE WHEN live < 2 THEN 'insufficient data' WHEN signals >= 3 THEN 'Alert' WHEN signals = 2 THEN 'Warning' WHEN signals = 1 OR watching >= 2 THEN 'Watch' ELSE 'Normal' END AS level
  FROM (SELECT nation, count(*) AS live, count(*) FILTER (WHERE zd >= 3) AS signals, count(*) FILTER (WHERE zd >= 2) AS watching FROM (
    SELECT nation, domain, CASE WHEN count(*) = 2 THEN avg(zd) ELSE max(zd) * 0.7 END AS zd FROM (
      SELECT *, CASE direction WHEN 'up' THEN z WHEN 'down' THEN -z ELSE abs(z) END AS zd, row_number() OVER (PARTITION BY nation, domain ORDER BY CASE direction WHEN 'up' THEN z WHEN 'down' THEN -z ELSE abs(z) END DESC, series_id) AS rn FROM items)
    WHERE rn <= 2 GROUP BY 1, 2) GROUP BY 1)""", ITEMS))
def legacy_levels(spark, sf):
    return C.legacy_level(items(spark, sf)).select("theatre", "live", "signals", "watching", "level")


@query("calm_world_thresholds")
def calm_world_thresholds(spark, sf):
    """Simulated 90 / 95 / 99% lines per theatre shape, and where today's reading sits among the calm draws."""
    _, g = groups(spark, sf)
    t = stable(C.thresholds(g, weights(spark)))
    c = C.composite(C.domain_scores(g), weights(spark))
    return t.select("theatre", *rnd("t_watch", "t_elevated", "t_critical")).join(C.calm_percentile(c, t), "theatre")


@query("measured_calm_quantiles", with_ctes(["lead", "daily", "hits"], """
  SELECT q, round(list_sort(list(z))[(floor(q * count(*)))::INT + 1], 6) AS z FROM lead l CROSS JOIN (VALUES (0.5), (0.9), (0.99)) t(q)
  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.nation = l.nation AND l.day BETWEEN h.day - 30 AND h.day + 30) GROUP BY q"""))
def measured_calm_quantiles(spark, sf):
    """Quantiles of z on calm days, every series weighing by its own days."""
    from tocsin.operators import ranking
    c = L.calm_windows(B.lead(spark, sf), B.hits(spark, sf), "nation")
    q = ranking.exact_quantiles(c, "z", [0.5, 0.9, 0.99], method="index")
    return q.select(F.inline(F.array(*[F.struct(F.lit(p).alias("q"), F.round(f"q{i}", 6).alias("z")) for i, p in enumerate((0.5, 0.9, 0.99))])))


LEFT_OUT = [*ITEMS, ("drops", "SELECT nation, 'signal' AS kind, series_id AS dropped FROM lab UNION ALL SELECT DISTINCT nation, 'domain', domain FROM lab UNION ALL SELECT DISTINCT nation, 'none', '' FROM lab"),
            ("rest", "SELECT d.kind, d.dropped, l.* FROM drops d JOIN lab l ON l.nation = d.nation AND NOT (d.kind = 'signal' AND l.series_id = d.dropped) AND NOT (d.kind = 'domain' AND l.domain = d.dropped)"),
            ("doms2", """SELECT nation, kind, dropped, domain, sum(z * CASE WHEN n = 1 THEN 0.7 WHEN rn = 1 THEN 0.7 ELSE 0.3 END) AS score FROM (
               SELECT *, row_number() OVER (PARTITION BY nation, kind, dropped, domain ORDER BY z DESC, grp) AS rn, count(*) OVER (PARTITION BY nation, kind, dropped, domain) AS n FROM (
                 SELECT nation, kind, dropped, domain, grp, avg(ze) AS z FROM rest GROUP BY 1, 2, 3, 4, 5)) GROUP BY 1, 2, 3, 4"""),
            ("comp2", """SELECT nation, kind, dropped, (m + v / m - 100) / 10 AS zc FROM (SELECT nation, kind, dropped, sum(w * x) / sum(w) AS m, sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2 AS v FROM (
               SELECT *, 100 + 10 * score AS x, CASE domain WHEN 'demand' THEN 0.5 WHEN 'alarm' THEN 0.3 ELSE 0.2 END AS w FROM doms2) GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""),
            ("whole", "SELECT nation, zc AS f FROM comp2 WHERE kind = 'none'"),
            ("moved", "SELECT d.nation, kind, dropped, f, coalesce(zc, f) AS z FROM drops d JOIN whole USING (nation) LEFT JOIN comp2 USING (nation, kind, dropped) WHERE kind <> 'none'"),
            ("ranks", """SELECT m.nation, kind, dropped, count(*) FILTER (WHERE w.f < m.z OR (w.f = m.z AND w.nation < m.nation)) AS r1, count(*) FILTER (WHERE w.f < m.f OR (w.f = m.f AND w.nation < m.nation)) AS r0
               FROM moved m JOIN whole w ON w.nation <> m.nation GROUP BY 1, 2, 3"""),
            ("places", """SELECT m.nation, m.kind, m.dropped, m.nation = w.nation AS own, CASE WHEN m.nation = w.nation THEN r0 ELSE rk END AS a,
               CASE WHEN m.nation = w.nation THEN r1 ELSE rk - (CASE WHEN rk > r0 THEN 1 ELSE 0 END) + (CASE WHEN rk - (CASE WHEN rk > r0 THEN 1 ELSE 0 END) >= r1 THEN 1 ELSE 0 END) END AS b
               FROM ranks m, (SELECT nation, row_number() OVER (ORDER BY f, nation) - 1 AS rk FROM whole) w""")]


@query("composite_sensitivity", with_ctes(NEED, """
  SELECT m.nation AS theatre, m.kind, m.dropped, round(z, 6) AS zc, round(z - f, 6) AS change, round(rho, 6) AS rho FROM moved m JOIN (
    SELECT nation, kind, dropped, corr(a, b) AS rho FROM places GROUP BY 1, 2, 3) USING (nation, kind, dropped)""", LEFT_OUT))
def composite_sensitivity(spark, sf):
    """Composite with each signal and each domain left out in turn, and what that does to the ranking of all theatres."""
    its = items(spark, sf)
    return C.sensitivity(its, C.components(its, edges(spark, sf, its)), weights(spark)).select("theatre", "kind", "dropped", *rnd("zc", "change", "rho"))


@query("portfolio_score")
def portfolio_score(spark, sf):
    """The stand-alone scoring entry over one portfolio of world totals."""
    p = B.points(spark, sf).groupBy(F.col("family").alias("series_id"), "day").agg(F.sum("value").alias("value"))
    m = B.catalog(spark).select(F.col("family").alias("series_id"), "domain", "direction", "late", F.lit("daily").alias("kind"))
    return C.compute_composite_score(p, m, weights(spark)).select("theatre", "live", "level", *rnd("zc", "reading"))


# ------------------------------------------------------------------ point in time
@query("available_points", with_ctes(["raw_points"], "SELECT nation, day, day + 3 AS avail FROM raw_points"))
def available_points(spark, sf):
    return pit.available(B.raw_points(spark, sf), 3).select("nation", "day", "avail")


@query("as_of_state", with_ctes(["raw_points", "daily"], """
  SELECT d.nation, d.day, round(r.value, 6) AS value FROM (SELECT nation, day FROM daily WHERE (day - DATE '1995-01-01') % 2 = 0) d
  ASOF LEFT JOIN (SELECT nation, day + 3 AS avail, value FROM raw_points) r ON d.nation = r.nation AND d.day >= r.avail"""))
def as_of_state(spark, sf):
    """The newest reading published by each replay day, three days of lag, every second day."""
    asks = B.daily(spark, sf).where(F.datediff("day", F.lit("1995-01-01").cast("date")) % 2 == 0).select("nation", "day")
    return pit.replay(B.raw_points(spark, sf), asks, ["nation"], 3, cols=("value",)).select("nation", "day", *rnd("value"))


@query("days_to_next_event", with_ctes(["forecast", "hits"], """
  SELECT f.nation, f.day, (min(h.day) - f.day)::INT AS days_to_next FROM forecast f LEFT JOIN hits h ON h.nation = f.nation AND h.day > f.day GROUP BY 1, 2"""))
def days_to_next_event(spark, sf):
    d = pit.next_after(B.forecast(spark, sf).select("nation", "day"), B.hits(spark, sf), ["nation"])
    return d.select("nation", "day", F.datediff("next", "day").alias("days_to_next"))


REPLAY = [("src", "SELECT series_id, nation, domain, direction, late, day, value FROM points JOIN catalog USING (family)"),
          ("zz", """SELECT *, (m7 - mu) / greatest(sd, 0.25 * abs(mu), 0.5) AS z FROM (
             SELECT series_id, nation, domain, direction, late, day, avg(value) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m7, avg(value) OVER b AS mu, stddev_pop(value) OVER b AS sd,
                    row_number() OVER (PARTITION BY series_id ORDER BY day) AS i FROM src WINDOW b AS (PARTITION BY series_id ORDER BY day ROWS BETWEEN 180 PRECEDING AND 31 PRECEDING)) WHERE i > 180"""),
          ("it", """SELECT nation, domain, d.day, z.series_id, z.late, greatest(0, CASE direction WHEN 'up' THEN z WHEN 'down' THEN -z ELSE abs(z) END) * CASE WHEN late THEN 0.25 ELSE 1 END AS ze
             FROM (SELECT DISTINCT day FROM daily WHERE (day - DATE '1995-01-01') % 2 = 0) d JOIN zz z ON z.day = d.day - 1"""),
          ("doms", """SELECT nation, domain, day, sum(ze * CASE WHEN n = 1 THEN 0.7 WHEN rn = 1 THEN 0.7 ELSE 0.3 END) AS score FROM (
             SELECT *, row_number() OVER (PARTITION BY nation, domain, day ORDER BY ze DESC, series_id) AS rn, count(*) OVER (PARTITION BY nation, domain, day) AS n FROM it) GROUP BY 1, 2, 3""")]


@query("composite_replay", with_ctes(["points", "catalog", "daily"], """
  SELECT nation AS theatre, day, round((m + v / m - 100) / 10, 6) AS zc FROM (
    SELECT nation, day, sum(w * x) / sum(w) AS m, sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2 AS v FROM (
      SELECT *, 100 + 10 * score AS x, CASE domain WHEN 'demand' THEN 0.5 WHEN 'alarm' THEN 0.3 ELSE 0.2 END AS w FROM doms) GROUP BY 1, 2)""", REPLAY))
def composite_replay(spark, sf):
    """The composite replayed every second day, one day of publication lag, all theatres in one plan."""
    it = replay_items(spark, sf)
    g = it.select("theatre", "day", "domain", F.col("series_id").alias("grp"), F.col("ze").alias("z"), F.lit(1).alias("members"),
                  (~F.col("late")).alias("fast"), F.col("series_id").alias("best"))
    by = ("theatre", "day")
    return C.composite(C.domain_scores(g, by), weights(spark), by).select("theatre", "day", *rnd("zc"))


REPLAY_STEP = 2  # days; a fixed value of the replay


def replay_items(spark, sf):
    p = B.points(spark, sf).join(B.catalog(spark), "family")
    keys = ["series_id", "nation", "domain", "direction", "late"]
    z = robust.lead_z(p.select(*keys, "day", "value"), keys)
    z = z.withColumn("day", F.date_add("day", 1)).where(F.datediff("day", F.lit("1995-01-01").cast("date")) % REPLAY_STEP == 0)
    z = z.where(F.col("day") <= B.bounds(spark, sf).select("hi").scalar())
    return C.items(z.withColumnRenamed("nation", "theatre"))


@query("domain_strips", with_ctes(["points", "catalog", "daily"], "SELECT nation AS theatre, domain, day, round(score, 6) AS score FROM doms", REPLAY))
def domain_strips(spark, sf):
    """Domain scores on each replay day."""
    it = replay_items(spark, sf)
    return C.ordered_average(it, ["theatre", "domain", "day"], "ze", ["series_id"]).select("theatre", "domain", "day", *rnd("score"))


# ------------------------------------------------------------------ panel
PANEL = [("fz", """SELECT series_id, family, nation, direction, day, (m7 - mu) / greatest(sd, 0.25 * abs(mu), 0.5) AS z FROM (
            SELECT series_id, family, nation, direction, day, avg(value) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m7, avg(value) OVER b AS mu, stddev_pop(value) OVER b AS sd,
                   row_number() OVER (PARTITION BY series_id ORDER BY day) AS i FROM points JOIN catalog USING (family)
            WINDOW b AS (PARTITION BY series_id ORDER BY day ROWS BETWEEN 180 PRECEDING AND 31 PRECEDING)) WHERE i > 180"""),
         ("ev", "SELECT nation, day, family, max(least(greatest(0, CASE direction WHEN 'up' THEN z WHEN 'down' THEN -z ELSE abs(z) END), 5)) AS e FROM fz GROUP BY 1, 2, 3"),
         ("par", "SELECT nation, (nation + 24) % 25 AS parent FROM nat WHERE nation % 5 = 4 UNION ALL SELECT nation, (nation + 23) % 25 FROM nat WHERE nation % 5 = 4"),
         ("pan", "SELECT nation, day, family, max(e) AS e FROM (SELECT nation, day, family, e FROM ev UNION ALL SELECT par.nation, day, family, e FROM ev JOIN par ON ev.nation = par.parent) GROUP BY 1, 2, 3")]
FAMS = [f[0] for f in B.FAMILIES]


def evidence(spark, sf):
    p = B.points(spark, sf, FAMS).join(B.catalog(spark), "family")
    keys = ["series_id", "family", "nation", "direction"]
    z = robust.lead_z(p.select(*keys, "day", "value"), keys)
    return P.evidence(z.withColumnRenamed("nation", "theatre"))


def parents(spark, sf):
    n = B.nations(spark, sf).where("nation % 5 = 4")
    return n.select(F.col("nation").alias("theatre"), F.explode(F.array((F.col("nation") + 24) % 25, (F.col("nation") + 23) % 25)).alias("parent"))


@query("evidence_panel", with_ctes(["points", "catalog", "nat"], "SELECT nation AS theatre, day, family, round(e, 6) AS e FROM pan", PANEL))
def evidence_panel(spark, sf):
    """Theatre-day evidence in long form, sub-theatres reading the stronger of their own and their parents'."""
    return P.with_parents(evidence(spark, sf), parents(spark, sf)).select("theatre", "day", "family", *rnd("e"))


@query("evidence_panel_wide", with_ctes(["points", "catalog", "nat"], "SELECT nation AS theatre, day, " + ", ".join(
    f"round(max(e) FILTER (WHERE family = '{f}'), 6) AS {f}" for f in FAMS) + " FROM pan GROUP BY 1, 2", PANEL))
def evidence_panel_wide(spark, sf):
    return P.wide(P.with_parents(evidence(spark, sf), parents(spark, sf)), FAMS).select("theatre", "day", *rnd(*FAMS))


@query("family_names", with_ctes(["points"], r"SELECT DISTINCT series_id, regexp_replace(series_id, '_(nation_\d+)$', '') AS family FROM points"))
def family_names(spark, sf):
    ids = B.nations(spark, sf).select(F.explode(F.array(*[F.concat(F.lit(f[0] + "_nation_"), "nation") for f in B.FAMILIES])).alias("series_id"))
    return ids.withColumn("family", P.family("series_id", r"nation_\d+"))


@query("cross_domain_features", with_ctes(["points", "catalog", "nat"], """
  SELECT theatre, day, "any", domains_up, mean_z, together FROM (
    SELECT nation AS theatre, day, round(max(z), 6) AS "any", count(*) FILTER (WHERE z >= 1.5) AS domains_up, round(avg(least(greatest(z, 0), 5)), 6) AS mean_z
    FROM (SELECT nation, day, domain, max(z) AS z FROM fz JOIN catalog USING (family) WHERE z IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) = 3)
  JOIN (SELECT nation AS theatre, day, round(least(max(z) FILTER (WHERE family = 'ord_n'), greatest(max(z) FILTER (WHERE family = 'ship_n'), max(z) FILTER (WHERE family = 'urgent_n'))), 6) AS together
    FROM fz GROUP BY 1, 2) USING (theatre, day)""", PANEL[:1]))
def cross_domain_features(spark, sf):
    """Domains that are up together, mean clipped z, and the co-occurrence feature."""
    p = B.points(spark, sf, FAMS)
    z = robust.lead_z(p.select("series_id", "family", "nation", "day", "value"), ["series_id", "family", "nation"]).withColumnRenamed("nation", "theatre")
    f = P.domain_features(z.where(F.col("z").isNotNull()).join(B.catalog(spark).select("family", "domain"), "family"))
    w = z.groupBy("theatre", "day").agg(*[F.max(F.when(F.col("family") == c, F.col("z"))).alias(c) for c in FAMS])
    w = w.select("theatre", "day", P.co_occurrence(w, "ord_n", "ship_n", "urgent_n").alias("together"))
    return f.join(w, ["theatre", "day"]).select("theatre", "day", *rnd("any"), "domains_up", *rnd("mean_z", "together"))


def model_rows(spark, sf):
    """Design rows: nation-week evidence with labels and history, judged rows marked."""
    ev = P.wide(evidence(spark, sf), FAMS).withColumnRenamed("theatre", "nation")
    days = ev.select("nation", "day")
    h = B.hits(spark, sf)
    lab = L.build(days, h, B.through(spark, sf), "nation")
    hist = L.history(days, h, "nation")
    rows = ev.join(lab, ["nation", "day"]).join(hist, ["nation", "day"]).withColumn("theatre", F.col("nation").cast("string"))
    rows = rows.withColumn("lab", ~F.col("excl") & ~F.col("unk")).withColumn("cluster", F.concat_ws("-", "theatre", F.year("day")))
    rows = rows.withColumns({f"seen_{f}": F.col(f).isNotNull() for f in FAMS})
    return stable(P.design(rows, OFFSETS_T, FAMS))


OFFSETS_T = [str(i) for i in range(25)]
OFFSETS = [f"t_{t}" for t in OFFSETS_T]
HIST = ["h1", "h3", "hs"]
W = [f"w_{f}" for f in FAMS]
TRAINING_YEARS = 4


def test_years(rows):
    """Years that are judged: all but the first few, which only train. One number per year comes to the driver."""
    return sorted(r["y"] for r in rows.select(F.year("day").alias("y")).distinct().collect())[TRAINING_YEARS:]


def before_and_after(rows):
    """Rows before the last two test years, and those of them and later."""
    cut = F.make_date(F.lit(test_years(rows)[-2]), F.lit(1), F.lit(1))
    return rows.where(F.col("day") < cut), rows.where(F.col("day") >= cut)


@query("design_matrix", with_ctes(["points", "catalog", "nat", "labels", "hits"], """
  SELECT w.nation, w.day, round(coalesce(ord_n, 0) / 5, 6) AS w_ord_n, round(coalesce(ship_n, 0) / 5, 6) AS w_ship_n, (w.nation = 3)::INT::DOUBLE AS t_3, y, NOT excl AND NOT unk AS lab FROM (
    SELECT nation, day, max(e) FILTER (WHERE family = 'ord_n') AS ord_n, max(e) FILTER (WHERE family = 'ship_n') AS ship_n FROM ev GROUP BY 1, 2) w JOIN labels USING (nation, day)""", PANEL[:2]))
def design_matrix(spark, sf):
    return model_rows(spark, sf).select("nation", "day", *rnd("w_ord_n", "w_ship_n"), "t_3", "y", "lab")


@query("smoothed_base_rates", with_ctes(["forecast"], """
  SELECT nation, round((sum(y) + 1000 * (SELECT avg(y) FROM ok)) / (count(*) + 1000), 6) AS base FROM ok GROUP BY 1""", [("ok", "SELECT * FROM forecast WHERE lab")]))
def smoothed_base_rates(spark, sf):
    return M.base_rates(stable(B.forecast(spark, sf).where("lab")), "nation").select("nation", *rnd("base"))


SHRINK = "greatest(1 / (1 + exp(-(ln(base / (1 - base)) + g * (ln(p / (1 - p)) - ln(base / (1 - base)))))), f * base)"


@query("published_probability", with_ctes(["forecast"], f"SELECT nation, day, round({SHRINK}, 6) AS published FROM forecast, (SELECT 0.6 AS g, 0.5 AS f)"))
def published_probability(spark, sf):
    f = B.forecast(spark, sf)
    return f.select("nation", "day", F.round(S.shrink(F.col("p"), F.col("base"), F.lit(0.6), F.lit(0.5)), 6).alias("published"))


GRID = [("ok", "SELECT *, year(day) AS year FROM forecast WHERE lab"),
        ("grid", "SELECT g, f FROM (VALUES (0.2), (0.3), (0.4), (0.5), (0.6), (0.7), (0.8), (0.9), (1.0)) a(g), (VALUES (0.0), (0.25), (0.5), (0.75)) b(f)")]


@query("shrink_grid_search", with_ctes(["forecast"], f"""
  SELECT g AS gamma, f AS phi, round(b, 6) AS brier FROM (SELECT g, f, avg(({SHRINK} - y) ** 2) AS b FROM ok, grid GROUP BY 1, 2) ORDER BY b, g, f LIMIT 1""", GRID))
def shrink_grid_search(spark, sf):
    return M.shrink_grid(B.forecast(spark, sf).where("lab"), raw="p").select("gamma", "phi", *rnd("brier"))


@query("nested_publishing", with_ctes(["forecast"], f"""
  SELECT nation, day, round({SHRINK}, 6) AS published FROM (SELECT o.*, coalesce(b.g, 0.6) AS g, coalesce(b.f, 0.5) AS f FROM ok o LEFT JOIN (
    SELECT t, arg_min(g, b * 1e6 + g * 1e-6 + f * 1e-9) AS g, arg_min(f, b * 1e6 + g * 1e-6 + f * 1e-9) AS f FROM (
      SELECT t, g, f, avg(({SHRINK} - y) ** 2) AS b FROM ok JOIN (SELECT DISTINCT year AS t FROM ok) ON year < t, grid GROUP BY 1, 2, 3) WHERE t >= 1997 GROUP BY 1) b ON b.t = o.year)""", GRID))
def nested_publishing(spark, sf):
    """Shrinkage fitted on earlier years only; the defaults for the first two years."""
    f = B.forecast(spark, sf).where("lab").withColumn("year", F.year("day")).withColumnRenamed("p", "raw")
    return M.nested_publish(f, 1995).select("nation", "day", F.round("p", 6).alias("published"))


@query("global_view", with_ctes(["forecast"], """
  SELECT day, round(1 - product(1 - p), 6) AS p_any, round((1 - product(1 - p)) / product(1 - p) / (0.8 / 0.2), 4) AS ratio FROM forecast GROUP BY 1"""))
def global_view(spark, sf):
    g = M.global_view(B.forecast(spark, sf), 0.8, 0.08)
    return g.select("day", *rnd("p_any"), F.round("ratio", 4).alias("ratio"))


@query("market_blend", with_ctes(["nat"], """
  SELECT theatre, round(1 / (1 + exp(-sum(x * vol) / sum(vol))), 6) AS p_market FROM (
    SELECT theatre, vol, -0.76 + 0.90 * ln(q / (1 - q)) AS x FROM (
      SELECT *, least(greatest(CASE WHEN days > 30 THEN 1 - (1 - p) ** (30.0 / days) ELSE p END, 0.005), 0.99) AS q FROM (
        SELECT c_nationkey AS theatre, o_totalprice AS vol, (o_orderkey % 97 + 1) / 100.0 AS p, greatest(1, o_orderdate::DATE - DATE '1998-01-01') AS days
        FROM orders JOIN customer ON o_custkey = c_custkey) WHERE vol >= 50000 AND p > 0.005 AND p < 0.995)) GROUP BY 1"""))
def market_blend(spark, sf):
    """Orders read as markets: price is volume, the key sets the quote, the date is the deadline."""
    o = B.order_facts(spark, sf).select(F.col("nation").alias("theatre"), F.col("o_totalprice").alias("vol"),
                                        ((F.col("o_orderkey") % 97 + 1) / 100).alias("p"), F.col("day").alias("end"))
    return M.market_probability(o, F.lit("1998-01-01").cast("date")).select("theatre", *rnd("p_market"))


@query("rolling_origin_forecast")
def rolling_origin_forecast(spark, sf):
    """Penalised fits on earlier years, judged on each test year."""
    rows = model_rows(spark, sf)
    r = M.rolling(rows, OFFSETS, HIST, W, 3.0, test_years(rows))
    return r.select("theatre", "day", "y", "year", *rnd("raw", "base"))


@query("history_only_forecast")
def history_only_forecast(spark, sf):
    rows = model_rows(spark, sf)
    r = M.rolling(rows, OFFSETS, HIST, [], 3.0, test_years(rows))
    return r.select("theatre", "day", "y", "year", *rnd("raw", "base"))


@query("fitted_coefficients")
def fitted_coefficients(spark, sf):
    """One penalised fit on every judged row: column and coefficient."""
    t = M.fit(model_rows(spark, sf).where("lab"), OFFSETS, HIST, W, 3.0)
    return spark.createDataFrame([(k, float(v)) for k, v in t.items()], "term string, coefficient double")


@query("bootstrap_intervals")
def bootstrap_intervals(spark, sf):
    """Refits with theatre-years redrawn, and the band of the newest day's probability."""
    rows = model_rows(spark, sf)
    newest = rows.where(F.col("day") == rows.agg(F.max("day").alias("d")).scalar())
    thetas = M.bootstrap(rows.where("lab"), OFFSETS, HIST, W, 3.0, reps=40)
    parts = newest.select("theatre", F.explode(M.raw_probabilities(thetas)).alias("p"))
    return M.interval(parts, ["theatre"]).select("theatre", *rnd("lo", "hi"))


@query("penalty_choice")
def penalty_choice(spark, sf):
    """Out-of-sample Brier score of the published probability under each ridge of the families, and the one that is chosen."""
    rows = model_rows(spark, sf)
    return M.choose_lambda(rows, OFFSETS, HIST, W, test_years(rows)).select("lam", *rnd("brier"), "chosen")


def labelled(rows, spark, sf, kinds, name, horizon=30, after=30):
    """rows with y_, lab_ and history terms of the events of some kinds."""
    h = B.hits(spark, sf).where(F.col("kind").isin(list(kinds)))
    days = rows.select("nation", "day")
    lab = L.build(days, h, B.through(spark, sf), "nation", horizon, after).select("nation", "day", F.col("y").alias(f"y_{name}"), (~F.col("excl") & ~F.col("unk")).alias(f"lab_{name}"),
                                                                                     F.col("eid").alias(f"eid_{name}"))
    hist = L.history(days, h, "nation").select("nation", "day", *[F.col(c).alias(f"{c}_{name}") for c in HIST])
    return rows.join(lab, ["nation", "day"]).join(hist, ["nation", "day"])


@query("shadow_variants")
def shadow_variants(spark, sf):
    """The hidden models beside the published one: events of force only, no history terms, and waves seven days ahead. Out of sample, each judged
    on its own label: skill against the base rate, AUC, and the newest day's mean probability."""
    rows = labelled(model_rows(spark, sf), spark, sf, ("strike", "raid"), "armed")
    rows = labelled(rows, spark, sf, ("strike",), "wave", horizon=7, after=7)
    fam = {c: 3.0 for c in W}
    v = [M.Variant("published", tuple(HIST), fam), M.Variant("armed", tuple(f"{c}_armed" for c in HIST), fam, "y_armed", "lab_armed"),
         M.Variant("nohist", (), fam), M.Variant("wave", tuple(f"{c}_wave" for c in HIST), fam, "y_wave", "lab_wave")]
    years = test_years(rows)
    pub = stable(M.nested_publish(stable(M.rolling_many(rows, v, OFFSETS, years)), years[0], by=("variant",)))
    k = pub.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"),
                                   F.avg(F.pow(F.col("base") - F.col("y"), 2)).alias("_c"), F.max_by("p", F.struct("day", "theatre")).alias("newest"))
    k = k.withColumn("skill", 1 - F.col("brier") / F.col("_c")).drop("_c")
    return k.join(E.auc(pub, "p", "y", ["variant"]).select("variant", "auc"), "variant").select("variant", "n", "positives", *rnd("brier", "skill", "newest", "auc"))


@query("sub_theatre_offsets")
def sub_theatre_offsets(spark, sf):
    """One ridge-penalised offset per nation with the rest of the log-odds held fixed."""
    f = B.forecast(spark, sf).where("lab").select(F.col("nation").alias("theatre"), "y", "p")
    return M.sub_offset(f, S.logit(F.col("p"))).select("theatre", *rnd("u"))


@query("recalibrated_probability")
def recalibrated_probability(spark, sf):
    """Isotonic and two-parameter logistic maps fitted on the years before the last two, applied to those."""
    f = stable(B.forecast(spark, sf).where("lab").select("nation", "day", "p", "y"))
    train, test = before_and_after(f)
    c, b = M.platt(train)
    iso = M.isotonic(train, test)
    return iso.select("nation", "day", "p", F.round("q", 6).alias("isotonic"), F.round(S.sigmoid(c + b * S.logit(F.col("p"))), 6).alias("platt"))


@query("isotonic_recalibration", with_ctes(["forecast"], """
  SELECT t.nation, t.day, t.p, round(coalesce((SELECT min(s.q) FROM steps s WHERE s.p >= t.p), (SELECT max(q) FROM steps)), 6) AS isotonic
  FROM ok t WHERE day >= (SELECT d FROM cut)""", [
    ("ok", "SELECT nation, day, p, y FROM forecast WHERE lab"),
    ("cut", "SELECT make_date(list_sort(list(DISTINCT year(day)))[-2], 1, 1) AS d FROM ok"),
    ("cells", "SELECT p, row_number() OVER (ORDER BY p) AS i, sum(s) OVER (ORDER BY p) AS s, sum(n) OVER (ORDER BY p) AS n FROM (SELECT p, sum(y) AS s, count(*) AS n FROM ok WHERE day < (SELECT d FROM cut) GROUP BY 1)"),
    ("runs", "SELECT b.i AS a, c.i AS b, (c.s - coalesce(z.s, 0)) / (c.n - coalesce(z.n, 0)) AS m FROM cells b JOIN cells c ON c.i >= b.i LEFT JOIN cells z ON z.i = b.i - 1"),
    ("least", "SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM runs"),
    ("steps", "SELECT c.p, max(l.m) AS q FROM cells c JOIN least l ON l.i = c.i GROUP BY 1")]))
def isotonic_recalibration(spark, sf):
    """Rising step function of the years before the last two, applied to those; its SQL takes the largest over all starts of the least mean over all
    ends."""
    f = stable(B.forecast(spark, sf).where("lab").select("nation", "day", "p", "y"))
    return M.isotonic(*before_and_after(f)).select("nation", "day", "p", F.round("q", 6).alias("isotonic"))


@query("boosted_trees_candidate")
def boosted_trees_candidate(spark, sf):
    """150 trees of depth three, no leaf under 300 rows, never falling in a family's evidence; judged on the last two test years."""
    rows = model_rows(spark, sf).where("lab")
    g = M.boosted(*before_and_after(rows), W + HIST, rising=W)
    return g.select("theatre", "day", "y", *rnd("raw"))


@query("recency_weights", with_ctes(["forecast"], """
  SELECT nation, day, round(w / avg(w) OVER (), 6) AS weight FROM (SELECT nation, day, pow(0.5, ((SELECT max(day) FROM forecast) - day) / 730.0) AS w FROM forecast)"""))
def recency_weights(spark, sf):
    return M.normalised_recency(stable(B.forecast(spark, sf).select("nation", "day")), 730.0).select("nation", "day", *rnd("weight"))


@query("model_predictions", with_ctes(["points", "catalog", "daily", "hits", "nat"], """
  SELECT theatre, day, round(least(0.95, greatest(1 / (1 + exp(-(lb + 0.6 * (ln(raw / (1 - raw)) - lb)))), 0.5 * base)), 6) AS p, round(raw, 6) AS raw FROM (
    SELECT theatre, day, base, ln(base / (1 - base)) AS lb, 1 / (1 + exp(-(-2.5 + 0.1 * theatre + 0.5 * h1 + 0.4 * h3 - 0.3 * hs + s))) AS raw FROM (
      SELECT h.nation AS theatre, h.day, h1, h3, hs, coalesce(s, 0) AS s, 0.06 + 0.002 * h.nation AS base FROM hist h LEFT JOIN (
        SELECT nation, day, sum(e / 5 * CASE family WHEN 'ord_n' THEN 0.8 WHEN 'ship_n' THEN 0.3 ELSE 0.5 END) AS s FROM ev GROUP BY 1, 2) e USING (nation, day)))""",
       [*PANEL[:2], ("hist", """SELECT d.nation, d.day, least(count(h.day) FILTER (WHERE d.day - h.day <= 365), 3) / 3.0 AS h1, least(count(h.day) FILTER (WHERE d.day - h.day <= 1095), 5) / 5.0 AS h3,
          ln(1 + least(coalesce(d.day - max(h.day), 3650), 3650)) / ln(3651) AS hs FROM daily d LEFT JOIN hits h ON h.nation = d.nation AND h.day < d.day GROUP BY 1, 2""")]))
def model_predictions(spark, sf):
    """Serving: coefficients as tables joined to evidence, history and base rates."""
    hist = L.history(B.daily(spark, sf).select("nation", "day"), B.hits(spark, sf), "nation").withColumnRenamed("nation", "theatre")
    n = B.nations(spark, sf)
    theta = n.select(F.col("nation").alias("theatre"), (-2.5 + 0.1 * F.col("nation")).alias("intercept"), F.lit(0.5).alias("c1"), F.lit(0.4).alias("c2"), F.lit(-0.3).alias("c3"))
    fam = spark.createDataFrame([(f, {"ord_n": 0.8, "ship_n": 0.3}.get(f, 0.5), f == "ship_n") for f in FAMS], "family string, w double, is_global boolean")
    base = n.select(F.col("nation").alias("theatre"), (0.06 + 0.002 * F.col("nation")).alias("base"))
    return M.predict(evidence(spark, sf), hist, base, theta, fam, 0.6, 0.5).select("theatre", "day", *rnd("p", "raw"))


@query("activity_index", with_ctes(["daily"], """
  SELECT theatre, round(100 * sum(CASE WHEN is_on THEN w ELSE 0 END) / sum(w), 1) AS "index", sum(CASE WHEN is_on THEN w ELSE 0 END) >= 0.049 - 1e-9 AS active FROM (
    SELECT nation AS theatre, f.family, w, CASE f.m WHEN 0 THEN n >= 2 WHEN 1 THEN urgent >= 1 WHEN 2 THEN NULL ELSE n >= f.m END AS is_on
    FROM (SELECT nation, sum(n) AS n, sum(urgent) AS urgent FROM daily WHERE day > (SELECT max(day) FROM daily) - 7 GROUP BY 1),
         (VALUES ('adsb_fighter', 2.51, 0), ('wiki', 0.816, 1), ('gdelt_accel', 0.628, 2), ('tells', 0.375, 3), ('adsb_tanker', 0.351, 4), ('base', 0.049, 5)) f(family, w, m)) GROUP BY 1"""))
def activity_index(spark, sf):
    """Which evidence families were on in the last week, by weight; a family with no data is missing, not quiet."""
    d = B.daily(spark, sf).where(F.col("day") > F.date_sub(B.bounds(spark, sf).select("hi").scalar(), 7))
    d = d.groupBy(F.col("nation").alias("theatre")).agg(F.sum("n").alias("n"), F.sum("urgent").alias("u"))
    on = [F.col("n") >= 2, F.col("u") >= 1, F.lit(None).cast("boolean"), F.col("n") >= 3, F.col("n") >= 4, F.col("n") >= 5]
    flags = d.select("theatre", F.inline(F.array(*[F.struct(F.lit(f).alias("family"), o.alias("on")) for f, o in zip(C.ACTIVITY, on)])))
    w = spark.createDataFrame(list(C.ACTIVITY.items()), "family string, weight double")
    return C.activity_index(flags, w, C.ACTIVITY["base"]).select("theatre", "index", "active")


@query("class_package_index", with_ctes([], """
  SELECT c_nationkey AS nation, o_orderdate::DATE AS day, count(*) * count(DISTINCT o_orderstatus) AS "index" FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""))
def class_package_index(spark, sf):
    """Sum over classes times the number of classes present."""
    c = B.order_facts(spark, sf).groupBy("nation", "day", "o_orderstatus").agg(F.count(F.lit(1)).alias("value"))
    return C.strike_package(c, ["nation", "day"], "o_orderstatus")


@query("duplicate_family_pairs", with_ctes(["points", "catalog", "nat"], """
  SELECT a.family AS a, b.family AS b, round(corr(a.e, b.e), 6) AS r FROM ev a JOIN ev b ON a.nation = b.nation AND a.day = b.day AND a.family < b.family GROUP BY 1, 2 HAVING count(*) >= 200""", PANEL[:2]))
def duplicate_family_pairs(spark, sf):
    """Correlation of family evidence over all theatre-days, one wide pass for the fixed family list."""
    w = P.wide(evidence(spark, sf), FAMS)
    pairs = [(a, b) for i, a in enumerate(sorted(FAMS)) for b in sorted(FAMS)[i + 1:]]
    agg = w.agg(*[S.pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return agg.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"`{a}|{b}`"), 6).alias("r")) for a, b in pairs])))


@query("merged_families", with_ctes(["points", "catalog", "nat"], """
  SELECT t.a || '+' || t.b AS family, round(t.r, 6) AS r, count(*) AS n, round(avg(m), 6) AS mean_e FROM (WITH RECURSIVE pick AS (
      SELECT NULL::VARCHAR AS a, NULL::VARCHAR AS b, 9.0::DOUBLE AS r, []::VARCHAR[] AS used, 0 AS k
      UNION ALL SELECT * FROM (SELECT p.a, p.b, p.r, list_concat(k.used, [p.a, p.b]), k.k + 1 FROM pick k JOIN prs p ON NOT list_contains(k.used, p.a) AND NOT list_contains(k.used, p.b)
        ORDER BY p.r DESC, p.a DESC, p.b DESC LIMIT 1)) SELECT a, b, r FROM pick WHERE a IS NOT NULL) t
  JOIN (SELECT nation, day, family, e FROM ev) x ON TRUE JOIN (SELECT nation AS n2, day AS d2, family AS f2, e AS e2 FROM ev) z
    ON x.nation = n2 AND x.day = d2 AND x.family = t.a AND f2 = t.b, LATERAL (SELECT (e + e2) / 2 AS m) GROUP BY 1, 2""",
       [*PANEL[:2], ("prs", """SELECT a.family AS a, b.family AS b, round(corr(a.e, b.e), 6) AS r FROM ev a JOIN ev b ON a.nation = b.nation AND a.day = b.day AND a.family < b.family
          GROUP BY 1, 2 HAVING count(*) >= 200 AND corr(a.e, b.e) > 0.01""")]))
def merged_families(spark, sf):
    """Families whose evidence moves together, averaged in pairs, strongest pair first and each used once."""
    from tocsin.operators import greedy
    pairs = duplicate_family_pairs(spark, sf).where("r > 0.01")
    t = stable(greedy.mutual_best(stable(pairs)))
    ev = stable(evidence(spark, sf))
    side = lambda c, e: ev.select("theatre", "day", F.col("family").alias(c), F.col("e").alias(e))      # noqa: E731
    j = t.join(side("a", "ea"), "a").join(side("b", "eb"), ["theatre", "day", "b"])
    return j.groupBy(F.concat_ws("+", "a", "b").alias("family"), "r").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("ea") + F.col("eb")) / 2), 6).alias("mean_e"))
