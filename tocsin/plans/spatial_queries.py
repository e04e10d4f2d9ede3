"""Queries on positions: boxes, nearest sites, heat detections, scenes, flights and vessels, derived from the event stream."""
from pyspark.sql import Window, functions as F

from tocsin.functions import geo
from tocsin.operators import greedy, histograms as H, spatial as G, trajectory as T
from tocsin.operators.lineage import stable
from tocsin.plans import bindings as B
from tocsin.plans.bindings import with_ctes
from tocsin.plans.registry import query
from tocsin.plans.series_queries import rnd

BOXES = [("north", 1, 30.4, 31.2, 39.9, 40.8), ("south", 2, 29.9, 30.5, 39.9, 40.4), ("east", 3, 30.0, 31.0, 40.3, 40.8)]


def boxes(spark):
    """A fixed list of a few rows, so it is broadcast."""
    return F.broadcast(spark.createDataFrame(BOXES, "box string, priority int, lat_min double, lat_max double, lon_min double, lon_max double"))


def detections(spark, sf):
    """Heat detections: place from the user, a small offset and an archive year from the event id."""
    e = B.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("det_id"), ((30000 + F.col("user_id") % 20 * 50 + F.col("event_id") % 7 * 3) / 1000).alias("lat"),
                    ((40000 + F.col("user_id") % 13 * 50 + F.col("event_id") % 5 * 3) / 1000).alias("lon"),
                    F.date_sub(F.to_date("ts"), (F.col("event_id") % 10 * 365).cast("int")).alias("day"), F.col("value").alias("frp"),
                    (F.col("event_id") % 23).cast("int").alias("type"), (F.hour("ts") < 6).alias("night"),
                    (F.floor(F.hour("ts") / 6)).cast("int").alias("quarter"), "ts", "user_id", "event_type")


SITES_SQL = ("sites", "SELECT s_suppkey AS site_id, (30000 + s_suppkey % 20 * 50 + 4) / 1000.0::DOUBLE AS lat, (40000 + s_suppkey % 13 * 50 + 4) / 1000.0::DOUBLE AS lon, CASE WHEN s_suppkey % 3 = 0 THEN 'industrial' ELSE 'sensitive' END AS kind FROM supplier")


def sites(spark, sf):
    s = B.table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("site_id"), ((30000 + F.col("s_suppkey") % 20 * 50 + 4) / 1000).alias("lat"),
                    ((40000 + F.col("s_suppkey") % 13 * 50 + 4) / 1000).alias("lon"),
                    F.when(F.col("s_suppkey") % 3 == 0, "industrial").otherwise("sensitive").alias("kind"))


DET = ("det", """SELECT event_id AS det_id, (30000 + user_id % 20 * 50 + event_id % 7 * 3) / 1000.0::DOUBLE AS lat, (40000 + user_id % 13 * 50 + event_id % 5 * 3) / 1000.0::DOUBLE AS lon,
   ts::DATE - (event_id % 10 * 365)::INT AS day, value AS frp, (event_id % 23)::INT AS type, hour(ts) < 6 AS night, (hour(ts) // 6)::INT AS quarter, ts, user_id, event_type FROM events""")
BOX = ("boxes", "SELECT * FROM (VALUES " + ", ".join(f"('{b}', {p}, {a}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE)" for b, p, a, c, d, e in BOXES) + ") t(box, priority, la0, la1, lo0, lo1)")
KM = "111.0 * sqrt(({a}.lat - {b}.lat) ** 2 + (({b}.lon - {a}.lon) * cos(radians(({a}.lat + {b}.lat) / 2))) ** 2)"


@query("points_in_boxes", with_ctes([], "SELECT box, count(*) AS n, count(DISTINCT user_id) AS users FROM det JOIN boxes ON lat BETWEEN la0 AND la1 AND lon BETWEEN lo0 AND lo1 GROUP BY 1", [DET, BOX]))
def points_in_boxes(spark, sf):
    return G.in_boxes(detections(spark, sf), boxes(spark)).groupBy("box").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("first_matching_box", with_ctes([], """
  SELECT det_id, arg_min(box, priority) AS box FROM det LEFT JOIN boxes ON lat BETWEEN la0 AND la1 AND lon BETWEEN lo0 AND lo1 GROUP BY 1""", [DET, BOX]))
def first_matching_box(spark, sf):
    return G.first_box(detections(spark, sf), BOXES).select("det_id", "box")


@query("box_day_quality", with_ctes([], """
  SELECT box, day, count(*) AS n, round(avg(frp) FILTER (WHERE type < 18), 6) AS good_mean, round(avg((type < 18)::INT), 6) AS good_share
  FROM det JOIN boxes ON lat BETWEEN la0 AND la1 AND lon BETWEEN lo0 AND lo1 GROUP BY 1, 2""", [DET, BOX]))
def box_day_quality(spark, sf):
    """Mean and share of the cells with a good flag, by place box and day."""
    return G.box_quality(detections(spark, sf), boxes(spark), F.col("type") < 18, "frp").select("box", "day", "n", *rnd("good_mean", "good_share"))


@query("nearest_site", with_ctes([], f"""
  SELECT d.det_id, arg_min(s.site_id, km * 1e6 + s.site_id * 1e-6) AS site_id, round(min(km), 6) AS km FROM det d LEFT JOIN (
    SELECT d.det_id, s.site_id, {KM.format(a='d', b='s')} AS km FROM det d JOIN sites s ON abs(d.lat - s.lat) < 0.05 AND abs(d.lon - s.lon) < 0.06) s ON s.det_id = d.det_id AND s.km <= 2 GROUP BY 1""", [DET, SITES_SQL]))
def nearest_site(spark, sf):
    return G.nearest(detections(spark, sf), sites(spark, sf), "det_id", 2.0, 0.05).select("det_id", "site_id", *rnd("km"))


@query("same_pass_neighbours", with_ctes([], f"""
  SELECT a.det_id, sum(b.k)::BIGINT AS near_n FROM det a JOIN (SELECT day, quarter, lat, lon, count(*) AS k FROM det GROUP BY 1, 2, 3, 4) b
  ON a.day = b.day AND a.quarter = b.quarter AND abs(a.lat - b.lat) < 0.03 AND {KM.format(a='a', b='b')} <= 2 GROUP BY 1""", [DET]))
def same_pass_neighbours(spark, sf):
    d = detections(spark, sf).withColumn("pass_id", F.concat_ws("-", "day", "quarter"))
    return G.same_pass_counts(d, "det_id").select("det_id", "near_n")


@query("listed_nearby", with_ctes([], f"""
  SELECT det_id, EXISTS (SELECT 1 FROM lst l WHERE abs(l.day - d.day) <= 1 AND abs(l.lat - d.lat) < 0.02 AND {KM.format(a='d', b='l')} <= 1) AS listed FROM det d""",
       [DET, ("lst", "SELECT lat, lon, day FROM det WHERE frp >= 200")]))
def listed_nearby(spark, sf):
    d = detections(spark, sf)
    return G.near_listed(d, d.where("frp >= 200").select("lat", "lon", "day"), "det_id").select("det_id", "listed")


CELL = "SELECT *, round_even(lat / 0.01, 0)::INT AS i, round_even(lon / 0.01, 0)::INT AS j, year(day) AS yr FROM det"


@query("archive_cells", with_ctes([], """
  SELECT i, j, years, year_mask, round(n95, 6) AS n95, last, round(frp95, 6) AS frp95, frpmax, t1, t2, t3 FROM
    (SELECT i, j, count(*) AS years, bit_or(1 << (yr - 2012)::INT)::INT AS year_mask FROM (SELECT DISTINCT i, j, yr FROM c) GROUP BY 1, 2) JOIN
    (SELECT i, j, quantile_cont(n, 0.95) AS n95, max(day) AS last FROM (SELECT i, j, day, count(*) AS n FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (i, j) JOIN
    (SELECT i, j, quantile_cont(frp, 0.95) AS frp95, max(frp) AS frpmax, count(*) FILTER (WHERE type = 1) AS t1, count(*) FILTER (WHERE type = 2) AS t2, count(*) FILTER (WHERE type = 3) AS t3 FROM c GROUP BY 1, 2) USING (i, j)""",
       [DET, ("c", CELL)]))
def archive_cells(spark, sf):
    c = G.archive_cells(detections(spark, sf))
    return c.select("i", "j", F.size("days").cast("long").alias("years"), "year_mask", *rnd("n95"), "last", *rnd("frp95"), "frpmax", "t1", "t2", "t3")


@query("archive_months", with_ctes([], """
  SELECT ci, cj, yr, bit_or(m)::INT AS months FROM (
    SELECT i, j, yr, min(round_even(lat / 0.1, 0)::INT * 100000 + round_even(lon / 0.1, 0)::INT) AS k, k // 100000 AS ci, k % 100000 AS cj, bit_or(1 << (month(day) - 1)::INT) AS m
    FROM c GROUP BY 1, 2, 3 HAVING count(DISTINCT day) < 60 AND NOT bool_or(type IN (1, 2, 3))) GROUP BY 1, 2, 3""", [DET, ("c", CELL)]))
def archive_months(spark, sf):
    return G.archive_months(detections(spark, sf)).select("ci", "cj", "yr", "months")


def classified(spark, sf):
    d = detections(spark, sf).withColumn("pass_id", F.concat_ws("-", "day", "quarter"))
    d = stable(G.same_pass_counts(d, "det_id").drop("pass_id"))
    f = G.detection_features(d, stable(G.archive_cells(d)), stable(G.archive_months(d)), stable(sites(spark, sf)))
    return G.classify(f).withColumn("box", F.lit("all"))


@query("heat_detection_classes")
def heat_detection_classes(spark, sf):
    """Every detection classed against the archive of earlier years, listed sites and its own pass."""
    return classified(spark, sf).select("det_id", "day", "cls", "score", "spot_years", "usual_days")


@query("daily_class_counts")
def daily_class_counts(spark, sf):
    """Classes per day over the archive's calendar, zero where a class was not seen."""
    c = stable(classified(spark, sf).groupBy("day").agg(*[F.count_if(F.col("cls") == k).alias(k) for k in ("anom", "hot", "unex", "seas", "ind", "volc", "off")]))
    days = c.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.join(c, "day", "left").na.fill(0)


EXPLAINED = ("seas", "ind", "volc", "off")


@query("detection_clusters")
def detection_clusters(spark, sf):
    """Greedy clusters of unexplained detections by score, same day, within two kilometres."""
    d = classified(spark, sf).where(~F.col("cls").isin(*EXPLAINED))
    c = G.cluster_day(stable(d), "det_id")
    return c.groupBy("cid").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("frp").alias("max_frp"), F.count(F.lit(1)).alias("n"))


@query("merged_fuel_sites")
def merged_fuel_sites(spark, sf):
    """Listed points within 400 m of a site's running mean become one site; the newest place of every event's user, tagged by its size."""
    d = detections(spark, sf).groupBy("lat", "lon").agg(F.min("det_id").alias("id"), F.max("frp").alias("frp"))
    return greedy.running_sites(d.withColumn("fuel", F.col("frp") > 250)).select("site", *rnd("lat", "lon"), "n", "fuel")


HIST_BINS = "[" + ", ".join(f"count(*) FILTER (WHERE {'TRUE' if i == 0 else f'frp >= {e}'}{'' if i + 1 == len(H.POWER_EDGES) else f' AND frp < {H.POWER_EDGES[i + 1]}'})" for i, e in enumerate(H.POWER_EDGES)) + "]"


@query("power_quantiles", with_ctes([], f"""
  SELECT ci, cj, n, round(max(v) FILTER (WHERE q = 0.5), 6) AS p50, round(max(v) FILTER (WHERE q = 0.95), 6) AS p95 FROM (
    SELECT ci, cj, n, q, arg_min(lo + (hi - lo) * (q * n - (upto - c)) / c, i) AS v FROM (
      SELECT *, sum(c) OVER (PARTITION BY ci, cj, q ORDER BY i) AS upto FROM (
        SELECT ci, cj, list_sum(h) AS n, unnest(h) AS c, generate_subscripts(h, 1) AS i, unnest({list(map(float, H.POWER_EDGES))}) AS lo,
               unnest({list(map(float, (*H.POWER_EDGES[1:], H.POWER_EDGES[-1] * 2)))}) AS hi FROM hists), (VALUES (0.5), (0.95)) t(q)) WHERE upto >= q * n AND c > 0 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""",
       [DET, ("hists", f"SELECT floor(lat / 0.05)::INT AS ci, floor(lon / 0.05)::INT AS cj, {HIST_BINS} AS h FROM det GROUP BY 1, 2")]))
def power_quantiles(spark, sf):
    """Median and 95th percentile of radiant power per cell from fixed bins, each year binned on its own and the years added up."""
    d = detections(spark, sf).withColumn("ci", geo.cell(F.col("lat"), 0.05)).withColumn("cj", geo.cell(F.col("lon"), 0.05))
    years = H.by_edges(d.withColumn("year", F.year("day")), ["ci", "cj", "year"], "frp")
    h = H.merged(years, ["ci", "cj"], len(H.POWER_EDGES))
    return h.select("ci", "cj", F.aggregate("hist", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"), F.round(H.quantile(F.col("hist"), 0.5), 6).alias("p50"),
                    F.round(H.quantile(F.col("hist"), 0.95), 6).alias("p95"))


@query("count_quantiles", with_ctes([], """
  SELECT ci, cj, max(k) FILTER (WHERE upto - c < 0.5 * n)::DOUBLE AS p50, max(k) FILTER (WHERE upto - c < 0.95 * n)::DOUBLE AS p95 FROM (
    SELECT ci, cj, k, count(*) AS c, sum(count(*)) OVER (PARTITION BY ci, cj ORDER BY k) AS upto, sum(count(*)) OVER (PARTITION BY ci, cj) AS n FROM (
      SELECT ci, cj, least(count(*), 20) AS k FROM (SELECT floor(lat / 0.05)::INT AS ci, floor(lon / 0.05)::INT AS cj, day FROM det) GROUP BY ci, cj, day) GROUP BY 1, 2, 3) GROUP BY 1, 2""", [DET]))
def count_quantiles(spark, sf):
    """Median and 95th percentile of detections per burning day and cell, from counts of counts up to 20."""
    d = detections(spark, sf).groupBy(geo.cell(F.col("lat"), 0.05).alias("ci"), geo.cell(F.col("lon"), 0.05).alias("cj"), "day").agg(F.count(F.lit(1)).alias("k"))
    h = H.by_count(d, ["ci", "cj"], "k", 20)
    return h.select("ci", "cj", H.count_quantile(F.col("hist"), 0.5).alias("p50"), H.count_quantile(F.col("hist"), 0.95).alias("p95"))


@query("cluster_summary", with_ctes([], """
  SELECT user_id % 20 AS cid, day, min(ts) AS first_ts, max(ts) AS last_ts, max(frp) AS max_frp, arg_max(event_type, frp * 1e6 + det_id * 1e-6) AS best FROM det GROUP BY 1, 2""", [DET]))
def cluster_summary(spark, sf):
    d = detections(spark, sf)
    return d.groupBy((F.col("user_id") % 20).alias("cid"), "day").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("frp").alias("max_frp"),
                                                                      F.max_by("event_type", F.struct("frp", "det_id")).alias("best"))


@query("merged_sites", with_ctes([], """
  SELECT floor(lat / 0.01)::INT AS ci, floor(lon / 0.01)::INT AS cj, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon, count(*) AS n, bool_or(frp > 250) AS fuel FROM det
  GROUP BY 1, 2 HAVING count(*) >= 5 OR bool_or(frp > 250)""", [DET]))
def merged_sites(spark, sf):
    return G.merge_points(detections(spark, sf).withColumn("fuel", F.col("frp") > 250)).select("ci", "cj", *rnd("lat", "lon", digits=9), "n", "fuel")


@query("routine_cells", with_ctes([], """
  SELECT d.det_id, n.dates >= 3 AS routine FROM (SELECT *, floor(lat / 0.01)::INT AS ci, floor(lon / 0.01)::INT AS cj FROM det) d JOIN (
    SELECT ci + a AS ci, cj + b AS cj, count(DISTINCT day) AS dates FROM (SELECT DISTINCT floor(lat / 0.01)::INT AS ci, floor(lon / 0.01)::INT AS cj, day FROM det), (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b) GROUP BY 1, 2) n
  USING (ci, cj)""", [DET]))
def routine_cells(spark, sf):
    return G.routine_cells(detections(spark, sf)).select("det_id", "routine")


@query("review_overlay", with_ctes([], """
  SELECT det_id, CASE WHEN verdict = 'scar' AND lc = 'cropland' THEN 'seas' WHEN lc = 'water' AND verdict IN ('none', 'unclear') THEN 'off' WHEN verdict = 'scar' AND cls = 'unex' AND s2 >= 60 THEN 'anom'
    WHEN verdict = 'none' AND cls = 'anom' AND s2 < 60 THEN 'unex' ELSE cls END AS cls2, s2::INT AS score2 FROM (
    SELECT *, CASE WHEN verdict = 'scar' AND lc = 'cropland' THEN 15 WHEN verdict = 'scar' THEN least(score + 10, 100) WHEN lc = 'water' AND verdict IN ('none', 'unclear') THEN 5 WHEN verdict = 'none' THEN greatest(score - 10, 0) ELSE score END AS s2 FROM (
      SELECT det_id, CASE WHEN frp >= 60 THEN 'anom' ELSE 'unex' END AS cls, least(100, floor(frp))::INT AS score, ['scar', 'none', 'unclear', NULL][(user_id % 4 + 1)::INT] AS verdict, ['cropland', 'water', 'built'][(user_id % 3 + 1)::INT] AS lc FROM det))""", [DET]))
def review_overlay(spark, sf):
    d = detections(spark, sf)
    v = d.select(F.col("user_id").alias("cid")).distinct().select("cid", F.get(F.array(F.lit("scar"), F.lit("none"), F.lit("unclear"), F.lit(None)), (F.col("cid") % 4).cast("int")).alias("verdict"),
                                                                  F.get(F.array(F.lit("cropland"), F.lit("water"), F.lit("built")), (F.col("cid") % 3).cast("int")).alias("lc"))
    d = d.select("det_id", F.col("user_id").alias("cid"), F.when(F.col("frp") >= 60, "anom").otherwise("unex").alias("cls"), F.least(F.lit(100), F.floor("frp")).cast("int").alias("score"))
    return G.review_overlay(d, v).select("det_id", "cls2", F.col("score2").cast("int").alias("score2"))


# ------------------------------------------------------------------ scenes and site states
SCENES = ("scenes", "SELECT user_id % 20 AS site, ts::DATE AS day, count(*) AS value FROM events GROUP BY 1, 2")
SCENE_Z = ("sz", """SELECT site, day, value, CASE WHEN len(p) >= 8 THEN (value - med) / greatest(1.4826 * mad, 0.05 * abs(med), 1.0) END AS z,
   CASE WHEN len(p) >= 8 THEN list_sort(p)[least(len(p), floor(0.5 * len(p))::INT + 1)] END AS usual, CASE WHEN len(p) >= 8 THEN list_sort(p)[least(len(p), floor(0.1 * len(p))::INT + 1)] END AS low,
   CASE WHEN len(p) >= 8 THEN list_sort(p)[least(len(p), floor(0.9 * len(p))::INT + 1)] END AS high FROM (
     SELECT *, list_aggregate(list_transform(p, lambda x: abs(x - med)), 'median') AS mad FROM (SELECT *, list_aggregate(p, 'median') AS med FROM (
       SELECT site, day, value, list(value::DOUBLE) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS p FROM scenes)))""")


def scenes(spark, sf):
    return B.table(spark, sf, "events").groupBy((F.col("user_id") % 20).alias("site"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("value"))


@query("scene_scores", with_ctes([], "SELECT site, day, value, round(z, 6) AS z, usual, low, high FROM sz", [SCENES, SCENE_Z]))
def scene_scores(spark, sf):
    return G.scene_z(scenes(spark, sf), ["site"]).select("site", "day", "value", *rnd("z"), "usual", "low", "high")


STATES = ("st", """SELECT site, day, z, CASE WHEN day - d0 <= 7 AND z0 <= -1 AND z <= -1 THEN 'out' WHEN day - d0 <= 7 AND z0 >= 1 AND z >= 1 THEN 'in' WHEN abs(z) >= 1 THEN 'changed' ELSE 'normal' END AS state FROM (
   SELECT *, lag(z) OVER (PARTITION BY site ORDER BY day) AS z0, lag(day) OVER (PARTITION BY site ORDER BY day) AS d0 FROM sz WHERE z IS NOT NULL)""")


def states(spark, sf):
    return G.site_state(G.scene_z(scenes(spark, sf), ["site"]), ["site"], at=1.0)


@query("site_states", with_ctes([], "SELECT site, day, state FROM st", [SCENES, SCENE_Z, STATES]))
def site_states(spark, sf):
    return states(spark, sf).select("site", "day", "state")


@query("theatre_site_counts", with_ctes([], """
  SELECT t.theatre, st.day, count(*) FILTER (WHERE state = 'out') AS n_out, count(*) FILTER (WHERE state = 'in') AS n_in FROM (
    SELECT site, 'a' || site % 4 AS theatre FROM (SELECT DISTINCT site FROM scenes) UNION ALL SELECT site, 'b' || site % 3 FROM (SELECT DISTINCT site FROM scenes)) t JOIN st USING (site) GROUP BY 1, 2""", [SCENES, SCENE_Z, STATES]))
def theatre_site_counts(spark, sf):
    s = states(spark, sf)
    t = scenes(spark, sf).select("site").distinct().withColumn("theatres", F.array(F.concat(F.lit("a"), F.col("site") % 4), F.concat(F.lit("b"), F.col("site") % 3)))
    return G.theatre_state_counts(s, t)


@query("site_state_today", with_ctes([], """
  SELECT s.site, CASE WHEN max(st.day) IS NULL OR DATE '2024-02-05' - max(st.day) > 10 THEN 'nodata' ELSE arg_max(state, st.day) END AS state FROM (SELECT DISTINCT site FROM scenes) s LEFT JOIN st USING (site) GROUP BY 1""", [SCENES, SCENE_Z, STATES]))
def site_state_today(spark, sf):
    asks = scenes(spark, sf).select("site").distinct().withColumn("day", F.lit("2024-02-05").cast("date"))
    return G.state_on(states(spark, sf), asks).select("site", "state")


OBJ = ("obj", "SELECT DISTINCT user_id % 20 AS site, day(ts)::INT AS seq, (event_id * 7 % 60)::INT AS \"row\", (event_id * 11 % 60)::INT AS col FROM events")


@query("new_and_gone_objects", with_ctes([], """
  SELECT site, seq, "row", col, 'new' AS change FROM obj a WHERE NOT EXISTS (SELECT 1 FROM obj b WHERE b.site = a.site AND b.seq = a.seq - 1 AND (a."row" - b."row") ** 2 + (a.col - b.col) ** 2 <= 9)
  UNION ALL SELECT site, seq, "row", col, 'gone' FROM obj a WHERE NOT EXISTS (SELECT 1 FROM obj b WHERE b.site = a.site AND b.seq = a.seq + 1 AND (a."row" - b."row") ** 2 + (a.col - b.col) ** 2 <= 9)""", [OBJ]))
def new_and_gone_objects(spark, sf):
    e = B.table(spark, sf, "events")
    o = e.select((F.col("user_id") % 20).alias("site"), F.dayofmonth("ts").alias("seq"), (F.col("event_id") * 7 % 60).cast("int").alias("row"), (F.col("event_id") * 11 % 60).cast("int").alias("col")).distinct()
    return G.unmatched_objects(stable(o)).select("site", "seq", "row", "col", "change")


@query("bright_object_counts")
def bright_object_counts(spark, sf):
    """Bright area and groups of touching bright pixels per scene, pixels derived from the event stream."""
    e = B.table(spark, sf, "events")
    px = e.select(F.dayofmonth("ts").alias("scene"), (F.col("event_id") * 7 % 40).cast("int").alias("row"), (F.col("event_id") * 11 % 40).cast("int").alias("col"), F.col("value").alias("db"))
    px = px.groupBy("scene", "row", "col").agg(F.max("db").alias("db"))
    return G.blob_counts(stable(px), cut=30.0)


@query("burn_area", with_ctes([], """
  SELECT a.site, round(count(*) FILTER (WHERE (a.n - a.s) / (a.n + a.s) - (b.n - b.s) / (b.n + b.s) > 0.27) * 0.04, 6) AS burn_ha FROM px a JOIN px b ON a.site = b.site AND a.cell = b.cell AND a.half = 0 AND b.half = 1 GROUP BY 1""",
       [("px", "SELECT user_id % 20 AS site, event_id % 97 AS cell, (day(ts) > 15)::INT AS half, max(value) + 1 AS n, min(value) + 1 AS s FROM events GROUP BY 1, 2, 3")]))
def burn_area(spark, sf):
    e = B.table(spark, sf, "events")
    p = e.groupBy((F.col("user_id") % 20).alias("site"), (F.col("event_id") % 97).alias("row"), F.lit(0).alias("col"), (F.dayofmonth("ts") > 15).alias("half")).agg(
        (F.max("value") + 1).alias("nir"), (F.min("value") + 1).alias("swir"))
    return G.burn_area(p.where("not half"), p.where("half")).select("site", *rnd("burn_ha"))


# ------------------------------------------------------------------ tracks
FIX = ("fix", """SELECT user_id AS vessel, ts, event_id, ['cargo', 'tanker', 'other'][(user_id % 3 + 1)::INT] AS cls, (30000 + event_id * 37 % 1000) / 1000.0::DOUBLE AS lat, (40000 + event_id * 53 % 1000) / 1000.0::DOUBLE AS lon, value * 30 AS alt FROM events""")


def fixes(spark, sf):
    e = B.table(spark, sf, "events")
    return e.select(F.col("user_id").alias("vessel"), "ts", "event_id", F.get(F.array(F.lit("cargo"), F.lit("tanker"), F.lit("other")), (F.col("user_id") % 3).cast("int")).alias("cls"),
                    ((30000 + F.col("event_id") * 37 % 1000) / 1000).alias("lat"), ((40000 + F.col("event_id") * 53 % 1000) / 1000).alias("lon"), (F.col("value") * 30).alias("alt"))


@query("distance_and_bearing", with_ctes([], """
  SELECT event_id, round(2 * 6371 * asin(sqrt(sin(radians(lat - 30) / 2) ** 2 + cos(radians(30)) * cos(radians(lat)) * sin(radians(lon - 40.5) / 2) ** 2)), 6) AS km,
         round(2 * 3440.065 * asin(sqrt(sin(radians(lat - 30) / 2) ** 2 + cos(radians(30)) * cos(radians(lat)) * sin(radians(lon - 40.5) / 2) ** 2)), 6) AS nm,
         round((degrees(atan2(sin(radians(lon - 40.5)) * cos(radians(lat)), cos(radians(30)) * sin(radians(lat)) - sin(radians(30)) * cos(radians(lat)) * cos(radians(lon - 40.5)))) + 360) % 360, 6) AS deg FROM fix""", [FIX]))
def distance_and_bearing(spark, sf):
    a = (F.lit(30.0), F.lit(40.5), F.col("lat"), F.col("lon"))
    return fixes(spark, sf).select("event_id", F.round(geo.haversine(*a), 6).alias("km"), F.round(geo.haversine(*a, radius=geo.EARTH_NM), 6).alias("nm"), F.round(geo.bearing(*a), 6).alias("deg"))


@query("grid_cells", with_ctes([], """
  SELECT det_id, round_even(lat / 0.01, 0)::INT AS fi, round_even(lat / 0.1, 0)::INT AS ci, floor(lat / 0.02)::INT AS b, floor(lat)::INT AS tile, (1 << (month(day) - 1)::INT)::INT AS bit FROM det""", [DET]))
def grid_cells(spark, sf):
    return detections(spark, sf).select("det_id", geo.fine_cell(F.col("lat")).alias("fi"), geo.fine_cell(F.col("lat"), 0.1).alias("ci"), geo.cell(F.col("lat"), 0.02).alias("b"),
                                        geo.cell(F.col("lat"), 1.0).alias("tile"), geo.month_bit("day").alias("bit"))


GATES = [("g1", 30.0, 40.5, 31.0, 40.5, "west", "east"), ("g2", 30.5, 40.0, 30.5, 41.0, "north", "south")]


@query("gate_crossings", with_ctes([], """
  SELECT DISTINCT vessel, gate, day, dir FROM (
    SELECT vessel, gate, ts::DATE AS day, (o2 - o1) * (pla - a1) - (a2 - a1) * (plo - o1) AS s1, (o2 - o1) * (lat - a1) - (a2 - a1) * (lon - o1) AS s2,
      111.0 * sqrt((lat - 30.5) ** 2 + ((lon - 40.5) * cos(radians((lat + 30.5) / 2))) ** 2) AS k2,
      111.0 * sqrt((pla - 30.5) ** 2 + ((plo - 40.5) * cos(radians((pla + 30.5) / 2))) ** 2) AS k1,
      CASE WHEN gate = 'g1' THEN CASE WHEN lon < 40.5 THEN 'west' ELSE 'east' END WHEN lat > 30.5 THEN 'north' ELSE 'south' END AS dir
    FROM (SELECT *, lag(lat) OVER w AS pla, lag(lon) OVER w AS plo, lag(ts) OVER w AS pt FROM fix WINDOW w AS (PARTITION BY vessel ORDER BY ts)), (VALUES ('g1', 30.0, 40.5, 31.0, 40.5), ('g2', 30.5, 40.0, 30.5, 41.0)) g(gate, a1, o1, a2, o2)
    WHERE date_diff('microsecond', pt, ts) < 86401000000) WHERE s1 * s2 < 0 AND k1 <= 30 AND k2 <= 30""", [FIX]))
def gate_crossings(spark, sf):
    return T.crossings(fixes(spark, sf), GATES, max_gap_s=86400).select("vessel", "gate", "day", "dir")


@query("vessel_presence", with_ctes([], "SELECT box, cls, ts::DATE AS day, count(DISTINCT vessel) AS vessels FROM fix JOIN boxes ON lat BETWEEN la0 AND la1 AND lon BETWEEN lo0 AND lo1 GROUP BY 1, 2, 3", [FIX, BOX]))
def vessel_presence(spark, sf):
    return T.presence(fixes(spark, sf), boxes(spark))


def trace(spark, sf):
    """Traces: one aircraft per user; low points sit near the airport of their cell; every eighth point is on the ground."""
    f = fixes(spark, sf)
    sec = F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return f.select(F.col("vessel").alias("icao"), sec.alias("t"), "ts", "event_id", "lat", "lon", "alt", (F.col("event_id") % 8 == 0).alias("on_ground"),
                    F.concat(F.lit("ABC"), (F.col("vessel") % 5).cast("string")).alias("call"), F.concat(F.lit("P"), F.floor(F.col("lat") * 4) % 7).alias("near"),
                    (F.col("alt") < 3000).alias("low"))


LEGS = [("pts", """SELECT vessel AS icao, date_diff('second', TIMESTAMP '2024-01-01', ts) AS t, event_id % 8 = 0 AS g, 'ABC' || (vessel % 5) AS call, 'P' || (floor(lat * 4)::BIGINT % 7) AS near, alt < 3000 AS low FROM fix"""),
        ("p1", """SELECT *, t - lag(t) OVER w AS dt, lag(g) OVER w AS pg, lag(near) OVER w AS pn, CASE WHEN lag(low) OVER w THEN lag(near) OVER w END AS pl, lead(g) OVER w AS ng, lead(near) OVER w AS nn
                  FROM pts WINDOW w AS (PARTITION BY icao ORDER BY t)"""),
        ("p2", "SELECT *, coalesce(dt > 43200 AND (pl IS NOT NULL OR dt > 432000), FALSE) AS cut FROM p1"),
        ("p3", "SELECT *, coalesce(lead(cut) OVER w, FALSE) AS ncut, sum((NOT g AND (coalesce(pg, TRUE) OR cut))::INT) OVER w AS leg, NOT g AND (coalesce(pg, TRUE) OR cut) AS st FROM p2 WINDOW w AS (PARTITION BY icao ORDER BY t)"),
        ("legs", """SELECT icao, leg, min(t) AS t0, max(t) AS t1, count(*) AS points, any_value(call) AS call,
                  arg_min(CASE WHEN pg AND dt <= 43200 THEN [pn] WHEN low THEN [near] ELSE [NULL] END, t)[1] AS dep,
                  arg_max(CASE WHEN ncut THEN CASE WHEN low THEN [near] ELSE [NULL] END WHEN ng THEN [nn] WHEN low THEN [near] ELSE [NULL] END, t)[1] AS arr,
                  coalesce(max(dt) FILTER (WHERE NOT st), 0) AS gap FROM p3 WHERE NOT g GROUP BY 1, 2 HAVING max(t) - min(t) >= 300 AND count(*) >= 2""")]


@query("flight_legs", with_ctes([], "SELECT icao, leg, t0, t1, points, call, dep, arr, gap FROM legs", [FIX, *LEGS]))
def flight_legs(spark, sf):
    """One callsign per aircraft here; changes of callsign are in the unit tests."""
    return T.legs(trace(spark, sf), gap=43200, max_gap=5 * 86400, least_n=2, ties=("ts", "event_id"))


def judged_legs(spark, sf):
    l = T.legs(trace(spark, sf), gap=43200, max_gap=5 * 86400, least_n=2, ties=("ts", "event_id"))
    routes = B.table(spark, sf, "nation").select(F.concat(F.lit("ABC"), F.col("n_nationkey") % 5).alias("call"), F.array(F.lit("P0"), F.lit("P1"), F.lit("P3")).alias("route")).distinct()
    ports = spark.range(7).select(F.concat(F.lit("P"), "id").alias("airport"), (30 + F.col("id") / 2).alias("a_lat"), F.lit(40.0).alias("a_lon"))
    return T.judge(l.withColumn("low_near_planned", F.lit(15000)).withColumn("hold", F.lit(0.0)), routes, ports)


@query("leg_verdicts")
def leg_verdicts(spark, sf):
    return judged_legs(spark, sf).select("icao", "leg", "dep", "arr", "planned", "verdict")


@query("airport_day_counters")
def airport_day_counters(spark, sf):
    return T.airport_day(judged_legs(spark, sf))


@query("holding_turns", with_ctes([], """
  SELECT vessel AS icao, round(coalesce(sum(CASE WHEN ok AND pok THEN abs(((track - pt + 540) % 360 + 360) % 360 - 180) END), 0), 6) AS hold FROM (
    SELECT *, lag(ok) OVER w AS pok, lag(track) OVER w AS pt FROM (SELECT vessel, ts, (event_id * 17 % 360)::DOUBLE AS track, alt <= 2000 AS ok FROM fix) WINDOW w AS (PARTITION BY vessel ORDER BY ts)) GROUP BY 1""", [FIX]))
def holding_turns(spark, sf):
    p = fixes(spark, sf).select(F.col("vessel").alias("icao"), F.col("ts").alias("t"), (F.col("event_id") * 17 % 360).cast("double").alias("track"), (F.col("alt") * 10).alias("alt"), F.lit(10).alias("km_to_arr"))
    return T.holding(p, ["icao"]).select("icao", *rnd("hold"))


@query("airline_leg_filter", with_ctes([], """
  SELECT conv_id, turn FROM conversations WHERE regexp_matches(substr(text, 1, 3) || turn, '^[A-Za-z]{3}[0-9]') AND ('A' || conv_id % 8) IN ('A2', 'A3', 'A4', 'A5')"""))
def airline_leg_filter(spark, sf):
    c = B.table(spark, sf, "conversations")
    call = F.concat(F.substring("text", 1, 3), F.col("turn").cast("string"))
    return c.where(T.airline(call, F.concat(F.lit("A"), F.col("conv_id") % 8))).select("conv_id", "turn")


# A fixed list of places (base, lat, lon) on all sides of the detections.
BASES = [("north", 52.0, 20.0), ("east", 30.0, 60.0), ("south", 5.0, 25.0), ("west", 36.0, -5.0), ("near", 25.0, 32.0)]
BASE_SQL = ("bases", "SELECT * FROM (VALUES " + ", ".join(f"('{b}', {x}::DOUBLE, {y}::DOUBLE)" for b, x, y in BASES) + ") t(base, blat, blon)")


@query("heading_to_base", with_ctes([], """
  SELECT det_id, (min((nm, base)) FILTER (WHERE nm BETWEEN 25 AND 1400 AND off <= 20))[2] AS base,
         round((min((nm, base)) FILTER (WHERE nm BETWEEN 25 AND 1400 AND off <= 20))[1], 6) AS nm
  FROM (SELECT det_id, base, nm, abs(fmod(brg - track + 540 + 360, 360) - 180) AS off FROM (
    SELECT det_id, base, (det_id * 17 % 360)::DOUBLE AS track,
           2 * 3440.065 * asin(sqrt(least(1, sin(radians(blat - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(blat)) * sin(radians(blon - lon) / 2) ** 2))) AS nm,
           fmod(degrees(atan2(sin(radians(blon - lon)) * cos(radians(blat)), cos(radians(lat)) * sin(radians(blat)) - sin(radians(lat)) * cos(radians(blat)) * cos(radians(blon - lon)))) + 360, 360) AS brg
    FROM det, bases)) GROUP BY det_id""", [DET, BASE_SQL]))
def heading_to_base(spark, sf):
    """Nearest base of a fixed list within reach that lies within twenty degrees of the track."""
    d = detections(spark, sf).withColumn("track", (F.col("det_id") * 17 % 360).cast("double"))
    return G.heading_base(d, BASES).select("det_id", "base", *rnd("nm"))


@query("newest_day_vs_usual", with_ctes(["ship_daily"], """
  SELECT nation, day, n, med AS usual, week FROM (SELECT *, median(n) OVER (PARTITION BY nation ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS med,
    sum(n) OVER (PARTITION BY nation ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS week, max(day) OVER (PARTITION BY nation) AS l FROM ship_daily) WHERE day = l"""))
def newest_day_vs_usual(spark, sf):
    return T.newest_vs_usual(B.ship_daily(spark, sf), ["nation"])


@query("dark_share_per_pass", with_ctes([], """
  SELECT box, ts::DATE AS day, count(*) AS seen, count(*) FILTER (WHERE cls = 'other') AS dark, CASE WHEN count(*) >= 5 THEN round(100.0 * count(*) FILTER (WHERE cls = 'other') / count(*), 6) END AS share
  FROM fix JOIN boxes ON lat BETWEEN la0 AND la1 AND lon BETWEEN lo0 AND lo1 GROUP BY 1, 2""", [FIX, BOX]))
def dark_share_per_pass(spark, sf):
    j = G.in_boxes(fixes(spark, sf), boxes(spark)).groupBy("box", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("cls") == "other").alias("dark"))
    return j.withColumn("share", F.when(F.col("seen") >= 5, F.round(100.0 * F.col("dark") / F.col("seen"), 6)))


@query("detections_per_area", with_ctes([], """
  SELECT box, round(10000.0 * count(*) / (1000 + 500 * min(priority)), 6) AS per_area FROM det JOIN boxes ON lat BETWEEN la0 AND la1 AND lon BETWEEN lo0 AND lo1 GROUP BY 1 HAVING 1000 + 500 * min(priority) >= 1500""", [DET, BOX]))
def detections_per_area(spark, sf):
    """Detections per 10,000 square kilometres of observed area, with a least area."""
    j = G.in_boxes(detections(spark, sf), boxes(spark)).withColumn("area", 1000 + 500 * F.col("priority")).groupBy("box", "area").agg(F.count(F.lit(1)).alias("n"))
    return j.where("area >= 1500").select("box", F.round(10000.0 * F.col("n") / F.col("area"), 6).alias("per_area"))


@query("densest_newest_cells", with_ctes([], """
  SELECT box, ci, cj, n FROM (SELECT *, row_number() OVER (PARTITION BY box ORDER BY n DESC, ci, cj) AS r FROM (
    SELECT box, floor(lat / 0.05)::INT AS ci, floor(lon / 0.05)::INT AS cj, count(*) AS n FROM fix JOIN boxes ON lat BETWEEN la0 AND la1 AND lon BETWEEN lo0 AND lo1
    WHERE ts::DATE = (SELECT max(ts::DATE) FROM fix) GROUP BY 1, 2, 3)) WHERE r <= 150""", [FIX, BOX]))
def densest_newest_cells(spark, sf):
    """Densest cells of the newest pass, the first 150 of each theatre (the length is the report's)."""
    f = G.in_boxes(fixes(spark, sf), boxes(spark))
    last = fixes(spark, sf).agg(F.max(F.to_date("ts")).alias("d")).scalar()
    c = f.where(F.to_date("ts") == last).groupBy("box", geo.cell(F.col("lat"), 0.05).alias("ci"), geo.cell(F.col("lon"), 0.05).alias("cj")).agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(Window.partitionBy("box").orderBy(F.desc("n"), "ci", "cj"))
    return c.withColumn("_r", r).where(F.col("_r") <= 150).drop("_r")


@query("loitering_durations", with_ctes([], """
  SELECT vessel, day, round(s / 3600.0, 4) AS hours FROM (SELECT vessel, ts::DATE AS day, date_diff('second', min(ts), max(ts)) AS s FROM fix GROUP BY 1, 2) WHERE s >= 7200""", [FIX]))
def loitering_durations(spark, sf):
    d = fixes(spark, sf).groupBy("vessel", F.to_date("ts").alias("day")).agg(F.min(F.date_trunc("second", "ts")).alias("a"), F.max(F.date_trunc("second", "ts")).alias("b"))
    s = F.timestamp_diff("SECOND", F.col("a"), F.col("b"))
    return d.where(s >= 7200).select("vessel", "day", F.round(s / 3600, 4).alias("hours"))


@query("site_gazetteer", with_ctes([], """
  SELECT name, arg_min(kind, pr) AS kind, min(pr)::INT AS pr FROM (SELECT s_name AS name, 'depot' AS kind, 1 AS pr FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT replace(c_name, 'Customer', 'Supplier'), 'port', 2 FROM customer WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')) GROUP BY 1"""))
def site_gazetteer(spark, sf):
    """Union of site lists with one vocabulary; the first source wins for a name."""
    a = B.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_name").alias("name"), F.lit("depot").alias("kind"), F.lit(1).alias("pr"))
    b = B.table(spark, sf, "customer").where(F.col("c_mktsegment").isin("MACHINERY", "HOUSEHOLD")).select(F.regexp_replace("c_name", "Customer", "Supplier").alias("name"), F.lit("port").alias("kind"), F.lit(2).alias("pr"))
    return a.unionByName(b).groupBy("name").agg(F.min_by("kind", "pr").alias("kind"), F.min("pr").alias("pr"))
