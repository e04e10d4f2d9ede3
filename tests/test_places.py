"""Spatial, trajectory, record and streaming rules on small fixtures."""
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tocsin.operators import pit, record, spatial as G, trajectory as T
from tocsin.streaming import jobs as J


def km(a, b):
    return 111 * math.hypot(b[0] - a[0], (b[1] - a[1]) * math.cos(math.radians((a[0] + b[0]) / 2)))


def test_greedy_clusters_match_a_direct_pass(spark):
    rnd = random.Random(3)
    pts = [(i, 30 + rnd.random() / 5, 40 + rnd.random() / 5, rnd.randint(0, 100), "b", dt.date(2024, 1, 1)) for i in range(150)]
    got = {r.det_id: r.cid for r in G.cluster_day(spark.createDataFrame(pts, "det_id long, lat double, lon double, score int, box string, day date")).collect()}
    seeds, want = [], {}
    for i, la, lo, s, _, _ in sorted(pts, key=lambda p: (-p[3], p[0])):
        hit = next((j for j, a, o in seeds if km((a, o), (la, lo)) <= 2), None)
        if hit is None:
            seeds.append((i, la, lo))
        want[i] = i if hit is None else hit
    assert got == want


def test_blobs_match_flood_fill(spark):
    rnd = random.Random(4)
    px = {(rnd.randrange(30), rnd.randrange(30)) for _ in range(220)}
    r = G.blob_counts(spark.createDataFrame([(1, a, b, 1.0) for a, b in px], "scene int, row int, col int, db double"), least=2, most=40).first()
    left, sizes = set(px), []
    while left:
        todo, n = [left.pop()], 0
        while todo:
            a, b = todo.pop()
            n += 1
            for q in [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    todo.append(q)
        sizes.append(n)
    assert (r.bright, r.blobs) == (len(px), sum(2 <= s <= 40 for s in sizes))


def leg_rows(spark, pts):
    rows = [("a", t, 30.0, 40.0, alt, g, c, near, alt < 3000) for t, alt, g, c, near in pts]
    return spark.createDataFrame(rows, "icao string, t long, lat double, lon double, alt double, on_ground boolean, call string, near string, low boolean")


def air(t0, n, alt=30000.0, call="ABC1", near=None, step=120):
    return [(t0 + i * step, alt, False, call, near) for i in range(n)]


def test_legs(spark):
    # a coverage gap at altitude does not split a flight; ground contact does
    one = [(0, 0.0, True, "", "P")] + air(60, 6) + air(60 + 6 * 120 + 4000, 6) + [(8000, 0.0, True, "", "Q")]
    r = T.legs(leg_rows(spark, one)).collect()
    assert [(x.dep, x.arr, x.points) for x in r] == [("P", "Q", 12)]
    # a new callsign ends a leg, and the unseen landing has no airport
    two = air(0, 6) + air(720, 6, call="XYZ9")
    r = T.legs(leg_rows(spark, two)).orderBy("leg").collect()
    assert [(x.call, x.arr) for x in r] == [("ABC1", None), ("XYZ9", None)]
    # a gap while low near an airport is a landing out of view
    three = air(0, 5) + [(600, 2000.0, False, "ABC1", "P")] + air(600 + 4000, 6)
    r = T.legs(leg_rows(spark, three)).orderBy("leg").collect()
    assert len(r) == 2 and r[0].arr == "P"
    # seen on the ground after more than half an hour out of view: the ground airport counts
    four = air(0, 6) + [(600 + 7200, 0.0, True, "ABC1", "Q")]
    assert [(x.arr, x.gap) for x in T.legs(leg_rows(spark, four)).collect()] == [("Q", 0)] or [x.arr for x in T.legs(leg_rows(spark, four)).collect()] == ["Q"]
    # a cut forgets the callsign: the next one on the new leg is no change
    five = air(0, 5) + [(600, 2000.0, False, "ABC1", "P")] + air(600 + 4000, 3, call="") + air(600 + 4000 + 360, 6, call="XYZ9")
    assert [x.call for x in T.legs(leg_rows(spark, five)).orderBy("leg").collect()] == ["ABC1", "XYZ9"]
    # the ground under a new callsign is no landing of the old one
    six = air(0, 6) + [(800, 0.0, True, "XYZ9", "Q")]
    assert [x.arr for x in T.legs(leg_rows(spark, six)).collect()] == [None]


def test_verdicts(spark):
    legs = [("ABC1", "P", "P", 0, 3000, 100, None), ("ABC1", "P", "R", 0, 3000, 100, 15000), ("ABC1", "P", "R", 0, 3000, 100, 25000), ("ABC1", "P", "Q", 0, 3000, 100, None), ("ABC1", None, "Q", 0, 3000, 100, None)]
    l = spark.createDataFrame(legs, "call string, dep string, arr string, t0 long, t1 long, gap long, low_near_planned int")
    routes = spark.createDataFrame([("ABC1", ["P", "Q"])], "call string, route array<string>")
    ports = spark.createDataFrame([("P", 30.0, 40.0), ("Q", 31.0, 40.0), ("R", 33.0, 40.0)], "airport string, a_lat double, a_lon double")
    got = sorted(str((r.dep, r.arr, r.low_near_planned, r.verdict)) for r in T.judge(l, routes, ports).collect())
    assert got == sorted(str(x) for x in [("P", "P", None, "turnback"), ("P", "R", 15000, "diversion"), ("P", "R", 25000, None), ("P", "Q", None, "normal"), (None, "Q", None, None)])


def test_scene_needs_eight_earlier_ones_and_floors_a_flat_spread(spark):
    d0 = dt.date(2024, 1, 1)
    f = lambda n, last: spark.createDataFrame([(1, d0 + dt.timedelta(6 * i), 100.0) for i in range(n)] + [(1, d0 + dt.timedelta(6 * n), last)], "site int, day date, value double")
    z = lambda n, v: G.scene_z(f(n, v), ["site"]).orderBy(F.desc("day")).first().z     # noqa: E731
    assert z(7, 110.0) is None and z(8, 110.0) == pytest.approx(2.0)


def test_record_is_appended_once_and_an_edit_is_found(spark, tmp_path):
    p = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "theatre string, p double")
    fields = ["day", "theatre", "p"]
    assert record.append_day(p, rows, "2024-01-01", "theatre", fields)
    assert not record.append_day(p, rows, "2024-01-01", "theatre", fields)
    assert record.append_day(p, rows, "2024-01-02", "theatre", fields)
    log = spark.read.parquet(p)
    assert log.count() == 4 and record.verify(log, fields).first().first_bad is None
    bad = log.withColumn("p", F.when(F.col("seq") == 2, 0.9).otherwise(F.col("p")))
    assert record.verify(bad, fields).first().first_bad == 2


def test_as_of_sees_only_what_was_public(spark):
    d = dt.date(2024, 1, 10)
    s = pit.available(spark.createDataFrame([("x", d, 1.0)], "k string, day date, value double"), 2)
    asks = spark.createDataFrame([("x", d + dt.timedelta(i)) for i in (1, 2, 5)], "k string, day date")
    assert [r.value for r in pit.as_of(asks, s, ["k"]).orderBy("day").collect()] == [None, 1.0, 1.0]


def test_restating_stream_rewrites_only_its_days(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    mk = lambda rows: spark.createDataFrame(rows, "day date, n int")     # noqa: E731
    mk([(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 2)]).write.partitionBy("day").parquet(out)
    mk([(dt.date(2024, 1, 2), 20)]).write.parquet(src)
    q = spark.readStream.schema("day date, n int").parquet(src).writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(J.restate_sink(out)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [1, 20]


def test_nearest_at_high_latitude_and_across_the_date_line(spark):
    pts = spark.createDataFrame([(1, 60.0, 10.0), (2, 80.0, 10.0), (3, 10.0, 179.999), (4, 89.99, 0.0)], "k int, lat double, lon double")
    sites = spark.createDataFrame([(1, 60.0, 10.063), (2, 80.0, 10.18), (3, 10.0, -179.99), (4, 89.99, 120.0)], "site_id int, lat double, lon double")
    got = {r.k: r.site_id for r in G.nearest(pts, sites, "k", 4.0, 0.05).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    both = pts.withColumn("pass_id", F.lit("p")).select("k", "lat", "lon", "pass_id").union(sites.selectExpr("site_id + 10", "lat", "lon", "'p'"))
    n = {r.k: r.near_n for r in G.same_pass_counts(both, "k", radius_km=4.0).collect()}
    assert set(n.values()) == {2}


def test_crossings_count_each_direction(spark):
    ts = "2024-01-01 0{}:00:00"
    rows = [("v", ts.format(h), 30.5, lon) for h, lon in ((0, 40.4), (1, 40.6), (2, 40.4))] + [("far", ts.format(0), 33.0, 40.4), ("far", ts.format(1), 33.0, 40.6)]
    f = spark.createDataFrame(rows, "vessel string, s string, lat double, lon double").withColumn("ts", F.to_timestamp("s"))
    got = sorted((r.vessel, r.dir) for r in T.crossings(f, [("g", 30.0, 40.5, 31.0, 40.5, "west", "east")]).collect())
    assert got == [("v", "east"), ("v", "west")]


def test_heading_by_great_circle(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0, 90.0), (2, 0.0, 0.0, 0.0), (3, 0.0, 9.9, 90.0)], "k int, lat double, lon double, track double")
    got = {r.k: r.base for r in G.heading_base(d, [("e", 0.0, 10.0), ("far", 0.0, 20.0), ("n", 40.0, 0.0)]).collect()}
    assert got == {1: "e", 2: None, 3: "far"}  # 40 degrees north is 2,400 miles; 0.1 degrees are 6


def test_boxes_by_priority_and_quality(spark):
    boxes = [("b", 2, 0.0, 2.0, 0.0, 2.0), ("a", 1, 1.0, 3.0, 1.0, 3.0)]
    df = spark.createDataFrame([(1, 1.5, 1.5, 4.0, True), (1, 1.5, 1.5, 4.0, True), (2, 0.5, 0.5, 2.0, False), (3, 9.0, 9.0, 1.0, True), (4, None, 1.0, 1.0, True), (5, 2.0, 2.0, 8.0, None)],
                               "k long, lat double, lon double, value double, good boolean")
    assert sorted((r.k, r.box) for r in G.first_box(df, boxes).collect() if r.box) == [(1, "a"), (1, "a"), (2, "b"), (5, "a")]
    assert G.first_box(df, boxes).count() == 6 and G.first_box(df, []).where("box is null").count() == 6
    sides = spark.createDataFrame(boxes, "box string, priority int, lat_min double, lat_max double, lon_min double, lon_max double")
    got = {r.box: (r.n, r.good_mean, round(r.good_share, 4)) for r in G.box_quality(df.selectExpr("*", "date'2020-01-01' day"), sides, df.good).collect()}
    assert got == {"a": (3, 4.0, 0.6667), "b": (4, 4.0, 0.5)}


def test_copies_for_neighbouring_cells_are_never_broadcast(spark, tmp_path):
    spark.createDataFrame([(i, 30 + i / 1000, 40.0, "p", dt.date(2024, 1, 1)) for i in range(40)], "k int, lat double, lon double, pass_id string, day date").write.parquet(str(tmp_path / "p"))
    pts = spark.read.parquet(str(tmp_path / "p"))   # files have a small planned size
    listed, sites = pts.where("k < 3").select("lat", "lon", "day"), pts.select(F.col("k").alias("site_id"), "lat", "lon")
    for df in (G.same_pass_counts(pts, "k"), G.near_listed(pts, listed, "k"), G.nearest(pts, sites, "k", 2.0, 0.05)):
        joins = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in line and "_ci" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)
    got = {r.k: r.near_n for r in G.same_pass_counts(pts, "k").collect()}
    assert got == {i: sum(km((30 + i / 1000, 40.0), (30 + j / 1000, 40.0)) <= 2 for j in range(40)) for i in range(40)}


def test_nearest_joins_each_place_once(spark):
    pts = spark.createDataFrame([(1, 30.0, 40.0), (1, 31.0, 40.0), (2, 30.0, 40.0), (3, None, 40.0), (4, 50.0, 40.0)], "k int, lat double, lon double")
    sites = spark.createDataFrame([(9, 30.001, 40.0), (7, 30.001, 40.0), (8, 30.002, 40.0), (5, 31.0, 40.0), (6, 31.0, 40.0)], "site_id int, lat double, lon double")
    got = G.nearest(pts, sites, "k", 2.0, 0.05)
    assert sorted((r.k, r.lat or 0, r.site_id, round(r.km or 0, 3)) for r in got.collect()) == [
        (1, 30.0, 7, 0.111), (1, 31.0, 5, 0.0), (2, 30.0, 7, 0.111), (3, 0, None, 0), (4, 50.0, None, 0)]
    pairs = G.nearest(*(df.crossJoin(spark.range(200)).drop("id") for df in (pts, sites)), "k", 2.0, 0.05)
    assert pairs.count() == 1000


def test_legs_with_points_of_one_second(spark):
    flight = [(0, 0.0, True, "", "P")] + air(60, 6) + [(900, 0.0, True, "", "Q")]
    twice = flight + flight[1:2] + flight[6:7]      # the first and the last point in the air are heard twice
    for rows in (twice, twice[::-1]):
        assert [(x.dep, x.arr, x.points) for x in T.legs(leg_rows(spark, rows)).collect()] == [("P", "Q", 8)]
    # a ground point of the same second as one in the air: the order given decides
    both = flight[:4] + [(flight[3][0], 0.0, True, "", "Q")]
    d = leg_rows(spark, both).withColumn("n", F.when(F.col("on_ground"), 0).otherwise(1))
    assert [x.points for x in T.legs(d, least_s=0, least_n=1, ties=("n",)).orderBy("leg").collect()] == [2, 1]
    assert [x.points for x in T.legs(d, least_s=0, least_n=1, ties=("on_ground",)).orderBy("leg").collect()] == [3]
