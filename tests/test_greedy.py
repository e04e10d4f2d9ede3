"""Greedy rules in rounds against the sequential rule, and histogram quantiles against a direct walk."""
import bisect
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tocsin.operators import greedy, histograms as H, spatial as G


def flat(a, b):
    return 111.0 * math.hypot(a[0] - b[0], (a[1] - b[1]) * math.cos(math.radians((a[0] + b[0]) / 2)))


@pytest.mark.parametrize("lat0, lon0", [(30.0, 40.0), (71.95, 179.99), (-0.01, -0.01)])
def test_clusters_in_rounds_equal_the_sequential_rule(spark, lat0, lon0):
    r = random.Random(4)
    day = dt.date(2024, 5, 1)
    pts = [(i, lat0 + round(r.random() * 0.2, 3), lon0 + round(r.random() * (0.009 if lon0 > 100 else 0.2), 3), r.randint(0, 30), r.choice(["a", "b"]), day + dt.timedelta(r.randint(0, 1))) for i in range(500)]
    pts += [(1000 + i, *pts[i][1:]) for i in range(60)] + [(2000 + i, lat0, lon0, i, "a", day) for i in range(40)]
    seeds, want = [], {}
    for p in sorted(pts, key=lambda p: (-p[3], p[0])):
        hit = next((s for s in seeds if s[4:] == p[4:] and flat(s[1:3], p[1:3]) <= 2.0), None)
        if hit is None:
            seeds.append(p)
        want[p[0]] = (hit or p)[0]
    df = spark.createDataFrame(pts, "det_id long, lat double, lon double, score int, box string, day date")
    got = {x.det_id: x.cid for x in G.cluster_day(df).collect()}
    assert got == want
    assert G.cluster_day(df.limit(0)).count() == 0
    plan = G.cluster_day(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_pairs_are_taken_strongest_first(spark):
    r = random.Random(9)
    for n in (0, 1, 40):
        pairs = [(f"n{i}", f"n{j}", round(r.random(), 1)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.3]
        want, used = [], set()
        for w, a, b in sorted(((w, a, b) for a, b, w in pairs), reverse=True):
            if not {a, b} & used:
                want.append((a, b, w))
                used |= {a, b}
        got = [tuple(x) for x in greedy.mutual_best(spark.createDataFrame(pairs, "a string, b string, r double")).collect()]
        assert sorted(got) == sorted(want)


def km(a, b):
    return 6371.0 * math.hypot(math.radians(b[1] - a[1]) * math.cos(math.radians((a[0] + b[0]) / 2)), math.radians(b[0] - a[0]))


def test_sites_follow_a_running_mean_over_cell_borders(spark):
    r = random.Random(3)
    pts = [(i, 30.0 + r.random() * 0.03, 40.0 + r.random() * 0.03, i % 11 == 0) for i in range(150)]
    pts += [(200 + i, 30.1 + 0.0099 + i * 0.0006, 40.1 + 0.0099 + i * 0.0005, False) for i in range(6)]      # a row over a border: the mean moves along
    pts += [(300, 35.0, 41.0, True), (301, 36.0, 41.0, False), (302, 36.0, 41.0, False)]
    sites = []
    for k, lat, lon, fuel in sorted(pts, key=lambda p: (p[1], p[2], p[0])):
        c = (math.floor(lat / 0.01), math.floor(lon / 0.01))
        hit = next((s for s in sites if max(abs(s["c"][0] - c[0]), abs(s["c"][1] - c[1])) <= 1 and km((lat, lon), s["at"]) <= 0.4), None)
        if hit is None:
            sites.append({"k": k, "c": c, "at": [lat, lon], "n": 1, "fuel": fuel})
        else:
            hit["n"] += 1
            hit["at"] = [hit["at"][0] + (lat - hit["at"][0]) / hit["n"], hit["at"][1] + (lon - hit["at"][1]) / hit["n"]]
            hit["fuel"] |= fuel
    want = sorted((s["k"], *s["at"], s["n"], s["fuel"]) for s in sites if s["n"] >= 5 or s["fuel"])
    df = spark.createDataFrame(pts, "id long, lat double, lon double, fuel boolean").repartition(5)
    got = sorted(tuple(x) for x in greedy.running_sites(df).collect())
    assert [(g[0], g[3], g[4]) for g in got] == [(w[0], w[3], w[4]) for w in want]
    assert [g[1:3] for g in got] == [pytest.approx(w[1:3]) for w in want]
    assert any(w[3] > 1 for w in want)
    assert greedy.running_sites(df.limit(0)).count() == 0


def line(hist, q, edges):
    n, acc = sum(hist), 0
    for k, c in enumerate(hist):
        if n and c and acc + c >= q * n:
            high = edges[k + 1] if k + 1 < len(edges) else edges[-1] * 2
            return edges[k] + (high - edges[k]) * (q * n - acc) / c
        acc += c
    return float(edges[-1]) if n else 0.0


def test_histogram_quantiles_and_halves_add_up(spark):
    r = random.Random(1)
    rows = [(g, h, float(f"{r.lognormvariate(2, 2):.2f}")) for g in "abc" for h in (0, 1) for _ in range(r.randint(1, 90))] + [("c", 0, 5000.0), ("c", 1, 1e6), ("a", 0, -1.0), ("n", 0, None)]
    df, edges = spark.createDataFrame(rows, "g string, half int, v double"), list(H.POWER_EDGES)
    whole = {x.g: list(x.hist) for x in H.by_edges(df, ["g"], "v").collect()}
    halves = {x.g: list(x.hist) for x in H.merged(H.by_edges(df, ["g", "half"], "v"), ["g"], len(edges)).collect()}
    want = {}
    for g, _, v in rows:
        want.setdefault(g, [0] * len(edges))
        if v is not None:
            want[g][max(0, bisect.bisect_right(edges, v) - 1)] += 1
    assert whole == halves == want
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        got = {x.g: x.q for x in H.by_edges(df, ["g"], "v").select("g", H.quantile(F.col("hist"), q).alias("q")).collect()}
        assert got == pytest.approx({g: line(h, q, edges) for g, h in want.items()})


def test_count_quantiles(spark):
    counts = [0, 0, 1, 1, 1, 2, 5, 30, 40]
    df = spark.createDataFrame([("a", c) for c in counts] + [("b", 0)], "g string, k int")
    h = H.by_count(df, ["g"], "k", 20)
    for q in (0.0, 0.3, 0.5, 0.7, 0.95, 1.0):
        hist = [sum(min(c, 20) == i for c in counts) for i in range(21)]
        acc, want = 0, 20.0
        for k, c in enumerate(hist):
            acc += c
            if acc >= q * len(counts):
                want = float(k)
                break
        got = {x.g: x.q for x in h.select("g", H.count_quantile(F.col("hist"), q).alias("q")).collect()}
        assert got == {"a": want, "b": 0.0}
