"""Rank statistics, exact tests, resampling, model and composite invariants against brute force."""
import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tocsin.functions import scoring as S, tails
from tocsin.operators import composite as C, evaluate as E, model as M, ranking, studies as ST


def brute_auc(s, y):
    pos, neg = [a for a, b in zip(s, y) if b], [a for a, b in zip(s, y) if not b]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(5)
    rows = [(f"t{i % 3}", dt.date(2020, 1, 1) + dt.timedelta(i // 3), round(rnd.random(), 2), int(rnd.random() < 0.3)) for i in range(900)]
    return rows, spark.createDataFrame(rows, "theatre string, day date, p double, y int").withColumn("ok", F.lit(True)).withColumn("base", F.lit(0.3)).cache()


def test_auc_matches_brute_force_and_flips_with_the_sign(scored):
    rows, df = scored
    want = brute_auc([r[2] for r in rows], [r[3] for r in rows])
    assert E.auc(df).first().auc == pytest.approx(want)
    assert E.auc(df.withColumn("p", -F.col("p"))).first().auc == pytest.approx(1 - want)


def test_exact_quantiles_and_ranks(scored):
    rows, df = scored
    xs = [r[2] for r in rows]
    q = ranking.exact_quantiles(df, "p", [0.05, 0.5, 0.9]).first()
    assert list(q) == pytest.approx(list(np.quantile(xs, [0.05, 0.5, 0.9])))
    r = {x.p: x.rank for x in ranking.average_ranks(df, "p").collect()}
    srt = sorted(xs)
    v = srt[400]
    assert r[v] == pytest.approx(np.mean([i + 1 for i, x in enumerate(srt) if x == v]))


def test_shift_zero_is_the_real_auc(scored):
    rows, df = scored
    c = {r["shift"]: r.auc for r in E.shift_control(df, shifts=5, edge=20, least=50).collect()}
    assert c[0] == pytest.approx(brute_auc([r[2] for r in rows], [r[3] for r in rows])) and len(c) == 6


def test_bootstrap_interval_holds_the_point_estimate(scored):
    rows, df = scored
    d = df.withColumn("cluster", F.concat_ws("-", "theatre", F.month("day")))
    b = E.cluster_bootstrap_auc(d, "cluster", reps=60).first()
    assert b.auc_lo < brute_auc([r[2] for r in rows], [r[3] for r in rows]) < b.auc_hi


def test_tails_match_direct_sums(spark):
    df = spark.createDataFrame([(3, 10, 0.2), (0, 10, 0.2), (10, 10, 0.5), (40, 200, 0.15)], "k long, n long, p double")
    for r in df.select("*", tails.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("t")).collect():
        assert r.t == pytest.approx(sum(math.comb(r.n, i) * r.p ** i * (1 - r.p) ** (r.n - i) for i in range(r.k, r.n + 1)))
    t = spark.createDataFrame([(5, 3, 2, 9), (0, 4, 3, 8)], "a long, b long, c long, d long")
    for r in E.fisher(t, "a", "b", "c", "d").collect():
        n, row, col = r.a + r.b + r.c + r.d, r.a + r.b, r.a + r.c
        want = sum(math.comb(col, i) * math.comb(n - col, row - i) for i in range(r.a, min(row, col) + 1)) / math.comb(n, row)
        assert r.p_value == pytest.approx(want)


def test_tails_below_the_mode_and_far_out(spark):
    df = spark.createDataFrame([(100, 2000, 0.5), (1000, 2000, 0.5), (1500, 2000, 0.5), (30000, 100000, 0.3), (29000, 100000, 0.3), (1, 100000, 0.9)], "k long, n long, p double")
    for r in df.select("*", tails.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("t")).collect():
        terms = [math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(r.p) + (r.n - i) * math.log(1 - r.p) for i in range(r.k, r.n + 1)]
        top = max(terms)
        assert r.t == pytest.approx(min(1, math.exp(top) * math.fsum(math.exp(x - top) for x in terms)), rel=1e-6)
    t = spark.createDataFrame([(10, 1990, 1000, 1000), (600, 1400, 400, 1600)], "a long, b long, c long, d long")
    for r in E.fisher(t, "a", "b", "c", "d").collect():
        n, row, col = r.a + r.b + r.c + r.d, r.a + r.b, r.a + r.c
        want = sum(math.comb(col, i) * math.comb(n - col, row - i) for i in range(r.a, min(row, col) + 1)) / math.comb(n, row)
        assert r.p_value == pytest.approx(want, rel=1e-6)


def test_ordered_weights_have_their_orness():
    for n in range(1, 8):
        w = S.ordered_weights(n)
        assert sum(w) == pytest.approx(1) and (n == 1 or sum(x * (n - 1 - i) / (n - 1) for i, x in enumerate(w)) == pytest.approx(0.7))


def test_smoothing_of_a_long_series(spark):
    from tocsin.operators import windows
    vals = [random.Random(i).random() * 100 for i in range(5000)]
    rows = [("a", dt.date(2000, 1, 1) + dt.timedelta(i), v) for i, v in enumerate(vals)]
    got = [r.ewma for r in windows.ewma(spark.createDataFrame(rows, "k string, day date, value double"), ["k"]).orderBy("day").collect()]
    now, want = None, []
    for v in vals:
        now = v if now is None else 0.3 * v + 0.7 * now
        want.append(now)
    assert got == pytest.approx(want, rel=1e-12)


def test_multiplicity_corrections(spark):
    ps = [0.001, 0.02, 0.02, 0.04, 0.3, 0.9]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p_value double")
    q = {r.i: r.q for r in E.benjamini_hochberg(df).collect()}
    m = len(ps)
    want = [min(1, min(ps[j] * m / (j + 1) for j in range(i, m))) for i in range(m)]
    assert [q[i] for i in range(m)] == pytest.approx(want)
    h = {r.i: r.p_holm for r in E.holm(df).collect()}
    want = [min(1, max(ps[j] * (m - j) for j in range(i + 1))) for i in range(m)]
    assert [h[i] for i in range(m)] == pytest.approx(want)


def test_penalised_fit_meets_its_optimality_conditions(spark):
    rng = np.random.default_rng(1)
    n = 600
    x = rng.normal(size=(n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-(-1 + 0.8 * x[:, 0] - 0.7 * x[:, 2])))).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "o double, w1 double, w2 double, y int")
    t = M.fit(df, ["o"], [], ["w1", "w2"], 3.0)
    p = 1 / (1 + np.exp(-(t["intercept"] + x @ np.array([t["o"], t["w1"], t["w2"]]))))
    grad = x.T @ (p - y) + np.array([10, 3, 3]) * np.array([t["o"], t["w1"], t["w2"]])
    assert abs((p - y).sum()) < 0.05 and abs(grad[0]) < 0.05
    assert t["w1"] >= 0 and t["w2"] == pytest.approx(0, abs=1e-6) and grad[2] > 0     # the bound is active


def test_published_probability_is_floored_and_monotone(spark):
    df = spark.createDataFrame([(i / 50,) for i in range(1, 50)], "r double")
    ps = [r[0] for r in df.select(S.shrink(F.col("r"), F.lit(0.1), F.lit(0.6), F.lit(0.5))).collect()]
    assert ps == sorted(ps) and min(ps) >= 0.05


def items(spark, rows):
    return spark.createDataFrame(rows, "theatre string, domain string, series_id string, z double, direction string, late boolean")


def zc(spark, rows):
    it = C.items(items(spark, rows))
    g = C.groups(it, it.select("series_id", F.col("series_id").alias("label")))
    w = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "domain string, weight double")
    return C.composite(C.domain_scores(g), w).first()


def test_composite_rules(spark):
    hot = [("x", "a", "s1", 3.0, "up", False), ("x", "b", "s2", 2.0, "up", False)]
    calm = hot + [("x", "b", "s3", -4.0, "up", False)]
    assert zc(spark, hot[:1]).zc is None                       # one live domain: no index
    m = [100 + 10 * 0.7 * 3, 100 + 10 * 0.7 * 2]
    mean, sd = np.mean(m), np.std(m)
    assert zc(spark, hot).zc == pytest.approx((mean + sd ** 2 / mean - 100) / 10)
    assert zc(spark, calm).firing == ["a"]
    assert S.ordered_weights(2) == pytest.approx([0.7, 0.3])


def test_components_close_a_long_chain(spark):
    n = spark.createDataFrame([(f"{i:03d}",) for i in range(40)], "series_id string")
    e = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(30)], "series_id string, other string")
    lab = {r.series_id: r.label for r in C.components(n, e).collect()}
    assert all(lab[f"{i:03d}"] == "000" for i in range(31)) and lab["035"] == "035"


def test_registered_resampling_takes_the_reference_counts(spark, monkeypatch):
    from tocsin.plans import catalogue
    q, sf, seen = catalogue.queries(), "/root/testdata/sf0.001", {}
    draws, shift_control = E.draws, E.shift_control

    def counted_draws(clusters, reps, *a, **b):
        seen.setdefault("reps", []).append(reps)
        return draws(clusters, reps, *a, **b)

    def counted_shifts(df, key="theatre", shifts=300, **b):
        seen.setdefault("shifts", []).append(shifts)
        return shift_control(df, key, shifts, **b)
    monkeypatch.setattr(E, "draws", counted_draws)
    monkeypatch.setattr(E, "shift_control", counted_shifts)
    for name in ("cluster_bootstrap_auc", "paired_brier_bootstrap", "shifted_timing_control", "shifted_timing_p_values", "release_gates", "single_family_timing_null"):
        q[name](spark, sf)
    assert seen == {"reps": [500] * 3, "shifts": [300] * 4}


def test_stratified_tables_without_a_contrast(spark):
    schema = "g int, a long, b long, c long, d long"
    quiet = E.mantel_haenszel(spark.createDataFrame([(1, 0, 4, 0, 9), (2, 0, 3, 0, 7)], schema)).first()
    assert math.isnan(quiet.odds_ratio) and quiet.chi2 == math.inf
    apart = E.mantel_haenszel(spark.createDataFrame([(1, 4, 0, 0, 9)], schema)).first()
    assert apart.odds_ratio == math.inf and apart.chi2 == pytest.approx((4 - 16 / 13 - 0.5) ** 2 / (4 * 9 * 4 * 9 / (13 * 13 * 12)))
    plain = E.mantel_haenszel(spark.createDataFrame([(1, 4, 2, 3, 9)], schema)).first()
    assert plain.odds_ratio == pytest.approx(6.0)


def test_flagged_months_with_every_month_flagged_or_none_calm(spark):
    all_flagged = ST.flagged_months(spark.createDataFrame([("x", True, True), ("x", True, False), ("y", True, False)], "theatre string, flag boolean, event boolean")).first()
    assert (all_flagged.n, all_flagged.k, all_flagged.calm_rate, all_flagged.p_value) == (1, 1, 1.0, 1.0) and math.isnan(all_flagged.odds_ratio)
    no_calm = ST.flagged_months(spark.createDataFrame([("x", True, True), ("x", False, True), ("y", False, True), ("y", False, True)], "theatre string, flag boolean, event boolean")).first()
    assert (no_calm.n, no_calm.k, no_calm.p_value) == (4, 1, None) and math.isnan(no_calm.calm_rate) and math.isnan(no_calm.odds_ratio)
