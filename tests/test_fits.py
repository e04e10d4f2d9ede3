"""The joint solver against the optimum's conditions, direct minimisation and odd designs."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tocsin.operators import fits, model as M


def objective(x, y, w, ridge, theta):
    z = x @ theta
    q = 1 / (1 + np.exp(-z))
    return (w * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * theta ** 2).sum(), x.T @ (w * (q - y)) + ridge * theta


def by_hand(x, y, w, ridge, bounded):
    """Projected gradient descent with a small step, long enough to settle."""
    theta = np.zeros(x.shape[1])
    step = 1 / (0.25 * np.linalg.norm(x * np.sqrt(w)[:, None], 2) ** 2 + ridge.max())
    for _ in range(20_000):
        theta = theta - step * objective(x, y, w, ridge, theta)[1]
        theta[bounded] = np.maximum(theta[bounded], 0)
    return theta


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    n = 400
    x = np.c_[r.integers(0, 2, n), r.normal(size=n), r.random(n), r.random(n), np.ones(n), np.zeros(n)]
    y = (r.random(n) < 1 / (1 + np.exp(-(-1 + x[:, 1] + 2 * x[:, 2] - 2 * x[:, 3])))).astype(float)
    other = (r.random(n) < 0.2).astype(float)
    w = r.integers(0, 4, n).astype(float)
    cols = ["o", "h", "up", "down", "one", "none"]
    df = spark.createDataFrame([(*map(float, a), float(b), float(c), float(d)) for a, b, c, d in zip(x, y, other, w)], ", ".join(f"{c} double" for c in [*cols, "y", "other", "w"]))
    return x, y, other, w, cols, df


def test_many_fits_at_once_reach_their_own_minima(data):
    x, y, other, w, cols, df = data
    free, positive = {"o": 10.0, "h": 1.0, "one": 10.0, "none": 10.0}, {"up": 3.0, "down": 3.0}
    wanted = [fits.Fit("plain", free, positive), fits.Fit("weighted", free, positive, F.col("w")), fits.Fit("other", free, positive, label=F.col("other")),
              fits.Fit("hard", free, {"up": 100.0, "down": 100.0}), fits.Fit("few", {"h": 1.0}, {"up": 0.3}), fits.Fit("nobody", free, positive, F.lit(0.0)),
              fits.Fit("no_label", free, positive, label=F.lit(0.0))]
    got = fits.solve(df, wanted)
    a = np.c_[np.ones(len(y)), x]
    for f, yy, ww in (("plain", y, 1 + 0 * w), ("weighted", y, w), ("other", other, 1 + 0 * w), ("hard", y, 1 + 0 * w)):
        fit = next(g for g in wanted if g.name == f)
        ridge = np.array([0.0] + [{**fit.free, **fit.positive}[c] for c in cols])
        bounded = np.array([False] + [c in fit.positive for c in cols])
        want = by_hand(a, yy, ww, ridge, bounded)
        theta = np.array([got[f].theta[c] for c in ["intercept", *cols]])
        assert objective(a, yy, ww, ridge, theta)[0] <= objective(a, yy, ww, ridge, want)[0] + 1e-7
        assert theta == pytest.approx(want, abs=2e-3)
        assert got[f].gradient <= fits.TOLERANCE and got[f].rounds <= 15 and theta[bounded].min() >= 0
    assert got["plain"].theta["down"] == 0 and got["plain"].theta["none"] == 0
    assert set(got["few"].theta) == {"intercept", "h", "up"}
    assert set(got["nobody"].theta.values()) == {0.0}
    assert got["no_label"].theta["intercept"] < -10


def test_fit_keeps_going_with_a_constant_column(data):
    *_, df = data
    t = M.fit(df.withColumn("new_theatre", F.lit(0.0)), ["o", "new_theatre"], ["h"], ["up"], 3.0)
    u = M.fit(df, ["o"], ["h"], ["up"], 3.0)
    assert t["new_theatre"] == 0 and {k: t[k] for k in u} == pytest.approx(u, abs=1e-6)


def test_partitioning_does_not_matter(data):
    *_, df = data
    f = [fits.Fit("a", {"o": 10.0}, {"up": 3.0}), fits.Fit("b", {"o": 1.0}, {"down": 3.0})]
    one, many = fits.solve(df.coalesce(1), f), fits.solve(df.repartition(9), f)
    for k in one:
        assert one[k].theta == pytest.approx(many[k].theta, abs=1e-8)


def test_box_step_solves_the_bounded_quadratic():
    r = np.random.default_rng(1)
    for _ in range(200):
        p = int(r.integers(1, 7))
        m = r.normal(size=(p, p))
        h, g, at = m @ m.T + 0.1 * np.eye(p), r.normal(size=p), np.maximum(r.normal(size=p), 0)
        bounded = r.random(p) < 0.6
        d = fits.box_step(g, h, at, bounded)
        push = g + h @ d
        assert (at + d)[bounded].min(initial=0) >= -1e-9
        assert np.abs(push[~bounded | (at + d > 1e-9)]).max(initial=0) < 1e-6 and push[bounded].min(initial=0) > -1e-6


def test_rolling_fits_see_only_the_past(spark):
    r = np.random.default_rng(7)
    import datetime as dt
    rows = [(f"t{i % 2}", dt.date(2018, 1, 1) + dt.timedelta(int(d)), float(r.random()), int(r.random() < 0.3), True) for i in range(2) for d in range(0, 1460, 7)]
    df = spark.createDataFrame(rows, "theatre string, day date, w double, y int, lab boolean").withColumn("t_t0", (F.col("theatre") == "t0").cast("double"))
    v = [M.Variant("a", (), {"w": 3.0}), M.Variant("b", (), {2020: {"w": 3.0}, 2021: {"w": 100.0}}, by_year=True)]
    out = M.rolling_many(df, v, ["t_t0"], [2020, 2021]).collect()
    for year in (2020, 2021):
        train = df.where(F.col("lab") & (F.col("day") < F.date_sub(F.lit(f"{year}-01-01").cast("date"), 30)))
        theta = M.fit(train, ["t_t0"], [], ["w"], 3.0)
        base = {x.theatre: x.base for x in M.base_rates(train).collect()}
        want = {(x.theatre, x.day): x.raw for x in df.where(F.year("day") == year).select("theatre", "day", M.raw_probability(theta).alias("raw")).collect()}
        mine = [x for x in out if x.year == year and x.variant == "a"]
        assert len(mine) == len(want)
        for x in mine:
            assert x.raw == pytest.approx(want[x.theatre, x.day], abs=1e-7) and x.base == pytest.approx(base[x.theatre])
    assert {x.variant for x in out} == {"a", "b"}


def test_steps_equal_one_direct_pass(spark):
    r = np.random.default_rng(5)
    p = np.round(r.random(900), 2)
    y = (r.random(900) < p ** 2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)] + [(None, 1), (0.5, None)], "p double, y int").repartition(7)
    cells = sorted({float(v): (float(y[p == v].sum()), float((p == v).sum()), float(v)) for v in p}.values(), key=lambda c: c[2])
    want = [(c[2], c[0] / c[1], c[1]) for c in M.pooled(cells)]
    got = sorted(tuple(x) for x in M.isotonic_steps(df).select("upto", "q", "n").collect())
    assert np.array(got) == pytest.approx(np.array(want))
    means = np.array([c[0] / c[1] for c in cells])
    n, s = np.array([c[1] for c in cells]), np.array([c[0] for c in cells])
    direct = [max(min(s[a:b + 1].sum() / n[a:b + 1].sum() for b in range(i, len(cells))) for a in range(i + 1)) for i in range(len(cells))]
    test = spark.createDataFrame([(float(c[2]),) for c in cells] + [(-1.0,), (2.0,), (None,)], "p double")
    q = {x.p: x.q for x in M.isotonic(df, test).collect()}
    assert [q[c[2]] for c in cells] == pytest.approx(direct) and len(means) == len(direct)
    assert q[-1.0] == pytest.approx(direct[0]) and q[2.0] == pytest.approx(direct[-1]) and q[None] is None


def test_boosting_never_falls_in_a_rising_column(spark):
    from tocsin.operators import boosting
    r = np.random.default_rng(2)
    n = 3000
    up, free = r.random(n).round(2), r.normal(size=n)
    y = r.random(n) < np.clip(0.1 + 0.5 * (up > 0.6) - 0.2 * (up > 0.8) + 0.3 * np.sin(2 * free), 0, 1)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(up, free, y)], "up double, free double, y int")
    m = boosting.fit(df, ["up", "free"], ["up"], rounds=12, least=100, rate=0.3)
    grid = spark.createDataFrame([(i / 50, j / 4) for i in range(51) for j in range(-8, 9)], "up double, free double")
    by = {}
    for x in m.predict(grid).collect():
        by.setdefault(x.free, []).append((x.up, x.raw))
    for v in by.values():
        raws = [q for _, q in sorted(v)]
        assert all(b >= a - 1e-12 for a, b in zip(raws, raws[1:]))
    assert max(len(t.column) for t in m.trees) <= 15 and len(m.trees) == 12
    bins = m.bins(np.c_[up, free])
    for t in m.trees:
        leaves = np.bincount(t.nodes(bins), minlength=len(t.column))
        assert leaves[[i for i, c in enumerate(t.column) if c < 0]].min() >= 100
    free_fit = boosting.fit(df, ["up", "free"], [], rounds=12, least=100, rate=0.3)
    loss = lambda model: model.predict(df).agg(F.avg(-F.log(F.when(F.col("y") == 1, F.col("raw")).otherwise(1 - F.col("raw"))))).first()[0]      # noqa: E731
    base = -(y.mean() * np.log(y.mean()) + (1 - y.mean()) * np.log(1 - y.mean()))
    assert loss(free_fit) <= loss(m) < base


def test_one_split_is_the_best_by_hand(spark):
    from tocsin.operators import boosting
    rows = [(float(i % 10), int(i % 10 >= 7)) for i in range(200)]
    m = boosting.fit(spark.createDataFrame(rows, "x double, y int"), ["x"], ["x"], rounds=1, depth=1, least=10, rate=1.0)
    t, p = m.trees[0], 0.3
    assert m.edges[0][t.bin[0]] == 6.0 and t.column == [0, -1, -1]
    g = [140 * p, 60 * (p - 1)]
    h = [140 * p * (1 - p), 60 * p * (1 - p)]
    assert t.value[1:] == pytest.approx([-g[0] / (h[0] + 1), -g[1] / (h[1] + 1)])
