"""Event-probability model: penalised fits with non-negative family weights, base rates, shrinkage, rolling
origin, bootstrap, prediction, recalibration and the market blend."""
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from tocsin.functions import scoring as S
from tocsin.operators import fits
from tocsin.operators.lineage import stable

# Fixed values of the published rule.
RIDGE_OFFSET, RIDGE_HISTORY, BASE_PRIOR, EMBARGO = 10.0, 1.0, 1000, 30
LAMBDAS = (0.3, 1, 3, 10, 30, 100)
GAMMAS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
PHIS = (0.0, 0.25, 0.5, 0.75)
GAMMA0, PHI0, P_CAP = 0.6, 0.5, 0.95
MARKET_CAL, MARKET_WEIGHT, MARKET_VOLUME = (-0.76, 0.90), 0.30, 50000


def ridges(offsets, history, families, lam):
    """(free, positive): the ridge of every column, by group."""
    return {**{c: RIDGE_OFFSET for c in offsets}, **{c: RIDGE_HISTORY for c in history}}, {c: float(lam) for c in families}


def fit(rows: DataFrame, offsets, history, families, lam, label="y", weight=None):
    """Coefficients by column name (plus `intercept`). Offsets and history terms are free, family weights are >= 0."""
    free, positive = ridges(offsets, history, families, lam)
    one = fits.Fit("fit", free, positive, F.lit(1.0) if weight is None else F.col(weight), F.col(label))
    return fits.solve(rows, [one])["fit"].theta


def raw_probability(theta, weights=None):
    return S.sigmoid(F.lit(theta["intercept"]) + sum((F.lit(b) * F.col(c) for c, b in theta.items() if c != "intercept"), F.lit(0.0)))


def base_rates(rows: DataFrame, key="theatre", label="y", pools: DataFrame = None) -> DataFrame:
    """Event rate per entity mixed with the pooled rate as 1,000 pseudo-days. pools (key, pool): a sub-theatre is mixed with
    the rate of the theatres it pools toward, and does not count in the pooled rate."""
    g = rows.groupBy(key).agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n"))
    if pools is None:
        pooled = g.agg((F.sum("pos") / F.sum("n")).alias("g")).scalar()
        return g.withColumn("_g", pooled).select(key, ((F.col("pos") + BASE_PRIOR * F.col("_g")) / (F.col("n") + BASE_PRIOR)).alias("base"))
    subs = pools.select(key).distinct().withColumn("_sub", F.lit(True))
    g = g.join(subs, key, "left")
    pooled = g.where("_sub is null").agg((F.sum("pos") / F.sum("n")).alias("g")).scalar()
    own = pools.join(g.select(F.col(key).alias("pool"), "pos", "n"), "pool").groupBy(key).agg((F.sum("pos") / F.sum("n")).alias("_pg"))
    g = g.join(own, key, "left").withColumn("_g", F.coalesce("_pg", pooled))
    return g.select(key, ((F.col("pos") + BASE_PRIOR * F.col("_g")) / (F.col("n") + BASE_PRIOR)).alias("base"))


def sub_offset(rows: DataFrame, rest, label="y", key="theatre", ridge=RIDGE_OFFSET, rounds=30) -> DataFrame:
    """One offset per entity with everything else held fixed (`rest` is the log-odds without it): damped Newton, one small
    aggregate per round."""
    d = stable(rows.select(key, F.col(label).alias("_y"), rest.alias("_r")))
    u = stable(d.select(key).distinct().withColumn("u", F.lit(0.0)))
    for _ in range(rounds):
        p = S.sigmoid(F.col("_r") + F.col("u"))
        g = d.join(u, key).groupBy(key, "u").agg(F.sum(p - F.col("_y")).alias("_g"), F.sum(p * (1 - p)).alias("_h"))
        step = S.clip((F.col("_g") + ridge * F.col("u")) / (F.col("_h") + ridge), -1.0, 1.0)
        u = stable(g.select(key, (F.col("u") - step).alias("u"), F.abs(step).alias("_step")))
        if u.agg(F.max("_step")).first()[0] < 1e-8:
            break
        u = u.drop("_step")
    return u.select(key, "u")


def shrink_grid(oos: DataFrame, by=(), raw="raw", base="base", y="y") -> DataFrame:
    """(gamma, phi) with the lowest Brier score, the first in grid order on a tie. All 36 candidates share one pass."""
    grid = [(g, f) for g in GAMMAS for f in PHIS]
    agg = oos.groupBy(*by).agg(*[F.avg(F.pow(S.shrink(F.col(raw), F.col(base), F.lit(g), F.lit(f)) - F.col(y), 2)).alias(f"b{i}")
                                 for i, (g, f) in enumerate(grid)])
    rows = F.array(*[F.struct(F.col(f"b{i}").alias("brier"), F.lit(i).alias("i"), F.lit(g).alias("gamma"), F.lit(f).alias("phi"))
                     for i, (g, f) in enumerate(grid)])
    return agg.select(*by, F.array_min(rows).alias("_b")).select(*by, "_b.gamma", "_b.phi", "_b.brier")


def nested_publish(oos: DataFrame, first_year: int, year="year", by=()) -> DataFrame:
    """Published probability with (gamma, phi) fitted on earlier test years only; the defaults for the first two. `by`: columns of models
    that are published each on its own."""
    by = list(by)
    years = oos.select(year).distinct()
    all_years = years.select(F.array_sort(F.collect_set(year))).scalar()  # one number per year
    past = oos.withColumn("_years", all_years).withColumn("target", F.explode(F.filter("_years", lambda t: t > F.col(year)))).drop("_years")
    fitted = shrink_grid(past, [*by, "target"]).select(*by, F.col("target").alias(year), "gamma", "phi")
    d = oos.join(fitted, [*by, year], "left")
    own = F.col(year) >= first_year + 2
    g, f = F.when(own, F.col("gamma")).otherwise(GAMMA0), F.when(own, F.col("phi")).otherwise(PHI0)
    return d.withColumn("gamma", g).withColumn("phi", f).withColumn("p", S.shrink(F.col("raw"), F.col("base"), F.col("gamma"), F.col("phi")))


@dataclass(frozen=True)
class Variant:
    """A model to be judged out of sample: its columns (families: ridge by column, for all years or by test year), the label, the mark of the
    rows that train and are judged, and a weight column."""
    name: str
    history: tuple
    families: dict
    label: str = "y"
    lab: str = "lab"
    weight: str = None
    by_year: bool = False

    def positive(self, year):
        return self.families[year] if self.by_year else self.families


def rolling_many(rows: DataFrame, variants, offsets, years, key="theatre", carry=("eid", "cluster")) -> DataFrame:
    """Out-of-sample raw probability and base rate of every variant and test year: key, day, y, year, variant, raw, base.

    A year is judged by the fit on the days before it less a 30-day embargo. All fits of all variants and years are solved together, the base
    rates come from one grouped sum, and the rows are scored in one pass.
    """
    rows = stable(rows)
    cuts = {yr: F.date_sub(F.lit(f"{yr}-01-01").cast("date"), EMBARGO) for yr in years}
    trains = lambda v, yr: F.col(v.lab) & (F.col("day") < cuts[yr])      # noqa: E731
    all_ = []
    for v in variants:
        for yr in years:
            free = {**{c: RIDGE_OFFSET for c in offsets}, **{c: RIDGE_HISTORY for c in v.history}}
            w = F.lit(1.0) if v.weight is None else F.col(v.weight).cast("double")
            all_.append(fits.Fit(f"{v.name}|{yr}", free, v.positive(yr), F.when(trains(v, yr), w).otherwise(0.0), F.col(v.label)))
    found = fits.solve(rows, all_)

    kinds = list(dict.fromkeys((v.label, v.lab) for v in variants))
    first = {k: next(v for v in variants if (v.label, v.lab) == k) for k in kinds}
    cells = [(k, yr, f"{i}_{yr}") for i, k in enumerate(kinds) for yr in years]
    g = stable(rows.groupBy(key).agg(*[x for k, yr, c in cells for x in (
        F.sum(F.when(trains(first[k], yr), F.col(k[0]))).alias(f"pos{c}"), F.count_if(trains(first[k], yr)).alias(f"n{c}"))]))
    total = g.agg(*[F.sum(f"{x}{c}").alias(f"{x}{c}") for _, _, c in cells for x in ("pos", "n")]).first()     # two numbers a cell
    pooled = {c: (total[f"pos{c}"] or 0) / max(total[f"n{c}"] or 0, 1) for _, _, c in cells}
    base = g.select(key, F.inline(F.array(*[F.struct(F.lit(kinds.index(k)).alias("_kind"), F.lit(yr).alias("year"), (
        (F.coalesce(f"pos{c}", F.lit(0)) + BASE_PRIOR * pooled[c]) / (F.col(f"n{c}") + BASE_PRIOR)).alias("base")) for k, yr, c in cells])))

    def score(v):
        out = F.lit(None).cast("double")
        for yr in years:
            out = F.when(F.year("day") == yr, raw_probability(found[f"{v.name}|{yr}"].theta)).otherwise(out)
        return out
    test = rows.where(F.year("day").isin(list(years))).select(key, "day", F.year("day").alias("year"), *[c for c in carry if c in rows.columns], F.inline(F.array(*[
        F.struct(F.lit(v.name).alias("variant"), F.col(v.label).alias("y"), F.col(v.lab).alias("_lab"), F.lit(kinds.index((v.label, v.lab))).alias("_kind"), score(v).alias("raw"))
        for v in variants])))
    return test.where("_lab").join(base, [key, "year", "_kind"]).drop("_lab", "_kind")


def rolling(rows: DataFrame, offsets, history, families, lam, years, key="theatre", weight=None) -> DataFrame:
    """`rolling_many` of one model."""
    return rolling_many(rows, [Variant("model", tuple(history), {c: float(lam) for c in families}, weight=weight)], offsets, years, key).drop("variant")


def choose_lambda(rows, offsets, history, families, years, lambdas=LAMBDAS, key="theatre") -> DataFrame:
    """Out-of-sample Brier score of the published probability under each penalty, and which is chosen (the first of the best):
    lam, brier, chosen. All penalties and years are fitted together."""
    v = [Variant(str(lam), tuple(history), {c: float(lam) for c in families}) for lam in lambdas]
    pub = nested_publish(stable(rolling_many(rows, v, offsets, years, key)), years[0], by=("variant",))
    b = stable(pub.groupBy(F.col("variant").cast("double").alias("lam")).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier")))
    best = b.agg(F.min(F.struct("brier", "lam")).alias("b")).select("b.lam").scalar()
    return b.withColumn("chosen", F.col("lam") == best)


def bootstrap(rows: DataFrame, offsets, history, families, lam, reps=40, seed=3, cluster="cluster"):
    """Refits with whole clusters redrawn, all solved together; every row carries its weights in all replicates. Returns one coefficient dict
    per replicate."""
    from tocsin.operators import evaluate
    d = evaluate.draws(rows.select(F.col(cluster).alias("cluster")), reps, seed)
    times = d.groupBy(F.col("cluster").alias(cluster)).agg(F.map_from_entries(F.collect_list(F.struct("rep", "times"))).alias("_times"))
    rows = stable(rows.join(times, cluster, "left"))
    free, positive = ridges(offsets, history, families, lam)
    found = fits.solve(rows, [fits.Fit(str(r), free, positive, F.coalesce(F.try_element_at("_times", F.lit(r)), F.lit(0)).cast("double"))
                              for r in range(1, reps + 1)])
    return [s.theta for s in found.values()]


def recency_weight(day, end, half_life):
    """Weight of a training day by age; normalise to mean one before fitting."""
    return F.pow(F.lit(0.5), F.datediff(end, day) / half_life)


def normalised_recency(rows: DataFrame, half_life) -> DataFrame:
    end = rows.agg(F.max("day").alias("d")).scalar()
    d = rows.withColumn("_end", end).withColumn("_w", recency_weight(F.col("day"), F.col("_end"), half_life))
    mean = d.agg(F.avg("_w").alias("m")).scalar()
    return d.withColumn("_mean", mean).withColumn("weight", F.col("_w") / F.col("_mean")).drop("_w", "_end", "_mean")


# ------------------------------------------------------------------ serving
def predict(evidence: DataFrame, hist: DataFrame, base: DataFrame, theta: DataFrame, families: DataFrame, gamma, phi,
            keys=("theatre", "day")) -> DataFrame:
    """Serve coefficients held as tables: theta (theatre, intercept, c1, c2, c3) and families (family, w, is_global).

    Contributions: top six of gamma * w * e / 5 per row, the global families merged into one line.
    """
    keys = list(keys)
    c = evidence.join(families, "family").withColumn("_c", F.col("w") * F.coalesce("e", F.lit(0.0)) / 5)
    lines = c.withColumn("line", F.when(F.col("is_global"), "world_tempo").otherwise(F.col("family")))
    lines = lines.groupBy(*keys, "line").agg(F.sum("_c").alias("_c"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_c"), "line")
    ranked = lines.withColumn("_r", F.row_number().over(w))
    agg = ranked.groupBy(*keys).agg(
        F.sum("_c").alias("_e"),
        F.array_sort(F.collect_list(F.when((F.col("_r") <= 6) & (F.col("_c") > 0),
                                           F.struct(F.col("_r").alias("r"), "line", F.round(gamma * F.col("_c"), 3).alias("c"))))).alias("_top"))
    d = hist.join(agg, keys, "left").join(theta, "theatre").join(base, "theatre")
    h = F.col("c1") * F.col("h1") + F.col("c2") * F.col("h3") + F.col("c3") * F.col("hs")
    raw = S.sigmoid(F.col("intercept") + h + F.coalesce("_e", F.lit(0.0)))
    p = F.least(F.lit(P_CAP), S.shrink(raw, F.col("base"), F.lit(gamma), F.lit(phi)))
    return d.select(*keys, raw.alias("raw"), "base", p.alias("p"), S.level(p).alias("level"), F.round(gamma * h, 3).alias("history"),
                    F.concat_ws(",", F.transform("_top", lambda t: t["line"])).alias("why"), (F.col("since") <= 30).alias("aftermath"))


def interval(replicates: DataFrame, keys, p="p") -> DataFrame:
    """5-95% band by index over replicate predictions (bounded by the number of refits)."""
    s = replicates.groupBy(*keys).agg(F.array_sort(F.collect_list(p)).alias("_a"))
    n = F.size("_a") - 1
    return s.select(*keys, F.get("_a", F.floor(0.05 * n).cast("int")).alias("lo"), F.get("_a", F.ceil(0.95 * n).cast("int")).alias("hi"))


def market_probability(markets: DataFrame, today, by=("theatre",)) -> DataFrame:
    """Volume-weighted log-odds mean of liquid markets on a 30-day horizon, recalibrated. markets: p, vol, end."""
    left = F.greatest(F.lit(1), F.datediff("end", today))
    m = markets.where((F.col("vol") >= MARKET_VOLUME) & (F.col("p") > 0.005) & (F.col("p") < 0.995))
    p30 = S.clip(F.when(left > 30, 1 - F.pow(1 - F.col("p"), 30.0 / left)).otherwise(F.col("p")), 0.005, 0.99)
    x = MARKET_CAL[0] + MARKET_CAL[1] * S.logit(p30)
    return m.groupBy(*by).agg(S.sigmoid(F.sum(x * F.col("vol")) / F.sum("vol")).alias("p_market"))


def blend(p, p_market):
    return F.when(p_market.isNull(), p).otherwise(S.sigmoid((1 - MARKET_WEIGHT) * S.logit(p) + MARKET_WEIGHT * S.logit(p_market)))


def global_view(per: DataFrame, clim, pooled, by=("day",)) -> DataFrame:
    """Chance of an event anywhere, 1 - prod(1 - p), and its level by the odds ratio against the climatological value."""
    g = per.groupBy(*by).agg((1 - F.product(1 - F.col("p"))).alias("p_any"))
    odds = lambda p: p / (1 - p)     # noqa: E731
    ratio = odds(F.col("p_any")) / (clim / (1 - clim))
    cuts = [(b / (1 - b)) / (pooled / (1 - pooled)) for b in S.BANDS]
    return g.withColumn("ratio", ratio).withColumn("level", F.when(F.col("ratio") < 1, "Normal").otherwise(S.level(F.col("ratio"), cuts)))


def platt(rows: DataFrame, slope=True, p="p", y="y"):
    """(shift, slope) of logit(q) = c + b logit(p) by maximum likelihood. The shift alone is a one-parameter Newton solve."""
    x = rows.select(F.col(y).cast("double").alias("label"), S.logit(F.col(p)).alias("x"))
    if slope:
        v = VectorAssembler(inputCols=["x"], outputCol="features").transform(x)
        m = LogisticRegression(maxIter=100, tol=1e-10, regParam=0.0, standardization=False).fit(v)
        return float(m.intercept), float(m.coefficients[0])
    u = sub_offset(x.withColumn("theatre", F.lit("all")), F.col("x"), label="label", ridge=0.0)
    return u.first()["u"], 1.0


def pooled(blocks):
    """Pools neighbouring blocks (sum, weight, end), in order, until their means rise. What two runs leave may be pooled again together."""
    out = []
    for s, n, end in blocks:
        while out and out[-1][0] * n >= s * out[-1][1]:
            before = out.pop()
            s, n = s + before[0], n + before[1]
        out.append((s, n, end))
    return out


def isotonic_steps(train: DataFrame, p="p", y="y") -> DataFrame:
    """Rising step function of y on p: upto (largest p of the step), q, n. Equal values of p are one cell.

    Cells are summed first, sorted by ranges of p, and pooled within each range; the ranges' blocks, which are far fewer than the cells, are
    pooled again in one more pass over rising groups of ranges until one is left. Pooling is the same in whatever order neighbours
    are merged, so this equals one pass over all cells.
    """
    cells = train.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).cast("double").alias("upto")).agg(
        F.sum(F.col(y).cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("n"))

    def pool(batches):
        import pyarrow as pa
        kept = []
        for b in batches:
            rows = zip(b.column("s").to_pylist(), b.column("n").to_pylist(), b.column("upto").to_pylist())
            kept = pooled([*kept, *rows])
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.float64()) for i in range(3)], ["s", "n", "upto"])
    out = stable(cells.repartitionByRange("upto").sortWithinPartitions("upto").select("s", "n", "upto").mapInArrow(pool, "s double, n double, upto double"))
    parts = out.rdd.getNumPartitions()
    while parts > 1:
        parts = (parts + 7) // 8
        out = stable(out.repartitionByRange(parts, "upto").sortWithinPartitions("upto").mapInArrow(pool, "s double, n double, upto double"))
    return out.select("upto", (F.col("s") / F.col("n")).alias("q"), "n")    # at the end one task holds the steps, no more than the distinct p


def isotonic(train: DataFrame, test: DataFrame, p="p", y="y") -> DataFrame:
    """The step function fitted on `train`, applied to `test` as `q`: the first step that reaches p, the last beyond all. Steps and
    rows meet in one ordered scan by p, so neither side is sent whole."""
    from tocsin.operators import ranking
    steps = stable(isotonic_steps(train, p, y))
    values = test.select(F.col(p).cast("double").alias("upto")).where("upto is not null").distinct()
    both = values.join(steps.select("upto", "q"), "upto", "full")
    s = ranking.ordered_scan(both, "upto", {"q": ("min", F.col("q"))}, reverse=True)     # q rises, so the nearest step above has the least q
    last = steps.agg(F.max_by("q", "upto")).scalar()
    at = s.select(F.col("upto").alias("_at"), F.coalesce(F.least("q", "q_before"), last).alias("q"))
    return test.withColumn("_p", F.col(p).cast("double")).join(at, F.col("_p") == F.col("_at"), "left").drop("_p", "_at")


def boosted(train: DataFrame, test: DataFrame, cols, rising=(), y="y", **settings) -> DataFrame:
    """Boosted-tree candidate whose prediction never falls in the `rising` columns, scored on `test` as `raw`."""
    from tocsin.operators import boosting
    return boosting.fit(train, cols, rising, y, **settings).predict(test)


def raw_probabilities(thetas):
    """Array of the probabilities under several coefficient sets of the same columns."""
    names = [c for c in thetas[0] if c != "intercept"]
    x = F.array(F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])
    sets = F.array(*[F.array(F.lit(t["intercept"]), *[F.lit(float(t[c])) for c in names]) for t in thetas])
    return F.transform(sets, lambda t: S.sigmoid(F.aggregate(F.zip_with(t, x, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)))
