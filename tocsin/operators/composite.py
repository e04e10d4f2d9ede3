"""Composite index: items, redundancy groups, domain scores, theatre composite, calm-world thresholds, rollup.

Every step is grouped by the columns in `by` (a theatre, or a theatre and an as-of day), so a replay over many days is the
same plan with one more key.
"""
import math

from pyspark.sql import DataFrame, Window, functions as F

from tocsin.functions import scoring as S
from tocsin.operators.lineage import stable

# Fixed values of the published rule.
TOP_GROUPS, LONE, LATE_WEIGHT, CORR_MIN, FIRING = 6, 0.7, 0.25, 0.8, 2.0
PERCENTILES = (0.90, 0.95, 0.99)
DRAWS = 2000


def items(scored: DataFrame) -> DataFrame:
    """scored: z, direction, late -> one-sided z, cut to a quarter for late data; adds zfull, k, sign, both."""
    k = F.when(F.col("late"), LATE_WEIGHT).otherwise(1.0)
    full = S.one_sided(F.col("z"), F.col("direction"))
    return (scored.withColumn("zfull", full).withColumn("k", k).withColumn("ze", full * k)
            .withColumn("sign", F.when(F.col("direction") == "down", -1).otherwise(1))
            .withColumn("both", ~F.col("direction").isin("up", "down")))


def correlated_pairs(points: DataFrame, meta: DataFrame, last=31, group=("theatre", "domain", "kind")) -> DataFrame:
    """Pairs of series of one theatre, domain and kind whose signed recent changes correlate above 0.8 on 10 or more labels.

    points: series_id, day, value. meta: series_id, group..., sign. Each group is one theatre's catalogue entries for one
    domain and kind: it grows with the catalogue, never with the facts, and only its last `last` points are read.
    """
    w = Window.partitionBy("series_id")
    recent = points.withColumn("_r", F.row_number().over(w.orderBy(F.desc("day")))).where(F.col("_r") <= last)
    ch = recent.withColumn("ch", F.col("value") - F.lag("value").over(w.orderBy("day"))).where(F.col("ch").isNotNull())
    ch = ch.join(meta, "series_id").select(*group, "series_id", "day", (F.col("ch") * F.col("sign")).alias("ch"))
    b = ch.select(*group, "day", F.col("series_id").alias("other"), F.col("ch").alias("ch2"))
    p = ch.join(b, [*group, "day"]).where("series_id < other")
    return (p.groupBy(*group, "series_id", "other").agg(F.count(F.lit(1)).alias("n"), S.pearson("ch", "ch2").alias("r"))
            .where((F.col("n") >= 10) & (F.col("r") > CORR_MIN)))


def components(nodes: DataFrame, edges: DataFrame, node="series_id", other="other") -> DataFrame:
    """Smallest connected id per node. Labels spread along edges and are then followed one jump further, so a chain closes in
    logarithmic rounds; each round is checkpointed and the loop stops when nothing moves."""
    both = stable(edges.select(node, other).unionByName(edges.select(F.col(other).alias(node), F.col(node).alias(other))).distinct())
    labels = stable(nodes.select(node, F.col(node).alias("label")).distinct())
    while True:
        spread = both.join(labels.select(F.col(node).alias(other), F.col("label").alias("_l")), other).groupBy(node).agg(F.min("_l").alias("_l"))
        near = labels.join(spread, node, "left").select(node, "label", F.least("label", F.coalesce("_l", "label")).alias("_n"))
        jump = labels.select(F.col(node).alias("_n"), F.col("label").alias("_j"))
        nxt = stable(near.join(jump, "_n").select(node, F.col("label").alias("_was"), F.least("_n", "_j").alias("label")))
        moved = nxt.where("_was <> label").limit(1).count()
        labels = nxt.drop("_was")
        if not moved:
            return labels


def groups(its: DataFrame, labels: DataFrame, by=("theatre",)) -> DataFrame:
    """Mean z per redundancy group, its best series, and whether any member is fast / all are two-sided."""
    g = its.join(labels, "series_id")
    return g.groupBy(*by, "domain", F.col("label").alias("grp")).agg(
        F.avg("ze").alias("z"), F.round(F.avg("k"), 2).alias("k"), F.max_by("series_id", F.struct("ze", "series_id")).alias("best"),
        F.bool_or(~F.col("late")).alias("fast"), F.bool_and("both").alias("both"), F.count(F.lit(1)).alias("members"))


def _rank_weight(n, rank):
    """Weight of a rank among n, from the six fixed weight vectors."""
    table = F.array(*[F.array(*[F.lit(x) for x in S.ordered_weights(i)]) for i in range(1, TOP_GROUPS + 1)])
    return F.get(F.get(table, (n - 1).cast("int")), (rank - 1).cast("int"))


def ordered_average(rows: DataFrame, by, value="z", tie=()) -> DataFrame:
    """Ordered weighted average of the strongest six values; a lone value is shrunk."""
    w = Window.partitionBy(*by)
    r = rows.withColumn("_rank", F.row_number().over(w.orderBy(F.desc(value), *tie))).where(F.col("_rank") <= TOP_GROUPS)
    n = F.count(F.lit(1)).over(w)
    r = r.withColumn("_n", n).withColumn("_w", _rank_weight(F.col("_n"), F.col("_rank")))
    s = F.sum(F.col("_w") * F.col(value))
    return r.groupBy(*by).agg(F.when(F.max("_n") == 1, s * LONE).otherwise(s).alias("score"))


def domain_scores(grp: DataFrame, by=("theatre",)) -> DataFrame:
    """Domain score, group count, whether the leading group is fast, and the three strongest drivers."""
    keys = [*by, "domain"]
    sc = ordered_average(grp, keys, "z", ["grp"])
    order = F.struct((-F.col("z")).alias("a"), F.col("grp").alias("b"))
    side = grp.groupBy(*keys).agg(F.count(F.lit(1)).alias("groups"), F.sum("members").alias("n"), F.min_by("fast", order).alias("fast"),
                                  F.slice(F.array_sort(F.collect_list(F.struct((-F.col("z")).alias("nz"), "grp", "best"))), 1, 3).alias("_top"))
    return sc.join(side, keys).select(*keys, "score", "groups", "n", "fast", F.transform("_top", lambda t: t["best"]).alias("drivers"))


def composite(doms: DataFrame, weights: DataFrame, by=("theatre",)) -> DataFrame:
    """Weighted mean and imbalance of domain scores on a 100 +- 10 scale; NULL with fewer than two live domains.

    weights: (domain, weight), optionally with the `by` columns. Adds zc, index, imbalance, firing, contributions.
    """
    keys = [c for c in weights.columns if c in ("domain", *by)]
    d = doms.join(weights, keys).withColumn("_i", 100 + 10 * F.col("score"))
    w = Window.partitionBy(*by)
    tw = F.sum("weight").over(w)
    d = d.withColumn("_m", F.sum(F.col("weight") * F.col("_i")).over(w) / tw).withColumn("contrib", F.col("weight") / tw * F.col("score"))
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("live"), F.sum("weight").alias("weight_live"), F.max("_m").alias("mean"),
        F.sqrt(F.sum(F.col("weight") * F.pow(F.col("_i") - F.col("_m"), 2)) / F.sum("weight")).alias("imbalance"),
        F.array_sort(F.collect_list(F.when(F.col("score") >= FIRING, F.col("domain")))).alias("firing"),
        F.bool_or((F.col("score") >= FIRING) & F.col("fast")).alias("firing_fast"))
    mpi = F.col("mean") + F.col("imbalance") * F.col("imbalance") / F.col("mean")
    ok = F.col("live") >= 2
    return g.withColumn("index", F.when(ok, mpi)).withColumn("zc", F.when(ok, (mpi - 100) / 10))


def with_level(comp: DataFrame, lines: DataFrame, by=("theatre",)) -> DataFrame:
    """Level, 0-100 reading and basis from thresholds t_watch, t_elevated, t_critical (one row per theatre)."""
    c = comp.join(lines, [k for k in by if k in lines.columns], "left")
    reached = sum((F.when(F.col("zc") >= F.col(t), 1).otherwise(0) for t in ("t_watch", "t_elevated", "t_critical")), F.lit(0))
    names = F.array(*[F.lit(x) for x in S.LEVELS])
    c = c.withColumn("level", F.when(F.col("zc").isNull(), "insufficient data").otherwise(F.element_at(names, reached + 1)))
    c = c.withColumn("reading", F.when(F.col("zc").isNotNull(), S.logistic_reading(F.col("zc"), F.col("t_watch"), F.col("t_critical"))))
    basis = F.when(~F.col("level").isin("Elevated", "Critical"), "").when(F.col("firing_fast"), "leading and lagging").otherwise("lagging only")
    return c.withColumn("basis", basis)


def confidence(its: DataFrame, expected: DataFrame, comp: DataFrame, by=("theatre",)) -> DataFrame:
    """Weight covered x share of series scored x (1 - mean missing), and its label. expected: by..., total."""
    g = its.groupBy(*by).agg(F.count(F.lit(1)).alias("scored"), F.avg("miss").alias("_miss"))
    d = expected.join(g, list(by), "left").join(comp.select(*by, "weight_live"), list(by), "left")
    share = F.coalesce("scored", F.lit(0)) / F.col("total")
    missing = F.round(1 - share, 3)
    conf = F.coalesce(F.col("weight_live"), F.lit(0.0)) * share * (1 - F.coalesce("_miss", F.lit(0.0)))
    return d.select(*by, F.round(conf, 3).alias("confidence"), missing.alias("missing"),
                    F.when(missing > 0.2, "Low").when(missing > 0.1, "Medium").otherwise("High").alias("label"))


def _calm_draw(*key):
    """One repeatable calm-world z: a unit-variance normal mixture, a tenth of the draws twice as wide."""
    def u(salt):
        return (F.pmod(F.xxhash64(*key, F.lit(salt)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))
    return normal * F.when(u(3) < 0.1, 2.0).otherwise(1.0) / math.sqrt(1.3)


def _table_draw(table, *key):
    """A draw from measured quantiles, linearly interpolated."""
    u = (F.pmod(F.xxhash64(*key, F.lit(1)), F.lit(1 << 30)) + 0.5) / float(1 << 30) * (len(table) - 1)
    arr, i = F.array(*[F.lit(float(x)) for x in table]), F.floor(u).cast("int")
    lo = F.get(arr, i)
    return lo + (u - i) * (F.get(arr, F.least(i + 1, F.lit(len(table) - 1))) - lo)


def thresholds(grp: DataFrame, weights: DataFrame, by=("theatre",), draws=DRAWS, seed=20261007, quantiles=None) -> DataFrame:
    """Calm-world lines per theatre: draw every group's z, score the theatre, take the 90 / 95 / 99th of the index.

    Work is draws x live groups per distinct shape; theatres of one shape share the simulation.
    """
    shape_of = grp.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("domain", "both", "k"))).alias("parts"))
    shape_of = stable(shape_of.withColumn("shape", F.xxhash64("parts")))
    shapes = shape_of.groupBy("shape").agg(F.first("parts").alias("parts"))
    d = shapes.select("shape", "parts", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    d = d.select("shape", "draw", F.posexplode("parts").alias("slot", "part")).select("shape", "draw", "slot", "part.*")
    # draws are keyed by domain make-up, so equal domains of different shapes see the same world
    key = ("domain", "both", "k", "slot", "draw", F.lit(seed))
    z = S.clip(_table_draw(quantiles, *key) if quantiles else _calm_draw(*key), -S.WINSOR, S.WINSOR) * F.col("k")
    d = d.withColumn("z", F.when(F.col("both"), F.abs(z)).otherwise(F.greatest(z, F.lit(0.0))))
    sc = ordered_average(d, ["shape", "draw", "domain"], "z", ["slot"])
    c = composite(sc.withColumn("fast", F.lit(True)), weights.select("domain", "weight"), by=("shape", "draw")).where("zc is not null")
    q = c.groupBy("shape").agg(F.array_sort(F.collect_list("zc")).alias("_z"))      # bounded by the number of draws
    at = [F.get("_z", F.least(F.size("_z") - 1, F.floor(F.lit(p) * F.size("_z")).cast("int"))) for p in PERCENTILES]
    q = q.select("shape", at[0].alias("t_watch"), at[1].alias("t_elevated"), at[2].alias("t_critical"), F.col("_z").alias("calm"))
    return shape_of.select(*by, "shape").join(q, "shape").drop("shape")


def calm_percentile(comp: DataFrame, lines: DataFrame, by=("theatre",)) -> DataFrame:
    """Share of the calm world below the reading, in percent."""
    c = comp.join(lines, list(by))
    below = F.size(F.filter("calm", lambda x: x < F.col("zc")))
    return c.select(*by, F.round(100 * below / F.size("calm"), 1).alias("pctl"))


def _mpi_plain(m, sd):
    return m + sd * sd / m


def rollup(theatres: DataFrame, region="region", by=()) -> DataFrame:
    """Region: worst level, best reading, index of the children, lead child. theatres: theatre, region, level, reading, zc."""
    rank = F.array_position(F.array(*[F.lit(x) for x in S.LEVELS]), F.col("level"))
    t = theatres.where(F.col("reading").isNotNull()).withColumn("_rank", rank)
    g = t.groupBy(*by, region).agg(
        F.max(F.struct("_rank", "reading", "theatre", "level")).alias("_top"), F.max("reading").alias("reading"),
        F.avg(100 + 10 * F.col("zc")).alias("_m"), F.stddev_pop(100 + 10 * F.col("zc")).alias("_s"), F.count(F.lit(1)).alias("children"))
    return g.select(*by, region, F.col("_top.level").alias("level"), "reading", _mpi_plain(F.col("_m"), F.col("_s")).alias("index"),
                    F.col("_top.theatre").alias("lead"), "children")


def world(regions: DataFrame, region="region", by=()) -> DataFrame:
    """World reading: min(100, m + sd^2 / m) of the region readings; worst level; regions per level."""
    rank = F.array_position(F.array(*[F.lit(x) for x in S.LEVELS]), F.col("level"))
    r = regions.withColumn("_rank", rank)
    g = r.groupBy(*by).agg(F.avg("reading").alias("_m"), F.stddev_pop("reading").alias("_s"),
                           F.max(F.struct("_rank", "reading", region, "level")).alias("_top"),
                           *[F.count_if(F.col("level") == x).alias(f"n_{x.lower()}") for x in S.LEVELS])
    gti = F.when(F.col("_m") == 0, 0.0).otherwise(F.least(F.lit(100.0), _mpi_plain(F.col("_m"), F.col("_s"))))
    return g.select(*by, gti.alias("reading"), F.col("_top.level").alias("level"), F.col(f"_top.{region}").alias("lead"),
                    *[f"n_{x.lower()}" for x in S.LEVELS])


def legacy_level(its: DataFrame, by=("theatre",), signal=3.0, watch=2.0) -> DataFrame:
    """The older level: domain score is the mean of its two strongest readings (a lone one x 0.7); levels count domains."""
    w = Window.partitionBy(*by, "domain").orderBy(F.desc("zdir"), "series_id")
    d = its.withColumn("zdir", S.directed(F.col("z"), F.col("direction"))).withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    dom = d.groupBy(*by, "domain").agg(F.when(F.count(F.lit(1)) == 2, F.avg("zdir")).otherwise(F.max("zdir") * LONE).alias("zd"),
                                       F.max(F.when(F.col("_r") == 1, ~F.col("late"))).alias("fast"))
    g = dom.groupBy(*by).agg(F.count(F.lit(1)).alias("live"), F.count_if(F.col("zd") >= signal).alias("signals"),
                             F.count_if(F.col("zd") >= watch).alias("watching"), F.bool_or((F.col("zd") >= signal) & F.col("fast")).alias("_f"))
    lv = (F.when(F.col("live") < 2, "insufficient data").when(F.col("signals") >= 3, "Alert").when(F.col("signals") == 2, "Warning")
          .when((F.col("signals") == 1) | (F.col("watching") >= 2), "Watch").otherwise("Normal"))
    g = g.withColumn("level", lv)
    return g.withColumn("basis", F.when(~F.col("level").isin("Warning", "Alert"), "").when(F.col("_f"), "leading and lagging").otherwise("lagging only")).drop("_f")


def _array_composite(doms):
    """zc of an array of (domain, score, weight); NULL with fewer than two."""
    total = F.aggregate(doms, F.lit(0.0), lambda n, d: n + d["weight"])
    mean = F.aggregate(doms, F.lit(0.0), lambda n, d: n + d["weight"] * (100 + 10 * d["score"])) / total
    var = F.aggregate(doms, F.lit(0.0), lambda n, d: n + d["weight"] * F.pow(100 + 10 * d["score"] - mean, 2)) / total
    return F.when(F.size(doms) >= 2, (mean + var / mean - 100) / 10)


def sensitivity(its: DataFrame, labels: DataFrame, weights: DataFrame, key="theatre") -> DataFrame:
    """The composite without each signal and without each domain: theatre, kind, dropped, zc (that of all where too little is left), change, rho.

    A signal that goes takes its share out of its redundancy group's mean, or the group with it; the ordered average of its domain is made again from the
    seven strongest groups, of which six count, so nothing is scored twice. rho is the Spearman correlation of the ranking of all theatres before and after: one
    theatre that moves k places costs 6 k (k + 1) / (n (n^2 - 1)). Redundancy groups stay as found.
    """
    m = stable(its.join(labels, "series_id").select(key, "domain", F.col("label").alias("grp"), "series_id", "ze"))
    g = m.groupBy(key, "domain", "grp").agg(F.sum("ze").alias("_s"), F.count(F.lit(1)).alias("_n"))
    g = stable(g.withColumn("z", F.col("_s") / F.col("_n")))
    entry = lambda z, grp: F.struct((-z).alias("nz"), grp.alias("grp"))      # noqa: E731
    table = F.array(*[F.array(*[F.lit(x) for x in S.ordered_weights(i)]) for i in range(1, TOP_GROUPS + 1)])

    def average(top):
        six = F.slice(top, 1, TOP_GROUPS)
        w = F.get(table, F.size(six) - 1)
        s = F.aggregate(F.transform(six, lambda x, i: -x["nz"] * F.get(w, i)), F.lit(0.0), lambda a, x: a + x)
        return F.when(F.size(six) == 0, None).when(F.size(six) == 1, s * LONE).otherwise(s)
    tops = g.groupBy(key, "domain").agg(F.slice(F.array_sort(F.collect_list(entry(F.col("z"), F.col("grp")))), 1, TOP_GROUPS + 1).alias("top"))
    tops = stable(tops.join(weights, "domain").withColumn("score", average(F.col("top"))))
    doms = tops.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("domain", "score", "weight"))).alias("doms"))
    full = stable(doms.withColumn("full", _array_composite(F.col("doms"))).where("full is not null"))
    ranking = full.agg(F.array_sort(F.collect_list(F.struct(F.col("full").alias("z"), F.col(key).alias("k")))).alias("r")).scalar()      # one number a theatre

    signals = m.join(g.select(key, "domain", "grp", "_s", "_n"), [key, "domain", "grp"]).join(tops.select(key, "domain", "top"), [key, "domain"]).join(full, key)
    others = F.filter("top", lambda x: x["grp"] != F.col("grp"))
    left = F.when(F.col("_n") > 1, F.array(entry((F.col("_s") - F.col("ze")) / (F.col("_n") - 1), F.col("grp")))).otherwise(F.array().cast("array<struct<nz:double,grp:string>>"))
    signals = signals.withColumn("_score", average(F.array_sort(F.concat(others, left))))
    swapped = F.filter(F.transform("doms", lambda d: F.when(d["domain"] == F.col("domain"), F.struct(d["domain"].alias("domain"), F.col("_score").alias("score"), d["weight"].alias("weight"))).otherwise(d)),
                       lambda d: d["score"].isNotNull())
    a = signals.select(key, F.lit("signal").alias("kind"), F.col("series_id").alias("dropped"), "full", swapped.alias("doms"))
    b = full.select(key, "full", "doms", F.explode(F.transform("doms", lambda d: d["domain"])).alias("dropped")).select(
        key, F.lit("domain").alias("kind"), "dropped", "full", F.filter("doms", lambda d: d["domain"] != F.col("dropped")).alias("doms"))
    out = a.unionByName(b).withColumn("zc", F.coalesce(_array_composite(F.col("doms")), "full")).withColumn("_r", ranking)
    place = lambda z: F.size(F.filter("_r", lambda x: (x["k"] != F.col(key)) & ((x["z"] < z) | ((x["z"] == z) & (x["k"] < F.col(key))))))      # noqa: E731
    k, n = F.abs(place(F.col("zc")) - place(F.col("full"))).cast("double"), F.size("_r").cast("double")
    rho = F.when(n > 2, 1 - 6 * k * (k + 1) / (n * (n * n - 1))).otherwise(1.0)
    return out.select(key, "kind", "dropped", "zc", (F.col("zc") - F.col("full")).alias("change"), rho.alias("rho"))


def compute_composite_score(points: DataFrame, metrics: DataFrame, weights: DataFrame, base_days=None) -> DataFrame:
    """Stand-alone entry: points (series_id, day, value), metrics (series_id, domain, direction, late, kind), weights (domain,
    weight) -> one composite row with level and reading."""
    from tocsin.operators import robust
    sc = robust.score_daily(points, base_days=base_days, newest_only=True).join(metrics, "series_id")
    its = stable(items(sc.withColumn("theatre", F.lit("portfolio"))))
    meta = its.select("series_id", "theatre", "domain", "kind", "sign")
    g = stable(groups(its, components(its, correlated_pairs(points, meta))))
    return with_level(composite(domain_scores(g), weights), thresholds(g, weights))


def strike_package(classes: DataFrame, by, kind="kind", value="value") -> DataFrame:
    """Sum over classes times the number of classes present."""
    return classes.groupBy(*by).agg((F.sum(value) * F.count_if(F.col(value) > 0)).alias("index"))


# Fixed weights of the activity index.
ACTIVITY = {"adsb_fighter": 2.51, "wiki": 0.816, "gdelt_accel": 0.628, "tells": 0.375, "adsb_tanker": 0.351, "base": 0.049}


def activity_index(flags: DataFrame, weights: DataFrame, least, by=("theatre",)) -> DataFrame:
    """flags: by..., family, on (NULL = missing). Weight share of the families that are on, and the missing ones.

    `least` is the smallest family's weight: the index is active when any family at all is on.
    """
    f = flags.join(weights, "family")
    g = f.groupBy(*by).agg(F.sum(F.when(F.col("on"), F.col("weight")).otherwise(0.0)).alias("_w"), F.sum("weight").alias("_t"),
                           F.array_sort(F.collect_list(F.when(F.col("on").isNull(), F.col("family")))).alias("missing"))
    return g.select(*by, F.round(100 * F.col("_w") / F.col("_t"), 1).alias("index"),
                    (F.col("_w") >= F.lit(least) - 1e-9).alias("active"), "missing")
