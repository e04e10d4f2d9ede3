"""Study jobs built from the shared parts: candidate matching, applied levels, feed tables, weighting schemes, forward gates."""
from pyspark.sql import DataFrame, Window, functions as F

from tocsin.functions import geo, scoring as S
from tocsin.operators import evaluate as E, labels as L, model as M, pit, spatial as G
from tocsin.operators.lineage import stable


def thin_kept(cands: DataFrame, key="theatre", gap=30) -> DataFrame:
    """One candidate per key and `gap` days counted from the last one kept. The rule depends on what was kept before, so it is a
    fold over each key's distinct days in order."""
    days = cands.select(key, "day").distinct().groupBy(key).agg(F.array_sort(F.collect_list("day")).alias("a"))
    zero = F.struct(F.lit(None).cast("date").alias("last"), F.array().cast("array<date>").alias("kept"))
    def step(s, d):
        take = s["last"].isNull() | (F.datediff(d, s["last"]) > gap)
        return F.struct(F.when(take, d).otherwise(s["last"]).alias("last"), F.when(take, F.concat(s["kept"], F.array(d))).otherwise(s["kept"]).alias("kept"))
    return days.select(key, F.explode(F.aggregate("a", zero, step, lambda s: s["kept"])).alias("day"))


def match_candidates(cands: DataFrame, events: DataFrame, key="theatre", near=3, episode=30) -> DataFrame:
    """Candidates marked match (a listed event within `near` days), continuation (inside a listed event's episode) or extra."""
    around = L._around(events, key, -near, episode)
    off = F.datediff("day", "event_day")
    flag = around.withColumn("_m", F.abs(off) <= near).groupBy(key, "day").agg(F.bool_or("_m").alias("_m"))
    j = cands.select(key, "day").distinct().join(flag, [key, "day"], "left")
    j = stable(j.withColumn("kind", F.when(F.col("_m").isNull(), "extra").when(F.col("_m"), "match").otherwise("continuation")).drop("_m"))
    kept = thin_kept(j.where("kind = 'extra'"), key, episode).withColumn("kind", F.lit("extra"))
    return j.where("kind <> 'extra'").unionByName(kept)


def apply_levels(pred: DataFrame, log: DataFrame, composite_levels: DataFrame, held: DataFrame, bands=S.BANDS, days=7) -> DataFrame:
    """Alert level from the larger of today's (blended) probability and the last week's logged maximum; the composite level is
    kept beside it. Held sub-theatres keep only the composite level.

    pred: theatre, day, p, p_blend. log: theatre, day, p.
    """
    rel = log.select("theatre", F.col("p").alias("_lp"), F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", days - 1))).alias("day"))
    rel = rel.groupBy("theatre", "day").agg(F.max("_lp").alias("recent"))
    j = pred.join(rel, ["theatre", "day"], "left").join(composite_levels, "theatre", "left").join(held.withColumn("held", F.lit(True)), "theatre", "left")
    head = F.coalesce("p_blend", "p")
    alert = F.greatest(head, F.coalesce("recent", F.lit(0.0)))
    open_ = F.col("held").isNull()
    return j.select("theatre", "day", F.when(open_, alert).alias("p_alert"), F.when(open_, S.level(alert, bands)).otherwise(F.col("level_composite")).alias("level"),
                    "level_composite", (~open_).alias("held"))


def feed_table(ev: DataFrame, by="family", key="theatre", zmin=2.0) -> DataFrame:
    """Per feed: within-theatre AUC and that of the reversed reading, share of events with the trailing maximum at 2 or more the
    day before, false-alarm share, noise-to-signal. ev: by, key, day, e (signed), y, eid, rmax."""
    d = stable(ev)
    up = E.within_auc(d.withColumn("p", S.clip(F.col("e"), 0.0, 5.0)), key, by=[by]).select(by, F.col("within_auc").alias("auc"))
    dn = E.within_auc(d.withColumn("p", S.clip(-F.col("e"), 0.0, 5.0)), key, by=[by]).select(by, F.col("within_auc").alias("auc_reversed"))
    per = d.where("y = 1").groupBy(by, key, "eid").agg(F.max_by("rmax", "day").alias("_last"))
    hit = per.groupBy(by).agg(F.count(F.lit(1)).alias("events"), F.avg((F.coalesce("_last", F.lit(-9.0)) >= zmin).cast("double")).alias("hit"))
    fa = d.where("y = 0 and rmax is not null").groupBy(by).agg(F.avg((F.col("rmax") >= zmin).cast("double")).alias("false_alarm"))
    return hit.join(fa, by).join(up, by, "left").join(dn, by, "left").withColumn("nsr", F.try_divide(F.col("false_alarm"), F.col("hit")))


def case_detection(cases: DataFrame, det: DataFrame, settings, radius_km=3.0, size=0.05) -> DataFrame:
    """Per score setting: cases with a detection at or above it within the radius on the day, and detections flagged in all."""
    c = G.neighbours(cases.select("case_id", "day", F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), size, radius_km, "lat2", "lon2")
    near = G.in_cells(det, size).join(c, ["_ci", "_cj", "day"]).where(geo.flat_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= radius_km)
    best = near.groupBy("case_id").agg(F.max("score").alias("best"))
    caught = best.agg(*[F.count_if(F.col("best") >= s).alias(f"c{i}") for i, s in enumerate(settings)])
    flagged = det.agg(*[F.count_if(F.col("score") >= s).alias(f"f{i}") for i, s in enumerate(settings)])
    j = caught.withColumn("_1", F.lit(1)).join(flagged.withColumn("_1", F.lit(1)), "_1")
    return j.select(F.inline(F.array(*[F.struct(F.lit(float(s)).alias("setting"), F.col(f"c{i}").alias("caught"), F.col(f"f{i}").alias("flagged")) for i, s in enumerate(settings)])))


def sliding_skill(forward: DataFrame, length=365, step=90, key="theatre") -> DataFrame:
    """Skill and AUC of a forward record on sliding windows of matured days: window, n, skill, auc."""
    lo = forward.agg(F.min("day").alias("d")).scalar()
    d = forward.withColumn("_i", F.datediff("day", lo)).withColumn("window", F.explode(F.sequence(
        F.greatest(F.lit(0), F.ceil((F.col("_i") - length + 1) / step)).cast("int"), F.floor(F.col("_i") / step).cast("int"))))
    d = stable(d.drop("_i"))
    return E.skill(d, ["window"]).select("window", "n", "skill").join(E.auc(d, by=["window"]).select("window", "auc"), "window")


def flagged_months(months: DataFrame, key="theatre") -> DataFrame:
    """Flag rate in event months against calm months over all theatres, with the stratified test. months: key, flag, event.

    Without a calm month its rate is NaN and there is no p."""
    t = months.groupBy(key).agg(F.count_if(F.col("flag") & F.col("event")).alias("a"), F.count_if(F.col("flag") & ~F.col("event")).alias("b"),
                                F.count_if(~F.col("flag") & F.col("event")).alias("c"), F.count_if(~F.col("flag") & ~F.col("event")).alias("d"))
    t = stable(t)
    s = t.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"), F.sum("d").alias("d"))
    s = s.select((F.col("a") + F.col("c")).alias("n"), F.col("a").alias("k"), E.quotient(F.col("b"), F.col("b") + F.col("d")).alias("calm_rate"), F.lit(1).alias("_1"))
    from tocsin.functions import tails
    s = s.withColumn("p_value", F.when(~F.isnan("calm_rate"), tails.binomial_tail(F.col("k"), F.col("n"), F.col("calm_rate"))))
    return s.join(E.mantel_haenszel(t).withColumn("_1", F.lit(1)), "_1").drop("_1")


def combined_with_outside(panel: DataFrame, outside: DataFrame, key="theatre", lag=1) -> DataFrame:
    """Own and outside forecasts on the same days: AUC of each and of the sum of both in standard-deviation units."""
    o = pit.as_of(panel.select(key, "day"), pit.available(outside, lag), [key], cols=("value",))
    j = stable(panel.join(o.where("value is not null"), [key, "day"]))
    sd = j.agg(F.stddev_pop("p").alias("a"), F.stddev_pop("value").alias("b"))
    a, b = sd.select("a").scalar(), sd.select("b").scalar()
    long = j.withColumn("_sa", a).withColumn("_sb", b).select("y", F.inline(F.array(
        F.struct(F.lit("own").alias("source"), F.col("p").alias("score")), F.struct(F.lit("outside").alias("source"), F.col("value").cast("double").alias("score")),
        F.struct(F.lit("both").alias("source"), (F.col("p") / F.col("_sa") + F.col("value") / F.col("_sb")).alias("score")))))
    return E.auc(long, "score", "y", ["source"]).select("source", "auc", "positives", "negatives")


def group_members(ev: DataFrame, alias: DataFrame) -> DataFrame:
    """Theatres that are read as a group of boxes: the strongest member's evidence. alias: theatre, box."""
    return ev.withColumnRenamed("theatre", "box").join(alias, "box").groupBy("theatre", "day", "family").agg(F.max("e").alias("e"))


# ------------------------------------------------------------------ weighting schemes and training variants
SUPPORT_MOST = 20.0  # Fixed value: most that a family seen on few positive days is shrunk harder


def screening(rows: DataFrame, families, years, key="theatre") -> dict:
    """(year, family) -> within-theatre AUC and positive days of the training rows of each test year, in one pass: a row trains every year
    whose cut lies behind it."""
    cuts = F.array(*[F.struct(F.lit(yr).alias("year"), F.date_sub(F.lit(f"{yr}-01-01").cast("date"), M.EMBARGO).alias("cut")) for yr in years])
    train = rows.where("lab").withColumn("_t", F.explode(F.filter(cuts, lambda c: F.col("day") < c["cut"])))
    long = train.select(key, "y", F.col("_t.year").alias("year"), F.inline(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).alias("p"), F.col(f"seen_{f[2:]}").alias("seen"))
                                                                             for f in families])))
    long = stable(long.groupBy(key, "y", "year", "family", "p").agg(F.count(F.lit(1)).alias("_c"), F.count_if("seen").alias("_s")))
    auc = E.within_auc(long, key, by=["year", "family"], weight="_c")
    sup = long.where("y = 1").groupBy("year", "family").agg(F.sum("_s").alias("support"))
    got = sup.join(auc, ["year", "family"], "left").select("year", "family", "within_auc", "support").collect()       # one row per year and family
    return {(r["year"], r["family"]): (r["within_auc"] or 0.5, r["support"] or 0) for r in got}


def schemes(rows: DataFrame, offsets, history, families, lam, years, domains, key="theatre", coverage=30) -> DataFrame:
    """Out-of-sample forecasts of all test years under each weighting scheme: all, screened, equal, support, domain, auc, improper.

    screened and equal keep the families whose training AUC is above one half, support shrinks families with fewer positive days than the median
    harder, domain takes the mean of a domain's three strongest families, auc weighs families by their training AUC, improper is the plain mean of
    the families with at least `coverage` positive days. What is chosen for a year is chosen on its own training rows; a scheme's
    column is made per year and is 0 in the fits of the others."""
    skill = screening(rows, families, years, key)
    at = lambda yr, f: skill.get((yr, f), (0.5, 0))      # noqa: E731
    kept = {yr: [f for f in families if at(yr, f)[0] > 0.5] or list(families) for yr in years}
    cols, by = {}, {s: {} for s in ("screened", "equal", "support", "auc", "improper")}
    for yr in years:
        by["screened"][yr] = {f: lam for f in kept[yr]}
        sup = {f: max(at(yr, f)[1], 1) for f in families}
        mid = sorted(sup.values())
        mid = (mid[(len(mid) - 1) // 2] + mid[len(mid) // 2]) / 2
        by["support"][yr] = {f: lam * min(max(mid / sup[f], 1.0), SUPPORT_MOST) for f in families}
        cols[f"eq_{yr}"] = sum((F.col(f) for f in kept[yr]), F.lit(0.0)) / len(kept[yr]) ** 0.5
        w = {f: max(at(yr, f)[0] - 0.5, 0.0) * min(1.0, at(yr, f)[1] / 500) for f in families}
        cols[f"au_{yr}"] = sum((F.col(f) * (w[f] / max(sum(w.values()), 1e-9)) for f in families), F.lit(0.0))
        covered = [f for f in families if at(yr, f)[1] >= coverage] or list(families)
        cols[f"im_{yr}"] = sum((F.col(f) for f in covered), F.lit(0.0)) / len(covered)
        by["equal"][yr], by["auc"][yr], by["improper"][yr] = {f"eq_{yr}": lam}, {f"au_{yr}": lam}, {f"im_{yr}": lam}
    for dom, members in domains.items():
        cols[f"d_{dom}"] = S.mean(F.slice(F.sort_array(F.array(*[F.col(f) for f in members]), False), 1, 3))
    v = [M.Variant("all", tuple(history), {f: lam for f in families}), M.Variant("domain", tuple(history), {f"d_{d}": lam for d in domains})]
    v += [M.Variant(s, tuple(history), years_, by_year=True) for s, years_ in by.items()]
    return M.rolling_many(rows.withColumns(cols), v, offsets, years, key).withColumnRenamed("variant", "scheme")
