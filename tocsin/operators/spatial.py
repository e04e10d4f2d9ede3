"""Spatial joins on grids, heat-detection classing against an archive, scene scoring and site states."""
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tocsin.functions import geo, scoring as S


def in_boxes(points: DataFrame, boxes: DataFrame, lat="lat", lon="lon") -> DataFrame:
    """Every (point, box) match. The side of the boxes is broadcast by the caller if it is a fixed list."""
    return points.join(boxes, F.col(lat).between(F.col("lat_min"), F.col("lat_max")) & F.col(lon).between(F.col("lon_min"), F.col("lon_max")))


def first_box(points: DataFrame, boxes: list[tuple], lat="lat", lon="lon") -> DataFrame:
    """The first matching box by priority, NULL when none. boxes: (box, priority, lat_min, lat_max, lon_min, lon_max), a fixed list, so it is one
    expression on each row: no join, no shuffle, and rows that repeat stay as they are."""
    inside = [F.when(geo.in_box(F.col(lat), F.col(lon), *bounds), box) for box, _, *bounds in sorted(boxes, key=lambda b: b[1])]
    return points.withColumn("box", F.coalesce(*inside, F.lit(None).cast("string")))


def box_quality(cells: DataFrame, boxes: DataFrame, good: Column, value="value") -> DataFrame:
    """Per box and day: n cells, the mean of the good ones (NULL without any) and their share. Cells in several boxes count in each."""
    g = in_boxes(cells.withColumn("_good", F.coalesce(good, F.lit(False))), boxes).groupBy("box", "day")
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("_good"), F.col(value))).alias("good_mean"), F.avg(F.col("_good").cast("int")).alias("good_share"))


def neighbours(df: DataFrame, size, radius_km, lat="lat", lon="lon") -> DataFrame:
    """Each row copied to every grid cell that its radius can reach, as join keys _ci, _cj.

    Degrees of longitude shrink with the cosine of the latitude, taken at the poleward edge of the reach; cells close round the globe.
    The planner's size of the result leaves out the copies, so it is never broadcast: the hint asks for a sort-merge join."""
    ring = round(360 / size)
    edge = F.abs(F.col(lat)) + radius_km / geo.KM_PER_DEGREE
    wide = F.when(edge >= 89.9, ring).otherwise(F.ceil(radius_km / (geo.KM_PER_DEGREE * size * F.cos(F.radians(edge)))))
    reach = F.least(wide, F.lit((ring - 1) // 2)).cast("int")
    up = math.ceil(radius_km / (geo.KM_PER_DEGREE * size))
    return (df.withColumn("_a", F.explode(F.sequence(F.lit(-up), F.lit(up)))).withColumn("_b", F.explode(F.sequence(-reach, reach)))
            .withColumn("_ci", geo.cell(F.col(lat), size) + F.col("_a")).withColumn("_cj", geo.ring_cell(F.col(lon), size, F.col("_b"))).drop("_a", "_b").hint("merge"))


def in_cells(df: DataFrame, size, lat="lat", lon="lon") -> DataFrame:
    """Each row with its own cell, to meet `neighbours`."""
    return df.withColumn("_ci", geo.cell(F.col(lat), size)).withColumn("_cj", geo.ring_cell(F.col(lon), size))


def nearest(points: DataFrame, sites: DataFrame, key, radius_km, size, tie="site_id") -> DataFrame:
    """Nearest site within `radius_km` of each point (left join), at any latitude.

    Sites of one place count as the one of smallest `tie`, and points of one place share their answer, whatever their `key`: distinct places meet
    on cells, to which the sites are copied, so copies on either side never multiply."""
    spots = sites.groupBy(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")).agg(F.min(tie).alias(tie))
    places = in_cells(points.select("lat", "lon").distinct(), size)
    j = places.join(neighbours(spots, size, radius_km, "s_lat", "s_lon"), ["_ci", "_cj"]).withColumn("km", geo.flat_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")))
    best = j.where(F.col("km") <= radius_km).groupBy("lat", "lon").agg(F.min(F.struct("km", tie)).alias("_b"))
    return points.join(best, ["lat", "lon"], "left").select(*points.columns, F.col(f"_b.{tie}").alias(tie), F.col("_b.km").alias("km"))


def heading_base(tracks: DataFrame, bases, within=20, least_nm=25, most_nm=1400) -> DataFrame:
    """Nearest base of a fixed list of (base, lat, lon) that lies within `within` degrees of the track, by great circle."""
    lat, lon = F.col("lat"), F.col("lon")

    def one(base, b_lat, b_lon):
        nm = geo.haversine(lat, lon, F.lit(b_lat), F.lit(b_lon), geo.EARTH_NM)
        off = F.abs(geo.turn(geo.bearing(lat, lon, F.lit(b_lat), F.lit(b_lon)), F.col("track")))
        return F.when(nm.between(least_nm, most_nm) & (off <= within), F.struct(nm.alias("nm"), F.lit(base).alias("base")))
    best = F.array_min(F.array_compact(F.array(*[one(*b) for b in bases])))
    return tracks.withColumn("_b", best).select(*tracks.columns, "_b.base", "_b.nm")


def same_pass_counts(points: DataFrame, key, pass_col="pass_id", radius_km=2.0, size=0.02) -> DataFrame:
    """Detections of the same pass within the radius of each one, itself included.

    Positions are reduced to distinct places with a count first, so copies of one place never pair with each other.
    """
    places = points.groupBy(pass_col, "lat", "lon").agg(F.count(F.lit(1)).alias("_k"))
    b = neighbours(places.select(pass_col, F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("_k").alias("_k2")), size, radius_km, "lat2", "lon2")
    near = in_cells(places, size).join(b, [pass_col, "_ci", "_cj"]).where(geo.flat_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= radius_km)
    n = near.groupBy(pass_col, "lat", "lon").agg(F.sum("_k2").alias("near_n"))
    return points.join(n, [pass_col, "lat", "lon"])


def near_listed(points: DataFrame, listed: DataFrame, key, radius_km=1.0, days=1, size=0.05) -> DataFrame:
    """Flag points within the radius and `days` of a listed one (second opinion)."""
    l = neighbours(listed.select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("day").alias("day2")), size, radius_km, "lat2", "lon2")
    l = l.withColumn("day", F.explode(F.sequence(F.date_sub("day2", days), F.date_add("day2", days))))
    hit = in_cells(points, size).join(l, ["_ci", "_cj", "day"]).where(geo.flat_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= radius_km)
    return points.join(hit.select(key).distinct().withColumn("listed", F.lit(True)), key, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


# ------------------------------------------------------------------ archive reference of heat detections
FIRST_YEAR = 2012


def archive_cells(det: DataFrame) -> DataFrame:
    """Per fine cell: days burned per year (map), year bit mask, type counts, power quantile and maximum, detections-per-day 95th."""
    d = det.withColumn("i", geo.fine_cell(F.col("lat"))).withColumn("j", geo.fine_cell(F.col("lon")))
    per_year = d.groupBy("i", "j", F.year("day").alias("yr")).agg(F.count_distinct("day").alias("days"))
    years = per_year.groupBy("i", "j").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("yr", "days")))).alias("days"),
                                           F.expr(f"bit_or(shiftleft(1, yr - {FIRST_YEAR}))").alias("year_mask"))
    per_day = d.groupBy("i", "j", "day").agg(F.count(F.lit(1)).alias("_n"))
    dens = per_day.groupBy("i", "j").agg(F.percentile("_n", 0.95).alias("n95"), F.max("day").alias("last"))
    power = d.groupBy("i", "j").agg(F.percentile("frp", 0.95).alias("frp95"), F.max("frp").alias("frpmax"),
                                    *[F.count_if(F.col("type") == t).alias(f"t{t}") for t in (1, 2, 3)])
    return years.join(dens, ["i", "j"]).join(power, ["i", "j"])


def archive_months(det: DataFrame, static_days=60) -> DataFrame:
    """Per coarse cell and year: bit mask of the months with fires, leaving out cells that burn most days or carry a source type."""
    d = det.withColumn("i", geo.fine_cell(F.col("lat"))).withColumn("j", geo.fine_cell(F.col("lon"))).withColumn("yr", F.year("day"))
    d = d.withColumn("ci", geo.fine_cell(F.col("lat"), 0.1)).withColumn("cj", geo.fine_cell(F.col("lon"), 0.1))
    cell = d.groupBy("i", "j", "yr").agg(F.count_distinct("day").alias("_days"), F.max(F.col("type").isin(1, 2, 3).cast("int")).alias("_typed"),
                                         F.min(F.struct("ci", "cj")).alias("_c"), F.expr("bit_or(shiftleft(1, month(day) - 1))").alias("m"))
    keep = cell.where((F.col("_days") < static_days) & (F.col("_typed") == 0))
    return keep.groupBy(F.col("_c.ci").alias("ci"), F.col("_c.cj").alias("cj"), "yr").agg(F.bit_or("m").alias("months"))


def season_bits(day):
    """The day's month and a neighbouring month within ten days of the boundary, as bits."""
    m = F.month(day)
    own = F.pow(F.lit(2), m - 1)
    before = F.when(F.dayofmonth(day) <= 10, F.pow(F.lit(2), F.pmod(m - 2, F.lit(12)))).otherwise(0)
    after = F.when(F.dayofmonth(day) > F.dayofmonth(F.last_day(day)) - 10, F.pow(F.lit(2), F.pmod(m, F.lit(12)))).otherwise(0)
    return (own + before + after).cast("int")


# Fixed weights and cuts of the published score.
SCORE = {"base": 30, "novel": 20, "rare": 10, "site": 30, "sensitive": 25, "frp50": 10, "frp200": 10, "cluster": 10, "night": 5, "season": -15}
ANOMALY_AT, SEASON_P, RARE_P, SPOT_YEARS, USUAL_DAYS = 60, 0.4, 0.1, 3, 5


def classify(f: DataFrame) -> DataFrame:
    """Class and score 0..100 from joined features: volcano, offshore, stat (static source), ind (listed plant, always_lit),
    usual_days, frp95, n95, sens, sp (seasonal share), spot_years, frp, night, near_n, has_ref."""
    usual = F.col("stat") | (F.col("usual_days") >= USUAL_DAYS) | F.coalesce("always_lit", F.lit(False))
    site = F.col("ind") & ~usual
    plant = F.col("stat") | (F.col("ind") & usual)
    hotter = F.when(F.col("has_ref"), (F.col("frp") >= F.greatest(3 * F.col("frp95"), F.col("frp95") + 100)) | (F.col("near_n") >= 3 * F.col("n95") + 3)
                    ).otherwise(F.col("frp") >= 300)
    season = (F.coalesce(F.col("sp") >= SEASON_P, F.lit(False)) & (F.col("spot_years").isNull() | (F.col("spot_years") >= SPOT_YEARS))
              & ~F.col("sens") & ~site & (F.col("frp") < 100))
    def add(cond, k):
        return F.when(F.coalesce(cond, F.lit(False)), SCORE[k]).otherwise(0)
    score = (F.lit(SCORE["base"]) + add(F.col("spot_years") == 0, "novel") + add(F.col("sp") < RARE_P, "rare")
             + F.when(site, SCORE["site"]).when(F.col("sens"), SCORE["sensitive"]).otherwise(0)
             + add(F.col("frp") >= 50, "frp50") + add(F.col("frp") >= 200, "frp200") + add(F.col("near_n") >= 3, "cluster")
             + add(F.col("night"), "night") + add((F.col("sp") >= SEASON_P) & ~site, "season"))
    score = F.least(F.greatest(score, F.lit(0)), F.lit(100))
    cls = (F.when(F.col("volcano"), "volc").when(F.col("offshore"), "off").when(plant & hotter, "hot").when(plant, "ind")
           .when(season, "seas").when(score >= ANOMALY_AT, "anom").otherwise("unex"))
    fixed = F.when(cls.isin("volc", "off"), 5).when(cls == "hot", 75).when(cls == "ind", 10).when(cls == "seas", 15).otherwise(score)
    return f.withColumn("cls", cls).withColumn("score", fixed.cast("int"))


def detection_features(det: DataFrame, cells: DataFrame, months: DataFrame, sites: DataFrame, key="det_id") -> DataFrame:
    """Join each detection to the archive around it (3 x 3 fine cells, 3 x 3 coarse cells) and to listed sites.

    The archive side is copied to the neighbouring cells; only years before the detection's own are read.
    """
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    d = det.withColumn("i", geo.fine_cell(F.col("lat"))).withColumn("j", geo.fine_cell(F.col("lon"))).withColumn("yr", F.year("day"))
    d = d.withColumn("ci", geo.fine_cell(F.col("lat"), 0.1)).withColumn("cj", geo.fine_cell(F.col("lon"), 0.1)).withColumn("bits", season_bits(F.col("day")))
    c = cells.withColumn("_n", F.explode(near)).withColumn("i", F.col("i") + F.col("_n.a")).withColumn("j", F.col("j") + F.col("_n.b")).drop("_n").hint("merge")
    asks = d.select("i", "j", "yr").distinct().join(c, ["i", "j"])
    def days_in(lo, hi):
        return F.aggregate(F.filter(F.map_entries("days"), lambda e: (e["key"] >= F.col("yr") - lo) & (e["key"] < F.col("yr") - hi)),
                           F.lit(0).cast("bigint"), lambda s, e: s + e["value"])
    persistent = F.size(F.filter(F.map_entries("days"), lambda e: (e["key"] >= F.col("yr") - 5) & (e["key"] < F.col("yr")) & (e["value"] >= 60))) >= 2
    past_mask = F.expr(f"year_mask & (shiftleft(1, greatest(yr - {FIRST_YEAR}, 0)) - 1)")
    asks = asks.withColumn("_p", persistent).withColumn("_stat", (F.col("t2") >= 5) | F.col("_p")).withColumn("_u", days_in(3, 0)).withColumn("_m", past_mask)
    ref = asks.groupBy("i", "j", "yr").agg(
        F.max(F.col("t1") >= 3).alias("volcano"), F.max((F.col("t3") >= 3) & (F.col("t3") > F.col("t2")) & F.col("_p")).alias("offshore"),
        F.max("_stat").alias("stat"), F.max("_u").alias("usual_days"),
        F.coalesce(F.max(F.when(F.col("_stat"), F.col("frp95"))), F.max("frp95")).alias("frp95"),
        F.coalesce(F.max(F.when(F.col("_stat"), F.col("n95"))), F.max("n95")).alias("n95"), F.bit_count(F.bit_or("_m")).alias("spot_years"))
    m = months.withColumn("_n", F.explode(near)).withColumn("ci", F.col("ci") + F.col("_n.a")).withColumn("cj", F.col("cj") + F.col("_n.b")).drop("_n")
    m = m.groupBy("ci", "cj", F.col("yr").alias("y0")).agg(F.bit_or("months").alias("months")).hint("merge")
    seas = d.select("ci", "cj", "yr", "bits").distinct().join(m, ["ci", "cj"]).where("y0 < yr")
    seas = seas.groupBy("ci", "cj", "yr", "bits").agg(F.count_if(F.expr("(months & bits) <> 0")).alias("_hit"))
    span = months.agg(F.min("yr").alias("a")).scalar()
    d = d.withColumn("_first", span).withColumn("_ys", F.col("yr") - F.col("_first"))
    out = d.join(ref, ["i", "j", "yr"], "left").join(seas, ["ci", "cj", "yr", "bits"], "left")
    out = out.withColumn("sp", F.when(F.col("_ys") >= 4, F.coalesce("_hit", F.lit(0)) / F.col("_ys"))).withColumn("has_ref", F.col("stat").isNotNull())
    for b in ("volcano", "offshore", "stat"):
        out = out.withColumn(b, F.coalesce(b, F.lit(False)))
    out = out.withColumn("usual_days", F.coalesce("usual_days", F.lit(0))).withColumn("frp95", F.coalesce("frp95", F.lit(0.0))).withColumn(
        "n95", F.coalesce("n95", F.lit(0.0))).withColumn("spot_years", F.coalesce("spot_years", F.lit(0)))
    out = nearest(out, sites.where("kind = 'industrial'"), key, 1.0, 0.05).withColumn("ind", F.col("site_id").isNotNull()).drop("site_id", "km")
    out = nearest(out, sites.where("kind = 'sensitive'"), key, 2.0, 0.05).withColumn("sens", F.col("site_id").isNotNull()).drop("site_id", "km")
    return out.withColumn("always_lit", F.lit(False))


def routine_cells(det: DataFrame, key="det_id", size=0.01, need=3) -> DataFrame:
    """Fallback rule: a detection is routine when its 3 x 3 cell block burned on three or more dates."""
    d = det.withColumn("_ci", geo.cell(F.col("lat"), size)).withColumn("_cj", geo.cell(F.col("lon"), size))
    per = d.select("_ci", "_cj", "day").distinct()
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    n = per.withColumn("_n", F.explode(near)).select((F.col("_ci") + F.col("_n.a")).alias("_ci"), (F.col("_cj") + F.col("_n.b")).alias("_cj"), "day")
    n = n.groupBy("_ci", "_cj").agg(F.count_distinct("day").alias("dates"))
    return d.join(n, ["_ci", "_cj"]).withColumn("routine", F.col("dates") >= need).drop("_ci", "_cj")


def cluster_day(det: DataFrame, key="det_id", radius_km=2.0) -> DataFrame:
    """Greedy clusters by score within a box and day (`greedy.near_clusters`)."""
    from tocsin.operators import greedy
    return greedy.near_clusters(det, key, radius_km)


def merge_points(points: DataFrame, cell=0.01) -> DataFrame:
    """Nearby points merged into one site: mean position per cell block, kept when five or more or any fuel-tagged."""
    g = points.groupBy(geo.cell(F.col("lat"), cell).alias("ci"), geo.cell(F.col("lon"), cell).alias("cj")).agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("n"), F.bool_or("fuel").alias("fuel"))
    return g.where((F.col("n") >= 5) | F.col("fuel"))


def review_overlay(det: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Class and score after an image check joined on the cluster: verdict in scar / none / unclear, land cover lc."""
    j = det.join(verdicts, "cid", "left")
    open_ = F.col("cls").isin("anom", "unex")
    field = (F.col("verdict") == "scar") & (F.col("lc") == "cropland") & open_
    water = (F.col("lc") == "water") & F.col("verdict").isin("none", "unclear") & open_
    sc = (F.when(field, 15).when((F.col("verdict") == "scar") & F.col("cls").isin("anom", "unex", "hot"), F.least(F.col("score") + 10, F.lit(100)))
          .when(water, 5).when((F.col("verdict") == "none") & open_, F.greatest(F.col("score") - 10, F.lit(0))).otherwise(F.col("score")))
    j = j.withColumn("score2", sc)
    cl = (F.when(field, "seas").when(water, "off").when((F.col("verdict") == "scar") & (F.col("cls") == "unex") & (F.col("score2") >= ANOMALY_AT), "anom")
          .when((F.col("verdict") == "none") & (F.col("cls") == "anom") & (F.col("score2") < ANOMALY_AT), "unex").otherwise(F.col("cls")))
    return j.withColumn("cls2", cl)


# ------------------------------------------------------------------ scenes and sites
def scene_z(scenes: DataFrame, keys=("site", "part", "orbit"), value="value", days=240, most=20, least=8, counts=True) -> DataFrame:
    """Each scene against up to 20 earlier scenes of the same orbit within 240 days; spread floored at 5% of the median."""
    w = Window.partitionBy(*keys).orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(-days, -1)
    d = scenes.withColumn("_p", F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("day", value)).over(w))), 1, most))
    d = d.withColumn("_v", F.transform("_p", lambda x: x[value].cast("double"))).drop("_p")
    d = d.select("*", F.inline(F.array(S.spread(F.col("_v")))))
    spread = F.greatest(1.4826 * F.col("mad"), 0.05 * F.abs("base_med"), F.lit(1.0 if counts else 200.0))
    srt = F.sort_array("_v")
    q = lambda p: F.get(srt, F.least(F.size("_v") - 1, F.floor(F.lit(p) * F.size("_v")).cast("int")))
    ok = F.size("_v") >= least
    return d.select(*scenes.columns, F.when(ok, (F.col(value) - F.col("base_med")) / spread).alias("z"),
                    *[F.when(ok, q(p)).alias(n) for p, n in ((0.5, "usual"), (0.1, "low"), (0.9, "high"))])


def site_state(scored: DataFrame, keys=("site",), at=2.5, close=7) -> DataFrame:
    """Two-pass state on each scored scene: out / in when this and the previous scene within a week agree, changed, normal."""
    w = Window.partitionBy(*keys).orderBy("day")
    d = scored.where(F.col("z").isNotNull()).withColumn("_z0", F.lag("z").over(w)).withColumn("_d0", F.lag("day").over(w))
    near = F.datediff("day", "_d0") <= close
    st = (F.when(near & (F.col("_z0") <= -at) & (F.col("z") <= -at), "out").when(near & (F.col("_z0") >= at) & (F.col("z") >= at), "in")
          .when(F.abs("z") >= at, "changed").otherwise("normal"))
    return d.withColumn("state", st).drop("_z0", "_d0")


def state_on(states: DataFrame, asks: DataFrame, keys=("site",), stale=10) -> DataFrame:
    """State in force on each asked day; nodata when the newest scored scene is older than `stale` days."""
    from tocsin.operators import pit
    s = pit.as_of(asks, states.withColumn("seen", F.col("day")), keys, at="day", cols=("state", "seen"))
    old = F.col("seen").isNull() | (F.datediff("day", "seen") > stale)
    return s.withColumn("state", F.when(old, "nodata").otherwise(F.col("state")))


def theatre_state_counts(states: DataFrame, site_theatres: DataFrame, keys=("day",)) -> DataFrame:
    """Sites out and in per theatre and day; every theatre of a watched site gets a row."""
    j = site_theatres.withColumn("theatre", F.explode("theatres")).join(states, "site")
    return j.groupBy("theatre", *keys).agg(F.count_if(F.col("state") == "out").alias("n_out"), F.count_if(F.col("state") == "in").alias("n_in"))


def unmatched_objects(objects: DataFrame, keys=("site",), radius=3) -> DataFrame:
    """Objects new on a scene and gone since the previous one: no object of the other scene within `radius` pixels.

    objects: keys, seq (scene number), row, col. Candidates meet on pixel blocks, so only near objects are compared.
    """
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    size = radius + 1
    a = objects.withColumn("_i", F.floor(F.col("row") / size)).withColumn("_j", F.floor(F.col("col") / size))
    def side(step):
        o = objects.select(*keys, (F.col("seq") + step).alias("seq"), F.col("row").alias("r2"), F.col("col").alias("c2"))
        o = o.withColumn("_n", F.explode(near)).withColumn("_i", F.floor(F.col("r2") / size) + F.col("_n.a")).withColumn("_j", F.floor(F.col("c2") / size) + F.col("_n.b"))
        close = F.pow(F.col("row") - F.col("r2"), 2) + F.pow(F.col("col") - F.col("c2"), 2) <= radius * radius
        hit = a.join(o, [*keys, "seq", "_i", "_j"]).where(close).select(*keys, "seq", "row", "col").distinct()
        return objects.join(hit, [*keys, "seq", "row", "col"], "left_anti")
    return side(1).withColumn("change", F.lit("new")).unionByName(side(-1).withColumn("change", F.lit("gone")))


def blob_counts(pixels: DataFrame, keys=("scene",), cut=0.0, least=2, most=40) -> DataFrame:
    """Bright area and groups of touching bright pixels of a plausible size, per scene.

    Touching pixels are joined by the distributed component labelling, so a scene of any size never sits in one task.
    """
    from tocsin.operators.composite import components
    p = pixels.where(F.col("db") >= cut).withColumn("node", F.concat_ws("_", *keys, "row", "col"))
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    o = p.select(*keys, F.col("node").alias("other"), F.explode(near).alias("_n"), "row", "col")
    o = o.select(*keys, "other", (F.col("row") + F.col("_n.a")).alias("row"), (F.col("col") + F.col("_n.b")).alias("col"))
    lab = components(p.select("node"), p.join(o, [*keys, "row", "col"]).select("node", "other"), "node")
    sizes = p.join(lab, "node").groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*keys).agg(F.sum("n").alias("bright"), F.count_if(F.col("n").between(least, most)).alias("blobs"))


def burn_area(before: DataFrame, after: DataFrame, keys=("site",), cut=0.27, pixel_ha=0.04) -> DataFrame:
    """Hectares whose normalised burn ratio fell by more than `cut` between two dates. Rows: keys, row, col, nir, swir."""
    nbr = lambda n, s: F.try_divide(F.col(n) - F.col(s), F.col(n) + F.col(s))
    b = before.select(*keys, "row", "col", nbr("nir", "swir").alias("_b"))
    a = after.select(*keys, "row", "col", nbr("nir", "swir").alias("_a"))
    return b.join(a, [*keys, "row", "col"]).groupBy(*keys).agg((F.count_if(F.col("_b") - F.col("_a") > cut) * pixel_ha).alias("burn_ha"))
