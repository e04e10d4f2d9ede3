"""Flight legs and verdicts, holding, airport counters, gate crossings, vessel presence."""
from pyspark.sql import DataFrame, Window, functions as F

from tocsin.functions import geo
from tocsin.operators import spatial

# Fixed values of the leg rules.
GAP_S, MAX_GAP_S, LOW_FT, MIN_AIR_S, MIN_POINTS = 1800, 5 * 3600, 3000, 300, 5
TURNBACK_S, TURNBACK_MAX_S, SEEN_GAP_S = 1200, 4 * 3600, 600
HOLD_FT, HOLD_KM, HOLD_DEG = 20000, 60, 720
APPROACH_KM, APPROACH_FT, DIVERT_KM = 150, 20000, 50
BLOCK_S = 86400
GATE_KM = 30


def legs(trace: DataFrame, key="icao", gap=GAP_S, max_gap=MAX_GAP_S, least_s=MIN_AIR_S, least_n=MIN_POINTS,
         ties=("on_ground", "call", "near", "low", "lat", "lon")) -> DataFrame:
    """Airborne legs of each aircraft: (key, leg, t0, t1, points, call, dep, arr, gap).

    trace: key, t (seconds), lat, lon, alt, on_ground, call, near (airport within reach of the point, NULL if none), low
    (true when low enough there to stand for a take-off or landing out of view). A leg ends on ground contact, on a new
    callsign, on a gap when the point before was low near an airport, or on any very long gap. Every rule needs only the
    point before and the callsign carried so far, so boundaries are flags and a running sum. One aircraft is one partition;
    its points are bounded by one transponder's report rate. Points of one time are taken in the order of `ties`; a leg departs with the first
    and arrives with the last of its points in that order.
    """
    w = Window.partitionBy(key).orderBy("t", *ties)
    low_at, call = F.when(F.col("low"), F.col("near")), F.nullif(F.col("call"), F.lit(""))
    d = trace.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    d = d.withColumn("_dt", F.col("t") - F.lag("t").over(w)).withColumn("_pg", F.lag("on_ground").over(w)).withColumn("_pnear", F.lag("near").over(w))
    d = d.withColumn("_cut", F.coalesce((F.col("_dt") > gap) & (F.lag(low_at).over(w).isNotNull() | (F.col("_dt") > max_gap)), F.lit(False)))
    # the callsign a point leaves behind: the last one heard since the ground or a cut, none after the ground
    d = d.withColumn("_seg", F.sum(F.when(F.coalesce("_pg", F.lit(True)) | F.col("_cut"), 1).otherwise(0)).over(w))
    heard = F.last(call, ignorenulls=True).over(Window.partitionBy(key, "_seg").orderBy("t", *ties).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_heard", F.when(~F.col("on_ground"), heard))
    d = d.withColumn("_new", F.coalesce(F.lag("_heard").over(w) != call, F.lit(False)))
    start = ~F.col("on_ground") & (F.coalesce("_pg", F.lit(True)) | F.col("_new") | F.col("_cut"))
    d = d.withColumn("_start", start).withColumn("leg", F.sum(F.col("_start").cast("int")).over(w))
    nxt = {c: F.lead(c).over(w) for c in ("_new", "_cut", "on_ground", "near")}
    arr = (F.when(F.coalesce(nxt["_new"], F.lit(False)), F.lit(None)).when(F.coalesce(nxt["_cut"], F.lit(False)), low_at)
           .when(F.coalesce(nxt["on_ground"], F.lit(False)), nxt["near"]).otherwise(low_at))
    d = d.withColumn("_arr", arr).withColumn("_i", F.row_number().over(w))
    air = d.where(~F.col("on_ground"))
    dep, arr = F.when(F.col("_pg") & (F.col("_dt") <= gap), F.col("_pnear")).otherwise(low_at), F.col("_arr")
    g = air.groupBy(key, "leg").agg(
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("points"), F.mode(F.nullif(F.col("call"), F.lit("")), True).alias("call"),
        F.min_by(dep, "_i").alias("dep"), F.max_by(arr, "_i").alias("arr"), F.coalesce(F.max(F.when(~F.col("_start"), F.col("_dt"))), F.lit(0)).alias("gap"))
    return g.where((F.col("t1") - F.col("t0") >= least_s) & (F.col("points") >= least_n))


def holding(points: DataFrame, keys=("icao", "leg")) -> DataFrame:
    """Degrees of turning below 20,000 ft within 60 km of the landing airport. points: keys, t, track, alt, km_to_arr."""
    w = Window.partitionBy(*keys).orderBy("t")
    ok = F.col("track").isNotNull() & F.col("alt").isNotNull() & (F.col("alt") <= HOLD_FT) & (F.col("km_to_arr") <= HOLD_KM)
    d = points.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    t = F.when(F.col("_ok") & F.lag("_ok").over(w), F.abs(geo.turn(F.col("track"), F.lag("track").over(w))))
    return d.withColumn("_t", t).groupBy(*keys).agg(F.coalesce(F.sum("_t"), F.lit(0.0)).alias("hold"))


def airline(call, category):
    """Airline callsign (three letters, a digit) on an airliner category; '' and 'A0' are left to a type test upstream."""
    return call.rlike("^[A-Za-z]{3}[0-9]") & category.isin("A2", "A3", "A4", "A5")


def judge(legs_: DataFrame, routes: DataFrame, airports: DataFrame) -> DataFrame:
    """Verdict per leg: turnback, diversion, normal, or NULL when it cannot be judged.

    legs_: call, dep, arr, t0, t1, gap, low_near_planned (lowest altitude within reach of the planned airport, NULL if none).
    routes: call, route (array of airports). airports: airport, a_lat, a_lon.
    """
    j = legs_.join(routes, "call", "left")
    at = F.array_position("route", F.col("dep"))
    planned = F.when((at > 0) & (at < F.size("route")), F.get("route", at.cast("int")))
    j = j.withColumn("planned", planned)
    pa = airports.select(F.col("airport").alias("planned"), F.col("a_lat").alias("_pla"), F.col("a_lon").alias("_plo"))
    aa = airports.select(F.col("airport").alias("arr"), F.col("a_lat").alias("_ala"), F.col("a_lon").alias("_alo"))
    j = j.join(pa, "planned", "left").join(aa, "arr", "left")
    dur = F.col("t1") - F.col("t0")
    back = dur.between(TURNBACK_S, TURNBACK_MAX_S) & (F.col("gap") <= SEEN_GAP_S) & ~F.coalesce(F.col("planned") == F.col("dep"), F.lit(False))
    away = geo.flat_km(F.col("_ala"), F.col("_alo"), F.col("_pla"), F.col("_plo")) >= DIVERT_KM
    low = F.coalesce(F.col("low_near_planned") <= APPROACH_FT, F.lit(False))
    v = (F.when(F.col("dep").isNull() | F.col("arr").isNull(), None)
         .when(F.col("dep") == F.col("arr"), F.when(back, "turnback"))
         .when(F.col("planned").isNull() | F.array_contains("route", F.col("arr")) | F.col("_pla").isNull(), "normal")
         .when(away & low, "diversion"))
    return j.withColumn("verdict", v).drop("_pla", "_plo", "_ala", "_alo")


def airport_day(judged: DataFrame, t="t1") -> DataFrame:
    """Counters per airport and day over judged legs: departures, arrivals, diversions away and in, turnbacks, holding."""
    d = judged.withColumn("day", F.to_date(F.timestamp_seconds(F.col(t))))
    def side(airport, what, on):
        return F.struct(F.col(airport).alias("airport"), F.lit(what).alias("what"), F.coalesce(on, F.lit(False)).alias("on"))
    sides = F.array(
        side("dep", "dep", F.lit(True)), side("arr", "arr", F.lit(True)),
        side("planned", "div_away", F.col("verdict") == "diversion"), side("arr", "div_in", F.col("verdict") == "diversion"),
        side("dep", "turnback", F.col("verdict") == "turnback"),
        side("arr", "hold", F.col("verdict").isNotNull() & (F.col("hold") >= HOLD_DEG)))
    r = d.select("day", F.inline(sides)).where(F.col("on") & F.col("airport").isNotNull())
    return r.groupBy("day", "airport").agg(*[F.count_if(F.col("what") == x).alias(x) for x in ("dep", "arr", "div_away", "div_in", "turnback", "hold")])


def newest_vs_usual(daily: DataFrame, keys, days=28) -> DataFrame:
    """Newest day against the median of the `days` days before it, plus 7-day totals."""
    w = Window.partitionBy(*keys).orderBy("day")
    from tocsin.functions import scoring as S
    d = daily.withColumn("_a", F.collect_list("n").over(w.rowsBetween(-days, -1))).withColumn("week", F.sum("n").over(w.rowsBetween(-6, 0)))
    last = F.max("day").over(Window.partitionBy(*keys))
    return d.withColumn("_l", last).where(F.col("day") == F.col("_l")).select(*keys, "day", "n", S.median(F.col("_a")).alias("usual"), "week")


def crossings(fixes: DataFrame, gates, key="vessel", max_gap_s=3 * 3600, reach_km=GATE_KM) -> DataFrame:
    """Gate crossings between consecutive fixes at most three hours apart: vessel, gate, day, direction and the first time, so that
    a way out and back in a day count as two.

    gates is a fixed list of (gate, lat1, lon1, lat2, lon2, to, back): the fixes lie on different sides of its line and both within reach of its
    middle; `to` names the direction towards the positive side. The list becomes an array, so there is no join.
    """
    w = Window.partitionBy(key).orderBy("ts")
    d = fixes.withColumn("_pla", F.lag("lat").over(w)).withColumn("_plo", F.lag("lon").over(w)).withColumn("_pt", F.lag("ts").over(w))
    d = d.where(F.col("_pt").isNotNull() & (F.timestamp_diff("SECOND", F.col("_pt"), F.col("ts")) <= max_gap_s))

    def at(gate, la1, lo1, la2, lo2, to, back):
        before, after = (geo.side(F.lit(la1), F.lit(lo1), F.lit(la2), F.lit(lo2), F.col(la), F.col(lo)) for la, lo in (("_pla", "_plo"), ("lat", "lon")))
        km = [geo.flat_km(F.col(la), F.col(lo), F.lit((la1 + la2) / 2), F.lit((lo1 + lo2) / 2)) for la, lo in (("_pla", "_plo"), ("lat", "lon"))]
        return F.when((before * after < 0) & (F.greatest(*km) <= reach_km), F.struct(F.lit(gate).alias("gate"), F.when(after > 0, to).otherwise(back).alias("dir")))
    x = d.select(key, "ts", F.to_date("ts").alias("day"), F.inline(F.array_compact(F.array(*[at(*g) for g in gates]))))
    return x.groupBy(key, "gate", "day", "dir").agg(F.min("ts").alias("first_ts"))


def presence(fixes: DataFrame, regions: DataFrame, key="vessel") -> DataFrame:
    """Distinct vessels per region, class and day."""
    j = spatial.in_boxes(fixes, regions)
    return j.groupBy("box", "cls", F.to_date("ts").alias("day")).agg(F.count_distinct(key).alias("vessels"))
