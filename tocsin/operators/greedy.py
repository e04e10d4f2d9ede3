"""Greedy rules without a sequential pass: rounds of local winners, and an ordered fold inside areas that can't touch each other."""
from pyspark.sql import DataFrame, functions as F

from tocsin.functions import geo
from tocsin.operators.lineage import stable
from tocsin.operators.spatial import in_cells, neighbours


def priority_seeds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, seed (itself where it is one) under the greedy rule: in order of priority a node joins the best seed it has an edge to, else becomes one.

    nodes: node. edges: node, better, rank (the better end's place in the order: the larger the better, no ties). In a round every open node
    without an open better neighbour becomes a seed and the neighbours of seeds close; that is what the sequential order does, as a node's fate depends on its
    better neighbours alone. The best open node closes in every round, and far fewer rounds than nodes are needed.
    """
    edges = stable(edges)
    state = stable(nodes.select("node", F.lit(None).cast("boolean").alias("seed")))
    while True:
        open_ = state.where("seed is null").select("node")
        live = edges.join(open_, "node").join(state.select(F.col("node").alias("better"), F.col("seed").alias("_s")), "better")
        told = live.groupBy("node").agg(F.bool_or(F.coalesce("_s", F.lit(False))).alias("_by_seed"), F.bool_or(F.col("_s").isNull()).alias("_waits"))
        state = stable(state.join(told, "node", "left").select("node", F.when(F.col("seed").isNotNull(), F.col("seed")).when(F.col("_by_seed"), False).when(
            F.coalesce("_waits", F.lit(False)), None).otherwise(True).alias("seed")))
        if state.where("seed is null").isEmpty():
            break
    best = edges.join(state.where("seed").select(F.col("node").alias("better")), "better").groupBy("node").agg(F.max_by("better", "rank").alias("_best"))
    return state.join(best, "node", "left").select("node", F.when(F.col("seed"), F.col("node")).otherwise(F.col("_best")).alias("seed"))


def near_clusters(points: DataFrame, key, radius_km=2.0, by=("box", "day"), score="score", size=0.05) -> DataFrame:
    """Adds cid: in order of score (ties: the smaller key) a point joins the best seed of its `by` within the radius, else becomes one.

    Points of one place share their fate, so a place enters once, with its best point. Places meet on grid cells; pairs are as many as places within
    the radius of each other, which the sensor's pixel bounds, whatever the number of points.
    """
    by = list(by)
    top = F.struct(F.col(score).alias("s"), (-F.col(key)).alias("k"))
    places = stable(points.groupBy(*by, "lat", "lon").agg(F.max(top).alias("rank")).withColumn("node", -F.col("rank.k")))
    other = neighbours(places.select(*by, F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("rank").alias("rank2"), F.col("node").alias("better")),
                       size, radius_km, "lat2", "lon2")
    near = in_cells(places, size).join(other, [*by, "_ci", "_cj"]).where(
        (F.col("rank2") > F.col("rank")) & (geo.flat_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= radius_km))
    seeds = priority_seeds(places, near.select("node", "better", F.col("rank2").alias("rank")))
    cid = places.join(seeds, "node").select(*by, "lat", "lon", F.col("seed").alias("cid"))
    return points.join(cid, [*by, "lat", "lon"])


def mutual_best(pairs: DataFrame, a="a", b="b", weight="r") -> DataFrame:
    """The pairs taken strongest first when every end is used once (ties: the later names first), in rounds: a pair that is the best of both
    its ends is taken, and every pair that touches it goes."""
    left = stable(pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), F.struct(F.col(weight).alias("w"), F.col(a).alias("a"), F.col(b).alias("b")).alias("_o")))
    taken = []
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("a", "b")).alias("end"), "_o").groupBy("end").agg(F.max("_o").alias("best"))
        won = stable(left.join(ends.select(F.col("end").alias("a"), F.col("best").alias("_ba")), "a").join(
            ends.select(F.col("end").alias("b"), F.col("best").alias("_bb")), "b").where((F.col("_o") == F.col("_ba")) & (F.col("_o") == F.col("_bb"))).select("a", "b", "_o"))
        taken.append(won)
        used = won.select(F.explode(F.array("a", "b")).alias("end"))
        left = stable(left.join(used.withColumnRenamed("end", "a"), "a", "left_anti").join(used.withColumnRenamed("end", "b"), "b", "left_anti").select("a", "b", "_o"))
    out = taken[0] if taken else left
    for t in taken[1:]:
        out = out.unionByName(t)
    return out.select("a", "b", F.col("_o.w").alias(weight))


# Fixed values of the rule: how near a point joins a site, the cell that is searched, the least points of a site without a tag.
JOIN_KM, CELL, LEAST = 0.4, 0.01, 5


def running_sites(points: DataFrame, key="id", join_km=JOIN_KM, cell=CELL, least=LEAST) -> DataFrame:
    """Points merged to sites: in the order of latitude and longitude (then key) a point joins the first made site of its own or a
    neighbouring cell whose mean lies within `join_km`, and moves the mean; else it makes a site, which keeps the cell of its first point. Sites count with
    `least` points or a tagged one (`fuel`): site (first key), lat, lon, n, fuel.

    A point only sees sites of its own and neighbouring cells, so groups of cells that don't touch are folded apart; such a group is one
    connected field of tanks.
    """
    from tocsin.operators.composite import components
    p = points.select(F.col(key).alias("key"), "lat", "lon", "fuel").withColumn("ci", geo.cell(F.col("lat"), cell)).withColumn("cj", geo.cell(F.col("lon"), cell))
    p = p.withColumn("node", F.concat_ws("_", "ci", "cj"))
    cells = stable(p.select("node", "ci", "cj").distinct())
    around = F.explode(F.array(*[F.struct((F.col("ci") + a).alias("ci"), (F.col("cj") + b).alias("cj")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    links = cells.select(F.col("node").alias("other"), around.alias("n")).select("other", "n.ci", "n.cj").join(cells, ["ci", "cj"]).select("node", "other")
    area = components(cells.select("node"), links, "node")

    def fold(pdf):
        import numpy as np
        import pandas as pd
        pdf = pdf.sort_values(["lat", "lon", "key"])
        sites = pd.DataFrame(columns=["site", "lat", "lon", "n", "fuel"])
        mean, count, cells_, first, tag = np.zeros((len(pdf), 2)), np.zeros(len(pdf), int), np.zeros((len(pdf), 2), int), [], np.zeros(len(pdf), bool)
        made = 0
        for at, c, k, fuel in zip(pdf[["lat", "lon"]].to_numpy(), pdf[["ci", "cj"]].to_numpy(), pdf["key"], pdf["fuel"]):
            m = mean[:made]
            x = np.radians(m[:, 1] - at[1]) * np.cos(np.radians((m[:, 0] + at[0]) / 2))
            ok = (np.abs(cells_[:made] - c).max(axis=1) <= 1) & (geo.EARTH_KM * np.hypot(x, np.radians(m[:, 0] - at[0])) <= join_km)
            if ok.any():
                i = int(np.argmax(ok))
                count[i] += 1
                mean[i] += (at - mean[i]) / count[i]
                tag[i] |= bool(fuel)
            else:
                mean[made], count[made], cells_[made], tag[made] = at, 1, c, bool(fuel)
                first.append(k)
                made += 1
        sites = pd.DataFrame({"site": first, "lat": mean[:made, 0], "lon": mean[:made, 1], "n": count[:made], "fuel": tag[:made]})
        return sites[(sites["n"] >= least) | sites["fuel"]]
    return p.join(area, "node").groupBy("label").applyInPandas(fold, "site long, lat double, lon double, n long, fuel boolean")
