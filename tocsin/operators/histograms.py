"""Quantiles from fixed bins. Counts are mergeable: those of two halves add up to those of the whole, so archives are folded in year by year."""
from pyspark.sql import Column, DataFrame, functions as F

# Lower edges of the radiant power bins, in megawatts; the last bin is open and counts as twice its edge.
POWER_EDGES = (0, 1, 2, 3, 5, 7, 10, 15, 20, 30, 50, 75, 100, 150, 200, 300, 500, 750, 1000, 1500, 2000, 3000, 5000)


def by_edges(values: DataFrame, by, value, edges=POWER_EDGES) -> DataFrame:
    """by..., hist: how many values lie in each bin (its lower edge is part of it; smaller values count in the first)."""
    v, top = F.col(value), len(edges) - 1
    def inside(i):
        up = F.lit(True) if i == top else v < edges[i + 1]
        return F.count_if((v.isNotNull() if i == 0 else v >= edges[i]) & up)
    return values.groupBy(*by).agg(F.array(*[inside(i) for i in range(len(edges))]).alias("hist"))


def by_count(counts: DataFrame, by, value, top) -> DataFrame:
    """by..., hist: place k holds how many rows have the count k, the last place those with `top` or more."""
    v = F.col(value)
    return counts.groupBy(*by).agg(F.array(*[F.count_if(v == i) for i in range(top)], F.count_if(v >= top)).alias("hist"))


def merged(hists: DataFrame, by, size) -> DataFrame:
    """Histograms of the same key added up."""
    return hists.groupBy(*by).agg(F.array(*[F.sum(F.get("hist", F.lit(i))) for i in range(size)]).alias("hist"))


def _reached(hist: Column, want: Column, strict: bool):
    """(bin, how many lie before it) of the first bin up to and with which `want` are reached; null if none."""
    zero = F.struct(F.lit(0).cast("long").alias("before"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bin"), F.lit(None).cast("long").alias("at"))
    def step(s, c):
        hit = s["bin"].isNull() & (s["before"] + c >= want) & ((c > 0) if strict else F.lit(True))
        return F.struct((s["before"] + c).cast("long").alias("before"), (s["i"] + 1).alias("i"), F.when(hit, s["i"]).otherwise(s["bin"]).alias("bin"),
                        F.when(hit, s["before"]).otherwise(s["at"]).alias("at"))
    return F.aggregate(hist, zero, step)


def _total(hist: Column) -> Column:
    return F.aggregate(hist, F.lit(0).cast("long"), lambda a, b: a + b)


def quantile(hist: Column, q: float, edges=POWER_EDGES) -> Column:
    """Quantile with a straight line inside the bin; 0 of nothing."""
    lows = F.array(*[F.lit(float(e)) for e in edges])
    highs = F.array(*[F.lit(float(e)) for e in (*edges[1:], edges[-1] * 2)])
    want = q * _total(hist)
    r = _reached(hist, want, True)
    low, high = F.get(lows, r["bin"]), F.get(highs, r["bin"])
    line = low + (high - low) * (want - r["at"]) / F.get(hist, r["bin"])
    return F.when(_total(hist) == 0, 0.0).otherwise(F.coalesce(line, F.lit(float(edges[-1]))))


def count_quantile(hist: Column, q: float) -> Column:
    """The least count up to which the share q lies; 0 of nothing."""
    r = _reached(hist, q * _total(hist), False)
    return F.when(_total(hist) == 0, 0.0).otherwise(F.coalesce(r["bin"], F.size(hist) - 1).cast("double"))
