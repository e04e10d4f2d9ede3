"""Exact tail probabilities as column expressions. Terms are carried as logarithms and summed from the largest seen, so that neither a
far tail nor a sum from below the mode leaves the range of a double."""
from pyspark.sql import Column, functions as F


def log_choose(n, k) -> Column:
    n, k = n.cast("long"), k.cast("long")
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))))
    return F.coalesce(F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.log((n - k + i) / i)), F.lit(0.0))


def _sum_of_terms(lo, hi, first, ratio) -> Column:
    """Sum of terms lo..hi: the logarithm of the first, and of each next over the one before."""
    def add(a, i):
        top = F.greatest(a["top"], a["term"])
        return F.struct((a["term"] + ratio(i)).alias("term"), top.alias("top"),
                        (a["sum"] * F.exp(a["top"] - top) + F.exp(a["term"] - top)).alias("sum"))
    start = F.struct(first.alias("term"), first.alias("top"), F.lit(0.0).alias("sum"))
    total = F.aggregate(F.sequence(lo.cast("long"), F.greatest(hi, lo).cast("long")), start, add, lambda a: F.exp(a["top"] + F.log(a["sum"])))
    return F.least(F.lit(1.0), total)


def binomial_tail(k, n, p) -> Column:
    """P(X >= k) for X ~ Binomial(n, p). The terms follow from one another, so only the first needs factorials."""
    first = log_choose(n, k) + k * F.log(p) + (n - k) * F.log(1 - p)
    odds = F.log(p) - F.log(1 - p)
    total = _sum_of_terms(k, n, first, lambda i: F.log(F.greatest(n - i, F.lit(1)) / (i + 1)) + odds)
    return (F.when(k <= 0, 1.0).when(p <= 0, 0.0).when(p >= 1, 1.0).otherwise(total))


def fisher_upper(a, b, c, d) -> Column:
    """One-sided Fisher exact p for a 2x2 table: chance of `a` or more in the first cell with the margins held."""
    row, col, n = a + b, a + c, a + b + c + d
    first = log_choose(col, a) + log_choose(n - col, row - a) - log_choose(n, row)
    return _sum_of_terms(a, F.least(row, col), first, lambda i: F.log(
        F.greatest((col - i) * (row - i), F.lit(1)) / ((i + 1) * (n - col - row + i + 1))))
