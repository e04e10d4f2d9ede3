"""Mixing sources to target weights by hash thresholds.

Every row has a fixed pseudo-random place in 0..2**60. A source that is to give T of its S words gives each row floor(T / S) times,
and the rows below a threshold once more. The threshold is found from histograms: words per source and hash bucket, their
running sum, then the bucket that holds the boundary is cut again, and only its rows are read for that. Budgets nest: a larger
target takes every row that a smaller one takes. No row is sorted; a window runs over at most BUCKETS sums of one source.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from tocsin.llm.shared import keep, word_count

DIGITS = 3       # hex digits of the hash cut at a time
LEVELS = 3       # times the boundary bucket is cut
FEW_SOURCES = 20_000  # up to so many sources their targets are broadcast, else joined


def place(doc_id: Column, text: Column) -> Column:
    """15 hex digits that depend on the row's id and text alone."""
    return F.substring(F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))), 1, 15)


def sized(docs: DataFrame) -> DataFrame:
    """The rows with _size (words), and _place."""
    return docs.withColumns({"_size": word_count(F.col("text")), "_place": place(F.col("doc_id"), F.col("text"))})


def targets(totals: DataFrame, budget: float, most: int = 2) -> DataFrame:
    """source, _total, _weight -> _target. budget (times all words) is dealt by weight; a source stops at most x its words, and what
    it leaves goes to the others by weight. Sources are few against rows, so one window over the sources' sums is enough:
    in the order of cap / weight, a source is full while its cap is at most its share of what is left."""
    by_fill = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    x = totals.withColumn("_cap", F.col("_total") * F.lit(most))
    x = x.withColumns({
        "_left": F.sum("_total").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
        "_weights": F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0)),
    })
    x = x.withColumn("_rate", F.col("_left") / F.col("_weights"))
    open_ = F.col("_cap") / F.col("_weight") > F.col("_rate")
    rate = F.min_by(F.when(open_, F.col("_rate")), F.when(open_, F.col("_cap") / F.col("_weight"))).over(every)
    share = F.least(F.col("_cap").cast("double"), F.coalesce(rate * F.col("_weight"), F.col("_cap").cast("double")))
    return x.withColumn("_target", share).select("source", "_total", "_weight", "_target")


def _bucket(level: int) -> Column:
    return F.substring("_place", 1 + DIGITS * level, DIGITS)


def thresholds(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """rows: source, _size, _place. goal: source, _total, _target. Adds _every (times that all rows are taken) and _below: rows
    whose place starts with less than, or exactly, this prefix are taken once more."""
    full = F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(F.lit(0)).cast("long")
    open_ = goal.withColumn("_every", full).withColumn("_need", F.col("_target") - F.col("_every") * F.col("_total"))
    found = open_.withColumn("_prefix", F.lit(""))
    for level in range(LEVELS):
        at = found.select(F.col("source").alias("_s"), "_prefix", "_need")
        inside = rows if level == 0 else rows.join(
            _small(at), F.col("source").eqNullSafe(F.col("_s")) & (F.substring("_place", 1, DIGITS * level) == F.col("_prefix")), "left_semi")
        sums = inside.groupBy("source", _bucket(level).alias("_b")).agg(F.sum("_size").alias("_n"))
        upto = Window.partitionBy("source").orderBy("_b")
        runs = sums.withColumn("_upto", F.sum("_n").over(upto)).join(_small(at), F.col("source").eqNullSafe(F.col("_s")))
        # the first bucket whose running sum reaches what is needed; none does so only if the need is everything left
        hit = runs.groupBy("source").agg(
            F.min(F.when(F.col("_upto") >= F.col("_need"), F.struct("_b", (F.col("_upto") - F.col("_n")).alias("_u"), "_n"))).alias("_hit"))
        hit = hit.select(F.col("source").alias("_s"), F.col("_hit._b").alias("_hb"), F.col("_hit._u").alias("_hu"), F.col("_hit._n").alias("_hn"))
        found = keep(found.join(hit, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "_total", "_weight", "_target", "_every",
            F.concat("_prefix", F.coalesce("_hb", F.lit("f" * DIGITS))).alias("_prefix"),
            (F.col("_need") - F.coalesce("_hu", F.lit(0))).alias("_need"), F.coalesce("_hn", F.lit(0)).alias("_last")), "mix-bounds")
    # what is left within the last bucket goes to the nearer side
    takes_last = (F.col("_need") > 0) & (F.col("_need") * 2 >= F.col("_last"))
    return found.select("source", "_total", "_weight", "_target", "_every", F.col("_prefix").alias("_below"), takes_last.alias("_inclusive"))


def _small(df: DataFrame) -> DataFrame:
    """A table of one row per source, broadcast only while its counted size is below the bound."""
    return F.broadcast(df) if df.count() <= FEW_SOURCES else df


def mix(docs: DataFrame, weights, budget: float = 1.5, most: int = 2) -> DataFrame:
    """How often each row enters the mix.

    docs: doc_id, text, source (other columns are ignored). weights: a function from the sources' totals (source, _total) to the
    same rows with _weight, a positive number. Returns doc_id, size, source, source_size, target, repeats, taken. Null or empty
    texts have size 0 and are taken 0 or more times without effect; null ids and repeated rows are rows like any other (rows equal
    in id and text share their fate); a null source is a source; an empty table gives none; columns of any other name don't clash,
    as only these three are read."""
    rows, goal = _plan(docs, weights, budget, most)
    return _repeats(rows.select("doc_id", "source", "_size", "_place"), goal).select(
        "doc_id", F.col("_size").alias("size"), "source", F.col("_total").alias("source_size"), F.col("_target").alias("target"),
        F.col("_times").alias("repeats"), (F.col("_times") * F.col("_size")).alias("taken"))


def mixed(docs: DataFrame, weights, budget: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of the mix themselves, with all columns of docs: a row stands as often as it is taken. Rows without words are
    dealt by the same thresholds. Names that start with an underscore and clash with the working ones come back unchanged, as the
    row travels in one struct."""
    names = docs.columns
    _, goal = _plan(docs, weights, budget, most)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "source",
                        word_count(F.col("text")).alias("_size"), place(F.col("doc_id"), F.col("text")).alias("_place"))
    many = _repeats(whole, goal).filter(F.col("_times") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return many.select(*[F.col("_row").getField(c).alias(c) for c in names])


def _plan(docs: DataFrame, weights, budget: float, most: int):
    rows = keep(sized(docs.select("doc_id", "text", "source")).select("doc_id", "source", "_size", "_place"), "mix-rows")
    totals = keep(rows.groupBy("source").agg(F.sum("_size").alias("_total")), "mix-totals")
    goal = keep(targets(weights(totals), budget, most), "mix-targets")
    return rows, thresholds(rows, goal)


def _repeats(rows: DataFrame, goal: DataFrame) -> DataFrame:
    g = _small(goal.withColumnRenamed("source", "_s"))
    start = F.substring("_place", 1, DIGITS * LEVELS)
    below = (start < F.col("_below")) | ((start == F.col("_below")) & F.col("_inclusive"))
    return rows.join(g, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_times", F.col("_every") + F.when(below, 1).otherwise(0))


def by_code_point(pattern: tuple[int, ...] = (5, 2, 1)):
    """Weights dealt to the sources in the order of their names' code points, null last, repeating the pattern."""
    def give(totals: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        return totals.withColumn("_weight", F.element_at(F.array(*[F.lit(p) for p in pattern]), (rank - 1) % len(pattern) + 1))
    return give
