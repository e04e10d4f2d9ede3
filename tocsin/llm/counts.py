"""Token counts kept as delta-maintained rollups.

The store holds, per committed batch, the signed sums by source, language and tokenizer version. A change is an insert (+1), a delete
(-1), or a revision (-1 of the old count, +1 of the new). Sums are additive, so totals are the sum over batches and a batch costs only its own
rows. A batch writes its own folder `batch=<name>` as a whole: applied again, after a lost executor, a retry or by mistake, it
replaces itself and the totals stay. compact() folds batches into one and keeps their names, so that they stay known.
"""
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tocsin.llm.shared import word_count

KEYS = ["source", "lang", "version"]
SUMS = ["n_docs", "n_tokens"]
COMPACTED = "compacted"
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long, batch string"

#: Tokenizer versions of the registered query. words/1 counts words between spaces, words/2 counts runs of letters
#: and digits, and every other visible character, on its own.
VERSIONS = {
    "words/1": word_count,
    "words/2": lambda text: F.coalesce(F.length(F.regexp_replace(F.regexp_replace(
        text, r"[\x30-\x39\x41-\x5A\x61-\x7A\u0080-\x{10FFFF}]+", "a"), r"[\x00-\x20\x7F]+", "")), F.lit(0)).cast("long"),
}


def change(rows: DataFrame, version: str, tokens: Column, sign: int = 1) -> DataFrame:
    """Rows with source and lang as signed changes. Null sources and languages are keys of their own; a null count counts as 0."""
    return rows.select("source", "lang", F.lit(version).alias("version"), F.lit(sign).cast("long").alias("n_docs"),
                       (F.coalesce(tokens, F.lit(0)) * sign).cast("long").alias("n_tokens"))


def inserts(rows: DataFrame, version: str, tokens: Column) -> DataFrame:
    return change(rows, version, tokens)


def deletes(rows: DataFrame, version: str, tokens: Column) -> DataFrame:
    return change(rows, version, tokens, -1)


def revisions(rows: DataFrame, old: str, old_tokens: Column, new: str, new_tokens: Column) -> DataFrame:
    """One pass over the rows: the old count goes, the new one comes."""
    both = F.explode(F.array(
        F.struct(F.lit(old).alias("version"), F.lit(-1).cast("long").alias("n_docs"), (-F.coalesce(old_tokens, F.lit(0))).cast("long").alias("n_tokens")),
        F.struct(F.lit(new).alias("version"), F.lit(1).cast("long").alias("n_docs"), F.coalesce(new_tokens, F.lit(0)).cast("long").alias("n_tokens"))))
    return rows.select("source", "lang", both.alias("c")).select("source", "lang", "c.version", "c.n_docs", "c.n_tokens")


class Rollup:
    """A store of committed batches under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Pre-aggregates the changes in the map tasks and writes the batch's folder whole. A batch of no rows commits as empty; one that
        was folded by a compaction is known, and nothing is written."""
        if not self.folded().filter(F.col("batch") == batch).isEmpty():
            return
        sums = changes.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def deltas(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(self.path)

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens; a key whose changes cancel stays with zeros."""
        return self.deltas().groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])

    def folded(self) -> DataFrame:
        """Names of the batches that compactions have folded, which stand beside the sums."""
        try:
            return self.spark.read.schema("batch string").parquet(f"{self.path}/_folded")
        except Exception as e:  # not compacted so far
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "batch string")

    def committed(self) -> DataFrame:
        return self.deltas().select("batch").filter(F.col("batch") != COMPACTED).union(self.folded()).distinct()

    def compact(self, path: str) -> "Rollup":
        """The same totals in a new store with one folder, and the names of its batches: applied again they change nothing."""
        path = path.rstrip("/")
        self.totals().write.mode("overwrite").parquet(f"{path}/batch={COMPACTED}")
        self.committed().write.mode("overwrite").parquet(f"{path}/_folded")
        return Rollup(self.spark, path)


def copies(rows: DataFrame, version: str, same: str = "same", key: str = "doc_id", tokens: str = "two") -> DataFrame:
    """Signed changes that delete all rows of equal `same` but those of the least key. Rows are summed by (same, source, lang) with their least key
    before equal ones meet, so a text of many copies brings one row for each source and language. Null texts and keys are no copies."""
    known = rows.filter(F.col(same).isNotNull() & F.col(key).isNotNull())
    own = known.groupBy(same, "source", "lang", key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(tokens, F.lit(0))).alias("t"))
    sums = own.groupBy(same, "source", "lang").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.min(F.struct(key, "n", "t")).alias("least"))
    first = sums.groupBy(F.col(same).alias("_same")).agg(F.min(f"least.{key}").alias("_first"))
    stays = F.col(f"least.{key}") == F.col("_first")
    out = sums.join(first, F.col(same) == F.col("_same")).withColumns({
        "gone": F.col("n") - F.when(stays, F.col("least.n")).otherwise(0), "less": F.col("t") - F.when(stays, F.col("least.t")).otherwise(0)}).filter("gone > 0")
    return out.select("source", "lang", F.lit(version).alias("version"), (-F.col("gone")).cast("long").alias("n_docs"), (-F.col("less")).cast("long").alias("n_tokens"))
