"""One registered query for each operator, over its whole table, and the SQL of those that SQL can express."""
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tocsin.llm import classlm, counts, entropy, language, leaks, lines, mixing, near, rules, sharding, surrogates, tries, variants
from tocsin.llm.oracles import ORACLES
from tocsin.llm.shared import documents, keep, shared_folder

SHARDS = 24
LEAST_QUALITY = 0.3


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mixing.mix(docs, mixing.by_code_point((5, 2, 1)), budget=1.5, most=2).select("doc_id", "size", "source_size", "target", "taken")


def op2_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score(documents(spark, sf_dir), fold=2, of=7)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sizes(documents(spark, sf_dir))
    out = sharding.shard(rows, SHARDS, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", language.held_out(0, 5).alias("held_out"), "text")
    return language.identified(rows, language.fit(docs), ["doc_id", "held_out"])


def op5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near(documents(spark, sf_dir))


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = lines.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("doc_id", lines.held_out(0, 5).alias("held_out"), "text")
    return lines.scored(rows, field, ["doc_id", "held_out"]).withColumn("predicted", F.when(F.col("score") >= LEAST_QUALITY, 1).otherwise(0))


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.searched(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"]).drop("spans")


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(documents(spark, sf_dir)).select("doc_id", "n_pii", "pii_kinds", "text")


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents in four batches, re-counts all with the next tokenizer version, deletes all but one of equal texts, and
    applies one batch twice, as a retry does."""
    store = counts.Rollup(spark, f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}")
    text = F.col("text")
    one, two = counts.VERSIONS["words/1"], counts.VERSIONS["words/2"]
    rows = keep(documents(spark, sf_dir).select(
        "doc_id", "source", "lang", one(text).alias("one"), two(text).alias("two"), F.md5(text).alias("same"),
        (F.crc32(F.col("doc_id").cast("string")) % 4).alias("part")), "token-counts")
    for part in (0, 1, 2, 3):
        mine = F.coalesce(F.col("part"), F.lit(0)) == part
        store.commit(f"load-{part}", counts.inserts(rows.filter(mine), "words/1", F.col("one")))
    recount = counts.revisions(rows, "words/1", F.col("one"), "words/2", F.col("two"))
    store.commit("recount", recount)
    store.commit("copies", counts.copies(rows, "words/2"))
    store.commit("recount", recount)
    return store.totals()


def op11_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entropy.scanned(documents(spark, sf_dir), ["doc_id"])
    base = entropy.of_kind(F.col("spans"), *entropy.KINDS[:3])
    counted = {f"n_{k}": F.size(entropy.of_kind(F.col("spans"), k)).cast("long") for k in entropy.KINDS}
    return rows.withColumns(counted | {"base_sha256": F.sha2(entropy.listed(base), 256), "spans": entropy.listed(F.col("spans"))})


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(documents(spark, sf_dir))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tries.placed(tries.hashed(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return tries.trie(*tries.rebuilt(turns)).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), "ends_sha256")


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_class_bigrams, op3_sharding, op4_language, op5_near, op6_line_quality, op7_leaks, op8_surrogates, op9_rules, op10_token_counts,
    op11_entropy, op12_variants, op13_trie)}
