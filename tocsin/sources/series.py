"""Reading, seeding, merging and restating series tables."""
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SERIES = "day DATE, value DOUBLE"


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """All series of a folder in one scan: the file name is the series id; rows of the wrong shape are dropped."""
    df = spark.read.schema(SERIES).option("mode", "DROPMALFORMED").csv(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)\.csv(?:\.gz)?$", 1)
    return df.select(name.alias("series_id"), "day", "value").where(F.col("day").isNotNull() & F.col("value").isNotNull())


def parse_lines(lines: DataFrame, key="series_id", line="line") -> DataFrame:
    """The same rule for lines already in a table."""
    parts = F.split(line, ",")
    return lines.where(F.size(parts) == 2).select(key, F.try_to_timestamp(F.get(parts, 0)).cast("date").alias("day"),
                                                  F.get(parts, 1).try_cast("double").alias("value")).where("day is not null and value is not null")


def append_snapshot(rows: DataFrame, path: str):
    """Append observations (ts, series_id, value), one partition per day."""
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def replace_days(rows: DataFrame, path: str, day="day"):
    """Rewrite only the days present in `rows`; every other day stays."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def write_if_changed(rows: DataFrame, path: str) -> bool:
    """Overwrite only when the content differs: an order-free content hash is kept beside the table."""
    spark = rows.sparkSession
    h = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])
    # the sum of pseudo-random hashes and of their squares modulo a prime identifies a bag of rows
    new = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).withColumn("s", F.col("s").cast("string"))
    try:
        old = spark.read.parquet(path + "_digest")
        if not new.exceptAll(old).limit(1).count():
            return False
    except Exception as e:     # first write: no digest yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("overwrite").parquet(path)
    new.write.mode("overwrite").parquet(path + "_digest")
    return True


def seed(archive: DataFrame, live: DataFrame, keys=("series_id",)) -> DataFrame:
    """Archive rows strictly before the live series' first day, then the live rows."""
    first = live.groupBy(*keys).agg(F.min("day").alias("_first"))
    old = archive.join(first, list(keys), "left").where(F.col("_first").isNull() | (F.col("day") < F.col("_first"))).drop("_first")
    return old.unionByName(live)


def upsert(parts, keys, order="priority") -> DataFrame:
    """Union of tables with a priority column; the highest priority wins per key."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    cols = [c for c in u.columns if c not in keys and c != order]
    return u.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_v")).select(*keys, "_v.*")


def merge_shards(base: DataFrame, shards: DataFrame, day="day") -> DataFrame:
    """A shard's days replace those days whole."""
    return base.join(shards.select(day).distinct(), day, "left_anti").unionByName(shards)


def merge_missing(have: DataFrame, more: DataFrame, keys) -> DataFrame:
    """Add only the missing keys, up to the table's last day."""
    last = have.agg(F.max("day").alias("d")).scalar()
    add = more.join(have.select(*keys), list(keys), "left_anti").withColumn("_last", last).where(F.col("day") <= F.col("_last")).drop("_last")
    return have.unionByName(add)


def restate(stored: DataFrame, recount: DataFrame, today, days, keys) -> DataFrame:
    """Rows of the trailing window come from the recount, older ones stay as they were."""
    cut = F.date_sub(today, days)
    return stored.where(F.col("day") < cut).unionByName(recount.where(F.col("day") >= cut))


def missing_days(have: DataFrame, watched: DataFrame, bounds: DataFrame, key="series_id", newest=None) -> DataFrame:
    """Days on which any watched key lacks a row: (day, have, want); with `newest`, the plan of one run, so many of the latest such days."""
    want = watched.agg(F.count_distinct(key).alias("n")).scalar()
    cal = bounds.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    n = have.join(watched.select(key).distinct(), key, "left_semi").groupBy("day").agg(F.count_distinct(key).alias("have"))
    d = cal.join(n, "day", "left").withColumn("have", F.coalesce("have", F.lit(0))).withColumn("want", want)
    d = d.where(F.col("have") < F.col("want"))
    return d if newest is None else d.orderBy(F.desc("day")).limit(newest)


def all_or_nothing(members: DataFrame, keys) -> DataFrame:
    """Sum over member feeds; one refused member voids the whole series. members: keys, day, value (NULL = empty), refused."""
    bad = members.groupBy(*keys).agg(F.bool_or("refused").alias("_bad"))
    return members.join(bad, list(keys)).where(~F.col("_bad")).groupBy(*keys, "day").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))


def intersect_sum(members: DataFrame, n, keys=(), member="series_id") -> DataFrame:
    """Sum on the days on which every one of the n members has a value."""
    g = members.where(F.col("value").isNotNull()).groupBy(*keys, "day").agg(F.sum("value").alias("value"), F.count_distinct(member).alias("_n"))
    return g.where(F.col("_n") == n).drop("_n")


def annual_then_candidates(annual: DataFrame, candidates: DataFrame, key="id") -> DataFrame:
    """The annual release, then candidate rows dated after it ends, one row per id."""
    end = annual.agg(F.max("day").alias("d")).scalar()
    return annual.unionByName(candidates.withColumn("_e", end).where(F.col("day") > F.col("_e")).drop("_e")).dropDuplicates([key])


def vintages(rows: DataFrame, keys, month="month", gen="generation", t="t") -> DataFrame:
    """Newest generation per key and month, public from the month after."""
    w = Window.partitionBy(*keys, month).orderBy(F.desc(gen), F.desc(t))
    return (rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").withColumn("known", F.add_months(month, 1)))


def stale(rows: DataFrame, now, limits) -> DataFrame:
    """Age in hours against the limit of each kind; stale rows are shown, not scored. limits: {kind: hours}."""
    lim = None
    for k, h in limits.items():
        lim = F.when(F.col("kind") == k, h) if lim is None else lim.when(F.col("kind") == k, h)
    age = F.timestamp_diff("HOUR", F.col("newest"), now)
    return rows.withColumn("age_h", age).withColumn("ratio", age / lim).withColumn("stale", F.col("ratio") > 1)


def write_json(df: DataFrame, path: str, by=("kind", "id")):
    df.write.mode("overwrite").partitionBy(*by).json(path)
