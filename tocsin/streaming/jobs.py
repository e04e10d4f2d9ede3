"""Structured Streaming jobs: the polled folds as incremental queries.

Each function takes a streaming (or static) DataFrame and returns one; `drain` runs a stream over what has arrived and
hands back its output as a table.
"""
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tocsin.operators.lineage import shared_folder


def source(spark: SparkSession, folder: str, name: str, files_per_trigger=None) -> DataFrame:
    """Parquet landing folder as a stream; the schema comes from the files already there."""
    path = f"{folder}/{name}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def with_time(df: DataFrame, ts="ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def waves(alerts: DataFrame, gap="10 minutes", late="0 seconds", keys=()) -> DataFrame:
    """Alert waves: runs with no gap longer than `gap` (a gap of exactly that length joins)."""
    return (alerts.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("alerts"), F.max("ts").alias("last_ts"))
            .select(*keys, F.col("session_window.start").alias("first_ts"), "last_ts", "alerts"))


def daily(snapshots: DataFrame, keys, late="0 seconds") -> DataFrame:
    """Count and mean per key and UTC day, emitted once the day is closed."""
    return (snapshots.withWatermark("ts", late).groupBy(*keys, F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
            .select(*keys, F.to_date("window.start").alias("day"), "n", "mean"))


def sliding(events: DataFrame, keys, length="7 days", step="1 day", late="0 seconds") -> DataFrame:
    return (events.withWatermark("ts", late).groupBy(*keys, F.window("ts", length, step)).agg(F.count(F.lit(1)).alias("n"))
            .select(*keys, F.to_date("window.end").alias("through"), "n"))


def tally(posts: DataFrame, keys, length="5 minutes", late="0 seconds") -> DataFrame:
    """Sample tally in fixed windows; the checkpoint keeps each window exactly once."""
    return (posts.withWatermark("ts", late).groupBy(*keys, F.window("ts", length)).agg(F.count(F.lit(1)).alias("n"))
            .select(*keys, F.col("window.start").alias("start"), "n"))


def dedupe(events: DataFrame, ids, late="2 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(ids))


def distinct_per_day(fixes: DataFrame, key, late="1 day") -> DataFrame:
    """Distinct entities per day: one row per entity and day is let through, then counted when the day closes."""
    one = (fixes.withColumn("day", F.to_date("ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key, "day"]))
    return one.groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), "n")


def public_on(points: DataFrame, lag_days, late="0 seconds") -> DataFrame:
    """Points with the watermark on the day they became public, so a day is scored only once it is."""
    return points.withColumn("avail", F.col("ts") + F.make_interval(days=F.lit(lag_days))).withWatermark("avail", late)


VESSEL_OUT = "vessel bigint, last_s double, lat double, lon double, track_points bigint"
VESSEL_STATE = "last_s double, lat double, lon double, track string"
STEP_S, KEEP_S = 600, 48 * 3600


def vessel_state(fixes: DataFrame) -> DataFrame:
    """Per vessel: newest fix and a track thinned to one point per ten minutes, kept 48 hours. State expires with the vessel.

    Keyed state lives in the state store; each call sees one vessel's rows of one micro-batch.
    """
    import pandas as pd

    def fold(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, lat, lon, kept = state.get if state.exists else (-1.0, 0.0, 0.0, "")
        track = [float(t) for t in kept.split(",") if t]
        for b in batches:
            for t, la, lo in b.sort_values("s")[["s", "lat", "lon"]].itertuples(index=False):
                if t >= last:
                    last, lat, lon = float(t), float(la), float(lo)
                if not track or t - track[-1] >= STEP_S:
                    track.append(float(t))
        track = [t for t in track if t >= last - KEEP_S]
        state.update((last, lat, lon, ",".join(repr(t) for t in track)))
        state.setTimeoutTimestamp(max(int((last + KEEP_S) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"vessel": [int(key[0])], "last_s": [last], "lat": [lat], "lon": [lon], "track_points": [len(track)]})

    seconds = fixes.withColumn("s", F.unix_micros("ts") / 1000000)
    out = (seconds.withWatermark("ts", "1 day").groupBy("vessel")
           .applyInPandasWithState(fold, VESSEL_OUT, VESSEL_STATE, "update", "EventTimeTimeout"))
    return out.select("vessel", F.timestamp_micros((F.col("last_s") * 1000000).cast("long")).alias("last_ts"), "lat", "lon", "track_points")


def health(status: DataFrame, now, ok_hours=24, stale_hours=72) -> DataFrame:
    """collecting / ok / stale / error per source from its newest stamp and last error."""
    age = F.timestamp_diff("HOUR", F.col("newest"), now)
    return status.withColumn("age_h", age).withColumn("status", F.when(F.col("newest").isNull(), "collecting").when(F.col("failed"), "error")
                                                      .when(age > stale_hours, "stale").when(age > ok_hours, "late").otherwise("ok"))


def restate_sink(path: str, day="day"):
    """foreachBatch writer that rewrites the day partitions present in the batch."""
    def write(batch, epoch):
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    return write


def drain(stream: DataFrame, mode="append") -> DataFrame:
    """Run a stream over everything that has arrived and return its output table, written to the cluster's shared folder.

    In update mode each batch owns one folder, so a batch that is tried again replaces itself."""
    spark = stream.sparkSession
    home = shared_folder(spark, f"stream-{uuid.uuid4().hex}")
    out, schema = f"{home}/out", stream.schema
    w = stream.writeStream.option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", out).start()
    else:
        schema = schema.add("epoch", "long")
        q = w.outputMode(mode).foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out)
