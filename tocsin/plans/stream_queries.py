"""Streaming jobs drained over the event table, and the hash-chained record."""
from pyspark.sql import functions as F

from tocsin.operators import ranking, record
from tocsin.operators.lineage import stable
from tocsin.plans import bindings as B
from tocsin.plans.bindings import with_ctes
from tocsin.plans.registry import query
from tocsin.streaming import jobs as J, ledger, states

END = "(SELECT max(ts) FROM events)"


def events(spark, sf):
    return J.with_time(J.source(spark, sf, "events"))


def ntz(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


WAVES = """SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS alerts FROM (
  SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM (
    SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id), ts) > 600000000 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY event_type, run"""


@query("alert_waves_batch", "SELECT event_type, first_ts AS started, last_ts AS ended, alerts AS rows FROM (" + WAVES + ")")
def alert_waves_batch(spark, sf):
    """Gap-based waves over the whole table in two levels, so a busy key is never one task."""
    return ranking.islands(B.table(spark, sf, "events"), ["event_type"], "ts", 600)


@query("alert_waves_stream", f"SELECT * FROM ({WAVES}) WHERE last_ts + INTERVAL 10 MINUTE <= {END}")
def alert_waves_stream(spark, sf):
    """Session windows drained to the watermark."""
    return ntz(J.drain(J.waves(events(spark, sf), keys=("event_type",))), "first_ts", "last_ts")


@query("weekly_wave_counts", f"""
  SELECT event_type, d.day AS through, count(*) AS waves FROM ({WAVES}) w JOIN (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY))::DATE AS day) d
  ON w.first_ts >= d.day - INTERVAL 7 DAY AND w.first_ts < d.day GROUP BY 1, 2""")
def weekly_wave_counts(spark, sf):
    """Waves in each seven-day window, one window per day."""
    w = ranking.islands(B.table(spark, sf, "events"), ["event_type"], "ts", 600)
    return (w.groupBy("event_type", F.window("started", "7 days", "1 day")).agg(F.count(F.lit(1)).alias("waves"))
            .select("event_type", F.to_date("window.end").alias("through"), "waves"))


@query("daily_snapshots_stream", f"SELECT event_type, ts::DATE AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2 HAVING ts::DATE + 1 <= {END}")
def daily_snapshots_stream(spark, sf):
    d = J.drain(J.daily(events(spark, sf), ["event_type"]))
    return d.select("event_type", "day", "n", F.round("mean", 6).alias("mean"))


@query("sliding_counts_stream", f"""
  SELECT event_type, d.day AS through, count(*) AS n FROM events e JOIN (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY))::DATE AS day) d
  ON e.ts >= d.day - INTERVAL 7 DAY AND e.ts < d.day WHERE d.day <= {END} GROUP BY 1, 2""")
def sliding_counts_stream(spark, sf):
    return J.drain(J.sliding(events(spark, sf), ["event_type"]))


@query("firehose_tally_stream", f"SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE <= {END}")
def firehose_tally_stream(spark, sf):
    return ntz(J.drain(J.tally(events(spark, sf), ["event_type"])), "start")


@query("deduplicated_stream", "SELECT count(DISTINCT event_id) AS n, count(DISTINCT event_id) AS ids FROM events")
def deduplicated_stream(spark, sf):
    """Alerts seen twice pass once."""
    e = events(spark, sf)
    twice = e.select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    d = J.drain(J.dedupe(twice, ["event_id"]))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("distinct_entities_stream", f"SELECT ts::DATE AS day, count(DISTINCT user_id) AS n FROM events GROUP BY 1 HAVING ts::DATE + 1 <= {END} - INTERVAL 1 DAY")
def distinct_entities_stream(spark, sf):
    return J.drain(J.distinct_per_day(events(spark, sf), "user_id"))


@query("vessel_state_stream", """
  SELECT user_id AS vessel, max(ts)::DATE AS last_day, arg_max((30000 + event_id * 37 % 1000) / 1000.0::DOUBLE, ts) AS lat FROM events GROUP BY 1""")
def vessel_state_stream(spark, sf):
    """Newest fix and thinned track per vessel from keyed state."""
    e = events(spark, sf).select(F.col("user_id").alias("vessel"), "ts", ((30000 + F.col("event_id") * 37 % 1000) / 1000).alias("lat"), ((40000 + F.col("event_id") * 53 % 1000) / 1000).alias("lon"))
    s = J.drain(J.vessel_state(e), mode="update")
    return s.groupBy("vessel").agg(F.max_by(F.struct("last_ts", "lat"), F.struct("epoch", "last_ts")).alias("m")).select("vessel", F.to_date("m.last_ts").alias("last_day"), F.col("m.lat").alias("lat"))


@query("publication_lag_stream", f"SELECT (ts + INTERVAL 3 DAY)::DATE AS avail_day, count(*) AS n FROM events GROUP BY 1 HAVING (ts + INTERVAL 3 DAY)::DATE + 1 <= {END} + INTERVAL 3 DAY")
def publication_lag_stream(spark, sf):
    """Counts per publication day, with the watermark on the day a point became public."""
    p = J.public_on(events(spark, sf), 3)
    d = p.groupBy(F.window("avail", "1 day")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("avail_day"), "n")
    return J.drain(d)


@query("source_status", "SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 200) THEN 'error' WHEN h > 72 THEN 'stale' WHEN h > 24 THEN 'late' ELSE 'ok' END AS status FROM (SELECT *, date_diff('second', max(date_trunc('second', ts)) OVER (PARTITION BY user_id), TIMESTAMP '2024-02-01 00:00:00') // 3600 AS h FROM events) GROUP BY user_id, h")
def source_status(spark, sf):
    s = B.table(spark, sf, "events").groupBy("user_id").agg(F.max(F.date_trunc("second", "ts")).cast("timestamp_ntz").alias("newest"), F.bool_or((F.col("event_type") == "error") & (F.col("value") > 200)).alias("failed"))
    return J.health(s, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).select("user_id", "status")


# ------------------------------------------------------------------ hash-chained record
FIELDS = ["nation", "month", "value"]
CHAIN = [("r", "SELECT nation, month, value, row_number() OVER (PARTITION BY nation ORDER BY month) - 1 AS seq FROM monthly"),
         ("ch", "SELECT nation, month, value, seq, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '|' || nation || '|' || month || '|' || value) AS hash FROM r WHERE seq = 0 UNION ALL "
                "SELECT r.nation, r.month, r.value, r.seq, c.hash, sha256(c.hash || '|' || r.nation || '|' || r.month || '|' || r.value) FROM ch c JOIN r ON r.nation = c.nation AND r.seq = c.seq + 1")]


def chain_sql(body):
    return with_ctes(["monthly"], body, CHAIN).replace("WITH ", "WITH RECURSIVE ", 1).replace("ch AS MATERIALIZED", "ch AS")


def chained(spark, sf):
    return record.chain(B.monthly(spark, sf).withColumn("n2", F.col("nation")).withColumnRenamed("nation", "chain").withColumnRenamed("n2", "nation"), "month", FIELDS, by=("chain",))


@query("hash_chained_record", chain_sql("SELECT nation, month, value, seq, prev_hash, hash FROM ch"))
def hash_chained_record(spark, sf):
    return chained(spark, sf).select("nation", "month", "value", "seq", "prev_hash", "hash")


@query("hash_chain_verification", with_ctes(["monthly"], """
  SELECT nation AS chain, CASE WHEN nation % 2 = 1 THEN min(seq) FILTER (WHERE value > 0 AND seq >= 10) END AS first_bad, count(*) AS rows FROM r GROUP BY 1""", CHAIN[:1]))
def hash_chain_verification(spark, sf):
    """Every other chain has one row edited after the fact; verification finds exactly that row."""
    c = stable(chained(spark, sf))
    at = c.where("value > 0 and seq >= 10").groupBy("chain").agg(F.min("seq").alias("_at"))
    t = c.join(at, "chain", "left").withColumn("value", F.when((F.col("chain") % 2 == 1) & (F.col("seq") == F.col("_at")), F.col("value") + 1).otherwise(F.col("value"))).drop("_at")
    return record.verify(t, FIELDS, by=("chain",))


# ------------------------------------------------------------------ keyed state with timers
@query("vessel_tracks_stream", f"""
  SELECT user_id AS vessel, max(ts)::DATE AS last_day, arg_max(event_type, ts) AS cls, max(ts) + INTERVAL 2 DAY <= {END} - INTERVAL 1 DAY AS expired FROM events GROUP BY 1""")
def vessel_tracks_stream(spark, sf):
    """Newest fix, class and expiry of every vessel; the same rows hold its track points."""
    e = events(spark, sf).select(F.col("user_id").alias("vessel"), "ts", ((30000 + F.col("event_id") * 37 % 1000) / 1000).alias("lat"),
                                 ((40000 + F.col("event_id") * 53 % 1000) / 1000).alias("lon"), F.col("event_type").alias("cls"))
    s = J.drain(states.vessel_tracks(e), mode="update")
    newest = F.max_by(F.struct("s", "cls"), F.when(F.col("kind") == "newest", F.struct("epoch", "s"))).alias("m")
    s = s.groupBy("vessel").agg(newest, F.bool_or(F.col("kind") == "expired").alias("expired"))
    return s.select("vessel", F.to_date(F.timestamp_micros((F.col("m.s") * 1000000).cast("long"))).alias("last_day"), F.col("m.cls").alias("cls"), "expired")


@query("silent_sources_stream", f"""
  SELECT user_id AS source, count(*) FILTER (WHERE s = 'ok') AS n_ok, count(*) FILTER (WHERE s = 'late') AS n_late, count(*) FILTER (WHERE s = 'stale') AS n_stale FROM (
    SELECT user_id, 'ok' AS s FROM events GROUP BY 1 UNION ALL SELECT user_id, 'late' FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 24 HOUR <= {END}
    UNION ALL SELECT user_id, 'stale' FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 72 HOUR <= {END}) GROUP BY 1""")
def silent_sources_stream(spark, sf):
    """Status changes of every source: ok at its first stamp, late and stale when timers find it silent."""
    s = J.drain(states.silence(events(spark, sf).select(F.col("user_id").alias("source"), "ts")), mode="update")
    return s.groupBy("source").agg(*[F.count_if(F.col("status") == k).alias(f"n_{k}") for k in ("ok", "late", "stale")])


@query("chained_record_stream", """
  WITH RECURSIVE r AS MATERIALIZED (SELECT event_type, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq FROM events),
  c AS (SELECT event_type, event_id, user_id, seq, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '|' || event_type || '|' || event_id || '|' || user_id) AS hash FROM r WHERE seq = 0
    UNION ALL SELECT r.event_type, r.event_id, r.user_id, r.seq, c.hash, sha256(c.hash || '|' || r.event_type || '|' || r.event_id || '|' || r.user_id) FROM c JOIN r ON r.event_type = c.event_type AND r.seq = c.seq + 1)
  SELECT * FROM c""")
def chained_record_stream(spark, sf):
    """Events logged as one hash chain a type by a stream; every micro-batch is written twice, as a retry does, and the log holds it once."""
    home = J.shared_folder(spark, f"log-{J.uuid.uuid4().hex}")
    write = ledger.append_chain(f"{home}/log", "event_id", ["event_type", "event_id", "user_id"], "event_type")

    def twice(batch, number):
        write(batch, number)
        write(batch, number)
    q = events(spark, sf).select("event_type", "event_id", "user_id").writeStream.option("checkpointLocation", f"{home}/checkpoint").foreachBatch(twice).trigger(availableNow=True).start()
    q.awaitTermination()
    out = ledger.log(spark, f"{home}/log", "event_type string, event_id long, user_id long, seq long, prev_hash string, hash string")
    return out.drop("batch")
