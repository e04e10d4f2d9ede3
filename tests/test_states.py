"""Keyed state over several micro-batches: thinning, late fixes, class, expiry, and sources that fall silent and come back."""
import datetime as dt

from pyspark.sql import functions as F

from tocsin.streaming import states

T0 = dt.datetime(2024, 3, 1)


def run(spark, tmp_path, batches, schema, job):
    """Feeds one file after another to a stream and returns its rows by batch."""
    src = tmp_path / "in"
    src.mkdir()
    out = []
    stream = job(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(
            lambda df, n: out.append([tuple(r) for r in df.collect()])).trigger(availableNow=True).start()
        q.awaitTermination()
        out.append(i)
    return out


def after(out, i):
    """Rows of the i-th file."""
    ends = [k for k, x in enumerate(out) if isinstance(x, int)]
    return [r for b in out[(ends[i - 1] if i else -1) + 1:ends[i]] for r in b]


def test_tracks_are_thinned_kept_and_expire(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)      # noqa: E731
    fix = lambda v, m, c=None, lat=1.0: (v, at(m), lat, m / 100, c)      # noqa: E731
    batches = [[fix(1, 0, "navy"), fix(1, 5), fix(1, 10), fix(1, 25), fix(2, 3), (2, at(4), 95.0, 0.0, "x")],
               [fix(1, 12), fix(1, 30), fix(1, 35)],              # one late fix within the track's reach
               [fix(3, 60 * 24 * 5)],                             # five days on: the watermark passes both vessels
               [fix(1, 60 * 24 * 5 + 60)]]
    out = run(spark, tmp_path, batches, "vessel long, ts timestamp, lat double, lon double, cls string", states.vessel_tracks)
    first = after(out, 0)
    assert sorted(r[5] for r in first if r[0] == 1 and r[1] == "track") == [0.0, 0.1, 0.25]
    assert [(r[2], r[5]) for r in first if r[0] == 1 and r[1] == "newest"] == [("navy", 0.25)]
    assert [r[5] for r in first if r[0] == 2 and r[1] == "newest"] == [0.03]
    second = after(out, 1)
    assert [r[5] for r in second if r[1] == "track"] == [0.35] and [(r[2], r[5]) for r in second if r[1] == "newest"] == [("navy", 0.35)]
    third = after(out, 2)
    assert sorted((r[0], r[2]) for r in third if r[1] == "expired") == [(1, "navy"), (2, None)]
    fourth = [r for r in after(out, 3) if r[0] == 1]
    assert sorted(r[1] for r in fourth) == ["newest", "track"] and fourth[0][2] is None        # begins anew, class forgotten


def test_silent_sources_turn_late_then_stale_and_come_back(spark, tmp_path):
    at = lambda h: T0 + dt.timedelta(hours=h)      # noqa: E731
    batches = [[(1, at(0)), (2, at(0))], [(2, at(30))], [(2, at(31)), (2, at(80))], [(1, at(81))]]
    out = run(spark, tmp_path, batches, "source long, ts timestamp", states.silence)
    got = [sorted((r[0], r[1]) for r in after(out, i)) for i in range(4)]
    assert got[0] == [(1, "ok"), (2, "ok")]
    assert (1, "late") in got[1] and (2, "late") not in got[1]
    assert (1, "stale") in got[2]
    assert (1, "ok") in got[3]
