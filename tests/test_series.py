"""Boundary cases of filling, scoring, labels and windows."""
import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from tocsin.operators import calendar, labels, ranking, robust, transforms, windows
from tocsin.sources import series

D0 = dt.date(2023, 1, 1)


def frame(spark, values, sid="a"):
    rows = [(sid, D0 + dt.timedelta(i), float(v)) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "series_id string, day date, value double")


def newest(spark, values, **kw):
    r = robust.score_daily(frame(spark, values), newest_only=True, **kw).collect()
    return r[0] if r else None


def test_gap_of_two_is_filled_and_of_three_is_not(spark):
    f = {r.day: (r.value, r.filled) for r in calendar.fill(frame(spark, [1, None, None, 4, None, None, None, 8])).collect()}
    assert f[D0 + dt.timedelta(2)] == (1.0, True)
    assert f[D0 + dt.timedelta(5)] == (4.0, True)
    assert f[D0 + dt.timedelta(6)] == (None, False)


def test_flat_history_gives_zero_or_the_limit(spark):
    assert newest(spark, [5.0] * 500).z == 0
    assert newest(spark, [5.0] * 493 + [9.0] * 7).z == 5
    assert newest(spark, [5.0] * 493 + [1.0] * 7).z == -5


def test_short_history_uses_the_plain_baseline_and_too_short_has_no_score(spark):
    assert newest(spark, [float(i % 5) for i in range(100)]).frame == "short"
    assert newest(spark, [float(i % 5) for i in range(51)]) is None


def test_guard_keeps_the_newest_month_out_of_the_baseline(spark):
    base = [10.0 + (i % 7) for i in range(470)]
    a, b = newest(spark, base + [30.0] * 7), newest(spark, base[:450] + [30.0] * 20 + [30.0] * 7)
    assert a.base_med == pytest.approx(b.base_med)


def test_score_against_a_direct_computation(spark):
    vals = [((i * 7919) % 101) / 10 for i in range(480)]
    m7 = [sum(vals[i - 6:i + 1]) / 7 for i in range(6, 480)]
    base = m7[-396:-30]
    med = statistics.median(base)
    mad = statistics.median(abs(x - med) for x in base)
    r = newest(spark, vals)
    assert r.base_n == len(base) == 366
    assert r.z == pytest.approx(max(-5, min(5, 0.6745 * (m7[-1] - med) / mad)))


def test_a_future_point_never_changes_a_past_score(spark):
    vals = [((i * 31) % 17) * 1.0 for i in range(460)]
    a = {r.day: r.z for r in robust.score_daily(frame(spark, vals)).collect()}
    b = {r.day: r.z for r in robust.score_daily(frame(spark, vals + [900.0])).collect()}
    assert all(b[d] == z for d, z in a.items())


def test_step_needs_a_point_in_its_gap(spark):
    r = transforms.step(frame(spark, [2] + [None] * 13 + [3])).collect()
    assert [(x.z_raw, x.z) for x in r] == [(3.0, 3.0)]
    assert not transforms.step(frame(spark, [2] + [None] * 44 + [3])).collect()


def test_label_window_edges(spark):
    days = spark.createDataFrame([("x", D0 + dt.timedelta(i)) for i in range(120)], "theatre string, day date")
    ev = spark.createDataFrame([("x", D0 + dt.timedelta(60), 1)], "theatre string, day date, event_id long")
    thr = spark.createDataFrame([(D0 + dt.timedelta(119),)], "d date")
    r = {x.day: x for x in labels.build(days, ev, thr).collect()}
    at = lambda k: r[D0 + dt.timedelta(60 - k)]     # noqa: E731
    assert (at(30).y, at(31).y, at(1).y, at(0).y) == (1, 0, 1, 0)
    assert at(0).excl and at(-30).excl and not at(-31).excl and not at(1).excl
    assert r[D0 + dt.timedelta(90)].unk and not r[D0 + dt.timedelta(89)].unk


def test_runs_bridge_short_gaps_only(spark):
    on = [1, 1, 0, 0, 1] + [0] * 9 + [1]
    f = frame(spark, on).withColumn("on", F.col("value") > 0)
    assert sorted(r.days for r in windows.runs(f, ["series_id"], bridge=7).collect()) == [1, 5]


def test_waves_join_at_exactly_the_gap_and_across_buckets(spark):
    t = dt.datetime(2024, 1, 1, 23, 55)
    rows = [(1, t), (1, t + dt.timedelta(minutes=10)), (1, t + dt.timedelta(minutes=20, seconds=1))]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz")
    assert sorted(r.rows for r in ranking.islands(df, ["k"], "ts", 600).collect()) == [1, 2]


def test_ewma_and_kept_gap(spark):
    e = [r.ewma for r in windows.ewma(frame(spark, [1, 2, 3]), ["series_id"]).orderBy("day").collect()]
    assert e == pytest.approx([1.0, 1.3, 1.81])


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "civil_x.csv").write_text("2024-01-01,3\nbad\n2024-01-02,4.5\n")
    got = series.read_series(spark, str(tmp_path / "s")).collect()
    assert [(r.series_id, r.value) for r in got] == [("civil_x", 3.0), ("civil_x", 4.5)]
    d = spark.createDataFrame([(D0, 1), (D0 + dt.timedelta(1), 2)], "day date, v int")
    p = str(tmp_path / "t")
    series.replace_days(d, p)
    series.replace_days(spark.createDataFrame([(D0, 9)], "day date, v int"), p)
    assert sorted((r.v) for r in spark.read.parquet(p).collect()) == [2, 9]
    q = str(tmp_path / "u")
    assert series.write_if_changed(d, q) and not series.write_if_changed(d.orderBy(F.desc("v")), q)
    assert series.write_if_changed(d.withColumn("v", F.col("v") + 1), q)
    ts = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 5), 1.0)], "series_id string, ts timestamp, value double")
    series.append_snapshot(ts, str(tmp_path / "snap"))
    series.append_snapshot(ts, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 2
    series.write_json(spark.createDataFrame([("k", "i", 1)], "kind string, id string, v int"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
