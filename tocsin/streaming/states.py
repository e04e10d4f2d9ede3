"""Keyed state with timers: vessels with their tracks, and sources that fall silent.

State lives in the state store under one key each; a call sees one key's rows of one micro-batch. Timers run on event time, so a replay
gives the same rows as the live run: they fire when the watermark passes them.
"""
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STEP_S, KEEP_S = 600, 48 * 3600             # Fixed values: a track point per ten minutes, kept two days
LATE_H, STALE_H = 24, 72                    # Fixed values: hours without a stamp until a source is late, stale
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRACK_ROWS = "vessel bigint, kind string, cls string, s double, lat double, lon double"
STATUS_ROWS = "source bigint, status string, since_s double"


def keyed_store(spark: SparkSession) -> None:
    """Timers and list state need this store; it is chosen for the session if it isn't set to it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Tracks(StatefulProcessor):
    """Newest fix of a vessel in a value, its thinned track in a list, and a timer that drops both after KEEP_S without a fix."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "s double, lat double, lon double, ship string")
        self.track = handle.getListState("track", "s double, lat double, lon double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd
        new = pd.concat(list(rows)).sort_values(["s", "lat", "lon"])
        last = self.newest.get() if self.newest.exists() else None
        track = list(self.track.get()) if self.track.exists() else []
        cls = new["cls"].dropna()
        cls = cls.iloc[-1] if len(cls) else (last[3] if last else None)
        s, lat, lon = (new[c].to_numpy(float) for c in ("s", "lat", "lon"))
        if last is None or s[-1] >= last[0]:
            last = (float(s[-1]), float(lat[-1]), float(lon[-1]), cls)
        else:
            last = (*last[:3], cls)
        added, at = [], 0 if not track else int(np.searchsorted(s, track[-1][0] + STEP_S))
        while at < len(s):                                          # from one kept point to the next
            added.append((float(s[at]), float(lat[at]), float(lon[at])))
            at = int(np.searchsorted(s, s[at] + STEP_S))
        kept = [p for p in [*track, *added] if p[0] >= last[0] - KEEP_S]
        self.newest.update(last)
        self.track.put(kept)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(int((last[0] + KEEP_S) * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        out = [("newest", last[3], *last[:3])] + [("track", last[3], *p) for p in added if p[0] >= last[0] - KEEP_S]
        yield pd.DataFrame([(int(key[0]), *r) for r in out], columns=["vessel", "kind", "cls", "s", "lat", "lon"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd
        s, lat, lon, cls = self.newest.get()
        self.newest.clear()
        self.track.clear()
        yield pd.DataFrame([(int(key[0]), "expired", cls, s, lat, lon)], columns=["vessel", "kind", "cls", "s", "lat", "lon"])

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """A source's newest stamp; two timers tell when it has been silent for LATE_H and STALE_H hours. A stamp brings it back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "s double, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd
        s = max(float(b["s"].max()) for b in rows)
        failed_before = self.seen.get()[1] if self.seen.exists() else None
        s = max(s, self.seen.get()[0]) if failed_before is not None else s
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        now = timerValues.getCurrentWatermarkInMs()
        for h in (LATE_H, STALE_H):
            self.handle.registerTimer(max(int((s + h * 3600) * 1000), now + 1 + h))
        self.seen.update((s, "ok"))
        if failed_before != "ok":
            yield pd.DataFrame([(int(key[0]), "ok", s)], columns=["source", "status", "since_s"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd
        s, _ = self.seen.get()
        late = not list(self.handle.listTimers()) or expiredTimerInfo.getExpiryTimeInMs() >= int((s + STALE_H * 3600) * 1000)
        status = "stale" if late else "late"
        self.seen.update((s, status))
        yield pd.DataFrame([(int(key[0]), status, s)], columns=["source", "status", "since_s"])

    def close(self) -> None:
        pass


def vessel_tracks(fixes: DataFrame, late="1 day") -> DataFrame:
    """fixes: vessel, ts, lat, lon, cls (null if not known). Rows: `newest` per vessel and micro-batch, `track` for every point the track gains,
    `expired` when nothing came for two days of event time."""
    keyed_store(fixes.sparkSession)
    s = fixes.select("vessel", "ts", F.when(F.col("lat").between(-90, 90), F.col("lat")).alias("lat"), F.when(F.col("lon").between(-180, 180), F.col("lon")).alias("lon"), "cls",
                     (F.unix_micros("ts") / 1000000).alias("s")).where("lat is not null and lon is not null")
    return s.withWatermark("ts", late).groupBy("vessel").transformWithStateInPandas(Tracks(), TRACK_ROWS, "update", "EventTime")


def silence(stamps: DataFrame, late="0 seconds") -> DataFrame:
    """stamps: source, ts. A row whenever a source's status changes: ok, late, stale."""
    keyed_store(stamps.sparkSession)
    s = stamps.select("source", "ts", (F.unix_micros("ts") / 1000000).alias("s"))
    return s.withWatermark("ts", late).groupBy("source").transformWithStateInPandas(Silence(), STATUS_ROWS, "update", "EventTime")
