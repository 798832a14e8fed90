"""Keyed operators on streams with typed state and timers (transformWithStateInPandas).

State is kept column by column in the state store, never as one blob: values for what a key has, maps and lists for what it holds back.
Timers bring out what time alone causes: a lookup that is tried again, a source that has gone silent, a hole that is given up. A key is
the unit of parallelism; its events of one micro-batch are put in order, and results do not depend on where micro-batches are cut.

With event time a timer fires once the watermark has passed it; with processing time, by the clock.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from hopline.schemas import schema
from hopline.storage import scratch
from hopline.streaming.machines import Revisions

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which typed state and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


class Keyed(StatefulProcessor):
    """Steps over a key's rows in order. ``by``: names of the key's columns; ``OUT``: what comes out besides them, as DDL."""

    OUT = ""
    ORDER: tuple[str, ...] = ("at_ms",)

    def __init__(self, by: list[str]):
        self.by = by
        self.columns = [*by, *schema(self.OUT).fieldNames()]

    def close(self) -> None:
        pass

    def ordered(self, batches: Iterator[pd.DataFrame]) -> list[dict]:
        rows = pd.concat(list(batches)).sort_values(list(self.ORDER), kind="stable")
        return rows.astype(object).where(lambda d: d.notna(), None).to_dict("records")

    def frames(self, key: tuple, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([{**dict(zip(self.by, key)), **r} for r in rows], columns=self.columns).astype(object)

    def on(self, stream: DataFrame, mode: str = "append", time: str = "None") -> DataFrame:
        kinds = dict(stream.dtypes)
        out = schema(", ".join([*[f"{c} {kinds[c]}" for c in self.by], self.OUT]))
        return stream.groupBy(*self.by).transformWithStateInPandas(self, out, mode, time)


class Lookups(Keyed):
    """One lookup for each revision and track, and after an error another one every ``retry_ms`` while the track stays, event or not (ST16).

    Rows: at_ms, revision, track_key (null: nothing to look up). ``lookup(revision, track_key, attempt)`` gives found, not_found or error; the
    first two hold until the track changes. With ``clock`` "event" a retry has the time at which it is due; with "processing" the
    time by the clock, and so do events.
    """

    OUT = "at_ms long, revision long, track_key string, attempt int, outcome string"

    def __init__(self, by: list[str], lookup: Callable[[int, str, int], str], retry_ms: int = 60_000, clock: str = "event", order: tuple[str, ...] = ("at_ms",)):
        super().__init__(by)
        self.lookup, self.retry, self.clock, self.ORDER = lookup, retry_ms, clock, order

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lookup", "revision long, track_key string, at long, attempt int, outcome string")

    def _try(self, revision: int, key: str, at: int, attempt: int, out: list[dict]) -> tuple:
        outcome = self.lookup(revision, key, attempt)
        out.append({"at_ms": at, "revision": revision, "track_key": key, "attempt": attempt, "outcome": outcome})
        return revision, key, at, attempt, outcome

    def _retried(self, s: tuple | None, until: int, out: list[dict]) -> tuple | None:
        """s after the retries that are due before ``until``."""
        while s and s[4] == "error" and s[2] + self.retry < until:
            s = self._try(s[0], s[1], s[2] + self.retry if self.clock == "event" else until - 1, s[3] + 1, out)
        return s

    def _kept(self, before: tuple | None, s: tuple | None) -> None:
        due = [x[2] + self.retry if x and x[4] == "error" else None for x in (before, s)]
        if due[0] != due[1]:
            if due[0] is not None:
                self.handle.deleteTimer(due[0])
            if due[1] is not None:
                self.handle.registerTimer(due[1])
        if s is None:
            self.state.clear()
        elif s != before:
            self.state.update(s)

    def handleInputRows(self, key, rows, timerValues):
        before = s = tuple(self.state.get()) if self.state.exists() else None
        out: list[dict] = []
        for r in self.ordered(rows):
            at = int(r["at_ms"]) if self.clock == "event" else timerValues.getCurrentProcessingTimeInMs()
            s = self._retried(s, at, out)
            if r["track_key"] is None:
                s = None
            elif s is None or (int(r["revision"]), r["track_key"]) != s[:2]:
                s = self._try(int(r["revision"]), r["track_key"], at, 0, out)
        self._kept(before, s)
        yield from self.frames(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        before = s = tuple(self.state.get()) if self.state.exists() else None
        out: list[dict] = []
        now = timerValues.getCurrentWatermarkInMs() if self.clock == "event" else timerValues.getCurrentProcessingTimeInMs()
        s = self._retried(s, now + 1, out)
        self._kept(before, s)
        yield from self.frames(key, out)


class Silence(Keyed):
    """A row for each time that a source has been silent for longer than its limit, as soon as that is known (FL11).

    Rows: at_ms, limit_ms (the source's). ``stale_ms`` is when the limit was reached.
    """

    OUT = "last_ms long, stale_ms long"

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "last long, limit long, told boolean")

    def handleInputRows(self, key, rows, timerValues):
        before = s = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for r in self.ordered(rows):
            at = int(r["at_ms"])
            if s and not s[2] and at - s[0] > s[1]:
                out.append({"last_ms": s[0], "stale_ms": s[0] + s[1]})
            s = (max(at, s[0]) if s else at, int(r["limit_ms"]), False)
        if before and not before[2]:
            self.handle.deleteTimer(before[0] + before[1] + 1)
        self.handle.registerTimer(s[0] + s[1] + 1)
        self.state.update(s)
        yield from self.frames(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, limit, told = self.state.get()
        if not told:
            self.state.update((last, limit, True))
            yield from self.frames(key, [{"last_ms": last, "stale_ms": last + limit}])


class InOrder(Keyed):
    """Rows by sequence, each number once: what comes too early waits, what comes too late is dropped (ST1, SC3).

    Rows: sequence, the ``payload`` columns, and at_ms where ``patience_ms`` is given. The first number is ``first``. A hole holds up
    what follows; with patience (and event time) it is given up once a row has waited for so long behind it, and the row after it
    comes out with ``gap``. What waits is kept in a map, so a micro-batch touches only the numbers that it brings or brings out.
    """

    ORDER = ("sequence",)

    def __init__(self, by: list[str], payload: str, first: int = 1, patience_ms: int | None = None):
        self.OUT = f"sequence long, gap boolean, {payload}"
        super().__init__(by)
        self.payload, self.first, self.patience = payload, first, patience_ms
        self.names = schema(payload).fieldNames()

    def init(self, handle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "sequence long, timer long")
        self.held = handle.getMapState("held", "sequence long", f"at long, {self.payload}")

    def _run(self, at: int, rows: dict[int, tuple], gap: bool, out: list[dict]) -> int:
        """The number after the run from ``at``; its rows go to ``out``."""
        while True:
            row = rows.pop(at, None)
            if row is None:
                if not self.held.containsKey((at,)):
                    return at
                row = tuple(self.held.getValue((at,)))
                self.held.removeKey((at,))
            out.append({"sequence": at, "gap": gap, **dict(zip(self.names, row[1:]))})
            at, gap = at + 1, False

    def _waiting(self, at: int, timer: int | None) -> None:
        """Keep the next number; a timer for the row that has waited longest, if any waits."""
        due = None
        if self.patience is not None:
            since = [v[0] for _, v in self.held.iterator()]
            due = min(since) + self.patience if since else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.next.update((at, due))

    def handleInputRows(self, key, rows, timerValues):
        at, timer = self.next.get() if self.next.exists() else (self.first, None)
        came: dict[int, tuple] = {}
        for r in self.ordered(rows):
            if int(r["sequence"]) >= at:
                came.setdefault(int(r["sequence"]), (int(r.get("at_ms") or 0), *[r[c] for c in self.names]))
        out: list[dict] = []
        at = self._run(at, came, False, out)
        for n, row in came.items():
            if not self.held.containsKey((n,)):
                self.held.updateValue((n,), row)
        self._waiting(at, timer)
        yield from self.frames(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, timer = self.next.get()
        out: list[dict] = []
        now, held = timerValues.getCurrentWatermarkInMs(), {k[0]: v[0] for k, v in self.held.iterator()}
        while any(since + self.patience <= now for since in held.values()):
            at = self._run(min(held), {}, True, out)
            held = {n: since for n, since in held.items() if n >= at}
        self._waiting(at, timer)
        yield from self.frames(key, out)


class Recorder(Keyed):
    """The acceptance figures of a session since it was last started or stopped (ST15), after each micro-batch that changes them.

    Rows: at_ms, action (null for a sample; start, start_airplay and stop begin anew, other commands are passed over) and the fields of a
    telemetry sample. What comes out has the columns from which ``telemetry.requirements`` tells the state; ``version`` rises, so an
    upsert keeps the newest. A session that has been reset and has no sample since has 0 samples.
    """

    COUNTERS = ("underruns", "device_recoveries", "skipped_sequence", "mixer_updates")
    RISES = ("captured_sequence", "gpu_sequence", "cache_hits", "cache_misses")
    RESETS = ("start", "start_airplay", "stop")
    COUNTS = ("samples", "streaming_samples", "playing_samples", "active_samples", "replay_samples")
    OUT = ", ".join(
        [
            "version long",
            *[f"{c} long" for c in COUNTS],
            *[f"{c}_delta long" for c in RISES],
            "initial_songs_cached long, maximum_songs_cached long, latest_songs_cached long, maximum_pending_windows long, minimum_active_buffer_seconds double, recovering_seen boolean",
            *[f"active_{c}_delta long" for c in COUNTERS],
            *[f"{c}_reset boolean" for c in COUNTERS[:3]],
            "max_latency_ms double",
        ]
    )
    STATE = ", ".join(
        [
            "version long, active boolean",
            *[f"{c} long" for c in COUNTS],
            *[f"first_{c} long, most_{c} long" for c in RISES],
            "initial_songs_cached long, maximum_songs_cached long, latest_songs_cached long, maximum_pending_windows long, minimum_active_buffer_seconds double, recovering_seen boolean",
            *[f"{c}_at_start long, {c}_most long, {c}_done long, {c}_last long, {c}_fell boolean" for c in COUNTERS],
            "max_latency_ms double",
        ]
    )

    def __init__(self, by: list[str]):
        super().__init__(by)
        zero = {"bigint": 0, "boolean": False, "double": 0.0}
        self.zero = {f.name: zero[f.dataType.simpleString()] for f in schema(self.STATE).fields} | {"minimum_active_buffer_seconds": None}

    def init(self, handle) -> None:
        self.state = handle.getValueState("figures", self.STATE)

    def _observe(self, s: dict, r: dict) -> None:
        count = lambda c: max(0, int(r.get(c) or 0))
        metric = lambda c: float(x) if (x := r.get(c)) is not None and math.isfinite(x) and x >= 0 else 0.0
        playing, streaming = r.get("playback_state") == "playing", bool(r.get("streaming"))
        active, fresh = streaming or playing, not s["samples"]
        for c in self.RISES:
            s[f"first_{c}"] = count(c) if fresh else s[f"first_{c}"]
            s[f"most_{c}"] = max(s[f"most_{c}"], count(c))
        songs = count("songs_cached")
        s["initial_songs_cached"] = songs if fresh else s["initial_songs_cached"]
        s["maximum_songs_cached"], s["latest_songs_cached"] = max(s["maximum_songs_cached"], songs), songs
        s["maximum_pending_windows"] = max(s["maximum_pending_windows"], count("pending_windows"))
        continues = s["active"] and active
        rose = count("mixer_updates") > s["mixer_updates_last"]
        for c in self.COUNTERS:
            now = count(c)
            if active and not continues:
                s[f"{c}_at_start"] = s[f"{c}_most"] = now
            elif active:
                s[f"{c}_most"] = max(s[f"{c}_most"], now)
                s[f"{c}_fell"] = s[f"{c}_fell"] or now < s[f"{c}_last"]
            elif s["active"]:
                s[f"{c}_done"] += max(0, s[f"{c}_most"] - s[f"{c}_at_start"])
                s[f"{c}_at_start"] = s[f"{c}_most"] = 0
            s[f"{c}_last"] = now
        if active:
            least, buffered = s["minimum_active_buffer_seconds"], metric("ready_buffer_seconds")
            s["minimum_active_buffer_seconds"] = buffered if least is None else min(least, buffered)
            s["recovering_seen"] = s["recovering_seen"] or bool(r.get("device_recovering"))
            if continues and rose:
                s["max_latency_ms"] = max(s["max_latency_ms"], metric("last_mixer_control_latency_ms"))
        replayed = bool(r.get("cache_hit")) and r.get("cache_scope") in ("song", "song-composite") and count("cache_hits") > s["first_cache_hits"]
        for c, more in zip(self.COUNTS, (True, streaming, playing, active, replayed)):
            s[c] += int(more)
        s["active"] = active

    def handleInputRows(self, key, rows, timerValues):
        s = dict(zip(self.zero, self.state.get())) if self.state.exists() else dict(self.zero)
        for r in self.ordered(rows):
            if r["action"] in self.RESETS:
                s = {**self.zero, "version": s["version"]}
            elif r["action"] is None:
                self._observe(s, r)
            s["version"] += 1
        self.state.update(tuple(s.values()))
        out = s | {f"{c}_delta": s[f"most_{c}"] - s[f"first_{c}"] for c in self.RISES}
        out |= {f"active_{c}_delta": s[f"{c}_done"] + max(0, s[f"{c}_most"] - s[f"{c}_at_start"]) for c in self.COUNTERS}
        out |= {f"{c}_reset": s[f"{c}_fell"] for c in self.COUNTERS[:3]}
        yield from self.frames(key, [out])


class Anchors(Keyed):
    """A session's anchors, again whenever late metadata changes them (ST11); the last 4,096 are kept for that (TK7).

    Rows and rules are those of ``machines.Revisions``. ``number`` counts a session's anchors, ``version`` what has come out: an upsert
    by number keeps the newest version.
    """

    NOW = "number long, revision long, metadata_revision long, start_rtp long, current_rtp long, end_rtp long, has_progress boolean, anchor_stream_frame long, title string, artist string, album string"
    OUT = f"{NOW}, backfilled boolean, version long"
    ORDER = ("stream_frame",)

    def __init__(self, by: list[str], sample_rate: int = 44100, order: tuple[str, ...] = ("stream_frame",)):
        super().__init__(by)
        self.rate, self.ORDER = sample_rate, order
        self.names = schema(self.NOW).fieldNames()

    def init(self, handle) -> None:
        self.now = handle.getValueState("now", f"version long, {self.NOW}")
        self.anchors = handle.getListState("anchors", self.NOW)

    def handleInputRows(self, key, rows, timerValues):
        machine, version = Revisions(self.rate), 0
        machine.now["number"] = 0
        if self.now.exists():
            version, *now = self.now.get()
            machine.now = dict(zip(self.names, now))
            machine.anchors = [dict(zip(self.names, a)) for a in self.anchors.get()]
        out = []
        for r in self.ordered(rows):
            machine.now["number"] += r["kind"] == "progress"
            for o in machine.step(r):
                version += 1
                out.append({**o, "version": version})
        self.now.update((version, *[machine.now[c] for c in self.names]))
        if out:
            self.anchors.put([tuple(a[c] for c in self.names) for a in machine.anchors])
        yield from self.frames(key, out)


def upserted(stream: DataFrame, by: list[str], name: str, version: str = "version") -> DataFrame:
    """The newest row of each key that a stream in update mode gives for what is there now.

    Each micro-batch is written under its number, so one that is run again replaces itself; readers take the newest version.
    """
    spark = stream.sparkSession
    at = scratch(spark, name)

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")

    with state_store(spark):
        query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{at}/rows")
    return rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in by]), version).alias("_hl_newest")).select(*by, "_hl_newest.*")
