"""Keyed streams with state and timers: cuts into micro-batches change nothing, and time alone brings rows out."""

import random
import time

import pytest
from pyspark.sql import functions as F

from hopline.operators import telemetry
from hopline.streaming import keyed, machines, run


def parts(spark, tmp_path, rows, ddl, n, part):
    """Rows as n files, one for each micro-batch; part(i, row) tells which."""
    at = f"file://{tmp_path}/in-{n}-{random.random()}"
    for p in range(n):
        some = [r for i, r in enumerate(rows) if part(i, r) == p]
        if some:
            spark.createDataFrame(some, ddl).coalesce(1).write.mode("append").parquet(at)
    return run.files(spark, at, ddl)


def gathered(stream, name):
    with keyed.state_store(stream.sparkSession):
        return sorted(map(tuple, run.collected(stream, name).collect()))


def test_rows_come_out_in_order_once(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, i, f"{k}{i}") for k in "ab" for i in range(1, 60)] + [("a", i, "again") for i in (3, 7, 58)] + [("b", 61, "behind a hole"), ("b", 0, "old"), ("c", 2, "no first")]
    first = [r for r in rows if r[2] not in ("again", "old")]
    rng.shuffle(first)
    late = [r for r in rows if r[2] in ("again", "old")]
    stream = parts(spark, tmp_path, first + late, "k string, sequence long, name string", 4, lambda i, r: 3 if r[2] in ("again", "old") else i % 3)
    got = gathered(keyed.InOrder(["k"], "name string").on(stream), "in-order")
    assert got == sorted((k, i, False, f"{k}{i}") for k in "ab" for i in range(1, 60))


def test_holes_are_given_up_after_patience(spark, tmp_path):
    rows = [("a", n, 1000 + at * 1000) for n, at in ((1, 0), (2, 1), (4, 2), (5, 3), (8, 4), (6, 30), (9, 200), (12, 210))] + [("z", 1, 400_000)]
    stream = parts(spark, tmp_path, rows, "k string, sequence long, at_ms long", 4, lambda i, r: min(3, i // 3))
    stream = stream.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", "1 second")
    order = keyed.InOrder(["k"], "at_ms long", patience_ms=20_000)
    got = [(n, gap) for k, n, gap, _ in gathered(order.on(stream, time="EventTime"), "patience") if k == "a"]
    # 3 never comes: 4 and 5 wait for 20 s; 6 comes before 8 is given up on; 7, 10 and 11 never come
    assert [n for n, _ in got] == [1, 2, 4, 5, 6, 8, 9, 12]
    assert {n for n, gap in got if gap} == {4, 8, 12}


@pytest.mark.parametrize("n", [1, 4])
def test_silence_does_not_depend_on_the_cuts(spark, tmp_path, n):
    rows = [("a", t, 2000) for t in (1, 1000, 3500, 5400, 9000)] + [("b", t, 6000) for t in (1, 5000, 11_000, 17_001)] + [("c", 100, 2000), ("z", 60_000, 2000)]
    rows.sort(key=lambda r: r[1])
    stream = parts(spark, tmp_path, rows, "source string, at_ms long, limit_ms long", n, lambda i, r: min(n - 1, i * n // len(rows)))
    stream = stream.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", "1 second")
    got = gathered(keyed.Silence(["source"]).on(stream, time="EventTime"), "silence")
    assert got == [("a", 1000, 3000), ("a", 5400, 7400), ("a", 9000, 11_000), ("b", 11_000, 17_000), ("b", 17_001, 23_001), ("c", 100, 2100)]


@pytest.mark.parametrize("n", [1, 3])
def test_lookups_follow_the_reference_cases(spark, tmp_path, n):
    """One lookup for a track; after an error again 60 s later, event or not; a change of track or none at all ends it."""
    s = 1000
    rows = [("x", 1, 1, "ok"), ("x", 5 * s, 1, "ok"), ("x", 10 * s, 2, "bad"), ("x", 20 * s, 2, "bad"), ("x", 100 * s, 2, "bad"), ("x", 140 * s, 2, None), ("x", 150 * s, 2, "bad"), ("x", 170 * s, 3, "bad"), ("z", 400 * s, 1, "ok")]
    stream = parts(spark, tmp_path, rows, "user string, at_ms long, revision long, track_key string", n, lambda i, r: min(n - 1, i * n // len(rows)))
    stream = stream.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", "1 second")
    look = keyed.Lookups(["user"], lambda revision, key, attempt: "error" if key == "bad" and attempt < 2 else "not_found" if key == "ok" else "found")
    got = [(at // s, rev, attempt, outcome) for u, at, rev, _, attempt, outcome in gathered(look.on(stream, time="EventTime"), "lookups") if u == "x"]
    assert got == [(0, 1, 0, "not_found"), (10, 2, 0, "error"), (70, 2, 1, "error"), (130, 2, 2, "found"), (150, 2, 0, "error"), (170, 3, 0, "error"), (230, 3, 1, "error"), (290, 3, 2, "found")]


def test_failed_lookups_come_again_by_the_clock(spark, tmp_path):
    rows = [("x", 0, 1, "bad")]
    stream = parts(spark, tmp_path, rows, "user string, at_ms long, revision long, track_key string", 1, lambda i, r: 0)
    look = keyed.Lookups(["user"], lambda revision, key, attempt: "error" if attempt < 2 else "found", retry_ms=1500, clock="processing")
    out = f"{tmp_path}/out"
    with keyed.state_store(spark):
        query = look.on(stream, time="ProcessingTime").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 90
        found = []
        while time.time() < until and len(found) < 3:
            time.sleep(1)
            try:
                found = sorted(spark.read.parquet(out).collect(), key=lambda r: r.attempt)
            except Exception:  # nothing is written yet
                found = []
    finally:
        query.stop()
    assert [(r.attempt, r.outcome) for r in found] == [(0, "error"), (1, "error"), (2, "found")]
    assert all(b.at_ms - a.at_ms >= 1500 for a, b in zip(found, found[1:]))


SAMPLE = "user string, at_ms long, action string, streaming boolean, playback_state string, captured_sequence long, gpu_sequence long, skipped_sequence long, underruns long, device_recoveries long, device_recovering boolean, mixer_updates long, last_mixer_control_latency_ms double, cache_hits long, cache_misses long, cache_hit boolean, cache_scope string, songs_cached long, pending_windows long, ready_buffer_seconds double"


def samples(seed, n):
    rng = random.Random(seed)
    rows, counters = [], [0] * 9
    for i in range(n):
        if rng.random() < 0.06:
            rows.append(("u%d" % rng.randint(0, 2), i, rng.choice(["start", "start_airplay", "stop", "mixer", "mixer"]), *[None] * 17))
            continue
        counters = [0 if rng.random() < 0.02 else c + rng.choice([0, 0, 0, 1]) for c in counters]
        c = counters
        state = rng.choice(["playing", "idle", "idle"])
        rows.append(("u%d" % rng.randint(0, 2), i, None, rng.random() < 0.5, state, c[0], c[1], c[2] // 3, c[3] // 3, c[4] // 4, rng.random() < 0.01, c[5], rng.random() * 80, c[6], c[7], rng.random() < 0.3, rng.choice(["song", "song-composite", "window"]), c[8] // 9, rng.randint(0, 5), rng.random() * 9))
    return rows


@pytest.mark.parametrize("n", [1, 5])
def test_the_recorder_equals_the_batch_report_since_the_last_start(spark, tmp_path, n):
    rows = samples(n, 400)
    stream = parts(spark, tmp_path, rows, SAMPLE, n, lambda i, r: i * n // len(rows))
    found = telemetry.requirements(keyed.upserted(keyed.Recorder(["user"]).on(stream, "update"), ["user"], "recorder").where("samples > 0")).drop("version")
    since = {u: max((r[1] for r in rows if r[0] == u and r[2] in keyed.Recorder.RESETS), default=-1) for u in ("u0", "u1", "u2")}
    left = [r for r in rows if r[2] is None and r[1] > since[r[0]]]
    want = telemetry.acceptance(spark.createDataFrame(left, SAMPLE), ["user"], at="at_ms")
    names = sorted(set(found.columns) & set(want.columns))
    assert set(want.columns) <= set(found.columns) | {"playing_samples"}
    key = lambda r: [str(r[c]) for c in names]
    assert sorted(map(key, found.collect())) == sorted(map(key, want.collect()))


@pytest.mark.parametrize("n", [1, 6])
def test_anchors_are_corrected_by_late_metadata(spark, tmp_path, n):
    rng = random.Random(4)
    rows, frame = [], 0
    for _ in range(120):
        frame += rng.choice([1, 9_000, 30_000, 60_000])
        track = frame // 500_000
        if rng.random() < 0.4:
            rows.append(("s", frame, "progress", None, None, track * 1000, track * 1000 + frame % 500_000, track * 1000 + 500_000))
        else:
            rows.append(("s", frame, "metadata", rng.choice(["title", "artist", "album", "other"]), rng.choice("pqr"), None, None, None))
    ddl = "session string, stream_frame long, kind string, field string, value string, start_rtp long, current_rtp long, end_rtp long"
    stream = parts(spark, tmp_path, rows, ddl, n, lambda i, r: i * n // len(rows))
    got = {r.number: r for r in keyed.upserted(keyed.Anchors(["session"]).on(stream, "update"), ["session", "number"], "anchors").collect()}
    machine = machines.Revisions()
    for r in rows:
        machine.step(dict(zip(["session", "stream_frame", "kind", "field", "value", "start_rtp", "current_rtp", "end_rtp"], r)))
    assert sorted(got) == list(range(1, len(machine.anchors) + 1))
    for i, a in enumerate(machine.anchors, 1):
        assert {k: got[i][k] for k in a} == a
    assert any(r.backfilled for r in got.values())


def test_only_the_last_anchors_are_kept():
    machine = machines.Revisions()
    for i in range(machines.Revisions.MOST + 5):
        machine.step({"kind": "progress", "stream_frame": i, "start_rtp": 0, "current_rtp": i, "end_rtp": 10**6})
    assert len(machine.anchors) == 4096 and machine.anchors[0]["anchor_stream_frame"] == 5
    assert len(machine.step({"kind": "metadata", "field": "title", "value": "t", "stream_frame": 0})) == 4096
