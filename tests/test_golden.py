"""The operators on small inputs with known results."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopline.functions import binary, identity, numeric, rules, text
from hopline.operators import cache, framing, joins, lyrics, publication, signal, telemetry, timeline
from hopline.schemas import ANCHOR, schema
from hopline.sources import documents, wav
from hopline.streaming import machines, run

ARRAY = "array<smallint>"


def anchor(revision, at, position, duration=10000, **more):
    base = dict(revision=revision, metadata_revision=1, has_progress=True, start_rtp=revision * 100, current_rtp=0, end_rtp=0, anchor_stream_frame=at, track_position_frame=position, track_duration_frame=duration, title="t", artist="a", album="b")
    return base | more


def one(spark, columns, *rows):
    return spark.createDataFrame(list(rows), columns)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


# --- timeline


def segments(spark, anchors, start, offset, count):
    names = [f.split()[0] for f in ANCHOR.split(", ")]
    df = spark.createDataFrame([(1, start, [tuple(a[n] for n in names) for a in anchors])], f"k int, stream_start_frame long, anchors array<struct<{', '.join(f.replace(' ', ':', 1) for f in ANCHOR.split(', '))}>>")
    out = timeline.segments(df, ["k"], F.lit(offset), F.lit(count)).orderBy("stream_start_frame").collect()
    got = [(r.revision, r.stream_start_frame, r.stream_end_frame, r.track_start_frame, r.track_end_frame) for r in out]
    assert got == [(p["revision"], p["stream_start"], p["stream_end"], p["track_start"], p["track_end"]) for p in machines.pieces(anchors, start + offset, count)]
    return got


def test_segments_split_at_anchors(spark):
    got = segments(spark, [anchor(1, 90, 1000), anchor(1, 160, 1070), anchor(2, 200, 0)], 100, 20, 100)
    assert got == [(1, 120, 160, 1030, 1070), (1, 160, 200, 1070, 1110), (2, 200, 220, 0, 20)]


def test_segments_project_back(spark):
    assert segments(spark, [anchor(1, 120, 1020)], 100, 0, 60) == [(1, 100, 160, 1000, 1060)]
    assert segments(spark, [anchor(1, 120, 10)], 100, 0, 60) == [(1, 120, 160, 10, 50)]
    assert segments(spark, [anchor(1, 90, 0, duration=30)], 100, 0, 60) == [(1, 100, 120, 10, 30)]
    assert segments(spark, [anchor(1, 90, 0, has_progress=False)], 100, 0, 60) == []


def test_window_anchors_include_the_end(spark):
    w = one(spark, "s int, stream_start_frame long, stream_end_frame long", (1, 100, 200))
    a = one(spark, "s int, anchor_stream_frame long, n int", (1, 50, 0), (1, 100, 1), (1, 150, 2), (1, 200, 3), (1, 201, 4))
    assert {r.n for r in timeline.window_anchors(w, a, ["s"], 64).collect()} == {1, 2, 3}


def test_islands_coverage_and_names(spark):
    p = one(spark, "w int, revision long, track_duration_frame long, track_start_frame long, track_end_frame long, stream_start_frame long, stream_end_frame long, title string, artist string, album string", (1, 1, 99, 0, 10, 0, 10, "x", "", ""), (1, 1, 99, 10, 20, 10, 20, "y", "", "z"), (1, 2, 99, 20, 30, 20, 30, "", "", ""))
    assert [r.island for r in timeline.islands(p, ["w"]).orderBy("stream_start_frame").collect()] == [0, 0, 1]
    assert timeline.covered(p, ["w"], F.lit(30)).first().usable is False
    assert timeline.covered(p.where("revision = 1"), ["w"], F.lit(20)).first().usable is True
    # the three names are those of one piece, the last with a title or artist
    assert timeline.latest_names(p, ["w"]).first()[1:] == ("y", "", "z")


def test_ordered_concat_has_no_holes(spark):
    p = one(spark, f"k int, o int, frame_count int, pcm {ARRAY}", (1, 2, 1, [3, 4]), (1, 1, 1, [1, 2]), (2, 1, 2, [1, 2]))
    assert {r.k: r.pcm for r in timeline.ordered_concat(p, ["k"], "o").collect()} == {1: [1, 2, 3, 4], 2: None}


# --- framing


def test_complete_windows_only(spark):
    for frames, windows in ((60, []), (80, [0]), (100, [0, 1])):
        df = spark.range(frames).select(F.lit(1).alias("s"), F.col("id").alias("f"))
        got = framing.sliding_windows(df, ["s"], "f", 80, 20, [], 0).orderBy("sequence").collect()
        assert [r.sequence for r in got] == windows
        blocks = df.groupBy(F.lit("s").alias("stream_id"), F.floor(F.col("f") / 30).alias("b")).agg(F.min("f").alias("start_frame"), F.flatten(F.array_sort(F.collect_list(F.array(F.col("f"), F.col("f"))))).cast(ARRAY).alias("pcm"))
        cut = framing.block_windows(blocks, 80, 20).orderBy("sequence").collect()
        assert [(r.sequence, r.pcm[0], r.pcm[-1]) for r in cut] == [(k, 20 * k, 20 * k + 79) for k in windows]


def test_packets(spark):
    got = framing.packets(one(spark, "n long", (7,), (0,)), F.col("n"), 3).orderBy("packet_no").collect()
    assert [(r.frame_offset, r.frame_count) for r in got] == [(0, 3), (3, 3), (6, 1)]


# --- signals


def hops(spark, rows, hop, overlap, channels=1):
    df = spark.createDataFrame([(1, i, r) for i, r in enumerate(rows)], f"s int, n int, pcm {ARRAY}")
    return [r.hop_pcm for r in signal.crossfade(df, ["s"], "n", hop, overlap, channels).orderBy("n").collect()]


def test_crossfade(spark):
    assert hops(spark, [[0, 1, 2, 3, 4, 5], [4, 5, 6, 7, 8, 9]], 4, 2) == [[0, 1, 2, 3], [4, 5, 6, 7]]
    assert hops(spark, [[0] * 7, [10000] * 4 + [0] * 3], 4, 3)[1] == [0, 5000, 10000, 10000]
    assert hops(spark, [[100, 200], [0, 0]], 1, 1)[1] == [100]


def test_mixes(spark):
    two = one(spark, f"g int, gain float, pcm {ARRAY}", (1, 1.0, [1000, -1000, 2000, -2000]), (1, 1.0, [500, -500, 1000, -1000]))
    assert signal.gain_mix(two, ["g"]).first().pcm == [1500, -1500, 3000, -3000]
    six = spark.createDataFrame([(1, 1.0, [7000, -7000])] * 6, f"g int, gain float, pcm {ARRAY}")
    assert signal.gain_mix(six, ["g"]).first().pcm == [32767, -32768]
    src = spark.createDataFrame([(1, s, [1000 * (i + 1)]) for i, s in enumerate(["vocals", "drums", "bass", "guitar", "piano", "other"])], f"g int, source string, pcm {ARRAY}")
    assert {r.stem: r.pcm[0] for r in signal.regrouped(src, 2, ["g"]).collect()} == {"vocals": 1000, "instrumental": 20000}
    assert {r.stem: r.pcm[0] for r in signal.regrouped(src, 4, ["g"]).collect()} == {"vocals": 1000, "drums": 2000, "bass": 3000, "other": 15000}
    loud = spark.createDataFrame([(1, s, [10000]) for s in ("drums", "bass", "guitar", "piano", "other")], f"g int, source string, pcm {ARRAY}")
    assert signal.regrouped(loud, 2, ["g"]).first().pcm == [32767]


def test_ramp_does_not_depend_on_blocks(spark):
    out = []
    for first, n in ((0, 2), (2, 1), (3, 1), (4, 1)):
        out += value(spark, signal.ramped(F.array_repeat(F.lit(10000), n), F.lit(1.0), F.lit(0.0), F.lit(4), F.lit(first), 1))
    assert out == [7500, 5000, 2500, 0, 0]


def test_levels(spark):
    pcm = F.array(*[F.lit(v).cast("smallint") for v in (0, 0, 16384, -8192, 32767, -16384, -16384, 8192)])
    m = value(spark, signal.levels(pcm, 4))
    assert m.peak_left > 0.99 and 0.49 < m.peak_right < 0.51 and m.rms_left > m.rms_right and m.waveform[-1] > 0.3
    assert value(spark, signal.levels(F.array().cast(ARRAY), 3)).waveform == [0.0] * 3


def located(spark, song, probe, approx, radius):
    df = spark.createDataFrame([([int(x) for x in song], [int(x) for x in probe], approx, radius)], f"song_pcm {ARRAY}, pcm {ARRAY}, approx int, radius int")
    return [(r.offset, round(r.correlation, 3)) for r in cache.located(df).collect()]


def test_alignment(spark):
    song = np.array([[f - 200, 200 - f] for f in range(60)]).ravel()
    assert located(spark, song, song[26:66], 12, 5) == [(13, 1.0)]
    rng = np.random.default_rng(1)
    song = rng.integers(-9000, 9000, 120)
    probe = song[26:66].copy()
    probe[::7] += 2
    assert located(spark, song, probe, 12, 5)[0][0] == 13
    assert located(spark, song, probe * 2, 12, 5) == []
    assert located(spark, song, probe, 30, 5) == []


def test_center_suppression_is_stateful(spark):
    x = [100, 300, 50, 70, -5, 9, 400, 100]
    whole = signal.center_suppressed(one(spark, f"s int, n int, pcm {ARRAY}", (1, 0, x)), "s", "n", 100, 1.0, 10.0).first().pcm
    parts = signal.center_suppressed(one(spark, f"s int, n int, pcm {ARRAY}", (1, 0, x[:4]), (1, 1, x[4:])), "s", "n", 100, 1.0, 10.0).orderBy("n").collect()
    assert whole == parts[0].pcm + parts[1].pcm
    with pytest.raises(ValueError, match="strength"):
        signal.center_suppressed(spark.range(1), "id", "id", 100, 2.0, 1.0)


# --- cache


def test_eviction(spark):
    e = one(spark, "g int, accessed long, key string, size long", (1, 1, "a", 100), (1, 2, "b", 60))
    assert [r.key for r in cache.evicted(e, ["g"], ["accessed", "key"], "size", F.lit(61)).collect()] == ["a"]
    assert cache.evicted(e, ["g"], ["accessed", "key"], "size", F.lit(160)).count() == 0
    rng = random.Random(2)
    rows = [(1, rng.randint(0, 9), str(i), rng.randint(1, 50)) for i in range(40)]
    left, gone = sum(r[3] for r in rows), []
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        if left > 300:
            gone.append(r[2])
            left -= r[3]
    got = cache.evicted(one(spark, "g int, accessed long, key string, size long", *rows), ["g"], ["accessed", "key"], "size", F.lit(300)).orderBy("removal_order").collect()
    assert [r.key for r in got] == gone


def test_tolerant_lookup(spark):
    songs = one(spark, "title string, album string, duration long, accessed long", ("x", "b", 60, 1), ("x", "b", 61, 2))
    for duration, album, opt, hit in ((59, "b", False, 61 - 1), (54, "b", False, None), (120, "b", False, None), (120, "b", True, 61), (120, "c", True, None)):
        r = cache.tolerant(one(spark, "title string, album string, duration long", ("x", album, duration)), songs.where("duration = 60") if hit == 60 else songs, ["title", "album"], "duration", F.lit(5), "accessed", opt).collect()
        assert [x.song_duration for x in r] == ([hit] if hit else [])


def test_integrity_and_retention(spark):
    f = one(spark, "k int, chunk_index int, stem string, bytes long, expected_bytes long, sha256 string, expected_sha256 string, sample_rate int, channels int", (1, 0, "a", 5, 5, "h", "h", 8, 2), (1, 0, "b", 5, 5, "h", "h", 8, 2), (2, 0, "a", 5, 5, "h", "i", 8, 2), (2, 0, "b", 5, 5, "h", "h", 8, 2), (3, 1, "a", 5, 5, "h", "h", 8, 2), (3, 1, "b", 5, 5, "h", "h", 8, 2))
    checks = cache.intact(f, ["k"], F.array(F.lit("b"), F.lit("a")))
    assert {r.k: r.intact for r in checks.collect()} == {1: True, 2: False, 3: False}
    assert [r.k for r in cache.quarantined(f.select("k").distinct(), checks, ["k"]).collect()] == [1]
    a = spark.range(1, 13).select(F.lit(1).alias("g"), F.col("id").alias("sequence"))
    assert sorted(r.sequence for r in cache.retained(a, one(spark, "g int, safe_sequence long", (1, 12)), ["g"], keep=3).collect()) == [10, 11, 12]


# --- telemetry


def sample(at, active, bump=0, **more):
    base = dict(s=1, observed_at_ns=at, streaming=active, playback_state="idle", captured_sequence=10 + at, gpu_sequence=5 + at, skipped_sequence=bump, underruns=bump, device_recoveries=bump, device_recovering=False, mixer_updates=bump, last_mixer_control_latency_ms=5.0, cache_hits=0, cache_misses=at, cache_hit=False, cache_scope="", songs_cached=1, pending_windows=0, ready_buffer_seconds=4.0, track_title="t", track_artist="a", track_duration_seconds=3.0)
    return base | more


def accept(spark, *rows):
    names = list(rows[0])
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {kinds[type(rows[0][n])]}" for n in names))
    return telemetry.acceptance(df, ["s"]).first()


def test_acceptance(spark):
    assert accept(spark, sample(0, False)).state == "waiting_for_phone"
    r = accept(spark, sample(1, True), sample(2, True, mixer_updates=1), sample(3, False, 1), sample(4, True, 1, cache_hit=True, cache_scope="song", cache_hits=1))
    assert r.state == "passed" and r.active_underruns_delta == 0 and r.max_latency_ms == 5.0
    r = accept(spark, sample(1, True), sample(2, True, underruns=1, cache_hit=True, cache_scope="song", cache_hits=1))
    assert r.state == "failed" and r.active_underruns_delta == 1
    r = accept(spark, sample(1, True, 2), sample(2, True, 1), sample(3, True, 2, songs_cached=0))
    assert not r.zero_active_underruns and not r.song_cache_available and r.maximum_songs_cached == 1
    late = accept(spark, sample(1, True), sample(2, True, mixer_updates=1, last_mixer_control_latency_ms=80.0, cache_hit=True, cache_scope="song", cache_hits=1))
    assert late.state == "failed"


def test_snapshot_is_lenient(spark):
    import datetime
    import json

    at = datetime.datetime(2024, 1, 1)
    docs = {
        "receiver": {"state": "streaming", "peak_left": 9, "track": {"title": " x ", "artist": "y", "revision": 3, "position_seconds": 2.5}, "waveform": [2, 0.5], "pcm_frames": 88200},
        "inbox": {"sequence": "7"}, "gpu": {"model_state": "odd", "last_sequence": -3}, "manifest": {"processing_seconds": "nan", "cache_hit": True, "cache_scope": "song", "cache_key": "0123456789abcdef"},
        "playback": {"state": "playing", "sequence": 2, "hop_seconds": 3, "gains": {"vocals": 2, "nope": 1}, "last_device_hresult": "0x8889000a"},
        "lyrics": {"state": "ready", "source": "cache", "track": {"revision": 3, "title": "X", "artist": "y "}, "lines": [{"time_seconds": 2, "text": "B"}, {"time_seconds": 1, "text": "A"}, {"time_seconds": 3, "text": "C"}, {"time_seconds": -1, "text": "D"}]},
    }
    s = one(spark, "source string, observed_at timestamp, payload string", *[(k, at, json.dumps(v)) for k, v in docs.items()], ("gpu", at - datetime.timedelta(1), "{}"))
    late, soon = (telemetry.snapshot(s, F.lit(f"2024-01-01 00:00:0{n}").cast("timestamp")).first() for n in (5, 1))
    assert (late.streaming, late.stream_stalled, soon.streaming) == (False, True, True)
    assert (soon.captured_sequence, soon.peak_left, soon.track_title, soon.model_state, soon.gpu_sequence, soon.hop_seconds, soon.received_seconds) == (7, 1.0, "x", "error", 0, 3.0, 2.0)
    assert soon.gains == {"vocals": 1.0} and soon.waveform == [1.0, 0.5] and soon.processing_seconds is None and soon.controller_stalled is False
    assert (soon.lyrics_previous, soon.lyrics_current, soon.lyrics_upcoming, soon.lyrics_line_count) == (["A"], "B", ["C"], 3)
    assert (soon.cache_scope, soon.cache_key_short, soon.last_device_hresult, soon.acceptance_state, soon.acceptance_passed) == ("song", "0123456789ab", "0x8889000A", "not_running", False)
    empty = telemetry.snapshot(s.where("false"), F.current_timestamp())
    assert empty.first().analysis_window_seconds == 12.0 and empty.first().lyrics_state == "waiting" and len(empty.columns) >= 104


def test_shedding_fallback_and_ladders(spark):
    w = one(spark, f"k int, pcm {ARRAY}", (1, [5, -5]))
    assert {r.stem: r.pcm for r in telemetry.fallback(w, ["vocals", "other"], "other").collect()} == {"vocals": [0, 0], "other": [5, -5]}
    r = one(spark, "has_metadata boolean, first_track_start_frame long, frame_count long, duration_frames long, sample_rate long, profile_sample_rate long", (False, None, 0, 0, 0, 0), (True, None, 0, 0, 10, 10), (True, 30, 9, 9, 10, 10), (True, 0, 5, 9, 10, 10), (True, 0, 9, 9, 11, 10), (True, 0, 9, 9, 10, 10))
    assert [x[0] for x in r.select(rules.rejection()).collect()] == ["missing_metadata", "missing_track_start", "missing_song_prefix", "incomplete_song", "sample_rate_mismatch", None]


# --- lyrics


def test_lrc(spark):
    lrc = "[ar:x]\n[offset:+500]\nno stamp\n[00:03.50]B\n[00:01.00][00:05.25] A \n[00:09.00]  \n x[00:01.00]y"
    got = value(spark, text.lyric_lines(F.lit(lrc)))
    assert [(r.time_seconds, r.text) for r in got] == [(1.5, "A"), (4.0, "B"), (5.75, "A")]
    early = value(spark, text.lyric_lines(F.lit("[offset:-5000]\r\n[00:02.00]a\r\n[00:01.00]b")))
    assert [(r.time_seconds, r.text) for r in early] == [(0.0, "a"), (0.0, "b")]


@pytest.mark.parametrize(("position", "context", "expected"), [(0.5, 2, ([], None, ["A", "B"])), (3.0, 1, (["B"], "C", ["D"])), (99.0, 2, (["B", "C"], "D", []))])
def test_lyric_window(spark, position, context, expected):
    lines = one(spark, "k int, line_no int, time_seconds double, text string", *[(1, i, i + 1.0, t) for i, t in enumerate("ABCD")])
    r = lyrics.current(one(spark, "k int, p double", (1, position)), lines, "k", "p", context).first()
    assert (r.previous, r.current, r.upcoming) == expected


def test_lyric_candidates(spark):
    t = one(spark, "track_key string, title string, artist string, album string, duration_seconds double", ("k", "x", "y", "z", 200.0))
    found = one(spark, "title string, artist string, album string, duration_seconds double, place int, lyrics string, instrumental boolean", ("x (live)", "y", "z", 200.0, 0, "[00:01.00]a", False), ("x", "y", "z", 269.0, 1, "[00:01.00]b", False), ("x", "y", "q", 200.0, 2, "[00:01.00]c", False), ("x", "y", "z", 203.0, 3, "[00:01.00]d", False), ("x", "y", "z", 200.0, 4, "junk", False))
    assert [r.lyrics for r in lyrics.candidates(t, found).collect()] == ["[00:01.00]d"]
    sources = [one(spark, "track_key string, lyrics string", ("q", "1")), one(spark, "track_key string, lyrics string", ("k", "2"))]
    assert lyrics.cascade(t, sources).first()[-2:] == ("2", 1)


# --- joins and sets


def test_processes(spark):
    p = one(spark, "pid int, name string, title string", (44, "Music.exe", None), (42, "music.exe", "song"), (9, "Utility.exe", None), (50, "MUSIC.EXE", "later"))
    assert [(r.pid, r.name) for r in joins.best_process(rules.allowed(p)).collect()] == [(42, "music.exe")]
    players = one(spark, "pid int, session int", (1, 7), (2, 8), (3, None))
    helpers = one(spark, "pid int, session int", (11, 7), (10, 7))
    assert {r.pid: r.target_pid for r in joins.helper_of(players, helpers).collect()} == {1: 10, 2: 2, 3: 10}


def test_states_sets_and_closure(spark):
    expected = one(spark, "q int, stem string", *[(q, s) for q in (1, 2, 3) for s in ("a", "b")])
    files = one(spark, "q int, stem string, sample_rate int, channels int, frames int", (1, "a", 8, 2, 9), (1, "b", 8, 2, 9), (2, "a", 8, 2, 9), (2, "b", 8, 2, 8))
    states = joins.group_state(expected, one(spark, "q int", (1,), (2,)), files, ["q"])
    assert {r.q: r.state for r in states.collect()} == {1: "ready", 2: "skipped", 3: "waiting"}
    edges = one(spark, "parent string, child string", ("A", "b"), ("B", "c"), ("c", "a"), ("x", "y"))
    assert sorted(r.node for r in joins.closure(edges, one(spark, "node string", ("a",))).collect()) == ["a", "b", "c"]
    chain = spark.range(70).selectExpr("cast(id as string) as parent", "cast(id + 1 as string) as child")
    assert joins.closure(chain, one(spark, "node string", ("3",))).count() == 68
    assert value(spark, joins.same_set(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1)))) is True


# --- functions and sources


def test_rules(spark):
    check = lambda c: value(spark, c)
    assert check(rules.endpoint(F.lit("192.168.1.10:9000"))) == ("192.168.1.10", 9000)
    assert [check(rules.endpoint(F.lit(x))) for x in ("1.2.3.4", "01.2.3.4:5", "1.2.3.256:5", "1.2.3.4:0", "1.2.3.4:70000", "1.2.3.4:05")] == [None] * 6
    assert check(rules.sequence_of(F.lit("capture-00000012.wav"))) == 12 and check(rules.sequence_of(F.lit("capture-12.wav"))) is None
    assert check(rules.retryable(F.lit(-2004287484))) is True and check(rules.retryable(F.lit(5))) is False
    assert [check(rules.source_of(F.lit(x))) for x in ("Song_(Vocals).wav", "x_no_vocals", "Instrumental", "drumsbass", "zzz")] == ["vocals", "instrumental", "instrumental", "drums", None]
    assert check(rules.valid_geometry(F.lit(12), F.lit(3), F.lit(0), F.lit(0.1), F.lit(2))) is True
    assert check(rules.plain_name(F.lit("../x"))) is False and check(rules.exported(F.lit("a/__pycache__/b.pyc"))) is False
    assert check(rules.stream_state(F.lit("connection_closed"), F.lit(0))) == "waiting"
    assert [check(numeric.retry_delay_ms(F.lit(n))) for n in (0, 1, 3, 4, 9)] == [100, 200, 800, 1000, 1000]
    assert check(numeric.pcm16(F.lit(-2.5))) == -3 and check(numeric.pcm16_of_float(F.lit(2.5 / 32767))) == 2
    assert check(text.folded(F.lit(" Straße　Ｘ "))) == "strasse x" and check(text.hresult(F.lit("0x8889000a"))) == "0x8889000A"
    assert check(numeric.position_at(F.lit(4294967290), F.lit(4), F.lit(100), F.lit(50), F.lit(60))) == 20
    same = [check(identity.pcm_identity(F.lit(b"ab"), F.lit(8), F.lit(2))) for _ in range(2)] + [check(identity.pcm_identity(F.lit(b"ac"), F.lit(8), F.lit(2)))]
    assert same[0] == same[1] != same[2]


def test_packets_are_refused_in_order(spark):
    pcm = F.array(*[F.lit(v).cast("smallint") for v in (1, -2, 3, -32768)])
    good = bytes(spark.range(1).select(binary.audio_packet(F.lit(7), F.lit(4294967295), F.lit(99), F.lit(48000), pcm).alias("p")).first().p)
    raw = bytearray(struct.pack("<4sBBHIIQIHBBHHI", b"SSNP", 1, 1, 40, 7, 4294967295, 99, 48000, 2, 2, 1, 8, 0, 0) + struct.pack("<4h", 1, -2, 3, -32768))
    raw[36:40] = struct.pack("<I", zlib.crc32(raw))
    assert good == bytes(raw)
    cases = {"none": good, "too_short": good[:39], "wrong_magic": b"X" + good[1:], "unsupported_version": good[:4] + b"\2" + good[5:], "wrong_packet_type": good[:5] + b"\2" + good[6:], "invalid_header": good[:6] + b"\1" + good[7:], "invalid_geometry": good[:30] + b"\1" + good[31:], "invalid_length": good + b"\0\0", "checksum_mismatch": good[:-1] + b"\1"}
    got = spark.createDataFrame(list(cases.items()), "want string, p binary").select("want", binary.audio_error(F.col("p")).alias("got"), binary.audio_fields(F.col("p")).alias("f")).collect()
    assert all(r.want == r.got for r in got)
    assert next(r.f for r in got if r.want == "none").pcm == [1, -2, 3, -32768]


def test_control_packets(spark):
    gains = F.array(*[F.lit(v) for v in (32768, 0, 16384, 0, 0, 0, 0)])
    p = spark.range(1).select(binary.control_packet(F.lit(7), F.lit(1), F.lit(5), F.lit(5), gains).alias("p"))
    r = p.repartition(1).select(binary.control_error(F.col("p")).alias("e"), binary.control_fields(F.col("p")).alias("f"), F.length("p").alias("n")).first()
    assert (r.e, r.n, r.f.gains) == ("none", 48, {"vocals": 1.0, "drums": 0.5})
    assert value(spark, binary.control_packet(F.lit(7), F.lit(1), F.lit(5), F.lit(128), gains)) is None


def test_wav_source(spark, tmp_path):
    wav.register(spark)
    pcm = list(range(-20, 20))
    spark.createDataFrame([("a.wav", 10, 2, pcm)], f"path string, sample_rate int, channels int, pcm {ARRAY}").write.format("wav_pcm16").mode("append").save(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["a.wav"]
    rows = spark.read.format("wav_pcm16").option("blockFrames", 8).load(str(tmp_path)).orderBy("start_frame").collect()
    assert [r.start_frame for r in rows] == [0, 8, 16] and sum((r.pcm for r in rows), []) == pcm
    part = spark.read.format("wav_pcm16").option("firstFrame", 3).option("frames", 2).load(str(tmp_path)).first()
    assert part.pcm == pcm[6:10]
    assert spark.read.format("wav_pcm16").load(f"file://{tmp_path}/*.wav").first().pcm == pcm
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert wav.decoded(files, 3, 2).select("pcm", "start_frame").first()[:] == (pcm[6:10], 3)
    assert wav.decoded(files, 3, 99).first().error == "no frames 3 to 102"
    own = spark.createDataFrame([(10, 2, pcm)], f"sample_rate int, channels int, pcm {ARRAY}")
    assert bytes(wav.encoded(own).first().content) == wav.wav_bytes(np.array(pcm), 10, 2)
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxx")
    got = {r.path.rsplit("/", 1)[1]: (r.pcm, r.error) for r in wav.decoded(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got["a.wav"] == (pcm, None) and got["bad.wav"][0] is None and got["bad.wav"][1]


@pytest.mark.parametrize("damage", [lambda b: b[:30], lambda b: b"RIFX" + b[4:], lambda b: b[:20] + b"\3" + b[21:], lambda b: b[:32] + b"\3" + b[33:], lambda b: b + b"data\0\0\0\0"])
def test_wav_refusals(damage):
    good = wav.wav_bytes(np.arange(4), 10, 2)
    assert wav.parse_header(good) == (10, 2, 44, 8)
    with pytest.raises(wav.WavError):
        bad = damage(good)
        wav.parse_header(bad[:4] + len(bad[8:]).to_bytes(4, "little") + bad[8:] if len(bad) > 44 else bad)


def test_documents(spark):
    import json

    a = {"version": 1, "source": "x", "sequence": 7, "sample_rate": 10, "stream_start_frame": 100, "stream_end_frame": 220, "track": None, "anchors": [anchor(1, 90, 1000), anchor(1, 160, 1070)]}
    bad = [a | {"sequence": "8x"}, a | {"sample_rate": 0}, a | {"anchors": a["anchors"][::-1]}, a | {"anchors": [anchor(1, 90, -1)]}, a | {"sequence": True}]
    df = spark.createDataFrame([(json.dumps(x),) for x in [a, *bad]] + [("junk",)], "value string")
    assert [r.valid for r in documents.annotations(df).collect()] == [True] + [False] * 6
    assert documents.annotations(df.limit(1), expected={"sample_rate": F.lit(44100)}).first().valid is False
    mixer = one(spark, "sequence long, gains map<string,float>", (5, {"vocals": 0.5, "drums": 1.0})).select(documents.mixer_file(F.col("sequence"), F.col("gains")).alias("value"))
    r = documents.mixer_gains(mixer).first()
    assert (r.valid, r.sequence, r.gains) == (True, 5, {"vocals": 0.5, "drums": 1.0})
    wrong = ["", "version\t1\nsequence\t1\n", "version\t1\nsequence\t1\ngain\tvocals\t2\n", "version\t1\nsequence\t1\ngain\tx\t1\n", "version\t1\nsequence\t1\nsequence\t2\ngain\tvocals\t1\n", "version\t1\nsequence\t1\ngain\tvocals\t1\ngain\tvocals\t1\n"]
    assert [x.valid for x in documents.mixer_gains(spark.createDataFrame([(w,) for w in wrong], "value string")).collect()] == [False] * 6
    names = spark.createDataFrame([(n,) for n in ("capture-00000003.wav", "result-00000008.json", "x.part", "song.MP3")], "name string")
    assert documents.next_sequence(names).first()[0] == 9
    assert [r.sequence for r in documents.ready_captures(names, F.lit(2)).collect()] == [3]
    assert [r.name for r in documents.accepted_inputs(names).collect()] == ["capture-00000003.wav", "song.MP3"]
    assert schema(ANCHOR).fieldNames()[0] == "revision"


# --- machines


def songs(*windows, rate=10, hop=20, overlap=1):
    m = machines.Assembly(rate, hop, overlap)
    out = []
    for i, (start, anchors) in enumerate(windows):
        out += m.step({"sequence": i + 1, "stream_start_frame": start, "pcm": [v for f in range(start, start + hop + overlap) for v in (f, f)], "anchors": anchors, "song_hit": False})
    return out


def frames_of(song):
    return song["pcm"][::2]


def test_assembly_whole_song():
    a = anchor(1, 0, 0, 40)
    out = songs((0, [a]), (20, [a, anchor(2, 40, 0, 40)]))
    assert len(out) == 1 and frames_of(out[0]) == list(range(40)) and out[0]["reason"] is None


def test_assembly_seek():
    out = songs((0, [anchor(1, 0, 20, 40)]), (20, [anchor(1, 20, 0, 40)]), (40, [anchor(1, 20, 0, 40)]))
    assert [(s["reason"], s["frame_count"]) for s in out] == [("incomplete_song", 20), (None, 40)]


def test_assembly_resync_keeps_early_names():
    old, new = anchor(1, 0, 0, 40, start_rtp=9, title="first"), anchor(2, 25, 24, 41, start_rtp=9, title="second")
    out = songs((0, [old]), (20, [old, new]))
    assert [(s["title"], s["revision"], s["frame_count"]) for s in out] == [("first", 2, 40)] and frames_of(out[0]) == list(range(40))


def test_assembly_ends_within_a_hop():
    a = anchor(1, 0, 0, 35)
    out = songs((0, [a]), (20, [a]))
    assert frames_of(out[0]) == list(range(35))


def test_assembly_recovers_prefixes():
    old, new = anchor(1, 0, 0, 400), anchor(2, 15, 0, 40)
    out = [s for s in songs((0, [old]), (20, [new]), (40, [new])) if s["reason"] is None]
    assert frames_of(out[0]) == list(range(15, 55)) and (out[0]["recoveries"], out[0]["misses"]) == (1, 0)
    new = anchor(2, 25, 5, 40)
    out = [s for s in songs((0, [old]), (20, [old, new]), (40, [new])) if s["reason"] is None]
    assert frames_of(out[0]) == list(range(20, 60)) and out[0]["recoveries"] == 1


def test_assembly_gap_and_regression():
    a = anchor(1, 0, 0, 40)
    m = machines.Assembly(10, 20, 1)
    row = lambda n, start, anchors=(a,): {"sequence": n, "stream_start_frame": start, "pcm": [1] * 42, "anchors": list(anchors), "song_hit": False}
    assert m.step(row(1, 0)) == [] and m.step(row(3, 20)) == [] and m.song["misses"] == 1
    out = m.step(row(4, 0))
    assert m.epoch == 1 and [s["reason"] for s in out] == ["incomplete_song"]
    assert m.step({**row(5, 20), "anchors": None}) == [] and m.song is None


def test_ring_soak():
    ring, rng = machines.Ring(2400, 1800), random.Random(0)
    read = 0
    for _ in range(300):
        ring.step({"op": "push", "frames": 600})
        while ring.buffered >= 1800 or (ring.playing and ring.buffered >= 600 and rng.random() < 0):
            read += ring.step({"op": "pop", "frames": 600})[0]["result"] == "audio"
    while ring.buffered:
        read += ring.step({"op": "pop", "frames": 600})[0]["result"] == "audio"
    assert (read * 600, ring.underruns) == (180000, 0)
    assert ring.step({"op": "pop", "frames": 10})[0]["result"] == "underrun"
    assert ring.step({"op": "push", "frames": 9999})[0]["result"] == "full"
    assert ring.step({"op": "pop", "frames": 10})[0]["result"] == "prebuffering"


def test_revisions_and_late_metadata():
    m = machines.Revisions(10)
    step = lambda **r: m.step(r)
    assert step(kind="progress", start_rtp=0, current_rtp=0, end_rtp=400, stream_frame=0)[0]["revision"] == 1
    assert [x["title"] for x in step(kind="metadata", field="title", value="x", stream_frame=15)] == ["x"]
    assert step(kind="metadata", field="title", value="y", stream_frame=99) == []
    assert step(kind="progress", start_rtp=0, current_rtp=50, end_rtp=400, stream_frame=100)[0]["revision"] == 1
    assert step(kind="progress", start_rtp=7, current_rtp=7, end_rtp=7, stream_frame=200)[0] | {"x": 1} == {**m.now, "backfilled": False, "x": 1}


def test_sessions_loader_and_lookups():
    s = machines.Session()
    assert [(r["state"], r["refused"]) for e in ("running", "start", "start", "running", "fail", "stop") for r in s.step({"event": e})] == [("stopped", True), ("warming", False), ("warming", True), ("running", False), ("error", False), ("stopped", False)]
    m = machines.Loader()
    got = [o for q, st in ((1, "waiting"), (1, "ready"), (2, "skipped"), (3, "ready"), (4, "ready")) for o in m.step({"sequence": q, "state": st})]
    assert [(o["action"], o["stitch_reset"]) for o in got] == [("push", True), ("skip", False), ("push", True), ("push", False)]
    m = machines.LyricLookups()
    at = [o["at_s"] for t, k, res in ((0, "a", "error"), (30, "a", "error"), (61, "a", "not_found"), (500, "a", "found"), (501, "b", "found")) for o in m.step({"at_s": t, "revision": 1, "track_key": k, "outcome": res})]
    assert at == [0, 61, 501]


def test_machines_on_streams(spark, tmp_path):
    rows = [(1, n, e) for n, e in enumerate(("start", "running", "progress", "fail", "stop", "start"))]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "k int, n int, event string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = run.files(spark, f"{tmp_path}/in", "k int, n int, event string")
    got = run.collected(run.streamed(src, "k", "n", machines.Session, machines.Session.OUT), "sessions").collect()
    want = run.replay(spark.createDataFrame(rows, "k int, n int, event string"), "k", "n", machines.Session, machines.Session.OUT).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    run.with_dead_letters(src, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/cp", "event <> 'fail'").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/good").count() == 5 and spark.read.parquet(f"{tmp_path}/bad").count() == 1
    run.published(src, f"{tmp_path}/out", f"{tmp_path}/cp2", lambda df: df.groupBy("k").count()).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/stems").count() == 6 and spark.read.json(f"{tmp_path}/out/manifests").count() == 2


# --- publication


def test_publication(spark):
    entries = one(spark, "k int, state string", (1, "building"), (2, "building"), (3, "complete"))
    chunks = one(spark, "k int, i int, at int, stems array<string>", (1, 0, 1, ["b", "a"]), (1, 1, 1, ["a", "b"]), (1, 1, 2, ["a", "b"]), (2, 1, 1, ["a", "b"]), (3, 0, 1, ["a"]))
    kept = publication.stored(entries, chunks, ["k"], "i", "at")
    assert sorted((r.k, r.i, r.at) for r in kept.collect()) == [(1, 0, 1), (1, 1, 2), (2, 1, 1)]
    done = publication.finalized(entries, kept, ["k"], "i", "stems", F.array(F.lit("a"), F.lit("b")))
    assert {r.k: r.state for r in done.collect()} == {1: "complete", 2: "building", 3: "complete"}
    m = publication.manifests(one(spark, "q int, stem string, filename string", (1, "b", "y"), (1, "a", "x")), ["q"], sample_rate=F.lit(10)).first()
    assert (m.version, m.sample_rate, m.stems) == (2, 10, {"a": "x", "b": "y"})
    parts = one(spark, "q int, ordinal int, cache_key string, cached_start_frame long, frame_count long, profile string", (1, 1, "B", 0, 13, "p"), (1, 0, "A", 52, 8, "p"), (2, 0, "A", 0, 8, "p"))
    c = publication.composites(parts, ["q"], F.lit(21)).collect()
    assert [(r.q, r.cache_part_count, [p.cache_key for p in r.cache_parts]) for r in c] == [(1, 2, ["A", "B"])]


def test_small_rules(spark):
    check = lambda c: value(spark, c)
    assert check(rules.absolute(F.lit("a//./b.wav"), F.lit("/out"))) == "/out/a/b.wav" and check(rules.absolute(F.lit("/x/y"), F.lit("/out"))) == "/x/y"
    assert check(rules.visible(F.array(F.lit("drums"))))["drums"] is True and check(rules.labels())["vocals"]
    assert check(rules.of_epoch_ns(F.lit(1704067200123456789)).cast("string")) == "2024-01-01 00:00:00.123456"
    assert check(rules.heartbeat(F.lit("2024-01-01T00:00:00Z")).cast("string")) == "2024-01-01 00:00:00" and check(rules.heartbeat(F.lit("x"))) is None
    assert check(rules.age_seconds(F.lit("2024-01-01 00:00:05").cast("timestamp"), F.lit("2024-01-01 00:00:02.5").cast("timestamp"))) == 2.5
