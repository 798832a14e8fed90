"""Predicates, ladders and tiers: what the system decides from one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.functions.text import file_stem

# File names with their sequence, and the shapes of identifiers.
CAPTURE, RESULT, ARTIFACT = r"^capture-(\d{8})\.wav$", r"^result-(\d{8})\.json$", r"^(?:capture|result|failed)-(\d{8})(?:[-.].*)?$"
STEM_NAME, SHA256 = r"^[a-z0-9_-]{1,32}$", r"^[0-9a-f]{64}$"
ENDPOINT = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3}):(\d{1,5})$"
#: Players that can be captured, without extension.
PLAYERS = ["aimp", "applemusic", "cloudmusic", "foobar2000", "itunes", "microsoft.media.player", "music", "musicbee", "potplayermini", "potplayermini64", "qqmusic", "spotify", "vlc", "wmplayer"]
#: Audio device errors after which opening the device again may help (as unsigned numbers).
RETRYABLE = [0x88890004, 0x88890010, 0x88890026, 0x8889000F, 0x8889000A, 0x88890018, 0x80070490, 0x80070426]
AUDIO_TYPES = ("aac", "aiff", "flac", "m4a", "mp3", "ogg", "opus", "wav")


def sequence_of(name: Column, pattern: str = CAPTURE) -> Column:
    """The sequence in a file name, null for other names (FL1, SC20)."""
    return F.regexp_extract(name, pattern, 1).try_cast("long")


def valid_geometry(window_seconds: Column, hop_seconds: Column, offset_seconds: Column, overlap_seconds: Column, channels: Column) -> Column:
    """The invariants of a window geometry (FL3)."""
    return (window_seconds >= 8) & (hop_seconds > 0) & (window_seconds % hop_seconds == 0) & (overlap_seconds > 0) & (overlap_seconds <= hop_seconds) & (offset_seconds + hop_seconds + overlap_seconds <= window_seconds) & (channels == 2)


def plain_name(path: Column) -> Column:
    """Whether a name stays in its folder (FL4)."""
    return ~path.rlike(r"[\\/]") & ~path.isin("", ".", "..")


def is_player(name: Column) -> Column:
    return file_stem(F.trim(name)).isin(*PLAYERS)


def valid_gain(gain: Column) -> Column:
    """Finite and in [0, 1]; null is not (FL6)."""
    return F.coalesce(gain.between(0.0, 1.0) & ~F.isnan(gain), F.lit(False))


def endpoint(text: Column) -> Column:
    """struct<host, port> of IPv4:port without leading zeros, port 1 to 65535; else null (FL7)."""
    parts = [F.regexp_extract(text, ENDPOINT, i) for i in range(1, 6)]
    octets = [p.try_cast("int").between(0, 255) & ((F.length(p) == 1) | ~p.startswith("0")) for p in parts[:4]]
    port = parts[4].try_cast("int")
    fine = text.rlike(ENDPOINT) & octets[0] & octets[1] & octets[2] & octets[3] & port.between(1, 65535) & ~parts[4].startswith("0")
    return F.when(fine, F.struct(F.concat_ws(".", *parts[:4]).alias("host"), port.alias("port")))


def audible(peak_left: Column, peak_right: Column) -> Column:
    """Any peak above 1e-4 (FL9)."""
    return F.greatest(peak_left, peak_right) > 1e-4


def stale(age_seconds: Column, kind: Column) -> Column:
    """Older than 2 s for a stream, 6 s for the controller (FL11)."""
    return age_seconds > F.when(kind == "controller", 6.0).otherwise(2.0)


def wants_lyrics(state: Column, title: Column, artist: Column, duration_seconds: Column) -> Column:
    """FL13: something plays or is paused, it has a name, and lasts less than a day."""
    return state.isin("streaming", "paused") & (F.trim(title) != "") & (F.trim(artist) != "") & (duration_seconds > 0) & (duration_seconds < 86400)


def retryable(code: Column) -> Column:
    """FL16, on the code as a signed or unsigned number."""
    return F.pmod(code.cast("long"), F.lit(1 << 32)).isin(*RETRYABLE)


def exported(path: Column) -> Column:
    """FL17: what a migration package takes."""
    return ~path.rlike(r"(^|[\\/])__pycache__([\\/]|$)|\.py[co]$|\.next\.exe$")


def source_of(name: Column) -> Column:
    """The model source that an output name stands for, by the first of these that it contains (PJ6)."""
    low = F.lower(name)
    out = F.when(low.contains("instrumental") | low.contains("no_vocals"), "instrumental")
    for stem in ("vocals", "drums", "bass", "guitar", "piano", "other"):
        out = out.when(low.contains(stem), stem)
    return out


def stream_state(event: Column, open_connections: Column) -> Column:
    """SF21."""
    closed = F.when(open_connections == 0, "waiting").otherwise("connected")
    names = {"receiver_started": "waiting", "connection_opened": "connected", "pcm_received": "streaming", "flush_received": "paused", "connection_reset": "recovering", "receiver_stopped": "stopped"}
    out = F.when(event == "connection_closed", closed)
    for k, v in names.items():
        out = out.when(event == k, v)
    return out.otherwise("error")


def gpu_tier(vram_gb: Column) -> Column:
    """struct<tier, live_stems, segment, concurrency> (SF20, SC17)."""
    pick = lambda a, b, c, d: F.when(vram_gb < 5.5, a).when(vram_gb < 7.5, b).when(vram_gb < 12, c).otherwise(d)
    return F.struct(pick("limited", "compatibility", "balanced", "performance").alias("tier"), pick(2, 4, 6, 6).alias("live_stems"), pick(128, 192, 256, 384).alias("segment"), F.when(vram_gb >= 15, 2).otherwise(1).alias("concurrency"))


#: SF19: (name, class, condition) in the order in which they are tried.
CONTINUITY = [
    ("controller_stalled", "bad", "controller_stalled"),
    ("device_recovering", "warm", "device_recovering"),
    ("network_loss", "bad", "device_network_enabled and (device_dropped_frames > 0 or device_send_errors > 0)"),
    ("stream_stalled", "bad", "stream_stalled"),
    ("device_reconnected", "bad", "active_device_recovery_delta > 0"),
    ("windows_skipped", "bad", "active_skipped_sequence_delta > 0"),
    ("active_underrun", "bad", "active_underrun_delta > 0"),
    ("drained_while_idle", "ok", "underruns > 0 and acceptance_active_samples > 0"),
    ("underrun", "bad", "underruns > 0"),
    ("fallback", "warm", "fallback_audio"),
    ("waiting", "idle", "not streaming"),
    ("first_window", "warm", "processing_seconds is null"),
    ("sustainable", "warm", "processing_seconds <= hop_seconds"),
    ("too_slow", "bad", "true"),
]


def ladder(rungs: list[tuple[str, str, str]], name: str = "state", kind: str = "class") -> list[Column]:
    """The first rung that holds, as two columns; a null condition doesn't hold."""
    out = []
    for i, alias in ((0, name), (1, kind)):
        c = None
        for rung in rungs:
            c = F.when(F.expr(rung[2]), rung[i]) if c is None else c.when(F.expr(rung[2]), rung[i])
        out.append(c.alias(alias))
    return out


#: FL15: (code, what must not hold) before an update may start.
READINESS = [
    ("controller_missing", "coalesce(controller_age_seconds > 6, true)"),
    ("stream_active", "streaming"),
    ("playback_active", "playback_state = 'playing'"),
    ("backlog", "pending_windows > 0"),
    ("not_quiet", "coalesce(captured_sequence <> previous_captured_sequence, true)"),
]


def readiness() -> Column:
    """The first check that fails, or ready (FL15); ``previous_captured_sequence`` comes from lag()."""
    c = None
    for code, failing in READINESS:
        c = F.when(F.expr(failing), code) if c is None else c.when(F.expr(failing), code)
    return c.otherwise("ready")


def rejection() -> Column:
    """Why a finished song is not published, null if it is (SF26). Columns: has_metadata, first_track_start_frame, frame_count, duration_frames, sample_rate, profile_sample_rate."""
    return F.expr(
        "case when not has_metadata then 'missing_metadata' when first_track_start_frame is null then 'missing_track_start' "
        "when first_track_start_frame > 2 * profile_sample_rate then 'missing_song_prefix' when frame_count < duration_frames then 'incomplete_song' "
        "when sample_rate <> profile_sample_rate then 'sample_rate_mismatch' end"
    )


def lag_state() -> list[Column]:
    """SF27: windows pending, ready and the seconds they last. Columns: captured_sequence, gpu_sequence, playback_sequence, playback_state, buffered_seconds, hop_seconds."""
    ready = F.expr("case when playback_state = 'playing' and playback_sequence > 0 then greatest(0, gpu_sequence - playback_sequence + 1) when playback_state = 'played' and playback_sequence > 0 then greatest(0, gpu_sequence - playback_sequence) else greatest(0, gpu_sequence) end")
    return [F.expr("greatest(0, captured_sequence - gpu_sequence)").alias("pending_windows"), ready.alias("ready_windows"), F.when(F.col("buffered_seconds").isNotNull(), F.greatest(F.lit(0.0), F.col("buffered_seconds"))).otherwise(ready * F.col("hop_seconds")).alias("ready_buffer_seconds")]


def allowed(processes: DataFrame, name: str = "name") -> DataFrame:
    """The processes that are known players (FL5): a semi join with the list, which is fixed and small."""
    players = processes.sparkSession.createDataFrame([(p,) for p in PLAYERS], "player string")
    return processes.withColumn("_hl_stem", file_stem(F.trim(F.col(name)))).join(F.broadcast(players), F.col("_hl_stem") == F.col("player"), "left_semi").drop("_hl_stem")


#: Display names of the stems, in order (PJ4).
LABELS = {"vocals": "人声", "instrumental": "伴奏（去人声）", "drums": "鼓", "bass": "贝斯", "guitar": "吉他", "piano": "钢琴", "other": "其他"}


def labels() -> Column:
    """The display names as a map (PJ4)."""
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])


def visible(stems: Column) -> Column:
    """For each known stem whether it is among ``stems`` (PJ4)."""
    return F.map_from_arrays(F.array(*[F.lit(s) for s in LABELS]), F.array(*[F.array_contains(stems, s) for s in LABELS]))


def absolute(path: Column, folder: Column) -> Column:
    """A path, below ``folder`` unless it is absolute, with single slashes and no ``.`` parts (PJ7); keep those that exist by a semi join with the listing."""
    full = F.when(path.rlike(r"^([A-Za-z]:)?[\\/]"), path).otherwise(F.concat_ws("/", folder, path))
    return F.regexp_replace(F.regexp_replace(full, r"[\\/]+", "/"), r"(/\.)+(?=/|$)", "")


def start_plan() -> list[Column]:
    """What has to start anew (PJ8). Columns: receiver_running, playback_running and current_ and requested_ profile, endpoint and hop_seconds."""
    receiver = ~F.col("receiver_running")
    changed = [~F.col(f"current_{c}").eqNullSafe(F.col(f"requested_{c}")) for c in ("profile", "endpoint", "hop_seconds")]
    return [receiver.alias("restart_receiver"), (receiver | ~F.col("playback_running") | changed[0] | changed[1] | changed[2]).alias("restart_playback")]


def age_seconds(now: Column, then: Column) -> Column:
    """Seconds between two timestamps, 0 at least, to microseconds; null if one is missing (SF9)."""
    passed = (F.unix_micros(now) - F.unix_micros(then)) / 1e6
    return F.when(passed.isNotNull(), F.greatest(F.lit(0.0), passed))


def of_epoch_ns(ns: Column) -> Column:
    """A timestamp of nanoseconds since 1970, cut to microseconds (SF9)."""
    return F.timestamp_micros(((ns - F.pmod(ns, F.lit(1000))).cast("decimal(20,0)") / 1000).cast("long"))


def heartbeat(text: Column) -> Column:
    """A timestamp of ISO 8601 text, null if it is none (SF9)."""
    return F.try_to_timestamp(text)
