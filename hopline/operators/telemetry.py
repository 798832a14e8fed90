"""Snapshots, counters within active segments, acceptance and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopline.functions.text import casefolded


def latest(events: DataFrame, by: list[str], at: str, payload: list[str]) -> DataFrame:
    """The last payload of each source (D11, SC8): a max of structs, so it is combined before the shuffle."""
    return events.groupBy(*by).agg(F.max(F.struct(at, *payload)).alias("_hl_m")).select(*by, "_hl_m.*")


def joined_snapshot(parts: list[DataFrame]) -> DataFrame:
    """One-row frames side by side (JN11); a missing one gives nulls. Each part is one row, so the join has one row too."""
    spark = parts[0].sparkSession
    out = spark.range(1).select(F.lit(1).alias("_hl_one"))
    for p in parts:
        out = out.join(p.limit(1).withColumn("_hl_k", F.lit(1)), F.col("_hl_one") == F.col("_hl_k"), "left").drop("_hl_k")
    return out.drop("_hl_one")


def count_of(payload: Column, path: str) -> Column:
    """A counter in a JSON payload, 0 if it isn't a whole number of at least 0 (PJ1)."""
    return F.greatest(F.lit(0), F.coalesce(F.get_json_object(payload, path).try_cast("long"), F.lit(0)))


def metric_of(payload: Column, path: str, default: float = 0.0, most: float | None = None) -> Column:
    """A finite number of at least 0 in a JSON payload, else the default (PJ1)."""
    v = F.get_json_object(payload, path).try_cast("double")
    out = F.when(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")), v).otherwise(F.lit(default))
    return F.least(F.lit(most), out) if most is not None else out


def text_of(payload: Column, path: str, most: int = 512) -> Column:
    return F.substr(F.trim(F.coalesce(F.get_json_object(payload, path), F.lit(""))), F.lit(1), F.lit(most))


def flag_of(payload: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(payload, path) == "true", F.lit(False))


def one_of(payload: Column, path: str, allowed: tuple, default: str, other: str) -> Column:
    v = F.coalesce(F.get_json_object(payload, path), F.lit(default))
    return F.when(v.isin(*allowed), v).otherwise(other)


#: AG7: the requirements, in order; the first three of ZERO decide failure.
ZERO = ("zero_active_underruns", "zero_active_device_recoveries", "zero_active_skipped_sequences")

#: The status documents that a snapshot is made of; ``input`` is the capture's while the controller captures, else the receiver's.
DOCUMENTS = ("controller", "heartbeat", "receiver", "capture", "inbox", "gpu", "playback", "manifest", "lyrics", "acceptance")
RATE = 44100
REQUIREMENTS = ("stream_received", "gpu_first_play", "song_cache_available", "song_cache_replayed", *ZERO, "mixer_adjusted_during_stream", "mixer_latency_below_limit")

#: PJ1, fixed values: fields that are read as they are, by document and kind; ``column:path`` where the two differ.
FIELDS = {
    "input": {
        "text": "input_scope track_title:track.title track_artist:track.artist track_album:track.album",
        "count": "source_sessions_tracked source_sessions_isolated track_revision:track.revision",
        "metric": "track_position_seconds:track.position_seconds track_duration_seconds:track.duration_seconds",
        "level": "peak_left peak_right rms_left rms_right",
        "flag": "signal_detected track_playing:track.playing",
    },
    "receiver": {"count": "published_windows"},
    "inbox": {"count": "captured_sequence:sequence"},
    "gpu": {
        "count": "gpu_sequence:last_sequence cache_hits cache_misses songs_cached fallback_windows inference_process_pid effective_shifts warmup_windows deadline_windows low_buffer_fallback_windows",
        "metric": "inference_timeout_seconds model_warmup_seconds shifts_benchmark_seconds continuity_reserve_seconds max_processing_seconds",
        "text": "inference_error",
        "flag": "shifts_fallback",
    },
    "playback": {
        "count": "playback_sequence:sequence skipped_sequence underruns last_underrun_system_time_ns device_open_count device_recoveries device_queue_packets device_queue_capacity_packets device_enqueued_packets device_dropped_packets device_dropped_frames device_sent_packets device_sent_bytes device_send_errors device_last_socket_error control_sequence mixer_updates",
        "metric": "prebuffer_seconds last_mixer_control_latency_ms max_mixer_control_latency_ms gain_smoothing_ms",
        "flag": "device_recovering device_network_enabled",
    },
    "manifest": {"flag": "fallback_audio cache_hit", "text": "fallback_error:error"},
    "acceptance": {"count": "acceptance_active_samples:metrics.active_samples active_underrun_delta:metrics.active_underrun_delta active_device_recovery_delta:metrics.active_device_recovery_delta active_skipped_sequence_delta:metrics.active_skipped_sequence_delta"},
}


def _frames_as(payload: Column, path: str, places: int, per_second: float = 1.0) -> Column:
    return F.round(metric_of(payload, path) * per_second / RATE, places)


def _lyric_fields(lyrics: Column, revision: Column, title: Column, artist: Column, position: Column) -> list[Column]:
    """What is shown of the lyrics document if it is that of the present track (JN7): state, source, flags, and the lines around the position (JN6)."""
    same_text = lambda path, own: casefolded(F.trim(F.coalesce(F.get_json_object(lyrics, path), F.lit("")))) == casefolded(F.trim(own))
    same = (revision > 0) & (count_of(lyrics, "$.track.revision") == revision) & same_text("$.track.title", title) & same_text("$.track.artist", artist)
    state = F.when(same, one_of(lyrics, "$.state", ("ready", "not_found", "error"), "waiting", "waiting")).otherwise("waiting")
    raw = F.slice(F.coalesce(F.from_json(F.get_json_object(lyrics, "$.lines"), "array<struct<time_seconds:double,text:string>>"), F.array().cast("array<struct<time_seconds:double,text:string>>")), 1, 20000)
    good = F.filter(raw, lambda x: (x["time_seconds"] >= 0) & ~F.isnan(x["time_seconds"]) & (F.trim(x["text"]) != ""))
    ordered = F.array_sort(F.transform(good, lambda x, i: F.struct(x["time_seconds"].alias("t"), i.alias("i"), F.substr(F.trim(x["text"]), F.lit(1), F.lit(4096)).alias("text"))))
    lines = F.when(state == "ready", ordered).otherwise(F.slice(ordered, 1, 0))
    at = F.size(F.filter(lines, lambda x: x["t"] <= position))
    text = lambda a: F.transform(a, lambda x: x["text"])
    shown = F.when(same, F.lit(True)).otherwise(False)
    return [
        state.alias("lyrics_state"), F.when(shown, one_of(lyrics, "$.source", ("cache", "lrclib"), "", "")).otherwise("").alias("lyrics_source"), (shown & flag_of(lyrics, "$.instrumental")).alias("lyrics_instrumental"),
        F.when(shown, text_of(lyrics, "$.error")).otherwise("").alias("lyrics_error"), F.coalesce(F.get(lines, at - 1)["text"], F.lit("")).alias("lyrics_current"),
        text(F.slice(lines, F.greatest(F.lit(1), at - 2), F.greatest(F.lit(0), F.least(F.lit(2), at - 1)))).alias("lyrics_previous"), text(F.slice(lines, at + 1, 2)).alias("lyrics_upcoming"), F.size(lines).cast("long").alias("lyrics_line_count")]


def snapshot(status: DataFrame, now: Column) -> DataFrame:
    """One row of the pipeline's present state, out of status (source, observed_at, payload), sources as in DOCUMENTS (PJ1, JN11, SF27, FL11).

    Each source's last document counts, and a missing one gives defaults. Values are read leniently: counts and metrics below 0 or of
    another type are 0, texts are trimmed and cut, names that are not known become the default.
    """
    from hopline.functions.rules import LABELS, age_seconds, lag_state, stale
    from hopline.functions.text import hresult

    latest_of = status.groupBy().pivot("source", list(DOCUMENTS)).agg(F.max(F.struct("observed_at", "payload")))
    seconds = lambda k: F.round(age_seconds(now, F.col(f"{k}.observed_at")), 3)
    docs = latest_of.select(*[F.coalesce(F.col(f"{k}.payload"), F.lit("{}")).alias(k) for k in DOCUMENTS], *[seconds(k).alias(f"{k}_age") for k in ("heartbeat", "receiver", "capture")])
    capturing = F.coalesce(F.get_json_object("controller", "$.state") == "capturing", F.lit(False))
    docs = docs.withColumn("capturing", capturing).withColumn("input", F.when(F.col("capturing"), F.col("capture")).otherwise(F.col("receiver"))).withColumn("input_age", F.when(F.col("capturing"), F.col("capture_age")).otherwise(F.col("receiver_age")))
    c = F.col
    kinds = {"flag": flag_of, "text": text_of, "count": count_of, "metric": lambda p, x: F.round(metric_of(p, x), 3), "level": lambda p, x: metric_of(p, x, most=1.0)}
    plain = [kinds[kind](c(doc), "$." + (f.split(":") + f.split(":"))[1]).alias(f.split(":")[0]) for doc, by in FIELDS.items() for kind, fields in by.items() for f in fields.split()]
    state = F.coalesce(F.get_json_object("controller", "$.state"), F.lit(""))
    online = F.coalesce(~stale(c("heartbeat_age"), F.lit("controller")), F.lit(False))
    wanted = F.when(c("capturing"), F.get_json_object("capture", "$.state") == "capturing").otherwise(F.get_json_object("receiver", "$.state") == "streaming")
    raw, fresh = F.coalesce(wanted, F.lit(False)), F.coalesce(~stale(c("input_age"), F.lit("stream")), F.lit(False))
    first = lambda name, default: F.coalesce(*[F.nullif(metric_of(c(d), f"$.{name}"), F.lit(0.0)) for d in ("playback", "manifest")], F.lit(default))
    overlap = F.coalesce(F.nullif(first("overlap_milliseconds", 0.0), F.lit(0.0)), first("overlap_frames", 4410.0) * 1000 / RATE)
    gains = F.map_filter(F.coalesce(F.from_json(F.get_json_object("playback", "$.gains"), "map<string,double>"), F.create_map().cast("map<string,double>")), lambda k, v: k.isin(*LABELS) & ~F.isnan(v))
    wave = F.slice(F.coalesce(F.from_json(F.get_json_object("input", "$.waveform"), "array<double>"), F.array().cast("array<double>")), 1, 64)
    clamp = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(v, F.lit(0.0))))
    hit, scope = flag_of(c("manifest"), "$.cache_hit"), one_of(c("manifest"), "$.cache_scope", ("song", "song-composite", "window"), "window", "window")
    taken = F.get_json_object("manifest", "$.processing_seconds").try_cast("double")
    isolation = F.get_json_object("input", "$.source_isolation_db").try_cast("double")
    requirements = F.map_from_arrays(F.array(*[F.lit(r) for r in REQUIREMENTS]), F.array(*[flag_of(c("acceptance"), f"$.requirements.{r}") for r in REQUIREMENTS]))
    accept = one_of(c("acceptance"), "$.state", ("waiting_for_phone", "in_progress", "passed", "failed", "timed_out", "stopped"), "not_running", "not_running")
    made = [
        state.alias("controller_state"), online.alias("controller_online"), (state.isin("airplay_waiting", "capturing") & ~online).alias("controller_stalled"), c("heartbeat_age").alias("controller_heartbeat_age_seconds"),
        (raw & fresh).alias("streaming"), (raw & ~fresh).alias("stream_stalled"), F.when(c("capturing"), "windows").otherwise("airplay").alias("input_source"), c("receiver_age").alias("receiver_status_age_seconds"),
        F.when(isolation.isNull() | F.isnan(isolation) | (F.abs(isolation) == float("inf")), 0.0).otherwise(isolation).alias("source_isolation_db"),
        F.when(c("capturing"), "PCM16 · Windows").otherwise(F.coalesce(F.get_json_object("receiver", "$.codec"), F.lit("none"))).alias("codec"), _frames_as(c("input"), "$.pcm_frames", 1).alias("received_seconds"), F.transform(wave, clamp).alias("waveform"),
        F.coalesce(F.get_json_object("playback", "$.state"), F.lit("waiting")).alias("playback_state"), F.get_json_object("playback", "$.buffered_seconds").try_cast("double").alias("buffered_seconds"),
        _frames_as(c("playback"), "$.last_underrun_buffered_frames", 3).alias("last_underrun_buffer_seconds"), _frames_as(c("playback"), "$.last_underrun_total_read_frames", 3).alias("last_underrun_playback_seconds"), _frames_as(c("playback"), "$.device_buffer_frames", 1, 1000.0).alias("device_buffer_ms"),
        F.coalesce(hresult(F.get_json_object("playback", "$.last_device_hresult")), F.lit("")).alias("last_device_hresult"), F.transform_values(gains, lambda k, v: clamp(v)).alias("gains"),
        F.round(F.coalesce(F.nullif(first("analysis_window_seconds", 0.0), F.lit(0.0)), first("window_seconds", 12.0)), 3).alias("analysis_window_seconds"), F.round(first("hop_seconds", 6.0), 3).alias("hop_seconds"), F.round(overlap, 1).alias("overlap_milliseconds"),
        F.when(taken.isNotNull() & ~F.isnan(taken), F.greatest(F.lit(0.0), taken)).alias("processing_seconds"), one_of(c("manifest"), "$.fallback_stem", tuple(LABELS), "", "").alias("fallback_stem"), one_of(c("gpu"), "$.model_state", ("warming", "ready", "error", "stopped"), "stopped", "error").alias("model_state"),
        F.when(hit, scope).otherwise("none").alias("cache_scope"), F.when(hit, F.substring(F.coalesce(F.get_json_object("manifest", "$.cache_key"), F.lit("")), 1, 12)).otherwise("").alias("cache_key_short"),
        accept.alias("acceptance_state"), requirements.alias("acceptance_requirements"), ((accept == "passed") & F.forall(F.map_values(requirements), lambda r: r)).alias("acceptance_passed")]
    base = docs.select(c("lyrics").alias("_hl_lyrics"), *plain, *made)
    shown = _lyric_fields(c("_hl_lyrics"), c("track_revision"), c("track_title"), c("track_artist"), c("track_position_seconds"))
    out = base.select("*", *shown, *lag_state()).drop("_hl_lyrics", "buffered_seconds")
    return out.withColumn("sustainable", F.coalesce(c("processing_seconds") <= c("hop_seconds"), F.lit(False)))


def restored(controller: Column, command: Column, constants: dict[str, str]) -> list[Column]:
    """Defaults of the control panel: the controller's value, else the last command's, else a constant (PJ2)."""
    return [F.coalesce(F.nullif(F.get_json_object(controller, f"$.{k}"), F.lit("")), F.nullif(F.get_json_object(command, f"$.{k}"), F.lit("")), F.lit(v)).alias(k) for k, v in constants.items()]


def active_segments(samples: DataFrame, by: list[str], at: str, active: Column) -> DataFrame:
    """samples with ``active``, ``segment`` (which run of active samples) and ``continues`` (its predecessor is in the same run) (WN5)."""
    w = Window.partitionBy(*by).orderBy(at)
    a = samples.withColumn("active", active)
    before = F.coalesce(F.lag("active").over(w), F.lit(False))
    marked = a.withColumn("continues", F.col("active") & before).withColumn("_hl_new", (F.col("active") & ~before).cast("int"))
    return marked.withColumn("segment", F.sum("_hl_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_hl_new")


def counter_deltas(samples: DataFrame, by: list[str], at: str, counters: list[str]) -> DataFrame:
    """by, segment and for each counter its rise within the segment and whether it fell there (WN5). samples come from active_segments()."""
    w = Window.partitionBy(*by).orderBy(at)
    marked = samples
    for c in counters:
        marked = marked.withColumn(f"_hl_fell_{c}", F.col("continues") & (F.col(c) < F.lag(c).over(w)))
    aggs = []
    for c in counters:
        aggs += [F.greatest(F.lit(0), F.max(c) - F.min_by(c, at)).alias(f"{c}_delta"), F.bool_or(F.coalesce(f"_hl_fell_{c}", F.lit(False))).alias(f"{c}_reset")]
    return marked.where("active").groupBy(*by, "segment").agg(F.count("*").alias("samples"), *aggs)


def adjusted_latency(samples: DataFrame, by: list[str], at: str, updates: str, latency: str) -> DataFrame:
    """The largest latency among samples whose update counter rose within a continuing segment; 0 if none (WN6)."""
    w = Window.partitionBy(*by).orderBy(at)
    rose = samples.withColumn("_hl_rose", F.col("continues") & (F.col(updates) > F.lag(updates).over(w)))
    return rose.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("_hl_rose"), F.col(latency))), F.lit(0.0)).alias("max_latency_ms"))



def acceptance(samples: DataFrame, by: list[str], at: str = "observed_at_ns", latency_limit_ms: float = 50.0) -> DataFrame:
    """One row for each session: counts, deltas, the nine requirements and the state (AG6, AG7, AG10, WN5, WN6, ST15)."""
    active = F.col("streaming") | (F.col("playback_state") == "playing")
    w = Window.partitionBy(*by).orderBy(at)
    s = active_segments(samples, by, at, active).withColumn("_hl_hits0", F.first("cache_hits").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    counters = ["underruns", "device_recoveries", "skipped_sequence", "mixer_updates"]
    deltas = counter_deltas(s, by, at, counters).groupBy(*by).agg(*[F.sum(f"{c}_delta").alias(f"active_{c}_delta") for c in counters], *[F.bool_or(f"{c}_reset").alias(f"{c}_reset") for c in counters[:3]])
    rise = lambda c: (F.max(c) - F.min_by(c, at)).alias(f"{c}_delta")
    replay = F.count_if(F.col("cache_hit") & F.col("cache_scope").isin("song", "song-composite") & (F.col("cache_hits") > F.col("_hl_hits0")))
    totals = s.groupBy(*by).agg(
        F.count("*").alias("samples"), F.count_if("streaming").alias("streaming_samples"), F.count_if(F.col("playback_state") == "playing").alias("playing_samples"), F.count_if("active").alias("active_samples"),
        rise("captured_sequence"), rise("gpu_sequence"), rise("cache_hits"), rise("cache_misses"), F.min_by("songs_cached", at).alias("initial_songs_cached"), F.max("songs_cached").alias("maximum_songs_cached"), F.max_by("songs_cached", at).alias("latest_songs_cached"),
        F.max("pending_windows").alias("maximum_pending_windows"), F.min(F.when(F.col("active"), F.col("ready_buffer_seconds"))).alias("minimum_active_buffer_seconds"), F.bool_or(F.col("active") & F.col("device_recovering")).alias("recovering_seen"), replay.alias("replay_samples"))
    r = totals.join(deltas, by, "left").join(adjusted_latency(s, by, at, "mixer_updates", "last_mixer_control_latency_ms"), by)
    r = r.na.fill(0, [f"active_{c}_delta" for c in counters]).na.fill(False, [f"{c}_reset" for c in counters[:3]])
    return requirements(r, latency_limit_ms)


def requirements(r: DataFrame, latency_limit_ms: float = 50.0) -> DataFrame:
    """r, which has a session's figures, with the nine requirements and the state (AG7)."""
    need = {
        "stream_received": "streaming_samples > 0 and captured_sequence_delta > 0",
        "gpu_first_play": "cache_misses_delta > 0 and gpu_sequence_delta > 0",
        "song_cache_available": "latest_songs_cached > 0",
        "song_cache_replayed": "replay_samples > 0",
        ZERO[0]: "active_samples > 0 and active_underruns_delta = 0 and not underruns_reset",
        ZERO[1]: "active_samples > 0 and active_device_recoveries_delta = 0 and not recovering_seen and not device_recoveries_reset",
        ZERO[2]: "active_samples > 0 and active_skipped_sequence_delta = 0 and not skipped_sequence_reset",
        "mixer_adjusted_during_stream": "active_mixer_updates_delta > 0",
        "mixer_latency_below_limit": f"active_mixer_updates_delta > 0 and max_latency_ms <= {latency_limit_ms}",
    }
    r = r.select("*", *[F.expr(v).alias(k) for k, v in need.items()])
    failed = F.expr(f"song_cache_replayed and (not ({' and '.join(ZERO)}) or (mixer_adjusted_during_stream and not mixer_latency_below_limit))")
    passed = F.expr(" and ".join(need))
    return r.withColumn("state", F.when(passed, "passed").when(failed, "failed").when(~F.col("stream_received"), "waiting_for_phone").otherwise("in_progress"))


def tracks_seen(samples: DataFrame, by: list[str], at: str, active: Column) -> DataFrame:
    """Distinct tracks of each group in the order they were first seen (AG10)."""
    named = samples.where(active).select(*by, at, F.substr(F.trim("track_title"), F.lit(1), F.lit(512)).alias("title"), F.substr(F.trim("track_artist"), F.lit(1), F.lit(512)).alias("artist"), F.round("track_duration_seconds", 3).alias("duration_seconds"))
    first = named.where("title <> '' or artist <> ''").groupBy(*by, "title", "artist", "duration_seconds").agg(F.min(at).alias("first_seen"))
    return first.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy("first_seen", "title", "artist", "duration_seconds")))


def control_latency(commands: DataFrame, by: list[str], started: Column) -> DataFrame:
    """Count, last and largest latency in milliseconds of commands issued since observation started (AG8): below 0 is 0, rounded up to microseconds."""
    seen = commands.where(F.col("issued_at_ns") >= started).withColumn("_hl_us", F.ceil(F.greatest(F.lit(0), F.col("applied_at_ns") - F.col("issued_at_ns")) / 1000))
    return seen.groupBy(*by).agg(F.count("*").alias("updates"), (F.max_by("_hl_us", "applied_at_ns") / 1000).alias("last_ms"), (F.max("_hl_us") / 1000).alias("max_ms"))


def newest(rows: DataFrame, by: list[str], sequence: str) -> DataFrame:
    """Rows whose sequence is above all before them, in order of arrival (ST14): repeated and old commands are left out."""
    w = Window.partitionBy(*by).orderBy("arrived_at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_hl_m", F.max(sequence).over(w)).where(F.col("_hl_m").isNull() | (F.col(sequence) > F.col("_hl_m"))).drop("_hl_m")


def timings(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """AG11."""
    return rows.groupBy(*by).agg(F.min(value).alias("min"), F.median(value).alias("median"), F.max(value).alias("max"))


def shed(rows: DataFrame) -> DataFrame:
    """rows with ``route``: what is done with a window (ST6, 3.1). Columns: song_hit, window_hit, windows_capture, backlog, playing, buffered_seconds, hop_seconds, audible.

    Cheapest first: a song or window of the cache; then the original sound where the input is silent or the model would come too late; then the model.
    """
    return rows.withColumn("route", F.expr("case when song_hit then 'song_cache' when window_hit and not windows_capture then 'window_cache' when not audible then 'fallback_silent' when playing and backlog >= 2 then 'fallback_backlog' when playing and buffered_seconds <= hop_seconds + 1 then 'fallback_buffer' else 'model' end"))


def fallback(rows: DataFrame, stems: list[str], preferred: str) -> DataFrame:
    """A row for each stem of a window that failed: the original sound in the preferred stem, silence in the others (ST7)."""
    each = rows.withColumn("stem", F.explode(F.array(*[F.lit(s) for s in stems])))
    return each.withColumn("pcm", F.when(F.col("stem") == preferred, F.col("pcm")).otherwise(F.transform("pcm", lambda v: F.lit(0).cast("smallint"))))
