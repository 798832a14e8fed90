"""Schemas of the records that the operators take and return.

Frames, RTP times and packet sequences are longs: an unsigned 32-bit number does not fit an int. PCM is kept as one block
of interleaved samples in a row, never one row for each sample.
"""

from __future__ import annotations

from pyspark.sql import types as T

ANCHOR = (
    "revision long, metadata_revision long, has_progress boolean, start_rtp long, current_rtp long, end_rtp long, "
    "anchor_stream_frame long, track_position_frame long, track_duration_frame long, title string, artist string, album string"
)
PCM_BLOCK = "stream_id string, sequence long, start_frame long, channels int, sample_rate int, pcm array<smallint>"
WINDOW = "sequence long, stream_start_frame long, stream_end_frame long, path string, pcm array<smallint>"
SEGMENT = (
    "revision long, metadata_revision long, start_rtp long, stream_start_frame long, stream_end_frame long, "
    "track_start_frame long, track_end_frame long, track_duration_frame long, title string, artist string, album string"
)
ANNOTATION = (
    "version int, source string, sequence long, sample_rate int, stream_start_frame long, stream_end_frame long, "
    f"track struct<{', '.join(f.replace(' ', ':', 1) for f in ANCHOR.split(', '))}>, "
    f"anchors array<struct<{', '.join(f.replace(' ', ':', 1) for f in ANCHOR.split(', '))}>>"
)
STEM_PROFILE = "profile_tracks int, stem string, stem_ordinal int, source string"
TRACK = "struct<title:string, artist:string, album:string, duration_frames:long, sample_rate:int>"
RESULT_MANIFEST = (
    "version int, sequence long, sample_rate int, channels int, window_seconds int, hop_seconds int, stable_offset_seconds int, "
    "overlap_frames int, processing_seconds double, latency_seconds double, cache_hit boolean, cache_scope string, cache_key string, "
    "cache_chunk_index int, cached_start_frame long, cache_part_count int, "
    f"cache_parts array<struct<cache_key:string, cached_start_frame:long, frame_count:long, track:{TRACK}>>, "
    f"track {TRACK}, tracks array<{TRACK}>, fallback_audio boolean, fallback_reason string, fallback_stem string, "
    "fallback_output_gain double, error string, stems map<string,string>"
)
PROFILE = (
    "struct<profile_name:string, model_filename:string, stems:array<string>, sample_rate:int, channels:int, bits_per_sample:int, "
    "window_seconds:int, hop_seconds:int, stable_offset_seconds:int, overlap_frames:int, algorithm_version:string>"
)
CACHE_WINDOW = "cache_key string, state string, chunk_index int, chunk_count int, stem string, filename string, bytes long, sha256 string, accessed_at long"
CACHE_SONG = (
    f"schema_version int, state string, cache_key string, audio_identity string, metadata_identity string, metadata {TRACK}, profile {PROFILE}, "
    "origin_track_frame long, frame_count long, files map<string, struct<filename:string, bytes:long, sha256:string>>, completed_at_ns long"
)
LYRIC_LINE = "track_key string, line_no int, time_seconds double, text string"
STATUS_EVENT = "source string, observed_at timestamp, payload string"
COMMAND = "sequence long, action string, issued_at_ns long, payload string"
TELEMETRY = (
    "observed_at_ns long, streaming boolean, playback_state string, captured_sequence long, gpu_sequence long, skipped_sequence long, "
    "underruns long, device_recoveries long, device_recovering boolean, mixer_updates long, last_mixer_control_latency_ms double, "
    "cache_hits long, cache_misses long, cache_hit boolean, cache_scope string, songs_cached long, pending_windows long, "
    "ready_buffer_seconds double, track_title string, track_artist string, track_duration_seconds double"
)
PROCESS = "pid int, name string, title string"
PACKET = "packet binary"
LEVELS = "peak_left float, peak_right float, rms_left float, rms_right float, waveform array<float>"


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
