"""Little-endian fields, checksums, and the two packet layouts. Samples and audio packets are read in Arrow batches, the rest in the JVM."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the packet format.
MAGIC = b"SSNP"
VERSION, AUDIO, CONTROL = 1, 1, 2
AUDIO_HEADER, CONTROL_BYTES, MOST_BYTES = 40, 48, 1400
AUDIO_SUM, CONTROL_SUM = 36, 44
PCM16LE, SILENCE = 1, 1
RATES = (44100, 48000)
UNITY = 32768
STEMS = ("vocals", "instrumental", "drums", "bass", "other", "guitar", "piano")
ERRORS = ("none", "too_short", "wrong_magic", "unsupported_version", "wrong_packet_type", "invalid_header", "invalid_geometry", "invalid_length", "output_too_small", "checksum_mismatch", "invalid_control")


def unsigned(packet: Column, offset: int, width: int) -> Column:
    """The unsigned little-endian number of ``width`` bytes at ``offset``, as a long (64-bit numbers above 2^63 - 1 are null) (SF16)."""
    part = F.hex(F.substring(packet, offset + 1, width))
    pairs = F.concat(*[F.substring(part, 2 * (width - i) - 1, 2) for i in range(width)])
    return F.conv(pairs, 16, 10).try_cast("long")


def little_endian(value: Column, width: int) -> Column:
    """``width`` bytes of a whole number, the lowest first (SF16)."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(width)]))


@F.pandas_udf(T.ArrayType(T.ShortType()))
def samples(payload: pd.Series) -> pd.Series:
    """array<smallint> of little-endian 16-bit samples (SF16); an odd last byte is left out."""
    return payload.map(lambda b: None if b is None else np.frombuffer(b, "<i2", len(b) // 2))


@F.pandas_udf(T.BinaryType())
def packed(pcm: pd.Series) -> pd.Series:
    """Little-endian 16-bit bytes of an array of samples."""
    return pcm.map(lambda v: None if v is None else np.asarray(v).astype("<i2").tobytes())


def checksum(packet: Column, field: int) -> Column:
    """CRC32 of the packet with its checksum field as zeros (AG14)."""
    return F.crc32(F.concat(F.substring(packet, 1, field), F.lit(bytes(4)), F.substring(packet, field + 5, MOST_BYTES)))


def _ladder(*rungs: tuple[Column, str]) -> Column:
    out = None
    for condition, name in rungs:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise("none")


def _common(packet: Column, kind: int, header: int) -> list[tuple[Column, str]]:
    return [
        (F.substring(packet, 1, 4) != F.lit(MAGIC), "wrong_magic"),
        (unsigned(packet, 4, 1) != VERSION, "unsupported_version"),
        (unsigned(packet, 5, 1) != kind, "wrong_packet_type"),
        (unsigned(packet, 6, 2) != header, "invalid_header"),
    ]


_NUMBERS = ("session_id", "sequence", "presentation_frame", "sample_rate", "frame_count", "flags")
_AUDIO = T.StructType([T.StructField("error", T.StringType()), *[T.StructField(c, T.LongType()) for c in _NUMBERS], T.StructField("pcm", T.ArrayType(T.ShortType()))])
_HEADER = np.dtype({"names": ["version", "kind", "header", "session_id", "sequence", "frame", "rate", "frames", "channels", "format", "payload", "flags", "checksum"], "formats": ["u1", "u1", "<u2", "<u4", "<u4", "<u8", "<u4", "<u2", "u1", "u1", "<u2", "<u2", "<u4"], "offsets": [4, 5, 6, 8, 12, 16, 24, 28, 30, 31, 32, 34, 36], "itemsize": AUDIO_HEADER})


@F.pandas_udf(_AUDIO)
def audio(packet: pd.Series) -> pd.DataFrame:
    """The first rule that an audio packet breaks, or none, and the fields of one that breaks none (SC18): headers are read as columns, payloads in one piece."""
    data = [b or b"" for b in packet]
    size = np.array([len(b) for b in data])
    h = np.frombuffer(b"".join(b[:AUDIO_HEADER].ljust(AUDIO_HEADER, b"\0") for b in data), _HEADER)
    frames = h["frames"].astype(np.int64)
    rungs = [
        ("too_short", size < AUDIO_HEADER), ("invalid_length", size > MOST_BYTES), ("wrong_magic", np.array([b[:4] != MAGIC for b in data], bool)), ("unsupported_version", h["version"] != VERSION), ("wrong_packet_type", h["kind"] != AUDIO),
        ("invalid_header", h["header"] != AUDIO_HEADER), ("invalid_geometry", (h["channels"] != 2) | ~np.isin(h["rate"], RATES) | (h["format"] != PCM16LE) | (frames == 0)), ("invalid_header", (h["flags"] & ~np.uint16(SILENCE)) != 0),
        ("invalid_length", (h["payload"] != 4 * frames) | (size != AUDIO_HEADER + 4 * frames)),
        ("checksum_mismatch", h["checksum"] != np.array([zlib.crc32(b[AUDIO_SUM + 4 :], zlib.crc32(b[:AUDIO_SUM] + bytes(4))) for b in data], np.int64)),
    ]
    error = np.select([r for _, r in rungs], [n for n, _ in rungs], "none").astype(object)
    fine = error == "none"
    error[[b is None for b in packet]] = None
    frame = h["frame"]
    out = {"session_id": h["session_id"], "sequence": h["sequence"], "presentation_frame": frame.astype(np.int64), "sample_rate": h["rate"], "frame_count": h["frames"], "flags": h["flags"]}
    columns = {k: pd.Series(v.astype(np.int64), dtype="Int64").mask(~fine) for k, v in out.items()}
    columns["presentation_frame"] = columns["presentation_frame"].mask(frame >= np.uint64(1 << 63))
    pcm = [np.frombuffer(b, "<i2", offset=AUDIO_HEADER) if ok else None for b, ok in zip(data, fine)]
    return pd.DataFrame({"error": error, **columns, "pcm": pd.Series(pcm, dtype=object)})


def audio_error(packet: Column) -> Column:
    """The first rule that an audio packet breaks, or none (SC18)."""
    return audio(packet)["error"]


def audio_fields(packet: Column) -> Column:
    """The fields of a valid audio packet, null for any other."""
    a = audio(packet)
    return F.when(a["error"] == "none", F.struct(*[a[c].alias(c) for c in (*_NUMBERS, "pcm")]))


def gains(packet: Column) -> Column:
    return F.array(*[unsigned(packet, 28 + 2 * i, 2) for i in range(len(STEMS))])


def valid_mask(mask: Column) -> Column:
    """Whether no bit beyond the stems is set (FL10)."""
    return mask.bitwiseAND(~((1 << len(STEMS)) - 1)) == 0


def control_error(packet: Column) -> Column:
    """The first rule that a mixer control packet breaks, or none (SC18); null for null."""
    error = _ladder(
        (F.length(packet) < CONTROL_BYTES, "too_short"),
        (F.length(packet) != CONTROL_BYTES, "invalid_length"),
        *_common(packet, CONTROL, CONTROL_BYTES),
        ((F.substring(packet, 26, 3) != F.lit(bytes(3))) | (unsigned(packet, 42, 2) != 0), "invalid_header"),
        (unsigned(packet, CONTROL_SUM, 4) != checksum(packet, CONTROL_SUM), "checksum_mismatch"),
        (~valid_mask(unsigned(packet, 24, 1)) | F.exists(gains(packet), lambda g: g > UNITY), "invalid_control"),
    )
    return F.when(packet.isNotNull(), error)


def control_fields(packet: Column) -> Column:
    """The fields of a valid control packet with its gains by stem (of the mask, 1.0 is unity), null for any other."""
    mask = unsigned(packet, 24, 1)
    kept = F.array(*[F.when(mask.bitwiseAND(1 << i) != 0, F.struct(F.lit(s).alias("k"), (unsigned(packet, 28 + 2 * i, 2) / UNITY).alias("v"))) for i, s in enumerate(STEMS)])
    masked = F.map_from_entries(F.filter(kept, lambda x: x.isNotNull()))
    fields = F.struct(unsigned(packet, 8, 4).alias("session_id"), unsigned(packet, 12, 4).alias("sequence"), unsigned(packet, 16, 8).alias("issued_at_ms"), unsigned(packet, 24, 1).alias("valid_stem_mask"), masked.alias("gains"))
    return F.when(control_error(packet) == "none", fields)


def _sealed(packet: Column, field: int) -> Column:
    return F.concat(F.substring(packet, 1, field), little_endian(checksum(packet, field), 4), F.substring(packet, field + 5, MOST_BYTES))


def audio_packet(session_id: Column, sequence: Column, frame: Column, sample_rate: Column, pcm: Column, flags: Column | None = None) -> Column:
    """An audio packet of interleaved stereo samples; null if the geometry, the flags or the length are not allowed (SK18)."""
    flags = F.lit(0) if flags is None else flags
    bytes_ = 2 * F.size(pcm)
    head = [F.lit(MAGIC), F.lit(bytes([VERSION, AUDIO])), little_endian(F.lit(AUDIO_HEADER), 2), little_endian(session_id, 4), little_endian(sequence, 4), little_endian(frame, 8), little_endian(sample_rate, 4)]
    head += [little_endian(F.size(pcm) / 2, 2), F.lit(bytes([2, PCM16LE])), little_endian(bytes_, 2), little_endian(flags, 2), F.lit(bytes(4)), packed(pcm)]
    fine = sample_rate.isin(*RATES) & (F.size(pcm) > 0) & (F.size(pcm) % 2 == 0) & (flags.bitwiseAND(~SILENCE) == 0) & (AUDIO_HEADER + bytes_ <= MOST_BYTES)
    return F.when(fine, _sealed(F.concat(*head), AUDIO_SUM))


def control_packet(session_id: Column, sequence: Column, issued_at_ms: Column, mask: Column, gains_q15: Column) -> Column:
    """A mixer control packet; null for a mask beyond the stems or a gain beyond unity (SK18)."""
    body = [F.lit(MAGIC), F.lit(bytes([VERSION, CONTROL])), little_endian(F.lit(CONTROL_BYTES), 2), little_endian(session_id, 4), little_endian(sequence, 4), little_endian(issued_at_ms, 8)]
    body += [little_endian(mask, 1), F.lit(bytes(3)), *[little_endian(F.get(gains_q15, i), 2) for i in range(len(STEMS))], F.lit(bytes(2)), F.lit(bytes(4))]
    fine = valid_mask(mask) & (F.size(gains_q15) == len(STEMS)) & ~F.exists(gains_q15, lambda g: g > UNITY)
    return F.when(fine, _sealed(F.concat(*body), CONTROL_SUM))


def gain_q15(gain: Column) -> Column:
    """A gain in [0, 1] as 0 to 32768."""
    return F.round(gain * UNITY).cast("int")
