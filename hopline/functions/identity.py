"""Content and metadata identities: canonical JSON, keys, manifest hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.functions.text import folded, folded_ascii

#: The tags that keep kinds of keys apart.
PCM_TAG, SONG_TAG, LYRIC_TAG, PARTS_TAG = "pcm16-v1", "song-v1", "lyrics-v1", "parts-v1"


def canonical_json(**fields: Column) -> Column:
    """A JSON object with its keys in order and no spaces (SF17). Nested structs must have their own fields in order; null fields are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def key_of(tag: str, **fields: Column) -> Column:
    """SHA-256 of the tag and the canonical JSON, in hex (SF18)."""
    return F.sha2(F.concat(F.lit(tag + "\0"), canonical_json(**fields)), 256)


def pcm_identity(pcm: Column, sample_rate: Column, channels: Column) -> Column:
    """SHA-256 over tag, geometry and samples: the same sound under any path has the same identity (AG12, SF18)."""
    head = F.concat(F.lit(PCM_TAG + "\0"), canonical_json(sample_rate=sample_rate, channels=channels), F.lit("\0"))
    return F.sha2(F.concat(head.cast("binary"), pcm.cast("binary")), 256)


def metadata_identity(title: Column, artist: Column, album: Column, duration_frames: Column, sample_rate: Column, ascii_only: bool = False) -> Column:
    """Key of a song's folded title, artist and album, its duration and sample rate (SF18)."""
    fold = folded_ascii if ascii_only else folded
    return key_of(SONG_TAG, title=fold(title), artist=fold(artist), album=fold(album), duration_frames=duration_frames, sample_rate=sample_rate)


def lyric_key(title: Column, artist: Column, album: Column, duration_seconds: Column, ascii_only: bool = False) -> Column:
    """Key of a track for lyrics: folded texts and the duration in whole seconds (SF18, SF11)."""
    from hopline.functions.numeric import whole_seconds

    fold = folded_ascii if ascii_only else folded
    return key_of(LYRIC_TAG, title=fold(title), artist=fold(artist), album=fold(album), duration_seconds=whole_seconds(duration_seconds))


def composite_key(parts: Column) -> Column:
    """Key of an ordered array of structs of key, start and frames (SF18)."""
    return F.sha2(F.concat(F.lit(PARTS_TAG + "\0"), F.to_json(parts)), 256)


def manifest_hash(files: DataFrame, group: list[str], path: str = "path", size: str = "size", digest: str = "sha256") -> DataFrame:
    """One SHA-256 for each group over its files in order of path, a line ``path|size|HASH`` for each (AG13).

    The lines of a group are its listing, so a group is as large as a folder's listing.
    """
    line = F.concat_ws("|", F.col(path), F.col(size).cast("string"), F.upper(digest))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), line.alias("l")))), lambda x: x["l"])
    text = F.concat(F.array_join(ordered, "\n"), F.lit("\n"))
    return files.groupBy(*group).agg(F.count("*").alias("files"), F.upper(F.sha2(text, 256)).alias("manifest_sha256"))
