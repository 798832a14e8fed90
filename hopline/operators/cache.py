"""Content-addressed lookup, tolerant lookup, integrity, quota and publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopline.functions.numeric import frame_range
from hopline.operators.signal import align
from hopline.operators.timeline import islands, latest_names


def lookup(requests: DataFrame, entries: DataFrame, key: str = "cache_key") -> DataFrame:
    """requests with the complete entry of their key, hit true or false (JN3)."""
    return requests.join(entries.where("state = 'complete'").withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(requests: DataFrame, entries: DataFrame, key: str = "cache_key") -> DataFrame:
    """The requests that no complete entry answers: only these go to the model (O1)."""
    return requests.join(entries.where("state = 'complete'").select(key), key, "left_anti")


def same_names(requests: DataFrame, songs: DataFrame, names: list[str], duration: str, tolerance: Column | None, bucket: float | None = None) -> DataFrame:
    """requests with every song of equal ``names`` whose duration lies within ``tolerance`` (null: any), its columns as ``song_`` and their name (JN4).

    Names are folded beforehand and are the join's keys. Where one name is common, give ``bucket``, a duration that no tolerance
    passes: the durations' buckets are then keys too, so that only songs of like length meet.
    """
    s = songs.select(*names, *[F.col(c).alias(f"song_{c}") for c in songs.columns if c not in names])
    if tolerance is None:
        return requests.join(s, names)
    near = F.abs(F.col(duration) - F.col(f"song_{duration}")) <= tolerance
    if bucket is None:
        return requests.join(s, names).where(near)
    own = F.floor(F.col(f"song_{duration}") / bucket)
    s = s.withColumn("_hl_b", F.explode(F.array(own - 1, own, own + 1)))
    return requests.withColumn("_hl_b", F.floor(F.col(duration) / bucket)).join(s, [*names, "_hl_b"]).where(near).drop("_hl_b")


def tolerant(requests: DataFrame, songs: DataFrame, names: list[str], duration: str, tolerance: Column, accessed: str, any_duration: bool = False, bucket: float | None = None) -> DataFrame:
    """Each request with the song of equal ``names`` whose duration lies within ``tolerance``, the last accessed, then the least in its other columns (JN4, TK3).

    Equal requests are answered once and counted, so that nothing depends on numbers given to rows.
    """
    each = requests.groupBy(*requests.columns).agg(F.count("*").cast("int").alias("_hl_times"))
    hits = same_names(each, songs, names, duration, None if any_duration else tolerance, bucket)
    rest = [f"song_{c}" for c in songs.columns if c not in names]
    newest = best_candidate(hits, each.columns, [*falling(hits, f"song_{accessed}"), *rest])
    return newest.withColumn("_hl_i", F.explode(F.sequence(F.lit(1), "_hl_times"))).drop("_hl_i", "_hl_times")


def falling(rows: DataFrame, column: str) -> list[Column]:
    """Columns that ascend as a number, date or time falls, null last."""
    kind = dict(rows.dtypes)[column]
    number = {"date": F.unix_date, "timestamp": F.unix_micros}.get(kind, F.col)(column)
    return [F.col(column).isNull(), -number]


def best_candidate(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The row of each group that is least in ``order``, columns that ascend (JN8, TK5, AG9): combined before the shuffle."""
    least = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)]))
    return rows.groupBy(*by).agg(least.alias("_hl_best")).select("_hl_best.*")


def located(candidates: DataFrame, least: float | None = None) -> DataFrame:
    """candidates (song_pcm, pcm, approx, radius) with where the one lies in the other (JN5); those not found are left out."""
    out = candidates.withColumn("_hl_a", align("song_pcm", "pcm", "approx", "radius")).select("*", "_hl_a.offset", "_hl_a.correlation", "_hl_a.gain").drop("_hl_a")
    return out.where("offset is not null")


def grouped_match(pieces: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Windows all of whose islands are found: key, parts in stream order (JN14). Any miss makes the window a miss."""
    of = pieces.select(*key, "island").distinct()
    both = of.join(found, [*key, "island"], "left")
    part = F.struct("island", "song_key", "offset", "frame_count")
    out = both.groupBy(*key).agg(F.bool_and(F.col("offset").isNotNull()).alias("_hl_all"), F.array_sort(F.collect_list(part)).alias("parts"))
    return out.where("_hl_all").drop("_hl_all")


def song_hits(pieces: DataFrame, windows: DataFrame, songs: DataFrame, key: list[str], offset_frames: Column, frame_count: Column, radius: Column, channels: int = 2) -> DataFrame:
    """Windows that cached songs answer whole: key, parts (JN14 by way of WN4, AG19, JN4 and JN5).

    pieces: what timeline.segments() gives. windows: key, stream_start_frame, pcm. songs: song_key, title, artist, album, accessed_at,
    song_pcm, names folded. A window's pieces must cover its output without a hole, at revisions above 0 and with a name; each island
    is then looked up by name, whatever its duration, and takes the last accessed song in which its sound is found.
    """
    w = windows.select(*key, (F.col("stream_start_frame") + offset_frames).alias("_hl_start"), frame_count.alias("_hl_frames"), F.col("stream_start_frame").alias("_hl_first"), F.col("pcm").alias("_hl_pcm"))
    own = pieces.join(w.drop("_hl_first", "_hl_pcm"), key)
    whole = (F.min("stream_start_frame") == F.first("_hl_start")) & (F.max("stream_end_frame") == F.first("_hl_start") + F.first("_hl_frames"))
    whole = whole & (F.sum(F.col("stream_end_frame") - F.col("stream_start_frame")) == F.first("_hl_frames")) & F.bool_and(F.col("revision") > 0)
    usable = own.groupBy(*key).agg(whole.alias("_hl_whole")).where("_hl_whole").select(*key)
    grouped = islands(pieces.join(usable, key, "left_semi"), key)
    spans = grouped.groupBy(*key, "island").agg(F.min("stream_start_frame").alias("first_frame"), (F.max("stream_end_frame") - F.min("stream_start_frame")).alias("frame_count"), F.min_by("track_start_frame", "stream_start_frame").alias("approx"))
    named = spans.join(latest_names(grouped, [*key, "island"]), [*key, "island"])
    part = frame_range(F.col("_hl_pcm"), F.col("first_frame") - F.col("_hl_first"), F.col("frame_count"), channels)
    asked = named.join(w.select(*key, "_hl_first", "_hl_pcm"), key).select(*key, "island", "frame_count", "approx", "title", "artist", "album", part.alias("pcm"))
    met = same_names(asked, songs.select("title", "artist", "album", "song_key", "accessed_at", F.col("song_pcm").alias("pcm")), ["title", "artist", "album"], "", None)
    scored = located(met.withColumn("radius", radius))
    slim = scored.select(*key, "island", F.col("song_song_key").alias("song_key"), "song_accessed_at", "offset", "frame_count")
    return grouped_match(grouped, best_candidate(slim, [*key, "island"], [*falling(slim, "song_accessed_at"), "song_key"]), key)


def dense(chunks: DataFrame, by: list[str], index: str) -> DataFrame:
    """by, n, complete: the indices of a group are 0 to n - 1, each once (SO6)."""
    n, d = F.count("*"), F.count_distinct(index)
    return chunks.groupBy(*by).agg(n.alias("n"), ((F.min(index) == 0) & (F.max(index) == n - 1) & (d == n)).alias("complete"))


def upserted(chunks: DataFrame, by: list[str], index: str, order: str) -> DataFrame:
    """The latest row of each index (SO5), combined before the shuffle."""
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in chunks.columns]), F.col(order))
    return chunks.groupBy(*by, index).agg(last.alias("_hl_last")).select("_hl_last.*")


def intact(files: DataFrame, by: list[str], expected_stems: Column) -> DataFrame:
    """Entries that pass every check: files as they should be, a full set of stems in each chunk, chunks dense, one geometry (FL14, SO1).

    files: by, chunk_index, stem, bytes, expected_bytes, sha256, expected_sha256, sample_rate, channels.
    """
    sound = F.bool_and(F.coalesce((F.col("bytes") == F.col("expected_bytes")) & (F.col("sha256") == F.col("expected_sha256")), F.lit(False)))
    chunk = files.groupBy(*by, "chunk_index").agg(sound.alias("sound"), (F.array_sort(F.collect_list("stem")) == F.array_sort(F.first(expected_stems))).alias("full"), F.min(F.struct("sample_rate", "channels")).alias("low"), F.max(F.struct("sample_rate", "channels")).alias("high"))
    n = F.count("*")
    ok = F.bool_and("sound") & F.bool_and("full") & (F.min("low") == F.max("high")) & (F.min("chunk_index") == 0) & (F.max("chunk_index") == n - 1)
    return chunk.groupBy(*by).agg(n.alias("chunks"), ok.alias("intact"))


def quarantined(entries: DataFrame, checks: DataFrame, key: list[str]) -> DataFrame:
    """Entries without those that failed their checks (FL14, JN3): an anti join in place of a deletion."""
    return entries.join(checks.where(~F.col("intact")).select(*key), key, "left_anti")


def evicted(entries: DataFrame, by: list[str], order: list[str], size: str, most: Column) -> DataFrame:
    """Which entries go, oldest first, until the rest fits (TK2): an entry goes if the total before it is still above ``most``."""
    group, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.sum(size).over(group) - (F.sum(size).over(w) - F.col(size))
    return entries.withColumn("left_before", left).where(F.col("left_before") > most).withColumn("removal_order", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def retained(artifacts: DataFrame, safe: DataFrame, by: list[str], sequence: str = "sequence", keep: int = 8) -> DataFrame:
    """Artifacts above the consumer's safe sequence less ``keep`` (ST2). Groups without a safe sequence keep all."""
    joined = artifacts.join(safe.select(*by, "safe_sequence"), by, "left")
    return joined.where(F.col("safe_sequence").isNull() | (F.col(sequence) > F.col("safe_sequence") - keep)).drop("safe_sequence")


def sliced(hits: DataFrame, channels: int = 2) -> DataFrame:
    """hits (song_pcm, offset, frame_count) with the part of the song that answers them (SK6)."""
    return hits.withColumn("pcm", F.slice("song_pcm", (channels * F.col("offset") + 1).cast("int"), (channels * F.col("frame_count")).cast("int")))


def published(songs: DataFrame) -> DataFrame:
    """Finished songs that may enter the cache, trimmed to their duration, one for each content key (ST5)."""
    from hopline.functions.rules import rejection

    fine = songs.where(rejection().isNull())
    trimmed = fine.withColumn("pcm", F.slice("pcm", 1, (2 * F.col("duration_frames")).cast("int"))).withColumn("frame_count", F.col("duration_frames"))
    return trimmed.dropDuplicates(["cache_key"])


def sizes(files: DataFrame, by: list[str]) -> DataFrame:
    """Bytes and files of each entry (AG5), and with them the count of complete ones (AG4)."""
    return files.groupBy(*by).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))
