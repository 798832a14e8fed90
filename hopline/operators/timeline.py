"""As-of and interval joins on a stream's timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopline.functions.numeric import wrapped_difference


def asof(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, columns: list[str]) -> DataFrame:
    """left with ``columns`` of the last row of right at or before it in its group, null if there is none (JN1, JN6).

    Both sides are one union, sorted within groups: a single shuffle and no inequality join. Of right rows at one
    time the largest in ``columns`` counts.
    """
    l = left.select(*by, F.col(left_at).alias("_hl_at"), F.lit(1).alias("_hl_side"), F.struct(*left.columns).alias("_hl_row"), F.lit(None).alias("_hl_hit"))
    hit = F.struct(*columns)
    r = right.select(*by, F.col(right_at).alias("_hl_at"), F.lit(0).alias("_hl_side"), F.lit(None).alias("_hl_row"), hit.alias("_hl_hit"))
    w = Window.partitionBy(*by).orderBy("_hl_at", "_hl_side", "_hl_hit").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_hl_found", F.last("_hl_hit", ignorenulls=True).over(w))
    return both.where("_hl_side = 1").select("_hl_row.*", *[F.col(f"_hl_found.{c}").alias(f"{c}_asof" if c in left.columns else c) for c in columns])


def segments(windows: DataFrame, key: list[str], offset_frames: Column, frame_count: Column) -> DataFrame:
    """The pieces of each window's output interval by the anchor that holds there (JN1).

    windows: key, stream_start_frame, anchors (array of anchor structs, in order). The output is [start + offset, + count). An
    anchor holds from its frame to the next one's; the last at or before the output's start holds at its start. Without such
    one the first later anchor is projected back, to the output's start if its position there is not below 0, else from its own
    frame. Pieces without progress or outside [0, duration) are dropped, and a piece ends with its track.
    """
    start = F.col("stream_start_frame") + offset_frames
    base = windows.select(*key, start.alias("_s"), (start + frame_count).alias("_e"), F.posexplode("anchors").alias("_i", "a"))
    w = Window.partitionBy(*key).orderBy("a.anchor_stream_frame", "_i")
    a = base.withColumn("_next", F.lead("a.anchor_stream_frame").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    at, position, duration = F.col("a.anchor_stream_frame"), F.col("a.track_position_frame"), F.col("a.track_duration_frame")
    back = F.col("_first") & (at > F.col("_s")) & (position + F.col("_s") - at >= 0)
    low = F.when(back, F.col("_s")).otherwise(F.greatest(at, F.col("_s")))
    cut = a.withColumn("_low", low).withColumn("_track", position + low - at)
    high = F.least(F.col("_e"), F.coalesce("_next", "_e"), F.col("_low") + duration - F.col("_track"))
    cut = cut.withColumn("_high", high).where((F.col("_low") < F.col("_high")) & F.col("a.has_progress") & (duration > 0) & (F.col("_track") >= 0) & (F.col("_track") < duration))
    return cut.select(
        *key, "a.revision", "a.metadata_revision", "a.start_rtp", F.col("_low").alias("stream_start_frame"), F.col("_high").alias("stream_end_frame"), F.col("_track").alias("track_start_frame"),
        (F.col("_track") + F.col("_high") - F.col("_low")).alias("track_end_frame"), duration.alias("track_duration_frame"), "a.title", "a.artist", "a.album")


def window_anchors(windows: DataFrame, anchors: DataFrame, by: list[str], bucket_frames: int) -> DataFrame:
    """Each window with the last anchor at or before its start and all in (start, end] (JN2).

    The range part is an equi join on frame buckets of ``bucket_frames``; the anchor before comes from asof().
    """
    cols = [c for c in anchors.columns if c not in by]
    w = windows.withColumn("_hl_b", F.explode(F.sequence(F.floor(F.col("stream_start_frame") / bucket_frames), F.floor(F.col("stream_end_frame") / bucket_frames))))
    a = anchors.withColumn("_hl_b", F.floor(F.col("anchor_stream_frame") / bucket_frames))
    inside = w.join(a, [*by, "_hl_b"]).where((F.col("anchor_stream_frame") > F.col("stream_start_frame")) & (F.col("anchor_stream_frame") <= F.col("stream_end_frame"))).drop("_hl_b")
    before = asof(windows, anchors, by, "stream_start_frame", "anchor_stream_frame", cols).where("anchor_stream_frame is not null")
    return inside.select(*windows.columns, *cols).unionByName(before.select(*windows.columns, *cols))


def covered(pieces: DataFrame, key: list[str], expected: Column) -> DataFrame:
    """Whether a window's pieces can be looked up in the cache (FL8): together the whole hop, revision above 0, and a name."""
    named = (F.trim("title") != "") | (F.trim("artist") != "")
    usable = F.bool_and((F.col("revision") > 0) & F.coalesce(named, F.lit(False))) & (F.sum(F.col("stream_end_frame") - F.col("stream_start_frame")) == expected)
    return pieces.groupBy(*key).agg(usable.alias("usable"))


def islands(pieces: DataFrame, key: list[str]) -> DataFrame:
    """pieces with ``island``: neighbours of one revision and duration whose track frames join are one (WN4)."""
    w = Window.partitionBy(*key).orderBy("stream_start_frame")
    same = F.col("revision").eqNullSafe(F.lag("revision").over(w)) & F.col("track_duration_frame").eqNullSafe(F.lag("track_duration_frame").over(w)) & F.col("track_start_frame").eqNullSafe(F.lag("track_end_frame").over(w)) & F.col("stream_start_frame").eqNullSafe(F.lag("stream_end_frame").over(w))
    return pieces.withColumn("_hl_new", (~same).cast("int")).withColumn("island", F.sum("_hl_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_hl_new")


def latest_names(pieces: DataFrame, group: list[str]) -> DataFrame:
    """Title, artist and album of each group's last piece that has a title or artist (AG19); null where none has."""
    named = (F.trim("title") != "") | (F.trim("artist") != "")
    last = F.max_by(F.struct("title", "artist", "album"), F.when(F.coalesce(named, F.lit(False)), F.col("stream_start_frame")))
    return pieces.groupBy(*group).agg(last.alias("_hl_n")).select(*group, "_hl_n.title", "_hl_n.artist", "_hl_n.album")


def revisions(progress: DataFrame, by: list[str], order: str) -> DataFrame:
    """progress (start_rtp, current_rtp, end_rtp, stream_frame) as anchors: the revision goes up when start or end changes (ST11, SF13)."""
    w = Window.partitionBy(*by).orderBy(order)
    new = ~(F.col("start_rtp").eqNullSafe(F.lag("start_rtp").over(w)) & F.col("end_rtp").eqNullSafe(F.lag("end_rtp").over(w)))
    marked = progress.withColumn("_hl_new", new.cast("int")).withColumn("revision", F.sum("_hl_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_hl_new")
    return marked.withColumn("has_progress", F.col("start_rtp") != F.col("end_rtp")).withColumn("track_position_frame", wrapped_difference(F.col("current_rtp"), F.col("start_rtp"))).withColumn("track_duration_frame", wrapped_difference(F.col("end_rtp"), F.col("start_rtp")))


def ordered_concat(parts: DataFrame, key: list[str], order: str, pcm: str = "pcm", frames: str = "frame_count", total: str | None = None, channels: int = 2) -> DataFrame:
    """The parts' samples one after the other; null where a part is missing or shorter than it says (SO4, SK7)."""
    whole = F.bool_and(F.coalesce(F.size(F.col(pcm)) == channels * F.col(frames), F.lit(False)))
    if total:
        whole = whole & (F.sum(frames) == F.max(total))
    sound = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(pcm).alias("_hl_pcm")))), lambda x: x["_hl_pcm"]))
    return parts.groupBy(*key).agg(F.when(whole, sound).alias(pcm), F.sum(frames).alias(frames))
