"""Timed text: lookup cascade, candidates, the current line and its neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopline.functions.text import casefolded, lyric_lines
from hopline.operators.cache import best_candidate
from hopline.operators.framing import neighbours
from hopline.operators.timeline import asof


def parsed(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, time_seconds, text of LRC documents (SF2)."""
    return documents.select(key, F.posexplode(lyric_lines(F.col(text))).alias("line_no", "x")).select(key, "line_no", "x.*")


def current(positions: DataFrame, lines: DataFrame, key: str, position: str, context: int = 2) -> DataFrame:
    """positions with current, previous and upcoming lines (JN6, WN7).

    The current line is the last at or before the position. Before the first line it is null and upcoming has the first lines.
    """
    before, after = neighbours("text", [key], "line_no", context)
    w = Window.partitionBy(key).orderBy("line_no")
    rich = lines.withColumn("previous", before).withColumn("upcoming", after).withColumnRenamed("text", "current")
    head = lines.withColumn("_hl_n", F.row_number().over(w)).where(F.col("_hl_n") <= context).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("_hl_head"))
    found = asof(positions.withColumn(position, F.greatest(F.lit(0.0), F.col(position))), rich, [key], position, "time_seconds", ["line_no", "current", "previous", "upcoming"])
    none = F.array().cast("array<string>")
    out = found.join(head, key, "left").withColumn("upcoming", F.when(F.col("current").isNull(), F.coalesce("_hl_head", none)).otherwise(F.col("upcoming")))
    return out.withColumn("previous", F.coalesce("previous", none)).drop("_hl_head", "line_no")


def guarded(tracks: DataFrame, lyrics: DataFrame) -> DataFrame:
    """tracks with lyrics only where revision (above 0), title and artist agree, outer spaces and case aside (JN7)."""
    l = lyrics.where("revision > 0").select(F.col("revision").alias("_hl_revision"), casefolded(F.trim("title")).alias("_hl_title"), casefolded(F.trim("artist")).alias("_hl_artist"), "lyrics")
    t = tracks.withColumns({"_hl_t": casefolded(F.trim("title")), "_hl_a": casefolded(F.trim("artist"))})
    same = (F.col("revision") == F.col("_hl_revision")) & (F.col("_hl_t") == F.col("_hl_title")) & (F.col("_hl_a") == F.col("_hl_artist"))
    return t.join(l, same, "left").select(*tracks.columns, "lyrics")


def candidates(tracks: DataFrame, results: DataFrame, tolerance: float = 5.0, most: int = 1000) -> DataFrame:
    """The best search result for each track (JN8): equal title and artist, duration within ``tolerance``, usable; equal album first, then the nearest duration, then the result's place. Only the first ``most`` results of a search count, as the service gives no more."""
    r = results.where(F.col("place") < most).select("title", "artist", F.col("album").alias("r_album"), F.col("duration_seconds").alias("r_duration"), "place", "lyrics", "instrumental")
    near = F.abs(F.col("duration_seconds") - F.col("r_duration"))
    usable = F.coalesce(F.col("instrumental"), F.lit(False)) | (F.size(F.coalesce(lyric_lines(F.col("lyrics")), F.array().cast("array<struct<time_seconds:double,text:string>>"))) > 0)
    j = tracks.join(r, ["title", "artist"]).where((near <= tolerance) & usable)
    return best_candidate(j, ["track_key"], [~F.coalesce(F.col("album") == F.col("r_album"), F.lit(False)), near, "place"])


def cascade(tracks: DataFrame, sources: list[DataFrame], key: str = "track_key") -> DataFrame:
    """tracks with lyrics and origin from the first source that has them, in order (SC11, SC12)."""
    out, found, origin = tracks, [], []
    for i, s in enumerate(sources):
        out = out.join(s.select(key, F.col("lyrics").alias(f"_hl_{i}")), key, "left")
        found.append(F.col(f"_hl_{i}"))
        origin.append(F.when(F.col(f"_hl_{i}").isNotNull(), F.lit(i)))
    return out.select(*tracks.columns, F.coalesce(*found).alias("lyrics"), F.coalesce(*origin).alias("origin"))


def checked(cached: DataFrame, tracks: DataFrame, key: str = "track_key") -> DataFrame:
    """Cached lyrics whose stored identity is that of the track they are filed under (SC12)."""
    return cached.join(tracks.select(key, F.col("identity").alias("_hl_i")), key).where(F.col("identity") == F.col("_hl_i")).drop("_hl_i")


def first_found(*columns: Column) -> Column:
    """The first that is not empty (AG18)."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])
