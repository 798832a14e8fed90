"""From chunks to complete cache entries, results with their manifests, and counters of what was sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopline.functions.identity import composite_key
from hopline.operators.cache import upserted


def stored(entries: DataFrame, chunks: DataFrame, by: list[str], index: str, order: str) -> DataFrame:
    """Chunks of entries in building, with the new ones; the latest of an index counts, and complete entries take none (SK19, SO5).

    entries: by, state. chunks: by, index, order and what they hold.
    """
    complete = entries.where("state = 'complete'").select(*by)
    return upserted(chunks.join(complete, by, "left_anti"), by, index, order)


def finalized(entries: DataFrame, chunks: DataFrame, by: list[str], index: str, stems: str, expected: Column) -> DataFrame:
    """by, state: complete where a building entry's chunks are dense and each has all its stems, else building (SK19, SO6, FL14)."""
    n = F.count("*")
    full = F.bool_and((F.size(F.array_except(expected, F.col(stems))) == 0) & (F.size(F.array_except(F.col(stems), expected)) == 0))
    ready = chunks.groupBy(*by).agg(((F.min(index) == 0) & (F.max(index) == n - 1) & (F.count_distinct(index) == n) & full).alias("_hl_ready"))
    state = F.when(F.col("state") == "complete", "complete").when(F.coalesce("_hl_ready", F.lit(False)), "complete").otherwise(F.col("state"))
    return entries.join(ready, by, "left").withColumn("state", state).drop("_hl_ready")


def manifests(stems: DataFrame, by: list[str], **constants: Column) -> DataFrame:
    """One manifest for each result: version 2, its stems as a map from name to file, and ``constants`` (SK4, D7)."""
    names = F.map_from_entries(F.array_sort(F.collect_list(F.struct("stem", "filename"))))
    return stems.groupBy(*by).agg(names.alias("stems")).select(F.lit(2).alias("version"), *by, *[c.alias(k) for k, c in constants.items()], "stems")


def composites(parts: DataFrame, key: list[str], expected_frames: Column, profile: str = "profile") -> DataFrame:
    """Results cut from several songs: their parts in order, all of one profile and together as long as they must be (SK7)."""
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "cache_key", "cached_start_frame", "frame_count")))
    out = parts.groupBy(*key).agg(listed.alias("cache_parts"), F.sum("frame_count").alias("frames"), F.min(profile).alias("_hl_a"), F.max(profile).alias("_hl_b"))
    sound = out.where((F.col("_hl_a") == F.col("_hl_b")) & (F.col("frames") == expected_frames)).drop("_hl_a", "_hl_b")
    return sound.withColumn("cache_key", composite_key(F.transform("cache_parts", lambda p: F.struct(p["cache_key"], p["cached_start_frame"], p["frame_count"])))).withColumn("cache_part_count", F.size("cache_parts"))


def send_counters(packets: DataFrame, by: list[str]) -> DataFrame:
    """Enqueued, dropped, sent and failed packets with their frames and bytes (AG15). packets: by, state, frame_count, bytes."""
    of = lambda s, c: F.coalesce(F.sum(F.when(F.col("state") == s, F.col(c))), F.lit(0))
    return packets.groupBy(*by).agg(
        F.count_if(F.col("state") != "dropped").alias("enqueued_packets"), F.count_if(F.col("state") == "dropped").alias("dropped_packets"), of("dropped", "frame_count").alias("dropped_frames"),
        F.count_if(F.col("state") == "sent").alias("sent_packets"), of("sent", "bytes").alias("sent_bytes"), F.count_if(F.col("state") == "failed").alias("send_errors"))


def loudest(rows: DataFrame, by: list[str], energy: str, place: str) -> DataFrame:
    """The place of greatest energy in each group, the first of equal ones (AG17)."""
    return rows.groupBy(*by).agg(F.max_by(place, F.struct(energy, -F.col(place))).alias(place), F.max(energy).alias(energy))


def increasing_ids(rows: DataFrame, by: list[str], order: str, now: str) -> DataFrame:
    """rows with ``id``: the time, or one more than the id before, whichever is larger (SF25, SK9, SK10).

    The recurrence id = max(now, previous + 1) has a closed form: the running maximum of now less the row's place, plus that place.
    """
    w = Window.partitionBy(*by).orderBy(order)
    place = F.row_number().over(w)
    ranked = rows.withColumn("_hl_p", place)
    return ranked.withColumn("id", F.max(F.col(now) - F.col("_hl_p")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_hl_p")).drop("_hl_p")
