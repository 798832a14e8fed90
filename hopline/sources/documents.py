"""Sidecars, manifests, mixer files and file listings as tables, strictly or leniently read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopline.functions.rules import ARTIFACT, AUDIO_TYPES, CAPTURE, sequence_of, valid_gain
from hopline.functions.text import is_ascii
from hopline.schemas import ANNOTATION, RESULT_MANIFEST, schema

#: The most anchors of a sidecar, and the stems.
MOST_ANCHORS = 4096
STEMS = ("vocals", "instrumental", "drums", "bass", "guitar", "piano", "other")


def annotations(rows: DataFrame, text: str = "value", expected: dict[str, Column] | None = None) -> DataFrame:
    """rows with annotation and valid (SC6): parsed sidecar JSON, null and false where a rule is broken.

    Rules: all fields are there and of their types, at most 4096 anchors in order of frame within the window's end, positions and
    durations not below 0, and what the caller expects of sequence and sample rate.
    """
    a = F.from_json(text, schema(ANNOTATION))
    w = rows.withColumn("_hl_a", a)
    x = F.col("_hl_a")
    anchors = x["anchors"]
    at = F.transform(anchors, lambda r: r["anchor_stream_frame"])
    ordered = F.coalesce(F.forall(F.zip_with(F.slice(at, 1, F.greatest(F.lit(0), F.size(at) - 1)), F.slice(at, 2, F.greatest(F.lit(0), F.size(at) - 1)), lambda p, q: p <= q), lambda t: t), F.lit(True))
    fields = F.forall(anchors, lambda r: (r["revision"] >= 0) & (r["track_position_frame"] >= 0) & (r["track_duration_frame"] >= 0) & (r["anchor_stream_frame"] <= x["stream_end_frame"]) & r["has_progress"].isNotNull() & r["title"].isNotNull() & r["start_rtp"].between(0, (1 << 32) - 1) & r["end_rtp"].between(0, (1 << 32) - 1))
    typed = F.get_json_object(text, "$.sequence").rlike(r"^\d+$") & F.get_json_object(text, "$.sample_rate").rlike(r"^\d+$") & F.get_json_object(text, "$.version").rlike(r"^\d+$")
    fine = typed & (x["version"] == 1) & (x["sequence"] >= 0) & (x["sample_rate"] > 0) & (x["stream_start_frame"] >= 0) & (x["stream_end_frame"] > x["stream_start_frame"]) & (F.size(anchors) <= MOST_ANCHORS) & fields & ordered
    for name, value in (expected or {}).items():
        fine = fine & (x[name] == value)
    valid = F.coalesce(fine, F.lit(False))
    return w.withColumn("valid", valid).withColumn("annotation", F.when(F.col("valid"), F.col("_hl_a"))).drop("_hl_a")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Result manifests, one JSON document in a file, all six shapes in one wide schema (D7, SC7)."""
    return spark.read.schema(schema(RESULT_MANIFEST)).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)


def mixer_gains(rows: DataFrame, text: str = "value") -> DataFrame:
    """rows with sequence, gains (map) and valid of a mixer control file (SC9).

    Its lines are tab-separated: a header ``version 1``, one ``sequence n``, then ``gain stem value`` for each of one or more known
    stems, none twice, each in [0, 1].
    """
    lines = F.filter(F.split(F.regexp_replace(text, "\r", ""), "\n"), lambda x: x != "")
    fields = F.transform(F.slice(lines, 2, 64), lambda x: F.split(x, "\t"))
    sequences = F.filter(fields, lambda f: (F.get(f, 0) == "sequence") & (F.size(f) == 2) & F.get(f, 1).rlike(r"^\d{1,18}$"))
    gains = F.filter(fields, lambda f: (F.get(f, 0) == "gain") & (F.size(f) == 3))
    names = F.transform(gains, lambda f: F.get(f, 1))
    values = F.transform(gains, lambda f: F.get(f, 2).try_cast("float"))
    fine = (F.get(lines, 0) == "version\t1") & (F.size(sequences) == 1) & (F.size(gains) >= 1) & (F.size(sequences) + F.size(gains) == F.size(lines) - 1)
    fine = fine & (F.size(F.array_distinct(names)) == F.size(names)) & (F.size(F.array_except(names, F.array(*[F.lit(s) for s in STEMS]))) == 0) & F.forall(values, valid_gain)
    valid = F.coalesce(fine, F.lit(False))
    out = rows.withColumn("valid", valid)
    return out.withColumn("sequence", F.when(F.col("valid"), F.get(F.get(sequences, 0), 1).try_cast("long"))).withColumn("gains", F.when(F.col("valid"), F.map_from_arrays(names, values)))


def mixer_file(sequence: Column, gains: Column) -> Column:
    """The text that mixer_gains() reads (SK9)."""
    lines = F.transform(F.array_sort(F.map_entries(gains)), lambda e: F.concat(F.lit("gain\t"), e["key"], F.lit("\t"), e["value"].cast("string")))
    return F.concat(F.lit("version\t1\nsequence\t"), sequence.cast("string"), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))


def ready_captures(listing: DataFrame, after: Column, most: int | None = None, name: str = "name") -> DataFrame:
    """Files of captured windows above a sequence, in order, the first ``most`` (SC3, TK1)."""
    out = listing.withColumn("sequence", sequence_of(F.col(name), CAPTURE)).where(F.col("sequence") > after).orderBy("sequence")
    return out.limit(most) if most else out


def next_sequence(listing: DataFrame, name: str = "name") -> DataFrame:
    """One more than the highest sequence of any capture or result, 1 at first (SC20)."""
    return listing.agg((F.coalesce(F.max(sequence_of(F.col(name), ARTIFACT)), F.lit(0)) + 1).alias("next_sequence"))


def accepted_inputs(listing: DataFrame, name: str = "name") -> DataFrame:
    """Files of the audio types that can be taken (SC19)."""
    return listing.where(F.lower(F.regexp_extract(name, r"\.([^.\\/]+)$", 1)).isin(*AUDIO_TYPES))


def commands(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Commands that take effect (SC10): above all before, and a start only once its capture session is there."""
    from hopline.operators.telemetry import newest

    fresh = newest(rows, ["stream"], "sequence")
    marked = fresh.join(sessions.select("stream", "sequence", F.lit(True).alias("_hl_in")), ["stream", "sequence"], "left")
    return marked.where((F.col("action") != "start") | F.col("_hl_in")).drop("_hl_in")


def cheap_names(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose name is ASCII, the others): only the others need the folding function (SF1)."""
    plain = F.coalesce(is_ascii(F.col(column)), F.lit(True))
    return rows.where(plain), rows.where(~plain)
