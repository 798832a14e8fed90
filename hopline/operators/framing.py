"""Windows over a frame clock: complete sliding windows, gaps, blocks, packets, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_numbers(frame: Column, size: int, hop: int) -> Column:
    """The numbers of all windows [k * hop, k * hop + size) that hold the frame (WN1)."""
    first = F.greatest(F.lit(0), F.ceil((frame - size + 1) / hop)).cast("long")
    return F.sequence(first, F.floor(frame / hop).cast("long"))


def sliding_windows(rows: DataFrame, by: list[str], frame: str, size: int, hop: int, aggs: list[Column], first_sequence: int = 0) -> DataFrame:
    """``aggs`` over each complete window of ``size`` frames, a row a frame; partial windows are dropped (WN1).

    A row goes to its size / hop windows, and rows are aggregated on the map side by (by, window) before the shuffle.
    """
    each = rows.withColumn("window_no", F.explode(window_numbers(F.col(frame), size, hop)))
    out = each.groupBy(*by, "window_no").agg(F.count("*").alias("_hl_n"), F.min(frame).alias("start_frame"), F.max(frame).alias("_hl_last"), *aggs)
    full = (F.col("_hl_n") == size) & (F.col("_hl_last") - F.col("start_frame") + 1 == size)
    return out.where(full).drop("_hl_n", "_hl_last").withColumn("sequence", F.col("window_no") + first_sequence).drop("window_no")


def sliding_time_windows(rows: DataFrame, by: list[str], at: str, size_s: int, hop_s: int, aggs: list[Column]) -> DataFrame:
    """The same over event time in seconds from each group's first row; a window counts if the group goes on past its end."""
    group = Window.partitionBy(*by)
    second = F.unix_micros(F.col(at)) / 1_000_000
    timed = rows.withColumn("_hl_first", F.min(at).over(group)).withColumn("_hl_end", F.max(at).over(group))
    origin = F.unix_micros("_hl_first") / 1_000_000
    timed = timed.withColumn("_hl_s", F.floor(second - origin).cast("long")).withColumn("_hl_end", F.unix_micros("_hl_end") / 1_000_000 - origin)
    each = timed.withColumn("window_no", F.explode(window_numbers(F.col("_hl_s"), size_s, hop_s)))
    return each.where(F.col("window_no") * hop_s + size_s <= F.col("_hl_end")).groupBy(*by, "window_no").agg(*aggs)


def block_windows(blocks: DataFrame, size: int, hop: int, channels: int = 2) -> DataFrame:
    """Complete windows out of PCM blocks (stream_id, start_frame, pcm): stream_id, sequence, stream_start_frame, pcm (WN1).

    A block is cut once for each window that it meets; nothing is exploded to samples.
    """
    n = F.size("pcm") / channels
    last = F.col("start_frame") + n - 1
    k = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("start_frame") - size + 1) / hop)).cast("long"), F.floor(last / hop).cast("long"))
    cut = blocks.withColumn("k", F.explode(k)).withColumn("a", F.greatest("start_frame", F.col("k") * hop)).withColumn("b", F.least(last + 1, F.col("k") * hop + size)).where("b > a")
    part = F.slice("pcm", (channels * (F.col("a") - F.col("start_frame")) + 1).cast("int"), (channels * (F.col("b") - F.col("a"))).cast("int"))
    parts = cut.groupBy("stream_id", "k").agg(F.array_sort(F.collect_list(F.struct("a", part.alias("pcm")))).alias("parts"), F.sum(F.col("b") - F.col("a")).alias("n"))
    pcm = F.flatten(F.transform("parts", lambda x: x["pcm"]))
    return parts.where(F.col("n") == size).select("stream_id", F.col("k").alias("sequence"), (F.col("k") * hop).alias("stream_start_frame"), pcm.alias("pcm"))


def epochs(rows: DataFrame, by: list[str], order: str, broken: Column) -> DataFrame:
    """rows with ``epoch``: how often ``broken`` held so far, within a group in order (WN3, WN4, ST3). ``broken`` may use lag()."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = rows.withColumn("_hl_break", F.coalesce(broken, F.lit(False)).cast("int"))
    return marked.withColumn("epoch", F.sum("_hl_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_hl_break")


def gap(order: str, by: list[str], step: int = 1) -> Column:
    """A row does not follow its predecessor by ``step`` (WN3)."""
    return F.col(order) != F.lag(order).over(Window.partitionBy(*by).orderBy(order)) + step


def regressed(value: str, by: list[str], order: str) -> Column:
    """A value lies below its predecessor's (ST3)."""
    return F.col(value) < F.lag(value).over(Window.partitionBy(*by).orderBy(order))


def changed(value: str, by: list[str], order: str) -> Column:
    """A value is distinct from its predecessor's; the first row counts as changed (WN12, SK12)."""
    w = Window.partitionBy(*by).orderBy(order)
    return F.row_number().over(w).eqNullSafe(1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))


def blocks(rows: DataFrame, by: list[str], frame: str, size: int, aggs: list[Column]) -> DataFrame:
    """``aggs`` over each full block of ``size`` frames; what is left over is dropped (WN10)."""
    out = rows.withColumn("block", F.floor(F.col(frame) / size)).groupBy(*by, "block").agg(F.count("*").alias("_hl_n"), *aggs)
    return out.where(F.col("_hl_n") == size).drop("_hl_n")


def packets(rows: DataFrame, frames: Column, most: int) -> DataFrame:
    """A row for each packet of at most ``most`` frames: packet_no, frame_offset, frame_count (ST13). Offsets go on over packets that are rejected later."""
    n = F.ceil(frames / most).cast("int")
    each = rows.withColumn("packet_no", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    offset = F.col("packet_no").cast("long") * most
    return each.withColumn("frame_offset", offset).withColumn("frame_count", F.least(F.lit(most), frames - offset).cast("long"))


def running_packets(rows: DataFrame, by: list[str], order: str, frames: str, most: int) -> DataFrame:
    """packets() with the packet's sequence and presentation frame over all of a session's blocks (ST13)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("_hl_p", F.ceil(F.col(frames) / most)).withColumn("first_packet", F.coalesce(F.sum("_hl_p").over(w), F.lit(0))).withColumn("first_frame", F.coalesce(F.sum(frames).over(w), F.lit(0))).drop("_hl_p")
    out = packets(counted, F.col(frames), most)
    return out.withColumn("packet_sequence", F.pmod(F.col("first_packet") + F.col("packet_no"), F.lit(1 << 32)).cast("long")).withColumn("presentation_frame", F.col("first_frame") + F.col("frame_offset"))


def neighbours(value: str, by: list[str], order: str, n: int = 2) -> tuple[Column, Column]:
    """(values of the n rows before, of the n rows after) (WN7)."""
    w = Window.partitionBy(*by).orderBy(order)
    return F.collect_list(value).over(w.rowsBetween(-n, -1)), F.collect_list(value).over(w.rowsBetween(1, n))


def played_sequence(initial: Column, frames_read: Column, hop: int) -> Column:
    """WN13: the window that a playback position belongs to; null before the first frame."""
    return F.when(frames_read > 0, initial + F.floor((frames_read - 1) / hop))


def ring_audio(steps: DataFrame, pushes: DataFrame, by: list[str], stems: list[str], bucket_frames: int, channels: int = 2) -> DataFrame:
    """by, frame, stem, result, pcm of each pop of a buffer: sound where it was given, else silence (ST8).

    steps are what machines.Ring puts out, pushes (by, frame, stem, pcm) what was offered. Accepted pushes and pops are intervals of one
    frame clock, so a pop's sound is cut from the pushes that it meets: an equi join on buckets of that clock.
    """
    slots = lambda a, b: F.explode(F.sequence(F.floor(a / bucket_frames), F.floor((b - 1) / bucket_frames))).alias("_hl_b")
    taken = steps.where("op = 'push' and result = 'accepted'").select(*by, "frame", (F.col("total_written") - F.col("frames")).alias("_hl_a"), F.col("total_written").alias("_hl_e"))
    blocks = taken.join(pushes, [*by, "frame"]).select(*by, "stem", "_hl_a", "_hl_e", "pcm", slots(F.col("_hl_a"), F.col("_hl_e")))
    pops = steps.where("op = 'pop' and result <> 'refused'").select(*by, "frame", "result", "frames", (F.col("total_read") - F.col("frames")).alias("_hl_low"), F.col("total_read").alias("_hl_high"))
    asked = pops.where("result = 'audio'").select(*by, "frame", "_hl_low", "_hl_high", slots(F.col("_hl_low"), F.col("_hl_high")))
    low, high = F.greatest("_hl_a", "_hl_low"), F.least("_hl_e", "_hl_high")
    met = asked.join(blocks, [*by, "_hl_b"]).where((high > low) & (F.floor(low / bucket_frames) == F.col("_hl_b")))  # each pair once
    part = F.slice("pcm", (channels * (low - F.col("_hl_a")) + 1).cast("int"), (channels * (high - low)).cast("int"))
    sound = met.groupBy(*by, "frame", "stem").agg(F.array_sort(F.collect_list(F.struct(low.alias("at"), part.alias("pcm")))).alias("parts"))
    sound = sound.select(*by, "frame", "stem", F.flatten(F.transform("parts", lambda x: x["pcm"])).alias("_hl_pcm"))
    every = pops.withColumn("stem", F.explode(F.array(*[F.lit(x) for x in stems])))
    silence = F.array_repeat(F.lit(0).cast("smallint"), (channels * F.col("frames")).cast("int"))
    return every.join(sound, [*by, "frame", "stem"], "left").select(*by, "frame", "stem", "result", F.coalesce("_hl_pcm", silence).alias("pcm"))
