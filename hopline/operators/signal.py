"""Levels, mixes, crossfades, ramps and alignment of PCM blocks kept as arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopline.functions import rules
from hopline.functions.numeric import channel, pcm16

#: What counts as an alignment.
LEAST_CORRELATION, LEAST_GAIN, MOST_GAIN, MOST_MATCHES = 0.985, 0.90, 1.10, 64

#: The stems of each profile and the model's sources in them (D6, PJ5).
PROFILES = [
    (2, "vocals", 0, "vocals"), (2, "instrumental", 1, "drums"), (2, "instrumental", 1, "bass"), (2, "instrumental", 1, "guitar"), (2, "instrumental", 1, "piano"), (2, "instrumental", 1, "other"),
    (4, "vocals", 0, "vocals"), (4, "drums", 1, "drums"), (4, "bass", 2, "bass"), (4, "other", 3, "guitar"), (4, "other", 3, "piano"), (4, "other", 3, "other"),
    (6, "vocals", 0, "vocals"), (6, "drums", 1, "drums"), (6, "bass", 2, "bass"), (6, "guitar", 3, "guitar"), (6, "piano", 4, "piano"), (6, "other", 5, "other"),
]


def profiles(spark) -> DataFrame:
    return spark.createDataFrame(PROFILES, "profile_tracks int, stem string, stem_ordinal int, source string")


def levels(pcm: Column, bins: int) -> Column:
    """struct<peak_left, peak_right, rms_left, rms_right, waveform> of interleaved stereo samples (AG1). Empty: zeros."""
    size = lambda v: F.least(F.lit(1.0), F.abs(v.cast("double")) / 32768)
    left, right = (F.transform(channel(pcm, c), size) for c in (0, 1))
    frames = F.size(left)
    rms = lambda x: F.when(frames > 0, F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / frames)).otherwise(0.0)
    means = F.zip_with(left, right, lambda a, b: (a + b) / 2)
    first = lambda b: F.ceil(b * frames / bins).cast("int")  # noqa: E731  the first frame with floor(frame * bins / frames) = b
    bar = lambda b: F.coalesce(F.array_max(F.slice(means, first(b) + 1, F.greatest(F.lit(0), first(b + 1) - first(b)))), F.lit(0.0))
    wave = F.when(frames > 0, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), bar)).otherwise(F.array_repeat(F.lit(0.0), bins))
    peak = lambda x: F.coalesce(F.array_max(x), F.lit(0.0))
    return F.struct(peak(left).alias("peak_left"), peak(right).alias("peak_right"), rms(left).alias("rms_left"), rms(right).alias("rms_right"), wave.alias("waveform"))


def _sum_arrays(arrays: Column, zero_of: Column) -> Column:
    return F.aggregate(arrays, F.transform(zero_of, lambda v: F.lit(0.0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))


def saturating_mix(rows: DataFrame, by: list[str], pcm: str = "pcm") -> DataFrame:
    """by, pcm: the samples of a group's rows added up in place, then saturated (AG2). A group has a row for each source: few."""
    arrays = F.collect_list(F.transform(pcm, lambda v: v.cast("double")))
    summed = rows.groupBy(*by).agg(arrays.alias("_hl_a"))
    return summed.select(*by, F.transform(_sum_arrays(F.col("_hl_a"), F.col("_hl_a")[0]), pcm16).alias(pcm))


def gain_mix(rows: DataFrame, by: list[str], pcm: str = "pcm", gain: str = "gain") -> DataFrame:
    """The same with each row's samples times its gain; rounded half away from zero (AG3)."""
    g = F.col(gain).cast("double")
    return saturating_mix(rows.withColumn(pcm, F.transform(pcm, lambda v: v.cast("double") * g)), by, pcm)


def regrouped(sources: DataFrame, tracks: int, by: list[str]) -> DataFrame:
    """sources (by, source, pcm) as the stems of a profile (PJ5, AG2): a broadcast of the profile's few rows, then the mix."""
    profile = profiles(sources.sparkSession).where(F.col("profile_tracks") == tracks)
    return saturating_mix(sources.join(F.broadcast(profile), "source"), [*by, "stem", "stem_ordinal"])


def complete_groups(rows: DataFrame, by: list[str], stems: Column, frames: Column) -> DataFrame:
    """JN9: by, complete: each expected stem once, all of one length above 0."""
    names = F.array_sort(F.collect_list("stem"))
    return rows.groupBy(*by).agg(((names == F.array_sort(F.first(stems))) & (F.min(frames) == F.max(frames)) & (F.min(frames) > 0)).alias("complete"))


def stacked(stems: list[Column], channels: int = 2) -> Column:
    """The samples of several stems as more channels of one array, frame by frame, so that they are stitched and assembled together; null if their lengths differ (ST4, ST10)."""
    frames = (F.size(stems[0]) / channels).cast("int")
    whole = F.lit(True)
    for x in stems[1:]:
        whole = whole & (F.size(x) == F.size(stems[0]))
    each = F.transform(F.sequence(F.lit(0), frames - 1), lambda f: F.concat(*[F.slice(x, channels * f + 1, F.lit(channels)) for x in stems]))
    return F.when(whole, F.when(frames > 0, F.flatten(each)).otherwise(F.slice(stems[0], 1, 0)))


def unstacked(pcm: Column, stems: int, number: int, channels: int = 2) -> Column:
    """One stem of stacked() samples."""
    return F.filter(pcm, lambda v, i: F.floor(i / channels) % stems == number)


def crossfade(rows: DataFrame, by: list[str], sequence: str, hop: int, overlap: int, channels: int = 2) -> DataFrame:
    """rows with ``hop_pcm``: a hop of samples whose start fades from the previous row's tail to the row's own (WN2, ST10).

    Frame i of n fades with weight i / (n - 1), or 1/2 if n is 1. After a gap in the sequence, and on the first row, nothing fades.
    """
    w = Window.partitionBy(*by).orderBy(sequence)
    tail = F.slice("pcm", channels * hop + 1, channels * overlap)
    joins = F.lag(sequence).over(w) == F.col(sequence) - 1
    held = rows.withColumn("_hl_tail", F.when(joins, F.lag(tail).over(w)))
    head, rest = F.slice("pcm", 1, channels * overlap), F.slice("pcm", channels * overlap + 1, channels * (hop - overlap))
    weights = F.array(*[F.lit(0.5 if overlap == 1 else i / (overlap - 1)) for i in range(overlap) for _ in range(channels)])
    both = F.zip_with(F.zip_with("_hl_tail", head, lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))), weights, lambda x, t: pcm16(x["a"] + (x["b"] - x["a"]) * t))
    faded = F.when(F.col("_hl_tail").isNull(), F.slice("pcm", 1, channels * hop)).otherwise(F.concat(both, rest))
    return held.withColumn("hop_pcm", faded).drop("_hl_tail")


def ramp(current: Column, target: Column, frames: Column, frame: Column) -> Column:
    """The gain at a frame (from 0) after a change: a line over ``frames`` frames, whatever the blocks (WN8)."""
    done = F.least(F.lit(1.0), (frame + 1) / F.greatest(frames, F.lit(1)))
    return current + (target - current) * done


def ramped(pcm: Column, current: Column, target: Column, frames: Column, first_frame: Column, channels: int = 2) -> Column:
    """Samples times the ramp's gain, as PCM16."""
    return F.transform(pcm, lambda v, i: pcm16(v.cast("double") * ramp(current, target, frames, first_frame + F.floor(i / channels))))


def gain_changes(controls: DataFrame, by: list[str], at: str, gain: str, order: str, frames: int, initial: float = 1.0) -> DataFrame:
    """by, at, start_gain, target_gain: where each control finds the gain, also inside the ramp of the one before (WN8).

    ``at`` is the frame that a control precedes; of several at one frame the last by ``order`` counts (ties: the largest gain). Controls
    without a frame or with a gain outside [0, 1] change nothing. A gain depends on all controls before it, so a stream's are read
    in order, batch by batch, with the last one as state.
    """
    types = dict(controls.dtypes)
    valid = controls.where(F.col(at).isNotNull() & rules.valid_gain(F.col(gain)))
    last = valid.groupBy(*by, at).agg(F.max_by(F.col(gain).cast("double"), F.struct(F.col(order), F.col(gain))).alias("target_gain"))

    def follow(batches):
        key, place, start, target = None, 0, initial, initial
        for b in batches:
            starts = []
            for *k, a, t in zip(*[b.column(c).to_pylist() for c in (*by, at, "target_gain")]):
                if k != key:
                    key, start, target = k, initial, initial
                elif frames:
                    start += (target - start) * min(1.0, (a - place) / frames)
                else:
                    start = target
                place, target = a, t
                starts.append(start)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*by, at)], pa.array(starts, pa.float64()), b.column("target_gain")], [*by, at, "start_gain", "target_gain"])

    ddl = ", ".join(f"`{c}` {types[c]}" for c in (*by, at))
    return last.repartition(*by).sortWithinPartitions(*by, at).mapInArrow(follow, f"{ddl}, start_gain double, target_gain double")


def gained(blocks: DataFrame, changes: DataFrame, by: list[str], first_frame: str, at: str, frames: int, channels: int = 2, initial: float = 1.0) -> DataFrame:
    """blocks with ``pcm`` times the gains of ``changes`` (WN8), rounded and saturated; samples are not taken apart into rows.

    Blocks of a stream do not overlap; by and first_frame name a block, one without first_frame has no samples in the result. A block takes the last change before it and those inside it, found by one
    window over block places and changes; samples join with the result once.
    """
    place = blocks.where((F.size("pcm") > 0) & F.col(first_frame).isNotNull()).select(*by, F.col(first_frame).cast("long").alias("_hl_f"), F.lit(0).alias("_hl_kind"), (F.col(first_frame) + F.ceil(F.size("pcm") / channels)).cast("long").alias("_hl_end"))
    change = changes.select(*by, F.col(at).cast("long").alias("_hl_f"), F.lit(1).alias("_hl_kind"), F.struct(F.col(at).cast("long").alias("at"), "start_gain", "target_gain").alias("_hl_c"))
    w = Window.partitionBy(*by).orderBy("_hl_f", "_hl_kind")
    block = F.when(F.col("_hl_kind") == 0, F.struct(F.col("_hl_f").alias("first"), F.col("_hl_end").alias("end")))
    both = place.unionByName(change, allowMissingColumns=True).withColumns({"_hl_b": F.last(block, True).over(w), "_hl_before": F.last("_hl_c", True).over(w)})
    inside = both.where("_hl_kind = 0 or _hl_f < _hl_b.end").groupBy(*by, F.col("_hl_b.first").alias("_hl_first")).agg(
        F.max(F.when(F.col("_hl_kind") == 0, F.col("_hl_before"))).alias("_hl_before"), F.array_sort(F.collect_list("_hl_c")).alias("_hl_in"))
    inside = inside.select(*[F.col(c).alias(f"_hl_k{i}") for i, c in enumerate(by)], "_hl_first", "_hl_before", "_hl_in")
    found = [F.col(c).eqNullSafe(F.col(f"_hl_k{i}")) for i, c in enumerate(by)] + [F.col(first_frame).cast("long") == F.col("_hl_first")]
    first, n = F.col("_hl_first"), F.ceil(F.size("pcm") / channels).cast("long")
    none = F.struct(first.alias("at"), F.lit(initial).alias("start_gain"), F.lit(initial).alias("target_gain"))
    parts = F.concat(F.array(F.coalesce("_hl_before", none)), "_hl_in")
    until = lambda i: F.coalesce(F.get("_hl_in", i)["at"], first + n)
    gains = lambda c, i: F.when(F.greatest(c["at"], first) < until(i), F.transform(F.sequence(F.greatest(c["at"], first), until(i) - 1), lambda f: ramp(c["start_gain"], c["target_gain"], F.lit(frames), f - c["at"]))).otherwise(F.array().cast("array<double>"))
    joined = blocks.join(inside, found, "left").withColumn("_hl_g", F.flatten(F.transform(parts, gains)))
    louder = F.transform("pcm", lambda v, i: pcm16(v.cast("double") * F.get("_hl_g", F.floor(i / channels).cast("int"))))
    return joined.withColumn("pcm", F.when(F.col("_hl_g").isNotNull(), louder).when(F.size("pcm") == 0, F.col("pcm"))).select(*blocks.columns)


BLOCK = 64


def _smoothed(x: np.ndarray, c: float, start: float = 0.0) -> np.ndarray:
    """y += c * (x - y) from ``start``: blocks of 64 by one matrix of powers, and a step from block to block."""
    a = 1.0 - c
    powers = a ** np.arange(BLOCK + 1)
    lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)[None, :]
    response = np.where(lag >= 0, c * powers[np.maximum(lag, 0)], 0.0)
    padded = np.zeros(-(-len(x) // BLOCK) * BLOCK)
    padded[: len(x)] = x
    own = padded.reshape(-1, BLOCK) @ response.T
    heads = np.empty(len(own))
    y = start
    for i, last in enumerate(own[:, -1].tolist()):
        heads[i] = y
        y = last + powers[BLOCK] * y
    return (own + heads[:, None] * powers[None, 1:]).ravel()[: len(x)]


def one_pole(values: Column, coefficient: float) -> Column:
    """The low-pass y += c * (x - y) along an array, from 0 (WN9)."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else _smoothed(np.asarray(v, float), coefficient))

    return run(values)


def center_suppressed(blocks: DataFrame, by: str, order: str, sample_rate: int, strength: float, bass_hz: float) -> DataFrame:
    """by, order, pcm without the centre above ``bass_hz`` (WN9). The filter's state runs through a stream's blocks, which are read in order, batch by batch."""
    if sample_rate <= 0 or not 0 <= strength <= 1 or bass_hz <= 0:
        raise ValueError("sample_rate and bass_hz are above 0, strength is in [0, 1]")
    c = float(np.float32(1 - np.exp(-2 * np.pi * bass_hz / sample_rate)))

    def suppress(batches):
        low, current, first = 0.0, None, True
        for pdf in batches:
            out = []
            for key, pcm in zip(pdf[by], pdf["pcm"]):
                if first or key != current:
                    low, current, first = 0.0, key, False
                x = np.asarray(pcm, np.float32).reshape(-1, 2)
                centre = x.mean(1, dtype=np.float32)
                smooth = _smoothed(centre, c, low)
                low = float(smooth[-1]) if len(smooth) else low
                y = np.clip(x - np.float32(strength) * (centre - smooth.astype(np.float32))[:, None], -32768, 32767)
                out.append(y.astype(np.int16).ravel())
            yield pdf[[by, order]].assign(pcm=out)

    types = dict(blocks.dtypes)
    return blocks.select(by, order, "pcm").repartition(by).sortWithinPartitions(by, order).mapInPandas(suppress, f"{by} {types[by]}, {order} {types[order]}, pcm array<smallint>")


def envelope(values: Column, size: int) -> Column:
    """Means of absolute values over full blocks of an array (WN10)."""
    count = F.floor(F.size(values) / size).cast("int")
    mean = lambda b: F.aggregate(F.slice(values, b * size + 1, size), F.lit(0.0), lambda s, v: s + F.abs(v)) / size
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), mean)).otherwise(F.array().cast("array<double>"))


def _search(song: np.ndarray, probe: np.ndarray, approx: int, radius: int) -> tuple[int | None, float, float]:
    frames, n = len(song) // 2, len(probe) // 2
    low, high = max(0, approx - radius), min(frames - n, approx + radius)
    if n == 0 or high < low:
        return None, 0.0, 0.0
    raw, want = song.astype("<i2").tobytes(), probe.astype("<i2").tobytes()
    found, at = [], raw.find(want, 4 * low, 4 * (high + n))
    while at >= 0 and len(found) < MOST_MATCHES:
        if at % 4 == 0:
            found.append(at // 4)
        at = raw.find(want, at + 1, 4 * (high + n))
    if found:
        return min(found, key=lambda o: (abs(o - approx), o)), 1.0, 1.0
    p = probe.reshape(-1, 2).astype(float)
    side = int(np.argmax((p**2).sum(0)))
    x, s = p[:, side] - p[:, side].mean(), song.reshape(-1, 2)[low : high + n, side].astype(float)
    power = float(x @ x)
    if power <= 0:
        return None, 0.0, 0.0
    size = 1 << (len(s) + n - 1).bit_length()
    dot = np.fft.irfft(np.fft.rfft(s, size) * np.conj(np.fft.rfft(x, size)), size)[: len(s) - n + 1]
    sums, squares = np.cumsum(np.concatenate(([0.0], s))), np.cumsum(np.concatenate(([0.0], s * s)))
    spread = squares[n:] - squares[:-n] - (sums[n:] - sums[:-n]) ** 2 / n
    corr = dot / np.sqrt(np.maximum(spread, 1e-9) * power)
    gain = dot / np.maximum(spread, 1e-9)  # probe against song
    fine = np.flatnonzero((corr >= LEAST_CORRELATION) & (gain >= LEAST_GAIN) & (gain <= MOST_GAIN))
    if not len(fine):
        return None, float(corr.max()), 0.0
    best = min(fine.tolist(), key=lambda o: (-round(corr[o], 9), abs(low + o - approx), o))
    return low + best, float(corr[best]), float(gain[best])


@F.pandas_udf(T.StructType([T.StructField("offset", T.LongType()), T.StructField("correlation", T.DoubleType()), T.StructField("gain", T.DoubleType())]))
def align(song: pd.Series, probe: pd.Series, approx: pd.Series, radius: pd.Series) -> pd.DataFrame:
    """Where the probe's stereo samples lie in the song's, in frames near ``approx``, or null (JN5, WN11, TK4).

    An exact match wins, the nearest to ``approx``, then the smaller. Otherwise the probe's louder channel is correlated with every
    place within the radius (by FFT), and the best with a correlation of at least 0.985 and a gain in [0.90, 1.10] is taken. Use it
    after a join on metadata, so that only candidates are scored.
    """
    out = [_search(np.asarray(s, np.int16), np.asarray(p, np.int16), int(a), int(r)) for s, p, a, r in zip(song, probe, approx, radius)]
    return pd.DataFrame(out, columns=["offset", "correlation", "gain"]).astype({"offset": "Int64"})


def correlation(a: Column, b: Column) -> tuple[Column, Column]:
    """(Pearson correlation, slope of a on b) of two arrays, in the JVM (WN11)."""
    n = F.size(a).cast("double")
    total = lambda f: F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    sa, sb, sab, saa, sbb = total(lambda x, y: x), total(lambda x, y: y), total(lambda x, y: x * y), total(lambda x, y: x * x), total(lambda x, y: y * y)
    cov, va, vb = sab - sa * sb / n, saa - sa * sa / n, sbb - sb * sb / n
    return F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)), F.when(vb > 0, cov / vb)
