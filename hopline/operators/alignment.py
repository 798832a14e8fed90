"""Where a probe lies in a song, from coarse to fine (JN5, WN11): envelopes choose places, samples are read at those places alone.

Songs are tables of blocks of one channel's samples; their envelopes (means of ``block`` absolute values) are an index that is smaller by
``block``. A probe meets the stretch of the index around where it is expected; only the places with the highest correlation of envelopes
are looked at in samples, around the probe's segment of most energy. Every step is an equi join on block numbers, so a song may
have any length and no task holds more than one probe's stretches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopline.operators.signal import LEAST_CORRELATION, LEAST_GAIN, MOST_GAIN, envelope
from hopline.storage import written


def _side(pcm: str, c: int) -> Column:
    return F.filter(pcm, lambda _, i: i % 2 == c)


def channels(blocks: DataFrame, pcm: str = "pcm") -> DataFrame:
    """blocks (song, block, interleaved stereo ``pcm``) as song, channel, block, values."""
    each = F.array(*[F.struct(F.lit(c).alias("channel"), _side(pcm, c).alias("values")) for c in (0, 1)])
    return blocks.select("song", "block", F.explode(each).alias("x")).select("song", "x.channel", "block", "x.values")


def indexed(track: DataFrame, block: int) -> DataFrame:
    """The envelope of each of the track's blocks, whose length is a multiple of ``block``; the last one of a song may be shorter (its remainder is dropped)."""
    return track.select("song", "channel", "block", envelope(F.col("values"), block).alias("values"))


def excerpts(track: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``wanted`` (id, song, channel, start from 0, count) with ``found``: those values of the track, whose blocks hold ``size`` values each."""
    of = wanted.select("id", "song", "channel", "start", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("count") - 1) / size))).alias("block"))
    parts = of.join(track, ["song", "channel", "block"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("block", "values"))).alias("parts"))
    whole = F.flatten(F.transform("parts", lambda x: x["values"]))
    joined = wanted.join(parts, "id")
    return joined.withColumn("found", F.slice(whole, (F.pmod("start", F.lit(size)) + 1).cast("int"), F.col("count").cast("int"))).drop("parts")


def _correlations(long: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Pearson correlation, slope of short on long) of short with each place of long; -1 and 0 where a place is constant."""
    n = len(short)
    places = np.lib.stride_tricks.sliding_window_view(long, n)
    x = short - short.mean()
    centred = places - places.mean(1, keepdims=True)
    power, dot = (centred * centred).sum(1), centred @ x
    some = power > 0
    safe = np.where(some, power, 1.0)
    return np.where(some, dot / np.sqrt(safe * (x @ x)), -1.0), np.where(some, dot / safe, 0.0)


def _best(places: int, block: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def best(song: pd.Series, probe: pd.Series, first: pd.Series, approx: pd.Series) -> pd.Series:
        out = []
        for s, p, f, a in zip(song, probe, first, approx):
            s, p = np.asarray(s, float), np.asarray(p, float)
            if len(p) == 0 or len(s) < len(p) or p.std() == 0:
                out.append([])
                continue
            c, at = _correlations(s, p)[0], (f + np.arange(len(s) - len(p) + 1)) * block
            order = np.lexsort((at, np.abs(at - a), -c))
            out.append(at[order[:places]].tolist())
        return pd.Series(out)

    return best


@F.pandas_udf(T.StructType([T.StructField("shift", T.LongType()), T.StructField("correlation", T.DoubleType()), T.StructField("gain", T.DoubleType())]))
def _finest(song: pd.Series, probe: pd.Series, first: pd.Series, approx: pd.Series, stride: pd.Series) -> pd.DataFrame:
    out = []
    for s, p, f, a, step in zip(song, probe, first, approx, stride):
        s, p = np.asarray(s, float), np.asarray(p, float)
        if len(s) < len(p) or p[::step].std() == 0:
            out.append((None, None, None))
            continue
        n = len(s) - len(p) + 1
        if step == 1:
            c, g = _correlations(s, p)
        else:  # every step-th sample of the segment, at each place
            c, g = (np.array(x) for x in zip(*[[y[0] for y in _correlations(s[i : i + len(p) : step], p[::step])] for i in range(n)]))
        i = int(np.lexsort((np.arange(n), np.abs(f + np.arange(n) - a), -c))[0])
        out.append((i, float(c[i]), float(g[i])))
    return pd.DataFrame(out, columns=["shift", "correlation", "gain"]).astype({"shift": "Int64"})


def _prepared(block: int, fine: int):
    """n, channel (the louder one), its envelope, and its segment of most energy with where that starts."""
    kind = T.StructType([T.StructField(c, t) for c, t in (("n", T.LongType()), ("channel", T.IntegerType()), ("own", T.ArrayType(T.DoubleType())), ("segment", T.LongType()), ("loudest", T.ArrayType(T.IntegerType())))])

    @F.pandas_udf(kind)
    def prepare(pcm: pd.Series) -> pd.DataFrame:
        out = []
        for x in pcm:
            both = np.asarray([] if x is None else x, np.int64)
            both = both[: len(both) // 2 * 2].reshape(-1, 2)
            n, m = len(both), min(len(both), fine)
            side = int(np.argmax((both[:: max(1, n // 4096)] ** 2).sum(0))) if n else 0
            x = both[:, side]
            starts = [*range(0, n - m + 1, m), n - m] if m else [0]
            at = max(starts, key=lambda s: (x[s : s + m] ** 2).sum())
            out.append((n, side, np.abs(x[: n // block * block]).reshape(-1, block).mean(1), at, x[at : at + m].astype(np.int32)))
        return pd.DataFrame(out, columns=[f.name for f in kind])

    return prepare


def aligned(track: DataFrame, probes: DataFrame, size: int, radius: int, block: int = 256, fine: int = 11_025, places: int = 1, stride: int = 1) -> DataFrame:
    """id, offset (null if nothing fits), correlation, gain, read (samples of songs that were scored) for each of the probes (id, song, interleaved stereo pcm, approx).

    ``track`` comes from channels(), with ``size`` frames in a block, a multiple of ``block``. The probe's louder channel is searched within
    ``radius`` frames of ``approx``: its envelope against the song's at whole blocks, then, 2 blocks (8 frames at least) to either side of the
    ``places`` best, its segment of ``fine`` frames with most energy, frame by frame. The best correlation must reach 0.985 with a gain in
    [0.90, 1.10]; ties go to the place nearest to ``approx``. Probes of under 8 frames or without sound, and those of songs that are
    not in the track, fit nowhere. Envelopes lie on the song's own grid of blocks.
    """
    prepared = probes.select("id", "song", "approx", _prepared(block, fine)("pcm").alias("x")).select("id", "song", "approx", "x.*")
    p = written(prepared, "probes")
    last = track.where("channel = 0").groupBy("song").agg(F.max(F.struct("block", F.size("values").alias("n"))).alias("last")).select("song", (F.col("last.block") * size + F.col("last.n")).alias("frames"))
    p = p.join(last, "song").withColumns({"low": F.greatest(F.lit(0), F.col("approx") - radius), "high": F.least(F.col("frames") - F.col("n"), F.col("approx") + radius)})
    p = p.where("n >= 8 and low <= high")
    # coarse: envelopes (single frames where a probe has fewer than two blocks are left to exact search)
    e = p.select("id", "song", "channel", "approx", "own", F.floor(F.col("low") / block).alias("start"), F.floor(F.col("high") / block).alias("end"))
    e = e.select("*", (F.col("end") - F.col("start") + F.size("own")).alias("count")).where("size(own) >= 2")
    rough = excerpts(indexed(track, block), e, size // block)
    best = rough.select("id", F.explode(_best(places, block)("found", "own", "start", "approx")).alias("place"))
    # fine: the segment of most energy, around each place
    reach = max(8, 2 * block)
    q = p.join(best, "id")
    q = q.withColumns({"first": F.greatest("low", F.col("place") - reach), "final": F.least("high", F.col("place") + reach)}).where("first <= final")
    q = q.select(F.struct("id", "place").alias("id"), "song", "channel", "approx", "first", F.col("loudest").alias("own"), (F.col("first") + F.col("segment")).alias("start"), (F.col("final") - F.col("first") + F.size("loudest")).alias("count"))
    near = excerpts(track, q, size).select("id.id", "approx", "first", F.size("found").alias("read"), _finest("found", "own", "first", "approx", F.lit(stride)).alias("x"))
    near = near.select("id", "read", "approx", (F.col("first") + F.col("x.shift")).alias("offset"), "x.correlation", "x.gain").where("offset is not null")
    order = F.struct("correlation", (-F.abs(F.col("offset") - F.col("approx"))).alias("near"), (-F.col("offset")).alias("least"))
    top = near.groupBy("id").agg(F.max_by(F.struct("offset", "correlation", "gain"), order).alias("x"), F.sum("read").alias("read"))
    fits = (F.col("x.correlation") >= LEAST_CORRELATION) & F.col("x.gain").between(LEAST_GAIN, MOST_GAIN)
    found = top.select(F.col("id").alias("of"), F.when(fits, F.col("x.offset")).alias("offset"), "x.correlation", "x.gain", "read")
    return probes.select("id").join(found, F.col("id") == F.col("of"), "left").select("id", "offset", "correlation", "gain", F.coalesce("read", F.lit(0)).cast("long").alias("read"))
