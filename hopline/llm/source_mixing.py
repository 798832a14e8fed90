"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Slot i of the mix gets the golden-ratio point frac((i + 1/2) / phi). Cumulative target shares map the point to
a source; the slot's rank among its source's slots names the block of ``block`` words that it takes, from the source's
documents put in order by a hash and cut into equal blocks. A source that is taken more than once starts again at its first
block. So any run of slots holds the sources in close to their target shares.

The number of slots is bounded, so the blocks of a large mix are longer. A source that then has fewer than FINE slots is
taken exactly instead: the first words of its documents in the same order, up to its target, once more from the start if need be.

Ranks and running sums work in two steps, within slices of a source and over the slices' totals, so that no
task holds a whole source. There are about as many slices as the square root of all rows, and so as rows in a slice.

Words are runs of anything but ASCII white space; null text has none. The null source is a source and comes last.
Documents without words are taken 0 times. An empty table gives an empty result. Rows that repeat a
doc_id count each for itself. A very long text may span several blocks. Columns other than doc_id, text and source are not read;
mixed() passes all on, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopline.llm._shared import blank, written

WEIGHTS = (3, 1, 2)
#: Words of the mix as a multiple of all words, and the most that a source gives as a multiple of its own.
SHARE, CAP = 1.5, 2.0
#: Slots of the smallest target, at least, unless it is taken exactly, and of the whole mix, at most; words in a block, at most unless the mix has more slots than that.
FINE, SLOTS, BLOCK = 256, 1 << 22, 4096
CELLS = 4096
#: Sources that are broadcast, at most.
FEW = 20_000


def words(text: str = "text") -> Column:
    return F.regexp_count(blank(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """A row for each source of ``sizes`` (source, size): rank, source_size, n_docs, weight, target, block, exact, blocks, low, high.

    Targets share ``share`` of all words by weight. One that would pass ``cap`` times its source's size stops there and the
    rest is shared anew: with the sources in order of cap by weight, those before the first that stays below its
    share are capped. The table has a row for each source; only its windows run in one task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranks = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranks = ranks.withColumn("weight", weight).withColumn("cap", cap * F.col("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranks.withColumn("total", share * F.sum("source_size").over(everything))
    left = F.col("total") - F.coalesce(F.sum("cap").over(order), F.lit(0.0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    ranks = ranks.withColumn("level", left / free).withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    ranks = ranks.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    ranks = ranks.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("weight")))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    fine = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), F.floor(least / FINE).cast("double")))
    ranks = ranks.withColumn("fine", F.coalesce(fine, F.lit(1.0)).cast("long"))
    ranks = ranks.withColumn("block", F.greatest("fine", F.coalesce(F.ceil(F.col("total") / SLOTS), F.lit(1)).cast("long")))
    ranks = ranks.withColumn("exact", (F.col("block") > F.col("fine")) & (F.col("target") < FINE * F.col("block")))
    high = F.sum("target").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    sum_all = F.nullif(F.sum("target").over(everything), F.lit(0.0))
    ranks = ranks.withColumn("high", high / sum_all).withColumn("low", (high - F.col("target")) / sum_all)
    return ranks.select("source", "rank", "source_size", "n_docs", "weight", "target", "block", "exact", F.ceil(F.col("source_size") / F.col("block")).alias("blocks"), "low", "high")


def _sliced(df: DataFrame, amount: Column, order: list) -> DataFrame:
    """df (rank, slice, ...) with ``place`` in its slice and ``before``: the amounts of all rows before it in its rank."""
    totals = df.groupBy("rank", "slice").agg(F.sum(amount).alias("of_slice"))
    totals = totals.select("rank", "slice", F.coalesce(F.sum("of_slice").over(Window.partitionBy("rank").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("rank", "slice").orderBy(*order)
    rows = df.withColumn("place", F.row_number().over(within)).withColumn("before", F.coalesce(F.sum(amount).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(totals, ["rank", "slice"]).withColumn("before", F.col("before") + F.col("base")).drop("base")


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """slot, rank, block_no, epoch for each slot, from the table that targets() gives; sources taken exactly have none."""
    point = (F.col("slot") + F.lit(0.5)) * F.lit(0.6180339887498949)
    points = sources.sparkSession.range(slots).withColumnRenamed("id", "slot").withColumn("u", point - F.floor(point))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS).cast("long"))
    cells = sources.where((F.col("target") > 0) & (F.col("blocks") > 0) & ~F.col("exact")).select("rank", "blocks", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    mapped = points.join(cells, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("slot", "rank", "blocks", F.floor(F.col("slot") / max(1, math.isqrt(slots))).alias("slice"))
    ranked = _sliced(mapped, F.lit(1), ["slot"])
    return ranked.select("slot", "rank", (F.col("before") % F.col("blocks")).alias("block_no"), F.floor(F.col("before") / F.col("blocks")).alias("epoch"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of ``docs`` (doc_id, text, source).

    ``taken`` counts the words that the schedule takes of the document, repeats included.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size"))
    sizes = written(sizes, "mix-sizes")
    sources = written(targets(sizes, weights, share, cap), "mix-sources")
    of = sources.agg(F.sum("target").alias("total"), F.max("block").alias("block"), F.sum("n_docs").alias("docs"), F.count("*").alias("sources")).first()
    small = F.broadcast if of["sources"] <= FEW else (lambda x: x)
    block = int(of["block"] or 1)
    bits = (of["docs"] or 0).bit_length() // 2
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    keyed = sizes.withColumn("place_hash", place).withColumn("slice", F.shiftright("place_hash", 32 - bits))
    keys = sources.select(F.col("source").alias("of"), "rank")
    keyed = keyed.join(small(keys), keyed["source"].eqNullSafe(keys["of"])).drop("of", "source")
    placed = _sliced(keyed, F.col("size"), ["place_hash", "doc_id", "size"])
    first, last = F.floor(F.col("before") / block), F.floor((F.col("before") + F.col("size") - 1) / block)
    pieces = placed.withColumn("block_no", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    piece = F.least(F.col("before") + F.col("size"), (F.col("block_no") + 1) * block) - F.greatest(F.col("before"), F.col("block_no") * block)
    times = schedule(sources, round((of["total"] or 0.0) / block)).where(F.col("epoch") < cap).groupBy("rank", "block_no").agg(F.count("*").alias("times"))
    joined = pieces.withColumn("piece", piece).join(times, ["rank", "block_no"], "left")
    taken = joined.groupBy("rank", "slice", "place").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("before").alias("before"), F.coalesce(F.sum(F.col("piece") * F.col("times")), F.lit(0)).cast("long").alias("taken"))
    taken = taken.join(small(sources.select("rank", "source", "source_size", "target", "exact")), "rank")
    goal = F.round("target").cast("long")
    rounds, rest = F.floor(goal / F.col("source_size")), goal % F.col("source_size")
    own = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return taken.withColumn("taken", F.when(F.col("exact") & (F.col("size") > 0), own).otherwise(F.col("taken")).cast("long")).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them: taken by size, rounded.

    Rows that share doc_id, source and number of words are taken alike. Documents without words are kept once.
    """
    taken = mix(docs, **options).where(F.col("size") > 0).withColumn("times", F.floor(F.col("taken") / F.col("size") + 0.5)).where(F.col("times") > 0)
    taken = taken.groupBy("doc_id", "source", "size").agg(F.max("times").cast("int").alias("times")).toDF("_hl_id", "_hl_source", "_hl_size", "_hl_times")
    rows = docs.withColumn("_hl_words", words())
    same = F.col("doc_id").eqNullSafe(F.col("_hl_id")) & F.col("source").eqNullSafe(F.col("_hl_source")) & (F.col("_hl_words") == F.col("_hl_size"))
    some = rows.join(taken, same, "left").withColumn("_hl_times", F.when(F.col("_hl_words") == 0, F.lit(1)).otherwise(F.coalesce("_hl_times", F.lit(0))))
    return some.where("_hl_times > 0").withColumn("_hl_time", F.explode(F.sequence(F.lit(1), F.col("_hl_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])
