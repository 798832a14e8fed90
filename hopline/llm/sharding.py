"""Sharding by extendible hashing.

A shard is a prefix of a document's hash bits. All documents start in the empty prefix; a prefix with more bytes
than the limit is split on its next bit, and only it, until every shard fits. The directory (a row for each
shard) comes from a histogram of hash prefixes: nodes of all depths are summed from it, and a shard is the shallowest node that
fits. Cells of the histogram that are still too large are taken apart 8 bits deeper, on their rows alone.

The hash covers doc_id and text. Rows that repeat both can't be told apart by it: if such a group passes the limit, it is
cut by count into parts ``prefix-0``, ``prefix-1`` and so on. A single row above the limit, such as a very long text, is a shard of
its own. Null text has 0 bytes, a null doc_id hashes as empty. An empty table gives an empty result. Other columns, of any name, are
not read by shards() and kept by write_shards().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopline.llm._shared import blank, written

BITS = 60
STEP = 8


def hash_bits() -> Column:
    """60 bits of md5 over doc_id and the text's md5."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(blank().cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _cell(depth: int) -> Column:
    return F.shiftright("key", BITS - depth)


def directory(sizes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(shards, cells) for ``sizes`` (key, n_bytes): cells map ``cell_depth, cell`` to the ``depth, prefix`` of the shard with its bytes and documents."""
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + 4)
    rows, found, from_depth = sizes, None, 0
    while True:
        cells = written(rows.groupBy(_cell(depth).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs")), "shard-cells")
        nodes = cells.withColumn("depth", F.explode(F.sequence(F.lit(from_depth), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
        sums = nodes.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("shard_docs"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == BITS))
        # a shard is a prefix that fits below one that doesn't; it is looked up by the cells below it
        above = fits.select((F.col("depth") + 1).alias("of"), F.col("prefix").alias("above")).hint("merge")
        top = fits.join(above, (F.col("depth") == F.col("of")) & (F.shiftright("prefix", 1) == F.col("above")), "left_anti")
        below = F.expr(f"explode(sequence(shiftleft(prefix, {depth} - depth), shiftleft(prefix + 1, {depth} - depth) - 1))")
        best = top.select(F.lit(depth).alias("cell_depth"), below.alias("cell"), "depth", "prefix", "shard_bytes", "shard_docs")
        best = written(best, "shard-directory")
        found = best if found is None else found.unionByName(best)
        if depth == BITS:
            break
        open_cells = written(cells.join(best.hint("merge"), "cell", "left_anti").select("cell"), "shard-open")
        if open_cells.isEmpty():
            break
        rows = written(rows.join(open_cells.hint("merge"), _cell(depth) == F.col("cell"), "left_semi"), "shard-rows")
        from_depth, depth = depth + 1, min(BITS, depth + STEP)
    return found.select("depth", "prefix", "shard_bytes", "shard_docs").distinct(), found


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_hl_key": hash_bits(), "_hl_bytes": F.octet_length(blank()).cast("long")})


def _assigned(rows: DataFrame, limit: int, sizes: DataFrame) -> DataFrame:
    """rows (_hl_key, _hl_bytes and any more columns) with _hl_shard, _hl_depth, _hl_shard_bytes and _hl_shard_docs."""
    _, cells = directory(sizes, limit)
    depths = [r[0] for r in cells.select("cell_depth").distinct().collect()]  # a few numbers
    at = [F.struct(F.lit(d).alias("_hl_cell_depth"), F.shiftright("_hl_key", BITS - d).alias("_hl_cell")) for d in sorted(depths) or [0]]
    keyed = rows.withColumn("_hl_at", F.explode(F.array(*at))).select("*", "_hl_at.*").drop("_hl_at")
    cells = cells.toDF(*[f"_hl_{c}" for c in cells.columns])
    found = keyed.join(cells.hint("merge"), ["_hl_cell_depth", "_hl_cell"]).drop("_hl_cell_depth", "_hl_cell")
    bits = F.when(F.col("_hl_depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(_hl_prefix), _hl_depth, '0')"))
    named = found.withColumn("_hl_shard", bits).drop("_hl_prefix")
    heavy = (F.col("_hl_depth") == BITS) & (F.col("_hl_shard_bytes") > limit) & (F.col("_hl_shard_docs") > 1)
    if cells.where(heavy).isEmpty():
        return named
    # repeated rows are counted in slices of the table, then over the slices' totals
    rest = named.where(heavy).withColumn("_hl_slice", F.spark_partition_id())
    totals = rest.groupBy("_hl_key", "_hl_slice").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("_hl_key").orderBy("_hl_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("_hl_key", "_hl_slice", before.alias("_hl_before"))
    place = F.row_number().over(Window.partitionBy("_hl_key", "_hl_slice").orderBy("_hl_bytes")) - 1
    fit = F.greatest(F.lit(1), F.floor(limit / F.col("_hl_bytes")))
    parts = rest.withColumn("_hl_place", place).join(totals, ["_hl_key", "_hl_slice"]).withColumn("_hl_part", F.floor((F.col("_hl_place") + F.col("_hl_before")) / fit))
    held = F.least(fit, F.col("_hl_shard_docs") - F.col("_hl_part") * fit)
    parts = parts.withColumns({"_hl_shard": F.concat_ws("-", "_hl_shard", F.col("_hl_part").cast("string")), "_hl_shard_docs": held, "_hl_shard_bytes": held * F.col("_hl_bytes")})
    return named.where(~heavy).unionByName(parts.drop("_hl_slice", "_hl_place", "_hl_before", "_hl_part"))


def shards(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes, shard_docs for each row of ``docs`` (doc_id, text)."""
    sizes = written(_sizes(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "_hl_key", "_hl_bytes"), "shard-sizes")
    found = _assigned(sizes, limit, sizes.select(F.col("_hl_key").alias("key"), F.col("_hl_bytes").alias("n_bytes")))
    return found.select("doc_id", F.col("_hl_bytes").alias("n_bytes"), *[F.col(f"_hl_{c}").alias(c) for c in ("shard", "depth", "shard_bytes", "shard_docs")])


def write_shards(docs: DataFrame, out: str, limit: int) -> None:
    """Each row of ``docs``, all columns, once, in one folder for each shard (``_hl_shard=`` and its name)."""
    sizes = written(_sizes(docs).select(F.col("_hl_key").alias("key"), F.col("_hl_bytes").alias("n_bytes")), "shard-sizes")
    rows = _assigned(_sizes(docs), limit, sizes).select(*[F.col(f"`{c}`") for c in docs.columns], "_hl_shard")
    rows.repartition(F.col("_hl_shard")).write.partitionBy("_hl_shard").parquet(out)
