"""Line dedup by a deletion-neighbourhood join.

Lines are compared word by word, with an edit bound of one word put in, left out or changed. A line's neighbourhood is all it becomes by
deleting one word, and itself with a word to be put in at any place; each variant is hashed with its place. Two lines
are within the bound exactly if they share a variant at one place, and in a group of equal variants every pair is, so
the earliest line of the group stands for it: no pairs are emitted. The edit distance of each line to its earliest neighbour is then
verified on the words. A line goes if an earlier line, by doc_id and place, is equal or within the bound.

Equal lines are one class from the start (128-bit hash, earliest place kept by partial aggregation). Only classes
that can have a neighbour emit variants: an edit leaves the first or the last half of the words as it was, so a class
that shares neither half with another has none. A chunk of documents settles what it can by itself and sends each variant
from its earliest line only, so a variant that very many lines share sends a row from each chunk.

Lines are cut at line feeds; words are runs of anything but ASCII white space. Lines without words are never removed and don't
count. The bound is one word in lines of LEAST words or more and none in shorter ones, where a word is too large a part: those go only
if equal to an earlier one. Null text has no lines. Null doc_ids come last. Rows that share doc_id and text are one document and get
one result each; among rows of one doc_id the order is that of a 64-bit print of the text. A very long text is one chunk of a worker.
An empty table gives an empty result. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopline.llm._shared import bloom, in_bloom, written
from hopline.llm.textvec import Words, chunks, flatten, groups

LEAST = 6
LAST_ID = 2**63 - 1


class Lines:
    """The lines of a chunk's documents: Words whose 'documents' are lines."""

    def __init__(self, texts: pa.Array):
        data, offsets = flatten(texts)
        feeds = np.flatnonzero(data == 10) + 1
        cuts = np.union1d(offsets, feeds) if len(data) else np.zeros(1, np.int64)
        self.words = Words(data, cuts)
        self.n = self.words.counts
        first = np.searchsorted(cuts[:-1], offsets)  # empty documents point at the next one's first line
        self.doc = np.searchsorted(offsets, cuts[:-1], "right") - 1
        self.place = np.arange(len(self.n)) - first[self.doc] if len(self.n) else np.zeros(0, np.int64)
        self.used = np.flatnonzero(self.n > 0)
        spans = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        self.prints = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in spans], np.uint64).view(np.int64)

    def part(self, lines: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hashes of n words of each line, after the first ``skip``; 0 words hash as 0."""
        w = self.words
        a = w.pointer[lines] + skip
        out = np.zeros(len(lines), np.uint64)
        some = np.flatnonzero(n > 0)
        out[some] = w.hash(w.starts[a[some]], w.ends[a[some] + n[some] - 1])
        return out

    def text(self, line: int) -> bytes:
        return self.words.text(line).tobytes()


def _blend(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for i, p in enumerate(parts):
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
        h ^= h >> np.uint64(31)
    return h


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), "text")


def _lines(batches):
    for batch in chunks(batches):
        x = Lines(batch.column("text"))
        ids = batch.column("id").to_numpy()
        u = x.used
        if not len(u):
            continue
        n = x.n[u]
        sums = [xxhash.xxh3_128_intdigest(x.text(i)) for i in u.tolist()]
        mask = (1 << 64) - 1
        keys = []
        for m in (n, n - 1):  # words of the shorter line of a pair
            half = m // 2
            keys.append(_blend(m, np.zeros(len(u), np.int64), x.part(u, np.zeros(len(u), np.int64), half)))
            keys.append(_blend(m, np.ones(len(u), np.int64), x.part(u, n - (m - half), m - half)))
        halves = pa.array(np.stack(keys, 1).view(np.int64).tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array([s >> 64 for s in sums], np.uint64).view(np.int64)), pa.array(np.array([s & mask for s in sums], np.uint64).view(np.int64)), pa.array(ids[x.doc[u]]), pa.array(x.prints[x.doc[u]]), pa.array(x.place[u].astype(np.int32)), pa.array(n.astype(np.int32)), halves],
            ["hi", "lo", "id", "print", "place", "n", "halves"],
        )


LINES = "hi long, lo long, id long, print long, place int, n int, halves array<long>"
SPOT = "id long, print long, place int"


def classes(docs: DataFrame) -> DataFrame:
    """A row for each distinct line: hi, lo, first (its earliest id, print and place), n, halves."""
    lines = _rows(docs).mapInArrow(_lines, LINES)
    return lines.groupBy("hi", "lo").agg(F.min(F.struct("id", "print", "place")).alias("first"), F.first("n").alias("n"), F.first("halves").alias("halves"))


def _spot_key(ids: np.ndarray, prints: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ids ^ prints ^ (places.astype(np.int64) << 12)


def _at(docs: DataFrame, spots: DataFrame, make, schema: str) -> DataFrame:
    """make(Lines, line numbers, ids) over the lines at ``spots`` (id, print, place), and few others; a Bloom filter of bounded size finds them without a shuffle."""
    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_spot_key(*[b.column(c).to_numpy() for c in ("id", "print", "place")]))], ["key"])

    found = bloom(spots.select("id", "print", "place").mapInArrow(keys, "key long"), spots.count())
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        for batch in chunks(batches):
            x = Lines(batch.column("text"))
            ids = batch.column("id").to_numpy()
            u = x.used
            u = u[in_bloom(sent.value, _spot_key(ids[x.doc[u]], x.prints[x.doc[u]], x.place[u]))] if len(u) else u
            if len(u):
                yield make(x, u, ids[x.doc[u]])

    return _rows(docs).mapInArrow(run, schema)


def _variants(x: Lines, u: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    keep = x.n[u] >= LEAST
    u, ids = u[keep], ids[keep]
    n = x.n[u]
    line = np.repeat(np.arange(len(u)), n)
    p = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    left, right = x.part(u[line], np.zeros(len(line), np.int64), p), x.part(u[line], p + 1, n[line] - p - 1)
    gone = _blend(left, right, p)
    slot = np.repeat(np.arange(len(u)), n + 1)
    q = np.arange(len(slot)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
    put = _blend(x.part(u[slot], np.zeros(len(slot), np.int64), q), x.part(u[slot], q, n[slot] - q), q)
    of, variant = np.concatenate([line, slot]), np.concatenate([gone, put])
    spot = [ids, x.prints[x.doc[u]], x.place[u].astype(np.int32)]
    rank = np.empty(len(u), np.int64)
    rank[np.lexsort(spot[::-1])] = np.arange(len(u))
    order = np.lexsort((rank[of], variant))
    of, variant = of[order], variant[order]
    cut = groups(variant)
    first = np.repeat(of[cut[:-1]], np.diff(cut))
    known = rank[first] < rank[of]  # an earlier line of this chunk has the variant: settled here, and not sent to the variant's group
    local, at = np.unique(of[known], return_index=True)
    sent = ~known
    rows = [np.concatenate([variant[sent], variant[known][at] ^ _blend(local + 1, rank[local])]), *[np.concatenate([c[of[sent]], c[local]]) for c in spot]]
    none, partner = int(sent.sum()), first[known][at]
    other = [pa.concat_arrays([pa.nulls(none, pa.array(c).type), pa.array(c[partner])]) for c in spot]
    return pa.RecordBatch.from_arrays([pa.array(rows[0].view(np.int64)), *[pa.array(c) for c in rows[1:]], *other], ["variant", "id", "print", "place", "o_id", "o_print", "o_place"])


def _texts(x: Lines, u: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x.prints[x.doc[u]]), pa.array(x.place[u].astype(np.int32)), pa.array([x.text(i) for i in u.tolist()], pa.binary())], ["id", "print", "place", "line"])


def within_one(a: list, b: list) -> bool:
    """Whether one word put in, left out or changed, or none, turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _verified(batches):
    for b in batches:
        keep = [within_one(x.split(), y.split()) for x, y in zip(b.column("line").to_pylist(), b.column("other").to_pylist())]
        yield b.select(["id", "print", "place"]).filter(pa.array(keep, pa.bool_()))


def neighbours(docs: DataFrame, table: DataFrame) -> DataFrame:
    """id, print, place of the classes of ``table`` that have an earlier class within one word."""
    long_enough = table.where(F.col("n") >= LEAST - 1)
    halves = long_enough.select("first", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("first").alias("x"), F.max("first").alias("y")).where("x <> y").select("half")
    near = written(halves.join(shared, "half", "left_semi").select("first.*").distinct(), "line-candidates")
    variants = _at(docs, near, _variants, f"variant long, {SPOT}, o_id long, o_print long, o_place int")
    me, other = F.struct("id", "print", "place"), F.struct(F.col("o_id").alias("id"), F.col("o_print").alias("print"), F.col("o_place").alias("place"))
    least = F.when(F.col("o_id").isNotNull(), other).otherwise(F.min(me).over(Window.partitionBy("variant")))
    first = variants.withColumn("least", least).where(F.col("least") < me)
    pairs = written(first.groupBy("id", "print", "place").agg(F.min("least").alias("o")).select("id", "print", "place", F.col("o.id").alias("o_id"), F.col("o.print").alias("o_print"), F.col("o.place").alias("o_place")), "line-pairs")
    spots = pairs.select("id", "print", "place").unionByName(pairs.select(F.col("o_id").alias("id"), F.col("o_print").alias("print"), F.col("o_place").alias("place"))).distinct()
    texts = written(_at(docs, spots, _texts, f"{SPOT}, line binary").join(spots, ["id", "print", "place"], "left_semi").dropDuplicates(["id", "print", "place"]), "line-texts")
    other = texts.select(F.col("id").alias("o_id"), F.col("print").alias("o_print"), F.col("place").alias("o_place"), F.col("line").alias("other"))
    both = pairs.join(texts, ["id", "print", "place"]).join(other, ["o_id", "o_print", "o_place"])
    return both.select("id", "print", "place", "line", "other").mapInArrow(_verified, SPOT)


def kept_lines(docs: DataFrame) -> DataFrame:
    """id, print, places (sorted) of the lines that stay, for each document that keeps one."""
    table = written(classes(docs), "line-classes")
    gone = neighbours(docs, table)
    kept = table.select("first.*").join(gone, ["id", "print", "place"], "left_anti")
    return kept.groupBy("id", "print").agg(F.array_sort(F.collect_list("place")).alias("places"))


def _counted(batches):
    for batch in chunks(batches):
        x = Lines(batch.column("text"))
        n = np.bincount(x.doc[x.used], minlength=batch.num_rows) if len(x.used) else np.zeros(batch.num_rows, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(x.prints), pa.array(n)], ["id", "print", "n_lines"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with words), n_removed, kept_lines (places from 0, comma-joined) for each row of ``docs`` (doc_id, text)."""
    all_docs = _rows(docs).mapInArrow(_counted, "id long, print long, n_lines long")
    joined = all_docs.join(kept_lines(docs), ["id", "print"], "left")
    places = F.coalesce("places", F.array().cast("array<int>"))
    return joined.select(F.when(F.col("id") < LAST_ID, F.col("id")).alias("doc_id"), "n_lines", (F.col("n_lines") - F.size(places)).cast("long").alias("n_removed"), F.array_join(places.cast("array<string>"), ",").alias("kept_lines"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and the text without the removed lines, for each row of ``docs`` (doc_id, text)."""

    def cut(batches):
        for b in batches:
            out = []
            for text, places in zip(b.column("text").to_pylist(), b.column("places").to_pylist()):
                stay = set(places or ())
                out.append(None if text is None else "\n".join(t for i, t in enumerate(text.split("\n")) if i in stay or not t.encode("utf-8", "surrogatepass").split()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], ["id", "text"])

    def keyed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.array([xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)), b.column("text")], ["id", "print", "text"])

    rows = _rows(docs).mapInArrow(keyed, "id long, print long, text string").join(kept_lines(docs), ["id", "print"], "left")
    return rows.mapInArrow(cut, "id long, text string").select(F.when(F.col("id") < LAST_ID, F.col("id")).alias("doc_id"), "text")
