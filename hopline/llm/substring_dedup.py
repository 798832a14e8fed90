"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. Its minimiser is the least hash among its runs of M words. Consecutive
windows with the same minimiser travel as one packed string to the minimiser's bucket. There all windows are unpacked
and sorted, equal ones lie together (their bytes are compared, not only their hashes), and each that also starts in a document
with a smaller doc_id is marked. Words that a marked window covers are removed.

Before anything travels, each chunk of documents marks what it can by itself: a window that occurs in several of its documents
goes to its bucket from the first of them only. A passage that a third of all documents hold then sends one copy from
each chunk, not one from each document.

Words are runs of anything but ASCII white space. Null text has none. Windows never span documents. A null doc_id
counts as larger than all others. Rows that share a doc_id are one document to the rule (neither removes from
the other); each gets its own result. A very long text is one chunk of a worker. An empty table gives an empty result. Columns
other than doc_id and text are not read, whatever their names.

A bucket's packed strings are read in one worker; its windows are sorted in as many passes over them as keep WINDOWS at once. Each
time FOLD bytes have come together, and twice of what was left before, strings all of whose windows are marked are let go: the
copies of a passage that each chunk holds leave one of them in memory. What is held is the bucket's distinct text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.llm._shared import bloom, in_bloom, partitions, written
from hopline.llm.textvec import Prefix, Words, chunks, flatten, gather, groups, release_memory, same_bytes, words

WINDOW = 13
M = 3
CHUNK = 4 << 20
LAST_ID = 2**63 - 1
#: Windows that are sorted at once, about; 40 bytes each.
WINDOWS = 4 << 20
#: Bytes of a bucket's strings that are sorted before more are read.
FOLD = 32 << 20


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def _expand(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """At i the least of x[i : i + n], as far as there are so many."""
    out, span = x.copy(), 1
    while 2 * span <= n:
        out[:-span] = np.minimum(out[:-span], out[span:])
        span *= 2
    if rest := n - span:
        out[:-rest] = np.minimum(out[:-rest], out[rest:])
    return out


def repeated(data: np.ndarray, hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the byte ranges also occur with a smaller id: sorted by hash and id, equal bytes lie together."""
    order = np.lexsort((ids, hashes))
    cut = groups(hashes[order])
    first = np.repeat(order[cut[:-1]], np.diff(cut))
    later = np.flatnonzero(ids[order] > ids[first])
    own, ref = order[later], first[later]
    n = ends[own] - starts[own]
    same = n == ends[ref] - starts[ref]
    same[same] = same_bytes(data, starts[own[same]], starts[ref[same]], n[same])
    out = np.zeros(len(hashes), bool)
    out[own[same]] = True
    for i in own[~same]:  # equal hashes of unlike windows: compare with the whole group
        group = np.flatnonzero(hashes == hashes[i])
        text = data[starts[i] : ends[i]].tobytes()
        out[i] = any(ids[j] < ids[i] and data[starts[j] : ends[j]].tobytes() == text for j in group)
    return out


def _breaks(*conditions: np.ndarray) -> np.ndarray:
    """Starts of runs, where any condition between neighbours holds, with the end."""
    broken = np.logical_or.reduce(conditions)
    return np.concatenate(([0], np.flatnonzero(broken) + 1, [len(broken) + 1]))


BLOBS = "bucket int, kind int, ids binary, prints binary, a binary, b binary, body binary"


def _blob(bucket: int, kind: int, ids, prints, a, b, body: bytes = b"") -> tuple:
    pack = lambda x, t: _squeeze(np.ascontiguousarray(x, t).tobytes())
    return bucket, kind, pack(ids, np.int64), pack(prints, np.int64), pack(a, np.int64), pack(b, np.int64), _squeeze(body)


def _pack(window: int, m: int, buckets: int):
    def run(batches):
        turn = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, limit=CHUNK):
            ids = batch.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            batch, ids = batch.take(pa.array(order)), ids[order]
            w = Words(*flatten(batch.column("text")))
            prints = w.prints()
            turn += 1
            own_bucket = xxhash.xxh3_64_intdigest(turn.to_bytes(8, "little")) % buckets  # tasks number their chunks alike, so the number alone would pile them up
            rows = []
            shas = b"".join(hashlib.sha256(w.text(d)).digest() for d in range(len(ids)))
            rows.append(_blob(own_bucket, 1, ids, prints, w.counts, np.zeros(len(ids)), shas))
            at = w.windows(window)
            if len(at):
                doc = np.searchsorted(w.pointer, at, "right") - 1
                hashes = w.runs(at, window)
                known = repeated(w.data, hashes, ids[doc], w.starts[at], w.ends[at + window - 1])
                if known.any():
                    own, of = at[known], doc[known]
                    cut = _breaks(own[1:] != own[:-1] + 1, of[1:] != of[:-1])
                    d = of[cut[:-1]]
                    rows.append(_blob(own_bucket, 2, ids[d], prints[d], own[cut[:-1]] - w.pointer[d], own[cut[1:] - 1] + window - w.pointer[d]))
                least = np.zeros(len(w.starts), np.uint64)
                least[: len(w.starts) - m + 1] = w.runs(np.arange(len(w.starts) - m + 1), m)
                least = _sliding_min(least, window - m + 1)
                own, of = at[~known], doc[~known]
                if len(own):
                    low = least[own]
                    cut = _breaks(own[1:] != own[:-1] + 1, of[1:] != of[:-1], low[1:] != low[:-1])
                    first, d = own[cut[:-1]], of[cut[:-1]]
                    start, end = w.starts[first], w.ends[own[cut[1:] - 1] + window - 1]
                    bucket = (low[cut[:-1]] % np.uint64(buckets)).astype(np.int64)
                    by = np.argsort(bucket, kind="stable")
                    for k in range(len(edge := groups(bucket[by])) - 1):
                        x = by[edge[k] : edge[k + 1]]
                        n = end[x] - start[x]
                        rows.append(_blob(int(bucket[x[0]]), 0, ids[d[x]], prints[d[x]], first[x] - w.pointer[d[x]], n, gather(w.data, start[x], n).tobytes()))
            types = [pa.int32(), pa.int32()] + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["bucket", "kind", "ids", "prints", "a", "b", "body"])

    return run


MARKS = "id long, print long, kind int, a int, b int, sha binary"


def _marks(ids, prints, kind: int, a, b, sha=None) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints.astype(np.int64)), pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(a).astype(np.int32)), pa.array(np.asarray(b).astype(np.int32)), pa.array(sha, pa.binary()) if sha else pa.nulls(n, pa.binary())], ["id", "print", "kind", "a", "b", "sha"])


def _sorted_windows(window: int):
    """Marks of a partition's bucket."""

    def one_pass(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, k: int, passes: int, total: np.ndarray) -> np.ndarray:
        """(run, place in it) of the repeated windows whose hash falls to pass k: equal windows fall to the same. ``total`` gets the windows of each run."""
        parts = []
        i = 0
        while i < len(ids):  # hashes need 24 bytes for each byte of text, so they are made slice by slice
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (2 << 20))) - 1)
            base = offsets[i]
            part = data[base : offsets[j]]
            starts, ends, pointer = words(part, offsets[i : j + 1] - base)
            counts = np.diff(pointer) - window + 1
            total[i:j] = counts
            at = np.arange(int(counts.sum())) + np.repeat(pointer[:-1] - (np.cumsum(counts) - counts), counts)
            run = np.repeat(np.arange(i, j), counts)
            h = Prefix(part)(starts[at], ends[at + window - 1])
            own = np.flatnonzero(h % np.uint64(passes) == k) if passes > 1 else slice(None)
            at, run, h = at[own], run[own], h[own]
            parts.append((run, at - pointer[run - i], h, starts[at] + base, ends[at + window - 1] + base))
            i = j
        run, place, hashes, starts, ends = (np.concatenate(x) for x in zip(*parts))
        dup = np.flatnonzero(repeated(data, hashes, ids[run], starts, ends))
        return np.stack([run[dup], place[dup]])

    def resolve(held: list, more: bool) -> pa.RecordBatch | None:
        """Marks of the strings held; if more of the bucket follow, those with an unmarked window stay."""
        ids, prints, a, n = (np.concatenate(x) for x in list(zip(*held))[:4])
        data = np.frombuffer(b"".join(x[4] for x in held), np.uint8)
        held.clear()
        offsets = np.concatenate(([0], np.cumsum(n)))
        passes = max(1, -(-len(data) // (8 * WINDOWS)))  # words have some eight bytes
        total = np.zeros(len(ids), np.int64)
        dup = np.concatenate([one_pass(data, offsets, ids, k, passes, total) for k in range(passes)], 1)
        dup = dup[:, np.lexsort((dup[1], dup[0]))]
        run, place = dup
        if more:
            stay = np.bincount(run, minlength=len(ids)) < total
            held.append((ids[stay], prints[stay], a[stay], n[stay], gather(data, offsets[:-1][stay], n[stay]).tobytes()))
        if not len(run):
            return None
        cut = _breaks((run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1))
        x, y = cut[:-1], cut[1:] - 1
        r = run[x]
        return _marks(ids[r], prints[r], 2, a[r] + place[x], a[r] + place[y] + window)

    def run(batches):
        bucket, held, size, bound = None, [], 0, FOLD
        for batch in batches:
            for k, kind, *blobs in zip(*[batch.column(c).to_pylist() for c in ("bucket", "kind", "ids", "prints", "a", "b", "body")]):
                ids, prints, a, b, body = (np.frombuffer(_expand(x), t) if t else _expand(x) for x, t in zip(blobs, (np.int64, np.int64, np.int64, np.int64, None)))
                if kind == 1:
                    yield _marks(ids, prints, 1, a, b, [body[i : i + 32] for i in range(0, len(body), 32)])
                elif kind == 2:
                    yield _marks(ids, prints, 2, a, b)
                else:
                    if (k != bucket or size > bound) and held:
                        if out := resolve(held, k == bucket):
                            yield out
                        size = sum(len(x[4]) for x in held)
                        bound = max(FOLD, 2 * size)
                    bucket = k
                    held.append((ids, prints, a, b, body))
                    size += len(body)
        if held and (out := resolve(held, False)):
            yield out
        release_memory()

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), "text")


def marks(docs: DataFrame, window: int = WINDOW, m: int = M) -> DataFrame:
    """A row for each document: id, print, n_words, copies (equal rows), sha (of all its words), ranges (of words to remove)."""
    buckets = 2 * partitions(docs)
    packed = _rows(docs).mapInArrow(_pack(window, m, buckets), BLOBS)
    found = packed.repartitionById(buckets, F.col("bucket")).mapInArrow(_sorted_windows(window), MARKS)  # a bucket is a partition
    info, cover = F.col("kind") == 1, F.col("kind") == 2
    return found.groupBy("id", "print").agg(
        F.max(F.when(info, F.col("a"))).cast("long").alias("n_words"), F.count(F.when(info, 1)).cast("int").alias("copies"), F.max("sha").alias("sha"),
        F.collect_list(F.when(cover, F.struct("a", "b"))).alias("ranges"))


def _key():
    return F.col("id").bitwiseXOR(F.col("print"))


def _kept(text: str | None, ranges: list, n: int) -> tuple[bytes, int]:
    gone = np.zeros(n + 1, np.int32)
    for r in ranges:
        gone[r["a"]] += 1
        gone[r["b"]] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    parts = (text or "").encode("utf-8", "surrogatepass").split()
    return b" ".join([p for p, g in zip(parts, gone.tolist()) if not g]), int(gone.sum())


def _touched(docs: DataFrame, table: DataFrame) -> DataFrame:
    """id, print, text of the documents that lose words, joined with their ranges. A Bloom filter of bounded size keeps most others out of the shuffle."""
    lose = table.where(F.size("ranges") > 0)
    keys = lose.select(_key().alias("key"))
    found = bloom(keys, keys.count())
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def thin(batches):
        for batch in chunks(batches):
            ids = batch.column("id").to_numpy()
            prints = Words(*flatten(batch.column("text"))).prints()
            keep = in_bloom(sent.value, ids ^ prints)
            out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints), batch.column("text")], ["id", "print", "text"])
            yield out.filter(pa.array(keep))

    return _rows(docs).mapInArrow(thin, "id long, print long, text string").join(lose.select("id", "print", "n_words", "ranges"), ["id", "print"])


def deduplicated(docs: DataFrame, window: int = WINDOW, m: int = M, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of ``docs`` (doc_id, text); with ``text`` the kept text of documents that lose words, else null."""
    table = written(marks(docs, window, m), "substring-marks")

    def cut(batches):
        for b in batches:
            kept = [_kept(t, r, n) for t, r, n in zip(*[b.column(c).to_pylist() for c in ("text", "ranges", "n_words")])]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_words"), pa.array([n for _, n in kept], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x, _ in kept], pa.string()), pa.array([x.decode("utf-8", "surrogatepass") if text else None for x, _ in kept], pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept"])

    changed = _touched(docs, table).mapInArrow(cut, "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    whole = table.where(F.size("ranges") == 0).withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    whole = whole.select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("sha")).alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    rows = changed.unionByName(whole).withColumn("doc_id", F.when(F.col("id") < LAST_ID, F.col("id")))
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if text else []))
