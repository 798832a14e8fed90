"""Document fingerprints: canonical exact digests.

The canonical form of a text is its NFKC form with case folded and white space runs as one space, none at the ends. Its
digest is the 128-bit xxh3. Inside a bucket of equal digests the canonical bytes are compared (their least and greatest
must be equal); in a bucket where they differ, the digest is extended by the SHA-256 of the canonical bytes, so
different canonical texts of documents never share a fingerprint. Likeness of two fingerprints is 1 if they are equal and their
texts' SHA-256 too, else 0.

Null text counts as empty. Null doc_ids come last in descending order. Rows that share a doc_id are ordered by text. A very long
text is one row of a range. A table of one row has itself as the next document; an empty table gives an empty result. Columns
other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.llm._shared import blank, bloom, in_bloom, partitions, written

LEAST_ID = -(2**63)


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.casefold().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def fingerprints(docs: DataFrame, digest=digest) -> DataFrame:
    """doc_id, fingerprint, wide (hex SHA-256 of the canonical bytes) for each row, before buckets are compared."""

    def each(batches):
        for b in batches:
            forms = [canonical(t or "") for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array([digest(x) for x in forms], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in forms], pa.string())], ["doc_id", "fingerprint", "wide"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fingerprint string, wide string")


def collisions(docs: DataFrame, rows: DataFrame, digest=digest) -> DataFrame:
    """The fingerprints of ``rows`` (fingerprint) that stand for more than one canonical text of ``docs``.

    Only buckets of several documents are compared: a Bloom filter of their digests, of bounded size, thins the texts before
    they are shuffled. Least and greatest are aggregated before the shuffle too, so a bucket of many copies sends one
    text from each task.
    """
    shared = rows.groupBy("fingerprint").count().where("count > 1")
    key = F.conv(F.substring("fingerprint", 1, 15), 16, 10).cast("long")
    shared = written(shared.select(key.alias("key")), "fingerprint-buckets")
    found = bloom(shared, shared.count())
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def forms(batches):
        for b in batches:
            texts = [canonical(t or "") for t in b.column("text").to_pylist()]
            digests = [digest(x) for x in texts]
            may = np.flatnonzero(in_bloom(sent.value, np.array([int(x[:15], 16) for x in digests], np.int64)))
            yield pa.record_batch([pa.array([digests[i] for i in may], pa.string()), pa.array([texts[i] for i in may], pa.binary())], ["fingerprint", "form"])

    compared = docs.select("text").mapInArrow(forms, "fingerprint string, form binary")
    return compared.groupBy("fingerprint").agg(F.min("form").alias("least"), F.max("form").alias("most")).where("least <> most").select("fingerprint")


def _places(docs: DataFrame, shards: int) -> tuple[np.ndarray, dict[int, int], dict[int, int]]:
    """(bounds, the first doc_id of each shard, the shard before each), from doc_ids alone: a few numbers for each shard reach the driver."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("key"))
    cuts = ids.approxQuantile("key", [i / shards for i in range(1, shards)], 0.2 / shards) if shards > 1 else []
    bounds = np.unique(np.array(cuts or [0.0]))

    def heads(batches):
        best: dict[int, int] = {}
        for b in batches:
            keys = b.column("key").to_numpy()
            for s, k in zip(_shard(bounds, keys).tolist(), keys.tolist()):
                best[s] = max(best.get(s, LEAST_ID), k)
        yield pa.record_batch([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], ["shard", "key"])

    first = {r["shard"]: r["key"] for r in ids.mapInArrow(heads, "shard int, key long").groupBy("shard").agg(F.max("key").alias("key")).collect()}
    order = sorted(first)
    return bounds, first, {s: order[i - 1] for i, s in enumerate(order)}


def _shard(bounds: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Shards in descending order of keys."""
    return (len(bounds) - np.searchsorted(bounds, keys.astype(float), "right")).astype(np.int32)


def edited(docs: DataFrame, digest=digest) -> DataFrame:
    """Each document beside its edited text: doc_id, n_chars, edited_sha256, fingerprint, wide, edited_fingerprint, edited_wide, next_fingerprint, next_wide.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many of the next document in
    descending doc_id order; the first document follows the last. Texts are shuffled once, to ranges of doc_id; the first
    document of a range goes to the range before it too.
    """
    shards = 2 * partitions(docs)
    bounds, first, before = _places(docs, shards)

    def deal(batches):
        for b in batches:
            keys = b.column("key").to_numpy()
            shard = _shard(bounds, keys)
            yield pa.record_batch([pa.array(shard), pa.array(np.zeros(len(keys), bool)), *b.columns], ["shard", "ahead", *b.schema.names])
            head = np.array([first[s] == k for s, k in zip(shard.tolist(), keys.tolist())], bool)
            if head.any():
                again = b.filter(pa.array(head))
                to = [before[s] for s in shard[head].tolist()]
                yield pa.record_batch([pa.array(to, pa.int32()), pa.array([True] * len(to)), *again.columns], ["shard", "ahead", *b.schema.names])

    def pair(batches):
        own = None  # the last document, which still waits for the next
        for b in batches:
            out = []
            for s, ahead, key, null, text in zip(*[b.column(c).to_pylist() for c in ("shard", "ahead", "key", "none", "text")]):
                if ahead and (own is None or own[0] != s):
                    continue
                form = canonical(text)
                prints = (digest(form), hashlib.sha256(form).hexdigest())
                if own is not None and own[0] == s:
                    n, half = len(own[2]), len(own[2]) // 2
                    new = own[2][: n - half] + text[:half]
                    new_form = canonical(new)
                    out.append((own[1], n, hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), *own[3], digest(new_form), hashlib.sha256(new_form).hexdigest(), *prints))
                own = None if ahead else (s, None if null else key, text, prints)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64()] + [pa.string()] * 7)], NAMES)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("key"), F.col("doc_id").isNull().alias("none"), blank().alias("text"))
    dealt = rows.mapInArrow(deal, "shard int, ahead boolean, key long, none boolean, text string")
    sorted_rows = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "ahead", F.desc("key"), F.desc("none"), "text")
    return sorted_rows.mapInArrow(pair, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, wide string, edited_fingerprint string, edited_wide string, next_fingerprint string, next_wide string")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "wide", "edited_fingerprint", "edited_wide", "next_fingerprint", "next_wide"]


def compared(docs: DataFrame, digest=digest) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of ``docs`` (doc_id, text)."""
    rows = written(edited(docs, digest), "fingerprints")
    bad = written(collisions(docs, rows.select("fingerprint"), digest), "fingerprint-collisions")
    kinds = ("", "edited_", "next_")
    if not bad.isEmpty():
        for kind in kinds:
            mark = bad.select(F.col("fingerprint").alias("bad"))
            rows = rows.join(mark, rows[f"{kind}fingerprint"] == mark["bad"], "left")
            rows = rows.withColumn(f"{kind}fingerprint", F.when(F.col("bad").isNull(), F.col(f"{kind}fingerprint")).otherwise(F.concat(f"{kind}fingerprint", F.lit("-"), f"{kind}wide"))).drop("bad")
    near = lambda kind: ((F.col("fingerprint") == F.col(f"{kind}fingerprint")) & (F.col("wide") == F.col(f"{kind}wide"))).cast("double")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_").alias("near_edited"), near("next_").alias("near_next"))
