"""Operator 8 against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from hopline.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k=13):
    first = defaultdict(lambda: 2**63)
    docs = [(2**63 - 1 if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for i, w in docs:
        for j in range(len(w) - k + 1):
            x = tuple(w[j : j + k])
            first[x] = min(first[x], i)
    out = []
    for (i, w), (doc_id, _) in zip(docs, rows):
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **o):
    return sorted((tuple(r) for r in sd.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **o).collect()), key=str)


@pytest.mark.parametrize("chunk, fold", [(4 << 20, 32 << 20), (300, 32 << 20), (300, 0), (300, 400)])
def test_brute_force(spark, monkeypatch, chunk, fold):
    monkeypatch.setattr(sd, "FOLD", fold)
    rng = random.Random(5)
    vocab = ["é", "a", "bb", "ccc", "dddd", "日本"] + [f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocab) for _ in range(n)] for n in (13, 14, 30, 60)]
    rows = [(None, "a " * 30), (7, None), (8, ""), (9, "one"), (9, "two \t\n words"), (10, "a " * 30), (10, "a " * 30), (10, "a " * 31)]
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(vocab) for _ in range(rng.randint(1, 30))]
        rows.append((rng.randint(0, 1000), rng.choice([" ", "\n", "  ", "\t "]).join(parts)))
    monkeypatch.setattr(sd, "CHUNK", chunk)
    assert got(spark, rows) == brute(rows)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got(spark, rows) == brute(rows)


def test_empty_and_text(spark):
    assert got(spark, []) == []
    w = " ".join(f"w{i}" for i in range(20))
    rows = sd.deduplicated(spark.createDataFrame([(1, w), (2, f"x {w} y")], "doc_id long, text string"), text=True).collect()
    assert {(r.doc_id, r.n_removed, r.kept) for r in rows} == {(1, 0, None), (2, 20, "x y")}


def test_chunks_spread_over_the_buckets(spark, monkeypatch):
    """Rows for each document go to as many buckets as there are chunks, whatever the number of tasks."""
    monkeypatch.setattr(sd, "CHUNK", 60)
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(15))) for i in range(64)], "id long, text string").repartition(16)
    blobs = docs.mapInArrow(sd._pack(13, 3, 4096), sd.BLOBS).where("kind = 1").groupBy("bucket").count().collect()
    assert sum(r["count"] for r in blobs) == 64 and len(blobs) > 55 and max(r["count"] for r in blobs) < 4


def test_a_passage_of_each_chunk_is_let_go(monkeypatch):
    """10,000 copies of a passage in one bucket: the largest sort has those that came since the last, not all."""
    monkeypatch.setattr(sd, "FOLD", 4000)
    text = " ".join(f"w{i}" for i in range(13)).encode()
    blobs = [sd._blob(1, 0, [i], [i], [0], [len(text)], text) for i in reversed(range(10_000))]
    batch = sd.pa.RecordBatch.from_arrays([sd.pa.array(c) for c in zip(*blobs)], ["bucket", "kind", "ids", "prints", "a", "b", "body"])
    sizes = []
    known = sd.repeated
    monkeypatch.setattr(sd, "repeated", lambda data, *x: (sizes.append(len(data)), known(data, *x))[1])
    marked = sorted(i for out in sd._sorted_windows(13)([batch]) for i in set(out.column("id").to_pylist()))
    assert marked == list(range(1, 10_000)) and max(sizes) < 5000


def test_unlike_windows_with_equal_hashes():
    data = np.frombuffer(b"aabbaa", np.uint8)
    at = np.array([0, 2, 4])
    assert sd.repeated(data, np.zeros(3, np.uint64), np.array([1, 2, 3]), at, at + 2).tolist() == [False, False, True]
