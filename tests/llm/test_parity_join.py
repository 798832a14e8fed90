"""Operator 12 against brute force."""

import random

import numpy as np
import pytest

from hopline.llm import minhash, parity_join
from tests.llm.test_pairs import brute_near, frame, near_rows

ODD = [(None, "null id text here"), (None, "another null id text"), (5, None), (6, " \n"), (7, "one"), (8, "ONE"), (8, "two words"), (9, "two  Words"), (8, "two words"), (10, "a b c d e"), (11, "A  b c\td e")]


def brute(rows, n, percent):
    return [r[:3] for r in brute_near(rows, n, percent)]


def found(spark, rows, n=5, percent=80):
    docs = frame(spark, rows).selectExpr("doc_id", "text", "1 as row", "2 as part", "'x' as print", "3 as low")
    return sorted((tuple(r) for r in parity_join.joined(docs, n, percent).collect()), key=str)


@pytest.mark.parametrize(("n", "percent", "bounds"), [(5, 80, {}), (3, 85, {"LIST": 6, "FAMILY": 600, "FEW": 0, "HOT": 1}), (1, 60, {"LIST": 6, "HOT": 2, "FEW_HOT": 0}), (5, 80, {"MANY": 0, "HOT": 1})])
def test_links_are_those_of_all_pairs(spark, monkeypatch, n, percent, bounds):
    for k, v in bounds.items():
        monkeypatch.setattr(minhash, k, v)
    rows = near_rows(n + percent, 60, 700) + ODD
    assert found(spark, rows, n, percent) == brute(rows, n, percent)


def test_sets_without_enough_parts_meet_too(spark, monkeypatch):
    """With few parts for many tokens, parts come out even; such sets have a list of their band."""
    monkeypatch.setattr(parity_join, "PARTS_PER", 1 / 64)
    monkeypatch.setattr(parity_join, "LEAST_PARTS", 2)
    rows = near_rows(2, 40, 200) + ODD
    rows += [(2_000_000 + i, t) for i, (_, t) in enumerate(rows) if t and len(t) > 400]
    assert found(spark, rows) == brute(rows, 5, 80)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == brute(rows, 5, 80)


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_hamming_distance_bounds_the_difference():
    rng = np.random.default_rng(4)
    for size in (1, 3, 20, 130, 255, 256, 700, 5000, 20000):
        for changed in (0, 1, size // 20, size // 9):
            a = rng.integers(0, 2**63, size, np.uint64)
            b = np.concatenate([a[changed:], rng.integers(0, 2**63, changed, np.uint64)])
            n, most = np.array([size, size]), 2 * changed
            sketch = [np.unpackbits(np.frombuffer(x, np.uint8)).reshape(2, -1) for x in parity_join.folded(np.concatenate([a, b]), n)]
            assert all((x != y).sum() <= most for x, y in zip(*sketch))
            (one, two) = [set(parity_join.part_keys(x, n[:1], parity_join.band_of(n[:1]))[0].tolist()) for x in (a, b)]
            assert len(one - two) <= most and len(two - one) <= most
            rows = np.stack([np.frombuffer(x, np.uint32) for x in parity_join.folded(np.concatenate([a, b]), n)])
            if 10 * changed <= size:
                assert parity_join.Parity(80).pairs(n, rows, np.array([0]), np.array([1])).all()
            c = rng.integers(0, 2**63, size, np.uint64)
            rows = np.stack([np.frombuffer(x, np.uint32) for x in parity_join.folded(np.concatenate([a, c]), n)])
            assert size == 1 or not parity_join.Parity(80).pairs(n, rows, np.array([0]), np.array([1])).any()


def test_neighbouring_levels_compare():
    rng = np.random.default_rng(6)
    for small, large in ((250, 260), (500, 530), (1000, 1100), (230, 280)):
        a = rng.integers(0, 2**63, large, np.uint64)
        n = np.array([small, large])
        rows = np.stack([np.frombuffer(x, np.uint32) for x in parity_join.folded(np.concatenate([a[:small], a]), n)])
        for i, j in ((0, 1), (1, 0)):
            assert parity_join.Parity(80).pairs(n, rows, np.array([i]), np.array([j])).all()


def test_template_pages_meet_in_few_lists(spark, monkeypatch):
    """Pages that share half of their shingles and do not link: the pairs that are compared grow with the pages, not with their square."""
    from pyspark.sql import functions as F

    rng = random.Random(1)
    template = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join(template + [f"o{rng.random()}" for _ in range(100)])) for i in range(1200)]
    lists = parity_join.sketches(frame(spark, rows), 5, 80).where("n_shingles > 0").cache()
    entries, _ = minhash._entries(lists)
    n = entries.groupBy("list").count()
    assert (n.agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0] or 0) < 3 * len(rows)
    assert found(spark, rows[:150]) == brute(rows[:150], 5, 80)
