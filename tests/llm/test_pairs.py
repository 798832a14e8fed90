"""Operators 2, 9 and 10 against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from hopline.llm import components, decontaminate, line_dedup, minhash, textvec

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


# --- lines


def print64(t):
    import xxhash

    return int(np.array(xxhash.xxh64_intdigest(t.encode()), np.uint64).view(np.int64))


def brute_lines(rows):
    docs = [(2**63 - 1 if i is None else i, t or "") for i, t in rows]
    lines = sorted({(i, print64(t), p, tuple(x.encode().split())) for i, t in docs for p, x in enumerate(t.split("\n")) if x.encode().split()})
    kept = {}
    first = {}
    for i, h, p, w in lines:
        first.setdefault(w, (i, h, p))
    order = sorted(first.items(), key=lambda kv: kv[1])
    gone = set()
    for k, (w, _) in enumerate(order):
        if len(w) >= 6 and any(len(v) >= 6 and line_dedup.within_one(list(v), list(w)) for v, _ in order[:k]):
            gone.add(w)
    for w, spot in order:
        if w not in gone:
            kept.setdefault(spot[:2], []).append(spot[2])
    out = []
    for (i, t), (doc_id, _) in zip(docs, rows):
        n = sum(bool(x.encode().split()) for x in t.split("\n"))
        k = sorted(kept.get((i, print64(t)), []))
        out.append((doc_id, n, n - len(k), ",".join(map(str, k))))
    return sorted(out, key=str)


def test_lines_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in line_dedup.deduplicated(frame(spark, rows)).collect()), key=str)
    assert got == brute_lines(rows)


@pytest.mark.parametrize("limit", [None, 100])
def test_lines(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(line_dedup, "chunks", lambda batches: textvec.chunks(batches, limit=limit))
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)] + ["é", "aa"]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 14))] for _ in range(25)]
    rows = [(None, "x y z a b c d"), (5, None), (5, ""), (6, "\n\n \n"), (7, "a a b c d e f\na b c d e f\na x b c d e f"), (7, "short one"), (9, "short one"), (9, "short two"), (9, "short two")]
    for i in range(50):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w) + 1)
                op = rng.random()
                if op < 0.4:
                    w.insert(k, rng.choice(vocab))
                elif k < len(w) and len(w) > 1:
                    w[k : k + 1] = [] if op < 0.7 else [rng.choice(vocab)]
            lines.append(rng.choice([" ", "  "]).join(w))
        rows.append((rng.randint(0, 100), "\n".join(lines)))
    got = sorted((tuple(r) for r in line_dedup.deduplicated(frame(spark, rows)).collect()), key=str)
    assert got == brute_lines(rows)
    texts = {(r.doc_id, r.text) for r in line_dedup.without_repeats(frame(spark, [(1, "a\nb\n\na"), (2, "b\nc"), (3, None)])).collect()}
    assert texts == {(1, "a\nb\n"), (2, "c"), (3, None)}
    assert line_dedup.deduplicated(frame(spark, [])).count() == 0


# --- near duplicates


def shingles(text, n):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_near(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = root(ids[a]), root(ids[b])
                up[max(x, y)] = min(x, y)
    real = lambda i: None if i == 2**63 - 1 else i
    return sorted(((real(i), len(s), real(root(i)), root(i) == i) for i, s in zip(ids, sets)), key=str)


def near_rows(seed, docs, length):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)] + ["É", "A"]
    common = [rng.choice(vocab) for _ in range(12)]
    rows = []
    for _ in range(docs):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, length))]
        if rng.random() < 0.5:
            base = common + base
        for _ in range(rng.choice([1, 1, 2, 8])):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((rng.randint(0, 10**6), " ".join(w) if rng.random() < 0.7 else "\n".join(w).upper()))
    return rows


@pytest.mark.parametrize(("n", "percent", "bounds"), [(3, 85, {}), (5, 80, {"LIST": 6, "FAMILY": 600, "FEW": 0, "HOT": 1}), (3, 85, {"LIST": 6, "HOT": 2, "FEW_HOT": 0})])
def test_near_duplicates(spark, monkeypatch, n, percent, bounds):
    for k, v in bounds.items():
        monkeypatch.setattr(minhash, k, v)
    rows = near_rows(n, 60, 150) + [(None, "null id text here"), (5, None), (6, " \n"), (7, "one"), (8, "ONE"), (8, "two words"), (9, "two  Words"), (8, "two words")]
    got = sorted((tuple(r) for r in minhash.near_duplicates(frame(spark, rows), n, percent).collect()), key=str)
    assert got == brute_near(rows, n, percent)


def test_near_duplicates_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in minhash.near_duplicates(frame(spark, rows), 3, 85).collect()), key=str)
    assert got == brute_near(rows, 3, 85)


def test_one_of_each(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None), (4, "x"), (4, "x"), (None, "q")]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "'k' as id", "1 as component")
    got = minhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == sorted([(1, "a b c d e f"), (3, None), (4, "x"), (None, "q")], key=str)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_large_lists_search():
    rng = np.random.default_rng(2)
    base = np.sort(rng.integers(0, 2**32 - 2, 64).astype(np.uint32))
    rows = [base]
    for _ in range(300):
        x = base.copy()
        x[rng.integers(1, 64, 3)] = rng.integers(0, 2**32 - 2, 3)
        rows.append(np.sort(x))
    rows += [np.sort(np.append(rng.integers(0, 2**32 - 2, 63).astype(np.uint32), base[0])) for _ in range(200)]
    forest = minhash.list_candidates(np.full(501, 500), np.stack(rows), 85, 64)
    assert len({forest.root(i) for i in range(301)}) == 1
    assert len({forest.root(i) for i in range(501)}) == 201


@pytest.mark.parametrize("seed", range(8))
def test_families_equal_all_pairs(seed):
    rng = random.Random(seed)
    rows = []
    common = [f"c{i}" for i in range(rng.randint(0, 80))]
    for _ in range(rng.randint(1, 8)):
        base = common + [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 6) if w else 0):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 30)}"
            rows.append(" ".join(w) or "one")
    for n, percent in ((3, 85), (5, 80), (1, 60)):
        values, cut = minhash.shingle_sets(pa.array(rows), n)
        sets = [set(values[a:b].tolist()) for a, b in zip(cut[:-1], cut[1:])]
        want = minhash.Forest(len(rows))
        for i in range(len(rows)):
            for j in range(i):
                k = len(sets[i] & sets[j])
                if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                    want.join(i, j)
        got = minhash.family_links(pa.array(rows), n, percent)
        assert [got.root(i) for i in range(len(rows))] == [want.root(i) for i in range(len(rows))]


def test_rare_values_meet_without_the_common_ones(spark):
    """Pages that share a quarter of their shingles enter no common list; near copies among them do."""
    rng = random.Random(8)
    template = [f"t{i}" for i in range(250)]
    own = [[f"o{i}x{j}" for j in range(750)] for i in range(120)]
    rows = [(i, " ".join(template + w)) for i, w in enumerate(own)] + [(1000 + i, " ".join(template + own[i] + [f"z{rng.random()}"])) for i in range(0, 120, 2)]
    nodes = minhash.sketches(minhash._rows(frame(spark, rows)).withColumnRenamed("id", "doc_id"), 3, percent=85).drop("print").selectExpr("*", "0 as part").cache()
    entries, _ = minhash._entries(nodes)
    assert entries.groupBy("list").count().agg({"count": "max"}).first()[0] <= 40
    got = {(r.a, r.b) for r in minhash.candidates(nodes, 85, minhash.Estimates(85, minhash.K)).collect()}
    assert got == {(1000 + i, i) for i in range(0, 120, 2)}


def test_template_pages_meet_in_few_lists(spark):
    """Pages with Jaccard about one half, which do not link: most have enough values of their own and enter no common list."""
    from pyspark.sql import functions as F

    rng = random.Random(2)
    template = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join(template + [f"o{rng.random()}" for _ in range(100)])) for i in range(1200)]
    nodes = minhash.sketches(minhash._rows(frame(spark, rows)).withColumnRenamed("id", "doc_id"), 3, percent=85).selectExpr("*", "0 as part").cache()
    entries, _ = minhash._entries(nodes)
    scored = entries.groupBy("list").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0] or 0
    assert scored < 0.05 * len(rows) * (len(rows) - 1) / 2


def test_prefix_of_rare_values():
    assert minhash._overlap(85, 32) == 12 and minhash._overlap(80, 32) == 10
    assert minhash.prefix_length(np.array([1, 2, 10, 32]), 85, 32).tolist() == [1, 1, 2, 21]
    assert minhash.prefix_length(np.array([100, 217, 218, 256]), 85, 256).tolist() == [16, 33, 218 - minhash._overlap(85, 256) + 1, 256 - minhash._overlap(85, 256) + 1]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}
    root = lambda i: i if up.setdefault(i, i) == i else root(up[i])
    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {(r.node, r.root) for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, root(i)) for i in list(up) if root(i) != i}


# --- benchmark passages


def edit_distance_within(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_banded():
    rng = random.Random(4)
    for _ in range(100):
        m, extra, n = rng.randint(1, 40), rng.randint(0, 6), 5
        p = np.array([[ord(rng.choice("abc")) for _ in range(m)] for _ in range(n)], np.uint8)
        t = np.array([[ord(rng.choice("abc")) for _ in range(m + extra)] for _ in range(n)], np.uint8)
        t[:2, :m] = p[:2]
        got, _ = decontaminate.banded(p, t, 99)
        for x, y, e in zip(p, t, got):
            free = edit_distance_within(x.tobytes(), y.tobytes())
            assert e >= free and (e == free or free > 0)
        assert (got[:2] == 0).all()


def planted(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "straße", "tion"] + ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(120)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(i, say(rng.randint(8, 50))) for i in range(25)] + [(25, None), (26, "")]
    docs = []
    for i in range(120):
        text = say(rng.randint(0, 150))
        if rng.random() < 0.5:
            item = rng.choice(bench[:25])[1]
            chars = list(item)
            for _ in range(rng.randint(0, len(item) // 8)):
                k = rng.randrange(len(chars))
                chars[k : k + 1] = rng.choice([[], [rng.choice("xyz")], [chars[k], "q"]])
            text = f"{text} {''.join(chars).upper() if rng.random() < 0.3 else ''.join(chars)}\n {say(rng.randint(0, 60))}"
        docs.append((i, text))
    return bench, [*docs, (None, bench[0][1]), (7, None), (7, "")]


def test_decontamination_equals_brute_force(spark, monkeypatch):
    bench, docs = planted(6)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1500)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.hits(frame(spark, docs), b).collect()}
    segs = decontaminate.Segments([(i, decontaminate.clean(pa.array([t]))[0].tobytes().rstrip(b" ")) for i, t in bench if t])
    want = {}
    for i, t in docs:
        text = decontaminate.clean(pa.array([t or ""]))[0].tobytes()
        for s, item in enumerate(segs.item):
            e = edit_distance_within(segs.text[s], text) if text else 99
            if e <= segs.edits[s]:
                want[i, item] = min(want.get((i, item), 99), e)
    assert got == {(i, j, e) for (i, j), e in want.items()}
    assert len(got) > 30
    left = decontaminate.uncontaminated(frame(spark, docs).selectExpr("*", "1 as held"), b)
    assert sorted([r.doc_id for r in left.collect()], key=str) == sorted([i for i, _ in docs if i not in {g[0] for g in got}], key=str)
    assert decontaminate.hits(frame(spark, []), b).count() == decontaminate.hits(frame(spark, docs), b.where("false")).count() == 0


def test_decontamination_finds_short_items_as_whole_words(spark):
    b = spark.createDataFrame([(1, "What is  Pi?"), (2, "what is pi?"), (3, "a b c d e"), (4, "overlong"), (5, "tiny"), (6, "Straße 1 of 2")], "item_id long, text string")
    docs = [(1, "What\nis pi? "), (2, "so what is pi? what is pi?"), (3, "somewhat is pi?"), (4, "what is pit?"), (5, "x a b c d e"), (6, "a b c d ex"), (7, "an overlong tale"), (8, "overlonger"), (9, "tiny"), (10, "x " * 9), (11, None), (12, "in straße 1 of 2")]
    got = {tuple(r) for r in decontaminate.hits(frame(spark, docs), b).collect()}
    assert got == {(9, 5, 0, 0, 4, 0, 4), (1, 1, 0, 0, 11, 0, 11), (1, 2, 0, 0, 11, 0, 11), (2, 1, 0, 0, 11, 3, 11), (2, 2, 0, 0, 11, 3, 11), (5, 3, 0, 0, 9, 2, 9), (7, 4, 0, 0, 8, 3, 8), (12, 6, 0, 0, 14, 3, 14)}
    assert sorted(r.doc_id for r in decontaminate.uncontaminated(frame(spark, docs), b).collect()) == [3, 4, 6, 8, 10, 11]
