"""Operators 1, 3, 4, 5, 6 and 7 against brute force, SQL or held-out labels."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from hopline.llm import fingerprints, language_id, license_scan, oracles, queries, sharding, source_mixing, token_ids

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "a", "Hello  World\t's 12 x!!\n\n q", "Déjà vu — naïve ½ " * 3, "日本語のテキスト mixed with latin", "tab\x1c\x1dsep\x85nel", "x " * 5000, "<|endoftext|> plain", "two<|endoftext|><|endoftext|>\n in one", "<|endoftext", "  lead and trail  \n"]


def frame(spark, rows, columns="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], columns)


def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_token_ids_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = table(spark).select("doc_id", "text").toPandas()
    rows = [(int(i), t, None, None) for i, t in zip(docs.doc_id, docs.text)] + [(1000 + i, t, None, None) for i, t in enumerate(TEXTS)] + [(1003, TEXTS[3], None, None)]
    tok = Tokenizer.from_file(queries.vocabulary())
    expected, start = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_ids.encoded(frame(spark, rows), queries.vocabulary(), f"file://{tmp_path}/out", length=64).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_token_ids_empty_table(spark, tmp_path):
    assert token_ids.encoded(frame(spark, []), queries.vocabulary(), f"file://{tmp_path}/out").count() == 0


@pytest.mark.parametrize(("name", "memo"), [("byte_bpe_50k.json", 1 << 20), ("byte_bpe_50k.json", 100), ("word_bpe_49k.json", 100)])
def test_encoder_by_piece_and_whole(monkeypatch, name, memo):
    monkeypatch.setattr(token_ids, "CHARS", 70)
    monkeypatch.setattr(token_ids, "PIECES", 7)
    monkeypatch.setattr(token_ids, "MEMO", memo)
    enc = token_ids.Encoder(queries.vocabulary(name))
    rng = np.random.default_rng(1)
    letters = list("aé ñ Ü1½ \n\t.,'s'll\xa0-’Ωж​")
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(letters, 60)) for _ in range(300)]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary(name))
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert enc.by_piece == (name == "byte_bpe_50k.json")


def test_encoder_keeps_many_words_in_little_memory(monkeypatch):
    """20,000 words fit into a megabyte, so the model is not asked for them again; runs of white space and long words are cut like the library cuts them."""
    from types import SimpleNamespace

    monkeypatch.setattr(token_ids, "MEMO", 1 << 20)
    enc = token_ids.Encoder(queries.vocabulary())
    library, asked = enc.tokenizer, []
    enc.tokenizer = SimpleNamespace(model=SimpleNamespace(tokenize=lambda p: asked.append(p) or library.model.tokenize(p)), encode_batch_fast=library.encode_batch_fast)
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("abcdefgé"), 7)) for _ in range(20_000)})
    texts = [" ".join(words[i::10]) for i in range(10)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for again in (False, True):
        asked.clear()
        assert [np.frombuffer(enc([t])[0], enc.dtype).tolist() for t in texts] == want
        assert len(asked) == (0 if again else len(words))
    monkeypatch.setattr(token_ids, "CHARS", 70)
    monkeypatch.setattr(token_ids, "PIECES", 7)
    texts = ["if x:\n    y = 1 \n\n  \t z  ", "   a    b\xa0  c \xa0d", " ", "  ", "a,b;" * 60 + " end " + "é1" * 90, "\n \n", "\0 \1 a"]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_language_held_out_accuracy(spark):
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/documents.parquet")[["doc_id", "lang"]])
    assert len(got) == 1000 and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all() and 100 < len(held) < 300
    assert (held.lang == held.lang_pred).mean() > 0.95


def test_language_filters_against_plain_sets():
    """The bit-sliced table against a set of slots for each language, gram by gram in plain Python."""
    rng = np.random.default_rng(5)
    names = ["aa", "bb", "cc"]
    own = [rng.choice(np.arange(97, 123), (40, 3)) for _ in names]
    code = lambda g: (int(g[0]) << 42) | (int(g[1]) << 21) | int(g[2])
    slots = 1 << 9
    mask = (1 << 64) - 1

    def places(gram):
        out = []
        for seed in language_id._SEEDS[: language_id.HASHES].tolist():
            h = gram * seed & mask
            for _ in range(2):
                h = (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 & mask
            out.append((h ^ (h >> 32)) >> (64 - 9))
        return out

    filled = [{p for g in grams for p in places(code(g))} for grams in own]
    table = np.zeros((1, slots), np.uint64)
    for bit, used in enumerate(filled):
        table[0, list(used)] |= np.uint64(1 << bit)
    rates = [(len(x) / slots) ** language_id.HASHES for x in filled]
    model = language_id.Model(names, table, np.array(rates))
    words = ["".join(map(chr, g)) for grams in own for g in grams]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(60)] + ["", "1 2", "q", None]
    best, score = language_id.scores(model, pa.array(texts))
    for text, b, s in zip(texts, best.tolist(), score.tolist()):
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        line = " ".join(letters.split()) + " " if letters.strip() else ""
        grams = [code([ord(c) for c in line[i : i + 3]]) for i in range(len(line) - 2)]
        counts = [max(0.0, (sum(all(p in used for p in places(g)) for g in grams) - len(grams) * r) / (1 - r)) for used, r in zip(filled, rates)]
        if not letters.strip():
            assert (b, s) == (-1, 0.0)
        elif max(counts) > 0:
            assert abs(counts[b] - max(counts)) < 1e-9 and abs(s - min(1.0, max(counts) / len(grams))) < 1e-9


def test_language_edges(spark):
    train = frame(spark, [(i, t, g, None) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)])
    model = language_id.fit(train)
    docs = frame(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "the dog and cat"), (5, "die katze und"), (None, "q"), (4, "the dog and cat")])
    got = {(r.doc_id, r.lang_pred) for r in language_id.predicted(docs, model).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (None, "de")}
    assert {r.lang_pred for r in language_id.predicted(docs, language_id.fit(train.where("false"))).collect()} == {"und"}
    assert language_id.predicted(docs.where("false"), model).count() == 0
    assert {r.doc_id for r in language_id.accepted(docs, model, 0.1).collect()} == {4, 5}


def test_language_learns_every_label(spark):
    """70 languages of an alphabet each; the last 6 by frequency and name are past one word of bits."""
    def text(i, shift):
        return " ".join("".join(chr(0x4E00 + 40 * i + (k + shift + j) % 20) for j in range(4)) for k in range(20))

    rows = [(i * 10 + r, text(i, r), f"l{i:02}", None) for i in range(70) for r in range(3 if i >= 64 else 4)]
    train = frame(spark, rows)
    model = language_id.fit(train)
    assert model.languages == [f"l{i:02}" for i in range(70)]
    docs = frame(spark, [(i, text(i, 7)) for i in range(70)])
    assert {(r.doc_id, r.lang_pred) for r in language_id.predicted(docs, model).collect()} == {(i, f"l{i:02}") for i in range(70)}
    assert language_id.accepted(docs, model, 0.3).count() == 70


def rows_of(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted([tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False)])


@pytest.mark.parametrize("name", ["op4_source_mixing", "op5_sharding", "op6_license_scan"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert rows_of(queries.queries()[name](spark, SF).toPandas()) == rows_of(con.execute(queries.oracle_sql()[name]).df())


def test_mixing_sql_with_sources_taken_exactly(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "SLOTS", 1 << 11)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.op4_source_mixing(spark, SF).toPandas()
    assert rows_of(got) == rows_of(con.execute(oracles.mixing()).df())
    assert source_mixing.targets(source_mixing.mix(table(spark)).selectExpr("source", "size")).where("exact").count() > 0


EDGES = [(None, None), (1, ""), (2, "a b c"), (2, "a b c"), (2, "other"), (3, "word " * 3000), (4, "x")]


def test_mixing_edges(spark):
    docs = frame(spark, [(i, t, None, s) for (i, t), s in zip(EDGES, [None, "b", "b", "b", None, "c", "a"])])
    got = source_mixing.mix(docs).toPandas()
    assert len(got) == len(EDGES) and (got.taken <= 2 * got["size"]).all()
    per = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (per.target <= 2 * per["size"] + 1e-9).all()
    assert abs(per.target.sum() - 1.5 * per["size"].sum()) < 1e-6
    assert source_mixing.mix(docs.where("false")).count() == 0
    again = source_mixing.mix(docs).toPandas()
    assert rows_of(got) == rows_of(again)
    assert set(source_mixing.mixed(docs).columns) == set(docs.columns)


def test_mixing_comes_near_targets(spark):
    got = source_mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    per = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(per.taken - per.target) / per.target).max() < 0.02


def test_mixing_rare_sources_meet_targets_in_a_large_mix(spark, monkeypatch):
    """With few slots a small table has the blocks of a large mix: 147 words here, where the rare sources have 60 to 500."""
    monkeypatch.setattr(source_mixing, "SLOTS", 1 << 11)
    rows = [(i, "w " * 1000, None, "bulk") for i in range(100)] + [(100 + i, "w " * 1000, None, "more") for i in range(100)]
    rows += [(1000, "one " * 500, None, "rare a"), (1001, "one " * 151, None, "rare b"), *[(1100 + i, "one " * 20, None, "rare c") for i in range(3)], (1200, "", None, "rare d"), (1201, None, None, None)]
    got = source_mixing.mix(frame(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    per = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    rare = per[per.index.str.startswith("rare")]
    assert set(rare.target[rare.target > 0]) == {1000.0, 302.0, 120.0}
    assert (rare.taken == rare.target).all()
    assert (abs(per.taken - per.target) <= 0.02 * per.target).all()


def test_sharding_fits_and_splits_equal_rows(spark):
    docs = frame(spark, [*EDGES, *[(9, "same text")] * 50, *[(100 + i, "t" * 7) for i in range(200)]])
    got = sharding.shards(docs, 100).toPandas()
    assert len(got) == 257
    per = got.groupby("shard").agg(bytes=("n_bytes", "sum"), said=("shard_bytes", "first"), n=("n_bytes", "size"))
    assert (per.bytes == per.said).all() and ((per.bytes <= 100) | (per.n == 1)).all()
    assert sharding.shards(docs.where("false"), 100).count() == 0


def test_written_shards_hold_each_row_once(spark, tmp_path):
    rows = [*EDGES, *[(9, "same text")] * 50, (None, "null id"), (5, None), (5, "five")]
    docs = frame(spark, rows).selectExpr("*", "'mine' as shard", "text as `a.b`", "1 as depth")
    sharding.write_shards(docs, f"file://{tmp_path}/shards", 100)
    got = spark.read.option("basePath", f"file://{tmp_path}/shards").parquet(f"file://{tmp_path}/shards")
    assert got.columns == [*docs.columns, "_hl_shard"]
    assert sorted([tuple(r)[:-1] for r in got.collect()], key=str) == sorted([tuple(r) for r in docs.collect()], key=str)
    per = got.groupby("_hl_shard").agg({"*": "count", "text": "max"}).toPandas()
    assert len(per) > 5


def test_license_edges(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "UNDER the MIT-License! x cc by nc"), (3, "UNDER the MIT-License! x cc by nc"), (4, "this work is licensed under the brand new gnu general public license version 3"), (5, "cc by nc " * 400), (6, "under mit")])
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license_scan.scan(docs).collect()}
    assert {x for x in got if x[0] != 4} == {(1, 0, 0, None, None, "", ""), (2, 0, 0, None, None, "", ""), (3, 8, 2, 0, 5, "cc-by-nc,mit", "cc-by-nc,mit"), (5, 1200, 400, 0, 1197, "cc-by-nc", "cc-by-nc"), (6, 2, 0, None, None, "", "")}
    four = next(x for x in got if x[0] == 4)
    assert four[2] == 0 and "gpl-3" in four[6].split(",")
    assert license_scan.scan(docs.where("false")).count() == 0


def test_license_texts_of_any_length(spark):
    """A whole licence, one with words put in, half of one, and a notice among runs that stray near its diagonal."""
    mit = license_scan.TEXTS[0][0]
    bsd = license_scan.TEXTS[2][0].split()
    loose = bsd[:40] + ["by", "the", "way"] + bsd[40:90] + bsd[92:]
    chain = "the license the license you may not use this file " * 30 + "licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. " + "in compliance with the license you may not " * 30
    rows = [(1, mit.upper()), (2, " ".join(loose)), (3, " ".join(bsd[: len(bsd) // 3])), (4, chain), (5, " ".join(license_scan.TEXTS[3][0].split()[::-1]))]
    got = {r.doc_id: (r.labels.split(","), r.score) for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got[1] == (["mit"], 1.0)
    assert got[2][0] == ["bsd"] and got[2][1] == 1.0
    assert got[3][0] == ["bsd"]  # by the notice; a third of the text is not the text
    assert "apache-2" in got[4][0]
    assert got[5] == ([""], got[5][1]) and got[5][1] < license_scan.COVER


def test_license_time_follows_length(spark):
    import time

    took = []
    for n in (10_000, 40_000):
        docs = frame(spark, [(1, "some words under the mit license " * (n // 6))]).coalesce(1)
        license_scan.scan(docs).collect()
        t = time.perf_counter()
        license_scan.scan(docs).collect()
        took.append(time.perf_counter() - t)
    assert took[1] < 4 * took[0] + 4


def test_fingerprints_against_brute_force(spark):
    rows = [(i, t, None, None) for i, t in enumerate(TEXTS)] + [(-5, "Hello world 's 12 X!! q", None, None), (None, "last", None, None), (3, "again", None, None)]
    got = fingerprints.compared(frame(spark, rows)).toPandas()
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1]))
    expected = {}
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        n, h = len(t), len(t) // 2
        e = t[: n - h] + u[:h]
        f = [fingerprints.digest(fingerprints.canonical(x)) for x in (t, e, u)]
        expected.setdefault(i, []).append((n, hashlib.sha256(e.encode()).hexdigest(), f[0], f[1], float(f[0] == f[1]), float(f[0] == f[2])))
    found = {}
    for r in got.itertuples(index=False):
        found.setdefault(None if pd.isna(r.doc_id) else int(r.doc_id), []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    assert found[-5][0][2] == found[3][0][2] or found[-5][0][2] == found[3][1][2]


def test_fingerprints_extend_collided_digests(spark):
    """A digest of the length alone collides for unlike texts; equal ones keep a common fingerprint."""
    weak = lambda form: f"{len(form) % 3:032x}"
    rows = [(i, t) for i, t in enumerate(["abc", "ABC ", "xyz", "four", "5", None, "abc", "none else is as long"])]
    docs = frame(spark, rows)
    wide = lambda t: hashlib.sha256(fingerprints.canonical(t or "")).hexdigest()
    of: dict = {}
    for _, t in rows:
        of.setdefault(weak(fingerprints.canonical(t or "")), set()).add(wide(t))
    expected = {i: (d := weak(fingerprints.canonical(t or ""))) + (f"-{wide(t)}" if len(of[d]) > 1 else "") for i, t in rows}
    got = fingerprints.compared(docs, weak).collect()
    assert {r.doc_id: r.fingerprint for r in got} == expected and len(set(expected.values())) == 6
    assert {f for f, n in of.items() if len(n) > 1} == {r.fingerprint for r in fingerprints.collisions(docs, fingerprints.fingerprints(docs, weak).select("fingerprint"), weak).collect()}
    texts = dict(rows)
    after = {i: i - 1 if i else len(rows) - 1 for i in texts}
    assert all(r.near_next == float(wide(texts[r.doc_id]) == wide(texts[after[r.doc_id]])) for r in got)


def test_fingerprints_edges(spark):
    docs = frame(spark, [(1, "a"), (2, "A "), (3, "b")])
    assert fingerprints.collisions(docs, fingerprints.fingerprints(docs).select("fingerprint")).count() == 0
    one = fingerprints.compared(frame(spark, [(1, "solo text")])).collect()
    assert [(r.n_chars, r.near_edited, r.near_next) for r in one] == [(9, 0.0, 1.0)]
    assert fingerprints.compared(docs.where("false")).count() == 0
    assert oracles.licenses()


CLASHES = "row hash gram place template n words bucket kind list low sketch group task weight key size rank slice shard depth lang_pred score target taken _hl print component id sha a b".split()


def test_extra_columns_with_clashing_names(spark):
    """Columns of any name change no result, and what passes rows on keeps them."""
    rows = [(i, f"{'the cat and the dog ran ' * (i + 1)} number {i}\nunder the mit license", ["en", "de"][i % 2], ["x", None][i % 2]) for i in range(12)] + [(12, None, None, None), (3, "", "en", "x")]
    plain = frame(spark, rows)
    docs = plain.selectExpr("*", *[f"'x' as {c}" for c in CLASHES])
    bench = spark.createDataFrame([(1, "the cat and the dog ran the cat and the dog ran number 0")], "item_id long, text string")
    same = lambda f: sorted(map(str, f(docs).collect())) == sorted(map(str, f(plain).collect()))
    from hopline.llm import decontaminate, line_dedup, minhash, substring_dedup

    assert same(lambda x: line_dedup.deduplicated(x))
    assert same(lambda x: language_id.predicted(x, language_id.fit(x)))
    assert same(lambda x: source_mixing.mix(x))
    assert same(lambda x: sharding.shards(x, 200))
    assert same(lambda x: license_scan.scan(x))
    assert same(lambda x: fingerprints.compared(x))
    assert same(lambda x: substring_dedup.deduplicated(x))
    assert same(lambda x: minhash.near_duplicates(x))
    assert same(lambda x: decontaminate.hits(x, bench))
    for kept in (language_id.accepted(docs, language_id.fit(docs), 0.0), minhash.one_of_each(docs), decontaminate.uncontaminated(docs, bench), source_mixing.mixed(docs)):
        assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}


def test_scratch_tables_are_cleaned(spark):
    from pathlib import Path

    from hopline.llm import _shared

    at = _shared.scratch(spark, "try")
    spark.range(3).write.parquet(at)
    assert _shared.written(spark.range(3), "try").count() == 3
    _shared.clean(spark)
    assert not Path(at.removeprefix("file://")).exists()


def test_bloom_loses_nothing(spark):
    import numpy as np

    from hopline.llm import _shared

    keys = spark.range(5000).selectExpr("xxhash64(id) as k")
    bits = _shared.bloom(keys, 5000)
    own = keys.toPandas()["k"].to_numpy()
    assert _shared.in_bloom(bits, own).all() and _shared.in_bloom(bits, own + 1).mean() < 0.1
    assert not _shared.in_bloom(_shared.bloom(keys.where("false"), 0), np.arange(9)).any()
