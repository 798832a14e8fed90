"""The pipeline stage by stage against brute force, SQL and the tokenizers library."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_pairs import brute_near, edit_distance_within

import corpus_pipeline
from hopline.llm import decontaminate, oracles
from hopline.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{at}/{name}")
        docs = out[name] = spark.read.parquet(f"{at}/{name}")
    return out


def test_shape(stages):
    names = list(stages)
    assert names[1:] == ["language_id", "minhash_near_dedup", "decontamination", "source_mixing", "token_ids"]
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1])
    counts = [stages[n].count() for n in names]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    assert counts[1] > 0.95 * counts[0]


def test_near_duplicates_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages["language_id"].collect()]
    assert sorted(r.doc_id for r in stages["minhash_near_dedup"].collect()) == sorted(i for i, _, _, kept in brute_near(rows, 5, 80) if kept)


def test_decontamination_stage(spark, stages):
    before = {r.doc_id: r.text for r in stages["minhash_near_dedup"].collect()}
    after = {r.doc_id for r in stages["decontamination"].collect()}
    clean = lambda t: decontaminate.clean(pa.array([t]))[0].tobytes().rstrip(b" ")
    bench = [(r.item_id, clean(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in clean(before[i]) for i in after for _, b in bench)
    segs = decontaminate.Segments(bench)
    for i in set(before) - after:
        assert any(edit_distance_within(s, clean(before[i])) <= e for s, e in zip(segs.text, segs.edits))


def test_mixing_stage(stages, tmp_path):
    rows = stages["decontamination"].toPandas()
    con = duckdb.connect()
    con.register("documents", rows)
    taken = con.execute(oracles.mixing()).df()
    want = Counter({int(r.doc_id): math.floor(r.taken / r.size + 0.5) for r in taken.rename(columns={"size": "n"}).assign(size=taken["size"]).itertuples() if r.size})
    assert Counter(r.doc_id for r in stages["source_mixing"].collect()) == +want


def test_token_stage(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    start, want = 0, []
    for i, t in sorted((r.doc_id, r.text) for r in stages["source_mixing"].collect()):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in stages["token_ids"].collect()) == want


def test_run_and_empty_tables(spark, tmp_path, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages["token_ids"].count()
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows and extra columns with clashing names."""
    real = spark.read.parquet(f"{SF}/documents.parquet").limit(40).selectExpr("*", "1 as id", "2 as component", "'x' as print", "3 as `rank`", "4 as `slice`", "5 as size")
    odd = spark.createDataFrame([(None, "a null id", "en", "s", 9), (7, None, None, None, None), (7, "", "de", None, 0), (8, "same words here", None, "s", 1), (8, "same words here", None, "s", 1), (9, "9 " * 9000, "fr", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.selectExpr("*", "1 as id", "2 as component", "'x' as print", "3 as `rank`", "4 as `slice`", "5 as size")
    real.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 30
    v = spark.read.parquet(f"{SF}/embeddings.parquet").limit(40).selectExpr("vec_id", "embedding", "1 as cluster", "2 as component", "3 as x", "'v' as vector")
    again = spark.createDataFrame([(None, [0.5] * 64), (7, [0.25] * 64), (7, [0.25] * 64), (8, None), (9, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    v.unionByName(again.selectExpr("*", "1 as cluster", "2 as component", "3 as x", "'v' as vector")).write.parquet(f"{tmp_path}/embeddings.parquet")
    from hopline.llm.queries import queries

    # of the vectors, op13 leaves out the null and the short one; op11 has eight rows for each but the null one
    rows = {"op11_whitening": 8 * 44, "op13_centroids": 43}
    for name, query in queries().items():
        n = query(spark, str(tmp_path)).count()
        assert n == rows.get(name, 46) or name == "op10_decontamination", name
