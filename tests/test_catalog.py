"""Every query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from hopline.plans import bindings, catalog, songs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if pd.isna(x) else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_stream_windows_equal_closed_batch_windows(spark):
    from pyspark.sql import functions as F

    got = {(r.start, r.n) for r in catalog.queries()["stream_windows"](spark, SF).collect()}
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {(r.w.start, r["count"]) for r in e.groupBy(F.window("ts", "12 hours", "3 hours").alias("w")).count().collect()}
    assert got <= batch and len(batch) - len(got) <= 6


def test_song_assembly_reads_whole_blocks(spark):
    """A hop's frames 8 to 23 are its block's own; the 8 after them only fade into the next hop."""
    blocks = bindings.blocks(spark, SF).toPandas().sort_values("vec_id")
    own = {label: [list(x) for x in g.pcm] for label, g in blocks.groupby("label")}
    assert {len(x) for x in blocks.pcm} == {64}
    found = [r for r in songs.assembled(spark, SF).collect() if r.reason is None]
    assert len(found) == sum(len(x) // 4 for x in own.values()) > 0
    for r in found:
        hops = own[r.label][(r.revision - 1) * 4 : r.revision * 4]
        sound = [v for i, v in enumerate(r.pcm) if i // 2 % 2 == 0]  # the first of two stems
        assert len(sound) == 4 * 48
        for i, pcm in enumerate(hops):
            assert sound[i * 48 + 16 : i * 48 + 48] == pcm[16:48]


def test_entry_runs_without_the_llm_package(spark):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['hopline.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'sliding_full_windows' in e.queries() and not any(k.startswith('op') for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_every_damaged_packet_is_refused(spark, tmp_path):
    """Even ids from 21760 to 22014, of every 32768, give packets that hold 0x55 where the damage is done."""
    ids = [*range(21750, 22030), *range(32768 * 9 + 21750, 32768 * 9 + 21780)]
    spark.createDataFrame([(i,) for i in ids], "event_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = c.execute(catalog.oracle_sql()["packet_roundtrip"]).df()
    assert rows_of(catalog.queries()["packet_roundtrip"](spark, str(tmp_path)).toPandas()) == rows_of(want)
