"""The WAV source and sink: pushed filters, ranges of long files, streams."""

import contextlib
import io
import json

import numpy as np
import pytest

from hopline.sources import wav

ROWS = "path string, sample_rate int, channels int, pcm array<smallint>"


def saved(folder, name, pcm, channels=2):
    (folder / name).write_bytes(wav.wav_bytes(np.asarray(pcm), 10, channels))


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("condition", ["start_frame >= 37", "start_frame > 40", "start_frame >= 40", "start_frame < 40", "start_frame < 41", "start_frame <= 40", "start_frame = 40", "start_frame = 41", "start_frame > -5", "start_frame < 0", "40 < start_frame and start_frame <= 80", "path like '%b.wav'", "path like '%b.wav' and start_frame = 0", "start_frame in (0, 40)", "start_frame is null", "path is not null and pcm[0] > 0"])
@pytest.mark.parametrize("options", [{}, {"splitBytes": 60}, {"firstFrame": 3, "frames": 60, "splitBytes": 100}])
def test_pushed_filters_leave_the_same_rows(spark, tmp_path, condition, options):
    wav.register(spark)
    for name, n in (("a.wav", 200), ("b.wav", 190), ("c.wav", 126)):
        saved(tmp_path, name, np.arange(n) - 50)
    df = spark.read.format("wav_pcm16").options(blockFrames=8, **options).load(str(tmp_path))
    rows = sorted(df.collect())
    want = sorted(spark.createDataFrame(rows, df.schema).where(condition).collect()) if rows else []
    assert sorted(df.where(condition).collect()) == want
    if not options:
        assert {p: sum(len(r.pcm) for r in rows if r.path.endswith(p)) for p in ("a.wav", "b.wav", "c.wav")} == {"a.wav": 200, "b.wav": 190, "c.wav": 126}


def test_filters_reach_the_source(spark, tmp_path):
    """Nothing of a pushed comparison is left to Spark, and blocks that it leaves out are not read."""
    wav.register(spark)
    saved(tmp_path, "a.wav", np.arange(400))
    df = spark.read.format("wav_pcm16").option("blockFrames", 10).load(str(tmp_path))
    assert "Filter" not in plan(df.where("start_frame >= 150")).replace("PushedFilters", "") and "Filter" in plan(df.where("sample_rate = 3"))
    blocks = wav.Blocks({"path": str(tmp_path), "blockFrames": "10"})
    assert blocks.take(wav.GreaterThanOrEqual(("start_frame",), 150)) and not blocks.take(wav.EqualTo(("sample_rate",), 3))
    assert [b.column("start_frame")[0].as_py() for t in wav._tasks(blocks.listed(), 128) for b in blocks.read(t)] == [150, 160, 170, 180, 190]


def test_tasks():
    tasks = wav._tasks([("a", 10), ("b", 300 << 20), ("c", 0), ("d", 120 << 20)], 128 << 20)
    assert [t.parts for t in tasks] == [[("b", 0, 3)], [("b", 1, 3)], [("b", 2, 3)], [("a", 0, 1), ("c", 0, 1)], [("d", 0, 1)]]
    assert wav._tasks([], 128) == []


def test_header_in_pieces(spark, tmp_path):
    """A chunk of any length before the samples is passed over, not read."""
    good = wav.wav_bytes(np.arange(20), 10, 2)
    long = good[:36] + b"LIST" + (100_000).to_bytes(4, "little") + bytes(100_000) + good[36:]
    long = long[:4] + (len(long) - 8).to_bytes(4, "little") + long[8:]
    read = []
    assert wav.read_header(lambda at, n: (read.append(n), long[at : at + n])[1], len(long)) == (10, 2, 100_052, 40)
    assert sum(read) < 100
    (tmp_path / "x.wav").write_bytes(long)
    wav.register(spark)
    assert spark.read.format("wav_pcm16").load(str(tmp_path)).first().pcm == list(range(20))


def test_bad_files(spark, tmp_path):
    wav.register(spark)
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    (tmp_path / "none.wav").write_bytes(b"")
    saved(tmp_path, "empty.wav", [])
    saved(tmp_path, "good.wav", [1, 2])
    read = spark.read.format("wav_pcm16")
    assert [r.pcm for r in read.option("onError", "skip").load(str(tmp_path)).collect()] == [[1, 2]]
    with pytest.raises(Exception, match="bad.wav: not a RIFF/WAVE file"):
        spark.read.format("wav_pcm16").load(str(tmp_path)).collect()
    for row in ((None, 10, 2, [1]), ("a/b.wav", 10, 2, [1]), ("n.wav", 10, 2, None), ("n.wav", None, 2, [1]), ("n.wav", 10, 2, [1, None])):
        with pytest.raises(Exception, match="null|plain"):
            spark.createDataFrame([row], ROWS).write.format("wav_pcm16").mode("append").save(str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").iterdir() if p.suffix == ".wav"]


def test_stream(spark, tmp_path):
    """Files that come by and by are read once each, in and out; a second run goes on where the first ended."""
    wav.register(spark)
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()

    def run():
        stream = spark.readStream.format("wav_pcm16").load(str(source))
        doubled = stream.selectExpr("replace(element_at(split(path, '/'), -1), 'capture', 'result') as path", "sample_rate", "channels", "transform(pcm, v -> cast(2 * v as smallint)) as pcm")
        q = doubled.writeStream.format("wav_pcm16").option("checkpointLocation", str(state)).start(str(out))
        q.processAllAvailable()
        q.stop()

    for numbers in ((0, 1, 2), (5, 7)):
        for n in numbers:
            saved(source, f"capture-{n:08}.wav", [n, -n])
        saved(source, "other.wav", [9, 9])
        run()
    got = {p.name: wav.np.frombuffer(p.read_bytes()[44:], "<i2").tolist() for p in out.glob("*.wav")}
    assert got == {f"result-{n:08}.wav": [2 * n, -2 * n] for n in (0, 1, 2, 5, 7)}
    notes = [json.loads(p.read_text()) for p in (out / "_batches").iterdir()]
    assert sorted(f for x in notes for f in x["files"]) == sorted(got) and not list(out.glob("*.part"))


def test_a_batch_run_again(tmp_path):
    """Before its note a batch is renamed again, after it its files are dropped."""
    import pyarrow as pa

    sink = wav.StreamWriter({"path": str(tmp_path)})
    batch = lambda v: sink.write([pa.RecordBatch.from_arrays([pa.array(["r.wav"]), pa.array([10], pa.int32()), pa.array([1], pa.int32()), pa.array([[v]], pa.list_(pa.int16()))], ["path", "sample_rate", "channels", "pcm"])])
    value = lambda: np.frombuffer((tmp_path / "r.wav").read_bytes()[44:], "<i2").tolist()
    sink.sink.publish([batch(1)])
    sink.commit([batch(2), None], 4)
    assert value() == [2]
    sink.commit([batch(3)], 4)
    assert value() == [2]
    sink.abort([batch(5)], 5)
    assert value() == [2] and not list(tmp_path.glob("*.part"))
    sink.commit([batch(6)], 5)
    assert value() == [6]
