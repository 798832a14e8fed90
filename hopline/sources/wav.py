"""WAV files of 16-bit PCM as a Python data source: ``read``, ``write``, ``readStream`` and ``writeStream`` with ``format("wav_pcm16")``.

Reading gives path, sample_rate, channels, start_frame and pcm, a row for each ``blockFrames`` frames (65,536 unless set).
``firstFrame`` and ``frames`` read that range only; comparisons of ``path`` and ``start_frame`` with constants are pushed into the
source, which then lists no other files and seeks to the blocks that are left. A file above ``splitBytes`` (128 MB) is read by
several tasks, small files share one. Writing takes path (a file name), sample_rate, channels and pcm; each file is written under
another name and renamed at commit.

A stream takes files by the number in their names (``capture-00000012.wav``; another pattern with one group as option ``name``):
its offset is the highest number read, so a producer publishes in ascending order. A file without a number is passed over. A
stream's sink renames a micro-batch's files in the order of their names and then notes the batch under ``_batches``; a batch that
is run again after that changes nothing.

Paths are local or URIs of stores that pyarrow knows (file, hdfs, s3, gs), so a cluster reads and writes its shared store. For one
that only Spark's own readers know, ``decoded`` takes a ``binaryFile`` frame.
"""

from __future__ import annotations

import json
import operator
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from hopline.functions.rules import CAPTURE
from hopline.storage import store

SCHEMA = "path string, sample_rate int, channels int, start_frame long, pcm array<smallint>"


class WavError(ValueError):
    pass


def read_header(read: Callable[[int, int], bytes], total: int) -> tuple[int, int, int, int]:
    """(sample_rate, channels, offset of the samples, their bytes) of a RIFF/WAVE file of ``total`` bytes (SC1); ``read`` gives the bytes at a place.

    Chunks are padded to even sizes; only their heads and the format are read. Truncated files, repeated ``fmt `` or ``data``
    chunks, other encodings than 16-bit PCM and wrong block sizes are refused.
    """
    head = read(0, 12)
    if total < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise WavError("not a RIFF/WAVE file")
    if int.from_bytes(head[4:8], "little") + 8 > total:
        raise WavError("truncated file")
    at, form, sound = 12, None, None
    while at + 8 <= total:
        head = read(at, 8)
        name, size = head[:4], int.from_bytes(head[4:], "little")
        if at + 8 + size > total:
            raise WavError("truncated chunk")
        if name == b"fmt ":
            if form is not None or size < 16:
                raise WavError("bad or repeated format chunk")
            form = struct.unpack("<HHIIHH", read(at + 8, 16))
        elif name == b"data":
            if sound is not None:
                raise WavError("repeated data chunk")
            sound = (at + 8, size)
        at += 8 + size + size % 2
    if form is None or sound is None:
        raise WavError("format or data chunk is missing")
    kind, channels, rate, byte_rate, align, bits = form
    if kind != 1 or bits != 16:
        raise WavError("not 16-bit PCM")
    if channels == 0 or rate == 0 or align != 2 * channels or byte_rate != rate * align or sound[1] % align:
        raise WavError("bad block size")
    return rate, channels, *sound


def parse_header(data: bytes) -> tuple[int, int, int, int]:
    """``read_header`` of bytes in memory."""
    return read_header(lambda at, n: data[at : at + n], len(data))


def wav_bytes(pcm: np.ndarray, sample_rate: int, channels: int) -> bytes:
    """A file with a 44-byte header (SK1)."""
    sound = np.asarray(pcm, "<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(sound), b"WAVE", b"fmt ", 16, 1, channels, sample_rate, sample_rate * 2 * channels, 2 * channels, 16, b"data", len(sound))
    return head + sound


class Files(InputPartition):
    """Parts of files: (path, k, n) is the k-th of n equal ranges of a file's blocks."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        super().__init__(parts)
        self.parts = parts


def _listed(path: str) -> list[tuple[str, int]]:
    """(path in its store, size) of the WAV files under a folder, or of one file, or of those a pattern names in a folder."""
    from fnmatch import fnmatch

    from pyarrow import fs

    files, at = store(path)
    if "*" in at or "?" in at:
        folder, pattern = at.rsplit("/", 1)
        found = [f for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if fnmatch(f.base_name, pattern)]
    else:
        info = files.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else [f for f in files.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if f.path.endswith(".wav")]
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File)


SPLIT, OPEN = 128 << 20, 4 << 20


def _tasks(listed: list[tuple[str, int]], split: int) -> list[Files]:
    """Long files in ranges of at most ``split`` bytes, small ones together; a file counts 4 MB more than it has, as for Spark's own files."""
    tasks, held, size = [], [], 0
    for path, n in listed:
        if n > split:
            ranges = -(-n // split)
            tasks += [Files([(path, k, ranges)]) for k in range(ranges)]
            continue
        if held and size + n + OPEN > split:
            tasks.append(Files(held))
            held, size = [], 0
        held.append((path, 0, 1))
        size += n + OPEN
    return tasks + [Files(held)] if held else tasks


ORDER = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, EqualTo: operator.eq}
ON_PATH = {EqualTo: operator.eq, In: lambda path, all_of: path in all_of, StringStartsWith: str.startswith, StringEndsWith: str.endswith}


class Blocks:
    """Reads the blocks of files, all of them or those that pushed comparisons leave."""

    def __init__(self, options: dict):
        option = lambda name, default: options.get(name, options.get(name.lower(), default))
        self.path, self.skip = options["path"], option("onError", "") == "skip"
        self.first, self.frames = int(option("firstFrame", 0)), option("frames", None)
        self.step, self.split = int(option("blockFrames", 1 << 16)), int(option("splitBytes", SPLIT))
        self.paths: list = []
        self.starts: list = []

    def take(self, f) -> bool:
        """Whether the source itself does what the filter says."""
        column = ".".join(f.attribute) if hasattr(f, "attribute") else None
        if isinstance(f, IsNotNull) and column in ("path", "start_frame"):
            return True  # they never are
        if getattr(f, "value", None) is None and not isinstance(f, In):
            return False
        if column == "path" and type(f) in ON_PATH:
            self.paths.append((ON_PATH[type(f)], f.value))
            return True
        if column == "start_frame" and type(f) in ORDER:
            self.starts.append((type(f), f.value))
            return True
        return False

    def listed(self) -> list[tuple[str, int]]:
        return [(p, n) for p, n in _listed(self.path) if all(holds(p, v) for holds, v in self.paths)]

    def _range(self, blocks: int, k: int, n: int) -> range:
        """Numbers of the k-th part's blocks whose first frame passes."""
        low, high = blocks * k // n, blocks * (k + 1) // n
        for kind, v in self.starts:
            at, exact = divmod(v - self.first, self.step)
            if kind is EqualTo and exact:
                return range(0)
            if kind in (EqualTo, GreaterThanOrEqual, GreaterThan):
                low = max(low, at + 1 if exact or kind is GreaterThan else at)
            if kind in (EqualTo, LessThanOrEqual, LessThan):
                high = min(high, at if kind is LessThan and not exact else at + 1)
        return range(low, high)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = store(self.path)
        for path, k, n in partition.parts:
            with files.open_input_file(path) as f:
                try:
                    rate, channels, offset, length = read_header(lambda at, size, f=f: f.read_at(size, at), f.size())
                    there = length // (2 * channels)
                    wanted = there - self.first if self.frames is None else int(self.frames)
                    if self.first < 0 or wanted < 0 or self.first + wanted > there:
                        raise WavError(f"no frames {self.first} to {self.first + wanted}")
                except WavError as e:
                    if self.skip:
                        continue
                    raise WavError(f"{path}: {e}") from None
                for i in self._range(-(-wanted // self.step), k, n):
                    a = self.first + i * self.step
                    size = 2 * channels * min(self.step, self.first + wanted - a)
                    pcm = np.frombuffer(f.read_at(size, offset + 2 * channels * a), "<i2")
                    pcm = pa.ListArray.from_arrays(pa.array([0, len(pcm)], pa.int32()), pa.array(pcm))
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([rate], pa.int32()), pa.array([channels], pa.int32()), pa.array([a], pa.int64()), pcm], ["path", "sample_rate", "channels", "start_frame", "pcm"])


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.blocks = Blocks(options)

    def pushFilters(self, filters):
        return [f for f in filters if not self.blocks.take(f)]

    def partitions(self):
        return _tasks(self.blocks.listed(), self.blocks.split)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.blocks.read(partition)


class StreamReader(DataSourceStreamReader):
    """Files by the numbers in their names (SC3); a micro-batch has all that were published since the last."""

    def __init__(self, options: dict):
        self.blocks = Blocks(options)
        self.name = re.compile(options.get("name", CAPTURE))

    def _numbered(self) -> list[tuple[int, str, int]]:
        found = [(self.name.search(os.path.basename(p)), p, n) for p, n in self.blocks.listed()]
        return sorted((int(m[1]), p, n) for m, p, n in found if m)

    def initialOffset(self) -> dict:
        return {"sequence": -1}

    def latestOffset(self) -> dict:
        return {"sequence": max((k for k, _, _ in self._numbered()), default=-1)}

    def partitions(self, start: dict, end: dict):
        return _tasks([(p, n) for k, p, n in self._numbered() if start["sequence"] < k <= end["sequence"]], self.blocks.split)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.blocks.read(partition)


class Written(WriterCommitMessage):
    def __init__(self, pairs: list):
        self.pairs = pairs


class Sink:
    """Files under names of their own, which are renamed or dropped when a job ends."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, batches) -> Written:
        files, at = store(self.path)
        files.create_dir(at, recursive=True)
        pairs = []
        for b in batches:
            for i, (name, rate, channels) in enumerate(zip(*[b.column(c).to_pylist() for c in ("path", "sample_rate", "channels")])):
                pcm = b.column("pcm")[i].values
                if not name or os.path.basename(name) != name:
                    raise WavError(f"not a plain file name: {name}")
                if rate is None or channels is None or pcm is None or pcm.null_count:
                    raise WavError(f"{name}: sample_rate, channels or samples are null")
                final = f"{at.rstrip('/')}/{name}"
                own = f"{final}.{uuid.uuid4().hex}.part"
                with files.open_output_stream(own) as f:
                    f.write(wav_bytes(pcm.to_numpy(zero_copy_only=False), rate, channels))
                pairs.append((own, final))
        return Written(pairs)

    def publish(self, messages) -> list[str]:
        files, _ = store(self.path)
        pairs = sorted((p for m in messages if m for p in m.pairs), key=lambda p: p[1])
        for own, final in pairs:
            files.move(own, final)
        return [os.path.basename(final) for _, final in pairs]

    def drop(self, messages) -> None:
        from pyarrow import fs

        files, _ = store(self.path)
        for m in messages:
            for own, _ in m.pairs if m else []:
                if files.get_file_info(own).type != fs.FileType.NotFound:
                    files.delete_file(own)


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.sink = Sink(options)

    def write(self, iterator) -> Written:
        return self.sink.write(iterator)

    def commit(self, messages) -> None:
        self.sink.publish(messages)

    def abort(self, messages) -> None:
        self.sink.drop(messages)


class StreamWriter(DataSourceStreamArrowWriter):
    """Micro-batches that are published once (SK3): a batch that has its note was renamed in whole, one without is renamed again."""

    def __init__(self, options: dict):
        self.sink = Sink(options)

    def write(self, iterator) -> Written:
        return self.sink.write(iterator)

    def commit(self, messages, batchId: int) -> None:
        from pyarrow import fs

        files, at = store(self.sink.path)
        note = f"{at.rstrip('/')}/_batches/{batchId}.json"
        if files.get_file_info(note).type == fs.FileType.File:
            self.sink.drop(messages)
            return
        names = self.sink.publish(messages)
        files.create_dir(os.path.dirname(note), recursive=True)
        with files.open_output_stream(f"{note}.part") as f:
            f.write(json.dumps({"batch": batchId, "files": names}).encode())
        files.move(f"{note}.part", note)

    def abort(self, messages, batchId: int) -> None:
        self.sink.drop(messages)


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_pcm16"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets its filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavSource)


def decoded(files: DataFrame, first_frame: int = 0, frames: int | None = None) -> DataFrame:
    """path, sample_rate, channels, start_frame, pcm, error of a ``binaryFile`` frame (path, content), for stores that only Spark reads; all frames or a range (SC1, SC2).

    A bad file, or one that lacks the range, has its error and no samples.
    """

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    rate, channels, offset, length = parse_header(content)
                    there = length // (2 * channels)
                    n = there - first_frame if frames is None else frames
                    if first_frame < 0 or n < 0 or first_frame + n > there:
                        raise WavError(f"no frames {first_frame} to {first_frame + n}")
                    rows.append((path, rate, channels, first_frame, np.frombuffer(content, "<i2", n * channels, offset + 2 * channels * first_frame), None))
                except WavError as e:
                    rows.append((path, None, None, None, None, str(e)))
            types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int16()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["path", "sample_rate", "channels", "start_frame", "pcm", "error"])

    return files.select("path", "content").mapInArrow(run, f"{SCHEMA}, error string")


def encoded(blocks: DataFrame) -> DataFrame:
    """blocks (sample_rate, channels, pcm, ...) with content, a WAV file, made in the JVM."""
    from hopline.functions.binary import little_endian, packed

    n = 2 * F.size("pcm")
    head = [F.lit(b"RIFF"), little_endian(n + 36, 4), F.lit(b"WAVEfmt "), little_endian(F.lit(16), 4), little_endian(F.lit(1), 2), little_endian(F.col("channels"), 2), little_endian(F.col("sample_rate"), 4)]
    head += [little_endian(F.col("sample_rate") * 2 * F.col("channels"), 4), little_endian(2 * F.col("channels"), 2), little_endian(F.lit(16), 2), F.lit(b"data"), little_endian(n, 4), packed(F.col("pcm"))]
    return blocks.withColumn("content", F.concat(*head))
