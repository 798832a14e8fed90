"""Scratch tables in the folder that all machines share, Bloom filters of bounded size, and row helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopline.storage import shared_dir

#: At most so many bits, 8 MB, are broadcast for a Bloom filter. A fuller filter lets more rows through; none is lost.
BLOOM_BITS = 1 << 26
_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; clean() takes it away."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(at)
    return at


def discard(spark: SparkSession, at: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    _made.remove(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard_since(spark: SparkSession, before: int) -> None:
    """Delete the scratch tables made since there were ``before`` of them, but for the last."""
    for at in _made[before:-1]:
        discard(spark, at)


def made() -> int:
    """How many scratch tables there are."""
    return len(_made)


def clean(spark: SparkSession) -> None:
    """Delete the scratch tables that this driver has made. Results that still read them must be written before."""
    while _made:
        discard(spark, _made[-1])


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and outlives lost executors."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Bytes of input, as Spark estimates them, for which a partition of text is meant.
PARTITION_BYTES = 512 << 20


def partitions(docs: DataFrame) -> int:
    """spark.sql.shuffle.partitions, or more where the tables that docs comes from are too large for so few: a partition for each PARTITION_BYTES."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    own = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, -(-size // PARTITION_BYTES)) if size < 1 << 60 else own  # rows that are no files have no size


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def _bits(keys: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    h = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(33)) & np.uint64(mask), (h >> np.uint64(5)) & np.uint64(mask)


def bloom(keys: DataFrame, n: int) -> tuple[bytes, int]:
    """A Bloom filter over the only column, a long, of ``keys`` with about ``n`` rows: (bits, mask).

    Its size follows n up to BLOOM_BITS. Partial filters are joined in 16 tasks, and those on the driver.
    """
    size = 1 << 12
    while size < min(16 * max(n, 1), BLOOM_BITS):
        size *= 2
    mask = size - 1

    def fill(batches):
        bits = np.zeros(size, bool)
        for b in batches:
            for h in _bits(b.column(0).to_numpy(zero_copy_only=False), mask):
                bits[h] = True
        if bits.any():
            yield pa.record_batch([pa.array([pa.compress(np.packbits(bits).tobytes(), "zstd", asbytes=True)], pa.binary())], ["bits"])

    def merge(batches):
        total = np.zeros(size // 8, np.uint8)
        for b in batches:
            for x in b.column("bits").to_pylist():
                total |= np.frombuffer(pa.decompress(x, size // 8, "zstd", asbytes=True), np.uint8)
        if total.any():
            yield pa.record_batch([pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())], ["bits"])

    total = np.zeros(size // 8, np.uint8)
    for row in keys.mapInArrow(fill, "bits binary").repartition(16).mapInArrow(merge, "bits binary").toLocalIterator():
        total |= np.frombuffer(pa.decompress(bytes(row[0]), size // 8, "zstd", asbytes=True), np.uint8)
    return total.tobytes(), mask


def in_bloom(filter_bits: tuple[bytes, int], keys: np.ndarray) -> np.ndarray:
    bits, mask = np.frombuffer(filter_bits[0], np.uint8), filter_bits[1]
    out = np.ones(len(keys), bool)
    for h in _bits(keys, mask):
        h = h.astype(np.int64)
        out &= (bits[h >> 3] >> (7 - (h & 7)).astype(np.uint8)) & 1 == 1
    return out


def blank(text: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))
