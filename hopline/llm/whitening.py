"""Embedding whitening from a compensated covariance.

Sums and centred outer products are kept as double-doubles: a high part and the low part that rounding took from it. The
transformations are error-free: two_sum for additions; for outer products, a block of centred rows is cut into slices of BITS bits, so
that the matrix product of two slices has no rounding at all, and those exact products are added up. Tasks send one row of
high and low parts each; parts are merged in a tree, then on the driver (``TREE`` of them). The mean is a double-double too, so a
large common offset costs no digits.

The covariance (``dims`` squared numbers) is brought to tridiagonal form and solved by divide and conquer, which is what LAPACK's syevd
behind numpy.linalg.eigh does. Components are numbered by falling eigenvalue; those without variance (an eigenvalue within
rounding of 0) have no whitened values.

The fit reads ``vector`` (array<double>); all vectors there have one length and finite entries of at most 2^500. Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.llm import vectors
from hopline.llm._shared import written

#: Rows in a block, and bits of a slice: 2 * (BITS - 1) + log2(BLOCK) is at most 53.
BLOCK, BITS, SLICES = 512, 22, 4
#: Whole-number entries up to this are exact as doubles.
LARGEST = 1 << 52
_REST = (("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))
#: Merged parts that the driver gets, at most.
TREE = 16


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and what rounding took."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def plus(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-doubles."""
    high, rest = two_sum(a[0], b[0])
    low, last = two_sum(a[1], b[1])
    high, rest = two_sum(high, rest + low)
    return two_sum(high, rest + last)


def summed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the rows, half against half."""
    high, low = rows, np.zeros_like(rows)
    while len(high) > 1:
        m = len(high) // 2
        a, b = plus((high[:m], low[:m]), (high[m : 2 * m], low[m : 2 * m]))
        high, low = np.concatenate([a, high[2 * m :]]), np.concatenate([b, low[2 * m :]])
    return high[0], low[0]


def centred(rows: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return plus((rows, np.zeros_like(rows)), (-mean[0], -mean[1]))


def _slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Parts of high + low whose entries are whole multiples, by at most 2^(BITS - 1), of one power of two for each column."""
    top = np.frexp(np.abs(high).max(0))[1]
    out = []
    for i in range(SLICES):
        cut = np.ldexp(1.5, top - i * BITS + 53 - BITS)
        part = (high + cut) - cut
        out.append(part)
        high, low = two_sum(high - part, low)
    return out


def outer(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the rows' outer products with themselves."""
    s = _slices(high, low)
    total = (np.zeros((high.shape[1],) * 2),) * 2
    for i in range(SLICES):
        for j in range(i, SLICES - i):
            exact = s[i].T @ s[j]
            total = plus(total, (exact, np.zeros_like(exact)))
            if i != j:
                total = plus(total, (exact.T, np.zeros_like(exact)))
    return total


def _added(vectors_of: DataFrame, block) -> tuple[int, tuple[np.ndarray, np.ndarray]] | None:
    """(rows, sum) of block(rows) -> double-double over all blocks of the column ``vector``."""
    kind = "n long, high array<double>, low array<double>"

    def batch_of(n, total):
        return pa.RecordBatch.from_arrays([pa.array([n]), *[vectors.lists(x.reshape(1, -1), pa.float64()) for x in total]], ["n", "high", "low"])

    def parts(batches):
        n, total = 0, None
        for batch in batches:
            x = vectors.matrix(batch.column("vector")) if batch.num_rows else np.zeros((0, 0))
            for at in range(0, len(x), BLOCK):
                one = block(x[at : at + BLOCK])
                n, total = n + len(x[at : at + BLOCK]), one if total is None else plus(total, one)
        if n:
            yield batch_of(n, total)

    def merged(batches):
        n, total = 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                one = tuple(vectors.matrix(batch.column(c).slice(i, 1))[0] for c in ("high", "low"))
                n, total = n + batch.column("n")[i].as_py(), one if total is None else plus(total, one)
        if n:
            yield batch_of(n, total)

    n, total = 0, None
    for r in vectors_of.select("vector").mapInArrow(parts, kind).repartition(TREE).mapInArrow(merged, kind).collect():
        one = np.array(r.high), np.array(r.low)
        n, total = n + r.n, one if total is None else plus(total, one)
    return (n, total) if n else None


@dataclass(frozen=True)
class Whitening:
    n: int
    #: Exact sums of the entries, by dimension.
    sums: list[Fraction]
    covariance: np.ndarray
    #: Of the kept components that have variance, by falling eigenvalue; a column of ``directions`` is a unit eigenvector.
    values: np.ndarray
    directions: np.ndarray

    @property
    def explained(self) -> list[float]:
        return (self.values / np.trace(self.covariance)).tolist()


def covariance(table: DataFrame) -> tuple[int, list[Fraction], np.ndarray] | None:
    """(n, sums, covariance with divisor n) of the column ``vector``; None without rows."""
    found = _added(table, summed)
    if not found:
        return None
    n, (high, low) = found
    sums = [Fraction(a) + Fraction(b) for a, b in zip(high.tolist(), low.tolist())]
    first = np.array([float(s / n) for s in sums])
    mean = first, np.array([float(s / n - Fraction(m)) for s, m in zip(sums, first.tolist())])
    _, (high, low) = _added(table, lambda rows: outer(*centred(rows, mean)))
    return n, sums, ((high + low) / n).reshape(len(sums), -1)


def fit(table: DataFrame, components: int) -> Whitening | None:
    """The model of the column ``vector`` (array<double>), with so many components; None without rows."""
    found = covariance(table)
    if not found:
        return None
    n, sums, v = found
    values, directions = np.linalg.eigh((v + v.T) / 2)
    order = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > len(v) * np.finfo(float).eps * values.max()]
    return Whitening(n, sums, v, values[order], directions[:, order])


def whitened(table: DataFrame, model: Whitening) -> DataFrame:
    """``table`` with a column whitened (array<double>): the centred ``vector`` on each component, over the root of its eigenvalue."""
    first = np.array([float(s / model.n) for s in model.sums])
    mean = first, np.array([float(s / model.n - Fraction(m)) for s, m in zip(model.sums, first.tolist())])
    turn = model.directions / np.sqrt(model.values)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                high, low = centred(vectors.matrix(batch.column("vector")), mean)
                yield pa.RecordBatch.from_arrays([*batch.columns, vectors.lists(high @ turn + low @ turn, pa.float64())], [*batch.schema.names, "whitened"])

    return table.mapInArrow(run, table.select("*", F.lit(None).cast("array<double>").alias("whitened")).schema)


def identity_error(table: DataFrame) -> float | None:
    """The largest absolute entry of the covariance of the column ``whitened``, less the identity."""
    found = covariance(table.select(F.col("whitened").alias("vector")))
    return float(np.abs(found[2] - np.eye(len(found[1]))).max()) if found and len(found[1]) else None


def commonest_length(table: DataFrame) -> int:
    """The length that most non-empty vectors have; of equally common ones the largest. 0 without any."""
    row = table.groupBy(F.size("vector").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    return row.d if row else 0


def by_component(table: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector of ``table`` (vec_id, embedding) and component.

    Entries become whole numbers floor(scale * c) + offset. Vectors that are null or hold null or non-finite entries are dropped. Those of
    another length than the commonest, or with an entry above LARGEST, stay: their rows have null for deviation and whitened, and they
    are not in the fit. A component without variance has null for whitened. A deviation beyond 64 bits is null. Repeated rows count each
    time, null vec_ids are rows like others; an empty table gives an empty result.
    """
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale) + offset)
    rows = table.select("vec_id", "embedding").where(vectors.finite("embedding"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(vectors.within("embedding", LARGEST / scale), whole).alias("x"))
    dims = commonest_length(rows.select(F.col("x").alias("vector")))
    usable = F.coalesce(F.size("x") == max(dims, 1), F.lit(False))
    exact = rows.where(usable).select("vec_id", "x", F.col("x").cast("array<double>").alias("vector"))
    model = fit(exact, components)
    numbers = F.lit(list(range(1, min(components, dims) + 1))).cast("array<int>")
    if not model:
        return rows.select("vec_id", F.explode(numbers).alias("component"), *[F.lit(None).cast(t).alias(c) for c, t in _REST])
    apart = F.zip_with("x", F.lit([int(s) for s in model.sums]).cast("array<long>"), lambda x, s: F.try_subtract(F.try_multiply(F.lit(model.n).cast("long"), x), s))
    deviation = F.aggregate(apart, F.lit(0).cast("long"), lambda total, d: F.try_add(total, F.try_multiply(d, d)))
    done = written(whitened(exact.select("vec_id", deviation.alias("deviation"), "vector"), model).drop("vector"), "whitened")
    explained = F.lit(model.explained).cast("array<double>")
    done = done.unionByName(rows.where(~usable).select("vec_id", F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")))
    error = identity_error(done.where("whitened is not null")) if len(model.values) else None
    at = F.col("component") - 1
    return done.select("vec_id", F.explode(numbers).alias("component"), "deviation", "whitened").select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", F.get("whitened", at).alias("whitened"), F.get(explained, at).alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
