"""Centroid clustering by Yinyang k-means over integer vectors, exact in every round.

Centroids are clustered into groups once. A vector carries its centroid, an upper bound of its distance to it and, for each group, a
lower bound of its distance to the group's other centroids. After a round the bounds move by as much as the centroids did:
vectors whose upper bound is below all lower bounds stay (the global filter); for the rest, groups whose bound is above the best distance
are passed over, and in those that remain only centroids which their own movement can have brought near are measured. Distances are exact
integers; bounds are doubles, rounded to the safe side, and only a strict comparison passes anything over, so ties go to the
smaller number as in a full scan.

A round reads the table of the round before and writes its own (vectors and bounds stay in their partition, nothing is shuffled);
tasks send one row of sums for each of their clusters. The driver holds the centroids alone: ``k`` vectors, a parameter.

Rows with another number of components, or with a null or non-finite one, are left out. A vector with a component
beyond ``largest()`` has no distances that fit into 64 bits: its row has null for cluster and distance, and takes no part. Null vec_ids are
rows like others, but the last to start a centroid. Repeated rows count each time; if rows of one vec_id start centroids, the smaller vector is first. With
fewer vectors than ``k`` there are as many centroids as vectors. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.llm import vectors
from hopline.llm._shared import discard, scratch

#: Bounds are rounded by this part of their value.
SAFE = 1e-12
STATE = "vec_id long, v array<long>, cluster int, upper double, lower array<double>, distance long"


def largest(dims: int) -> int:
    """Components up to this keep squared distances within 62 bits."""
    return math.isqrt((1 << 60) // dims)


@dataclass(frozen=True)
class Centroids:
    at: np.ndarray
    group: np.ndarray
    #: How far each one went in the last round, rounded up; None in the first.
    moved: np.ndarray | None = None


def grouped(at: np.ndarray) -> np.ndarray:
    """The group of each centroid: k-means over the centroids, a tenth as many groups."""
    n = -(-len(at) // 10)
    middle = at[np.linspace(0, len(at) - 1, n).astype(int)].astype(float)
    group = np.zeros(len(at), int)
    for _ in range(5):
        group = ((at[:, None, :] - middle[None]) ** 2).sum(2).argmin(1)
        for g in np.unique(group):
            middle[g] = at[group == g].mean(0)
    return np.unique(group, return_inverse=True)[1]


def _kind(x: np.ndarray, at: np.ndarray) -> type:
    """Doubles where all distances are whole numbers below 2^53, else integers."""
    most = max(np.abs(x).max(initial=0), np.abs(at).max(initial=0))
    return np.float64 if 4 * x.shape[1] * int(most) ** 2 < 1 << 53 else np.int64


def _to_own(x: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    apart = x - at[own]
    return (apart * apart).sum(1)


def assigned(x: np.ndarray, to: Centroids, own: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(centroid, upper bound, lower bounds, distances measured) of the rows of x, from those of the round before or from nothing."""
    kind = _kind(x, to.at)
    x, at = x.astype(kind), to.at.astype(kind)
    n, k, groups = len(x), len(at), int(to.group.max()) + 1
    rows = np.arange(n)
    members = [np.flatnonzero(to.group == g) for g in range(groups)]
    if own is None:
        squared = (x * x).sum(1)[:, None] + (at * at).sum(1)[None] - 2 * (x @ at.T)
        best = squared.argmin(1)
        root = np.sqrt(squared.astype(np.float64))
        upper = root[rows, best] * (1 + SAFE)
        root[rows, best] = np.inf
        return best, upper, np.stack([root[:, m].min(1) for m in members], 1) * (1 - SAFE), n * k
    before = lower
    furthest = np.array([to.moved[m].max() for m in members])
    upper = (upper + to.moved[own]) * (1 + SAFE)
    lower = np.maximum(0, before - furthest) * (1 - SAFE)
    best = own.copy()
    look = np.flatnonzero(upper >= lower.min(1))
    exact = _to_own(x[look], at, own[look])
    upper[look] = np.sqrt(exact.astype(np.float64)) * (1 + SAFE)
    near = upper[look] >= lower[look].min(1)
    measured, look, exact = len(look), look[near], exact[near]
    if not len(look):
        return best, upper, lower, measured
    # of each vector that is left: a lower bound for each centroid, then its distance where that is measured
    bound = np.maximum(0, before[look][:, to.group] - to.moved) * (1 - SAFE)
    place, was = np.arange(len(look)), own[look]
    bound[place, was] = np.sqrt(exact.astype(np.float64)) * (1 - SAFE)
    winner, least, reach = was.copy(), exact.copy(), upper[look]
    for g, m in enumerate(members):
        group = np.flatnonzero(lower[look, g] <= reach)
        for c in m.tolist():
            some = group[(bound[group, c] <= reach[group]) & (was[group] != c)]
            if not len(some):
                continue
            apart = x[look[some]] - at[c]
            d = (apart * apart).sum(1)
            measured += len(some)
            root = np.sqrt(d.astype(np.float64))
            bound[some, c] = root * (1 - SAFE)
            better = (d < least[some]) | ((d == least[some]) & (c < winner[some]))
            won = some[better]
            winner[won], least[won], reach[won] = c, d[better], root[better] * (1 + SAFE)
    bound[place, winner] = np.inf
    best[look], upper[look] = winner, reach
    lower[look] = np.stack([bound[:, m].min(1) for m in members], 1)
    return best, upper, lower, measured


def _round(state: DataFrame, to: Centroids, last: bool) -> DataFrame:
    """STATE for vec_id, v alone (the first round) or for the STATE of the round before."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors.matrix(batch.column("v"))
            was = [None] * 3 if to.moved is None else [batch.column("cluster").to_numpy().astype(np.int64), batch.column("upper").to_numpy(), vectors.matrix(batch.column("lower"))]
            own, upper, lower, _ = assigned(x, to, *was)
            distance = pa.array(_to_own(x, to.at, own)) if last else pa.nulls(len(x), pa.int64())
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(own, pa.int32()), pa.array(upper), vectors.lists(lower, pa.float64()), distance]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "cluster", "upper", "lower", "distance"])

    return state.mapInArrow(run, STATE)


def _sums(state: DataFrame) -> dict[int, list[int]]:
    """The exact sum of each component, and the number of vectors behind them, of each cluster that has vectors."""

    def run(batches):
        sums = {}
        for batch in batches:
            x, own = vectors.matrix(batch.column("v")), batch.column("cluster").to_numpy()
            for c in np.unique(own).tolist():
                part = x[own == c]
                sums[c] = sums.get(c, 0) + np.append(part.sum(0), len(part))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), vectors.lists(np.stack(list(sums.values())), pa.int64())], ["cluster", "sums"])

    parts = state.select("v", "cluster").mapInArrow(run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("i", "part"))
    total = parts.groupBy("cluster", "i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    out: dict[int, list[int]] = {}
    for r in sorted(total):
        out.setdefault(r.cluster, []).append(int(r.total))
    return out


def integers(table: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, v (whole-number components; null where one is too large) for the vectors of ``table`` (vec_id, embedding) that can be used."""
    sound = table.select("vec_id", "embedding").where((F.size("embedding") == dims) & vectors.finite("embedding"))
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    return sound.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(vectors.within("embedding", largest(dims) / scale), whole).alias("v"))


def clusters(table: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array<long>) for each vector of ``table`` (vec_id, embedding)."""
    spark = table.sparkSession
    rows = integers(table, dims, scale)
    state, path = rows.where(F.col("v").isNotNull()), None
    hashed = state.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"))
    start = hashed.orderBy(F.col("hash").asc_nulls_last(), "v").limit(k).collect()
    odd = rows.where(F.col("v").isNull()).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid", "array<long>"))])
    if not start:
        return odd
    at = np.array([r.v for r in start], np.int64)
    to = Centroids(at, grouped(at))
    for i in range(rounds + 1):
        before, path = path, scratch(spark, f"clusters-{i}")
        _round(state, to, i == rounds).write.parquet(path)
        state = spark.read.schema(STATE).parquet(path)
        if before:
            discard(spark, before)
        if i < rounds:
            at = to.at.copy()
            for c, (*sums, n) in _sums(state).items():
                at[c] = [x // n for x in sums]
            apart = (at - to.at).astype(object)
            to = Centroids(at, to.group, np.array([math.sqrt(int(x)) for x in (apart * apart).sum(1)]) * (1 + SAFE))
    totals = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()
    inertia = sum(int(r.inertia) for r in totals)
    long = lambda x: x if x < 1 << 63 else None
    of = spark.createDataFrame([(r.cluster, long(int(r.inertia)), long(inertia), to.at[r.cluster].tolist()) for r in totals], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    found = state.select("vec_id", "cluster", "distance").join(F.broadcast(of), "cluster")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid").unionByName(odd)


def digest(centroid: str = "centroid"):
    """Lowercase hex SHA-256 of the components as decimal integers, joined by commas."""
    return F.sha2(F.concat_ws(",", F.transform(centroid, lambda x: x.cast("string"))), 256)
