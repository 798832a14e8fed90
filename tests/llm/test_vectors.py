"""Clustering and whitening against plain integers and fractions."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from hopline.llm import centroids, queries, vectors, whitening

DIMS = 6
KIND = "vec_id long, embedding array<float>, cluster string, distance double, v int, x int, vector string"


def brute(rows, k, rounds, scale, seed=2):
    """[(vec_id, cluster, distance)], centroids: full scans in plain integers."""
    table = [(i, [math.floor(scale * c) for c in v]) for i, v in rows]
    code = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "x"
    at = [v for _, v in sorted(table, key=lambda r: (code(r[0]), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(at))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in table]
        for c in set(own):
            some = [v for (_, v), o in zip(table, own) if o == c]
            at[c] = [sum(x) // len(some) for x in zip(*some)]
    return [(i, *nearest(v)[::-1]) for i, v in table], at


def frame(spark, rows):
    """With columns whose names the operators use too."""
    return spark.createDataFrame([(i, v, "a", 0.5, 7, 8, "b") for i, v in rows], KIND)


def blobs(n, dims, seed, spread=0.1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(25, dims))
    return [(i, (middles[i % 25] + spread * rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


def sound(rows, dims=DIMS):
    return [(i, v) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]


ODD = [
    (None, [0.5] * DIMS), (None, [0.25] * DIMS), (900, None), (901, []), (902, [0.1] * (DIMS - 1)), (903, [0.1] * (DIMS + 1)),
    (904, [math.nan] + [0.0] * (DIMS - 1)), (905, [math.inf] + [0.0] * (DIMS - 1)), (906, [None] + [0.0] * (DIMS - 1)),
    (3, [0.0] * DIMS), (907, [0.0] * DIMS), (908, [-0.0] * DIMS), (909, [0.0] * DIMS), (3, [0.0] * DIMS),
]


@pytest.mark.parametrize("n, k, rounds", [(0, 7, 3), (5, 7, 2), (120, 24, 5), (120, 1, 1)])
def test_clusters_are_those_of_full_scans(spark, n, k, rounds):
    rows = blobs(n, DIMS, n + k) + (ODD if n else [])
    found = centroids.clusters(frame(spark, rows).repartition(5), k=k, rounds=rounds, dims=DIMS, scale=256).collect()
    want, at = brute(sound(rows), k, rounds, 256)
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in found], key=key) == sorted(want, key=key)
    for r in found:
        assert r.centroid == at[r.cluster]
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.inertia == sum(d for *_, d in want)


def test_bounds_pass_over_most_centroids_and_change_nothing():
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.array([v for _, v in blobs(3000, 16, 9, 0.05)])).astype(np.int64)
    at = x[rng.permutation(len(x))[:40]]
    to, state, measured = centroids.Centroids(at, centroids.grouped(at)), [None] * 3, []
    for _ in range(8):
        own, upper, lower, n = centroids.assigned(x, to, *state)
        squared = ((x[:, None] - to.at[None]) ** 2).sum(2)
        assert (own == squared.argmin(1)).all()
        root = np.sqrt(squared)
        assert (upper >= root[np.arange(len(x)), own]).all()
        root[np.arange(len(x)), own] = np.inf
        assert all((lower[:, g] <= root[:, to.group == g].min(1)).all() for g in range(lower.shape[1]))
        measured.append(n)
        new = np.stack([x[own == c].sum(0) // max(1, (own == c).sum()) if (own == c).any() else to.at[c] for c in range(40)])
        to, state = centroids.Centroids(new, to.group, np.sqrt(((new - to.at) ** 2).sum(1)) * (1 + centroids.SAFE)), [own, upper, lower]
    assert measured[0] == 40 * len(x) and measured[-1] < 0.15 * measured[0]


@pytest.mark.parametrize("size", [1 << 10, 1 << 21, 1 << 26])
def test_distances_are_exact_for_large_components(size):
    rng = np.random.default_rng(size)
    x, at = rng.integers(-size, size, (50, 64)), rng.integers(-size, size, (12, 64))
    assert size <= centroids.largest(64)
    own, *_ = centroids.assigned(x, centroids.Centroids(at, centroids.grouped(at)), None, None, None)
    want = [min((sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)), i) for i, b in enumerate(at)) for a in x]
    assert [int(i) for i in own] == [i for _, i in want]
    assert centroids._to_own(x, at, own).tolist() == [d for d, _ in want]


def test_vectors_without_64_bit_distances_stay_as_rows(spark):
    rows = [*blobs(20, DIMS, 1), (50, [1e30] + [0.0] * (DIMS - 1))]
    found = {r.vec_id: r for r in centroids.clusters(frame(spark, rows), k=4, rounds=2, dims=DIMS).collect()}
    assert found[50].cluster is None and found[50].distance is None
    assert [(i, found[i].cluster, found[i].distance) for i in range(20)] == brute(rows[:20], 4, 2, 256)[0]


def exact_covariance(x):
    n = len(x)
    mean = [sum(map(Fraction, c)) / n for c in zip(*x)]
    apart = [[Fraction(v) - m for v, m in zip(r, mean)] for r in x]
    return mean, [[sum(r[i] * r[j] for r in apart) / n for j in range(len(mean))] for i in range(len(mean))]


@pytest.mark.parametrize("offset, scale", [(0.0, 1.0), (1e9, 1.0), (-3e12, 1e-3), (1e5, 1e8)])
def test_covariance_has_no_error_but_the_last_rounding(spark, offset, scale):
    rng = np.random.default_rng(3)
    x = (offset + scale * rng.normal(size=(1300, 5)) @ rng.normal(size=(5, 5))).tolist()
    _, sums, v = whitening.covariance(spark.createDataFrame([(r,) for r in x], "vector array<double>").repartition(3))
    mean, want = exact_covariance(x)
    assert [float(s / len(x)) for s in sums] == [float(m) for m in mean]
    top = max(abs(float(c)) for r in want for c in r)
    assert max(abs(Fraction(float(v[i, j])) - want[i][j]) for i in range(5) for j in range(5)) <= 2**-52 * top


def test_sums_of_whole_numbers_are_exact(spark):
    x = [[float(2**50 + 3 * i), float(-(2**52) + i)] for i in range(2000)]
    _, sums, _ = whitening.covariance(spark.createDataFrame([(r,) for r in x], "vector array<double>").repartition(7))
    assert sums == [sum(int(r[i]) for r in x) for i in range(2)]


def test_components_and_whitened_values(spark):
    rows = blobs(400, DIMS, 8, 0.4) + ODD
    found = whitening.by_component(frame(spark, rows).repartition(3)).collect()
    fit = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in sound(rows)]
    usable = [r for r in found if r.deviation is not None]
    # rows of another length stay, without values
    assert len(found) == DIMS * (len(fit) + 3) and len(usable) == DIMS * len(fit)
    assert {r.vec_id for r in found if r.deviation is None} == {901, 902, 903} and all(r.whitened is None for r in found if r.deviation is None)
    mean, cov = exact_covariance(fit)
    cov = np.array(cov, float)
    values, directions = np.linalg.eigh(cov)
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    assert {r.component for r in found} == set(range(1, DIMS + 1)) and {r.n for r in usable} == {n}
    assert sorted(r.deviation for r in usable if r.component == 1) == sorted(sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in fit)
    for i in range(1, DIMS + 1):
        e = values[-i]
        apart = np.array([[float(a - m) for a, m in zip(v, mean)] for v in fit])
        want = np.sort(apart @ directions[:, -i] / math.sqrt(e))
        got = np.sort([r.whitened for r in usable if r.component == i])
        assert min(np.abs(got - want).max(), np.abs(got + want[::-1]).max()) < 1e-9
        assert {round(r.explained, 12) for r in usable if r.component == i} == {round(e / np.trace(cov), 12)}
    assert 0 <= usable[0].identity_error < 1e-9


def test_components_without_variance(spark):
    rows = [(i, [float(i % 3), 2.0 * (i % 3), 7.0]) for i in range(30)]
    found = whitening.by_component(frame(spark, rows)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in found) and len(found) == 90
    assert all(abs(r.explained - 1) < 1e-12 for r in found if r.component == 1)
    same = whitening.by_component(frame(spark, [(i, [1.0, 2.0]) for i in range(4)])).collect()
    assert len(same) == 8 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)


def test_tables_without_vectors(spark):
    for rows in ([], [(1, None)], [(2, [])], [(3, [math.nan, 1.0])]):
        assert whitening.by_component(frame(spark, rows)).count() == 0
        assert centroids.clusters(frame(spark, rows), dims=2).count() == 0


def test_lists_and_matrices_of_slices():
    import pyarrow as pa

    column = pa.array([[1, 2], [3, 4], [5, 6]], pa.list_(pa.int64())).slice(1, 2)
    assert vectors.matrix(column).tolist() == [[3, 4], [5, 6]]
    assert vectors.lists(np.array([[1.0, 2.0], [3.0, 4.0]]), pa.float64()).to_pylist() == [[1.0, 2.0], [3.0, 4.0]]


def test_queries_have_the_columns(spark):
    at = "/root/testdata/sf0.001"
    assert queries.op11_whitening(spark, at).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert queries.op13_centroids(spark, at).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
