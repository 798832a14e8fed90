"""Coarse-to-fine search against a search of every place."""

import numpy as np

from hopline.operators import alignment


def full(song, probe, approx, radius, fine, stride):
    side = int(np.argmax((probe.astype(float) ** 2).sum(0)))
    p, s, m = probe[:, side].astype(float), song[:, side].astype(float), min(len(probe), fine)
    starts = [*range(0, len(p) - m + 1, m), len(p) - m]
    at = max(starts, key=lambda i: (p[i : i + m] ** 2).sum())
    x = p[at : at + m : stride]
    best = None
    for o in range(max(0, approx - radius), min(len(s) - len(p), approx + radius) + 1):
        y = s[o + at : o + at + m : stride]
        if y.std() and x.std():
            c, gain = float(np.corrcoef(x, y)[0, 1]), float(((x - x.mean()) @ (y - y.mean())) / ((y - y.mean()) @ (y - y.mean())))
            if best is None or (c, -abs(o - approx)) > best[:2]:
                best = c, -abs(o - approx), o, gain
    return best[2] if best and best[0] >= 0.985 and 0.9 <= best[3] <= 1.1 else None


def test_noisy_quieter_probes_are_found_with_few_samples_read(spark):
    rng = np.random.default_rng(5)
    size, block, fine, radius = 512, 16, 200, 1500
    songs, rows, probes, want = {}, [], [], {}
    for k in range(3):
        n = 6000 + 300 * k
        loud = np.repeat(rng.uniform(0.05, 1, n // 40 + 1), 40)[:n, None]
        songs[k] = np.clip(rng.normal(size=(n, 2)) * [4000, 7000] * loud, -32768, 32767).astype(np.int64)
        rows += [(k, b, songs[k][b * size : (b + 1) * size].ravel().tolist()) for b in range(-(-n // size))]
    for i in range(40):
        k, n = i % 3, int(rng.integers(300, 700))
        at = int(rng.integers(0, len(songs[k]) - n))
        gain = [0.95, 1.05, 0.5, 1.0][i % 4]
        sound = np.round(songs[k][at : at + n] * gain + rng.normal(size=(n, 2)) * 40).astype(np.int64)
        approx = max(0, at + int(rng.integers(-900, 900)))
        probes.append((i, k, sound.ravel().tolist(), approx))
        want[i] = full(songs[k], sound, approx, radius, fine, 2)
    probes += [(100, 0, [0] * 800, 5), (101, 9, [1, 2] * 400, 5), (102, 0, [5] * 10, 5), (103, 0, [], 5), (104, 0, songs[0][:300].ravel().tolist(), 50_000)]
    want |= dict.fromkeys(range(100, 105))
    track = alignment.channels(spark.createDataFrame(rows, "song int, block long, pcm array<int>"))
    found = alignment.aligned(track, spark.createDataFrame(probes, "id long, song int, pcm array<int>, approx long"), size, radius, block, fine, stride=2, places=2).collect()
    assert {r.id: r.offset for r in found} == want
    assert sum(x is not None for x in want.values()) >= 28
    assert sum(r.read for r in found) < 0.25 * 40 * 2 * radius


def test_excerpts_cross_blocks(spark):
    track = spark.createDataFrame([("s", 0, b, list(range(b * 4, min(18, b * 4 + 4)))) for b in range(5)], "song string, channel int, block long, values array<int>")
    wanted = spark.createDataFrame([(1, "s", 0, 0, 4), (2, "s", 0, 3, 6), (3, "s", 0, 15, 9), (4, "s", 0, 7, 1)], "id long, song string, channel int, start long, count long")
    got = {r.id: r.found for r in alignment.excerpts(track, wanted, 4).collect()}
    assert got == {1: [0, 1, 2, 3], 2: [3, 4, 5, 6, 7, 8], 3: [15, 16, 17], 4: [7]}
