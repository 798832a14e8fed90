"""Gains that are changed during a ramp, against a mixer that goes frame by frame."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hopline.operators import signal

CONTROLS, BLOCKS = "s string, at long, gain double, n long", "s string, first int, pcm array<smallint>, gain string"


def mixed(controls, blocks, frames, initial):
    """One frame after the other, as a device would render them."""
    out = []
    for s, first, pcm, x in blocks:
        if not pcm or first is None:
            out.append((s, first, pcm if pcm == [] else None, x))
            continue
        due = {}
        for k, at, gain, n in controls:
            if k == s and at is not None and gain is not None and 0 <= gain <= 1:
                due.setdefault(at, []).append((n, gain))
        begin = min([first, *due])
        current = target = initial
        left, rendered = 0, []
        for f in range(begin, first + len(pcm) // 2):
            if f in due:
                target, left = max(due[f])[1], frames
                current = target if frames == 0 else current
            if left:
                current += (target - current) / left
                left -= 1
            if f >= first:
                rendered += [v * current for v in pcm[2 * (f - first) : 2 * (f - first) + 2]]
        out.append((s, first, [int(math.copysign(math.floor(abs(v) + 0.5), v)) for v in rendered], x))
    return sorted(out, key=str)


@pytest.mark.parametrize("frames, initial", [(0, 1.0), (1, 0.5), (7, 1.0), (40, 0.25)])
def test_frame_by_frame(spark, frames, initial):
    rng = random.Random(frames)
    controls = [(rng.choice(["a", "b", "c", None]), rng.randrange(-20, 200), rng.choice([0.0, 0.3, 0.7, 1.0, 1.5, math.nan, None]), i) for i in range(60)] + [("a", None, 1.0, 99), ("a", 5, 0.5, 200), ("a", 5, 0.75, 201)]
    blocks = [(s, i * 25 + (3 if i > 3 else 0), [rng.randrange(-30000, 30000) for _ in range(50)], "x") for s in ("a", "b", "d", None) for i in range(7)]
    blocks += [("e", 0, [], "x"), ("e", 40, None, "y"), ("a", None, [1, 2], "z")]
    changes = signal.gain_changes(spark.createDataFrame(controls, CONTROLS).repartition(3), ["s"], "at", "gain", "n", frames, initial)
    got = signal.gained(spark.createDataFrame(blocks, BLOCKS), changes, ["s"], "first", "at", frames, initial=initial)
    assert got.columns == ["s", "first", "pcm", "gain"]
    want = mixed(controls, blocks, frames, initial)
    rows = sorted((tuple(r) for r in got.collect()), key=lambda r: str(r[:2]))
    want = sorted(want, key=lambda r: str(r[:2]))
    assert [(r[0], r[1], r[3]) for r in rows] == [(r[0], r[1], r[3]) for r in want]
    for r, w in zip(rows, want):  # steps that are added up and a line differ in the last bit
        assert (r[2] is None) == (w[2] is None) and (r[2] is None or len(r[2]) == len(w[2]) and all(abs(x - y) <= 1 for x, y in zip(r[2], w[2])))
    assert sum(x != y for r, w in zip(rows, want) for x, y in zip(r[2] or [], w[2] or [])) <= 2


def test_blocks_of_any_length(spark):
    """The same samples in one block or in many."""
    pcm = list(range(-1000, 1000))
    changes = signal.gain_changes(spark.createDataFrame([("a", 100, 0.0, 1), ("a", 130, 1.0, 2), ("a", 500, 0.2, 3)], CONTROLS), ["s"], "at", "gain", "n", 64)

    def of(step):
        b = spark.createDataFrame([("a", i // 2, pcm[i : i + 2 * step], "x") for i in range(0, 2000, 2 * step)], BLOCKS)
        return sum((r.pcm for r in signal.gained(b, changes, ["s"], "first", "at", 64).orderBy("first").collect()), [])

    assert of(1000) == of(7) == of(250)


def test_empty(spark):
    none = signal.gain_changes(spark.createDataFrame([], CONTROLS), ["s"], "at", "gain", "n", 8)
    assert none.count() == 0
    b = spark.createDataFrame([("a", 0, [5, -5], "x")], BLOCKS)
    assert signal.gained(b, none, ["s"], "first", "at", 8, initial=0.5).first().pcm == [3, -3]
    assert signal.gained(b.where(F.lit(False)), none, ["s"], "first", "at", 8).count() == 0
