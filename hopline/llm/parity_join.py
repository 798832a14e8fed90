"""Jaccard join of word n-gram sets by parity sketches.

A token (the hash of a run of words) flips one bit of a sketch, so a bit is the parity of the tokens that fall on it, and two sketches
differ in no more bits than the sets do in tokens: Hamming distance bounds the symmetric difference from below. Sets with Jaccard
t or more differ in (a + b) (1 - t) / (1 + t) tokens at most, a and b being their sizes.

Sizes form bands from each power of two to the next; a set that may link with one of the band below joins there too, so partners always meet
in a band. In a band, the sketch has PARTS_PER of 2^64 bits for each token of the band's smallest set; what is kept of a part is the XOR of its bits'
numbers (0 for a part without odd bits), which equal parts have in common. With at most h differing bits, at most h parts that are not empty differ
(pigeonhole): a set enters the lists of its h + 1 rarest parts, and two linked sets share the first of the parts that they have in common.
Sets with h or fewer parts that are not empty also enter a list of their band.

Inside a list, folded sketches (BITS bits, of a sample of the tokens of larger sets, by hash; of all tokens below 2 * FULL) are compared by Hamming distance:
pairs that are further apart than linked sets can be, but for a chance under 1e-9 where a sample is used, are no candidates. Candidates
form families, inside which exact Jaccard on the full sets decides (see ``minhash``, which also says how lists and families are
searched in bounded tasks without emitting their pairs). Equal sets are one node from the start.

Words are runs of anything but ASCII white space, A-Z lower-cased. A text with fewer words than a shingle has one shingle, all of
it; null or blank text has none and is linked with nothing. Rows that share a doc_id are one node, null doc_ids too (greater than all
others). An empty table gives an empty result. Texts are whole, however long. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.llm._shared import written
from hopline.llm.minhash import Forest, _rows, _search, candidates, distinct_sets, real, resolved, shingle_sets
from hopline.llm.textvec import chunks, mix

#: Parts of a band's sketch for each token of its smallest set, and at least.
PARTS_PER, LEAST_PARTS = 1, 32
#: Bits of a folded sketch; sets of fewer than twice FULL tokens have all of them in it.
BITS, FULL = 1024, 128
#: minus the logarithm of the chance that a sample of two linked sets differs in more bits than allowed.
RISK = -math.log(1e-9)


def band_of(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1] - 1


def parts_of(band: np.ndarray) -> np.ndarray:
    return np.maximum(LEAST_PARTS, (PARTS_PER * np.exp2(band)).astype(np.int64))


def most_apart(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The symmetric difference of sets of sizes a and b at the threshold."""
    return (a + b) * (100 - percent) // (100 + percent)


def part_keys(values: np.ndarray, sizes: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, pointer) of the parts with odd bits of each set's sketch in its band; ``values`` are the sets' tokens, one set after the other."""
    parts = parts_of(band)
    base = np.concatenate([[0], np.cumsum(parts)])
    at = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    where = np.repeat(base[:-1], sizes) + ((at >> np.uint64(8)) % np.repeat(parts, sizes).astype(np.uint64)).astype(np.int64)
    words = np.zeros(base[-1], np.uint64)
    np.bitwise_xor.at(words, where, mix(at + np.uint64(0x14057B7EF767814F)))
    odd = np.flatnonzero(words)
    own = np.searchsorted(base, odd, "right") - 1
    salt = (band[own].astype(np.uint64) << np.uint64(40)) + (odd - base[own]).astype(np.uint64)
    return mix(words[odd] ^ mix(salt + np.uint64(1))), np.searchsorted(odd, base)


def level_of(n: np.ndarray) -> np.ndarray:
    """A folded sketch at level j has the tokens of one hash in 2^j."""
    return np.maximum(0, band_of(n) - (FULL.bit_length() - 1))


def folded(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Two sketches of BITS bits for each set, one after the other: at its level and at the next."""
    h = mix(values ^ np.uint64(0x2545F4914F6CDD1D))
    ends, out = np.concatenate([[0], np.cumsum(sizes)]), []
    for first in range(0, len(sizes), 1024):
        n = sizes[first : first + 1024]
        own = h[ends[first] : ends[first + len(n)]]
        owner = np.repeat(np.arange(len(n)), n)
        bits = np.zeros((len(n), 2, BITS), np.uint8)
        for i in range(2):
            level = (level_of(np.maximum(n, 1)) + i)[owner].astype(np.uint64)
            chosen = np.flatnonzero(own & ((np.uint64(1) << level) - np.uint64(1)) == 0)
            np.bitwise_xor.at(bits, (owner[chosen], i, (own[chosen] >> np.uint64(54)).astype(np.int64)), 1)
        out += [r.tobytes() for r in np.packbits(bits.reshape(len(n), -1), axis=1)]
    return out


class Parity:
    """Which folded sketches may belong to sets at the threshold: by Hamming distance."""

    def __init__(self, percent: int):
        self.percent = percent

    def pairs(self, sizes: np.ndarray, sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        two = np.ascontiguousarray(sketch).view(np.uint64).reshape(len(sketch), 2, -1)
        level = level_of(sizes)
        step = np.clip(level[b] - level[a], -1, 1)  # linked sets are at one level or at two neighbouring ones
        apart = np.bitwise_count(two[a, (step > 0).astype(int)] ^ two[b, (step < 0).astype(int)]).sum(1, dtype=np.int64)
        most = most_apart(sizes[a], sizes[b], self.percent)
        mean = most / np.exp2(np.maximum(level[a], level[b]))
        return apart <= np.where(np.maximum(level[a], level[b]) > 0, mean + RISK / 3 + np.sqrt(RISK * RISK / 9 + 2 * RISK * mean), most)

    def clusters(self, sizes: np.ndarray, sketch: np.ndarray) -> Forest:
        forest, ratio = Forest(len(sizes)), self.percent / 100 - 1e-9

        def linked(y: int, left: np.ndarray) -> np.ndarray:
            s = sizes[left]
            a, b = np.searchsorted(s, sizes[y] * ratio), np.searchsorted(s, sizes[y] / ratio, "right")
            out = np.zeros(len(left), bool)
            out[a:b] = self.pairs(sizes, sketch, np.full(b - a, y), left[a:b])
            return out

        _search(np.arange(len(sizes)), forest, linked)
        return forest


def sketches(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """A row for each document (part 0) and one more for each that joins the band below (part 1): row, id, part, n_shingles, print, low (keys of
    its parts), take (how many of them are lists), sketch (folded; part 0 alone)."""

    def sketch(batches):
        for batch in chunks(batches):
            values, cut = shingle_sets(batch.column("text"), shingle)
            n = np.diff(cut)
            prints = pa.array([xxhash.xxh3_128_digest(values[a:b].tobytes()) if b > a else None for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary())
            band = band_of(np.maximum(n, 1))
            heads = folded(values, n)
            below = np.flatnonzero((n > 0) & (-(-n * percent // 100) < 1 << band))
            lower = np.concatenate([values[cut[i] : cut[i + 1]] for i in below]) if len(below) else values[:0]
            for part, rows, tokens, at in ((0, np.arange(len(n)), values, band), (1, below, lower, band[below] - 1)):
                size = n[rows]
                keys, ends = part_keys(tokens, size, at)
                partner = size * 100 // percent if part == 0 else (1 << band[rows]) - 1
                most = most_apart(size, partner, percent)
                scarce = (np.diff(ends) <= most) & (size > 0)
                if scarce.any():  # a list for all such sets of the band
                    keys = np.insert(keys, ends[1:][scarce], mix((at[scarce].astype(np.uint64) << np.uint64(40)) + np.uint64(1 << 39)))
                    ends = ends + np.concatenate([[0], np.cumsum(scarce)])
                take = np.where(scarce, np.diff(ends), most + 1)
                column = lambda c: c.take(pa.array(rows))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch.column("row")), column(batch.column("id")), pa.array(np.full(len(rows), part), pa.int32()), pa.array(size), column(prints),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.view(np.int64))), pa.array(take, pa.int32()), pa.array([heads[i] for i in rows.tolist()], pa.binary()),
                    ],
                    ["row", "id", "part", "n_shingles", "print", "low", "take", "sketch"],
                )

    rows = _rows(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(sketch, "row long, id long, part int, n_shingles long, print binary, low array<long>, take int, sketch binary")


def joined(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) for each row of ``docs`` (doc_id, text)."""
    rows = written(sketches(docs, shingle, percent), "parity-sketches")
    nodes, lists = distinct_sets(rows)
    found = resolved(docs, rows.where("part = 0"), nodes, candidates(lists, percent, Parity(percent)), shingle, percent)
    return found.select(real("id").alias("doc_id"), "n_shingles", real("component").alias("component_id"))
