"""Benchmark decontamination by the q-gram lemma.

Each benchmark text is cut into overlapping segments of SEGMENT characters (shorter texts are one segment), so a
document that holds a part of it is found too. A place in a document that lies within e edits of a segment of m characters shares
at least m - Q + 1 - Q * e character Q-grams with it, on diagonals (place in the document less place in the segment) of
a band of e + 1. Shared Q-grams are counted in bands of 2 (e + 1) diagonals that overlap by half, so every such band
lies in one of them; bands that reach the bound are kept, and a banded alignment over the region gives the edit distance.

Characters are compared in lower case (A-Z), with runs of ASCII white space as one space. Null or empty texts, on either side, match
nothing. Benchmark texts with fewer than LEAST characters, of any length, allow no edit and are found as runs of whole words only.
Rows that repeat give repeated hits. A very long text is one chunk of a worker. Empty tables give an empty result. Columns of ``docs``
other than doc_id and text are not read; uncontaminated() passes them on, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.llm._shared import written
from hopline.llm.textvec import LOWER, Words, chunks, flatten, groups

SEGMENT, STRIDE = 100, 50
Q = 8
#: Edits allowed, as a part of the segment's length.
RATE = 0.1
#: Characters of a text that is cut into segments, at least.
LEAST = 40
#: Characters of benchmark text that are broadcast at once; a larger benchmark is held against the documents block by block.
BLOCK_CHARS = 8 << 20
SIEVE_BITS, SLOT_BITS = 20, 22
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def qgrams(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes from each place as a number, q at most 8."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    out = np.empty(-(-n // 8) * 8, np.uint64)
    for r in range(8):
        out[r::8] = padded[r : r + len(out)].view("<u8")
    return out[:n] & np.uint64((1 << (8 * q)) - 1)


def _spread(grams: np.ndarray, bits: int) -> np.ndarray:
    return ((grams * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def _edits(m: int, rate: float, q: int) -> int:
    """Edits allowed in m characters: the rate, but few enough for the lemma's bound to be positive."""
    return max(0, min(int(rate * m), (m - q) // q))


class Segments:
    """The segments of some benchmark texts and an index of their Q-grams."""

    def __init__(self, items: list[tuple[int, bytes]], q: int = Q, segment: int = SEGMENT, stride: int = STRIDE, rate: float = RATE, least: int = LEAST):
        self.q = q
        self.item, self.at, self.text = [], [], []
        for item, text in items:
            if len(text) < max(least, q):
                continue
            starts = list(range(0, max(1, len(text) - segment), stride)) + ([len(text) - segment] if len(text) > segment else [])
            for s in dict.fromkeys(starts):
                self.item.append(item)
                self.at.append(s)
                self.text.append(text[s : s + segment])
        lengths = np.array([len(t) for t in self.text], np.int64)
        self.lengths = lengths
        self.edits = np.array([_edits(n, rate, q) for n in lengths.tolist()], np.int64)
        self.bound = lengths - q + 1 - q * self.edits
        data = np.frombuffer(b"".join(self.text), np.uint8)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        place = np.arange(max(0, len(data) - q + 1))
        owner = np.searchsorted(offsets, place, "right") - 1
        inside = place + q <= offsets[owner + 1] if len(place) else np.zeros(0, bool)
        place, owner = place[inside], owner[inside]
        grams = qgrams(data, q)[place]
        order = np.argsort(grams, kind="stable")
        cut = groups(grams[order])
        self.grams, self.cut = grams[order][cut[:-1]], cut
        self.owner, self.place = owner[order].astype(np.int32), (place - offsets[owner])[order].astype(np.int32)
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[_spread(self.grams, SIEVE_BITS)] = True
        at = _spread(self.grams, SLOT_BITS)
        self.slot = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slot[at] = np.arange(len(at))
        shared = np.bincount(at, minlength=1)
        self.slot[np.flatnonzero(shared > 1)] = -2  # several grams: looked up by search

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``grams`` of those of the segments, their numbers)."""
        spread = grams * _SPREAD
        at = np.flatnonzero(self.sieve[(spread >> np.uint64(64 - SIEVE_BITS)).astype(np.int32)])
        found = grams[at]
        k = self.slot[(spread[at] >> np.uint64(64 - SLOT_BITS)).astype(np.int32)]
        search = np.flatnonzero(k == -2)
        k[search] = np.minimum(np.searchsorted(self.grams, found[search]), len(self.grams) - 1)
        same = (k >= 0) & (self.grams[k] == found)
        return at[same], k[same].astype(np.int64)


class Short:
    """The benchmark texts that are too short for segments, by their number of words."""

    def __init__(self, items: list[tuple[int, bytes]], least: int = LEAST):
        of: dict[bytes, list[int]] = {}
        for item, text in items:
            if 0 < len(text) < least:
                of.setdefault(text, []).append(item)
        self.text, self.items = list(of), list(of.values())
        w = Words(*flatten(pa.array(self.text, pa.binary()).cast(pa.large_binary()).view(pa.large_string())))
        self.by_words = {}
        for n in np.unique(w.counts).tolist():
            own = np.flatnonzero(w.counts == n)
            hashes = w.runs(w.pointer[own], n)
            order = np.argsort(hashes)
            self.by_words[n] = hashes[order], own[order]

    def found(self, w: Words) -> list[tuple[int, int, int]]:
        """(document, number of the text, first place of it in the document) for documents that hold a text."""
        out = []
        for n, (hashes, own) in self.by_words.items():
            at = w.windows(n)
            h = w.runs(at, n)
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[k] == h
            at, k = at[same], own[k[same]]
            doc = np.searchsorted(w.pointer, at, "right") - 1
            _, first = np.unique(doc * len(self.text) + k, return_index=True)
            for i in first.tolist():
                d, a, text = int(doc[i]), int(w.starts[at[i]]), self.text[k[i]]
                if w.data[a : a + len(text)].tobytes() == text:
                    out.append((d, int(k[i]), a - int(w.starts[w.pointer[d]])))
        return out


def _cleaned(texts: pa.Array) -> tuple[Words, np.ndarray]:
    data, offsets = flatten(texts)
    w = Words(LOWER[data], offsets)
    return w, np.append(w.starts, len(w.data))[w.pointer]


def clean(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts as they are compared."""
    w, offsets = _cleaned(texts)
    return w.data, offsets


def banded(patterns: np.ndarray, texts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: (least edit distance of the pattern to a part of the text, where that part ends), or ``most + 1``.

    A part may begin on any diagonal of the band, from 0 to the difference in length, and stays within it. Rows that are beyond
    ``most`` everywhere are dropped on the way.
    """
    n, m = patterns.shape
    width = texts.shape[1] - m + 1
    along = np.arange(width, dtype=np.int16)
    rows = np.zeros((n, width), np.int16)
    alive = np.arange(n)
    for i in range(m):
        new = rows + (texts[:, i : i + width] != patterns[:, i : i + 1])
        np.minimum(new[:, :-1], rows[:, 1:] + 1, out=new[:, :-1])
        rows = np.minimum.accumulate(new - along, 1) + along  # a text character more
        if i % 16 == 15 or i + 1 == m:
            good = rows.min(1) <= most
            if not good.all():
                rows, patterns, texts, alive = rows[good], patterns[good], texts[good], alive[good]
    out, end = np.full(n, most + 1), np.zeros(n, np.int64)
    if len(alive):
        out[alive], end[alive] = rows.min(1), m + rows.argmin(1)
    return out, end


def _verified(segs: Segments, data: np.ndarray, offsets: np.ndarray, found: tuple) -> list[tuple[int, int, int, int]]:
    """(document, segment, edits, place in the document) of the regions that hold their segment."""
    doc, seg, low = found
    out = []
    shape = segs.lengths[seg] * 1000 + segs.edits[seg]
    for key in np.unique(shape):
        of = np.flatnonzero(shape == key)
        m, e = int(key // 1000), int(key % 1000)
        span = m + 4 * e + 2
        for a in range(0, len(of), 2048):
            part = of[a : a + 2048]
            at = low[part][:, None] + np.arange(span)
            inside = (at >= offsets[doc[part]][:, None]) & (at < offsets[doc[part] + 1][:, None])
            texts = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0)
            patterns = np.stack([np.frombuffer(segs.text[s], np.uint8) for s in seg[part]])
            edits, end = banded(patterns, texts, e)
            for x in np.flatnonzero(edits <= e).tolist():
                d = int(doc[part[x]])
                out.append((d, int(seg[part[x]]), int(edits[x]), int(low[part[x]] + end[x] - offsets[d])))
    return out


def _candidates(segs: Segments, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, segment, first place): regions of documents, by bytes, that reach the lemma's bound."""
    none = (np.zeros(0, np.int64),) * 3
    q = segs.q
    if len(data) < q or not len(segs.grams):
        return none
    at, k = segs.find(qgrams(data, q))
    # a region of any segment needs the least bound of shared grams within a segment's length and edits
    need, reach = int(segs.bound.min()), int((segs.lengths + segs.edits).max())
    if len(at) < need:
        return none
    first = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < reach)
    cover = np.zeros(len(at) + 1, np.int64)
    cover[: len(at)] += np.bincount(first, minlength=len(at))[: len(at)]
    cover -= np.bincount(np.searchsorted(at, at[first] + reach), minlength=len(at) + 1)
    dense = np.cumsum(cover[:-1]) > 0
    at, k = at[dense], k[dense]
    doc = np.searchsorted(offsets, at, "right") - 1
    dense = at + q <= offsets[doc + 1]
    at, k, doc = at[dense], k[dense], doc[dense]
    out = []
    step = 200_000
    sizes = segs.cut[k + 1] - segs.cut[k]
    edges = np.searchsorted(np.cumsum(sizes), np.arange(step, int(sizes.sum()) + step, step), "left") + 1
    marks = [0]
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc))
    for e in edges:  # whole documents at a time, so that no band is cut
        to = int(ends[np.searchsorted(ends, min(e, len(doc)), "left")]) if len(doc) else 0
        if to > marks[-1]:
            marks.append(to)
    for a, b in zip(marks, marks[1:]):
        n = sizes[a:b]
        total = int(n.sum())
        entry = np.arange(total) + np.repeat(segs.cut[k[a:b]] - (np.cumsum(n) - n), n)
        seg, place, d = segs.owner[entry].astype(np.int64), segs.place[entry].astype(np.int64), np.repeat(doc[a:b], n)
        longest = int(segs.lengths.max())
        diagonal = np.repeat(at[a:b], n) - place - offsets[d] + longest
        width = segs.edits[seg] + 1
        bands = int(diagonal.max(initial=0)) // 2 + 2
        pair = ((d - d[0]) * len(segs.text) + seg) * bands if total else d
        for shift in (0, 1):  # overlapping bands of twice the width
            key = (pair + (diagonal + shift * width) // (2 * width)) * longest + place
            key.sort()
            band = key[np.append(True, key[1:] != key[:-1])] // longest  # each Q-gram of the segment counts once
            starts = groups(band)
            band, counts = band[starts[:-1]], np.diff(starts)
            ss = band // bands % len(segs.text)
            good = counts >= segs.bound[ss]
            if good.any():
                ss, band = ss[good], band[good]
                ds, e = band // bands // len(segs.text) + d[0], segs.edits[ss]
                out.append((ds, ss, (2 * (band % bands) - shift) * (e + 1) - longest + offsets[ds] - e))
    if not out:
        return none
    return tuple(np.concatenate(x) for x in zip(*out))


HITS = "doc_id long, item_id long, edits int, segment_at int, segment_chars int, found_at int, found_chars int"


def _block_hits(docs: DataFrame, items: list, options: dict) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def find(batches):
        segs = Segments(sent.value, **options)
        short = Short(sent.value, max(options.get("least", LEAST), segs.q))
        for batch in chunks(batches):
            w, offsets = _cleaned(batch.column("text"))
            data = w.data
            ids = batch.column("doc_id").to_pylist()
            best: dict = {}
            for d, s, e, end in _verified(segs, data, offsets, _candidates(segs, data, offsets)):
                key, hit = (d, segs.item[s]), (e, segs.at[s], len(segs.text[s]), end)
                best[key] = min(best.get(key, hit), hit)
            for d, k, at in short.found(w):
                n = len(short.text[k])
                for item in short.items[k]:
                    best[d, item] = min(best.get((d, item), (0, 0, n, at + n)), (0, 0, n, at + n))
            rows = [(ids[d], item, e, at, n, max(0, end - n), n) for (d, item), (e, at, n, end) in best.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 2 + [pa.int32()] * 5)], [x.split()[0] for x in HITS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, HITS)


def hits(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row for each document of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text) that it holds a part of: the best segment, its edits and where it is found.

    Places count UTF-8 bytes of the compared form. The benchmark is a query set: it is taken in blocks of
    BLOCK_CHARS characters, each broadcast, and the documents are read once for each block. Nothing is shuffled.
    """
    out, block, held = None, [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        data, _ = clean(pa.array([row[1]]))
        block.append((row[0], data.tobytes().rstrip(b" ")))
        held += len(data)
        if held >= BLOCK_CHARS:
            part = _block_hits(docs, block, options)
            out, block, held = part if out is None else out.unionByName(part), [], 0
    if block or out is None:
        part = _block_hits(docs, block, options)
        out = part if out is None else out.unionByName(part)
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no part of a benchmark text."""
    keyed = docs.select("doc_id", "text")
    found = written(hits(keyed, benchmark, **options).select(F.col("doc_id").alias("_hl_held")).distinct(), "contaminated")
    found = F.broadcast(found) if found.count() <= 400_000 else found
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_hl_held")), "left_anti")
