"""Language identification by a bit-sliced Bloom filter of character n-grams.

A table holds the Bloom filters of WORD languages side by side: slot i is a word whose bit l belongs to language l. The words
at an n-gram's HASHES slots, and-ed, give at once every language whose filter contains it. There are as many tables as the languages need. A document's count for
a language is the popcount of that bit over its n-grams; counts are corrected for the filter's false positives
((count - n * rate) / (1 - rate)), and the largest decides.

A language's filter holds its typical n-grams: those whose rate in it reaches SHARE of the largest rate in
any language and which occur at least LEAST times, the FILTER most frequent at most.

Null text, or text without a letter, is ``und`` with score 0. Ties go to the language first by code
point. Without training rows every document is ``und``. Rows that repeat are predicted alike. A very long text is one chunk of a
worker. An empty table gives an empty result. Columns other than doc_id, text and lang are not read; accepted() passes all on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopline.llm.textvec import chunks, mix

UNKNOWN = "und"
N = 3
HASHES = 3
SLOTS = 1 << 17
#: Languages of a table, a bit of its words for each.
WORD = 64
#: About so many labelled documents of each language are counted, chosen by hash.
SAMPLE = 2000
#: N-grams in a language's filter, at most.
FILTER = 8000
LEAST = 3
SHARE = 0.4
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@dataclass
class Model:
    languages: list[str]
    tables: np.ndarray  # uint64, tables by slots; bit l of table t: language t * WORD + l
    rates: np.ndarray  # of false positives


def _ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams as 64-bit numbers, the document of each, whether each document has a letter). Case is folded; all but letters is one space."""
    lists = [t or "" for t in texts.to_pylist()]
    joined = " ".join(lists).lower() + " "
    lengths = np.array([len(t.lower()) if not t.isascii() else len(t) for t in lists], np.int64) + 1
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(codes)
    owner = np.repeat(np.arange(len(lists)), lengths)
    has = np.zeros(len(lists), bool)
    has[owner[letter]] = True
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character after a word, as its space
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    if len(codes) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    grams = codes[: 1 - N].copy()
    for i in range(1, N):
        grams = (grams << np.uint64(21)) | codes[i : len(codes) - N + 1 + i]
    within = owner[: 1 - N] == owner[N - 1 :]
    return grams[within], owner[: 1 - N][within], has


_letter_table: list[np.ndarray] = []


def _letters(codes: np.ndarray) -> np.ndarray:
    if not _letter_table:
        _letter_table.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letter_table[0][codes]


def _slots(grams: np.ndarray, seed: np.uint64, slots: int) -> np.ndarray:
    return (mix(grams * seed) >> np.uint64(64 - int(math.log2(slots)))).astype(np.int64)


def fit(labelled: DataFrame, sample: int = SAMPLE, slots: int = SLOTS, filter_size: int = FILTER) -> Model:
    """A model from ``labelled`` (text, lang, doc_id); rows without lang or text don't count.

    Documents are counted about ``sample`` for each language: a language with more is thinned by the hash of
    doc_id. N-grams are added up on the executors, and at most ``filter_size`` for each language reach the
    driver.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = rows.groupBy("lang").count().collect()
    if not found:
        return Model([], np.zeros((0, slots), np.uint64), np.zeros(0))
    languages = sorted((r["lang"] for r in found), key=lambda x: [ord(c) for c in x])
    limits = labelled.sparkSession.createDataFrame([(r["lang"], int(min(1.0, sample / r["count"]) * (1 << 30))) for r in found], "lang string, below long")
    hashed = rows.select("lang", "text", F.xxhash64(F.coalesce("doc_id", F.lit(0))).bitwiseAND((1 << 30) - 1).alias("hash"))
    chosen = hashed.join(F.broadcast(limits), "lang").where("hash < below").select("lang", "text")

    def count(batches):
        for batch in chunks(batches):
            grams, owner, _ = _ngrams(batch.column("text"))
            names = batch.column("lang").to_pylist()
            for lang in set(names):
                values, counts = np.unique(grams[np.array([x == lang for x in names])[owner]], return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(values)), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    counts = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.where(F.col("n") >= LEAST)
    # the sample bounds the n-grams of a language, and so the groups of the window
    top = counts.groupBy("lang").agg(F.sum("n").alias("all")).hint("broadcast")
    rated = counts.join(top, "lang").withColumn("rate", F.col("n") / F.col("all"))
    best = rated.groupBy("gram").agg(F.collect_list(F.struct("lang", "rate")).alias("of"), F.max("rate").alias("most"))
    typical = best.select("gram", F.explode("of").alias("x"), "most").select("gram", "x.lang", "x.rate", "most").where(F.col("rate") >= SHARE * F.col("most"))
    ranked = typical.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "gram")))
    kept = ranked.where(F.col("place") <= filter_size).select("lang", "gram").toPandas()
    of = {lang: g.to_numpy(np.int64).view(np.uint64) for lang, g in kept.groupby("lang")["gram"]}
    tables, rates = np.zeros((-(-len(languages) // WORD), slots), np.uint64), []
    for i, lang in enumerate(languages):
        table, bit = tables[i // WORD], np.uint64(1 << i % WORD)
        for seed in _SEEDS[:HASHES]:
            table[_slots(of.get(lang, np.zeros(0, np.uint64)), seed, slots)] |= bit
        rates.append((np.count_nonzero(table & bit) / slots) ** HASHES)
    return Model(languages, tables, np.array(rates))


def scores(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(language number or -1, score) of each text. The score is the winner's corrected count by n-gram, 0 to 1."""
    n = len(texts)
    if not model.languages:
        return np.full(n, -1), np.zeros(n)
    grams, owner, has = _ngrams(texts)
    slots = [_slots(grams, seed, model.tables.shape[1]) for seed in _SEEDS[:HASHES]]
    of = np.bincount(owner, minlength=n).astype(float)
    best, top = np.zeros(n, np.int64), np.full(n, -1.0)
    for t, table in enumerate(model.tables):
        members = np.full(len(grams), 2**64 - 1, np.uint64)
        for at in slots:
            members &= table[at]
        for bit, rate in enumerate(model.rates[t * WORD : (t + 1) * WORD]):
            hits = np.bincount(owner, weights=((members >> np.uint64(bit)) & np.uint64(1)).astype(float), minlength=n)
            count = np.maximum(0, (hits - of * rate) / (1 - rate))
            better = count > top  # the first of equal ones stays
            best[better], top[better] = t * WORD + bit, count[better]
    share = np.clip(top / np.maximum(of, 1), 0, 1)
    known = has & (top > 0)
    first = has & ~known & (len(model.languages) > 0)  # letters, but no n-gram that any language has
    return np.where(known | first, best, -1), np.where(known, share, 0.0)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs``; only doc_id and text are read, nothing is shuffled.

    The model is broadcast: 8 bytes for each slot, 1 MB for each WORD languages.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.tables, model.rates))

    def predict(batches):
        m = Model(*sent.value)
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in chunks(batches):
            best, score = scores(m, batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a score of at least ``least``."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.tables, model.rates))

    def keep(batches):
        m = Model(*sent.value)
        for batch in chunks(batches):
            best, score = scores(m, batch.column("text"))
            yield batch.filter(pa.array((best >= 0) & (score >= least)))

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """The fold that training never sees: crc32 of doc_id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


