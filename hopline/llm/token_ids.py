"""Token ids as Arrow files of fixed-size lists.

Each shard is one Arrow IPC file of the columns ``ids`` (fixed-size list of ``length`` unsigned
integers) and ``mask`` (fixed-size list of booleans, false on padding). A memory map of such a file gives
any sequence as a slice without copying. A second Arrow file beside it says where each document lies:
``doc_id, offset, n_tokens``. Documents follow each other in ascending doc_id order within a shard and from shard
to shard; only a shard's last sequence is padded. A manifest (Parquet) holds one row for each shard.

Null text counts as empty; an empty document has the end id alone. A very long text is one row of one task, and is split into
pieces bit by bit. Null doc_ids come first. Rows that repeat a
doc_id are all written, ordered by their text. An empty table gives an empty manifest. Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopline.llm._shared import blank, partitions, scratch
from hopline.llm.textvec import KEPT, release_memory
from hopline.storage import store as store_of

END_ID = 2
LENGTH = 2048
#: Bytes of words and their ids that a worker keeps; beyond, it starts anew from the words at hand.
MEMO = 20 << 20
#: Characters of texts that are cut into words at once; new words, or pieces of a very long one, that are encoded at once.
CHARS, PIECES = 1 << 21, 1 << 13
ROWS = 64

# Letters, digits and white space up to U+024F, for the splitting pattern of byte-level BPE. Other texts go to the library whole.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t\\n\\r \\xa0"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_RUNS = re.compile(f" (?![^{_S}])(?<=[{_S}] )")  # spaces inside or at the end of longer white space
_OTHER = re.compile("[^\\t\\n\\r -~\\xa0-ɏ‐-‧€]")


def _byte_letters() -> dict[int, str]:
    """The letter for each byte that byte-level BPE works on: printable bytes are themselves, the others follow from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = str.maketrans({chr(b): c for b, c in _byte_letters().items()})


class Encoder:
    """Ids of whole texts by the tokenizers library with its default settings.

    For byte-level BPE without a normaliser, a text's ids are those of its pieces, and a piece starts at each space that stands alone
    or last before a word. So texts are cut there in Arrow, each distinct word is split into pieces and goes through the
    library's model once, and is remembered in Arrow (up to MEMO bytes). All else is encoded as it is, and so are texts
    that hold an added token such as an end mark, which the library gives its own id.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() < 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, words: list[list[str]]) -> list[bytes]:
        """The ids of words given as pieces; the model is asked once for each distinct piece."""
        own = list(dict.fromkeys(chain.from_iterable(words)))
        # no piece holds a zero byte, so its letter stands between them
        letters = "\0".join(own).encode("utf-8", "surrogatepass").decode("latin-1").translate(_BYTES).split(_BYTES[0])
        tokenize, kind = self.tokenizer.model.tokenize, self.dtype().dtype.char
        found = {p: array(kind, [t.id for t in tokenize(x)]).tobytes() for p, x in zip(own, letters)}
        return [b"".join(map(found.__getitem__, p)) for p in words]

    def learned(self, words: pa.Array) -> pa.Array:
        """The ids of new words. A zero byte marks a text's first word, which has no space before it; \\1 is a space that was not cut at."""
        pieces, long = [], {}
        for w in words.to_numpy(zero_copy_only=False).tolist():
            if w.isalpha():
                pieces.append([" " + w])
                continue
            w = (w[1:] if w[:1] == "\0" else " " + w).replace("\1", " ")
            if len(w) > CHARS:  # so many at a time, so that its pieces are never held together
                each = (m.group() for m in _PIECES.finditer(w))
                long[len(pieces)] = b"".join(self.joined([some])[0] for some in iter(lambda: list(islice(each, PIECES)), []))
                pieces.append([])
            else:
                pieces.append(_PIECES.findall(w))
        coded = self.joined(pieces)
        for i, ids in long.items():
            coded[i] = ids
        return pa.array(coded, pa.large_binary())

    def by_word(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without zero bytes and \\1."""
        cut = pc.split_pattern(pa.array(["\0" + _RUNS.sub("\1", t) for t in texts], pa.string()), " ")
        found = cut.flatten().dictionary_encode()
        place = pc.index_in(found.dictionary, value_set=self.words)
        fresh = place.is_null()
        new = found.dictionary.filter(fresh)
        known = pa.concat_arrays([self.ids, *[self.learned(new.slice(i, PIECES)) for i in range(0, len(new), PIECES)]])
        fresh = fresh.to_numpy(zero_copy_only=False)
        place = np.where(fresh, len(self.ids) + np.cumsum(fresh) - 1, place.fill_null(0).to_numpy())
        ids = known.take(pa.array(place[found.indices.to_numpy()]))
        if known.nbytes + self.words.nbytes + new.nbytes <= MEMO:
            self.words, self.ids = pa.concat_arrays([self.words, new]), known
        else:
            self.words, self.ids = found.dictionary, known.take(pa.array(place))
            if self.words.nbytes + self.ids.nbytes > MEMO:
                self.forget()
        _, ends, data = ids.buffers()
        at = np.frombuffer(ends, np.int64)[cut.offsets.to_numpy()].tolist()
        whole = memoryview(data or b"")
        return [bytes(whole[a:b]) for a, b in zip(at, at[1:])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self.whole(texts)
        other = [bool(_OTHER.search(t)) or any(a in t for a in self.added) for t in texts]
        coded = iter(self.by_word([t for t, o in zip(texts, other) if not o]))
        return [self.whole([t])[0] if o else next(coded) for t, o in zip(texts, other)]


_encoders: dict[str, Encoder] = {}
KEPT.append(_encoders)


def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _texts(batch: pa.RecordBatch, size: int = CHARS) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts, about ``size`` characters at a time."""
    ids, texts, held = [], [], 0
    for i, t in zip(batch.column("doc_id"), batch.column("text")):
        ids.append(i.as_py())
        texts.append(t.as_py() or "")
        held += len(texts[-1])
        if held >= size:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


MANIFEST = "shard int, path string, n_docs long, n_tokens long, length int, dtype string"


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int = END_ID, length: int = LENGTH, shards: int | None = None) -> DataFrame:
    """Write the shards of ``docs`` (doc_id, text) under ``out``; returns the manifest, read from its table.

    Documents are range-partitioned by doc_id, so a shard is one task's work and holds no more than its share of
    documents. A task writes under a name of its own and renames at its end: a lost or repeated task leaves no
    half-written shard.
    """
    spark = docs.sparkSession
    n = shards or partitions(docs)

    def shard(batches):
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        kind = pa.from_numpy_dtype(enc.dtype)
        ids_type, mask_type = pa.list_(kind, length), pa.list_(pa.bool_(), length)
        schema = pa.schema([("ids", ids_type), ("mask", mask_type)])
        where = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
        store, root = store_of(out)
        names = [f"{root}/part-{k:06d}.{x}" for x in ("arrow", "docs.arrow")]
        own = [f"{x}.{uuid.uuid4().hex}" for x in names]
        end = np.array([end_id], enc.dtype).tobytes()
        total = n_docs = 0
        store.create_dir(root, recursive=True)

        def rows(tokens: np.ndarray, real: int) -> pa.RecordBatch:
            mask = np.arange(len(tokens)) < real
            return pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(tokens), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema)

        with store.open_output_stream(own[0]) as f, pa.ipc.new_file(f, schema) as seqs, store.open_output_stream(own[1]) as g, pa.ipc.new_file(g, where) as index:
            left = np.zeros(0, enc.dtype)
            for batch in batches:
                for doc_ids, texts in _texts(batch):
                    coded = [x + end for x in enc(texts)]
                    counts = np.array([len(x) // enc.dtype().itemsize for x in coded], np.int64)
                    index.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(total + np.cumsum(counts) - counts), pa.array(counts)], schema=where))
                    total, n_docs = total + int(counts.sum()), n_docs + len(texts)
                    left = np.concatenate([left, np.frombuffer(b"".join(coded), enc.dtype)])
                    full = len(left) // (length * ROWS) * length * ROWS
                    for i in range(0, full, length * ROWS):
                        seqs.write_batch(rows(left[i : i + length * ROWS], length * ROWS))
                    left = left[full:]
            release_memory()
            if len(left):
                padded = np.zeros(-(-len(left) // length) * length, enc.dtype)
                padded[: len(left)] = left
                seqs.write_batch(rows(padded, len(left)))
        for a, b in zip(own, names):
            store.move(a, b) if n_docs else store.delete_file(a)
        if n_docs:
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([f"{out}/part-{k:06d}"]), pa.array([n_docs]), pa.array([total]), pa.array([length], pa.int32()), pa.array([np.dtype(enc.dtype).name])], ["shard", "path", "n_docs", "n_tokens", "length", "dtype"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank().alias("text"))
    rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(shard, MANIFEST).write.parquet(f"{out}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def _open(path: str) -> pa.ipc.RecordBatchFileReader:
    from pyarrow import fs

    store, at = store_of(path)
    return pa.ipc.open_file(pa.memory_map(at) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(at))


def tokens(path: str, dtype: str, at: int, n: int, length: int = LENGTH, reader: pa.ipc.RecordBatchFileReader | None = None) -> np.ndarray:
    """The n token ids from place ``at`` of a shard; only the batches that hold them are touched."""
    reader = reader or _open(f"{path}.arrow")
    step, parts = length * ROWS, []
    while n > 0:
        k, within = divmod(at, step)
        take = min(n, step - within)
        parts.append(reader.get_batch(k).column("ids").flatten().to_numpy()[within : within + take])
        at, n = at + take, n - take
    return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, dtype)])


def read(manifest: DataFrame) -> DataFrame:
    """What the files hold, by document: doc_id, start, n_tokens, ids_crc32, shard, offset.

    start counts the ids of all documents before it; a running sum over the manifest (a row for each shard) gives
    the shard's own. Sequences are read batch by batch.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.withColumn("first", before)

    def docs(batches):
        for batch in batches:
            for s in batch.to_pylist():
                reader = _open(f"{s['path']}.arrow")
                index = _open(f"{s['path']}.docs.arrow")
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    offs, counts = part.column("offset").to_numpy(), part.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(tokens(s["path"], s["dtype"], a, n, s["length"], reader).astype("<u4").tobytes()) for a, n in zip(offs.tolist(), counts.tolist())]
                    yield pa.record_batch([part.column("doc_id"), pa.array(offs + s["first"]), pa.array(counts), pa.array(crc, pa.int64()), pa.array([s["shard"]] * len(crc), pa.int32()), pa.array(offs)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset"])
        release_memory()

    n = max(1, min(partitions(manifest), 4096))
    return shards.repartition(n, "shard").mapInArrow(docs, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, offset long")


def encoded(docs: DataFrame, tokenizer: str, out: str | None = None, **options) -> DataFrame:
    """Write ``docs`` and read the files back."""
    return read(write(docs, out or scratch(docs.sparkSession, "token-ids"), tokenizer, **options))
