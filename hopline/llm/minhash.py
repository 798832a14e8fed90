"""Near-duplicate documents by bottom-k sketches.

One hash function maps a document's word shingles to numbers; its sketch is the K least. Inverted lists of retained values
generate overlaps. Of the P least of a union of two sets with Jaccard J, as many are shared as a binomial says, so pairs at the
threshold share ``_overlap`` of their P least values at least, but for a chance under 1e-9. Two sets that share o of p values
meet in the lists of their p - o + 1 rarest ones already: each set enters those lists alone, and values that many documents share
(common passages, templates) are left to the documents that consist of them. Inside a list, the sketch of the union
estimates Jaccard; pairs six standard deviations below the threshold are no candidates. Candidates form families (their
connected components), and inside a family exact Jaccard on the full sets decides.

Equal sets are one node from the start. Lists and families never emit all their pairs: a search from node to node over those not
yet reached gives a spanning forest, so a group of n near copies yields n - 1 links. Groups above a bound (LIST members, FAMILY
shingles) are cut into blocks, each searched together with the group's least member. What that joins, need not meet again:
only pairs of blocks that hold different components are searched after it. Either way every pair that may matter meets in
some task, and no task holds more than its bound.

Words are runs of anything but ASCII white space, A-Z lower-cased. A text with fewer words than a shingle has one
shingle, all of it; null or blank text has none and is linked with nothing. Rows that share a doc_id are one node.
Null doc_ids are one node too, greater than all others. An empty table gives an empty result. A very long text is one chunk
of a worker. Columns other than doc_id and text are not read; one_of_each passes them on, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopline.llm._shared import bloom, discard_since, in_bloom, made, partitions, written
from hopline.llm.components import connected
from hopline.llm.textvec import LOWER, Words, chunks, flatten, flatten_binary, gather, groups, release_memory

SHINGLE, PERCENT = 5, 80
K, P = 64, 192
LAST_ID = 2**63 - 1
#: Members of a list in one task, at most.
LIST = 4096
#: Shingles of a family in one task, at most (8 bytes each).
FAMILY = 4 << 20
#: Values in more sketches than this are hot: the order by rarity looks at them alone.
HOT = 16
#: Rows that are broadcast, at most; hot values that are, at most; values for which a Bloom filter is of use, at most.
FEW, FEW_HOT, MANY = 400_000, 200_000, 8_000_000
PAD = np.uint32(2**32 - 1)


def _overlap(percent: int, p: int) -> int:
    """So many of the p least values of a union are shared at the threshold, but for a chance under 1e-9."""
    j, chance = percent / 100, 0.0
    for o in range(p + 1):
        chance += math.comb(p, o) * j**o * (1 - j) ** (p - o)
        if chance >= 1e-9:
            return max(1, o)
    return p


def prefix_length(n: np.ndarray, percent: int, p: int) -> np.ndarray:
    """How many of a set's n least values (n at most p), the rarest, meet every set at the threshold. Sets that are too small for a partner of
    more than p values are whole there, as their partners are."""
    shared = -(-n * percent // 100)
    return n - np.where(n <= p * percent // 100, shared, np.minimum(_overlap(percent, p), shared)) + 1


def _least_estimate(percent: int, k: int) -> float:
    j = percent / 100
    return j - 6 * math.sqrt(j * (1 - j) / k)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, pointer): the sorted distinct shingle hashes of document d are values[pointer[d]:pointer[d + 1]]."""
    data, offsets = flatten(texts)
    w = Words(LOWER[data], offsets)
    at = w.windows(n)
    doc = np.searchsorted(w.pointer, at, "right") - 1
    hashes = w.runs(at, n)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        hashes = np.concatenate([hashes, w.hash(w.starts[w.pointer[short]], w.ends[w.pointer[short + 1] - 1])])
        doc = np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[fresh], doc[fresh]
    return hashes, np.searchsorted(doc, np.arange(len(texts) + 1))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), "text")


def sketches(docs: DataFrame, shingle: int = SHINGLE, k: int = K, p: int = P, percent: int = PERCENT) -> DataFrame:
    """row, id, n_shingles, print (128 bits of the whole set, null if empty), low (the p least values), take (how many of them are lists), sketch (32 bits of
    each of the k least, padded)."""

    def sketch(batches):
        for batch in chunks(batches):
            values, cut = shingle_sets(batch.column("text"), shingle)
            spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
            prints = [xxhash.xxh3_128_digest(values[a:b].tobytes()) if b > a else None for a, b in spans]
            low = pa.array([values[a : min(b, a + p)].view(np.int64) for a, b in spans], pa.list_(pa.int64()))
            heads = (values >> np.uint64(32)).astype(np.uint32)
            take = prefix_length(np.minimum(np.diff(cut), p), percent, p)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(np.diff(cut)), pa.array(prints, pa.binary()), low, pa.array(take, pa.int32()), pa.array([heads[a : min(b, a + k)].tobytes().ljust(4 * k, b"\xff") for a, b in spans], pa.binary())], ["row", "id", "n_shingles", "print", "low", "take", "sketch"])

    return _rows(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(sketch, "row long, id long, n_shingles long, print binary, low array<long>, take int, sketch binary")


def _union_estimates(one: np.ndarray, many: np.ndarray, k: int) -> np.ndarray:
    """Jaccard of ``one`` (or of its rows) with each row of ``many``, from the k least of the two sketches' union."""
    both = np.sort(np.concatenate([np.broadcast_to(one, many.shape), many], 1), 1)
    real = both != PAD
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    place = np.cumsum(real & ~again, 1)
    within = real & (place <= k)
    return (again & within).sum(1) / np.maximum(1, (within & ~again).sum(1))


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _search(members: np.ndarray, forest: Forest, linked) -> None:
    """Join in ``forest`` what is linked, from node to node: each node is held against those not yet reached from it only."""
    roots = {forest.root(i) for i in members.tolist()}
    if len(roots) == 1:
        return
    left = members
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            y = queue.pop()
            hit = linked(y, left)
            for x in left[hit].tolist():
                forest.join(y, x)
                queue.append(x)
            left = left[~hit]


def list_candidates(sizes: np.ndarray, sketch: np.ndarray, percent: int, k: int) -> Forest:
    """Candidate clusters of one list's members, which ascend in size."""
    n = len(sizes)
    forest = Forest(n)
    least, ratio = _least_estimate(percent, k), percent / 100 - 1e-9
    values, codes = np.unique(sketch, return_inverse=True)
    codes = codes.reshape(sketch.shape).astype(np.int32)
    real = values != PAD
    held = (sketch != PAD).sum(1)
    mark = np.zeros(len(values), np.uint8)

    def linked(y: int, left: np.ndarray) -> np.ndarray:
        s = sizes[left]
        a, b = np.searchsorted(s, sizes[y] * ratio), np.searchsorted(s, sizes[y] / ratio, "right")
        part = left[a:b]
        mark[codes[y]] = real[codes[y]]
        common = mark[codes[part]].sum(1, dtype=np.int64)
        mark[codes[y]] = 0
        union = np.minimum(k, held[y] + held[part] - common)
        at = np.flatnonzero(common >= least * union)
        out = np.zeros(len(left), bool)
        out[a + at[_union_estimates(sketch[y], sketch[part[at]], k) >= least]] = True
        return out

    _search(np.arange(n), forest, linked)
    return forest


def _in_groups(key: str, finish):
    """Batches sorted by ``key``, cut into its groups: finish(columns as lists) -> batch or None."""

    def run(batches):
        held, current = None, None
        for batch in batches:
            values = batch.column(key).to_numpy()
            cut = groups(values)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                part = batch.slice(a, b - a)
                if held is not None and current == values[a]:
                    held.append(part)
                    continue
                if held is not None and (out := finish(pa.Table.from_batches(held))) is not None:
                    yield out
                held, current = [part], values[a]
        if held is not None and (out := finish(pa.Table.from_batches(held))) is not None:
            yield out
        held = None
        release_memory()

    return run


def _edges(ids: np.ndarray, forest: Forest) -> pa.RecordBatch | None:
    pairs = [(ids[i], ids[r]) for i in range(len(ids)) if (r := forest.root(i)) != i]
    return pa.RecordBatch.from_arrays([pa.array([int(x) for x in c], pa.int64()) for c in zip(*pairs)], ["a", "b"]) if pairs else None


class Estimates:
    """Which sketches may belong to sets at the threshold: by the union sketch's estimate of Jaccard."""

    def __init__(self, percent: int, k: int):
        self.percent, self.k = percent, k

    def pairs(self, sizes: np.ndarray, sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _union_estimates(sketch[a], sketch[b], self.k) >= _least_estimate(self.percent, self.k)

    def clusters(self, sizes: np.ndarray, sketch: np.ndarray) -> Forest:
        return list_candidates(sizes, sketch, self.percent, self.k)


def _list_edges(percent: int, score):
    """Batches of list, id, n_shingles, sketch sorted by list: a, b for the stars of the candidate clusters of each list."""
    ratio = percent / 100 - 1e-9

    def solve(lists: np.ndarray, ids: np.ndarray, sizes: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        cut = groups(lists)
        n = np.diff(cut)
        one = cut[:-1][n == 2]  # most lists have two members
        near = np.minimum(sizes[one], sizes[one + 1]) >= ratio * np.maximum(sizes[one], sizes[one + 1])
        one = one[near & (ids[one] != ids[one + 1])]
        one = one[score.pairs(sizes, sketch, one, one + 1)] if len(one) else one
        found = [np.stack([ids[one], ids[one + 1]])]
        for i in np.flatnonzero(n > 2).tolist():
            at = np.arange(cut[i], cut[i + 1])
            at = at[np.lexsort((ids[at], sizes[at]))]
            forest = score.clusters(sizes[at], sketch[at])
            roots = np.array([forest.root(j) for j in range(len(at))])
            found.append(np.stack([ids[at], ids[at[roots]]]))
        both = np.concatenate(found, 1)
        both = np.unique(np.stack([both.max(0), both.min(0)]), axis=1)
        both = both[:, both[0] != both[1]]
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def run(batches):
        kept: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            data, _ = flatten_binary(batch.column("sketch"))
            rows = (batch.column("list").to_numpy(), batch.column("id").to_numpy(), batch.column("n_shingles").to_numpy(), data.view(np.uint32).reshape(batch.num_rows, -1))
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if kept and (last or kept[0][0][0] != rows[0][-1]):
                yield solve(*[np.concatenate(x) for x in zip(*kept, tuple(c[:last] for c in rows))])
                kept = []
            elif last:
                yield solve(*[c[:last] for c in rows])
            kept.append(tuple(np.copy(c[last:]) for c in rows))
        if kept:
            yield solve(*[np.concatenate(x) for x in zip(*kept)])
        kept = []
        release_memory()

    return run


def _entries(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(list, id, n_shingles, sketch for the lists of each node's ``take`` rarest values, those in one node alone left out; long lists: list, n)."""
    spark = nodes.sparkSession
    counts = written(nodes.select(F.explode("low").alias("list")).groupBy("list").agg(F.count("*").alias("n")).where("n > 1"), "list-sizes")
    hot = counts.where(F.col("n") > HOT)
    n_hot, repeated, long_lists = counts.agg(F.count_if(F.col("n") > HOT), F.count("*"), F.count_if(F.col("n") > LIST)).first()
    long_lists = hot.where(F.col("n") > LIST) if long_lists else None
    if n_hot > FEW_HOT or repeated > MANY:
        values = nodes.select("id", "part", "take", F.explode("low").alias("list")).join(counts, "list", "left")
        order = Window.partitionBy("id", "part").orderBy(F.when(F.col("n") > HOT, F.col("n")).otherwise(0), "list")
        rare = values.withColumn("place", F.row_number().over(order)).where((F.col("place") <= F.col("take")) & F.col("n").isNotNull())
        return rare.select("list", "id").join(_payload(nodes), "id").select("list", "id", "n_shingles", "sketch"), long_lists
    table = hot.toArrow().sort_by("list")
    sent = spark.sparkContext.broadcast((table.column("list").to_numpy(), table.column("n").to_numpy(), bloom(counts.select("list"), repeated)))

    def rarest(batches):
        values, numbers, again = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            low = batch.column("low")
            lists, n = low.flatten().to_numpy(), np.diff(low.offsets.to_numpy())
            owner = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(values, lists), max(0, len(values) - 1))
            weight = np.where(values[at] == lists, numbers[at], 0) if len(values) else np.zeros(len(lists), np.int64)
            order = np.lexsort((lists, weight, owner))
            place = np.arange(len(lists)) - np.repeat(np.cumsum(n) - n, n)
            take = order[place < np.repeat(batch.column("take").to_numpy(), n)]
            take = take[in_bloom(again, lists[take])]
            rows = pa.array(owner[take])
            yield pa.RecordBatch.from_arrays([pa.array(lists[take]), *[batch.column(c).take(rows) for c in ("id", "n_shingles", "sketch")]], ["list", "id", "n_shingles", "sketch"])

    return nodes.select("low", "take", "id", "n_shingles", "sketch").mapInArrow(rarest, "list long, id long, n_shingles long, sketch binary"), long_lists


def _payload(nodes: DataFrame) -> DataFrame:
    return nodes.where("part = 0").select("id", "n_shingles", "sketch")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def _blocks(members: DataFrame, bound: int) -> DataFrame:
    """task, id (and what else ``members`` has) for groups above the bound (group, id, weight, least, total): blocks, each with the group's least member."""
    blocks = F.ceil(F.col("total") / max(1, bound // 2))
    everywhere = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.xxhash64("group", j))
    own = F.array(F.xxhash64("group", F.pmod(F.xxhash64("id"), blocks)))
    return members.withColumn("task", F.explode(F.when(F.col("id") == F.col("least"), everywhere).otherwise(own)))


def _across(members: DataFrame, components: DataFrame, bound: int) -> DataFrame:
    """task, id for groups above the bound: pairs of blocks that hold more than one component of the group."""
    rows = members.join(components, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    parts = rows.groupBy("group", "root").agg(F.sum("weight").alias("part"))
    mixed = written(parts.groupBy("group").agg(F.count("*").alias("parts")).where("parts > 1"), "mixed-groups")
    if mixed.isEmpty():
        return rows.where("false").withColumn("task", F.lit(0).cast("long"))
    # a component above half the bound has blocks of its own (home: its root), the rest shares blocks (home: null)
    parts = parts.join(_few(mixed.select("group")), "group", "left_semi").withColumn("home", F.when(F.col("part") > bound // 2, F.col("root")))
    homes = parts.groupBy("group", "home").agg(F.ceil(F.sum("part") / max(1, bound // 4)).alias("blocks"))
    cells = homes.select("group", "home", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    cells = written(cells.select("group", "home", "blocks", "block", F.xxhash64("group", "home", "block").alias("cell")), "blocks")
    other = cells.select("group", F.col("home").alias("home2"), F.col("cell").alias("cell2"))
    tasks = cells.join(other, "group").where(F.col("home").isNull() | F.col("home2").isNull() | (F.col("home") != F.col("home2")))
    tasks = tasks.select("cell", F.xxhash64("group", F.least("cell", "cell2"), F.greatest("cell", "cell2")).alias("task"))
    rows = rows.join(parts.select("group", "root", "home"), ["group", "root"])
    same = homes.select(F.col("group").alias("of"), F.col("home").alias("at"), "blocks")
    rows = rows.join(same, (F.col("group") == F.col("of")) & F.col("home").eqNullSafe(F.col("at")))
    rows = rows.withColumn("cell", F.xxhash64("group", "home", F.pmod(F.xxhash64("id"), F.col("blocks"))))
    return rows.join(tasks, "cell")


def candidates(nodes: DataFrame, percent: int, score) -> DataFrame:
    """Edges a, b between candidates: stars of the candidate clusters of each list.

    Nodes have id, part (0 in one row of each id), n_shingles, low (their values), take (how many of them, rarest first, are lists of the
    node) and sketch, by which ``score`` tells candidates.
    """
    n = partitions(nodes)
    entries, long_lists = _entries(nodes)

    def edges(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "list").sortWithinPartitions("list").mapInArrow(_list_edges(percent, score), "a long, b long").distinct()

    if long_lists is None:
        return edges(entries)
    long_lists = _few(long_lists.select("list"))
    short = edges(entries.join(long_lists, "list", "left_anti"))
    # sets at the threshold lie in one class of sizes or in two neighbouring ones
    size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / -math.log(percent / 100 - 1e-9))
    cut = entries.join(long_lists, "list", "left_semi").select("id", F.explode(F.array(F.xxhash64("list", size_class), F.xxhash64("list", size_class + 1))).alias("group"))
    cut = written(cut.withColumn("weight", F.lit(1)), "long-lists")
    sizes = written(cut.groupBy("group").agg(F.count("*").alias("total"), F.min("id").alias("least")), "list-sizes")
    payload = _payload(nodes)

    def searched(tasks: DataFrame) -> DataFrame:
        return edges(tasks.select(F.col("task").alias("list"), "id").distinct().join(payload, "id").select("list", "id", "n_shingles", "sketch"))

    short = short.unionByName(searched(cut.join(sizes.where((F.col("total") > 1) & (F.col("total") <= LIST)), "group").withColumn("task", F.col("group"))))
    large = written(cut.join(_few(sizes.where(F.col("total") > LIST)), "group"), "large-lists")
    if large.isEmpty():
        return short.distinct()
    first = written(short.unionByName(searched(_blocks(large, LIST))).distinct(), "candidates")
    return first.unionByName(searched(_across(large, connected(first), LIST)))


def family_links(texts: pa.Array, shingle: int, percent: int) -> Forest:
    """Documents joined by exact Jaccard of their full sets.

    Two sets at the threshold share one of their rarest shingles, of as many as may be missing and one more: only such pairs are
    counted. Rarity is that in the family.
    """
    values, cut = shingle_sets(texts, shingle)
    n, sizes = len(texts), np.diff(cut)
    forest = Forest(n)
    codes = np.unique(values, return_inverse=True)[1]
    total = int(codes.max(initial=-1)) + 1
    owner = np.repeat(np.arange(n), sizes)
    order = np.lexsort((codes, np.bincount(codes, minlength=total)[codes], owner))
    place = np.arange(len(codes)) - np.repeat(cut[:-1], sizes)
    head = order[place < np.repeat(sizes + 1 + (-sizes * percent // 100), sizes)]
    first = np.searchsorted(owner[head], np.arange(n + 1))
    by = head[np.argsort(codes[head], kind="stable")]
    starts, holders = np.searchsorted(codes[by], np.arange(total + 1)), owner[by]
    marked, may = np.zeros(total, np.uint8), np.zeros(n, bool)

    def linked(y: int, left: np.ndarray) -> np.ndarray:
        out = np.zeros(len(left), bool)
        at = np.arange(len(left))
        own = codes[head[first[y] : first[y + 1]]]
        met = starts[own + 1] - starts[own]
        if met.sum() < 4 * len(left):
            near = gather(holders, starts[own], met)
            may[near] = True
            at = np.flatnonzero(may[left])
            may[near] = False
        part = left[at]
        fits = 100 * np.minimum(sizes[part], sizes[y]) >= percent * np.maximum(sizes[part], sizes[y])
        at, part = at[fits], part[fits]
        if not len(part):
            return out
        own = codes[cut[y] : cut[y + 1]]
        marked[own] = 1
        ends = np.cumsum(sizes[part])
        shared = np.add.reduceat(marked[gather(codes, cut[part], sizes[part])], ends - sizes[part], dtype=np.int64)
        marked[own] = 0
        out[at] = 100 * shared >= percent * (sizes[part] + sizes[y] - shared)
        return out

    _search(np.arange(n), forest, linked)
    return forest


def _families(docs: DataFrame, families: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links a, b inside the families (id, print, group, weight: its shingles), exact."""
    spark = docs.sparkSession
    sizes = written(families.groupBy("group").agg(F.sum("weight").alias("total"), F.min("id").alias("least"), F.count("*").alias("n")), "family-sizes")
    n_large, members = sizes.agg(F.count_if(F.col("total") > FAMILY), F.sum("n")).first()
    sent = spark.sparkContext.broadcast(bloom(families.select("id"), members or 0))

    def thin(batches):
        some = (b.filter(pa.array(in_bloom(sent.value, b.column("id").to_numpy()))) for b in batches if b.num_rows)
        for batch in chunks(some):
            values, cut = shingle_sets(batch.column("text"), shingle)
            prints = [xxhash.xxh3_128_digest(values[a:b].tobytes()) if b > a else None for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.binary()), batch.column("text")], ["id", "print", "text"])

    def finish(table: pa.Table):
        ids, prints = table.column("id").to_numpy(), table.column("print").to_pylist()
        first = {x: i for i, x in reversed(list(enumerate(prints)))}  # repeated rows
        order = sorted(first.values(), key=lambda i: (ids[i], prints[i]))
        if len(order) < 2:
            return None
        return _edges(ids[order], family_links(table.take(pa.array(order)).combine_chunks().column("text").chunk(0), shingle, percent))

    texts = _rows(docs).mapInArrow(thin, "id long, print binary, text string")
    n = partitions(docs)

    def links(tasks: DataFrame, few: bool) -> DataFrame:
        tasks = tasks.select("id", "print", "task").distinct()
        joined = texts.join(F.broadcast(tasks) if few else tasks, ["id", "print"]).select("id", "print", "text", "task")
        return joined.repartition(n, "task").sortWithinPartitions("task", "id").mapInArrow(_in_groups("task", finish), "a long, b long")

    few = (members or 0) <= FEW
    if not n_large:
        return links(families.withColumn("task", F.col("group")), few)
    rows = families.join(_few(sizes.where(F.col("total") > FAMILY).drop("n")), "group", "left")
    large = written(rows.where(F.col("total").isNotNull()), "large-families")
    small = rows.where(F.col("total").isNull()).select("id", "print", F.xxhash64("group").alias("task"))
    first = written(links(small.unionByName(_blocks(large, FAMILY).select("id", "print", "task")), False), "links")
    return first.unionByName(links(_across(large, connected(first), FAMILY), False))


def resolved(docs: DataFrame, rows: DataFrame, nodes: DataFrame, edges: DataFrame, shingle: int, percent: int) -> DataFrame:
    """id, n_shingles, component for each of ``rows`` (id, n_shingles, print): exact links inside the families that the candidate ``edges`` form.

    Nodes (id, print, n_shingles, copies) are the distinct sets, each with its least id.
    """
    families = connected(edges)
    inside = families.select(F.col("node").alias("id"), "root").unionByName(families.select(F.col("root").alias("id"), "root")).distinct()
    inside = written(inside.join(nodes.select("id", "print", "n_shingles"), "id").select("id", "print", F.col("root").alias("group"), F.col("n_shingles").alias("weight")), "family-members")
    links = _families(docs, inside, shingle, percent)
    some = rows.where("n_shingles > 0")
    twice = some.groupBy("id").agg(F.min("print").alias("x"), F.max("print").alias("y")).where("x <> y").select("id")
    of = some.join(twice, "id", "left_semi").select(F.col("id").alias("row"), "print").distinct().join(nodes.select("print", "id"), "print")
    links = links.unionByName(of.groupBy("row").agg(F.collect_set("id").alias("ids")).select(F.explode("ids").alias("a"), F.array_min("ids").alias("b")))
    roots = written(connected(links), "components")
    linked = nodes.join(roots, F.col("id") == F.col("node"), "left").select("print", F.coalesce("root", "id").alias("component"), (F.col("root").isNotNull() | (F.col("copies") > 1)).alias("many"))
    linked = linked.where("many").drop("many")
    return rows.select("id", "n_shingles", "print").join(linked, "print", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))


def distinct_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(print, copies, id, row, n_shingles for each distinct set, with its least id; the sketches of those rows) of written sketches."""
    own = rows.where("part = 0 and n_shingles > 0").select("row", "id", "n_shingles", "print")
    nodes = own.groupBy("print").agg(F.min(F.struct("id", "row", "n_shingles")).alias("r"), F.count("*").alias("copies"))
    nodes = written(nodes.select("print", "copies", "r.*"), "distinct-sets")
    copies = own.join(nodes.where("copies > 1").select("print", F.col("row").alias("first")), "print").where("row <> first").select("row")
    return nodes, rows.where("n_shingles > 0").join(_few(written(copies, "copies")), "row", "left_anti")


def real(c: str):
    """The doc_id of an id."""
    return F.when(F.col(c) < LAST_ID, F.col(c))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    rows = written(sketches(docs, shingle, k, percent=percent), "sketches").withColumn("part", F.lit(0))
    nodes, lists = distinct_sets(rows)
    found = resolved(docs, rows, nodes, candidates(lists, percent, Estimates(percent, k)), shingle, percent)
    return found.select(real("id").alias("doc_id"), "n_shingles", real("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, without those that have a near duplicate of smaller doc_id; of rows that repeat a doc_id the one of least text stays."""
    before = made()
    found = written(near_duplicates(docs, **options), "near-duplicates")
    discard_since(docs.sparkSession, before)
    gone = found.where("not kept").select(F.col("doc_id").alias("_hl_gone")).distinct()
    gone = F.broadcast(gone) if gone.count() <= FEW else gone
    rest = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_hl_gone")), "left_anti")
    again = written(found.where("kept").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_hl_again")), "repeated-ids")
    if again.isEmpty():
        return rest
    same = F.col("doc_id").eqNullSafe(F.col("_hl_again"))
    first = rest.join(again, same).withColumn("_hl_place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())))
    return rest.join(again, same, "left_anti").unionByName(first.where("_hl_place = 1").select(*[F.col(f"`{c}`") for c in docs.columns]))
