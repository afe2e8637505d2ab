"""SimHash near-duplicate detection by a binary trie self-join (operator 1).

1. Each text gets a 64-bit fingerprint: a bit is 1 if it is set in over half the XXH64 (seed 42) values of its
   word shingles. Equal texts meet in one row of the distinct fingerprints, so copies are never paired.
2. The self-join runs on a binary trie whose bits are read in several orders. If two fingerprints differ in at most
   k bits, some `matched` of `blocks` bit blocks are free of differences (blocks - matched = k); an order starts with
   those blocks. The top of the trie is then spent without a differing bit, so some of its bits are the shuffle key, no
   more than it takes for buckets of a few thousand fingerprints. In a bucket a task walks node pairs together, from the
   node down bit by bit, adds up differing bits (none are allowed in the leading blocks) and leaves a pair of subtries
   once the budget is exceeded. Buckets beyond `bucket_rows` are keyed by all of their leading blocks, and if that isn't
   enough split by the next trie levels into node pairs of their own, with what is left of the budget, until every task
   is small: no bucket is capped.
3. Each bucket returns a spanning forest of its links, never all its pairs; connected components come from
   alternating large-star and small-star steps on Spark tables.

Null and empty texts have the fingerprint 0 and are linked like any other. Rows that repeat a doc_id are kept; a null
doc_id never names a component unless the component has no other id. Input must be a stored (repeatable) table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
_SLICE = 100_000


def _bit_counts(hashes: list[int], starts: list[int]) -> np.ndarray:
    """Of each run of hashes that begins at starts, how often each of the 64 bits is set (most significant first)."""
    raw = np.array(hashes, dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(np.unpackbits(raw, axis=1), starts, axis=0, dtype=np.int64)


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).reshape(-1)


def fingerprints(texts: list[str | None], shingle_words: int) -> np.ndarray:
    """64-bit fingerprints of whole texts."""
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    starts: list[int] = []
    rows: list[int] = []

    def close() -> None:
        if rows:
            counts = _bit_counts(hashes, starts)
            sizes = np.diff(np.append(starts, len(hashes)))[:, None]
            out[rows] = _pack(2 * counts > sizes)
            hashes.clear(), starts.clear(), rows.clear()

    for i, text in enumerate(texts):
        words = common.words_of(text)
        if not words:
            continue
        n = len(words) - shingle_words + 1
        if n <= _SLICE:
            starts.append(len(hashes))
            rows.append(i)
            if n <= 1:
                hashes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
            else:
                hashes.extend(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(shingle_words)), strict=False)), repeat(SEED)))
            if len(hashes) >= _SLICE:
                close()
            continue
        total = np.zeros((1, 64), np.int64)  # a very long text: its shingles in slices
        for a in range(0, n, _SLICE):
            part = words[a : min(a + _SLICE, n) + shingle_words - 1]
            total += _bit_counts([xxhash.xxh64_intdigest(b" ".join(part[k : k + shingle_words]), SEED) for k in range(len(part) - shingle_words + 1)], [0])
        out[i] = _pack(2 * total > n)[0]
    close()
    return out


def with_fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a long."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            texts = batch.column(1).to_pylist()
            fps = [fingerprints(texts[a:b], shingle_words) for a, b in common.batches(texts)]
            if fps:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(fps).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def block_plan(max_bits: int) -> tuple[int, int]:
    """(blocks, matched): for a budget of k bits, how many blocks there are, and how many of them must be equal."""
    matched = 1 if max_bits <= 2 else 2 if max_bits <= 4 else 3
    return max_bits + matched, matched


def trie_orders(max_bits: int) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """Bit orders as lists of (shift, width) blocks, leading blocks first, and the width of each order's key."""
    blocks, matched = block_plan(max_bits)
    edges = [round(64 * b / blocks) for b in range(blocks + 1)]
    spans = [(64 - edges[b + 1], edges[b + 1] - edges[b]) for b in range(blocks)]
    orders, keys = [], []
    for chosen in combinations(range(blocks), matched):
        orders.append([spans[b] for b in chosen] + [spans[b] for b in range(blocks) if b not in chosen])
        keys.append(sum(spans[b][1] for b in chosen))
    return orders, keys


def reorder(fps: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """The bits of fps in the given order of blocks."""
    out = np.zeros_like(fps)
    for shift, width in order:
        out = (out << np.uint64(width)) | ((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def _halves(values: np.ndarray, first: np.ndarray, last: np.ndarray, bit: int) -> np.ndarray:
    """Where the 1-branch of each trie node values[first:last] begins; all its values agree above `bit`."""
    above = values[first] >> np.uint64(bit) | np.uint64(1)
    return np.clip(np.searchsorted(values, above << np.uint64(bit)), first, last)


def _walk(a: np.ndarray, b: np.ndarray, own: bool, max_bits: int, free_bits: int, wave: int, skip: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with at most max_bits differing bits across two sorted arrays (own: of one array with itself), in blocks.

    A range of a sorted array is a trie node. Node pairs go down together from the root, all of a wave by one bit at a
    time, with the bits in which they differ so far; a pair whose budget is exceeded is left. In the first free_bits
    bits no difference is allowed. At most about `wave` node pairs are walked at once, the others wait. `skip` marks
    node pairs to leave out.
    """
    if not len(a) or not len(b):
        return
    top = int(a[0] ^ a[-1] | b[0] ^ b[-1] | a[0] ^ b[0]).bit_length() - 1  # all agree above
    waiting = [(top, np.array([[0, len(a), 0, len(b), 0]], np.int64))]
    while waiting:
        bit, nodes = waiting.pop()
        if len(nodes) > wave:
            waiting.append((bit, nodes[wave:]))
            nodes = nodes[:wave]
        single = (nodes[:, 1] - nodes[:, 0] == 1) & (nodes[:, 3] - nodes[:, 2] == 1)
        if single.any() or bit < 0:
            # one fingerprint on each side (or equal ones): what is left of the bits at once
            ends = nodes[single] if bit >= 0 else nodes
            i, j = ends[:, 0], ends[:, 2]
            near = (np.bitwise_count(a[i] ^ b[j]) <= max_bits) & ~(own & (i == j))
            if near.any():
                yield i[near], j[near]
            nodes = nodes[~single] if bit >= 0 else nodes[:0]
        if not len(nodes):
            continue
        nodes = nodes[~skip(nodes)]
        a0, a1, b0, b1, spent = nodes.T
        am, bm = _halves(a, a0, a1, bit), _halves(b, b0, b1, bit)
        same = own & (a0 == b0)
        down = [np.stack(x, 1) for x in ((a0, am, b0, bm, spent), (am, a1, bm, b1, spent))]
        if bit < 64 - free_bits:
            down.append(np.stack((a0, am, bm, b1, spent + 1), 1))
            down.append(np.stack((am, a1, b0, bm, spent + 1), 1)[~same])
        nodes = np.concatenate(down)
        nodes = nodes[(nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3]) & (nodes[:, 4] <= max_bits)]
        lone = own & (nodes[:, 0] == nodes[:, 2]) & (nodes[:, 1] - nodes[:, 0] == 1)
        if len(nodes := nodes[~lone]):
            waiting.append((bit - 1, nodes))


def trie_pairs(a: np.ndarray, b: np.ndarray | None, max_bits: int, wave: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs with at most max_bits differing bits, of one sorted array of distinct values (b is None) or across two."""
    found = list(_walk(a, a if b is None else b, b is None, max_bits, 0, wave, lambda nodes: np.zeros(len(nodes), bool)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index in each node's component; label holds those of the links so far."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def trie_labels(a: np.ndarray, b: np.ndarray | None, max_bits: int, free_bits: int = 0, wave: int = 200_000, held_pairs: int = 200_000) -> np.ndarray:
    """For each index of a, then of b, the smallest one that it is linked to, directly or not.

    Holds held_pairs pairs and those of one wave at once. Node pairs whose members all are in one component already can
    add nothing and are skipped, so a dense group costs about as many comparisons as it has members.
    """
    own, n = b is None, len(a)
    b, shift = (a, 0) if own else (b, n)
    label = np.arange(n if own else n + len(b))
    if own and n > 1:  # neighbours first: they join most of a dense group
        near = np.flatnonzero(np.bitwise_count(a[1:] ^ a[:-1]) <= max_bits)
        label = _forest(label, near, near + 1)
    changes = None

    def joined(nodes: np.ndarray) -> np.ndarray:
        nonlocal changes
        if changes is None:  # how often the label changes before each index
            changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        a0, a1, b0, b1 = nodes[:, 0], nodes[:, 1] - 1, nodes[:, 2] + shift, nodes[:, 3] + shift - 1
        return (label[a0] == label[b0]) & (changes[a0] == changes[a1]) & (changes[b0] == changes[b1])

    left, right, held = [], [], 0
    for i, j in _walk(a, b, own, max_bits, free_bits, wave, joined):
        left.append(i)
        right.append(j + shift)
        held += len(i)
        if held >= held_pairs:
            label, changes = _forest(label, np.concatenate(left), np.concatenate(right)), None
            left, right, held = [], [], 0
    if held:
        label = _forest(label, np.concatenate(left), np.concatenate(right))
    return label


def _bucket_links(order: int, side: np.ndarray, fps: np.ndarray, orders: list, keys: list, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one bucket's links. side: 0 all with all; 1 and 2 only across."""
    if len(fps) < 2:
        return fps[:0], fps[:0]
    turned = reorder(fps, orders[order])
    at = np.lexsort((turned, side))
    turned, fps, side = turned[at], fps[at], side[at]
    if side[0] == 0:
        label = trie_labels(turned, None, max_bits, keys[order])
    else:
        ones = int(np.count_nonzero(side == 1))
        label = trie_labels(turned[:ones], turned[ones:], max_bits, keys[order])
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[moved]], fps[moved]


def _buckets(distinct: DataFrame, max_bits: int, depth: int) -> DataFrame:
    """(order, key, side, budget, level, fp): the fingerprints under each node of each order that is `depth` bits down, all in the leading blocks."""
    orders, keys = trie_orders(max_bits)
    blocks, matched = block_plan(max_bits)
    entries = [F.struct(F.lit(t).alias("order"), F.shiftrightunsigned(_leading(order[:matched]), max(0, keys[t] - depth)).alias("key")) for t, order in enumerate(orders)]
    return distinct.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.order", "e.key", F.lit(0).alias("side"), F.lit(max_bits).alias("budget"), F.lit(0).alias("level"), "fp")


def _leading(blocks: list[tuple[int, int]]) -> Column:
    """The bits of fp in some blocks of an order."""
    bits = F.lit(0).cast("long")
    for shift, width in blocks:
        bits = F.shiftleft(bits, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
    return bits


def _deepen(hot: DataFrame, max_bits: int) -> DataFrame:
    """The same rows under the nodes at the end of the leading blocks."""
    orders, _ = trie_orders(max_bits)
    key = F.lit(None).cast("long")
    for t, order in enumerate(orders):
        key = F.when(F.col("order") == t, _leading(order[: block_plan(max_bits)[1]])).otherwise(key)
    return hot.withColumn("key", F.xxhash64(key, F.lit(-1)))


def _split(hot: DataFrame, max_bits: int, step: int = 4) -> DataFrame:
    """Node pairs `step` levels further down for buckets that are too large, with what is left of their budget."""
    orders, keys = trie_orders(max_bits)
    turned = None
    for t, order in enumerate(orders):
        turned = F.when(F.col("order") == t, _leading(order)) if turned is None else turned.when(F.col("order") == t, _leading(order))
    key_bits = F.element_at(F.array(*map(F.lit, keys)), F.col("order") + 1)
    shift = F.greatest(F.lit(0), F.lit(64 - step) - key_bits - step * F.col("level"))
    own = F.expr("shiftrightunsigned(turned, shift)").bitwiseAND(F.lit((1 << step) - 1).cast("long"))
    masks = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(m.bit_count()).alias("d")) for m in range(1 << step) if m.bit_count() <= max_bits))
    other = F.col("own").bitwiseXOR(F.col("x.m"))
    return (
        hot.withColumns({"turned": turned, "shift": shift}).withColumn("own", own).withColumn("x", F.explode(masks))
        .where("x.d <= budget")
        .select(
            "order",
            F.xxhash64("key", "level", F.when(F.col("side") == 2, other).when(F.col("side") == 1, F.col("own")).otherwise(F.least("own", other)), F.when(F.col("side") == 2, F.col("own")).when(F.col("side") == 1, other).otherwise(F.greatest("own", other)), F.col("side") == 0).alias("key"),
            F.when((F.col("side") != 0) | (F.col("x.m") == 0), F.col("side")).when(F.col("own") < other, 1).otherwise(2).alias("side"),
            (F.col("budget") - F.col("x.d")).alias("budget"),
            (F.col("level") + 1).alias("level"),
            "fp",
        )
    )


def near_links(distinct: DataFrame, max_bits: int = 2, bucket_rows: int = 20_000) -> DataFrame:
    """(a, b): links that connect exactly the distinct fingerprints that are at most max_bits apart."""
    orders, keys = trie_orders(max_bits)
    spark = distinct.sparkSession
    # nodes so deep that an even spread gives each an eighth of bucket_rows; larger ones go down, then are split in pairs
    depth = max(0, math.ceil(math.log2(max(1, distinct.count() * 8 / bucket_rows))))
    ready, todo = [], _buckets(distinct, max_bits, depth)
    for turn in range(1 + -(-64 // 4)):
        hot = todo.groupBy("order", "key").count().where(F.col("count") > bucket_rows).select("order", "key")
        hot = common.materialise(hot, "simhash-hot")
        if hot.isEmpty():
            ready.append(todo)
            break
        ready.append(todo.join(hot, ["order", "key"], "left_anti"))
        large = todo.join(hot, ["order", "key"], "left_semi")
        todo = common.materialise(_split(large, max_bits) if turn else _deepen(large, max_bits), "simhash-split")
    else:
        ready.append(todo)
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None

        def links(order, key, side, fp):
            starts = np.flatnonzero(np.append(True, (order[1:] != order[:-1]) | (key[1:] != key[:-1])))
            ends = np.append(starts[1:], len(key))
            many = np.flatnonzero(ends - starts > 1)
            a, b = [], []
            for k in many:
                s, e = starts[k], ends[k]
                x, y = _bucket_links(int(order[s]), side[s:e], fp[s:e], orders, keys, max_bits)
                if len(x):
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

        for batch in batch_iter:
            part = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy().view(np.uint64)]
            if not len(part[0]):
                continue
            if held is not None:
                part = [np.concatenate(p) for p in zip(held, part, strict=True)]
            last = np.flatnonzero((part[0] != part[0][-1]) | (part[1] != part[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from links(*(p[:cut] for p in part))
            held = tuple(p[cut:] for p in part)
        if held is not None:
            yield from links(*held)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.select("order", "key", "side", "fp").repartition(parts, "order", "key").sortWithinPartitions("order", "key").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of the links, the smallest node that it reaches. Alternating star contraction, until nothing changes."""
    edges = common.materialise(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = sign(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        edges = common.materialise(small, "stars")
        after = sign(edges)
        if after == before:
            break
        before = after
    stars = edges.groupBy("u").agg(F.min("v").alias("v"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id, n_same): one row per document; n_same counts documents of the same fingerprint."""
    rows = common.materialise(with_fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    distinct = common.materialise(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n_same")), "distinct")
    comps = common.materialise(components(near_links(distinct.select("fp"), max_bits)), "components")
    reached = comps.join(distinct, comps["node"] == distinct["fp"]).groupBy("root").agg(F.min("first").alias("component_id"))
    linked = comps.join(reached, "root").select(F.col("node").alias("fp"), "component_id")
    # a stored table, so that the join below reads both sides from a shuffle and Spark can split a fingerprint of many copies
    named = common.materialise(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n_same"), "named")
    return rows.join(named, "fp").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_same")


def keep_one(docs: DataFrame, shingle_words: int = 5, max_bits: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate group: the first by id (nulls last), one row where rows repeat.

    The columns of docs are returned unchanged, whatever their names. docs must be a stored table, whose rows keep
    their partition and order when it is read again.
    """
    key = "__sessionloom_row"
    common.pin_splits(docs.sparkSession)
    keyed = docs.withColumn(key, F.monotonically_increasing_id())
    slim = keyed.select(F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), F.col(key).alias("row")).alias("who"), F.col(text_col).alias("text"))
    rows = common.materialise(with_fingerprints(slim, shingle_words, "who", "text"), "fingerprints")
    distinct = common.materialise(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    comps = components(near_links(distinct.select("fp"), max_bits))
    chosen = distinct.join(comps, distinct["fp"] == comps["node"], "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return keyed.join(chosen.select(F.col("first.row").alias(key)), key, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
