"""Importance resampling to a target distribution: word tries, bucket totals, and a seeded draw without replacement.

Features are the runs of 1 to 2 consecutive words. A task keeps a trie of its words: a node stands for a feature and holds
its count and its CRC-32 state, from which the states of its children follow (a CRC is linear, so the state after a space
and a word is the parent's state moved by the length, and the word's own). When a trie has `max_nodes` nodes, its counts go
into the task's totals of buckets and it starts anew, so memory doesn't follow the partition.

1. Tries over the raw documents and over the target's texts give the totals of `buckets` buckets; a task sends its own sums.
2. A bucket's gain is a floored thousandfold logarithm of how much likelier the target is to use it.
3. Documents walk the tries again, whose nodes now hold gains; a document's weight is the floored mean over its features.
4. A document's score is its weight and Gumbel noise from a hash of its id; the highest scores are drawn. Scores are
   integers between fixed limits, so ranks are sums over the counts of scores, and an order by id within a score.

Null and empty texts and texts without words have no features and weight 0. Documents of fewer than `min_words` words are
scored and never drawn. A null id hashes as an empty one and comes last among ties; rows that repeat an id each count.
An empty target or an empty table leaves totals of zero. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BUCKETS, MAX_NODES = 10_000, 400_000
#: A-Z to a-z, all other ASCII but digits and letters to blanks; bytes of other characters stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class _Moves:
    """CRC-32 states moved by a number of bytes: a linear map for each length, as four tables of 256."""

    def __init__(self) -> None:
        self._tables: dict[int, np.ndarray] = {}

    def _table(self, size: int) -> np.ndarray:
        if size not in self._tables:
            none = zlib.crc32(bytes(size))
            images = np.array([zlib.crc32(bytes(size), 1 << bit) ^ none for bit in range(32)], np.uint32)
            table = np.zeros((4, 256), np.uint32)
            for bit in range(8):
                table[:, 1 << bit : 2 << bit] = table[:, : 1 << bit] ^ images[bit::8][:, None]
            self._tables[size] = table
        return self._tables[size]

    def moved(self, states: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.empty(len(states), np.uint32)
        order = np.argsort(sizes, kind="stable")
        kinds, starts = np.unique(sizes[order], return_index=True)
        for size, a, b in zip(kinds.tolist(), starts, [*starts[1:], len(order)], strict=True):
            table, s = self._table(size), states[order[a:b]]
            out[order[a:b]] = table[0][s & 255] ^ table[1][s >> 8 & 255] ^ table[2][s >> 16 & 255] ^ table[3][s >> 24]
        return out


class WordTrie:
    """Nodes for words (below the root) and for word pairs (below their first word), numbered from 0 in their order of arrival.

    states and counts are by node. A pair is found by its key, (first word's node, second word's node).
    """

    def __init__(self, moves: _Moves) -> None:
        self._moves, self._words, self._pairs = moves, {}, np.zeros(0, np.int64)
        self._pair_nodes = np.zeros(0, np.int64)
        self.states, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self._tails, self._sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.states)

    def _grow(self, states: np.ndarray, tails: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        first = len(self.states)
        self.states, self.counts = np.append(self.states, states), np.append(self.counts, np.zeros(len(states), np.int64))
        self._tails, self._sizes = np.append(self._tails, tails), np.append(self._sizes, sizes)
        return np.arange(first, first + len(states))

    def _word_nodes(self, words: pa.Array) -> np.ndarray:
        coded = words.dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        nodes = np.fromiter((self._words.get(w, -1) for w in kinds), np.int64, len(kinds))
        missing = np.flatnonzero(nodes < 0)
        if len(missing):
            new = [kinds[i] for i in missing]
            states = np.fromiter(map(zlib.crc32, new), np.uint32, len(new))
            tails = np.fromiter((zlib.crc32(b" " + w) for w in new), np.uint32, len(new))
            nodes[missing] = self._grow(states, tails, np.fromiter(map(len, new), np.int64, len(new)) + 1)
            self._words.update(zip(new, nodes[missing].tolist(), strict=True))
        return nodes[coded.indices.to_numpy()]

    def _pair_nodes_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys, own = np.unique(first << 32 | second, return_inverse=True)
        at = np.searchsorted(self._pairs, keys)
        known = self._pairs[np.minimum(at, len(self._pairs) - 1)] == keys if len(self._pairs) else np.zeros(len(keys), bool)
        nodes = np.empty(len(keys), np.int64)
        nodes[known] = self._pair_nodes[at[known]]
        new = keys[~known]
        if len(new):
            a, b = new >> 32, new & 0xFFFFFFFF
            nodes[~known] = self._grow(self._moves.moved(self.states[a], self._sizes[b]) ^ self._tails[b], np.zeros(len(new), np.uint32), np.zeros(len(new), np.int64))
            self._pairs, self._pair_nodes = np.insert(self._pairs, at[~known], new), np.insert(self._pair_nodes, at[~known], nodes[~known])
        return nodes[own]

    def walk(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(nodes of all features of texts, end to end; how many each text has); nodes that are missing are added."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        words = self._word_nodes(pa.array([w for found in lists for w in found], pa.binary()))
        owner = np.repeat(np.arange(len(lists)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs = self._pair_nodes_of(words[inner], words[inner + 1])
        order = np.argsort(np.concatenate([owner, owner[inner]]), kind="stable")
        return np.concatenate([words, pairs])[order], sizes + np.maximum(sizes - 1, 0)


def _texts(table: DataFrame, text_col: str) -> DataFrame:
    return table.select(F.col(text_col).cast("string").cast("binary").alias("text"))


def _lists(column: pa.Array, limit: int = 1_000_000) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """(a, b, words of each text in [a, b)) for slices of about `limit` bytes."""
    for a, b in common.text_slices(column, limit):
        yield a, b, [words_of(t) for t in column.slice(a, b - a).to_pylist()]


def bucket_totals(table: DataFrame, text_col: str = "text", buckets: int = BUCKETS, max_nodes: int = MAX_NODES) -> np.ndarray:
    """How many features of the table's texts fall in each bucket."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, moves = np.zeros(buckets, np.int64), _Moves()
        trie = WordTrie(moves)

        def merge() -> None:
            np.add.at(totals, trie.states % np.uint32(buckets), trie.counts)

        for batch in batch_iter:
            for _, _, lists in _lists(batch.column(0)):
                nodes, _ = trie.walk(lists)
                trie.counts += np.bincount(nodes, minlength=len(trie))
                if len(trie) > max_nodes:
                    merge()
                    trie = WordTrie(moves)
        merge()
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(totals[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in _texts(table, text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored 1000 * ln of the target's smoothed share over the raw one, for each bucket."""
    n = float(len(raw))
    return np.floor(1000 * np.log((target + 1.0) * (float(raw.sum()) + n) / ((raw + 1.0) * (float(target.sum()) + n)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", max_nodes: int = MAX_NODES) -> DataFrame:
    """(id, n_words, n_features, weight) of every document."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = _Moves()
        trie, held = WordTrie(moves), np.zeros(0, np.int64)
        for batch in batch_iter:
            for a, b, lists in _lists(batch.column(1)):
                if len(trie) > max_nodes:
                    trie, held = WordTrie(moves), np.zeros(0, np.int64)
                nodes, sizes = trie.walk(lists)
                held = np.append(held, gains[trie.states[len(held) :] % np.uint32(len(gains))])
                weight = common.segment_sums(held[nodes], sizes) // np.maximum(sizes, 1)
                words = np.fromiter(map(len, lists), np.int64, len(lists))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words), pa.array(sizes), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))) for u from the first 32 bits of the SHA-256 of '<seed>:<id>'."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(id, n_features, weight, score, rank): all documents; those drawn have a rank, from 1 for the highest score."""
    gains = bucket_gains(bucket_totals(docs, text_col, buckets), bucket_totals(target, target_col, buckets))
    scored = common.materialise(weigh(docs, gains, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "resampling")
    able = scored.where(F.col("n_words") >= min_words)
    draw = able.count() * percent // 100
    # as many rows as there are integers between the least and the highest score, whatever the number of documents
    before = able.groupBy("score").agg(F.count("*").alias("n")).select("score", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("before")).where(F.col("before") < draw)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last()))
    able_score = F.when(F.col("n_words") >= min_words, F.col("score"))
    drawn = able.join(F.broadcast(before), "score").select("id", "n_features", "weight", "score", (F.col("before") + place).cast("long").alias("rank"))
    drawn = drawn.select("id", "n_features", "weight", "score", F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    rest = scored.select("id", "n_features", "weight", "score", able_score.alias("able")).join(F.broadcast(before.select(F.col("score").alias("able"))), "able", "left_anti")
    return drawn.unionByName(rest.select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
