"""Packing token sequences into fixed windows (operator 7): best-fit decreasing with a segment tree.

Each task tokenizes its documents and packs them by itself, so nothing is shuffled: a sequence_id carries the task's
partition in its high bits. Documents longer than a window are first cut into full windows; what is left of each is a
piece. Pieces are taken in decreasing length, some `group_tokens` at a time, and each goes to the open window with the
least room that still holds it, which a segment tree indexed by remaining capacity finds. Open windows stay open from
one group to the next. At the end of a task the emptiest windows are cut up to fill the others, so that a task pads
one window at most.

Null and empty texts are documents of the end id alone. Repeated rows are packed like any others. Input must be a
stored (repeatable) table: a task that runs again packs its partition in the same way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


class CapacityTree:
    """Open windows by remaining capacity: a segment tree over capacities that counts the windows below each node."""

    def __init__(self, window: int) -> None:
        self._size = 1 << window.bit_length()
        self._count = [0] * (2 * self._size)
        self._at: list[list[int]] = [[] for _ in range(self._size)]

    def add(self, window_id: int, capacity: int) -> None:
        if capacity:
            self._at[capacity].append(window_id)
            self._move(capacity, 1)

    def _move(self, capacity: int, by: int) -> None:
        node = capacity + self._size
        while node:
            self._count[node] += by
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window with the least capacity >= need: (window, its capacity)."""
        count, node = self._count, need + self._size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up to the first node with a filled right neighbour
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self._size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self._size
        self._move(capacity, -1)
        return self._at[capacity].pop(), capacity


class Packer:
    """Best-fit decreasing over the pieces of one task. A piece is (document, start, length)."""

    def __init__(self, window: int) -> None:
        self.window = window
        self._tree = CapacityTree(window)
        self.windows: dict[int, list[tuple[int, int, int]]] = {}
        self._next = 0

    def _open(self) -> int:
        self._next += 1
        return self._next - 1

    def place(self, lengths: list[tuple[int, int]]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Pack documents (id, length); yields windows as they become full."""
        rest = []
        for doc, length in lengths:
            cut = length - length % self.window
            for start in range(0, cut, self.window):
                yield self._open(), [(doc, start, self.window)]
            if cut < length:
                rest.append((doc, cut, length - cut))
        rest.sort(key=lambda piece: -piece[2])
        for piece in rest:
            found = self._tree.tightest(piece[2])
            window, capacity = found or (self._open(), self.window)
            self.windows.setdefault(window, []).append(piece)
            if capacity == piece[2]:
                yield window, self.windows.pop(window)
            else:
                self._tree.add(window, capacity - piece[2])

    def finish(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """The open windows; the emptiest are cut up to fill the fullest."""
        open_ = sorted(((sum(p[2] for p in pieces), window) for window, pieces in self.windows.items()), reverse=True)
        low = len(open_) - 1
        loose: list[tuple[int, int, int]] = []
        high = 0
        while high <= low:
            used, window = open_[high]
            pieces = self.windows.pop(window)
            room = self.window - used
            while room:
                if not loose:
                    if low <= high:
                        break
                    loose = self.windows.pop(open_[low][1])
                    low -= 1
                doc, start, length = loose.pop()
                take = min(length, room)
                pieces.append((doc, start, take))
                room -= take
                if take < length:
                    loose.append((doc, start + take, length - take))
            high += 1
            yield window, pieces
        if loose:
            yield self._open(), loose


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, lead_space: bool = True, group_tokens: int = 4_000_000, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids with with_ids.

    group_tokens bounds the ids that a task holds at once (besides one batch of texts).
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    columns = ["start long", "length long", "ids_crc32 long", "doc_tokens long", "sequence_id long", "offset long"] + ["ids array<int>"] * with_ids

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = common.piece_encoder(tokenizer_path, lead_space), Packer(window)
        base = TaskContext.get().partitionId() << 40
        doc_ids: dict[int, object] = {}
        ids: dict[int, np.ndarray] = {}
        left: dict[int, int] = {}
        group: list[tuple[int, int]] = []
        number = held = 0
        id_arrow = None

        def rows(windows) -> Iterator[pa.RecordBatch]:
            out: list[list] = [[] for _ in range(7)]
            data: list[np.ndarray] = []
            for sequence, pieces in windows:
                offset = 0
                for doc, start, length in pieces:
                    part = ids[doc][start : start + length]
                    for column, value in zip(out, (doc_ids[doc], start, length, zlib.crc32(part), len(ids[doc]), base + sequence, offset), strict=True):
                        column.append(value)
                    if with_ids:
                        data.append(part)
                    offset += length
                    left[doc] -= length
                    if not left[doc]:
                        done.append(doc)
                if len(out[0]) >= 4000:
                    yield batch_of(out, data)
                    out, data = [[] for _ in range(7)], []
            if out[0]:
                yield batch_of(out, data)
            for doc in done:
                del doc_ids[doc], ids[doc], left[doc]
            done.clear()
            for doc in ids:  # what waits in open windows doesn't keep its batch's ids in memory
                ids[doc] = ids[doc].copy()

        done: list[int] = []

        def batch_of(out: list[list], data: list[np.ndarray]) -> pa.RecordBatch:
            arrays = [pa.array(out[0], id_arrow), *(pa.array(c, pa.int64()) for c in out[1:])]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, data)]), pa.int32()), pa.array(np.concatenate(data), pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=["id"] + [c.split()[0] for c in columns])

        for batch in batch_iter:
            id_arrow = batch.column(0).type
            keys = batch.column(0).to_pylist()
            for a, b in common.text_slices(batch.column(1)):
                flat, sizes = encoder.encode(batch.column(1).slice(a, b - a))
                flat, ends = common.with_ends(flat, sizes, end_id)
                flat = flat.astype("<u4", copy=False)
                for key, end, size in zip(keys[a:b], ends.tolist(), (sizes + 1).tolist(), strict=True):
                    doc_ids[number], ids[number], left[number] = key, flat[end - size : end], size
                    group.append((number, size))
                    number += 1
                held += len(flat)
                if held >= group_tokens:
                    yield from rows(packer.place(group))
                    group, held = [], 0
        yield from rows(packer.place(group))
        yield from rows(packer.finish())

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join([f"id {id_type}", *columns]))


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens) from pieces with ids: each padded to the window, but for lengths that are a power of two."""
    joined = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    return joined.select("sequence_id", F.when(F.bit_count(n.cast("long")) == 1, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - n))).alias("ids"), n.cast("long").alias("n_tokens"))
