"""Removal of line passages that repeat across the corpus, by content-defined chunks (operator 4).

Each line has a hash. A segment of lines ends where a rolling hash over the last `width` line hashes says so (one value
in `divisor`) or after `max_lines` lines; it also ends before and after a line of `long_words` words or more. All look
at no more than `width` lines back or one ahead, so an insertion moves no boundary beyond the next ones that the hash
sets, and a passage that begins with a long line begins a segment whatever stands before it: without that rule a passage
of two or three lines seldom has a chunk of its own (README). A chunk is two consecutive segments, a segment of several
lines, or a single line of `single_words` words or more. Chunks are counted over all documents by a 64-bit hash; every
occurrence of a repeated one but the first (by id, row and line) is compared with the first byte by byte, and its lines
are removed.

A chunk with more than one in `hot_share` of all occurrences is joined by broadcast: there are at most hot_share of
them. The others meet their occurrences by a shuffle on the hash.

Null texts stay null and empty ones empty; neither has chunks. Rows that repeat count as documents of their own: the
first keeps its lines. A document may end up empty. Blank lines never make a chunk by themselves. Where docs has a
column n_lines or n_removed_lines, it stays as it is and the new one gets an underscore. Input must be a stored table,
whose rows keep their partition and order when it is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_M1, _M2, _U = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64


def chunks(text: str | None, divisor: int = 2, width: int = 2, max_lines: int = 64, long_words: int = 8, single_words: int = 50) -> list[tuple[int, int, int]]:
    """(first line, line after the last, hash) of the chunks of a text."""
    if not text:
        return []
    lines = text.split("\n")
    raw = [line.encode("utf-8", "surrogatepass") for line in lines]
    sizes = [len(r.split()) for r in raw]
    hashes = [xxhash.xxh64_intdigest(r) for r in raw]
    h = np.array(hashes, np.uint64)
    rolling, factor = np.zeros(len(h), np.uint64), _M1
    for back in range(width):
        rolling[back:] += h[: len(h) - back] * factor
        factor *= _M2
    rolling ^= rolling >> _U(31)
    long = np.array(sizes) >= long_words
    ends = np.flatnonzero((rolling % _U(divisor) == 0) | long | np.append(long[1:], False)) + 1
    bounds = [0]
    for end in (*ends.tolist(), len(lines)):
        bounds.extend(range(bounds[-1] + max_lines, end, max_lines))
        if end > bounds[-1]:
            bounds.append(end)
    found = []
    for k in range(len(bounds) - 1):
        for a, b in ((bounds[k], bounds[k + 1]), (bounds[k], bounds[k + 2]) if k + 2 < len(bounds) else (0, 0)):
            if b - a > 1 or (b - a == 1 and sizes[a] >= single_words):
                if any(sizes[a:b]):
                    digest = xxhash.xxh64_intdigest(b"".join(x.to_bytes(8, "little") for x in hashes[a:b]), b - a)
                    found.append((a, b, digest - (1 << 64) if digest >> 63 else digest))
    return found


def _occurrences(keyed: DataFrame, options: dict) -> DataFrame:
    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            texts, at, out = batch.column(2).to_pylist(), [], []
            for i, text in enumerate(texts):
                found = chunks(text, **options)
                at.extend([i] * len(found))
                out.extend(found)
            if out:
                a, b, h = zip(*out, strict=True)
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(h, pa.int64())], names=["row", "id", "a", "b", "h"])

    return keyed.mapInArrow(run, f"row long, id {keyed.schema['id'].dataType.simpleString()}, a int, b int, h long")


def dedup_lines(docs: DataFrame, divisor: int = 2, width: int = 2, max_lines: int = 64, long_words: int = 8, single_words: int = 50, hot_share: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut out of text_col, and the new columns n_lines and n_removed_lines (long)."""
    options = {"divisor": divisor, "width": width, "max_lines": max_lines, "long_words": long_words, "single_words": single_words}
    n_lines, n_removed = (common.free_name(c, docs.columns) for c in ("n_lines", "n_removed_lines"))
    key, cuts = "__sessionloom_row", "__sessionloom_cuts"
    common.pin_splits(docs.sparkSession)
    keyed = docs.withColumn(key, F.monotonically_increasing_id())
    found = common.materialise(_occurrences(keyed.select(F.col(key).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), options), "line-chunks")
    place = F.struct(F.col("id").isNull().alias("null"), "id", "row", "a")
    repeated = common.materialise(found.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"), "line-repeated")
    limit = found.count() / hot_share
    hot, cold = repeated.where(F.col("n") > limit), repeated.where(F.col("n") <= limit)
    met = found.join(F.broadcast(hot), "h").unionByName(found.join(F.broadcast(hot.select("h")), "h", "left_anti").join(cold, "h"))
    cut = met.select("row", F.struct("h", "a", "b", ((F.col("first.row") == F.col("row")) & (F.col("first.a") == F.col("a"))).alias("first")).alias("c")).groupBy("row").agg(F.collect_list("c").alias(cuts))
    joined = common.materialise(keyed.join(cut.withColumnRenamed("row", key), key, "left"), "line-cuts")

    differ = _differences(joined.where(F.col(cuts).isNotNull()).select(F.col(key).alias("row"), F.col(text_col).alias("text"), F.col(cuts).alias("cuts")))
    if not differ.isEmpty():  # two chunks with one hash: keep what isn't equal to the first
        bad = differ.groupBy("row").agg(F.collect_set(F.struct("h", "a")).alias("__sessionloom_bad"))
        joined = joined.join(bad.withColumnRenamed("row", key), key, "left").withColumn(
            cuts, F.when(F.col("__sessionloom_bad").isNull(), F.col(cuts)).otherwise(F.filter(cuts, lambda c: ~F.array_contains("__sessionloom_bad", F.struct(c["h"].alias("h"), c["a"].alias("a"))))))
    gone = F.coalesce(F.array_distinct(F.flatten(F.transform(F.filter(cuts, lambda c: ~c["first"]), lambda c: F.sequence(c["a"], c["b"] - 1)))), F.array().cast("array<int>"))
    lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.length(text_col) - F.length(F.translate(text_col, "\n", "")) + 1)
    measured = joined.withColumns({"__sessionloom_lines": lines.cast("long"), "__sessionloom_gone": gone})
    kept = F.when(F.size("__sessionloom_gone") == 0, F.col(text_col)).otherwise(_without_lines(text_col, "__sessionloom_gone"))
    columns = [kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return measured.select(*columns, F.col("__sessionloom_lines").alias(n_lines), F.size("__sessionloom_gone").cast("long").alias(n_removed))


@F.pandas_udf(T.StringType())
def _without_lines(text: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for t, g in zip(text, gone, strict=True):
        if t is None or g is None or not len(g):
            out.append(t)
        else:
            drop = set(g)
            out.append("\n".join(line for i, line in enumerate(t.split("\n")) if i not in drop))
    return pd.Series(out, dtype=object)


def _differences(rows: DataFrame) -> DataFrame:
    """(h, row, a) of repeated chunks whose bytes aren't those of the first with their hash."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            at, h, a, first, text = [], [], [], [], []
            for i, (t, cuts) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                lines = t.split("\n")
                for c in cuts:
                    at.append(i)
                    h.append(c["h"])
                    a.append(c["a"])
                    first.append(c["first"])
                    text.append("\n".join(lines[c["a"] : c["b"]]))
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(h, pa.int64()), pa.array(a, pa.int32()), pa.array(first, pa.bool_()), pa.array(text, pa.string())], names=["row", "h", "a", "first", "chunk"])

    found = rows.mapInArrow(run, "row long, h long, a int, first boolean, chunk string")
    # equal bytes of one hash meet on the way to the shuffle, so a passage in a third of all documents moves once a task
    kinds = found.groupBy("h", "chunk").agg(F.max("first").alias("first"), F.count("*").alias("n"))
    other = common.materialise(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h"), "line-collisions")
    if other.isEmpty():
        return found.select("h", "row", "a").limit(0)
    mixed = common.materialise(found.join(other, "h", "left_semi"), "line-mixed")
    canon = mixed.where("first").select("h", F.col("chunk").alias("canon"))
    return common.materialise(mixed.join(canon, "h").where("chunk <> canon").select("h", "row", "a"), "line-differences")
