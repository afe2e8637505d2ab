"""Sharding by extendible hashing (operator 9), in DataFrame functions only.

A document's hash is the first 60 bits of the MD5 of its id as text. Bytes are summed by a hash prefix that is some
bits longer than even shards would need; from these cells the buckets of all shorter prefixes follow bottom-up, two
children to a parent. A bucket is a shard if it fits the limit and its parent doesn't: only oversized buckets use
another bit. The directory has one entry for each cell, and documents find their shard by an equi-join on the prefix.
Cells that are still too large get more bits, alone. What no bit can split (rows that repeat an id) is dealt to
overflow pages by running bytes, counted first within each input partition. A document above the limit is a page of its own.

Null texts have no bytes; null ids hash as the empty text. An empty table has no shards. Documents must be a stored
table, whose rows keep their partition and order when it is read again.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

HASH_BITS = 60


def hash_of(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def directory(cells: DataFrame, depth: int, limit: int, above: int = 0) -> DataFrame:
    """(cell, shard_depth) for (cell, bytes, n) with prefixes of `depth` bits: how many bits the shard of each cell uses.

    shard_depth is null for a cell that doesn't fit by itself. Prefixes under `above` bits are known not to fit.
    """
    fits = (F.col("bytes") <= limit) | (F.col("n") == 1)
    levels = [cells.select(F.lit(depth).alias("d"), F.col("cell").alias("prefix"), "bytes", "n")]
    for d in range(depth - 1, above - 1, -1):
        levels.append(levels[-1].groupBy(F.lit(d).alias("d"), F.shiftright("prefix", 1).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")))
    sizes = common.materialise(reduce(DataFrame.unionByName, levels).select("d", "prefix", fits.alias("fits")), "shard-sizes")
    parents = sizes.select((F.col("d") + 1).alias("d"), F.col("prefix").alias("up"), F.col("fits").alias("parent_fits"))
    leaves = sizes.where("fits").withColumn("up", F.shiftright("prefix", 1)).join(parents, ["d", "up"], "left").where("parent_fits is null or not parent_fits").select("d", "prefix")
    prefixes = cells.select("cell", F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("d")).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - d)"))
    return cells.select("cell").join(prefixes.join(leaves, ["d", "prefix"]).select("cell", F.col("d").alias("shard_depth")), "cell", "left")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """page: overflow pages of at most `limit` bytes of each hash, unless one row is larger."""
    part = rows.withColumn("part", F.shiftrightunsigned("row", 33))
    tops = part.groupBy("hash").agg(F.max("bytes").alias("top"))
    totals = part.groupBy("hash", "part").agg(F.sum("bytes").alias("total"))
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.partitionBy("hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(tops, "hash")
    inside = F.coalesce(F.sum("bytes").over(Window.partitionBy("hash", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    paged = part.withColumn("inside", inside).join(before.select("hash", "part", "before", "top"), ["hash", "part"])
    return paged.withColumn("page", F.floor((F.col("before") + F.col("inside")) / F.greatest(F.lit(limit) - F.col("top"), F.lit(1))).cast("long")).drop("part", "inside", "before", "top")


def assign_shards(docs: DataFrame, limit: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, shard, depth, page, bytes): shard is the bits of the bucket's prefix, '*' where that is empty.

    page is 0 but for overflow pages. All rows of one (shard, page) have at most `limit` bytes, or are one document.
    """
    return _assigned(docs, limit, id_col, text_col).drop("row")


def _assigned(docs: DataFrame, limit: int, id_col: str, text_col: str) -> DataFrame:
    """assign_shards() with each document's row number."""
    common.pin_splits(docs.sparkSession)
    rows = common.materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), hash_of(F.col(id_col)).alias("hash"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes")), "shard-rows")
    size = rows.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).first()
    total = size["bytes"] or 0
    if total <= limit or size["n"] == 1:  # the directory has one entry
        return rows.select("row", "id", F.lit("*").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("page"), "bytes")
    depth = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 6)
    above, todo, done = 0, rows, []
    while True:
        cell = F.shiftright("hash", HASH_BITS - depth)
        cells = common.materialise(todo.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "shard-cells")
        entries = common.materialise(directory(cells, depth, limit, above), "shard-directory")
        found = todo.withColumn("cell", cell).join(entries, "cell")
        bits = F.when(F.col("shard_depth") == 0, "*").otherwise(F.expr(f"substr(lpad(bin(cell), {depth}, '0'), 1, shard_depth)"))
        done.append(found.where("shard_depth is not null").select("row", "id", bits.alias("shard"), F.col("shard_depth").alias("depth"), F.lit(0).cast("long").alias("page"), "bytes"))
        if entries.where("shard_depth is null").isEmpty():
            break
        todo = common.materialise(found.where("shard_depth is null").select(*rows.columns), "shard-oversized")
        if depth == HASH_BITS:
            full = F.lpad(F.bin("hash"), HASH_BITS, "0")
            done.append(_pages(todo, limit).select("row", "id", full.alias("shard"), F.lit(HASH_BITS).alias("depth"), "page", "bytes"))
            break
        above, depth = depth + 1, min(HASH_BITS, depth + 18)
    return reduce(DataFrame.unionByName, done)


def write_shards(docs: DataFrame, path: str, limit: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write all rows of docs as Parquet with one folder for each shard and page, each by one task; returns the folders' column.

    Rows meet their shard by row number, so null and repeated ids are written once each. The column is `shard`, with
    underscores after it where docs has one of that name. docs must be a stored table.
    """
    key, column = "__sessionloom_row", common.free_name("shard", docs.columns)
    found = common.materialise(_assigned(docs, limit, id_col, text_col).select(F.col("row").alias(key), F.concat_ws("-", F.regexp_replace("shard", r"\*", "all"), "page").alias(column)), "shard-places")
    docs.withColumn(key, F.monotonically_increasing_id()).join(found, key).drop(key).repartition(column).write.partitionBy(column).parquet(path)
    return column
