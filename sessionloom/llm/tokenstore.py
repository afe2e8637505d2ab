"""Token ids in ORC (operator 3).

Documents are range-partitioned and sorted by id, tokenized in that order, and written as ORC files with the columns
part, row, id, n_tokens and ids; row is a document's place in its file. ORC stores the ids in stripes with integer
run-length encoding, keeps a row index (minimum and maximum of every `row_index_stride` rows) and a Bloom filter on the
document ids; readers split files at stripes and skip stripes and row groups by that metadata when they look for a
document. A document's start is not stored, as it depends on all parts before its own: it is the sum over earlier parts
(one row each) and a running sum in the part.

Null and empty texts give the end id alone. A null id sorts first. Rows that repeat an id stay next to each other in
the order of the input, and an id with very many rows is spread over several files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, lead_space: bool = False, stripe_bytes: int = 64 << 20, row_index_stride: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token ids of all whole texts to ORC files under path, in ascending order of ids."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = common.piece_encoder(tokenizer_path, lead_space), 0
        for batch in batch_iter:
            for a, b in common.text_slices(batch.column(2)):
                ids, sizes = encoder.encode(batch.column(2).slice(a, b - a))
                ids, ends = common.with_ends(ids, sizes, end_id)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids))
                columns = [batch.column(0).slice(a, b - a), pa.array(np.arange(row, row + b - a)), batch.column(1).slice(a, b - a), pa.array(sizes + 1), lists]
                row += b - a
                yield pa.RecordBatch.from_arrays(columns, names=["part", "row", "id", "n_tokens", "ids"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("came")).repartitionByRange(parts, "id", "came").sortWithinPartitions("id", "came")
    stored = ordered.select(F.spark_partition_id().alias("part"), "id", "text").mapInArrow(run, f"part int, row long, id {id_type}, n_tokens long, ids array<int>")
    stored.write.option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", row_index_stride).option("orc.bloom.filter.columns", "id").option("orc.bloom.filter.fpp", 0.01).option("compression", "zstd").orc(path)


def read_ids(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(part, row, id, n_tokens, ids) of the files; filters on id are pushed down to stripes, row groups and Bloom filters."""
    return spark.read.schema(f"part int, row long, id {id_type}, n_tokens long, ids array<int>").orc(path)


def digest(stored: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of read_ids()."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            lists = batch.column(4)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            crcs = [zlib.crc32(flat[a:b]) for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)] if len(ends) else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crcs, pa.int64())], names=["part", "row", "id", "n_tokens", "ids_crc32"])

    id_type = stored.schema["id"].dataType.simpleString()
    rows = stored.mapInArrow(run, f"part int, row long, id {id_type}, n_tokens long, ids_crc32 long")
    # a running sum over each part alone, and over the parts' totals: one row for each part
    own = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = stored.groupBy("part").agg(F.sum("n_tokens").alias("total")).withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(before.select("part", "before"), "part").select("id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
