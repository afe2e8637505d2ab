"""The tail of history files that grow, as a stream: only bytes that no batch has read yet are read.

`spark.readStream.format("history_tail")` lists the files below a folder at each trigger. Its offset holds for every file how
many bytes were there, and the key of the project's roots. A batch reads what lies between two offsets, in ranges that tasks
share out: new files whole, grown files from where the last batch ended, files that shrank from their start, and all files
again where the roots' key has changed (the importer leaves out what it has). A line goes to the range in which it begins; a
last line that isn't ended yet waits for its end. Files are opened by pyarrow's file systems, wherever they are.

import_tail() stages and stores these lines: what holds from line to line (session, folder, sequence) goes on from cursors,
of which each batch writes those that it moves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from .. import tables
from ..operators import indexes, store
from . import histories

SCHEMA = "file string, why string, start long, line string"


class Ranges(InputPartition):
    """Byte ranges that one task reads: (file, from, to, why, the batch's first byte of the file, the file's end)."""

    def __init__(self, ranges: list[tuple[str, int, int, str, int, int]]) -> None:
        self.ranges = ranges


def _begin(source, at: int, block: int = 1 << 16) -> int:
    """Where the line begins that holds the byte before `at`: after the last line end below it."""
    while at > 0:
        low = max(0, at - block)
        source.seek(low)
        found = source.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def lines_between(source, start: int, end: int, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the ended lines that begin in [start, end); a line begins at start."""
    source.seek(start)
    at, held = start, b""
    while at < end:
        data = source.read(block)
        if not data:
            return
        *ended, held = (held + data).split(b"\n")
        for line in ended:
            if at >= end:
                return
            yield at, line
            at += len(line) + 1


class _Until:
    """A file that ends at a given byte, whatever has been written since."""

    def __init__(self, source, stop: int) -> None:
        self._source, self._stop = source, stop

    def seek(self, at: int) -> None:
        self._source.seek(at)

    def read(self, n: int) -> bytes:
        return self._source.read(max(0, min(n, self._stop - self._source.tell())))


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _batches(file: str, why: str, lines: Iterator[tuple[int, bytes]], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Lines that aren't blank, in batches of about `limit` bytes."""

    def batch() -> pa.RecordBatch:
        starts, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([why] * len(rows)), pa.array(starts, pa.int64()), pa.array(texts)], names=["file", "why", "start", "line"])

    rows, size = [], 0
    for start, line in lines:
        if line.strip():
            rows.append((start, line.decode("utf-8", "replace")))
            size += len(line)
        if size > limit:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self._uri = options["path"]
        self._glob, self._key = options.get("glob", "*.jsonl"), options.get("rootskey", "")
        self._range = int(options.get("rangebytes", 64 << 20))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"roots_key": self._key, "files": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        files, path = _opened(self._uri)
        found = files.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        return {"roots_key": self._key, "files": {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and fnmatch(f.base_name, self._glob)}}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        """Ranges of about `rangebytes` each, small ones together."""
        again, out, size = start["roots_key"] != end["roots_key"], [[]], 0
        for file, stop in end["files"].items():
            before = start["files"].get(file)
            why = "new" if before is None else "roots" if again else "grown" if stop > before else "shrunk" if stop < before else None
            if why is None:
                continue
            at = before if why == "grown" else 0
            while at < stop:
                to = min(stop, at + self._range)
                if size and size + to - at > self._range:
                    out.append([])
                    size = 0
                out[-1].append((file, at, to, why, before if why == "grown" else 0, stop))
                size, at = size + to - at, to
        return [Ranges(r) for r in out if r]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, _ = _opened(self._uri)
        for file, at, to, why, first, stop in partition.ranges:
            with files.open_input_file(file) as opened:
                source = _Until(opened, stop)
                if at == first:  # with the line that was open when the last batch ended
                    yield from _batches(file, why, lines_between(source, _begin(source, at), to))
                    continue
                open_line = next(lines_between(source, at - 1, at), None)  # from the byte before to the end of its line
                if open_line is not None:
                    yield from _batches(file, why, lines_between(source, at + len(open_line[1]), to))

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """Options: path (a folder, or its URI), glob (*.jsonl), rootsKey, rangeBytes (64 MiB)."""

    @classmethod
    def name(cls) -> str:
        return "history_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader({k.lower(): v for k, v in self.options.items()})


def read_tail(spark: SparkSession, path: str, roots_key: str, glob: str = "*.jsonl", range_bytes: int = 64 << 20) -> DataFrame:
    """The stream (file, why, start, line): why is new, grown, shrunk or roots, start the line's first byte."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("history_tail").option("path", path).option("glob", glob).option("rootsKey", roots_key).option("rangeBytes", range_bytes).load()


def cursors(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The latest cursor of each file (file, line_count, sequence, session_id, cwd), of batches before a given one; line_count is the first byte not read."""
    if not tables.exists(spark, path):
        return None
    rows = spark.read.schema("file string, line_count long, sequence long, session_id string, cwd string, batch long").parquet(path)
    rows = rows.where(F.col("batch") < before) if before is not None else rows
    return rows.groupBy("file").agg(F.max_by(F.struct("line_count", "sequence", "session_id", "cwd"), "batch").alias("c")).select("file", "c.*")


def _whole(files: DataFrame, source: str) -> DataFrame:
    """(file, why, line_no, line) of files (file, stop) up to a byte; a file is a task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(source)
        for batch in batches:
            for file, stop in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(file) as opened:
                    yield from _batches(file, "new", lines_between(_Until(opened, stop), 0, stop))

    return files.select("file", "stop").repartition("file").mapInArrow(run, SCHEMA).withColumnRenamed("start", "line_no")


def import_tail(lines: DataFrame, source: str, provider: str, repo_id: str, roots: list[str], root: str, folder: str, now: Column | None = None, actor_id: str | None = None) -> StreamingQuery:
    """Import a stream of read_tail(), of the folder `source`, into the indexed store at `root` (see indexes.add); checkpoints and cursors lie in `folder`.

    Of a file that goes on, lines are staged from its cursor on; one that shrank starts again. Where the roots have changed,
    a file that gave events keeps its place, and one that gave none is staged from its start. Batches may run again.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = tables.stored(batch.select("file", "why", F.col("start").alias("line_no"), "line"), "tail-batch")
        if kept.isEmpty():
            return
        whys = kept.groupBy("file").agg(F.max("why").alias("why"))
        known = cursors(spark, f"{folder}/cursors", number)
        if known is not None:
            known = tables.stored(known.join(whys, "file").where("why <> 'shrunk'"), "tail-cursors")
            # files that grew and named no folder before: their earlier lines may count now
            stops = kept.groupBy("file").agg(F.max(F.col("line_no") + F.octet_length("line") + 1).alias("stop"))
            unknown = tables.stored(known.where("why = 'grown' and sequence = 0 and cwd is null").select("file").join(stops, "file"), "tail-unknown")
            if not unknown.isEmpty():
                kept = tables.stored(kept.join(unknown.select("file"), "file", "left_anti").unionByName(_whole(unknown, source)), "tail-batch")
                known = known.join(unknown.select("file"), "file", "left_anti")
            known = known.withColumn("tail", F.col("why") == "grown").drop("why")
        staged, files = histories.stage_files(kept.select("file", "line_no", "line"), provider, repo_id, roots, F.current_timestamp() if now is None else now, known, actor_id, chunk_lines=8 << 20)
        moment = F.lit(number << 40)  # batches arrive in their order, and files in a batch by path
        staged = tables.numbered(staged, ["file", "sequence"], "__place").withColumn("arrival_seq", moment + F.col("__place")).drop("__place")
        staged = tables.stored(staged, "tail-staged")
        indexes.add(store.envelopes(staged.drop("file", "line_no")), root, number)
        reached = staged.groupBy("file").agg(F.max("sequence").alias("sequence"))
        moved = files.join(reached, "file", "left").select("file", F.col("lines_now").alias("line_count"), F.coalesce("sequence", "base").alias("sequence"), "session_id", "cwd", F.lit(number).cast("long").alias("batch"))
        moved.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/cursors")

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
