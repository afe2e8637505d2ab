"""Near-duplicate removal at a stated shingle similarity: SimHash by a binary trie self-join, MinHash bands for pairs that
64 bits can't tell, exact Jaccard for the verdict.

1. Texts of equal words (white space and case A-Z aside) are one kind; only the first document of a kind goes on.
   Kinds whose SimHash fingerprints are linked by the trie self-join of operator 1 (at `max_bits` bits) are held against
   the first of their group, then, of those that are left, linked ones against each other.
2. The bits of two texts at the limit often differ in more places than a trie can look past. So a kind also has `bands` band keys of `rows` MinHash values each over its word shingles. Two kinds whose shingle sets have
   Jaccard similarity s share a key with probability 1 - (1 - s^rows)^bands: 0.99993 at 0.8, and more above.
3. In each bucket of a key, members are first compared with one representative, which dissolves dense groups at about as
   many pairs as they have members. Those left are compared in blocks of `block` rows and pairs of blocks: by the share
   of equal MinHash values (8 bits each), and where that may reach the limit, by four standard deviations, by the hashes
   of their shingles; a cell gives a forest of its links, never all its pairs. No bucket is capped: one of n copies that
   are all below the limit costs n * n / 2 comparisons, spread over its blocks, and no rows.
4. A pair is a link only if the exact similarity of the shingle sets reaches the limit. Of linked kinds the first stays.

So each document that goes has a chain of verified links to one that stays, and of two that share a key and both stay the
similarity is below the limit. A text of fewer words than a shingle is one shingle. Null and empty texts are one kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontam import WordHashes, seeds
from .simhash import components, fingerprints, near_links

BANDS, ROWS = 24, 5
_U = np.uint64


def shingles(text: str | None, shingle_words: int) -> set[bytes]:
    words = common.words_of(text)
    if len(words) <= shingle_words:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(shingle_words)), strict=False)))


def similar(a: set[bytes], b: set[bytes], limit: float) -> bool:
    if min(len(a), len(b)) < limit * max(len(a), len(b)) - 1e-9:
        return False
    both = len(a & b)
    return both >= limit * (len(a) + len(b) - both) - 1e-9


def _hashes_of(words: list[bytes], shingle_words: int, hashes: WordHashes) -> np.ndarray:
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return seeds(h, "1" * min(shingle_words, len(words)), 0)


def band_keys(lists: list[list[bytes]], shingle_words: int, hashes: WordHashes, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Keys (texts x bands) and 8 bits of each MinHash value (texts x bands * rows) of texts that have words."""
    rng = np.random.default_rng(42)
    mixes, factors = rng.integers(0, 2**32, bands * rows, dtype=np.uint32), rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    parts = [_hashes_of(words, shingle_words, hashes) for words in lists]
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    flat = (np.concatenate(parts) >> _U(32)).astype(np.uint32)
    out = np.zeros((len(lists), bands), np.uint64)
    small = np.zeros((len(lists), bands * rows), np.uint8)
    for band in range(bands):
        key = np.full(len(lists), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            least = np.minimum.reduceat((flat ^ mixes[k]) * factors[k], starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15)
            small[:, k] = least >> _U(56)
            key = (key ^ least) * _U(0xD6E8FEB86659FD93)
            key ^= key >> _U(29)
        out[:, band] = key
    return out, small


def _kinds(keyed: DataFrame, shingle_words: int) -> DataFrame:
    """(who, d1, d2, fp, keys, sign): a digest of each document's words, its fingerprint, its band keys and its MinHash values."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batch_iter:
            texts = batch.column(1).to_pylist()
            for a, b in common.batches(texts):
                lists = [common.words_of(t) for t in texts[a:b]]
                digests = np.array([(d >> 64, d & (2**64 - 1)) for d in (xxhash.xxh3_128_intdigest(b" ".join(words)) for words in lists)], np.uint64).view(np.int64)
                some = [i for i, words in enumerate(lists) if words]
                sizes = np.zeros(len(lists), np.int64)
                sizes[some] = BANDS
                keys, small = band_keys([lists[i] for i in some], shingle_words, hashes) if some else (np.zeros(0, np.uint64), [])
                column = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                signs: list[bytes | None] = [None] * len(lists)
                for i, sign in zip(some, small, strict=True):
                    signs[i] = sign.tobytes()
                prints = pa.array(fingerprints(texts[a:b], shingle_words).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(digests[:, 0]), pa.array(digests[:, 1]), prints, column, pa.array(signs, pa.binary())], names=["who", "d1", "d2", "fp", "keys", "sign"])

    return keyed.mapInArrow(run, f"who {keyed.schema['who'].dataType.simpleString()}, d1 long, d2 long, fp long, keys array<long>, sign binary")


def _shingled(texts: DataFrame, shingle_words: int) -> DataFrame:
    """(row, shingles): the sorted distinct shingle hashes of texts."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batch_iter:
            found = [np.unique(_hashes_of(words, shingle_words, hashes)).view(np.int64) if words else np.zeros(0, np.int64) for words in map(common.words_of, batch.column(1).to_pylist())]
            if found:
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row", "shingles"])

    return texts.select("row", "text").mapInArrow(run, "row long, shingles array<long>")


def _trie_links(kinds: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) rows of kinds with words: each with the first of its group of linked fingerprints, and links that connect these groups."""
    printed = common.materialise(kinds.where(F.size("keys") > 0).groupBy("fp").agg(F.min("row").alias("rep")), "near-prints")
    links = common.materialise(near_links(printed.select("fp"), max_bits), "near-trie")
    rep = lambda fp, name: printed.select(F.col("fp").alias(fp), F.col("rep").alias(name))
    rows = common.materialise(links.withColumnsRenamed({"a": "f", "b": "g"}).join(rep("f", "a"), "f").join(rep("g", "b"), "g").select("a", "b"), "near-trie-rows")
    same = kinds.where(F.size("keys") > 0).select("fp", "row").join(printed, "fp").where("row <> rep").select(F.col("rep").alias("a"), F.col("row").alias("b"))
    stars = components(rows).where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    return common.materialise(stars.unionByName(same), "near-pairs"), rows


def _linked(members: DataFrame, kinds: DataFrame, shingled: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b): links that connect a bucket's members (h, row, n) as all of its similar pairs would.

    Members are compared in blocks and pairs of blocks: by MinHash values, and where these may reach the limit by their
    shingle hashes, unless both are linked already. A pair is looked at in the first bucket that it shares. So a cell gives
    fewer links than it has members, however many of its pairs are similar.
    """
    least = BANDS * ROWS * similarity - 4 * (BANDS * ROWS * similarity * (1 - similarity)) ** 0.5

    def close(a: np.ndarray, b: np.ndarray) -> bool:
        if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= similarity * (len(a) + len(b) - both) - 1e-9

    def links_of(h: int, row: np.ndarray, own: np.ndarray, sign: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], across: bool) -> Iterator[pa.RecordBatch]:
        label, a, b = np.arange(len(row)), [], []
        band = int(np.argmax(keys[0] == h))
        for i in range(len(row) - 1):
            j = np.flatnonzero((sign[i + 1 :] == sign[i]).sum(axis=1) >= least) + i + 1
            if across:
                j = j[own[j] != own[i]]
            j = j[~(keys[j, :band] == keys[i, :band]).any(axis=1)]
            for k in j.tolist():
                if label[k] != label[i] and close(sets[i], sets[k]):
                    label[label == label[k]] = label[i]
                    a.append(row[i])
                    b.append(row[k])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                row, own, sign, keys = (np.concatenate([part[k] for part in held]) for k in range(4))
                yield from links_of(cell[0], row, own, sign, keys, [x for part in held for x in part[4]], cell[1] != cell[2])

        for batch in batch_iter:
            h, i, j, own, row = (batch.column(k).to_numpy() for k in range(5))
            sign = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
            keys = batch.column(6).flatten().to_numpy().reshape(-1, BANDS)
            ends = np.cumsum(batch.column(7).value_lengths().to_numpy(zero_copy_only=False))
            sets = np.split(batch.column(7).flatten().to_numpy(), ends[:-1]) if len(ends) else []
            starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) if len(h) else []
            for s, e in zip(starts, [*starts[1:], len(h)], strict=True):
                if (h[s], i[s], j[s]) != cell:
                    yield from done()
                    cell, held = (h[s], i[s], j[s]), []
                held.append((row[s:e], own[s:e], sign[s:e], keys[s:e], sets[s:e]))
        yield from done()

    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = members.withColumn("own", F.pmod(F.xxhash64("row"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = placed.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "row").join(kinds.select("row", "sign", "keys").join(shingled, "row"), "row")
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return cells.select("h", "i", "j", "own", "row", "sign", "keys", "shingles").repartition(parts, "h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """(a, b) of the pairs whose shingle sets are similar."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, set[bytes]] = (None, set())
        for batch in batch_iter:
            keep = []
            for i, (s, t) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if s != last[0]:
                    last = (s, shingles(s, shingle_words))
                if similar(last[1], shingles(t, shingle_words), similarity):
                    keep.append(i)
            if keep:
                rows = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "b"])

    both = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("row").alias("b"), F.col("text").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def keep_one(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, block: int = 500, max_bits: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies: the first by id (nulls last), one row where rows repeat.

    The columns of docs are returned unchanged, whatever their names. docs must be a stored table, whose rows keep
    their partition and order when it is read again.
    """
    key = "__sessionloom_row"
    common.pin_splits(docs.sparkSession)
    keyed = docs.withColumn(key, F.monotonically_increasing_id())
    slim = keyed.select(F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), F.col(key).alias("row")).alias("who"), F.col(text_col).alias("text"))
    rows = common.materialise(_kinds(slim, shingle_words), "near-rows")
    kinds = common.materialise(rows.groupBy("d1", "d2").agg(F.min("who").alias("who"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sign").alias("sign")).select("who", F.col("who.row").alias("row"), "fp", "keys", "sign"), "near-kinds")

    def crowded(members: DataFrame) -> DataFrame:
        """(h, row, n) of buckets with more than one member."""
        sizes = members.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
        return members.join(sizes, "h").select("h", "row", "n")

    members = common.materialise(crowded(kinds.select(F.explode("keys").alias("h"), "row")), "near-members")
    stars, trie = _trie_links(kinds, max_bits)
    needed = members.select("row").unionByName(stars.select(F.explode(F.array("a", "b")).alias("row"))).distinct()
    texts = common.materialise(keyed.select(F.col(key).alias("row"), F.col(text_col).alias("text")).join(needed.hint("merge"), "row", "left_semi"), "near-texts")
    gone = []

    def settle(pairs: DataFrame) -> None:
        links = common.materialise(_verified(pairs, texts, shingle_words, similarity), "near-links")
        groups = common.materialise(components(links).join(kinds.select(F.col("row").alias("node"), "who"), "node"), "near-groups")
        first = groups.groupBy("root").agg(F.min("who").alias("kept")).select(F.col("kept.row").alias("node"))
        gone.append(common.materialise(groups.select("node").join(first, "node", "left_anti").select(F.col("node").alias("row")), "near-gone"))

    def left_of(rows: DataFrame, *columns: str) -> DataFrame:
        """rows without those of kinds that go."""
        for late in gone:
            for c in columns:
                rows = rows.join(late.select(F.col("row").alias(c)), c, "left_anti")
        return rows

    if not stars.isEmpty():
        settle(stars)
        members = common.materialise(crowded(left_of(members.select("h", "row"), "row")), "near-members")
        trie = left_of(trie, "a", "b")
    chosen = members.groupBy("h").agg(F.min("row").alias("rep"))
    pairs = members.join(chosen, "h").where("row <> rep").select(F.col("rep").alias("a"), F.col("row").alias("b"))
    pairs = common.materialise(pairs.unionByName(trie.select("a", "b")).distinct(), "near-pairs")
    if not pairs.isEmpty():
        settle(pairs)
        members = common.materialise(crowded(left_of(members.select("h", "row"), "row")), "near-members")
    if not members.isEmpty():
        left = texts.join(members.select("row").distinct(), "row", "left_semi")
        shingled = common.materialise(_shingled(left, shingle_words), "near-shingles")
        settle(common.materialise(_linked(members, kinds, shingled, similarity, block), "near-pairs"))
    kept = left_of(kinds.select("row"), "row")
    # as many rows as documents: never a broadcast
    return keyed.join(kept.select(F.col("row").alias(key)).hint("merge"), key, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
