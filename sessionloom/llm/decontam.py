"""Benchmark decontamination by spaced-seed hashing (operator 6).

Texts are lower-cased (A-Z) and cut into words at white space and ASCII punctuation. A mask picks some of the words of
a window and ignores the others, so a substituted word in an ignored place doesn't change the window's hash. Windows of
the benchmark and of the training texts that agree under a mask are joined by hash; before that join a Bloom filter of
fixed size, built from the benchmark in Spark, drops training windows that can't match. Around every hit the two word
sequences are compared on the hit's diagonal: the longest stretch of which `min_share` of the words are equal counts if
at least `min_words` of its words are equal (of a shorter item, `min_share` of its words, `min_item_words` at least long).

Every item is hashed under all masks, whatever its length, and all of them are spaced. At the default limits they miss no
overlap: a test searches all ways to place the substitutions, in items of 5 to 12 words and in stretches of 13 to 25 equal
words. Heavier masks would hit less by chance and miss some; words next to each other alone (1111) miss short items.

Null and empty texts never match. Items shorter than min_item_words never do either. Rows that repeat are documents of
their own. Documents must be a stored table, whose rows keep their partition and order when it is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MASKS = ("11011", "10111", "11101", "1101")
_U = np.uint64
_BLOOM_BITS = 23
_PUNCTUATION = bytes(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_TO_SPACE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, each computed once, and forgotten beyond `most` words."""

    def __init__(self, most: int = 500_000) -> None:
        self._most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) > self._most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 7)
        return value


def _factors(n: int, mask: int) -> np.ndarray:
    state = np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U((mask + 1) * 0xD6E8FEB86659FD93 % 2**64)
    state ^= state >> _U(32)
    return state * _U(0xBF58476D1CE4E5B9) | _U(1)


def seeds(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hashes of all windows of a mask."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return hashes[:0]
    out = np.zeros(n, np.uint64)
    picked = [i for i, c in enumerate(mask) if c == "1"]
    for i, factor in zip(picked, _factors(len(picked), number), strict=True):
        out += hashes[i : i + n] * factor
    out ^= out >> _U(29)
    out *= _U(0x94D049BB133111EB)
    return out ^ (out >> _U(32))


def _bloom_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = _U((1 << _BLOOM_BITS) - 1)
    return h & low, (h >> _U(64 - _BLOOM_BITS)) & low


def _item_seeds(items: DataFrame, masks: tuple[str, ...], min_item_words: int) -> DataFrame:
    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batch_iter:
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                if len(words) < min_item_words:
                    continue
                h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
                for number, mask in enumerate(masks):
                    found = seeds(h, mask, number)
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), batch.column(0).take(pa.array([i] * len(found), pa.int64())), pa.array(range(len(found)), pa.int32())], names=["h", "item", "at"])

    return items.mapInArrow(run, f"h long, item {items.schema['item'].dataType.simpleString()}, at int")


def _item_words(items: DataFrame) -> DataFrame:
    """(item, item_words): the hashes of each item's words."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batch_iter:
            lists = [[hashes[w] for w in words_of(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(x, np.uint64).view(np.int64) for x in lists], pa.list_(pa.int64()))], names=["item", "item_words"])

    return items.mapInArrow(run, f"item {items.schema['item'].dataType.simpleString()}, item_words array<long>")


def _regions(keyed: DataFrame, masks: tuple[str, ...], bloom, reach: int) -> DataFrame:
    """(row, id, first, words, hits): stretches of a document's word hashes around windows that may match."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = bloom.value, WordHashes()
        for batch in batch_iter:
            at, first, region, hit_h, hit_at = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                places, found = [], []
                for number, mask in enumerate(masks):
                    s = seeds(h, mask, number)
                    one, two = _bloom_places(s)
                    ok = np.flatnonzero(bits[one] & bits[two])
                    places.append(ok)
                    found.append(s[ok])
                places, found = np.concatenate(places), np.concatenate(found)
                if not len(places):
                    continue
                order = np.argsort(places, kind="stable")
                places, found = places[order], found[order]
                cuts = np.flatnonzero(np.diff(places) > 2 * reach) + 1
                for p, f in zip(np.split(places, cuts), np.split(found, cuts), strict=True):
                    lo = max(0, int(p[0]) - reach)
                    at.append(i)
                    first.append(lo)
                    region.append(h[lo : int(p[-1]) + reach].view(np.int64))
                    hit_h.append(f.view(np.int64))
                    hit_at.append(p.astype(np.int32))
            if at:
                rows = pa.array(at, pa.int64())

                def lists(parts, kind):
                    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts), kind))

                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first, pa.int32()), lists(region, pa.int64()), lists(hit_h, pa.int64()), lists(hit_at, pa.int32())], names=["row", "id", "first", "words", "h", "at"])

    return keyed.mapInArrow(run, f"row long, id {keyed.schema['id'].dataType.simpleString()}, first int, words array<long>, h array<long>, at array<int>")


def best_stretch(equal: np.ndarray, min_share: float) -> tuple[int, int, int]:
    """(start, end, equal words) of the longest stretch of which at least min_share of the words are equal.

    It begins and ends with an equal word: words that differ at its ends are cut off, which only raises the share.
    """
    sums = np.concatenate([[0.0], np.cumsum(equal - min_share)]) + 1e-9 * np.arange(len(equal) + 1)
    low, high = np.minimum.accumulate(sums), np.maximum.accumulate(sums[::-1])[::-1]
    # for each start that is a new low, the last end that isn't below it
    starts = np.flatnonzero(np.concatenate([[True], sums[1:] < low[:-1]]))
    ends = np.searchsorted(-high, -sums[starts], side="right") - 1
    k = int(np.argmax(ends - starts))
    inside = np.flatnonzero(equal[starts[k] : ends[k]])
    if not len(inside):
        return 0, 0, 0
    return int(starts[k] + inside[0]), int(starts[k] + inside[-1]) + 1, len(inside)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, min_share: float = 0.8, min_item_words: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(row, id, item, first_word, n_words, n_equal): for each document and item that overlap, the best stretch.

    row is the document's monotonically_increasing_id(). Around a hit the item's whole diagonal is compared.
    """
    spark = docs.sparkSession
    common.pin_splits(spark)
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    worded = common.materialise(_item_words(items), "item-words")
    reach = worded.agg(F.max(F.size("item_words"))).first()[0] or 0  # no diagonal is longer
    item_seeds = common.materialise(_item_seeds(items, masks, min_item_words), "item-seeds")
    words = F.col("p").bitwiseAND(F.lit(63))
    low = F.lit((1 << _BLOOM_BITS) - 1).cast("long")
    places = item_seeds.select(F.explode(F.array(F.col("h").bitwiseAND(low), F.shiftrightunsigned("h", 64 - _BLOOM_BITS).bitwiseAND(low))).alias("p"))
    # one long for each 64 bits of the filter: 2**17 rows at most, however large the benchmark
    filled = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toPandas()
    bits = np.zeros(1 << (_BLOOM_BITS - 6), np.uint64)
    bits[filled["w"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    bloom = spark.sparkContext.broadcast(np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool))

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    regions = common.materialise(_regions(keyed, masks, bloom, reach), "decontam-regions")
    hits = regions.select("row", "first", F.explode(F.arrays_zip("h", "at")).alias("x")).select("row", "first", F.col("x.h").alias("h"), F.col("x.at").alias("doc_at"))
    diagonals = hits.join(item_seeds, "h").select("row", "first", "item", (F.col("doc_at") - F.col("at")).alias("diagonal")).distinct()

    pairs = diagonals.join(worded, "item").join(regions.select("row", "id", "first", "words"), ["row", "first"]).select("row", "id", "item", "first", "diagonal", "words", "item_words")

    def verify(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            at, start, size, equal = [], [], [], []
            firsts, diagonals_ = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i in range(batch.num_rows):
                d, t = batch.column(5)[i].values.to_numpy(), batch.column(6)[i].values.to_numpy()
                shift = diagonals_[i] - firsts[i]  # where the item's first word falls among the region's words
                lo, hi = max(0, shift), min(len(d), shift + len(t))
                if hi <= lo:
                    continue
                a, b, n = best_stretch(d[lo:hi] == t[lo - shift : hi - shift], min_share)
                if n and n >= (min_words if len(t) >= min_words else min_share * len(t) - 1e-9):
                    at.append(i)
                    start.append(firsts[i] + lo + a)
                    size.append(b - a)
                    equal.append(n)
            if at:
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(3)), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(equal, pa.int64())], names=["row", "id", "item", "first_word", "n_words", "n_equal"])

    id_type, item_type = keyed.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    found = pairs.mapInArrow(verify, f"row long, id {id_type}, item {item_type}, first_word long, n_words long, n_equal long")
    best = F.max(F.struct("n_equal", (-F.col("n_words")).alias("w"), (-F.col("first_word")).alias("f"))).alias("best")
    return found.groupBy("row", "id", "item").agg(best).select("row", "id", "item", (-F.col("best.f")).alias("first_word"), (-F.col("best.w")).alias("n_words"), F.col("best.n_equal").alias("n_equal"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that overlap a benchmark item; columns unchanged."""
    key = common.free_name("__sessionloom_row", docs.columns)
    found = common.materialise(contaminated(docs, benchmark, **options).select(F.col("row").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, F.monotonically_increasing_id()).join(found, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
