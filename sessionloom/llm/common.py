"""Helpers that the training-data operators share: scratch tables, batches, cached tokenization."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space, the separators of words in every contract here; bytes.split() splits on exactly these.
WHITE = "[\\x20\\x09-\\x0D]+"

_OWN_DIRS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this session: spark.checkpoint.dir, or where that is unset and all runs on this machine, one of our own."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="sessionloom-")
    return _OWN_DIRS[app]


_OPEN: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted at the end of the scratch() around it, or when the driver program ends."""
    path = f"{scratch_root(spark)}/sessionloom/{name}-{uuid.uuid4().hex[:12]}"
    if _OPEN:
        _OPEN[-1].append(path)
    else:
        atexit.register(_drop, spark, path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables of operators called inside; their results must be written before it ends."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _drop(spark, path)


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str, *, partition_by: Iterable[str] = (), **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, or with as many underscores as it takes to be none of the taken ones (in any case)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def pin_splits(spark: SparkSession) -> None:
    """From now on files are split for as many cores as there are now, unless the session says for how many.

    Row numbers and partition ids of a stored table then agree between two reads, also after executors are lost.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)


def words_of(text: str | None) -> list[bytes]:
    """Words of the lower-cased (A-Z only) text as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def text_slices(texts: pa.Array, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of texts with about `limit` bytes each, at least one text."""
    sums = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + limit, side="right")))
        yield a, b
        a = b


def batches(texts: list, limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of texts with about `limit` characters each, so that a task's memory doesn't follow Spark's batches."""
    a = size = 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= limit:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def concat_ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """[starts[0] .. +lens[0]) and so on, end to end."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


class _Index(dict):
    """Numbers keys in the order of their first use."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


class _Store:
    """Id lists by number, end to end in one growing array; number 0 is the empty list."""

    def __init__(self) -> None:
        self.ids, self._used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lens, self._count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 1

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])

    def add(self, flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The numbers of new lists."""
        first, last = self._count, self._count + len(lens)
        self.ids = self._room(self.ids, self._used + len(flat))
        self.starts, self.lens = self._room(self.starts, last), self._room(self.lens, last)
        self.ids[self._used : self._used + len(flat)] = flat
        self.starts[first:last], self.lens[first:last] = self._used + np.cumsum(lens) - lens, lens
        self._used, self._count = self._used + len(flat), last
        return np.arange(first, last)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the lists end to end, their lengths)."""
        lens = self.lens[numbers]
        return self.ids[concat_ranges(self.starts[numbers], lens)], lens


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct piece once.

    Texts are cut where neither kind of public BPE file merges across. For files that drop white space: at single spaces
    and line ends. For byte-level files (`lead_space`): before the last white-space character of each run, which goes
    with the piece after it; a text with white space other than spaces, tabs and line ends goes to the library whole,
    and so does one that holds an added token. The result equals encoding the whole text with the file as it is loaded.
    """

    MAX_PIECES = 500_000
    _FOREIGN = r"\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    _cut = re.compile(r"[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+(?=[ \t\n\r][^ \t\n\r])|[ \t\n\r]?[^ \t\n\r]+")
    _letters = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")

    def __init__(self, path: str, lead_space: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._lead = lead_space
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        normal = self._tokenizer.normalizer
        self._lower = normal is not None and normal.normalize_str("AbZ") == "abz"
        # ids with which a piece begins (its space) or a word ends: they tell joined pieces apart
        vocabulary = self._tokenizer.get_vocab()
        self.vocabulary_size = max(vocabulary.values()) + 1
        self._mark = np.zeros(self.vocabulary_size, bool)
        self._mark[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if lead_space else t.endswith("</w>"))]] = True
        self._reset()

    def _reset(self) -> None:
        self._numbers: dict[str, int] = {"": 0}
        self._store = _Store()

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of texts end to end, how many each has)."""
        found = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """_library() for pieces whose ids the mark tells apart, a thousand at once."""
        blocks = [pieces[a : a + 1000] for a in range(0, len(pieces), 1000)]
        whole = self._tokenizer.encode_batch_fast([("" if self._lead else " ").join(b) for b in blocks], add_special_tokens=False)
        flat, lens = [], []
        for block, found in zip(blocks, whole, strict=True):
            ids = np.array(found.ids, np.int32)
            at = np.flatnonzero(self._mark[ids])
            edges = np.append(at, len(ids)) if self._lead else np.append(0, at + 1)
            if len(at) == len(block) and edges[0] == 0 and edges[-1] == len(ids):
                n = np.diff(edges)
            else:
                ids, n = self._library(block)
            flat.append(ids)
            lens.append(n)
        return np.concatenate(flat), np.concatenate(lens)

    def _numbers_of(self, pieces: pa.Array) -> np.ndarray:
        """Numbers in the store of pieces; new ones are encoded."""
        coded = pieces.dictionary_encode()
        kinds = coded.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self._numbers.get, kinds, repeat(-1)), np.int64, len(kinds))
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new = kinds[missing].tolist()
            if self._lead:
                plain = np.array([p[0] == " " and p[1:].split() == [p[1:]] for p in new])
            else:
                plain = np.array([self._letters.fullmatch(p) is not None for p in new])
            for some, encode in ((np.flatnonzero(plain), self._joined), (np.flatnonzero(~plain), self._library)):
                if len(some):
                    numbers[missing[some]] = self._store.add(*encode([new[i] for i in some]))
            self._numbers.update(zip(new, numbers[missing].tolist(), strict=True))
        return numbers[coded.indices.to_numpy()]

    def _ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, lengths) of pieces. Closing punctuation after a letter is a pre-token of its own, so it is encoded apart."""
        if self._lower:  # the file's own lower-casing, for pieces of ASCII alone
            pieces = pc.if_else(pc.string_is_ascii(pieces), pc.ascii_lower(pieces), pieces)
        core = pc.ascii_rtrim(pieces, characters=".,;:!?")
        size, kept = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (pieces, core))
        data = np.frombuffer(core.buffers()[2] or b"", np.uint8) if kept.any() else np.zeros(1, np.uint8)
        ends = np.frombuffer(core.buffers()[1], np.int64)[core.offset + 1 :][: len(core)]
        last, before = (np.where(kept > k, data[np.maximum(ends - 1 - k, 0)], 0).astype(np.int32) for k in (0, 1))
        letter = ((last | 32) >= 97) & ((last | 32) <= 122)
        # two bytes of U+00C0 to U+024F, but for the signs of multiplication and division and the I whose lower case ends with a mark
        code = (before & 31) << 6 | (last & 63)
        letter |= (before >= 0xC3) & (before <= 0xC9) & (last >= 0x80) & (last <= 0xBF) & (code <= 0x24F) & (code != 0xD7) & (code != 0xF7) & (code != 0x130)
        cut = np.flatnonzero((size > kept) & letter)
        numbers = np.zeros((len(pieces), 2), np.int64)
        whole = pieces
        if len(cut):
            apart = np.zeros(len(pieces), bool)
            apart[cut] = True
            whole = pc.if_else(pa.array(apart), core, pieces)
            tails = [p[-n:] for p, n in zip(pieces.take(pa.array(cut)).to_numpy(zero_copy_only=False), (size - kept)[cut].tolist(), strict=True)]
            numbers[cut, 1] = self._numbers_of(pa.array(tails, pa.large_string()))
        numbers[:, 0] = self._numbers_of(whole)
        ids, lens = self._store.take(numbers.reshape(-1))
        return ids, lens.reshape(-1, 2).sum(axis=1)

    def encode_pieces(self, pieces: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces end to end, how many each has). A piece holds neither white space nor an added token."""
        if len(self._numbers) > self.MAX_PIECES:
            self._reset()
        return self._ids_of(pieces if isinstance(pieces, pa.Array) else pa.array(pieces, pa.large_string()))

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of texts in which no piece is longer than one white-space character and what follows it."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if self._lead else " "), " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        codes, kinds = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        if self._lead:  # every piece but a text's first has the space before it, unless it begins with a line end
            first = np.cumsum(counts) - counts
            heads, codes[first] = np.unique(codes[first], return_inverse=True)
            codes[first] += len(kinds)
            spaced = pc.if_else(pc.starts_with(kinds, "\n"), kinds, pc.binary_join_element_wise(pa.scalar(" ", kinds.type), kinds, pa.scalar("", kinds.type)))
            kinds = pa.concat_arrays([spaced, kinds.take(pa.array(heads))])
        ids, lens = self._ids_of(kinds)
        own = lens[codes]
        return ids[concat_ranges((np.cumsum(lens) - lens)[codes], own)], segment_sums(own, counts)

    def _cut_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of byte-level texts with runs of white space."""
        pieces = [self._cut.findall(t) for t in texts.to_pylist()]
        ids, lens = self._ids_of(pa.array(chain.from_iterable(pieces), pa.large_string()))
        return ids, segment_sums(lens, np.fromiter(map(len, pieces), np.int64, len(pieces)))

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, the number of ids of each text)."""
        if len(self._numbers) > self.MAX_PIECES:
            self._reset()
        array = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        masks = [pc.match_substring(array, t, ignore_case=True) for t in self._added]
        if self._lead:
            masks.append(pc.match_substring_regex(array, f"[{self._FOREIGN}]"))
        whole = np.logical_or.reduce([m.to_numpy(zero_copy_only=False) for m in masks]) if masks else np.zeros(len(array), bool)
        runs = np.zeros(len(array), bool)
        if self._lead:
            runs = pc.match_substring_regex(array, r"[ \n]{2}|^[ \n]|[ \n]$|[\t\r]").to_numpy(zero_copy_only=False) & ~whole
        if not (whole.any() or runs.any()):
            return self._split(array)
        parts = [(np.flatnonzero(mask), encode) for mask, encode in ((~whole & ~runs, self._split), (runs, self._cut_up), (whole, lambda t: self._library(t.to_pylist())))]
        found = [(at, *encode(array.take(pa.array(at)))) for at, encode in parts if len(at)]
        order = np.argsort(np.concatenate([at for at, _, _ in found]))
        flat, sizes = (np.concatenate([f[k] for f in found]) for k in (1, 2))
        return flat[concat_ranges((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]


def with_ends(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids with end_id after each of the lists that stand end to end, where each list ends)."""
    ends = np.cumsum(sizes + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.int32)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    out[inner] = ids
    return out, ends


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def piece_encoder(path: str, lead_space: bool) -> PieceEncoder:
    """One encoder for each worker process: its cache lasts over the tasks that the process runs."""
    key = (path, lead_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, lead_space)
    return _ENCODERS[key]


def bounded_sample(df, bound: int, key: str, by: str | None = None, salt: int = 0):
    """About `bound` rows (for each value of `by`) as pandas, chosen by a hash of `key`; all rows if there are fewer."""
    from pyspark.sql import functions as F

    spread = F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    if by is None:
        total = df.count()
        return df.where(spread < min(1.0, bound / max(1, total))).toPandas()
    rates = {row[0]: min(1.0, bound / row[1]) for row in df.groupBy(by).count().collect()}
    if not rates:
        return df.limit(0).toPandas()
    rate = F.create_map(*(F.lit(x) for pair in rates.items() for x in pair))[F.col(by)]
    return df.where(spread < rate).toPandas()


def word_grams(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed buckets of each word's byte n-grams and the word itself, end to end; how many each word has)."""
    raw = [b"<" + w + b">" for w in words]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw) + b"\0" * max(sizes), np.uint8).astype(np.uint64)
    ends = np.cumsum(lens)
    starts, n = ends - lens, int(ends[-1]) if len(ends) else 0
    owner, stop = np.repeat(np.arange(len(raw)), lens), np.repeat(ends, lens)
    place = np.arange(n)
    found, owners = [], []
    for size in sizes:
        h = np.full(n, size * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        for k in range(size):
            h = (h ^ data[k : k + n]) * np.uint64(0x100000001B3)
        ok = place + size <= stop
        found.append(h[ok])
        owners.append(owner[ok])
    import xxhash

    found.append(np.fromiter((xxhash.xxh64_intdigest(w, 11) for w in words), np.uint64, len(words)))
    owners.append(np.arange(len(words)))
    h, owner = np.concatenate(found), np.concatenate(owners)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    order = np.argsort(owner, kind="stable")
    return ((h[order] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), np.bincount(owner, minlength=len(words))


class WordTable:
    """Numbers words and keeps the rows that `measure(words)` gives: one table for each (width, dtype). Forgets all beyond `limit` words."""

    def __init__(self, measure, *kinds: tuple[int, type], limit: int = 300_000) -> None:
        self._measure, self._kinds, self._limit = measure, kinds, limit
        self._reset()

    def _reset(self) -> None:
        self._index = _Index()
        self.tables = [np.zeros((1024, width), kind) for width, kind in self._kinds]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' rows in .tables, valid until the next call."""
        if len(self._index) > self._limit:
            self._reset()
        out = np.fromiter(map(self._index.__getitem__, words), np.int64, len(words))
        if self._index.new:
            new, self._index.new = self._index.new, []
            n, first = len(self._index), len(self._index) - len(new)
            for k, table in enumerate(self.tables):
                if n > len(table):
                    self.tables[k] = np.concatenate([table, np.zeros((max(n, 2 * len(table)) - len(table), table.shape[1]), table.dtype)])
            for a in range(0, len(new), 20_000):
                for table, rows in zip(self.tables, self._measure(new[a : a + 20_000]), strict=True):
                    table[first + a : first + a + len(rows)] = rows
        return out


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; empty runs give 0. A run's sum depends on its own rows alone."""
    out = np.zeros((len(counts), *values.shape[1:]), np.result_type(values.dtype, np.int64) if values.dtype.kind in "iub" else np.float64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        out[some] = np.add.reduceat(values, starts, axis=0, dtype=out.dtype)
    return out
