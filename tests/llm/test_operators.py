"""The training-data operators against brute force, exact round trips and odd inputs."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionloom.llm import common, decontam, langid, linededup, lm, packing, quality, sharding, simhash, tokenstore, toxicity

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t", "one", "a a a a", "two words", "é ñ ß", "\x00x", "x" * 5000, "w " * 3000, "same text here", "same text here", "a\n\nb\n", "12 34", "a  b\r\nc"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rows = [(i if i != 3 else None, t, None if i % 2 else "en", None if i % 3 else "h", 7, "clash", "clash", i) for i, t in enumerate(ODD)] + [(9, ODD[9], "en", "h", 7, "clash", "clash", 9)]
    path = str(tmp_path_factory.mktemp("odd") / "t")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, fingerprint string, row int").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def exact_ids(path, found):
    tokenizer = Tokenizer.from_file(path)
    return [np.array([*e.ids, 1], "<u4") for e in tokenizer.encode_batch([t or "" for t in found], add_special_tokens=False)]


def fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] or [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def linked(fps, bits):
    """Component of each fingerprint, by comparing all pairs."""
    kinds = sorted(set(fps))
    root = {f: f for f in kinds}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in kinds}


def test_simhash_components_equal_brute_force(docs, odd):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        fps = [fingerprint(r.text, 3) for r in rows]
        comp = linked(fps, 2)
        least = collections.defaultdict(lambda: None)
        for r, f in zip(rows, fps, strict=True):
            if r.doc_id is not None:
                least[comp[f]] = r.doc_id if least[comp[f]] is None else min(least[comp[f]], r.doc_id)
        expected = sorted((str(r.doc_id), f"{f:016x}", least[comp[f]]) for r, f in zip(rows, fps, strict=True))
        found = simhash.near_duplicates(df).select("id", "fingerprint", "component_id").collect()
        assert sorted((str(r.id), r.fingerprint, r.component_id) for r in found) == expected


@pytest.mark.parametrize("bits", [0, 1, 2, 4, 6])
def test_trie_finds_every_pair(bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, 3), dtype=np.uint64), axis=1)
    fps = np.unique(np.concatenate([base, base ^ flips, base ^ np.uint64(1)]))
    i, j = simhash.trie_pairs(fps, None, bits, wave=7)
    expected = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= bits}
    assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == expected
    orders, _ = simhash.trie_orders(bits)
    assert all(sum(w for _, w in o) == 64 for o in orders)


@pytest.mark.parametrize("held", [1, 50, 200_000])
def test_dense_groups_are_linked_without_all_their_pairs(held):
    rng = np.random.default_rng(held)
    centres = rng.integers(0, 2**63, 3, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (900, 4), dtype=np.uint64), axis=1)
    fps = np.unique(np.concatenate([np.repeat(centres, 300) ^ flips, rng.integers(0, 2**63, 50, dtype=np.uint64)]))

    def least(pairs, n):
        label = np.arange(n)
        while True:
            new = label.copy()
            for i, j in pairs:
                new[i] = new[j] = min(new[i], new[j])
            if np.array_equal(new, label):
                return label
            label = new

    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 6
    pairs = [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j]
    assert np.array_equal(simhash.trie_labels(fps, None, 6, wave=500, held_pairs=held), least(pairs, len(fps)))
    one, two = fps[::2], fps[1::2]
    across = [(i, j + len(one)) for i, j in zip(*np.nonzero(near[::2, 1::2]), strict=True)]
    assert np.array_equal(simhash.trie_labels(one, two, 6, wave=500, held_pairs=held), least(across, len(fps)))


def test_split_buckets_give_the_same_components(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))} | {int(x) for x in rng.integers(0, 2**62, 40)})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    comp = linked(fps, 2)
    groups = collections.defaultdict(set)
    for f, s in zip(fps, signed, strict=True):
        groups[comp[f]].add(s)
    expected = sorted(tuple(sorted(g)) for g in groups.values() if len(g) > 1)
    for rows in (4, 60, 20_000):
        found = collections.defaultdict(set)
        for r in simhash.components(simhash.near_links(df, 2, bucket_rows=rows)).collect():
            found[r.root].add(r.node)
        assert sorted(tuple(sorted(g)) for g in found.values()) == expected


def test_the_walk_leaves_exceeded_budgets():
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    looked = []

    def note(nodes):
        looked.append(len(nodes))
        return np.zeros(len(nodes), bool)

    for free in (0, 21):
        looked.clear()
        pairs = list(simhash._walk(fps, fps, True, 2, free, 10**6, note))
        assert not pairs and sum(looked) < len(fps) ** 2 / 8  # random fingerprints: few of the 8 million pairs are reached


def test_long_chains_are_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(3000)], "a long, b long").repartition(4)
    found = simhash.components(chain)
    assert found.count() == 3001 and {r.root for r in found.select("root").distinct().collect()} == {0}


def test_simhash_of_an_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one_of_each_group(odd, empty):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and simhash.keep_one(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert [t for _, t in rows].count("same text here") == 1 and len({(t or "").split() == [] for _, t in rows}) == 2
    assert (10, "same text here") in rows


def test_lm_base_is_exact_and_scores_beat_subword_counts(spark):
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    found = {r.id: r for r in lm.fit_and_score(docs, ~held, WORD, block_docs=150).collect()}
    tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t in texts(docs).items()}
    out = {i for i in tokens if zlib.crc32(str(i).encode()) % 5 == 1}
    c = collections.Counter(w for i, x in tokens.items() if i not in out for w in x)
    n, v = sum(c.values()), len(c)
    for i, x in tokens.items():
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(c[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), rel=1e-9)
        assert np.isfinite(r.score) and r.score < 0
    # the same ids and ends of words with probabilities from their counts alone
    words = lm.Words(WORD)
    learnt, _ = words.texts(pa.array([t for i, t in texts(docs).items() if i not in out], pa.large_string()))
    counts = np.bincount(learnt, minlength=words.rows) + 0.5
    for ids in (out, set(tokens) - out):
        rows, _ = words.texts(pa.array([texts_ for i, texts_ in texts(docs).items() if i in ids], pa.large_string()))
        assert sum(found[i].score for i in ids) > np.log10(counts / counts.sum())[rows].sum()


def small_lm(seed=0, scale=0.5, **options):
    rng = np.random.default_rng(seed)
    tokens = np.array([20, 3, 90, 70, 50, 30, 9, 7, 5, 3, 2, 1, 0, 0], float)
    layout = lm.Layout.of(tokens, np.floor(tokens / 3), singles=3, middle=4, tails=2, embeds=8)
    m = lm.AttentionModel.new(layout, block=4, dims=5, keys=3, hidden=6)
    for p in m.PARTS:
        setattr(m, p, rng.normal(0, scale, getattr(m, p).shape))
    counts = np.array([1, 4, 5, 13, 0, 8])
    return m, rng.integers(0, len(tokens), counts.sum()), counts


def test_lm_probabilities_of_the_vocabulary_sum_to_one():
    m, _, _ = small_lm()
    size = len(m.layout.head_of)
    hidden = np.random.default_rng(1).normal(0, 2, (7, 6))
    total = np.exp(lm.log_probabilities(m, np.repeat(hidden[:, None], size, 1), np.tile(np.arange(size), (7, 1)))).sum(axis=1)
    assert np.allclose(total, 1) and np.allclose(np.exp(m.layout.log_last) + np.exp(m.layout.log_more), 1)
    for tokens in (np.zeros(5), np.array([1.0, 0, 0])):  # nothing learnt
        layout = lm.Layout.of(tokens, np.zeros(len(tokens)))
        m = lm.AttentionModel.new(layout)
        assert np.exp(lm.log_probabilities(m, np.zeros((len(tokens), 16)), np.arange(len(tokens)))).sum() == pytest.approx(1)


@pytest.mark.parametrize("scale", [0.5, 6])
def test_lm_scores_each_token_once_from_what_comes_before(scale):
    m, rows, counts = small_lm(scale=scale)
    inputs, usable, target, scored = lm.windows_of(m, rows, counts)
    assert scored.sum() == len(rows) and target[scored].tolist() == rows.tolist()
    hidden, _ = lm.hidden_states(m, inputs, usable)
    slow = lm.log_probabilities(m, hidden, target)
    fast = lm.FastScorer(m)
    assert fast._shift == (scale == 6)
    found = fast(rows, counts, batch=3)
    assert np.allclose(found, slow[scored], atol=1e-3, rtol=1e-4)
    ends = np.cumsum(counts)
    for k, n in enumerate(counts):  # each text by itself, and each token without the later ones
        own = rows[ends[k] - n : ends[k]]
        assert np.allclose(fast(own, np.array([n])), found[ends[k] - n : ends[k]], atol=1e-3, rtol=1e-4)
        for j in range(1, n + 1):
            assert np.allclose(fast(own[:j], np.array([j])), found[ends[k] - n : ends[k] - n + j], atol=1e-3, rtol=1e-4)
    # by hand: the third token of the second text
    text, table = rows[1:5], m.layout.embed_of
    x = m.embed[table[[lm.END, text[0], text[1]]]]
    a = x[2] @ m.wq @ (x @ m.wk).T / np.sqrt(3) + m.distance[[2, 1, 0]]
    a = np.exp(a - a.max())
    state = x[2] @ m.we + a / a.sum() @ (x @ m.wv)
    assert lm.log_probabilities(m, state, text[2]) == pytest.approx(found[3], abs=1e-3, rel=1e-4)


def test_lm_gradients_of_a_stream_are_those_of_its_windows():
    m, rows, counts = small_lm()
    inputs, places = lm.stream(rows, counts, m.block)
    target, scored = np.zeros(len(inputs), np.int64), np.zeros(len(inputs), bool)
    target[places], scored[places] = rows, True
    g, found = lm.gradients(m, *lm.windows_of(m, rows, counts)), lm.stream_gradients(m, inputs, target, scored)
    assert all(np.allclose(g[name], found[name], atol=1e-6) for name in m.PARTS)


def test_lm_layer_is_trained_by_every_training_document(spark, tmp_path, monkeypatch):
    rows = [(i, f"w{i} word of text {i * 7}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs, seen, train = spark.read.parquet(str(tmp_path / "d")), [], lm._train_everywhere

    def watched(texts, *args, **options):
        seen.extend(r.text for r in texts.collect())
        return train(texts, *args, **options)

    monkeypatch.setattr(lm, "_train_everywhere", watched)
    assert lm.fit_and_score(docs, F.col("doc_id") % 5 != 1, WORD, start_steps=2).count() == 40
    assert sorted(seen) == sorted(t for i, t in rows if i % 5 != 1)


def test_lm_gradients_are_those_of_differences():
    m, rows, counts = small_lm()
    case = lm.windows_of(m, rows, counts)
    inputs, usable, target, scored = case

    def loss():
        return -lm.log_probabilities(m, lm.hidden_states(m, inputs, usable)[0], target)[scored].mean()

    g = lm.gradients(m, *case)
    for name in m.PARTS:
        part = getattr(m, name)
        for at in {(0,) * part.ndim, tuple(n - 1 for n in part.shape), tuple(n // 2 for n in part.shape)}:
            part[at] += 1e-5
            up = loss()
            part[at] -= 2e-5
            down = loss()
            part[at] += 1e-5
            assert g[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


@pytest.mark.parametrize("scale", [0.5, 6])
def test_lm_middle_ids_are_told_apart_in_classes(scale):
    rng = np.random.default_rng(2)
    tokens = np.concatenate([[20, 3], rng.permutation(np.arange(40))]).astype(float)
    layout = lm.Layout.of(tokens, np.floor(tokens / 3), singles=5, middle=17, tails=2, embeds=30, classes=3)
    assert np.diff(layout.edges).tolist() == [5, 6, 6] and layout.middles == 17 and layout.heads == 1 + 5 + 3 + 2
    m = lm.AttentionModel.new(layout, block=4, dims=5, keys=3, hidden=6)
    for p in m.PARTS:
        setattr(m, p, rng.normal(0, scale, getattr(m, p).shape))
    counts = np.array([9, 1, 30, 0, 200])
    rows = rng.integers(0, len(tokens), counts.sum())
    hidden = rng.normal(0, 2, (7, 6))
    total = np.exp(lm.log_probabilities(m, np.repeat(hidden[:, None], len(tokens), 1), np.tile(np.arange(len(tokens)), (7, 1)))).sum(axis=1)
    assert np.allclose(total, 1)
    case = lm.windows_of(m, rows, counts)
    inputs, places = lm.stream(rows, counts, m.block)
    target, scored = np.zeros(len(inputs), np.int64), np.zeros(len(inputs), bool)
    target[places], scored[places] = rows, True
    g, found = lm.gradients(m, *case), lm.stream_gradients(m, inputs, target, scored)
    assert all(np.allclose(g[name], found[name], atol=1e-6 * max(1, np.abs(g[name]).max())) for name in m.PARTS)
    slow = lm.log_probabilities(m, lm.hidden_states(m, *case[:2])[0], case[2])[case[3]]
    assert np.allclose(lm.FastScorer(m)(rows, counts, batch=3), slow, atol=2e-3, rtol=1e-3)
    if scale < 1:

        def loss():
            return -lm.log_probabilities(m, lm.hidden_states(m, *case[:2])[0], case[2])[case[3]].mean()

        for at in ((0, 0), (3, 8), (5, 16)):
            m.middle[at] += 1e-5
            up = loss()
            m.middle[at] -= 2e-5
            down = loss()
            m.middle[at] += 1e-5
            assert g["middle"][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_lm_steps_are_adams():
    m, rows, counts = small_lm()
    adam, case = lm.Adam(m), lm.windows_of(m, rows, counts)
    expected, mean, square = m.vector(), 0.0, 0.0
    for k in range(1, 6):
        g = lm.gradients(m, *case)
        flat = np.concatenate([g[p].reshape(-1) for p in m.PARTS])
        adam.step(g, 0.01)
        mean, square = 0.9 * mean + 0.1 * flat, 0.99 * square + 0.01 * flat**2
        expected = expected - 0.01 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        assert np.allclose(m.vector(), expected, atol=1e-9) and m.vector().tolist() == adam.flat.tolist()


def test_lm_trains_on_stored_rows_of_texts(spark, odd, tmp_path, monkeypatch):
    import pyarrow as pa

    odd.write.parquet(str(tmp_path / "d"))
    docs, seen, train, words = spark.read.parquet(str(tmp_path / "d")), [], lm._train_everywhere, lm.Words(WORD)

    def watched(texts, start, kind, tasks):
        seen.extend((r.text, bytes(r.ids)) for r in texts.collect())
        assert "text#" not in texts.select("ids")._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
        return train(texts, start, kind, tasks)

    monkeypatch.setattr(lm, "_train_everywhere", watched)
    assert lm.fit_and_score(docs, F.lit(True), WORD, start_steps=2, block_docs=3).count() == len(seen) == docs.count()
    for text, ids in seen:
        rows, counts = words.texts(pa.array([text], pa.large_string()))
        assert lm.rows_of(pa.array([ids]), words.kind)[0].tolist() == rows.tolist() and len(rows) == counts[0]
    # rows and ends of words come back from what is stored, also from a slice of it
    table = pa.array([t for t, _ in seen], pa.large_string())
    split, codes, n = words.split(table)
    flat, last, counts = words.joined(*words.subwords(split), codes, n)
    ids, bits = lm.stored_rows(flat, last, counts, words.kind)
    assert lm.lasts_of(bits, counts).tolist() == last.tolist() and last.sum() == len(codes) + len(seen)
    cut = counts[:2].sum()
    assert lm.rows_of(ids.slice(2), words.kind)[0].tolist() == flat[cut:].tolist() and lm.lasts_of(bits.slice(2), counts[2:]).tolist() == last[cut:].tolist()


def test_lm_of_odd_texts(spark, odd, empty):
    assert lm.fit_and_score(empty, F.lit(True), WORD, start_steps=2).count() == 0
    rows = lm.fit_and_score(odd, F.col("doc_id") > 4, WORD, start_steps=2, train_share=1.0, block_docs=3).collect()
    assert len(rows) == odd.count() and all(r.score < 0 for r in rows)
    same = [r for r in rows if r.id in (10, 11)]
    assert len({r.base_score for r in same}) == 1 and same[0].score == pytest.approx(same[1].score, rel=1e-5)
    none = lm.fit_and_score(odd, F.lit(False), WORD, start_steps=2).collect()
    assert len(none) == odd.count() and all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in none)


@pytest.mark.parametrize(("path", "lead"), [(BYTE, True), (WORD, False)])
def test_cached_encoding_equals_the_library(docs, path, lead):
    cases = ODD + ["  a b", "a \n b", "tab\t tab", "z\x1c y", "\rfoo bar", "don 't 's x", "a.. b!? C", "中文 字。x", "e\u0301\u0301 a \u0301b", "<|endoftext|> x", "A_b c", "a×, b÷!? c", "x <|ENDOFTEXT|>y <|startoftext|>z  <|endoftext|>", "İx İ. K", "É. ÿ; Ɏ! ɐ.", "\n\nHello\n\n\nWorld  .\n", "x\u0085y", "a \x0b b"]
    rng = np.random.default_rng(1)
    signs = ["a", "B", "é", "×", " ", "  ", "\n", "\t", "\r", ".", ",", "'", "s", "<|endoftext|>", "1", "\u0301", "İ", "中", "\x1d", "\u00a0", "!?"]
    cases += ["".join(rng.choice(signs, rng.integers(1, 14))) for _ in range(5000)] + list(texts(docs).values())
    encoder, want = common.PieceEncoder(path, lead), [x[:-1].tolist() for x in exact_ids(path, cases)]
    for some in (cases, cases[::-1]):  # the second time from the cache
        ids, sizes = encoder.encode(some)
        found = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert found == (want if some is cases else want[::-1])
    import pyarrow as pa

    for a, b in common.text_slices(pa.array(cases, pa.string()), 3000):  # slices of one array
        ids, sizes = encoder.encode(pa.array(cases, pa.string()).slice(a, b - a))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want[a:b]


def test_token_store_round_trip(spark, docs, odd, empty, tmp_path):
    repeats = spark.createDataFrame([(1, "b c d"), (2, "x"), (1, "a"), (None, "n"), (1, "a b"), (1, "a")], "doc_id long, text string").coalesce(1)
    for name, df in (("docs", docs), ("odd", odd), ("empty", empty), ("repeats", repeats)):
        path = str(tmp_path / name)
        tokenstore.write_ids(df, path, WORD)
        found = tokenstore.digest(tokenstore.read_ids(spark, path)).orderBy("start").collect()
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
        start = 0
        for f, r, ids in zip(found, rows, exact_ids(WORD, [r.text for r in rows]), strict=True):
            assert (f.id, f.start, f.n_tokens, f.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    one = tokenstore.read_ids(spark, str(tmp_path / "docs")).where("id = 7")
    assert "EqualTo(id,7)" in one._jdf.queryExecution().toString() and one.count() == 1


def test_token_store_splits_at_stripes_and_skips_them(spark, tmp_path):
    path = str(tmp_path / "many")
    docs = spark.range(0, 40_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.md5(F.concat("id", F.lit(f"/{k}")).cast("binary")) for k in range(4))).alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        tokenstore.write_ids(docs, path, WORD, stripe_bytes=1 << 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    from pyarrow import orc

    (file,) = [str(p) for p in (tmp_path / "many").glob("*.orc")]
    assert orc.ORCFile(file).nstripes > 3
    stored = tokenstore.read_ids(spark, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        per_task = [r["count"] for r in stored.groupBy(F.spark_partition_id()).count().collect()]
        assert len(per_task) > 3 and sum(per_task) == 40_000  # stripes of one file go to several tasks
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert stored.where("id = 39999").count() == 1
    plan = stored.where("id = 39999")._jdf.queryExecution()
    plan.toRdd().count()
    scan = plan.executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() <= 1000  # one row group of one stripe


@pytest.mark.parametrize("group", [500, 4_000_000])
def test_packing_covers_every_id_once(docs, odd, group):
    for df in (docs, odd):
        pieces = packing.pack(df, BYTE, window=256, group_tokens=group, with_ids=True)
        rows = pieces.collect()
        held = collections.Counter((r.text, r.doc_id) for r in df.select("doc_id", "text").collect())
        assert sum(r.length for r in rows) == sum(len(x) * n for x, n in zip(exact_ids(BYTE, [t for t, _ in held]), held.values(), strict=True))
        windows = collections.defaultdict(list)
        for r in rows:
            assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
            windows[r.sequence_id].append((r.offset, r.length))
        for w in windows.values():
            at = 0
            for offset, length in sorted(w):
                assert offset == at
                at += length
            assert at <= 256
        assert sum(256 - sum(n for _, n in w) for w in windows.values()) < 256 * pieces.rdd.getNumPartitions() + 1
    whole = packing.sequences(packing.pack(odd, BYTE, window=256, with_ids=True), 256).collect()
    assert all(len(r.ids) == 256 or r.n_tokens.bit_count() == 1 for r in whole)


def test_best_fit_takes_the_tightest_window():
    tree = packing.CapacityTree(16)
    for window, capacity in ((1, 9), (2, 4), (3, 12), (4, 4)):
        tree.add(window, capacity)
    assert tree.tightest(5) == (1, 9) and tree.tightest(4)[1] == 4 and tree.tightest(3)[1] == 4 and tree.tightest(13) is None and tree.tightest(1) == (3, 12)


def best_fit_decreasing(sizes, window):
    """Windows of (document, start, length): full ones cut off first, then rests by falling length into the tightest window that holds them, of equal ones the last used."""
    windows = [[(d, w * window, window)] for d, n in enumerate(sizes) for w in range(n // window)]
    opened = []  # (room, pieces), the last used at the end
    for n, d in sorted(((n % window, d) for d, n in enumerate(sizes) if n % window), key=lambda r: (-r[0], r[1])):
        room = min((r for r, _ in opened if r >= n), default=None)
        k = max((i for i, (r, _) in enumerate(opened) if r == room), default=None)
        room, pieces = (window, []) if k is None else opened.pop(k)
        opened.append((room - n, [*pieces, (d, sizes[d] - n, n)]))
    return sorted(windows + [p for _, p in opened])


@pytest.mark.parametrize("seed", range(6))
def test_windows_are_those_of_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.choice((8, 64, 2048)))
    sizes = [int(n) for n in rng.integers(1, rng.choice((window // 2, window, 5 * window)), 400)]
    packer = packing.Packer(window)
    closed = [pieces for _, pieces in packer.place(list(enumerate(sizes)))]
    assert sorted(closed + list(packer.windows.values())) == best_fit_decreasing(sizes, window)


def test_repeated_passages_go_and_others_stay(spark, tmp_path):
    rng = np.random.default_rng(5)
    line = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))
    passage = [line(20), line(25), line(15)]
    rows = [(0, "\n".join([line(9), *passage, line(9)])), (1, "\n".join([line(9), line(12), *passage, line(30)])), (2, "\n".join([line(9), line(8)])), (3, None), (4, ""), (5, line(60)), (6, line(5))]
    rows += [(7, rows[5][1]), (8, rows[6][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found = {r.doc_id: r for r in linededup.dedup_lines(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert found[0].text == rows[0][1] and found[0].n_removed_lines == 0
    assert found[1].n_removed_lines == 3 and found[1].text == "\n".join(rows[1][1].split("\n")[:2] + rows[1][1].split("\n")[5:])
    assert [found[i].text for i in (2, 3, 4, 5, 6, 8)] == [rows[i][1] for i in (2, 3, 4, 5, 6, 8)] and found[7].text == ""
    assert (found[3].n_lines, found[4].n_lines) == (0, 1)


def test_passages_after_short_lines_go(spark, tmp_path):
    rng = np.random.default_rng(7)
    line = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))
    single, two = line(60), [line(20), line(25)]
    rows = [(i, "\n".join([line(2), *([single] if i % 2 else two), line(3)])) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found = {r.doc_id: r.n_removed_lines for r in linededup.dedup_lines(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert found == {i: 0 if i < 2 else 1 if i % 2 else 2 for i in range(60)}


def lines_left(rows, **options):
    """dedup_lines() on (id, text) rows in order, with one dictionary."""
    first, gone = {}, [set() for _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in order:
        for a, b, _ in linededup.chunks(rows[i][1], **options):
            passage = tuple(rows[i][1].split("\n")[a:b])
            if first.setdefault(passage, (i, a)) != (i, a):
                gone[i] |= set(range(a, b))
    return [t if not g else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g) for (_, t), g in zip(rows, gone, strict=True)]


@pytest.mark.parametrize("hot_share", [1, 10_000])
def test_line_dedup_equals_brute_force(spark, docs, tmp_path, hot_share):
    rng = np.random.default_rng(3)
    pool = [" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in (1, 2, 3, 9, 12, 60, 4, 8)] + [""]
    rows = [(int(i) if i % 11 else None, "\n".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(1, 12)))) for i in range(150)]
    rows += [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    rows = [(r.doc_id, r.text) for r in stored.collect()]
    found = linededup.dedup_lines(stored, hot_share=hot_share)
    assert collections.Counter((r.doc_id, r.text) for r in found.collect()) == collections.Counter((i, t) for (i, _), t in zip(rows, lines_left(rows), strict=True))


def test_boundaries_are_local():
    rng = np.random.default_rng(11)
    lines = [f"w{x}" for x in rng.integers(0, 10**9, 400)]
    for extra in (1, 3):
        before, after = linededup.chunks("\n".join(lines)), linededup.chunks("\n".join(lines[:200] + ["new"] * extra + lines[200:]))
        hashes = {h for _, _, h in before}
        moved = [a for a, _, h in after if h not in hashes]
        assert moved and min(moved) > 180 and max(moved) < 220
    assert max(b - a for a, b, _ in linededup.chunks("x\n" * 500, divisor=10**9, max_lines=10)) == 20  # two segments


def test_line_dedup_of_odd_texts(spark, odd, empty):
    found = linededup.dedup_lines(odd)
    assert found.columns == [*odd.columns, "n_lines", "n_removed_lines"] and found.count() == odd.count() and linededup.dedup_lines(empty).count() == 0
    removed = {r.n_removed_lines for r in found.collect() if (r.text or "") == "" and r.doc_id == 9}
    assert removed == {1}  # of the two equal rows one keeps its 3,000 words
    named = spark.createDataFrame([(1, "a", 99, "own")], "doc_id long, text string, n_lines int, n_removed_lines string")
    assert linededup.dedup_lines(named).first().asDict() == {"doc_id": 1, "text": "a", "n_lines": 99, "n_removed_lines": "own", "n_lines_": 1, "n_removed_lines_": 0}


def test_quality_signals_and_verdicts(spark, docs, odd, empty):
    word = re.compile(r"[^\x20\x09-\x0d]+")
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0
    for df in (docs, odd):
        judged = quality.judge(df).collect()
        seen = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            w = word.findall(r.text or "")
            n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
            cover = {i + k for i in range(len(w) - 2) if n[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
            lines = [x for x in (r.text or "").split("\n") if word.search(x)]
            seen[r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)] += 1
        assert seen == collections.Counter((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judged)
        assert quality.keep_good(df).columns == df.columns and quality.keep_good(df).count() == sum(r.kept for r in judged)


def test_bad_hosts_go_and_the_salted_join_agrees(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "bad", "short" if i % 4 else good) for i in range(40)] + [(100 + i, "good", good) for i in range(40)] + [(200, None, good), (201, "once", "short")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r.id for r in quality.judge(df).collect() if r.kept}
    assert kept == {*range(100, 140), 200}
    hosts = spark.createDataFrame([("bad", False), ("good", True), ("", True), ("once", True)], "host string, host_kept boolean")
    a, b = (sorted(map(str, quality.join_hosts(df, hosts, F.col("source"), F.col("doc_id"), broadcast_hosts=n).collect())) for n in (10, 0))
    assert a == b and len(a) == df.count()


def test_decontamination_finds_plants_with_substitutions(spark, tmp_path):
    rng = np.random.default_rng(2)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 5))
    items = [[word() for _ in range(n)] for n in (40, 30, 7, 3)]
    filler = lambda n: [word() for _ in range(n)]
    swapped = list(items[0])
    for i in (5, 14, 23, 33):
        swapped[i] = word()
    rows = [(0, " ".join(filler(30) + items[0] + filler(30))), (1, " ".join(filler(500) + swapped)), (2, " ".join(filler(100))), (3, " ".join(filler(9) + items[1][:12] + filler(40))), (4, " ".join(filler(5) + items[2]).upper() + "!"), (5, " ".join(items[3])), (6, None), (7, ""), (8, " ".join(items[1][5:25]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(9, None)], "item_id long, text string")
    found = {(r.id, r.item): r for r in decontam.contaminated(docs, bench).collect()}
    assert set(found) == {(0, 0), (1, 0), (4, 2), (8, 1)}
    assert (found[0, 0].first_word, found[0, 0].n_words, found[1, 0].n_equal) == (30, 40, 36)
    assert {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()} == {2, 3, 5, 6, 7}


def test_decontamination_at_the_stated_limits(spark, tmp_path):
    rng = np.random.default_rng(12)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    rows, items = [], []
    for n, subs, hit in ((15, 1, True), (15, 2, True), (16, 3, True), (18, 3, True), (20, 4, True), (25, 5, True), (15, 3, False), (5, 1, True), (6, 2, False), (9, 1, True), (10, 2, True), (12, 2, True), (12, 3, False)):
        for _ in range(12):
            item = [word() for _ in range(n)]
            copy = list(item)
            for k in rng.choice(n, subs, replace=False):
                copy[k] = word()
            items.append((len(items), " ".join(item)))
            rows.append((len(rows), " ".join([*(word() for _ in range(20)), *copy, *(word() for _ in range(20))]), hit))
    spark.createDataFrame(rows, "doc_id long, text string, hit boolean").write.parquet(str(tmp_path / "d"))
    found = decontam.contaminated(spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.id, r.item) for r in found} == {(i, i) for i, _, hit in rows if hit}
    for n in range(1, 40):
        equal = rng.random(n) < 0.75
        longest = max((b - a for a in range(n) for b in range(a + 1, n + 1) if equal[a] and equal[b - 1] and equal[a:b].mean() >= 0.8), default=0)
        a, b, count = decontam.best_stretch(equal, 0.8)
        assert b - a <= longest and count >= 0.8 * (b - a) - 1e-6 and count == equal[a:b].sum()


def overlaps(text, item, min_words=13, share=0.8):
    """Whether any stretch of any diagonal has enough equal words: all stretches of all diagonals with as many equal words at all."""
    d, t = decontam.words_of(text), decontam.words_of(item)
    if len(t) < 5:
        return False
    need = min_words if len(t) >= min_words else share * len(t) - 1e-9
    places = collections.defaultdict(list)
    for k, w in enumerate(t):
        places[w].append(k)
    equal_at = collections.defaultdict(list)
    for k, w in enumerate(d):
        for i in places.get(w, ()):
            equal_at[k - i].append(k)
    for found in equal_at.values():
        if len(found) < need:
            continue
        for a in range(len(found)):  # a longest stretch begins and ends with an equal word
            last = np.array(found[a:])
            equal = np.arange(1, len(last) + 1)
            if ((equal >= need) & (equal >= share * (last - found[a] + 1) - 1e-9)).any():
                return True
    return False


def test_decontamination_equals_brute_force_over_all_diagonals(spark, tmp_path):
    rng = np.random.default_rng(21)
    word = lambda: f"w{rng.integers(0, 400)}"
    items = [[word() for _ in range(n)] for n in (14, 20, 33, 6, 11, 60, 400, 4)]
    rows = []
    for i in range(160):
        item = items[i % len(items)]
        a = int(rng.integers(0, max(1, len(item) - 20))) if len(item) > 30 else 0
        part = [word() if rng.random() < (0.05, 0.15, 0.22, 0.3)[i // len(items) % 4] else w for w in item[a : a + int(rng.integers(10, 60))]]
        rows.append((i, " ".join([*(word() for _ in range(20)), *part, *(word() for _ in range(15))])))
    # sparse hits far from each other: equal words only at the ends of a long item
    long = items[6]
    rows.append((900, " ".join(long[:14] + [word() for _ in range(372)] + long[386:])))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    bench = [(i, " ".join(x)) for i, x in enumerate(items)]
    want = {(i, k) for i, text in rows for k, item in bench if overlaps(text, item)}
    for extra in ([], [(99, "only three words"), (98, "one two three four five six")]):  # other items change nothing
        found = decontam.contaminated(spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(bench + extra, "item_id long, text string"))
        assert {(r.id, r.item) for r in found.collect()} == want
    assert 40 < len(want) < 160


def placements_left(masks, words, substitutions):
    """Whether some way to substitute so many words leaves no mask a window of equal words: a search over the words that a window picks."""
    windows = [{p + i for i, c in enumerate(m) if c == "1"} for m in masks for p in range(words - len(m) + 1)]

    def hidden(left, gone):
        window = next((w for w in windows if not w & gone), None)
        return window is None or left > 0 and any(hidden(left - 1, gone | {i}) for i in window)

    return hidden(substitutions, frozenset())


def test_spaced_masks_miss_no_overlap_at_the_limits():
    limits = [(n, n - -(-8 * n // 10)) for n in range(5, 13)] + [(equal + equal // 4, equal // 4) for equal in range(13, 26)]
    assert all("0" in mask for mask in decontam.MASKS)
    assert not [x for x in limits if placements_left(decontam.MASKS, *x)]
    assert (10, 2) in [x for x in limits if placements_left(("1111",), *x)] and placements_left(decontam.MASKS[:3], 5, 1)


def test_spaced_masks_find_what_four_words_in_a_row_cannot(spark, tmp_path):
    rng = np.random.default_rng(31)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    rows, items = [], []
    for n, subs in ((10, (3, 7)), (5, (2,)), (6, (3,)), (11, (3, 7)), (12, (3, 8))):
        item = [word() for _ in range(n)]
        items.append((len(items), " ".join(item)))
        rows.append((len(rows), " ".join([*(word() for _ in range(9)), *(word() if k in subs else w for k, w in enumerate(item)), *(word() for _ in range(9))])))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs, bench = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(items, "item_id long, text string")
    found = lambda masks: {(r.id, r.item) for r in decontam.contaminated(docs, bench, masks=masks).collect()}
    assert found(decontam.MASKS) == {(i, i) for i in range(5)}
    assert found(("1111",)) == {(4, 4)}


def test_own_columns_survive_the_filter(spark, tmp_path):
    spark.createDataFrame([(1, "w " * 20, 5), (2, "x", 6)], "doc_id long, text string, __sessionloom_row int").write.parquet(str(tmp_path / "d"))
    bench = spark.createDataFrame([(1, "w " * 20)], "item_id long, text string")
    assert [tuple(r) for r in decontam.drop_contaminated(spark.read.parquet(str(tmp_path / "d")), bench).collect()] == [(2, "x", 6)]


def test_decontamination_of_odd_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, "w " * 20)], "item_id long, text string")
    assert {r.id for r in decontam.contaminated(odd, bench).collect()} == {9}
    none = spark.createDataFrame([], bench.schema)
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.drop_contaminated(odd, none).count() == odd.count()


def test_language_id(docs, odd, empty):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = langid.fit(docs, ~held)
    rows = langid.predict(docs, model).join(docs.select(F.col("doc_id").alias("id"), "lang", held.alias("held")), "id").where("held").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.95 and all(0 <= r.score <= 1 for r in rows)
    found = {r.id: r for r in langid.predict(odd, model).collect()}
    assert [found[i].lang_pred for i in (0, 1, 2, 13)] == ["und"] * 4 and found[3 if 3 in found else None].lang_pred in model.languages
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(empty, F.lit(True))).collect()} == {"und"} and langid.predict(empty, model).count() == 0


def test_language_predictions_equal_plain_means(docs):
    model = langid.fit(docs, F.lit(True), per_language=20)
    table = model.embeddings @ model.weights
    for r in langid.predict(docs, model).join(docs.select(F.col("doc_id").alias("id"), "text"), "id").limit(60).collect():
        words = common.words_of(r.text)
        if r.lang_pred == "und":
            assert not any(map(str.isalpha, r.text or "")) and r.score == 0
            continue
        grams, _ = common.word_grams(words, model.sizes, len(model.embeddings))
        logits = (table[grams].astype(float).mean(axis=0) + model.bias) / model.temperature
        p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        assert r.lang_pred == model.languages[int(p.argmax())] and r.score == pytest.approx(p.max(), abs=1e-4)


def test_snippets_are_drawn_evenly():
    texts_ = ["aa bb " * 2000] + ["cc dd ee ff"] * 30 + ["xx yy zz"] * 10
    model = langid.train(texts_, ["a"] * 31 + ["b"] * 10, snippet_words=4, language_snippets=31, epochs=8)
    words = [b"cc", b"xx"]
    grams, counts = common.word_grams(words, model.sizes, len(model.embeddings))
    means = common.segment_sums((model.embeddings @ model.weights)[grams], counts) / counts[:, None] + model.bias
    assert model.probabilities(means).argmax(axis=1).tolist() == [0, 1]  # the long document leaves room for the others


@pytest.mark.parametrize("limit", [32 << 20, 50_000, 2_000])
def test_shards_fit_and_are_as_short_as_can_be(docs, limit):
    rows = sharding.assign_shards(docs, limit).collect()
    assert len(rows) == docs.count()
    size, number = collections.Counter(), collections.Counter()
    for r in rows:
        size[r.shard] += r.bytes
        number[r.shard] += 1
    assert all(n <= limit or number[s] == 1 for s, n in size.items())
    for s in size:
        if s != "*":
            above = [r for r in rows if r.shard.startswith(s[:-1])]
            assert sum(r.bytes for r in above) > limit and len(above) > 1


def test_repeated_ids_go_to_overflow_pages(spark, odd, empty):
    df = spark.createDataFrame([(7, "x" * 100)] * 50 + [(i, "y" * 50) for i in range(100, 120)] + [(None, "z")] * 3, "doc_id long, text string").repartition(3)
    rows = sharding.assign_shards(df, 1000).collect()
    size = collections.Counter()
    for r in rows:
        size[r.shard, r.page] += r.bytes
    assert len(rows) == 73 and max(size.values()) <= 1000
    assert sharding.assign_shards(empty, 1000).count() == 0 and sharding.assign_shards(odd, 1000).count() == odd.count()


def test_write_shards(spark, docs, odd, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), 100_000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()
    path = str(tmp_path / "t")
    rows = [(None, "a" * 30, "own"), (1, "b" * 30, "own"), (1, "c" * 30, None), (2, "d" * 30, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, shard string").write.parquet(path)
    column = sharding.write_shards(spark.read.parquet(path), str(tmp_path / "u"), 60)
    found = spark.read.parquet(str(tmp_path / "u"))
    assert column == "shard_" and sorted(map(str, found.select("doc_id", "text", "shard").collect())) == sorted(map(str, spark.read.parquet(path).collect()))
    assert all(r["n"] <= 60 for r in found.groupBy(column).agg(F.sum(F.length("text")).alias("n")).collect())
    sharding.write_shards(odd, str(tmp_path / "v"), 1000)
    assert spark.read.parquet(str(tmp_path / "v")).count() == odd.count()


def test_scratch_tables_are_deleted(spark, docs, tmp_path):
    import os

    with common.scratch(spark):
        sharding.assign_shards(docs, 50_000).write.parquet(str(tmp_path / "s"))
        kept = [p for p in common._OPEN[-1] if os.path.exists(p)]
    assert kept and not any(map(os.path.exists, kept))


def enumerated(unary, counts, moves):
    """(log partition, log score of the clean chain, all (states, probability)) of each chain, one after another."""
    at = 0
    for n in counts:
        states = list(np.ndindex(*(2,) * n)) if n else [()]
        scores = []
        for state in states:
            path = (0, *state)
            scores.append(sum(unary[at + i] * x for i, x in enumerate(state)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        total = np.logaddexp.reduce(scores)
        yield total, scores[0] - total, list(zip(states, np.exp(np.array(scores) - total), strict=True))
        at += n


def chain_case():
    rng = np.random.default_rng(4)
    counts = np.array([3, 0, 1, 5, 2])
    return rng.normal(0, 2, counts.sum()), counts, rng.normal(0, 1, (2, 2))


def test_marginals_equal_enumeration():
    unary, counts, moves = chain_case()
    expected, clean = [], []
    for (_, log_clean, states), n in zip(enumerated(unary, counts, moves), counts, strict=True):
        expected.extend(sum(p * np.array(s) for s, p in states) if n else [])
        clean.append(log_clean)
    chains = toxicity.Chains(unary, counts, moves)
    assert np.allclose(chains.p, expected, atol=1e-12) and np.allclose(chains.log_clean(), clean, atol=1e-12)


def test_crf_gradients_are_those_of_differences():
    unary, counts, moves = chain_case()
    log_z = lambda u, m: sum(z for z, _, _ in enumerated(u, counts, m))
    chains = toxicity.Chains(unary, counts, moves)
    expected = toxicity.transitions(chains.p[chains.first], chains.pairs())
    for a, b in np.ndindex(2, 2):  # the partition's derivatives are the expected uses
        step = np.zeros((2, 2))
        step[a, b] = 1e-5
        assert expected[a, b] == pytest.approx((log_z(unary, moves + step) - log_z(unary, moves - step)) / 2e-5, abs=1e-6)
    step = np.full(len(unary), 1e-5)  # the bias
    assert chains.p.sum() == pytest.approx((log_z(unary + step, moves) - log_z(unary - step, moves)) / 2e-5, abs=1e-6)


def test_tags_given_noisy_labels_equal_enumeration():
    unary, counts, moves = chain_case()
    toxic, noise = np.array([1, 0, 0, 1, 1]), 0.1
    tags, uses = [], np.zeros((2, 2))
    for (_, _, states), n, y in zip(enumerated(unary, counts, moves), counts, toxic, strict=True):
        if not n:
            continue
        weight = np.array([p * ((1 - noise) if (any(s) == (y == 1)) else noise) for s, p in states])
        weight /= weight.sum()
        tags.extend(sum(w * np.array(s) for w, (s, _) in zip(weight, states, strict=True)))
        for w, (s, _) in zip(weight, states, strict=True):
            for a, b in zip((0, *s), s, strict=False):
                uses[a, b] += w
    q, seen = toxicity.offending_given_label(toxicity.Chains(unary, counts, moves), toxic, noise)
    assert np.allclose(q, tags, atol=1e-9) and np.allclose(seen, uses, atol=1e-9)


def test_relabelling_finds_words_that_are_too_rare_for_labelled_tokens():
    rng = np.random.default_rng(8)
    clean = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(200)]
    docs, labels = [], []
    for i in range(600):
        words = [str(w) for w in rng.choice(clean, 25)]
        if i % 3 == 0:
            words[int(rng.integers(0, 25))] = f"grubbing{chr(97 + i // 6 % 26)}{chr(97 + i // 156)}" if i % 2 else "nastyword"
        docs.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    p = []
    for rounds in (0, 3):
        model = toxicity.train(docs, labels, rounds=rounds)
        p.append(toxicity.marginals(model.word_scores([b"grubbingaa", b"nastyword", clean[0].encode()])[0][:, 0], np.ones(3, int), model.moves))
    assert p[0][0] < 0.2 and p[1][0] > 0.5 and p[1][1] > 0.9 and p[1][2] < 0.1


def test_equal_texts_score_alike_wherever_they_stand(spark, docs):
    text = docs.where("length(text) > 2000").first().text
    rows = [(i, ("pad word " * i if i % 2 else text)) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = toxicity.SpanModel(np.random.default_rng(0).normal(0, 3, 1 << 16), layer=np.ones(5))
    assert len({r.score for r in toxicity.score(df, model).collect() if r.id % 2 == 0}) == 1


def test_toxic_spans(spark, odd, empty):
    rng = np.random.default_rng(6)
    clean = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(300):
        words = list(rng.choice(clean, 40))
        if i % 3 == 0:
            for k in rng.integers(0, 40, 3):
                words[k] = ["nastyword", "vileword"][k % 2]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, table, F.col("doc_id") % 5 != 0)
    found = {r.id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([found[i].predicted == y for i, y in labels if i % 5 == 0]) > 0.95
    for i, text in rows:
        assert {text[s.start : s.end] for s in found[i].spans} <= {"nastyword", "vileword"}
    spans = toxicity.score(spark.createDataFrame([(1, "héllo, NastyWord!")], "doc_id long, text string"), model).first().spans
    assert [(s.start, s.end) for s in spans] == [(7, 16)]
    assert toxicity.score(empty, model).count() == 0 and all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    flat = toxicity.fit(docs, table.where("toxic = 0"), F.lit(True))
    assert {round(r.score, 2) for r in toxicity.score(docs, flat).collect()} == {0.01}


def test_rare_toxic_labels_are_all_used(spark):
    rng = np.random.default_rng(9)
    clean = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(300)]
    rows = []
    for i in range(3000):
        words = list(rng.choice(clean, 30))
        if i % 100 == 0:
            words[int(rng.integers(0, 30))] = "nastyword"
        rows.append((i, " ".join(words), int(i % 100 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = {r.id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, docs, F.lit(True), per_class=60)).collect()}
    assert np.mean([found[i] for i, _, y in rows if y]) > 0.9 and np.mean([found[i] for i, _, y in rows if not y]) < 0.01
