"""The corpus pipeline's stages on small tables, and the queries' SQL."""

import os
import sys

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionloom.llm import neardup, queries, simhash

sys.path.insert(0, os.path.dirname(__file__))
from test_operators import exact_ids, lines_left, overlaps  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_decide(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF)
        found.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name == "quality_rules":
            clean = labels.where("quality = 1").join(spark.read.parquet(f"{SF}/documents.parquet").where(F.size(F.split("text", "[ \n]+")) > 60), "doc_id")
            assert clean.join(docs, "doc_id", "left_anti").count() <= 0.02 * clean.count()
        if name != "packing":
            assert docs.columns == columns
    assert sizes[0] > sizes[1] and sizes[1] == sizes[2] and sizes[2] > sizes[3] >= sizes[4] and sizes[5] >= sizes[4]
    assert corpus_pipeline.run(spark, SF).count() == sizes[5]


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages, found = dict(corpus_pipeline.STAGES), {}

    def stage(name, docs):
        stages[name](spark, docs, SF).write.parquet(str(tmp_path / name))
        stored = spark.read.parquet(str(tmp_path / name))
        found[name] = {r.doc_id: r.text for r in stored.collect()} if name != "packing" else stored.collect()
        return stored

    # quality rules: the SQL of operator 5
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op5_quality']}) WHERE kept").fetchall()}
    docs = stage("quality_rules", docs)
    assert set(found["quality_rules"]) == good
    # line dedup: one dictionary of passages
    rows = sorted(found["quality_rules"].items())
    docs = stage("line_dedup", docs)
    assert found["line_dedup"] == dict(zip([i for i, _ in rows], lines_left(rows), strict=True))
    # near-dedup: all pairs; every group keeps a document and no two kept ones are similar
    sets = {i: neardup.shingles(t, 5) for i, t in found["line_dedup"].items()}
    close = {(i, j) for i in sets for j in sets if i < j and (sets[i] == sets[j] or neardup.similar(sets[i], sets[j], 0.8))}
    docs = stage("near_dedup", docs)
    kept = set(found["near_dedup"])
    root = {i: i for i in sets}
    for _ in sets:
        for i, j in close:
            root[i] = root[j] = min(root[i], root[j])
    assert close and not any(i in kept and j in kept for i, j in close) and {root[i] for i in kept} == set(root.values())
    assert all(i in kept for i in sets if not any(i in pair for pair in close))
    # decontamination: all diagonals of all items
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = stage("decontaminate", docs)
    dirty = {i for i, text in found["near_dedup"].items() if any(overlaps(text, item) for item in bench.values())}
    assert set(found["decontaminate"]) == kept - dirty and dirty
    # packing: every id of every document in one place
    stage("packing", docs)
    lengths = dict.fromkeys(found["decontaminate"], 0)
    for r in found["packing"]:
        lengths[r.doc_id] += r.length
    ids = exact_ids(public_tokenizers.path("byte_bpe_50k.json"), list(found["decontaminate"].values()))
    assert lengths == {i: len(x) for i, x in zip(found["decontaminate"], ids, strict=True)}


def test_stages_take_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("empty", []), ("odd", [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "a b " * 40, "en", "s", 160)])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).collect()


def test_near_dedup_removes_pairs_at_the_stated_similarity(spark, tmp_path):
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    rows, expected, other = [], set(), set()
    for i in range(0, 400, 2):
        words = [word() for _ in range(200)]
        changed = list(words)
        for k in range(10, 200, 60 if i % 4 else 20):  # 4 or 10 of 200 words: similarities of 176/216 and 146/246
            changed[k] = word()
        rows += [(i, " ".join(words), "en", "s", 1), (i + 1, " ".join(changed), "en", "s", 1)]
        expected |= {i} if i % 4 else {i, i + 1}
        a, b = ({tuple(x[k : k + 5]) for k in range(196)} for x in (words, changed))
        assert (len(a & b) >= 0.8 * len(a | b)) == bool(i % 4)
        other.add(simhash.fingerprints([" ".join(words)], 5)[0] ^ simhash.fingerprints([" ".join(changed)], 5)[0])
    assert max(int(x).bit_count() for x in other) > 6
    star = [word() for _ in range(300)]
    for i in range(400, 480):  # a group whose members are all close to the first and mostly below the limit to each other
        copy = list(star)
        for k in rng.integers(0, 300, 0 if i == 400 else 6):
            copy[k] = word()
        rows.append((i, " ".join(copy), "en", "s", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    kept = {r.doc_id: r.text for r in corpus_pipeline.near_dedup(spark, spark.read.parquet(str(tmp_path / "d")), SF).collect()}
    assert {i for i in kept if i < 400} == expected
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (kept[i].split() for i in kept if i >= 400)]
    small = neardup.keep_one(spark.read.parquet(str(tmp_path / "d")), block=7)
    assert {r.doc_id for r in small.collect()} == set(kept)
    assert 1 <= len(sets) < 80 and all(len(a & b) < 0.8 * len(a | b) for j, a in enumerate(sets) for b in sets[:j])


def test_near_dedup_goes_through_the_trie(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(0, 60, 2):
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(200)]
        rows += [(i, " ".join(words), "en", "s", 1), (i + 1, " ".join(words[:-1]), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    apart = {i: int(np.bitwise_count(np.bitwise_xor(*simhash.fingerprints([rows[i][1], rows[i + 1][1]], 5)))) for i in range(0, 60, 2)}
    assert sum(n <= 6 for n in apart.values()) > 20
    # without bands the trie alone finds the pairs within its bits
    monkeypatch.setattr(neardup, "band_keys", lambda lists, *_: (rng.integers(0, 2**63, (len(lists), neardup.BANDS)).astype(np.uint64), np.zeros((len(lists), neardup.BANDS * neardup.ROWS), np.uint8)))
    stars, links = neardup._trie_links(docs.sparkSession.createDataFrame([(i, [1], int(simhash.fingerprints([t], 5).view(np.int64)[0])) for i, t, *_ in rows], "row long, keys array<int>, fp long"), 6)
    assert {i for i, n in apart.items() if n <= 6} <= {r.a for r in stars.collect()} and links.count()
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert {i + 1 for i in apart} - kept >= {i + 1 for i, n in apart.items() if n <= 6} and {*apart} <= kept


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{table}'")
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    result = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, expected))
