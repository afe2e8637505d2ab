"""Embedding whitening against exact integers and numpy over all rows."""

from collections import Counter

import numpy as np
import pytest

from sessionloom.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def expected(rows):
    """By (id, component): deviation, whitened up to the sign, explained."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    if not kept:
        return [], None
    sizes = Counter(len(x) for _, x in kept)
    size = max(sizes, key=lambda d: (sizes[d], d))
    kept = [(i, x) for i, x in kept if len(x) == size]
    fit = np.array(sorted({tuple(x) for _, x in kept}), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((n * fit - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = [k for k in np.argsort(-values)[:4] if values[k] > 1e-12 * max(values.max(), 1e-300)]
    out = []
    for i, x in kept:
        off = n * np.array(x, object) - sums
        white = (off / n).astype(float) @ vectors[:, order] / np.sqrt(values[order])
        out += [(i, k + 1, n, int((off * off).sum()), w, values[o] / values.sum()) for k, (o, w) in enumerate(zip(order, white, strict=True))]
    return out, n


def hold(df, rows):
    want, _ = expected(rows)
    got = df.collect()
    key = lambda r: (str(r[0]), r[1], r[3], abs(round(r[4], 6)))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    signs = {}
    for g, w in zip(got, want, strict=True):
        assert abs(abs(g[4]) - abs(w[4])) < 1e-9 and abs(g[5] - w[5]) < 1e-9
        assert g[6] < 1e-9
        if abs(w[4]) > 1e-6:
            assert signs.setdefault(g[1], g[4] * w[4] > 0) == (g[4] * w[4] > 0)
    return got


def test_query_equals_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op12_embedding_whitening(spark, SF)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert len(hold(got, rows)) == 4 * len(rows)


KIND = "vec_id long, embedding array<float>, n string, x int"


def test_nulls_other_lengths_repeats_and_clashing_names(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(40)]
    bad = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0, 1.0]), (93, [float("nan")] * 5), (94, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (95, [1.0, 2.0])]
    rows = good + good[:7] + [(None, good[3][1]), (50, [-0.0] * 5), (51, [0.0] * 5)] + bad
    table = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], KIND)
    got = hold(whitening.whiten(table), rows)
    assert {r[2] for r in got} == {41} and {90, 91, 92, 93, 94, 95} & {r[0] for r in got} == set()


@pytest.mark.parametrize("rows, components", [
    ([], 0), ([(1, None)], 0), ([(1, [0.5, 0.25])], 0), ([(1, [0.5, 0.25])] * 3, 0),
    ([(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0])], 1), ([(1, [0.0]), (2, [3.0]), (3, [7.0])], 1),
])
def test_too_few_distinct_vectors(spark, rows, components):
    """No component for an eigenvalue of zero: a single distinct vector, or none, has no rows."""
    got = hold(whitening.whiten(spark.createDataFrame([(i, v, "", 1) for i, v in rows], KIND)), rows)
    assert len({r[1] for r in got}) == components


def test_means_are_not_rounded(spark):
    """A far common offset leaves the covariance as exact as without it."""
    rng = np.random.default_rng(5)
    base = rng.integers(-3, 4, size=(60, 4)).tolist()
    rows = [(i, [float(c + 2**40) for c in v]) for i, v in enumerate(base)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    a, b = ({(r.id, r.component): (r.deviation, abs(r.whitened), r.explained) for r in whitening.whiten(t).collect()} for t in (table, near))
    assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()}
    assert all(np.allclose(a[k][1:], b[k][1:], rtol=0, atol=1e-12) for k in a)  # the sums' order alone differs


def test_deviations_beyond_64_bits_raise():
    model = whitening.Whitening(10**6, np.array([0]), np.ones((1, 1)), np.ones(1), 1.0, 0.0)
    assert model.deviations(np.array([[3000]])).tolist() == [9 * 10**18]
    with pytest.raises(OverflowError):
        model.deviations(np.array([[4000]]))
