"""Toxic spans by a linear-chain conditional random field (operator 10).

Documents carry the labels and tokens don't, so a two-state chain over a document's words is trained in two phases:

* first on labelled tokens: a word of a toxic document is an offending token if it is far likelier in toxic documents
  than in others and occurs in several that don't copy each other;
* then by expectation maximisation: a token's tag is its marginal, given that a document with a toxic label has at least
  one offending token and one with a clean label none, but for a share `label_noise` of wrong labels. So a word that
  offends in some contexts only, or one that the first phase missed, gets the tag that its neighbours support.

Both phases follow the gradient of the likelihood for all parameters: the unary weights of a word's hashed byte n-grams
and of the word itself, the bias and the four transitions (observed against expected ones). Forward-backward marginals
mark spans; a logistic layer over a document's marginals (probability that any token offends, expected number, largest
marginal, expected share) gives its score.

Fitting uses about `per_class` labelled documents of each class, whole. Scores need text alone; a null or empty text has
no tokens and scores what the logistic layer gives for none. Equal texts score alike, whatever stands beside them. With
labels of one class only, or none, every score is that class's share.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .decontam import words_of

_TOKEN = re.compile(r"[^\x20\x09-\x0d!-/:-@\[-`{-~]+")


@dataclass
class SpanModel:
    weights: np.ndarray
    bias: float = -4.0
    #: Log potentials of the state pairs (clean, clean), (clean, toxic), (toxic, clean), (toxic, toxic); a chain starts after a clean state.
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    layer: np.ndarray = field(default_factory=lambda: np.zeros(5))
    sizes: tuple[int, ...] = (3, 4, 5)

    def word_scores(self, words: list[bytes]) -> tuple[np.ndarray]:
        """The unary log-odds of being offending of each word."""
        grams, counts = common.word_grams(words, self.sizes, len(self.weights))
        return (common.segment_sums(self.weights[grams][:, None], counts) / np.sqrt(counts)[:, None] + self.bias,)


def _pass(message: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log-odds that a neighbour's log-odds send on."""
    return np.logaddexp(moves[0, 1], message + moves[1, 1]) - np.logaddexp(moves[0, 0], message + moves[1, 0])


def _sweep(unary: np.ndarray, first: np.ndarray, moves: np.ndarray, start: float) -> np.ndarray:
    """Log-odds of all chains, end to end, each from its first token on; first marks those and start is what they get from before.

    All messages are passed at once until none changes: after k rounds whatever depends on k tokens is exact, and what
    is left to update are the few tokens whose message still moves.
    """
    out = unary + start
    active = np.flatnonzero(~first)
    while len(active):
        new = unary[active] + _pass(out[active - 1], moves)
        moved = new != out[active]
        changed = active[moved]
        out[changed] = new[moved]
        active = changed + 1
        active = active[active < len(out)]
        active = active[~first[active]]
    return out


@dataclass
class Chains:
    """Forward-backward over chains that stand end to end."""

    unary: np.ndarray
    counts: np.ndarray
    moves: np.ndarray

    def __post_init__(self) -> None:
        n, ends = len(self.unary), np.cumsum(self.counts)
        some = self.counts > 0
        self.first, last = np.zeros(n, bool), np.zeros(n, bool)
        self.first[(ends - self.counts)[some]] = True
        last[ends[some] - 1] = True
        self.start = self.moves[0, 1] - self.moves[0, 0]
        self.forward = _sweep(self.unary, self.first, self.moves, self.start)
        # both sweeps hold a token's own unary score; nothing comes after a chain's last token
        self.backward = _sweep(self.unary[::-1], last[::-1], self.moves.T, 0.0)[::-1]
        self.inner = np.flatnonzero(~last)
        #: Probability of the offending state of every token.
        self.p = _logistic(self.forward + self.backward - self.unary)

    def pairs(self) -> np.ndarray:
        """Probabilities (n, 2, 2) of the states of each inner token and its next."""
        f, g = self.forward[self.inner], self.backward[self.inner + 1]
        scores = self.moves[None] + np.array([0.0, 1.0])[None, :, None] * f[:, None, None] + np.array([0.0, 1.0])[None, None, :] * g[:, None, None]
        scores = np.exp(scores - scores.max(axis=(1, 2), keepdims=True))
        return scores / scores.sum(axis=(1, 2), keepdims=True)

    def log_clean(self) -> np.ndarray:
        """Log-probability of each chain that no token offends."""
        return -common.segment_sums(np.logaddexp(0, self.start + self.backward), self.counts)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def marginals(unary: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of the offending state for every token of chains that stand end to end."""
    return Chains(unary, counts, moves).p


def transitions(first: np.ndarray, pairs: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Expected uses (2, 2) of the transitions: pairs of neighbours, and starts (after a clean state) with offending probability first."""
    out = (pairs if weight is None else pairs * weight[:, None, None]).sum(axis=0)
    out[0] += [(1 - first).sum(), first.sum()]
    return out


def offending_given_label(chains: Chains, toxic: np.ndarray, label_noise: float) -> tuple[np.ndarray, np.ndarray]:
    """(token tags, transitions) expected given noisy labels: toxic means that at least one token offends."""
    clean = np.minimum(chains.log_clean(), -1e-12)
    some = -np.expm1(clean)
    right, wrong = np.where(toxic == 1, 1 - label_noise, label_noise), np.where(toxic == 1, label_noise, 1 - label_noise)
    scale = right / (right * some + wrong * np.exp(clean))  # P(some, label) / P(label) over P(some)
    scale[chains.counts == 0] = 0
    own = np.repeat(scale, chains.counts)
    pairs = chains.pairs() * own[chains.inner][:, None, None]
    pairs[:, 0, 0] = 1 - pairs[:, 0, 1] - pairs[:, 1, 0] - pairs[:, 1, 1]
    q = chains.p * own
    return q, transitions(q[chains.first], pairs)


def offending_words(lists: list[list[bytes]], toxic: np.ndarray, least: int = 3, odds: float = 8.0) -> set[bytes]:
    """Words far likelier in toxic documents, from documents that don't copy each other (one per smallest word hash)."""
    import xxhash

    seen: dict[bytes, list[set]] = defaultdict(lambda: [set(), set()])
    signatures: list[set] = [set(), set()]
    for words, label in zip(lists, toxic, strict=True):
        kinds = set(words)
        if not kinds:
            continue
        signature = min(xxhash.xxh64_intdigest(w, 3) for w in kinds)
        signatures[label].add(signature)
        for w in kinds:
            seen[w][label].add(signature)
    n0, n1 = len(signatures[0]) + 1, len(signatures[1]) + 1
    return {w for w, (clean, bad) in seen.items() if len(bad) >= least and (len(bad) / n1) / ((len(clean) + 0.5) / n0) >= odds}


def _summary(chains: Chains) -> np.ndarray:
    """Features of documents: 1, log-odds that any token offends, log(1 + expected number), largest marginal, expected share."""
    p, counts = chains.p, chains.counts
    total = common.segment_sums(p, counts)
    top = np.zeros(len(counts))
    some = counts > 0
    if some.any():
        top[some] = np.maximum.reduceat(p, (np.cumsum(counts) - counts)[some])
    clean = np.minimum(chains.log_clean(), -1e-12)
    odds = np.where(some, np.clip(np.log(-np.expm1(clean)) - clean, -8, 8), -8) / 4
    return np.column_stack([np.ones(len(counts)), odds, np.log1p(total), top, np.sqrt(total / np.maximum(counts, 1))])


def _grams_of(kinds: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """common.word_grams in small integers, some words at a time."""
    parts = [common.word_grams(kinds[a : a + 20_000], sizes, buckets) for a in range(0, len(kinds), 20_000)]
    return np.concatenate([g.astype(np.uint32) for g, _ in parts]), np.concatenate([c for _, c in parts])


def train(texts: list[str | None], toxic: list[int], buckets: int = 1 << 16, seed_epochs: int = 3, rounds: int = 3, label_noise: float = 0.05, batch_tokens: int = 150_000, rate: float = 0.4, seed: int = 1) -> SpanModel:
    """seed_epochs over the labelled tokens, then rounds of expectation maximisation, in steps of about batch_tokens words."""
    rng = np.random.default_rng(seed)
    model, y = SpanModel(np.zeros(buckets)), np.array(toxic, dtype=int)
    if len(set(toxic)) < 2:
        share = min(0.99, max(0.01, float(y.mean()) if len(y) else 0.01))
        model.layer[0] = np.log(share / (1 - share))
        return model
    lists = [words_of(t) for t in texts]
    bad = offending_words(lists, y)
    number: dict[bytes, int] = {}
    shown = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for words in lists]
    kinds = list(number)
    offends = np.fromiter((w in bad for w in kinds), bool, len(kinds))
    del lists
    grams, sizes = _grams_of(kinds, model.sizes, buckets)
    begins = np.cumsum(sizes) - sizes
    squares = {"weights": np.full(buckets, 1e-3), "bias": 1e-3, "moves": np.full((2, 2), 1e-3)}

    def unary_of(own: np.ndarray) -> np.ndarray:
        return common.segment_sums(model.weights[grams[common.concat_ranges(begins[own], sizes[own])]], sizes[own]) / np.sqrt(sizes[own]) + model.bias

    def step(rows: np.ndarray, seeds: bool) -> None:
        counts = np.array([len(shown[i]) for i in rows])
        own, at = np.unique(np.concatenate([shown[i] for i in rows]), return_inverse=True)
        chains = Chains(unary_of(own)[at], counts, model.moves)
        pairs = chains.pairs()
        if seeds:
            q = (offends[own][at] & np.repeat(y[rows] == 1, counts)).astype(float)
            a, b = q[chains.inner], q[chains.inner + 1]
            seen = transitions(q[chains.first], np.stack([np.stack([(1 - a) * (1 - b), (1 - a) * b], 1), np.stack([a * (1 - b), a * b], 1)], 1))
        else:
            q, seen = offending_given_label(chains, y[rows], label_noise)
        pull = np.bincount(at, q - chains.p, len(own))
        flat = common.concat_ranges(begins[own], sizes[own])
        g = {"weights": np.bincount(grams[flat], np.repeat(pull / np.sqrt(sizes[own]), sizes[own]), buckets), "bias": pull.sum(), "moves": seen - transitions(chains.p[chains.first], pairs)}
        for name, value in g.items():  # adaptive steps: each parameter by its own past gradients
            squares[name] = squares[name] + value**2
            setattr(model, name, getattr(model, name) + rate * value / np.sqrt(squares[name]))

    lengths = np.array([len(x) for x in shown])
    limit = max(1, min(batch_tokens, int(lengths.sum()) // 24))
    for epoch in range(seed_epochs + rounds):
        order = rng.permutation(np.flatnonzero(lengths))
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths[order]) // limit)) + 1
        for rows in np.split(order, cuts):
            if len(rows):
                step(rows, epoch < seed_epochs)
    unary = np.concatenate([unary_of(np.arange(a, min(a + 50_000, len(kinds)))) for a in range(0, len(kinds), 50_000)]) if kinds else np.zeros(0)
    x = np.concatenate([_summary(Chains(unary[np.concatenate(shown[a : a + 500])], lengths[a : a + 500], model.moves)) for a in range(0, len(shown), 500)])
    for _ in range(60):  # Newton steps with a small ridge
        p = _logistic(x @ model.layer)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        model.layer += np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * model.layer)
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> SpanModel:
    """A model of the documents whose ids meet `usable`; about per_class labelled ones of each class are used."""
    known = labels.where(usable & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    sizes = {row[0]: row[1] for row in known.groupBy("y").count().collect()}
    # sampled before the join, so that only the sample's texts move; each class at its own rate, which the layer's prior makes up for
    rates = {y: min(1.0, per_class / n) for y, n in sizes.items()}
    rate = F.lit(1.0)
    for y, r in rates.items():
        rate = F.when(F.col("y") == y, F.lit(r)).otherwise(rate)
    spread = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(spread < rate)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").toPandas().sort_values("id")
    model = train(rows["text"].tolist(), rows["y"].tolist(), **options)
    if rows["y"].nunique() > 1:
        model.layer[0] += np.log(rates[0] / rates[1])
    return model


def score(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text", span_limit: float = 0.5) -> DataFrame:
    """(id, score, predicted, spans): spans are (start, end, probability) of offending tokens, in characters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: SpanModel = shared.value
        table = common.WordTable(m.word_scores, (1, np.float64))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        for batch in batch_iter:
            texts = batch.column(1).to_pylist()
            for a, b in common.batches(texts):
                lists = [words_of(t) for t in texts[a:b]]
                counts = np.array([len(x) for x in lists])
                numbers = table.numbers([w for x in lists for w in x])
                chains = Chains(table.tables[0][numbers, 0], counts, m.moves)
                p, s = chains.p, _logistic((_summary(chains) * m.layer).sum(axis=1))
                spans: list[list[dict]] = [[] for _ in lists]
                ends = np.cumsum(counts)
                flagged = np.flatnonzero(p > span_limit)
                for i in np.unique(np.searchsorted(ends, flagged, side="right")):
                    found = list(_TOKEN.finditer(texts[a + i]))
                    for k in flagged[(flagged < ends[i]) & (flagged >= ends[i] - counts[i])] - (ends[i] - counts[i]):
                        spans[i].append({"start": found[k].start(), "end": found[k].end(), "probability": float(p[ends[i] - counts[i] + k])})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, kind)], names=["id", "score", "predicted", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int, spans array<struct<start: long, end: long, probability: double>>")
