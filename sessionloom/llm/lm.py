"""Language-model scoring with causal self-attention over subword ids (operator 2).

A text is the sequence of the subword ids of its lower-cased words, and one end. The model gives the probability of

* the next id (or the end) by a two-level softmax over a causal self-attention layer's hidden state: the first level
  has the end, the most frequent ids one by one, some classes of `middle` ids and some tail classes (bands of frequency);
  the ids of a middle class are told apart by a second softmax over the same state, ids of a tail class by their counts;
* whether the word ends after an id, by that id's counts.

At every place the probabilities of all that can follow sum to 1, so a word has the product over its subwords and ends,
and `score` is the log10 probability of the whole text. An input is an id's embedding; queries, keys and values are
linear maps of it, and a learned bias of the distance stands for positions. Windows of two blocks overlap by one: each
scores the tokens of its second block with the first as context, so every token is scored once; windows are batched and
masked in numpy.

What is gathered from the corpus: counts of words and of subwords over all training documents, in Spark. The pass that
counts stores the rows of every text, from which the layer is trained and texts are scored. The layer is
trained in every task on its part of all training documents; the tasks' parameters are averaged in a tree. Where they
begin are parameters from `start_docs` documents on the driver, so that the tasks' models are near enough to average.
`train_share` is for trials: 1, the default, takes all. Word counts never meet on the driver or in one table: a block is `block_docs` consecutive documents, a task emits
the distinct words of its blocks, a window over each word's hash sums them, and each block gets its own words back, in
one shuffle in which its words and its texts' scores by the layer sort before its texts. A word has at most a few rows for each block, so no word is hot.

Null and empty texts are one end. Equal texts have equal base scores; their scores agree to the rounding of 32-bit
matrix products. With no training document every count is 0. A word that the tokenizer drops is one id of its own.
Documents must be a stored table, whose rows keep their partition and order when it is read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of ids: the end, a word without ids, then the tokenizer's ids from FIRST on.
END, DROPPED, FIRST = 0, 1, 2
_END_HASH = np.array([xxhash.xxh64_intdigest(b"\n", 2)], np.uint64).view(np.int64)  # no word is a line end


@dataclass
class Layout:
    """What the counts of rows decide: outputs of both softmax levels, shares in tail classes, ends of words."""

    head_of: np.ndarray
    middle_of: np.ndarray
    class_of: np.ndarray
    edges: np.ndarray
    log_inside: np.ndarray
    log_last: np.ndarray
    log_more: np.ndarray
    embed_of: np.ndarray
    heads: int
    middles: int
    embeds: int

    @classmethod
    def of(cls, tokens: np.ndarray, last: np.ndarray, singles: int = 47, middle: int = 192, tails: int = 15, embeds: int = 4096, classes: int = 4) -> Layout:
        """tokens and last: for each row, how often it occurs in training text, and how often at the end of a word.

        Middle ids are numbered by middle_of; class c of them holds the numbers edges[c] to edges[c + 1], and class_of gives a number's class.
        """
        size = len(tokens)
        order = 1 + np.argsort(-tokens[1:], kind="stable")
        head_of, middle_of, log_inside = np.zeros(size, np.int64), np.full(size, -1), np.zeros(size)
        single, mid, rest = order[:singles], order[singles : singles + middle], order[singles + middle :]
        head_of[single] = 1 + np.arange(len(single))
        heads = 1 + len(single)
        classes = min(classes, len(mid))
        edges = np.arange(classes + 1) * len(mid) // max(1, classes)
        class_of = np.repeat(np.arange(classes), np.diff(edges)).astype(np.uint8)
        if len(mid):
            head_of[mid], middle_of[mid] = heads + class_of, np.arange(len(mid))
            heads += classes
        if len(rest):
            smooth = tokens[rest] + 0.5
            band = np.minimum((np.cumsum(smooth) - smooth) / smooth.sum() * tails, tails - 1).astype(np.int64)
            _, band = np.unique(band, return_inverse=True)
            log_inside[rest] = np.log(smooth / np.bincount(band, smooth)[band])
            head_of[rest] = heads + band
            heads += int(band.max()) + 1
        share = (last + 0.5) / (tokens + 1)
        embed_of = np.ones(size, np.int64)
        embed_of[END] = 0
        own = order[: embeds - 2]
        embed_of[own] = 2 + np.arange(len(own))
        return cls(head_of, middle_of, class_of, edges, log_inside, np.log(share), np.log1p(-share), embed_of, heads, len(mid), len(own) + 2)

    def by_class(self, numbers: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
        """(the places of middle numbers (-1: none), those of a class together; for each class that occurs, which of these places and which numbers are its own)."""
        at = np.flatnonzero(numbers >= 0)
        kinds = self.class_of[numbers[at]]
        ends = np.cumsum(np.bincount(kinds, minlength=len(self.edges) - 1)).tolist()
        parts = zip([0, *ends], ends, self.edges.tolist(), self.edges[1:].tolist())  # noqa: B905
        return at[np.argsort(kinds, kind="stable")], [(slice(a, b), slice(lo, hi)) for a, b, lo, hi in parts if b > a]


@dataclass
class AttentionModel:
    """One causal self-attention layer; windows hold two blocks of `block` inputs."""

    layout: Layout
    block: int
    embed: np.ndarray
    wq: np.ndarray
    wk: np.ndarray
    wv: np.ndarray
    we: np.ndarray
    distance: np.ndarray
    head: np.ndarray
    head_bias: np.ndarray
    middle: np.ndarray
    middle_bias: np.ndarray

    PARTS = ("embed", "wq", "wk", "wv", "we", "distance", "head", "head_bias", "middle", "middle_bias")

    @classmethod
    def new(cls, layout: Layout, block: int = 16, dims: int = 16, keys: int = 7, hidden: int = 16, seed: int = 1) -> AttentionModel:
        rng = np.random.default_rng(seed)

        def init(*shape):
            return rng.normal(0, 0.1, shape).astype(np.float32)

        return cls(layout, block, init(layout.embeds, dims), init(dims, keys), init(dims, keys), init(dims, hidden), init(dims, hidden), np.zeros(2 * block, np.float32),
                   init(hidden, layout.heads), np.zeros(layout.heads, np.float32), init(hidden, max(1, layout.middles)), np.zeros(max(1, layout.middles), np.float32))

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, p).reshape(-1) for p in self.PARTS])

    def with_vector(self, flat: np.ndarray) -> AttentionModel:
        parts, at = {}, 0
        for p in self.PARTS:
            shape = getattr(self, p).shape
            n = int(np.prod(shape))
            parts[p] = flat[at : at + n].reshape(shape).astype(np.float32)
            at += n
        return AttentionModel(self.layout, self.block, **parts)

    def distances(self) -> np.ndarray:
        """(query, key) of a window: how far back the key is; negative for keys that come later."""
        return np.arange(self.block, 2 * self.block)[:, None] - np.arange(2 * self.block)[None, :]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def hidden_states(m: AttentionModel, inputs: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Hidden states after each input of the second block of windows (n, 2 * block) of embedding numbers, and what the gradient needs."""
    x = m.embed[inputs]
    last = x[:, m.block :]
    q, k, v = last @ m.wq / np.sqrt(m.wq.shape[1]).astype(m.wq.dtype), x @ m.wk, x @ m.wv
    back = m.distances()
    mask = (back >= 0)[None] & (usable[:, None, :] | (back == 0)[None])
    scores = np.where(mask, q @ k.transpose(0, 2, 1) + m.distance[np.maximum(back, 0)], -np.inf)
    weight = _softmax(scores)
    return last @ m.we + weight @ v, (x, q, k, v, weight)


def log_probabilities(m: AttentionModel, hidden: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """log P(row | hidden): hidden (..., h), rows of the same leading shape. Without the ends of words."""
    lay = m.layout
    logits = hidden @ m.head + m.head_bias
    logits = logits - logits.max(axis=-1, keepdims=True)
    out = np.take_along_axis(logits, lay.head_of[rows][..., None], -1)[..., 0] - np.log(np.exp(logits).sum(axis=-1))
    out, second = np.asarray(out), lay.middle_of[rows]
    for lo, hi in zip(lay.edges[:-1], lay.edges[1:], strict=True):
        mid = (second >= lo) & (second < hi)
        if mid.any():
            logits = hidden[mid] @ m.middle[:, lo:hi] + m.middle_bias[lo:hi]
            logits = logits - logits.max(axis=-1, keepdims=True)
            out[mid] += logits[np.arange(len(logits)), second[mid] - lo] - np.log(np.exp(logits).sum(axis=-1))
    return out + lay.log_inside[rows]


def gradients(m: AttentionModel, inputs: np.ndarray, usable: np.ndarray, rows: np.ndarray, scored: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean of -log P over the scored places."""
    hidden, (x, q, k, v, weight) = hidden_states(m, inputs, usable)
    n = np.float32(max(1, scored.sum()))
    g = _softmax(hidden @ m.head + m.head_bias)
    np.put_along_axis(g, m.layout.head_of[rows][..., None], np.take_along_axis(g, m.layout.head_of[rows][..., None], -1) - 1, -1)
    g *= scored[..., None] / n
    flat = lambda a: a.reshape(-1, a.shape[-1])
    out = {"head": flat(hidden).T @ flat(g), "head_bias": flat(g).sum(axis=0), "middle": np.zeros_like(m.middle), "middle_bias": np.zeros_like(m.middle_bias)}
    gh = g @ m.head.T
    second = m.layout.middle_of[rows]
    for lo, hi in zip(m.layout.edges[:-1], m.layout.edges[1:], strict=True):
        mid = (second >= lo) & (second < hi) & scored
        if mid.any():
            g = _softmax(hidden[mid] @ m.middle[:, lo:hi] + m.middle_bias[lo:hi])
            g[np.arange(len(g)), second[mid] - lo] -= 1
            g /= n
            out["middle"][:, lo:hi], out["middle_bias"][lo:hi] = hidden[mid].T @ g, g.sum(axis=0)
            gh[mid] += g @ m.middle[:, lo:hi].T
    last = x[:, m.block :]
    out["we"] = flat(last).T @ flat(gh)
    gv, gw = weight.transpose(0, 2, 1) @ gh, gh @ v.transpose(0, 2, 1)
    gs = weight * (gw - (gw * weight).sum(axis=2, keepdims=True))
    back = m.distances()
    out["distance"] = np.bincount(back[back >= 0], gs.sum(axis=0)[back >= 0], 2 * m.block)
    scale = np.sqrt(m.wq.shape[1]).astype(m.wq.dtype)
    gq, gk = gs @ k / scale, gs.transpose(0, 2, 1) @ q
    out |= {"wq": flat(last).T @ flat(gq), "wk": flat(x).T @ flat(gk), "wv": flat(x).T @ flat(gv)}
    gx = gk @ m.wk.T + gv @ m.wv.T
    gx[:, m.block :] += gh @ m.we.T + gq @ m.wq.T
    out["embed"] = np.zeros_like(m.embed)
    np.add.at(out["embed"], inputs, gx)
    return out


def stream_gradients(m: AttentionModel, inputs: np.ndarray, rows: np.ndarray, scored: np.ndarray, shift: bool = False) -> dict[str, np.ndarray]:
    """gradients() of the windows of neighbouring blocks of a stream: its inputs (-1: none), and for each place the row to score, if any.

    Keys and values of a block are computed once for both windows that it stands in, softmaxes for scored places alone.
    Exponents are shifted by their maximum only when sums without that leave the range of 32-bit numbers.
    """
    s, lay, kind = m.block, m.layout, m.embed.dtype
    n = len(inputs) // s - 1
    empty = inputs < 0
    numbers = lay.embed_of[np.maximum(inputs, 0)]
    x = m.embed[numbers]
    x[empty] = 0
    d, h = m.wk.shape[1], m.wv.shape[1]
    scale = np.sqrt(d).astype(kind)
    # all maps of an input by one product; keys have one more place, which keeps out empty inputs, and values a 1, which adds up weights
    value, query, rest = d + 1, d + h + 2, 2 * d + h + 3
    maps = np.zeros((x.shape[1], rest + h + 1), kind)
    maps[:, :d], maps[:, value : value + h], maps[:, query : query + d], maps[:, rest : rest + h] = m.wk, m.wv, m.wq / scale, m.we
    p = x @ maps
    p[:, d], p[:, value + h], p[:, query + d] = np.where(empty, kind.type(-1e30), kind.type(0)), 1, 1

    def view(first: int, width: int, skip: int, length: int) -> np.ndarray:
        return np.lib.stride_tricks.as_strided(p[skip:, first:], (n, length, width), (s * p.strides[0], *p.strides))

    q, k, v = view(query, d + 1, s, s), view(0, d + 1, 0, 2 * s), view(value, h + 1, 0, 2 * s)
    back = m.distances()
    near = back >= 0
    at = np.flatnonzero(scored[s:])
    sums = []

    def exponents(logits: np.ndarray) -> None:
        if shift:
            logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)

    with np.errstate(over="ignore", invalid="ignore"):
        weight = q @ k.transpose(0, 2, 1)
        weight += np.where(near, m.distance[np.maximum(back, 0)], kind.type(-1e30))
        exponents(weight)
        attended = (weight @ v).reshape(n * s, h + 1)
        sums.append(attended[at, h])
        share = 1 / np.maximum(attended[:, h:], kind.type(1e-30))
        attended *= share
        hidden = attended + p[s:, rest:]
        own, state = rows[s:][at], hidden[at]
        total = kind.type(max(1, len(at)))

        def error(state: np.ndarray, weights: np.ndarray, bias: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Gradients of weights, bias and states (which end with a 1)."""
            logits = state @ np.concatenate([weights, bias[None]])
            exponents(logits)
            sums.append(logits @ np.ones(logits.shape[1], kind))
            logits *= (1 / (total * sums[-1]))[:, None]
            logits.reshape(-1)[np.arange(0, logits.size, logits.shape[1]) + target] -= 1 / total
            g = state.T @ logits
            return g[:-1], g[-1], logits @ weights.T

        out = {"middle": np.zeros_like(m.middle), "middle_bias": np.zeros_like(m.middle_bias)}
        out["head"], out["head_bias"], g = error(state, m.head, m.head_bias, lay.head_of[own])
        second = lay.middle_of[own]
        mid, classes = lay.by_class(second)
        state, second, more = state[mid], second[mid], np.empty((len(mid), h), kind)
        for some, ids in classes:
            out["middle"][:, ids], out["middle_bias"][ids], more[some] = error(state[some], m.middle[:, ids], m.middle_bias[ids], second[some] - ids.start)
        if not shift and any(len(x) and not (x.min() > 1e-25 and x.max() < 1e25) for x in sums):
            return stream_gradients(m, inputs, rows, scored, shift=True)
    g[mid] += more
    # of attention's sums before they are divided by those of weights; the last column stands for the division
    gh = np.zeros((n * s, h + 1), kind)
    gh[at, :h] = g
    gm = gh * share
    gm[:, h] = -np.einsum("ij,ij->i", gm[:, :h], attended[:, :h])
    gm = gm.reshape(n, s, h + 1)
    gs = gm @ v.transpose(0, 2, 1)
    gs *= weight
    out["distance"] = np.bincount(back[near], (np.ones(n, kind) @ gs.reshape(n, -1)).reshape(s, -1)[near], 2 * s)
    gp = np.zeros(p.shape, kind)
    by_block = gp.reshape(n + 1, s, -1)
    for to, found in ((slice(0, value), gs.transpose(0, 2, 1) @ q), (slice(value, query), weight.transpose(0, 2, 1) @ gm)):
        by_block[1:, :, to] = found[:, s:]
        by_block[:-1, :, to] += found[:, :s]
    by_block[1:, :, query:rest] = gs @ k
    gp[s:, rest:] = gh
    gp[empty] = 0
    g = x.T @ gp
    out |= {"wk": g[:, :d], "wv": g[:, value : value + h], "wq": g[:, query : query + d] / scale, "we": g[:, rest : rest + h]}
    out["embed"], dims = np.zeros_like(m.embed), x.shape[1]
    np.add.at(out["embed"].reshape(-1), (numbers[:, None] * dims + np.arange(dims)).reshape(-1), (gp @ maps.T).reshape(-1))
    return out


class Adam:
    """Steps on a model's parts, in place: from now on they are views of one vector, .flat."""

    def __init__(self, m: AttentionModel) -> None:
        self.steps, self.flat, at = 0, m.vector(), 0
        for p in m.PARTS:
            part = getattr(m, p)
            setattr(m, p, self.flat[at : at + part.size].reshape(part.shape))
            at += part.size
        self._parts = m.PARTS
        self._mean, self._square = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        g = np.concatenate([g[p].reshape(-1) for p in self._parts]).astype(self.flat.dtype, copy=False)
        mean, square = self._mean, self._square
        mean += 0.1 * (g - mean)
        g *= g
        g -= square
        g *= 0.01
        square += g
        np.multiply(square, 1 / (1 - 0.99**self.steps), out=g)
        np.sqrt(g, out=g)
        g += 1e-8
        np.divide(mean, g, out=g)
        g *= rate / (1 - 0.9**self.steps)
        self.flat -= g


def stream(rows: np.ndarray, counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, places) of texts whose rows stand end to end: every text begins at a block, after an empty one.

    inputs: the row before each place's (the end before a text's first), -1 for empty places. places: where each row stands.
    """
    blocks = 1 + -(-counts // block)
    starts = (np.cumsum(blocks) - blocks + 1) * block
    places = common.concat_ranges(starts, counts)
    inputs = np.full(int(blocks.sum()) * block, -1, np.int64)
    before = np.roll(rows, 1)
    before[(np.cumsum(counts) - counts)[counts > 0]] = END
    inputs[places] = before
    return inputs, places


def windows_of(m: AttentionModel, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, usable, rows, scored) of all windows, as gradients() takes them."""
    inputs, places = stream(rows, counts, m.block)
    target, scored = np.zeros(len(inputs), np.int64), np.zeros(len(inputs), bool)
    target[places], scored[places] = rows, True
    if not len(inputs):
        inputs, target, scored = np.full(2 * m.block, -1), np.zeros(2 * m.block, np.int64), np.zeros(2 * m.block, bool)
    two = np.lib.stride_tricks.sliding_window_view(inputs, 2 * m.block)[:: m.block]
    own = lambda a: a[m.block :].reshape(-1, m.block)
    keep = own(scored).any(axis=1)
    two = two[keep]
    return m.layout.embed_of[np.maximum(two, 0)], two >= 0, own(target)[keep], own(scored)[keep]


class FastScorer:
    """log_probabilities() of all rows of texts, from tables of keys, values and queries, without copies of windows."""

    def __init__(self, m: AttentionModel) -> None:
        self.m, d = m, m.wk.shape[1]
        e, h = m.layout.embeds, m.wv.shape[1]
        # keys have one more place, which keeps empty places (the last row) out of every sum, and values a 1, which adds up weights
        self._d, self._h = d + 1, h + 1
        self._at = np.cumsum([0, d + 1, h + 1, d + 1])  # where keys, values, queries and what inputs add themselves begin
        key, value, query, rest = self._at
        table = np.zeros((e + 1, rest + h + 1), np.float32)
        table[:e, key : key + d], table[e, key + d] = m.embed @ m.wk, -1e30
        table[:e, value : value + h], table[:, value + h] = m.embed @ m.wv, 1
        table[:e, query : query + d], table[:, query + d] = m.embed @ m.wq / np.sqrt(d).astype(np.float32), 1
        table[:e, rest : rest + h] = m.embed @ m.we
        self._table = table
        # states end with a 1, for the biases
        self._head, self._middle = np.vstack([m.head, m.head_bias]), np.vstack([m.middle, m.middle_bias])
        back = m.distances()
        self._near = np.where(back >= 0, np.exp(m.distance[np.maximum(back, 0)]), 0).astype(np.float32)
        norm = lambda a: float(np.sqrt((a**2).sum(axis=-1)).max())
        # largest possible exponents; beyond 60 (of 88) sums are shifted by their maximum first
        state = norm(m.embed @ m.we) + norm(m.embed @ m.wv)
        self._shift = max(norm(m.embed @ m.wq / np.sqrt(d)) * norm(m.embed @ m.wk), state * norm(m.head.T) + np.abs(m.head_bias).max(), state * norm(m.middle.T) + np.abs(m.middle_bias).max()) > 60

    def _log_softmax_at(self, logits: np.ndarray, target: np.ndarray) -> np.ndarray:
        if self._shift:
            logits -= logits.max(axis=1, keepdims=True)
        own = logits.reshape(-1)[np.arange(0, logits.size, logits.shape[1]) + target]
        np.exp(logits, out=logits)
        return own - np.log(logits @ np.ones(logits.shape[1], logits.dtype))

    def __call__(self, rows: np.ndarray, counts: np.ndarray, batch: int = 512) -> np.ndarray:
        m, lay, s, d, h = self.m, self.m.layout, self.m.block, self._d, self._h
        key, value, query, rest = self._at
        inputs, places = stream(rows, counts, s)
        numbers = np.where(inputs < 0, lay.embeds, lay.embed_of[inputs]).astype(np.int32)
        head, middle = np.zeros(len(inputs), np.int64), np.full(len(inputs), -1)
        head[places], middle[places] = lay.head_of[rows], lay.middle_of[rows]
        out = np.zeros(len(inputs), np.float32)
        for a in range(0, len(inputs) - s, batch * s):
            n = min(batch, (len(inputs) - a) // s - 1)
            g = self._table[numbers[a : a + (n + 1) * s]]
            step = g.strides[0]

            def view(first: int, width: int, skip: int, length: int, g=g, n=n, step=step) -> np.ndarray:
                return np.lib.stride_tricks.as_strided(g[skip:, first:], (n, length, width), (s * step, step, g.itemsize))

            weight = view(query, d, s, s) @ view(key, d, 0, 2 * s).transpose(0, 2, 1)
            if self._shift:
                weight = np.where(self._near > 0, weight, np.float32(-np.inf))
                weight -= weight.max(axis=2, keepdims=True)
            np.exp(weight, out=weight)
            weight *= self._near
            mixed = (weight @ view(value, h, 0, 2 * s)).reshape(n * s, h)
            mixed /= np.maximum(mixed[:, -1:], np.float32(1e-30))
            mixed += g[s:, rest:]
            own = slice(a + s, a + (n + 1) * s)
            out[own] = self._log_softmax_at(mixed @ self._head, head[own])
            second = middle[own]
            mid, classes = lay.by_class(second)
            state, second = mixed[mid], second[mid]
            for some, ids in classes:
                out[a + s + mid[some]] += self._log_softmax_at(state[some] @ self._middle[:, ids], second[some] - ids.start)
        return out[places].astype(np.float64) + lay.log_inside[rows]


class Words:
    """Words of texts as numbers of distinct ones, and the subword rows of words."""

    def __init__(self, tokenizer_path: str) -> None:
        self._encoder = common.piece_encoder(tokenizer_path, False)

    @property
    def rows(self) -> int:
        """How many rows there are."""
        return self._encoder.vocabulary_size + FIRST

    @property
    def kind(self) -> type:
        """The number type of stored rows."""
        return np.uint16 if self.rows <= 1 << 16 else np.uint32

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct words, their numbers in the texts end to end, how many words each text has)."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        cased = pc.list_flatten(lists).dictionary_encode()
        coded = pc.ascii_lower(cased.dictionary).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)[cased.indices.to_numpy()]
        blank = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
        if blank >= 0:  # white space at either end of a text
            real = codes != blank
            counts, codes = common.segment_sums(real.astype(np.int64), counts), codes[real]
        return coded.dictionary, codes, counts

    def subwords(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows of distinct words end to end, how many each has: at least one)."""
        ids, counts = self._encoder.encode_pieces(words)
        rows = ids.astype(np.int64) + FIRST
        empty = np.flatnonzero(counts == 0)
        return np.insert(rows, np.cumsum(counts)[empty], DROPPED), np.maximum(counts, 1)

    def joined(self, rows: np.ndarray, sizes: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of texts end to end, each with its end; which are the last of a word; how many each has) of what subwords() and split() give."""
        final = np.zeros(len(rows), bool)
        final[np.cumsum(sizes) - 1] = True
        own = sizes[codes]
        places, n = common.concat_ranges((np.cumsum(sizes) - sizes)[codes], own), common.segment_sums(own, counts)
        flat, ends = common.with_ends(rows[places], n, END)
        last = np.ones(len(flat), bool)
        inner = last.copy()
        inner[ends - 1] = False
        last[inner] = final[places]
        return flat, last, n + 1

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows of texts end to end, each with its end; how many each has)."""
        words, codes, counts = self.split(texts)
        rows, _, n = self.joined(*self.subwords(words), codes, counts)
        return rows.astype(np.int64), n


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of bytes that stand end to end in data."""
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all values end to end, how many each has)."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, np.diff(ends)


def _padding(counts: np.ndarray) -> np.ndarray:
    """For flags of texts, eight to a byte, where each text begins a byte: which of all bits are flags."""
    used = np.ones(int((-(-counts // 8)).sum()) * 8, bool)
    used[common.concat_ranges((np.cumsum(-(-counts // 8)) - -(-counts // 8)) * 8 + counts, -counts % 8)] = False
    return used


def stored_rows(rows: np.ndarray, last: np.ndarray, counts: np.ndarray, kind: type) -> tuple[pa.Array, pa.Array]:
    """What Words.joined() gives as two columns: rows as numbers of that kind, ends of words as bits."""
    used = _padding(counts)
    bits = np.zeros(len(used), bool)
    bits[used] = last
    return _binary(rows.astype(kind), counts * np.dtype(kind).itemsize), _binary(np.packbits(bits), -(-counts // 8))


def rows_of(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(rows of texts end to end, how many each has) of stored_rows()."""
    data, sizes = _bytes(column)
    return np.ascontiguousarray(data).view(kind).astype(np.int64), sizes // np.dtype(kind).itemsize


def lasts_of(column: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Which rows are the last of a word, of stored_rows()."""
    return np.unpackbits(_bytes(column)[0]).astype(bool)[_padding(counts)]


def hashes_of(words: pa.Array) -> np.ndarray:
    found = words.to_numpy(zero_copy_only=False)
    return np.fromiter((xxhash.xxh64_intdigest(w, 2) for w in found), np.uint64, len(found)).view(np.int64)


def start_model(layout: Layout, rows: np.ndarray, counts: np.ndarray, steps: int = 300, batch: int = 96, rate: float = 0.01, seed: int = 1, **options) -> AttentionModel:
    """A model trained on some texts, from which all tasks go on."""
    m = AttentionModel.new(layout, seed=seed, **options)
    rng, adam = np.random.default_rng(seed), Adam(m)
    inputs, usable, target, scored = windows_of(m, rows, counts)
    for step in range(steps if len(inputs) else 0):
        some = rng.integers(0, len(inputs), batch)
        adam.step(gradients(m, inputs[some], usable[some], target[some], scored[some]), rate * (1 - 0.9 * step / steps))
    return m


def _train_everywhere(texts: DataFrame, start: AttentionModel, kind: type, tasks: int, batch: int = 256, rate: float = 0.002) -> AttentionModel:
    """The start trained on by each task over all of its texts, in at most `tasks` tasks, whose `ids` are stored_rows() of that kind; the average of the tasks' mean parameters, by the steps of each."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(start)

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = start_copy(shared.value)
        adam, total = Adam(m), np.zeros(len(m.vector()))
        for stored in batch_iter:
            column = stored.column(0)
            for a, b in common.text_slices(column, 2_400_000):
                rows, counts = rows_of(column.slice(a, b - a), kind)
                inputs, places = stream(rows, counts, m.block)
                target, scored = np.zeros(len(inputs), np.int64), np.zeros(len(inputs), bool)
                target[places], scored[places] = rows, True
                # batches of `batch` windows; the last block of one is the context of the next
                for k in range(0, len(inputs) - m.block, batch * m.block):
                    s = slice(k, k + (batch + 1) * m.block)
                    adam.step(stream_gradients(m, inputs[s], target[s], scored[s]), rate)
                    total += adam.flat
        if adam.steps:
            yield _sum_row(adam.steps, total)

    def add(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, total = 0, 0.0
        for sums in batch_iter:
            for n, part in zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), strict=True):
                steps, total = steps + n, total + np.frombuffer(part, np.float64)
        if steps:
            yield _sum_row(steps, total)

    schema = "steps long, total binary"
    # not texts.rdd for the number of tasks: that would shuffle the ids once more
    sums, left = common.materialise(texts.select("ids").mapInArrow(run, schema), "lm-models"), tasks
    while left > 16:
        left = -(-left // 16)
        sums = sums.repartition(left).mapInArrow(add, schema)
    found = sums.collect()  # at most 16 rows of one model each
    steps = sum(r["steps"] for r in found)
    return start.with_vector(sum(np.frombuffer(r["total"], np.float64) for r in found) / steps) if steps else start


def _sum_row(steps: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([steps], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["steps", "total"])


def start_copy(m: AttentionModel) -> AttentionModel:
    return m.with_vector(m.vector())


_ENCODED = "block long, kind int, h long, n long, ids binary, lasts binary"


def _encode(keyed: DataFrame, tokenizer_path: str, held: int = 2_000_000) -> DataFrame:
    """Of each block: kind 0: word hash h, its training tokens n; kinds 1 and 2: subword row h, its training tokens n, those at the end of a word;
    kind 3: a text's row h, 1 if it is for training, its stored_rows().

    All but the start's sample are encoded here alone. A block's sums are emitted, and begun anew, when they hold more than `held` words.
    """

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(tokenizer_path)
        block, parts, tokens, last, size = -1, [], np.zeros(words.rows, np.int64), np.zeros(words.rows, np.int64), 0

        def emit() -> Iterator[pa.RecordBatch]:
            if parts:
                hashes, at = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
                yield _encoded(block, 0, hashes, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64))
                for kind, values in ((1, tokens), (2, last)):
                    some = np.flatnonzero(values)
                    yield _encoded(block, kind, some, values[some])

        for batch in batch_iter:
            blocks = batch.column(0).to_numpy()
            for lo, hi in _runs(blocks):
                texts = batch.column(3).slice(lo, hi - lo)
                for a, b in common.text_slices(texts, 4_000_000):
                    if blocks[lo] != block or size > held:
                        yield from emit()
                        block, size = blocks[lo], 0
                        parts.clear(), tokens.fill(0), last.fill(0)
                    numbers = batch.column(1).slice(lo + a, b - a).to_numpy()
                    training = batch.column(2).slice(lo + a, b - a).to_numpy(zero_copy_only=False)
                    kinds, codes, counts = words.split(texts.slice(a, b - a))
                    n = np.bincount(codes[np.repeat(training, counts)], minlength=len(kinds))
                    rows, sizes = words.subwords(kinds)
                    tokens += np.bincount(rows, np.repeat(n, sizes), words.rows).astype(np.int64)
                    last += np.bincount(rows[np.cumsum(sizes) - 1], n, words.rows).astype(np.int64)
                    tokens[END] += training.sum()
                    parts.append((np.append(hashes_of(kinds), _END_HASH), np.append(n, training.sum())))
                    size += len(kinds)
                    yield _encoded(block, 3, numbers, training.astype(np.int64), *stored_rows(*words.joined(rows, sizes, codes, counts), words.kind))
        yield from emit()

    return keyed.select("block", "row", "training", "text").mapInArrow(run, _ENCODED)


def _encoded(block: int, kind: int, h: np.ndarray, n: np.ndarray, *stored: pa.Array) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(h), block, np.int64)), pa.array(np.full(len(h), kind, np.int32)), pa.array(h, pa.int64()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays([*arrays, *(stored or [pa.nulls(len(h), pa.binary())] * 2)], names=["block", "kind", "h", "n", "ids", "lasts"])


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    edges = np.flatnonzero(values[1:] != values[:-1]) + 1
    return zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True) if len(values) else iter(())


def fit_and_score(docs: DataFrame, training: Column, tokenizer_path: str, train_share: float = 1, start_docs: int = 1000, block_docs: int = 4000, start_steps: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every document, learning from those that meet `training`.

    Counts are of all training documents, and all of them train the layer in the tasks, unless train_share says a share.
    start_docs bounds the documents of its start on the driver alone. Scores are log10 probabilities.
    """
    spark = docs.sparkSession
    common.pin_splits(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    row = F.monotonically_increasing_id()
    block = F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / block_docs)
    keyed = docs.select(block.alias("block"), row.alias("row"), F.col(id_col).alias("id"), F.coalesce(training, F.lit(False)).alias("training"), F.col(text_col).alias("text"))
    encoded = common.materialise(_encode(keyed, tokenizer_path), "lm-encoded", compression="zstd")
    counted, stored = encoded.select("block", "kind", "h", "n"), encoded.where("kind = 3").select("block", F.col("h").alias("row"), "ids", "lasts")

    # one row for each subword of the tokenizer
    subwords = counted.where("kind in (1, 2)").groupBy("kind", "h").agg(F.sum("n").alias("n")).toPandas()
    words = Words(tokenizer_path)
    tokens, last = np.zeros(words.rows), np.zeros(words.rows)
    for kind, values in ((1, tokens), (2, last)):
        some = subwords[subwords["kind"] == kind]
        values[some["h"].to_numpy()] = some["n"].to_numpy()
    layout = Layout.of(tokens, last)

    learn = keyed.where("training").select("row", "text")
    sample = common.bounded_sample(learn, start_docs, "row", salt=9).sort_values("row")
    start = start_model(layout, *words.texts(pa.array(sample["text"].tolist(), pa.large_string())), steps=start_steps)
    chosen = learn.where(F.pmod(F.xxhash64("row", F.lit(4)), F.lit(1 << 30)) < train_share * (1 << 30))
    # dealt out by row numbers, so that no task has neighbours alone; texts themselves aren't read again
    tasks = keyed.rdd.getNumPartitions()
    chosen = stored.select("row", "ids").repartition(tasks, "row").join(chosen.repartition(tasks, "row").hint("shuffle_hash"), "row").coalesce(tasks)
    model = spark.sparkContext.broadcast(_train_everywhere(chosen, start, words.kind, tasks))

    each = Window.partitionBy("h").orderBy("block")
    totals = counted.where("kind = 0").select("block", "h", F.sum("n").over(each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"), (F.row_number().over(each) == 1).alias("first"))
    totals = common.materialise(totals, "lm-words")
    size = totals.agg(F.sum(F.when(F.col("first"), F.col("n"))).alias("tokens"), F.count_if(F.col("first") & (F.col("n") > 0)).alias("kinds")).first()
    train_tokens, distinct = int(size["tokens"] or 0), int(size["kinds"] or 0)

    none = {"id": F.lit(None).cast(id_type), "text": F.lit(None).cast("string"), "n": F.lit(0).cast("long"), "score": F.lit(0.0)}
    counts = totals.select("block", F.lit(0).alias("kind"), "h", "n").withColumns({k: none[k] for k in ("id", "text", "score")})
    scores = _scores(stored, model, words.kind).select("block", F.lit(1).alias("kind"), F.col("row").alias("h"), "score").withColumns({k: none[k] for k in ("id", "text", "n")})
    texts = keyed.select("block", F.lit(2).alias("kind"), F.col("row").alias("h"), "id", "text").withColumns({k: none[k] for k in ("n", "score")})
    # about as many partitions as blocks, so that no task gets more than a few
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keyed.rdd.getNumPartitions() + 2 * docs.count() // block_docs)
    together = counts.unionByName(scores).unionByName(texts).select("block", "kind", "id", "text", "h", "n", "score").repartition(parts, "block").sortWithinPartitions("block", "kind")

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, scored = Words(tokenizer_path), None
        for batch in batch_iter:
            block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in _runs(block * 3 + kind):
                if scored is None or scored.block != block[a]:
                    scored = _BlockScorer(int(block[a]), words, train_tokens, distinct)
                if kind[a] == 0:
                    scored.add(*(batch.column(k).slice(a, b - a).to_numpy() for k in (4, 5)))
                    continue
                if kind[a] == 1:
                    scored.scores.append(tuple(batch.column(k).slice(a, b - a).to_numpy() for k in (4, 6)))
                    continue
                rows = batch.column(3).slice(a, b - a)
                for i, j in common.text_slices(rows):
                    n, known, base, score = scored.score(rows.slice(i, j - i), batch.column(4).slice(a + i, j - i).to_numpy())
                    yield pa.RecordBatch.from_arrays([batch.column(2).slice(a + i, j - i), pa.array(n), pa.array(known), pa.array(np.full(j - i, train_tokens, np.int64)), pa.array(base), pa.array(score)], names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return together.mapInArrow(run, f"id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _scores(stored: DataFrame, model: Broadcast, kind: type) -> DataFrame:
    """(block, row, score) of stored_rows() of that kind."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = FastScorer(model.value)
        lay, size = model.value.layout, len(model.value.layout.log_last)
        ends = np.append(lay.log_more, lay.log_last)
        ends[size + END] = 0
        for batch in batch_iter:
            for a, b in common.text_slices(batch.column(2), 1_200_000):
                part = batch.slice(a, b - a)
                rows, counts = rows_of(part.column(2), kind)
                logs = scorer(rows, counts)
                logs += ends[rows + size * lasts_of(part.column(3), counts)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(common.segment_sums(logs, counts) / np.log(10))], names=["block", "row", "score"])

    return stored.mapInArrow(run, "block long, row long, score double")


@dataclass
class _BlockScorer:
    """Scores the documents of one block, whose words with their counts and whose texts' scores by the layer come first."""

    block: int
    words: Words
    train_tokens: int
    distinct: int
    parts: list = field(default_factory=list)
    scores: list = field(default_factory=list)

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((hashes, counts))

    @staticmethod
    def _found(parts: list, keys: np.ndarray) -> np.ndarray:
        """The values of keys; parts are merged and sorted once."""
        if len(parts) != 1 or len(parts[0]) != 3:
            known, values = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(known, kind="stable")
            parts[:] = [(known[order], values[order], None)]
        known, values, _ = parts[0]
        return values[np.searchsorted(known, keys)]

    def score(self, texts: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        kinds, codes, counts = self.words.split(texts)
        n = self._found(self.parts, np.append(hashes_of(kinds), _END_HASH))
        base = np.log10((n + 0.5) / (self.train_tokens + 0.5 * (self.distinct + 1)))
        codes, _ = common.with_ends(codes, counts, len(kinds))
        counts = counts + 1
        return counts, common.segment_sums((n > 0)[codes].astype(np.int64), counts), common.segment_sums(base[codes], counts), self._found(self.scores, rows)
