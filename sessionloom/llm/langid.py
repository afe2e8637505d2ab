"""Language identification by averaged hashed subword embeddings (operator 8).

A text's vector is the mean of the embeddings of its words' hashed byte n-grams (and of the words themselves); a linear
softmax gives the languages. Embeddings and softmax are trained together by stochastic gradient descent in numpy, on
snippets of a bounded sample: about `per_language` labelled documents of each language, and of these at most
`language_snippets` snippets, drawn evenly over its documents. A temperature is then fitted on snippets kept out of
training, and so is the rejection limit: the confidence that all but `reject_share` of them reach.

As the softmax is linear, a word's share of the logits is one row; tasks keep those rows in a bounded table.

Null texts and texts without a letter are `und` with score 0. Equal texts get equal results. Without any labelled row
every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.0
    sizes: tuple[int, ...] = (2, 3, 4)

    def word_logits(self, words: list[bytes]) -> tuple[np.ndarray]:
        """Rows of (sum of the word's n-gram logits, number of n-grams)."""
        buckets, counts = common.word_grams(words, self.sizes, len(self.embeddings))
        table = self.embeddings @ self.weights
        return (np.column_stack([common.segment_sums(table[buckets], counts), counts]),)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], dims: int = 16, buckets: int = 1 << 15, snippet_words: int = 25, language_snippets: int = 3_000, epochs: int = 4, rate: float = 0.5, reject_share: float = 0.01, seed: int = 1) -> LanguageModel:
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    model = LanguageModel(languages, rng.normal(0, 0.1, (buckets, dims)).astype(np.float32), np.zeros((dims, max(1, len(languages))), np.float32), np.zeros(max(1, len(languages)), np.float32))
    model.weights[:] = rng.normal(0, 0.1, model.weights.shape)
    found: dict[str, list[tuple]] = {language: [] for language in languages}
    for text, label in zip(texts, labels, strict=True):
        words = common.words_of(text)
        own = [words[a : a + snippet_words] for a in range(0, len(words), snippet_words)]
        # a document's second snippet is drawn after the first one of every other document
        found[label].extend((turn, rng.random(), own[k]) for turn, k in enumerate(rng.permutation(len(own))))
    drawn = [(words, k) for k, language in enumerate(languages) for _, _, words in sorted(found[language], key=lambda x: x[:2])[:language_snippets]]
    if not drawn:
        return model
    order = rng.permutation(len(drawn))
    snippets, y = [drawn[i][0] for i in order], np.array([drawn[i][1] for i in order])
    grams, counts = common.word_grams([w for s in snippets for w in s], model.sizes, buckets)
    sizes = common.segment_sums(counts[:, None], np.array([len(s) for s in snippets]))[:, 0].astype(np.int64)
    ends = np.cumsum(sizes)
    dev = max(1, len(snippets) // 10) if len(snippets) > 20 else 0
    batch = 64
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for a in range(dev, len(snippets), batch):
            rows = np.arange(a, min(a + batch, len(snippets)))
            flat = grams[ends[rows[0]] - sizes[rows[0]] : ends[rows[-1]]]
            owner = np.repeat(np.arange(len(rows)), sizes[rows])
            mean = np.zeros((len(rows), dims), np.float32)
            np.add.at(mean, owner, model.embeddings[flat])
            mean /= sizes[rows][:, None]
            error = model.probabilities(mean @ model.weights + model.bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            back = (error @ model.weights.T / sizes[rows][:, None]).astype(np.float32)
            model.weights -= step * mean.T @ error / len(rows) * 4
            model.bias -= step * error.mean(axis=0)
            np.add.at(model.embeddings, flat, -step * 20 * back[owner] / 4)
    if dev:
        table = model.embeddings @ model.weights
        logits = common.segment_sums(table[grams[: ends[dev - 1]]], sizes[:dev]) / sizes[:dev][:, None] + model.bias
        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(model.probabilities(logits)[np.arange(dev), y[:dev]] + 1e-12).mean()
        model.temperature = min((float(t) for t in np.geomspace(0.05, 8, 40)), key=loss)
        best = model.probabilities(logits).max(axis=1)
        model.limit = float(np.quantile(best, reject_share))
    return model


def fit(docs: DataFrame, labelled: Column, per_language: int = 600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> LanguageModel:
    """A model of the rows that meet `labelled`; about per_language of each language are used."""
    rows = docs.where(labelled & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sample = common.bounded_sample(rows, per_language, "id", "lang").sort_values("id")
    return train(sample["text"].tolist(), sample["lang"].tolist(), **options)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected): rejected if the calibrated confidence is under the model's limit."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = shared.value
        table = common.WordTable(m.word_logits, (len(m.bias) + 1, np.float32))
        for batch in batch_iter:
            texts = batch.column(1).to_pylist()
            for a, b in common.batches(texts):
                lists = [common.words_of(t) for t in texts[a:b]]
                counts = np.array([len(x) for x in lists])
                numbers = table.numbers([w for x in lists for w in x])
                sums = common.segment_sums(table.tables[0][numbers], counts)
                p = m.probabilities(sums[:, :-1] / np.maximum(sums[:, -1:], 1) + m.bias)
                best = p.argmax(axis=1)
                known = np.array([bool(m.languages) and any(map(str.isalpha, t or "")) for t in texts[a:b]])
                score = np.where(known, p.max(axis=1), 0.0)
                names = [m.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(score), pa.array(~known | (score < m.limit))], names=["id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
