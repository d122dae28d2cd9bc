"""Quality classifier: supervised subword embeddings.

Hashed word, word-pair and character n-gram vectors are averaged per document and go through a softmax; vectors
and output are learnt together by stochastic gradient descent in numpy on a bounded sample of labelled rows.
A trained model is linear in the average, so each bucket's vector folds into one log-odds value for scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .subwords import MIX, Batch, joined, ngrams, word_hashes

BITS = 18
GRAMS = (3, 4)


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled sample that is fetched; the other fields are those of the training."""

    max_rows: int = 4000
    dim: int = 12
    epochs: int = 5
    rate: float = 0.5
    seed: int = 5


def _bucket(codes: np.ndarray) -> np.ndarray:
    return ((codes * MIX[0]) >> np.uint64(64 - BITS)).astype(np.int64)


def _parts(batch: Batch):
    """Buckets of the distinct words' features with the words they belong to, and of each pair of neighbours.

    A word that follows itself makes one pair feature, whatever the word."""
    hashes = word_hashes(batch.distinct)
    raw, space, owner = joined(batch.distinct)
    buckets, words = [_bucket(hashes)], [np.arange(len(hashes))]
    for n in GRAMS:
        at, code = ngrams(raw, space, n)
        inside = owner[at] < len(hashes)
        buckets.append(_bucket(code[inside]))
        words.append(owner[at][inside])
    left, right = batch.which[:-1], batch.which[1:]
    pairs = np.where(left == right, 0, _bucket(hashes[left] * MIX[1] + hashes[right] * MIX[2])) if len(hashes) else np.zeros(0, np.int64)
    first = np.zeros(len(batch.which), bool)
    first[batch.starts[batch.counts > 0]] = True
    return np.concatenate(buckets), np.concatenate(words), pairs, ~first[1:]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their shares of all its features."""
    batch = Batch([text])
    if not len(batch.which):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    bucket, word, pairs, inner = _parts(batch)
    times = np.bincount(batch.which, minlength=len(batch.distinct))[word]
    total = np.bincount(np.concatenate((bucket, pairs[inner])), np.concatenate((times, np.ones(inner.sum()))))
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / total[at].sum()).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Log-odds of each bucket, and those of a text without words; ``rows`` as from :func:`features`."""
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1 / settings.dim, 1 / settings.dim, (1 << BITS, settings.dim)).astype(np.float32)
    output, bias = np.zeros((settings.dim, 2), np.float32), np.zeros(2, np.float32)
    total, done = settings.epochs * max(1, len(rows)), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(rows)):
            at, share = rows[i]
            rate = np.float32(settings.rate * (1 - done / total))
            done += 1
            hidden = share @ vectors[at]
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = output @ p
            output -= rate * np.outer(hidden, p)
            bias -= rate * np.float32(0.1) * p
            # A feature's share of a document is small: the step is scaled by how many features there are.
            vectors[at] -= np.outer(rate * np.minimum(share * np.float32(len(at)), 4), back)
    if not len(rows):
        return np.zeros(1 << BITS), 0.0
    slope = output[:, 1] - output[:, 0]
    return (vectors @ slope).astype(np.float64), float(bias[1] - bias[0])


def labelled(docs: DataFrame, labels: DataFrame, label: str, allowed, max_rows: int, seed: int = 5) -> DataFrame:
    """Up to ``max_rows`` labelled rows (doc_id, text, label) with ``allowed`` ids, in an order of hashed ids: of rows that
    repeat an id, the one whose text has the least hash; of labels that differ, the lesser."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed).select(F.col("doc_id").alias("of_id"), F.col(label).cast("int").alias("label"))
    chosen = chosen.groupBy("of_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("of_id", F.lit(seed)), "of_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of_id"))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("r")
    return rows.groupBy("doc_id").agg(one).select("doc_id", "r.text", "r.label")


def fit(sample: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Model from a bounded ``sample`` (doc_id, text, label); features are made by the tasks that hold the texts."""
    kinds = {"at": "binary", "share": "binary"}

    def run(texts: list[str | None]) -> dict[str, list]:
        made = [features(t) for t in texts]
        return {"at": [a.tobytes() for a, _ in made], "share": [s.tobytes() for _, s in made]}

    rows = map_texts(sample, kinds, run, keep=["doc_id", "label"]).toArrow().sort_by("doc_id")
    data = [(np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(s.as_buffer(), np.float32)) for a, s in zip(rows["at"], rows["share"], strict=True)]
    return train(data, np.array(rows["label"].to_pylist(), np.int64), settings)


def score_texts(texts: list[str | None], odds: np.ndarray, bias: float) -> np.ndarray:
    batch = Batch(texts)
    if not len(batch.which):
        mean = np.zeros(len(texts))
    else:
        bucket, word, pairs, inner = _parts(batch)
        n = len(batch.distinct)
        of_word, n_of_word = np.bincount(word, odds[bucket], n), np.bincount(word, minlength=n)
        sums, counts = of_word[batch.which], n_of_word[batch.which].astype(np.float64)
        sums[1:] += np.where(inner, odds[pairs], 0)
        counts[1:] += inner
        mean = batch.sums(sums) / np.maximum(1, batch.sums(counts))
    return 1 / (1 + np.exp(-np.clip(mean + bias, -30, 30)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1, the probability of label 1) and predicted (1 from ``threshold`` on).

    Null and empty texts get the score of the bias alone; repeated rows score alike; an empty table gives no
    rows; columns named score or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # 2**BITS values

    def run(texts: list[str | None]) -> dict[str, list]:
        odds, bias = shared.value
        found = score_texts(texts, odds, bias)
        return {"score": found, "predicted": (found >= threshold).astype(np.int32)}

    return map_texts(docs, {"score": "double", "predicted": "int"}, run)
