"""Toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel compares words by their common subsequences of three characters, gaps included: a subsequence counts
``DECAY`` to the power of the characters that it skips, up to two, so that inserted, doubled or left-out
characters cost little. Kernel values against a set of landmark words, whitened, are a word's features
(Nystroem). The machine is trained on labelled sentences with the hinge loss, a sentence's value being that of
its worst word; the worst words of clean documents are then added as negative sentences and training is
repeated. A document's score is a logistic function of its three worst words.

Decision values are linear in the subsequence counts, so a trained machine folds into one table of weights per
subsequence, and scoring needs no kernel evaluation.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts

DECAY = 0.5
#: Offsets of a subsequence's second and third character; skipped characters: the last offset less 2.
PATTERNS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: Subsequences of three code points are told apart by hashes of this many bits.
BITS = 20
CODES = 1 << BITS
#: Value of a document without (another) word.
NONE = -3.0
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
#: What is taken out of words, inside them as well: marks that hide a word leave at most a gap in it.
_MARKS = str.maketrans("", "", string.punctuation + "«»„“”‚‘’…–—·¡¿§°")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Three or more single letters with white space between them: a word that is spaced out.
SPACED = re.compile(r"(?<![\w'’])[^\W\d_](?:\s+[^\W\d_](?!\w)){2,}")


def words_of(text: str | None) -> list[str]:
    """Words as training and scoring both see them: lower case, at white space, and spaced-out words put together as well.
    :func:`plain` is applied to them, once per distinct word."""
    low = (text or "").lower()
    words = low.split()
    if len(words) > 2:
        words += ["".join(m[0].split()) for m in SPACED.finditer(low)]
    return words


def plain(word: str) -> str:
    return word.translate(_MARKS)


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled documents, max_sentences the sentences of each label, and the hard negatives, that are
    fetched; all are taken in an order of hashes."""

    max_rows: int = 6000
    max_sentences: int = 5000
    max_seeds: int = 400
    evidence: float = 14.0
    landmarks: int = 192
    steps: int = 400
    rate: float = 5.0
    ridge: float = 1e-3
    seed: int = 11


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, code and value of the words' subsequences; a word's values have length 1 as a vector of parts.

    A word begins and ends with a blank, which counts as a character."""
    raw = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    space = raw == 32
    owner = np.cumsum(space) - 1
    wide = raw.astype(np.uint64)
    first, second, third = (wide * m for m in _MIX)
    found = []
    for a, b in PATTERNS:
        size = len(raw) - b
        if size <= 0:
            continue
        good = np.ones(size, bool)
        for k in range(1, b):
            good &= ~space[k : k + size]
        at = np.flatnonzero(good)
        mixed = (first[at] + second[at + a] + third[at + b]) * _MIX[0]
        found.append((owner[at], (mixed >> np.uint64(64 - BITS)).astype(np.int64), np.full(len(at), DECAY ** (b - 2))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    word, codes, value = (np.concatenate(x) for x in zip(*found, strict=True))
    inside = word < len(words)
    word, codes, value = word[inside], codes[inside], value[inside]
    norm = np.sqrt(np.bincount(word, value**2, len(words)))
    return word, codes, value / norm[word]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values, a row per word and a column per landmark."""
    word, codes, value = subsequences(landmarks)
    used, place = np.unique(codes, return_inverse=True)
    dense = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    np.add.at(dense, (place, word), value)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for start in range(0, len(words), 1000):
        some = words[start : start + 1000]
        word, codes, value = subsequences(some)
        row = np.searchsorted(used, codes)
        row[(row == len(used)) | (used[np.minimum(row, len(used) - 1)] != codes)] = len(used)
        hit = row < len(used)
        order = np.argsort(word[hit], kind="stable")
        owners, rows, values = word[hit][order], row[hit][order], value[hit][order]
        if len(owners):
            first = np.flatnonzero(np.diff(owners, prepend=-1))
            out[start + owners[first]] = np.add.reduceat(dense[rows] * values[:, None].astype(np.float32), first, axis=0)
    return out


def train(sentences: list[list[str]], labels: np.ndarray, landmarks: list[str], settings: Settings) -> tuple[np.ndarray, float]:
    """Weight of each subsequence and bias of the machine; ``sentences`` are lists of words, none of them empty.

    A negative sentence counts by its worst word. Of a positive one only the words that may be the reason are
    given, which keeps the problem convex but for the choice among them.
    """
    index: dict[str, int] = {}
    which = np.array([index.setdefault(w, len(index)) for s in sentences for w in s], np.int64)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sentences])))[:-1]
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    good = values > 1e-4
    white = vectors[:, good] / np.sqrt(values[good])
    z = (kernel(list(index), landmarks) @ white.astype(np.float32)).astype(np.float32)
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels != 1).sum()))
    w, bias = np.zeros(z.shape[1]), -0.5
    owner = np.repeat(np.arange(len(sentences)), np.diff(np.append(starts, len(which))))
    mean_w, mean_bias, kept = np.zeros_like(w), 0.0, 0
    for step in range(settings.steps):
        values = (z @ w.astype(np.float32) + np.float32(bias))[which]
        worst = np.maximum.reduceat(values, starts)
        top = np.flatnonzero((values == worst[owner]) & (sign * worst < 1)[owner])
        wrong, first = np.unique(owner[top], return_index=True)
        pull = sign[wrong] * share[wrong]
        rate = settings.rate / (1 + 0.02 * step)
        w = (1 - rate * settings.ridge) * w + rate * (pull @ z[which[top[first]]] if len(wrong) else 0)
        bias += 0.1 * rate * pull.sum()
        if step >= settings.steps // 2:
            mean_w, mean_bias, kept = mean_w + w, mean_bias + bias, kept + 1
    alpha = white @ (mean_w / kept)
    table = np.zeros(CODES)
    word, codes, value = subsequences(landmarks)
    np.add.at(table, codes, alpha[word] * value)
    return table, mean_bias / kept


def worst_words(texts: list[str | None], machine: tuple[np.ndarray, float]) -> tuple[np.ndarray, list[str]]:
    """Values of the three worst distinct words of each text (n x 3, descending), and the worst word."""
    out, names = np.full((len(texts), 3), NONE), [""] * len(texts)
    words: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = words_of(text)
        counts[k] = len(own)
        words += own
    full = np.flatnonzero(counts > 0)
    if not len(full):
        return out, names
    which, distinct = pd.factorize(np.array(words, dtype=object))
    distinct = [plain(w) for w in distinct]
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    table, bias = machine
    word, codes, value = subsequences(distinct)
    of_word = np.bincount(word, table[codes] * value, len(distinct)) + bias
    of_word[[not w for w in distinct]] = NONE
    # Equal values count as one word: the next one is strictly lower, or the same subsequences in other words.
    left = of_word[which].astype(np.float64)
    owner = np.repeat(np.arange(len(texts)), counts)
    for k in range(3):
        best = np.maximum.reduceat(left, starts[full])
        out[full, k] = np.maximum(best, NONE)
        of_text = np.full(len(texts), np.inf)
        of_text[full] = best
        top = left == of_text[owner]
        if k == 0:
            at = np.flatnonzero(top)
            texts_at, first = np.unique(owner[at], return_index=True)
            for t, i in zip(texts_at.tolist(), at[first].tolist(), strict=True):
                names[t] = distinct[which[i]]
        left[top] = -np.inf
    return out, names


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Coefficients, the last one the constant, by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    c = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = x.T * (p * (1 - p)) @ x + ridge * np.eye(len(c))
        c = c + np.linalg.solve(h, x.T @ (y - p) - ridge * c)
    return c


def marks(word: str) -> list[str]:
    """What of a word may mark a toxic document: itself, and its first letters."""
    return [f"={word}", f"^{word[:4]}", f"^{word[:5]}"]


def fit(sample: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, float, np.ndarray]:
    """Model from a bounded ``sample`` (doc_id, text, label): weights, bias, coefficients of the documents' score.

    A toxic document has many sentences that are not. Its sentences are positive by those of their words that
    documents of label 1 show far more often than others do (``evidence``; 0: by all their words).
    """
    sample = cut(sample.dropDuplicates(["text", "label"]))  # else a copied document makes its words look like reasons
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        prior = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
        return np.zeros(CODES), 0.0, np.array([0, 0, 0, np.log(prior / (1 - prior))])

    def sentences(texts: list[str | None]) -> dict[str, list]:
        found = [[[w for x in words_of(s) if (w := plain(x))] for s in SENTENCE.split(t or "")] for t in texts]
        return {"sentences": found, "marks": [sorted({m for s in f for w in set(s) for m in marks(w)}) for f in found]}

    told = cut(map_texts(sample, {"sentences": "array<array<string>>", "marks": "array<string>"}, sentences, keep=["label"]))
    seen = told.select("label", F.explode("marks").alias("mark")).groupBy("mark").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    odds = F.log(((F.col("bad") + 0.5) / n[1]) / ((F.col("good") + 0.5) / n[0]))
    telling = (F.col("bad") >= max(2, 0.008 * n[1])) & (F.col("odds") > 2) & (F.col("bad") * F.col("odds") >= settings.evidence)
    seeds = {r["mark"] for r in seen.withColumn("odds", odds).filter(telling).orderBy(F.desc(F.col("bad") * F.col("odds")), "mark").limit(settings.max_seeds).select("mark").collect()}

    lines = told.select("label", F.explode("sentences").alias("words")).filter(F.size("words") > 0)
    few = lambda df: [r["words"] for r in df.select("words").orderBy(F.xxhash64("words", F.lit(settings.seed))).limit(settings.max_sentences).collect()]
    bad = lines.filter("label = 1")
    if settings.evidence > 0:
        named = F.array(*[F.lit(s) for s in sorted(seeds)]) if seeds else F.expr("CAST(array() AS array<string>)")
        of_word = lambda w: F.array(F.concat(F.lit("="), w), *[F.concat(F.lit("^"), F.substring(w, 1, k)) for k in (4, 5)])
        bad = bad.withColumn("words", F.array_sort(F.array_distinct(F.filter("words", lambda w: F.arrays_overlap(of_word(w), named))))).filter(F.size("words") > 0)
    positive, negative = few(bad), few(lines.filter("label = 0"))
    if not positive or not negative:
        return np.zeros(CODES), 0.0, np.array([0, 0, 0, np.log(n[1] / n[0])])
    rng = np.random.default_rng(settings.seed)
    reasons = [w for w, _ in Counter(w for s in positive for w in s).most_common(settings.landmarks // 2)]
    pick = lambda words, k: [words[i] for i in rng.permutation(len(words))[:k]]
    common, free = sorted({w for s in negative for w in s}), settings.landmarks - len(reasons)
    landmarks = list(dict.fromkeys(reasons + pick(common, free)))
    machine = train(positive + negative, np.repeat([1, 0], [len(positive), len(negative)]), landmarks, settings)

    def judged(machine: tuple[np.ndarray, float], wanted: str) -> DataFrame:
        shared = sample.sparkSession.sparkContext.broadcast(machine)

        def run(texts: list[str | None]) -> dict[str, list]:
            top, names = worst_words(texts, shared.value)
            return {"top": list(top), "worst": names}

        return map_texts(sample, {"top": "array<double>", "worst": "string"}, run, keep=["doc_id", "label"]).filter(wanted)

    hard = judged(machine, "label = 0").filter("worst != ''").select("worst").distinct().orderBy(F.xxhash64("worst", F.lit(settings.seed)), "worst")
    hard = [[r["worst"]] for r in hard.limit(settings.max_sentences).collect()]
    landmarks = list(dict.fromkeys(reasons + pick([h[0] for h in hard], free // 2) + pick(common, free - free // 2)))
    machine = train(positive + negative + hard, np.repeat([1, 0], [len(positive), len(negative) + len(hard)]), landmarks, settings)
    rows = judged(machine, "true").select("doc_id", "label", "top").toArrow().sort_by("doc_id")
    tops = np.array(rows["top"].to_pylist()).reshape(-1, 3)
    return *machine, logistic(tops, np.array(rows["label"].to_pylist(), float))


def score(docs: DataFrame, model: tuple[np.ndarray, float, np.ndarray], threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1, higher: toxic likelier) and predicted (1 from ``threshold`` on).

    Null and empty texts score as texts without a bad word; repeated rows score alike; an empty table gives no
    rows; columns named score or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the table has 2**18 values

    def run(texts: list[str | None]) -> dict[str, list]:
        *machine, c = shared.value
        top, _ = worst_words(texts, tuple(machine))
        found = 1 / (1 + np.exp(-np.clip(top @ c[:3] + c[3], -30, 30)))
        return {"score": found, "predicted": (found >= threshold).astype(np.int32)}

    return map_texts(docs, {"score": "double", "predicted": "int"}, run)
