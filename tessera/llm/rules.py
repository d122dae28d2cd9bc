"""Quality rules as a short-circuit cascade.

Every rule rejects by one measure of the text. A rule's cost and the share of documents that it rejects are
estimated on a sample, in one distributed pass, and the rules are then tried in the order of rejections per
second, each only on documents that no earlier rule rejected. The verdict does not depend on that order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_texts, shielded

SYMBOLS = b"#*$%&|<>"


class Measures:
    """Measures of one text, each computed when first asked for. ``bytes.split()`` splits at ASCII white space only."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.raw.count(bytes([c])) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside three-word windows that the text has twice or more."""
        if self.n_words < 4:
            return 0
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in self.words), np.int64, self.n_words)
        pairs = ids[:-1] * len(index) + ids[1:]
        if len(index) >= 2**20:  # three ids would not fit 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
            codes = np.unique(pairs[:-1] * self.n_words + pairs[1:], return_inverse=True)[1]
        else:
            codes = pairs[:-1] * len(index) + ids[2:]
        order = np.argsort(codes, kind="stable")
        same = np.diff(codes[order]) == 0
        if not same.any():
            return 0
        twice = np.zeros(len(codes), bool)
        twice[order[:-1][same]] = twice[order[1:][same]] = True
        covered = np.zeros(self.n_words, bool)
        for k in range(3):
            covered[k : k + len(codes)] |= twice
        return int(covered.sum())

    @cached_property
    def shouts(self) -> bool:
        letters = sum(map(str.isalpha, self.text))
        return sum(map(str.isupper, self.text)) > 0.7 * max(1, letters)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


#: Limits are loose on purpose: a rule rejects only what running prose never shows.
RULES = (
    Rule("too_few_words", lambda m: m.n_words < 50),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
    Rule("symbols", lambda m: 100 * m.n_symbols > 10 * m.word_chars),
    Rule("repeated_lines", lambda m: 100 * m.n_dup_lines > 50 * len(m.lines)),
    Rule("shouting", lambda m: m.n_words >= 20 and m.shouts),
    Rule("word_length", lambda m: m.word_chars < 2 * m.n_words or m.word_chars > 25 * m.n_words),
)
#: The rules of the base contract: they hold whatever the others say.
BASE = ("too_few_words", "repeated_windows")
MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plan_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, fraction: float = 0.01, seed: int = 7) -> list[str]:
    """Names of ``rules`` by rejections per second on a sample of ``fraction`` of ``docs``; of equals, the one
    given first. Seconds are measured, so two runs may order rules of like gain differently.

    Only sums per rule reach the driver. With an empty sample the given order stays.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spent, hit = dict.fromkeys([r.name for r in rules], 0.0), dict.fromkeys([r.name for r in rules], 0)
            for text in batch.column(0).to_pylist():
                for r in rules:  # fresh measures, so that no rule gets another's work for nothing
                    m, began = Measures(text), time.perf_counter()
                    hit[r.name] += bool(r.rejects(m))
                    spent[r.name] += time.perf_counter() - began
            yield pa.RecordBatch.from_pydict({"rule": list(spent), "seconds": list(spent.values()), "hits": list(hit.values())})

    sample = docs.select("text").sample(False, fraction, seed)
    rows = map_arrow(sample, measure, "rule string, seconds double, hits long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("hits").alias("h")).collect()
    gain = {r["rule"]: r["h"] / max(r["s"], 1e-9) for r in rows}
    given = [r.name for r in rules]
    return sorted(given, key=lambda n: (-gain.get(n, 0.0), given.index(n)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None, measures: bool = False) -> DataFrame:
    """``docs`` with ``rejected_by``: the first rule, in cascade order, that rejects the row's text, or null.

    Whether a row is rejected does not depend on the order; which rule is named does: give ``order`` to have reruns agree.

    ``measures`` adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed for every row,
    rejected or not. Null texts count as empty; empty texts fail for want of words; repeated rows are judged
    alike; an empty table gives an empty result. Columns of the input with these names are replaced.
    """
    order = order or plan_order(docs, rules)
    ranked = sorted(rules, key=lambda r: order.index(r.name))
    base = [r for r in rules if r.name in BASE]
    added = {"rejected_by": "string"}
    if measures:
        added |= dict.fromkeys(MEASURED, "long") | {"base_failed": "boolean"}

    def run(texts: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in added}
        for m in map(Measures, texts):
            out["rejected_by"].append(next((r.name for r in ranked if r.rejects(m)), None))
            if measures:
                for k in MEASURED:
                    out[k].append(getattr(m, k))
                out["base_failed"].append(any(r.rejects(m) for r in base))
        return out

    return map_texts(docs, added, run)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with the columns of ``docs``."""
    plain, restored = shielded(docs, ["rejected_by"])
    return restored(judge(plain, rules).filter(F.col("rejected_by").isNull()))
