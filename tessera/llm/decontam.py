"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items, as word ids, form one automaton per block of items, which a task builds and writes into the shared folder;
documents are streamed through each of them word by word, and the longest match that ends at each word tells which
words lie in windows of the items. Only runs of words that the items have at all are streamed. An automaton of n words
has 2n states at most, so ``BLOCK_WORDS`` bounds what a worker holds at once. More items make more blocks: each part of
the documents is then matched against one after the other, so that documents are still read once.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, file_system, map_arrow, map_texts, new_folder, parts

BLOCK_WORDS = 100_000
#: Automata that a worker keeps for its next texts.
HELD = 2
#: Bytes of texts that are matched against one automaton before the next is taken.
PART_BYTES = 16 << 20
KINDS = {"n_words": "long", "spans": "array<struct<start:int,end:int>>", "items": "array<string>"}
#: As the pattern of the words: digits, letters and whatever is not ASCII.
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: On UTF-8 bytes: A-Z to lower case, everything else in ASCII that no word has to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton of word sequences; items of fewer than ``window`` words match as a whole."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.ids, self.vocabulary = window, [i for i, _ in items], {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, owners = [-1], [0], [set()]
        whole: list[tuple[int, int, int]] = []  # state, length and item of the short ones
        for k, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)), owners)
                owners[last].add(k)
            if words and len(words) < window:
                whole.append((last, len(words), k))
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[v]] >= window:  # shorter strings are no windows
                owners[self.link[v]] |= owners[v]
        self.owners = [tuple(x) if n >= window else () for x, n in zip(owners, self.length, strict=True)]
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for state, n, k in whole:
            self.whole.setdefault(state, []).append((n, k))
        self.shortest = min([window, *(n for _, n, _ in whole)])

    def _extend(self, last: int, c: int, owners: list[set]) -> int:
        nxt, link, length = self.next, self.link, self.length

        def clone(p: int, q: int) -> int:
            new = len(link)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            owners.append(set())
            link[q] = new
            while p != -1 and nxt[p].get(c) == q:
                nxt[p][c] = new
                p = link[p]
            return new

        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[last] + 1 == length[q] else clone(last, q)
        cur = len(link)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        owners.append(set())
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[p] + 1 == length[q] else clone(p, q)
        return cur

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words (start, end) covered by windows, and the numbers of the items they are from."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))))
        runs = edge.reshape(-1, 2)
        for begin, end in runs[runs[:, 1] - runs[:, 0] >= self.shortest].tolist():
            state = length = 0
            for i, c in enumerate(ids[begin:end].tolist(), begin):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if c in self.next[state]:
                    state = self.next[state][c]
                    length += 1
                if length >= self.window or self.whole and length >= self.shortest:
                    self._ends(i + 1, state, length, spans, items)
        return spans, items

    def _ends(self, end: int, state: int, length: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        if length >= self.window:
            spans.append((end - length, end))
            top = state
            while self.length[self.link[top]] >= self.window:
                top = self.link[top]
            items.update(self.owners[top])
        while state > 0 and self.whole:
            for n, k in self.whole.get(state, ()):
                if n <= length:
                    spans.append((end - n, end))
                    items.add(k)
            state = self.link[state]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces_of(words: list[bytes], window: int, most: int) -> Iterator[list[bytes]]:
    """``words`` in pieces of ``most`` at most that overlap so that each window lies in one of them."""
    if len(words) <= most:
        yield words
        return
    step = most - window + 1
    for start in range(0, len(words) - window + 1, step):
        yield words[start : start + most]


def build(benchmark: DataFrame, folder: str, window: int = 10, block_words: int = BLOCK_WORDS) -> list[str]:
    """Write an automaton per block of items into ``folder``; the files' names.

    Long items go in overlapping pieces, and pieces are dealt to blocks of about ``block_words`` words by their hash.
    Each block's automaton is built and written by a task; only names, one per block, reach the driver.
    """
    most = max(window, block_words // 4)

    def split(texts: list[str | None]) -> dict[str, list]:
        found = [[b" ".join(p) for p in pieces_of(w, window, most)] if (w := words_of(t)) else [] for t in texts]
        return {"pieces": found}

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    items = map_texts(named, {"pieces": "array<binary>"}, split, keep=["item"])
    items = cut(items.select("item", F.explode("pieces").alias("words")).distinct())
    n_words = F.regexp_count(F.col("words").cast("string"), F.lit(" ")) + 1
    total = items.agg(F.sum(n_words)).first()[0] or 0
    if not total:
        return []
    blocks = -(-total // block_words)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        automaton = Automaton([(i, w.split()) for i, w in zip(rows["item"].to_pylist(), rows["words"].to_pylist(), strict=True)], window)
        store, path = file_system(folder)
        store.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.automaton"
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(zlib.compress(pickle.dumps(automaton, pickle.HIGHEST_PROTOCOL), 1))
        return pa.table({"name": [name]})

    return sorted(r["name"] for r in dealt.groupBy("block").applyInArrow(write, "name string").collect())


#: Automata that a worker holds, by file, the last used last.
_held: dict[str, Automaton] = {}


def _automata(folder: str, names: list[str]) -> Iterator[Automaton]:
    """The automata of all blocks, one after the other, those that this worker holds first; it holds ``HELD`` at most."""
    for name in sorted(names, key=lambda n: f"{folder}/{n}" not in _held):
        file = f"{folder}/{name}"
        if file not in _held:
            while len(_held) >= HELD:
                _held.pop(next(iter(_held)))
            store, path = file_system(file)
            with store.open_input_file(path) as data:
                _held[file] = pickle.loads(zlib.decompress(data.read()))
        yield _held[file]


def find(texts: list[str | None], folder: str, names: list[str]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """Number of words, spans of words (merged) and items of each text, over all blocks."""
    words = [words_of(t) for t in texts]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for automaton in _automata(folder, names):
        for k, own in enumerate(words):
            found, numbers = automaton.match(own)
            if found:
                spans[k] += merged(found)
                items[k] |= {automaton.ids[n] for n in numbers}
    return [len(w) for w in words], [merged(s) for s in spans], items


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, spans (of words, merged) and items (ids) that occur in each row's text.

    Texts are read once, whatever the number of blocks. An item of fewer than ``window`` words occurs as a whole;
    null and empty texts have no words and items without words never occur. Repeated rows and items count alike;
    with no items nothing is hit; an empty table gives no rows. Columns of ``docs`` with the names of the new ones
    are replaced.
    """
    docs = docs.select([f"`{c}`" for c in docs.columns if c not in KINDS])
    folder = new_folder(docs.sparkSession, "automata")
    names = build(benchmark, folder, window, block_words)

    def run(texts: list[str | None]) -> dict[str, list]:
        counts, spans, items = find(texts, folder, names)
        return {"n_words": counts, "spans": [[{"start": a, "end": b} for a, b in s] for s in spans], "items": [sorted(i) for i in items]}

    return map_texts(docs, KINDS, run, at_once=4096, at_once_bytes=PART_BYTES)


def n_hit(spans: list[tuple[int, int]]) -> int:
    return sum(b - a for a, b in spans)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per row of ``docs``."""
    found = matches(docs.select("doc_id", "text"), benchmark, window, block_words).drop("text")
    hit = F.aggregate("spans", F.lit(0), lambda n, x: n + x["end"] - x["start"]).cast("long")
    items = F.array_sort("items")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans (merged) and what lies between them; a line break takes each span's place."""
    places = [m.span() for m in TOKEN.finditer(text.translate(_LOWER))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "\n".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the spans of ``window`` words or more (or whole shorter items) shared with the items.

    Rows with more than ``coverage`` of their words in such spans go as a whole. Cutting may bring words
    together that match anew, so what was cut is matched again until nothing is left to cut: each cut shortens
    the text. Null and empty texts stay; columns are those of ``docs``; an empty table gives no rows.
    """
    schema, place = docs.schema, docs.columns.index("text")
    folder = new_folder(docs.sparkSession, "automata")
    names = build(benchmark, folder, window, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows in parts(batch.column(place), 4096, PART_BYTES):
                part = batch.slice(start, rows)
                texts = part.column(place).to_pylist()
                counts, spans, _ = find(texts, folder, names)
                keep = [n_hit(s) <= coverage * n for s, n in zip(spans, counts, strict=True)]
                todo = [k for k, s in enumerate(spans) if s and keep[k]]
                if not todo and all(keep):
                    yield part
                    continue
                while todo:
                    for k in todo:
                        texts[k] = cut_spans(texts[k], spans[k])
                    found = find([texts[k] for k in todo], folder, names)[1]
                    for k, s in zip(todo, found, strict=True):
                        spans[k] = s
                    todo = [k for k in todo if spans[k]]
                columns = [part.column(i) for i in range(part.num_columns)]
                columns[place] = pa.array(texts, columns[place].type)
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames()).filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, schema)


def items_digest(ids: list[str]) -> str:
    """As ``items_sha256``: for tests and callers outside Spark."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
