"""SimHash near-duplicates by Golay-code fuzzy hashing.

Documents with one fingerprint form a class; links are looked for between classes. A 64-bit fingerprint has
three segments of 22, 21 and 21 bits, each read as a 23-bit word of the perfect binary Golay code. A word's
nearest codeword is at distance 3 at most, and if two words differ in one bit, the nearest codeword of either
is within distance 4 of the other: at most six codewords are that near, and they are the word's keys.

With at most three differing bits in all, the errors of the three segments are, up to order, (x, 0, 0),
(x, 1, 0) or (1, 1, 1), so that classes which may link share at least one of these keys:

* the exact values of two segments,
* the exact value of one segment and a codeword of a second one,
* a codeword of each segment.

One differing bit changes a segment's parity: the side with even parity gives only its nearest codeword and the
odd side all near ones, and only sides of opposite parity are joined. A key fixes 33 bits or more, so the
candidates by chance stay few however large the corpus is, and each is verified by its bit count.

:func:`near_duplicates` links fingerprints over shingles by these bits alone. :func:`keep_dissimilar` wants a share of
common five-word shingles: a text that shares 0.8 of them differs from the other in few words, so that it uses the same
keys on fingerprints over words, which then differ in few bits, and signatures of the shingles to decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, map_texts, row_keys
from .graph import components

SEED = 42
#: Shift and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, size: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 values; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return 0
    if len(words) < size:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
        n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)
    for start in range(0, n, 65536):
        counts += np.unpackbits(hashes[start : start + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, k1, k2 (keys of the row), fp (the fingerprint as a signed long) per row of ``docs``."""

    def run(texts: list[str | None]) -> dict[str, list]:
        return {"fp": np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)}

    return map_texts(docs.select("doc_id", "text", *row_keys()), {"fp": "long"}, run, keep=["doc_id", "k1", "k2"])


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator: its syndrome."""
    words = words.astype(np.int64)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ GENERATOR << (bit - 11), words)
    return words


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each of the 2048 syndromes: the error pattern (weight 3 at most), and the six patterns that lead to the
    codewords within distance 4, the first again where there are fewer."""
    patterns = np.array([sum(1 << b for b in c) for k in range(4) for c in combinations(range(23), k)], np.int64)
    error = np.zeros(2048, np.int64)
    error[_remainder(patterns)] = patterns
    near = np.repeat(error[:, None], 6, axis=1)
    fill = np.ones(2048, np.int64)
    fours = np.array([sum(1 << b for b in c) for c in combinations(range(23), 4)], np.int64)
    for syndrome, pattern in zip(_remainder(fours).tolist(), fours.tolist(), strict=True):
        near[syndrome, fill[syndrome]] = pattern
        fill[syndrome] += 1
    return error, near


def class_keys(fps: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of fingerprints: row of the fingerprint, key, side (0 and 1 are joined)."""
    error, near = tables
    fps = fps.view(np.uint64)
    seg = [(fps >> np.uint64(s) & np.uint64(2**w - 1)).astype(np.int64) for s, w in SEGMENTS]
    syndromes = [_remainder(x) for x in seg]
    own = [(x ^ error[s]) >> 11 for x, s in zip(seg, syndromes, strict=True)]  # the 12 leading bits name a codeword
    close = [(x[:, None] ^ near[s]) >> 11 for x, s in zip(seg, syndromes, strict=True)]
    odd = [np.bitwise_count(x.astype(np.uint64)).astype(np.int64) & 1 for x in seg]
    options = [np.where(o[:, None] == 1, c, w[:, None]) for o, c, w in zip(odd, close, own, strict=True)]
    rows = np.arange(len(fps))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(tag: np.ndarray | int, value: np.ndarray, side: np.ndarray) -> None:
        out.append((np.broadcast_to(rows.reshape(-1, *[1] * (value.ndim - 1)), value.shape).ravel(), (np.int64(tag) << 44 | value if np.isscalar(tag) else (tag.reshape(-1, *[1] * (value.ndim - 1)) << 44) | value).ravel(), np.broadcast_to(side.reshape(-1, *[1] * (value.ndim - 1)), value.shape).ravel()))

    for k in range(3):
        i, j = [x for x in range(3) if x != k]
        add(k, seg[i] << 22 | seg[j], np.full(len(fps), 2))
        for exact, fuzzy in ((i, j), (j, i)):
            add(3 + 2 * k + (exact == j), seg[exact][:, None] << 12 | options[fuzzy], odd[fuzzy])
    parity = odd[0] | odd[1] << 1 | odd[2] << 2
    a, b, c = options
    add(16 + np.minimum(parity, 7 - parity), a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :], odd[2])
    row, key, side = map(np.concatenate, zip(*out, strict=True))
    return _distinct(row, key, side)


def _distinct(row: np.ndarray, key: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((key, row))
    row, key, side = row[order], key[order], side[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new], side[new]


def links(classes: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs a < b of the distinct fingerprints ``classes.fp`` that differ in ``max_bits`` (3 at most) or fewer bits.

    Fingerprints are distinct, so the pairs of each are bounded by the 43,744 values within three bits of it, however
    many rows have it. Sides that share a key are compared where they meet, and only linked pairs leave that task.
    """
    if max_bits > 3:
        raise ValueError("the keys cover up to three differing bits")
    return _near(classes.select(F.lit(0).alias("t"), "fp", F.col("fp").alias("root")), max_bits).select("a", "b")


def _near(prints: DataFrame, max_bits: int) -> DataFrame:
    """t, a < b: fingerprints ``fp`` of one kind ``t`` and of different ``root`` that share a key and differ in ``max_bits`` or
    fewer bits: up to three all such pairs, beyond them those whose differing bits the keys happen to bear."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                kind, fps, root = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                row, key, side = class_keys(fps.astype(np.int64), tables)
                yield pa.RecordBatch.from_arrays([pa.array(kind[row], pa.int32()), pa.array(key), pa.array(side.astype(np.int8)), pa.array(fps[row]), pa.array(root[row])], names=["t", "key", "side", "fp", "root"])

    keys = map_arrow(prints.select("t", "fp", "root"), run, "t int, key long, side byte, fp long, root long")
    side = lambda rows, fp, root: rows.select("t", "key", F.col("fp").alias(fp), F.col("root").alias(root))
    left, right = side(keys.filter("side != 1"), "x", "x_root"), side(keys.filter("side != 0"), "y", "y_root")
    near = (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits) & (F.col("x") != F.col("y")) & (F.col("x_root") != F.col("y_root"))
    pairs = left.join(right, ["t", "key"]).filter(near)
    return pairs.select("t", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _starred(prints: DataFrame, max_bits: int) -> DataFrame:
    """t, a < b: each fingerprint ``fp`` of a kind ``t`` with the least one that has two of its segments and differs in
    ``max_bits`` or fewer bits: at most three pairs for each, which tie most of a dense cluster together."""
    others = [(2**64 - 1) ^ ((2**w - 1) << s) for s, w in SEGMENTS]
    masks = [m - 2**64 if m >= 2**63 else m for m in others]  # as signed longs
    held = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("rest")) for i, m in enumerate(masks)])
    keyed = prints.select("t", "fp", F.inline(held))
    least = cut(keyed.groupBy("t", "part", "rest").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1"))
    pairs = keyed.withColumnRenamed("fp", "b").join(least.drop("n"), ["t", "part", "rest"]).filter(F.col("a") < F.col("b"))
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("t", "a", "b").distinct()


def linked(classes: DataFrame, max_bits: int = 3) -> DataFrame:
    """node, root of every fingerprint ``classes.fp`` that has a link: the components of all links, of which those inside a
    cluster that few links already tie together are not listed."""
    if max_bits > 3:
        raise ValueError("the keys cover up to three differing bits")
    few = cut(_starred(classes.select(F.lit(0).alias("t"), "fp"), max_bits).select("a", "b"))
    tied = classes.select("fp").join(components(few), F.col("fp") == F.col("node"), "left").select(F.lit(0).alias("t"), "fp", F.coalesce("root", "fp").alias("root"))
    return components(few.unionAll(_near(tied, max_bits).select("a", "b")))


def _marked(docs: DataFrame, max_bits: int, shingle: int) -> DataFrame:
    """As near_duplicates, and root (the least fingerprint of the component): its key, while component_id need not be unique."""
    prints = cut(fingerprints(docs, shingle))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = linked(classes, max_bits)  # node, root: only classes with links
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = cut(rooted.join(first, "root").select("fp", "component_id", "root"))
    return prints.join(members, "fp").select("doc_id", "k1", "k2", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, max_bits: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, k1, k2, fp, component_id (the smallest doc_id that links reach) per row of ``docs``.

    Null and empty texts have fingerprint 0 and are linked like any other. Null ids count only where a
    component has no other id; repeated rows stay and share their component; an empty table gives no rows;
    other columns are ignored.
    """
    return _marked(docs, max_bits, shingle).drop("root")


def keep_one(docs: DataFrame, max_bits: int = 3, shingle: int = 3) -> DataFrame:
    """``docs`` with only the row of smallest doc_id of each group of near-duplicates; of equal rows, one."""
    marked = _marked(docs, max_bits, shingle)
    best = marked.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("k1", "k2")).alias("k"))
    return _only(docs, best)


def _only(docs: DataFrame, best: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose keys are ``best.k``; of equal rows, one."""
    kept = docs.select("*", *row_keys("__")).join(best.select(F.col("k.k1").alias("__of1"), F.col("k.k2").alias("__of2")), (F.col("__k1") == F.col("__of1")) & (F.col("__k2") == F.col("__of2")))
    # Equal rows have equal keys, and lie together after the join.
    place = Window.partitionBy("__k1", "__k2").orderBy("__k1")
    return kept.withColumn("__nth", F.row_number().over(place)).filter("__nth = 1").select([f"`{c}`" for c in docs.columns])


#: Fingerprints per text in the search for similar texts, differing bits that are looked at, and places of a signature.
TABLES, LOOK_BITS, PLACES = 3, 8, 256


def profiles(texts: list[str | None], shingle: int) -> dict[str, list]:
    """Of each text: c1, c2 (128 bits that name its words in order), f (``TABLES`` fingerprints over its words, each
    weighted by 1 + ln of how often it stands there), and a signature of its shingles.

    The signature has, in each of ``PLACES`` places, one byte of the least of the shingle hashes that fall there, or 0:
    two signatures agree in about the share of shingles that two texts have in common.
    """
    words: list[bytes] = []
    bounds = [0]
    for text in texts:
        words += (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
        bounds.append(len(words))
    which, distinct = pd.factorize(np.array(words, dtype=object))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([[digest(w, SEED + t) for t in range(TABLES)] for w in distinct], np.uint64).reshape(len(distinct), TABLES)
    signs = np.unpackbits(hashes.astype("<u8").view(np.uint8), axis=1, bitorder="little").reshape(len(distinct), 64 * TABLES)
    out: dict[str, list] = {"c1": [], "c2": [], "f": [], "signature": []}
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        own = words[lo:hi]
        whole = b" ".join(own)
        out["c1"].append(np.uint64(digest(whole, SEED)).astype(np.int64))
        out["c2"].append(np.uint64(digest(whole, SEED + 1)).astype(np.int64))
        if not own:
            out["f"].append([0] * TABLES)
            out["signature"].append(bytes(PLACES))
            continue
        ids, times = np.unique(which[lo:hi], return_counts=True)
        weights = (1 + np.log(times)).astype(np.float32)
        total = sum(weights[k : k + 4096] @ signs[ids[k : k + 4096]] for k in range(0, len(ids), 4096))
        bits = 2 * total > weights.sum()
        out["f"].append(np.packbits(bits, bitorder="little").view("<i8").tolist())
        pieces = map(b" ".join, zip(*(own[i:] for i in range(shingle)), strict=False)) if len(own) >= shingle else [whole]
        found = np.sort(np.fromiter((digest(x, SEED) for x in pieces), np.uint64, max(1, len(own) - shingle + 1)))
        place = (found >> np.uint64(56)).astype(np.int64)  # sorted by place, and in each place by value
        first = np.flatnonzero(np.diff(place, prepend=-1))
        signature = np.zeros(PLACES, np.uint8)
        signature[place[first]] = (found[first] % np.uint64(255)).astype(np.uint8) + 1
        out["signature"].append(signature.tobytes())
    return out


def agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles of texts with these signatures (rows): of the places that either uses, those
    that agree, less what agrees by chance. Its standard error is 0.03 at most."""
    used = ((left > 0) | (right > 0)).sum(axis=1)
    same = ((left == right) & (left > 0)).sum(axis=1)
    return np.where(used > 0, (same / np.maximum(used, 1) - 1 / 255) / (1 - 1 / 255), 1.0)


def similar(classes: DataFrame, similarity: float) -> DataFrame:
    """node, root of ``classes.id``: components of the classes whose signatures agree in ``similarity`` or more, among those with
    a fingerprint in common or near by.

    Candidates come from the keys of all ``TABLES`` fingerprints; a class with another's very fingerprint is compared with
    the first class that has it. What few pairs have tied together is not compared again.
    """
    prints = classes.select("id", F.posexplode("f").alias("t", "fp"))
    first = cut(prints.groupBy("t", "fp").agg(F.min("id").alias("first")))
    same = prints.join(first, ["t", "fp"]).filter("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    of = lambda c, n: first.select("t", F.col("fp").alias(c), F.col("first").alias(n))
    named = lambda pairs: pairs.join(of("a", "x"), ["t", "a"]).join(of("b", "y"), ["t", "b"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    few = cut(_agreeing(same.unionAll(named(_starred(first, LOOK_BITS))).distinct(), classes, similarity))
    tied = first.join(components(few), F.col("first") == F.col("node"), "left").select("t", "fp", F.coalesce("root", "first").alias("root"))
    return components(few.unionAll(_agreeing(named(_near(tied, LOOK_BITS)).distinct(), classes, similarity)))


def _agreeing(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    sides = lambda c: classes.select(F.col("id").alias(c), F.col("signature").alias(f"{c}_signature"))
    met = pairs.join(sides("a"), "a").join(sides("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                a, b, left, right = batch.slice(start, 4096).columns
                left, right = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, PLACES) for x in (left, right))
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(agreement(left, right) >= similarity))

    return map_arrow(met.select("a", "b", "a_signature", "b_signature"), run, "a long, b long")


def keep_dissimilar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each group of texts that are linked by ``similarity`` or more of their ``shingle``-word
    shingles: the row of smallest doc_id (null ids last), of ties one.

    Texts of the same words in the same order, but for the case of A-Z and white space, are one class. Classes are
    candidates if one of three fingerprints over their words comes near the other's, and linked if their signatures
    agree. Null and empty texts are one class; an empty table gives no rows; other columns pass through.
    """
    kinds = {"c1": "long", "c2": "long", "f": "array<long>", "signature": "binary"}
    prints = map_texts(docs.select("doc_id", "text", *row_keys()), kinds, lambda texts: profiles(texts, shingle), keep=["doc_id", "k1", "k2"], at_once_bytes=1 << 20)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("best")
    classes = prints.groupBy("c1", "c2").agg(best, F.first("f").alias("f"), F.first("signature").alias("signature"))
    classes = cut(cut(classes).withColumn("id", F.monotonically_increasing_id()).select("id", "best", "f", "signature"))
    roots = similar(classes, similarity)
    rooted = classes.select("id", "best").join(roots, F.col("id") == F.col("node"), "left").select("best", F.coalesce("root", "id").alias("root"))
    return _only(docs, rooted.groupBy("root").agg(F.min("best").alias("k")))
