"""Line dedup by the spread over distinct sites.

Each line is two hashes, 128 bits together; per line one HyperLogLog sketch of the sites that show it, merged by the aggregation. Lines
whose estimate is clear of the threshold are decided by it; those near it get an exact distinct count. Lines on
``min_sites`` sites or more are boilerplate and go from every document, but for their first place in the corpus
(smallest id, then line number), so that no text is lost for good, copied documents included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, joined_hot, row_keys

#: Up to this count, which is taken first, lines near the threshold are broadcast; above it they are joined by a shuffle.
BROADCAST_ROWS = 100_000


def line_rows(docs: DataFrame, site: str = "source") -> DataFrame:
    """k1, k2 (keys of the row), doc_id, site, place, h1, h2 (128 bits of hashes of the line) of every line with a word."""
    # Keys first: beside the generator they would be hashes of the whole text, once per line.
    split = docs.select(*row_keys(), "doc_id", F.col(site).alias("site"), F.split("text", "\n", -1).alias("lines"))
    lines = split.select("k1", "k2", "doc_id", "site", F.posexplode("lines").alias("place", "line"))
    return lines.filter(F.col("line").rlike(WORD)).select("k1", "k2", "doc_id", "site", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = 8) -> DataFrame:
    """h1, h2, first_id, first_place, n of the lines of ``line_rows`` on ``min_sites`` distinct sites or more; n is how often.

    A null site counts as a site of its own. A sketch of 2**lg_k registers errs by 1.04 / sqrt(2**lg_k); lines
    within four such errors, and one site, of the threshold are counted exactly.
    """
    named = F.coalesce(F.concat(F.lit("+"), F.col("site")), F.lit("-"))
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(named, F.lit(lg_k))).alias("sites"), F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")
    )
    margin = 1 + 4 * 1.04 / 2 ** (lg_k / 2) * min_sites
    spread = cut(spread.filter(F.col("sites") >= min_sites - margin))
    near = spread.filter(F.col("sites") <= min_sites + margin)
    asked = near.select("h1", "h2")
    if near.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    # Distinct pairs first, which each task does before the shuffle: a common line is no heavier than its sites.
    sites = lines.select("h1", "h2", named.alias("named")).join(asked, ["h1", "h2"], "left_semi").distinct()
    exact = sites.groupBy("h1", "h2").agg(F.count("*").alias("exact")).filter(F.col("exact") >= min_sites)
    chosen = spread.filter(F.col("sites") > min_sites + margin).unionAll(near.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi").select(spread.columns))
    return chosen.select("h1", "h2", F.col("first.doc_id").alias("first_id"), F.col("first.place").alias("first_place"), "n")


def remove_boilerplate(docs: DataFrame, min_sites: int = 5, site: str = "source", lg_k: int = 8) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and n_lines, n_removed (lines with a word).

    Lines are split at \\n and compared as they stand; lines without a word stay. Null texts stay null, a text
    whose every line goes becomes empty, and no row is dropped. Of repeated rows, each that ties for a line's
    first place keeps it. An empty table gives no rows. Columns named n_lines or n_removed are replaced.

    Lines on a large share of all places come by broadcast, so that no task gets all places of one line. Texts
    cross one shuffle, as arrays of lines: after it, taking the lines that stay is linear in the text.
    """
    kept = [f"`{c}`" for c in docs.columns if c not in ("n_lines", "n_removed")]
    lines = cut(line_rows(docs, site))
    bad = cut(boilerplate(lines, min_sites, lg_k))
    met = joined_hot(lines, bad, "n", {"h1": "h1", "h2": "h2"}, ["first_id", "first_place"], F.xxhash64("k1", "place"))
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("place") == F.col("first_place"))
    gone = met.filter(F.col("first_place").isNotNull() & ~first)
    gone = gone.groupBy("k1", "k2").agg(F.collect_set("place").alias("__gone")).withColumnsRenamed({"k1": "__of1", "k2": "__of2"})
    split = docs.select(*[c for c in kept if c != "`text`"], F.split("text", "\n", -1).alias("__lines"), *row_keys("__"))
    whole = split.join(gone, (F.col("__k1") == F.col("__of1")) & (F.col("__k2") == F.col("__of2")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))  # by hashing, in order
    left = F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(F.transform(stay, lambda i: F.get("__lines", i)))
    n_lines = F.size(F.filter("__lines", lambda x: x.rlike(WORD)))
    return whole.select(
        *[F.array_join(left, "\n").alias("text") if c == "`text`" else F.col(c) for c in kept],
        F.when(F.col("__lines").isNull(), F.lit(0)).otherwise(n_lines).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
