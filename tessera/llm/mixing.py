"""Mixing sources to target weights: Efraimidis-Spirakis sampling up to token budgets, in DataFrame operations only.

Each document draws the key ``-ln(u) / weight``: taking documents by ascending key is weighted sampling
without replacement. A source whose target is above its size first gives whole epochs; the rest of its target
is filled by the documents of lowest key.

The running token counts never sort a whole source in one task: rows are dealt into buckets of their key's
logarithm, bucket totals are aggregated and prefix-summed (a row per source and bucket), and rows are sorted only
within their (source, bucket). ``ln(key)`` is Gumbel noise less ``ln(weight)``, whose density is 1/e at most, so that
no bucket gets more than a share of ``1 / (e * buckets)`` of a source, whatever the weights are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Characters that lower a document's weight.
SYMBOLS = "#*$%&|<>!"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.005 and 1: lower for texts with many symbols, and for very short ones."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    symbols = chars - F.length(F.translate(text, SYMBOLS, ""))
    clean = F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(5.0) * symbols / F.greatest(chars, F.lit(1)))
    return clean * F.least(F.lit(1.0), (size + F.lit(6)) / F.lit(60.0))


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """In (0, 1), from the first 48 bits of an MD5 of seed, id and text, so that reruns agree and only equal rows tie."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(named.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Target words of each source; ``sizes`` has a row per source: source, source_size.

    Sources in code-point order, null last, get ``weights`` in turn. No target is above ``max_epochs`` times
    the source's size; what that cuts off goes to the other sources by weight. With sources sorted by
    cap / weight, those at their cap are the first few, so running sums give the common level at once. One
    row per source: the two windows without partitions hold no more than that.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    capped = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"))
    level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    # The level if all sources before this one are at their caps and this one and the later ones are not.
    at = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    held = F.when(at <= F.col("cap") / F.col("w"), at)
    return (
        capped.withColumn("held", held)
        .withColumn("level", F.min_by("held", F.when(F.col("held").isNotNull(), F.col("cap") / F.col("w"))).over(Window.partitionBy(F.lit(1))))
        .select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("w") * F.col("level")), F.col("cap")).alias("target"))
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.0,
    max_epochs: int = 3,
    quality: Column | None = None,
    buckets: int = 1024,
    seed: int = 17,
) -> DataFrame:
    """How often each row of ``docs`` (doc_id, text, source) is taken: the columns doc_id, source, size, source_size,
    target, epochs (whole ones), copies, taken, text_hash.

    ``share`` of all words is dealt to the sources by ``weights``; ``quality`` is a column of positive document
    weights; ``buckets`` is how many an interval of 1 of ``ln(key)`` has. Whole documents are taken: the one at the boundary only if that brings its source nearer to its
    target. Null texts have size 0 and are never counted; null sources form one source; repeated rows are
    rows of their own (same key, so neighbours), and rows that share an id, or have none, are spread by their texts; an empty table gives no rows; other columns are ignored.
    """
    size = word_count(F.col("text"))
    sized = docs.select("doc_id", "source", size.alias("size"), (quality_weight(F.col("text"), size) if quality is None else quality).alias("weight"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"), F.xxhash64("text").alias("text_hash"))
    key = -F.log("u") / F.col("weight")
    keyed = cut(
        sized.withColumn("key", key)
        .withColumn("bucket", F.floor(F.ln("key") * buckets).cast("int"))
        .withColumn("place", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source"))))
        .drop("weight", "u")
    )
    dealt = keyed.groupBy("place", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("in_bucket"))
    dealt = dealt.withColumn("before", F.sum("in_bucket").over(Window.partitionBy("place").orderBy("bucket")) - F.col("in_bucket"))
    targets = source_targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    targets = targets.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    dealt = dealt.join(targets, dealt["source"].eqNullSafe(targets["source"])).select("place", "bucket", "before", "source_size", "target", "epochs", "rest")
    running = F.col("before") + F.sum("size").over(Window.partitionBy("place", "bucket").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0))
    chosen = (2 * F.col("running") - F.col("size") <= 2 * F.col("rest")) & (F.col("size") > 0)
    return (
        keyed.join(dealt, ["place", "bucket"])
        .withColumn("running", running)
        .withColumn("copies", F.col("epochs") + chosen.cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "epochs", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_hash")
    )
