"""The corpus pipeline: documents through quality rules, line dedup, near-dedup, decontamination and mixing.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns a DataFrame, which is
written as Parquet and read again for the next stage. All but the last return the columns of ``documents``; the
last adds how often each document is taken.

In every stage an empty table gives an empty one, extra columns of any name pass through, and null or repeated ids are
allowed. What null and empty texts, ties and repeated rows become is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import decontam, linededup, mixing, rules, simhash
from tessera.llm.common import new_folder, shielded, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects: null and empty texts go, having no words; repeated rows are judged alike."""
    return rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without cross-site boilerplate lines; ``n_chars``, if there, follows the text.

    No row goes: null texts stay null, a text whose every line goes is empty. Of repeated rows, each that ties for a
    line's first place keeps it.
    """
    plain, restored = shielded(docs, ["n_lines", "n_removed"])
    cleaned = linededup.remove_boilerplate(plain)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return restored(cleaned)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of smallest doc_id, of ties and equal rows one of them.

    Null and empty texts are near-duplicates of each other.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of the benchmark; those that are mostly such passages go.

    Null and empty texts stay as they are; repeated rows are cut alike.
    """
    clean = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with ``copies`` (``copies_taken``, if the documents have a column ``copies``): how often
    each is taken. Those taken no times go, and so do null texts and texts without words, which have no size.

    Equal rows are neighbours in the mix and so differ by one copy at most: the first few of them, in any
    order, get the larger number.
    """
    keys = ["doc_id", "source", "text_hash"]
    mixed = mixing.mix(docs).groupBy(*[F.col(k).alias(f"__{k}") for k in keys])
    mixed = mixed.agg(F.max("copies").alias("__most"), F.count_if(F.col("copies") == F.col("epochs") + 1).alias("__more"), F.min("copies").alias("__least"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.xxhash64("text") == F.col("__text_hash"))
    place = Window.partitionBy(*[f"__{k}" for k in keys]).orderBy("__text_hash")
    taken = F.when(F.row_number().over(place) <= F.col("__more"), F.col("__most")).otherwise(F.col("__least"))
    dealt = docs.join(mixed.filter("__most > 0"), same).withColumn("__copies", taken).filter("__copies > 0")
    name = "copies_taken" if "copies" in docs.columns else "copies"
    return dealt.select([f"`{c}`" for c in docs.columns if c != name] + [F.col("__copies").alias(name)])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: XXH64 fingerprints and the automaton have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the stages' results lie in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
