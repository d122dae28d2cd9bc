"""The registered queries of the operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_extract, linededup, mixing, oracle, quality_model, rules, secrets, simhash, toxicity, warc
from .common import crc_rest, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, settings = table(spark, sf_dir, "documents"), toxicity.Settings()
    sample = quality_model.labelled(docs, table(spark, sf_dir, "labels"), "toxic", crc_rest(F.col("doc_id")) != 2, settings.max_rows)
    return _scored(toxicity.score(docs.select("doc_id", "text"), toxicity.fit(sample, settings), 0.3))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, settings = table(spark, sf_dir, "documents"), quality_model.Settings()
    sample = quality_model.labelled(docs, table(spark, sf_dir, "labels"), "quality", crc_rest(F.col("doc_id")) != 2, settings.max_rows)
    return _scored(quality_model.score(docs.select("doc_id", "text"), quality_model.fit(sample, settings), 0.7))


def _scored(df: DataFrame) -> DataFrame:
    return df.select("doc_id", (crc_rest(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["rule"] < len(secrets.BASE))
    of_rule = lambda k: F.filter("found", lambda x: x["rule"] == k)
    count = [F.size(of_rule(k)).cast("long").alias(f"n_{r.name}") for k, r in enumerate(secrets.BASE)]
    return found.select("doc_id", *count, F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("found")).alias("spans"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"), measures=True)
    return judged.select("doc_id", *rules.MEASURED, "base_failed", F.col("rejected_by").isNull().alias("kept"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_warc,
        op3_toxicity,
        op4_html_extraction,
        op5_quality_classifier,
        op6_decontamination,
        op7_simhash,
        op8_line_dedup,
        op9_secrets,
        op10_quality_rules,
    )
}
#: The other queries need hashes, automata or trained models that SQL lacks; the tests hold them against brute force.
SQL: dict[str, str] = {
    "op1_mixing": oracle.OP1,
    "op2_warc": oracle.OP2,
    "op6_decontamination": oracle.OP6,
    "op8_line_dedup": oracle.OP8,
    "op9_secrets": oracle.op9(secrets.RULES),
    "op10_quality_rules": oracle.OP10,
}
