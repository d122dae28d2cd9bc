"""Secret scans over an incremental blob ledger, in DataFrame and SQL operations only.

A blob is one content of a text, named by its SHA-256, however many paths (rows) and versions hold it. The
ledger has a row for each (blob, rule, version of the rule) that was ever scanned, with the spans found. A
scan reads only the blobs that lack a current pair, once each, for the missing rules only, and findings are
joined back to every path.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import cut, new_folder


@dataclass(frozen=True)
class SecretRule:
    """Matches of ``pattern``, leftmost and not overlapping; those whose ``group`` has fewer than ``least``
    characters are dropped. ``hint`` is a cheaper pattern that every text with a match has."""

    name: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1
    hint: str | None = None

    @property
    def key(self) -> str:
        return f"{self.name}:{self.version}"


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The three base rules come first; the others add spans. A run of hex digits or of access-key characters is
#: matched as a whole, so its least length can stand in the pattern.
RULES = (
    SecretRule("assign", ASSIGN, group=2, least=6, hint=r"""[dDtTnNyY]["']?\x20*[:=]"""),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}", least=20, hint="AKIA"),
    SecretRule("hex", r"[0-9a-f]{24,}", least=24),
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY"),
    SecretRule("forge_token", r"gh[oprsu]_[A-Za-z0-9]{36,}", hint="gh[oprsu]_"),
)
BASE = RULES[:3]
SPANS = "array<struct<start:int,end:int>>"


#: Matches whose places are summed up in one go.
CHUNK = 256


def _bound(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once: a lambda's variable holds it."""
    return F.transform(F.array(value), use)[0]


def spans(text: Column, rule: SecretRule) -> Column:
    """Spans of a rule's matches in code points, end exclusive: the pieces between matches and the matches
    themselves, by their running lengths, give every place.

    Matches are taken in chunks: the chunks' lengths are summed up first, then places within each chunk from
    where it begins, so that the work grows with the matches and not with their square.
    """
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else None
    pieces = F.split(text, rule.pattern, -1)
    shape = lambda gap, hit, of: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"), F.length(of).alias("kept"))
    if kept is None:
        parts = _bound(hits, lambda h: F.zip_with(F.slice(pieces, 1, F.size(h)), h, lambda gap, m: shape(gap, m, m)))
    else:
        parts = _bound(F.arrays_zip(hits.alias("hit"), kept.alias("kept")), lambda h: F.zip_with(F.slice(pieces, 1, F.size(h)), h, lambda gap, m: shape(gap, m["hit"], m["kept"])))
    none, no_int = F.expr(f"CAST(array() AS {SPANS})"), F.expr("CAST(array() AS array<int>)")

    def placed(chunk: Column, begin: Column) -> Column:
        """Spans of one chunk of parts."""

        def step(state: Column, part: Column) -> Column:
            at = state["at"] + part["gap"]
            span = F.array(F.struct(at.alias("start"), (at + part["hit"]).alias("end")))
            return F.struct((at + part["hit"]).alias("at"), F.when(part["kept"] >= rule.least, F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

        return F.aggregate(chunk, F.struct(begin.alias("at"), none.alias("found")), step, lambda s: s["found"])

    def of_chunks(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["gap"] + x["hit"]))
        begins = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), no_int.alias("all")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
        return F.flatten(F.zip_with(chunks, begins, placed))

    def chunked(p: Column) -> Column:
        starts = F.when(F.size(p) > 0, F.sequence(F.lit(1), F.size(p), F.lit(CHUNK)))
        return F.transform(starts, lambda at: F.slice(p, at, F.lit(CHUNK)))

    found = F.coalesce(_bound(_bound(parts, chunked), of_chunks), none)
    return F.when(text.rlike(rule.hint or rule.pattern), found).otherwise(none)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"blob binary, rule string, spans {SPANS}").parquet(folder)
    except AnalysisException:
        return None


def scan(docs: DataFrame, ledger: str, rules: Iterable[SecretRule] = RULES) -> None:
    """Bring the ledger in the folder ``ledger`` up to date with ``docs`` (doc_id, text); null texts are empty.

    A scan that fails leaves the ledger as it was: Spark commits the new rows as a whole. Rows of the same
    content are scanned once, at the row of smallest id (all null ids: at each of those rows, kept once).
    """
    spark, rules = docs.sparkSession, list(rules)
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    blobs = named.groupBy("blob").agg(F.min("doc_id").alias("at"))
    seen = read_ledger(spark, ledger)
    if seen is None:
        pending = blobs.withColumn("missing", wanted)
    else:
        done = seen.groupBy("blob").agg(F.collect_set("rule").alias("done"))
        pending = blobs.join(done, "blob", "left").withColumn("missing", F.array_except(wanted, F.coalesce("done", F.expr("CAST(array() AS array<string>)")))).filter(F.size("missing") > 0)
    pending = pending.select(F.col("blob").alias("want"), "at", "missing")
    texts = named.join(pending, (F.col("blob") == F.col("want")) & F.col("doc_id").eqNullSafe(F.col("at")))
    scanned = F.array(*[F.when(F.array_contains("missing", r.key), F.struct(F.lit(r.key).alias("rule"), spans(F.col("text"), r).alias("spans"))) for r in rules])
    found = texts.select("blob", F.explode(F.filter(scanned, lambda x: x.isNotNull())).alias("f")).select("blob", "f.rule", "f.spans")
    found.write.mode("append").parquet(ledger)


def findings(docs: DataFrame, ledger: str, rules: Iterable[SecretRule] = RULES) -> DataFrame:
    """doc_id and ``found`` (rule index, start, end; by start, then rule) per row of ``docs``, from the ledger."""
    rules = list(rules)
    place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)])
    current = read_ledger(docs.sparkSession, ledger).filter(F.col("rule").isin([r.key for r in rules])).filter(F.size("spans") > 0)
    # Several scans or equal rows may have left a pair twice; as a set, its spans count once. As a table of its own,
    # it lets Spark split a blob that very many rows have.
    of_blob = current.withColumn("s", F.explode("spans")).groupBy(F.col("blob").alias("has")).agg(
        F.sort_array(F.collect_set(F.struct(F.col("s.start").alias("start"), place[F.col("rule")].alias("rule"), F.col("s.end").alias("end")))).alias("found")
    )
    named = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob"))
    none = F.expr("CAST(array() AS array<struct<start:int,rule:int,end:int>>)")
    return named.join(cut(of_blob).hint("merge"), F.col("blob") == F.col("has"), "left").select("doc_id", F.coalesce("found", none).alias("found"))


def span_text(found: Column, rules: Iterable[SecretRule] = RULES) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["rule"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, ledger: str | None = None, rules: Iterable[SecretRule] = RULES) -> DataFrame:
    """doc_id, found per row of ``docs``: scan what ``ledger`` (default: a new one in the shared folder) lacks, join back.

    Null and empty texts have no findings; repeated rows each get theirs; an empty table gives no rows; other
    columns are ignored.
    """
    ledger = ledger or new_folder(docs.sparkSession, "secrets")
    scan(docs, ledger, rules)
    return findings(docs, ledger, rules)
