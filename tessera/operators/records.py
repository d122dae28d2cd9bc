"""Record transforms of declarative pipelines as Column expressions: filters, field mappings, JSON-style steps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.records import ConfigError

OPERATORS = ("=", "==", "!=", "<>", ">", "<", ">=", "<=", "contains")


def parse_literal(text: str):
    """Integer, else float, else true or false, else the text; ``nan``, ``inf`` and ``1_000`` are texts."""
    if re.fullmatch(r"[+-]?\d+", text, re.ASCII):
        return int(text)
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text, re.ASCII):
        return float(text)
    return {"true": True, "false": False}.get(text, text)


def condition(df: DataFrame, text: str, lenient: bool = False) -> Column:
    """``field operator literal`` as a predicate.

    Types are strict: a number never equals a string, orders hold between numbers only, ``contains`` between
    strings only, and null matches nothing. ``lenient`` compares string columns with number literals as numbers.
    """
    parts = text.split()
    if len(parts) != 3:
        raise ConfigError(f"a condition has three parts: {text!r}")
    name, op, value = parts[0], parts[1], parse_literal(parts[2])
    if op not in OPERATORS:
        raise ConfigError(f"unknown operator {op!r}")
    if name not in df.columns:
        return F.lit(False)
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if lenient and number and isinstance(kind, T.StringType):
        kind, c = T.DoubleType(), c.try_cast("double")
    if isinstance(kind, T.NumericType):
        alike = number
    elif isinstance(kind, T.BooleanType):
        alike = isinstance(value, bool)
    else:
        alike = isinstance(kind, T.StringType) and isinstance(value, str)
    if op == "contains":
        return c.contains(value) if alike and isinstance(value, str) else F.lit(False)
    if op in ("=", "=="):
        return c == F.lit(value) if alike else F.lit(False)
    if op in ("!=", "<>"):
        return c != F.lit(value) if alike else c.isNotNull()
    if not (alike and number):
        return F.lit(False)
    return {">": c > value, "<": c < value, ">=": c >= value, "<=": c <= value}[op]


def filter_records(df: DataFrame, text: str, lenient: bool = False) -> DataFrame:
    return df.filter(condition(df, text, lenient))


def filter_fields(df: DataFrame, text: str, fields: str = "fields") -> DataFrame:
    """Rows whose map ``fields``, or else whose column of that name, holds ``field=value``; a text of another form keeps all."""
    name, equals, value = text.partition("=")
    if not equals or not name.strip():
        return df
    name = name.strip()
    found = F.try_element_at(F.col(fields), F.lit(name))
    if name in df.columns and name != fields:
        found = F.coalesce(found, F.col(f"`{name}`").cast("string"))
    return df.filter(found == value.strip())


def transform_expression(df: DataFrame, source: str, transform: str | None) -> Column:
    """Column of one mapping: to_uppercase(), to_lowercase(), multiply(n), divide(n), concat(s) or prefix(s);
    values of other types, and unknown transforms, stay as they are."""
    c, kind = F.col(f"`{source}`"), df.schema[source].dataType
    found = re.fullmatch(r"(?:value\.)?(\w+)\((.*)\)", (transform or "").strip())
    if not found:
        return c
    name, argument = found[1], found[2].strip().strip("\"'")
    if isinstance(kind, T.StringType):
        if name in ("to_uppercase", "to_lowercase"):
            return F.upper(c) if name == "to_uppercase" else F.lower(c)
        if name in ("concat", "prefix"):
            return F.concat(c, F.lit(argument)) if name == "concat" else F.concat(F.lit(argument), c)
    if isinstance(kind, T.NumericType) and name in ("multiply", "divide"):
        n = parse_literal(argument)
        if isinstance(n, (str, bool)):
            return c
        n = float(n)
        if name == "multiply":
            return c.cast("double") * n
        return c.cast("double") / n if n else c
    return c


def map_records(df: DataFrame, mappings: list[dict], remove_source_fields: bool = False) -> DataFrame:
    """Copy ``source`` to ``target`` through a transform; every mapping sees the input, missing sources are skipped."""
    known = [m for m in mappings if m["source"] in df.columns]
    out = df.withColumns({m.get("target") or m["source"]: transform_expression(df, m["source"], m.get("transform")) for m in known})
    if remove_source_fields:
        targets = {m.get("target") or m["source"] for m in known}
        out = out.drop(*[m["source"] for m in known if m["source"] not in targets])
    return out


def apply_step(df: DataFrame, step: dict) -> DataFrame:
    """One step of a JSON-style transform, by ``op``: rename_field, remove_field, add_field ($NOW: the current time),
    convert_field, format_date, format_field (currency), filter_field."""
    op, field = step["op"], step.get("field")
    c = F.col(f"`{field}`")
    if op == "rename_field":
        return df.withColumnRenamed(field, step["to"])
    if op == "remove_field":
        return df.drop(field)
    if op == "add_field":
        value = F.current_timestamp() if step["value"] == "$NOW" else F.lit(step["value"])
        return df.withColumn(field, value)
    if op == "convert_field":
        kinds = {"float": "double", "int": "int", "long": "bigint", "string": "string", "boolean": "boolean"}
        if step["type"] not in kinds:
            raise ConfigError(f"unknown type {step['type']!r}")
        return df.withColumn(field, c.try_cast(kinds[step["type"]]))
    if op == "format_date":
        return df.withColumn(field, F.date_format(c if isinstance(df.schema[field].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.try_to_timestamp(c, F.lit(step.get("from", "yyyy-MM-dd"))), step["to"]))
    if op == "format_field":
        return df.withColumn(field, F.concat(F.lit(step.get("symbol", "¥")), F.format_number(c.cast("double"), 2)))
    if op == "filter_field":
        return df.filter(c == F.lit(step["equals"]))
    raise ConfigError(f"unknown step {op!r}")


TRANSFORMS = {
    "filter": lambda df, o: filter_records(df, o["condition"], o.get("lenient", False)),
    "map": lambda df, o: map_records(df, o["mappings"], o.get("remove_source_fields", False)),
    "json": lambda df, o: _steps(df, o["steps"]),
    "sql": lambda df, o: df.sparkSession.sql(o["query"], input=df),
}


def _steps(df: DataFrame, steps: list[dict]) -> DataFrame:
    for step in steps:
        df = apply_step(df, step)
    return df


def transform(kind: str):
    if kind not in TRANSFORMS:
        raise ConfigError(f"unknown transform type {kind!r}; known: {', '.join(sorted(TRANSFORMS))}")
    return TRANSFORMS[kind]
