"""Record sources and sinks of declarative pipelines, by type name.

A source is ``(spark, options) -> DataFrame``, a sink ``(df, options) -> None``. CSV values stay strings; rows carry
``_source``. Memory sources are frames kept by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.sync import commit_version, read_version, upsert


class ConfigError(ValueError):
    """A pipeline is not well defined."""


MEMORY: dict[str, DataFrame] = {}


def _need(options: dict, key: str):
    if options.get(key) in (None, ""):
        raise ConfigError(f"option {key!r} is required")
    return options[key]


def read_csv(spark: SparkSession, options: dict) -> DataFrame:
    """file_path, delimiter (one character, default a comma), has_header (default true); without it column_0, column_1, ..."""
    path, delimiter = _need(options, "file_path"), options.get("delimiter", ",")
    if len(delimiter) != 1:
        raise ConfigError("delimiter must be one character")
    header = options.get("has_header", True)
    df = spark.read.csv(path, sep=delimiter, header=header, inferSchema=False)
    if not header:
        df = df.toDF(*[f"column_{i}" for i in range(len(df.columns))])
    return df.withColumn("_source", F.lit(f"csv:{path}"))


def read_jdbc(spark: SparkSession, options: dict) -> DataFrame:
    """connection_string (a JDBC URL), query, driver (optional); partition_column with lower, upper and partitions reads in parallel."""
    reader = spark.read.format("jdbc").option("url", _need(options, "connection_string"))
    if options.get("driver"):
        reader = reader.option("driver", options["driver"])
    if options.get("partition_column"):
        reader = reader.options(dbtable=f"({_need(options, 'query')}) q", partitionColumn=options["partition_column"], lowerBound=_need(options, "lower"), upperBound=_need(options, "upper"), numPartitions=options.get("partitions", 8))
    else:
        reader = reader.option("query", _need(options, "query"))
    return reader.load()


def read_memory(spark: SparkSession, options: dict) -> DataFrame:
    """key (default "default"); an absent one is an error if required, else empty."""
    key = options.get("key", "default")
    if key in MEMORY:
        return MEMORY[key]
    if options.get("required"):
        raise ConfigError(f"no frame in memory under {key!r}")
    return spark.createDataFrame([], "value string")


def read_generated(spark: SparkSession, options: dict) -> DataFrame:
    """rows (default 100) of id, name and value, as strings."""
    i = F.col("id").cast("string")
    return spark.range(options.get("rows", 100)).select(i.alias("id"), F.concat(F.lit("name_"), i).alias("name"), (F.col("id") * 10).cast("string").alias("value"))


def read_format(kind: str) -> Callable[[SparkSession, dict], DataFrame]:
    def read(spark: SparkSession, options: dict) -> DataFrame:
        df = spark.read.format(kind).options(**options.get("options", {})).load(_need(options, "file_path"))
        df = df.filter(options["filter"]) if options.get("filter") else df
        df = df.orderBy(*options["sort"]) if options.get("sort") else df
        return df.limit(options["limit"]) if options.get("limit") else df

    return read


def write_csv(df: DataFrame, options: dict) -> None:
    """file_path, delimiter, write_header, append, fields (missing ones are written empty)."""
    fields = options.get("fields") or df.columns
    out = df.select(*[F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields])
    out.write.mode("append" if options.get("append") else "overwrite").csv(_need(options, "file_path"), sep=options.get("delimiter", ","), header=options.get("write_header", True), emptyValue="")


def write_memory(df: DataFrame, options: dict) -> None:
    """key, mode replace (default) or append (by name; missing columns become null)."""
    key = options.get("key", "default")
    if options.get("mode", "replace") == "append" and key in MEMORY:
        df = MEMORY[key].unionByName(df, allowMissingColumns=True)
    MEMORY[key] = df


def write_parquet(df: DataFrame, options: dict) -> None:
    df.write.mode("append" if options.get("append") else "overwrite").parquet(_need(options, "file_path"))


def write_table(df: DataFrame, options: dict) -> None:
    """A versioned table at file_path; mode insert, update (known keys only) or upsert by key_column (default id)."""
    folder, mode, key = _need(options, "file_path"), options.get("mode", "insert"), options.get("key_column", "id")
    if mode not in ("insert", "update", "upsert"):
        raise ConfigError(f"unknown mode {mode!r}")
    target = read_version(df.sparkSession, folder)
    if target is None:
        commit_version(df if mode != "update" else df.limit(0), folder)
    elif mode == "insert":
        commit_version(target.unionByName(df, allowMissingColumns=True), folder)
    else:
        changes = df.filter(F.col(key).isNotNull())
        commit_version(upsert(target, changes.join(target.select(key), key, "left_semi") if mode == "update" else changes, [key]), folder)


def write_jdbc(df: DataFrame, options: dict) -> None:
    writer = df.write.format("jdbc").option("url", _need(options, "connection_string")).option("dbtable", _need(options, "table"))
    if options.get("driver"):
        writer = writer.option("driver", options["driver"])
    writer.mode("append").save()


SOURCES: dict[str, Callable[[SparkSession, dict], DataFrame]] = {"csv": read_csv, "jdbc": read_jdbc, "memory": read_memory, "generated": read_generated} | {k: read_format(k) for k in ("parquet", "json", "orc")}
SINKS: dict[str, Callable[[DataFrame, dict], None]] = {"csv": write_csv, "memory": write_memory, "parquet": write_parquet, "table": write_table, "jdbc": write_jdbc}


def source(kind: str) -> Callable[[SparkSession, dict], DataFrame]:
    if kind not in SOURCES:
        raise ConfigError(f"unknown source type {kind!r}; known: {', '.join(sorted(SOURCES))}")
    return SOURCES[kind]


def sink(kind: str) -> Callable[[DataFrame, dict], None]:
    if kind not in SINKS:
        raise ConfigError(f"unknown sink type {kind!r}; known: {', '.join(sorted(SINKS))}")
    return SINKS[kind]
