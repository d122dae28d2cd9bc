"""Tables: import, export, create-as, catalogue, and names, SQL or frames as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resolve(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    """A frame as it is, a query (it has a blank or a parenthesis) by ``spark.sql``, anything else as a table name."""
    if isinstance(source, DataFrame):
        return source
    return spark.sql(source) if any(c in source.strip() for c in " ()\n\t") else spark.table(source)


def query(spark: SparkSession, sql: str, args: list | dict | None = None) -> DataFrame:
    """SQL with ``?`` (list) or ``:name`` (dict) parameters; values are bound, never pasted."""
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def import_csv(spark: SparkSession, name: str, path: str, header: bool = True, schema: str | None = None, **options) -> DataFrame:
    """CSV as the view ``name``; without a ``schema`` types are inferred, which reads the file twice."""
    reader = spark.read.options(header=header, **options)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    df.createOrReplaceTempView(name)
    return df


def import_parquet(spark: SparkSession, name: str, *paths: str) -> DataFrame:
    df = spark.read.parquet(*paths)
    df.createOrReplaceTempView(name)
    return df


def import_json(spark: SparkSession, name: str, path: str, schema: str | None = None) -> DataFrame:
    df = (spark.read.schema(schema) if schema else spark.read).json(path)
    df.createOrReplaceTempView(name)
    return df


def export_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite", **options) -> None:
    df.write.mode(mode).options(header=header, **options).csv(path)


def export_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    df.write.mode(mode).parquet(path, partitionBy=partition_by)


def create_table_as(spark: SparkSession, name: str, source: DataFrame | str, managed: bool = False) -> DataFrame:
    """View (or managed table) ``name`` of a source, replaced if it exists."""
    df = resolve(spark, source)
    if managed:
        df.write.mode("overwrite").saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)
    return spark.table(name)


def create_table(spark: SparkSession, name: str, columns: str) -> DataFrame:
    """An empty view ``name`` with the DDL ``columns``, unless there is one."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], columns).createOrReplaceTempView(name)
    return spark.table(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def describe(spark: SparkSession, name: str) -> list[dict]:
    """Name, type and nullability of each column."""
    return [{"name": c.name, "type": c.dataType, "nullable": c.nullable} for c in spark.catalog.listColumns(name)]


def analyze(spark: SparkSession, name: str, columns: bool = True) -> None:
    """Statistics of a managed table, also of its columns, for Spark's cost-based choices."""
    spark.sql("ANALYZE TABLE IDENTIFIER(:name) COMPUTE STATISTICS" + " FOR ALL COLUMNS" * columns, {"name": name})


def select_tables(spark: SparkSession, include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Tables to work on: all but system ones (leading underscore) and ``exclude``; of ``include`` only, if given."""
    names = {t.name for t in spark.catalog.listTables() if not t.name.startswith("_")}
    return sorted((names & set(include) if include else names) - set(exclude or ()))


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object per row, in the column ``value``."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
