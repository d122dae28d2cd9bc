"""Session factory and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings that the operators assume; a cluster's own sizing (partitions, memory) is left to its configuration.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app_name: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """Active or new session in UTC with adaptive execution; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a directory of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
