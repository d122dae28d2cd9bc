"""Collections of vectors as versioned tables: upsert, delete, lookup, exact and filtered search, export."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import METRICS
from tessera.operators import search
from tessera.operators.sync import commit_version, delete_rows, read_version, upsert


def metadata_pairs(df: DataFrame, id_col: str, metadata: str) -> DataFrame:
    """A row per top-level key of the JSON objects: id, key, value, value_numeric (null for texts)."""
    pairs = df.select(id_col, F.explode(F.from_json(metadata, "map<string,string>")).alias("key", "value"))
    return pairs.withColumn("value_numeric", F.col("value").try_cast("double"))


def with_metadata(df: DataFrame, pairs: DataFrame, id_col: str, wanted: dict) -> DataFrame:
    """Rows of ``df`` that have all ``wanted`` pairs: a semi join per value, an anti join per None (key absent)."""
    for key, value in wanted.items():
        own = pairs.filter(F.col("key") == key)
        if value is None:
            df = df.join(own.select(id_col), id_col, "left_anti")
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            df = df.join(own.filter(F.col("value_numeric") == float(value)).select(id_col), id_col, "left_semi")
        else:
            df = df.join(own.filter(F.col("value") == str(value)).select(id_col), id_col, "left_semi")
    return df


class VectorStore:
    """A collection in ``folder``; rows: id string, vector array<float>, metadata string (JSON).

    Every change writes a version of the table, so readers never see half of one.
    """

    SCHEMA = "id string, vector array<float>, metadata string"
    #: Kinds of index: those that are searched exactly, and those whose rows are partitioned by their nearest centre.
    #: No graph and no code book is built for ``APPROXIMATE`` kinds: they are searched exactly, too, with a warning.
    EXACT, CLUSTERED, APPROXIMATE = ("flat",), ("ivf", "partitioned"), ("hnsw", "pq", "sq")

    def __init__(self, spark: SparkSession, folder: str, dimension: int, metric: str = "cosine"):
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        self.spark, self.folder, self.dimension, self.metric = spark, folder, dimension, metric
        self.centers: list[list[float]] | None = None

    def rows(self) -> DataFrame:
        found = read_version(self.spark, self.folder)
        return self.spark.createDataFrame([], self.SCHEMA) if found is None else found

    def add(self, new: DataFrame, order: str | None = None) -> None:
        """Insert, or replace rows of the same id; of repeated new ids the last by ``order``. A wrong dimension fails the write."""
        fits = F.when(F.size("vector") == self.dimension, F.col("vector")).otherwise(F.raise_error(F.lit(f"vectors must have dimension {self.dimension}")).cast("array<float>"))
        commit_version(upsert(self.rows(), new.withColumn("vector", fits), ["id"], order), self.folder)
        self.drop_index()

    def delete(self, ids: Iterable[str] | DataFrame) -> None:
        """Remove the rows of ``ids``, a frame with a column id or a few ids."""
        gone = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        commit_version(delete_rows(self.rows(), gone, ["id"]), self.folder)
        self.drop_index()

    def create_index(self, kind: str = "flat", clusters: int = 100, **fit) -> None:
        """Index the rows as they are now; a later change of the collection drops the index."""
        if kind not in self.EXACT + self.CLUSTERED + self.APPROXIMATE:
            raise ValueError(f"unknown index {kind!r}; known: {', '.join(self.EXACT + self.CLUSTERED + self.APPROXIMATE)}")
        if kind in self.APPROXIMATE:
            warnings.warn(f"no {kind} index is built: searches stay exact, over all rows", stacklevel=2)
        self.centers = search.build_index(self.rows(), f"{self.folder}_index", clusters, **fit) if kind in self.CLUSTERED else None

    def drop_index(self) -> None:
        """Search all rows from now on; the folder of an index stays until the next one replaces it."""
        self.centers = None

    def get(self, id_: str) -> DataFrame:
        return self.rows().filter(F.col("id") == id_)

    def count(self) -> int:
        return self.rows().count()

    def search(self, query: Sequence[float], k: int, where: Column | str | None = None, metric: str | None = None, probes: int | None = None) -> DataFrame:
        """The nearest ``k`` rows of all; with a clustered index and ``probes``, of that many nearest clusters."""
        if len(query) != self.dimension:
            raise ValueError(f"the query has dimension {len(query)}, the collection {self.dimension}")
        if self.centers:
            return search.search_index(self.spark, f"{self.folder}_index", self.centers, query, k, probes, metric=metric or self.metric, where=where).drop("cluster")
        return search.search(self.rows(), query, k, metric or self.metric, where=where)
