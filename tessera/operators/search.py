"""Vector search: exact, filtered, per group, and over a cluster-partitioned index."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors as V


def search(df: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", id_col: str = "id", vector: str = "vector", where: Column | str | None = None, normalize: bool = False) -> DataFrame:
    """The ``k`` rows nearest to ``query`` with similarity and distance, nearest first, ties by id.

    ``where`` filters before the search, so the result is exact. ``normalize`` compares unit vectors. The plan
    is a TakeOrderedAndProject: each task keeps ``k`` rows.
    """
    found = df if where is None else df.filter(where)
    a, b = F.col(vector), V.literal(query)
    if normalize:
        a, b = V.normalize(a), V.normalize(b)
    # Each row's vector is gone through once per metric: similarity and distance follow from one another.
    if metric in ("cosine", "dot"):
        size = None if normalize else F.lit(math.sqrt(_squares(query)))
        scored = found.withColumn("similarity", V.cosine(a, b, size) if metric == "cosine" else V.dot(a, b))
        scored = scored.withColumn("distance", 1 - F.col("similarity") if metric == "cosine" else -F.col("similarity"))
    else:
        scored = found.withColumn("distance", V.distance(metric, a, b))
        scored = scored.withColumn("similarity", 1 / (1 + F.col("distance"))).select(*[f"`{c}`" for c in found.columns], "similarity", "distance")
    return scored.orderBy(F.desc_nulls_last("similarity"), id_col).limit(k)


def _squares(query: Sequence[float]) -> float:
    total = 0.0
    for x in query:
        total += float(x) * float(x)
    return total


def _chunks(df: DataFrame, id_col: str, vector: str, most: int) -> DataFrame:
    """Rows of ``df`` packed ``most`` to a row: ids in order, whether each has a vector, their dimension, and the vectors as doubles."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(df.schema[id_col].dataType)), *[T.StructField(n, T.BinaryType()) for n in ("has", "data")], T.StructField("size", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                part = part.take(pc.sort_indices(part.column(0), null_placement="at_start"))
                ids, vectors = part.column(0), part.column(1)
                flat = vectors.flatten().cast(pa.float64())
                sizes = {n for n in pc.list_value_length(vectors).to_pylist() if n is not None}
                if len(sizes) > 1:
                    raise ValueError("vectors differ in dimension")
                if flat.null_count:
                    raise ValueError("vectors have null components")
                has = np.asarray(vectors.is_valid().to_numpy(zero_copy_only=False), bool)
                size = sizes.pop() if sizes else -1
                offsets = pa.array([0, len(ids)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, ids), pa.array([has.tobytes()], pa.binary()), pa.array([flat.to_numpy(zero_copy_only=False).tobytes()], pa.binary()), pa.array([size], pa.int64())], names=["ids", "has", "data", "size"])

    return df.select(id_col, vector).mapInArrow(run, schema)


def search_all(df: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vector: str = "vector", query_id: str = "query_id", query_vector: str = "vector", block: int = 256) -> DataFrame:
    """The ``k`` rows nearest to each row of ``queries``: query_id, ``id_col``, similarity, distance, rank; ties by id, as ``search``.

    Ids of queries are unique; queries without a vector have no neighbours. ``block`` queries meet ``block`` rows at a
    time, and each task keeps ``k`` rows per query before the shuffle. Sums go component by component as those of
    ``vectors`` do, so that equal vectors have equal similarities wherever they lie.
    """
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(V.METRICS)}")
    spark = df.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("v")).filter("v IS NOT NULL").coalesce(tasks)
    left = _chunks(asked, "q", "v", block).withColumnsRenamed({"ids": "qs", "data": "query", "size": "query_size"}).drop("has")
    right = _chunks(df.select(id_col, vector).repartition(4 * tasks), id_col, vector, block)
    pairs = right.crossJoin(left).select("ids", "has", "data", "size", "qs", "query", "query_size")
    schema = T.StructType([T.StructField("q", queries.schema[query_id].dataType), T.StructField("i", df.schema[id_col].dataType), *[T.StructField(n, T.DoubleType()) for n in ("similarity", "distance", "key")]])
    names = schema.fieldNames()

    def scores(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros((len(b), len(a)))
        for x, y in zip(a.T, b.T, strict=True):
            if metric in ("cosine", "dot"):
                total += x[None, :] * y[:, None]
            else:
                gap = x[None, :] - y[:, None]
                total += np.abs(gap) if metric == "manhattan" else gap * gap
        if metric == "dot":
            return total, -total
        if metric == "cosine":
            squares = [np.zeros(len(v)) for v in (a, b)]
            for square, v in zip(squares, (a, b), strict=True):
                for x in v.T:
                    square += x * x
            norms = np.sqrt(squares[0])[None, :] * np.sqrt(squares[1])[:, None]
            near = np.divide(total, norms, out=np.zeros_like(total), where=norms != 0)
            return near, 1 - near
        far = np.sqrt(total) if metric == "euclidean" else total
        return 1 / (1 + far), far

    def best(found: pa.Table) -> pa.Table:
        """The first ``k`` rows of each query."""
        found = found.combine_chunks()
        codes = pc.dictionary_encode(found["q"].combine_chunks(), null_encoding="encode").indices
        order = pc.sort_indices(pa.table({"c": codes, "k": found["key"], "i": found["i"]}), [("c", "ascending"), ("k", "ascending"), ("i", "ascending")], null_placement="at_start")
        c = codes.take(order).to_numpy()
        first = np.searchsorted(c, c)
        return found.take(order.filter(pa.array(np.arange(len(c)) - first < k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for n in range(batch.num_rows):
                ids, has, data, size, qs, query, query_size = (batch.column(j)[n] for j in range(7))
                ids, qs, has = ids.values, qs.values, np.frombuffer(has.as_py(), bool)
                if size.as_py() not in (-1, query_size.as_py()):
                    raise ValueError("vectors differ in dimension")
                b = np.frombuffer(query.as_py()).reshape(len(qs), -1)
                near, far = np.full((len(qs), len(ids)), np.nan), np.full((len(qs), len(ids)), np.nan)
                near[:, has], far[:, has] = scores(np.frombuffer(data.as_py()).reshape(int(has.sum()), b.shape[1]), b)
                # As Spark's order: NaN first, rows without a vector last; ids are in order, so a stable sort settles ties.
                key = np.where(np.isnan(near), -np.inf, -near)
                key[:, ~has] = np.inf
                at = np.argsort(key, axis=1, kind="stable")[:, :k]
                take = lambda x: np.take_along_axis(x, at, 1).ravel()  # noqa: B023, E731
                none = ~has[at.ravel()]
                held.append(pa.RecordBatch.from_arrays([qs.take(pa.array(np.repeat(np.arange(len(qs)), at.shape[1]))), ids.take(pa.array(at.ravel())), pa.array(take(near), mask=none), pa.array(take(far), mask=none), pa.array(take(key))], names=names))
                rows += held[-1].num_rows
                if rows > 500_000:
                    kept = best(pa.Table.from_batches(held))
                    held, rows = kept.to_batches(), kept.num_rows
                    if rows > 250_000:
                        yield from held
                        held, rows = [], 0
        if held:
            yield from best(pa.Table.from_batches(held)).to_batches()

    place = Window.partitionBy("q").orderBy(F.desc_nulls_last("similarity"), "i")
    ranked = pairs.mapInArrow(run, schema).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("i").alias(id_col), "similarity", "distance", "rank")


def nearest_per_group(df: DataFrame, query: Sequence[float], k: int, group: str, metric: str = "cosine", id_col: str = "id", vector: str = "vector") -> DataFrame:
    """The ``k`` nearest rows of each group. Spark turns the rank limit into a limit per task before the shuffle."""
    scored = df.withColumn("similarity", V.similarity(metric, F.col(vector), V.literal(query)))
    place = Window.partitionBy(group).orderBy(F.desc_nulls_last("similarity"), id_col)
    return scored.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def centroids(df: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """Component-wise mean of each group: group, position, mean. Aggregates before the shuffle."""
    return df.select(group, F.posexplode(vector).alias("position", "x")).groupBy(group, "position").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centroid_vectors(df: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    parts = centroids(df, group, vector).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("position", "mean"))).alias("parts"))
    return parts.select(group, F.transform("parts", lambda p: p["mean"]).alias("centroid"))


def nearest_centroid(vector: Column, centers: list[Sequence[float]]) -> Column:
    """Number of the nearest of the ``centers``, ties to the lower number."""
    distances = F.array(*[F.struct(V.squared_euclidean(vector, V.literal(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centers)])
    return F.array_min(distances)["i"]


def fit_centers(df: DataFrame, clusters: int, vector: str = "vector", rounds: int = 5, sample_rows: int = 20_000, seed: int = 1) -> list[list[float]]:
    """k-means centres, at most ``clusters``, from a sample of ``sample_rows`` rows at most; every row is indexed with them."""
    rows = df.select(vector).filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.to_json(vector), F.lit(seed))).limit(sample_rows).persist()
    try:
        centers = [[float(x) for x in r[0]] for r in rows.distinct().orderBy(F.xxhash64(F.to_json(vector), F.lit(seed + 1))).limit(clusters).collect()]
        for _ in range(rounds if centers else 0):
            found = centroid_vectors(rows.withColumn("cluster", nearest_centroid(F.col(vector), centers)), "cluster", vector).orderBy("cluster").collect()
            new = [r["centroid"] for r in found]
            if new == centers:
                break
            centers = new
    finally:
        rows.unpersist()
    return centers


class Centers(list):
    """Centres of an index; ``bounds`` has of each cluster how far its rows go: r2 and r1 (Euclidean and Manhattan distance from
    the centre), angle from the centre, and whether it has zero vectors."""

    bounds: dict[int, dict]


def build_index(df: DataFrame, folder: str, clusters: int = 16, vector: str = "vector", **fit) -> Centers:
    """Write ``df`` partitioned by its nearest centre; return the centres with the bounds of their clusters."""
    centers = Centers(fit_centers(df, clusters, vector, **fit))
    cluster = nearest_centroid(F.col(vector), centers) if centers else F.lit(0)
    df.withColumn("cluster", F.coalesce(cluster, F.lit(-1))).write.mode("overwrite").partitionBy("cluster").parquet(folder)
    centers.bounds = {}
    if centers:
        spark = df.sparkSession
        own = F.broadcast(spark.createDataFrame(list(enumerate(centers)), "cluster int, __center array<double>"))
        a, c = F.col(vector), F.col("__center")
        cosine = F.least(F.greatest(V.cosine(a, c), F.lit(-1.0)), F.lit(1.0))
        found = spark.read.parquet(folder).filter("cluster >= 0").join(own, "cluster").groupBy("cluster")
        found = found.agg(F.max(V.euclidean(a, c)).alias("r2"), F.max(V.manhattan(a, c)).alias("r1"), F.max(F.acos(cosine)).alias("angle"), F.max(V.norm(a) == 0).alias("zero"))
        centers.bounds = {r["cluster"]: r.asDict() for r in found.collect()}
    return centers


def nearest_possible(metric: str, query: Sequence[float], center: Sequence[float], bound: dict) -> float:
    """No row of the cluster has a higher similarity to ``query``; a little more, for rounding."""
    q, c = np.array(query, float), np.array(center, float)
    size = float(np.linalg.norm(q))
    if metric == "cosine":
        if not size or not np.linalg.norm(c):
            return math.inf
        apart = math.acos(min(1.0, max(-1.0, float(q @ c) / (size * float(np.linalg.norm(c)))))) - bound["angle"]
        most = math.cos(max(0.0, apart))
        return (max(most, 0.0) if bound["zero"] else most) + 1e-6
    if metric == "dot":
        reach = size * bound["r2"]
        return float(q @ c) + reach + 1e-9 * (1 + abs(float(q @ c)) + reach)
    far, reach = (float(np.linalg.norm(q - c)), bound["r2"]) if metric == "euclidean" else (float(np.abs(q - c).sum()), bound["r1"])
    return 1 / (1 + max(0.0, far - reach - 1e-9 * (1 + far + reach)))


def search_index(spark: SparkSession, folder: str, centers: list[list[float]], query: Sequence[float], k: int, probes: int | None = None, metric: str = "cosine", normalize: bool = False, **options) -> DataFrame:
    """The ``k`` nearest rows of the index, exactly as ``search``; partitions that cannot hold one are not read.

    The cluster nearest to ``query`` gives a k-th best similarity, at once; the search then covers the clusters whose bounds
    allow as much. Without bounds, with ``normalize`` or with fewer than ``k`` rows there, it covers all. With ``probes`` it
    covers that many nearest clusters instead and may miss neighbours.
    """
    order = sorted(range(len(centers)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(query, centers[i], strict=True)), i))
    rows = spark.read.parquet(folder)
    options |= {"metric": metric, "normalize": normalize}
    if probes is not None:
        return search(rows.filter(F.col("cluster").isin(order[:probes])), query, k, **options)
    bounds = getattr(centers, "bounds", {})
    if not bounds or normalize:
        return search(rows, query, k, **options)
    first = next(i for i in order if i in bounds)
    n, worst = search(rows.filter(F.col("cluster") == first), query, k, **options).agg(F.count("similarity"), F.min("similarity")).first()
    if n < k or worst is None:
        return search(rows, query, k, **options)
    # A bound that is not a number excludes nothing.
    wanted = [i for i in order if i in bounds and not nearest_possible(metric, query, centers[i], bounds[i]) < worst]
    return search(rows.filter(F.col("cluster").isin(wanted)), query, k, **options)


def upsert_vectors(store: DataFrame, new: DataFrame, id_col: str = "id", order: str | None = None) -> DataFrame:
    """``store`` with ``new`` rows put in place of those of the same id; of repeated new ids the last by ``order``."""
    from tessera.operators.sync import upsert

    return upsert(store, new, [id_col], order)
