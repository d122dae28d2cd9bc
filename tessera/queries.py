"""The registered queries of the core operators, each with SQL of the same result.

Money sums are rounded to 2 digits, means and similarities to 4 to 6, coefficients to 8; limits follow an order
by unrounded value, then id.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import sql
from tessera.functions import vectors as V
from tessera.functions.times import time_bucket
from tessera.operators import analytics, joins, records, search, store, sync
from tessera.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


# Analytics


@registered("""
    WITH s AS (SELECT avg(value) m, stddev_pop(value) sd FROM events)
    SELECT ts AS "timestamp", value, round((value - m) / nullif(sd, 0), 6) AS z_score, 'Anomaly' AS status
    FROM events, s WHERE abs((value - m) / nullif(sd, 0)) > 3""")
def anomaly_zscore(spark, sf_dir):
    return analytics.anomalies(table(spark, sf_dir, "events"), "ts", "value", 3.0).withColumn("z_score", F.round("z_score", 6))


def _bucket(width: str, aggregate: str, source: str, ts: str, value: str) -> Query:
    def run(spark, sf_dir):
        out = analytics.time_series(table(spark, sf_dir, source), ts, value, width, aggregate, digits=2 if aggregate != "count" else None)
        return out.withColumn("time_bucket", F.col("time_bucket").cast("string")) if dict(out.dtypes)["time_bucket"] == "date" else out

    return run


for _name, _width, _aggregate in (("bucket_1week_sum", "1 week", "sum"), ("bucket_6h_avg", "6 hours", "avg"), ("bucket_2day_max", "2 days", "max"), ("bucket_15min_min", "15 minutes", "min")):
    registered(f"SELECT time_bucket(INTERVAL '{_width}', ts) AS time_bucket, round({_aggregate}(value), 2) AS {_aggregate.upper()}_value FROM events GROUP BY 1", _name)(_bucket(_width, _aggregate, "events", "ts", "value"))
registered("SELECT time_bucket(INTERVAL '6 hours', ts) AS time_bucket, count(value) AS COUNT_value FROM events GROUP BY 1", "bucket_6h_count")(_bucket("6 hours", "count", "events", "ts", "value"))
registered("SELECT CAST(CAST(time_bucket(INTERVAL '5 months', o_orderdate) AS DATE) AS VARCHAR) AS time_bucket, count(o_totalprice) AS COUNT_value FROM orders GROUP BY 1", "bucket_5month_count")(_bucket("5 months", "count", "orders", "o_orderdate", "o_totalprice"))
registered("SELECT CAST(CAST(time_bucket(INTERVAL '3 months', o_orderdate) AS DATE) AS VARCHAR) AS time_bucket, round(sum(o_totalprice), 2) AS SUM_value FROM orders GROUP BY 1", "bucket_quarter_sum")(_bucket("1 quarter", "sum", "orders", "o_orderdate", "o_totalprice"))


@registered("SELECT round(coalesce(corr(l_quantity, l_extendedprice), 0), 8) AS correlation FROM lineitem")
def correlation(spark, sf_dir):
    return analytics.correlation(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("correlation", 8).alias("correlation"))


@registered("SELECT CAST(0 AS DOUBLE) AS correlation")
def correlation_constant(spark, sf_dir):
    return analytics.correlation(table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0)), "l_quantity", "one")


def _profile_sql() -> str:
    kinds = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_discount": "double", "l_returnflag": "string"}
    parts = []
    for c, kind in kinds.items():
        number = kind != "string"
        avg, std = (f"round(avg({c}), 4)", f"round(stddev_samp({c}), 4)") if number else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
        parts.append(f"SELECT '{c}' AS column_name, '{kind}' AS column_type, CAST(min({c}) AS VARCHAR) AS \"min\", CAST(max({c}) AS VARCHAR) AS \"max\", count(DISTINCT {c}) AS n_distinct, {avg} AS \"avg\", {std} AS std, count({c}) AS \"count\", 100.0::DOUBLE * (count(*) - count({c})) / greatest(count(*), 1) AS null_percentage FROM lineitem")
    return " UNION ALL ".join(parts)


@registered(_profile_sql())
def profile_lineitem(spark, sf_dir):
    columns = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"]
    return analytics.profile(table(spark, sf_dir, "lineitem"), columns, exact=True, digits=4, quartiles=False)


@registered(
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q25, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS q50, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q75 FROM lineitem" for c in ("l_quantity", "l_discount", "l_linenumber"))
)
def profile_quartiles(spark, sf_dir):
    return analytics.profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_linenumber"], exact=True).select("column_name", "q25", "q50", "q75")


@registered("""
    SELECT event_id, round(avg(value) OVER w, 8) AS rolling_avg FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND CURRENT ROW)""")
def rolling_mean_31(spark, sf_dir):
    return analytics.rolling(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], "value").select("event_id", F.round("rolling_avg", 8).alias("rolling_avg"))


@registered("""
    SELECT event_id, value FROM (SELECT event_id, value, avg(value) OVER w a, stddev_samp(value) OVER w s FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND CURRENT ROW)) WHERE abs(value - a) > 3 * s""")
def rolling_anomaly(spark, sf_dir):
    return analytics.rolling_anomalies(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], "value").select("event_id", "value")


@registered("SELECT count(DISTINCT l_suppkey) AS suppliers, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS median_price FROM lineitem")
def exact_quantile_distinct(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    (q25,), (median,) = (analytics.exact_quantiles(lineitem, [c], [p])[0] for c, p in (("l_quantity", 0.25), ("l_extendedprice", 0.5)))
    return lineitem.agg(F.count_distinct("l_suppkey").alias("suppliers")).withColumns({"q25": F.lit(q25), "median_price": F.lit(median)})


@registered("""
    WITH e AS (SELECT min(l_quantity) lo, max(l_quantity) hi FROM lineitem)
    SELECT CAST(round((l_quantity - lo) / (hi - lo) * 9) AS INT) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1""")
def histogram_qty(spark, sf_dir):
    return analytics.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 10)


@registered("""
    SELECT event_type AS shape, count(*) AS executions, round(sum(value), 2) AS total_ms, min(value) AS min_ms, max(value) AS max_ms, round(avg(value), 4) AS avg_ms,
           round(avg(user_id), 4) AS avg_rows, avg(value) > 40 AS slow FROM events GROUP BY 1""")
def query_stats(spark, sf_dir):
    out = analytics.shape_stats(table(spark, sf_dir, "events"), "event_type", "value", "user_id", slow_ms=40.0)
    return out.withColumns({"total_ms": F.round("total_ms", 2), "avg_ms": F.round("avg_ms", 4), "avg_rows": F.round("avg_rows", 4)})


@registered("SELECT regexp_replace('SELECT a FROM events WHERE event_type = ''' || event_type || ''' AND user_id = ' || user_id, '''[^'']*''|[0-9]', '?', 'g') AS shape, count(*) AS n FROM events GROUP BY 1")
def query_shapes(spark, sf_dir):
    sql = F.format_string("SELECT a FROM events WHERE event_type = '%s' AND user_id = %d", "event_type", "user_id")
    return table(spark, sf_dir, "events").groupBy(analytics.query_shape(sql).alias("shape")).agg(F.count("*").alias("n"))


@registered("""
    WITH a AS (SELECT event_type, avg(value) m FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, avg(value) m FROM events WHERE user_id % 2 = 1 GROUP BY 1)
    SELECT a.event_type, round(a.m, 4) AS avg_a, round(b.m, 4) AS avg_b, round(100 * (b.m - a.m) / a.m, 4) AS difference_percent FROM a JOIN b USING (event_type)""")
def run_comparison(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    out = analytics.compare_runs(events.filter("user_id % 2 = 0"), events.filter("user_id % 2 = 1"), "event_type", "value")
    return out.select("event_type", *[F.round(c, 4).alias(c) for c in ("avg_a", "avg_b", "difference_percent")])


# Vectors


def _query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One row by id: a point lookup."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]


_Q = "WITH q AS (SELECT embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, label, embedding::DOUBLE[] AS a FROM embeddings)"
_SIMILARITY = {
    "cosine": "list_cosine_similarity(a, b)",
    "dot": "list_inner_product(a, b)",
    "euclidean": "1 / (1 + list_distance(a, b))",
    "manhattan": "1 / (1 + list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))))",
}
_DISTANCE = {"cosine": "1 - list_cosine_similarity(a, b)", "dot": "-list_inner_product(a, b)", "euclidean": "list_distance(a, b)", "manhattan": "list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2])))"}


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local master without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (folder or tempfile.mkdtemp(prefix="tessera-")).rstrip("/")


def _top(metric: str, k: int = 10, **options) -> Query:
    def run(spark, sf_dir):
        found = search.search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), k, metric, "vec_id", "embedding", **options)
        return found.select("vec_id", F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"))

    return run


for _metric in V.METRICS:
    registered(f"{_Q} SELECT vec_id, round({_SIMILARITY[_metric]}, 6) AS similarity, round({_DISTANCE[_metric]}, 6) AS distance FROM e, q ORDER BY {_SIMILARITY[_metric]} DESC, vec_id LIMIT 10", f"topk_{_metric}")(_top(_metric))
registered(f"{_Q} SELECT vec_id, round({_SIMILARITY['cosine']}, 6) AS similarity, round({_DISTANCE['cosine']}, 6) AS distance FROM e, q WHERE label = 3 ORDER BY {_SIMILARITY['cosine']} DESC, vec_id LIMIT 5", "topk_filtered_label")(_top("cosine", 5, where="label = 3"))
registered(
    f"""{_Q}, u AS (SELECT vec_id, list_transform(a, lambda x: x / sqrt(list_inner_product(a, a))) AS a FROM e), v AS (SELECT list_transform(b, lambda x: x / sqrt(list_inner_product(b, b))) AS b FROM q)
    SELECT vec_id, round(1 / (1 + list_distance(a, b)), 6) AS similarity, round(list_distance(a, b), 6) AS distance FROM u, v ORDER BY list_distance(a, b), vec_id LIMIT 10""",
    "topk_unit_euclid",
)(_top("euclidean", normalize=True))


_ALL = "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id % 50 = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings)"


def _top_of_all(metric: str, k: int = 10) -> Query:
    def run(spark, sf_dir):
        df = table(spark, sf_dir, "embeddings")
        found = search.search_all(df, df.filter("vec_id % 50 = 0"), k, metric, "vec_id", "embedding", "vec_id", "embedding")
        return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))

    return run


for _metric in V.METRICS:
    registered(
        f"""{_ALL} SELECT query_id, vec_id, round({_SIMILARITY[_metric]}, 6) AS similarity, round({_DISTANCE[_metric]}, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY {_SIMILARITY[_metric]} DESC, vec_id) AS rank
        FROM e, q QUALIFY rank <= 10""",
        f"topk_all_{_metric}",
    )(_top_of_all(_metric))


@registered(f"{_Q} SELECT vec_id, {', '.join(f'round({s}, 5) AS sim_{m}, round({_DISTANCE[m]}, 5) AS dist_{m}' for m, s in _SIMILARITY.items())} FROM e, q")
def dist_metric_table(spark, sf_dir):
    b = V.literal(_query_vector(spark, sf_dir))
    a = F.col("embedding")
    out = {f"sim_{m}": F.round(V.similarity(m, a, b), 5) for m in V.METRICS} | {f"dist_{m}": F.round(V.distance(m, a, b), 5) for m in V.METRICS}
    return table(spark, sf_dir, "embeddings").select("vec_id", *[c.alias(n) for n, c in out.items()])


@registered("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, len(embedding) AS dimension FROM embeddings")
def vector_norms(spark, sf_dir):
    text = V.to_text(F.col("embedding"))
    back = V.from_text(text)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(back), 5).alias("norm"), F.size(back).cast("long").alias("dimension"))


@registered(f"{_Q} SELECT vec_id, label, rank FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY list_cosine_similarity(a, b) DESC, vec_id) AS rank FROM e, q) WHERE rank <= 3")
def knn_per_label(spark, sf_dir):
    found = search.nearest_per_group(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 3, "label", "cosine", "vec_id", "embedding")
    return found.select("vec_id", "label", F.col("rank").cast("long").alias("rank"))


@registered("SELECT label, i - 1 AS position, round(avg(x::DOUBLE), 5) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2")
def centroid_per_label(spark, sf_dir):
    out = search.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return out.select("label", F.col("position").cast("long").alias("position"), F.round("mean", 5).alias("mean"))


@registered(f"{_Q} SELECT vec_id, round({_SIMILARITY['cosine']}, 6) AS similarity FROM e, q ORDER BY {_SIMILARITY['cosine']} DESC, vec_id LIMIT 10")
def ivf_exhaustive_equals_flat(spark, sf_dir):
    """The index in memory: rows with their cluster, all clusters probed."""
    df = table(spark, sf_dir, "embeddings")
    centers = search.fit_centers(df, 8, "embedding", rounds=2)
    placed = df.withColumn("cluster", search.nearest_centroid(F.col("embedding"), centers))
    found = search.search(placed.filter(F.col("cluster").isin(list(range(len(centers))))), _query_vector(spark, sf_dir), 10, "cosine", "vec_id", "embedding")
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


@registered(f"{_Q} SELECT vec_id, round({_SIMILARITY['cosine']}, 6) AS similarity FROM e, q ORDER BY {_SIMILARITY['cosine']} DESC, vec_id LIMIT 10")
def ivf_index(spark, sf_dir):
    """An index on disk at its defaults."""
    folder = f"{_shared(spark)}/tessera-index-{uuid.uuid4().hex}"
    centers = search.build_index(table(spark, sf_dir, "embeddings"), folder, vector="embedding")
    found = search.search_index(spark, folder, centers, _query_vector(spark, sf_dir), 10, id_col="vec_id", vector="embedding")
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


@registered("SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id, 99 AS label FROM embeddings WHERE vec_id % 7 = 0")
def vector_upsert(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    new = df.filter("vec_id % 7 = 0").select("vec_id", F.lit(99).alias("label"), F.lit(2).alias("seq"))
    new = new.unionByName(new.withColumns({"label": F.lit(5), "seq": F.lit(1)}))
    return search.upsert_vectors(df, new, "vec_id", "seq")


@registered("SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events WHERE CAST(props->>'$.k' AS INT) = 7")
def json_metadata_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter(V.metadata_filter(F.col("props"), {"k": 7, "absent": None}))
    return events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@registered("SELECT event_id, 'k' AS key, props->>'$.k' AS value, CAST(props->>'$.k' AS DOUBLE) AS value_numeric FROM events WHERE props->>'$.k' IS NOT NULL")
def metadata_pairs(spark, sf_dir):
    return store.metadata_pairs(table(spark, sf_dir, "events"), "event_id", "props")


@registered("SELECT event_id, value FROM events WHERE CAST(props->>'$.k' AS DOUBLE) = 11 AND props->>'$.absent' IS NULL")
def metadata_semi_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    pairs = store.metadata_pairs(events, "event_id", "props")
    return store.with_metadata(events, pairs, "event_id", {"k": 11, "absent": None}).select("event_id", "value")


@registered(f"{_Q} SELECT vec_id, round(list_distance(a, b), 5) AS l2, round({_DISTANCE['cosine']}, 5) AS cosine, round({_DISTANCE['dot']}, 5) AS dot, round({_DISTANCE['manhattan']}, 5) AS manhattan FROM e, q")
def sql_vector_functions(spark, sf_dir):
    """The distances by name in SQL, over vectors as text."""
    sql.register(spark)
    views(spark, sf_dir, "embeddings")
    return spark.sql(
        """SELECT vec_id, round(l2_distance(v, q), 5) AS l2, round(cosine_distance(v, q), 5) AS cosine, round(dot_product(v, q), 5) AS dot, round(manhattan_distance(v, q), 5) AS manhattan
        FROM (SELECT vec_id, to_json(embedding) AS v, to_json(:q) AS q FROM embeddings)""",
        args={"q": V.literal(_query_vector(spark, sf_dir))},
    )


# Relational queries


def _sql(name: str, text: str, *tables: str, oracle: str | None = None) -> None:
    def run(spark, sf_dir):
        views(spark, sf_dir, *tables)
        return spark.sql(text)

    registered(oracle or text, name)(run)


_sql("q_pricing_summary", """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""", "lineitem")
_sql("q_join_group", """
    SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""", "customer", "orders", "nation")
_sql("q_left_coalesce", """
    SELECT c_custkey, coalesce(n, 0) AS n, coalesce(total, 0.0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey""", "customer", "orders",
    oracle="SELECT c_custkey, coalesce(n, 0) AS n, coalesce(total, 0.0::DOUBLE) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey")
_sql("q_segments", """
    SELECT segment, count(*) AS customers, round(sum(total), 2) AS revenue FROM (SELECT o_custkey, sum(o_totalprice) AS total, CASE WHEN sum(o_totalprice) > 2000000 THEN 'high' WHEN count(*) BETWEEN 5 AND 12 THEN 'regular' ELSE 'low' END AS segment FROM orders GROUP BY o_custkey) GROUP BY segment""", "orders")
_sql("q_month_case_sum", """
    SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS month, count(DISTINCT o_custkey) AS customers, round(sum(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice ELSE 0 END), 2) AS urgent FROM orders GROUP BY 1""", "orders")
_sql("q_union_intersect_except", """
    SELECT k FROM ((SELECT c_custkey AS k FROM customer WHERE c_custkey <= 300 INTERSECT SELECT o_custkey FROM orders) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 100)
    UNION SELECT c_custkey FROM customer WHERE c_custkey IN (1, 2, 3)""", "customer", "orders")
for _kind, _group in (("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("cube", "CUBE (l_returnflag, l_linestatus)"), ("grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())")):
    _sql(f"q_{_kind}", f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY {_group}", "lineitem")
_sql("q_range_around_anomaly", """
    WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events), a AS (SELECT ts FROM events, s WHERE abs(value - m) > 6 * sd)
    SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts BETWEEN (SELECT min(ts) FROM a) - INTERVAL 5 MINUTES AND (SELECT max(ts) FROM a) + INTERVAL 5 MINUTES""", "events")
_sql("q_ranking", """
    SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, round(lag(o_totalprice) OVER v, 2) AS previous, round(first_value(o_totalprice) OVER v, 2) AS first_price
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""", "orders")
_sql("q_quality_profile", """
    SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, sum(CASE WHEN o_totalprice IS NULL OR o_totalprice <= 0 THEN 1 ELSE 0 END) AS bad_price, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders""", "orders",
    oracle="SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, CAST(sum(CASE WHEN o_totalprice IS NULL OR o_totalprice <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_price, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders")
_sql("q_hours", "SELECT CAST(EXTRACT(HOUR FROM ts) AS BIGINT) AS hour, count(*) AS n, round(avg(value), 4) AS mean FROM events WHERE event_type IN ('click', 'view') GROUP BY 1", "events")
_sql("q_full_outer", """
    SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) a
    FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) b ON a.k = b.k""", "supplier", "customer")


@registered("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def semi_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@registered("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@registered("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def q_pivot_count(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return out.select("l_returnflag", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("F", "O")])


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 10 AND o_orderstatus = 'O'")
def q_bound_parameters(spark, sf_dir):
    from tessera.sources.tables import query

    views(spark, sf_dir, "orders")
    return query(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = :c AND o_orderstatus = :s", {"c": 10, "s": "O"})


_sql("q_right_join", "SELECT n_name, count(s_suppkey) AS suppliers FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name", "supplier", "nation")
_sql("q_theta_join", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey < r_regionkey GROUP BY r_name", "nation", "region")


@registered("""
    SELECT p.event_id, count(*) AS n, round(sum(e.value), 2) AS total FROM events p JOIN events e ON e.user_id = p.user_id AND e.ts BETWEEN p.ts - INTERVAL 6 HOURS AND p.ts
    WHERE p.event_type = 'purchase' GROUP BY p.event_id""")
def q_range_join(spark, sf_dir):
    """What each buyer did in the six hours before a purchase, itself included."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    found = joins.range_join(events.filter("event_type = 'purchase'"), events, ["user_id"], "ts", 6 * 3600)
    return found.groupBy("event_id").agg(F.count("*").alias("n"), F.round(F.sum("r_value"), 2).alias("total"))


@registered("""
    SELECT p.event_id, max(v.ts) AS r_viewed FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND v.ts <= p.ts GROUP BY p.event_id""")
def q_asof_join(spark, sf_dir):
    """The last view of each buyer at or before a purchase."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type").withColumn("viewed", F.col("ts"))
    found = joins.asof_join(events.filter("event_type = 'purchase'"), events.filter("event_type = 'view'"), ["user_id"], "ts", ["viewed"])
    return found.select("event_id", "r_viewed")


# Synchronisation


_PRICED = "CASE WHEN o_orderkey % 100 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END"


@registered(f"SELECT o_orderkey, o_custkey, {_PRICED} AS o_totalprice FROM orders UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 100 = 1")
def upsert_orders(spark, sf_dir):
    target = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    changes = target.filter("o_orderkey % 100 = 0").withColumn("o_totalprice", F.lit(0.0))
    changes = changes.unionByName(target.filter("o_orderkey % 100 = 1").withColumn("o_orderkey", F.col("o_orderkey") + 10000000))
    return sync.upsert(target, changes, ["o_orderkey"])


@registered(f"SELECT o_orderkey, {_PRICED} AS o_totalprice FROM orders WHERE o_orderkey % 100 <> 1 UNION ALL SELECT o_orderkey + 10000000, 1.0::DOUBLE FROM orders WHERE o_orderkey % 100 = 2")
def cdc_apply(spark, sf_dir):
    target = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    rest = F.col("o_orderkey") % 100
    change = lambda df, op, seq: df.withColumns({"op": F.lit(op), "seq": F.lit(seq)})
    first = change(target.filter(rest <= 1).withColumn("o_totalprice", F.lit(-1.0)), "UPDATE", 1)
    second = change(target.filter(rest == 0).withColumn("o_totalprice", F.lit(0.0)), "UPDATE", 2)
    gone = change(target.filter(rest == 1), "DELETE", 3)
    new = change(target.filter(rest == 2).select((F.col("o_orderkey") + 10000000).alias("o_orderkey"), F.lit(1.0).alias("o_totalprice")), "INSERT", 4)
    return sync.apply_changes(target, first.unionByName(second).unionByName(gone).unionByName(new), ["o_orderkey"])


@registered("SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 1.5::DOUBLE ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def bulk_update(spark, sf_dir):
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    changes = target.filter("c_custkey % 10 = 3").select("c_custkey", F.lit(1.5).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    return sync.update_rows(target, changes, ["c_custkey"])


@registered("SELECT c_custkey, c_name FROM customer WHERE c_nationkey <> 4")
def bulk_delete(spark, sf_dir):
    target = table(spark, sf_dir, "customer")
    return sync.delete_rows(target, target.filter("c_nationkey = 4"), ["c_custkey"]).select("c_custkey", "c_name")


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01'")
def changed_since_watermark(spark, sf_dir):
    import datetime

    return sync.changed_since(table(spark, sf_dir, "orders"), "o_orderdate", datetime.datetime(1999, 6, 1)).select("o_orderkey", "o_totalprice")


@registered("SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1999-06-01' THEN 1.0::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders")
def incremental_sync_at_watermark(spark, sf_dir):
    """A table synced once, then again from the newest day of its source on: rows of that day itself have changed."""
    import datetime

    folder, day = f"{_shared(spark)}/tessera-sync-{uuid.uuid4().hex}", datetime.datetime(1999, 6, 1)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    sync.incremental_sync(orders, folder, ["o_orderkey"], "o_orderdate")
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderdate") >= F.lit(day), F.lit(1.0)).otherwise(F.col("o_totalprice")))
    sync.incremental_sync(changed, folder, ["o_orderkey"], "o_orderdate", day)
    return sync.read_version(spark, folder).select("o_orderkey", "o_totalprice")


@registered("SELECT * FROM (VALUES ('customer'), ('orders')) t(table_name)")
def tracker_pending(spark, sf_dir):
    """Tables that have changed since their last sync."""
    import datetime

    day = lambda d: datetime.datetime(2024, 1, d)
    tracker = sync.ChangeTracker.empty(spark)
    for name in ("orders", "customer", "part"):
        tracker = tracker.register(name, day(1))
    tracker = tracker.mark_synced("part", day(2)).mark_synced("orders", day(2)).register("orders", day(3))
    return tracker.pending().select("table_name")


@registered("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 3")
def sync_tables_by_key(spark, sf_dir):
    """Two tables synced under one root, one of them twice."""
    import datetime

    root, at = f"{_shared(spark)}/tessera-tables-{uuid.uuid4().hex}", datetime.datetime(2024, 1, 1)
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").filter("n_nationkey <> 3")
    sources, keys = {"nation": nation, "region": table(spark, sf_dir, "region")}, {"nation": ["n_nationkey"], "region": ["r_regionkey"]}
    tracker = sync.sync_tables(sources, root, keys, sync.ChangeTracker.empty(spark), at, force=True)
    sync.sync_tables(sources, root, keys, tracker.register("nation", at + datetime.timedelta(days=1)), at + datetime.timedelta(days=2))
    return sync.read_version(spark, f"{root}/nation")


@registered("SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding) AS size, count(*) OVER () AS kept FROM embeddings WHERE vec_id % 5 <> 0")
def vector_store_delete(spark, sf_dir):
    """A collection: rows added, some replaced, some deleted, the rest counted."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("metadata"))
    collection = store.VectorStore(spark, f"{_shared(spark)}/tessera-vectors-{uuid.uuid4().hex}", 64)
    collection.add(rows)
    collection.add(rows.filter("CAST(id AS INT) % 7 = 0"))
    collection.delete(rows.filter("CAST(id AS INT) % 5 = 0").select("id"))
    return collection.rows().select("id", F.size("vector").cast("long").alias("size"), F.lit(collection.count()).cast("long").alias("kept"))


@registered("SELECT s_name, s_suppkey FROM supplier")
def snapshot_projection(spark, sf_dir):
    return sync.project(table(spark, sf_dir, "supplier"), include=["s_name", "no_such_column", "s_suppkey"])


@registered("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, 'new' AS tier, CAST(NULL AS DOUBLE) AS discount FROM customer")
def schema_evolve(spark, sf_dir):
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_nationkey", T.LongType()), T.StructField("tier", T.StringType()), T.StructField("discount", T.DoubleType())])
    return sync.evolve(table(spark, sf_dir, "customer"), schema, {"tier": "new"})


# Record pipelines


@registered("SELECT n_name AS name, n_nationkey, n_regionkey, -1 AS r_regionkey FROM nation UNION ALL SELECT r_name, -1, -1, r_regionkey FROM region")
def etl_append_union(spark, sf_dir):
    a = table(spark, sf_dir, "nation").withColumnRenamed("n_name", "name")
    return a.unionByName(table(spark, sf_dir, "region").withColumnRenamed("r_name", "name"), allowMissingColumns=True).fillna(-1)


@registered("SELECT p_partkey, upper(p_name) AS p_name, p_brand || '-x' AS brand, 'T:' || p_type AS p_type, p_retailprice * 1.5::DOUBLE AS price, p_size / 2.0::DOUBLE AS half FROM part")
def etl_map_chain(spark, sf_dir):
    mapped = records.map_records(
        table(spark, sf_dir, "part"),
        [
            {"source": "p_name", "transform": "to_uppercase()"},
            {"source": "p_brand", "target": "brand", "transform": "concat('-x')"},
            {"source": "p_type", "transform": "prefix(T:)"},
            {"source": "p_retailprice", "target": "price", "transform": "multiply(1.5)"},
            {"source": "p_size", "target": "half", "transform": "divide(2)"},
            {"source": "missing", "target": "other"},
        ],
        remove_source_fields=True,
    )
    return mapped.select("p_partkey", "p_name", "brand", "p_type", "price", "half")


@registered("SELECT o_orderkey AS id, CAST(trunc(o_totalprice) AS INT) AS price, strftime(o_orderdate, '%Y/%m/%d') AS day, 'etl' AS origin FROM orders WHERE o_orderstatus = 'F'")
def etl_rename_convert_date(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_custkey")
    steps = [
        {"op": "filter_field", "field": "o_orderstatus", "equals": "F"},
        {"op": "rename_field", "field": "o_orderkey", "to": "id"},
        {"op": "rename_field", "field": "o_totalprice", "to": "price"},
        {"op": "convert_field", "field": "price", "type": "int"},
        {"op": "rename_field", "field": "o_orderdate", "to": "day"},
        {"op": "format_date", "field": "day", "to": "yyyy/MM/dd"},
        {"op": "add_field", "field": "origin", "value": "etl"},
        {"op": "remove_field", "field": "o_custkey"},
    ]
    return records.transform("json")(df, {"steps": steps}).select("id", "price", "day", "origin")


for _name, _condition, _where in (
    ("eq", "c_mktsegment = BUILDING", "c_mktsegment = 'BUILDING'"),
    ("ne", "c_nationkey != 7", "c_nationkey <> 7"),
    ("gt", "c_acctbal > 5000.5", "c_acctbal > 5000.5"),
    ("contains", "c_name contains 12", "false"),
    ("contains_text", "c_mktsegment contains MACH", "c_mktsegment LIKE '%MACH%'"),
    ("strict_type", "c_name = 12", "false"),
):
    registered(f"SELECT c_custkey FROM customer WHERE {_where}", f"etl_filter_{_name}")(lambda spark, sf_dir, c=_condition: records.filter_records(table(spark, sf_dir, "customer"), c).select("c_custkey"))


@registered("SELECT CAST(event_id AS VARCHAR) AS id, upper(event_type) AS kind FROM events WHERE event_type = 'click' AND props->>'$.k' = '5'")
def etl_plugin_records(spark, sf_dir):
    """Records with a map of fields: filtered by a field, then by a base column, then changed."""
    events = table(spark, sf_dir, "events")
    found = events.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("source"), F.from_json("props", "map<string,string>").alias("fields"))
    found = records.filter_fields(records.filter_fields(found, "k=5"), "source=click")
    return found.select("id", F.upper("source").alias("kind"))


@registered("SELECT id, 'row ' || id AS name FROM (SELECT CAST(range AS VARCHAR) AS id FROM range(100)) WHERE CAST(id AS INT) > 40")
def etl_generated_lenient(spark, sf_dir):
    from tessera.sources.records import source

    df = records.filter_records(source("generated")(spark, {}), "value > 400", lenient=True)
    return df.select("id", F.concat(F.lit("row "), "id").alias("name"))


# Streams


@registered("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_bucket_available_now(spark, sf_dir):
    """Daily windows over the events as a stream, run to its end."""
    from tessera.streaming.events import windowed

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_stream_path(spark, sf_dir))
    name = "stream_bucket_available_now"
    run = windowed(stream, "ts", "1 day", ["event_type"], "value").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.table(name)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@registered("""
    SELECT CAST(to_timestamp(floor(epoch(ts) / 21600) * 21600 - k * 21600) AT TIME ZONE 'UTC' AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total
    FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2""")
def stream_sliding_windows(spark, sf_dir):
    """Windows of twelve hours that begin every six."""
    from tessera.streaming.events import windowed

    return _ran(spark, windowed(_events(spark, sf_dir), "ts", "12 hours", ["event_type"], "value", slide="6 hours")).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total")
    )


@registered("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOURS AS session_end, count(*) AS n FROM s GROUP BY user_id, session""")
def stream_sessions(spark, sf_dir):
    """Runs of a user's events with gaps below two hours."""
    from tessera.streaming.events import ON_DISK, sessions

    # Sessions that touch are one in Spark: a gap of two hours less the least unit keeps those two hours apart asunder.
    out = _ran(spark, sessions(_events(spark, sf_dir), "ts", "2 hours -1 microseconds", "user_id"), ON_DISK)
    out = out.withColumn("session_end", F.col("session_end") + F.expr("INTERVAL '0.000001' SECOND"))
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n")


@registered("SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id")
def stream_upsert(spark, sf_dir):
    """The last event per user, kept by upserts of micro-batches."""
    from tessera.streaming.events import upsert_stream

    folder = f"{_shared(spark)}/tessera-stream-{uuid.uuid4().hex}"
    seen = _events(spark, sf_dir).select("user_id", F.col("ts").alias("last_seen"))
    upsert_stream(seen, f"{folder}/table", ["user_id"], "last_seen", f"{folder}/checkpoint").awaitTermination()
    return sync.read_version(spark, f"{folder}/table")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(_stream_path(spark, sf_dir))


def _ran(spark: SparkSession, stream: DataFrame, state: str | None = None) -> DataFrame:
    """The result of a stream that is run to its end: it and the stream's state are in the shared folder, not in the driver."""
    from tessera.streaming.events import complete_stream

    folder = f"{_shared(spark)}/tessera-stream-{uuid.uuid4().hex}"
    complete_stream(stream, f"{folder}/table", f"{folder}/checkpoint", state).awaitTermination()
    out = sync.read_version(spark, f"{folder}/table")
    return spark.createDataFrame([], stream.schema) if out is None else out  # no files, no batch


# Files


def _round_trip(kind: str) -> Query:
    def run(spark, sf_dir):
        folder = f"{_shared(spark)}/tessera-{kind}-{uuid.uuid4().hex}"
        df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
        df.write.options(**({"header": True} if kind == "csv" else {})).format(kind).save(folder)
        options = {"header": True} if kind == "csv" else {}
        return spark.read.schema(df.schema).options(**options).format(kind).load(folder).filter("c_nationkey < 20")

    return run


for _kind in ("csv", "json", "orc"):
    registered("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_nationkey < 20", f"round_trip_{_kind}")(_round_trip(_kind))


def _stream_path(spark: SparkSession, sf_dir: str) -> str:
    """A pattern: file streams read folders, and the table may be one file."""
    return f"{sf_dir}/events.parquet*"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly_zscore(spark, sf_dir)
