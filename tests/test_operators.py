"""Fixtures with known answers, edge cases, and plans."""

import datetime
import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors as V
from tessera.functions.times import parse_width
from tessera.operators import analytics, records, search, sync
from tessera.plans import pipelines, statements
from tessera.sources import plugin, tables
from tessera.sources import records as sources
from tessera.streaming import events as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Tables


def test_csv_round_trip_and_create_as(spark, tmp_path):
    df = spark.createDataFrame([(1, "test1", 10.5), (2, "test2", 20.5)], "id int, name string, value double")
    tables.export_csv(df, f"{tmp_path}/c")
    back = tables.import_csv(spark, "from_csv", f"{tmp_path}/c")
    assert dict(back.dtypes) == {"id": "int", "name": "string", "value": "double"} and sync.same_rows(back, df)
    doubled = tables.create_table_as(spark, "derived", "SELECT name, value * 2 AS doubled_value FROM from_csv WHERE id > 0")
    assert sorted(r.doubled_value for r in doubled.collect()) == [21.0, 41.0]
    tables.export_parquet(df, f"{tmp_path}/p")
    assert sync.same_rows(tables.import_parquet(spark, "from_parquet", f"{tmp_path}/p"), df)
    assert tables.table_exists(spark, "derived") and not tables.table_exists(spark, "no_such")
    assert tables.create_table(spark, "fresh", "a int").count() == 0
    assert {"from_csv", "derived"} <= set(tables.select_tables(spark, exclude=["fresh"])) and "fresh" not in tables.select_tables(spark, exclude=["fresh"])
    assert json.loads(tables.as_json(df.filter("id = 1")).first()[0]) == {"id": 1, "name": "test1", "value": 10.5}
    assert [c["name"] for c in tables.describe(spark, "derived")] == ["name", "doubled_value"]


# Analytics


def test_sales_fixture(spark):
    rows = [(i + 1, datetime.date(2023, 1, i + 1), p, a, 100 + i) for i, (p, a) in enumerate([("A", 100.5), ("B", 200.75), ("A", 150.25), ("C", 300.0), ("B", 250.5)])]
    sales = spark.createDataFrame(rows, "id int, date date, product string, amount double, customer_id int")
    series = analytics.time_series(sales.withColumn("date", F.col("date").cast("timestamp_ntz")), "date", "amount", "1 day", "SUM").collect()
    assert len(series) == 5 and series[0].asDict() == {"time_bucket": datetime.datetime(2023, 1, 1), "SUM_value": 100.5}
    assert -1 <= analytics.correlation(sales, "id", "amount").first()[0] <= 1
    found = {r.column_name: r for r in analytics.profile(sales, exact=True).collect()}
    assert set(found) == set(sales.columns) and found["product"].n_distinct == 3 and found["amount"].q50 == 200.75


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, 5.0)], [(i, 5.0) for i in range(4)]])
def test_degenerate_statistics(spark, rows):
    df = spark.createDataFrame(rows, "t int, v double").withColumn("ts", F.lit(datetime.datetime(1999, 12, 31)).cast("timestamp_ntz"))
    assert analytics.correlation(df, "t", "v").first()[0] == 0.0
    assert analytics.anomalies(df, "ts", "v").count() == 0
    assert analytics.histogram(df, "v").count() == (1 if any(v for _, v in rows) else 0)
    assert analytics.profile(df).count() == 3


def test_buckets(spark):
    assert parse_width("5 Minutes") == (5, "minute")
    for bad in ("five days", "0 days", "1 fortnight"):
        with pytest.raises(ValueError):
            parse_width(bad)
    ts = spark.createDataFrame([(datetime.datetime(2023, 1, 1, 12),), (datetime.datetime(1999, 2, 1),)], "ts timestamp_ntz").withColumn("v", F.lit(1.0))
    week = [r.time_bucket for r in analytics.time_series(ts, "ts", "v", "1 week").collect()]
    assert week[1] == datetime.datetime(2022, 12, 26) and week[0].weekday() == 0
    assert [r.time_bucket for r in analytics.time_series(ts, "ts", "v", "5 months").collect()] == [datetime.date(1998, 10, 1), datetime.date(2022, 12, 1)]
    with pytest.raises(ValueError):
        analytics.rolling(ts, [], ["ts"], "v")


# Vectors


def test_metric_values(spark):
    a, b = V.literal([1, 2, 3]), V.literal([4, 5, 6])
    assert one(spark, V.dot(a, b)) == 32 and one(spark, V.euclidean(a, b)) == pytest.approx(5.19615, abs=1e-4)
    assert one(spark, V.cosine(a, b)) == pytest.approx(0.974632, abs=1e-5) and one(spark, V.manhattan(a, b)) == 9
    assert one(spark, V.normalize(V.literal([3, 4]))) == [0.6, 0.8] and one(spark, V.normalize(V.literal([0, 0]))) == [0.0, 0.0]
    assert one(spark, V.cosine(V.literal([0, 0]), V.literal([1, 0]))) == 0 and one(spark, V.distance("cosine", V.literal([0, 0]), V.literal([1, 0]))) == 1
    assert one(spark, V.similarity("euclidean", V.literal([1, 0, 0]), V.literal([0, 1, 0]))) == pytest.approx(0.41421, abs=1e-4)
    assert one(spark, V.hamming(V.literal([1, 2]), V.literal([1, 3]))) == 1 and one(spark, V.distance("dot", a, b)) == -32
    assert one(spark, V.from_text(F.lit("[1,2.5]"))) == [1.0, 2.5] and one(spark, V.from_text(F.lit("x"))) is None
    with pytest.raises(Exception, match="dimension"):
        one(spark, V.dot(a, V.literal([1, 2])))
    with pytest.raises(ValueError):
        V.similarity("angular", a, b)


@pytest.fixture(scope="module")
def store(spark):
    rows = [("v1", [1.0, 0.0, 0.0], '{"c":"AI","n":1}'), ("v2", [0.0, 1.0, 0.0], '{"c":"DB","n":2.0}'), ("v3", [0.0, 0.0, 1.0], None), ("v4", [0.7, 0.7, 0.0], '{"c":"DB"}')]
    return spark.createDataFrame(rows, "id string, vector array<float>, metadata string")


def test_search(store):
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(search.search(store, [1, 0, 0], 2)) == ["v1", "v4"]
    assert ids(search.search(store, [1, 0, 0], 2, where="id <> 'v1'")) == ["v4", "v2"]
    assert len(ids(search.search(store, [1, 0, 0], 99, "manhattan"))) == 4
    assert ids(search.search(store.filter(V.metadata_filter(F.col("metadata"), {"c": "DB"})), [1, 0, 0], 9)) == ["v4", "v2"]
    assert ids(search.search(store.filter(V.metadata_filter(F.col("metadata"), {"n": 2})), [1, 0, 0], 9)) == ["v2"]
    assert sorted(ids(store.filter(V.metadata_filter(F.col("metadata"), {"n": None})))) == ["v3", "v4"]
    assert "TakeOrderedAndProject" in plan(search.search(store, [1, 0, 0], 2))
    with pytest.raises(ValueError):
        V.metadata_filter(F.col("metadata"), {"a') OR 1": 1})


@pytest.mark.parametrize("metric", V.METRICS)
def test_search_of_all_queries_equals_each_search(spark, metric):
    rows = [(f"v{i}", [float(i % 7), float(i % 3), 0.125 * (i % 11)]) for i in range(60)] + [("zero", [0.0, 0.0, 0.0]), ("none", None), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, vector array<float>").repartition(3)
    queries = df.filter("id IN ('v0', 'v5', 'v17', 'v59', 'zero', 'none')")
    for k in (4, 99):
        got = {}
        for r in search.search_all(df, queries, k, metric, query_id="id", block=8).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r.similarity, r.distance))
        assert set(got) == {"v0", "v5", "v17", "v59", "zero"}
        for q, found in got.items():
            assert found == [(r.id, r.similarity, r.distance) for r in search.search(df, dict(rows)[q], k, metric).collect()]
    assert search.search_all(df, queries.limit(0), 3, metric, query_id="id").count() == search.search_all(df.limit(0), queries, 3, metric, query_id="id").count() == 0


def test_index_with_all_probes_is_exact_and_prunes(spark, store, tmp_path, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    folder = f"{tmp_path}/ivf"
    centers = search.build_index(df, folder, 6, "embedding", rounds=2)
    query = df.first().embedding
    options = {"metric": "euclidean", "id_col": "vec_id", "vector": "embedding"}
    flat = [r.vec_id for r in search.search(df, query, 8, **options).collect()]
    assert [r.vec_id for r in search.search_index(spark, folder, centers, query, 8, probes=6, **options).collect()] == flat
    few = search.search_index(spark, folder, centers, query, 8, probes=1, **options)
    assert re.search(r"PartitionFilters: \[[^\]]*cluster", plan(few)) and few.count() <= 8
    assert spark.read.parquet(folder).count() == df.count()
    assert search.fit_centers(df.limit(0), 3, "embedding") == []


def test_index_at_its_defaults_loses_no_neighbour(spark, tmp_path, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").cache()
    folder = f"{tmp_path}/ivf"
    centers = search.build_index(df, folder, vector="embedding", rounds=1)
    query = df.filter("vec_id = 50").first().embedding
    for metric in V.METRICS:
        options = {"metric": metric, "id_col": "vec_id", "vector": "embedding"}
        exact = [r.vec_id for r in search.search(df, query, 10, **options).collect()]
        assert [r.vec_id for r in search.search_index(spark, folder, centers, query, 10, **options).collect()] == exact


def test_index_reads_no_cluster_that_is_too_far(spark, tmp_path):
    rows = spark.range(60).selectExpr("cast(id AS string) id", "array(cast(id % 3 * 100 + 1 AS float), cast(id / 60 AS float)) vector")
    centers = search.Centers([[1.0, 0.5], [101.0, 0.5], [201.0, 0.5]])
    folder = f"{tmp_path}/far"
    rows.withColumn("cluster", F.expr("cast(id AS int) % 3")).write.partitionBy("cluster").parquet(folder)
    centers.bounds = {i: {"r2": 0.5, "r1": 0.5, "angle": 0.5, "zero": False} for i in range(3)}
    found = search.search_index(spark, folder, centers, [101, 0.2], 5, metric="euclidean")
    assert [r.id for r in found.collect()] == [r.id for r in search.search(rows, [101, 0.2], 5, "euclidean").collect()]
    assert re.search(r"PartitionFilters: \[[^\]]*cluster", plan(found))


def test_vector_store(spark, store, tmp_path):
    from tessera.operators.store import VectorStore

    collection = VectorStore(spark, f"{tmp_path}/v", 3)
    assert collection.count() == 0 and collection.search([1, 0, 0], 3).count() == 0
    collection.add(store)
    again = spark.createDataFrame([("v1", [0.0, 0.0, 1.0], None, 1), ("v1", [0.0, 1.0, 1.0], None, 2), ("v5", [1.0, 0.0, 0.1], None, 1)], "id string, vector array<float>, metadata string, seq int")
    collection.add(again, "seq")
    assert collection.count() == 5 and collection.get("v1").first().vector == [0.0, 1.0, 1.0]
    assert [r.id for r in collection.search([1, 0, 0], 2).collect()] == ["v5", "v4"]
    collection.delete(["v5"])
    assert [r.id for r in collection.search([1, 0, 0], 1).collect()] == ["v4"] and collection.count() == 4
    with pytest.raises(ValueError):
        collection.search([1, 0], 1)
    with pytest.raises(Exception, match="dimension"):
        collection.add(spark.createDataFrame([("v6", [1.0], None)], VectorStore.SCHEMA))


def test_vector_store_index(spark, tmp_path):
    from tessera.operators.store import VectorStore

    rows = spark.createDataFrame([(str(i), [float(i % 5), float(i // 5), 1.0], None) for i in range(50)], VectorStore.SCHEMA)
    collection = VectorStore(spark, f"{tmp_path}/c", 3, "euclidean")
    collection.add(rows)
    exact = [r.id for r in collection.search([2, 3, 1], 4).collect()]
    for kind in ("flat", "ivf"):
        collection.create_index(kind, 4)
        found = collection.search([2, 3, 1], 4, probes=4)
        assert [r.id for r in found.collect()] == exact and found.columns == [*rows.columns, "similarity", "distance"]
    assert collection.centers
    collection.delete([exact[0]])
    assert [r.id for r in collection.search([2, 3, 1], 3).collect()] == exact[1:]
    with pytest.warns(UserWarning, match="no hnsw index"):
        collection.create_index("hnsw")
    with pytest.raises(ValueError, match="index"):
        collection.create_index("tree")


def test_sql_vector_functions(spark):
    from tessera.functions import sql

    sql.register(spark)
    row = spark.sql("SELECT l2_distance('[0,3]', '[4,0]') a, manhattan_distance('[0,3]', '[4,0]') b, hamming_distance('[1,2]', '[1,3]') c, dot_product('[1,2]', '[3,4]') d, cosine_distance('[1,0]', '[0,0]') e, cosine_distance(NULL, '[1]') f").first()
    assert tuple(row) == (5.0, 7.0, 1.0, -11.0, 1.0, None)
    with pytest.raises(Exception, match="dimension"):
        spark.sql("SELECT l2_distance(v, '[1]') FROM VALUES ('[1,2]') AS t(v)").collect()


def test_statistics_of_a_managed_table(spark):
    from tessera.sources import tables

    tables.create_table_as(spark, "analyzed", spark.range(7), managed=True)
    tables.analyze(spark, "analyzed")
    assert any("7 rows" in r.data_type for r in spark.sql("DESCRIBE EXTENDED analyzed").collect())


# Synchronisation


def test_repeated_and_null_keys(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 1), (None, "d", 2)], "id int, name string, at int")
    folder = f"{tmp_path}/first"
    sync.incremental_sync(rows, folder, ["id"], "at")
    assert sorted(r.name for r in sync.read_version(spark, folder).collect()) == ["b", "c", "d"]
    got = sync.upsert(spark.createDataFrame([(1, "old", 0), (None, "e", 0)], rows.schema), rows, ["id"])
    assert sorted(r.id or 0 for r in got.collect()) == [0, 0, 0, 1] and "old" not in {r.name for r in got.collect()}


def test_sync_of_changed_tables(spark, tmp_path):
    import datetime

    day = lambda d: datetime.datetime(2024, 1, d)
    sources = {n: spark.createDataFrame([(1, n)], "id int, name string") for n in ("a", "b")}
    keys, root = {"a": ["id"], "b": ["id"]}, str(tmp_path)
    tracker = sync.sync_tables(sources, root, keys, sync.ChangeTracker.empty(spark).register("a", day(1)), day(2))
    assert sync.read_version(spark, f"{root}/a").count() == 1 and sync.read_version(spark, f"{root}/b") is None
    assert tracker.pending().count() == 0
    sync.sync_tables(sources, root, keys, tracker, day(3), force=True)
    assert sync.read_version(spark, f"{root}/b").first().name == "b"


def test_changes_with_deletes(spark):
    target = spark.createDataFrame([(1, "test1", 10.5), (2, "test2", 20.5)], "id long, name string, value double")
    changes = spark.createDataFrame([(1, "x", 0.0, "UPDATE", 1), (1, "updated_test1", 15.5, "UPDATE", 2), (2, None, None, "DELETE", 3), (3, "test3", 30.5, "INSERT", 4)], "id long, name string, value double, op string, seq int")
    assert sorted(map(tuple, sync.apply_changes(target, changes, ["id"]).collect())) == [(1, "updated_test1", 15.5), (3, "test3", 30.5)]


def test_incremental_sync_is_idempotent(spark, tmp_path):
    folder = f"{tmp_path}/t"
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, name string, at int")
    sync.incremental_sync(rows, folder, ["id"])
    new = spark.createDataFrame([(2, "c", 3), (2, "d", 4), (3, "e", 5)], "id int, name string, at int")
    for _ in range(2):
        sync.incremental_sync(rows.unionByName(new), folder, ["id"], "at", watermark=2)
    assert sorted(map(tuple, sync.read_version(spark, folder).collect())) == [(1, "a", 1), (2, "d", 4), (3, "e", 5)]
    assert len(sync.versions(spark, folder)) == 3
    assert spark.read.parquet(sync.snapshot(rows, f"{tmp_path}/s", 17)).count() == 2 and sync.snapshot(rows, f"{tmp_path}/s", 17).endswith("s_17")
    sync.full_sync(rows, f"{tmp_path}/f", exclude=["at"])
    assert spark.read.parquet(f"{tmp_path}/f").columns == ["id", "name"]


def test_rows_at_the_watermark_come_again(spark, tmp_path):
    """A row written at the watermark after a sync is not lost, and a sync of nothing writes nothing."""
    folder, schema = f"{tmp_path}/w", "id int, name string, at int"
    sync.incremental_sync(spark.createDataFrame([(1, "a", 5)], schema), folder, ["id"], "at")
    source = spark.createDataFrame([(1, "a", 5), (2, "late", 5)], schema)
    assert sync.incremental_sync(source, folder, ["id"], "at", watermark=5)
    assert sorted(r.name for r in sync.read_version(spark, folder).collect()) == ["a", "late"]
    before = sync.versions(spark, folder)
    assert sync.incremental_sync(source, folder, ["id"], "at", watermark=9) is None and sync.versions(spark, folder) == before
    empty = f"{tmp_path}/e"
    sync.incremental_sync(source.limit(0), empty, ["id"])
    sync.incremental_sync(source, empty, ["id"])
    assert sync.read_version(spark, empty).count() == 2


def test_two_writers(spark, tmp_path):
    """A version is written once: the second writer fails, or reads the first one's and merges into it."""
    folder, schema = f"{tmp_path}/t", "id int, name string"
    sync.merge_version(spark.createDataFrame([(i, "old") for i in range(200)], schema), folder, ["id"])
    seen = sync.versions(spark, folder)
    mine = sync.read_version(spark, folder, seen).withColumn("name", F.lit("mine"))
    sync.merge_version(spark.createDataFrame([(1, "other"), (500, "other")], schema), folder, ["id"])
    with pytest.raises(sync.Conflict):
        sync.commit_version(mine, folder, seen)
    real, raced = sync._next, []

    def late(*a):  # another writer comes between reading and writing
        if not raced:
            raced.append(True)
            sync.commit_version(sync.read_version(spark, folder).withColumn("name", F.lit("third")), folder)
        return real(*a)

    sync._next = late
    try:
        sync.merge_version(spark.createDataFrame([(2, "last")], schema), folder, ["id"])
    finally:
        sync._next = real
    got = {r.id: r.name for r in sync.read_version(spark, folder).collect()}
    assert len(got) == 201 and got[2] == "last" and got[500] == got[1] == "third"


def test_only_touched_parts_are_written(spark, tmp_path):
    folder, schema = f"{tmp_path}/t", "id int, name string"
    sync.merge_version(spark.createDataFrame([(i, "old") for i in range(2000)], schema), folder, ["id"])
    name = sync.merge_version(spark.createDataFrame([(7, "new"), (None, "no key")], schema), folder, ["id"])
    parts = [p for p in (tmp_path / "t" / name.rpartition("/")[2]).iterdir() if p.is_dir()]
    assert len(parts) == 2 and spark.read.parquet(name).count() < 200
    got = {r.id: r.name for r in sync.read_version(spark, folder).collect()}
    assert len(got) == 2001 and got[7] == "new" and got[None] == "no key" and got[8] == "old"
    sync.compact(spark, folder)
    assert len(sync.versions(spark, folder)) == 1 and {r.id: r.name for r in sync.read_version(spark, folder).collect()} == got
    sync.merge_version(spark.createDataFrame([(8, "newer")], schema), folder, ["id"])
    assert sync.read_version(spark, folder).filter("id = 8 OR id IS NULL").count() == 2


def test_ties_and_replays_give_the_same_rows(spark, tmp_path):
    rows = [(1, n, 3) for n in "abcdef"] + [(None, n, 3) for n in "xyyz"]
    schema = "id int, name string, at int"
    got = {tuple(sorted(map(tuple, sync._last(spark.createDataFrame(rows[k:] + rows[:k], schema).repartition(3), ["id"], "at").collect()), key=str)) for k in range(0, 10, 3)}
    assert len(got) == 1 and len(got.pop()) == 5
    folder = f"{tmp_path}/r"
    batch = spark.createDataFrame(rows, schema)
    assert sync.merge_version(batch, folder, ["id"], "at", tag="s1b0") and sync.merge_version(batch, folder, ["id"], "at", tag="s1b0") is None
    assert sync.merge_version(batch, folder, ["id"], "at", tag="s1b1") and sync.read_version(spark, folder).filter("id IS NULL").count() == 8


def test_schema_evolution(spark):
    old = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType()), T.StructField("gone", T.StringType())])
    new = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("v", T.DoubleType()), T.StructField("tier", T.StringType())])
    diff = sync.compare_schemas(new, old)
    assert (diff.added, diff.removed, diff.retyped, diff.constraint) == (["tier"], ["gone"], ["v"], ["id"]) and diff
    df = spark.createDataFrame([(1, "1.5", "x"), (2, "abc", "y")], old)
    assert [tuple(r) for r in sync.evolve(df, new, {"tier": "new"}).orderBy("id").collect()] == [(1, 1.5, "new"), (2, None, "new")]
    words = ["INTEGER", "INT", "BIGINT", "REAL", "FLOAT", "TEXT", "VARCHAR", "BLOB", "BINARY", "CUSTOM_TYPE"]
    assert [sync.normalize_type(w) for w in words] == ["INTEGER"] * 3 + ["REAL"] * 2 + ["TEXT"] * 2 + ["BLOB"] * 2 + ["CUSTOM_TYPE"]
    assert sync.map_type("real") == T.DoubleType() and sync.map_type("VARCHAR(10)") == T.StringType()
    with pytest.raises(ValueError):
        sync.project(df, exclude=df.columns)


def test_change_tracker(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    t = sync.ChangeTracker.empty(spark).register("a", day(1)).register("b", day(1)).mark_synced("a", day(2))
    assert [r.table_name for r in t.pending().collect()] == ["b"]
    again = t.register("a", day(3))
    assert [(r.table_name, r.last_synced) for r in again.pending().collect()] == [("a", day(2)), ("b", None)]


# Record pipelines


def test_conditions(spark):
    df = spark.createDataFrame([(1, "30", 2.5, True), (2, "x", None, False)], "i int, s string, d double, b boolean")
    count = lambda text, **o: records.filter_records(df, text, **o).count()
    got = [count(c) for c in ("i = 1", "s = 30", "s != 30", "i != 1", "d != 9", "s > 1", "d >= 2.5", "s contains x", "s contains 3", "b = true", "b != true", "i = 1.0", "nothing = 1")]
    assert got == [1, 0, 2, 1, 1, 0, 1, 1, 0, 1, 1, 1, 0]
    assert count("s > 1", lenient=True) == 1
    assert [records.parse_literal(x) for x in ("1", "-2.5", "1e3", ".5", "1_000", "nan", "inf", "true", "x")] == [1, -2.5, 1000.0, 0.5, "1_000", "nan", "inf", True, "x"]
    same = records.map_records(df, [{"source": "i", "transform": "multiply(x)"}, {"source": "d", "transform": "divide(nan)"}])
    assert sync.same_rows(same, df)
    for bad in ("i 1", "i ~ 1", "a = b c"):
        with pytest.raises(sources.ConfigError):
            count(bad)
    out = records.map_records(df, [{"source": "i", "target": "s", "transform": "multiply(2)"}, {"source": "s", "target": "t", "transform": "prefix('p-')"}, {"source": "i", "target": "z", "transform": "divide(0)"}, {"source": "s", "target": "u", "transform": "unknown(1)"}])
    assert tuple(out.orderBy("i").first()) == (1, 2.0, 2.5, True, "p-30", 1, "30")


PIPELINE = """
jobs:
  - id: load
    source: {type: csv, options: {file_path: PATH/in}}
    transforms:
      - {type: filter, options: {condition: "value > 15", lenient: true}}
      - {type: map, options: {mappings: [{source: name, transform: to_uppercase()}]}}
    sinks: [{type: table, options: {file_path: PATH/out, mode: upsert}}]
  - id: copy
    needs: [load]
    source: {type: generated}
    sinks: [{type: memory, options: {key: copy}}]
  - id: bad
    retry: {count: 2}
    source: {type: csv, options: {file_path: PATH/absent}}
    sinks: [{type: memory}]
  - id: after_bad
    needs: [bad]
    source: {type: generated}
"""


def test_pipeline_runs_and_skips(spark, tmp_path):
    tables.export_csv(spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "id int, name string, value int"), f"{tmp_path}/in")
    jobs = pipelines.load(PIPELINE.replace("PATH", str(tmp_path)))
    results = pipelines.run(spark, jobs)
    assert {k: r.status for k, r in results.items()} == {"load": "success", "copy": "success", "bad": "failed", "after_bad": "skipped"}
    assert (results["load"].read, results["load"].written, results["load"].dropped, results["bad"].attempts) == (3, 2, 1, 3)
    assert sorted(r.name for r in sync.read_version(spark, f"{tmp_path}/out").collect()) == ["B", "C"]
    assert sources.read_memory(spark, {"key": "copy"}).count() == 100 and sources.read_memory(spark, {"key": "none"}).count() == 0
    for text in ("jobs: [{id: a, source: {type: odd}}]", "jobs: [{id: a, needs: [b], source: {type: generated}}]", "jobs: [{id: a, needs: [b], source: {type: generated}}, {id: b, needs: [a], source: {type: generated}}]"):
        with pytest.raises(sources.ConfigError):
            pipelines.load(text)


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", None), ("2", "x")], "id string, name string")
    sources.write_csv(df, {"file_path": f"{tmp_path}/c", "fields": ["name", "id", "absent"], "delimiter": ";"})
    back = sources.read_csv(spark, {"file_path": f"{tmp_path}/c", "delimiter": ";"})
    assert back.columns == ["name", "id", "absent", "_source"] and back.count() == 2
    assert sources.read_csv(spark, {"file_path": f"{tmp_path}/c", "delimiter": ";", "has_header": False}).columns[0] == "column_0"
    sources.write_memory(df, {"key": "m"})
    sources.write_memory(spark.createDataFrame([(1,)], "other int"), {"key": "m", "mode": "append"})
    assert sources.MEMORY["m"].columns == ["id", "name", "other"] and sources.MEMORY["m"].count() == 3
    for o in ({}, {"file_path": "x", "delimiter": "ab"}):
        with pytest.raises(sources.ConfigError):
            sources.read_csv(spark, o)
    with pytest.raises(sources.ConfigError):
        sources.sink("email")


def test_jdbc_round_trip(spark):
    options = {"connection_string": "jdbc:derby:memory:tessera;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    sources.write_jdbc(spark.range(5).withColumn("name", F.lit("n")), options | {"table": "t"})
    assert sources.read_jdbc(spark, options | {"query": 'SELECT * FROM t WHERE "id" > 2'}).count() == 2
    assert sources.read_jdbc(spark, options | {"query": "SELECT * FROM t", "partition_column": '"id"', "lower": 0, "upper": 5, "partitions": 2}).count() == 5


def test_plugin_source_pushes_filters(spark, tmp_path):
    rows = [{"id": f"pg_{i}", "source": "s", "timestamp": "t", "fields": {"email": f"u{i}@x", "active": True}} for i in range(5)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    plugin.register(spark)
    df = spark.read.format("json_documents").option("path", str(tmp_path)).load()
    assert df.count() == 5 and df.filter("id = 'pg_3'").count() == 1
    assert df.filter("fields['email'] = 'u1@x'").select(F.upper(F.col("fields")["email"])).first()[0] == "U1@X"


# Statements


@pytest.mark.parametrize(
    ("sql", "kind", "label", "names"),
    [
        ("SELECT * FROM a WHERE id = 1", "select", "oltp", ("a",)),
        ("SELECT x, count(*) FROM a JOIN b USING (id) GROUP BY x", "select", "olap", ("a", "b")),
        ("WITH c AS (SELECT * FROM a) SELECT * FROM c ORDER BY 1", "select", "olap", ("a",)),
        ("SELECT rank() OVER (ORDER BY x) FROM a", "select", "olap", ("a",)),
        ("INSERT INTO a VALUES (1)", "insert", "oltp", ("a",)),
        ("DELETE FROM a WHERE id = 1", "delete", "oltp", ("a",)),
        ("UPDATE a SET x = 1", "update", "oltp", ("a",)),
        ("CREATE TABLE t (id INT)", "create", "oltp", ()),
        ("DROP TABLE t", "drop", "oltp", ()),
        ("SELECT 'JOIN b GROUP BY' FROM a", "select", "oltp", ("a",)),
    ],
)
def test_classification(spark, sql, kind, label, names):
    got = statements.classify(spark, sql)
    assert (got.kind, got.label) == (kind, label) and set(got.tables) == set(names) and got.writes == (kind != "select")


# Streams


def test_stream_upsert_and_sessions(spark, tmp_path):
    rows = [(1, "a", 1), (2, "b", 2)]
    spark.createDataFrame(rows, "id int, name string, seq int").write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema("id int, name string, seq int").parquet(f"{tmp_path}/in")
    streams.upsert_stream(read(), f"{tmp_path}/out", ["id"], "seq", f"{tmp_path}/ck").awaitTermination()
    spark.createDataFrame([(2, "c", 3), (3, "d", 4)], "id int, name string, seq int").write.mode("append").parquet(f"{tmp_path}/in")
    streams.upsert_stream(read(), f"{tmp_path}/out", ["id"], "seq", f"{tmp_path}/ck").awaitTermination()
    assert sorted((r.id, r.name) for r in sync.read_version(spark, f"{tmp_path}/out").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    batch = spark.createDataFrame([("u", t(0)), ("u", t(4)), ("u", t(30)), ("v", t(1))], "k string, ts timestamp")
    assert sorted(r.n for r in streams.sessions(batch, "ts", "10 minutes", "k").collect()) == [1, 1, 2]
    sliding = streams.windowed(batch.withColumn("v", F.lit(1)), "ts", "10 minutes", ["k"], "v", slide="5 minutes")
    assert sliding.agg(F.sum("n")).first()[0] == 8


def test_stream_results_stay_out_of_the_driver(spark, sf):
    """Results and state of streams that are run to their end are files of the shared folder; the session is left as it was."""
    from tessera import queries

    before = spark.conf.get(streams.STATE)
    for name, provider in (("stream_sessions", streams.ON_DISK), ("stream_sliding_windows", before)):
        files = queries.QUERIES[name](spark, sf).inputFiles()
        assert files and all("/tessera-stream-" in f for f in files)
        checkpoint = Path(files[0].partition("/table/")[0].removeprefix("file:"), "checkpoint")
        assert any((checkpoint / "state").iterdir()) and provider in next((checkpoint / "offsets").glob("[0-9]*")).read_text()
        assert name not in [t.name for t in spark.catalog.listTables()]
    assert spark.conf.get(streams.STATE) == before


def test_sessions_exactly_the_gap_apart(spark, tmp_path):
    """Two hours apart, to the microsecond, are two sessions, as in the SQL; a microsecond less is one. Users may be null."""
    import duckdb

    from tessera import queries

    t = lambda h, us=0: datetime.datetime(2024, 1, 1, h, 0, 0, us)
    rows = [(1, t(0)), (1, t(2)), (1, t(4)), (2, t(0, 1)), (2, t(2)), (3, t(0)), (3, t(2, 1)), (None, t(0)), (None, t(1)), (None, t(3)), (4, t(5)), (4, t(5))]
    spark.createDataFrame(rows, "user_id bigint, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"SET TimeZone='UTC'; CREATE VIEW events AS SELECT user_id, ts::TIMESTAMP AS ts FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    df = queries.stream_sessions(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL['stream_sessions']})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want)) and len(want) == 9


def test_complete_stream_goes_on(spark, tmp_path):
    """A second run takes up the state of the first; its version holds the sessions of both. No rows are a version, too."""
    t = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    run = lambda: streams.complete_stream(streams.sessions(spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in"), "ts", "10 minutes", "k"), f"{tmp_path}/out", f"{tmp_path}/ck", streams.ON_DISK).awaitTermination()
    put = lambda rows: spark.createDataFrame(rows, "k string, ts timestamp").write.mode("append").parquet(f"{tmp_path}/in")
    put([])
    run()
    assert sync.read_version(spark, f"{tmp_path}/out").count() == 0
    put([("u", t(5)), ("u", t(5, 4)), ("v", t(5, 1))])
    run()
    put([("u", t(5, 9)), ("v", t(6))])
    run()
    got = sync.read_version(spark, f"{tmp_path}/out").select("k", F.col("session_start").cast("string"), F.col("session_end").cast("string"), "n").collect()
    assert sorted(map(tuple, got)) == [("u", "2024-01-01 05:00:00", "2024-01-01 05:19:00", 3), ("v", "2024-01-01 05:01:00", "2024-01-01 05:11:00", 1), ("v", "2024-01-01 06:00:00", "2024-01-01 06:10:00", 1)]


def test_exact_quantiles(spark):
    """Ties, nulls, few and no values; brackets as narrow as they get."""
    import random

    rng = random.Random(5)
    rows = [(float(rng.randrange(50)), rng.random() ** 9, None, 7) for _ in range(4001)] + [(None, None, None, 7)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d int")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    want = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probabilities])) for c in "abcd"]).first()
    got = analytics.exact_quantiles(df, list("abcd"), probabilities, error=1e-3)
    assert [w and [round(x, 12) for x in w] for w in want] == [None if x[0] is None else [round(y, 12) for y in x] for x in got]
    assert analytics.exact_quantiles(df.filter("d = 8"), ["a", "d"], [0.5]) == [[None], [None]]


# Joins and windows in slices


def test_rolling_in_ranges_equals_one_range(spark):
    """Ranges with fewer rows than the window, empty ones, ties and nulls of the order, a key with most rows."""
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice("aaaaab"), rng.choice([None, *range(40)]), float(rng.randrange(100))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, at int, v double")
    got, want = (sorted(((r.id, round(r.rolling_avg, 9), None if r.rolling_std is None else round(r.rolling_std, 9)) for r in analytics.rolling(df, ["k"], ["at", "id"], "v", 30, ranges=n).collect()), key=str) for n in (9, 1))
    assert got == want and len(got) == 400
    assert analytics.rolling(df.limit(0), ["k"], ["at", "id"], "v", ranges=3).count() == 0


def test_slices_lose_no_pair(spark):
    import random

    from tessera.operators import joins

    rng = random.Random(4)
    make = lambda n: [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(60)])) for i in range(n)]
    a, b = make(120), make(150)
    left, right = (spark.createDataFrame(x, "id int, k int, at int") for x in (a, b))
    got = sorted((r.id, r.r_id) for r in joins.range_join(left, right, ["k"], "at", 7).collect())
    pairs = [(x, y) for x in a for y in b if None not in x and None not in y and x[1] == y[1]]
    assert got == sorted((x[0], y[0]) for x, y in pairs if 0 <= x[2] - y[2] <= 7)
    found = {r.id: r.r_id for r in joins.asof_join(left, right, ["k"], "at", ["id"], width=5).collect()}
    want = {x[0]: max(((y[2], y[0]) for z, y in pairs if z is x and y[2] <= x[2]), default=(None, None))[1] for x in a}
    assert found == want and None in want.values() and joins.asof_join(left.limit(0), right, ["k"], "at", ["id"]).count() == 0


# Plans


def test_plans_stay_narrow(spark, sf):
    from tessera import queries

    names = ["anomaly_zscore", "topk_cosine", "knn_per_label", "etl_filter_gt", "json_metadata_filter", "centroid_per_label"]
    plans = {n: plan(queries.QUERIES[n](spark, sf)) for n in names}
    assert all("Python" not in p and "Arrow" not in p for p in plans.values())
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,5000.5)]" in plans["etl_filter_gt"]
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plans["anomaly_zscore"] and "WindowGroupLimit" in plans["knn_per_label"]
