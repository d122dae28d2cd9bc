"""Key-based synchronisation: full, incremental, change frames, snapshots, schema evolution."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared type word to Spark type; words beyond these become strings.
TYPES = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "TEXT": T.StringType(), "BLOB": T.BinaryType()}
#: Type words that count as the same when schemas are compared.
SAME = {w: k for k, ws in {"INTEGER": "INT BIGINT SMALLINT TINYINT INTEGER", "REAL": "REAL FLOAT DOUBLE DECIMAL", "TEXT": "TEXT VARCHAR CHAR STRING", "BLOB": "BLOB BINARY"}.items() for w in ws.split()}


def normalize_type(word: str) -> str:
    return SAME.get(word.upper(), word.upper())


def map_type(word: str) -> T.DataType:
    return TYPES.get(word.upper(), T.StringType())


def _last(changes: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row per key: the last by ``order``, ties and rows without an order by their hash, so that reruns agree. Rows with
    a null in a key are equal to no other: all stay, and they are dealt out by a hash of their own, as they may be many."""
    whole = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys])
    hashed = F.xxhash64(*[F.to_json(F.struct(f"`{f.name}`")) if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType, T.VariantType)) else F.col(f"`{f.name}`") for f in changes.schema.fields])
    alone = any(changes.schema[k].nullable for k in keys)
    changes = changes.withColumn("__hash", hashed)
    if alone:
        changes = changes.withColumn("__alone", F.when(~whole, F.col("__hash")))
    place = Window.partitionBy(*[f"`{k}`" for k in keys], *["__alone"] * alone).orderBy(*[F.desc(f"`{order}`")] * (order is not None), F.desc("__hash"))
    kept = changes.withColumn("__nth", F.row_number().over(place)).filter(F.col("__nth") == 1 if not alone else (F.col("__nth") == 1) | F.col("__alone").isNotNull())
    return kept.drop("__nth", "__hash", "__alone")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``target`` with ``changes`` in place of rows of equal keys, last write first; null keys never match, so such rows are added."""
    return _put(target, _last(changes, keys, order), keys)


def _put(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    changes = changes.select([f"`{c}`" for c in target.columns])
    return target.join(changes.select(*keys), keys, "left_anti").select([f"`{c}`" for c in target.columns]).unionByName(changes)


def update_rows(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the columns of ``changes`` taken over where keys match and the new value is not null; ``changes`` has one row per key."""
    new = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*[f"`{k}`" for k in keys], *[F.col(f"`{c}`").alias(f"__new_{c}") for c in new])
    joined = target.join(renamed, keys, "left")
    return joined.select([F.coalesce(f"__new_{c}", F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in target.columns])


def delete_rows(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` without the rows whose keys are in ``gone``; null keys match nothing."""
    return target.join(gone.select(*keys), keys, "left_anti").select([f"`{c}`" for c in target.columns])


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], op: str = "op", order: str = "seq") -> DataFrame:
    """``target`` after a change frame of INSERT, UPDATE and DELETE rows: per key the last change holds."""
    last = _last(changes, keys, order)
    kept = target.join(last.select(*keys), keys, "left_anti").select([f"`{c}`" for c in target.columns])
    return kept.unionByName(last.filter(F.upper(op) != "DELETE").select([f"`{c}`" for c in target.columns]))


def changed_since(source: DataFrame, column: str, watermark) -> DataFrame:
    """Rows modified at ``watermark`` or later (all of them, if it is None); never capped. Rows of the watermark itself
    come again, as some may have been written after the last sync: an upsert by key takes them twice without harm."""
    return source if watermark is None else source.filter(F.col(column) >= F.lit(watermark))


def project(df: DataFrame, include: Iterable[str] | None = None, exclude: Iterable[str] | None = None) -> DataFrame:
    """Columns of ``include`` in its order (unknown ones dropped), else all but ``exclude``; none left is an error."""
    names = [c for c in include if c in df.columns] if include else [c for c in df.columns if c not in set(exclude or ())]
    if not names:
        raise ValueError("no columns are left")
    return df.select([f"`{c}`" for c in names])


def full_sync(source: DataFrame, folder: str, **columns) -> None:
    """Replace the table at ``folder`` by ``source``; the folder must not be one that ``source`` reads."""
    project(source, **columns).write.mode("overwrite").parquet(folder)


def snapshot(source: DataFrame, folder: str, epoch: int) -> str:
    """Write ``source`` to ``folder``_``epoch`` and return that name."""
    name = f"{folder.rstrip('/')}_{epoch}"
    source.write.mode("overwrite").parquet(name)
    return name


#: Parts of a table that is kept up to date by key; a sync rewrites those parts that its changes fall into.
PARTS = 64


class Conflict(RuntimeError):
    """Another writer has written the version that was to come next."""


def _store(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    store, path = _store(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Complete version folders of a table, oldest first: whole tables (v1), or some of its parts (v2-part)."""
    store, _ = _store(spark, folder)
    found = [n for n in _names(spark, folder) if n.startswith("v") and n[1:10].isdigit()]
    return [f"{folder}/{n}" for n in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]


def _number(version: str) -> int:
    return int(version.rpartition("/v")[2][:9])


def _next(spark: SparkSession, folder: str, after: list[str] | None, suffix: str = "") -> str:
    found = versions(spark, folder) if after is None else after
    name = f"v{_number(found[-1]) + 1 if found else 1:09d}"
    if any(n.startswith(name) for n in _names(spark, folder)):
        raise Conflict(f"{folder}/{name} exists")
    return f"{folder}/{name}{suffix}"


def commit_version(df: DataFrame, folder: str, after: list[str] | None = None) -> str:
    """Write ``df`` as the next version of the table at ``folder``. Readers see complete versions only, so a failed write is
    never seen and a table may be rewritten from itself. If ``after`` (the versions that ``df`` was made from) is no
    longer all there is, or the next version is being written, nothing is overwritten: :class:`Conflict`."""
    name = _next(df.sparkSession, folder, after)
    df.write.mode("errorifexists").parquet(name)
    return name


def _current(spark: SparkSession, found: list[str]) -> tuple[str | None, dict[int, str]]:
    """The last whole version, if it is in one piece, or else the newest folder of each part."""
    whole = max((i for i, v in enumerate(found) if "-part" not in v), default=0)
    newest = {int(n.rpartition("=")[2]): f"{v}/{n}" for v in found[whole:] for n in _names(spark, v) if n.startswith(f"__part_{PARTS}=")}
    return (None, newest) if newest else (found[whole], {})


def read_version(spark: SparkSession, folder: str, found: list[str] | None = None) -> DataFrame | None:
    """The table as its last complete version has it (``found``: as of these versions); None if there is none."""
    found = versions(spark, folder) if found is None else found
    if not found:
        return None
    piece, newest = _current(spark, found)
    return spark.read.parquet(*([piece] if piece else newest.values()))


def merge_version(changes: DataFrame, folder: str, keys: list[str], order: str | None = None, tag: str = "") -> str | None:
    """Upsert ``changes`` into the table at ``folder`` and write the parts that they fall into as its next version.

    Keys are dealt to ``PARTS`` parts by hash; which parts change is all that reaches the driver. A version that
    another writer has written meanwhile is read and merged into. ``tag`` names what is merged: a second merge under
    one tag does nothing.
    """
    spark = changes.sparkSession
    part = F.pmod(F.xxhash64(*[f"`{k}`" for k in keys]), F.lit(PARTS)).cast("int").alias(f"__part_{PARTS}")
    while True:
        found = versions(spark, folder)
        if tag and any(v.endswith(f"-{tag}") for v in found):
            return None
        target = read_version(spark, folder, found)
        newest = _current(spark, found)[1] if found else {}
        new = _last(changes, keys, order)
        if target is not None:
            touched = {r[0] for r in new.select(part).distinct().collect()}
            if newest:  # parts are read as folders: the others are not even listed
                folders = [newest[k] for k in sorted(touched & set(newest))]
                old = spark.read.schema(target.schema).parquet(*folders) if folders else target.limit(0)
            else:
                old = target
            new = _put(old, new, keys)
        try:
            name = _next(spark, folder, found, ("-part" if newest else "") + (f"-{tag}" if tag else ""))
            if new.isEmpty():
                return commit_version(new, folder, found) if target is None else None
            # Rebalanced by part: few files for each, and a part that is large is split.
            new.select("*", part).hint("rebalance", f"__part_{PARTS}").write.mode("errorifexists").partitionBy(f"__part_{PARTS}").parquet(name)
            return name
        except Conflict:
            time.sleep(1)


def compact(spark: SparkSession, folder: str) -> str:
    """Write the table as one whole version and delete all older ones; no reader should still be reading those."""
    found = versions(spark, folder)
    name = commit_version(read_version(spark, folder, found), folder, found)
    store, _ = _store(spark, folder)
    for old in found:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)
    return name


def incremental_sync(source: DataFrame, folder: str, keys: list[str], modified: str | None = None, watermark=None, tag: str = "") -> str | None:
    """Upsert what changed at ``watermark`` or later into the versioned table at ``folder``; create it if there is none."""
    return merge_version(changed_since(source, modified, watermark) if modified else source, folder, keys, modified, tag)


@dataclass
class SchemaDiff:
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    retyped: list[str] = field(default_factory=list)
    constraint: list[str] = field(default_factory=list)

    def __bool__(self) -> bool:
        return bool(self.added or self.removed or self.retyped or self.constraint)


def compare_schemas(source: T.StructType, target: T.StructType) -> SchemaDiff:
    """What must change in ``target`` to be like ``source``."""
    old, diff = {f.name: f for f in target.fields}, SchemaDiff()
    for f in source.fields:
        if f.name not in old:
            diff.added.append(f.name)
        elif normalize_type(f.dataType.simpleString().partition("(")[0]) != normalize_type(old[f.name].dataType.simpleString().partition("(")[0]):
            diff.retyped.append(f.name)
        elif f.nullable != old[f.name].nullable:
            diff.constraint.append(f.name)
    diff.removed = [n for n in old if n not in source.fieldNames()]
    return diff


def evolve(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """``df`` in ``schema``: common columns cast (null where a value has no such form), new ones filled with defaults."""
    defaults = defaults or {}
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(defaults.get(f.name)).cast(f.dataType)).alias(f.name) for f in schema.fields])


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both have the same rows, repeats counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


class ChangeTracker:
    """Per-table watermarks: when a table was last modified and last synced. State is a small DataFrame."""

    SCHEMA = "table_name string, last_modified timestamp, last_synced timestamp"

    def __init__(self, state: DataFrame):
        self.state = state

    @classmethod
    def empty(cls, spark: SparkSession) -> ChangeTracker:
        return cls(spark.createDataFrame([], cls.SCHEMA))

    def register(self, name: str, at) -> ChangeTracker:
        """A change keeps ``last_synced``, so that the next sync reads only what is new."""
        rows = self.state.sparkSession.createDataFrame([(name, at)], "table_name string, at timestamp")
        joined = self.state.join(rows, "table_name", "full").select("table_name", F.coalesce("at", "last_modified").alias("last_modified"), "last_synced")
        return ChangeTracker(joined)

    def pending(self) -> DataFrame:
        return self.state.filter(F.col("last_synced").isNull() | (F.col("last_modified") > F.col("last_synced"))).orderBy("table_name")

    def mark_synced(self, name: str, at) -> ChangeTracker:
        synced = F.when(F.col("table_name") == name, F.lit(at).cast("timestamp")).otherwise(F.col("last_synced"))
        return ChangeTracker(self.state.withColumn("last_synced", synced))


def sync_tables(sources: dict[str, DataFrame], root: str, keys: dict[str, list[str]], tracker: ChangeTracker, at, force: bool = False) -> ChangeTracker:
    """Upsert each of ``sources`` that has changed since its last sync (``force``: every one) into the versioned
    table of its name under ``root``; the tracker with them marked as synced at ``at``."""
    changed = set(sources) if force else {r["table_name"] for r in tracker.pending().select("table_name").collect()}
    for name in sorted(changed & set(sources)):
        incremental_sync(sources[name], f"{root}/{name}", keys[name])
        tracker = tracker.mark_synced(name, at)
    return tracker
