"""What the operators of this subpackage share: the shared folder, checkpoints and word patterns."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of texts that are worked on at a time; one text is never split.
AT_ONCE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset a local master gets a temporary folder; a cluster gets an error, for its
    executors would not see a folder of the driver's.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name, unused so far, in the shared folder."""
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; a plain path or a URI that Arrow knows (file, hdfs, s3, gs)."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in a folder of its own in the shared folder, to be given to :func:`drop` when it has been used."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def drop(folder: str) -> None:
    """Delete a folder of the shared folder."""
    store, path = file_system(folder)
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_dir(path)


def row_keys(prefix: str = "") -> list[Column]:
    """Two hashes of a row's doc_id and text, 128 bits together and never null, to find the row again by."""
    return [F.xxhash64("doc_id", "text").alias(f"{prefix}k1"), F.xxhash64("text", "doc_id").alias(f"{prefix}k2")]


def shielded(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns called as one of ``names`` renamed, and what selects all its columns under their own names."""
    other = {c: f"__own_{c}" if c in set(names) else c for c in docs.columns}
    return docs.select([F.col(f"`{c}`").alias(n) for c, n in other.items()]), lambda df: df.select([F.col(f"`{n}`").alias(c) for c, n in other.items()])


#: Keys with more than this share of all weight are hot: there are no more than its inverse of them.
HOT_SHARE = 1 / 10_000


def joined_hot(left: DataFrame, right: DataFrame, weight: str, on: dict[str, str], values: list[str], spread: Column, slim: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Left join of ``left`` with ``right``, which has one row per key, where a few keys may hold most rows of ``left``.

    ``on`` names the key columns of both sides, ``values`` the columns of ``right`` that are taken and ``weight`` what
    a key weighs. At most 10,000 keys have more than 1/10,000 of all weight: their values come by broadcast, and
    their rows are dealt over all tasks by the hash ``spread``; all others meet ``right`` by a shuffle on the key,
    where no key is heavy. ``slim`` may drop what hot rows no longer need, before the shuffle: it sees the hot
    values, which are null for other rows. ``right`` is read three times: give a checkpointed one.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) > F.lit(float(total)) * HOT_SHARE
    keys = list(on.values())
    hot = right.filter(is_hot).select(*[F.col(k).alias(f"__hot_{k}") for k in keys], *values, F.lit(True).alias("__hot"))
    met = left.join(F.broadcast(hot), [F.col(a) == F.col(f"__hot_{b}") for a, b in on.items()], "left").drop(*[f"__hot_{k}" for k in keys])
    met = slim(met) if slim else met
    met = met.withColumn("__salt", F.when(F.col("__hot"), spread.bitwiseOR(1)).otherwise(F.lit(0)))
    rest = right.filter(~is_hot).select(*[F.col(k).alias(f"__of_{k}") for k in keys], *[F.col(v).alias(f"__of_{v}") for v in values], F.lit(0).cast("long").alias("__of_salt"))
    same = [F.col(a) == F.col(f"__of_{b}") for a, b in on.items()] + [F.col("__salt") == F.col("__of_salt")]
    out = met.join(rest.hint("merge"), same, "left")
    return out.withColumns({v: F.coalesce(v, f"__of_{v}") for v in values}).drop("__hot", "__salt", "__of_salt", *[f"__of_{k}" for k in keys], *[f"__of_{v}" for v in values])


def crc_rest(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows with 2 are held out of training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow``, with this package on the path of workers that start where the driver runs from elsewhere.

    On a cluster whose nodes do not share that path the package is shipped with ``--py-files``. Spark ends a batch
    at ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB here, unless set lower) whatever its rows are.
    """
    home, env = str(Path(__file__).resolve().parents[2]), df.sparkSession.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), home]))
    return df.mapInArrow(fn, schema)


def parts(values: pa.Array, at_once: int, at_once_bytes: int) -> Iterator[tuple[int, int]]:
    """Start and length of runs of ``values``, each of ``at_once`` rows and ``at_once_bytes`` at most, or of one row."""
    start = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(values), 0).to_pylist()):
        if i > start and (i - start == at_once or held + size > at_once_bytes):
            yield start, i - start
            start, held = i, 0
        held += size
    if len(values):
        yield start, len(values) - start


def map_texts(
    df: DataFrame,
    added: dict[str, str],
    fn: Callable[[list], dict[str, list]],
    column: str = "text",
    keep: list[str] | None = None,
    at_once: int = 512,
    at_once_bytes: int = AT_ONCE_BYTES,
) -> DataFrame:
    """``df`` with the columns ``added`` (name: type), which ``fn`` makes from a list of values of ``column``.

    Other columns pass through as Arrow, untouched; ``keep`` names those to keep (default: all). Columns of
    ``df`` whose names clash with ``added`` are replaced. ``fn`` sees at most ``at_once`` values at a time, and
    at most ``at_once_bytes`` of them or one.
    """
    names = [c for c in (df.columns if keep is None else keep) if c not in added]
    new = T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in added.items()])
    schema = T.StructType([df.schema[c] for c in names] + new.fields)
    arrow = to_arrow_schema(new)
    source = df.select(*[f"`{c}`" for c in names], F.col(f"`{column}`").alias("__input"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows in parts(batch.column(len(names)), at_once, at_once_bytes):
                part = batch.slice(start, rows)
                made = fn(part.column(len(names)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(names))] + [pa.array(made[f.name], f.type) for f in arrow], names=[*names, *arrow.names]
                )

    return map_arrow(source, run, schema)
