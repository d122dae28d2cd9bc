"""A Python data source with filter push-down, as the pattern for sources without a Spark connector.

``json_documents`` reads JSON-lines files as documents (id, source, timestamp, fields), the record form of plug-ins,
one partition per file, and takes equality filters on its top-level columns into the reader.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

SCHEMA = "id string, source string, timestamp string, fields map<string,string>"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path: a plain path, or a URI that Arrow knows (file, hdfs, s3, gs)."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class JsonDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return JsonDocumentsReader(self.options)


class JsonDocumentsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.equal = dict(options), {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in ("id", "source", "timestamp"):
                self.equal[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, folder = _store(self.options["path"])
        files = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and re.search(r"\.json[^/]*$", f.path)]
        return [InputPartition(f) for f in sorted(files)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = _store(self.options["path"])
        with io.TextIOWrapper(store.open_input_stream(partition.value, compression=None), encoding="utf-8") as lines:
            for line in lines:
                record = json.loads(line)
                row = (record.get("id"), record.get("source"), record.get("timestamp"), {k: None if v is None else str(v) for k, v in (record.get("fields") or {}).items()})
                if all(row[("id", "source", "timestamp").index(k)] == v for k, v in self.equal.items()):
                    yield row


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonDocuments)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
