"""WARC archives with an index that is written first and read by sorted, coalesced byte ranges.

Every task writes one archive, a gzip member per record, under a name of its own, and yields the index rows of
what it wrote: archive, offset, length, URL, digest. Only rows of tasks that succeeded reach the index, so a
retried task leaves an archive that nothing refers to. Reading sorts the selected index rows by place, joins
neighbouring byte ranges into one read each, and cuts the records out of it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, file_system, joined_hot, map_arrow, new_folder

INDEX = "archive string, offset long, length long, page_id string, url string, digest string, record_type string"
RECORDS = "page_id string, url string, record_type string, refers_to string, digest string, payload_bytes long, payload binary"
#: The HTTP head of a block; a revisit has the head alone, which still tells how long the payload is.
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
#: Name of the records of pages whose id is null.
UNNAMED = "<urn:no-page>"
#: Uncompressed bytes after which a reading task hands its records on.
HELD_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _safe(url: str) -> str:
    """A URL that can stand in a header line: white space and control characters, which no valid one has, are encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def _urn(page_id: str | None) -> str:
    """A name for a header line: any text as an id, percent-encoded; null has a name of its own."""
    return UNNAMED if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def record(page_id: str | None, url: str | None, digest: str, payload: bytes | None, size: int, refers_to: str | None) -> bytes:
    """One WARC 1.1 record: a response with its payload of ``size`` bytes, or a revisit without it."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    block = HTTP.format(size).encode() + (payload or b"" if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of ``RECORDS`` from one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    page = lambda name: unquote(fields[name][len("<urn:page:") : -1]) if fields.get(name, UNNAMED) != UNNAMED else None
    kind = fields["WARC-Type"]
    return {
        "page_id": page("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "refers_to": page("WARC-Refers-To"),
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": int(http.rpartition(b"Content-Length: ")[2]),
        "payload": payload if kind == "response" else None,
    }


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) into ``folder``; the index, as a table in it.

    Of rows with equal payloads of ``min_revisit_bytes`` or more, those of the smallest page_id are responses
    and the others revisits of it. Null html is an empty payload; where all ids of a payload are null, all its
    rows are responses. Ids may be any text, the empty one included, which is not null.

    Which id a payload's first page has is found on digests and ids alone. Digests with much of all bytes are told
    their first page by a broadcast of a bounded size and are spread over all tasks, without their contents
    where they are revisits; the contents of the others cross one shuffle.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    size = F.octet_length(payload).cast("long")
    hashed = pages.select("page_id", "url", F.col("html").cast("binary").alias("html"), F.sha1(payload).alias("sha1"), size.alias("size"))
    first = pages.select("page_id", F.sha1(payload).alias("of_sha1"), size.alias("size")).groupBy("of_sha1")
    first = first.agg(F.min("page_id").alias("first_id"), F.sum(F.col("size") + 200).alias("weight"), F.count("*").alias("n"))
    # A payload of one row is its own first page, whatever its size.
    first = cut(first.filter("n > 1").drop("n"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("size") >= min_revisit_bytes)
    bare = lambda rows: rows.withColumn("html", F.when(~revisit, F.col("html")))
    joined = joined_hot(hashed, first, "weight", {"sha1": "of_sha1"}, ["first_id"], F.xxhash64("page_id", "url"), bare)
    rows = bare(joined).select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "size", "sha1", F.when(revisit, F.col("first_id").cast("string")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for batch in batches:
            made: dict[str, list] = {k.split()[0]: [] for k in INDEX.split(", ")}
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                digest, squeeze = base32(row["sha1"]), zlib.compressobj(6, zlib.DEFLATED, 31)
                data = squeeze.compress(record(row["page_id"], row["url"], digest, row["html"], row["size"], row["refers_to"])) + squeeze.flush()
                out.write(data)
                for k, v in zip(made, (name, at, len(data), row["page_id"], row["url"], digest, "response" if row["refers_to"] is None else "revisit"), strict=True):
                    made[k].append(v)
                at += len(data)
            yield pa.RecordBatch.from_pydict(made, schema=pa.schema([(k.split()[0], pa.int64() if k.endswith("long") else pa.string()) for k in INDEX.split(", ")]))
        if out is not None:
            out.close()

    map_arrow(rows, write, INDEX).write.parquet(f"{folder}/index")
    return read_index(pages, folder)


def read_index(like: DataFrame, folder: str) -> DataFrame:
    return like.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def coalesced(rows: Iterator[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Byte ranges (start, end, records) that join records sorted by offset, ``gap`` apart at most; a range is
    ``most`` bytes long at most, unless a record alone is longer."""
    start = end = None
    held: list[tuple[int, int]] = []
    for offset, length in rows:
        if held and (offset - end > gap or offset + length - start > most):
            yield start, end, held
            held = []
        if not held:
            start = end = offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield start, end, held


def read_records(selected: DataFrame, folder: str, gap: int = 65536, most: int = 8 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """The records (``RECORDS``) of the ``selected`` index rows, read in order of place.

    Archives are dealt out in slices of ``most`` bytes, to as many tasks as ``task_bytes`` of records each need (or
    as run at once, if that is more): index rows are small, so their own size would bring too few tasks.
    """
    total, n = selected.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(n, max(selected.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))))
    places = selected.select("archive", "offset", "length").repartition(tasks, "archive", F.floor(F.col("offset") / most)).sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)
        kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
        schema = pa.schema([(k.split()[0], kinds[k.split()[1]]) for k in RECORDS.split(", ")])
        for batch in batches:
            table = batch.to_pydict()
            bounds = [i for i, a in enumerate(table["archive"]) if not i or a != table["archive"][i - 1]] + [batch.num_rows]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                with store.open_input_file(f"{path}/{table['archive'][lo]}") as archive:
                    for start, end, held in coalesced(zip(table["offset"][lo:hi], table["length"][lo:hi], strict=True), gap, most):
                        archive.seek(start)
                        data = archive.read(end - start)
                        rows, size = [], 0
                        for o, n in held:
                            rows.append(parse_record(zlib.decompress(data[o - start : o - start + n], 31)))
                            size += rows[-1]["payload_bytes"]
                            if size >= HELD_BYTES:
                                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                                rows, size = [], 0
                        if rows:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return map_arrow(places, read, RECORDS)


def archive_and_read(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives (default: into a new part of the shared folder) and read all records back:
    page_id, payload_bytes, payload_digest, record_type, refers_to, with the type of ``pages.page_id``.

    Digest and length of a response are checked against the payload as read; a revisit has those of its response.
    An empty table gives no archive and no rows; repeated rows have records of their own.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType
    index = write_archives(pages, folder, min_revisit_bytes)
    records = read_records(index, folder)
    whole = (F.col("record_type") == "revisit") | (to_base32(F.sha1("payload")) == F.col("digest")) & (F.octet_length("payload") == F.col("payload_bytes"))
    digest = F.when(whole, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs in record "), F.coalesce("page_id", F.lit("of no page")))))
    return records.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def to_base32(sha1_hex: Column) -> Column:
    """Base-32 text of a hexadecimal SHA-1: five hexadecimal digits are four of its digits."""
    group = lambda i: F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 10).cast("int")
    digit = lambda i, k: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(group(i), 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[digit(i, k) for i in range(8) for k in range(4)])
