"""Web archives: write records, index them first, read back selected byte ranges.

``decide`` finds the record type of each page: of pages with equal payloads of at least
``least`` bytes the one with the smallest id is a response and the others are revisits that
refer to it; shorter payloads are always responses. ``write`` writes gzip members to archive
files in a shared folder, a file per task or more, and returns an index with the file,
offset, length, URL and digest of every record. ``read`` takes any selection of index rows,
sorts it by file and offset, joins neighbouring ranges into one read and parses the records.
A payload whose digest differs from its header's is an error.

A task that is repeated writes files of new names; the index names only those of the attempt
that counted, so lost executors leave unused files and never a wrong record.

Null html is an empty payload, a null url has no target header, a null id stands after all
others. Repeated rows are as many records; of equal ones one is the response. One record
is held in memory at a time, of any length. Equal ids with equal payloads go by url.
Extra columns are ignored. An empty table gives no records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_map, cut, scratch_path

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: An archive file is closed when it has so many bytes.
FILE_BYTES = 1 << 30
#: Ranges with a gap of at most so many bytes are one read of at most READ bytes.
GAP, READ = 1 << 16, 1 << 23
#: Bytes of one file whose records are read by the same task.
REGION = 1 << 26
#: Copies of a repeated row that one row is unfolded to at a time.
COPIES = 4096
#: Fixed value: the profile of a revisit with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CONTROL = re.compile(r"[\x00-\x20\x7f%]")


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of every row.

    Payloads of revisits are null: they are not written.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        "page_id",
        "url",
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
    )
    # one row per digest that occurs again: the smallest id, and how many rows are equal to that one
    same = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "page_id", "url")
    order = F.struct(
        F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url", "copies"
    )
    firsts = (
        same.agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("payload_digest")
        .agg(F.min(order).alias("first"), F.sum("copies").alias("n"))
        .filter("n > 1")
        .select("payload_digest", "first")
    )
    firsts = cut(firsts)
    first = F.col("first")
    is_first = F.col("page_id").eqNullSafe(first["page_id"]) & F.col("url").eqNullSafe(first["url"])
    revisits = first.isNotNull() & ~is_first
    joined = rows.join(firsts, "payload_digest", "left")
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def typed(df: DataFrame) -> DataFrame:
        return df.select(
            "page_id",
            "url",
            F.when(~revisits, F.col("payload")).alias("payload"),
            "payload_bytes",
            "payload_digest",
            F.when(revisits, "revisit").otherwise("response").alias("record_type"),
            F.when(revisits, first["page_id"]).alias("refers_to"),
        )

    tied = firsts.filter(first["copies"] > 1)
    if tied.isEmpty():
        return typed(joined)
    # rows equal to the first in everything: one response, the others revisit it
    repeated = is_first & (first["copies"] > 1)
    single = typed(joined.filter(~F.coalesce(first.isNotNull() & repeated, F.lit(False))))
    one = typed(joined.filter(first.isNotNull() & repeated).dropDuplicates(["payload_digest"]))
    size = one.select("payload_digest", "payload_bytes")
    parts = tied.join(size, "payload_digest").withColumn("left", first["copies"] - 1)
    parts = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("left") - 1) / COPIES))))
    spread = parts.repartition("payload_digest", "part").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("left") - F.col("part") * COPIES)))
    )
    others = spread.select(
        first["page_id"].alias("page_id"),
        first["url"].alias("url"),
        F.lit(None).cast("binary").alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.lit("revisit").alias("record_type"),
        first["page_id"].alias("refers_to"),
    )
    return single.unionByName(one).unionByName(others).select(*columns)


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder that Spark names, and the folder's path in it."""
    uri = re.sub(r"\Afile:/+", "file:///", folder)
    return fs.FileSystem.from_uri(re.sub(r"\As3[an]:", "s3:", uri))


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def _packed(raw: bytes, level: int) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(raw) + engine.flush()


def _escaped(value: str | None) -> str | None:
    """Header values hold no control characters or blanks."""
    return None if value is None else _CONTROL.sub(lambda m: quote(m[0], safe=""), value)


def response_id(digest: str) -> str:
    """The record id of the response that revisits of a payload refer to."""
    return f"<urn:uuid:{uuid.UUID(digest[:32])}>"


def record(row: dict, name: str, date: str, least: int = LEAST) -> bytes:
    """One record as bytes; ``name`` tells records without a shared payload apart."""
    response = row["record_type"] == "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    block = http.encode() + (row["payload"] if response else b"")
    shared = response and row["payload_bytes"] >= least
    own = response_id(row["payload_digest"]) if shared else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", own),
        ("WARC-Date", date),
        ("WARC-Target-URI", _escaped(row["url"])),
        ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
        ("WARC-Refers-To", None if response else response_id(row["payload_digest"])),
        ("WARC-Profile", None if response else PROFILE),
        ("Page-ID", _escaped(row["page_id"])),
        ("Refers-To-Page-ID", _escaped(row["refers_to"])),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return _header(fields) + block + b"\r\n\r\n"


def write(records: DataFrame, folder: str, level: int = 6, file_bytes: int = FILE_BYTES, least: int = LEAST) -> DataFrame:
    """Write the rows of ``decide`` as archives in ``folder``; returns the index, a written table.

    Index: ``file, offset, length, page_id, url, payload_digest, record_type, refers_to``.
    """
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    kind = records.schema["page_id"].dataType.simpleString()
    named = records.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    about = ["page_id", "url", "payload_digest", "record_type", "refers_to"]
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)
        store.create_dir(path, recursive=True)
        context = TaskContext.get()
        out = name = None
        at = 0
        for batch in batches:
            place = []
            for row in batch.to_pylist():
                if out is None:
                    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                    info = b"format: WARC File Format 1.1\r\n"
                    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
                    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", own), ("WARC-Date", date)]
                    fields += [("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]
                    head = _packed(_header(fields) + info + b"\r\n\r\n", level)
                    out.write(head)
                    at = len(head)
                raw = _packed(record(row, f"{name}:{at}", date, least), level)
                out.write(raw)
                place.append((name, at, len(raw)))
                at += len(raw)
                if at >= file_bytes:
                    out.close()
                    out = None
            columns = zip(*place) if place else ([], [], [])
            arrays = [pa.array(v, f.type) for v, f in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays(arrays + [batch.column(c) for c in about], schema.names + about)
        if out is not None:
            out.close()

    index = arrow_map(
        named,
        work,
        "file string, offset bigint, length bigint, page_id string, url string, payload_digest string, "
        "record_type string, refers_to string",
    )
    return cut(index.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")}))


def parse(raw: bytes) -> dict:
    """The fields of a record and its payload; null payload for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    text = {k: unquote(fields[k], errors="surrogatepass") for k in ("Page-ID", "WARC-Target-URI", "Refers-To-Page-ID") if k in fields}
    return {
        "page_id": text.get("Page-ID"),
        "url": text.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": text.get("Refers-To-Page-ID"),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if response else None,
    }


def coalesced(ranges: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted ``(file, offset, length)`` joined to ``(file, start, end, its ranges)``."""
    run = None
    for file, offset, length in ranges:
        end = offset + length
        if run and run[0] == file and offset - run[2] <= GAP and end - run[1] <= READ:
            run = (file, run[1], max(end, run[2]), run[3])
        else:
            if run:
                yield run
            run = (file, offset, end, [])
        run[3].append((offset, length))
    if run:
        yield run


def read(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of the index rows given: their fields, and with ``payload`` the bytes of responses."""
    kind = index.schema["page_id"].dataType.simpleString()
    region = F.floor(F.col("offset") / REGION)
    sorted_ranges = (
        index.select("file", "offset", "length")
        .repartition("file", region)
        .sortWithinPartitions("file", "offset")
    )
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payload
    types = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, types.get(n, pa.string())) for n in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)

        def ranges() -> Iterator[tuple[str, int, int]]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)))

        opened = source = None
        for file, start, end, wanted in coalesced(ranges()):
            if file != opened:
                if source is not None:
                    source.close()
                opened, source = file, store.open_input_file(f"{path}/{file}")
            raw = source.read_at(end - start, start)
            rows = []
            for offset, length in wanted:
                found = parse(zlib.decompress(raw[offset - start : offset - start + length], 31))
                rows.append(found if payload else {k: v for k, v in found.items() if k != "payload"})
            yield pa.RecordBatch.from_pylist(rows, schema)
        if source is not None:
            source.close()

    ddl = ", ".join(f"{n} " + {"payload_bytes": "bigint", "payload": "binary"}.get(n, "string") for n in names)
    found = arrow_map(sorted_ranges, work, ddl)
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages in the shared folder and read every record back, payloads left out."""
    folder = scratch_path(pages.sparkSession, "archive")
    return read(write(decide(pages), folder), folder, payload=False)
