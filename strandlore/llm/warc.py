"""WARC archives as a chunked record table.

A WARC file is the concatenation of its records; here every record is cut into rows (record key,
chunk number, bytes) of at most CHUNK payload bytes, so neither writer nor reader ever allocates a
whole record: a payload of any size streams through in chunks, and each chunk carries the SHA-1 of
the payload up to its end, so damage is found at the chunk where it lies.

Equal payloads of at least MIN_DUPLICATE bytes (by SHA-1, length and a second hash) are stored once, in the record of
the largest page_id; the others become ``revisit`` records (profile identical-payload-digest) without a body. Every
record has an id of its own; that of a response which others revisit follows from its page and payload.

Defined cases: null html is an empty payload; rows that tie at the largest page_id of equal payloads
are all responses, and what revisits them names the page and no record; a page without page_id revisits one that has
it, and is a response if none has; a very long payload streams in chunks; only page_id, url and html are read, whatever
other columns are called; an empty table gives an empty archive, which reads back as an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandlore.llm.common import lookup_join, small_batches
from strandlore.session import cut, shared_folder

CHUNK, MIN_DUPLICATE = 64 * 1024, 1000
ARCHIVE = "record_key string, chunk_no int, data binary, sha1_so_far string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_record_types(pages: DataFrame, url: str = "url") -> DataFrame:
    """Digest, length and record type of each page; only digests that occur twice meet the pages again."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(
        "page_id", F.col(url).alias("url"), body.alias("_body"), F.sha1(body).alias("_digest"), F.octet_length(body).cast("long").alias("_bytes"), F.xxhash64(body).alias("_check")
    )
    same = ["_digest", "_bytes", "_check"]
    ids = rows.where(F.col("_bytes") >= MIN_DUPLICATE).groupBy(*same, "page_id").agg(F.count("*").alias("_n"))
    # null page_ids come before all others
    last = ids.groupBy(*same).agg(F.sum("_n").alias("_all"), F.max(F.struct("page_id", "_n")).alias("_last")).where("_all > 1")
    twice = cut(last.select(*same, F.col("_last.page_id").alias("_keeper"), (F.col("_last._n") == 1).alias("_alone")))
    joined = lookup_join(rows, twice, same, F.col("page_id"), twice.count())
    kept = F.coalesce(F.col("_alone") & (F.col("page_id") == F.col("_keeper")), F.lit(False))
    other = F.col("_keeper").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("_keeper"))) & (F.col("_bytes") >= MIN_DUPLICATE)
    return joined.select("page_id", "url", "_body", "_digest", "_bytes", F.when(other, F.col("_keeper")).alias("_refers"), F.when(other, F.col("_alone")).alias("_named"), kept.alias("_kept"))


def _uuid(page_id: int, digest: str) -> str:
    d = hashlib.md5(f"page:{page_id}:{digest}".encode()).hexdigest()
    return f"{d[:8]}-{d[8:12]}-{d[12:16]}-{d[16:20]}-{d[20:]}"


def _head(record: str, page_id: int | None, url: str | None, digest: str, size: int, refers: int | None, named: bool | None) -> bytes:
    """WARC and HTTP headers of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{record}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (size if refers is None else 0))),
        ("X-Payload-Length", str(size)),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers is not None:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", str(refers))]
    if named:
        fields.append(("WARC-Refers-To", f"<urn:uuid:{_uuid(refers, digest)}>"))
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + http


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payload chunks, each record's in order, into chunks of the archive."""
    running = hashlib.sha1()
    for batch in batches:
        out: dict[str, list] = {"record_key": [], "chunk_no": [], "data": [], "sha1_so_far": []}
        for r in batch.to_pylist():
            part = r["_part"]
            if r["_no"] == 0:
                running = hashlib.sha1()
            running.update(part)
            head = b""
            if r["_no"] == 0:
                record = _uuid(r["page_id"], r["_digest"]) if r["_kept"] else r["_record"]
                head = _head(record, r["page_id"], r["url"], r["_digest"], r["_bytes"], r["_refers"], r["_named"])
            tail = b"\r\n\r\n" if r["_no"] == r["_chunks"] - 1 else b""
            for name, value in zip(out, (r["_record"], r["_no"], head + part + tail, running.hexdigest()), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("record_key", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("sha1_so_far", pa.string())]))


def encode_archive(pages: DataFrame, url: str = "url") -> DataFrame:
    """The chunk rows of the archive. The JVM cuts the payloads; rows never leave their partition."""
    small_batches(pages.sparkSession)
    stored = F.when(F.col("_refers").isNull(), F.col("_body")).otherwise(F.lit(b""))
    rows = with_record_types(pages, url).withColumn("_record", F.expr("uuid()")).withColumn("_body", stored)
    rows = rows.withColumn("_chunks", F.greatest(F.ceil(F.octet_length("_body") / F.lit(CHUNK)), F.lit(1)).cast("int"))
    cols = ["page_id", "url", "_digest", "_bytes", "_refers", "_named", "_kept", "_record", "_chunks"]
    # numbers first: the parts of a payload are never in memory together
    rows = rows.withColumn("_no", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    return rows.select(*cols, "_no", F.substring("_body", F.col("_no") * CHUNK + 1, F.lit(CHUNK)).alias("_part")).mapInArrow(_encode, ARCHIVE)


class _Record:
    """Reads one record chunk by chunk; holds its head until the blank line, never its payload."""

    def __init__(self) -> None:
        self.head, self.fields, self.left, self.size, self.sha = b"", None, 0, 0, hashlib.sha1()

    def feed(self, data: bytes, so_far: str) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            http_end = self.head.find(b"\r\n\r\n", end + 4) if end >= 0 else -1
            if http_end < 0:
                return
            lines = self.head[:end].decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            self.fields = dict(line.split(": ", 1) for line in lines[1:])
            self.left = int(self.fields["Content-Length"]) - (http_end - end)
            data, self.head = self.head[http_end + 4 :], b""
        payload = data[: self.left]
        self.left -= len(payload)
        self.size += len(payload)
        self.sha.update(payload)
        if self.sha.hexdigest() != so_far:
            raise ValueError(f"damaged chunk in {self.fields['WARC-Record-ID']} before byte {self.size}")

    def row(self) -> tuple:
        f = self.fields
        digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        size = int(f["X-Payload-Length"])
        if self.left or f["WARC-Type"] == "response" and (self.size != size or self.sha.hexdigest() != digest):
            raise ValueError(f"incomplete record {f['WARC-Record-ID']}")
        number = lambda k: int(f[k]) if k in f else None
        return number("X-Page-Id"), size, digest, f["WARC-Type"], number("X-Refers-To-Page-Id")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, record = None, None
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for batch in batches:
        rows = []
        for k, data, so_far in zip(batch["record_key"].to_pylist(), batch["data"].to_pylist(), batch["sha1_so_far"].to_pylist(), strict=True):
            if k != key:
                if record:
                    rows.append(record.row())
                key, record = k, _Record()
            record.feed(data, so_far)
        if rows:
            yield table(rows)
    if record:
        yield table([record.row()])


def read_archive(archive: DataFrame) -> DataFrame:
    """One row per record, from its chunks in order; every digest is checked on the way."""
    small_batches(archive.sparkSession)
    return archive.repartition("record_key").sortWithinPartitions("record_key", "chunk_no").mapInArrow(_decode, RECORDS)


def write_archive(pages: DataFrame, path: str, url: str = "url") -> None:
    encode_archive(pages, url).write.option("compression", "zstd").parquet(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages as an archive in the shared folder and reads the records back."""
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_archive(pages, path)
    return read_archive(spark.read.schema(ARCHIVE).parquet(path))
