"""WARC records in ZIP archives: writing with revisits, and reading by ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, input_splits, join_spread
from .ziparchive import open_system, Remote, Source, ZipReader, ZipWriter

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, name: uuid.UUID, url: str | None, kind: str, payload: bytes | None, size: int, payload_digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response holds the payload; a revisit has only the HTTP head, which states its length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"") if kind == "response" else head
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"X-Refers-To-Page: {refers_to}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers in lower case, HTTP head, payload)."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not sep or not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def read_archive(source: Source) -> Iterator[tuple[dict, dict[str, str], bytes, bytes]]:
    """(index entry, WARC headers, HTTP head, payload) of every indexed record, each read by its own range."""
    z = ZipReader(source)
    begin = z.start(DATA)
    size = z.members[DATA].size
    for line in z.read(INDEX).decode().split("\n")[:-1]:
        entry = json.loads(line.split(" ", 2)[2])
        if entry["offset"] + entry["length"] > size:
            raise ValueError("index entry outside the archive member")
        yield entry, *parse_record(gzip.decompress(source.read_at(begin + entry["offset"], entry["length"])))


def classify(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """pages(id, url, html) with record_type and refers_to; one payload's largest id is its response. html isn't null; null ids are below
    all others; a payload of very many pages is joined by broadcast; an empty table gives none."""
    keyed = pages.withColumn("sha", F.sha2("html", 256))
    facts = scratch.keep(keyed.select("id", F.octet_length("html").alias("size"), "sha").distinct(), "facts")
    owner = scratch.keep(facts.groupBy("sha", "size").agg(F.max("id").alias("own"), F.count(F.lit(1)).alias("n")), "owner")
    again = (F.col("size") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("own"))
    kinds = join_spread(facts, owner, ["sha", "size"], "n", facts.count()).select(F.col("id").alias("k_id"), F.col("sha").alias("k_sha"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("own")).alias("refers_to"))
    kinds = scratch.keep(kinds, "kinds")
    return keyed.join(kinds, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("sha") == F.col("k_sha"))).select("id", "url", "html", "record_type", "refers_to")


def write_archives(records: DataFrame, folder: str, archive_bytes: int = 32 << 20, zip64: bool = True) -> DataFrame:
    """Writes the records as ZIP archives under folder, which all executors must share; returns the manifest (path, records).

    A task writes archives of about archive_bytes under names of its own, so that one which is retried leaves no half
    archive in the manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_system(folder)
        system.create_dir(base, recursive=True)
        data, index = io.BytesIO(), []

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.zip"
            with system.open_output_stream(f"{base}/{name}") as out:
                z = ZipWriter(out, zip64)
                z.add(DATA, data.getvalue())
                z.add(INDEX, "".join(sorted(index)).encode())
                z.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64())], names=["path", "records"])

        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                for r in batch.slice(s, 64).to_pylist():
                    payload = (r["html"] or "").encode()
                    d = digest(payload)
                    raw = gzip.compress(build_record(r["id"], uuid.uuid4(), r["url"], r["record_type"], payload, len(payload), d, r["refers_to"]), 1, mtime=0)
                    entry = {"url": r["url"], "digest": f"sha1:{d}", "offset": data.tell(), "length": len(raw), "page": r["id"]}
                    index.append(f"{quote(r['url'] or '', safe=':/?&=') or '-'} 19700101000000 {json.dumps(entry)}\n")
                    data.write(raw)
                    if data.tell() >= archive_bytes:
                        yield flush()
                        data, index = io.BytesIO(), []
        if index:
            yield flush()

    return records.select("id", "url", "html", "record_type", "refers_to").mapInArrow(write, "path string, records bigint")


def read_archives(manifest: DataFrame, id_type: T.DataType) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of all records of the archives listed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for _, head, http, payload in read_archive(Remote(path)):
                    stated = head["warc-payload-digest"].removeprefix("sha1:")
                    (length,) = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    if head["warc-type"] == "response" and (digest(payload) != stated or len(payload) != length):
                        raise ValueError(f"payload of {head['warc-record-id']} in {path} doesn't match its digest")
                    num = lambda v: int(v) if v not in (None, "", "None") else None
                    rows.append((num(head["x-page-id"]), length, stated, head["warc-type"], num(head.get("x-refers-to-page"))))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])

    return manifest.select("path").mapInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 32 << 20) -> DataFrame:
    """Writes pages(page_id, url, html) as WARC records in ZIP archives and reads them back.

    page_id, payload_bytes, payload_digest, record_type, refers_to. Of pages with equal payloads of at least min_bytes the
    largest page_id is the response, the others are revisits of it. Payloads are shuffled once, to meet their record type;
    archives hold gzip members, so that a record is one range of a stored ZIP member.

    Nulls: a null html is an empty payload; a null url an empty target; a null page_id is below all others and
    stays null. Empty payloads are equal to each other. Rows that repeat a page_id with one payload are records of one kind. Ids must be
    integers. Long payloads are one record. Other columns are not read. An empty table writes no archive and gives no rows.
    """
    spark: SparkSession = pages.sparkSession
    scratch = Scratch(spark, "warc")
    open_system(scratch.path("archives"))  # a folder that can't be opened is told before anything runs
    src = pages.select(F.col("page_id").cast("bigint").alias("id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    parts = max(input_splits(pages), int(spark.conf.get("spark.sql.shuffle.partitions")))
    manifest = scratch.keep(write_archives(classify(src, scratch, min_bytes), scratch.path("archives"), archive_bytes), "manifest")
    return read_archives(manifest.repartition(parts), T.LongType())
