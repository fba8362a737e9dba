"""WARC archives with revisit resolution.

Headers alone (page, digest, length) are shuffled by payload digest to find the original of each payload; every other
record with that payload becomes a revisit that refers to it. The payloads are then joined with what was decided and
each task writes one gzip-per-record archive with fresh headers. `read_archives` parses the archives again.

Rules: a null html is the empty payload; payloads of fewer than `min_bytes` bytes are always responses; of equal
payloads the record with the largest page_id is the response (all rows that carry that page_id with that payload, where
rows repeat; null ids count as smallest); a null url is written as an urn of the page; very long payloads are written
whole, and equal ones of any number spread over tasks; an empty table gives no archives; extra columns are ignored, whatever
their names. WARC-Date is the time of writing, in UTC, one for all records of a call, unless `date` is given.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, file_system, shared_dir, task_file

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, sha1, origin (page_id of the original, null for one without id): one row per page_id and payload."""
    payload = F.coalesce("html", F.lit(""))
    heads = pages.select(F.col("page_id").cast("long"), F.sha1(payload.cast("binary")).alias("sha1"), F.sha2(payload.cast("binary"), 256).alias("sha256"), F.octet_length(payload).alias("bytes"))
    heads = heads.groupBy("page_id", "sha1", "sha256", "bytes").agg(F.lit(1).alias("one")).drop("one")
    origins = heads.groupBy("sha1", "sha256", "bytes").agg(F.max("page_id").alias("origin"))
    found = heads.join(origins, ["sha1", "sha256", "bytes"])
    return found.select("page_id", "sha1", F.when(F.col("bytes") < min_bytes, F.col("page_id")).otherwise(F.col("origin")).alias("origin"))


def _urn(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _record(page_id, url, payload: bytes, origin, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = page_id != origin
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    uri = "".join(c for c in url if c > " ") if url else f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(origin, digest)}", f"X-Refers-To-Page-ID: {origin}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: datetime | None = None) -> list[tuple[str, int]]:
    """Write deduplicated archives of page_id, url, html into folder; (file, records) of each, as many as tasks."""
    written = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches):
        import pyarrow as pa

        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name, out, n = task_file(base, "pages") + ".warc.gz", None, 0
        for batch in batches:
            ids, urls, origins = (batch.column(c).to_pylist() for c in ("page_id", "url", "origin"))
            html = batch.column("html").cast(pa.binary())
            for i, (page_id, url, origin) in enumerate(zip(ids, urls, origins)):
                out = out or fs.open_output_stream(name, compression=None)
                out.write(gzip.compress(_record(page_id, url, html[i].as_py() or b"", origin, written), 1, mtime=0))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]}, schema=pa.schema([("file", pa.string()), ("records", pa.int64())]))

    rows = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    d = resolve(rows, min_bytes)
    rows = rows.join(d, rows.page_id.eqNullSafe(d.page_id) & (rows.sha1 == d.sha1)).select(rows.page_id, "url", "html", "origin")
    # one row per written file, which the number of tasks bounds
    return [(r.file, r.records) for r in rows.mapInArrow(write, "file string, records long").collect()]


def parse_archive(stream):
    """(headers, HTTP headers, payload) of each record of a decompressed archive."""

    def fields():
        found = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            found[k.lower()] = v.strip()
        return found

    while first := stream.readline():
        if first.strip():
            if not first.startswith(b"WARC/"):
                raise ValueError(f"no WARC record: {first[:40]!r}")
            head = fields()
            block = stream.read(int(head["content-length"]))
            http, _, payload = block.partition(b"\r\n\r\n")
            web = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
            yield head, web, payload


def read_archives(spark: SparkSession, files: list[str]) -> DataFrame:
    """RECORD rows of the archives; a response whose payload does not have its digest or length raises."""
    schema = spark.createDataFrame([], RECORD).schema

    def read(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                fs, path = file_system(name)
                rows = []
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, web, payload in parse_archive(stream):
                        digest, length = head["warc-payload-digest"].removeprefix("sha1:"), int(web["content-length"])
                        if head["warc-type"] == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"damaged record {head['warc-record-id']} in {name}")
                        number = lambda k: int(head[k]) if k in head else None
                        rows.append((number("x-page-id"), length, digest, head["warc-type"], number("x-refers-to-page-id")))
                        if len(rows) == 5000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    return spark.createDataFrame([(f,) for f in files], "file string").mapInArrow(read, schema)


def warc_round(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives of pages to the shared folder and read them back."""
    spark = pages.sparkSession
    return read_archives(spark, [f for f, _ in write_archives(pages, shared_dir(spark, "warc"), min_bytes)])
