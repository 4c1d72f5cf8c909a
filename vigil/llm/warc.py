"""WARC archives with revisit records: write each payload once, read the archives back resolved.

Headers ``(record, digest, length)`` are shuffled by payload digest, without the payloads;
the largest record of each digest is the response, the others refer to it. Payloads then meet
only their own header. Each task writes one archive of gzip members, one member per record,
with fresh headers; a revisit record holds no payload. The manifest, committed by Spark's own
writer, lists the archives of the task attempts that counted.

Reading: each archive is parsed record by record; revisits are joined to their responses by
record id, so each page gets the length and digest of its full payload, and can get the
payload itself.

Rules: payloads (UTF-8 of the html; null is empty) below ``MIN_BYTES`` are always responses.
Of rows with the same page id and payload none is larger, so if they are the largest all are
responses. A null page id has no place in the order: such rows are responses, and none refers
to them. An empty table gives no archives. Other columns are ignored; a null url is "about:blank".
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import materialise, open_folder, out_batch, shared_path, small_batches, table, text_or_empty

MIN_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
ID = "urn:page:"
MANIFEST = "file string, n_records long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
_MANIFEST_PA = pa.schema([("file", pa.string()), ("n_records", pa.int64())])
_RECORDS_PA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def with_record_types(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``(page_id, url, html, digest, record_type, refers_to)``: payload digests decide, payloads do not move."""
    html = text_or_empty("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    heads = rows.filter(F.col("page_id").isNotNull() & (F.octet_length("html") >= min_bytes)).select("page_id", "digest")
    largest = heads.groupBy("digest").agg(F.max("page_id").alias("original"), F.min("page_id").alias("least"))
    # Only digests of several pages make revisits; the join is on the headers, then on the rows that revisit.
    largest = largest.filter("original > least").select("digest", "original")
    revisits = heads.join(largest, "digest").filter("page_id < original").select("page_id", "digest", F.col("original").alias("refers_to")).distinct()
    return rows.join(revisits, ["page_id", "digest"], "left").withColumn(
        "record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def record(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    head = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{ID}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE),
            ("WARC-Target-URI", " ".join((url or "about:blank").split())), ("WARC-Payload-Digest", digest),
            ("Content-Type", "application/http; msgtype=response")]
    if record_type == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def read_records(stream):
    """``(headers, block)`` of every record of an archive (a binary stream of gzip members)."""
    lines = gzip.GzipFile(fileobj=stream)
    while first := lines.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := lines.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        block = lines.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("a WARC record is cut short")
        yield head, block


def write_archives(typed: DataFrame, folder: str) -> DataFrame:
    """One archive per task; returns the manifest (materialised)."""
    small_batches(typed.sparkSession)

    def write(batches):
        part, (files, path) = TaskContext.get(), open_folder(folder)
        name, out, n = f"pages-{part.partitionId():06d}-{part.taskAttemptId()}.warc.gz", None, 0
        for b in batches:
            if out is None:
                out = files.open_output_stream(f"{path}/{name}", compression=None)
            for r in b.to_pylist():
                out.write(record(r["page_id"], r["url"], r["html"].encode(), r["record_type"], r["refers_to"]))
                n += 1
        if out is not None:
            out.close()
            yield out_batch(_MANIFEST_PA, [[name], [n]])

    columns = typed.select("page_id", "url", "html", "record_type", "refers_to")
    return materialise(columns.mapInArrow(write, MANIFEST), "warc-manifest")


def _page(uri: str | None) -> int | None:
    number = (uri or "").strip("<>").removeprefix(ID)
    return int(number) if number else None


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Header facts of every record; lengths and digests of payloads are computed from the blocks read."""

    def read(batches):
        files, path = open_folder(folder)
        for b in batches:
            for name in b.column("file").to_pylist():
                with files.open_input_stream(f"{path}/{name}", compression=None) as f:
                    out = []
                    for head, block in read_records(f):
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        revisit = head["warc-type"] == "revisit"
                        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: a payload does not have its digest")
                        out.append((_page(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"],
                                    None if revisit else len(payload), digest, _page(head.get("warc-refers-to"))))
                    for a in range(0, len(out), 5000):
                        yield out_batch(_RECORDS_PA, list(zip(*out[a:a + 5000])))

    return manifest.repartition(max(1, manifest.count()), "file").mapInArrow(read, RECORDS)  # a row per archive


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Join revisits to the responses they refer to, by record id and digest; fills ``payload_bytes``."""
    responses = records.filter("record_type = 'response'")
    originals = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes").join(originals, ["refers_to", "payload_digest"], "left")
    return responses.unionByName(revisits)


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives with revisit records, and what the archives say, resolved."""
    folder = shared_path(spark, "warc")
    files, path = open_folder(folder)
    files.create_dir(path)
    manifest = write_archives(with_record_types(table(spark, sf_dir, "pages")), folder)
    # The records are used twice; stored, the archives are read once.
    records = materialise(read_archives(manifest, folder), "warc-records")
    return resolve_revisits(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
