"""WARC archives with revisit resolution.

``resolve``: headers (id, digest, length) alone are shuffled by payload digest, in a
partial aggregate, so a digest that a third of all records share costs one row a task.
``write_archives`` writes records with fresh headers, revisits without payload.
``read_archives`` parses them, and ``with_originals`` joins revisits to their responses.

Defined results. Null payload: empty payload, always a response. Payloads below
``min_bytes``: responses. Ties: of equal payloads all records that hold the largest id
are responses (a repeated row is stored again, never lost); the rest refer to that id.
A null id counts as the smallest; if a group has only null ids all are responses.
Empty table: an archive of no records. Columns besides id, url and payload are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.shared import new_path, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE = "archive string, segment int, n_records int, content binary"
RECORD = "page_id long, url string, record_type string, payload_digest string, computed_digest string, payload_bytes long, refers_to long"


def _records(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))


def resolve(records: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Revisits as (page_id, digest, refers_to); what it leaves out are responses."""
    headers = records.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= min_bytes)
    best = headers.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and refers_to is not null").drop("copies")
    revisits = headers.join(best, ["digest", "n"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return revisits.groupBy("page_id", "digest").agg(F.max("refers_to").alias("refers_to"))


def _record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    block = http + (payload if refers_to is None else b"")
    fields += [("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, path: str, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", segment_bytes: int = 8 << 20, level: int = 6) -> str:
    """Writes gzipped records (a member each). Every row of the table is a run of whole
    members; those of one ``archive`` in order of ``segment`` are a .warc.gz file. The
    payloads are shuffled by id, which is even, not by digest."""
    revisits = resolve(records, min_bytes)
    rows = records.withColumn("digest", F.sha1("payload")).alias("r").join(
        revisits.alias("v"), F.col("r.page_id").eqNullSafe(F.col("v.page_id")) & (F.col("r.digest") == F.col("v.digest")), "left"
    ).select("r.page_id", "r.url", F.when(F.col("v.refers_to").isNull(), F.col("r.payload")).otherwise("").alias("payload"), "r.digest", "v.refers_to")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, segment, parts, size = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0, [], 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(_record(page_id, url, payload.encode(), digest, refers_to, date)) + z.flush()
                parts.append(member)
                size += len(member)
                if size >= segment_bytes:
                    yield pa.RecordBatch.from_pylist([{"archive": archive, "segment": segment, "n_records": len(parts), "content": b"".join(parts)}], schema=ARROW)
                    segment, parts, size = segment + 1, [], 0
        if parts:
            yield pa.RecordBatch.from_pylist([{"archive": archive, "segment": segment, "n_records": len(parts), "content": b"".join(parts)}], schema=ARROW)

    ARROW = pa.schema([("archive", pa.string()), ("segment", pa.int32()), ("n_records", pa.int32()), ("content", pa.binary())])
    rows.mapInArrow(pack, ARCHIVE).write.option("compression", "none").parquet(path)
    return path


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of concatenated gzip members."""
    view, at, step = memoryview(content), 0, 1 << 14
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:  # fed in steps, so that what follows a member is not copied each time
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            parts.append(z.decompress(view[at : at + step]))
            at += step
        at = min(at, len(view)) - len(z.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if fields.get("WARC-Block-Digest", "") != f"sha1:{hashlib.sha1(block).hexdigest()}":
            raise ValueError(f"block digest differs in {fields.get('WARC-Record-ID')}")
        yield fields, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per stored record; ``payload_bytes`` is null for revisits."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        urn = lambda x: int(x[10:-1]) if x and len(x) > 11 else None
        for batch in batches:
            for content in batch.column("content"):
                out = []
                for fields, block in parse(content.as_py()):
                    payload = block.partition(b"\r\n\r\n")[2]
                    full = fields["WARC-Type"] == "response"
                    out.append({"page_id": urn(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_digest": fields["WARC-Payload-Digest"][5:], "computed_digest": hashlib.sha1(payload).hexdigest() if full else None, "payload_bytes": len(payload) if full else None, "refers_to": urn(fields.get("WARC-Refers-To"))})
                yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("computed_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())])
    return spark.read.schema(ARCHIVE).parquet(path).mapInArrow(unpack, RECORD)


def with_originals(stored: DataFrame) -> DataFrame:
    """Each record with the bytes and digest of its full payload: a revisit's are those
    of the response that it refers to."""
    revisits = stored.where("record_type = 'revisit'")
    targets = stored.where("record_type = 'response'").join(revisits.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct(), ["page_id", "payload_digest"], "left_semi")
    originals = targets.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("n"), F.max("computed_digest").alias("d"))
    joined = revisits.drop("payload_bytes", "computed_digest").join(originals, ["refers_to", "payload_digest"], "left")
    cols = ["page_id", "url", "record_type", "payload_digest", "computed_digest", "payload_bytes", "refers_to"]
    return stored.where("record_type = 'response'").select(cols).unionByName(joined.withColumnsRenamed({"n": "payload_bytes", "d": "computed_digest"}).select(cols))


def deduplicated_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000, path: str | None = None) -> DataFrame:
    spark = pages.sparkSession
    path = write_archives(_records(pages, id_col, url_col, payload_col), path or new_path(spark, "warc"), min_bytes)
    return with_originals(read_archives(spark, path))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicated_archive(table(spark, sf_dir, "pages"))
    return done.select("page_id", "payload_bytes", F.col("computed_digest").alias("payload_digest"), "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(octet_length(CAST(encode(html) AS BLOB)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS best FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM m
"""
