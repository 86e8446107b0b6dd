"""WARC archives: write captures as request, response and metadata records, read them back, assemble them.

Records are built and written by Spark's text writer, whose line separator is the blank line pair that ends a WARC
record, so every part file is an ordinary gzip WARC archive in the shared scratch folder.  They are read as whole
files (a file has at most ``RECORDS_PER_FILE`` captures) and cut by Content-Length.  Captures are put together by a
join on WARC-Concurrent-To.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cytoloom.operators.filters import small
from cytoloom.scratch import bound_batches, materialise, scratch_dir

RECORDS_PER_FILE = 3_000
END = "\r\n\r\n"
#: Payloads shorter than this never become revisits.
LEAST_REVISIT_BYTES = 100
RECORD = "warc_type string, record_id string, concurrent_to string, target_uri string, refers_to string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary"


def _record(kind: str, record_id: Column, block: Column, **headers: Column) -> Column:
    """The text of one record; headers that are null are left out."""
    lines = [F.concat(F.lit(name.replace("_", "-") + ": "), value, F.lit("\r\n")) for name, value in headers.items()]
    head = F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:"), record_id, F.lit(">\r\n"), *[F.coalesce(x, F.lit("")) for x in lines])
    return F.concat(head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def _urn(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("?")) for p in parts]))


def _clean(value: Column) -> Column:
    """A header value without line ends."""
    return F.regexp_replace(value, r"[\r\n]+", " ")


def write_archives(pages: DataFrame) -> str:
    """Write pages (page_id, url, html) as WARC files and return their folder.

    Of captures with equal payloads of LEAST_REVISIT_BYTES bytes or more, the smallest page_id keeps its payload and the others
    become revisit records that name its record and hold no payload.  A null html is an empty payload; a null url gives no
    target; a null page_id never counts as smallest unless all are null.  A record is named by its page_id and payload: rows
    that repeat both are written as often as they come, under one name.  Rows that repeat the smallest page_id are responses too.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    # The text stays out of the shuffle where few payloads occur more than once: their digests are broadcast then.
    seen = rows.where(F.col("bytes") >= LEAST_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(small(seen), "digest", "left")
    later = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False)) & (F.col("bytes") >= LEAST_REVISIT_BYTES)
    rows = rows.withColumn("capture", _urn(F.col("page_id"), F.col("digest"))).withColumn("kind", F.when(later, "revisit").otherwise("response"))
    own, req, meta = F.col("capture"), _urn(F.col("capture"), F.lit("q")), _urn(F.col("capture"), F.lit("m"))
    target, stamp = _clean(F.col("url")), F.lit("2024-01-01T00:00:00Z")
    link, first = (F.concat(F.lit("<urn:uuid:"), x, F.lit(">")) for x in (own, _urn(F.col("first"), F.col("digest"))))
    common = {"WARC_Date": stamp, "WARC_Target_URI": target}
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    whole = _record("response", own, F.concat(http, F.col("html")), **common, WARC_Payload_Digest=digest, Content_Type=F.lit("application/http;msgtype=response"))
    again = _record("revisit", own, http, **common, WARC_Payload_Digest=digest, WARC_Profile=F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), WARC_Refers_To=first, Content_Type=F.lit("application/http;msgtype=response"))
    ask = _record("request", req, F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")), **common, WARC_Concurrent_To=link, Content_Type=F.lit("application/http;msgtype=request"))
    note = _record("metadata", meta, F.coalesce(F.concat(F.lit("page_id: "), F.url_encode(F.col("page_id").cast("string")), F.lit("\r\n")), F.lit("")), **common, WARC_Concurrent_To=link, Content_Type=F.lit("application/warc-fields"))
    records = rows.select(F.explode(F.array(ask, F.when(F.col("kind") == "response", whole).otherwise(again), note)).alias("value"))
    folder = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)
    return folder


def _bytes(content: bytes) -> io.BytesIO:
    """The inflated bytes of a file of one or more gzip members; other files as they are."""
    if content[:2] != b"\x1f\x8b":
        return io.BytesIO(content)
    out = io.BytesIO()
    while content:
        member = zlib.decompressobj(31)
        out.write(member.decompress(content))
        content = member.unused_data
    out.seek(0)
    return out


def parse_records(data: io.BytesIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; a file that ends inside a record is an error."""
    while line := data.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := data.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        block = data.read(size := int(head["content-length"]))
        if len(block) != size:
            raise ValueError("record cut short")
        yield head, block


def _id(value: str | None) -> str | None:
    return value.strip("<>").rpartition(":")[2] if value else None


def _records(keep_payload: bool):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found = []
                for head, block in parse_records(_bytes(bytes(content))):
                    kind, payload, fields = head["warc-type"], b"", {}
                    if kind in ("response", "revisit"):
                        payload = block.partition(b"\r\n\r\n")[2]
                    elif kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode().splitlines() if ": " in x)
                    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else (head.get("warc-payload-digest") or "").rpartition(":")[2]
                    found.append((kind, _id(head["warc-record-id"]), _id(head.get("warc-concurrent-to")), head.get("warc-target-uri"), _id(head.get("warc-refers-to")), fields, len(payload), digest, payload if keep_payload else None))
                yield pd.DataFrame(found, columns=[c.split()[0] for c in RECORD.split(", ")])

    return parse


def read_archives(spark: SparkSession, folder: str, keep_payload: bool = False) -> DataFrame:
    """One row per record of all archives in a folder; the payload digest of responses is computed from the bytes read."""
    bound_batches(spark)
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInPandas(_records(keep_payload), RECORD)


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with the request and metadata records concurrent to it.

    A capture without request or metadata has null there; such records without a capture are left out.  Where several
    records of a kind name one capture, the one with the smallest record id is kept.
    """
    def one(kind: str):
        of_kind = F.col("warc_type") == kind
        return F.min_by(F.when(of_kind, F.struct("record_id", "target_uri", "fields")), F.when(of_kind, F.col("record_id"))).alias(kind)

    side = records.where("warc_type in ('request', 'metadata')").groupBy(F.col("concurrent_to").alias("capture_id")).agg(one("request"), one("metadata"))
    main = records.where("warc_type in ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), "target_uri", F.struct("warc_type", "payload_bytes", "payload_digest", "refers_to", "payload").alias("response"))
    return main.join(side, "capture_id", "left")


def capture_table(pages: DataFrame) -> DataFrame:
    """Write, read back and assemble: page_id, payload_bytes, payload_digest, record_type and refers_to per page.

    A response's size and digest are those of the bytes that were read; a revisit takes its size and the page it refers
    to from the response whose record it names, and keeps the digest that it states.  Ids keep their type.
    """
    id_type = pages.schema["page_id"].dataType
    # The archives are read once; what is kept of them are headers and measures.
    records = materialise(read_archives(pages.sparkSession, write_archives(pages)).drop("payload"), "records").withColumn("payload", F.lit(None).cast("binary"))
    captures = assemble_captures(records).select("capture_id", F.url_decode(F.try_element_at(F.col("metadata.fields"), F.lit("page_id"))).cast(id_type).alias("page_id"), "response.warc_type", "response.payload_bytes", "response.payload_digest", "response.refers_to")
    captures = materialise(captures, "captures")
    own, again = captures.where("warc_type = 'response'"), captures.where("warc_type = 'revisit'").drop("payload_bytes")
    # Only responses that are referred to are looked up; many revisits may name one of them.
    wanted = again.select(F.col("refers_to").alias("capture_id")).distinct()
    wholes = own.join(wanted, "capture_id").groupBy(F.col("capture_id").alias("refers_to")).agg(F.max("page_id").alias("first"), F.max("payload_bytes").alias("payload_bytes"))
    named = again.join(small(wholes), "refers_to", "left").drop("refers_to").withColumnRenamed("first", "refers_to")
    rows = own.withColumn("refers_to", F.lit(None).cast(id_type)).unionByName(named)
    return rows.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")
