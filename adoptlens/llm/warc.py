"""WARC archives: write captures as records, read records, assemble transactions.

A capture is a transaction of three records: the request, the response (or a revisit of
an earlier response with the same payload) and metadata. Request and metadata name the
response in WARC-Concurrent-To. Archives are text files whose lines are records: the line
separator is the end of a WARC record, two CRLF. They are read the same way, as streams;
payloads may hold that separator, so the reader puts lines together by Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import whole_text

CRLF = "\r\n"
END = b"\r\n\r\n"
RECORDS_PER_FILE = 3000
#: Records and payload bytes that a reader hands on together.
BATCH_ROWS, BATCH_BYTES = 4096, 32 << 20
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SQL = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
    "headers map<string, string>, fields map<string, string>, payload_bytes long, payload_digest string, payload binary"
)
RECORD = pa.schema(
    [(n, pa.string()) for n in ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri")]
    + [("headers", pa.map_(pa.string(), pa.string())), ("fields", pa.map_(pa.string(), pa.string()))]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base 32: forty bits become eight digits."""
    digits = [
        F.lpad(F.conv(F.substring(F.sha1(data), 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)
    ]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts: Column) -> Column:
    named = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    at = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(named, a, n) for a, n in at)), F.lit(">"))


def _record(kind: Column, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its end; headers with a null value are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    return F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit(f"WARC-Date: {DATE}"),
        *lines,
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        F.lit(""),
        block,
    )


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The pages with digest, keep_id (the page that holds the payload) and copy (1, 2, ...
    among rows with the same page_id and payload).

    Of pages with equal payloads of ``least_bytes`` or more, the one with the largest
    page_id holds it. Only digests and ids meet by payload; a payload moves once, by its
    page_id, so one that a third of all pages share is spread.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace("url", r"[\r\n]+", "%0D%0A").alias("url"),
        whole_text("html").alias("html"),
    ).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    # one key without nulls, so that the payloads meet their ids and are numbered in one shuffle
    key = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest")
    ids = rows.select("page_id", "digest").distinct()
    winners = ids.groupBy("digest").agg(F.max("page_id").alias("keep_id"))
    ids = ids.join(winners, "digest").select(key.alias("__key"), "keep_id")
    rows = rows.withColumn("__key", key).join(ids, "__key")
    copy = F.row_number().over(Window.partitionBy("__key").orderBy("url"))
    rows = rows.withColumn("copy", copy).drop("__key")
    is_small = F.octet_length("html") < least_bytes
    return rows.withColumn("small", is_small)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes one transaction per page of (page_id, url, html) as gzipped WARC files.

    A null html is an empty payload; a null url leaves out the target; line breaks in a url
    are percent-encoded. A page that doesn't hold its payload (see ``captures``) is written
    as a revisit; so is a repeated row. Other columns are ignored. An empty table gives no
    records.
    """
    rows = captures(pages, least_bytes)
    me = [F.col("page_id"), F.col("digest"), F.col("copy")]
    holds = F.col("small") | (F.col("page_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))
    response_id = _urn(*me, F.lit("response"))
    target = ("WARC-Target-URI", F.col("url"))
    size = F.octet_length("html").cast("string")
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF + CRLF)
    )
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    response = _record(
        F.when(holds, F.lit("response")).otherwise(F.lit("revisit")),
        response_id,
        [
            target,
            digest,
            ("WARC-Refers-To", F.when(~holds, _urn(F.col("keep_id"), F.col("digest"), F.lit(1), F.lit("response")))),
            ("WARC-Profile", F.when(~holds, F.lit(PROFILE))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(holds, F.concat(head, F.col("html"))).otherwise(head),
    )
    request = _record(
        F.lit("request"),
        _urn(*me, F.lit("request")),
        [target, ("WARC-Concurrent-To", response_id), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}")),
    )
    metadata = _record(
        F.lit("metadata"),
        _urn(*me, F.lit("metadata")),
        [target, ("WARC-Concurrent-To", response_id), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)),
    )
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    writer = records.write.option("lineSep", END.decode()).option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


class RecordStream:
    """The records of an archive, put together from the pieces between record ends.

    A payload may hold the bytes of a record end, so a record takes pieces until it has
    its Content-Length; each byte is joined once for its headers and once for its block.
    """

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.have, self.need, self.at, self.headers = 0, 0, 0, {}

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """Headers by lower-case name, and the block, of each record that is whole now."""
        self.parts.append(piece + END)
        self.have += len(piece) + len(END)
        while self.have and self.have >= self.need:
            data = b"".join(self.parts)
            if not self.need:
                data = data.lstrip(CRLF.encode())
                self.at = data.find(END) + len(END)
                if self.at >= len(END):
                    lines = data[: self.at - len(END)].decode("utf-8").split(CRLF)
                    self.headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
                    self.need = self.at + int(self.headers["content-length"]) + len(END)
            if self.need and len(data) >= self.need:
                yield self.headers, data[self.at : self.need - len(END)]
                data, self.need = data[self.need :], 0
            self.parts, self.have = [data] * bool(data), len(data)

    def close(self) -> None:
        if self.have and b"".join(self.parts).strip(CRLF.encode()):
            raise ValueError("an archive ends within a record")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive in memory."""
    stream = RecordStream()
    for piece in data.split(END):
        yield from stream.feed(piece)
    stream.close()


def _fields(block: bytes) -> list[tuple[str, str]]:
    lines = block.decode("utf-8", "replace").split(CRLF)
    return [(k.lower(), v) for k, sep, v in (line.partition(": ") for line in lines) if sep]


def _row(headers: dict[str, str], block: bytes, whole: bool) -> tuple:
    kind, fields, payload, size, digest = headers["warc-type"], [], None, None, None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(END)
        fields = _fields(head)
        size = len(payload)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if kind == "revisit":
            size = int(dict(fields)["content-length"])
            digest, payload = headers["warc-payload-digest"].removeprefix("sha1:"), None
    elif kind == "metadata":
        fields = _fields(block)
    ids = headers["warc-record-id"], kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to")
    if whole:
        return *ids, headers.get("warc-target-uri"), list(headers.items()), fields, size, digest, payload
    return *ids, None, None, fields if kind == "metadata" else None, size, digest, None


def read_records(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """One row per record of the gzipped archives in a folder. ``payload_bytes`` and
    ``payload_digest`` are those of the full payload: of the bytes that a response holds,
    and as a revisit states them. Not ``whole``: without headers, target and payload.

    Archives are read as streams, one task per file, so a file may be larger than memory;
    a record may not. An archive that ends within a record raises ValueError.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stream = None, RecordStream()
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*rows)) or [()] * len(RECORD)
            rows.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, RECORD)], schema=RECORD)

        for batch in batches:
            for source, piece in zip(batch["file"], batch["piece"]):
                if source.as_py() != file:
                    stream.close()
                    file, stream = source.as_py(), RecordStream()
                for headers, block in stream.feed(piece.as_py()):
                    rows.append(_row(headers, block, whole))
                    size += len(block) if whole else 0
                    if len(rows) == BATCH_ROWS or size > BATCH_BYTES:
                        yield flush()
        stream.close()
        yield flush()

    pieces = spark.read.option("lineSep", END.decode()).text(path)
    return pieces.select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(read, RECORD_SQL)


def transactions(records: DataFrame) -> DataFrame:
    """One row per capture: record_id, record_type, target_uri, payload_bytes,
    payload_digest, payload, refers_to (record id), and the structs request and metadata
    (null where the archives have none), joined through WARC-Concurrent-To."""
    main = records.filter(F.col("record_type").isin("response", "revisit"))
    out = main.select(
        "record_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "payload", "refers_to",
        F.col("fields").alias("http"),
    )
    for kind in ("request", "metadata"):
        side = records.filter(F.col("record_type") == kind).select(
            F.col("concurrent_to").alias("__to"), F.struct("record_id", "headers", "fields").alias(kind)
        )
        out = out.join(side, F.col("record_id") == F.col("__to"), "left").drop("__to")
    return out


def page_id(metadata: Column) -> Column:
    """The page that a metadata record names; null if it names none."""
    return metadata["fields"]["page-id"].try_cast("long")


def with_referred_page(found: DataFrame, records: DataFrame) -> DataFrame:
    """Adds page_id, and refers_to_page: the page of the response that a revisit refers to,
    as the metadata of that response names it."""
    named = records.filter("record_type = 'metadata'")
    named = named.select(F.col("concurrent_to").alias("__target"), page_id(F.struct("fields")).alias("__page"))
    # every other record looks itself up, so that rows without a reference have no common key
    target = F.coalesce("refers_to", "record_id")
    out = found.withColumn("page_id", page_id(F.col("metadata"))).join(named, target == F.col("__target"), "left")
    return out.withColumn("refers_to_page", F.when(F.col("refers_to").isNotNull(), F.col("__page"))).drop("__target", "__page")
