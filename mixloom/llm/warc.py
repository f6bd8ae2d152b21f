"""WARC archives: writing captures, reading records, assembling transactions."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES_IN_FILE = 2000
DATE = "2024-01-01T00:00:00Z"
# fixed value: the alphabet of base 32
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_BREAK = "\r\n"
_RECORD_SCHEMA = (
    "type string, record_id string, concurrent_to string, refers_to string, uri string, date string, "
    "content_type string, stated_digest string, fields map<string,string>, "
    "payload_bytes long, payload_digest string, payload binary"
)


def base32_of_hex(hex_digest: Column) -> Column:
    """Base 32 of a SHA-1 given as 40 hex digits, 5 of them (4 signs) at a time."""
    signs = []
    for at in range(0, 40, 5):
        value = F.conv(F.substring(hex_digest, at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(value, shift).bitwiseAND(31) + 1
            signs.append(F.substr(F.lit(ALPHABET), place, F.lit(1)))
    return F.concat(*signs)


def record_uri(*parts: Column) -> Column:
    """A record id that depends on the parts only, so that reruns give the same one."""
    h = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    spans = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *spans), F.lit(">"))


def _header(*fields: tuple[str, Column]) -> Column:
    """A record's header; fields whose value is null are left out."""
    lines = [
        F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit(_BREAK))
        for name, value in fields
    ]
    return F.concat(F.lit("WARC/1.0" + _BREAK), F.concat_ws("", *lines), F.lit(_BREAK))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, pages_in_file: int = PAGES_IN_FILE) -> None:
    """A request, a response or revisit, and a metadata record for every row.

    Of rows with equal payloads of at least ``min_bytes`` the one with the smallest
    page_id is a response and the others revisit it; rows that share this page_id
    are all responses, and so are all rows of a group without any page_id. A null
    html is an empty payload, a null url leaves its header out.

    Archives are gzip files of at most ``pages_in_file`` captures.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    firsts = rows.groupBy("sha").agg(F.min("page_id").alias("first"))
    joined = rows.join(firsts, "sha").withColumn("n", F.octet_length("html").cast("long"))
    revisit = F.coalesce(
        (F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)
    )
    joined = joined.withColumn("revisit", revisit).withColumn(
        "id", record_uri(F.lit("capture"), F.col("page_id"), F.col("sha"))
    )
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha")))
    date = ("WARC-Date", F.lit(DATE))
    target = ("WARC-Target-URI", F.col("url"))
    ask = F.concat(
        F.lit("GET "), F.coalesce(F.regexp_replace("url", r"\s+", ""), F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")
    )
    answer = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n").cast("string"),
        F.lit("\r\n\r\n"),
    )
    notes = F.concat_ws("", F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(_BREAK)))
    block = F.when(F.col("revisit"), answer).otherwise(F.concat(answer, F.col("html")))
    size = lambda c: ("Content-Length", F.octet_length(c).cast("string"))
    capture = F.concat(
        _header(
            ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
            ("WARC-Record-ID", F.col("id")),
            date,
            target,
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
            (
                "WARC-Refers-To",
                F.when(F.col("revisit"), record_uri(F.lit("capture"), F.col("first"), F.col("sha"))),
            ),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            (
                "Content-Length",
                (F.octet_length(answer) + F.when(F.col("revisit"), 0).otherwise(F.col("n"))).cast("string"),
            ),
        ),
        block,
    )

    def beside(kind: str, content_type: str, body: Column) -> Column:
        return F.concat(
            _header(
                ("WARC-Type", F.lit(kind)),
                ("WARC-Record-ID", record_uri(F.lit(kind), F.col("page_id"), F.col("sha"))),
                date,
                target,
                ("WARC-Concurrent-To", F.col("id")),
                ("Content-Type", F.lit(content_type)),
                size(body),
            ),
            body,
        )

    end = _BREAK * 2
    records = F.concat_ws(
        end,
        beside("request", "application/http; msgtype=request", ask),
        capture,
        beside("metadata", "application/warc-fields", notes),
    )
    (
        joined.select(records.alias("value"))
        .write.option("lineSep", end)
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", pages_in_file)
        .text(path)
    )


def records_of(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record; header names in lower case."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        header: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            header[name.strip().lower()] = value.strip()
        length = int(header["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"record {header.get('warc-record-id')} is cut off")
        yield header, block


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in a folder, gzip or plain.

    An archive is read by one task, so archives should be of the usual size (up to a
    gigabyte). ``payloads=False`` keeps only size and digest of the payloads.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(c, pa.string()) for c in ("type", "record_id", "concurrent_to", "refers_to", "uri", "date")]
            + [("content_type", pa.string()), ("stated_digest", pa.string())]
            + [("fields", pa.map_(pa.string(), pa.string()))]
            + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
        )
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                raw = io.BytesIO(data)
                stream = gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw
                rows, held = [], 0
                for header, block in records_of(io.BufferedReader(stream, 1 << 16)):
                    rows.append(_row(header, block, payloads))
                    held += len(block) if payloads else 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, _RECORD_SCHEMA)


def _row(header: dict[str, str], block: bytes, payloads: bool) -> dict:
    kind = header.get("warc-type")
    payload = None
    fields = None
    if header.get("content-type", "").startswith("application/http"):
        _, found, body = block.partition(b"\r\n\r\n")
        if kind == "response" and found:
            payload = body
    elif header.get("content-type") == "application/warc-fields":
        lines = [x.partition(":") for x in block.decode("utf-8", "replace").split(_BREAK) if ":" in x]
        fields = [(name.strip(), value.strip()) for name, _, value in lines]
    else:
        payload = block
    return {
        "type": kind,
        "record_id": header.get("warc-record-id"),
        "concurrent_to": header.get("warc-concurrent-to"),
        "refers_to": header.get("warc-refers-to"),
        "uri": header.get("warc-target-uri"),
        "date": header.get("warc-date"),
        "content_type": header.get("content-type"),
        "stated_digest": header.get("warc-payload-digest"),
        "fields": None if fields is None else list(dict(fields).items()),
        "payload_bytes": None if payload is None else len(payload),
        "payload_digest": None if payload is None else payload_digest(payload),
        "payload": payload if payloads else None,
    }


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, requests, metadata.

    Requests and metadata meet the response or revisit that they name as concurrent;
    those whose response is missing come as a capture with a null response. Records
    that repeat a response's id give a capture each. Info records are left out.
    """
    struct = F.struct(*records.columns)
    capture = ("response", "revisit", "resource", "conversion")
    main = F.col("type").isin(*capture)
    grouped = (
        records.where(F.coalesce(F.col("type"), F.lit("")) != "warcinfo")
        .withColumn("capture_id", F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")))
        .groupBy("capture_id")
        .agg(F.collect_list(struct).alias("records"))
    )
    of = lambda *kinds: F.filter("records", lambda r: r["type"].isin(*kinds))
    return grouped.select(
        "capture_id",
        F.explode_outer(of(*capture)).alias("response"),
        of("request").alias("requests"),
        F.filter("records", lambda r: ~r["type"].isin("request", *capture)).alias("metadata"),
    )


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """page_id, payload size and digest of each capture, a revisit's from its response.

    A revisit whose response is missing has only the digest that its header states.
    """
    flat = captures.where(F.col("response").isNotNull()).select(
        F.get(F.col("metadata"), 0)["fields"]["page-id"].cast("long").alias("page_id"),
        F.col("response.record_id").alias("record_id"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("refers_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.coalesce(
            "response.payload_digest", F.regexp_replace("response.stated_digest", "^sha1:", "")
        ).alias("payload_digest"),
    )
    full = (
        flat.where(F.col("record_type") != "revisit")
        .groupBy(F.col("record_id").alias("of"))
        .agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("full_bytes"))
    )
    plain = flat.where(F.col("record_type") != "revisit").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    again = flat.where(F.col("record_type") == "revisit").join(full, F.col("refers_id") == F.col("of"), "left")
    return plain.union(
        again.select("page_id", F.col("full_bytes"), "payload_digest", "record_type", "refers_to")
    )
