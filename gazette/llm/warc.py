"""WARC derivatives: a metadata and a plain-text conversion record for every response.

``responses`` turns pages into WARC 1.1 response records. ``derivatives`` reads response records
and makes two records for each: *metadata* (the source's HTTP headers, digests, title, language
and link count, as ``application/warc-fields``) and *conversion* (the visible text of the page).
Both name the response in ``WARC-Refers-To``, keep its target URI and date, and carry the digests
of the source's block and payload. Record ids are name-based, so a rerun makes the same ids.

``write_warc`` and ``read_warc`` store records as WARC files and read them back.

A NULL or empty page gives an empty payload and an empty conversion; a NULL url an empty target.
Repeated rows repeat their records. A NULL page id is the empty name.
"""

from __future__ import annotations

import base64
import hashlib
import html as html_entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.common import slices
from gazette.shipping import ship_package

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
RECORD = T.StructType([T.StructField(name, T.StringType()) for name in (
    "record_type", "record_id", "refers_to", "target_uri", "date", "content_type",
    "block_digest", "payload_digest", "source_block_digest", "source_payload_digest")] + [
    T.StructField("content_length", T.LongType()), T.StructField("block", T.StringType())])
# Order and names of the header lines of a record.
HEADERS = (
    ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"),
    ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
    ("Content-Type", "content_type"), ("WARC-Block-Digest", "block_digest"),
    ("WARC-Payload-Digest", "payload_digest"),
    ("WARC-Source-Block-Digest", "source_block_digest"),
    ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Length", "content_length"))

# A head without an end tag ends before what cannot stand in a head.
HIDDEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<head\b[^>]*>(?:(?:(?!<head\b|<body\b).)*?</head\s*>|(?:\s|<!--(?:(?!<head\b).)*?-->"
    r"|</?(?:base|link|meta)\b[^>]*>"
    r"|<(script|style|template|noscript|title)\b[^>]*>(?:(?!<head\b).)*?</\1\s*>)*+)"
    r"|<(script|style|template|noscript)\b[^>]*>.*?(?:</\2\s*>|\Z)",
    re.IGNORECASE | re.DOTALL)
BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form"
    r"|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|tr|ul)\b[^>]*>",
    re.IGNORECASE)
TAG = re.compile(r"<[!/?A-Za-z][^>]*>?")
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.IGNORECASE | re.DOTALL)
LANGUAGE = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.IGNORECASE)
LINK = re.compile(r"<a\b[^>]*?\bhref\s*=", re.IGNORECASE)
BLANK = re.compile(r"[^\S\n]+")
LINES = re.compile(r" ?\n[\n ]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(names))}>"


def one_line(value: str) -> str:
    """A header value cannot hold line breaks."""
    return " ".join(value.split())


def plain_text(page: str) -> str:
    """The visible text: one line per block element, white space collapsed, entities resolved."""
    text = HIDDEN.sub(" ", page)
    # White space of the source separates words, only block elements break lines.
    text = BREAK.sub("\n", re.sub(r"\s+", " ", text))
    text = html_entities.unescape(TAG.sub("", text))
    return LINES.sub("\n", BLANK.sub(" ", text)).strip()


def split_http(block: str) -> tuple[str, str]:
    """The HTTP header lines and the payload of a response block."""
    head, found, payload = block.partition("\r\n\r\n")
    return (head, payload) if found else ("", block)


def response(page_id: str, url: str, page: str) -> dict:
    raw = page.encode("utf-8", "replace")
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(raw)}\r\n\r\n")
    block = head.encode() + raw
    return {
        "record_type": "response", "record_id": record_id("response", page_id, url),
        "refers_to": None, "target_uri": one_line(url), "date": DATE,
        "content_type": "application/http; msgtype=response", "block_digest": digest(block),
        "payload_digest": digest(raw), "source_block_digest": None,
        "source_payload_digest": None, "content_length": len(block), "block": head + page}


def derived(source: dict) -> list[dict]:
    """The metadata and the conversion record of a response record."""
    head, page = split_http(source["block"] or "")
    title = TITLE.search(page)
    language = LANGUAGE.search(page)
    fields = [("source-header", one_line(line)) for line in head.split("\r\n") if line]
    fields += [
        ("source-content-length", str(source["content_length"])),
        ("title", one_line(html_entities.unescape(title[1])) if title else ""),
        ("language", language[1].lower() if language else ""),
        ("outlinks", str(sum(1 for _ in LINK.finditer(page)))),
    ]
    described = "".join(f"{name}: {value}\r\n" for name, value in fields)
    out = []
    for kind, content_type, block in (
            ("metadata", "application/warc-fields", described),
            ("conversion", "text/plain; charset=utf-8", plain_text(page))):
        raw = block.encode("utf-8", "replace")
        out.append({
            "record_type": kind, "record_id": record_id(kind, source["record_id"]),
            "refers_to": source["record_id"], "target_uri": source["target_uri"],
            "date": source["date"], "content_type": content_type, "block_digest": digest(raw),
            "payload_digest": digest(raw), "source_block_digest": source["block_digest"],
            "source_payload_digest": source["payload_digest"], "content_length": len(raw),
            "block": block})
    return out


def _mapped(frame: DataFrame, keep: str, made) -> DataFrame:
    """``keep`` and the fields of each record that ``made`` makes of a row."""
    schema = T.StructType([frame.schema[keep], *RECORD])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for part in slices(batches):
            rows = [{keep: row[keep], **record} for row in part.to_pylist() for record in made(row)]
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    ship_package(frame.sparkSession)
    return frame.mapInArrow(run, schema)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """``id_col`` and a response record for every page."""
    def made(row: dict) -> list[dict]:
        name = "" if row[id_col] is None else str(row[id_col])
        return [response(name, row[url_col] or "", row[html_col] or "")]

    return _mapped(pages.select(*dict.fromkeys([id_col, url_col, html_col])), id_col, made)


def derivatives(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``id_col``, a metadata and a conversion record for every response; others are passed over."""
    return _mapped(records.where(F.col("record_type") == "response").select(
        id_col, *RECORD.names), id_col, derived)


def serialised(records: DataFrame) -> DataFrame:
    """One column ``value``: the record's header lines, an empty line, and its block."""
    lines = [F.concat(F.lit(f"{name}: "), F.col(column).cast("string"), F.lit("\r\n"))
             for name, column in HEADERS]
    return records.select(F.concat(
        F.lit(VERSION + "\r\n"), *[F.coalesce(line, F.lit("")) for line in lines],
        F.lit("\r\n"), F.coalesce("block", F.lit(""))).alias("value"))


def write_warc(records: DataFrame, path: str, records_per_file: int = 50_000) -> None:
    """WARC files, compressed by gzip; the line end of the text writer closes each record."""
    serialised(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file).text(path)


def parsed(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, by their content length."""
    at = 0
    while True:
        start = data.find(VERSION.encode(), at)
        if start < 0:
            return
        end = data.index(b"\r\n\r\n", start)
        lines = data[start:end].decode().split("\r\n")[1:]
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                      for line in lines)
        length = int(fields["Content-Length"])
        at = end + 4 + length
        record = {column: fields.get(name) for name, column in HEADERS}
        yield record | {"content_length": length, "block": data[end + 4:at].decode()}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and the fields of each record of the WARC files in a folder, one task per file."""
    import gzip

    files = spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("file"), "content")

    def made(row: dict) -> Iterator[dict]:
        raw = row["content"]
        return parsed(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)

    return _mapped(files, "file", made)
