"""WARC derivative builder.

Captured pages are response records; each becomes a metadata record (title, language, character and
link counts, and the source's HTTP headers and digests) and a conversion record (the plain text). Both
name the response in WARC-Refers-To, and carry its target and date. Record ids are urn:uuids derived
from page id, target and payload digest, so that a second run gives the same ones and any executor can
recompute them. Digests are sha256 over the exact bytes.

Rows are converted one by one: no shuffle. ``records`` gives the serialised bytes of any record,
``write_warc`` one file a partition, ``parse`` reads them back.

Defined results: a null page has an empty payload and an empty conversion; a record without a target has
no WARC-Target-URI header; line breaks in a target are percent-encoded; repeated rows give equal
records; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CRLF, DATE = "\r\n", "2026-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<head\b[^>]*>.*?(?:</head\s*>|(?=<body\b))|<title\b[^>]*>.*?</title\s*>|</?([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>|<[!?/][^>]*>", re.S | re.I)
SPACES, LINES = re.compile(r"[^\S\n]+"), re.compile(r" ?\n[ \n]*")


def plain_text(page: str | None) -> str:
    """The visible text: block elements end lines, runs of blanks are one, no empty lines."""
    if not page:
        return ""
    text = TOKEN.sub(lambda m: "\n" if (m[2] or "").lower() in BLOCKS else "", page.replace("\n", " ").replace("\r", " "))
    return LINES.sub("\n", SPACES.sub(" ", entities.unescape(text))).strip()


@F.pandas_udf(T.StringType())
def _plain(pages: pd.Series) -> pd.Series:
    return pages.map(plain_text)


def urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cuts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(block, "UTF-8"), 256))


def responses(pages: DataFrame) -> DataFrame:
    """One response record for each captured page; its date and HTTP header are those of the columns date and http_header where there are such, else DATE and one made of HTTP and the payload's length."""
    payload = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit(HTTP), F.octet_length(payload).cast("string"), F.lit(CRLF + CRLF))
    head = F.coalesce("http_header", head) if "http_header" in pages.columns else head
    date = F.coalesce("date", F.lit(DATE)) if "date" in pages.columns else F.lit(DATE)
    return pages.select(
        "page_id", F.lit("response").alias("record_type"), F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("target_uri"), date.alias("date"),
        head.alias("http_header"), payload.alias("payload"),
    ).withColumns({"payload_digest": digest(F.col("payload")), "block": F.concat("http_header", "payload")}).withColumns({
        "record_id": urn(F.lit("response"), F.col("page_id"), F.col("target_uri"), F.col("payload_digest")),
        "refers_to": F.lit(None).cast("string"), "content_type": F.lit("application/http; msgtype=response"), "block_digest": digest(F.col("block")),
    })


def derivatives(source: DataFrame) -> DataFrame:
    """Two records for each response: metadata and conversion."""
    own = source.withColumn("_text", _plain("payload"))
    title = F.trim(F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title", 1))
    flat = F.regexp_replace(F.rtrim(F.regexp_replace("http_header", CRLF, " | ")), r"[ |]+$", "")
    fields = F.concat(
        F.lit("title: "), F.regexp_replace(title, r"\s+", " "), F.lit(CRLF + "language: "), F.regexp_extract("payload", r"(?i)<html[^>]*\blang=\"?([A-Za-z-]+)", 1),
        F.lit(CRLF + "outlinks: "), F.size(F.regexp_extract_all("payload", F.lit(r"(?i)<a\s[^>]*href="), F.lit(0))).cast("string"),
        F.lit(CRLF + "textChars: "), F.length("_text").cast("string"), F.lit(CRLF + "sourcePayloadDigest: "), F.col("payload_digest"),
        F.lit(CRLF + "sourceBlockDigest: "), F.col("block_digest"), F.lit(CRLF + "sourceHeader: "),
        flat, F.lit(CRLF),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("_text").alias("block")),
    )
    return (
        own.select("page_id", "target_uri", "date", F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("source_digest"), flat.alias("source_header"), F.explode(kinds).alias("k"))
        .select("page_id", "k.record_type", "refers_to", "target_uri", "date", "source_digest", "source_header", "k.content_type", "k.block")
        .withColumns({"record_id": urn(F.col("record_type"), F.col("refers_to")), "block_digest": digest(F.col("block")), "content_length": F.octet_length("block").cast("bigint")})
    )


def header(kind: str = "record_type", derived: bool = True) -> Column:
    """The header of a record; derived ones name the source's payload digest and HTTP header too."""
    def line(name: str, value: Column) -> Column:
        return F.when(value.isNull(), "").otherwise(F.concat(F.lit(name + ": "), value, F.lit(CRLF)))

    return F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.col(kind)), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Block-Digest", F.col("block_digest")),
        *([line("X-Source-Payload-Digest", F.col("source_digest")), line("X-Source-HTTP-Header", F.col("source_header"))] if derived else []),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF),
    )


def _head(df: DataFrame) -> Column:
    return header(derived="source_digest" in df.columns and "source_header" in df.columns)


def records(df: DataFrame) -> DataFrame:
    """(record_id, record): the bytes of each record."""
    return df.select("record_id", F.encode(F.concat(_head(df), F.col("block"), F.lit(CRLF + CRLF)), "UTF-8").alias("record"))


def write_warc(df: DataFrame, path: str) -> None:
    """One gzip file a partition, with nothing between the records: the last line feed of each is the writer's line separator."""
    body = df.select(F.concat(_head(df), F.col("block"), F.lit(CRLF + "\r")).alias("value"))
    body.write.option("lineSep", "\n").option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        yield {"version": lines[0], **fields}, data[start:stop]
        at = stop + 4


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derivatives(responses(table(spark, sf_dir, "pages")))
    return made.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length", header().alias("header"), F.col("block").alias("content"))
