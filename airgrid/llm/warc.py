"""WARC derivatives: a metadata and a plain-text conversion record for each response record.

Derived records name their source in WARC-Refers-To and keep its target, date, payload digest and HTTP headers.  Record
ids are hashes of the source's id and the record type, so a second run gives the same records.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});"
#: Names of characters: those of HTML 4 and the apostrophe of XML; a hard blank counts as a blank.
NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}
BLOCKS = "p|div|h[1-6]|li|ul|ol|tr|td|th|table|article|section|nav|header|footer|main|aside|br|hr|title|blockquote|pre|dl|dt|dd|form"


def _character(entity: Column) -> Column:
    """What a numeric or named reference stands for; itself where it stands for nothing."""
    body = F.substring(entity, 2, 1 << 20)
    body = F.regexp_replace(body, ";$", "")
    code = F.when(F.lower(F.substring(body, 1, 2)) == "#x", F.conv(F.substring(body, 3, 8), 16, 10)).when(body.startswith("#"), F.substring(body, 2, 8)).cast("long")
    real = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    shown = F.when(code == 160, " ").when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    return F.coalesce(F.when(code.isNotNull(), shown).otherwise(F.try_element_at(named, body)), entity)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def decoded(text: Column) -> Column:
    """Character references decoded once each; an ampersand that comes out begins no new one."""

    held = F.lit("\ufdd0")  # stands for an ampersand till all are decoded; no text has this code point

    def replaced(t: Column, pairs: Column) -> Column:
        return F.aggregate(pairs, t, lambda x, p: F.replace(x, p["e"], F.when(p["c"] == "&", held).otherwise(p["c"])))

    def known(t: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0)))
        return F.transform(found, lambda e: F.struct(e.alias("e"), _character(e).alias("c")))

    return _let(text, lambda t: _let(known(t), lambda pairs: F.replace(replaced(t, pairs), held, F.lit("&"))))


def plain_text(html: Column) -> Column:
    """Text of a page: comments, scripts, styles and tags go, block tags end a line, numeric and named character references
    are decoded."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    t = F.regexp_replace(t, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    t = decoded(t)
    t = F.regexp_replace(t, r"[ \t\f\r]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def _urn(text: Column) -> Column:
    h = F.md5(text.cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _one_line(value: Column) -> Column:
    """A header's value; line ends, which would end the header, are percent-encoded."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a page table: page_id, record_id, target_uri, date, http_headers, payload, payload_digest.
    Null urls and pages are empty."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF))
    return pages.select("page_id", _urn(F.concat(F.lit("response|"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("|"), url)).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), html.alias("payload"), _sha256(html).alias("payload_digest"))


def derive(source: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Two rows for each response: ``keep``, warc_type, record_id, refers_to, target_uri, date, payload_digest (the
    source's), block, block_digest, content_length, header.

    ``header`` and ``block`` with an empty line after each, as ``record_text`` joins them, are a WARC/1.1 record.  Null
    payloads are empty and give an empty conversion block.  Line ends in a header's value (a url) are percent-encoded there.  Source rows that repeat give records that repeat.  No shuffle.
    """
    text = plain_text(F.coalesce("payload", F.lit("")))
    title = F.regexp_extract(F.coalesce("payload", F.lit("")), r"(?is)<title[^>]*>(.*?)</title", 1)
    s = source.withColumns({"__text": text, "__title": F.regexp_replace(title, r"[\r\n\t ]+", " ")})
    links = F.regexp_count(F.coalesce("payload", F.lit("")), F.lit(r"(?i)<a\b[^>]*\bhref="))
    lines = F.regexp_count("__text", F.lit(r"[^\n]+"))
    meta = F.concat(
        F.lit("source-digest: "), F.col("payload_digest"), F.lit(CRLF + "title: "), F.col("__title"), F.lit(CRLF + "outlinks: "), links.cast("string"),
        F.lit(CRLF + "text-lines: "), lines.cast("string"), F.lit(CRLF + "text-digest: "), _sha256(F.col("__text")), F.lit(CRLF + "source-http: "),
        F.replace(F.regexp_replace("http_headers", r"[\r\n]+$", ""), F.lit(CRLF), F.lit(CRLF + "source-http: ")), F.lit(CRLF),
    )
    both = F.array(*[F.struct(F.lit(kind).alias("warc_type"), block.alias("block"), F.lit(mime).alias("mime")) for kind, block, mime in (("metadata", meta, "application/warc-fields"), ("conversion", F.col("__text"), "text/plain"))])
    r = s.withColumn("__r", F.explode(both))
    r = r.select(*keep, F.col("__r.warc_type"), _urn(F.concat("__r.warc_type", F.lit("|"), "record_id")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.col("__r.block"), _sha256(F.col("__r.block")).alias("block_digest"), F.octet_length("__r.block").cast("long").alias("content_length"), F.col("__r.mime").alias("mime"))
    fields = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Source-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "mime"), ("Content-Length", "content_length"))
    header = F.concat(F.lit("WARC/1.1" + CRLF), *[F.concat(F.lit(f"{name}: "), _one_line(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(CRLF)) for name, c in fields])
    return r.withColumn("header", header).drop("mime")


def record_text() -> Column:
    """The whole record of a row of ``derive``."""
    return F.concat("header", F.lit(CRLF), "block", F.lit(CRLF + CRLF))
