"""WARC derivatives: metadata and plain-text conversion records of response records.

The project reads no web archive, so the operator is general. A response record has ``warc_record_id``,
``warc_target_uri``, ``warc_date`` and ``block`` (the HTTP response: status line, headers, blank line, body).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# fixed values: elements that end a line, and the named references that are resolved (the ampersand last)
LINE_TAGS = r"(?i)<(?:/?(?:p|div|article|section|nav|header|footer|ul|ol|li|table|tr|h[1-6]|blockquote|pre|title)|br)\b[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def digest(value: Column) -> Column:
    """sha1 in base 32, as archives write it."""
    hex_digits = F.sha1(value.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(hex_digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*groups), BASE32_HEX, BASE32))


def record_id(*parts: Column) -> Column:
    """A uuid that depends on the parts only, so a task that runs again writes the same record."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]), F.lit(">"))


def plain_text(body: Column) -> Column:
    """Text of an HTML body: no comments, scripts or styles; block elements end lines; blanks collapse."""
    text = F.regexp_replace(body, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?is)<script\b.*?</script>", "")
    text = F.regexp_replace(text, r"(?is)<style\b.*?</style>", "")
    text = F.regexp_replace(text, r"[\x09-\x0D\x20]+", " ")
    text = F.regexp_replace(text, LINE_TAGS, "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    text = F.regexp_replace(text, r" *\n[ \n]*", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"^[ \n]+", ""), r"[ \n]+$", "")


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header or field lines; a line without value is left out."""
    return F.concat_ws("", *[F.when(v.isNotNull(), F.concat(F.lit(f"{name}: "), v, F.lit(CRLF))) for name, v in pairs])


def derive_records(responses: DataFrame) -> DataFrame:
    """One metadata and one conversion record for each response, with its other columns.

    Adds record_type, record_id, refers_to, target_uri, content_type, content_length, block_digest,
    source_digest, content and record (the whole WARC record). Both name the response in ``WARC-Refers-To`` with its URI
    and date, and each other in ``WARC-Concurrent-To``. The metadata record keeps the HTTP status and
    headers in order, the digests of the response's block and payload, title, language and links in order; the
    conversion record is the plain text. Nothing is shuffled.

    Defined results: a response whose content type is neither HTML nor plain text has only a metadata record; a null block
    is an empty response without status; a block without a blank line is all header; null URI, date or
    id leave their header lines out; repeated responses give equal records; columns ``record_type``.. of the
    input are replaced, ``warc_record_id``, ``warc_target_uri``, ``warc_date`` and ``block`` dropped.
    """
    block = F.coalesce(F.col("block").cast("string"), F.lit(""))
    head = F.substring_index(block, CRLF + CRLF, 1)
    own = ["warc_record_id", "warc_target_uri", "warc_date", "block"]
    added = "record_type record_id refers_to target_uri content_type content_length block_digest source_digest content record".split()
    keep = [c for c in responses.columns if c.lower() not in own and c.lower() not in added]
    df = responses.select(
        F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("none")]).alias("row"),
        F.col("warc_record_id").cast("string").alias("source"), F.col("warc_target_uri").cast("string").alias("uri"),
        F.col("warc_date").cast("string").alias("date"), block.alias("block"), head.alias("head"),
    )
    df = df.withColumn("body", F.expr("substring(block, length(head) + 5)"))
    lines = F.split("head", CRLF)
    headers = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda h: h != "")
    media = F.lower(F.regexp_extract("head", r"(?im)^content-type:[ \t]*([^;\r\n \t]*)", 1))
    df = df.select(
        "row", "source", "uri", "date", "body",
        F.nullif(F.regexp_extract("head", r"^HTTP/[^ ]+ (\d{3})", 1), F.lit("")).alias("status"),
        headers.alias("headers"), media.alias("media"),
        digest(F.col("block")).alias("block_digest"), digest(F.col("body")).alias("payload_digest"),
        record_id(F.lit("metadata"), F.col("source"), F.col("uri"), F.col("date"), F.sha1(F.col("block").cast("binary"))).alias("metadata_id"),
        record_id(F.lit("conversion"), F.col("source"), F.col("uri"), F.col("date"), F.sha1(F.col("block").cast("binary"))).alias("conversion_id"),
    )
    is_html = F.col("media").isin("text/html", "application/xhtml+xml")
    is_text = is_html | (F.col("media") == "text/plain")
    some = lambda c: F.when(is_html & (c != ""), c)
    title = F.trim(F.regexp_replace(F.regexp_extract("body", r"(?is)<title[^>]*>(.*?)</title>", 1), r"[\x09-\x0D\x20]+", " "))
    language = F.regexp_extract("body", r'(?i)<html\b[^>]*\blang="([^"]*)"', 1)
    links = F.when(is_html, F.regexp_extract_all("body", F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), F.lit(1))).otherwise(F.array().cast("array<string>"))
    fields = F.concat(
        _lines(("source-record", F.col("source")), ("source-block-digest", F.col("block_digest")), ("source-payload-digest", F.col("payload_digest")), ("http-status", F.col("status"))),
        F.array_join(F.transform("headers", lambda h: F.concat(F.lit("http-header: "), h, F.lit(CRLF))), ""),
        _lines(("title", some(title)), ("language", some(language))),
        F.array_join(F.transform(links, lambda u: F.concat(F.lit("outlink: "), u, F.lit(CRLF))), ""),
    )
    entry = lambda kind, own_id, other, media, content: F.struct(
        F.lit(kind).alias("record_type"), own_id.alias("record_id"), other.alias("other"), F.lit(media).alias("content_type"), content.alias("content")
    )
    metadata = entry("metadata", F.col("metadata_id"), F.when(is_text, F.col("conversion_id")), "application/warc-fields", fields)
    text = F.when(is_html, plain_text(F.col("body"))).otherwise(F.col("body"))
    conversion = entry("conversion", F.col("conversion_id"), F.col("metadata_id"), "text/plain; charset=UTF-8", text)
    both = F.when(is_text, F.array(metadata, conversion)).otherwise(F.array(metadata))
    df = df.select("row", "source", "uri", "date", "payload_digest", F.inline(both))
    size = F.octet_length("content").cast("bigint")
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _lines(
            ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("uri")),
            ("WARC-Refers-To", F.col("source")), ("WARC-Refers-To-Target-URI", F.col("uri")), ("WARC-Refers-To-Date", F.col("date")),
            ("WARC-Concurrent-To", F.col("other")), ("WARC-Block-Digest", digest(F.col("content"))), ("WARC-Source-Payload-Digest", F.col("payload_digest")),
            ("Content-Type", F.col("content_type")), ("Content-Length", size.cast("string")),
        ),
        F.lit(CRLF),
    )
    return df.select(
        *[F.col("row").getField(c).alias(c) for c in keep],
        "record_type", "record_id", F.col("source").alias("refers_to"), F.col("uri").alias("target_uri"), "content_type",
        size.alias("content_length"), digest(F.col("content")).alias("block_digest"), F.col("payload_digest").alias("source_digest"),
        "content", F.concat(head, F.col("content"), F.lit(CRLF + CRLF)).alias("record"),
    )
