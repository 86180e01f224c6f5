"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_END = "\r\n\r\n"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a hex digest whose length is a multiple of five digits (SHA-1: 40)."""
    groups = [
        F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    # fixed values: the digits of conv() and the base32 alphabet of RFC 4648
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def archive_records(
    pages: DataFrame, smallest: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) of one WARC record per page.

    ``payloads(content_id, payload)`` has each distinct payload once; content_id is its SHA-256.
    ``headers(page_id, content_id, header)`` has each record's header block byte for byte. Of the
    records with equal payloads of at least ``smallest`` bytes the one with the largest page_id is
    the response and the rest are revisits that name it; smaller payloads are always responses.

    Null html: an empty payload. Null url: an empty target. Null page_id: a record of its own, always
    a response, that others do not refer to. Rows that repeat a page_id with one payload: all are
    the response if that id is the largest. Other columns are ignored.
    """
    raw = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"),
    )
    named = raw.select("page_id", "url", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("content_id"))
    newest = named.groupBy("content_id").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1")
    placed = named.join(newest, "content_id", "left")
    revisit = F.coalesce((F.col("size") >= smallest) & (F.col("page_id") < F.col("newest")), F.lit(False))
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.coalesce(_record_id(F.col("page_id")), F.lit("<urn:page:>"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        field("WARC-Payload-Digest", digest),
        F.when(revisit, F.concat(field("WARC-Refers-To", _record_id(F.col("newest"))), field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
    )
    headers = placed.select("page_id", "content_id", F.encode(header, "UTF-8").alias("header"))
    payloads = raw.select(F.sha2("payload", 256).alias("content_id"), "payload").groupBy("content_id").agg(F.any_value("payload").alias("payload"))
    return headers, payloads


def write_archive(pages: DataFrame, path: str, **options) -> None:
    """Write the two stores below ``path``: ``headers`` and ``payloads``."""
    headers, payloads = archive_records(pages, **options)
    headers.write.mode("overwrite").parquet(f"{path}/headers")
    payloads.write.mode("overwrite").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records rebuilt by joining the stores: page_id, header, payload, record, and fields parsed from the header.

    The digests are computed again from the stored bytes. A payload that does not match its
    content_id or its record's digest, or that is missing, raises an error when the record is read.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    payloads = payloads.select("content_id", "payload", (F.sha2("payload", 256) == F.col("content_id")).alias("sound"), base32_of_hex(F.sha1("payload")).alias("digest"))
    text = F.decode("header", "UTF-8")
    part = lambda name: F.regexp_extract(F.col("text"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    headers = spark.read.parquet(f"{path}/headers").withColumn("text", text)
    records = headers.select(
        "page_id", "content_id", "header",
        part("WARC-Type").alias("record_type"),
        F.regexp_replace(part("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        F.nullif(F.regexp_extract(part("WARC-Refers-To"), "^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long").alias("refers_to"),
        part("WARC-Target-URI").alias("url"),
    ).join(payloads, "content_id", "left")
    sound = F.col("sound") & (F.col("digest") == F.col("payload_digest"))
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.where(F.when(F.coalesce(sound, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("content_id"))).cast("boolean"))).select(
        "page_id", "url", "record_type", "payload_digest", "refers_to", "header", "payload",
        F.concat(F.col("header"), body, F.lit(RECORD_END.encode())).alias("record"),
    )


def export_warc(records: DataFrame, path: str) -> None:
    """Write ``records`` of ``read_archive`` as plain .warc text parts, one record after the other."""
    whole = F.decode(F.expr(f"substring(record, 1, octet_length(record) - {len(RECORD_END)})"), "UTF-8")
    records.select(whole.alias("value")).write.mode("overwrite").option("lineSep", RECORD_END).text(path)
