"""Content-addressed WARC archive (operator 1).

An archive is a folder with two tables. ``headers`` has one row per record: its exact header bytes
(WARC header block with the line that ends it) and the digest of its payload. ``payloads`` has each
payload once, under its SHA-256. Before payloads are taken as one, the archive holds a second digest and
the length against the first; on reading, the payload is hashed again. Records come back byte for
byte through a join of the two tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
VERSION = "WARC/1.1"
LINE = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SMALLEST_SHARED = 100  # payloads of fewer bytes are stored in full by every record's type


def record_id(page_id: Column) -> Column:
    """A record name made of the page's id alone, so that writing again gives the same bytes."""
    h = F.sha2(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))), 256)
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3),
                    F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def one_line(value: Column) -> Column:
    return F.regexp_replace(value, "[\r\n]+", " ")


def header_block(record_type: Column, date: str) -> Column:
    """The header bytes of a record, from ``page_id url payload_digest payload_bytes refers_to``."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(LINE))

    fields = F.concat(
        F.lit(VERSION + LINE), line("WARC-Type", record_type), line("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col("page_id")), F.lit(">"))),
        line("WARC-Date", F.lit(date)), F.coalesce(line("WARC-Target-URI", one_line(F.col("url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        F.when(record_type == "revisit", F.concat(
            line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<"), record_id(F.col("refers_to")), F.lit(">"))),
            line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")), line("X-Payload-Length", F.col("payload_bytes").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(record_type == "revisit", F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))))
    return F.encode(F.concat(fields, F.lit(LINE)), "UTF-8")


def write_archive(spark: SparkSession, pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", smallest: int = SMALLEST_SHARED) -> None:
    """Write ``pages`` (``page_id url html``) as an archive.

    A null html is the empty payload. Of the records with one payload of at least ``smallest`` bytes
    that with the smallest ``page_id`` is the response and the others are revisits of it; if rows
    repeat that ``page_id``, each of them is a response. Null ids come last. A null url leaves its line
    out; line breaks in a url become spaces; other columns are ignored; an empty table gives an empty
    archive. The payloads of a digest are brought together by partial aggregation, so a payload that
    very many pages share is shuffled once per task, not once per page.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    second = F.xxhash64("payload")
    same = (F.min("second") == F.max("second")) & (F.min("payload_bytes") == F.max("payload_bytes"))
    # The payload itself rides along with the aggregation: any of a digest's rows will do, they are equal.
    stored = rows.withColumn("second", second).groupBy("payload_digest").agg(
        F.first("payload").alias("payload"), F.when(same, F.min("payload_bytes")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256"))).alias("payload_bytes"))
    stored.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/payloads")
    slim = rows.select("page_id", "url", "payload_digest", "payload_bytes")
    first = slim.where(F.col("payload_bytes") >= smallest).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    shared = first.where("n > 1").select("payload_digest", "first_id")
    typed = slim.join(shared, "payload_digest", "left")
    revisit = F.coalesce(F.col("first_id") != F.col("page_id"), F.col("first_id").isNotNull())
    record_type = F.when(revisit, "revisit").otherwise("response")
    typed = typed.withColumn("refers_to", F.when(revisit, F.col("first_id")))
    headers = typed.select(record_id(F.col("page_id")).alias("record_id"), header_block(record_type, date).alias("header"), "payload_digest")
    headers.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """``(record_id, header, payload_digest, payload)`` for every record; fails on a payload that isn't its digest's.

    A revisit comes with the payload that it refers to. A header whose payload is missing fails too.
    """
    headers = spark.read.parquet(f"{folder}/headers")
    payloads = spark.read.parquet(f"{folder}/payloads").withColumnRenamed("payload_digest", "stored_digest")
    joined = headers.join(payloads.select("stored_digest", "payload"), F.col("payload_digest") == F.col("stored_digest"), "left")
    whole = F.sha2("payload", 256) == F.col("payload_digest")
    checked = F.when(whole, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload missing or damaged: "), F.col("payload_digest"))))
    return joined.select("record_id", "header", "payload_digest", checked.alias("payload"))


def records(archive: DataFrame) -> DataFrame:
    """The records' exact WARC bytes: header, the block (none in a revisit), and the two line ends after it."""
    block = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.select("record_id", F.concat(F.col("header"), block, F.lit((LINE * 2).encode())).alias("record"))


def field(name: str, header: str = "header") -> Column:
    """A field's value out of the header bytes; null where it is missing."""
    found = F.regexp_extract(F.decode(F.col(header), "UTF-8"), rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(found != "", found)


def parse_records(raw: DataFrame) -> DataFrame:
    """``(header, block)`` of raw ``record`` bytes: cut behind the first empty line, by the stated length.

    The empty line is sought in the whole record, whatever the length of its header; a record without
    one fails, and so does one that is shorter than it states.
    """
    at = F.expr("instr(decode(record, 'ISO-8859-1'), '\r\n\r\n')")
    end = F.when(at > 0, at + 3).otherwise(F.raise_error(F.lit("a record has no empty line after its header")).cast("int"))
    cut = raw.withColumn("header", F.substring("record", F.lit(1), end))
    length = F.coalesce(field("Content-Length").cast("bigint"), F.lit(0))
    whole = F.octet_length("record") >= F.octet_length("header") + length
    block = F.expr("substring(record, octet_length(header) + 1)")
    stated = F.when(whole, F.substring(block, F.lit(1), length.cast("int"))).otherwise(F.raise_error(F.lit("a record is shorter than it states")).cast("binary"))
    return cut.withColumn("block", stated).drop("record")
