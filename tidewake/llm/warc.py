"""WARC as a content-addressed archive, in DataFrame functions.

An archive is two tables: payloads (SHA-256 digest, bytes, each stored once and verified when read) and records
(the exact header bytes of every record with its payload's digest). Original records are rebuilt by a join
on the digest: header, blank line, payload, two line ends.

Of records with equal payloads of at least 100 bytes the one with the smallest page_id is the response and the
others revisit it; smaller payloads are all responses. Defined results: a null html is an empty payload; null
urls are written as an empty target, and control characters and blanks of a url in percent form; rows with a null
page_id come first in that order and a revisit of one has no number to refer to; of rows that repeat the smallest
page_id one is the response; every record has an id of its own; an empty table gives an empty archive; columns other
than page_id, url and html are not read. The block of a record is the payload itself, without a protocol header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import passing, scratch, stored

LEAST_REVISIT = 100
CRLF = "\r\n"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _uuid(digest: Column) -> Column:
    """A name-based identifier from a hex digest."""
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))


def record_id(page_id: Column, row: Column, digest: Column) -> Column:
    name = F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), row.cast("string"), F.lower(F.hex(digest)))
    return F.concat(F.lit("<urn:uuid:"), _uuid(F.sha2(name, 256)), F.lit(">"))


def escaped(url: Column) -> Column:
    """url with control characters and blanks in percent form, so that it cannot end its header line."""
    out = url
    for c in (*range(33), 127):
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url.rlike("[\\x00-\\x20\\x7F]"), out).otherwise(url)


def header(date: str = "1970-01-01T00:00:00Z") -> Column:
    """Exact header bytes of a record, up to and with the blank line before the block. date: of all records of a run, as pages have none."""
    revisit = F.col("record_type") == "revisit"
    text = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", escaped(F.coalesce(F.col("url"), F.lit("")))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))),
        F.when(revisit, _line("WARC-Refers-To", record_id(F.col("first_id"), F.col("first_row"), F.col("digest")))).otherwise(F.lit("")),
        F.when(revisit, _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
        F.lit(CRLF),
    )
    return F.encode(text, "UTF-8")


def write_archive(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT) -> None:
    """Archive pages (page_id, url, html) under path as the tables payloads and records."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    with passing(spark):
        # rows without payloads are numbered once and stored, so the number holds in all that follows
        lean = stored(rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row")), "warc-rows")
        # equal digests have equal payloads, so the map side keeps one of each
        rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
        first = lean.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id").alias("id"), "row")).alias("first"))
        first = stored(first.select("digest", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row")), "warc-first")
        heads = lean.join(first.hint("merge"), "digest")
        revisit = (F.col("n_bytes") >= least_revisit) & (F.col("row") != F.col("first_row"))
        heads = heads.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("record_id", record_id(F.col("page_id"), F.col("row"), F.col("digest")))
        refers = F.when(revisit, F.col("first_id"))
        heads.select("page_id", "url", "record_type", refers.alias("refers_to"), header().alias("header"), "digest").write.parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: page_id, url, record_type, refers_to, header, payload, and the digest and length of the payload as read.

    The digest is taken again from the stored bytes; a record whose payload does not match its address fails the read.
    """
    held = spark.read.parquet(f"{path}/payloads")
    held = held.select("digest", "payload", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    right = F.col("payload_digest") == F.lower(F.hex("digest"))
    held = held.withColumn("payload_digest", F.when(right, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest"))))
    return spark.read.parquet(f"{path}/records").join(held.hint("merge"), "digest").drop("digest")


def rebuild(records: DataFrame) -> DataFrame:
    """records of read_archive() with record: the original bytes; the block of a revisit is empty."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.withColumn("record", F.concat(F.col("header"), block, F.lit(b"\r\n\r\n")))


def _field(head: Column, name: str) -> Column:
    """The value of a header line, null where there is none."""
    value = F.regexp_extract(head, f"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(head.contains(f"\n{name}: "), value)


def parsed(rebuilt: DataFrame) -> DataFrame:
    """rebuilt of rebuild() with fields read from the bytes of each record: warc_type, warc_id, warc_refers, warc_digest; a block that is not as its header says fails the read."""
    head = F.substring_index(F.col("record").cast("string"), CRLF * 2, 1)
    x = rebuilt.withColumn("_head", head)
    for name, line in (("warc_type", "WARC-Type"), ("warc_id", "WARC-Record-ID"), ("warc_refers", "WARC-Refers-To"), ("warc_digest", "WARC-Payload-Digest"), ("_length", "Content-Length")):
        x = x.withColumn(name, _field(F.col("_head"), line))
    block = F.expr("substring(record, octet_length(_head) + 5, int(_length))")
    ends = F.expr("octet_length(record) = octet_length(_head) + 4 + int(_length) + 4")
    sound = ends & (F.col("warc_digest") == F.concat(F.lit("sha256:"), F.when(F.col("warc_type") == "revisit", F.col("payload_digest")).otherwise(F.sha2(block, 256))))
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("warc_type")).otherwise(F.raise_error(F.lit("a record's block does not match its header")))
    return x.withColumn("warc_type", checked).drop("_head", "_length")


def archive_digest(pages: DataFrame) -> DataFrame:
    """Write pages to a new archive in the shared folder, rebuild every record and read page_id, payload_bytes, payload_digest, record_type and refers_to from them.

    The page that a revisit refers to is that of the record which has the id named in its header.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archive(pages, path)
    records = parsed(rebuild(read_archive(spark, path))).select("page_id", "payload_bytes", F.substring_index("warc_digest", ":", -1).alias("payload_digest"), "warc_type", "warc_id", "warc_refers")
    records = stored(records, "warc-parsed")
    named = records.where("warc_type = 'response'").select(F.col("warc_id").alias("_id"), F.col("page_id").alias("_page"))
    revisits = records.where("warc_type = 'revisit'").join(named.hint("merge"), F.col("warc_refers") == F.col("_id"), "left")
    keep = "page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type")
    return records.where("warc_type <> 'revisit'").select(*keep, F.lit(None).cast(records.schema["page_id"].dataType).alias("refers_to")).union(revisits.select(*keep, F.col("_page").alias("refers_to")))
