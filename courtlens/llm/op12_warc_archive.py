"""A content-addressed WARC archive: payloads once by digest, record headers apart, records by join.

An archive is a folder with two Parquet tables:

* ``payloads`` (digest, copies, payload): every distinct payload once under its SHA-256, and the number
  of records that have it;
* ``headers`` (record, digest, header): the exact bytes of every record before its payload, that is the
  WARC header and, for these pages, the HTTP header.

A record is put together again by a join on the digest. A *response* is header and payload; a *revisit* is its
header alone, and its full payload is that of the response it refers to. What is stored is verified both ways: on
writing, equal digests must also have equal SHA-512 digests and sizes; on reading, the stored bytes must
hash to the digest that they are stored under. Either failure ends the job.

Payloads move once, to be stored. Copies of one payload may be very many, so joins on the
digest split a digest of more than ``many`` records into parts. At most ``HOT`` digests can be that large, which bounds the
list of them that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlens.session import stable

#: Payloads of fewer bytes are never replaced by a revisit.
MIN_REVISIT = 100
DATE = "2000-01-01T00:00:00Z"
#: A digest is split when it has more than 1 / HOT of all records, and more than LEAST.
HOT, LEAST = 100_000, 10_000
# fixed values of the format
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPE = "application/http; msgtype=response"
END = "\r\n\r\n"


def _join(left: DataFrame, right: DataFrame, records: int, how: str = "inner") -> DataFrame:
    """``left`` with the row of ``right`` (digest, copies, ...) of its digest, large digests in parts."""
    many = max(LEAST, records // HOT)
    parts = F.expr(f"if(copies > {many}, copies div {many}, 0)").cast("int")
    hot = right.where(F.col("copies") > many).select("digest", parts.alias("parts"))
    left = left.join(F.broadcast(hot), "digest", "left").withColumn(
        "part", F.coalesce(F.pmod(F.col("record"), F.col("parts") + 1), F.lit(0)).cast("int")).drop("parts")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), parts)))
    return left.join(right, ["digest", "part"], how).drop("part")


def _line(name: str, value: Column | str) -> Column:
    """A header line; none for a null value. Line ends in a value are written as %0D and %0A."""
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    value = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _name(key: str, record: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.col(record), F.lit(">"))


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
          date: str = DATE, min_revisit: int = MIN_REVISIT) -> None:
    """Store every row of ``pages`` as a record of an archive in ``folder``.

    ``key`` holds whole numbers. A null payload counts as empty, a null address has no header line, a null
    key stands in no record name and ranks behind all others. Of records with equal payloads of at least
    ``min_revisit`` bytes the one with the smallest key is the response (of rows that repeat a key, one), the others
    revisit it; smaller ones are all responses, though their payload is stored once too. Other columns of
    ``pages`` are not read, an empty table gives an empty archive.
    """
    rows = pages.select(F.col(key).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    heads = stable(rows.select(
        F.monotonically_increasing_id().alias("record"), "id", "url", "digest",
        F.octet_length("payload").cast("bigint").alias("size"), F.sha2("payload", 512).alias("second")))
    firsts = stable(heads.groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("id").isNull(), "id", "record")).alias("first"),
        F.min("second").alias("a"), F.max("second").alias("b"),
        F.min("size").alias("c"), F.max("size").alias("d"),
    ).select("digest", "copies", F.col("first.id").alias("to"), F.col("first.record").alias("to_record"),
             F.when((F.col("a") == F.col("b")) & (F.col("c") == F.col("d")), True).otherwise(
                 F.raise_error(F.concat(F.lit("different payloads share the digest "), "digest"))).alias("same")))
    d = _join(heads, firsts, heads.count()).where("same")
    revisit = (F.col("size") >= min_revisit) & (F.col("record") != F.col("to_record"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("size")), F.lit("\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    header = F.concat(
        F.lit(f"{VERSION}\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _name("id", "record")), _line("WARC-Date", date), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _line("WARC-Refers-To", F.when(revisit, _name("to", "to_record"))), _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("Content-Type", TYPE), _line("Content-Length", length), F.lit("\r\n"), http)
    d.select("record", "digest", header.cast("binary").alias("header")).write.parquet(f"{folder}/headers")
    # copies meet in their task first, so a payload of very many records moves once for each task
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).join(
        firsts.select("digest", "copies"), "digest").select("digest", "copies", "payload").write.parquet(f"{folder}/payloads")


def _verified(stored: DataFrame) -> DataFrame:
    """The payloads; bytes that do not hash to their digest end the job."""
    return stored.where(F.when(F.sha2("payload", 256) == F.col("digest"), True).otherwise(
        F.raise_error(F.concat(F.lit("the archive holds other bytes than those of digest "), "digest"))))


def _fields(d: DataFrame) -> DataFrame:
    """(key, url, record_type, refers_to) read from the header bytes, before all other columns but the header."""
    text = F.col("header").cast("string")
    field = lambda p: F.nullif(F.regexp_extract(text, f"\r\n{p}\r\n", 1), F.lit(""))
    return d.select(
        field("WARC-Record-ID: <urn:page:(-?[0-9]*):[0-9]+>").cast("bigint").alias("key"),
        field("WARC-Target-URI: ([^\r\n]*)").alias("url"), field("WARC-Type: ([a-z]+)").alias("record_type"),
        field("WARC-Refers-To: <urn:page:(-?[0-9]*):[0-9]+>").cast("bigint").alias("refers_to"),
        field("WARC-Payload-Digest: sha256:([0-9a-f]+)").alias("payload_digest"), *[c for c in d.columns if c != "digest"])


def _read(spark: SparkSession, folder: str, *stored: Column) -> DataFrame:
    heads = spark.read.parquet(f"{folder}/headers")
    kept = _verified(spark.read.parquet(f"{folder}/payloads")).select("digest", "copies", *stored)
    d = _join(heads, kept.withColumn("known", F.lit(True)), heads.count(), "left")
    return _fields(d.where(F.when(F.col("known"), True).otherwise(
        F.raise_error(F.concat(F.lit("the archive holds no payload of digest "), "digest")))).drop("copies", "known"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(key, url, record_type, refers_to, payload_digest, record, header, payload) of every record, payload in full."""
    return _read(spark, folder, F.col("payload"))


def index(spark: SparkSession, folder: str) -> DataFrame:
    """As :func:`records`, with payload_bytes and no payload: only sizes and verdicts of the stored bytes move."""
    return _read(spark, folder, F.octet_length("payload").cast("bigint").alias("payload_bytes"))


def export(spark: SparkSession, folder: str, out: str) -> None:
    """The records as plain WARC files in ``out``, one for each task, as the format lays them out."""
    revisit = F.col("record_type") == "revisit"
    whole = F.concat("header", F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))).cast("string")
    records(spark, folder).select(whole.alias("value")).write.option("lineSep", END).text(out)


def report(pages: DataFrame, folder: str, key: str = "page_id") -> DataFrame:
    """key, payload_bytes, payload_digest, record_type and refers_to of every row, after a write and a read."""
    write(pages, folder, key)
    return index(pages.sparkSession, folder).select(
        F.col("key").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")
