"""A content-addressed web archive: payload bytes once by verified SHA-256, exact record headers apart from them.

``write_archive`` makes two Parquet tables in one folder: ``payloads`` (digest, bytes; one row for each distinct
payload that a record carries) and ``records`` (the header block of each WARC/1.1 record exactly as it stands in the
file, and the digest of its payload). ``read_archive`` joins them again to complete records and checks every digest;
``record_bytes`` gives a record as it stands in a .warc file.

Of records with equal payloads of at least `least` bytes the one with the smallest id is a response, the others are
revisits that carry no payload; smaller ones are all responses. Defined results: a null payload is empty; rows repeated
with one id each give a record with an id of its own, and of those one alone is the response; a null id comes last and its
record names no id; line ends in a URL are written as %0D and %0A; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import HOT_KEYS, HOT_ROWS, drop, join_hot, shuffles_dropped, stored, written

LEAST_BYTES = 100
#: The date of a page of which it is not known.
NO_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _plan(pages: DataFrame, key: str, url: str, payload: str, least: int, date: F.Column) -> DataFrame:
    """Of every page: id, url, date, payload, digest and payload_bytes."""
    raw = F.coalesce(F.encode(F.col(payload), "UTF-8") if dict(pages.dtypes)[payload] == "string" else F.col(payload), F.lit(b""))
    return pages.select(F.col(key).alias("id"), F.col(url).alias("url"), raw.alias("payload"), date.alias("date")).select("id", "url", "date", "payload", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("payload_bytes"))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_BYTES, date: F.Column | None = None) -> None:
    """An archive of the pages at `path`, a folder that all executors share. `date` is when each page was fetched (text in ISO 8601)."""
    rows = _plan(pages, key, url, payload, least, F.lit(NO_DATE) if date is None else date)
    slim = written(rows.select("id", "url", "digest", "payload_bytes", "date").withColumn("row", F.monotonically_increasing_id()), "warc-plan")
    # the first record of each digest: a minimum, so partitions combine before the shuffle whatever the copies
    first = slim.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"), F.count("*").alias("copies"))
    # records of a hot digest go to several tasks of a reader; of HOT_KEYS digests at most
    parts = F.when(F.col("copies") >= max(HOT_ROWS, slim.count() // HOT_KEYS), F.ceil(F.col("copies") / HOT_ROWS)).otherwise(1).cast("int")
    copied = stored(first.where("copies > 1").select("digest", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row"), parts.alias("parts")), "warc-copies")
    joined = join_hot(slim, copied, "digest", "left")
    records = joined.withColumn("record_type", F.when(F.col("first_row").isNull() | (F.col("payload_bytes") < least) | (F.col("row") == F.col("first_row")), "response").otherwise("revisit"))
    # a row's own number makes ids of repeated keys differ
    uri = lambda i, row: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(i).cast("string"), F.lit("none")), F.lit(":"), F.col(row).cast("string"), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    target = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), uri("id", "row")),
        F.concat(F.lit("WARC-Date: "), F.coalesce("date", F.lit(NO_DATE))),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), uri("first_id", "first_row"))),
        F.when(revisit, F.concat(F.lit("WARC-Profile: "), F.lit(PROFILE))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit("\r\n"),
    )
    with shuffles_dropped(pages.sparkSession):
        records.select("id", "record_type", F.when(revisit, F.col("first_id")).alias("refers_to"), "digest", F.encode(block, "UTF-8").alias("header"), F.coalesce("parts", F.lit(1)).alias("parts")).write.parquet(f"{path}/records")
        # payloads: every distinct one is kept once; equal payloads meet as partial firsts, never as rows of one task
        once = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
        once.join(F.broadcast(copied.where("parts > 1").select("digest", "parts")), "digest", "left").select("digest", "payload", F.coalesce("parts", F.lit(1)).alias("parts")).write.parquet(f"{path}/payloads")
    drop(slim, copied)


_HEADER = re.compile(rb"\r\n([A-Za-z-]+): ([^\r\n]*)")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: id, header, payload (of a revisit, that of the record it refers to), and what the header says.

    Payloads whose bytes do not give their digest raise an error wherever the payload, or what is made of it, is read.
    """
    records = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads")
    # the payload itself hangs on the check, so no reader's choice of columns can leave it out
    wrong = F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest")))
    checked = payloads.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong.cast("binary")).alias("payload"), "parts")
    said = F.decode("header", "UTF-8")
    found = lambda field: F.regexp_extract(said, rf"\r\n{field}: ([^\r\n]*)", 1)
    refers = F.regexp_extract(found("WARC-Refers-To"), r"^<urn:page:(.*):[0-9]+>$", 1)
    # records of a hot digest go to several tasks, its payload to each of them
    asked = records.withColumn("part", F.pmod(F.xxhash64("header"), F.col("parts")).cast("int"))
    given = checked.select("digest", "payload", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    joined = asked.join(given, ["digest", "part"])
    return joined.select("id", "header", "payload", F.col("payload").isNotNull().alias("verified"), found("WARC-Type").alias("record_type"), F.regexp_extract(found("WARC-Payload-Digest"), "^sha256:(.*)$", 1).alias("payload_digest"), F.when((refers != "") & (refers != "none"), refers).alias("refers_to"), found("Content-Length").cast("long").alias("content_length"), found("WARC-Target-URI").alias("target_uri"))


def record_bytes(records: DataFrame) -> DataFrame:
    """The records of read_archive as the bytes of a .warc file: header block, content and two line ends."""
    content = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select("id", F.concat("header", content, F.lit(b"\r\n\r\n")).alias("record"))


def parse_records(archive: DataFrame, column: str = "record") -> DataFrame:
    """Records read back from the bytes of .warc files, a row of any number of records each: type, id, digest, content."""

    def parse(batches):
        for batch in batches:
            out = {"record_type": [], "record_id": [], "payload_digest": [], "refers_to": [], "content": [], "intact": []}
            for data in batch.column(0).to_pylist():
                at = 0
                while data and at < len(data):
                    stop = data.index(b"\r\n\r\n", at) + 4
                    field = {k.lower(): v.decode() for k, v in _HEADER.findall(data[at:stop])}
                    size = int(field[b"content-length"])
                    body = data[stop : stop + size]
                    digest = field.get(b"warc-payload-digest", "").removeprefix("sha256:")
                    for k, v in zip(out, (field.get(b"warc-type"), field.get(b"warc-record-id"), digest, field.get(b"warc-refers-to"), body, field.get(b"warc-type") == "revisit" or hashlib.sha256(body).hexdigest() == digest), strict=True):
                        out[k].append(v)
                    at = stop + size + 4
            yield pa.record_batch([pa.array(v, pa.binary() if k == "content" else pa.bool_() if k == "intact" else pa.string()) for k, v in out.items()], list(out))

    return archive.select(column).mapInArrow(parse, "record_type string, record_id string, payload_digest string, refers_to string, content binary, intact boolean")
