"""Web archives in which equal payloads are stored once.

Headers (key, URL, digest, length) are shuffled by payload digest: of equal payloads the one with the smallest key is
the original, all others become revisit records that name it. The verdicts meet the payloads again by key, and the
archives are written as WARC/1.1 files with fresh headers. Reading them back joins every revisit record to its
original's response.

Only the narrow headers are aggregated, with a partial aggregate in front of the shuffle, so a payload that a third of
all pages share is one row per task there. The join of pages to originals has one row per digest on its right side, so
a hot digest can be split.
"""

import gzip
import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaloom.llm.common import map_rows
from vitaloom.session import cut_lineage, shared_folder

CRLF = "\r\n"
# Ends every record, and so is what the text writer puts after each value.
RECORD_END = CRLF + CRLF
MIN_BYTES = 100
RECORDS_PER_FILE = 2000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = ("record_id string, source_key string, record_type string, refers_to_record string, payload_digest string, payload_bytes long, "
        "target_uri string")


def header_value(text: Column) -> Column:
    """A value that cannot break out of its header line: blanks and control characters are percent-encoded."""
    value = F.coalesce(text, F.lit(""))
    for code in (10, 13):
        value = F.replace(value, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.regexp_replace(value, r"[\x00-\x20\x7F]", "%20")


def record_id(key: Column, url: Column, digest: Column) -> Column:
    """A UUID from what the record is about, so a task that runs again writes the same record."""
    h = F.md5(F.concat_ws("|", F.coalesce(key, F.lit("null")), F.coalesce(url, F.lit("")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
                    F.lit(">"))


def resolve(pages: DataFrame, key: str, url: str, payload: Column, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Headers of all rows: ``key, url, digest, bytes, revisit, original_key, original_url`` (the last two null for responses).

    Payloads below ``min_bytes`` are never originals. Rows that share the smallest key and the payload are the same
    record and are all responses; null keys come after all others.
    """
    heads = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.sha2(payload, 256).alias("digest"),
                         F.octet_length(payload).cast("long").alias("bytes"))
    first = F.min(F.struct(F.col("key").isNull().alias("missing"), "key", "url"))
    originals = (heads.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(first.alias("first"))
                 .select("digest", F.col("first.key").alias("original_key"), F.col("first.url").alias("original_url")))
    revisit = (F.col("bytes") >= min_bytes) & ~F.col("key").eqNullSafe(F.col("original_key"))
    return (heads.join(originals, "digest", "left").withColumn("revisit", revisit)
            .withColumns({c: F.when(F.col("revisit"), F.col(c)) for c in ("original_key", "original_url")}))


def write_archives(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html",
                   date: str = "2024-01-01T00:00:00Z", min_bytes: int = MIN_BYTES) -> None:
    """Write one WARC record for each row of ``pages`` into gzip files below ``path``.

    The payload is the text in UTF-8 (or a binary column as it is); null is an empty payload. Response blocks are HTTP
    messages that hold the payload; revisit blocks hold the HTTP header alone. Other columns are not stored. Exactly
    repeated rows are repeated records. An empty table writes no record.
    """
    body = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b""))
    pages = pages.select(F.col(f"`{key}`").alias("own_key"), F.col(f"`{url}`").alias("own_url"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    key, url = "own_key", "own_url"
    verdicts = (resolve(pages, key, url, F.col("body"), min_bytes).where("revisit")
                .select(F.col("key").alias("revisit_key"), F.col("digest").alias("revisit_digest"), "original_key", "original_url").distinct())
    met = pages.join(verdicts, F.col(key).eqNullSafe(F.col("revisit_key")) & (F.col("digest") == F.col("revisit_digest")), "left")
    revisit = F.col("revisit_digest").isNotNull()
    name = lambda k: F.col(k).cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.octet_length("body").cast("string"), F.lit(RECORD_END))
    block = F.when(revisit, http.cast("binary")).otherwise(F.concat(http.cast("binary"), F.col("body")))
    line = lambda head, value: F.concat(F.lit(f"{head}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(name(key), F.col(url), F.col("digest"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", header_value(F.col(url))),
        F.when(F.col(key).isNotNull(), line("Source-Key", header_value(name(key)))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", record_id(name("original_key"), F.col("original_url"), F.col("digest"))),
            line("WARC-Refers-To-Target-URI", header_value(F.col("original_url"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF))
    records = met.withColumn("block", block).select(F.concat(head.cast("binary"), F.col("block")).cast("string").alias("value"))
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(content: bytes) -> Iterator[tuple]:
    """Records of one archive, found by their stated lengths; digests are computed from the stored payloads."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at, view = 0, memoryview(content)
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        head = content[at:end].decode().split(CRLF)
        if head[0] != "WARC/1.1":
            raise ValueError(f"no record starts at byte {at}")
        fields = dict(h.split(": ", 1) for h in head[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        http = content.index(b"\r\n\r\n", start, stop) + 4
        stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if fields["WARC-Type"] == "response":
            if hashlib.sha256(view[http:stop]).hexdigest() != stated:
                raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not have its digest")
            size = stop - http
        else:
            size = None
        yield (fields["WARC-Record-ID"], fields.get("Source-Key"), fields["WARC-Type"], fields.get("WARC-Refers-To"), stated, size,
               fields["WARC-Target-URI"])
        at = stop + len(RECORD_END)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path``, revisits joined to the responses they name.

    Columns: ``record_id, source_key, record_type, target_uri, payload_digest, payload_bytes, refers_to``;
    ``refers_to`` is the source key of the response. A revisit whose response is missing keeps null bytes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    records = cut_lineage(map_rows(files, parse, READ), "warc-records")
    responses = (records.where("record_type = 'response'").groupBy("record_id")
                 .agg(F.first("source_key").alias("refers_to"), F.first("payload_bytes").alias("original_bytes"))
                 .withColumnRenamed("record_id", "refers_to_record"))
    # Responses name nobody: in the join they would all meet under the null key.
    revisits = (records.where("record_type = 'revisit'").drop("payload_bytes").join(responses, "refers_to_record", "left")
                .withColumnRenamed("original_bytes", "payload_bytes"))
    stored = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("string"))
    columns = ["record_id", "source_key", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to"]
    return stored.select(columns).unionByName(revisits.select(columns))


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = shared_folder(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
