"""WARC archives with revisit resolution.

Pages become WARC records; records whose payload has been seen carry a reference instead of the payload. The digest of
each payload is shuffled without the payload, the first page of each digest becomes the response, and the archives are
written by Spark's own writer, so a lost task is written again and no half archive stays.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from modelwatch.llm.common import stored

#: Fixed values of the formats.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
CRLF = "\r\n"


def payload_digest(payload: Column) -> Column:
    """Base32 SHA-1 of a binary column: ten hex digits at a time become eight base-32 digits, which are renamed."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def resolve_revisits(pages: DataFrame, id_col: str, html_col: str, least_bytes: int = 0) -> DataFrame:
    """(page, digest, first): the smallest page id among the pages with this payload, null for payloads that are too small.

    Works on digests only. The groups shrink before they are shuffled, so one payload on a third of all pages is no hot
    group; the join back is on light rows, whose hot keys adaptive execution splits.
    """
    heads = pages.select(F.col(f"`{id_col}`").alias("page"), payload_of(html_col).alias("payload"))
    heads = stored(
        heads.select("page", payload_digest(F.col("payload")).alias("digest"), F.octet_length("payload").alias("n")),
        "warc-heads",
    )
    firsts = heads.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page").alias("first"))
    return heads.select("page", "digest").distinct().join(firsts.withColumn("resolved", F.lit(True)), "digest", "left")


def payload_of(html_col: str) -> Column:
    return F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")


def header_value(c: Column) -> Column:
    """Header text: line breaks would end the header."""
    return F.replace(F.replace(c.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def record_id(page: Column, digest: Column, copy: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("-")), digest, copy.cast("string")).cast("binary"))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    records_per_archive: int = 5_000,
) -> None:
    """Write one record per page below ``path`` as gzip-compressed WARC 1.1.

    Of pages with equal payloads of at least ``least_bytes`` bytes, the one with the smallest id is a response (null ids
    come last), all others are revisits that refer to it; pages with smaller payloads are all responses. Rows that repeat
    an id and a payload: the first by url is the one that counts, the others are revisits of it. A null html is an empty
    payload, a null url leaves its header out. Other columns do not matter. An empty table writes no record.
    """
    page, url, digest = F.col("page"), F.col("url"), F.col("digest")
    # A null page gets a key as well: with plain equality the window below needs no second shuffle of the payloads.
    page_key = F.struct(page.isNull().alias("none"), F.coalesce(page.cast("string"), F.lit("")).alias("text")).alias("page_key")
    verdicts = resolve_revisits(pages, id_col, html_col, least_bytes).select(page_key, "digest", "first", "resolved")
    source = pages.select(
        F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").alias("url"), payload_of(html_col).alias("payload")
    ).withColumn("digest", payload_digest(F.col("payload")))
    joined = source.withColumn("page_key", page_key).join(verdicts, ["page_key", "digest"])
    copy = F.row_number().over(W.Window.partitionBy("page_key", "digest").orderBy(F.col("url").asc_nulls_last()))
    rows = joined.withColumn("copy", F.when(F.col("resolved"), copy).otherwise(F.lit(1)))
    rows = rows.withColumn(
        "revisit", F.coalesce(F.col("resolved"), F.lit(False)) & (~page.eqNullSafe(F.col("first")) | (F.col("copy") > 1))
    )

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), header_value(value), F.lit(CRLF)), F.lit(""))

    size = F.octet_length("payload")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF * 2)
    )
    revisit = F.col("revisit")
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", record_id(page, digest, F.when(revisit, F.col("copy") + 1).otherwise(F.lit(1)))),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", url),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        header("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        header("WARC-Refers-To", F.when(revisit, record_id(F.col("first"), digest, F.lit(1)))),
        header("Page-ID", F.url_encode(page.cast("string"))),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(http) + F.octet_length(body)),
        F.lit(CRLF),
        http,
        body,
        F.lit(CRLF),  # the writer ends each value with one more
    )
    writer = rows.select(record.alias("value")).write.option("lineSep", CRLF).option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_archive).text(path)


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of one archive, plain or gzip (whole or per record)."""
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("archive ends inside a record")
        yield headers, block


RECORD = (
    "record_id string, record_type string, page_id string, url string, header_digest string, refers_to_record string, "
    "payload_bytes long, payload_digest string, payload binary"
)
RECORD_NAMES = [field.split()[0] for field in RECORD.split(", ")]


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives below ``path``.

    ``payload_bytes`` and ``payload_digest`` are taken from the block itself (null for revisits, which have none).
    Archives are read through Spark, whole files at a time; records stream out of them.
    """

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for content in batch.column(0):
                for headers, block in records(content.as_py()):
                    kind = headers.get("warc-type")
                    http = headers.get("content-type", "").startswith("application/http")
                    payload = block.partition(b"\r\n\r\n")[2] if http else block
                    if kind == "revisit":
                        payload = None
                    page = headers.get("page-id")
                    rows.append(
                        (
                            headers.get("warc-record-id"), kind, None if page is None else unquote(page.replace("+", " ")),
                            headers.get("warc-target-uri"), headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                            headers.get("warc-refers-to"), None if payload is None else len(payload),
                            None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                            payload if payloads else None,
                        )
                    )
                    held += len(payload or b"") * payloads
                    if len(rows) >= 10_000 or held > 16_000_000:
                        yield as_batch(rows)
                        rows, held = [], 0
            if rows:
                yield as_batch(rows)

    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]

    def as_batch(rows):
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=RECORD_NAMES)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, RECORD)


def resolve(archived: DataFrame) -> DataFrame:
    """Give every revisit the size, digest and page of the response it refers to, found by payload digest."""
    seen = archived.where("record_type = 'response'")
    originals = seen.select(
        F.col("record_id").alias("refers_to_record"), F.col("header_digest"), F.col("page_id").alias("first_page"),
        F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest"),
    )
    responses = seen.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("string").alias("refers_to"))
    revisits = archived.where("record_type = 'revisit'").join(originals, ["header_digest", "refers_to_record"], "left")
    return responses.unionByName(
        revisits.select(
            "page_id", F.col("first_bytes").alias("payload_bytes"), F.col("first_digest").alias("payload_digest"),
            "record_type", F.col("first_page").alias("refers_to"),
        )
    )
