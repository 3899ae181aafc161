"""Content-addressed WARC archive.

``write_archive`` keeps two tables under one folder:

* ``payloads``: each distinct payload once, under its SHA-256;
* ``records``: per record the exact bytes of its WARC header and HTTP header,
  with the payload's key.

``read_archive`` joins them back into whole records.  A payload is verified
where it is stored once (its key is recomputed from the bytes read, a mismatch
stops the job), before the join hands it to its records; the header fields are
parsed from the stored header bytes.

Writing shuffles narrow rows plus one copy of each payload per map task (equal
payloads collapse before the shuffle).  Reading only digests or lengths never
shuffles payload bytes, as column pruning drops them from the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four groups of 40 bits, eight base-32 digits each."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_uuid(*parts: Column) -> Column:
    """A stable urn:uuid from the record's identity."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _uri(url: Column) -> Column:
    """Percent-encodes the control characters and spaces that would break a header line, and the percent sign before them stays as is."""
    out = F.replace(url, F.lit("\r"), F.lit("%0D"))
    return F.replace(out, F.lit("\n"), F.lit("%0A"))


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)), F.lit("")) for k, v in pairs])


def warc_records(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    min_revisit_bytes: int = 0,
) -> DataFrame:
    """(payload_key, warc_header, http_header), one row per page row, headers as exact bytes.

    Among records of equal payloads of at least ``min_revisit_bytes`` bytes
    the one with the smallest (id, url, copy number) is the response and the
    others revisit it; nulls order last.  Rows repeated whole are numbered
    copies: the first is the response, the rest revisit it.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = (
        pages.select(
            F.col(id_col).cast("string").alias("id"),
            F.col(id_col).alias("num"),
            F.col(url_col).alias("url"),
            F.sha2(payload, 256).alias("payload_key"),
            base32_sha1(payload).alias("sha1"),
            F.octet_length(payload).cast("long").alias("bytes"),
        )
        .groupBy("id", "num", "url", "payload_key", "sha1", "bytes")
        .agg(F.count("*").alias("n"))
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    )
    place = F.struct(
        F.col("num").isNull().alias("a"), F.col("num").alias("b"),
        F.col("url").isNull().alias("c"), F.col("url").alias("d"), F.col("copy").alias("e"),
    )
    firsts = rows.groupBy(F.col("payload_key").alias("key")).agg(F.min(place).alias("first"))
    joined = rows.join(firsts.hint("merge"), F.col("payload_key") == F.col("key"))  # a hot payload's rows: split by AQE
    revisit = (F.col("bytes") >= min_revisit_bytes) & ~place.eqNullSafe(F.col("first"))
    kind = F.when(revisit, "revisit").otherwise("response")
    digest = F.concat(F.lit("sha1:"), F.col("sha1"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}"),
        _lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    warc = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _lines(
            ("WARC-Type", kind),
            ("WARC-Record-ID", record_uuid(F.col("id"), F.col("url"), F.col("payload_key"), F.col("copy"))),
            ("WARC-Date", F.lit(date)),
            ("WARC-Target-URI", _uri(F.col("url"))),
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(revisit, PROFILE)),
            ("WARC-Refers-To", F.when(revisit, record_uuid(F.col("first.b"), F.col("first.d"), F.col("payload_key"), F.col("first.e")))),
            ("X-Refers-To-Page", F.when(revisit, F.col("first.b").cast("string"))),
            ("X-Page", F.col("id")),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", block.cast("string")),
        ),
        F.lit(CRLF),
    )
    return joined.select("payload_key", F.encode(warc, "UTF-8").alias("warc_header"), F.encode(http, "UTF-8").alias("http_header"))


def write_archive(pages: DataFrame, path: str, **options) -> None:
    """Writes the two tables of the archive of ``pages`` under ``path`` (a shared folder).

    Null html: the empty payload.  Null url: no target line.  Null id: no page
    line.  An empty table writes an empty archive.  Other columns are ignored.
    """
    html = F.encode(F.coalesce(F.col(options.get("html_col", "html")), F.lit("")), "UTF-8")
    payloads = (
        pages.select(F.sha2(html, 256).alias("payload_key"), html.alias("payload"))
        .groupBy("payload_key")
        .agg(F.first("payload").alias("payload"))
    )
    for table, name in ((payloads, "payloads"), (warc_records(pages, **options), "records")):
        table.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def payload_of(archive: DataFrame) -> Column:
    """The payload as the rebuilt records of ``read_archive`` hold it: the bytes of the record behind both its headers.

    A revisit's record ends with its headers; its payload is the one that the join brought.
    """
    record = archive["record"]
    head = F.octet_length(archive["warc_header"]) + F.octet_length(archive["http_header"])
    body = F.substring(record, head + 1, F.octet_length(record) - head - len(CRLF * 2))
    return F.when(archive["record_type"] == "revisit", archive["payload"]).otherwise(body)


def _field(header: Column, name: str) -> Column:
    """The value of a header line, null where there is none."""
    got = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(F.contains(header, F.lit(f"{CRLF}{name}: ")), got)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records, rebuilt by joining headers to payloads.

    Columns: the parsed header fields (``page`` and ``refers_to_page`` as
    strings), ``payload`` and its recomputed ``payload_bytes`` and
    ``payload_sha1``, and ``record``: the exact bytes of the WARC record
    (a revisit has only its HTTP header as block).  A payload that does not
    match its key, or a header whose digest does not match, stops the job.
    """
    stored = spark.read.schema("payload_key string, payload binary").parquet(f"{path}/payloads")
    key = F.sha2(F.col("payload"), 256)
    checked = stored.select(
        F.when(key == F.col("payload_key"), F.col("payload_key"))
        .otherwise(F.raise_error(F.concat(F.lit("payload does not match "), F.col("payload_key"))))
        .alias("__key"),
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_sha1"),
    )
    headers = spark.read.schema("payload_key string, warc_header binary, http_header binary").parquet(f"{path}/records")
    text = F.decode(F.col("warc_header"), "UTF-8")
    fields = {
        "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI",
        "refers_to_record": "WARC-Refers-To", "refers_to_page": "X-Refers-To-Page", "page": "X-Page", "__digest": "WARC-Payload-Digest",
    }
    parsed = headers.select("*", text.alias("__text")).select(
        "payload_key", "warc_header", "http_header", *[_field(F.col("__text"), v).alias(k) for k, v in fields.items()]
    )
    tail = F.encode(F.lit(CRLF * 2), "UTF-8")
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return (
        parsed.join(checked.hint("merge"), F.col("payload_key") == F.col("__key"))
        .withColumn(
            "payload_sha1",
            F.when(F.concat(F.lit("sha1:"), F.col("payload_sha1")) == F.col("__digest"), F.col("payload_sha1"))
            .otherwise(F.raise_error(F.concat(F.lit("digest mismatch in "), F.col("record_id")))),
        )
        .withColumn("record", F.concat("warc_header", "http_header", body, tail))
        .drop("__key", "__digest")
    )
