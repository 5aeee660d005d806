"""Content-addressed WARC archive: payload bytes once, exact record headers apart, records by joins.

The archive is two Parquet tables. ``payloads`` holds each distinct payload once under its
SHA-256; every copy is checked against it by length and a second digest while it is written.
``headers`` holds, per record, the exact header bytes and the digest of its payload. Reading joins
the two into WARC records, parses them and checks the digests that the records carry.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import join_groups
from tallyweave.session import cut, shared_folder

#: Payloads from so many bytes on are stored in one response; equal ones refer to it.
REVISIT_BYTES = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Rows of a broadcast of payloads under REVISIT_BYTES: ten megabytes.
SMALL_PAYLOADS = 10_000


def archive_folder(spark: SparkSession) -> str:
    """A new folder among the session's shared intermediate tables."""
    return f"{shared_folder(spark)}/warc/{uuid.uuid4().hex}"


def _line(name: str, value: Column) -> Column:
    """A header line, none for a null value; line breaks in the value are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _record_id(page: str, row: str) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(F.col(page).cast("string"), F.lit("null")), F.col(row).cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = DATE) -> None:
    """Write ``folder/payloads`` and ``folder/headers`` for one record per row of ``pages``.

    Among records with equal payloads of ``REVISIT_BYTES`` or more, the one with the largest key
    (the earliest row among equal keys; null keys are smallest) is the response and the others
    are revisits of it. A null payload is empty, a null url gives no target line. Other columns
    are ignored; an empty table gives an empty archive.
    """
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    source = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"), body.alias("_body"))
    facts = source.select("_key", "_url", F.octet_length("_body").cast("bigint").alias("n_bytes"), F.sha2("_body", 256).alias("sha256"), F.sha1("_body").alias("sha1"))
    facts = cut(facts.withColumn("_row", F.monotonically_increasing_id()))
    best = F.max(F.struct(F.col("_key").isNotNull().alias("known"), F.col("_key").alias("key"), (-F.col("_row")).alias("back")))
    groups = facts.groupBy("sha256").agg(F.count(F.lit(1)).alias("n_refs"), best.alias("_best"))
    groups = cut(groups.select("sha256", "n_refs", F.col("_best.key").alias("_owner"), (-F.col("_best.back")).alias("_owner_row")))

    same = (F.min("n_bytes") == F.max("n_bytes")) & (F.min("sha1") == F.max("sha1"))
    stored = source.select(F.sha2("_body", 256).alias("sha256"), F.octet_length("_body").alias("n_bytes"), F.sha1("_body").alias("sha1"), F.col("_body").alias("payload"))
    stored = stored.groupBy("sha256").agg(F.first("payload").alias("payload"), same.alias("_same"))
    checked = F.when(F.col("_same"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("binary"))
    stored.select("sha256", checked.alias("payload")).write.parquet(f"{folder}/payloads")

    records = join_groups(facts, groups, ["sha256"], "n_refs", "inner")
    visit = (F.col("n_bytes") >= REVISIT_BYTES) & (F.col("_row") != F.col("_owner_row"))
    records = records.withColumn("_revisit", visit).withColumns({"_id": _record_id("_key", "_row"), "_refers": _record_id("_owner", "_owner_row")})
    kind = F.when(F.col("_revisit"), "revisit").otherwise("response")
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", F.col("_id")), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("_url")), _line("Page-ID", F.col("_key").cast("string")),
        _line("WARC-Profile", F.when(F.col("_revisit"), REVISIT_PROFILE)), _line("WARC-Refers-To", F.when(F.col("_revisit"), F.col("_refers"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")), _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(F.col("_revisit"), F.lit("0")).otherwise(F.col("n_bytes").cast("string"))), F.lit("\r\n"),
    )
    records.select(
        F.encode(header, "UTF-8").alias("header"), "sha256", F.col("_revisit").alias("revisit"), "n_bytes", "n_refs"
    ).write.parquet(f"{folder}/headers")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Whole records rebuilt from the archive: ``record`` (the exact bytes), ``sha256``, ``n_refs``.

    A response of ``REVISIT_BYTES`` or more is the only one with its payload, so that join has no
    hot key; shorter payloads may be shared by any number of responses.
    """
    heads = spark.read.parquet(f"{folder}/headers")
    bodies = spark.read.parquet(f"{folder}/payloads")
    long = heads.filter(~F.col("revisit") & (F.col("n_bytes") >= REVISIT_BYTES)).join(bodies, "sha256")
    short_heads = heads.filter(~F.col("revisit") & (F.col("n_bytes") < REVISIT_BYTES))
    shared = short_heads.groupBy("sha256").agg(F.max("n_refs").alias("_refs"))
    short_bodies = bodies.filter(F.octet_length("payload") < REVISIT_BYTES).join(shared, "sha256")
    short = join_groups(short_heads, cut(short_bodies), ["sha256"], "_refs", "inner", SMALL_PAYLOADS).drop("_refs")
    visits = heads.filter("revisit").withColumn("payload", F.lit(b""))
    whole = F.concat("header", "payload", F.lit(b"\r\n\r\n"))
    names = ["header", "payload", "sha256", "n_refs"]
    return long.select(names).unionByName(short.select(names)).unionByName(visits.select(names)).select(whole.alias("record"), "sha256", "n_refs")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and content of one WARC record; an error if its frame is broken."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record doesn't end where its length says")
    return fields, rest[:size]


_PARSED = (
    "record_id string, record_type string, page_id string, url string, refers_to_id string, payload_digest string,"
    " payload_bytes long, sha256 string, n_refs long"
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in _PARSED.split(",")]
    for batch in batches:
        out: dict[str, list] = {n: [] for n in names}
        for record, sha256, refs in zip(*(batch.column(i) for i in range(3)), strict=True):
            fields, content = parse_record(record.as_py())
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            response = fields["WARC-Type"] == "response"
            if response and (hashlib.sha1(content).hexdigest() != digest or hashlib.sha256(content).hexdigest() != sha256.as_py()):
                raise ValueError(f"payload of {fields['WARC-Record-ID']} has another digest")
            row = (
                fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("Page-ID"), fields.get("WARC-Target-URI"), fields.get("WARC-Refers-To"),
                digest, len(content) if response else None, sha256.as_py(), refs.as_py(),
            )
            for name, value in zip(names, row, strict=True):
                out[name].append(value)
        types = [pa.int64() if n in ("payload_bytes", "n_refs") else pa.string() for n in names]
        yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of every record, from its rebuilt bytes: ``page_id``, ``url``, ``record_type``,
    ``payload_bytes``, ``payload_digest``, ``refers_to`` (the response's page, for revisits).

    A revisit's length comes from the response that it names, checked by record id and digest.
    """
    parsed = cut(records(spark, folder).mapInArrow(_parse, _PARSED))
    responses = parsed.filter("record_type = 'response'")
    visits = parsed.filter("record_type = 'revisit'")
    targets = cut(
        responses.filter((F.col("payload_bytes") >= REVISIT_BYTES) & (F.col("n_refs") > 1)).select(
            "sha256", "n_refs", F.col("record_id").alias("_id"), F.col("page_id").alias("_page"),
            F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"),
        )
    )
    found = join_groups(visits.drop("n_refs"), targets, ["sha256"], "n_refs", "left")
    right = (F.col("_id") == F.col("refers_to_id")) & (F.col("_digest") == F.col("payload_digest"))
    size = F.when(right, F.col("_bytes")).otherwise(F.raise_error(F.lit("a revisit names no response with its payload")).cast("bigint"))
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    found = found.withColumns({"payload_bytes": size, "refers_to": F.col("_page")})
    return responses.withColumn("refers_to", F.lit(None).cast("string")).select(names).unionByName(found.select(names))
