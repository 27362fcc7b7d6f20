"""WARC archives: deduplicated writing, and reading with boundary-chain verification.

Writing is Spark's text writer: a record ends with two line ends, which is the writer's separator.

Reading takes the magic line as the text reader's separator, so files are split and every fragment
begins right behind a magic, be it a record's or one inside a payload. Fragments tile each file, so
their offsets are running sums of lengths: within a split, then over the splits of a file. Each
fragment whose head parses is a candidate and names its successor's offset. Pointer jumping from
offset 0 keeps the candidates that the chain reaches; a magic inside a payload is never reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redpen.llm.base import new_path, small_side, written

MAGIC, END, BREAK = "WARC/1.1\r\n", "\r\n\r\n", "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are never stored as a revisit.
REVISIT_BYTES = 1000
#: Records in one archive file: the chain of a file is resolved in one task.
FILE_RECORDS = 50_000


def plan_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads (by SHA-1) of `least` bytes or more, the one with the greatest page_id is the response.
    Only digests that occur twice are gathered, one row each; they are broadcast if counted to be few.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    large = rows.filter(F.col("payload_bytes") >= least)
    twice = written(large.groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").select("payload_digest", "kept"), "twice")
    revisit = F.col("kept").isNotNull() & (F.col("payload_bytes") >= least) & (F.col("kept") != F.col("page_id"))
    return rows.join(small_side(twice), "payload_digest", "left").withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("kept"))}).drop("kept")


def _one_line(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "\r", "%0D"), "\n", "%0A")


def _uri(url: Column, page: Column) -> Column:
    return F.coalesce(_one_line(url), F.concat(F.lit("urn:page:"), page.cast("string")), F.lit("urn:page:"))


def write_archives(records: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Write plan_records() rows as uncompressed .warc text files under path."""
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    block = F.concat(F.lit(HTTP + END), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat_ws(
        BREAK,
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), name),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), _uri(F.col("url"), F.col("page_id"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: " + PROFILE)),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    records.select(F.concat(F.lit(MAGIC), head, F.lit(END), block).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", file_records).text(path)


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """What follows each magic: file, block (start of the split), seq (order in the table), value."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_bytes"), F.monotonically_increasing_id().alias("seq"), "value")


def _header(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row for each magic in the files: its offset, the successor that its head claims, and the head's fields.

    digest and complete are of a payload that lies within the fragment as a whole.
    """
    raw = fragments(spark, path)
    head = F.substring_index("value", END, 1)
    head_bytes = F.octet_length(head).cast("long")
    rows = raw.withColumns({"frag": F.octet_length("value").cast("long"), "head": head, "http": F.substring_index("value", END, 2)})
    length = F.try_to_number(_header(F.col("head"), "Content-Length"), F.lit("999999999999")).cast("long")
    rows = rows.withColumns({"length": F.when(F.col("frag") > head_bytes, length), "body": head_bytes + 4})
    payload_at = F.octet_length("http").cast("long") + 4
    payload = F.expr("substring(cast(value as binary), cast(octet_length(http) + 5 as int), cast(greatest(body + length - octet_length(http) - 4, 0) as int))")
    complete = F.col("frag") >= F.col("body") + F.col("length")
    kind = F.lower(_header(F.col("head"), "WARC-Type"))
    stated = F.regexp_replace(F.lower(_header(F.col("head"), "WARC-Payload-Digest")), "^sha1:", "")
    rows = rows.select(
        "file", "file_bytes", "block", "seq", "frag", "body", "length", complete.alias("complete"),
        F.regexp_extract(_header(F.col("head"), "WARC-Record-ID"), r"urn:page:(-?\d+)", 1).alias("page"),
        kind.alias("record_type"), F.regexp_extract(_header(F.col("head"), "WARC-Refers-To"), r"urn:page:(-?\d+)", 1).alias("refers"),
        stated.alias("stated"), F.try_to_number(_header(F.col("head"), "X-Payload-Length"), F.lit("999999999999")).cast("long").alias("stated_bytes"),
        F.when(complete & (kind == "response"), F.sha1(payload)).alias("digest"), F.when(complete & (kind == "response"), F.col("body") + F.col("length") - payload_at).alias("bytes"),
    )
    rows = written(rows, "candidates")
    return _with_offsets(rows).filter("offset >= 0")


def _with_offsets(rows: DataFrame) -> DataFrame:
    """offset: of the magic before each fragment (-1 for what stands before a file's first magic); succ: what the head claims."""
    width = F.col("frag") + len(MAGIC)
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(F.sum(width).alias("width"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("file", "block", F.coalesce(F.sum("width").over(before), F.lit(0)).alias("base"))
    at = F.col("base") + F.coalesce(F.sum(width).over(inside), F.lit(0)) - len(MAGIC)
    return rows.join(base, ["file", "block"]).withColumn("offset", at).withColumn("succ", F.col("offset") + len(MAGIC) + F.col("body") + F.col("length") + len(END))


def chain(offset: np.ndarray, succ: np.ndarray) -> np.ndarray:
    """Flags of the candidates that pointer jumping reaches from offset 0. Each round doubles the length of the jumps."""
    n = len(offset)
    order = np.argsort(offset, kind="stable")
    sorted_at = offset[order]
    to = np.full(n + 1, n, np.int64)
    if n:
        k = np.minimum(np.searchsorted(sorted_at, succ[order]), n - 1)
        to[:n] = np.where((sorted_at[k] == succ[order]) & (succ[order] > sorted_at), k, n)
    reached = np.zeros(n + 1, bool)
    if n and sorted_at[0] == 0:
        reached[0] = True
    for _ in range(max(1, n).bit_length()):
        reached[to[np.flatnonzero(reached)]] = True
        to = to[to]
    out = np.zeros(n, bool)
    out[order] = reached[:n]
    return out


def _reach(pdf: pd.DataFrame) -> pd.DataFrame:
    succ = pdf["succ"].fillna(-1).to_numpy(np.int64)
    return pdf.loc[chain(pdf["offset"].to_numpy(np.int64), succ), ["file", "seq"]]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record on the chain.

    Responses are digested from the payload that is read; revisits give what their head states. A payload that
    holds the magic is put together from its fragments again. A file's chain ends where a claimed successor is
    no magic, so a damaged tail is left out.
    """
    found = written(candidates(spark, path), "offsets")
    kept = found.select("file", "seq", "offset", "succ").groupBy("file").applyInPandas(_reach, "file string, seq long")
    records = written(found.join(kept, ["file", "seq"]), "records")
    whole = records.filter(F.col("complete") | (F.col("record_type") != "response")).select("page", "record_type", "refers", F.coalesce("bytes", "stated_bytes").alias("payload_bytes"), F.coalesce("digest", "stated").alias("payload_digest"))
    if records.filter(~F.col("complete") & (F.col("record_type") == "response")).limit(1).count():
        whole = whole.union(_split_payloads(spark, path, found, records))
    page = F.try_to_number("page", F.lit("S999999999999999999")).cast("long")
    refers = F.try_to_number("refers", F.lit("S999999999999999999")).cast("long")
    return whole.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", refers).alias("refers_to"))


def _split_payloads(spark: SparkSession, path: str, found: DataFrame, records: DataFrame) -> DataFrame:
    """The responses whose payload holds the magic: the fragments up to the successor are joined again."""
    split = records.filter(~F.col("complete") & (F.col("record_type") == "response")).select("file", F.col("offset").alias("owner"), F.col("succ").alias("until"), "page", "record_type", "refers", "body", "length")
    # a fragment belongs to the last record of its file that begins at or before it
    starts = records.select("file", "offset", F.col("offset").alias("starts"))
    owner = F.last("starts", ignorenulls=True).over(Window.partitionBy("file").orderBy("offset"))
    owned = found.select("file", "block", "seq", "offset").join(starts, ["file", "offset"], "left").select("file", "block", "seq", "offset", owner.alias("owner"))
    wanted = owned.join(split, ["file", "owner"]).filter(F.col("offset") < F.col("until"))
    # a fragment is found again by its place in its split, which doesn't depend on how splits are dealt to tasks
    place = Window.partitionBy("file", "block").orderBy("seq")
    first = found.groupBy("file", "block").agg(F.min("seq").alias("first"))
    texts = fragments(spark, path).select("file", "block", F.row_number().over(place).alias("k"), "value")
    ordered = wanted.join(first, ["file", "block"])
    lead = F.when(F.col("block") == 0, 2).otherwise(1)  # a file's first fragment is what stands before its first magic
    ordered = ordered.withColumn("k", (F.col("seq") - F.col("first") + lead).cast("int"))
    parts = ordered.join(texts, ["file", "block", "k"]).groupBy("file", "owner", "page", "record_type", "refers", "body", "length").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    text = parts.withColumn("value", F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC)).withColumn("http", F.substring_index("value", END, 2))
    payload = F.expr("substring(cast(value as binary), cast(octet_length(http) + 5 as int), cast(greatest(body + length - octet_length(http) - 4, 0) as int))")
    return text.select("page", "record_type", "refers", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))


def archive(pages: DataFrame, path: str | None = None, least: int = REVISIT_BYTES, file_records: int = FILE_RECORDS) -> DataFrame:
    """The operator: write every row of pages as a record under path, read the archives back.

    Null html is an empty payload; null urls get a urn; repeated rows are records of their own (equal page_ids
    of equal payloads are all responses); no rows, no records; extra columns are ignored.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(plan_records(pages, least), path, file_records)
    return read_archives(spark, path)
