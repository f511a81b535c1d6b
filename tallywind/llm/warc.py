"""WARC archives: written from pages, read back by boundary-chain verification.

Writing. Of pages with equal payloads the one with the smallest page_id becomes a response
record, the others revisit records that refer to it. Records are lines of Spark's text writer
with the separator CR LF CR LF, so a file is records one after another.

Reading. A file is cut at every occurrence of the magic ``WARC/1.1`` by Spark's splittable text
reader; each piece is a candidate record that names, by its Content-Length, the offset of its
successor. A magic inside a payload makes false candidates. What counts is reachability from the
start of the file: in each split the chains are followed by pointer doubling to the first offset
outside it, the exits of splits are then jumped the same way across the file, and the offset at
which the chain enters a split marks that split's records. Payloads with a magic inside are put
together again from their pieces; digests are computed from what was read.

Defined cases: null html is an empty payload; a null url is empty; rows with null page_id are
responses; repeated rows with the same page_id and payload are responses alike; an empty table
gives an empty archive. Line breaks in a url are percent-encoded.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywind.session import new_path

from .common import ship_by_value, store

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Base32 of the SHA-1: five hex digits are four characters."""
    digest = F.sha1(payload)

    def four(i: Column) -> Column:
        v = F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, refers_to) of the pages whose payload a page with a smaller id has already."""
    small = (pages.select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
             .filter(F.octet_length("payload") >= least_bytes).filter("page_id IS NOT NULL")
             .select("page_id", F.sha2("payload", 256).alias("digest")))
    first = small.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    first = first.filter("last > refers_to").drop("last")
    return (small.join(first, "digest").filter("page_id > refers_to")
            .groupBy("page_id").agg(F.min("refers_to").alias("refers_to"), F.min("digest").alias("digest")))


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One column ``value``: the records without the gap that follows them."""
    again = store(revisits(pages, least_bytes), "warc-revisits").select(
        F.col("page_id").alias("of"), "refers_to", F.col("digest").alias("same"))
    body = F.encode("payload", "UTF-8")
    p = (pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
         .join(again, (F.col("page_id") == F.col("of")) & (F.sha2(body, 256) == F.col("same")), "left")
         .withColumn("n_bytes", F.octet_length("payload"))
         .withColumn("http", F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                                      F.col("n_bytes"), F.lit(GAP))))
    again = F.col("refers_to").isNotNull()
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name,
        F.lit(">\r\nWARC-Target-URI: "), F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"), base32_sha1(body),
        F.when(again, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
            F.col("refers_to"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("http") + F.when(again, F.lit(0)).otherwise(F.col("n_bytes")), F.lit(GAP), F.col("http"))
    return p.select(F.when(again, head).otherwise(F.concat(head, F.col("payload"))).alias("value"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int = 100_000) -> None:
    (records(pages, least_bytes).write.option("lineSep", GAP).option("maxRecordsPerFile", records_per_file)
     .mode("overwrite").text(path))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between magics, by file, block of the file and place in the block."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nr"), "value")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per piece between magics: file, block, nr (order in the block), its size with the
    magic before it, the fields of its header, the size the header states, and, if the piece is
    as long as stated, the payload's size and digest."""
    at = F.instr("value", GAP)
    head = F.when(at > 0, F.substring("value", F.lit(1), at - 1))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r]*)", 1), F.lit(""))
    block = F.substring(F.col("value").cast("binary"), F.octet_length("head") + len(GAP) + 1,
                        (F.col("size") - F.octet_length("head") - len(MAGIC) - 2 * len(GAP)).cast("int"))
    return (_pieces(spark, path).withColumn("head", head)
            .withColumn("size", F.octet_length("value") + len(MAGIC))
            .withColumn("stated", F.octet_length("head") + len(MAGIC) + 2 * len(GAP) + field("Content-Length").try_cast("long"))
            .withColumn("whole", F.coalesce(F.col("size") == F.col("stated"), F.lit(False)))
            .withColumn("body", F.when(F.col("whole"), block))
            .select("file", "block", "nr", "size", "stated", "whole",
                    field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("id"),
                    field("WARC-Payload-Digest").alias("digest"), field("WARC-Refers-To").alias("refers"),
                    *_http(F.col("body"))))


def _http(block: Column) -> list[Column]:
    """Of a record's block, a HTTP response: the length it states, the payload's size and digest."""
    at = F.instr(block.cast("string"), GAP)  # the header is ASCII, so characters are bytes
    payload = F.substring(block, at + len(GAP), F.octet_length(block).cast("int"))
    stated = F.regexp_extract(F.substring(block, F.lit(1), at).cast("string"), r"Content-Length: (\d+)", 1).try_cast("long")
    return [stated.alias("http_bytes"), F.octet_length(payload).cast("long").alias("n_bytes"), base32_sha1(payload).alias("found")]


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pointer doubling inside a split: for each candidate the first offset its chain reaches
    that is no candidate here."""
    pdf = pdf.sort_values("start", ignore_index=True)
    start, succ = pdf["start"].to_numpy(), pdf["succ"].to_numpy()
    n = len(start)
    to = np.searchsorted(start, succ)
    inside = (to < n) & (start[np.minimum(to, n - 1)] == succ)
    jump = np.where(inside, np.minimum(to, n - 1), np.arange(n))
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    pdf["exit"] = succ[jump]
    return pdf[["file", "block", "start", "exit"]]


def _reached(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates on the chain from the offset at which it enters the split."""
    pdf = pdf.sort_values("start", ignore_index=True)
    start, succ = pdf["start"].to_numpy(), pdf["succ"].to_numpy()
    n = len(start)
    to = np.searchsorted(start, succ)
    jump = np.append(np.where((to < n) & (start[np.minimum(to, n - 1)] == succ), to, n), n)
    mark = np.append(np.isin(start, pdf["entry"].to_numpy()), False)
    while jump[:n].min(initial=n) < n:
        mark[jump[mark]] = True
        mark[n] = False
        jump = jump[jump]
    pdf = pdf[mark[:n]]
    return pdf[["file", "block", "start", "succ"]]


def chain(found: DataFrame) -> DataFrame:
    """(file, block, start, succ) of the candidates that the chain from the start of their
    file reaches. ``found`` has file, block, start and succ (null where no header is valid)."""
    ship_by_value(__name__)
    nodes = found.filter("succ IS NOT NULL").select("file", "block", "start", "succ")
    hops = store(nodes.groupBy("file", "block").applyInPandas(_exits, "file string, block long, start long, exit long"), "warc-hops")
    # Only offsets that a chain can enter a split by take part from here on.
    firsts = hops.select("file").distinct().select("file", F.lit(0).cast("long").alias("start"))
    doors = hops.select("file", F.col("exit").alias("start")).unionByName(firsts).distinct()
    jumps = store(hops.join(doors, ["file", "start"], "left_semi").select("file", "start", F.col("exit").alias("to")), "warc-jumps")
    splits = hops.groupBy("file").agg(F.count_distinct("block").alias("n")).agg(F.max("n")).first()[0] or 0
    marked = firsts
    for _ in range(math.ceil(math.log2(splits + 1)) if splits > 1 else 0):
        further = marked.join(jumps, ["file", "start"]).select("file", F.col("to").alias("start"))
        marked = store(marked.unionByName(further).distinct(), "warc-marked")
        jumps = store(jumps.join(jumps.select("file", F.col("start").alias("to"), F.col("to").alias("next")), ["file", "to"], "left")
                      .select("file", "start", F.coalesce("next", "to").alias("to")), "warc-jumps")
    entry = (nodes.select("file", "block", "start").join(marked, ["file", "start"], "left_semi")
             .groupBy("file", "block").agg(F.min("start").alias("entry")))
    return nodes.join(entry, ["file", "block"]).groupBy("file", "block").applyInPandas(
        _reached, "file string, block long, start long, succ long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``: file, start, type, page_id, refers_to,
    digest (as stated), found (as computed; null for revisits), http_bytes and n_bytes."""
    raw = store(candidates(spark, path), "warc-candidates")
    within = Window.partitionBy("file", "block").orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("file", "block").agg(F.sum("size").alias("n"))
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = (raw.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
              .join(blocks, ["file", "block"])
              # every piece but the first of a file follows a magic
              .withColumn("start", F.col("base") + F.col("before") - len(MAGIC))
              .withColumn("succ", F.col("start") + F.col("stated")))
    placed = store(placed.filter("start >= 0"), "warc-placed")
    good = store(chain(placed), "warc-chain")
    fields = ["type", "id", "digest", "refers"]
    rows = placed.join(good.select("file", "start"), ["file", "start"])
    whole = rows.filter("whole").select("file", "start", *fields, "http_bytes", "n_bytes", "found")
    cut = rows.filter("NOT whole").select("file", "start", "succ", *fields)
    if not cut.isEmpty():
        whole = whole.unionByName(_mended(spark, path, raw, placed, cut, fields))
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1)
    is_response = F.col("type") == "response"
    return whole.select(
        "file", "start", "type", page("id").try_cast("long").alias("page_id"),
        page("refers").try_cast("long").alias("refers_to"),
        F.regexp_replace("digest", "^sha1:", "").alias("digest"),
        F.when(is_response, F.col("found")).alias("found"), "http_bytes", "n_bytes")


def _mended(spark: SparkSession, path: str, raw: DataFrame, placed: DataFrame, cut: DataFrame, fields: list[str]) -> DataFrame:
    """Records with a magic inside: their pieces, from start to succ, read once more and joined."""
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    first = lambda df: df.groupBy("file", "block").agg(F.min("nr").alias("first"))
    pieces = (placed.select("file", "block", "nr", "start").join(first(raw), ["file", "block"])
              .join(cut.select("file", "start", F.struct("start", "succ").alias("of")), ["file", "start"], "left")
              .withColumn("of", F.last("of", ignorenulls=True).over(upto)).filter("start < of.succ")
              .select("file", "block", (F.col("nr") - F.col("first")).alias("place"), "start", F.col("of.start").alias("owner")))
    again = _pieces(spark, path)
    again = again.join(first(again), ["file", "block"]).select(
        "file", "block", (F.col("nr") - F.col("first")).alias("place"), F.col("value").cast("binary").alias("piece"))
    parts = (again.join(pieces, ["file", "block", "place"]).groupBy("file", "owner")
             .agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("parts")))
    magic = F.lit(MAGIC).cast("binary")
    joined = F.aggregate("parts", F.lit("").cast("binary"), lambda done, p: F.concat(done, magic, p["piece"]))
    parts = parts.select("file", F.col("owner").alias("start"), F.substring(joined, F.lit(len(MAGIC) + 1), F.octet_length(joined)).alias("value"))
    at = F.instr(F.col("value").cast("string"), GAP)
    head = F.octet_length(F.substring(F.col("value").cast("string"), F.lit(1), at - 1))
    body = F.substring("value", head + len(GAP) + 1, F.octet_length("value") - head - 2 * len(GAP))
    return cut.join(parts.withColumn("body", body), ["file", "start"]).select("file", "start", *fields, *_http(F.col("body")))


def pages_of(found: DataFrame) -> DataFrame:
    """Per page, from the records read: payload_bytes, payload_digest, record_type, refers_to.
    A revisit's payload is that of the record it refers to, which its header describes."""
    return found.select("page_id", F.when(F.col("type") == "response", F.col("n_bytes")).otherwise(F.col("http_bytes")).alias("payload_bytes"),
                        F.coalesce("found", "digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    path = new_path(pages.sparkSession, "llm-warc")
    write(pages, path, least_bytes)
    return pages_of(read(pages.sparkSession, path))


#: What reading back must give, from the pages themselves, in DuckDB's SQL.
SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html)) AS n, upper(sha1(html)) AS hex, sha256(html) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d WHERE page_id IS NOT NULL GROUP BY h)
SELECT d.page_id, d.n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda x: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    ((('0x' || substr(hex, x // 4 * 5 + 1, 5))::BIGINT >> (15 - 5 * (x % 4))) & 31)::INTEGER + 1]), '') AS payload_digest,
  CASE WHEN d.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id > f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h
"""
