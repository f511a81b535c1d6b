"""The snapshot archive: listing, identity, integrity, limits and retention.

``meta`` is one row per archived snapshot: feed, snapshot_ts, fetched_ts, bytes, sha256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywind.functions import scalars as S
from tallywind.session import materialize
from tallywind.schemas import DAY


def with_date(meta: DataFrame) -> DataFrame:
    """Add the ``date`` partition column archives and metadata tables are laid out by."""
    return meta.withColumn("date", S.day_date(S.day_index("snapshot_ts")).cast("string"))


def snapshots_since(meta: DataFrame, since: int, feed: str | None = None) -> DataFrame:
    """Snapshots at or after ``since``, oldest first. The predicate on ``date`` prunes the
    partitions before it; the one on the instant trims the first day."""
    if "date" in meta.columns:
        meta = meta.filter(F.col("date") >= S.day_date(F.lit(since // DAY)).cast("string"))
    rows = meta.filter(F.col("snapshot_ts") >= F.lit(since))
    if feed is not None:
        rows = rows.filter(F.col("feed") == F.lit(feed))
    return rows.orderBy("snapshot_ts", "feed")


def latest_snapshot(meta: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("snapshot_ts", "fetched_ts", "bytes", "sha256"), F.col("snapshot_ts"))
    return meta.groupBy("feed").agg(newest.alias("m")).select("feed", "m.*")


def identify(fetches: DataFrame, published: str = "published_ts", fetched: str = "fetched_ts",
             grace: int = 300) -> DataFrame:
    """Give each fetch the time that names its snapshot."""
    return fetches.withColumn("snapshot_ts", S.archive_time(published, fetched, grace))


def conflicts(meta: DataFrame) -> DataFrame:
    """How often each (feed, time) was stored and whether its copies differ."""
    return meta.groupBy("feed", "snapshot_ts").agg(
        F.count(F.lit(1)).alias("copies"), F.countDistinct("sha256").alias("digests")).withColumn(
        "verdict", F.when(F.col("digests") > 1, "conflict").when(F.col("copies") > 1, "repeat")
        .otherwise("single"))


def integrity(files: DataFrame, meta: DataFrame, max_bytes: int) -> DataFrame:
    """Check decoded payloads (``feed, snapshot_ts, content``) against their metadata."""
    seen = files.select("feed", "snapshot_ts", F.octet_length("content").cast("bigint").alias("size"),
                        F.sha2("content", 256).alias("digest"))
    rows = seen.join(meta.select("feed", "snapshot_ts", "bytes", "sha256"), ["feed", "snapshot_ts"], "left")
    verdict = (F.when(F.col("size") > F.lit(max_bytes), "too large")
               .when(F.col("sha256").isNull(), "no metadata")
               .when((F.col("bytes") > 0) & (F.col("bytes") != F.col("size")), "size differs")
               .when(F.col("sha256") != F.col("digest"), "digest differs").otherwise("ok"))
    return rows.select("feed", "snapshot_ts", "size", "digest", verdict.alias("verdict"))


def thinning(meta: DataFrame, now: int, full_days: int = 90, keep_daily: bool = True) -> DataFrame:
    """Keep or delete per snapshot: all recent ones, then the first of each UTC day and feed."""
    day = S.day_index("snapshot_ts")
    w = Window.partitionBy("feed", day).orderBy("snapshot_ts")
    recent = F.col("snapshot_ts") >= F.lit(now - full_days * DAY)
    first: Column = (F.row_number().over(w) == 1) if keep_daily else F.lit(False)
    return meta.select("feed", "snapshot_ts",
                       F.when(recent | first, "keep").otherwise("delete").alias("action"))


def compaction_plan(delta: DataFrame, daily: DataFrame, raw_before: int, daily_before: int | None) -> DataFrame:
    """Rows each retention cut removes, per table and day; months are never cut.

    The raw cutoff is floored to a day so that no day loses part of its deltas.
    """
    raw = delta.groupBy(S.day_index("ts").alias("day")).agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit("delta").alias("table_name"), "day", "row_count",
        (F.col("day") < F.lit(raw_before // DAY)).alias("prune"))
    cut = F.lit(False) if daily_before is None else F.col("day") < F.lit(daily_before // DAY)
    day = daily.groupBy("day").agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit("daily").alias("table_name"), "day", "row_count", cut.alias("prune"))
    return raw.unionByName(day)


def pruned(table: DataFrame, column: str, since: int) -> DataFrame:
    """A new copy of a table that is not laid out by ``column``, from ``since`` on."""
    return materialize(table.filter(F.col(column) >= F.lit(since)), f"pruned-{column}")


def delete_partitions(spark: SparkSession, root: str, column: str, keep) -> int:
    """Drop whole ``column=value`` folders of a table for which ``keep(value)`` is false."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith(f"{column}=") and not keep(name.split("=", 1)[1]):
            gone += bool(fs.delete(status.getPath(), True))
    return gone
