"""The snapshot archive by feed, date and time, and a stream of what it holds in its own order.

``root/<feed>/date=YYYY-MM-DD/snapshot_ts=N/`` holds one snapshot, ``root/meta/<feed>/date=...`` a row
per snapshot (feed, snapshot_ts, row_count, digest, malformed), written with it. The file source
of Spark hands files over by the time they were written; here the offset of a stream is the
snapshot's own time, so that a backfill in any order is applied in the right one, and only the
folders of the dates asked for are listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallywind.functions import scalars as S
from tallywind.schemas import MEMBER_SNAPSHOT, TEAM_SNAPSHOT
from tallywind.session import path_exists, ship_by_value

FEEDS = {"user": MEMBER_SNAPSHOT, "team": TEAM_SNAPSHOT}
META = "feed string, snapshot_ts bigint, row_count bigint, digest decimal(38,0), malformed bigint"


def date_of(ts: int) -> str:
    return datetime.fromtimestamp(ts, timezone.utc).strftime("%Y-%m-%d")


def row_digest(feed: str):
    """Aggregate over a snapshot's rows that does not depend on their order."""
    columns = [f.name for f in FEEDS[feed] if f.name != "snapshot_ts"]
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))


def snapshot_meta(rows: DataFrame, feed: str, malformed: DataFrame | None = None) -> DataFrame:
    """What is kept about each snapshot. ``malformed`` (snapshot_ts, malformed) are counts of
    records a parser left out."""
    meta = rows.groupBy("snapshot_ts").agg(F.count(F.lit(1)).alias("row_count"), row_digest(feed).alias("digest"))
    meta = meta.join(malformed, "snapshot_ts", "left") if malformed is not None else meta.withColumn("malformed", F.lit(0))
    return meta.select(F.lit(feed).alias("feed"), "snapshot_ts", "row_count", "digest", F.coalesce("malformed", F.lit(0)).cast("bigint").alias("malformed"))


def write_archive(rows: DataFrame, feed: str, root: str, meta: DataFrame | None = None) -> None:
    """Add snapshots to the archive, each with its row in ``meta``."""
    dated = rows.select(*FEEDS[feed].names).withColumn("date", S.day_date(S.day_index("snapshot_ts")).cast("string"))
    dated.repartition("snapshot_ts").write.mode("append").partitionBy("date", "snapshot_ts").parquet(f"{root}/{feed}")
    meta = snapshot_meta(rows, feed) if meta is None else meta
    meta = meta.withColumn("date", S.day_date(S.day_index("snapshot_ts")).cast("string"))
    # A folder per feed: writers of the two feeds do not share a commit.
    meta.repartition("date").write.mode("append").partitionBy("date").parquet(f"{root}/meta/{feed}")


def read_feed(spark: SparkSession, root: str, feed: str, dates: list[str]) -> DataFrame:
    """The rows of a feed's snapshots on some dates; no other folder is listed."""
    paths = [p for p in (f"{root}/{feed}/date={d}" for d in dates) if path_exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], FEEDS[feed])
    schema = StructType([*FEEDS[feed].fields, StructField("date", StringType())])
    return spark.read.schema(schema).option("basePath", f"{root}/{feed}").parquet(*paths).select(*FEEDS[feed].names)


def read_meta(spark: SparkSession, root: str, dates: list[str]) -> DataFrame:
    """One row per snapshot on some dates; of several the first in order of their values."""
    paths = [p for p in (f"{root}/meta/{feed}/date={d}" for feed in FEEDS for d in dates) if path_exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], META)
    rows = spark.read.schema(META).parquet(*paths)
    first = rows.groupBy("feed", "snapshot_ts").agg(F.min(F.struct("row_count", "digest", "malformed")).alias("m"))
    return first.select("feed", "snapshot_ts", "m.*")


class _Folder(InputPartition):
    def __init__(self, date: str, after: int, upto: int):
        self.date, self.after, self.upto = date, after, upto


class SnapshotReader(DataSourceStreamReader):
    """Offsets are snapshot times. A trigger takes the snapshots up to the ``limit``-th user
    snapshot after ``after``: those name the cycles."""

    def __init__(self, root: str, after: int, limit: int):
        self.root, self.after, self.limit = root, after, limit
        self.reached = after

    def _children(self, path: str, column: str) -> list[str]:
        if "://" in self.root or self.root.startswith("file:"):
            files, base = arrow_fs.FileSystem.from_uri(self.root.replace("file:///", "file:/").replace("file:/", "file:///"))
        else:
            files, base = arrow_fs.LocalFileSystem(), self.root
        found = files.get_file_info(arrow_fs.FileSelector(f"{base}/{path}", allow_not_found=True))
        return sorted(f.base_name.partition("=")[2] for f in found if f.base_name.startswith(f"{column}="))

    def _dates(self, after: int, upto: int | None = None) -> list[str]:
        low, high = date_of(max(after, 0)), date_of(upto) if upto is not None else "9999"
        return sorted({d for feed in FEEDS for d in self._children(feed, "date") if low <= d <= high})

    def _times(self, feed: str, date: str) -> list[int]:
        return sorted(map(int, self._children(f"{feed}/date={date}", "snapshot_ts")))

    def initialOffset(self) -> dict:
        return {"ts": self.after}

    def latestOffset(self) -> dict:
        newest, n = self.reached, 0
        for date in self._dates(self.reached):
            for ts in self._times("user", date):
                if ts > self.reached and (not self.limit or n < self.limit):
                    newest, n = ts, n + 1
        self.reached = newest  # the next trigger of this reader goes on from here
        return {"ts": newest}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["ts"] >= end["ts"]:
            return []
        return [_Folder(d, start["ts"], end["ts"]) for d in self._dates(start["ts"], end["ts"])]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        for feed in FEEDS:
            for ts in self._times(feed, partition.date):
                if partition.after < ts <= partition.upto:
                    yield feed, ts, partition.date


class SnapshotSource(DataSource):
    """``spark.readStream.format("snapshots").option("path", root)``: feed, snapshot_ts and date
    of archived snapshots, oldest first from ``after`` on, ``cyclesPerTrigger`` cycles at a time."""

    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> StructType:
        return StructType([StructField("feed", StringType()), StructField("snapshot_ts", LongType()), StructField("date", StringType())])

    def streamReader(self, schema: StructType) -> SnapshotReader:
        return SnapshotReader(self.options["path"].rstrip("/"), int(self.options.get("after", -1)), int(self.options.get("cyclesPerTrigger", 0)))


def open_snapshots(spark: SparkSession, root: str, after: int = -1, cycles_per_trigger: int | None = None) -> DataFrame:
    """The archive at ``root`` as a stream of its snapshots."""
    ship_by_value(__name__)
    spark.dataSource.register(SnapshotSource)
    return (spark.readStream.format("snapshots").option("path", root).option("after", str(after))
            .option("cyclesPerTrigger", str(cycles_per_trigger or 0)).load())
