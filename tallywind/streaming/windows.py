"""Windowed aggregations over delta and event streams.

The streams keep tumbling sums, one state row per entity and bucket, and emit in update mode,
so the newest bucket is visible at once. Trailing windows are read from those sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywind.operators.windows import trailing_sums
from tallywind.schemas import HOUR


def _event_time(ts: str, shift: int = 0):
    return F.timestamp_seconds(F.col(ts) - F.lit(shift))


def hourly_sums(deltas: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Points per entity and hour; ``ts`` is the hour's end.

    Spark's windows are [start, end); moving whole-second instants back by one second turns
    that into the half-open interval (start, end] the batch figures use.
    """
    timed = deltas.withColumn("event_time", _event_time("ts", 1)).withWatermark("event_time", late)
    w = timed.groupBy(*keys, F.window("event_time", "1 hour")).agg(F.sum("d_score").alias("points"))
    return w.select(*keys, F.unix_seconds(F.col("window.end")).alias("ts"), "points")


def rolling_sums(hours: DataFrame, keys: list[str], span: int) -> DataFrame:
    """Sums over (ts - span, ts] at every full hour that has any, from hourly sums.

    An hour's points come in at its end and go ``span`` later, so running totals over those two
    rows are the sums; they are spread over the hours they hold for only after all shuffles.
    """
    come = hours.select(*keys, "ts", "points", F.lit(1).alias("n"))
    go = hours.select(*keys, (F.col("ts") + F.lit(span)).alias("ts"), (-F.col("points")).alias("points"), F.lit(-1).alias("n"))
    moved = come.unionByName(go).groupBy(*keys, "ts").agg(F.sum("points").alias("points"), F.sum("n").alias("n"))
    w = Window.partitionBy(*keys).orderBy("ts")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = moved.select(*keys, "ts", F.lead("ts").over(w).alias("until"), F.sum("points").over(upto).alias("points"), F.sum("n").over(upto).alias("n"))
    ends = F.sequence(F.col("ts"), F.col("until") - F.lit(HOUR), F.lit(HOUR).cast("bigint"))
    return held.filter("n > 0").select(*keys, F.explode(ends).alias("ts"), "points")


def daily_buckets(deltas: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Tumbling UTC days."""
    timed = deltas.withColumn("event_time", _event_time("ts")).withWatermark("event_time", late)
    w = timed.groupBy(*keys, F.window("event_time", "1 day")).agg(
        F.sum("d_score").alias("points"), F.sum("d_wu").alias("wus"))
    day = (F.unix_seconds(F.col("window.start")) / 86400).cast("bigint")
    return w.select(*keys, day.alias("day"), "points", "wus")


def once_per_snapshot(meta: DataFrame, late: str = "2 hours") -> DataFrame:
    """Drop repeats of a snapshot that arrive within the watermark."""
    timed = meta.withColumn("event_time", _event_time("snapshot_ts")).withWatermark("event_time", late)
    return timed.dropDuplicatesWithinWatermark(["feed", "snapshot_ts"]).drop("event_time")


def second_counts(events: DataFrame, ts: str, late: str = "10 seconds") -> DataFrame:
    """Events per second: (sec, n)."""
    timed = events.withColumn("event_time", F.col(ts)).withWatermark("event_time", late)
    w = timed.groupBy(F.window("event_time", "1 second")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.unix_seconds(F.col("window.start")).alias("sec"), "n")


def event_rate(counts: DataFrame, span: int = 60) -> DataFrame:
    """Events in the trailing minute at every second that has one, from counts per second."""
    return trailing_sums(counts, span)
