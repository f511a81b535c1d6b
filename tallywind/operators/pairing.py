"""Matching the two feeds into cycles, and the publish cadence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywind.operators.windows import carry_last
from tallywind.schemas import HOUR

# Bounds of a believable publish interval, and the cycles that hold 24 gaps.
MIN_INTERVAL, MAX_INTERVAL, CADENCE_CYCLES = 50 * 60, 75 * 60, 25
STALE_GRACE = 20 * 60


def pair_snapshots(meta: DataFrame) -> DataFrame:
    """Each user snapshot with the newest team snapshot at or before it.

    A team snapshot may serve several users' cycles; a user snapshot with no team snapshot
    before it is skipped. The cycle's time is the user snapshot's.
    """
    line = meta.select(
        F.col("snapshot_ts").alias("ts"),
        F.when(F.col("feed") == "team", 0).otherwise(1).alias("kind"),
        F.when(F.col("feed") == "team", F.col("snapshot_ts")).alias("team_ts")).distinct()
    return (carry_last(line, "team_ts").filter((F.col("kind") == 1) & F.col("team_ts").isNotNull())
            .select("ts", "team_ts", F.col("ts").alias("user_ts")))


def cadence(cycles: DataFrame, recent: int = CADENCE_CYCLES) -> DataFrame:
    """Median believable gap among the most recent cycles, and the publish it predicts.

    The median is the element at index n // 2 of the sorted gaps; with none left the hour
    is assumed and the estimate is not marked as measured.
    """
    last = cycles.orderBy(F.col("ts").desc()).limit(recent)
    # At most ``recent`` rows from here on.
    gap = F.col("ts") - F.lag("ts").over(Window.orderBy("ts"))
    gaps = last.withColumn("gap", gap)
    ok = F.col("gap").between(MIN_INTERVAL, MAX_INTERVAL)
    row = gaps.agg(
        F.max("ts").alias("snapshot_ts"),
        F.sort_array(F.collect_list(F.when(ok, F.col("gap")))).alias("g"))
    n = F.size("g")
    return row.select(
        "snapshot_ts", n.alias("samples"),
        F.when(n > 0, F.element_at("g", F.floor(n / 2).cast("int") + 1))
        .otherwise(F.lit(HOUR)).cast("bigint").alias("interval_sec"),
        (n > 0).alias("measured")).withColumn(
        "next_expected_ts", F.col("snapshot_ts") + F.col("interval_sec"))


def staleness(cadence_row: DataFrame, as_of: Column) -> DataFrame:
    """Stale once the next publish is overdue by more than the grace period."""
    due = F.col("next_expected_ts") + F.lit(STALE_GRACE)
    return cadence_row.select("snapshot_ts", "next_expected_ts", due.alias("stale_after_ts"),
                              (as_of > due).alias("stale"))
