"""Daily, weekly, monthly and project rollups of delta tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywind.functions import scalars as S


def daily(delta: DataFrame, keys: list[str]) -> DataFrame:
    """Production per UTC day, recomputed from the day's deltas."""
    return delta.groupBy(*keys, S.day_index("ts").alias("day")).agg(
        F.sum("d_score").alias("points"), F.sum("d_wu").alias("wus"))


def monthly(daily_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per UTC month, from days: stays right after the raw deltas are pruned."""
    return daily_rows.groupBy(*keys, S.month_of_day("day").alias("month")).agg(
        F.sum("points").alias("points"), F.sum("wus").alias("wus"))


def weekly(daily_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per Sunday-start UTC week, from days."""
    return daily_rows.groupBy(*keys, S.week_of_day("day").alias("week")).agg(
        F.sum("points").alias("points"), F.sum("wus").alias("wus"))


def project_deltas(team_delta: DataFrame) -> DataFrame:
    """Whole-project production per cycle; a cycle in which nothing moved has no row."""
    return team_delta.groupBy("ts").agg(F.sum("d_score").alias("d_score"), F.sum("d_wu").alias("d_wu"))


def month_totals(daily_rows: DataFrame, keys: list[str], month: int) -> DataFrame:
    lo = S.month_start_day(F.lit(month).cast("bigint"))
    hi = S.month_start_day(F.lit(month + 1).cast("bigint"))
    return daily_rows.filter((F.col("day") >= lo) & (F.col("day") < hi)).groupBy(*keys).agg(
        F.sum("points").alias("points"), F.sum("wus").alias("wus"))


def project_rebuild(team_delta: DataFrame, team_daily: DataFrame, team_monthly: DataFrame) -> DataFrame:
    """All project buckets from the team tables, months from months so pruned days count."""
    cyc = team_delta.groupBy(F.col("ts").alias("bucket")).agg(
        F.sum("d_score").alias("points"), F.sum("d_wu").alias("wus")).withColumn("grain", F.lit("cycle"))
    day = team_daily.groupBy(F.col("day").alias("bucket")).agg(
        F.sum("points").alias("points"), F.sum("wus").alias("wus")).withColumn("grain", F.lit("day"))
    mon = team_monthly.groupBy(F.col("month").alias("bucket")).agg(
        F.sum("points").alias("points"), F.sum("wus").alias("wus")).withColumn("grain", F.lit("month"))
    return cyc.unionByName(day).unionByName(mon).select("grain", "bucket", "points", "wus")


def replay(member_delta: DataFrame, team_delta: DataFrame, cycles: DataFrame, since: int) -> DataFrame:
    """Cycles at or after ``since`` with what each held; idle cycles appear with zeros."""
    recent = F.col("ts") >= F.lit(since)

    def side(d: DataFrame, label: str) -> DataFrame:
        return d.filter(recent).groupBy("ts").agg(
            F.count(F.lit(1)).alias(f"{label}_deltas"), F.sum("d_score").alias(f"{label}_points"))

    out = (cycles.filter(recent).select("ts")
           .join(side(member_delta, "member"), "ts", "full_outer")
           .join(side(team_delta, "team"), "ts", "full_outer"))
    cols = ["member_deltas", "member_points", "team_deltas", "team_points"]
    return out.select("ts", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in cols])
