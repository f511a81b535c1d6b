"""Table and export sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywind.functions import scalars as S


def write_by_day(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Replace exactly the (day, cycle) partitions present in ``df``: writing a cycle again
    gives the same table."""
    out = df.withColumn("day", S.day_index(ts)).withColumn("cycle", F.col(ts))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "cycle").parquet(path))


def write_batch(df: DataFrame, path: str, batch_id: int, ts: str = "ts") -> None:
    """Replace the (day, batch) partitions of one micro-batch. Running the batch again after
    a failure writes the same partitions; days stay whole folders for retention."""
    out = df.withColumn("day", S.day_index(ts)).withColumn("batch", F.lit(batch_id))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "batch").parquet(path))


def replace_partitions(df: DataFrame, path: str, *columns: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*columns).parquet(path))


def export_history(series: DataFrame, granularity: str, path: str) -> DataFrame:
    """Write ``at,points,wus`` as CSV with a header. Hourly rows are pruned, so they are
    not offered as an archive."""
    if granularity in ("hourly", "cycle"):
        raise ValueError("hourly history is not exported")
    rows = export_rows(series)
    rows.write.mode("overwrite").option("header", True).csv(path)
    return rows


def export_rows(series: DataFrame) -> DataFrame:
    at = F.date_format(F.timestamp_seconds("bucket_ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    keys = [c for c in series.columns if c not in ("bucket_ts", "points", "wus")]
    return series.select(*keys, at.alias("at_time"), "points", "wus")
