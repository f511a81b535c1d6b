"""Transition alerts over a stream of readings: the batch expressions, batch by batch, with
each rule's last reading carried on in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywind.operators import alerts
from tallywind.session import path_exists
from tallywind.sources.sinks import replace_partitions
from tallywind.streaming.runner import run_available

FIRED = "id string, type string, target string, ts bigint, value bigint"


def _carry_before(spark, path: str, batch_id: int) -> DataFrame | None:
    """Each rule's last reading in the batches before ``batch_id``."""
    if not path_exists(spark, path):
        return None
    names = [c.split()[0] for c in alerts.CARRY.split(", ")]
    rows = spark.read.schema(f"{alerts.CARRY}, batch bigint").parquet(path).filter(F.col("batch") < batch_id)
    return rows.groupBy("id").agg(*[F.max_by(c, "ts").alias(f"_{c}") for c in names[2:]], F.max("ts").alias("ts")).select(
        "id", "ts", *[F.col(f"_{c}").alias(c) for c in names[2:]])


def alert_stream(rules: DataFrame, readings: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Firings of ``rules`` (a table) over ``readings`` (a stream of per-cycle figures, whole
    cycles in a batch). A batch run again writes the same partitions."""
    spark = rules.sparkSession

    def body(batch: DataFrame, batch_id: int) -> None:
        path = f"{out}/_staged"
        alerts.walk(rules, batch, _carry_before(spark, f"{out}/carry", batch_id)).write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path)
        tag = lambda df: df.withColumn("batch", F.lit(batch_id))
        replace_partitions(tag(alerts.firings(rows).withColumn("value", F.col("value").cast("bigint"))), f"{out}/fired", "batch")
        replace_partitions(tag(alerts.carried(rows)), f"{out}/carry", "batch")

    run_available(readings, checkpoint, body)
    if not path_exists(spark, f"{out}/fired"):
        return spark.createDataFrame([], FIRED)
    return spark.read.schema(f"{FIRED}, batch bigint").parquet(f"{out}/fired").drop("batch")
