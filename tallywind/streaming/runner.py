"""Running a stream over what is available now into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tallywind.session import STREAM_CONF, new_path
from tallywind.sources.sinks import replace_partitions


def use_stream_conf(spark: SparkSession) -> None:
    for k, v in STREAM_CONF.items():
        spark.conf.set(k, v)


def open_table_stream(spark: SparkSession, path: str, schema: StructType,
                      files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None] | None = None,
                  out: str | None = None, mode: str = "append") -> StreamingQuery:
    """Process everything available and stop; a second run picks up where this one ended.

    A stream keeps the ``spark.sql.shuffle.partitions`` it started with for life.
    """
    use_stream_conf(stream.sparkSession)
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(batch).start() if batch else w.format("parquet").option("path", out).start()
    q.awaitTermination()
    return q


def collect_stream(stream: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream into a fresh table and read the table back."""
    spark = stream.sparkSession
    out = new_path(spark, label)
    run_available(stream, new_path(spark, f"{label}-checkpoint"), out=out)
    return spark.read.schema(stream.schema).parquet(out)


def upsert_stream(stream: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """Run an update-mode aggregation and read the newest row of every key.

    A batch writes the keys it changed to a partition of its own, so running it again after a
    failure replaces the same rows. Nothing waits for a watermark: the newest window is there
    as soon as its first row is.
    """
    spark = stream.sparkSession
    run_available(stream, checkpoint, lambda batch, i: replace_partitions(batch.withColumn("batch", F.lit(i)), out, "batch"),
                  mode="update")
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    values = [c for c in stream.columns if c not in keys]
    newest = spark.read.schema(schema).parquet(out).groupBy(*keys).agg(
        *[F.max_by(c, "batch").alias(c) for c in values])
    return newest.select(*stream.columns)


def collect_updates(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    spark = stream.sparkSession
    return upsert_stream(stream, keys, new_path(spark, label), new_path(spark, f"{label}-checkpoint"))
