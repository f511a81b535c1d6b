"""Incremental ingest: snapshot folders in, delta, rollup and audit tables out.

Each micro-batch of snapshot files is staged, checked, differenced against the table of latest
totals and committed as whole (day, batch) partitions, so a batch that is run again after a
failure writes the same tables. A snapshot with a row that fails validation, or with more rows
than allowed, goes to ``quarantine`` whole and does not hold up the ones after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywind.functions import scalars as S
from tallywind.operators import rollups
from tallywind.schemas import MEMBER_SNAPSHOT, TEAM_SNAPSHOT
from tallywind.session import path_exists
from tallywind.sources.sinks import replace_partitions, write_batch
from tallywind.streaming.differencing import LatestTotals, deltas_of, difference, entity_schema
from tallywind.streaming.runner import open_table_stream, run_available

FEEDS = {"member": (["name", "team_id"], MEMBER_SNAPSHOT), "team": (["team_id"], TEAM_SNAPSHOT)}


def is_invalid():
    """A row no entity may have: totals are never negative."""
    return ~F.coalesce((F.col("score") >= 0) & (F.col("wus") >= 0) & F.col("team_id").isNotNull(), F.lit(False))


def refused_cycles(snapshots: DataFrame, max_rows: int | None = None) -> DataFrame:
    """(snapshot_ts, reason) of the snapshots that are not applied."""
    seen = snapshots.groupBy("snapshot_ts").agg(F.count_if(is_invalid()).alias("bad"), F.count(F.lit(1)).alias("n"))
    over = F.lit(False) if max_rows is None else F.col("n") > F.lit(max_rows)
    reason = F.when(F.col("bad") > 0, "invalid rows").when(over, "too many rows")
    return seen.withColumn("reason", reason).filter("reason IS NOT NULL").select("snapshot_ts", "reason")


def _newest_cycle(spark: SparkSession, out: str, feed: str, batch_id: int) -> int | None:
    path = f"{out}/{feed}_cycles"
    if not path_exists(spark, path):
        return None
    rows = spark.read.schema("ts bigint, day bigint, batch bigint").parquet(path)
    return rows.filter(F.col("batch") < batch_id).agg(F.max("ts").alias("m")).first()["m"]


def commit(feed: str, out: str, publish: Callable[[SparkSession, int], None] | None = None,
           state: DataFrame | None = None, max_rows: int | None = None):
    """foreachBatch body: quarantine, totals, deltas, audit, then the rollups of the days touched.

    The batch is first written whole, so the source is read once and what follows reads a
    table that does not depend on any executor.
    """
    keys, _ = FEEDS[feed]

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged, moved = f"{out}/_staged/{feed}", f"{out}/_staged/{feed}_moves"
        batch.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(batch.schema).parquet(staged)
        refused = refused_cycles(rows, max_rows)
        replace_partitions(rows.join(refused, "snapshot_ts").withColumn("batch", F.lit(batch_id)), f"{out}/{feed}_quarantine", "batch")
        totals = LatestTotals(spark, f"{out}/{feed}_latest", entity_schema(batch, keys), keys, state)
        applied = _newest_cycle(spark, out, feed, batch_id)
        if applied is None and state is not None:
            applied = state.agg(F.max("ts").alias("m")).first()["m"]
        good = rows.join(refused, "snapshot_ts", "left_anti")
        moves = difference(good, keys, totals.before(batch_id), applied)
        moves.write.mode("overwrite").parquet(moved)
        moves = spark.read.schema(moves.schema).parquet(moved)
        audit = moves.groupBy("ts").agg(
            F.count(F.lit(1)).alias("row_count"), F.count_if("first_sighting").alias("new_entities"),
            F.count_if("is_delta").alias("deltas"), F.count_if(F.col("d_score") < 0).alias("regressions"))
        # One value per calendar day in the batch.
        touched = [r["day"] for r in audit.select(S.day_index("ts").alias("day")).distinct().collect()]
        if not touched:
            return
        write_batch(moves.select(*keys, "ts", "score", "wus"), f"{out}/{feed}_totals", batch_id)
        write_batch(deltas_of(moves, keys), f"{out}/{feed}_delta", batch_id)
        write_batch(audit, f"{out}/{feed}_cycles", batch_id)
        totals.write(moves, batch_id)
        rebuild_days(spark, out, feed, touched)
        if publish is not None:
            publish(spark, moves.agg(F.max("ts").alias("m")).first()["m"])

    return body


def restore_state(spark: SparkSession, out: str, feed: str) -> DataFrame:
    """Latest totals of the committed batches, for a stream with a new checkpoint."""
    keys, schema = FEEDS[feed]
    entity = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema if f.name in keys)
    return LatestTotals(spark, f"{out}/{feed}_latest", entity, keys).before(1 << 62)


def rebuild_days(spark: SparkSession, out: str, feed: str, days: list[int]) -> None:
    """Recompute whole daily buckets, then the months they are in from the daily table.

    ``days`` are the calendar days of one batch, read with partition pruning.
    """
    keys, schema = FEEDS[feed]
    entity = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema if f.name in keys)
    # Schemas are given because a table holds no file until the first delta arrives.
    delta = (spark.read.schema(f"{entity}, ts bigint, d_score bigint, d_wu bigint, day bigint, batch bigint")
             .parquet(f"{out}/{feed}_delta").filter(F.col("day").isin(days)).drop("day", "batch"))
    replace_partitions(rollups.daily(delta, keys), f"{out}/{feed}_daily", "day")
    if not path_exists(spark, f"{out}/{feed}_daily"):
        return
    months = [r["m"] for r in spark.createDataFrame([(d,) for d in days], "day bigint")
              .select(S.month_of_day("day").alias("m")).distinct().collect()]
    daily = spark.read.schema(f"{entity}, points bigint, wus bigint, day bigint").parquet(f"{out}/{feed}_daily")
    lo = S.month_start_day(F.lit(min(months)).cast("bigint"))
    hi = S.month_start_day(F.lit(max(months) + 1).cast("bigint"))
    rows = daily.filter((F.col("day") >= lo) & (F.col("day") < hi))
    monthly = rollups.monthly(rows, keys).filter(F.col("month").isin(months))
    replace_partitions(monthly, f"{out}/{feed}_monthly", "month")


def ingest(spark: SparkSession, feed: str, source: str, out: str, checkpoint: str,
           files_per_batch: int | None = None, state: DataFrame | None = None,
           publish: Callable[[SparkSession, int], None] | None = None, max_rows: int | None = None) -> None:
    """Apply every snapshot file not applied yet, oldest first, then stop.

    A snapshot is one file, so that no micro-batch holds half a cycle.
    ``state`` (keys, ts, score, wus) are the totals a stream with a new checkpoint starts from;
    ``max_rows`` is the most rows a snapshot may have. ``publish(spark, newest_cycle)`` runs
    after a batch that brought a cycle, and only then.
    """
    _, schema = FEEDS[feed]
    stream = open_table_stream(spark, source, schema, files_per_batch)
    run_available(stream, f"{checkpoint}/{feed}", commit(feed, out, publish, state, max_rows), mode="append")


def rows_since(deltas: DataFrame, horizon_day: int) -> DataFrame:
    """Refuse cycles older than the raw horizon: recomputing a pruned day would shrink it."""
    return deltas.filter(S.day_index("ts") >= F.lit(horizon_day))
