"""Differencing of snapshot streams against a table of latest totals.

A micro-batch is differenced inside itself by ``lag``; what an entity's first row needs comes
from the latest-totals table by one left join on the entity's keys. Only the totals a batch
changed are written, as a partition of that batch; from time to time the table is folded. So
everything runs in the JVM, entities need no state store, and the table is at once what a new
stream starts from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywind.session import list_partitions, path_exists
from tallywind.sources.archive import delete_partitions
from tallywind.sources.sinks import replace_partitions

#: Batches after which the totals they changed are folded into one table.
FOLD_AFTER = 16


def entity_schema(snapshots: DataFrame, keys: list[str]) -> str:
    types = dict(snapshots.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in keys)


class LatestTotals:
    """Totals (keys, ts, score, wus) by entity under ``path``, as of the batches before one.

    ``changed/batch=n`` holds what batch n changed, ``folded/batch=n`` everything up to n.
    Reading for batch n ignores what an earlier try of n or a later batch wrote.
    """

    def __init__(self, spark: SparkSession, path: str, entity: str, keys: list[str], seed: DataFrame | None = None):
        self.spark, self.path, self.keys, self.seed = spark, path, keys, seed
        self.schema = f"{entity}, ts bigint, score bigint, wus bigint, batch bigint"

    def _read(self, part: str) -> DataFrame | None:
        path = f"{self.path}/{part}"
        return self.spark.read.schema(self.schema).parquet(path) if path_exists(self.spark, path) else None

    def before(self, batch_id: int) -> DataFrame | None:
        folds = [b for b in list_partitions(self.spark, f"{self.path}/folded", "batch") if b < batch_id]
        last = max(folds, default=-1)
        parts = []
        if folds:
            parts.append(self._read("folded").filter(F.col("batch") == last))
        elif self.seed is not None:
            parts.append(self.seed.select(*self.keys, "ts", "score", "wus").withColumn("batch", F.lit(-1).cast("bigint")))
        changed = self._read("changed")
        if changed is not None:
            parts.append(changed.filter((F.col("batch") > last) & (F.col("batch") < batch_id)))
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.groupBy(*self.keys).agg(F.max("ts").alias("ts"), F.max_by("score", "ts").alias("score"),
                                            F.max_by("wus", "ts").alias("wus"))

    def write(self, moves: DataFrame, batch_id: int) -> None:
        newest = moves.groupBy(*self.keys).agg(F.max_by("score", "ts").alias("score"), F.max_by("wus", "ts").alias("wus"),
                                               F.max("ts").alias("ts"))
        replace_partitions(newest.withColumn("batch", F.lit(batch_id)), f"{self.path}/changed", "batch")
        folds = [b for b in list_partitions(self.spark, f"{self.path}/folded", "batch") if b < batch_id]
        done = max(folds, default=-1)
        # This batch runs, so the ones before it are committed: what they folded can go.
        if folds:
            delete_partitions(self.spark, f"{self.path}/changed", "batch", lambda v: int(v) > done)
            delete_partitions(self.spark, f"{self.path}/folded", "batch", lambda v: int(v) >= done)
        if batch_id - done >= FOLD_AFTER:
            replace_partitions(self.before(batch_id + 1).withColumn("batch", F.lit(batch_id)), f"{self.path}/folded", "batch")


def difference(rows: DataFrame, keys: list[str], totals: DataFrame | None, applied: int | None) -> DataFrame:
    """Every row of a batch of snapshots with its change since the entity's last total.

    Cycles at or before ``applied``, the newest cycle applied earlier, are late or repeated and
    ignored whole, also for entities that were absent since.
    """
    if applied is not None:
        rows = rows.filter(F.col("snapshot_ts") > F.lit(applied))
    own = rows.groupBy(*keys, F.col("snapshot_ts").alias("ts")).agg(F.sum("score").alias("score"), F.sum("wus").alias("wus"))
    w = Window.partitionBy(*keys).orderBy("ts")
    own = own.withColumn("p_score", F.lag("score").over(w)).withColumn("p_wus", F.lag("wus").over(w))
    if totals is not None:
        held = totals.select(*keys, F.col("score").alias("h_score"), F.col("wus").alias("h_wus"))
        own = own.join(held, keys, "left").withColumn("p_score", F.coalesce("p_score", "h_score")).withColumn(
            "p_wus", F.coalesce("p_wus", "h_wus"))
    had = F.col("p_score").isNotNull()
    zero = F.lit(0).cast("bigint")
    d_score, d_wu = (F.col(c) - F.coalesce(f"p_{c}", zero) for c in ("score", "wus"))
    moved = had & ((F.col("p_score") != 0) | (F.col("p_wus") != 0)) & ((d_score != 0) | (d_wu != 0))
    return own.select(*keys, "ts", "score", "wus", d_score.alias("d_score"), d_wu.alias("d_wu"),
                      (~had).alias("first_sighting"), moved.alias("is_delta"))


def deltas_of(movement: DataFrame, keys: list[str]) -> DataFrame:
    return movement.filter("is_delta").select(*keys, "ts", "d_score", "d_wu")


def seed_from(snapshot_state: DataFrame) -> DataFrame:
    """The latest totals of ``diff.latest_state`` as a stream's first totals."""
    return snapshot_state.withColumn("ts", F.col("last_seen"))
