"""Exact nearest-rank percentiles and fixed-width histogram quantiles per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywind.functions.scalars import idiv
from tallywind.operators.ranking import with_group_position


def nearest_rank(df: DataFrame, key: str, value: str, tie: str, percents=(50, 90, 99)) -> DataFrame:
    """``sorted[n * p / 100]`` of each key's values, with count and maximum.

    Positions come from the range-partitioned ranking, so a key with most of the rows is
    sorted by many tasks; only the wanted positions are then kept.
    """
    pos = with_group_position(df.select(key, value, tie), [key], [F.col(value), F.col(tie)], "__p")
    total = pos.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("max_value"))
    rows = pos.join(total, key)
    picks = [F.least(idiv(F.col("n") * F.lit(p), F.lit(100).cast("bigint")), F.col("n") - 1) + 1
             for p in percents]
    cols = [F.max(F.when(F.col("__p") == pick, F.col(value))).alias(f"p{p}")
            for p, pick in zip(percents, picks)]
    return rows.groupBy(key).agg(F.first("n").alias("n"), *cols, F.first("max_value").alias("max_value"))


def histogram(df: DataFrame, key: str, value: str, width: float, buckets: int,
              quantiles=(0.5, 0.9, 0.99)) -> DataFrame:
    """Upper edge of the first bucket that reaches ceil(q * n); the last bucket is overflow.

    Counting per bucket combines map-side and leaves at most ``buckets + 1`` rows per key.
    """
    b = F.least(F.floor(F.col(value) / F.lit(width)), F.lit(buckets)).cast("bigint")
    counts = df.groupBy(key, b.alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key).orderBy("bucket")
    cum = counts.withColumn("cum", F.sum("c").over(w)).withColumn(
        "n", F.sum("c").over(Window.partitionBy(key)))
    edge = (F.col("bucket") + 1).cast("double") * F.lit(width)
    cols = [F.min(F.when(F.col("cum") >= F.ceil(F.lit(q) * F.col("n")), edge)).alias(f"q{int(q * 100)}")
            for q in quantiles]
    return cum.groupBy(key).agg(F.max("n").alias("n"), *cols)
