"""Streaks, recent ratio, standings, per-day windows and production records.

Windows here run over one entity's days, so a partition is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywind.functions import scalars as S
from tallywind.operators import ranking as R
from tallywind.operators.windows import Clock
from tallywind.schemas import DAY, HOUR, NANOS, WEEK

RECENT_DAYS = 30
GRID_DAYS = 365


def producing_days(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Days with production; several rows of a key on one day are one day."""
    return daily.filter("points > 0").groupBy(*keys, "day").agg(
        F.sum("points").alias("points"), F.sum("wus").alias("wus"))


def streaks(entities: DataFrame, days: DataFrame, keys: list[str], clock: Clock) -> DataFrame:
    """Current, longest and total active days. The current run must reach today or
    yesterday; one that reaches the first day on record is only a lower bound."""
    today, floor = clock.at // DAY, clock.first_cycle // DAY
    w = Window.partitionBy(*keys).orderBy("day")
    island = days.select(*keys, "day", (F.col("day") - F.row_number().over(w)).alias("island"))
    runs = island.groupBy(*keys, "island").agg(
        F.min("day").alias("start"), F.max("day").alias("stop"), F.count(F.lit(1)).alias("len"))
    live = F.col("stop") >= F.lit(today - 1)
    s = runs.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(live, F.col("len"))), F.lit(0)).alias("current_days"),
        F.max("len").alias("longest_days"), F.sum("len").alias("active_days"),
        F.max(F.when(live, F.col("start"))).alias("since_day"))
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("current_days", "longest_days", "active_days")]
    return entities.select(*keys).join(s, keys, "left").select(
        *keys, *zero, "since_day",
        F.coalesce(F.col("since_day") <= F.lit(floor), F.lit(False)).alias("at_collection_floor"))


def recent_ratio(days: DataFrame, keys: list[str], clock: Clock, window: int = RECENT_DAYS) -> DataFrame:
    """Points per work unit over the last month of the record; none without work units."""
    today, floor = clock.at // DAY, clock.first_cycle // DAY
    first = max(today - window + 1, floor)
    r = days.filter(F.col("day") >= F.lit(first)).groupBy(*keys).agg(
        F.sum("points").alias("recent_points"), F.sum("wus").alias("recent_wus"))
    return r.filter("recent_wus > 0").select(
        *keys, F.lit(today - first + 1).cast("bigint").alias("recent_days"), "recent_points", "recent_wus",
        S.points_per_wu("recent_points", "recent_wus").alias("recent_points_per_wu"))


def competition_rank(df: DataFrame, value: str, tie: list[Column], out: str) -> DataFrame:
    """1 + how many rows are strictly ahead, from a distributed position."""
    pos = R.with_position(df, [F.col(value).desc(), *tie], "__p")
    first = pos.groupBy(value).agg(F.min("__p").alias(out))
    return pos.join(first, value).drop("__p")


def standings(mart: DataFrame, keys: list[str]) -> DataFrame:
    """Top-percent by lifetime rank and among those that produced this month."""
    field = mart.agg(F.count(F.lit(1))).scalar()
    month = mart.filter("points_this_month_utc > 0").select(*keys, "points_this_month_utc")
    month_field = month.agg(F.count(F.lit(1))).scalar()
    placed = competition_rank(month, "points_this_month_utc", [F.col(k) for k in keys], "place")
    placed = placed.select(*keys, S.top_percent("place", month_field).alias("month_top_percent"),
                           month_field.alias("month_of"))
    return mart.select(*keys, "rank").join(placed, keys, "left").select(
        *keys, S.top_percent("rank", field).alias("lifetime_top_percent"), field.alias("lifetime_of"),
        "month_top_percent", "month_of")


def per_day_windows(mart: DataFrame, keys: list[str], recent: DataFrame, slack_sec: int) -> DataFrame:
    """The daily rate over 24 h, 7 d and 30 d, each with the span it really covers."""
    slack = slack_sec if 0 < slack_sec <= HOUR else HOUR

    def win(name: str, nominal: int, points: str) -> Column:
        span = F.least(F.col("observed_ns"), F.lit(nominal * NANOS))
        return F.struct(F.lit(name).alias("period"), S.per_day(points, span).alias("points_per_day"),
                        S.idiv(span, F.lit(NANOS).cast("bigint")).alias("covers_sec"),
                        (span < F.lit((nominal - slack) * NANOS)).alias("partial"))

    days = F.col("recent_days")
    month = F.when(days > 0, F.struct(
        F.lit("30d").alias("period"),
        S.per_day("recent_points", days * F.lit(DAY * NANOS)).alias("points_per_day"),
        (days * DAY).alias("covers_sec"), (days < RECENT_DAYS).alias("partial")))
    rows = mart.select(*keys, "observed_ns", "points_last_24h", "points_last_7d").join(recent, keys, "left")
    items = F.array(win("24h", DAY, "points_last_24h"), win("7d", WEEK, "points_last_7d"), month)
    return rows.select(*keys, F.explode(F.filter(items, lambda x: x.isNotNull())).alias("w")).select(
        *keys, "w.period", "w.points_per_day", "w.covers_sec", "w.partial")


def production_records(daily: DataFrame, keys: list[str], clock: Clock) -> DataFrame:
    """Best day, best trailing seven days and active days; the earliest wins a tie.

    Trailing sums only rise when a day enters and, after a correction, when one leaves, so
    each day and the day a week later are the only candidates.
    """
    today = clock.at // DAY
    zero = F.lit(0).cast("bigint")
    leave = daily.select(*keys, (F.col("day") + 7).alias("day"), zero.alias("points"))
    cand = daily.select(*keys, "day", "points").unionByName(leave.filter(F.col("day") <= F.lit(today)))
    cand = cand.groupBy(*keys, "day").agg(F.sum("points").alias("points"))
    w = Window.partitionBy(*keys).orderBy("day").rangeBetween(-6, 0)
    runs = cand.select(*keys, "day", F.sum("points").over(w).alias("run"))
    best7 = runs.groupBy(*keys).agg(F.max(F.struct(F.col("run"), (-F.col("day")).alias("d"))).alias("b"))
    best = daily.groupBy(*keys).agg(
        F.max(F.struct(F.col("points"), (-F.col("day")).alias("d"))).alias("a"),
        F.count(F.lit(1)).alias("active_days"), F.min("day").alias("__first"))
    some = F.col("b.run") > 0
    return best.join(best7, keys).select(
        *keys, F.col("a.points").alias("best_day_points"), (-F.col("a.d")).alias("best_day"),
        F.when(some, F.col("b.run")).otherwise(zero).alias("best_7d_points"),
        F.when(some, -F.col("b.d")).otherwise(F.col("__first")).alias("best_7d_end"), "active_days")


def heatmap(daily: DataFrame, keys: list[str], clock: Clock) -> DataFrame:
    """A year of days per entity as whole Sunday-start weeks, with a heat level per day."""
    newest = clock.at // DAY
    year = daily.filter((F.col("day") >= F.lit(newest - GRID_DAYS + 1)) & (F.col("day") <= F.lit(newest)))
    last_cell = newest + 6 - (newest - S.FIRST_SUNDAY) % 7
    span = year.groupBy(*keys).agg(F.min("day").alias("oldest"), F.max("points").alias("peak"))
    first_cell = S.week_start_day(S.week_of_day("oldest"))
    grid = span.select(*keys, "oldest", "peak",
                       F.explode(F.sequence(first_cell, F.lit(last_cell).cast("bigint"))).alias("day"))
    cells = grid.join(year.select(*keys, "day", "points", "wus"), [*keys, "day"], "left")
    pts = F.coalesce(F.col("points"), F.lit(0)).cast("bigint")
    return cells.select(
        *keys, "day", pts.alias("points"), F.coalesce("wus", F.lit(0)).cast("bigint").alias("wus"),
        S.heat_level(pts, F.col("peak")).alias("level"),
        ((F.col("day") < F.col("oldest")) | (F.col("day") > F.lit(newest))).alias("outside"))
