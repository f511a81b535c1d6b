"""Rolling, calendar and observed-span figures as of one cycle, and for every cycle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywind.functions import scalars as S
from tallywind.schemas import DAY, NANOS, WEEK


@dataclass(frozen=True)
class Clock:
    """The scalars of one published cycle. All instants are unix seconds, spans nanoseconds."""

    at: int
    first_cycle: int
    prev_at: int | None
    window_first: int
    window_cycles: int
    baseline: int | None
    cycles: int

    @property
    def day_start(self) -> int:
        return self.at - self.at % DAY

    @property
    def week_start(self) -> int:
        day = self.at // DAY
        return ((day - S.FIRST_SUNDAY) // 7 * 7 + S.FIRST_SUNDAY) * DAY

    @property
    def month_start(self) -> int:
        import datetime as dt
        d = dt.datetime.fromtimestamp(self.at, dt.timezone.utc)
        return int(dt.datetime(d.year, d.month, 1, tzinfo=dt.timezone.utc).timestamp())

    @property
    def covered_ns(self) -> int:
        """Period the retained cycles cover: one mean interval is added once the first cycle
        ever seen has aged out, because the oldest delta then reaches back past its cycle."""
        span = (self.at - self.window_first) * NANOS
        if self.window_first != self.first_cycle and self.window_cycles > 1:
            span += (self.at - self.window_first) * NANOS // (self.window_cycles - 1)
        return min(span, WEEK * NANOS)

    @property
    def span(self) -> int:
        return self.at - self.first_cycle


def cycles_of(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(F.col("snapshot_ts").alias("ts")).distinct()


def clock_frame(cycles: DataFrame, at: int | None = None) -> DataFrame:
    """One row of cycle scalars, as of the newest cycle or a given one."""
    upto = cycles if at is None else cycles.filter(F.col("ts") <= F.lit(at))
    newest = upto.agg(F.max("ts").alias("m")).select("m").scalar()
    c = upto.withColumn("at", newest)
    in_week = F.col("ts") > F.col("at") - WEEK
    return c.agg(
        F.max("at").alias("snapshot_ts"), F.min("ts").alias("first_cycle"),
        F.max(F.when(F.col("ts") < F.col("at"), F.col("ts"))).alias("prev_at"),
        F.min(F.when(in_week, F.col("ts"))).alias("window_first"),
        F.count_if(in_week).alias("window_cycles"),
        F.max(F.when(in_week & (F.col("ts") <= F.col("at") - DAY), F.col("ts"))).alias("baseline"),
        F.count(F.lit(1)).alias("cycles"))


def read_clock(cycles: DataFrame, at: int | None = None) -> Clock:
    """Fetch the one clock row, so that later filters carry literals and prune scans."""
    r = clock_frame(cycles, at).first()
    return Clock(r["snapshot_ts"], r["first_cycle"], r["prev_at"], r["window_first"],
                 r["window_cycles"], r["baseline"], r["cycles"])


def observed_ns(first_seen: Column, clock: Clock) -> Column:
    """How long an entity has been watched inside the week ending at the clock."""
    seen = (F.lit(clock.at) - first_seen) * F.lit(NANOS)
    return (F.when(first_seen <= F.lit(clock.window_first), F.lit(clock.covered_ns))
            .when(first_seen <= F.lit(clock.at), seen).otherwise(F.lit(0)).cast("bigint"))


def _sum_if(cond: Column, col: str, out: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0)).cast("bigint").alias(out)


WINDOW_COLUMNS = ["points_last_cycle", "points_last_24h", "points_last_7d", "points_today_utc",
                  "points_this_week_utc", "points_this_month_utc"]


def window_sums(delta: DataFrame, keys: list[str], clock: Clock) -> DataFrame:
    """All trailing and calendar sums in one pass over the deltas that can matter.

    The lower bound is a literal, so it prunes row groups of a delta table sorted by time.
    """
    oldest = min(clock.at - WEEK + 1, clock.month_start, clock.week_start)
    ts = F.col("ts")
    return delta.filter((ts >= F.lit(oldest)) & (ts <= F.lit(clock.at))).groupBy(*keys).agg(
        _sum_if(ts == F.lit(clock.at), "d_score", "points_last_cycle"),
        _sum_if(ts > F.lit(clock.at - DAY), "d_score", "points_last_24h"),
        _sum_if(ts > F.lit(clock.at - WEEK), "d_score", "points_last_7d"),
        _sum_if(ts >= F.lit(clock.day_start), "d_score", "points_today_utc"),
        _sum_if(ts >= F.lit(clock.week_start), "d_score", "points_this_week_utc"),
        _sum_if(ts >= F.lit(clock.month_start), "d_score", "points_this_month_utc"))


def rates(points_7d: Column, points_24h: Column, observed: Column) -> tuple[Column, Column]:
    day = F.least(observed, F.lit(DAY * NANOS))
    return S.per_day(points_7d, observed), S.per_day(points_24h, day)


def production(state: DataFrame, delta: DataFrame, keys: list[str], clock: Clock) -> DataFrame:
    """State with every production measure; an entity that did not move has zeros."""
    sums = window_sums(delta, keys, clock)
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in WINDOW_COLUMNS]
    rest = [c for c in state.columns if c not in keys]
    out = state.join(sums, keys, "left").select(*keys, *rest, *zero)
    out = out.withColumn("observed_ns", observed_ns(F.col("first_seen"), clock))
    week, day = rates(F.col("points_last_7d"), F.col("points_last_24h"), F.col("observed_ns"))
    return out.select("*", week.alias("points_per_day_7d_avg"), day.alias("points_per_day_24h_avg"),
                      S.points_per_wu("score", "wus").alias("points_per_wu"))


def rolling(delta: DataFrame, keys: list[str], span: int, out: str) -> DataFrame:
    """Trailing sum over (ts - span, ts] at each of an entity's deltas."""
    w = (Window.partitionBy(*keys).orderBy("ts").rangeBetween(-(span - 1), 0))
    return delta.select(*keys, "ts", F.sum("d_score").over(w).alias(out))


# --- over a timeline that no key splits -----------------------------------------------

def trailing_counts(seconds: DataFrame, span: int = 60, tile: int = 3600) -> DataFrame:
    """Events in (t - span, t] for every second that has one, and that count per second.

    ``seconds`` holds one BIGINT column ``sec``. Counting by second combines map-side.
    """
    return trailing_sums(seconds.groupBy("sec").agg(F.count(F.lit(1)).alias("n")), span, tile)


def trailing_sums(counted: DataFrame, span: int = 60, tile: int = 3600) -> DataFrame:
    """The same from counts per second (sec, n).

    The timeline is cut into tiles, each carrying a copy of the ``span - 1`` seconds before
    it, so tiles are independent tasks of at most ``tile + span`` rows.
    """
    own = S.floor_div("sec", tile)
    reach = S.floor_div(F.col("sec") + F.lit(span - 1), tile)
    tiled = counted.withColumn("tile", F.explode(F.sequence(own, reach)))
    w = Window.partitionBy("tile").orderBy("sec").rangeBetween(-(span - 1), 0)
    return (tiled.withColumn("events_in_window", F.sum("n").over(w))
            .filter(F.col("tile") == own)
            .select("sec", "events_in_window",
                    (F.col("events_in_window").cast("double") / F.lit(float(span))).alias("per_second")))


def carry_last(points: DataFrame, value: str, tile: int = DAY) -> DataFrame:
    """Last non-null ``value`` at or before each row of a (ts, kind, value) timeline.

    ``value`` must not decrease over time, as an instant carried forward does not.

    Rows see the values of their own tile; a tile's opening value comes from one summary row
    per tile, so the only un-partitioned window runs over the list of days.
    """
    t = points.withColumn("tile", S.floor_div("ts", tile))
    order = Window.partitionBy("tile").orderBy("ts", "kind")
    inside = F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ends = t.filter(F.col(value).isNotNull()).groupBy("tile").agg(F.max(value).alias("__end"))
    tiles = t.select("tile").distinct().join(ends, "tile", "left")
    before = Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    opening = tiles.select("tile", F.max("__end").over(before).alias("__open"))
    return (t.withColumn("__in", inside).join(opening, "tile")
            .withColumn(value, F.coalesce("__in", "__open")).drop("tile", "__in", "__open"))
