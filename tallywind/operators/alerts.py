"""Alert rules replayed over a history of readings: each fires on a transition.

A rule's first reading is its seed and never fires. Windows run over one rule's readings,
one per cycle. The same expressions serve tables and streams: a stream hands each rule's last
reading on to the next batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywind.functions import scalars as S
from tallywind.operators.ranking import with_group_position
from tallywind.schemas import DAY, HOUR


def readings(kind: str, key: str, totals: DataFrame, delta: DataFrame, cycles: DataFrame) -> DataFrame:
    """Every entity's total, trailing day and rank at every real cycle since its first.

    ``totals`` (key, ts, score) has a row where a total changed; it holds until the next one.
    Cycles are numbered, so carrying a total forward is an equi-join on the number. ``delta``
    is (key, ts, d_score), ``cycles`` (ts), one row per cycle.
    """
    nr = cycles.select(F.col("ts").alias("cycle"), F.row_number().over(Window.orderBy("ts")).alias("nr"))
    last = F.lit(cycles.count())
    w = Window.partitionBy(key).orderBy("nr")
    held = totals.join(nr, F.col("ts") == F.col("cycle")).select(
        key, "nr", "score", F.first("ts").over(w).alias("first_seen"), F.coalesce(F.lead("nr").over(w) - 1, last).alias("until"))
    dense = held.select(key, "score", "first_seen", F.explode(F.sequence("nr", "until")).alias("nr")).join(
        nr, "nr").withColumnRenamed("cycle", "ts")
    moved = dense.join(delta.select(key, "ts", "d_score"), [key, "ts"], "left")
    day = Window.partitionBy(key).orderBy("ts").rangeBetween(-(DAY - 1), 0)
    rows = moved.select(
        F.lit(kind).alias("kind"), F.col(key).cast("string").alias("target"), "ts", "first_seen", F.col(key).alias("tied"),
        F.col("score").alias("points_total"), F.coalesce(F.sum("d_score").over(day), F.lit(0)).alias("points_last_24h"))
    ranked = with_group_position(rows, ["ts"], [F.col("points_total").desc(), F.col("first_seen").asc(), F.col("tied").asc()], "rank")
    return ranked.select("kind", "target", "ts", "points_total", "points_last_24h", F.col("rank").cast("bigint").alias("rank"))


def team_readings(team_snapshot: DataFrame, team_delta: DataFrame, cycles: DataFrame) -> DataFrame:
    return readings("team", "team_id", team_snapshot.select("team_id", F.col("snapshot_ts").alias("ts"), "score"), team_delta, cycles)


def donor_readings(member_snapshot: DataFrame, member_delta: DataFrame, cycles: DataFrame) -> DataFrame:
    """The same for donors, whose total is the sum of their memberships' totals."""
    own = Window.partitionBy("name", "team_id").orderBy("snapshot_ts")
    change = F.col("score") - F.coalesce(F.lag("score").over(own), F.lit(0))
    steps = (member_snapshot.select("name", F.col("snapshot_ts").alias("ts"), change.alias("d"))
             .groupBy("name", "ts").agg(F.sum("d").alias("d")))
    totals = steps.select("name", "ts", F.sum("d").over(Window.partitionBy("name").orderBy("ts")).alias("score"))
    delta = member_delta.groupBy("name", "ts").agg(F.sum("d_score").alias("d_score"))
    return readings("donor", "name", totals, delta, cycles)


RULES = {"milestone": 0, "rank": 3, "idle": 24, "resumed": 0, "daily": 0}


def rules_for(kind: str, first_seen: DataFrame, thresholds: dict[str, int] = RULES) -> DataFrame:
    """A rule of every type in ``thresholds`` per entity of ``first_seen`` (target, first_seen),
    created when the entity was first seen."""
    rule = F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(v).cast("bigint").alias("threshold"))
                               for t, v in thresholds.items()]))
    target = F.col("target").cast("string")
    return first_seen.select(target.alias("target"), F.col("first_seen").alias("created_ts"), rule.alias("r")).select(
        F.concat_ws("-", "r.type", "target").alias("id"), "r.type", F.lit(kind).alias("kind"),
        "target", "r.threshold", "created_ts")


#: What a rule carries from one batch of readings to the next: its last reading and what was
#: known then (best milestone, last producing instant, start of the quiet spell, what was told).
CARRY = ("id string, ts bigint, rank bigint, points_last_24h bigint, best bigint, last_producing bigint, "
         "quiet_since bigint, told_quiet int, told_today int")


def evaluate(rules: DataFrame, readings: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """(id, type, target, ts, value) of every firing."""
    return firings(walk(rules, readings, carry))


def walk(rules: DataFrame, readings: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """The readings of every rule with what the rule knew before each of them.

    ``carry`` (:data:`CARRY`) stands in front of a rule's readings as its reading number one;
    readings at or before it are late and left out.
    """
    rows = (rules.join(readings, ["kind", "target"]).filter("ts >= created_ts").filter(S.threshold_valid("type", "threshold"))
            .select("id", "type", "target", "threshold", "ts", F.col("rank").cast("bigint").alias("rank"), "points_last_24h",
                    S.milestone_at_or_below("points_total").alias("milestone")))
    nothing = {"last_producing": "bigint", "quiet_since": "bigint", "told_quiet": "int", "told_today": "int"}
    rows = rows.withColumns({f"c_{c}": F.lit(None).cast(t) for c, t in nothing.items()}).withColumn("carried", F.lit(False))
    if carry is not None:
        known = carry.withColumnsRenamed({c: f"c_{c}" for c in nothing}).withColumnRenamed("best", "milestone")
        after = known.select("id", F.col("ts").alias("c_ts"))
        rows = rows.join(after, "id", "left").filter("c_ts IS NULL OR ts > c_ts").drop("c_ts")
        front = known.join(rules.select("id", "type", "target", "threshold"), "id").withColumn("carried", F.lit(True))
        rows = rows.unionByName(front.select(*rows.columns))
    w = Window.partitionBy("id").orderBy("ts")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    quiet = F.col("points_last_24h") <= 0
    producing = F.coalesce("c_last_producing", F.when(~quiet, F.col("ts")))
    rows = rows.select(
        "*", quiet.alias("quiet"), F.row_number().over(w).alias("n"), F.max("milestone").over(past).alias("best"),
        F.lag("rank").over(w).alias("prev_rank"), F.lag("points_last_24h").over(w).alias("prev_24h"),
        # The last producing reading before this one opens the quiet spell.
        F.when(F.col("carried"), F.when(quiet, F.col("c_last_producing")))
        .otherwise(F.max(producing).over(past)).alias("last_producing"),
        S.day_index("ts").alias("day"), S.idiv(F.pmod("ts", F.lit(DAY)), F.lit(HOUR).cast("bigint")).alias("hour"))
    spell = Window.partitionBy("id", "last_producing", "quiet").orderBy("ts")
    rows = rows.withColumn("quiet_since", F.first(F.coalesce("c_quiet_since", "ts")).over(spell))
    long_quiet = (F.col("quiet") & F.col("last_producing").isNotNull()
                  & (F.col("ts") - F.col("quiet_since") >= F.col("threshold") * HOUR))
    due = (F.col("n") > 1) & (F.col("hour") >= F.col("threshold"))
    rows = rows.withColumn("long_quiet", F.coalesce(F.col("c_told_quiet"), long_quiet.cast("int"))).withColumn(
        "due", F.coalesce(F.col("c_told_today"), due.cast("int")))
    today = Window.partitionBy("id", "day").orderBy("ts")
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("told_quiet", F.coalesce(F.max("long_quiet").over(until(spell)), F.lit(0))).withColumn(
        "told_today", F.coalesce(F.max("due").over(until(today)), F.lit(0)))


def firings(rows: DataFrame) -> DataFrame:
    """Of readings as :func:`walk` gives them those that fire; a rule's first is its seed."""
    def when(kind: str, cond: Column) -> Column:
        return (F.col("type") == kind) & cond

    fires = (when("milestone", F.col("milestone") > F.col("best"))
             | when("rank", (F.col("rank") <= F.col("threshold")) & (F.col("prev_rank") > F.col("threshold")))
             | when("idle", (F.col("long_quiet") == 1) & (F.col("told_quiet") == 0))
             | when("resumed", (F.col("points_last_24h") > 0) & (F.col("prev_24h") == 0))
             | when("daily", (F.col("due") == 1) & (F.col("told_today") == 0)))
    value = (F.when(F.col("type") == "milestone", F.col("milestone"))
             .when(F.col("type") == "rank", F.col("rank"))
             .when(F.col("type") == "idle", F.col("ts") - F.col("quiet_since"))
             .otherwise(F.col("points_last_24h")))
    return rows.filter(fires & (F.col("n") > 1)).select("id", "type", "target", "ts", value.alias("value"))


def carried(rows: DataFrame) -> DataFrame:
    """What every rule of :func:`walk`'s readings carries on (:data:`CARRY`): its last reading."""
    w = Window.partitionBy("id").orderBy("ts")
    both = lambda a, b: F.greatest(F.col(a), F.col(b))
    last = rows.withColumn("more", F.lead("ts").over(w)).filter("more IS NULL")
    return last.select(
        "id", "ts", "rank", "points_last_24h", both("best", "milestone").alias("best"),
        F.when(F.col("quiet"), F.col("last_producing")).otherwise(F.col("ts")).alias("last_producing"),
        F.when(F.col("quiet"), F.col("quiet_since")).alias("quiet_since"),
        both("long_quiet", "told_quiet").alias("told_quiet"), both("due", "told_today").alias("told_today"))
