"""Alert rules fired from what changed, without a reading per entity and cycle.

An entity's figures hold from one event to the next: a new total, points of a delta entering the
trailing day, and the same points leaving it at the first cycle a day later. Those are at most
three rows per delta, however many cycles pass. Rules are walked over these rows only:

* milestones and resumed production are transitions between neighbouring rows;
* an idle spell fires at the first cycle a threshold after it began, if it lasts that long;
* a daily report is read at the day's first due cycle, i.e. as often as it is told;
* a rank rule needs the first k of every cycle. Per month, entities whose best total stays behind
  the k-th worst-case total cannot be among them; only the others are laid out by cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywind.functions import scalars as S
from tallywind.schemas import DAY, HOUR
from tallywind.session import materialize

#: Seconds of a tile in which entities out of contention are left aside.
TILE = 30 * DAY


def calendar(cycles: DataFrame) -> DataFrame:
    """(day, times, following): the cycles of every day of the record, in order, and the first
    cycle of a later day. One row per day."""
    days = cycles.groupBy(S.day_index("ts").alias("day")).agg(F.sort_array(F.collect_list("ts")).alias("times"))
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("z")).filter("a IS NOT NULL").select(F.explode(F.sequence("a", "z")).alias("day"))
    later = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    times = F.coalesce("times", F.array().cast("array<bigint>"))
    return span.join(days, "day", "left").select("day", times.alias("times"), F.min(F.get(times, 0)).over(later).alias("following"))


def next_cycle(rows: DataFrame, at: Column, days: DataFrame, out: str) -> DataFrame:
    """Add the first cycle at or after ``at``, null if the record ends before."""
    found = rows.withColumn("__at", at).withColumn("day", S.day_index("__at")).join(days, "day", "left")
    here = F.get(F.filter("times", lambda t: t >= F.col("__at")), 0)
    first = F.coalesce(here, F.col("following"))
    return found.withColumn(out, first).drop("__at", "day", "times", "following")


def changes(key: str, totals: DataFrame, delta: DataFrame, cycles: DataFrame) -> DataFrame:
    """(target, key, ts, until, first_seen, points_total, points_last_24h): an entity's figures
    from ``ts`` up to the cycle before ``until`` (null: to the newest).

    ``totals`` is (key, ts, score), ``delta`` (key, ts, d_score), ``cycles`` (ts).
    """
    days = calendar(cycles)
    moved = delta.select(key, "ts", F.col("d_score").alias("d"))
    left = next_cycle(moved, F.col("ts") + DAY, days, "gone").filter("gone IS NOT NULL").select(key, F.col("gone").alias("ts"), (-F.col("d")).alias("d"))
    score = F.lit(None).cast("bigint").alias("score")
    rows = (totals.select(key, "ts", "score", F.lit(0).cast("bigint").alias("d"))
            .unionByName(moved.select(key, "ts", score, "d")).unionByName(left.select(key, "ts", score, "d")))
    at = rows.groupBy(key, "ts").agg(F.max("score").alias("score"), F.sum("d").alias("d"))
    w = Window.partitionBy(key).orderBy("ts")
    past = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return at.select(
        F.col(key).cast("string").alias("target"), F.col(key).alias("key"), "ts", F.lead("ts").over(w).alias("until"),
        F.first("ts").over(w).alias("first_seen"), F.last("score", ignorenulls=True).over(past).alias("points_total"),
        F.sum("d").over(past).cast("bigint").alias("points_last_24h"))


def team_changes(team_snapshot: DataFrame, team_delta: DataFrame, cycles: DataFrame) -> DataFrame:
    return changes("team_id", team_snapshot.select("team_id", F.col("snapshot_ts").alias("ts"), "score"), team_delta, cycles)


def donor_changes(member_snapshot: DataFrame, member_delta: DataFrame, cycles: DataFrame) -> DataFrame:
    """The same for donors, whose total is the sum of their memberships' totals."""
    own = Window.partitionBy("name", "team_id").orderBy("snapshot_ts")
    change = F.col("score") - F.coalesce(F.lag("score").over(own), F.lit(0))
    steps = (member_snapshot.select("name", F.col("snapshot_ts").alias("ts"), change.alias("d"))
             .groupBy("name", "ts").agg(F.sum("d").alias("d")))
    totals = steps.select("name", "ts", F.sum("d").over(Window.partitionBy("name").orderBy("ts")).alias("score"))
    return changes("name", totals, member_delta.groupBy("name", "ts").agg(F.sum("d_score").alias("d_score")), cycles)


def leaders(changed: DataFrame, cycles: DataFrame, k: int) -> DataFrame:
    """(nr, ts, target, rank) of the first ``k`` of every cycle; nr counts the cycles."""
    numbered = materialize(cycles.select(F.col("ts").alias("cycle"), F.row_number().over(Window.orderBy("ts")).cast("bigint").alias("nr"),
                                         S.floor_div("ts", TILE).alias("tile")), "numbered-cycles")
    tiles = numbered.groupBy("tile").agg(F.min("nr").alias("from_nr"), F.max("nr").alias("to_nr"))
    newest = numbered.agg(F.max("nr")).first()[0] or 0
    entity = Window.partitionBy("key").orderBy("nr")
    held = (changed.join(numbered, F.col("ts") == F.col("cycle")).select("key", "target", "first_seen", "points_total", "nr", "tile")
            .withColumn("last_nr", F.coalesce(F.lead("nr").over(entity) - 1, F.lit(newest)))
            .withColumn("last_tile", F.coalesce(F.lead("tile").over(entity), F.lit(numbered.agg(F.max("tile")).first()[0]).cast("bigint"))))
    spread = held.withColumn("tile", F.explode(F.sequence("tile", "last_tile"))).drop("last_tile").join(tiles, "tile")
    spread = spread.withColumn("a", F.greatest("nr", "from_nr")).withColumn("z", F.least("last_nr", "to_nr")).filter("a <= z")
    spread = materialize(spread.select("tile", "key", "target", "first_seen", "points_total", "a", "z", "from_nr"), "held-by-tile")
    band = spread.groupBy("tile", "key", "first_seen").agg(F.min("points_total").alias("lo"), F.max("points_total").alias("hi"),
                                                           (F.min("a") == F.min("from_nr")).alias("whole"))
    place = F.row_number().over(Window.partitionBy("tile").orderBy(F.desc("lo"), "first_seen", "key"))
    bound = (band.filter("whole").withColumn("place", place).filter(F.col("place") <= k).filter(F.col("place") == k)
             .select("tile", F.col("lo").alias("b_lo"), F.col("first_seen").alias("b_seen"), F.col("key").alias("b_key")))
    ahead = (F.col("b_lo").isNull() | (F.col("hi") > F.col("b_lo")) | ((F.col("hi") == F.col("b_lo")) & (
        (F.col("first_seen") < F.col("b_seen")) | ((F.col("first_seen") == F.col("b_seen")) & (F.col("key") <= F.col("b_key"))))))
    contend = band.join(bound, "tile", "left").filter(ahead).select("tile", "key")
    at = spread.join(contend, ["tile", "key"], "left_semi").select(
        "key", "target", "first_seen", "points_total", F.explode(F.sequence("a", "z")).alias("nr"))
    rank = F.row_number().over(Window.partitionBy("nr").orderBy(F.desc("points_total"), "first_seen", "key"))
    return (at.withColumn("rank", rank).filter(F.col("rank") <= k).join(numbered.select("nr", F.col("cycle").alias("ts")), "nr")
            .select("nr", "ts", "target", F.col("rank").cast("bigint").alias("rank")))


def evaluate(rules: DataFrame, changed: DataFrame, cycles: DataFrame) -> DataFrame:
    """(id, type, target, ts, value) of every firing of ``rules`` (as :func:`alerts.rules_for`
    gives them, of one kind) over ``changed``. A rule's first cycle is its seed and never fires."""
    days = materialize(calendar(cycles), "calendar")
    rules = rules.filter(S.threshold_valid("type", "threshold"))
    types = {r["type"]: r["most"] for r in rules.groupBy("type").agg(F.max("threshold").alias("most")).collect()}  # five at most
    seen = changed.groupBy("target").agg(F.min("first_seen").alias("first_seen"))
    begun = next_cycle(rules.join(seen, "target"), F.greatest("created_ts", "first_seen"), days, "start").filter("start IS NOT NULL")

    def walked(kind: str) -> DataFrame:
        """The rows of ``changed`` a rule of this type sees, the first clipped to its start."""
        own = begun.filter(F.col("type") == kind).select("id", "type", "target", "threshold", "start")
        rows = own.join(changed.select("target", "ts", "until", "points_total", "points_last_24h"), "target")
        return rows.filter("until IS NULL OR until > start").withColumn("ts", F.greatest("ts", "start"))

    w = Window.partitionBy("id").orderBy("ts")
    columns = ["id", "type", "target", "ts", "value"]

    def milestone() -> DataFrame:
        rows = walked("milestone").withColumn("value", S.milestone_at_or_below("points_total"))
        best = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("best", best).filter("value > best").select(columns)

    def resumed() -> DataFrame:
        rows = walked("resumed").withColumn("before", F.lag("points_last_24h").over(w))
        return rows.filter("points_last_24h > 0 AND before = 0").withColumn("value", F.col("points_last_24h")).select(columns)

    def idle() -> DataFrame:
        rows = walked("idle").withColumn("quiet", F.col("points_last_24h") <= 0)
        ends = F.min(F.when(~F.col("quiet"), F.col("ts"))).over(w.rowsBetween(1, Window.unboundedFollowing))
        spells = rows.withColumn("was_quiet", F.lag("quiet").over(w)).withColumn("ends", ends).filter("quiet AND NOT was_quiet")
        told = next_cycle(spells.withColumnRenamed("ts", "since"), F.col("since") + F.col("threshold") * HOUR, days, "ts")
        return told.filter("ts IS NOT NULL AND (ends IS NULL OR ts < ends)").withColumn("value", F.col("ts") - F.col("since")).select(columns)

    def daily() -> DataFrame:
        rows = walked("daily")
        last = F.coalesce(S.day_index(F.col("until") - 1), days.agg(F.max("day")).scalar())
        by_day = rows.withColumn("day", F.explode(F.sequence(S.day_index("ts"), last))).join(days.select("day", "times"), "day")
        due = F.get(F.filter("times", lambda t: (t >= F.col("day") * DAY + F.col("threshold") * HOUR) & (t > F.col("start"))), 0)
        told = by_day.withColumn("due", due).filter("due >= ts AND (until IS NULL OR due < until)")
        return told.withColumn("ts", F.col("due")).withColumn("value", F.col("points_last_24h")).select(columns)

    def rank() -> DataFrame:
        first = materialize(leaders(changed, cycles, int(types["rank"])), "leaders")
        own = begun.filter(F.col("type") == "rank").select("id", "type", "target", "threshold", "start")
        before = first.select(F.col("target").alias("of"), (F.col("nr") + 1).alias("then"), F.col("rank").alias("before"))
        rows = first.join(before, (F.col("target") == F.col("of")) & (F.col("nr") == F.col("then")), "left").drop("of", "then")
        fired = own.join(rows, "target").filter("ts > start AND rank <= threshold AND (before IS NULL OR before > threshold)")
        return fired.withColumn("value", F.col("rank")).select(columns)

    out = None
    for kind, make in {"milestone": milestone, "resumed": resumed, "idle": idle, "daily": daily, "rank": rank}.items():
        if kind in types:
            part = make().withColumn("value", F.col("value").cast("bigint"))
            out = part if out is None else out.unionByName(part)
    return out if out is not None else begun.select("id", "type", "target", F.col("start").alias("ts"), F.lit(0).cast("bigint").alias("value")).filter("false")
