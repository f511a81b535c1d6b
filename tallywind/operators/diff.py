"""Differencing cumulative snapshots, identity, validation and reconciliation.

Every per-entity window here is partitioned by the entity: after duplicates are summed an
entity has at most one row per cycle, so a partition is bounded by the number of cycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywind.operators.ranking import with_position

MEMBER = ["name", "team_id"]
TEAM = ["team_id"]


def sum_duplicates(snapshot: DataFrame, keys: list[str] = MEMBER) -> DataFrame:
    """Rows repeated within a snapshot are summed, never dropped."""
    return snapshot.groupBy(*keys, "snapshot_ts").agg(
        F.sum("score").alias("score"), F.sum("wus").alias("wus"))


def movements(snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Change against the last total the entity was seen with; absent cycles are skipped."""
    w = Window.partitionBy(*keys).orderBy("snapshot_ts")
    prev_s, prev_w = F.lag("score").over(w), F.lag("wus").over(w)
    return snapshot.select(
        *keys, F.col("snapshot_ts").alias("ts"), "score", "wus",
        prev_s.alias("prev_score"), prev_w.alias("prev_wus")).select(
        *keys, "ts", "score", "wus", "prev_score", "prev_wus",
        (F.col("score") - F.coalesce("prev_score", F.lit(0))).alias("d_score"),
        (F.col("wus") - F.coalesce("prev_wus", F.lit(0))).alias("d_wu"))


def is_delta():
    """First sightings, and returns from a zero total, are not production."""
    return (F.col("prev_score").isNotNull()
            & ((F.col("prev_score") != 0) | (F.col("prev_wus") != 0))
            & ((F.col("d_score") != 0) | (F.col("d_wu") != 0)))


def deltas(snapshot: DataFrame, keys: list[str] = MEMBER) -> DataFrame:
    return movements(snapshot, keys).filter(is_delta()).select(*keys, "ts", "d_score", "d_wu")


def latest_state(snapshot: DataFrame, keys: list[str] = MEMBER, name_col: str | None = None) -> DataFrame:
    """Last total of every entity and when it was first seen; the latest name wins."""
    # One fixed-width buffer per measure keeps this a hash aggregate; a struct would sort.
    last = [F.max_by(c, "snapshot_ts").alias(c) for c in ([name_col] if name_col else []) + ["score", "wus"]]
    names = [name_col] if name_col else []
    return snapshot.groupBy(*keys).agg(
        F.min("snapshot_ts").alias("first_seen"), F.max("snapshot_ts").alias("last_seen"), *last).select(
        *keys, *names, "first_seen", "last_seen", "score", "wus")


def first_sightings(snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """How many entities were first seen at each cycle."""
    first = snapshot.groupBy(*keys).agg(F.min("snapshot_ts").alias("ts"))
    return first.groupBy("ts").agg(F.count(F.lit(1)).alias("new_entities"))


def regressions(snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Totals that fell; the first sighting of a negative total counts as a fall from zero."""
    return movements(snapshot, keys).filter("d_score < 0").select(*keys, "ts", "d_score", "d_wu")


def regression_samples(regressed: DataFrame, keys: list[str], limit: int = 5) -> DataFrame:
    """The ``limit`` worst falls of each cycle beside the cycle's count.

    The sample is an aggregate over top-``limit`` heaps rather than a window over the cycle:
    a cycle can hold every entity at once.
    """
    per_cycle = regressed.groupBy("ts").agg(F.count(F.lit(1)).alias("regressions"))
    worst = Window.partitionBy("ts", "__salt").orderBy(F.col("d_score"), *keys)
    salted = regressed.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(64)))
    # Keeping the best of each salt first leaves at most 64 * limit rows per cycle.
    kept = salted.withColumn("__n", F.row_number().over(worst)).filter(F.col("__n") <= limit)
    final = Window.partitionBy("ts").orderBy(F.col("d_score"), *keys)
    top = kept.withColumn("sample_no", F.row_number().over(final)).filter(F.col("sample_no") <= limit)
    return top.drop("__salt", "__n").join(per_cycle, "ts")


def validate_totals(team: DataFrame, user: DataFrame) -> DataFrame:
    """Per snapshot: both measures of both feeds non-negative and summing inside BIGINT."""
    rows = team.select("snapshot_ts", F.lit("team").alias("feed"), "score", "wus").unionByName(
        user.select("snapshot_ts", F.lit("user").alias("feed"), "score", "wus"))
    agg = rows.groupBy("snapshot_ts", "feed").agg(
        F.try_sum("score").alias("score_total"), F.try_sum("wus").alias("wus_total"),
        F.min("score").alias("__min_s"), F.min("wus").alias("__min_w"))
    reason = (F.when((F.col("__min_s") < 0) | F.col("score_total").isNull(), "score")
              .when((F.col("__min_w") < 0) | F.col("wus_total").isNull(), "wus"))
    return agg.select("snapshot_ts", "feed", "score_total", "wus_total",
                      F.coalesce(reason, F.lit("ok")).alias("verdict"))


def over_row_limit(snapshot: DataFrame, limit: int) -> DataFrame:
    return snapshot.groupBy("snapshot_ts").agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "accepted", F.col("row_count") <= F.lit(limit))


def reconcile(team: DataFrame, member: DataFrame, threshold: int) -> DataFrame:
    """Teams whose member rows claim more than the team feed grants, per snapshot.

    A team the team feed does not know is held against zero.
    """
    granted = team.groupBy("snapshot_ts", "team_id").agg(F.sum("score").alias("granted"))
    claimed = member.groupBy("snapshot_ts", "team_id").agg(
        F.sum("score").alias("claimed"), F.count(F.lit(1)).alias("member_rows"))
    excess = F.col("claimed") - F.coalesce("granted", F.lit(0))
    return (claimed.join(granted, ["snapshot_ts", "team_id"], "left")
            .withColumn("excess", excess).filter(F.col("excess") > F.lit(threshold))
            .select("snapshot_ts", "team_id", "excess", "member_rows"))


def drop_over_claims(member: DataFrame, excess: DataFrame) -> DataFrame:
    """Remove an over-claiming team's member rows for that cycle only."""
    return member.join(excess.select("snapshot_ts", "team_id"), ["snapshot_ts", "team_id"], "left_anti")


def feed_checksum(team: DataFrame, member: DataFrame) -> DataFrame:
    """Per snapshot: how many teams' members add up exactly, under or over."""
    granted = team.groupBy("snapshot_ts", "team_id").agg(F.sum("score").alias("granted"))
    claimed = member.groupBy("snapshot_ts", "team_id").agg(F.sum("score").alias("claimed"))
    both = granted.join(claimed, ["snapshot_ts", "team_id"])
    return both.groupBy("snapshot_ts").agg(
        F.count_if(F.col("claimed") == F.col("granted")).alias("exact"),
        F.count_if(F.col("claimed") < F.col("granted")).alias("under"),
        F.count_if(F.col("claimed") > F.col("granted")).alias("over_claimed"),
        F.max(F.greatest(F.col("claimed") - F.col("granted"), F.lit(0))).alias("max_over"))


def ordinals(state: DataFrame, keys: list[str]) -> DataFrame:
    """First-seen order, starting at 0; never reused as later cycles only append."""
    pos = with_position(state.select(*keys, "first_seen"),
                        [F.col("first_seen"), *[F.col(k) for k in keys]], "__pos")
    return pos.select(*keys, "first_seen", (F.col("__pos") - 1).alias("ordinal"))


def extend_ordinals(known: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Number entities not yet in ``known`` after the highest ordinal given out so far."""
    top = known.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("m")).first()["m"]
    fresh = ordinals(seen.join(known.select(*keys), keys, "left_anti"), keys)
    return known.unionByName(fresh.withColumn("ordinal", F.col("ordinal") + F.lit(top + 1)))


def pending_cycles(pairs: DataFrame, cycle_log: DataFrame) -> DataFrame:
    """Cycles not applied yet; replaying an applied one is a no-op."""
    return pairs.join(cycle_log.select("ts"), "ts", "left_anti")


def cycle_audit(team: DataFrame, member: DataFrame) -> DataFrame:
    """One row per cycle: rows read, new entities, deltas and regressions."""
    def side(snapshot: DataFrame, keys: list[str], raw: DataFrame, label: str) -> DataFrame:
        moved = movements(snapshot, keys).groupBy("ts").agg(
            F.count_if(F.col("prev_score").isNull()).alias(f"new_{label}s"),
            F.count_if(is_delta()).alias(f"{label}_deltas"),
            F.count_if(F.col("d_score") < 0).alias(f"{label}_regressions"))
        rows = raw.groupBy(F.col("snapshot_ts").alias("ts")).agg(
            F.count(F.lit(1)).alias(f"{label}_rows"))
        return rows.join(moved, "ts")

    t = side(sum_duplicates(team, TEAM), TEAM, team, "team")
    m = side(sum_duplicates(member, MEMBER), MEMBER, member, "member")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return m.join(t, "ts", "left").select(
        "ts", zero("team_rows"), F.col("member_rows").alias("user_rows"),
        "new_members", zero("new_teams"), "member_deltas", zero("team_deltas"),
        (F.col("member_regressions") + F.coalesce("team_regressions", F.lit(0))).alias("regressions"))
