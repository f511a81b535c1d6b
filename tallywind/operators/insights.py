"""Leaderboards, search, rivals, goals, movers, roster activity, changes, groups.

Subjects arrive as one-row scalar subqueries, so a lookup costs no join and Catalyst can
prune the other side by the subject's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywind.functions import scalars as S
from tallywind.operators import ranking as R
from tallywind.schemas import WEEK

# Ordering keys and the columns they rank by, and their aliases.
TEAM_KEYS = {
    "lifetime": "score", "per_day": "points_per_day_24h_avg", "today": "points_today_utc",
    "this_week": "points_this_week_utc", "this_month": "points_this_month_utc",
    "last_24h": "points_last_24h", "wus": "wus", "members": "members_total",
}
DONOR_KEYS = {**{k: v for k, v in TEAM_KEYS.items() if k != "members"}, "teams": "team_count"}
MEMBER_KEYS = {k: v for k, v in TEAM_KEYS.items() if k != "members"}
SORT_ALIASES = {
    "daily": "today", "weekly": "this_week", "monthly": "this_month",
    "points_total": "lifetime", "points_per_day_24h_avg": "per_day",
    "points_today_utc": "today", "points_this_week_utc": "this_week",
    "points_this_month_utc": "this_month", "points_last_24h": "last_24h",
    "wus_total": "wus", "members_total": "members", "team_count": "teams",
}
SURGE_RATIO = 1.5
GOAL_HORIZONS = (30, 90, 365)


def sort_key(key: str, columns: dict[str, str]) -> str:
    """Resolve an alias; a key the entity has no column for falls back to lifetime."""
    k = SORT_ALIASES.get(key, key)
    if k not in TEAM_KEYS and k not in DONOR_KEYS:
        raise ValueError(f"unknown sort {key}")
    return columns.get(k, columns["lifetime"])


def teams_by(teams: DataFrame, key: str) -> DataFrame:
    col = sort_key(key, TEAM_KEYS)
    pos = R.with_position(teams.select("team_id", "team_name", "first_seen", "rank", F.col(col).alias("value")),
                          [F.col("value").desc(), F.col("first_seen"), F.col("team_id")])
    return pos.select("position", "team_id", "team_name", "rank", "value")


def donors_by(donors: DataFrame, key: str) -> DataFrame:
    col = sort_key(key, DONOR_KEYS)
    pos = R.with_position(donors.select("name", "rank", F.col(col).alias("value")),
                          [F.col("value").desc(), F.col("rank")])
    return pos.select("position", "name", "rank", "value")


def top_k(mart: DataFrame, value: str, tie: list[Column], k: int) -> DataFrame:
    """The best ``k`` rows without ordering the rest."""
    best = mart.orderBy(F.col(value).desc(), *tie).limit(k)
    return best.withColumn("position", F.row_number().over(Window.orderBy(F.col(value).desc(), *tie)))


def roster_by(members: DataFrame, key: str, active_only: bool = False) -> DataFrame:
    """Every team's roster by a column; members with nothing there keep lifetime order."""
    col = sort_key(key, MEMBER_KEYS)
    rows = members.filter("points_last_7d > 0") if active_only else members
    rows = rows.select("team_id", "name", "rank", F.col(col).alias("value"))
    first = F.greatest(F.col("value"), F.lit(0)).desc()
    order = [F.col("rank").asc()] if col == "score" else [first, F.col("rank").asc()]
    return R.with_group_position(rows, ["team_id"], order, "position")


def search(mart: DataFrame, query: str, name_col: str, id_col: str | None = None, limit: int = 8) -> DataFrame:
    """Exact name first, then ASCII case-insensitive prefix matches by rank; a number also
    finds the team with that id, ahead of both."""
    if not query:
        raise ValueError("q is required")
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    name = F.col(name_col)
    exact = name == F.lit(query)
    hit = S.ascii_fold(name).startswith(S.ascii_fold(F.lit(query)))
    by_id = F.lit(False)
    if id_col and query.isdigit():
        by_id = F.col(id_col) == F.lit(int(query))
    rows = mart.filter(hit | by_id).select(
        "*", F.when(by_id, 0).when(exact, 1).otherwise(2).alias("match"))
    return rows.orderBy("match", "rank").limit(limit).select(
        *([id_col] if id_col else []), name_col, "rank", "score", (F.col("match") < 2).alias("exact"))


def entity_summaries(teams: DataFrame, donors: DataFrame) -> DataFrame:
    cols = ["rank", F.col("score").alias("points_total"), "points_per_day_24h_avg",
            "points_per_day_7d_avg", "rank_change_24h"]
    t = teams.select(F.lit("team").alias("kind"), F.col("team_id").cast("string").alias("ref"),
                     F.col("team_name").alias("name"), "team_id", *cols)
    d = donors.select(F.lit("donor").alias("kind"), F.col("name").alias("ref"), "name",
                      F.lit(None).cast("int").alias("team_id"), *cols)
    return t.unionByName(d)


def _one(entities: DataFrame, kind: str, cond: Column, prefix: str) -> DataFrame:
    row = entities.filter((F.col("kind") == F.lit(kind)) & cond)
    return row.select("kind", *[F.col(c).alias(f"{prefix}_{c}") for c in
                                ("name", "rank", "points_total", "points_per_day_24h_avg")])


def compare(entities: DataFrame, kind: str, a: str, b: str, now: Column) -> DataFrame:
    rows = (_one(entities, kind, F.col("ref") == F.lit(a), "a")
            .join(_one(entities, kind, F.col("ref") == F.lit(b), "b"), "kind"))
    pa, pb = F.col("a_points_total"), F.col("b_points_total")
    gap, days, at = S.overtake(now, pa, "a_points_per_day_24h_avg", pb, "b_points_per_day_24h_avg")
    leader = F.when(pa > pb, "a").when(pb > pa, "b").otherwise("tie")
    return rows.select("*", leader.alias("leader"), gap.alias("points_gap"),
                       days.alias("overtake_days"), at.alias("overtake_ts"))


def goal(entities: DataFrame, kind: str, who: str, now: Column, *, target_rank: int | None = None,
         target_points: int | None = None, overtake: str | None = None,
         by_days: float | None = None) -> DataFrame:
    """What a subject must average to reach exactly one kind of target.

    With ``by_days`` one dated requirement, otherwise one row per horizon that needs any
    production (and one row with NULLs when none does).
    """
    if sum(x is not None for x in (target_rank, target_points, overtake)) != 1:
        raise ValueError("give exactly one of target_rank, target_points or overtake")
    subject = _one(entities, kind, F.col("ref") == F.lit(who), "self")
    if target_rank is not None:
        target, how = _one(entities, kind, F.col("rank") == F.lit(target_rank), "target"), "rank"
    elif overtake is not None:
        target, how = _one(entities, kind, F.col("ref") == F.lit(overtake), "target"), "overtake"
    else:
        if target_points <= 0:
            raise ValueError("target_points must be a positive integer")
        how, zero = "points", F.lit(0).cast("bigint")
        target = subject.select(
            "kind", F.lit(f"{target_points} points").alias("target_name"), zero.alias("target_rank"),
            F.lit(target_points).cast("bigint").alias("target_points_total"),
            zero.alias("target_points_per_day_24h_avg"))
    sp, tp = F.col("self_points_total"), F.col("target_points_total")
    sr, tr = F.col("self_points_per_day_24h_avg"), F.col("target_points_per_day_24h_avg")
    gap, days, at = S.overtake(now, sp, sr, tp, tr)
    holding = sp >= tp
    base = subject.join(target, "kind").select(
        "*", F.lit(how).alias("target_type"), holding.alias("holding"),
        (holding & (sr >= tr)).alias("already_reached"), gap.alias("points_gap"),
        days.alias("overtake_days"), at.alias("overtake_ts"))
    need = lambda d: F.greatest(F.lit(0).cast("bigint"), S.required_rate(sp, tp, tr, d))
    if by_days is not None:
        if by_days <= 0:
            raise ValueError("by must be after the snapshot date")
        return base.withColumn("required_per_day", need(F.lit(float(by_days))))
    horizons = F.array(*[F.struct(F.lit(d).alias("days"), need(F.lit(d)).alias("rate"))
                         for d in GOAL_HORIZONS])
    horizons = F.filter(horizons, lambda h: h["rate"] > 0)
    multiple = F.when(sr > 0, F.round(F.col("h.rate").cast("double") / sr.cast("double") * 100) / 100)
    return base.withColumn("h", F.explode_outer(horizons)).select(
        *base.columns, F.col("h.days").alias("horizon_days"), F.col("h.rate").alias("required_per_day"),
        F.when(F.col("h.rate").isNotNull(), F.coalesce(multiple, F.lit(0.0))).alias("rate_multiple"))


def movers(entities: DataFrame, kind: str, within: int = 1000, limit: int = 10) -> DataFrame:
    """Biggest climbs and falls over 24 h among the first ``within`` by lifetime rank."""
    if not 10 <= within <= 10_000:
        raise ValueError("within must be between 10 and 10000")
    if not 1 <= limit <= 25:
        raise ValueError("limit must be between 1 and 25")
    field = entities.filter((F.col("kind") == kind) & (F.col("rank") <= F.lit(within)))

    def side(rows: DataFrame, direction: str, key: Column) -> DataFrame:
        best = rows.orderBy(key, "rank").limit(limit)
        place = F.row_number().over(Window.orderBy(key, F.col("rank")))
        return best.select(F.lit(direction).alias("direction"), place.alias("place"), "kind", "name",
                           "rank", "points_total", "points_per_day_24h_avg",
                           F.col("rank_change_24h").alias("change_24h"))

    up = side(field.filter("rank_change_24h > 0"), "climbed", F.col("rank_change_24h").desc())
    down = side(field.filter("rank_change_24h < 0"), "fell", F.col("rank_change_24h").asc())
    return up.unionByName(down)


def rivals(mart: DataFrame, subject: Column, rank: str, name: str, now: Column, per_page: int = 100) -> DataFrame:
    """The page of the ranking that holds the subject, with when each row and it swap places."""
    me = mart.filter(subject).select(
        F.struct(F.col(rank).alias("r"), F.col("score").alias("p"),
                 F.col("points_per_day_24h_avg").alias("v"))).scalar()
    page = R.page_of_anchor(me.getField("r"), per_page)
    near = mart.filter((F.col(rank) > (page - 1) * per_page) & (F.col(rank) <= page * per_page))
    gap, days, at = S.overtake(now, me.getField("p"), me.getField("v"), "score", "points_per_day_24h_avg")
    mine = F.col(rank) == me.getField("r")
    return near.select(
        F.col(rank).alias("rank"), F.col(name).alias("name"), mine.alias("self"),
        F.col("score").alias("points_total"), "points_per_day_24h_avg", "points_per_day_7d_avg",
        gap.alias("points_gap"), F.when(~mine, days).alias("overtake_days"),
        F.when(~mine, at).alias("overtake_ts"))


def team_activity(members: DataFrame, limit: int = 10) -> DataFrame:
    """Who joined, stopped or surged on each team's roster, the largest first.

    A member who joined is in no other class; each class keeps its full count beside the
    ``limit`` rows shown.
    """
    rate = F.col("points_per_day_7d_avg")
    last24, last7 = F.col("points_last_24h"), F.col("points_last_7d")
    kind = (F.when(F.col("arrived_24h"), "joined")
            .when((last7 > 0) & (last24 == 0), "stopped")
            .when((last24 > 0) & (rate > 0) & (last24 >= F.lit(SURGE_RATIO) * rate), "surging"))
    by = (F.when(F.col("activity") == "joined", F.col("score"))
          .when(F.col("activity") == "stopped", last7).otherwise(last24 - rate))
    rows = (members.withColumn("activity", kind).filter("activity IS NOT NULL")
            .select("team_id", "activity", "name", "rank", by.alias("by_points")))
    counts = rows.groupBy("team_id", "activity").agg(F.count(F.lit(1)).alias("in_class"))
    placed = R.with_group_position(rows, ["team_id", "activity"],
                                   [F.col("by_points").desc(), F.col("rank").asc()], "place")
    return (placed.filter(F.col("place") <= F.lit(limit)).join(counts, ["team_id", "activity"])
            .select("team_id", "activity", "place", "name", "by_points", "in_class"))


def changed(delta: DataFrame, mart: DataFrame, keys: list[str], since: int, at: int) -> DataFrame:
    """Entities that moved after ``since`` (exclusive), with their rank."""
    if since < at - WEEK:
        raise ValueError("since is further back than seven days; read the full collection")
    moved = delta.filter(F.col("ts") > F.lit(since)).select(*keys).distinct()
    return mart.join(moved, keys, "left_semi").select(*keys, "rank", "score", "points_last_24h")


def concentration(members: DataFrame, teams: DataFrame) -> DataFrame:
    """Share of a team's total held by its top 10 and top 100 members, in whole percent."""
    r = F.col("rank_in_team")
    sums = members.groupBy("team_id").agg(
        F.count(F.lit(1)).alias("member_count"),
        F.sum(F.when(r <= 10, F.col("score"))).alias("top10"),
        F.sum(F.when(r <= 100, F.col("score"))).alias("top100"))
    pct = lambda c: F.round(F.col(c).cast("double") / F.col("score").cast("double") * 100).cast("bigint")
    rows = sums.join(teams.select("team_id", "score"), "team_id").filter(
        (F.col("member_count") >= 10) & (F.col("score") > 0))
    return rows.select("team_id", "member_count", pct("top10").alias("top10_percent"),
                       F.when(F.col("member_count") >= 100, pct("top100")).alias("top100_percent"))


GROUP_SUMS = ["score", "wus", "points_last_cycle", "points_last_24h", "points_last_7d", "points_today_utc",
              "points_this_week_utc", "points_this_month_utc", "points_per_day_24h_avg",
              "points_per_day_7d_avg"]


def group_totals(teams: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums over each group's teams, rates included; ids no team has are ignored."""
    rows = groups.join(teams, "team_id")
    g = rows.groupBy("group_kind", "code", "group_name").agg(
        F.count(F.lit(1)).alias("teams_total"),
        F.count_if(F.col("points_last_7d") > 0).alias("teams_active"),
        *[F.sum(c).alias(c) for c in GROUP_SUMS])
    return g.withColumn("points_per_wu", S.points_per_wu("score", "wus"))


def group_top_teams(teams: DataFrame, groups: DataFrame, countries: int = 10, topics: int = 6) -> DataFrame:
    rows = groups.join(teams.select("team_id", "team_name", "score", "rank"), "team_id")
    placed = R.with_group_position(rows, ["group_kind", "code"], [F.col("rank").asc()], "place")
    cap = F.when(F.col("group_kind") == "country", F.lit(countries)).otherwise(F.lit(topics))
    return placed.filter(F.col("place") <= cap).select(
        "group_kind", "code", "place", "team_id", "team_name", "score")


def watch_diff(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Movement since a stored reading; a better rank is a positive change."""
    then = baseline.select(*keys, F.col("rank").alias("r0"), F.col("score").alias("p0"),
                           F.col("points_per_day_24h_avg").alias("v0"))
    return current.join(then, keys, "left").select(
        *keys, "rank", (F.col("r0") - F.col("rank")).alias("rank_diff"),
        (F.col("points_per_day_24h_avg") - F.col("v0")).alias("rate_diff"),
        (F.col("score") - F.col("p0")).alias("points_diff"))
