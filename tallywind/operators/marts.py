"""Member, team, donor and project views of one published cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywind.functions import scalars as S
from tallywind.operators import ranking as R
from tallywind.operators.windows import WINDOW_COLUMNS, Clock, rates
from tallywind.session import materialize, together

# Names on more teams than this are likely shared; embedded lists are capped.
SHARED_TEAMS = 50
BREAKDOWN_CAP = 100


def _change(rank_then: str, rank: str) -> Column:
    """Places gained since the baseline; NULL when there is no earlier rank."""
    return (F.col(rank_then) - F.col(rank)).alias("rank_change_24h")


def _total_then(score="score", last24="points_last_24h") -> Column:
    return F.greatest(F.col(score) - F.col(last24), F.lit(0).cast("bigint"))


def _order(total: str, keys: list[str]) -> list[Column]:
    """Total first; ties go to the entity seen first, then to its key."""
    return [F.col(total).desc(), F.col("first_seen").asc(), *[F.col(k).asc() for k in keys]]


def _rank_now(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, rank). Only keys and sort columns travel through the range shuffle;
    the wide production rows are joined once, at the end."""
    slim = rows.select(*keys, "score", "first_seen")
    return R.with_position(slim, _order("score", keys), "rank").drop("first_seen")


def _rank_then(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks of the reconstructed totals, among the entities that existed at the baseline."""
    pos = R.with_position(rows.select(*keys, "total_then", "first_seen"), _order("total_then", keys), "rank_then")
    return pos.select(*keys, "rank_then")


def _existed(clock: Clock) -> Column:
    return F.col("first_seen") <= F.lit(clock.baseline)


def _ranks(prod: DataFrame, keys: list[str], clock: Clock, more=lambda now: now) \
        -> tuple[DataFrame, DataFrame | None]:
    """Ranks now, taken further by ``more``, beside the ranks a day ago."""
    if clock.baseline is None:
        return more(_rank_now(prod, keys)), None
    then = prod.filter(_existed(clock)).select(*keys, "first_seen", _total_then().alias("total_then"))
    now, before = together(lambda: more(_rank_now(prod, keys)), lambda: _rank_then(then, keys))
    return now, before


def _join_ranks(prod: DataFrame, now: DataFrame, before: DataFrame | None, keys: list[str]) -> DataFrame:
    out = prod.join(R.with_tie_width(now, "score").drop("score"), keys)
    if before is None:
        return out.withColumn("rank_change_24h", F.lit(None).cast("bigint"))
    return (out.join(before, keys, "left")
            .withColumn("rank_change_24h", _change("rank_then", "rank")).drop("rank_then"))


def _arrived(clock: Clock) -> Column:
    flag = F.lit(None).cast("boolean") if clock.baseline is None else ~_existed(clock)
    return flag.alias("arrived_24h")


def rank_entities(prod: DataFrame, keys: list[str], clock: Clock) -> DataFrame:
    """Lifetime rank, tie width, arrival flag and 24 h rank change for members or teams."""
    now, before = _ranks(prod, keys, clock)
    return _join_ranks(prod, now, before, keys).select("*", _arrived(clock))


def member_mart(prod: DataFrame, clock: Clock) -> DataFrame:
    """Members with global rank, rank in their team and position among their name's teams."""
    keys, by_rank = ["name", "team_id"], [F.col("rank").asc()]

    def within(now: DataFrame) -> DataFrame:
        # One frame gathers all positions, so that only it meets the production rows.
        team = R.with_group_position(now, ["team_id"], by_rank, "rank_in_team")
        return R.with_group_position(team, ["name"], by_rank, "rank_in_name")

    now, before = _ranks(prod, keys, clock, within)
    return _join_ranks(prod, now, before, keys).select("*", _arrived(clock))


def by_rank() -> list[Column]:
    """What a member's global rank is by: breaks ties like the rank itself."""
    return _order("score", ["name", "team_id"])


def roster_of(prod: DataFrame, column: str) -> DataFrame:
    """Every team's roster by one column, with global ranks, straight from production rows: team_id,
    name, rank, value, position. Only keys and sort columns travel."""
    slim = prod.select("name", "team_id", "first_seen", *dict.fromkeys(["score", column]))
    ranked = R.with_position(slim, by_rank(), "rank").select("team_id", "name", "rank", F.col(column).alias("value"))
    first = [] if column == "score" else [F.greatest(F.col("value"), F.lit(0)).desc()]
    return R.with_group_position(ranked, ["team_id"], [*first, F.col("rank").asc()], "position")


def team_member_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("team_id").agg(
        F.count(F.lit(1)).alias("members_total"),
        F.count_if(F.col("points_last_7d") > 0).alias("members_active"))


def team_mart(prod: DataFrame, members: DataFrame, clock: Clock) -> DataFrame:
    ranked = rank_entities(prod, ["team_id"], clock)
    counts = team_member_counts(members)
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
            for c in ("members_total", "members_active")]
    return ranked.join(counts, "team_id", "left").select(*ranked.columns, *zero)


def donor_totals(members: DataFrame, *more: Column) -> DataFrame:
    """Roll members up by name; period figures are sums, the span is the longest."""
    return members.groupBy("name").agg(
        F.sum("score").alias("score"), F.sum("wus").alias("wus"),
        F.count(F.lit(1)).alias("team_count"), F.min("first_seen").alias("first_seen"),
        *[F.sum(c).alias(c) for c in WINDOW_COLUMNS],
        F.max("observed_ns").alias("observed_ns"), *more)


def donor_production(members: DataFrame, shared_teams: int = SHARED_TEAMS, *more: Column) -> DataFrame:
    d = donor_totals(members, *more)
    # The rate of the sums, not the sum of rounded rates.
    week, day = rates(F.col("points_last_7d"), F.col("points_last_24h"), F.col("observed_ns"))
    return d.select(
        "*", week.alias("points_per_day_7d_avg"), day.alias("points_per_day_24h_avg"),
        S.points_per_wu("score", "wus").alias("points_per_wu"),
        (F.col("team_count") > F.lit(shared_teams)).alias("likely_not_a_person"))


def donor_mart(members: DataFrame, clock: Clock, shared_teams: int = SHARED_TEAMS) -> DataFrame:
    """Members are rolled up once, with both totals; ranks are taken of the kept sums."""
    keys = ["name"]
    if clock.baseline is None:
        donors = materialize(donor_production(members, shared_teams), "donor-sums", scratch=True)
        return _join_ranks(donors, _rank_now(donors, keys), None, keys)
    # Clamped per member, then summed over the members that existed at the baseline. A name existed
    # if one of its members did, and was first seen with the first of them.
    then = F.sum(F.when(_existed(clock), _total_then())).alias("total_then")
    sums = materialize(donor_production(members, shared_teams, then), "donor-sums", scratch=True)
    donors = sums.drop("total_then")
    now, before = together(lambda: _rank_now(donors, keys), lambda: _rank_then(sums.filter(_existed(clock)), keys))
    return _join_ranks(donors, now, before, keys)


PRODUCTION = ["score", "wus", *WINDOW_COLUMNS, "points_per_day_7d_avg", "points_per_day_24h_avg",
              "points_per_wu"]


def _production() -> list[Column]:
    names = {"score": "points_total", "wus": "wus_total"}
    return [F.col(c).alias(names.get(c, c)) for c in PRODUCTION]


def team_view(teams: DataFrame) -> DataFrame:
    return teams.select("team_id", "team_name", "rank", "tie", "rank_change_24h",
                        "members_total", "members_active", *_production())


def member_view(members: DataFrame, teams: DataFrame | None = None) -> DataFrame:
    """Member rows; with ``teams`` each also carries its team's latest name."""
    cols = ["name", "team_id", F.col("rank").alias("rank_global"), F.col("tie").alias("tie_global"),
            "rank_in_team", "rank_change_24h", *_production()]
    if teams is None:
        return members.select(*cols)
    return (members.select(*cols)
            .join(teams.select("team_id", "team_name"), "team_id", "left"))


def donor_view(donors: DataFrame) -> DataFrame:
    return donors.select("name", "rank", "tie", "rank_change_24h", "team_count",
                         "likely_not_a_person", *_production())


def donor_breakdown(members: DataFrame, teams: DataFrame, by_production: bool = False,
                    cap: int = BREAKDOWN_CAP) -> DataFrame:
    """Each name's memberships, best first, capped with a flag on what was cut."""
    if by_production:
        members = R.with_group_position(
            members, ["name"], [F.col("points_last_7d").desc(), F.col("rank").asc()], "place")
    else:
        members = members.withColumn("place", F.col("rank_in_name"))
    counts = members.groupBy("name").agg(F.count(F.lit(1)).alias("team_count"))
    return (members.filter(F.col("place") <= F.lit(cap))
            .join(counts, "name")
            .join(teams.select("team_id", "team_name"), "team_id", "left")
            .select("name", "place", "team_id", "team_name", "score", "points_last_7d",
                    (F.col("team_count") > F.lit(cap)).alias("teams_truncated")))


def with_teams_array(donors: DataFrame, breakdown: DataFrame) -> DataFrame:
    """Donor rows with their capped memberships embedded; at most ``cap`` structs per name."""
    item = F.struct("place", "team_id", "team_name", "score", "points_last_7d")
    nested = breakdown.groupBy("name").agg(
        F.sort_array(F.collect_list(item)).alias("teams"),
        F.max("teams_truncated").alias("teams_truncated"))
    return donors.join(nested, "name", "left")


def project_summary(teams: DataFrame, donors: DataFrame, members: DataFrame, clock: Clock) -> DataFrame:
    """Totals from the team feed, which is authoritative, plus entity and arrival counts.

    One pass over each mart; donor and member counts come in as scalar subqueries.
    """
    t = teams.agg(
        F.count(F.lit(1)).alias("teams_total"),
        F.count_if(F.col("points_last_7d") > 0).alias("teams_active"),
        *[F.sum(c).alias(c) for c in ["score", "wus", *WINDOW_COLUMNS]],
        F.count_if(F.col("arrived_24h")).alias("new_teams"))
    d = donors.agg(F.struct(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("points_last_7d") > 0).alias("active"),
        F.count_if(F.col("rank_change_24h").isNull()).alias("fresh"))).scalar()
    m = members.agg(F.struct(F.count(F.lit(1)).alias("total"),
                             F.count_if(F.col("arrived_24h")).alias("fresh"))).scalar()
    week, day = rates(F.col("points_last_7d"), F.col("points_last_24h"),
                      F.lit(clock.covered_ns).cast("bigint"))
    known = F.lit(clock.baseline is not None)
    return t.select(
        "teams_total", "teams_active", d.getField("total").alias("donors_total"),
        d.getField("active").alias("donors_active"), m.getField("total").alias("members_total"),
        F.col("score").alias("points_total"), F.col("wus").alias("wus_total"), *WINDOW_COLUMNS,
        week.alias("points_per_day_7d_avg"), day.alias("points_per_day_24h_avg"),
        S.points_per_wu("score", "wus").alias("points_per_wu"),
        F.when(known, d.getField("fresh")).alias("new_donors_24h"),
        F.when(known, F.col("new_teams")).alias("new_teams_24h"),
        F.when(known, m.getField("fresh")).alias("new_members_24h"))


def warming_up(clock_row: DataFrame, measured: DataFrame) -> DataFrame:
    """What still needs qualifying on a young record: span under a week, guessed cadence,
    no rank a day back. NULL span once a full week has been seen."""
    from tallywind.schemas import WEEK
    span = F.col("snapshot_ts") - F.col("first_cycle")
    return (clock_row.join(measured.select("snapshot_ts", "measured"), "snapshot_ts")
            .select("snapshot_ts",
                    F.when(span < F.lit(WEEK), span).alias("history_span_sec"),
                    (~F.col("measured")).alias("interval_estimated"),
                    F.col("baseline").isNull().alias("rank_change_unavailable")))
