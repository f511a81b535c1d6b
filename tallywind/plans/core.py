"""Queries over feeds, deltas, identity, windows, ranks, rollups and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywind.functions import scalars as S
from tallywind.operators import activity, diff, marts, pairing, quantiles, rollups, windows
from tallywind.operators import ranking as R
from tallywind.plans import oracle as O
from tallywind.plans.registry import query
from tallywind.schemas import DAY, HOUR, MAX_TEAM_ROWS, MAX_USER_ROWS, WEEK
from tallywind.sources import adapters as A
from tallywind.sources import archive

M, T = diff.MEMBER, diff.TEAM

# --- differencing ---------------------------------------------------------------------


@query("member_snapshot_dedup", "split", "select name, team_id, snapshot_ts, score, wus from msnap")
def member_snapshot_dedup(W):
    return diff.sum_duplicates(W.raw_member_snapshot)


for _world in ("hourly", "daily"):
    query(f"member_deltas_{_world}" if _world == "daily" else "member_deltas", _world,
          "select * from mdelta")(lambda W: diff.deltas(W.member_snapshot, M))
    query(f"team_deltas_{_world}" if _world == "daily" else "team_deltas", _world,
          "select * from tdelta")(lambda W: diff.deltas(W.team_snapshot, T))


@query("new_entities", "daily", """
  select 'member' as kind, ts, count(*) as new_entities from (select min(snapshot_ts) as ts from msnap group by name, team_id) group by ts
  union all select 'team', ts, count(*) from (select min(snapshot_ts) as ts from tsnap group by team_id) group by ts""")
def new_entities(W):
    m = diff.first_sightings(W.member_snapshot, M).withColumn("kind", F.lit("member"))
    t = diff.first_sightings(W.team_snapshot, T).withColumn("kind", F.lit("team"))
    return m.unionByName(t)


@query("regressions", "corrections", """
  with bad as (select 'user' as feed, name, team_id, ts, d_score, d_wu from mmove where d_score < 0
               union all select 'team', null, team_id, ts, d_score, d_wu from tmove where d_score < 0),
  r as (select *, row_number() over (partition by feed, ts order by d_score, name, team_id) as sample_no,
               count(*) over (partition by feed, ts) as regressions from bad)
  select feed, ts, name, team_id, d_score, d_wu, sample_no, regressions from r where sample_no <= 5""")
def regressions(W):
    user, team = (diff.regression_samples(diff.regressions(s, k), k).withColumn("feed", F.lit(f)) for f, s, k in (
        ("user", W.member_snapshot, M), ("team", W.team_snapshot, T)))
    out = user.unionByName(team, allowMissingColumns=True)
    return out.select("feed", "ts", "name", "team_id", "d_score", "d_wu", "sample_no", "regressions")


@query("snapshot_validation", "corrections", """
  select snapshot_ts, feed, cast(sum(score) as bigint) as score_total, cast(sum(wus) as bigint) as wus_total,
         case when min(score) < 0 then 'score' when min(wus) < 0 then 'wus' else 'ok' end as verdict
  from (select snapshot_ts, 'team' as feed, score, wus from tsnap union all
        select snapshot_ts, 'user', score, wus from mraw) group by snapshot_ts, feed""")
def snapshot_validation(W):
    return diff.validate_totals(W.team_snapshot, W.raw_member_snapshot)


_EXCESS = """
  with g as (select snapshot_ts, team_id, sum(score) as granted from tsnap group by all),
  c as (select snapshot_ts, team_id, sum(score) as claimed, count(*) as member_rows from mraw group by all),
  x as (select c.snapshot_ts, c.team_id, cast(claimed - coalesce(granted, 0) as bigint) as excess, member_rows
        from c left join g on c.snapshot_ts = g.snapshot_ts and c.team_id = g.team_id)"""


@query("reconcile_excess", "forged", _EXCESS + " select * from x where excess > 10000000")
def reconcile_excess(W):
    return diff.reconcile(W.team_snapshot, W.raw_member_snapshot, 10_000_000)


@query("reconcile_drop", "forged", _EXCESS + """
  select name, team_id, snapshot_ts, score, wus from mraw m
  where not exists (select 1 from x where x.snapshot_ts = m.snapshot_ts and x.team_id = m.team_id
                    and excess > 100000000)""")
def reconcile_drop(W):
    over = diff.reconcile(W.team_snapshot, W.raw_member_snapshot, 100_000_000)
    return diff.drop_over_claims(W.raw_member_snapshot, over).select(
        "name", "team_id", "snapshot_ts", "score", "wus")


@query("feed_checksum", "hourly", """
  select count(*) filter (where c = g) as exact, count(*) filter (where c < g) as under,
         count(*) filter (where c > g) as over_claimed, cast(max(greatest(c - g, 0)) as bigint) as max_over
  from (select team_id, sum(score) as c from mstate group by team_id) m
       join (select team_id, sum(score) as g from tstate group by team_id) t using (team_id)""")
def feed_checksum(W):
    # Complete feeds of the newest cycle: every entity with its last total.
    team = W.team_state.withColumn("snapshot_ts", W.lit_at())
    member = W.member_state.withColumn("snapshot_ts", W.lit_at())
    return diff.feed_checksum(team, member).drop("snapshot_ts")


@query("entity_ordinals", "daily", """
  select name, team_id, first_seen, row_number() over (order by first_seen, name, team_id) - 1 as ordinal from mstate""")
def entity_ordinals(W):
    return diff.ordinals(W.member_state, M)


@query("team_latest_name", "hourly", "select team_id, team_name, first_seen, last_seen from tstate")
def team_latest_name(W):
    return diff.latest_state(W.team_snapshot, T, "team_name").select(
        "team_id", "team_name", "first_seen", "last_seen")


_PAIRS = """
  with u as (select distinct snapshot_ts as ts from meta where feed = 'user'),
  t as (select distinct snapshot_ts as team_ts from meta where feed = 'team'),
  pairs as (select u.ts, t.team_ts, u.ts as user_ts from u asof join t on u.ts >= t.team_ts)"""


@query("pair_snapshots", "hourly", _PAIRS + " select * from pairs")
def pair_snapshots(W):
    return pairing.pair_snapshots(W.snapshot_meta)


@query("pending_cycles", "hourly", _PAIRS + """
  select * from pairs where ts not in (select ts from cycles, newest where ts <= at_ts - 604800)""")
def pending_cycles(W):
    applied = W.cycles.filter(F.col("ts") <= F.lit(W.clock.at - WEEK))
    return diff.pending_cycles(pairing.pair_snapshots(W.snapshot_meta), applied)


@query("cycle_audit", "corrections", """
  with m as (select ts, count(*) as user_rows, count(*) filter (where prev_score is null) as new_members,
                    count(*) filter (where d_score < 0) as r from mmove group by ts),
  md as (select ts, count(*) as n from mdelta group by ts),
  t as (select ts, count(*) as team_rows, count(*) filter (where prev_score is null) as new_teams,
               count(*) filter (where d_score < 0) as r from tmove group by ts),
  td as (select ts, count(*) as n from tdelta group by ts)
  select m.ts, coalesce(t.team_rows, 0) as team_rows, user_rows, new_members, coalesce(new_teams, 0) as new_teams,
         coalesce(md.n, 0) as member_deltas, coalesce(td.n, 0) as team_deltas, m.r + coalesce(t.r, 0) as regressions
  from m left join t on m.ts = t.ts left join md on m.ts = md.ts left join td on m.ts = td.ts""")
def cycle_audit(W):
    return diff.cycle_audit(W.team_snapshot, W.raw_member_snapshot)


# --- archive --------------------------------------------------------------------------


@query("snapshots_since", "hourly", """
  select feed, snapshot_ts, fetched_ts, bytes, sha256 from meta, newest where snapshot_ts >= at_ts - 604800""")
def snapshots_since(W):
    rows = archive.snapshots_since(archive.with_date(W.snapshot_meta), W.clock.at - WEEK)
    return rows.drop("date")


@query("latest_snapshot", "hourly", """
  select feed, max(snapshot_ts) as snapshot_ts, arg_max(fetched_ts, snapshot_ts) as fetched_ts,
         arg_max(bytes, snapshot_ts) as bytes, arg_max(sha256, snapshot_ts) as sha256 from meta group by feed""")
def latest_snapshot(W):
    return archive.latest_snapshot(W.snapshot_meta)


@query("snapshot_time", "hourly", """
  with f as (select event_id, cast(floor(epoch(ts)) as bigint) as fetched_ts,
                    case event_type when 'error' then null when 'signup' then cast(floor(epoch(ts)) as bigint) + 301
                         when 'view' then cast(floor(epoch(ts)) as bigint) + 300
                         else cast(floor(epoch(ts)) as bigint) - 45 end as published_ts from events)
  select event_id, fetched_ts, published_ts,
         case when published_ts is null or published_ts > fetched_ts + 300 then fetched_ts else published_ts end as snapshot_ts
  from f""")
def snapshot_time(W):
    fetched = A.epoch("ts")
    kind = F.col("event_type")
    published = (F.when(kind == "error", F.lit(None).cast("bigint")).when(kind == "signup", fetched + 301)
                 .when(kind == "view", fetched + 300).otherwise(fetched - 45))
    rows = A.table(W.spark, W.sf_dir, "events").select(
        "event_id", fetched.alias("fetched_ts"), published.alias("published_ts"))
    return archive.identify(rows)


@query("snapshot_conflicts", "hourly", """
  with stored as (select feed, snapshot_ts, sha256 from meta
    union all select feed, snapshot_ts, sha256 from meta where (snapshot_ts // 3600) % 24 in (3, 4)
    union all select feed, snapshot_ts, sha256('x' || sha256) from meta where (snapshot_ts // 3600) % 24 = 4)
  select feed, snapshot_ts, count(*) as copies, count(distinct sha256) as digests,
         case when count(distinct sha256) > 1 then 'conflict' when count(*) > 1 then 'repeat' else 'single' end as verdict
  from stored group by feed, snapshot_ts""")
def snapshot_conflicts(W):
    # The 03:00 snapshots are stored twice alike, the 04:00 ones also with other content.
    hour = F.col("snapshot_ts") / HOUR % 24
    hour = F.floor(hour)
    meta = W.snapshot_meta.select("feed", "snapshot_ts", "sha256")
    again = meta.filter(hour.isin(3, 4))
    other = meta.filter(hour == 4).withColumn("sha256", F.sha2(F.concat(F.lit("x"), "sha256"), 256))
    return archive.conflicts(meta.unionByName(again).unionByName(other))


@query("snapshot_row_limits", "daily", """
  select 'team' as feed, snapshot_ts, count(*) as row_count, count(*) <= 500000 as accepted from tsnap group by snapshot_ts
  union all select 'user', snapshot_ts, count(*), count(*) <= 5000000 from mraw group by snapshot_ts""")
def snapshot_row_limits(W):
    return _row_limits(W, MAX_TEAM_ROWS, MAX_USER_ROWS)


@query("snapshot_row_limits_reached", "daily", """
  with n as (select 'team' as feed, snapshot_ts, count(*) as row_count from tsnap group by snapshot_ts
             union all select 'user', snapshot_ts, count(*) from mraw group by snapshot_ts)
  select *, row_count <= case when feed = 'team' then 2 else 3 end as accepted from n""")
def snapshot_row_limits_reached(W):
    return _row_limits(W, 2, 3)


def _row_limits(W, team, user):
    over = lambda df, limit, feed: diff.over_row_limit(df, limit).select(F.lit(feed).alias("feed"), "snapshot_ts", "row_count", "accepted")
    return over(W.team_snapshot, team, "team").unionByName(over(W.raw_member_snapshot, user, "user"))


@query("archive_thinning", "hourly", """
  select feed, snapshot_ts,
         case when snapshot_ts >= at_ts - 10 * 86400
                or row_number() over (partition by feed, snapshot_ts // 86400 order by snapshot_ts) = 1
              then 'keep' else 'delete' end as action from meta, newest""")
def archive_thinning(W):
    return archive.thinning(W.snapshot_meta, W.clock.at, full_days=10)


@query("compaction_plan", "daily", """
  select 'delta' as table_name, ts // 86400 as day, count(*) as row_count,
         ts // 86400 < (any_value(at_ts) - 90 * 86400) // 86400 as prune from mdelta, newest group by ts // 86400
  union all select 'daily', day, count(*), day < (any_value(at_ts) - 730 * 86400) // 86400 from mdaily, newest group by day""")
def compaction_plan(W):
    return archive.compaction_plan(W.member_delta, W.member_daily, W.clock.at - 90 * DAY, W.clock.at - 730 * DAY)


@query("strict_int", "hourly", r"""
  with c as (select unnest([cast(user_id as varchar), '-' || user_id, ' ' || user_id, cast(value as varchar),
                            '9' || repeat('0', 18), repeat('9', 19), repeat('9', 20), '', props]) as txt from events)
  select txt, count(*) as n,
         any_value(case when regexp_full_match(txt, '[0-9]{1,19}') then try_cast(txt as bigint) end) as parsed
  from c group by txt""", prelude=False)
def strict_int(W):
    uid = F.col("user_id").cast("string")
    texts = F.array(uid, F.concat(F.lit("-"), uid), F.concat(F.lit(" "), uid), F.col("value").cast("string"),
                    F.lit("9" + "0" * 18), F.lit("9" * 19), F.lit("9" * 20), F.lit(""), F.col("props"))
    rows = A.table(W.spark, W.sf_dir, "events").select(F.explode(texts).alias("txt"))
    return rows.groupBy("txt").agg(F.count(F.lit(1)).alias("n")).withColumn("parsed", S.strict_int("txt"))


# --- windows --------------------------------------------------------------------------

for _key, _span in (("24h", DAY), ("7d", WEEK)):
    query(f"rolling_{_key}", "hourly", f"""
  select name, team_id, ts, cast(sum(d_score) over (partition by name, team_id order by ts
         range between {_span - 1} preceding and current row) as bigint) as points from mdelta""")(
        lambda W, span=_span: windows.rolling(W.member_delta, M, span, "points"))


@query("calendar_to_date", "daily", """
  select name, team_id, points_today_utc, points_this_week_utc, points_this_month_utc from mprod""")
def calendar_to_date(W):
    return W.member_production.select(
        "name", "team_id", "points_today_utc", "points_this_week_utc", "points_this_month_utc")


@query("last_cycle", "daily", "select team_id, points_last_cycle, at_ts as snapshot_ts, prev_at from tprod, clock")
def last_cycle(W):
    return W.team_production.select("team_id", "points_last_cycle", W.lit_at().alias("snapshot_ts"),
                                    F.lit(W.clock.prev_at).cast("bigint").alias("prev_at"))


@query("baseline_24h", "daily", """
  select at_ts as snapshot_ts, baseline, (select count(*) from mstate, clock where first_seen <= baseline) as members_then,
         (select count(*) from tstate, clock where first_seen <= baseline) as teams_then from clock""")
def baseline_24h(W):
    c = windows.clock_frame(W.cycles)
    then = F.lit(W.clock.baseline).cast("bigint")
    count = lambda s: s.filter(F.col("first_seen") <= then).agg(F.count(F.lit(1))).scalar()
    return c.select("snapshot_ts", "baseline", count(W.member_state).alias("members_then"),
                    count(W.team_state).alias("teams_then"))


@query("observed_span", "daily", """
  select name, team_id, first_seen, observed_ns // 1000000000 as observed_sec from mprod""")
def observed_span(W):
    return W.member_production.select(
        "name", "team_id", "first_seen",
        S.idiv("observed_ns", F.lit(1_000_000_000).cast("bigint")).alias("observed_sec"))


@query("per_day_avg", "daily", """
  select name, team_id, points_per_day_7d_avg, points_per_day_24h_avg from mprod""")
def per_day_avg(W):
    return W.member_production.select("name", "team_id", "points_per_day_7d_avg", "points_per_day_24h_avg")


# --- ranks ----------------------------------------------------------------------------


@query("member_rank", "daily", "select name, team_id, score, rank from members")
def member_rank(W):
    order = [F.col("score").desc(), F.col("first_seen"), F.col("name"), F.col("team_id")]
    return R.with_position(W.member_state, order, "rank").select("name", "team_id", "score", "rank")


@query("team_rank", "daily", "select team_id, score, rank from teams")
def team_rank(W):
    order = [F.col("score").desc(), F.col("first_seen"), F.col("team_id")]
    return R.with_position(W.team_state, order, "rank").select("team_id", "score", "rank")


@query("donor_rank", "daily", "select name, score, rank from donors")
def donor_rank(W):
    d = W.member_state.groupBy("name").agg(F.sum("score").alias("score"), F.min("first_seen").alias("first_seen"))
    order = [F.col("score").desc(), F.col("first_seen"), F.col("name")]
    return R.with_position(d, order, "rank").select("name", "score", "rank")


@query("in_team_rank", "daily", "select name, team_id, rank_in_team from members")
def in_team_rank(W):
    order = [F.col("score").desc(), F.col("first_seen"), F.col("name")]
    return R.with_group_position(W.member_state, ["team_id"], order, "rank_in_team").select(
        "name", "team_id", "rank_in_team")


@query("tie_width", "daily", "select name, team_id, wus, count(*) over (partition by wus) as tie from mstate")
def tie_width(W):
    # Work units take few values, so almost every member shares its total.
    return R.with_tie_width(W.member_state, "wus").select("name", "team_id", "wus", "tie")


for _key, _sql, _keys in (("team", "team_id", ["team_id"]), ("member", "name, team_id", M), ("donor", "name", ["name"])):
    query(f"{_key}_rank_change", "daily", f"select {_sql}, rank, rank_change_24h from {_key}s")(
        lambda W, key=_key, keys=_keys: getattr(W, f"{key}s").select(*keys, "rank", "rank_change_24h"))


@query("standings_team", "daily", """
  with f as (select team_id, rank, points_this_month_utc as m, (select count(*) from teams) as n from teams),
  p as (select team_id, rank() over (order by m desc) as place, count(*) over () as n from f where m > 0)
  select f.team_id, round(cast(f.rank as double) / f.n * 100 * 1e6) / 1e6 as lifetime_top_percent, f.n as lifetime_of,
         round(cast(place as double) / p.n * 100 * 1e6) / 1e6 as month_top_percent, p.n as month_of
  from f left join p on f.team_id = p.team_id""")
def standings_team(W):
    return activity.standings(W.teams, T)


@query("standings", "daily", """
  with f as (select name, rank, points_this_month_utc as m, (select count(*) from donors) as n from donors),
  p as (select name, rank() over (order by m desc) as place, count(*) over () as n from f where m > 0)
  select f.name, round(cast(f.rank as double) / f.n * 100 * 1e6) / 1e6 as lifetime_top_percent, f.n as lifetime_of,
         round(cast(place as double) / p.n * 100 * 1e6) / 1e6 as month_top_percent, p.n as month_of
  from f left join p on f.name = p.name""")
def standings(W):
    return activity.standings(W.donors, ["name"])


# --- aggregations ---------------------------------------------------------------------


@query("donor_totals", "daily", "select name, score, wus, team_count from dsum")
def donor_totals(W):
    return W.member_state.groupBy("name").agg(
        F.sum("score").alias("score"), F.sum("wus").alias("wus"), F.count(F.lit(1)).alias("team_count"))


@query("shared_names", "daily", "select name, team_count, likely_not_a_person from donors")
def shared_names(W):
    return W.donors.select("name", "team_count", "likely_not_a_person")


@query("donor_periods", "daily", f"""
  select name, {', '.join(O.WINCOLS)}, observed_ns // 1000000000 as observed_sec, points_per_day_7d_avg,
         points_per_day_24h_avg from dprod""")
def donor_periods(W):
    d = marts.donor_production(W.member_production)
    return d.select("name", *windows.WINDOW_COLUMNS,
                    S.idiv("observed_ns", F.lit(1_000_000_000).cast("bigint")).alias("observed_sec"),
                    "points_per_day_7d_avg", "points_per_day_24h_avg")


@query("team_member_counts", "daily", "select * from mcount")
def team_member_counts(W):
    return marts.team_member_counts(W.member_production)


@query("project_summary", "daily", f"""
  with t as (select count(*) as teams_total, count(*) filter (where points_last_7d > 0) as teams_active,
       cast(sum(score) as bigint) as score, cast(sum(wus) as bigint) as wus,
       {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in O.WINCOLS)},
       count(*) filter (where arrived_24h) as new_teams_24h from teams),
  d as (select count(*) as donors_total, count(*) filter (where points_last_7d > 0) as donors_active,
       count(*) filter (where rank_change_24h is null) as new_donors_24h from donors),
  m as (select count(*) as members_total, count(*) filter (where arrived_24h) as new_members_24h from members)
  select teams_total, teams_active, donors_total, donors_active, members_total, score as points_total, wus as wus_total,
       {', '.join(O.WINCOLS)}, {O.per_day('points_last_7d', 'covered_ns')} as points_per_day_7d_avg,
       {O.per_day('points_last_24h', 'least(covered_ns, 86400000000000)')} as points_per_day_24h_avg,
       {O.per_wu('score', 'wus')} as points_per_wu, new_donors_24h, new_teams_24h, new_members_24h
  from t, d, m, clock""")
def project_summary(W):
    return marts.project_summary(W.teams, W.donors, W.members, W.clock)


@query("arrivals_24h", "daily", """
  select (select count(*) from members where arrived_24h) as new_members,
         (select count(*) from teams where arrived_24h) as new_teams,
         (select count(*) from donors where rank_change_24h is null) as new_donors""")
def arrivals_24h(W):
    s = marts.project_summary(W.teams, W.donors, W.members, W.clock)
    return s.select(F.col("new_members_24h").alias("new_members"), F.col("new_teams_24h").alias("new_teams"),
                    F.col("new_donors_24h").alias("new_donors"))


def _day(c="day"):
    return S.day_date(c).cast("string").alias("bucket")


def _month(c="month"):
    return S.day_date(S.month_start_day(c)).cast("string").alias("bucket")


_SQL_DAY = "cast(date '1970-01-01' + cast(day as integer) as varchar)"
_SQL_MONTH = "cast(cast(date_trunc('month', date '1970-01-01' + cast(day as integer)) as date) as varchar)"
_SUMS = "cast(sum(points) as bigint) as points, cast(sum(wus) as bigint) as wus"

for _k, _keys, _t in (("member", M, "mdaily"), ("team", T, "tdaily")):
    _cols = ", ".join(_keys)
    query(f"{_k}_daily", "hourly", f"select {_cols}, {_SQL_DAY} as bucket, points, wus from {_t}")(
        lambda W, k=_k, keys=_keys: rollups.daily(getattr(W, f"{k}_delta"), keys).select(
            *keys, _day(), "points", "wus"))
    query(f"{_k}_monthly", "daily",
          f"select {_cols}, {_SQL_MONTH} as bucket, {_SUMS} from {_t} group by all")(
        lambda W, k=_k, keys=_keys: rollups.monthly(getattr(W, f"{k}_daily"), keys).select(
            *keys, _month(), "points", "wus"))


@query("team_weekly", "daily", f"""
  select team_id, cast(date '1970-01-01' + cast(day - (day + 4) % 7 as integer) as varchar) as bucket, {_SUMS}
  from tdaily group by all""")
def team_weekly(W):
    return rollups.weekly(W.team_daily, T).select(
        "team_id", S.day_date(S.week_start_day("week")).cast("string").alias("bucket"), "points", "wus")


@query("project_deltas", "hourly", """
  select ts, cast(sum(d_score) as bigint) as d_score, cast(sum(d_wu) as bigint) as d_wu from tdelta group by ts""")
def project_deltas(W):
    return rollups.project_deltas(W.team_delta)


@query("project_daily", "hourly", f"select {_SQL_DAY} as bucket, {_SUMS} from tdaily group by day")
def project_daily(W):
    return rollups.daily(rollups.project_deltas(W.team_delta), []).select(_day(), "points", "wus")


@query("project_monthly", "daily", f"select {_SQL_MONTH} as bucket, {_SUMS} from tdaily group by 1")
def project_monthly(W):
    return rollups.monthly(W.team_daily, []).select(_month(), "points", "wus")


@query("project_rebuild", "daily", f"""
  select 'cycle' as grain, ts as bucket, cast(sum(d_score) as bigint) as points, cast(sum(d_wu) as bigint) as wus
  from tdelta group by ts
  union all select 'day', day, {_SUMS} from tdaily group by day
  union all select 'month', year({_SQL_DAY}::date) * 12 + month({_SQL_DAY}::date) - 1, {_SUMS} from tdaily group by 2""")
def project_rebuild(W):
    return rollups.project_rebuild(W.team_delta, W.team_daily, rollups.monthly(W.team_daily, T))


@query("month_totals", "daily", """
  select name, team_id, cast(sum(d_score) as bigint) as points, cast(sum(d_wu) as bigint) as wus
  from mdelta, clock where ts >= month0 group by name, team_id""")
def month_totals(W):
    import datetime as dt
    d = dt.datetime.fromtimestamp(W.clock.at, dt.timezone.utc)
    return rollups.month_totals(W.member_daily, M, d.year * 12 + d.month - 1)


@query("replay_cycles", "daily", """
  with m as (select ts, count(*) as n, sum(d_score) as p from mdelta group by ts),
  t as (select ts, count(*) as n, sum(d_score) as p from tdelta group by ts)
  select c.ts, coalesce(m.n, 0) as member_deltas, cast(coalesce(m.p, 0) as bigint) as member_points,
         coalesce(t.n, 0) as team_deltas, cast(coalesce(t.p, 0) as bigint) as team_points
  from cycles c left join m on c.ts = m.ts left join t on c.ts = t.ts, newest where c.ts >= at_ts - 604800""")
def replay_cycles(W):
    return rollups.replay(W.member_delta, W.team_delta, W.cycles, W.clock.at - WEEK)


_CADENCE = """
  with last as (select ts from cycles order by ts desc limit 25),
  gaps as (select ts - lag(ts) over (order by ts) as gap from last),
  ok as (select gap, row_number() over (order by gap) - 1 as i, count(*) over () as n from gaps
         where gap between 3000 and 4500),
  cad as (select at_ts as snapshot_ts, (select count(*) from ok) as samples,
                 coalesce((select gap from ok where i = n // 2), 3600) as interval_sec,
                 (select count(*) from ok) > 0 as measured from newest)"""


@query("cadence", "hourly", _CADENCE + " select *, snapshot_ts + interval_sec as next_expected_ts from cad")
def cadence(W):
    return pairing.cadence(W.cycles)


@query("cadence_unmeasured", "daily", _CADENCE + " select *, snapshot_ts + interval_sec as next_expected_ts from cad")
def cadence_unmeasured(W):
    return pairing.cadence(W.cycles)


@query("staleness", "hourly", _CADENCE + """
  select snapshot_ts, snapshot_ts + interval_sec as next_expected_ts,
         snapshot_ts + interval_sec + 1200 as stale_after_ts,
         snapshot_ts + 5000 > snapshot_ts + interval_sec + 1200 as stale from cad""")
def staleness(W):
    return pairing.staleness(pairing.cadence(W.cycles), F.lit(W.clock.at + 5000).cast("bigint"))


@query("cycle_bounds", "hourly", """
  select min(ts) as first_cycle, max(ts) as latest_cycle, count(*) as applied from cycles""")
def cycle_bounds(W):
    return W.cycles.agg(F.min("ts").alias("first_cycle"), F.max("ts").alias("latest_cycle"),
                        F.count(F.lit(1)).alias("applied"))


@query("warming_up", "daily", _CADENCE + """
  select snapshot_ts, case when at_ts - first_cycle < 604800 then at_ts - first_cycle end as history_span_sec,
         not measured as interval_estimated, baseline is null as rank_change_unavailable from cad, clock""")
def warming_up(W):
    return marts.warming_up(windows.clock_frame(W.cycles), pairing.cadence(W.cycles))


@query("event_percentiles", "hourly", """
  with o as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i,
                    count(*) over (partition by event_type) as n from events)
  select event_type, any_value(n) as n, max(value) filter (where i = least(n * 50 // 100, n - 1)) as p50,
         max(value) filter (where i = least(n * 90 // 100, n - 1)) as p90,
         max(value) filter (where i = least(n * 99 // 100, n - 1)) as p99, max(value) as max_value
  from o group by event_type""", prelude=False)
def event_percentiles(W):
    return quantiles.nearest_rank(A.table(W.spark, W.sf_dir, "events"), "event_type", "value", "event_id")


@query("histogram_quantiles", "hourly", """
  with b as (select event_type, cast(least(floor(value / 0.5), 400) as bigint) as bucket from events),
  c as (select event_type, bucket, count(*) as c from b group by all),
  s as (select *, sum(c) over (partition by event_type order by bucket) as cum,
               sum(c) over (partition by event_type) as n from c)
  select event_type, cast(max(n) as bigint) as n,
         min((bucket + 1) * cast(0.5 as double)) filter (where cum >= ceil(cast(0.5 as double) * n)) as q50,
         min((bucket + 1) * cast(0.5 as double)) filter (where cum >= ceil(cast(0.9 as double) * n)) as q90,
         min((bucket + 1) * cast(0.5 as double)) filter (where cum >= ceil(cast(0.99 as double) * n)) as q99
  from s group by event_type""", prelude=False)
def histogram_quantiles(W):
    return quantiles.histogram(A.table(W.spark, W.sf_dir, "events"), "event_type", "value", 0.5, 400)


@query("event_rate_60s", "hourly", """
  with s as (select cast(floor(epoch(ts)) as bigint) as sec, count(*) as n from events group by 1)
  select sec, cast(sum(n) over (order by sec range between 59 preceding and current row) as bigint) as events_in_window,
         cast(sum(n) over (order by sec range between 59 preceding and current row) as double) / 60 as per_second
  from s""", prelude=False)
def event_rate_60s(W):
    return windows.trailing_counts(A.table(W.spark, W.sf_dir, "events").select(A.epoch("ts").alias("sec")))


# --- views ----------------------------------------------------------------------------


@query("team_view", "daily", f"""
  select team_id, team_name, rank, tie, rank_change_24h, members_total, members_active, {O.PRODUCTION} from teams""")
def team_view(W):
    return marts.team_view(W.teams)


@query("member_view", "daily", f"""
  select m.name, m.team_id, m.rank as rank_global, m.tie as tie_global, rank_in_team, m.rank_change_24h,
         {', '.join('m.' + c.strip() for c in O.PRODUCTION.split(','))}, team_name
  from members m left join tstate t on m.team_id = t.team_id""")
def member_view(W):
    return marts.member_view(W.members, W.teams)


@query("donor_view", "daily", f"""
  select name, rank, tie, rank_change_24h, team_count, likely_not_a_person, {O.PRODUCTION} from donors""")
def donor_view(W):
    return marts.donor_view(W.donors)


@query("active_members", "daily", "select name, team_id, points_last_7d from members where points_last_7d > 0")
def active_members(W):
    return W.members.filter("points_last_7d > 0").select("name", "team_id", "points_last_7d")


@query("donor_team_scope", "daily", """
  select name, team_id, score, rank, rank_in_name from members where name = (select name from donors where rank = 1)
     and team_id = (select team_id from teams where rank = 1)""")
def donor_team_scope(W):
    donor = W.donors.filter("rank = 1").select("name").scalar()
    team = W.teams.filter("rank = 1").select("team_id").scalar()
    return W.members.filter((F.col("name") == donor) & (F.col("team_id") == team)).select(
        "name", "team_id", "score", "rank", "rank_in_name")


@query("entity_lookup", "daily", """
  select 'team' as kind, cast(team_id as varchar) as ref, rank, score from teams where team_id = 9
  union all select 'donor', name, rank, score from donors where name = 'c7'
  union all select 'member', name || '/' || team_id, rank, score from members where name = 'c7' and team_id = 9""")
def entity_lookup(W):
    t = W.teams_by_id.filter("team_id = 9").select(
        F.lit("team").alias("kind"), F.col("team_id").cast("string").alias("ref"), "rank", "score")
    d = W.donors_by_name.filter("name = 'c7'").select(F.lit("donor").alias("kind"), F.col("name").alias("ref"), "rank", "score")
    m = W.members_by_name.filter("name = 'c7' AND team_id = 9").select(
        F.lit("member").alias("kind"), F.concat_ws("/", "name", F.col("team_id").cast("string")).alias("ref"),
        "rank", "score")
    return t.unionByName(d).unionByName(m)


@query("insight_entities", "daily", """
  select 'team' as kind, team_name as name, team_id, rank, score as points_total, points_per_day_24h_avg,
         points_per_day_7d_avg from teams
  union all select 'donor', name, null, rank, score, points_per_day_24h_avg, points_per_day_7d_avg from donors""")
def insight_entities(W):
    from tallywind.operators.insights import entity_summaries
    return entity_summaries(W.teams, W.donors).select(
        "kind", "name", "team_id", "rank", "points_total", "points_per_day_24h_avg", "points_per_day_7d_avg")
