"""Queries over what the cycle ingest committed: the archive of both feeds, with broken and forged
snapshots in it, written newest first and taken up in several commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywind.operators import diff, insights as I, marts
from tallywind.plans.registry import query
from tallywind.plans.warehouse import RETAINED

M, T = diff.MEMBER, diff.TEAM

query("cycle_member_deltas", "ingested", "select name, team_id, ts, d_score, d_wu from mdelta")(lambda W: W.store.read("member_delta"))
query("cycle_team_deltas", "ingested", "select team_id, ts, d_score, d_wu from tdelta")(lambda W: W.store.read("team_delta"))
query("cycle_member_daily", "ingested", "select name, team_id, day, points, wus from mdaily")(lambda W: W.store.read("member_daily"))



@query("cycle_member_monthly", "ingested", """
  with k as (select name, team_id, date '1970-01-01' + cast(day as integer) as d, points, wus from mdaily)
  select name, team_id, strftime(d, '%Y-%m') as month, cast(sum(points) as bigint) as points, cast(sum(wus) as bigint) as wus
  from k group by all""")
def cycle_member_monthly(W):
    return _named_months(W.store.read("member_monthly"))


def _named_months(df):
    from tallywind.functions import scalars as S
    name = F.date_format(F.date_from_unix_date(S.month_start_day("month").cast("int")), "yyyy-MM")
    return df.withColumn("month", name)


@query("cycle_project", "ingested", """
  with p as (select ts, cast(sum(d_score) as bigint) as points, cast(sum(d_wu) as bigint) as wus from tdelta group by ts),
  d as (select day, cast(sum(points) as bigint) as points, cast(sum(wus) as bigint) as wus from tdaily group by day)
  select 'cycle' as grain, cast(ts as varchar) as bucket, points, wus from p
  union all select 'day', cast(day as varchar), points, wus from d
  union all select 'month', strftime(date '1970-01-01' + cast(day as integer), '%Y-%m'), cast(sum(points) as bigint), cast(sum(wus) as bigint)
            from d group by 2""")
def cycle_project(W):
    grain = lambda df, name, col: df.select(F.lit(name).alias("grain"), F.col(col).cast("string").alias("bucket"), "points", "wus")
    cycle = W.store.read("project_cycle").select("ts", F.col("d_score").alias("points"), F.col("d_wu").alias("wus"))
    return (grain(cycle, "cycle", "ts").unionByName(grain(W.store.read("project_daily"), "day", "day"))
            .unionByName(grain(_named_months(W.store.read("project_monthly")), "month", "month")))


@query("cycle_ingest_audit", "ingested", """
  with m as (select ts, count(*) filter (where prev_score is null) as new_members, count(*) filter (where d_score < 0) as r from mmove group by ts),
  md as (select ts, count(*) as n from mdelta group by ts),
  t as (select ts, count(*) filter (where prev_score is null) as new_teams, count(*) filter (where d_score < 0) as r from tmove group by ts),
  td as (select ts, count(*) as n from tdelta group by ts),
  u as (select snapshot_ts as ts, count(*) as n from mpub group by 1),
  tr as (select snapshot_ts as ts, count(*) as n from tsnap group by 1)
  select good.ts, team_ts, good.ts as user_ts, coalesce(tr.n, 0) as team_rows, u.n as user_rows, cast(0 as bigint) as malformed,
         coalesce(new_members, 0) as new_members, coalesce(new_teams, 0) as new_teams, coalesce(md.n, 0) as member_deltas,
         coalesce(td.n, 0) as team_deltas, coalesce(m.r, 0) + coalesce(t.r, 0) as regressions
  from good join u on u.ts = good.ts left join tr on tr.ts = good.ts left join m on m.ts = good.ts left join md on md.ts = good.ts
       left join t on t.ts = good.ts left join td on td.ts = good.ts""")
def cycle_ingest_audit(W):
    return W.store.read("cycles")


query("cycle_quarantine", "ingested", """
  select ts, 'user' as feed, ts as snapshot_ts, user_reason as reason from judged where user_reason is not null
  union all select ts, 'team', team_ts, team_reason from judged where team_reason is not null""")(lambda W: W.store.read("quarantine"))
query("cycle_over_claims", "ingested", "select ts, team_id, excess, member_rows from claims")(lambda W: W.store.read("over_claims"))
query("cycle_member_state", "ingested", "select name, team_id, first_seen, last_seen as ts, score, wus from mstate")(
    lambda W: W.store.read("member_state"))


# --- marts of the ingested tables -----------------------------------------------------

for _k in ("last_24h", "lifetime"):
    _c = I.TEAM_KEYS[_k]
    query(f"ingested_teams_by_{_k}", "ingested", f"""
  select row_number() over (order by {_c} desc, first_seen, team_id) as position, team_id, team_name, rank,
         {_c} as value from teams""")(lambda W, k=_k: I.teams_by(W.teams, k))
for _k in ("per_day", "lifetime"):
    _c = I.DONOR_KEYS[_k]
    query(f"ingested_donors_by_{_k}", "ingested", f"""
  select row_number() over (order by {_c} desc, rank) as position, name, rank, {_c} as value from donors""")(
        lambda W, k=_k: I.donors_by(W.donors, k))
query("ingested_member_ranks", "ingested", """
  select name, team_id, rank as rank_global, tie as tie_global, rank_in_team, rank_change_24h from members""")(
    lambda W: marts.member_view(W.members).select(*M, "rank_global", "tie_global", "rank_in_team", "rank_change_24h"))


# --- after retention ------------------------------------------------------------------

_RAW_FLOOR = f"(select max(ts) // 86400 - {RETAINED['raw']} from judged)"


@query("retained_member_monthly", "retained", """
  with k as (select name, team_id, date '1970-01-01' + cast(day as integer) as d, points, wus from mdaily)
  select name, team_id, strftime(d, '%Y-%m') as month, cast(sum(points) as bigint) as points, cast(sum(wus) as bigint) as wus
  from k group by all""")
def retained_member_monthly(W):
    """Months are whole, though deltas and days they came from are gone."""
    return _named_months(W.store.read("member_monthly"))


@query("retained_member_deltas", "retained", f"""
  select name, team_id, ts, d_score, d_wu from mdelta where ts // 86400 >= {_RAW_FLOOR}""")
def retained_member_deltas(W):
    return W.store.read("member_delta")


@query("retained_member_daily", "retained", f"""
  with f as (select date_trunc('month', date '1970-01-01' + cast(max(ts) // 86400 - {RETAINED['daily']} as integer)) as d from judged)
  select name, team_id, day, points, wus from mdaily, f where day >= date_diff('day', date '1970-01-01', cast(f.d as date))""")
def retained_member_daily(W):
    return W.store.read("member_daily")
