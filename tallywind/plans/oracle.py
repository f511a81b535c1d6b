"""SQL prelude shared by the oracle texts: each world's tables as one WITH clause.

Written independently of the DataFrame code, straight from the rules: a global
``row_number`` for ranks, conditional sums for windows.
"""

from __future__ import annotations

_HOURLY = """
base as (
  select 'u' || user_id as name,
         case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3
                         when 'signup' then 4 else 5 end as team_id,
         event_type as team_name,
         (cast(floor(epoch(ts) / 3600) as bigint) + 1) * 3600 as snapshot_ts,
         {sign} cast(round(value * 100) as bigint) as pts, cast(1 as bigint) as units,
         case when event_type = 'purchase' then 1 else 0 end as unattributed
  from events)"""

_DAILY = """
base as (
  select 'c' || o_custkey as name, s_nationkey as team_id, n_name as team_name,
         (cast(floor(epoch(l_shipdate) / 86400) as bigint) + 1) * 86400 as snapshot_ts,
         cast(round(l_extendedprice * 100) as bigint) as pts, cast(l_quantity as bigint) as units,
         0 as unattributed
  from lineitem join orders on l_orderkey = o_orderkey
       join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)"""

_FEEDS = """,
feed as (
  select name, team_id, snapshot_ts, cast(sum(p) over w as bigint) as score, cast(sum(u) over w as bigint) as wus
  from (select name, team_id, snapshot_ts, sum(pts) as p, sum(units) as u from base group by all)
  window w as (partition by name, team_id order by snapshot_ts)),
tsnap as (
  select team_id, team_name, snapshot_ts, cast(sum(p) over w as bigint) as score, cast(sum(u) over w as bigint) as wus
  from (select team_id, min(team_name) as team_name, snapshot_ts, sum(pts + unattributed) as p, sum(units) as u
        from base group by team_id, snapshot_ts)
  window w as (partition by team_id order by snapshot_ts))"""

_RAW = {
    "plain": ",\nmraw as (select * from feed)",
    "split": """,
mraw as (select name, team_id, snapshot_ts, score // 2 as score, wus from feed
         union all select name, team_id, snapshot_ts, score - score // 2, 0 from feed)""",
    "forged": """,
mraw as (select * from feed
         union all select distinct 'forged', 1, snapshot_ts, 1000000000000, 1 from feed
                   where snapshot_ts % 86400 = 0 and team_id = 1
         union all select distinct 'stray', 99, snapshot_ts, 1000000000000, 1 from feed
                   where snapshot_ts % 86400 = 0)""",
}

#: Both feeds as an archive with broken snapshots, paired, checked and reconciled.
_INGESTED = """,
mpub as (select * from feed
         union all select distinct 'forged', 1, snapshot_ts, 1000000000000, 1 from feed
                   where snapshot_ts % 86400 = 0 and team_id = 1
         union all select distinct 'stray', 99, snapshot_ts, 1000000000000, 1 from feed
                   where snapshot_ts % 86400 = 0),
tpub as (select distinct snapshot_ts as src, unnest(case (snapshot_ts // 3600) % 12 when 5 then [] when 7 then [snapshot_ts - 60, snapshot_ts - 600]
                                                    else [snapshot_ts - 60] end) as team_ts from tfeed),
paired as (select c.ts, max(team_ts) as team_ts from (select distinct snapshot_ts as ts from mpub) c join tpub on team_ts <= ts group by c.ts),
judged as (
  select ts, team_ts,
    case when (ts // 3600) % 24 = 3 then case (ts // 86400) % 5 when 0 then 'invalid rows' when 1 then 'totals overflow'
         when 3 then 'no metadata' when 4 then 'rows differ' end end as user_reason,
    case when (team_ts + 60) % 86400 = 10800 and ((team_ts + 60) // 86400) % 5 = 2 then 'digest differs' end as team_reason from paired),
good as (select ts, team_ts from judged where user_reason is null and team_reason is null),
tsnap as (select team_id, team_name, ts as snapshot_ts, score, wus from good join tpub on tpub.team_ts = good.team_ts join tfeed on snapshot_ts = src),
claims as (
  select m.snapshot_ts as ts, m.team_id, cast(sum(score) - coalesce(max(granted), 0) as bigint) as excess, count(*) as member_rows
  from mpub m join good on good.ts = m.snapshot_ts
       left join (select snapshot_ts, team_id, sum(score) as granted from tsnap group by all) g on g.snapshot_ts = m.snapshot_ts and g.team_id = m.team_id
  group by m.snapshot_ts, m.team_id having sum(score) - coalesce(max(granted), 0) > 500000000000),
mraw as (select m.* from mpub m join good on good.ts = m.snapshot_ts
         where not exists (select 1 from claims where claims.ts = m.snapshot_ts and claims.team_id = m.team_id))"""

_REST = """,
msnap as (select name, team_id, snapshot_ts, cast(sum(score) as bigint) as score, cast(sum(wus) as bigint) as wus
          from mraw group by all),
cycles as (select distinct snapshot_ts as ts from mraw),
newest as (select max(ts) as at_ts from cycles),
clock0 as (
  select any_value(at_ts) as at_ts, min(ts) as first_cycle, count(*) as n_cycles,
         max(ts) filter (where ts < at_ts) as prev_at,
         min(ts) filter (where ts > at_ts - 604800) as window_first,
         count(*) filter (where ts > at_ts - 604800) as window_cycles,
         max(ts) filter (where ts > at_ts - 604800 and ts <= at_ts - 86400) as baseline
  from cycles, newest),
clock as (
  select *, at_ts - at_ts % 86400 as day0,
         (at_ts // 86400 - (at_ts // 86400 + 4) % 7) * 86400 as week0,
         cast(epoch(date_trunc('month', to_timestamp(at_ts) at time zone 'UTC')) as bigint) as month0,
         least(604800000000000,
               (at_ts - window_first) * 1000000000
               + case when window_first <> first_cycle and window_cycles > 1
                      then (at_ts - window_first) * 1000000000 // (window_cycles - 1) else 0 end) as covered_ns
  from clock0),
mmove as (
  select *, score - coalesce(prev_score, 0) as d_score, wus - coalesce(prev_wus, 0) as d_wu
  from (select *, snapshot_ts as ts, lag(score) over w as prev_score, lag(wus) over w as prev_wus from msnap
        window w as (partition by name, team_id order by snapshot_ts))),
tmove as (
  select *, score - coalesce(prev_score, 0) as d_score, wus - coalesce(prev_wus, 0) as d_wu
  from (select *, snapshot_ts as ts, lag(score) over w as prev_score, lag(wus) over w as prev_wus from tsnap
        window w as (partition by team_id order by snapshot_ts))),
mdelta as (select name, team_id, ts, d_score, d_wu from mmove
           where prev_score is not null and (prev_score <> 0 or prev_wus <> 0) and (d_score <> 0 or d_wu <> 0)),
tdelta as (select team_id, ts, d_score, d_wu from tmove
           where prev_score is not null and (prev_score <> 0 or prev_wus <> 0) and (d_score <> 0 or d_wu <> 0)),
mstate as (select name, team_id, min(snapshot_ts) as first_seen, max(snapshot_ts) as last_seen,
                  arg_max(score, snapshot_ts) as score, arg_max(wus, snapshot_ts) as wus
           from msnap group by name, team_id),
tstate as (select team_id, arg_max(team_name, snapshot_ts) as team_name, min(snapshot_ts) as first_seen,
                  max(snapshot_ts) as last_seen, arg_max(score, snapshot_ts) as score, arg_max(wus, snapshot_ts) as wus
           from tsnap group by team_id),
mwin as (
  select name, team_id,
    cast(sum(case when ts = at_ts then d_score else 0 end) as bigint) as points_last_cycle,
    cast(sum(case when ts > at_ts - 86400 then d_score else 0 end) as bigint) as points_last_24h,
    cast(sum(case when ts > at_ts - 604800 then d_score else 0 end) as bigint) as points_last_7d,
    cast(sum(case when ts >= day0 then d_score else 0 end) as bigint) as points_today_utc,
    cast(sum(case when ts >= week0 then d_score else 0 end) as bigint) as points_this_week_utc,
    cast(sum(case when ts >= month0 then d_score else 0 end) as bigint) as points_this_month_utc
  from mdelta, clock group by name, team_id),
twin as (
  select team_id,
    cast(sum(case when ts = at_ts then d_score else 0 end) as bigint) as points_last_cycle,
    cast(sum(case when ts > at_ts - 86400 then d_score else 0 end) as bigint) as points_last_24h,
    cast(sum(case when ts > at_ts - 604800 then d_score else 0 end) as bigint) as points_last_7d,
    cast(sum(case when ts >= day0 then d_score else 0 end) as bigint) as points_today_utc,
    cast(sum(case when ts >= week0 then d_score else 0 end) as bigint) as points_this_week_utc,
    cast(sum(case when ts >= month0 then d_score else 0 end) as bigint) as points_this_month_utc
  from tdelta, clock group by team_id),
mobs as (
  select s.name, s.team_id, s.first_seen, s.last_seen, s.score, s.wus, {wincols},
    case when s.first_seen <= window_first then covered_ns else (at_ts - s.first_seen) * 1000000000 end as observed_ns
  from mstate s left join mwin w on s.name = w.name and s.team_id = w.team_id, clock),
tobs as (
  select s.team_id, s.team_name, s.first_seen, s.last_seen, s.score, s.wus, {wincols},
    case when s.first_seen <= window_first then covered_ns else (at_ts - s.first_seen) * 1000000000 end as observed_ns
  from tstate s left join twin w on s.team_id = w.team_id, clock),
mprod as (select *, {rates} from mobs),
tprod as (select *, {rates} from tobs),
mthen as (
  select name, team_id, first_seen, greatest(score - points_last_24h, 0) as total_then,
         row_number() over (order by greatest(score - points_last_24h, 0) desc, first_seen, name, team_id) as rank_then
  from mprod, clock where first_seen <= baseline),
tthen as (
  select team_id,
         row_number() over (order by greatest(score - points_last_24h, 0) desc, first_seen, team_id) as rank_then
  from tprod, clock where first_seen <= baseline),
mranked as (
  select *, row_number() over (order by score desc, first_seen, name, team_id) as rank,
         count(*) over (partition by score) as tie,
         row_number() over (partition by team_id order by score desc, first_seen, name) as rank_in_team,
         row_number() over (partition by name order by score desc, first_seen, team_id) as rank_in_name
  from mprod),
members as (
  select r.*, rank_then - rank as rank_change_24h, r.first_seen > baseline as arrived_24h
  from mranked r left join mthen t on r.name = t.name and r.team_id = t.team_id, clock),
mcount as (select team_id, count(*) as members_total, count(*) filter (where points_last_7d > 0) as members_active
           from mprod group by team_id),
teams as (
  select r.*, rank_then - rank as rank_change_24h, r.first_seen > baseline as arrived_24h,
         coalesce(members_total, 0) as members_total, coalesce(members_active, 0) as members_active
  from (select *, row_number() over (order by score desc, first_seen, team_id) as rank,
               count(*) over (partition by score) as tie from tprod) r
       left join tthen t on r.team_id = t.team_id left join mcount c on r.team_id = c.team_id, clock),
dsum as (
  select name, cast(sum(score) as bigint) as score, cast(sum(wus) as bigint) as wus, count(*) as team_count,
         min(first_seen) as first_seen, {sumcols}, max(observed_ns) as observed_ns
  from mprod group by name),
dprod as (select *, {rates}, team_count > {shared} as likely_not_a_person from dsum),
dthen as (
  select name, row_number() over (order by sum(total_then) desc, min(first_seen), name) as rank_then
  from mthen group by name),
donors as (
  select r.*, rank_then - rank as rank_change_24h
  from (select *, row_number() over (order by score desc, first_seen, name) as rank,
               count(*) over (partition by score) as tie from dprod) r
       left join dthen t on r.name = t.name),
mdaily as (select name, team_id, ts // 86400 as day, cast(sum(d_score) as bigint) as points,
                  cast(sum(d_wu) as bigint) as wus from mdelta group by all),
tdaily as (select team_id, ts // 86400 as day, cast(sum(d_score) as bigint) as points,
                  cast(sum(d_wu) as bigint) as wus from tdelta group by all),
meta as (
  select feed, snapshot_ts, snapshot_ts + 30 as fetched_ts, length(feed || ':' || snapshot_ts) as bytes,
         sha256(feed || ':' || snapshot_ts) as sha256
  from (select 'user' as feed, ts as snapshot_ts from cycles
        union all select 'team', ts - 60 from cycles where (ts // 3600) % 12 <> 5
        union all select 'team', ts - 600 from cycles where (ts // 3600) % 12 = 7)),
grp as (
  select 'country' as group_kind, cast(r_regionkey as varchar) as code, r_name as group_name, n_nationkey as team_id
  from nation join region on n_regionkey = r_regionkey
  union all select 'topic', 'ends-' || right(n_name, 1), 'ends-' || right(n_name, 1), n_nationkey from nation
  union all select 'topic', 'length-' || length(n_name), 'length-' || length(n_name), n_nationkey from nation)
"""

WINCOLS = ["points_last_cycle", "points_last_24h", "points_last_7d", "points_today_utc",
           "points_this_week_utc", "points_this_month_utc"]


def per_day(points: str, span: str) -> str:
    return (f"case when {span} >= 604800000000000 then ({points} + case when {points} < 0 then -3 else 3 end) // 7 "
            f"when {span} <= 0 then 0 else cast(round(cast({points} as double) / "
            f"(cast({span} as double) / 86400000000000.0)) as bigint) end")


def per_wu(points: str, wus: str) -> str:
    return f"case when {wus} > 0 then ({points} + {wus} // 2) // {wus} else 0 end"


RATES = (f"{per_day('points_last_7d', 'observed_ns')} as points_per_day_7d_avg, "
         f"{per_day('points_last_24h', 'least(observed_ns, 86400000000000)')} as points_per_day_24h_avg, "
         f"{per_wu('score', 'wus')} as points_per_wu")


def prelude(world: str) -> str:
    base = _DAILY if world == "daily" else _HOURLY.replace(
        "{sign}", "case when event_type = 'error' then -1 else 1 end *" if world == "corrections" else "")
    raw = _RAW[world if world in _RAW else "plain"]
    rest = (_REST.replace("{rates}", RATES)
            .replace("{wincols}", ", ".join(f"coalesce({c}, 0) as {c}" for c in WINCOLS))
            .replace("{sumcols}", ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in WINCOLS))
            .replace("{shared}", "20" if world == "daily" else "50"))
    if world in ("ingested", "retained"):
        feeds = _FEEDS.replace("tsnap as (", "tfeed as (") + _INGESTED
        return "with" + base + feeds + rest.replace("cycles as (select distinct snapshot_ts as ts from mraw)", "cycles as (select ts from good)")
    return "with" + base + _FEEDS + raw + rest


def sql(world: str, body: str) -> str:
    """A full oracle text: the world's prelude and a final SELECT (which may add CTEs)."""
    body = body.strip()
    if body.startswith("with "):
        return prelude(world) + ", " + body[len("with "):]
    return prelude(world) + body


PRODUCTION = ("score as points_total, wus as wus_total, " + ", ".join(WINCOLS)
              + ", points_per_day_7d_avg, points_per_day_24h_avg, points_per_wu")


def overtake(sp: str, sr: str, op: str, orate: str, now: str) -> str:
    """Three select items: points_gap, overtake_days, overtake_ts."""
    raw = (f"case when (case when {sp} > {op} then {orate} - {sr} else {sr} - {orate} end) > 0 then "
           f"cast(abs({sp} - {op}) as double) / cast((case when {sp} > {op} then {orate} - {sr} "
           f"else {sr} - {orate} end) as double) end")
    days = f"case when {sp} = {op} then 0.0 when ({raw}) <= 3650 then round(({raw}) * 100) / 100 end"
    return (f"abs({sp} - {op}) as points_gap, {days} as overtake_days, "
            f"{now} + cast(round(({days}) * 86400.0) as bigint) as overtake_ts")
