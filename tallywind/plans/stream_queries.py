"""Queries that run through Structured Streaming or the feed parser, checked like the batch
ones: the stream must give what the tables give."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywind.operators import alerts, diff, windows
from tallywind.plans.insight_queries import _READ
from tallywind.plans import oracle as O
from tallywind.plans.registry import ORACLES, query
from tallywind.schemas import DAY, MAX_DECODED_BYTES
from tallywind.session import materialize, new_path
from tallywind.sources import adapters as A
from tallywind.sources import archive, feeds
from tallywind.streaming import alerts as alert_streams
from tallywind.streaming import ingest, runner
from tallywind.streaming import windows as stream_windows

M, T = diff.MEMBER, diff.TEAM


def _stream(W, df, label):
    """Write a frame as a table and open the table as a stream."""
    path = new_path(W.spark, label)
    df.write.parquet(path)
    runner.use_stream_conf(W.spark)
    return runner.open_table_stream(W.spark, path, df.schema)


def _ingested(W, feed, snapshot):
    """Ingest a snapshot table through the stream; the folder of its tables."""
    src, out, ckpt = (new_path(W.spark, f"{feed}-{p}") for p in ("in", "ingested", "checkpoint"))
    snapshot.repartitionByRange(4, "snapshot_ts").sortWithinPartitions("snapshot_ts").write.parquet(src)
    ingest.ingest(W.spark, feed, src, out, ckpt)
    return out


@query("stream_deltas", "hourly", "select * from mdelta")
def stream_deltas(W):
    out = _ingested(W, "member", W.raw_member_snapshot)
    return W.spark.read.parquet(f"{out}/member_delta").select(*M, "ts", "d_score", "d_wu")


_ROLLING = """
  with w as (select team_id, unnest(range(ts, ts + {span}, 3600)) as e, d_score from tdelta)
  select team_id, e as ts, cast(sum(d_score) as bigint) as points from w group by team_id, e"""


def _rolling(W, span):
    hours = stream_windows.hourly_sums(_stream(W, W.team_delta, "team-delta-in"), T)
    return stream_windows.rolling_sums(runner.collect_updates(hours, [*T, "ts"], "stream-hours"), T, span)


query("stream_rolling", "hourly", _ROLLING.format(span=DAY))(lambda W: _rolling(W, DAY))
query("stream_rolling_7d", "hourly", _ROLLING.format(span=7 * DAY))(lambda W: _rolling(W, 7 * DAY))


@query("stream_daily", "hourly", "select team_id, day, points, wus from tdaily")
def stream_daily(W):
    days = stream_windows.daily_buckets(_stream(W, W.team_delta, "team-delta-in"), T)
    return runner.collect_updates(days, [*T, "day"], "stream-daily")


@query("stream_dedup", "hourly", "select feed, snapshot_ts, sha256 from meta")
def stream_dedup(W):
    meta = W.snapshot_meta.select("feed", "snapshot_ts", "sha256")
    twice = _stream(W, meta.unionByName(meta), "meta-in")
    return runner.collect_stream(stream_windows.once_per_snapshot(twice), "stream-dedup")


@query("stream_event_rate", "hourly", ORACLES["event_rate_60s"], prelude=False)
def stream_event_rate(W):
    events = A.table(W.spark, W.sf_dir, "events").select(F.timestamp_seconds(A.epoch("ts")).alias("ts"))
    counts = stream_windows.second_counts(_stream(W, events, "events-in"), "ts")
    return stream_windows.event_rate(runner.collect_updates(counts, ["sec"], "stream-seconds"))


_ALERT_PARTS = ("milestone", "rank", "idle", "resumed", "daily")


@query("stream_alerts", "daily")
def stream_alerts(W):
    readings = alerts.team_readings(W.team_snapshot, W.team_delta, W.cycles.select("ts"))
    rules = alerts.rules_for("team", W.team_state.select(F.col("team_id").alias("target"), "first_seen"))
    path = new_path(W.spark, "readings-in")
    readings = materialize(readings, "readings")
    edges = [W.clock.first_cycle + (W.clock.at + 1 - W.clock.first_cycle) * i // 3 for i in range(4)]
    for low, high in zip(edges, edges[1:]):  # a file each, in order: rules carry on over three batches
        readings.filter((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.mode("append").parquet(path)
    runner.use_stream_conf(W.spark)
    stream = runner.open_table_stream(W.spark, path, readings.schema, files_per_batch=1)
    return alert_streams.alert_stream(rules, stream, new_path(W.spark, "stream-alerts"), new_path(W.spark, "stream-alerts-checkpoint"))


def _stream_alerts_oracle() -> str:
    bodies = []
    for kind in _ALERT_PARTS:
        text = ORACLES[f"alerts_{kind}"]
        bodies.append(f"select id, type, target, ts, cast(value as bigint) as value from ({text})")
    return " union all ".join(bodies)


ORACLES["stream_alerts"] = _stream_alerts_oracle()


@query("stream_ingest", "hourly", """
  select team_id, cast(date '1970-01-01' + cast(day as integer) as varchar) as bucket, points, wus from tdaily""")
def stream_ingest(W):
    out = _ingested(W, "team", W.team_snapshot.select("team_id", "team_name", "snapshot_ts", "score", "wus"))
    daily = W.spark.read.parquet(f"{out}/team_daily")
    return daily.select("team_id", F.date_from_unix_date("day").cast("string").alias("bucket"), "points", "wus")


# --- feed files -----------------------------------------------------------------------


def _feed(W, kind):
    return W.once(f"{kind}-feed", lambda: _write_feed(W, kind))


def _write_feed(W, kind):
    root = new_path(W.spark, f"{kind}-feed")
    if kind == "team":
        return feeds.write_feed(W.team_snapshot, "team", root, "team_name")
    return feeds.write_feed(W.raw_member_snapshot, "user", root)


def _parsed(W, kind):
    return W.once(f"{kind}-parsed", lambda: materialize(
        feeds.parse_files(feeds.open_feed(W.spark, _feed(W, kind), "*.txt"), kind), f"{kind}-parsed"))


@query("parse_team_feed", "hourly", "select team_id, team_name as name, snapshot_ts, score, wus from tsnap")
def parse_team_feed(W):
    return feeds.records(_parsed(W, "team")).select(
        "team_id", "name", feeds.snapshot_time_of().alias("snapshot_ts"), "score", "wus")


@query("parse_user_feed", "hourly", "select name, team_id, snapshot_ts, score, wus from mraw")
def parse_user_feed(W):
    return feeds.records(_parsed(W, "user")).select(
        "name", "team_id", feeds.snapshot_time_of().alias("snapshot_ts"), "score", "wus")


@query("snapshot_preamble", "hourly", """
  select snapshot_ts, strftime(to_timestamp(snapshot_ts) at time zone 'UTC', '%a %b %d %H:%M:%S GMT %Y') as feed_timestamp,
         'team' || chr(9) || 'teamname' || chr(9) || 'score' || chr(9) || 'wu' as header, count(*) as row_count,
         0 as malformed from tsnap group by snapshot_ts""")
def snapshot_preamble(W):
    return feeds.file_stats(_parsed(W, "team")).select(
        feeds.snapshot_time_of().alias("snapshot_ts"), "feed_timestamp", "header", "row_count", "malformed")


@query("parse_malformed_stats", "hourly", r"""
  with l as (select doc_id, string_split(text, chr(10)) as ls from documents),
  k as (select doc_id, ls, len(ls) - case when ls[-1] = '' then 1 else 0 end as n from l),
  h as (select doc_id, n, rtrim(coalesce(case when n >= 1 then ls[1] end, ''), chr(13)) as first_line,
               greatest(case when n >= 1 then strlen(ls[1]) else 0 end, case when n >= 2 then strlen(ls[2]) else 0 end) as longest from k),
  e as (select *, case when first_line = '' then 'empty feed' when longest > 193 then 'preamble line too long' end as error from h)
  select 'snapshot_ts=' || doc_id as file, cast(0 as bigint) as row_count,
         case when error is null then greatest(n - 2, 0) else 0 end as malformed, error from e""", prelude=False)
def parse_malformed_stats(W):
    """Document texts as a feed: their lines are no records, so all of them are counted."""
    docs = A.table(W.spark, W.sf_dir, "documents").select(
        F.concat(F.lit("snapshot_ts="), F.col("doc_id").cast("string")).alias("path"),
        F.encode("text", "UTF-8").alias("content"))
    return feeds.file_stats(feeds.parse_files(docs, "user")).select("file", "row_count", "malformed", "error")


@query("snapshot_integrity", "hourly", """
  select distinct 'team' as feed, snapshot_ts,
         case when snapshot_ts % 86400 = 0 then 'digest differs' else 'ok' end as verdict from tsnap""")
def snapshot_integrity(W):
    files = feeds.open_feed(W.spark, _feed(W, "team"), "*.txt").select(
        F.lit("team").alias("feed"), feeds.snapshot_time_of("path").alias("snapshot_ts"), "content")
    good = files.select("feed", "snapshot_ts", F.octet_length("content").cast("bigint").alias("bytes"),
                        F.sha2("content", 256).alias("sha256"))
    # Midnight snapshots carry a wrong digest in their metadata.
    meta = good.withColumn("sha256", F.when(F.col("snapshot_ts") % DAY == 0, F.sha2(F.col("sha256"), 256))
                           .otherwise(F.col("sha256")))
    return archive.integrity(files, meta, MAX_DECODED_BYTES).drop("digest", "size")
