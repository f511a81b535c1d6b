"""Streams give what the tables give, whether or not they were stopped on the way."""

import random

import pytest
from pyspark.sql import functions as F

from tallywind.operators import diff, rollups
from tallywind.schemas import DAY, HOUR, TEAM_SNAPSHOT
from tallywind.session import path_exists
from tallywind.sources import archive, sinks
from tallywind.streaming import ingest
from tallywind.streaming.differencing import LatestTotals, difference, seed_from

T = ["team_id"]
T0 = 1_785_628_800


def snapshots(spark, cycles, seed=1):
    rnd, total, out = random.Random(seed), {t: 1000 * t for t in range(1, 7)}, []
    for i in cycles:
        for t in total:
            total[t] += rnd.randrange(0, 50)
            out.append((t, f"team {t}", T0 + i * HOUR, total[t], i + 1))
    return spark.createDataFrame(out, TEAM_SNAPSHOT)


def write_files(df, path, mode="append"):
    for ts in sorted(r[0] for r in df.select("snapshot_ts").distinct().collect()):
        df.filter(F.col("snapshot_ts") == ts).coalesce(1).write.mode(mode).parquet(path)


def result(spark, out):
    cols = ["team_id", "ts", "d_score", "d_wu"]
    delta = sorted(map(tuple, spark.read.parquet(f"{out}/team_delta").select(*cols).collect()))
    daily = sorted(map(tuple, spark.read.parquet(f"{out}/team_daily").select("team_id", "day", "points", "wus").collect()))
    months = sorted(map(tuple, spark.read.parquet(f"{out}/team_monthly").select("team_id", "month", "points").collect()))
    return delta, daily, months


def expected(df):
    d = diff.deltas(df, T)
    daily = rollups.daily(d, T)
    take = lambda x, *c: sorted(map(tuple, x.select(*c).collect()))
    return (take(d, "team_id", "ts", "d_score", "d_wu"), take(daily, "team_id", "day", "points", "wus"),
            take(rollups.monthly(daily, T), "team_id", "month", "points"))


def test_ingest_in_pieces_equals_batch(spark, tmp):
    df = snapshots(spark, range(30)).cache()
    src, out, ckpt = f"{tmp}/src", f"{tmp}/out", f"{tmp}/ckpt"
    published = []
    run = lambda: ingest.ingest(spark, "team", src, out, ckpt, files_per_batch=6,
                                publish=lambda s, at: published.append(at))
    write_files(df.filter(F.col("snapshot_ts") < T0 + 12 * HOUR), src)
    run()
    write_files(df.filter(F.col("snapshot_ts") >= T0 + 12 * HOUR), src)
    run()
    assert result(spark, out) == expected(df)
    assert published == sorted(published) and published[-1] == T0 + 29 * HOUR
    before = len(published)
    run()  # nothing new: nothing is written or published
    assert len(published) == before and result(spark, out) == expected(df)
    audit = spark.read.parquet(f"{out}/team_cycles")
    assert audit.agg(F.sum("new_entities")).first()[0] == 6 and audit.count() == 30


def test_a_new_checkpoint_seeded_from_tables_goes_on(spark, tmp):
    df = snapshots(spark, range(16)).cache()
    src, out = f"{tmp}/src", f"{tmp}/out"
    write_files(df.filter(F.col("snapshot_ts") < T0 + 10 * HOUR), f"{src}-1")
    ingest.ingest(spark, "team", f"{src}-1", out, f"{tmp}/ckpt-1")
    state = ingest.restore_state(spark, out, "team")
    write_files(df.filter(F.col("snapshot_ts") >= T0 + 10 * HOUR), f"{src}-2")
    ingest.ingest(spark, "team", f"{src}-2", f"{out}-2", f"{tmp}/ckpt-2", state=state)
    got = sorted(result(spark, out)[0] + result(spark, f"{out}-2")[0])
    assert got == expected(df)[0]


def test_late_and_repeated_cycles_are_ignored(spark, tmp):
    df = snapshots(spark, range(6)).cache()
    src = f"{tmp}/src"
    write_files(df, src)
    write_files(df.filter(F.col("snapshot_ts") == T0 + 2 * HOUR).withColumn("score", F.col("score") + 999), src)
    out, ckpt = f"{tmp}/out", f"{tmp}/ckpt"
    ingest.ingest(spark, "team", src, out, ckpt, files_per_batch=1)
    assert result(spark, out)[0] == expected(df)[0]


def test_a_late_cycle_is_ignored_for_entities_that_were_absent(spark, tmp):
    """Team 6 is missing in cycle 4; a second cycle 3 after it must not be applied to it alone."""
    df = snapshots(spark, range(6)).filter(f"NOT (team_id = 6 AND snapshot_ts >= {T0 + 4 * HOUR})").cache()
    late = df.filter(F.col("snapshot_ts") == T0 + 3 * HOUR).withColumn("score", F.col("score") + 999)
    write_files(df, f"{tmp}/src")
    write_files(late, f"{tmp}/src")
    ingest.ingest(spark, "team", f"{tmp}/src", f"{tmp}/out", f"{tmp}/ckpt", files_per_batch=1)
    assert result(spark, f"{tmp}/out")[0] == expected(df)[0]


def test_snapshots_with_bad_or_too_many_rows_go_to_quarantine_whole(spark, tmp):
    df = snapshots(spark, range(5)).cache()
    bad = df.filter((F.col("snapshot_ts") == T0 + HOUR) & (F.col("team_id") < 3)).withColumn("score", -F.col("score"))
    many = df.filter(F.col("snapshot_ts") == T0 + 3 * HOUR).withColumn("team_id", F.col("team_id") + 100)
    write_files(df.unionByName(bad).unionByName(many), f"{tmp}/src")
    ingest.ingest(spark, "team", f"{tmp}/src", f"{tmp}/out", f"{tmp}/ckpt", max_rows=10)
    kept = df.filter(~F.col("snapshot_ts").isin(T0 + HOUR, T0 + 3 * HOUR))
    assert result(spark, f"{tmp}/out")[0] == expected(kept)[0]
    held = spark.read.parquet(f"{tmp}/out/team_quarantine").groupBy("snapshot_ts", "reason").count().collect()
    assert {tuple(r) for r in held} == {(T0 + HOUR, "invalid rows", 8), (T0 + 3 * HOUR, "too many rows", 12)}


def test_a_batch_differenced_against_a_table_of_totals(spark):
    df = snapshots(spark, range(8)).cache()
    old, new = df.filter(F.col("snapshot_ts") < T0 + 5 * HOUR), df.filter(F.col("snapshot_ts") >= T0 + 5 * HOUR)
    got = difference(new, T, seed_from(diff.latest_state(old, T)), T0 + 4 * HOUR).filter("is_delta").select("team_id", "ts", "d_score")
    assert sorted(map(tuple, got.collect())) == [x[:3] for x in expected(df)[0] if x[1] >= T0 + 5 * HOUR]


def test_latest_totals_fold_and_ignore_a_try_that_failed(spark, tmp, monkeypatch):
    from tallywind.streaming import differencing
    monkeypatch.setattr(differencing, "FOLD_AFTER", 2)
    table = LatestTotals(spark, f"{tmp}/latest", "team_id int", T)
    row = lambda ts, score: spark.createDataFrame([(1, ts, score, 1), (ts, ts, score, 2)], "team_id int, ts bigint, score bigint, wus bigint")
    for i in range(7):
        table.write(row(100 + i, 10 * i), i)
        table.write(row(100 + i, 10 * i), i)  # the same batch again
    held = {r["team_id"]: (r["ts"], r["score"]) for r in table.before(7).collect()}
    assert held == {1: (106, 60), **{100 + i: (100 + i, 10 * i) for i in range(7)}}
    assert {r["team_id"]: r["score"] for r in table.before(6).collect()}[1] == 50


def test_writing_a_cycle_again_replaces_it(spark, tmp):
    d = diff.deltas(snapshots(spark, range(5)), T)
    sinks.write_by_day(d, f"{tmp}/t")
    once = d.filter(F.col("ts") == T0 + 3 * HOUR)
    sinks.write_by_day(once.withColumn("d_score", F.lit(7).cast("bigint")), f"{tmp}/t")
    got = spark.read.parquet(f"{tmp}/t")
    assert got.count() == d.count()
    assert {r[0] for r in got.filter(F.col("ts") == T0 + 3 * HOUR).select("d_score").collect()} == {7}


def test_retention_drops_whole_days(spark, tmp):
    d = diff.deltas(snapshots(spark, range(60)), T)
    sinks.write_by_day(d, f"{tmp}/t")
    cut = T0 // DAY + 1
    gone = archive.delete_partitions(spark, f"{tmp}/t", "day", lambda v: int(v) >= cut)
    assert gone == 1 and not path_exists(spark, f"{tmp}/t/day={cut - 1}")
    assert spark.read.parquet(f"{tmp}/t").agg(F.min("day")).first()[0] == cut
    assert ingest.rows_since(d, cut).agg(F.min("ts")).first()[0] >= cut * DAY


def test_export_refuses_hourly(spark, tmp):
    s = spark.createDataFrame([(T0, 5, 1)], "bucket_ts bigint, points bigint, wus bigint")
    with pytest.raises(ValueError):
        sinks.export_history(s, "hourly", f"{tmp}/x")
    sinks.export_history(s, "daily", f"{tmp}/x")
    assert spark.read.text(f"{tmp}/x").collect()[1][0] == "2026-08-02T00:00:00.000Z,5,1"
