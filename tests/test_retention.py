"""Retention on a cycle store: floors, sweeping, thinning by a log that may break off."""

import os

import pytest
from pyspark.sql import functions as F

from tallywind.operators import diff, rollups
from tallywind.schemas import DAY, HOUR, MEMBER_SNAPSHOT, TEAM_SNAPSHOT
from tallywind.sources import snapshots as A
from tallywind.streaming import cycles as C
from tallywind.streaming import retention as R

T0 = 1_785_456_000 - 2 * DAY  # two days before the last of a month
STEP = 6 * HOUR


def rows_of(i):
    return [("ann", 1, T0 + i * STEP, 100 + 10 * i, i + 1), ("bob", 1, T0 + i * STEP, 50 + 3 * i, i + 1)]


def put(spark, root, cycles):
    user = spark.createDataFrame([r for i in cycles for r in rows_of(i)], MEMBER_SNAPSHOT)
    team = spark.createDataFrame([(1, "one", T0 + i * STEP, 150 + 13 * i, 2 * i + 2) for i in cycles], TEAM_SNAPSHOT)
    A.write_archive(user, "user", root)
    A.write_archive(team, "team", root)


def ingest(spark, tmp):
    return C.ingest_cycles(spark, f"{tmp}/archive", f"{tmp}/out", f"{tmp}/ckpt")


def take(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def held(tmp, feed):
    reader = A.SnapshotReader(f"{tmp}/archive", -1, 0)
    return [ts for d in reader._dates(-1) for ts in reader._times(feed, d)]


def test_retention_keeps_months_whole(spark, tmp):
    put(spark, f"{tmp}/archive", range(0, 18))
    store = ingest(spark, tmp)
    assert R.retain(store, f"{tmp}/archive", raw_days=1, daily_days=1, archive_days=1)["snapshots"] == 2 * 9
    newest = T0 + 17 * STEP
    floor = newest // DAY - 1
    # one snapshot a day and feed before the last day, all since
    assert held(tmp, "user") == held(tmp, "team") == [T0 + i * STEP for i in (0, 4, 8, *range(12, 18))]
    put(spark, f"{tmp}/archive", [5, *range(18, 26)])  # a late file and the next cycles
    store = ingest(spark, tmp)
    want = diff.deltas(spark.createDataFrame([r for i in range(26) for r in rows_of(i)], MEMBER_SNAPSHOT), diff.MEMBER)
    daily = rollups.daily(want, diff.MEMBER)
    assert take(store.read("member_monthly"), "name", "month", "points", "wus") == take(rollups.monthly(daily, diff.MEMBER), "name", "month", "points", "wus")
    assert take(store.read("member_delta"), "name", "ts", "d_score") == take(want.filter(F.col("ts") >= floor * DAY), "name", "ts", "d_score")
    low = store.manifest()["floors"]["daily"]
    assert low <= floor and take(store.read("member_daily"), "name", "day", "points") == take(daily.filter(F.col("day") >= low), "name", "day", "points")
    # folders go once no newer manifest of two reads them
    R.retain(store, f"{tmp}/archive", raw_days=1, daily_days=1, archive_days=1)
    R.retain(store, f"{tmp}/archive", now=newest + 20 * STEP, raw_days=1, daily_days=1, archive_days=1)
    days = {int(d.partition("=")[2]) for p in os.listdir(f"{tmp}/out/member_delta") for d in os.listdir(f"{tmp}/out/member_delta/{p}") if d.startswith("day=")}
    assert days and min(days) >= floor
    now = store.manifest()
    R.retain(store, f"{tmp}/archive", now=newest, raw_days=30, daily_days=300, archive_days=1)
    assert store.manifest() == now  # floors never fall


def test_a_broken_off_thinning_is_ended_by_the_next(spark, tmp, monkeypatch):
    put(spark, f"{tmp}/archive", range(0, 12))
    store = ingest(spark, tmp)
    delete = R.delete_path
    monkeypatch.setattr(R, "delete_path", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        R.retain(store, f"{tmp}/archive", archive_days=0)
    assert not store.pointer("retention")["done"] and os.path.exists(f"{tmp}/archive/_trash")
    monkeypatch.setattr(R, "delete_path", delete)
    assert R.carry_out(store) == 0 and store.pointer("retention")["done"]
    assert os.listdir(f"{tmp}/archive/_trash") == []
    # the newest cycle's snapshots stay, and the team snapshot later cycles are paired with
    assert held(tmp, "user") == [T0 + i * STEP for i in (0, 4, 8, 11)] == held(tmp, "team")
    assert R.retain(store, f"{tmp}/archive", archive_days=0)["snapshots"] == 0


def test_retention_of_an_empty_store(spark, tmp):
    assert R.retain(C.CycleStore(spark, f"{tmp}/out"), f"{tmp}/archive") == {"snapshots": 0, "folders": 0}
