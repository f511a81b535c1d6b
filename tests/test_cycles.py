"""The cycle ingest: one commit for both feeds, in the order of the snapshots' own times."""

import pytest
from pyspark.sql import functions as F

from tallywind.operators import diff, rollups
from tallywind.plans.warehouse import StoreWarehouse, publish_cycle, published
from tallywind.schemas import DAY, HOUR, MEMBER_SNAPSHOT, TEAM_SNAPSHOT
from tallywind.sources import snapshots as A
from tallywind.streaming import cycles as C

T0 = 1_785_628_800 - 3 * HOUR  # three hours before a midnight


def user_rows(i, extra=()):
    return [("ann", 1, T0 + i * HOUR, 100 + 10 * i, i + 1), ("bob", 2, T0 + i * HOUR, 500 + 5 * i * (i % 2), i + 1),
            *[(n, t, T0 + i * HOUR, s, 1) for n, t, s in extra]]


def team_rows(i, ahead=60):
    return [(1, "one", T0 + i * HOUR - ahead, 100 + 10 * i, i + 1), (2, f"two-{i}", T0 + i * HOUR - ahead, 600 + 5 * i * (i % 2), i + 1)]


def put(spark, root, feed, rows, spoil=lambda meta: meta):
    df = spark.createDataFrame(rows, MEMBER_SNAPSHOT if feed == "user" else TEAM_SNAPSHOT)
    A.write_archive(df, feed, root, spoil(A.snapshot_meta(df, feed)))


def both(spark, root, cycles, extra={}):
    for i in cycles:
        put(spark, root, "user", user_rows(i, extra.get(i, ())))
        put(spark, root, "team", team_rows(i))


def take(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def expected(spark, cycles):
    rows = spark.createDataFrame([r for i in cycles for r in user_rows(i)], MEMBER_SNAPSHOT)
    return diff.deltas(rows, diff.MEMBER)


def test_files_written_backwards_one_cycle_a_commit(spark, tmp):
    for i in (3, 1, 2, 0):
        both(spark, f"{tmp}/archive", [i])
    done = []
    store = C.ingest_cycles(spark, f"{tmp}/archive", f"{tmp}/out", f"{tmp}/ckpt", cycles_per_trigger=1, publish=lambda s, at: done.append(at))
    assert done == [T0 + i * HOUR for i in range(4)] and store.manifest()["seq"] == 4
    want = expected(spark, range(4))
    assert take(store.read("member_delta"), "name", "ts", "d_score", "d_wu") == take(want, "name", "ts", "d_score", "d_wu")
    assert take(store.read("member_daily"), "name", "day", "points") == take(rollups.daily(want, diff.MEMBER), "name", "day", "points")
    assert take(store.read("team_state"), "team_id", "team_name", "first_seen", "score") == [
        (1, "one", T0, 130), (2, "two-3", T0, 615)]
    assert take(store.read("cycles"), "ts", "team_ts", "new_members", "member_deltas")[0] == (T0, T0 - 60, 2, 0)
    assert C.vacuum(store) > 0 and take(store.read("member_delta"), "name", "ts", "d_score", "d_wu") == take(want, "name", "ts", "d_score", "d_wu")


def test_a_late_cycle_is_not_taken_up(spark, tmp):
    both(spark, f"{tmp}/archive", [0, 2])
    C.ingest_cycles(spark, f"{tmp}/archive", f"{tmp}/out", f"{tmp}/ckpt")
    both(spark, f"{tmp}/archive", [1])
    store = C.ingest_cycles(spark, f"{tmp}/archive", f"{tmp}/out", f"{tmp}/ckpt")
    assert store.manifest()["seq"] == 1
    assert take(store.read("member_delta"), "name", "ts", "d_score", "d_wu") == take(expected(spark, [0, 2]), "name", "ts", "d_score", "d_wu")


def test_broken_snapshots_stop_nothing(spark, tmp):
    big = 9 * 10**18
    both(spark, f"{tmp}/archive", [0, 1, 2, 3, 4, 6], {1: [("x", 1, big), ("x", 1, big)], 2: [("y", 2, -1)], 6: [("claims", 1, 10**12), ("stray", 9, 10**12)]})
    put(spark, f"{tmp}/archive", "user", user_rows(5), lambda meta: meta.withColumn("row_count", F.col("row_count") + 1))
    put(spark, f"{tmp}/archive", "team", team_rows(5))
    store = C.ingest_cycles(spark, f"{tmp}/archive", f"{tmp}/out", f"{tmp}/ckpt", max_user_rows=4)
    assert take(store.read("quarantine"), "ts", "feed", "reason") == [
        (T0 + HOUR, "user", "totals overflow"), (T0 + 2 * HOUR, "user", "invalid rows"), (T0 + 5 * HOUR, "user", "rows differ")]
    assert take(store.read("over_claims"), "ts", "team_id", "member_rows") == [(T0 + 6 * HOUR, 1, 2), (T0 + 6 * HOUR, 9, 1)]
    got = [r for r in take(store.read("member_delta"), "ts", "name", "d_score")]
    assert got == [(T0 + 3 * HOUR, "ann", 30), (T0 + 3 * HOUR, "bob", 15), (T0 + 4 * HOUR, "ann", 10), (T0 + 4 * HOUR, "bob", -15), (T0 + 6 * HOUR, "bob", 0)]
    assert [r[1] for r in take(store.read("cycles"), "ts", "user_rows")] == [2, 2, 2, 4]
    assert "claims" not in [r[0] for r in take(store.read("member_state"), "name")]


def test_a_crash_between_tables_leaves_readers_on_the_old_cycle(spark, tmp, monkeypatch):
    both(spark, f"{tmp}/archive", [0, 1])
    store = C.ingest_cycles(spark, f"{tmp}/archive", f"{tmp}/out", f"{tmp}/ckpt")
    tables = [*C.APPENDED, *C.BUCKETED]
    before = {t: take(store.read(t), *store.read(t).columns) for t in tables}
    both(spark, f"{tmp}/archive", [2, 3])
    write = C.CycleStore.write

    def breaks(self, df, table, part):
        if table == "member_daily":
            raise OSError("lost")
        write(self, df, table, part)

    monkeypatch.setattr(C.CycleStore, "write", breaks)
    with pytest.raises(Exception, match="lost"):
        C.ingest_cycles(spark, f"{tmp}/archive", f"{tmp}/out", f"{tmp}/ckpt")
    assert {t: take(store.read(t), *store.read(t).columns) for t in tables} == before
    monkeypatch.setattr(C.CycleStore, "write", write)
    C.ingest_cycles(spark, f"{tmp}/archive", f"{tmp}/out", f"{tmp}/ckpt")
    assert take(store.read("member_delta"), "name", "ts", "d_score", "d_wu") == take(expected(spark, range(4)), "name", "ts", "d_score", "d_wu")
    assert store.manifest()["seq"] == 2
    with pytest.raises(RuntimeError):
        store.commit(store.manifest())  # a second writer of the same commit


def test_marts_follow_the_newest_commit(spark, tmp, monkeypatch):
    monkeypatch.setattr(C, "FOLD_AFTER", 2)
    for i in range(3):
        both(spark, f"{tmp}/archive", [i])
    store = C.ingest_cycles(spark, f"{tmp}/archive", f"{tmp}/out", f"{tmp}/ckpt", cycles_per_trigger=1)
    assert store.manifest()["tables"]["member_state"][0].endswith("f")  # parts were merged
    with pytest.raises(LookupError):
        published(spark, f"{tmp}/out")
    publish_cycle(store, T0)
    at, now = published(spark, f"{tmp}/out")
    assert at == T0 + 2 * HOUR and take(now["donors"], "rank", "name", "score") == [(1, "bob", 500), (2, "ann", 120)]
    both(spark, f"{tmp}/archive", [3])
    C.ingest_cycles(spark, f"{tmp}/archive", f"{tmp}/out", f"{tmp}/ckpt")
    assert published(spark, f"{tmp}/out")[0] == at  # until it is published
    w = StoreWarehouse(spark, store).publish()
    at, now = published(spark, f"{tmp}/out")
    assert at == T0 + 3 * HOUR and take(now["teams"], "rank", "team_id", "team_name", "points_last_cycle") == [(1, 2, "two-3", 15), (2, 1, "one", 10)]
    assert w.clock.cycles == 4 and (T0 + 3 * HOUR) % DAY == 0


def test_listing_asks_only_for_the_dates_it_needs(spark, tmp, monkeypatch):
    both(spark, f"{tmp}/archive", [0, 4])
    asked = []
    children = A.SnapshotReader._children
    monkeypatch.setattr(A.SnapshotReader, "_children", lambda self, path, column: asked.append(path) or children(self, path, column))
    reader = A.SnapshotReader(f"{tmp}/archive", T0 + 2 * HOUR, 0)
    assert reader.initialOffset() == {"ts": T0 + 2 * HOUR} and reader.latestOffset() == {"ts": T0 + 4 * HOUR}
    assert not any("2026-08-01" in p and "user" in p for p in asked) or A.date_of(T0 + 2 * HOUR) == "2026-08-01"
    parts = reader.partitions({"ts": T0 + 3 * HOUR}, {"ts": T0 + 4 * HOUR})
    assert [p.date for p in parts] == [A.date_of(T0 + 4 * HOUR)]
    assert list(reader.read(parts[0])) == [("user", T0 + 4 * HOUR, parts[0].date), ("team", T0 + 4 * HOUR - 60, parts[0].date)]
    assert reader.partitions({"ts": T0 + 4 * HOUR}, {"ts": T0 + 4 * HOUR}) == []
