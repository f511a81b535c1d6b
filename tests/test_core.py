"""Differencing, windows, ranks, rollups and their brute-force checks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallywind.functions import scalars as S
from tallywind.operators import activity, diff, marts, pairing, quantiles, rollups, windows
from tallywind.operators import history as H
from tallywind.operators import ranking as R
from tallywind.schemas import DAY, HOUR, NANOS, WEEK
from tallywind.sources import archive

M, T = ["name", "team_id"], ["team_id"]
T0 = 1_785_672_547  # 2026-08-02 12:09:07 UTC, a Sunday


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- differencing ---------------------------------------------------------------------


def test_first_sighting_idle_and_carry_forward(members):
    snap = members([("a", 1, 100, 10, 1), ("b", 1, 100, 5, 1), ("a", 1, 200, 10, 1),
                    ("a", 1, 300, 25, 2), ("b", 1, 400, 9, 1)])
    assert rows(diff.deltas(snap), "name", "ts", "d_score", "d_wu") == [("a", 300, 15, 1), ("b", 400, 4, 0)]


def test_zero_total_suppresses_the_next_delta(members):
    snap = members([("a", 1, 100, 0, 0), ("a", 1, 200, 50, 2), ("a", 1, 300, 60, 3)])
    assert rows(diff.deltas(snap), "ts", "d_score") == [(300, 10)]


def test_duplicates_are_summed(members):
    snap = diff.sum_duplicates(members([("a", 1, 100, 10, 1), ("a", 1, 100, 7, 2), ("a", 1, 200, 30, 4)]))
    assert rows(snap, "snapshot_ts", "score", "wus") == [(100, 17, 3), (200, 30, 4)]
    assert rows(diff.deltas(snap), "ts", "d_score", "d_wu") == [(200, 13, 1)]


def test_regressions_are_kept_and_sampled(members):
    first = [(f"m{i}", 1, 100, 1000, 1) for i in range(20)]
    second = [(f"m{i}", 1, 200, 1000 - i, 1) for i in range(20)]
    snap = members(first + second)
    bad = diff.regressions(snap, M)
    s = diff.regression_samples(bad, M)
    assert rows(s, "sample_no", "name", "d_score", "regressions") == [
        (i + 1, f"m{19 - i}", i - 19, 19) for i in range(5)]
    assert diff.deltas(snap).filter("d_score < 0").count() == 19


def test_rename_keeps_identity(teams):
    snap = teams([(7, "old", 100, 5, 1), (7, "new", 200, 9, 2)])
    assert rows(diff.latest_state(snap, T, "team_name"), "team_id", "team_name", "first_seen", "score") == [
        (7, "new", 100, 9)]
    assert rows(diff.deltas(snap, T), "d_score") == [(4,)]


def test_overflowing_and_negative_snapshots_are_refused(teams, members):
    big = (1 << 63) - 1
    t = teams([(1, "a", 100, big, 1), (2, "b", 100, 1, 1), (1, "a", 200, 5, 1)])
    m = members([("x", 1, 100, 5, 1), ("x", 1, 200, -5, 1)])
    got = {(r["snapshot_ts"], r["feed"]): r["verdict"] for r in diff.validate_totals(t, m).collect()}
    assert got == {(100, "team"): "score", (200, "team"): "ok", (100, "user"): "ok", (200, "user"): "score"}


def test_forged_record_is_found_and_dropped(teams, members):
    t = teams([(1, "a", 100, 500, 1), (2, "b", 100, 900, 1)])
    m = members([("x", 1, 100, 100, 1), ("forged", 1, 100, 1_000_000_000_000, 1), ("y", 2, 100, 900, 1),
                 ("stray", 9, 100, 200_000_000, 1)])
    over = diff.reconcile(t, m, 100_000_000)
    assert rows(over, "team_id", "excess", "member_rows") == [(1, 999_999_999_600, 2), (9, 200_000_000, 1)]
    assert rows(diff.drop_over_claims(m, over), "name") == [("y",)]


def test_ordinals_follow_first_sight_and_extend(spark):
    known = spark.createDataFrame([("b", 1, 10, 0), ("a", 1, 20, 1)], "name string, team_id int, first_seen bigint, ordinal bigint")
    seen = spark.createDataFrame([("a", 1, 20), ("b", 1, 10), ("d", 1, 30), ("c", 1, 30)], "name string, team_id int, first_seen bigint")
    assert rows(diff.extend_ordinals(known, seen, M), "ordinal", "name") == [(0, "b"), (1, "a"), (2, "c"), (3, "d")]


# --- windows --------------------------------------------------------------------------


def test_windows_match_brute_force(spark):
    rnd, rowsets, start = random.Random(21), [], T0
    cycles = [start + i * HOUR + i * 7 for i in range(400)]
    for e in range(8):
        for c in cycles:
            if rnd.randrange(1 << 30) % 3 == 0:
                rowsets.append((f"m{e}", 1, c, rnd.randrange(1 << 30) % 10_000 - 500, 1))
    delta = spark.createDataFrame(rowsets, "name string, team_id int, ts bigint, d_score bigint, d_wu bigint")
    cyc = spark.createDataFrame([(c,) for c in cycles], "ts bigint")
    for at in (cycles[-1], cycles[200], cycles[30]):
        clock = windows.read_clock(cyc, at)
        got = {r["name"]: r for r in windows.window_sums(delta, M, clock).collect()}
        d = dt.datetime.fromtimestamp(at, dt.timezone.utc)
        day = d.replace(hour=0, minute=0, second=0)
        starts = {"points_today_utc": day, "points_this_month_utc": day.replace(day=1),
                  "points_this_week_utc": day - dt.timedelta(days=(d.weekday() + 1) % 7)}
        for e in range(8):
            mine = [r for r in rowsets if r[0] == f"m{e}" and r[2] <= at]
            g = got[f"m{e}"]
            assert g["points_last_24h"] == sum(r[3] for r in mine if r[2] > at - DAY)
            assert g["points_last_7d"] == sum(r[3] for r in mine if r[2] > at - WEEK)
            assert g["points_last_cycle"] == sum(r[3] for r in mine if r[2] == at)
            for col, t in starts.items():
                assert g[col] == sum(r[3] for r in mine if r[2] >= t.timestamp()), (col, at)


@pytest.mark.parametrize("points,span,want", [
    (51_364_842, WEEK, 7_337_835), (49_559_068, WEEK, 7_079_867), (123_079_584_757, WEEK, 17_582_797_822),
    (7, WEEK, 1), (10, WEEK, 1), (11, WEEK, 2), (0, WEEK, 0), (3, WEEK, 0), (4, WEEK, 1), (-11, WEEK, -2),
    (700, DAY, 700), (700, DAY // 2, 1400), (0, 0, 0), (5, 0, 0)])
def test_per_day(spark, points, span, want):
    df = spark.createDataFrame([(points, span * NANOS)], "p bigint, s bigint")
    assert df.select(S.per_day("p", "s")).first()[0] == want


def test_observed_span(spark):
    cycles = [T0 + i * HOUR for i in range(170)]
    clock = windows.read_clock(spark.createDataFrame([(c,) for c in cycles], "ts bigint"))
    seen = spark.createDataFrame([(cycles[0],), (cycles[145],), (cycles[169],)], "f bigint")
    got = [r[0] // NANOS for r in seen.select(windows.observed_ns(F.col("f"), clock)).collect()]
    assert got == [WEEK, 24 * HOUR, 0]
    young = windows.read_clock(spark.createDataFrame([(c,) for c in cycles[:10]], "ts bigint"))
    assert young.covered_ns == 9 * HOUR * NANOS and young.baseline is None


def test_trailing_counts_match_brute_force(spark):
    rnd = random.Random(3)
    secs = sorted(T0 + rnd.randrange(9000) for _ in range(3000))
    got = {r["sec"]: r["events_in_window"] for r in windows.trailing_counts(
        spark.createDataFrame([(s,) for s in secs], "sec bigint"), tile=600).collect()}
    assert got == {s: sum(1 for x in secs if s - 60 < x <= s) for s in set(secs)}


# --- ranking --------------------------------------------------------------------------


def test_positions_are_a_permutation_with_a_third_tied(spark):
    df = spark.range(60_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id") % 1000).cast("bigint").alias("v"),
        F.when(F.col("id") % 3 == 1, 1).otherwise(F.col("id") % 40).cast("int").alias("g"))
    got = R.with_position(df, [F.col("v").desc(), F.col("id")], "p").select("id", "v", "p").toPandas()
    want = got.sort_values(["v", "id"], ascending=[False, True])
    assert want["p"].tolist() == list(range(1, 60_001))
    grp = R.with_group_position(df, ["g"], [F.col("v").desc(), F.col("id")], "p").toPandas()
    for _, part in grp.groupby("g"):
        assert part.sort_values(["v", "id"], ascending=[False, True])["p"].tolist() == list(range(1, len(part) + 1))


def test_a_plateau_is_spread_over_partitions(spark):
    """All rows at one score: the unique second key still splits the range shuffle."""
    df = spark.range(200_000).select(F.col("id"), F.lit(7).cast("bigint").alias("v"))
    parts = df.repartitionByRange(16, F.col("v").desc(), F.col("id")).groupBy(F.spark_partition_id()).count()
    counts = [r["count"] for r in parts.collect()]
    assert len(counts) == 16 and max(counts) < 3 * 200_000 / 16


def test_tie_width(spark):
    df = spark.createDataFrame([(v,) for v in (100, 90, 90, 90, 50, 50, 7, 7, 7, 7, 7)], "score bigint")
    assert {(r["score"], r["tie"]) for r in R.with_tie_width(df, "score").collect()} == {
        (100, 1), (90, 3), (50, 2), (7, 5)}


def _ranked(snap, at=None):
    clock = windows.read_clock(windows.cycles_of(snap), at)
    prod = windows.production(diff.latest_state(snap), diff.deltas(snap), M, clock)
    m = marts.member_mart(prod, clock)
    return {r["name"]: r for r in m.collect()}, {r["name"]: r for r in marts.donor_mart(m, clock).collect()}


def test_rank_change_moves(members):
    t1 = T0 + 25 * HOUR
    m, d = _ranked(members([(n, 1, T0, s, 1) for n, s in (("a", 100), ("b", 200), ("c", 300))] + [("a", 1, t1, 1000, 2)]))
    assert {n: r["rank_change_24h"] for n, r in m.items()} == {"a": 2, "b": -1, "c": -1}
    assert {n: r["rank_change_24h"] for n, r in d.items()} == {"a": 2, "b": -1, "c": -1}


def test_rank_change_is_unknown_for_the_new(members):
    t1 = T0 + 25 * HOUR
    m, d = _ranked(members([("a", 1, T0, 100, 1), ("b", 1, T0, 200, 1), ("new", 1, t1, 9000, 1)]))
    assert m["new"]["rank_change_24h"] is None and d["new"]["rank_change_24h"] is None and m["new"]["arrived_24h"]
    assert m["a"]["rank_change_24h"] == -1 and not m["a"]["arrived_24h"]


def test_rank_change_needs_a_day(members):
    m, d = _ranked(members([("a", 1, T0, 100, 1), ("b", 1, T0, 200, 1), ("a", 1, T0 + HOUR, 500, 1)]))
    assert all(r["rank_change_24h"] is None for r in [*m.values(), *d.values()])


def test_rank_change_survives_a_regression(members):
    t1 = T0 + 25 * HOUR
    m, _ = _ranked(members([("a", 1, T0, 900, 1), ("b", 1, T0, 200, 1), ("c", 1, T0, 50, 1), ("a", 1, t1, 10, 1)]))
    assert m["b"]["rank_change_24h"] == 1 and m["c"]["rank_change_24h"] == 1


def test_in_team_order_and_donor_rollup(members):
    m, d = _ranked(members([("a", 1, T0, 50, 5), ("a", 2, T0, 60, 6), ("b", 1, T0, 50, 5), ("c", 2, T0, 10, 1)]))
    assert d["a"]["score"] == 110 and d["a"]["team_count"] == 2 and d["a"]["rank"] == 1
    assert m["b"]["rank_in_team"] == 2 and m["c"]["rank_in_team"] == 2


@pytest.mark.parametrize("rank,n,total,want", [(5, 2, 10, (3, 7)), (1, 2, 10, (1, 5)), (2, 2, 10, (1, 5)),
                                              (10, 2, 10, (6, 10)), (9, 2, 10, (6, 10)), (2, 4, 3, (1, 3))])
def test_recentred_window(spark, rank, n, total, want):
    df = spark.createDataFrame([(rank,)], "r bigint")
    lo, hi = R.recentred_window(F.col("r"), n, F.lit(total))
    assert tuple(df.select(lo, hi).first()) == want


def test_page_past_the_end_is_empty(spark):
    df = spark.range(1, 26).withColumnRenamed("id", "position")
    assert R.page(df, "position", 3, 10).count() == 5 and R.page(df, "position", 4, 10).count() == 0
    with pytest.raises(ValueError):
        R.page(df, "position", 0)
    with pytest.raises(ValueError):
        R.page(df, "position", 1, 1001)


# --- pairing and cadence --------------------------------------------------------------


def hm(h, m):
    return int(dt.datetime(2026, 8, 2, h, m, tzinfo=dt.timezone.utc).timestamp())


@pytest.mark.parametrize("team,user,want", [
    ([(5, 10), (9, 10)], [(5, 20), (9, 20)], [((5, 20), (5, 10)), ((9, 20), (9, 10))]),
    ([(9, 10)], [(5, 20), (9, 20)], [((9, 20), (9, 10))]),
    ([(5, 10)], [(5, 20), (7, 0), (9, 20)], [((5, 20), (5, 10)), ((7, 0), (5, 10)), ((9, 20), (5, 10))]),
    ([(5, 10), (5, 12), (5, 15)], [(5, 13), (6, 0)], [((5, 13), (5, 12)), ((6, 0), (5, 15))]),
    ([], [(5, 20)], []), ([(5, 10)], [], []), ([(5, 20)], [(5, 20)], [((5, 20), (5, 20))])])
def test_pairing(spark, team, user, want):
    meta = spark.createDataFrame([("team", hm(*t)) for t in team] + [("user", hm(*u)) for u in user],
                                 "feed string, snapshot_ts bigint")
    assert rows(pairing.pair_snapshots(meta), "ts", "team_ts") == [(hm(*u), hm(*t)) for u, t in want]


def test_pairing_carries_over_days(spark):
    meta = spark.createDataFrame([("team", T0), ("user", T0 + 5 * DAY), ("user", T0 + 9 * DAY)], "feed string, snapshot_ts bigint")
    assert rows(pairing.pair_snapshots(meta), "ts", "team_ts") == [(T0 + 5 * DAY, T0), (T0 + 9 * DAY, T0)]


@pytest.mark.parametrize("gaps,interval,measured", [
    ([3700] * 5, 3700, True), ([], 3600, False), ([3650, 3650, 7300, 3650, 3650], 3650, True),
    ([1] * 6, 3600, False), ([3200] * 40 + [3640] * 24, 3640, True)])
def test_cadence(spark, gaps, interval, measured):
    ts = [T0]
    for g in gaps:
        ts.append(ts[-1] + g)
    r = pairing.cadence(spark.createDataFrame([(t,) for t in ts], "ts bigint")).first()
    assert (r["interval_sec"], r["measured"], r["next_expected_ts"]) == (interval, measured, ts[-1] + interval)


# --- buckets and rollups --------------------------------------------------------------


def test_sunday_weeks_for_900_days(spark):
    start = (dt.date(2024, 1, 1) - dt.date(1970, 1, 1)).days
    df = spark.range(start, start + 900).select(F.col("id").alias("day"))
    for r in df.select("day", S.week_start_day(S.week_of_day("day")).alias("w"), S.month_of_day("day").alias("m")).collect():
        d = dt.date(1970, 1, 1) + dt.timedelta(days=r["day"])
        assert r["w"] == r["day"] - (d.weekday() + 1) % 7 and r["m"] == d.year * 12 + d.month - 1


def test_project_rollups_over_two_months(spark):
    base = int(dt.datetime(2026, 7, 30, 6, tzinfo=dt.timezone.utc).timestamp())
    at = [base + h * HOUR for h in (0, 20, 26, 50)]
    snap = [(t, f"t{t}", ts, 1000 * t + 10 * i * t, i + 1) for t in (1, 2, 3) for i, ts in enumerate(at)]
    d = diff.deltas(spark.createDataFrame(snap, "team_id int, team_name string, snapshot_ts bigint, score bigint, wus bigint"), T)
    assert rows(rollups.project_deltas(d), "ts", "d_score", "d_wu") == [(t, 60, 3) for t in at[1:]]
    daily = rollups.daily(d, T)
    monthly = rollups.monthly(daily, T)
    july, august = 2026 * 12 + 6, 2026 * 12 + 7
    got = rows(rollups.project_rebuild(d, daily, monthly), "grain", "bucket", "points")
    assert [g for g in got if g[0] == "month"] == [("month", july, 120), ("month", august, 60)]
    assert sum(g[2] for g in got if g[0] == "day") == sum(g[2] for g in got if g[0] == "cycle") == 180


def test_thinning(spark):
    now = int(dt.datetime(2026, 8, 2, 12, tzinfo=dt.timezone.utc).timestamp())
    old = now - 200 * DAY
    meta = spark.createDataFrame(
        [("team", now - i * HOUR) for i in range(4)] + [("team", old + i * HOUR) for i in range(4)]
        + [("user", old + i * HOUR + 60) for i in range(3)], "feed string, snapshot_ts bigint")
    plan = archive.thinning(meta, now)
    kept = rows(plan.filter("action = 'keep'"), "feed", "snapshot_ts")
    assert kept == sorted([("team", now - i * HOUR) for i in range(4)] + [("team", old), ("user", old + 60)])
    again = archive.thinning(plan.filter("action = 'keep'").drop("action"), now)
    assert again.filter("action = 'delete'").count() == 0
    assert archive.thinning(meta, now, keep_daily=False).filter("action = 'delete'").count() == 7


def test_compaction_floors_to_days_and_keeps_months(spark):
    delta = spark.createDataFrame([("a", 1, T0 + i * HOUR, 5, 1) for i in range(0, 72, 6)],
                                  "name string, team_id int, ts bigint, d_score bigint, d_wu bigint")
    cut = T0 + 30 * HOUR
    plan = archive.compaction_plan(delta, rollups.daily(delta, M), cut, None)
    assert all(r["prune"] == (r["table_name"] == "delta" and r["day"] < cut // DAY) for r in plan.collect())
    kept = delta.filter(F.col("ts") >= cut // DAY * DAY)
    full = rollups.monthly(rollups.daily(delta, M), M)
    assert rollups.daily(kept, M).exceptAll(rollups.daily(delta, M)).count() == 0 and full.count() == 1


# --- activity -------------------------------------------------------------------------


def _clock(today, first=0):
    return windows.Clock(today * DAY + 3600, first * DAY, None, today * DAY, 1, None, 1)


@pytest.mark.parametrize("days,current,longest,active,since", [
    ([], 0, 0, 0, None), ([100], 1, 1, 1, 100), ([99], 1, 1, 1, 99), ([96, 97, 98], 0, 3, 3, None),
    ([95, 96, 97, 98, 99, 100], 6, 6, 6, 95), ([10, 11, 12, 13, 14, 15, 99, 100], 2, 6, 8, 99),
    ([10, 20, 30, 40], 0, 1, 4, None), ([95, 96, 98, 99, 100], 3, 3, 5, 98), (list(range(61, 101)), 40, 40, 40, 61)])
def test_streaks(spark, days, current, longest, active, since):
    e = spark.createDataFrame([("x",)], "name string")
    d = spark.createDataFrame([("x", day, 5, 1) for day in days], "name string, day bigint, points bigint, wus bigint")
    r = activity.streaks(e, activity.producing_days(d, ["name"]), ["name"], _clock(100, 61)).first()
    assert (r["current_days"], r["longest_days"], r["active_days"], r["since_day"]) == (current, longest, active, since)
    assert r["at_collection_floor"] == (since == 61)


def test_recent_ratio(spark):
    def recent(days, floor):
        d = spark.createDataFrame([("x", *r) for r in days], "name string, day bigint, points bigint, wus bigint")
        return activity.recent_ratio(activity.producing_days(d, ["name"]), ["name"], _clock(100, floor)).first()

    days = [(60, 1_000_000, 1000), (98, 800_000, 10), (99, 400_000, 10)]
    r = recent(days, 0)
    assert (r["recent_days"], r["recent_points"], r["recent_wus"], r["recent_points_per_wu"]) == (30, 1_200_000, 20, 60_000)
    assert recent(days, 98)["recent_days"] == 3
    assert recent([(10, 5, 5)], 0) is None and recent([], 0) is None and recent([(99, 500, 0)], 0) is None


def test_production_records_with_corrections(spark):
    rnd = random.Random(5)
    data = {d: rnd.randrange(-50, 100) for d in range(0, 60) if rnd.random() < 0.5}
    df = spark.createDataFrame([("x", d, p, 1) for d, p in data.items()], "name string, day bigint, points bigint, wus bigint")
    r = activity.production_records(df, ["name"], _clock(64)).first()
    runs = {d: sum(data.get(x, 0) for x in range(d - 6, d + 1)) for d in range(min(data), 65)}
    best = max(runs.values())
    assert r["best_7d_points"] == best and r["best_7d_end"] == min(d for d, v in runs.items() if v == best)
    assert r["best_day_points"] == max(data.values()) and r["active_days"] == len(data)


# --- history --------------------------------------------------------------------------


def test_history_range_bounds():
    r = H.history_range(T0, "cycle")
    assert (r.granularity, r.start, r.end) == ("hourly", T0 - WEEK, T0 + HOUR)
    assert H.history_range(T0, "monthly").start == T0 - 3 * 365 * DAY
    for bad in (dict(granularity="yearly"), dict(start=T0, end=T0), dict(start=T0 - 91 * DAY, end=T0),
                dict(granularity="daily", start=T0 - 6 * 365 * DAY, end=T0)):
        with pytest.raises(ValueError):
            H.history_range(T0, **bad)


def test_densify_tolerates_drift_and_pads_a_lone_point(spark):
    t = [T0, T0 + 3613, T0 + 4 * HOUR + 40]
    s = spark.createDataFrame([("a", x, 5, 1) for x in t] + [("b", T0, 7, 1)],
                              "name string, bucket_ts bigint, points bigint, wus bigint")
    got = rows(H.densify(s, ["name"], "hourly", T0 + 1800), "name", "bucket_ts", "points")
    assert got == [("a", T0, 5), ("a", t[1], 5), ("a", t[1] + HOUR, 0), ("a", t[1] + 2 * HOUR, 0), ("a", t[2], 5),
                   ("b", T0 - HOUR, 0), ("b", T0, 7)]


def test_per_day_uses_what_was_watched(spark):
    day = T0 // DAY * DAY
    s = spark.createDataFrame([(day - DAY, 240, 24), (day, 120, 12)], "bucket_ts bigint, points bigint, wus bigint")
    got = rows(H.per_day(s, "daily", day + 12 * HOUR, day - DAY + 12 * HOUR), "bucket_ts", "points")
    assert got == [(day - DAY, 240), (day, 240)]
    young = H.per_day(s, "daily", day + 60).filter(F.col("bucket_ts") == day).first()
    assert young["points"] == 120 * 24


# --- quantiles ------------------------------------------------------------------------


def test_histogram_quantiles_and_overflow(spark):
    df = spark.range(1, 101).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    r = quantiles.histogram(df, "k", "v", 0.1, 100_000).first()
    for q, want in (("q50", 50), ("q90", 90), ("q99", 99)):
        assert want <= r[q] <= want + 0.1 + 1e-9
    over = spark.createDataFrame([("k", 3600_000.0)], "k string, v double")
    assert quantiles.histogram(over, "k", "v", 0.1, 100_000).first()["q50"] >= 10_000


def test_nearest_rank_with_a_hot_key(spark):
    rnd = random.Random(9)
    data = [("hot" if i % 3 else f"k{i % 7}", rnd.randrange(1000), i) for i in range(3000)]
    got = {r["k"]: r for r in quantiles.nearest_rank(
        spark.createDataFrame(data, "k string, v bigint, id bigint"), "k", "v", "id").collect()}
    for k in {d[0] for d in data}:
        v = sorted(d[1] for d in data if d[0] == k)
        assert [got[k][f"p{p}"] for p in (50, 90, 99)] == [v[min(len(v) * p // 100, len(v) - 1)] for p in (50, 90, 99)]
        assert got[k]["n"] == len(v) and got[k]["max_value"] == v[-1]
