import pytest
from pyspark.sql import functions as F

from tallywind.functions import scalars as S
from tallywind.operators import alerts, diff, insights as I, marts, windows
from tallywind.schemas import DAY, HOUR

M = ["name", "team_id"]
T0 = 1_785_672_547


@pytest.mark.parametrize("a,ra,b,rb,gap,days", [
    (9000, 500, 10000, 400, 1000, 10.0), (10000, 400, 9000, 500, 1000, 10.0), (10000, 500, 9000, 400, 1000, None),
    (9000, 400, 10000, 500, 1000, None), (9000, 500, 10000, 500, 1000, None), (9000, 100, 10000, 0, 1000, 10.0),
    (9000, 0, 10000, 0, 1000, None), (10000, 300, 10000, 100, 0, 0.0), (0, 2, 10 ** 12, 1, 10 ** 12, None)])
def test_overtake(spark, a, ra, b, rb, gap, days):
    df = spark.createDataFrame([(a, ra, b, rb)], "a bigint, ra bigint, b bigint, rb bigint")
    got = df.select(*S.overtake(F.lit(T0), "a", "ra", "b", "rb")).first()
    assert tuple(got) == (gap, days, None if days is None else T0 + int(days * DAY))


def test_required_rate_counts_the_moving_target(spark):
    df = spark.createDataFrame([(1000, 4000, 100)], "s bigint, t bigint, r bigint")
    assert df.select(S.required_rate("s", "t", "r", F.lit(30))).first()[0] == 200


@pytest.mark.parametrize("points,reached,upcoming", [
    (999_999, 0, 1_000_000), (1_000_000, 1_000_000, 2_000_000), (1_999_999, 1_000_000, 2_000_000),
    (2_000_000, 2_000_000, 5_000_000), (6_211_286_931, 5_000_000_000, 10_000_000_000),
    (52_243_537_611_990, 50_000_000_000_000, 100_000_000_000_000), (5_000_000_000, 5_000_000_000, 10_000_000_000),
    (9_000_000_000_000_000, 5_000_000_000_000_000, 0), (0, 0, 1_000_000), (-5, 0, 1_000_000)])
def test_milestones(spark, points, reached, upcoming):
    df = spark.createDataFrame([(points,)], "p bigint")
    assert tuple(df.select(S.milestone_at_or_below("p"), S.next_milestone("p")).first()) == (reached, upcoming)


@pytest.mark.parametrize("n,all_trimmed,fixed", [
    (999, "999", "999"), (1000, "1K", "1K"), (1005, "1K", "1K"), (1500, "1.5K", "1.50K"), (1125, "1.12K", "1.12K"),
    (2_345_678, "2.35M", "2.35M"), (10 ** 12, "1T", "1T"), (8_219_397_246_031, "8.22T", "8.22T")])
def test_compact(spark, n, all_trimmed, fixed):
    df = spark.createDataFrame([(n,)], "n bigint")
    assert tuple(df.select(S.compact("n"), S.compact("n", True)).first()) == (all_trimmed, fixed)


def test_small_scalars(spark):
    df = spark.createDataFrame([(48_213, 8_219)], "r bigint, p bigint")
    assert tuple(df.select(S.next_rank_target("r"), S.next_point_target("p"), S.next_rank_target(F.lit(1)),
                           S.grouped(F.lit(8219397246031)), S.percent_text(F.lit(0.00005)), S.percent_text(F.lit(3.14159)),
                           S.duration_text(F.lit(0.02)), S.eta_text(F.lit(1.0)), S.eta_text(F.lit(0.01)),
                           S.ascii_fold(F.lit("DÄh")), S.streak_tier(F.lit(365)), S.streak_tier(F.lit(0)),
                           S.production_tier(F.lit(2_500_000)), S.heat_level(F.lit(0), F.lit(9)),
                           S.heat_level(F.lit(9), F.lit(9))).first()) == (
        40_000, 9_000, None, "8,219,397,246,031", "<0.01%", "3.1%", "1 hours", "~1 day", "any moment", "dÄh", 6, 0, 5, 0, 4)


def test_archive_time(spark):
    df = spark.createDataFrame([(None, 100), (399, 100), (401, 100), (50, 100)], "p bigint, f bigint")
    assert [r[0] for r in df.select(S.archive_time("p", "f")).collect()] == [100, 399, 100, 50]


def _world(members, teams, rows, team_rows):
    snap, tsnap = members(rows), teams(team_rows)
    clock = windows.read_clock(windows.cycles_of(snap))
    m = marts.member_mart(windows.production(diff.latest_state(snap), diff.deltas(snap), M, clock), clock)
    t = marts.team_mart(windows.production(diff.latest_state(tsnap, ["team_id"], "team_name"),
                                           diff.deltas(tsnap, ["team_id"]), ["team_id"], clock), m, clock)
    return clock, m, t, marts.donor_mart(m, clock)


def test_team_activity(members, teams):
    """Three cycles: quitter stops, spiker surges, steady does neither, fresh joins."""
    t1, t2 = T0 + 30 * HOUR, T0 + 60 * HOUR
    rows = [(n, 32, T0, 1000, 1) for n in ("quitter", "steady", "spiker")]
    rows += [("quitter", 32, t1, 5000, 2), ("steady", 32, t1, 2250, 2), ("spiker", 32, t1, 1100, 2)]
    rows += [("steady", 32, t2, 3250, 3), ("spiker", 32, t2, 9000, 3), ("fresh", 32, t2, 700, 1)]
    team = [(32, "t", x, 10_000 + i * 5000, i + 1) for i, x in enumerate((T0, t1, t2))]
    _, m, _, _ = _world(members, teams, rows, team)
    got = {(r["activity"], r["name"]) for r in I.team_activity(m).collect()}
    assert got == {("stopped", "quitter"), ("surging", "spiker"), ("joined", "fresh")}


def test_two_cycle_world_views_and_search(members, teams):
    t1 = T0 + HOUR
    rows = [("Ida", 32, T0, 1000, 10), ("Ida", 51, T0, 500, 5), ("tom", 51, T0, 800, 8), ("solo", 32, T0, 10, 1),
            ("Ida", 32, t1, 1600, 12)]
    team = [(32, "Red", T0, 2000, 20), (51, "Blue", T0, 1300, 13), (32, "Red", t1, 2700, 22)]
    clock, m, t, d = _world(members, teams, rows, team)
    top = marts.donor_view(d).orderBy("rank").first()
    assert (top["name"], top["points_total"], top["team_count"], top["points_last_cycle"]) == ("Ida", 2100, 2, 600)
    s = marts.project_summary(t, d, m, clock).first()
    # The project's figures are the team feed's: 700, not the members' 600.
    assert (s["points_total"], s["points_last_cycle"], s["members_total"], s["donors_total"]) == (4000, 700, 4, 3)
    assert s["new_members_24h"] is None
    assert [(r["name"], r["exact"]) for r in I.search(d, "ida", "name").collect()] == [("Ida", False)]
    assert [(r["name"], r["exact"]) for r in I.search(d, "Ida", "name").collect()] == [("Ida", True)]
    assert [r["team_id"] for r in I.search(t, "51", "team_name", "team_id").collect()] == [51]
    nested = marts.with_teams_array(d, marts.donor_breakdown(m, t, cap=1)).filter("name = 'Ida'").first()
    assert [x["team_id"] for x in nested["teams"]] == [32] and nested["teams_truncated"]
    roster = I.roster_by(m, "last_24h").filter("team_id = 32").orderBy("position").collect()
    assert [(r["name"], r["value"]) for r in roster] == [("Ida", 600), ("solo", 0)]


def test_argument_checks(spark):
    d = spark.createDataFrame([("a", 1, 5)], "name string, rank bigint, score bigint")
    for call in (lambda: I.search(d, "", "name"), lambda: I.search(d, "x", "name", limit=51),
                 lambda: I.sort_key("bogus", I.TEAM_KEYS), lambda: I.movers(d, "team", within=5),
                 lambda: I.changed(d, d, ["name"], 0, T0), lambda: I.goal(d, "team", "a", F.lit(0))):
        with pytest.raises(ValueError):
            call()
    assert I.sort_key("daily", I.TEAM_KEYS) == "points_today_utc"
    assert I.sort_key("members", I.DONOR_KEYS) == "score"


def test_an_unknown_subject_gives_nothing(members, teams):
    clock, m, _, d = _world(members, teams, [("a", 1, T0, 5, 1), ("b", 1, T0, 9, 1)], [(1, "t", T0, 14, 2)])
    now = F.lit(clock.at).cast("bigint")
    assert I.rivals(d, F.col("name") == "nobody", "rank", "name", now).count() == 0
    assert I.rivals(d, F.col("name") == "a", "rank", "name", now).count() == 2
    e = I.entity_summaries(d.limit(0).select(F.lit(1).alias("team_id"), F.lit("x").alias("team_name"), "rank", "score",
                                             "points_per_day_24h_avg", "points_per_day_7d_avg", "rank_change_24h"), d)
    assert I.goal(e, "donor", "nobody", now, target_rank=1).count() == 0
    dated = I.goal(e, "donor", "a", now, target_points=105, by_days=10).first()
    assert dated["required_per_day"] == 10 and not dated["holding"]


def _fire(spark, kind, threshold, readings, created=None):
    rules = spark.createDataFrame([("r", kind, "team", "1", threshold, created or readings[0][0])],
                                  "id string, type string, kind string, target string, threshold bigint, created_ts bigint")
    rd = spark.createDataFrame([("team", "1", *r) for r in readings],
                               "kind string, target string, ts bigint, points_total bigint, points_last_24h bigint, rank bigint")
    return [(r["ts"], r["value"]) for r in alerts.evaluate(rules, rd).orderBy("ts").collect()]


DAY0 = 20_600 * DAY


def test_a_new_rule_is_silent(spark):
    still = [(DAY0 + i * HOUR, 7_300_000_000, 0, 50) for i in range(3)]
    for kind, threshold in (("milestone", 0), ("rank", 80), ("idle", 2), ("resumed", 0)):
        assert _fire(spark, kind, threshold, still[:2]) == []


def test_milestones_fire_once_each_and_only_the_highest_passed(spark):
    totals = [1_900_000, 1_999_999, 2_000_000, 4_999_999, 23_000_000, 22_000_000, 23_500_000]
    seen = [(DAY0 + i * HOUR, p, 5, 1) for i, p in enumerate(totals)]
    assert _fire(spark, "milestone", 0, seen) == [(DAY0 + 2 * HOUR, 2_000_000), (DAY0 + 4 * HOUR, 20_000_000)]


def test_a_rank_rule_fires_on_entering_and_rearms_on_leaving(spark):
    ranks = [30, 11, 10, 4, 12, 10, 10, 31, 1]
    seen = [(DAY0 + i * HOUR, 1, 1, k) for i, k in enumerate(ranks)]
    assert _fire(spark, "rank", 10, seen) == [(DAY0 + i * HOUR, ranks[i]) for i in (2, 5, 8)]


def test_an_idle_rule_fires_once_a_spell(spark):
    spans = [(0, 40), (5, 0), (16, 0), (17, 0), (30, 0), (31, 8), (33, 0), (44, 0), (45, 0), (70, 0)]
    seen = [(DAY0 + h * HOUR, 1, p, 1) for h, p in spans]
    assert _fire(spark, "idle", 12, seen) == [(DAY0 + 17 * HOUR, 12 * HOUR), (DAY0 + 45 * HOUR, 12 * HOUR)]


def test_resumed_and_daily_rules(spark):
    seen = [(DAY0 + i * HOUR, 1, p, 1) for i, p in enumerate([6, 0, 0, 9, 2, 0, 5])]
    assert _fire(spark, "resumed", 0, seen) == [(DAY0 + 3 * HOUR, 9), (DAY0 + 6 * HOUR, 5)]
    hours = [1, 5, 7, 8, 23, 25, 30, 31, 55]
    assert [t for t, _ in _fire(spark, "daily", 7, [(DAY0 + h * HOUR, 1, 3, 1) for h in hours])] == [DAY0 + h * HOUR for h in (7, 31, 55)]


def test_a_rule_carried_over_batches_fires_as_in_one(spark):
    import random
    rnd = random.Random(11)
    rows, total = [], 0
    for i in range(120):
        moved = rnd.choice([0, 0, 0, rnd.randrange(1, 900_000)])
        total += moved
        rows.append((DAY0 + i * 5 * HOUR, total, moved, rnd.randrange(1, 8)))
    kinds = [("milestone", 0), ("rank", 3), ("idle", 9), ("resumed", 0), ("daily", 6)]
    rules = spark.createDataFrame([(k, k, "team", "1", v, DAY0) for k, v in kinds],
                                  "id string, type string, kind string, target string, threshold bigint, created_ts bigint")
    schema = "kind string, target string, ts bigint, points_total bigint, points_last_24h bigint, rank bigint"
    frame = lambda part: spark.createDataFrame([("team", "1", *r) for r in part], schema)
    whole = sorted(map(tuple, alerts.evaluate(rules, frame(rows)).collect()))
    carry, pieces = None, []
    for a, b in ((0, 31), (28, 74), (74, 75), (75, 120)):  # the second repeats readings of the first
        seen = alerts.walk(rules, frame(rows[a:b]), carry)
        pieces += map(tuple, alerts.firings(seen).collect())
        carry = spark.createDataFrame(alerts.carried(seen).collect(), alerts.CARRY)
    assert len(whole) > 10 and sorted(pieces) == whole
