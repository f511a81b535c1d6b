"""What a read builds, and that the daily world's member tables are shuffled once."""

from pyspark.sql import functions as F

from tallywind.operators import diff, history, marts, ranking, rollups, windows
from tallywind.plans.warehouse import MEMBER, Warehouse
from tallywind.session import drop_scratch, scratch_mark
from tallywind.sources import adapters

SF = "/root/testdata/sf0.001"


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_member_tables_of_the_daily_world_need_no_further_shuffle(spark):
    w = Warehouse(spark, SF, "daily")
    assert _exchanges(diff.deltas(w.member_snapshot, MEMBER)) == 0
    assert _exchanges(diff.latest_state(w.member_snapshot, MEMBER)) == 0
    assert _exchanges(rollups.daily(w.member_delta, MEMBER)) == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert _exchanges(windows.production(w.member_state, w.member_delta, MEMBER, w.clock)) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = w.feed_rows.select("name", "team_id", F.input_file_name().alias("file")).groupBy("name", "team_id").agg(F.countDistinct("file").alias("files"))
    assert rows.filter("files > 1").count() == 0


def test_reads_build_no_more_than_they_use(spark):
    w = Warehouse(spark, SF, "daily")
    one = w.roster("this_month")
    assert not {"members", "rosters"} & set(vars(w))
    w.teams, w.donors
    assert "members" not in vars(w)
    order = ["team_id", "position"]
    assert one.orderBy(*order).collect() == w.rosters.filter("key = 'this_month'").select(*one.columns).orderBy(*order).collect()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_travel_without_names(spark):
    # The name is spelled out behind the shuffle, and the feed still needs no second one.
    plan = _optimized(adapters.daily_base(spark, SF, 12))
    assert "RepartitionByExpression [concat(c, cast(o_custkey" in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        feed = adapters.feed_rows(adapters.daily_base(spark, SF, 12))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert feed.count("Exchange hashpartitioning(concat(") == 1 and "Exchange hashpartitioning(name" not in feed


def test_members_are_rolled_up_to_donors_once(spark):
    w = Warehouse(spark, SF, "daily")
    members, mark = w.member_production, scratch_mark()
    mart = marts.donor_mart(members, w.clock)
    assert "AS team_count" not in _optimized(mart)  # read from the kept sums, not added up again
    then = members.filter(F.col("first_seen") <= w.clock.baseline).groupBy("name").agg(
        F.sum(F.greatest(F.col("score") - F.col("points_last_24h"), F.lit(0))).alias("t"), F.min("first_seen").alias("f")).collect()
    place = {r["name"]: i + 1 for i, r in enumerate(sorted(then, key=lambda r: (-r["t"], r["f"], r["name"])))}
    got = mart.select("name", "rank", "rank_change_24h").collect()
    drop_scratch(spark, mark)
    assert len(got) > len(place) > 0 or len(got) == len(place)
    assert all(r["rank_change_24h"] == (place[r["name"]] - r["rank"] if r["name"] in place else None) for r in got)


def test_contributions_order_only_the_named_bands(spark):
    members = spark.createDataFrame([(1, f"m{i}", 100 - i // 2, i) for i in range(9)] + [(2, "m0", 5, 9)],
                                    "team_id int, name string, points_last_7d bigint, rank bigint")
    daily = spark.createDataFrame([(1, f"m{i}", 3, 10 + i, 1) for i in range(9)] + [(2, "m0", 4, 7, 1), (3, "gone", 4, 7, 1)],
                                  "team_id int, name string, day bigint, points bigint, wus bigint")
    mark = scratch_mark()
    out = history.contributions(members, daily, history.history_range(5 * 86400, "daily"))
    assert scratch_mark() == mark  # nothing is numbered and written
    assert "WindowGroupLimit" in _optimized(out)  # a task passes on no more of a team than it needs
    assert sorted(map(tuple, out.collect())) == sorted(
        [(1, i + 1, f"m{i}", 3, 10 + i) for i in range(6)] + [(1, 7, "Other", 3, 16 + 17 + 18), (2, 1, "m0", 4, 7)])


def test_few_groups_do_not_shuffle_their_rows_again(spark):
    rows = spark.range(100_000).select("id", (F.col("id") % 5).alias("g"), F.xxhash64("id").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")  # less than the rows, more than five groups
    mark = scratch_mark()
    try:
        placed = ranking.with_group_position(rows, ["g"], [F.col("v"), F.col("id")])
        assert "SortMergeJoin" not in placed._jdf.queryExecution().executedPlan().toString()
        assert placed.groupBy("g").agg(F.max("position"), F.countDistinct("position")).distinct().count() == 5
        assert placed.filter("position < 1 or position > 20000").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        drop_scratch(spark, mark)


def test_lines_travel_as_a_key_and_one_number(spark):
    # Fields beyond their bits, and nulls, come back as they were.
    edge = {f: [0, (1 << n) - 1, 1 << n, -1, None] for f, n in adapters.LINE_BITS.items()}
    rows = [(i, *[values[(i >> k) % 5] for k, values in enumerate(edge.values())]) for i in range(64)]
    lines = spark.createDataFrame(rows, "k bigint, team_id int, day bigint, units bigint, pts bigint")
    packed = adapters.pack_lines(lines, "k")
    assert packed.columns == ["k", "line", "wide"] and 0 < packed.filter("line is not null").count() < 64
    assert packed.filter("(line is null) = (wide is null)").count() == 0
    back = packed.select("k", *[adapters.line_field(f).alias(f) for f in adapters.LINE_BITS]).collect()
    assert sorted(map(tuple, back)) == rows
    # Nothing else goes through the shuffle by member.
    moved = [line for line in _optimized(adapters.daily_base(spark, SF, 12)).split("RepartitionByExpression")[1].split("\n")[1:2]]
    assert "pts" not in moved[0] and "units" not in moved[0] and "line" in moved[0]


def test_production_read_alone_writes_neither_state_nor_deltas(spark):
    w = Warehouse(spark, SF, "daily")
    alone = w.member_production
    assert not {"member_state", "member_delta"} & set(vars(w))
    tables = windows.production(w.member_state, w.member_delta, MEMBER, w.clock)
    assert alone.exceptAll(tables).count() == 0 == tables.exceptAll(alone).count()
