"""Stored orders and the search index: same rows as the scans, and ranges that reach the scan."""

import random

import pytest
from pyspark.sql import functions as F

from tallywind.operators import indexes as X
from tallywind.operators import insights as I
from tallywind.session import materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def donors(spark):
    rng = random.Random(4)
    names = {"".join(rng.choice("abABzZé_") for _ in range(rng.randint(1, 7))) for _ in range(3000)} | {"ab", "AB", "abab", "x\U0010ffff", "x"}
    rows = [(n, i + 1, 10_000 - i) for i, n in enumerate(sorted(names, key=lambda n: rng.random()))]
    return spark.createDataFrame(rows, "name string, rank long, score long").cache()


@pytest.mark.parametrize("query, limit", [("a", 50), ("AB", 8), ("ab", 8), ("abab", 8), ("ababz", 20), ("zzzzz", 50), ("é", 5), ("none", 3), ("x", 3), ("x\U0010ffff", 3)])
def test_search_by_index_equals_the_scan(spark, donors, query, limit):
    index = materialize(X.search_index(donors, "name"), "index")
    heads = materialize(X.search_heads(index), "heads")
    got = [tuple(r) for r in X.search(index, heads, query, "name", limit=limit).collect()]
    assert got == [tuple(r) for r in I.search(donors, query, "name", limit=limit).collect()]


def test_ranges_reach_the_scan(spark, donors):
    index = materialize(X.search_index(donors, "name"), "index")
    heads = materialize(X.search_heads(index), "heads")
    text = plan(X.search(index, heads, "ababz", "name"))
    assert "GreaterThanOrEqual(folded,ababz)" in text and "LessThan(folded,abab{)" in text
    assert "EqualTo(prefix,ab)" in plan(X.search(index, heads, "AB", "name"))
    by_name = materialize(X.by_key(donors, "name"), "by-name")
    assert "EqualTo(name,ab)" in plan(by_name.filter(F.col("name") == "ab"))


def test_heads_hold_the_best_of_a_prefix_all_names_share(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("Same"), F.col("id").cast("string")).alias("name"), (F.lit(20_000) - F.col("id")).alias("rank"), "id")
    index = X.search_index(rows.withColumnRenamed("id", "score"), "name")
    heads = X.search_heads(index).filter("prefix = 'same'")
    assert [r["rank"] for r in heads.orderBy("rank").collect()] == list(range(1, X.HEAD_ROWS + 1))


def test_after_prefix():
    assert X.after_prefix("ab") == "ac" and X.after_prefix("a\U0010ffff") == "b" and X.after_prefix("\U0010ffff") is None
    assert X.after_prefix("퟿") == ""


def test_search_refuses_as_the_scan_does(donors):
    for call in (lambda: X.search(donors, donors, "", "name"), lambda: X.search(donors, donors, "x", "name", limit=51)):
        with pytest.raises(ValueError):
            call()


def test_all_rosters_equal_each_roster(spark):
    rng = random.Random(8)
    rows = [(t, f"m{i}", 0, rng.randrange(4), rng.randrange(-2, 3), rng.randrange(5)) for i in range(400) for t in ([1] if i % 3 else [2, 3])]
    rows = [(t, n, r + 1, s, a, b) for r, (t, n, _, s, a, b) in enumerate(sorted(rows, key=lambda x: -x[3]))]
    members = spark.createDataFrame(rows, "team_id int, name string, rank long, score long, points_last_24h long, wus long").cache()
    columns = {"lifetime": "score", "last_24h": "points_last_24h", "wus": "wus"}
    stored = X.all_rosters(members, columns)
    for key in columns:
        one = I.roster_by(members.withColumn("points_last_7d", F.lit(1)), key).select("team_id", "position", "name", "value")
        got = stored.filter(F.col("key") == key).select("team_id", "position", "name", "value")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one.collect()))
