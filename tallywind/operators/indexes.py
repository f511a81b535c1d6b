"""Stored orders and indexes of the marts, built once per publish so that a read prunes.

A parquet table sorted by a plain column skips the row groups a pushed filter rules out. The
marts are laid out by rank; here are the copies other reads need: by key for exact lookups, by
folded name for prefix search, and every team's roster under all orderings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywind.functions import scalars as S
from tallywind.operators import ranking as R

#: Prefixes up to this many characters have their best matches stored.
HEAD_CHARS = 4
#: Best matches stored per prefix: the most a search may ask for.
HEAD_ROWS = 50


def by_key(mart: DataFrame, *keys: str) -> DataFrame:
    """A copy in the order of its keys: an equality on the first of them reads few row groups."""
    return mart.repartitionByRange(*keys).sortWithinPartitions(*keys)


def all_rosters(members: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Every team's roster under every ordering: key, team_id, position, name, rank, value.

    All orderings are numbered in one pass: a member is one slim row per ordering, and a single
    range shuffle by (key, team, order) places them all, however large one team is.
    """
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value"),
                              (F.lit(0).cast("bigint") if c == "score" else -F.greatest(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))).alias("place"))
                     for k, c in columns.items()])
    slim = members.select("team_id", "name", "rank", F.explode(rows).alias("r")).select("r.key", "team_id", "name", "rank", "r.value", "r.place")
    placed = R.with_group_position(slim, ["key", "team_id"], [F.col("place"), F.col("rank")])
    return placed.select("key", "team_id", "position", "name", "rank", "value")


def search_index(mart: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """(folded, rank, [key], name, score) in the order of the folded name."""
    rows = mart.select(S.ascii_fold(F.col(name)).alias("folded"), "rank", *([key] if key else []), name, "score")
    return rows.repartitionByRange("folded", "rank").sortWithinPartitions("folded", "rank")


def search_heads(index: DataFrame) -> DataFrame:
    """The best HEAD_ROWS matches of every short prefix, by prefix.

    Spark limits the groups before the shuffle, so a prefix that all names share sends no more
    rows of a task than it keeps.
    """
    size = F.least(F.lit(HEAD_CHARS), F.length("folded"))
    every = index.filter("folded <> ''").withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), size), lambda n: F.left("folded", n))))
    best = F.row_number().over(Window.partitionBy("prefix").orderBy("rank"))
    return (every.withColumn("nr", best).filter(F.col("nr") <= HEAD_ROWS).drop("nr", "folded")
            .repartitionByRange("prefix").sortWithinPartitions("prefix", "rank"))


def after_prefix(prefix: str) -> str | None:
    """The least text greater than all that begin with ``prefix``; None if there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        point = ord(prefix[i])
        if point < 0x10FFFF:
            point += 1
            return prefix[:i] + chr(0xE000 if point == 0xD800 else point)
    return None


def _folded(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def starts_with(column: str, prefix: str) -> Column:
    """A prefix as a range on a plain column, which reaches the scan."""
    low, high = F.col(column) >= F.lit(prefix), after_prefix(prefix)
    return low if high is None else low & (F.col(column) < F.lit(high))


def search(index: DataFrame, heads: DataFrame, query: str, name: str, by_id: DataFrame | None = None, key: str | None = None,
           limit: int = 8) -> DataFrame:
    """Exact name first, then case-insensitive prefix matches by rank; a number also finds the
    entity with that ``key`` in ``by_id``, ahead of both. A short prefix is read from ``heads``,
    a longer one from its range of the index."""
    if not query:
        raise ValueError("q is required")
    if not 1 <= limit <= HEAD_ROWS:
        raise ValueError(f"limit must be between 1 and {HEAD_ROWS}")
    text = _folded(query)
    columns = [*([key] if key else []), name, "rank", "score"]
    if len(text) <= HEAD_CHARS:
        prefixed = heads.filter(F.col("prefix") == F.lit(text)).select(*columns)
    else:
        prefixed = index.filter(starts_with("folded", text)).select(*columns)
    exact = index.filter((F.col("folded") == F.lit(text)) & (F.col(name) == F.lit(query))).select(*columns)
    found = prefixed.filter(F.col(name) != F.lit(query)).withColumn("match", F.lit(2)).unionByName(exact.withColumn("match", F.lit(1)))
    if key and by_id is not None and query.isdigit():
        hit = by_id.filter(F.col(key) == F.lit(int(query))).select(*columns)
        found = found.filter(F.col(key) != F.lit(int(query))).unionByName(hit.withColumn("match", F.lit(0)))
    return found.orderBy("match", "rank").limit(limit).select(*columns, (F.col("match") < 2).alias("exact"))
