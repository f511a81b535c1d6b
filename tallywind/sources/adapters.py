"""Snapshot feeds derived from the given tables.

``hourly``  events: who = user, parent = event type, one cycle per hour.
``daily``   lineitem joined to orders, supplier and nation: who = customer, parent = the
            supplier's nation, one cycle per ship day. Customers keep meeting new nations
            to the last day, so arrivals, multi-parent names and short spans all occur.

Variants of ``hourly`` exercise the checks: ``corrections`` (error events take points back,
so totals regress), ``split`` (each row published twice, in halves), ``forged`` (a record at
every UTC midnight that its parent cannot support, and one on an unknown parent), ``ingested`` (the
forged feed as an archive of which some snapshots are broken, see ``spoil_rows``, applied by the
cycle ingest).

Parents credit one point more than their members for each purchase, so parent totals run
ahead of the sum of their members as unattributed production makes them do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywind.schemas import DAY, HOUR

# Parent ids of the event types.
EVENT_TEAMS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
FORGED_POINTS = 1_000_000_000_000
UNKNOWN_TEAM = 99

#: Bits of a line's fields where it travels as one number, lowest first.
LINE_BITS = {"team_id": 8, "day": 16, "units": 12, "pts": 27}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(col: str):
    """Whole unix seconds of a TIMESTAMP_NTZ column, whatever the session time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")


def cycle_end(ts, step: int):
    return (F.floor(ts / F.lit(step)) + 1) * F.lit(step)


def hourly_base(spark: SparkSession, sf_dir: str, corrections: bool = False) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    team = F.lit(None).cast("int")
    for kind, i in EVENT_TEAMS.items():
        team = F.when(F.col("event_type") == kind, F.lit(i)).otherwise(team)
    pts = F.round(F.col("value") * 100).cast("bigint")
    if corrections:
        pts = F.when(F.col("event_type") == "error", -pts).otherwise(pts)
    return ev.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"),
        team.alias("team_id"),
        F.col("event_type").alias("team_name"),
        cycle_end(epoch("ts"), HOUR).alias("snapshot_ts"),
        pts.alias("pts"),
        F.lit(1).cast("bigint").alias("units"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("bigint").alias("unattributed"))


def pack_lines(rows: DataFrame, *keys: str) -> DataFrame:
    """A line's fields as one number, ``line``. A line with a null, or with a field its bits do not
    hold, keeps its fields as they are in ``wide``, and has no ``line``."""
    fits, line, at = F.lit(True), F.lit(0).cast("bigint"), 0
    for field, bits in LINE_BITS.items():
        value = F.col(field).cast("bigint")
        fits &= value.between(0, (1 << bits) - 1)
        line, at = line.bitwiseOR(F.shiftleft(value, at)), at + bits
    line = F.when(fits, line)
    return rows.select(*keys, line.alias("line"), F.when(line.isNull(), F.struct(*LINE_BITS)).alias("wide"))


def line_field(field: str) -> Column:
    """A field of what :func:`pack_lines` made."""
    names = list(LINE_BITS)
    at = sum(LINE_BITS[f] for f in names[:names.index(field)])
    packed = F.shiftright("line", at).bitwiseAND(F.lit((1 << LINE_BITS[field]) - 1).cast("bigint"))
    return F.when(F.col("line").isNull(), F.col("wide")[field]).otherwise(packed)


def daily_base(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """With ``parts`` the rows come hashed by (name, team_id) into so many partitions: nearly every
    line is a member's only one of its day, so there is nothing to combine before that shuffle. Lines
    travel as a key and one number; names and times are spelled out where they arrive."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", F.floor(epoch("l_shipdate") / F.lit(DAY)).alias("day"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("pts"), F.col("l_quantity").cast("bigint").alias("units"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("team_id"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    name = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    lines = pack_lines(li.join(supp, li.l_suppkey == supp.s_suppkey), "l_orderkey")
    rows = lines.join(orders, F.col("l_orderkey") == orders.o_orderkey).select("o_custkey", "line", "wide")
    team = line_field("team_id").cast(supp.schema["team_id"].dataType)
    if parts is not None:
        rows = rows.repartition(parts, name, team)
    rows = rows.select(name.alias("name"), team.alias("team_id"), ((line_field("day") + 1) * F.lit(DAY)).alias("snapshot_ts"),
                       line_field("pts").alias("pts"), line_field("units").alias("units"))
    return rows.join(nation, F.col("team_id") == F.col("n_nationkey")).select(
        "name", "team_id", F.col("n_name").alias("team_name"), "snapshot_ts", "pts", "units",
        F.lit(0).cast("bigint").alias("unattributed"))


def feed_rows(base: DataFrame) -> DataFrame:
    """Per (name, team) and cycle the counter moved: how far, and the totals so far.

    Both feeds come from this one table, so the source rows are joined and shuffled once.
    A parent has one name here, which is grouped by rather than aggregated: a string in the
    aggregation buffer would turn the hash aggregate into a sort.
    """
    moved = base.groupBy("name", "team_id", "team_name", "snapshot_ts").agg(
        F.sum("pts").alias("p"), F.sum("units").alias("u"), F.sum("unattributed").alias("x"))
    w = Window.partitionBy("name", "team_id").orderBy("snapshot_ts")
    return moved.select("name", "team_id", "team_name", "snapshot_ts", "p", "u", "x",
                        F.sum("p").over(w).alias("score"), F.sum("u").over(w).alias("wus"))


def member_feed(rows: DataFrame) -> DataFrame:
    return rows.select("name", "team_id", "snapshot_ts", "score", "wus")


def team_feed(rows: DataFrame) -> DataFrame:
    moved = rows.groupBy("team_id", "team_name", "snapshot_ts").agg(
        F.sum(F.col("p") + F.col("x")).alias("p"), F.sum("u").alias("u"))
    w = Window.partitionBy("team_id").orderBy("snapshot_ts")
    return moved.select("team_id", "team_name", "snapshot_ts",
                        F.sum("p").over(w).alias("score"), F.sum("u").over(w).alias("wus"))


def split_rows(member: DataFrame) -> DataFrame:
    """Publish every row as two rows that add up to it."""
    half = F.call_function("div", F.col("score"), F.lit(2).cast("bigint"))
    part = F.explode(F.array(
        F.struct(half.alias("score"), F.col("wus").alias("wus")),
        F.struct((F.col("score") - half).alias("score"), F.lit(0).cast("bigint").alias("wus"))))
    return member.select("name", "team_id", "snapshot_ts", part.alias("p")).select(
        "name", "team_id", "snapshot_ts", "p.score", "p.wus")


def forge_rows(member: DataFrame) -> DataFrame:
    """Add a forged record per midnight cycle and parent, and one on an unknown parent."""
    seen = member.filter(F.col("snapshot_ts") % DAY == 0).select("team_id", "snapshot_ts").distinct()
    points = F.lit(FORGED_POINTS).cast("bigint")
    one = F.lit(1).cast("bigint")
    known = seen.filter(F.col("team_id") == EVENT_TEAMS["click"]).select(
        F.lit("forged").alias("name"), "team_id", "snapshot_ts",
        points.alias("score"), one.alias("wus"))
    unknown = seen.select("snapshot_ts").distinct().select(
        F.lit("stray").alias("name"), F.lit(UNKNOWN_TEAM).alias("team_id"), "snapshot_ts",
        points.alias("score"), one.alias("wus"))
    return member.unionByName(known).unionByName(unknown)


def archive_meta(cycles: DataFrame) -> DataFrame:
    """Sidecar rows for a feed archive over the given cycle times.

    The team feed publishes a minute ahead of the user feed, misses its 05:00 and 17:00
    publishes and publishes twice at 07:00 and 19:00.
    """
    hour = F.call_function("div", F.col("ts"), F.lit(HOUR).cast("bigint")) % 12
    offsets = (F.when(hour == 5, F.array().cast("array<bigint>"))
               .when(hour == 7, F.array(F.lit(60), F.lit(600)).cast("array<bigint>"))
               .otherwise(F.array(F.lit(60)).cast("array<bigint>")))
    team = cycles.select("ts", F.explode(offsets).alias("ahead")).select(
        F.lit("team").alias("feed"), (F.col("ts") - F.col("ahead")).alias("snapshot_ts"))
    user = cycles.select(F.lit("user").alias("feed"), F.col("ts").alias("snapshot_ts"))
    return team.unionByName(user).select(
        "feed", "snapshot_ts", (F.col("snapshot_ts") + 30).alias("fetched_ts"),
        F.length(F.concat_ws(":", "feed", F.col("snapshot_ts").cast("string"))).cast("bigint").alias("bytes"),
        F.sha2(F.concat_ws(":", "feed", F.col("snapshot_ts").cast("string")), 256).alias("sha256"))


def published_teams(team: DataFrame) -> DataFrame:
    """Team snapshots at the times :func:`archive_meta` publishes them: a minute ahead of the
    user feed, none at 05:00 and 17:00, two at 07:00 and 19:00."""
    hour = F.call_function("div", F.col("snapshot_ts"), F.lit(HOUR).cast("bigint")) % 12
    ahead = (F.when(hour == 5, F.array().cast("array<bigint>")).when(hour == 7, F.array(F.lit(60), F.lit(600)).cast("array<bigint>"))
             .otherwise(F.array(F.lit(60)).cast("array<bigint>")))
    return team.withColumn("ahead", F.explode(ahead)).withColumn("snapshot_ts", F.col("snapshot_ts") - F.col("ahead")).drop("ahead")


def _defect(ts: Column) -> Column:
    """What is wrong with the 03:00 cycle of a day: one of five by the day, else null."""
    hour = F.call_function("div", ts, F.lit(HOUR).cast("bigint")) % 24
    return F.when(hour == 3, F.call_function("div", ts, F.lit(DAY).cast("bigint")) % 5)


def spoil_rows(member: DataFrame) -> DataFrame:
    """Add rows no snapshot may hold: a negative total (0), totals past BIGINT together (1)."""
    seen = member.select("snapshot_ts").distinct().withColumn("defect", _defect(F.col("snapshot_ts")))
    row = lambda name, score: F.struct(F.lit(name).alias("name"), F.lit(2).alias("team_id"), F.lit(score).cast("bigint").alias("score"),
                                       F.lit(1).cast("bigint").alias("wus"))
    added = F.when(F.col("defect") == 0, F.array(row("broken", -5))).when(F.col("defect") == 1, F.array(row("huge", 9 * 10**18), row("huge", 9 * 10**18)))
    bad = seen.select("snapshot_ts", F.explode(added).alias("r")).select("r.name", "r.team_id", "snapshot_ts", "r.score", "r.wus")
    return member.unionByName(bad)


def spoil_meta(meta: DataFrame) -> DataFrame:
    """Snapshot metadata with another digest for a team snapshot (2), none (3) and another row
    count (4) for a user snapshot."""
    at = F.when(F.col("feed") == "team", F.col("snapshot_ts") + 60).otherwise(F.col("snapshot_ts"))
    of = lambda feed, n: (F.col("feed") == feed) & F.coalesce((F.col("defect") == n) & (at % HOUR == 0), F.lit(False))
    marked = meta.withColumn("defect", _defect(at)).filter(~of("user", 3))
    return (marked.withColumn("digest", F.when(of("team", 2), F.col("digest") + 1).otherwise(F.col("digest")).cast("decimal(38,0)"))
            .withColumn("row_count", F.when(of("user", 4), F.col("row_count") + 1).otherwise(F.col("row_count"))).drop("defect"))


def country_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each parent in one group: nation to region."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.lit("country").alias("group_kind"), F.col("r_regionkey").cast("string").alias("code"),
        F.col("r_name").alias("group_name"), F.col("n_nationkey").alias("team_id"))


def topic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each parent in several groups: by the last character and by the length of its name."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    letter = F.concat(F.lit("ends-"), F.right(F.col("n_name"), F.lit(1)))
    size = F.concat(F.lit("length-"), F.length("n_name").cast("string"))
    return nation.select(
        F.lit("topic").alias("group_kind"), F.explode(F.array(letter, size)).alias("code"),
        F.col("n_nationkey").alias("team_id")).select(
        "group_kind", "code", F.col("code").alias("group_name"), "team_id")
