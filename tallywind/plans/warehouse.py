"""The tables of one snapshot world, each written once and read by every query.

This is the publish step: a query never recomputes identity, deltas or ranks, it scans
the marts of the newest cycle. The tables live in the session's shared folder.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywind.operators import diff, indexes, marts, rollups, windows
from tallywind.operators.insights import MEMBER_KEYS
from tallywind.schemas import WEEK
from tallywind.session import (app_dir, drop_scratch, materialize, materialize_by, new_path, path_exists, prepare,
                               scratch_mark, shared_dir, table_bytes, together)
from tallywind.sources import adapters as A
from tallywind.sources import snapshots
from tallywind.streaming import cycles as C
from tallywind.streaming import retention as R

MEMBER, TEAM = diff.MEMBER, diff.TEAM

#: Source bytes whose member rows make a bucket of the member tables: some 200,000 rows.
BUCKET_BYTES = 4 << 20

#: Ranks in a file of a mart.
FILE_RANKS = 1 << 16

#: Days the world ``retained`` keeps.
RETAINED = {"raw": 3, "daily": 7, "archive": 2}

_OPEN: dict[tuple[str, str, str, str], "Warehouse"] = {}


def open_warehouse(spark: SparkSession, sf_dir: str, world: str) -> "Warehouse":
    """The warehouse of a world, shared by all queries of one application."""
    prepare(spark)
    key = (spark.sparkContext.applicationId, shared_dir(spark), str(sf_dir), world)
    if key not in _OPEN or not path_exists(spark, app_dir(spark)):
        _OPEN[key] = {"ingested": IngestedWarehouse, "retained": RetainedWarehouse}.get(world, Warehouse)(spark, str(sf_dir), world)
    return _OPEN[key]


class Warehouse:
    """``world`` names the feed adapter: hourly, daily, corrections, split, forged, ingested or retained."""

    def __init__(self, spark: SparkSession, sf_dir: str, world: str):
        self.spark, self.sf_dir, self.world = spark, sf_dir, world
        self._memo: dict[str, object] = {}

    def once(self, key: str, make):
        """Build something of this world on first use."""
        if key not in self._memo:
            self._memo[key] = make()
        return self._memo[key]

    def _keep(self, df: DataFrame, label: str) -> DataFrame:
        return materialize(df, f"{self.world}-{label}")

    @cached_property
    def buckets(self) -> int:
        """Buckets of the member tables; a bucket keeps its size as the sources grow, so no task spills."""
        source = "lineitem" if self.world == "daily" else "events"
        grown = table_bytes(self.spark, f"{self.sf_dir}/{source}.parquet") // BUCKET_BYTES
        return max(min(12, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), int(grown))

    def _keep_members(self, df: DataFrame, label: str, *order: str) -> DataFrame:
        """Member tables of the daily world are hashed by member: differences, states, sums and days
        follow from the feed without another shuffle."""
        if self.world != "daily":
            return self._keep(df, label)
        return materialize_by(df, f"{self.world}-{label}", MEMBER, self.buckets, [*order])

    def _build(self, make, label: str) -> DataFrame:
        """Keep what ``make()`` returns, laid out by rank so that a page, a neighbourhood or a
        rank range reads few row groups, and drop the numbering tables it went through. Ranks
        are dense, so their ranges are known without sampling the rows, i.e. without making them twice."""
        mark = scratch_mark()
        file_of = F.floor((F.col("rank") - 1) / FILE_RANKS)
        out = self._keep(make().repartition(file_of).sortWithinPartitions("rank"), label)
        drop_scratch(self.spark, mark)
        return out

    @cached_property
    def feed_rows(self) -> DataFrame:
        if self.world == "daily":
            base = A.daily_base(self.spark, self.sf_dir, self.buckets)
        else:
            base = A.hourly_base(self.spark, self.sf_dir, corrections=self.world == "corrections")
        # Read whole by everything, so laid out by member: its columns repeat from row to row.
        return self._keep_members(A.feed_rows(base), "feed-rows", *MEMBER, "snapshot_ts")

    @cached_property
    def raw_member_snapshot(self) -> DataFrame:
        feed = A.member_feed(self.feed_rows)
        return {"split": A.split_rows, "forged": A.forge_rows, "ingested": A.forge_rows, "retained": A.forge_rows}.get(self.world, lambda f: f)(feed)

    @cached_property
    def team_snapshot(self) -> DataFrame:
        return self._keep(A.team_feed(self.feed_rows), "team-feed")

    @property
    def member_snapshot(self) -> DataFrame:
        """One row per member and cycle. Only feeds that repeat rows pay for the summing."""
        raw = self.raw_member_snapshot
        return diff.sum_duplicates(raw) if self.world == "split" else raw

    @cached_property
    def cycles(self) -> DataFrame:
        return self._keep(windows.cycles_of(self.raw_member_snapshot), "cycles")

    @cached_property
    def clock(self) -> windows.Clock:
        return windows.read_clock(self.cycles)

    def _by_time(self, delta: DataFrame, keys: list[str], label: str) -> DataFrame:
        # Ordered by time so that a window over the newest week skips the older row groups (in the
        # daily world's buckets: the older pages). The keys let a cycle in which everybody moved spread
        # over several files; weeks are known without sampling, so the differences are taken once.
        if keys == MEMBER and self.world == "daily":
            return self._keep_members(delta, label, "ts")
        return self._keep(delta.repartition(F.floor(F.col("ts") / WEEK), F.pmod(F.xxhash64(*keys), F.lit(4))).sortWithinPartitions("ts"), label)

    @cached_property
    def member_delta(self) -> DataFrame:
        return self._by_time(diff.deltas(self.member_snapshot, MEMBER), MEMBER, "member-delta")

    @cached_property
    def team_delta(self) -> DataFrame:
        return self._by_time(diff.deltas(self.team_snapshot, TEAM), TEAM, "team-delta")

    @cached_property
    def member_daily(self) -> DataFrame:
        return self._keep_members(rollups.daily(self.member_delta, MEMBER), "member-daily", "day")

    @cached_property
    def team_daily(self) -> DataFrame:
        return self._keep(rollups.daily(self.team_delta, TEAM), "team-daily")

    @cached_property
    def member_monthly(self) -> DataFrame:
        return self._keep_members(rollups.monthly(self.member_daily, MEMBER), "member-monthly", "month")

    @cached_property
    def team_monthly(self) -> DataFrame:
        return self._keep(rollups.monthly(self.team_daily, TEAM), "team-monthly")

    @cached_property
    def member_state(self) -> DataFrame:
        return self._keep_members(diff.latest_state(self.member_snapshot, MEMBER), "member-state", "name")

    @cached_property
    def team_state(self) -> DataFrame:
        return self._keep(diff.latest_state(self.team_snapshot, TEAM, "team_name"), "team-state")

    @cached_property
    def member_production(self) -> DataFrame:
        state, delta = (lambda: self.member_state), (lambda: self.member_delta)
        if self.world == "daily":  # from the feed's buckets, without a shuffle; written only if something else reads them
            state = state if "member_state" in vars(self) else lambda: diff.latest_state(self.member_snapshot, MEMBER)
            delta = delta if "member_delta" in vars(self) else lambda: diff.deltas(self.member_snapshot, MEMBER)
        return self._keep_members(windows.production(state(), delta(), MEMBER, self.clock), "member-production", "name")

    @cached_property
    def team_production(self) -> DataFrame:
        return self._keep(windows.production(self.team_state, self.team_delta, TEAM, self.clock),
                          "team-production")

    @cached_property
    def members(self) -> DataFrame:
        prod = self.member_production
        return self._build(lambda: marts.member_mart(prod, self.clock), "members")

    @cached_property
    def teams(self) -> DataFrame:
        members, prod = self.member_production, self.team_production  # counts need no ranks
        return self._build(lambda: marts.team_mart(prod, members, self.clock), "teams")

    @cached_property
    def donors(self) -> DataFrame:
        shared = 20 if self.world == "daily" else marts.SHARED_TEAMS
        members = self.member_production  # sums need no ranks
        return self._build(lambda: marts.donor_mart(members, self.clock, shared), "donors")

    # Copies in the order of other reads.
    members_by_name = cached_property(lambda self: self._keep(indexes.by_key(self.members, "name", "team_id"), "members-by-name"))
    donors_by_name = cached_property(lambda self: self._keep(indexes.by_key(self.donors, "name"), "donors-by-name"))
    teams_by_id = cached_property(lambda self: self._keep(indexes.by_key(self.teams, "team_id"), "teams-by-id"))
    donor_index = cached_property(lambda self: self._keep(indexes.search_index(self.donors, "name"), "donor-index"))
    donor_heads = cached_property(lambda self: self._keep(indexes.search_heads(self.donor_index), "donor-heads"))
    team_index = cached_property(lambda self: self._keep(indexes.search_index(self.teams, "team_name", "team_id"), "team-index"))
    team_heads = cached_property(lambda self: self._keep(indexes.search_heads(self.team_index), "team-heads"))

    @cached_property
    def rosters(self) -> DataFrame:
        """Rosters under all orderings, a folder per ordering."""
        mark, path = scratch_mark(), new_path(self.spark, f"{self.world}-rosters")
        rows = indexes.all_rosters(self.members, MEMBER_KEYS)
        rows.sortWithinPartitions("key", "team_id", "position").write.partitionBy("key").parquet(path)
        drop_scratch(self.spark, mark)
        return self.spark.read.schema(rows.schema).parquet(path)

    def roster(self, key: str) -> DataFrame:
        """Rosters under one ordering: read, if all are published, else numbered for this ordering alone."""
        columns = ["team_id", "name", "rank", "value", "position"]
        if "rosters" in self.__dict__:
            return self.rosters.filter(F.col("key") == key).select(*columns)
        return self.once(f"roster-{key}", lambda: marts.roster_of(self.member_production, MEMBER_KEYS[key])).select(*columns)

    @cached_property
    def groups(self) -> DataFrame:
        return A.country_groups(self.spark, self.sf_dir).unionByName(
            A.topic_groups(self.spark, self.sf_dir))

    @cached_property
    def snapshot_meta(self) -> DataFrame:
        return self._keep(A.archive_meta(self.cycles), "snapshot-meta")

    def publish(self) -> "Warehouse":
        """Build every table a read needs; tables that do not need each other go together."""
        for step in (["feed_rows"], ["team_snapshot", "cycles", "member_delta", "member_state"],
                     ["clock"], ["team_delta", "team_state", "member_production", "member_daily"],
                     ["members", "team_production", "team_daily", "member_monthly"], ["teams", "donors", "team_monthly", "rosters", "members_by_name"],
                     ["donors_by_name", "teams_by_id", "donor_index", "team_index"], ["donor_heads", "team_heads"]):
            together(*[lambda name=name: getattr(self, name) for name in step])
        return self

    def lit_at(self):
        return F.lit(self.clock.at).cast("bigint")


class StoreWarehouse(Warehouse):
    """Marts over the tables a cycle ingest has committed, of the newest commit when opened.

    What the ingest keeps by itself (deltas, state, rollups) is read; ranks and marts are built,
    under ``marts/`` beside the tables.
    """

    def __init__(self, spark: SparkSession, store: C.CycleStore, sf_dir: str = "", world: str = "store"):
        super().__init__(spark, sf_dir, world)
        self._store = store
        self.paths: dict[str, str] = {}

    @property
    def store(self) -> C.CycleStore:
        return self._store

    @cached_property
    def commit(self) -> dict:
        return self.store.manifest()

    def _keep(self, df: DataFrame, label: str) -> DataFrame:
        path = self.paths[label] = f"{self.store.out}/marts/{self.commit['seq']:012d}/{label}"
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _table(self, name: str) -> DataFrame:
        return self.store.rows(name, self.commit)

    def _state(self, kind: str) -> DataFrame:
        rows = self.store.state(kind, self.commit)
        names = ["team_name"] if kind == "team" else []
        return self._keep(rows.select(*C.KEYS[kind], *names, "first_seen", F.col("ts").alias("last_seen"), "score", "wus"), f"{kind}-state")

    cycles = cached_property(lambda self: self._table("cycles").select("ts"))
    member_delta = cached_property(lambda self: self._table("member_delta"))
    team_delta = cached_property(lambda self: self._table("team_delta"))
    member_daily = cached_property(lambda self: self._table("member_daily"))
    team_daily = cached_property(lambda self: self._table("team_daily"))
    member_monthly = cached_property(lambda self: self._table("member_monthly"))
    team_monthly = cached_property(lambda self: self._table("team_monthly"))
    member_state = cached_property(lambda self: self._state("member"))
    team_state = cached_property(lambda self: self._state("team"))

    def publish(self) -> "StoreWarehouse":
        """Build the marts, then turn the pointer readers follow to them."""
        self.clock
        for step in (["member_state", "team_state"], ["member_production", "team_production"], ["members"], ["teams", "donors"]):
            together(*[lambda name=name: getattr(self, name) for name in step])
        self.store.point("published", {"seq": self.commit["seq"], "ts": self.commit["ts"], "marts": self.paths})
        return self


def publish_cycle(store: C.CycleStore, newest: int) -> None:
    """Publish hook of :func:`tallywind.streaming.cycles.ingest_cycles`."""
    StoreWarehouse(store.spark, store).publish()


def published(spark: SparkSession, out: str) -> tuple[int, dict[str, DataFrame]]:
    """The newest published cycle of a store and its marts (members, teams, donors), all of it."""
    found = C.CycleStore(spark, out).pointer("published")
    if found is None:
        raise LookupError(f"nothing is published in {out}")
    return found["ts"], {name: spark.read.parquet(found["marts"][name]) for name in ("members", "teams", "donors")}


class IngestedWarehouse(StoreWarehouse):
    """The world ``ingested``: the feeds as an archive, its snapshots written newest first, taken
    up by the cycle ingest some at a time."""

    def __init__(self, spark: SparkSession, sf_dir: str, world: str):
        super().__init__(spark, None, sf_dir, world)

    @cached_property
    def store(self) -> C.CycleStore:
        root, out = new_path(self.spark, "archive"), new_path(self.spark, "cycle-store")
        feeds = {"user": A.spoil_rows(self.raw_member_snapshot), "team": A.published_teams(self.team_snapshot)}
        together(*[lambda feed=feed, rows=rows: snapshots.write_archive(rows, feed, root, A.spoil_meta(snapshots.snapshot_meta(rows, feed)))
                   for feed, rows in feeds.items()])
        return C.ingest_cycles(self.spark, root, out, new_path(self.spark, "cycle-checkpoint"), cycles_per_trigger=400,
                               tolerance=A.FORGED_POINTS // 2, publish=self.after_commit(root))

    def after_commit(self, root: str):
        """What the ingest runs after each commit."""
        return None

    # The feeds themselves are adapters' tables.
    def _keep(self, df: DataFrame, label: str) -> DataFrame:
        return materialize(df, f"{self.world}-{label}") if label in ("feed-rows", "team-feed") else super()._keep(df, label)


class RetainedWarehouse(IngestedWarehouse):
    """The world ``retained``: as ``ingested``, with retention carried out after every commit."""

    def after_commit(self, root: str):
        return lambda store, newest: R.retain(store, root, newest, raw_days=RETAINED["raw"], daily_days=RETAINED["daily"],
                                              archive_days=RETAINED["archive"])
