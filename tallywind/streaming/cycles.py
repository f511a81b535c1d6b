"""Both feeds as one cycle: admitted together, applied together, committed together.

A micro-batch holds the snapshots of some cycles in their order. User snapshots are paired with
the newest team snapshot at or before them, each snapshot is checked (metadata, row count,
digest, row limit, signs, sums inside BIGINT), teams whose members claim more than they hold lose their
member rows for that cycle, and what is left is differenced against the state before the batch.
A cycle with a refused snapshot is not applied and is listed in ``quarantine``; it holds up nothing.

Every table of a batch is written to a part of its own. Then one small manifest file is renamed
into ``_commits``; only what the newest manifest names is read. So readers see all tables of a
cycle or none, and a batch that broke off leaves nothing but unnamed parts, which its next try
writes anew. Buckets (days, months) are replaced by naming a new part for them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from tallywind.functions import scalars as S
from tallywind.operators import diff, rollups
from tallywind.operators.pairing import pair_snapshots
from tallywind.schemas import MAX_TEAM_ROWS, MAX_USER_ROWS
from tallywind.session import delete_path, list_partitions, path_exists, together
from tallywind.sources import snapshots as A
from tallywind.streaming.differencing import deltas_of, difference
from tallywind.streaming.runner import run_available

#: Parts after which the newest are merged into one.
FOLD_AFTER = 16
#: Points a team's members may claim beyond the team's own before their rows are dropped.
TOLERANCE = 1_000_000_000

KEYS = {"member": diff.MEMBER, "team": diff.TEAM}
_KEY = {"member": "name string, team_id int", "team": "team_id int"}
_TOTALS = "first_seen bigint, ts bigint, score bigint, wus bigint"
#: Tables that grow by a part per batch.
APPENDED = {
    "cycles": "ts bigint, team_ts bigint, user_ts bigint, team_rows bigint, user_rows bigint, malformed bigint, new_members bigint, "
              "new_teams bigint, member_deltas bigint, team_deltas bigint, regressions bigint",
    "quarantine": "ts bigint, feed string, snapshot_ts bigint, reason string",
    "over_claims": "ts bigint, team_id int, excess bigint, member_rows bigint",
    "project_cycle": "ts bigint, d_score bigint, d_wu bigint",
    **{f"{k}_delta": f"{_KEY[k]}, ts bigint, d_score bigint, d_wu bigint" for k in KEYS},
    "member_state": f"{_KEY['member']}, {_TOTALS}", "team_state": f"{_KEY['team']}, team_name string, {_TOTALS}",
}
#: Tables retention cuts by day.
RAW = [f"{k}_delta" for k in KEYS]
#: Tables of which a batch replaces whole buckets.
BUCKETED = {
    **{f"{k}_daily": ("day", f"{_KEY[k]}, points bigint, wus bigint") for k in KEYS},
    **{f"{k}_monthly": ("month", f"{_KEY[k]}, points bigint, wus bigint") for k in KEYS},
    "project_daily": ("day", "points bigint, wus bigint"), "project_monthly": ("month", "points bigint, wus bigint"),
}


class CycleStore:
    """The committed tables under ``out``."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest commit: seq, newest cycle applied, newest team snapshot seen, parts by table."""
        return self.pointer("commits") or {"seq": 0, "ts": -1, "team_ts": None, "tables": {}}

    def commit(self, manifest: dict) -> None:
        """Make ``manifest`` the one readers find: written aside, then renamed."""
        aside, files = self._fs(f"{self.out}/_commits/.{uuid.uuid4().hex}")
        stream = files.create(aside, True)
        stream.writeBytes(json.dumps(manifest))
        stream.close()
        final, _ = self._fs(f"{self.out}/_commits/{manifest['seq']:012d}.json")
        if not files.rename(aside, final):
            raise RuntimeError(f"cycle commit {manifest['seq']} was made by another writer")

    def point(self, name: str, value: dict) -> None:
        """Set a named pointer to ``value``; readers find the old value or the new one."""
        aside, files = self._fs(f"{self.out}/_{name}/.{uuid.uuid4().hex}")
        stream = files.create(aside, True)
        stream.writeBytes(json.dumps(value))
        stream.close()
        final, _ = self._fs(f"{self.out}/_{name}/{value['seq']:012d}.json")
        files.delete(final, False)
        files.rename(aside, final)

    def pointer(self, name: str) -> dict | None:
        """The newest value of a named pointer."""
        p, files = self._fs(f"{self.out}/_{name}")
        names = sorted(f.getPath().getName() for f in files.listStatus(p)) if files.exists(p) else []
        names = [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        return self._load(f"{self.out}/_{name}/{names[-1]}") if names else None

    def manifests(self, keep: int) -> list[dict]:
        """The newest ``keep`` commits, oldest first."""
        p, files = self._fs(f"{self.out}/_commits")
        names = sorted(f.getPath().getName() for f in files.listStatus(p)) if files.exists(p) else []
        names = [n for n in names if n.endswith(".json") and not n.startswith(".")]
        return [self._load(f"{self.out}/_commits/{n}") for n in names[-keep:]]

    def _load(self, path: str) -> dict:
        p, files = self._fs(path)
        stream = files.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def schema(self, table: str) -> StructType:
        if table in APPENDED:
            day = ", day bigint" if "ts bigint" in APPENDED[table] and not table.endswith("_state") else ""
            return _parse_datatype_string(APPENDED[table] + day)
        bucket, columns = BUCKETED[table]
        return _parse_datatype_string(f"{columns}, {bucket} bigint")

    def parts(self, table: str, named, buckets: list[int] | None = None) -> DataFrame:
        """The rows of some parts of a table; ``named``: a list of parts, or parts by bucket."""
        schema = self.schema(table)
        if table in APPENDED:
            paths = [f"{self.out}/{table}/part={p}" for p in named or []]
        else:
            bucket = BUCKETED[table][0]
            paths = [f"{self.out}/{table}/part={p}/{bucket}={b}" for b, p in sorted((named or {}).items()) if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.out}/{table}").parquet(*paths).select(*schema.names)

    def read(self, table: str) -> DataFrame:
        """A table as of the newest commit."""
        if table in ("member_state", "team_state"):
            return self.state(table.removesuffix("_state"), self.manifest())
        return self.rows(table, self.manifest())

    def rows(self, table: str, manifest: dict) -> DataFrame:
        """A table other than the states as of a manifest; deltas from its floor on."""
        rows = self.parts(table, manifest["tables"].get(table))
        floor = manifest.get("floors", {}).get("raw", 0)
        if floor and table in RAW:
            rows = rows.filter(F.col("day") >= F.lit(floor))
        return rows.drop("day") if table in APPENDED else rows

    def state(self, kind: str, manifest: dict) -> DataFrame:
        """Totals of every entity as of a manifest: keys, [team_name], first_seen, ts, score, wus."""
        rows = self.parts(f"{kind}_state", manifest["tables"].get(f"{kind}_state"))
        newest = [F.max_by(c, "ts").alias(c) for c in rows.columns if c not in (*KEYS[kind], "first_seen", "ts")]
        out = rows.groupBy(*KEYS[kind]).agg(F.min("first_seen").alias("first_seen"), F.max("ts").alias("ts"), *newest)
        return out.select(*rows.columns)

    def write(self, df: DataFrame, table: str, part: str) -> None:
        schema = self.schema(table)
        if "day" in schema.names and table in APPENDED:
            df = df.withColumn("day", S.day_index("ts"))
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        by = [BUCKETED[table][0]] if table in BUCKETED else ["day"] if "day" in schema.names else []
        if by:
            df = df.repartition(*by, F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(8))) if table in BUCKETED else df
        path = f"{self.out}/{table}/part={part}"
        delete_path(self.spark, path)
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)

    def written(self, table: str, part: str) -> list[int]:
        return list_partitions(self.spark, f"{self.out}/{table}/part={part}", BUCKETED[table][0])


def check(rows: DataFrame, feed: str, meta: DataFrame, max_rows: int) -> DataFrame:
    """(snapshot_ts, rows, malformed, verdict) of each snapshot in ``rows``: ok or why it is refused."""
    valid = F.coalesce((F.col("score") >= 0) & (F.col("wus") >= 0) & F.col("team_id").isNotNull(), F.lit(False))
    seen = rows.groupBy("snapshot_ts").agg(
        F.count(F.lit(1)).alias("rows"), A.row_digest(feed).alias("found"), F.count_if(~valid).alias("bad"),
        (F.try_sum("score").isNull() | F.try_sum("wus").isNull()).alias("over"))
    told = meta.filter(F.col("feed") == feed).select("snapshot_ts", "row_count", "digest", "malformed")
    verdict = (F.when(F.col("row_count").isNull(), "no metadata").when(F.col("row_count") != F.col("rows"), "rows differ")
               .when(F.col("digest") != F.col("found"), "digest differs").when(F.col("rows") > max_rows, "too many rows")
               .when(F.col("bad") > 0, "invalid rows").when(F.col("over"), "totals overflow").otherwise("ok"))
    return seen.join(told, "snapshot_ts", "left").select("snapshot_ts", "rows", F.coalesce("malformed", F.lit(0)).alias("malformed"), verdict.alias("verdict"))


def _fold(store: CycleStore, table: str, parts: list[str], part: str) -> list[str]:
    """The parts of a table with those of the last FOLD_AFTER batches merged into one."""
    loose = [p for p in parts if not p.endswith("f")]
    if len(loose) < FOLD_AFTER:
        return parts
    if table.endswith("_state"):
        kept, rows = [], store.state(table.removesuffix("_state"), {"tables": {table: parts}})
    else:
        kept, rows = [p for p in parts if p.endswith("f")], store.parts(table, loose)
    store.write(rows, table, f"{part}f")
    return [*kept, f"{part}f"]


def apply_cycles(store: CycleStore, root: str, listed: list[tuple[str, int]], tolerance: int, max_user: int, max_team: int) -> int | None:
    """Apply the listed snapshots (feed, snapshot_ts) of the archive ``root`` as one commit;
    returns the newest cycle taken up, None if there was none to take."""
    spark, old = store.spark, store.manifest()
    part, out = f"{old['seq'] + 1:08d}", store.out
    teams = sorted({ts for feed, ts in listed if feed == "team"} | ({old["team_ts"]} if old["team_ts"] is not None else set()))
    users = sorted({ts for feed, ts in listed if feed == "user" and ts > old["ts"]})
    if not users:
        return None
    meta = spark.createDataFrame([("team", t) for t in teams] + [("user", t) for t in users], "feed string, snapshot_ts bigint")
    staged = f"{out}/_staged/{part}"

    def stage(df: DataFrame, label: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{staged}/{label}")
        return spark.read.schema(df.schema).parquet(f"{staged}/{label}")

    pairs = stage(pair_snapshots(meta), "pairs")
    user_dates = sorted({A.date_of(t) for t in users})
    team_dates = sorted({A.date_of(t) for t in teams})
    lo, hi = F.lit(users[0]), F.lit(users[-1])
    user_rows = A.read_feed(spark, root, "user", user_dates).filter(F.col("snapshot_ts").between(lo, hi))
    asked = pairs.select("team_ts").distinct()
    team_rows = A.read_feed(spark, root, "team", team_dates).join(asked, F.col("snapshot_ts") == F.col("team_ts"), "left_semi")
    told = A.read_meta(spark, root, sorted({*user_dates, *team_dates}))
    user_check, team_check = together(lambda: stage(check(user_rows, "user", told, max_user), "user-check"),
                                      lambda: stage(check(team_rows, "team", told, max_team), "team-check"))
    side = lambda df, feed: df.select(F.col("snapshot_ts").alias(f"{feed}_ts"), F.col("rows").alias(f"{feed}_rows"),
                                      F.col("malformed").alias(f"{feed}_malformed"), F.col("verdict").alias(f"{feed}_verdict"))
    judged = pairs.join(side(user_check, "user"), "user_ts", "left").join(side(team_check, "team"), "team_ts", "left")
    # A snapshot without a row is a feed that broke off, whatever its metadata say.
    for feed in ("user", "team"):
        judged = judged.withColumn(f"{feed}_verdict", F.coalesce(f"{feed}_verdict", F.lit("no rows")))
    judged = stage(judged, "judged")
    good = judged.filter("user_verdict = 'ok' AND team_verdict = 'ok'")
    refused = judged.select("ts", F.explode(F.filter(F.array(*[
        F.struct(F.lit(f).alias("feed"), F.col(f"{f}_ts").alias("snapshot_ts"), F.col(f"{f}_verdict").alias("reason")) for f in ("team", "user")]),
        lambda x: x["reason"] != "ok")).alias("r")).select("ts", "r.feed", "r.snapshot_ts", "r.reason")

    named = [F.col(c) for c in ("team_id", "score", "wus")]
    member = user_rows.join(good.select(F.col("user_ts").alias("snapshot_ts"), "ts"), "snapshot_ts").select("name", *named, F.col("ts").alias("snapshot_ts"))
    team = (team_rows.withColumnRenamed("snapshot_ts", "team_ts").join(good.select("team_ts", "ts"), "team_ts")
            .select("team_name", *named, F.col("ts").alias("snapshot_ts")))
    excess = stage(diff.reconcile(team, member, tolerance), "excess")
    before = {k: store.state(k, old) for k in KEYS}
    kept = {"member": diff.drop_over_claims(member, excess), "team": team}
    moves = dict(zip(KEYS, together(*[lambda k=k: stage(difference(kept[k], KEYS[k], before[k], None), f"{k}-moves") for k in KEYS])))

    def changed(kind: str) -> DataFrame:
        rows = moves[kind].groupBy(*KEYS[kind]).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("ts"),
                                                    F.max_by("score", "ts").alias("score"), F.max_by("wus", "ts").alias("wus"))
        if kind == "member":
            return rows
        return rows.join(team.groupBy("team_id").agg(F.max_by("team_name", "snapshot_ts").alias("team_name")), "team_id")

    def counted(kind: str) -> DataFrame:
        return moves[kind].groupBy("ts").agg(F.count_if("first_sighting").alias(f"new_{kind}s"), F.count_if("is_delta").alias(f"{kind}_deltas"),
                                             F.count_if(F.col("d_score") < 0).alias(f"{kind}_regressions"))

    audit = good.join(counted("member"), "ts", "left").join(counted("team"), "ts", "left").fillna(0)
    audit = audit.withColumn("malformed", F.col("user_malformed") + F.col("team_malformed")).withColumn(
        "regressions", F.col("member_regressions") + F.col("team_regressions"))
    appended = {
        "cycles": audit, "quarantine": refused, "over_claims": excess.withColumnRenamed("snapshot_ts", "ts"),
        "project_cycle": rollups.project_deltas(deltas_of(moves["team"], diff.TEAM)),
        **{f"{k}_delta": deltas_of(moves[k], KEYS[k]) for k in KEYS}, **{f"{k}_state": changed(k) for k in KEYS},
    }
    together(*[lambda t=t, df=df: store.write(df, t, part) for t, df in appended.items()])
    new = {**old, "seq": old["seq"] + 1, "ts": users[-1], "team_ts": max((t for t in teams if t <= users[-1]), default=None),
           "tables": {**old["tables"], **{t: [*old["tables"].get(t, []), part] for t in appended}}}

    # One value per day in the batch.
    days = [r["day"] for r in good.select(S.day_index("ts").alias("day")).distinct().collect()]
    months = [r["m"] for r in good.select(S.month_of_day(S.day_index("ts")).alias("m")).distinct().collect()]

    def replace(table: str, df: DataFrame, buckets: list[int]) -> None:
        store.write(df, table, part)
        held = {b: p for b, p in new["tables"].get(table, {}).items() if int(b) not in buckets}
        new["tables"][table] = {**held, **{str(b): part for b in store.written(table, part)}}

    def roll(kind: str) -> None:
        delta = store.parts(f"{kind}_delta", new["tables"][f"{kind}_delta"]).filter(F.col("day").isin(days)).drop("day")
        replace(f"{kind}_daily", rollups.daily(delta, KEYS[kind]), days)
        lo, hi = S.month_start_day(F.lit(min(months)).cast("bigint")), S.month_start_day(F.lit(max(months) + 1).cast("bigint"))
        daily = store.parts(f"{kind}_daily", new["tables"][f"{kind}_daily"]).filter((F.col("day") >= lo) & (F.col("day") < hi))
        replace(f"{kind}_monthly", rollups.monthly(daily, KEYS[kind]).filter(F.col("month").isin(months)), months)

    if days:
        together(lambda: roll("member"), lambda: roll("team"))
        for grain, buckets in (("daily", days), ("monthly", months)):
            bucket = BUCKETED[f"project_{grain}"][0]
            rows = store.parts(f"team_{grain}", new["tables"][f"team_{grain}"], buckets)
            replace(f"project_{grain}", rows.groupBy(bucket).agg(F.sum("points").alias("points"), F.sum("wus").alias("wus")), buckets)
    for t in APPENDED:
        new["tables"][t] = _fold(store, t, new["tables"][t], part)
    store.commit(new)
    delete_path(spark, staged)
    return users[-1]


def vacuum(store: CycleStore, keep: int = 2) -> int:
    """Delete the parts no one of the newest ``keep`` manifests names; returns how many."""
    p, files = store._fs(f"{store.out}/_commits")
    names = sorted(f.getPath().getName() for f in files.listStatus(p) if f.getPath().getName().endswith(".json"))
    live: dict[str, set[str]] = {}
    for name in names[-keep:]:
        for t, parts in store._load(f"{store.out}/_commits/{name}")["tables"].items():
            live.setdefault(t, set()).update(parts.values() if isinstance(parts, dict) else parts)
    gone = 0
    for t, parts in live.items():
        root, fs = store._fs(f"{store.out}/{t}")
        for f in fs.listStatus(root):
            if f.getPath().getName().removeprefix("part=") not in parts:
                gone += bool(fs.delete(f.getPath(), True))
    return gone


def ingest_cycles(spark: SparkSession, root: str, out: str, checkpoint: str, cycles_per_trigger: int | None = None,
                  tolerance: int = TOLERANCE, max_user_rows: int = MAX_USER_ROWS, max_team_rows: int = MAX_TEAM_ROWS,
                  publish: Callable[[CycleStore, int], None] | None = None) -> CycleStore:
    """Apply every archived cycle after the newest one committed, in the order of their times.

    ``cycles_per_trigger`` bounds a commit. ``publish(store, newest_cycle)`` runs after a commit.
    Cycles at or before the newest one committed are late and never taken up.
    """
    store = CycleStore(spark, out)

    def body(batch: DataFrame, batch_id: int) -> None:
        listed = [(r["feed"], r["snapshot_ts"]) for r in batch.collect()]  # one row per snapshot file
        newest = apply_cycles(store, root, listed, tolerance, max_user_rows, max_team_rows)
        if newest is not None and publish is not None:
            publish(store, newest)

    while True:
        before = store.manifest()["ts"]
        run_available(A.open_snapshots(spark, root, before, cycles_per_trigger), checkpoint, body)
        if cycles_per_trigger is None or store.manifest()["ts"] == before:
            return store
