"""Retention carried out on a cycle store and its archive.

Rows are cut in two steps. A commit raises the floors in the manifest: days of deltas below the raw
floor, and buckets of the daily tables below theirs, are no longer read, all at once. ``sweep`` then
deletes the folders none of the newest manifests reads. Snapshots are thinned by a log: the plan is
written as a table, then pointed to; each snapshot in it is renamed into a trash folder, the trash is
deleted, and the log entry is confirmed. Every step may be repeated, so a run that broke off is ended
by the next one.

Rollups never lose by it: deltas are cut by whole days before the day of the newest cycle, days by
whole months before its month, and the ingest never takes up a cycle at or before the newest commit,
so no day or month that is rolled up again has lost a row. Months are never cut. Of the archive, only
snapshots older than the newest commit are thinned, and never the team snapshot later cycles may
still be paired with.

Defined cases: a store without a commit is left as it is; floors never fall, also when ``now`` or the
days kept change; ``daily_days`` None keeps all days; repeating a call changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallywind.functions import scalars as S
from tallywind.schemas import DAY
from tallywind.session import delete_path
from tallywind.sources import archive, snapshots
from tallywind.streaming.cycles import BUCKETED, RAW, CycleStore

#: Tables the daily floor cuts.
DAILY = [t for t, (bucket, _) in BUCKETED.items() if bucket == "day"]


def _month_floor(store: CycleStore, day: int) -> int:
    start = S.month_start_day(S.month_of_day(F.lit(day).cast("bigint")))
    return store.spark.range(1).select(start.alias("d")).first()["d"]


def raise_floors(store: CycleStore, now: int, raw_days: int, daily_days: int | None) -> dict:
    """Commit the floors ``now`` asks for; returns the manifest that holds."""
    old = store.manifest()
    newest = old["ts"] // DAY
    held = old.get("floors", {})
    raw = max(held.get("raw", 0), min(now // DAY - raw_days, newest))
    daily = held.get("daily", 0)
    if daily_days is not None:
        daily = max(daily, _month_floor(store, min(now // DAY - daily_days, newest)))
    floors = {"raw": raw, "daily": daily}
    if floors == {"raw": held.get("raw", 0), "daily": held.get("daily", 0)}:
        return old
    tables = dict(old["tables"])
    for t in DAILY:
        tables[t] = {b: p for b, p in tables.get(t, {}).items() if int(b) >= daily}
    new = {**old, "seq": old["seq"] + 1, "tables": tables, "floors": floors}
    store.commit(new)
    return new


def sweep(store: CycleStore, keep: int = 2) -> int:
    """Delete the day folders below the floors of all of the newest ``keep`` manifests; returns how many."""
    floors = [m.get("floors", {}) for m in store.manifests(keep)]
    gone = 0
    for tables, name in ((RAW, "raw"), (DAILY, "daily")):
        floor = min((f.get(name, 0) for f in floors), default=0)
        for t in tables:
            root, files = store._fs(f"{store.out}/{t}")
            for part in files.listStatus(root) if floor and files.exists(root) else []:
                if part.getPath().getName().startswith("part="):
                    gone += archive.delete_partitions(store.spark, part.getPath().toString(), "day", lambda d: int(d) >= floor)
    return gone


def plan_thinning(store: CycleStore, root: str, now: int, full_days: int, keep_daily: bool) -> None:
    """Write the plan of the snapshots to delete and point to it."""
    held = store.manifest()
    reader = snapshots.SnapshotReader(root, -1, 0)
    listed = [(feed, ts) for p in reader.partitions({"ts": -1}, {"ts": held["ts"] - 1}) for feed, ts, _ in reader.read(p)]  # one row per file
    rows = archive.thinning(store.spark.createDataFrame(listed, "feed string, snapshot_ts bigint"), now, full_days, keep_daily)
    needed = (F.col("feed") == "team") & (F.col("snapshot_ts") == F.lit(held["team_ts"]).cast("bigint"))
    path = f"{store.out}/_plans/{uuid.uuid4().hex}"
    rows.filter("action = 'delete'").filter(~F.coalesce(needed, F.lit(False))).select("feed", "snapshot_ts").write.parquet(path)
    seq = (store.pointer("retention") or {"seq": 0})["seq"] + 1
    store.point("retention", {"seq": seq, "root": root, "plan": path, "done": False})


def carry_out(store: CycleStore) -> int:
    """End the plan last pointed to, if it is not confirmed; returns how many snapshots went."""
    log = store.pointer("retention")
    if log is None or log["done"]:
        return 0
    trash, gone = f"{log['root']}/_trash/{log['seq']:012d}", 0
    rows = store.spark.read.schema("feed string, snapshot_ts bigint").parquet(log["plan"])
    for r in rows.orderBy("feed", "snapshot_ts").toLocalIterator():
        name = f"snapshot_ts={r['snapshot_ts']}"
        source, files = store._fs(f"{log['root']}/{r['feed']}/date={snapshots.date_of(r['snapshot_ts'])}/{name}")
        if not files.exists(source):
            continue  # an earlier try moved it
        target, _ = store._fs(f"{trash}/{r['feed']}/{name}")
        files.mkdirs(target.getParent())
        if not files.rename(source, target):
            raise RuntimeError(f"{source.toString()} was not moved to the trash")
        gone += 1
    delete_path(store.spark, trash)
    store.point("retention", {**log, "done": True})
    return gone


def retain(store: CycleStore, root: str, now: int | None = None, raw_days: int = 30, daily_days: int | None = None,
           archive_days: int = 90, keep_daily: bool = True) -> dict[str, int]:
    """Apply the retention rules as of ``now`` (the newest cycle, if None): deltas of ``raw_days``
    and days of ``daily_days`` are kept, snapshots of ``archive_days`` and the first of each older day.

    Returns how many snapshots and day folders were deleted. May be the ``publish`` hook of an ingest.
    """
    if store.manifest()["ts"] < 0:
        return {"snapshots": 0, "folders": 0}
    now = store.manifest()["ts"] if now is None else now
    gone = carry_out(store)  # what an earlier run left
    raise_floors(store, now, raw_days, daily_days)
    plan_thinning(store, root, now, archive_days, keep_daily)
    return {"snapshots": gone + carry_out(store), "folders": sweep(store)}
