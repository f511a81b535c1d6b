"""Headline timings on one machine; prints one JSON line.

``publish_*`` builds every table of a world from the given Parquet files (feeds, deltas,
state, rollups, ranks); the other queries read those tables, as a deployment does.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallywind.plans.catalog import QUERIES  # noqa: E402
from tallywind.plans.warehouse import Warehouse  # noqa: E402
from tallywind.session import cleanup, local_session  # noqa: E402

HEADLINE = [
    "member_deltas", "member_deltas_daily", "member_snapshot_dedup", "entity_ordinals", "member_rank", "donor_rank",
    "in_team_rank", "tie_width", "rolling_24h", "rolling_7d", "per_day_avg", "donor_periods", "project_summary",
    "member_daily", "member_monthly", "project_rebuild", "teams_by_last_24h", "donors_by_per_day", "roster_by_per_day",
    "rivals_donor", "movers_donor", "team_activity", "donor_streaks", "donor_detail", "history_project_hourly",
    "history_donor_weekly", "history_densified", "contributions", "group_totals", "search_donors", "changed_donors",
    "event_percentiles", "event_rate_60s", "cycle_audit", "reconcile_excess", "pair_snapshots",
    "history_member_monthly", "stream_deltas", "stream_event_rate", "stream_daily", "stream_ingest", "parse_user_feed", "alerts_rank", "alerts_idle",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    times: dict[str, float] = {}
    drain(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count())  # start the executors
    for world in ("hourly", "daily"):
        t = time.perf_counter()
        Warehouse(spark, sf_dir, world).publish()
        times[f"publish_{world}"] = time.perf_counter() - t
    for key in HEADLINE:  # tables are built on first use, outside the timings below
        QUERIES[key](spark, sf_dir)
    for key in HEADLINE:
        t = time.perf_counter()
        drain(QUERIES[key](spark, sf_dir))
        times[key] = time.perf_counter() - t
    cleanup(spark)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
