"""Dense global and in-group positions without collecting an order into one task.

An un-partitioned ``row_number`` runs in a single task, and one partitioned by a hot
group runs that group in a single task. Both are replaced here by a range shuffle on a
unique sort key: rows are numbered inside each range partition while they stream past
(``monotonically_increasing_id`` already carries partition and row index), the numbered
frame is written once so that every later read sees the same partitions, and the
per-partition counts turn into offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywind.session import materialize

_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1


def with_position(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """Add the 1-based position of every row under a *unique* ordering.

    Cost: one range shuffle and one write of ``df``, then a count over one column of the
    written table. The counts are one number per shuffle partition; they come back as a
    constant, so what is returned is a projection of a scan and can be read repeatedly.
    """
    numbered = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("__row", F.monotonically_increasing_id()),
        "positions", scratch=True)
    part = F.shiftright("__row", _ROW_BITS)
    counts = {r[0]: r[1] for r in numbered.groupBy(part).agg(F.count(F.lit(1))).collect()}
    before, total = [], 0
    for i in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(i, 0)
    offsets = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")
    position = F.get(offsets, part.cast("int")) + F.col("__row").bitwiseAND(F.lit(_ROW_MASK)) + 1
    return numbered.withColumn(out, position).drop("__row")


def with_group_position(df: DataFrame, group: list[str], order: list[Column],
                        out: str = "position") -> DataFrame:
    """Position inside each group, with a hot group spread over as many tasks as it needs.

    Sorting by (group, order) makes a group a contiguous run, so a row's position in it is
    its global position less that of the run's first row; the latter is a ``min`` that
    combines map-side, one row per group. Those rows are written first: their size is then known
    before the join is planned, and a few groups do not send all rows through one more shuffle.
    """
    pos = with_position(df, [F.col(g).asc() for g in group] + order, "__pos")
    first = materialize(pos.groupBy(*group).agg((F.min("__pos") - 1).alias("__first")), "group-starts", scratch=True)
    return (pos.join(first, group, "left")
            .withColumn(out, F.col("__pos") - F.col("__first"))
            .drop("__pos", "__first"))


def with_tie_width(df: DataFrame, value: str, out: str = "tie") -> DataFrame:
    """How many rows share each row's value.

    Counted with a map-side combine and joined back, so a plateau holding most of the
    rows never sits in one window; the join's hot key is left to the skew-join split.
    """
    runs = df.groupBy(value).agg(F.count(F.lit(1)).alias(out))
    return df.join(runs, value, "left")


def page(df: DataFrame, position: str, page_no: int = 1, per_page: int = 100) -> DataFrame:
    """One page as a predicate on position; a page past the end is empty."""
    if page_no < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= per_page <= 1000:
        raise ValueError("per_page must be between 1 and 1000")
    lo = (page_no - 1) * per_page
    return df.filter((F.col(position) > F.lit(lo)) & (F.col(position) <= F.lit(lo + per_page)))


def page_of_anchor(anchor: Column, per_page: int) -> Column:
    """Page number that contains a 1-based anchor position."""
    return F.floor((anchor - 1) / F.lit(per_page)).cast("bigint") + 1


def clamped_window(rank: Column, n: int, total: Column) -> tuple[Column, Column]:
    """(lo, hi) inclusive ranks within ``n`` places of ``rank``, cut off at the ends."""
    known = rank.isNotNull()  # greatest and least skip NULLs: no subject must mean no window
    return F.when(known, F.greatest(F.lit(1), rank - n)), F.when(known, F.least(total, rank + n))


def recentred_window(rank: Column, n: int, total: Column) -> tuple[Column, Column]:
    """Like :func:`clamped_window`, but shifted at the ends so it keeps its width."""
    lo, hi = rank - n, rank + n
    shifted_hi = F.when(lo < 1, F.least(hi - lo + 1, total)).otherwise(hi)
    shifted_lo = F.greatest(F.lit(1), lo)
    over = shifted_hi > total
    return (F.when(over, F.greatest(F.lit(1), shifted_lo - (shifted_hi - total))).otherwise(shifted_lo),
            F.when(over, total).otherwise(shifted_hi))
