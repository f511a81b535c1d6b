"""Scalar functions over Columns: buckets, rates, projections, tiers, formatting, parsing.

Everything here is a built-in expression, so it stays inside whole-stage codegen. Instants
are unix seconds in BIGINT columns, which keeps them independent of the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywind.schemas import DAY, MAX_TEAM_ID, NANOS, WEEK

# Fixed value: day number of 1970-01-04, the first Sunday of the epoch.
FIRST_SUNDAY = 3
# Fixed value: projections further out than this many days are not reported.
HORIZON_DAYS = 3650
# Points-per-day tier bounds.
TIER_BOUNDS = (150_000, 500_000, 1_000_000, 2_500_000, 10_000_000)
# Streak tier bounds in days.
STREAK_BOUNDS = (1, 3, 7, 30, 100, 365)
# Milestone ladder 1-2-5 per decade between these decades.
MILESTONE_FIRST = 1_000_000
MILESTONE_LAST = 5_000_000_000_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def idiv(a, b) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", _c(a), _c(b))


def floor_div(a, b: int) -> Column:
    a = _c(a)
    return idiv(a - F.pmod(a, F.lit(b).cast("bigint")), F.lit(b).cast("bigint"))


# --- time buckets ---------------------------------------------------------------------

def day_index(ts) -> Column:
    return floor_div(ts, DAY)


def week_of_day(day) -> Column:
    """Dense index of the Sunday-start week a day number falls in."""
    return floor_div(_c(day) - F.lit(FIRST_SUNDAY), 7)


def week_index(ts) -> Column:
    return week_of_day(day_index(ts))


def week_start_day(week) -> Column:
    return _c(week) * F.lit(7) + F.lit(FIRST_SUNDAY)


def day_date(day) -> Column:
    return F.date_from_unix_date(_c(day).cast("int"))


def month_of_day(day) -> Column:
    """year * 12 + month - 1."""
    d = day_date(day)
    return (F.year(d) * 12 + F.month(d) - 1).cast("bigint")


def month_index(ts) -> Column:
    return month_of_day(day_index(ts))


def month_start_day(month) -> Column:
    m = _c(month)
    return F.unix_date(F.make_date(idiv(m, 12).cast("int"),
                                   (F.pmod(m, F.lit(12)) + 1).cast("int"), F.lit(1))).cast("bigint")


# --- rates and projections ------------------------------------------------------------

def points_per_wu(points, wus) -> Column:
    p, w = _c(points), _c(wus)
    return F.when(w > 0, idiv(p + idiv(w, 2), w)).otherwise(F.lit(0).cast("bigint"))


def per_day(points, span_ns) -> Column:
    """Points per day over an observed span in nanoseconds.

    A full week divides exactly by seven, rounding half away from zero; a shorter span
    divides by the part of it that was observed; nothing observed is zero.
    """
    p, s = _c(points), _c(span_ns)
    week = idiv(F.when(p < 0, p - 3).otherwise(p + 3), 7)
    part = F.round(p.cast("double") / (s.cast("double") / F.lit(float(DAY) * NANOS)))
    return (F.when(s >= F.lit(WEEK * NANOS), week)
            .when(s <= 0, F.lit(0).cast("bigint"))
            .otherwise(part.cast("bigint")))


def overtake(now, self_points, self_rate, other_points, other_rate) -> tuple[Column, Column, Column]:
    """(gap, days, at): when two totals cross if both keep their daily rate."""
    a, b = _c(self_points), _c(other_points)
    gap = F.abs(a - b)
    closing = F.when(a > b, _c(other_rate) - _c(self_rate)).otherwise(_c(self_rate) - _c(other_rate))
    raw = F.when(closing > 0, gap.cast("double") / closing.cast("double"))
    days = (F.when(gap == 0, F.lit(0.0))
            .when(raw <= F.lit(float(HORIZON_DAYS)), F.round(raw * 100) / 100))
    at = _c(now).cast("bigint") + F.round(days * F.lit(float(DAY))).cast("bigint")
    return gap, days, at


def required_rate(self_points, target_points, target_rate, days) -> Column:
    """Daily rate that reaches a target which is itself moving, within ``days``."""
    d = _c(days).cast("double")
    finish = _c(target_points).cast("double") + _c(target_rate).cast("double") * d
    return F.ceil((finish - _c(self_points).cast("double")) / d).cast("bigint")


def top_percent(position, field) -> Column:
    p, n = _c(position), _c(field)
    share = p.cast("double") / n.cast("double") * F.lit(100.0)
    return F.when((p > 0) & (n > 0), F.round(share * F.lit(1e6)) / F.lit(1e6))


# --- tiers and targets ----------------------------------------------------------------

def production_tier(rate) -> Column:
    r = F.coalesce(_c(rate), F.lit(0))
    out = F.when(r <= 0, F.lit(0))
    for i, bound in enumerate(TIER_BOUNDS, start=1):
        out = out.when(r < F.lit(bound), F.lit(i))
    return out.otherwise(F.lit(len(TIER_BOUNDS) + 1))


def streak_tier(days) -> Column:
    d = _c(days)
    out = F.when(d >= F.lit(STREAK_BOUNDS[-1]), F.lit(len(STREAK_BOUNDS)))
    for i in range(len(STREAK_BOUNDS) - 2, -1, -1):
        out = out.when(d >= F.lit(STREAK_BOUNDS[i]), F.lit(i + 1))
    return out.otherwise(F.lit(0))


def heat_level(value, peak) -> Column:
    """0 for nothing, else 1..4 on a log scale of the peak (itself at least 1)."""
    v = _c(value).cast("double")
    p = F.greatest(_c(peak).cast("double"), F.lit(1.0))
    level = F.ceil(F.log1p(v) / F.log1p(p) * 4).cast("int")
    return F.when(F.coalesce(v, F.lit(0.0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), level))


def _decade(x: Column) -> Column:
    """Largest power of ten at or below a positive integer, exact in BIGINT."""
    digits = F.length(x.cast("string"))
    return F.rpad(F.lit("1"), digits, F.lit("0")).cast("bigint")


def milestone_at_or_below(points) -> Column:
    p = F.least(_c(points), F.lit(MILESTONE_LAST))
    d = _decade(F.greatest(p, F.lit(1)))
    lead = idiv(p, d)
    step = F.when(lead >= 5, 5).when(lead >= 2, 2).otherwise(1)
    return F.when(p >= F.lit(MILESTONE_FIRST), step * d).otherwise(F.lit(0)).cast("bigint")


def next_milestone(points) -> Column:
    p = _c(points)
    d = _decade(F.greatest(p, F.lit(1)))
    lead = idiv(p, d)
    step = F.when(lead >= 5, 10).when(lead >= 2, 5).otherwise(2)
    return (F.when(p < F.lit(MILESTONE_FIRST), F.lit(MILESTONE_FIRST))
            .when(p >= F.lit(MILESTONE_LAST), F.lit(0))
            .otherwise(step * d)).cast("bigint")


def next_point_target(points) -> Column:
    p = _c(points)
    step = F.greatest(F.lit(1000), idiv(_decade(F.greatest(p, F.lit(1))), 10)).cast("bigint")
    return (idiv(p, step) + 1) * step


def next_rank_target(rank) -> Column:
    r = _c(rank).cast("bigint")
    step = _decade(F.greatest(r, F.lit(1)))
    return F.when(r > 1, F.greatest(F.lit(1).cast("bigint"), idiv(r - 1, step) * step))


# --- formatting -----------------------------------------------------------------------

# Compact number suffixes.
SUFFIXES = ((10 ** 12, "T"), (10 ** 9, "B"), (10 ** 6, "M"), (10 ** 3, "K"))


def grouped(n) -> Column:
    return F.format_number(_c(n), 0)


def compact(n, keep_zero_digits: bool = False) -> Column:
    """1.5M, 2T, 12. With ``keep_zero_digits`` only a bare .00 is dropped (1.50M)."""
    v = _c(n)
    out = None
    for bound, suffix in SUFFIXES:
        q = v.cast("double") / F.lit(float(bound))
        if keep_zero_digits:
            text = F.regexp_replace(F.call_function("format_number", q, F.lit("0.00")), r"\.00$", "")
        else:
            text = F.call_function("format_number", q, F.lit("0.##"))
        text = F.concat(text, F.lit(suffix))
        cond = v >= F.lit(bound)
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out.otherwise(v.cast("string"))


def percent_text(p) -> Column:
    v = _c(p)
    fmt = lambda f: F.concat(F.call_function("format_number", v, F.lit(f)), F.lit("%"))
    return (F.when(v >= 10, fmt("0")).when(v >= 1, fmt("0.0"))
            .when(v >= 0.01, fmt("0.00")).otherwise(F.lit("<0.01%")))


def duration_text(days) -> Column:
    """A span of days in the coarsest unit worth naming."""
    d = _c(days)
    n = lambda x: F.floor(x + 0.5).cast("bigint").cast("string")
    hours = F.greatest(F.lit(1).cast("bigint"), F.floor(d * 24 + 0.5).cast("bigint")).cast("string")
    return (F.when(d < 1, F.concat(hours, F.lit(" hours")))
            .when(d < 14, F.concat(n(d), F.lit(" days")))
            .when(d < 90, F.concat(n(d / 7), F.lit(" weeks")))
            .when(d < 730, F.concat(n(d / 30.4), F.lit(" months")))
            .otherwise(F.concat(n(d / 365), F.lit(" years"))))


def eta_text(days) -> Column:
    """A projected crossing, rounded hard: "any moment", "~5 h", "~3 days"."""
    d = _c(days)

    def unit(x: Column, word: str) -> Column:
        k = F.round(x).cast("bigint")
        plural = F.when(k == 1, F.lit(word)).otherwise(F.lit(word + "s"))
        return F.concat(F.lit("~"), k.cast("string"), F.lit(" "), plural)

    return (F.when(d < F.lit(1.0 / 24), F.lit("any moment"))
            .when(d < 1, F.concat(F.lit("~"), F.round(d * 24).cast("bigint").cast("string"), F.lit(" h")))
            .when(d < 14, unit(d, "day"))
            .when(d < 60, unit(d / 7, "week"))
            .when(d < 730, unit(d / 30.44, "month"))
            .otherwise(unit(d / 365.25, "year")))


# --- parsing --------------------------------------------------------------------------

def strict_int(text, upper: int | None = None) -> Column:
    """A clean run of 1..19 digits that fits BIGINT, else NULL: no sign, blank or point."""
    t = _c(text)
    v = F.when(t.rlike(r"\A[0-9]{1,19}\z"), t.try_cast("bigint"))
    return v if upper is None else F.when(v <= F.lit(upper), v)


def strict_team_id(text) -> Column:
    return strict_int(text, MAX_TEAM_ID).cast("int")


def ascii_fold(text) -> Column:
    """Lower-case A-Z only; other letters are left as they are."""
    return F.translate(_c(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Fixed value: an RFC 3339 instant.
RFC3339 = r"\A(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.\d+)?(Z|[+-]\d{2}:\d{2})\z"


def parse_cursor(text) -> Column:
    """Unix seconds from either plain seconds or an RFC 3339 instant, else NULL."""
    t = _c(text)
    seconds = F.when(t.rlike(r"\A[+-]?\d{1,19}\z"), t.try_cast("bigint"))
    wall = F.unix_seconds(F.try_to_timestamp(
        F.concat(F.regexp_replace(F.regexp_extract(t, RFC3339, 1), "T", " "), F.lit(" +00:00")),
        F.lit("yyyy-MM-dd HH:mm:ss xxx")))
    zone = F.regexp_extract(t, RFC3339, 2)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    shift = sign * (F.substring(zone, 2, 2).try_cast("bigint") * 3600
                    + F.substring(zone, 5, 2).try_cast("bigint") * 60)
    instant = F.when(t.rlike(RFC3339), wall - F.when(zone == "Z", F.lit(0)).otherwise(shift))
    return F.coalesce(seconds, instant)


def parse_target(text) -> tuple[Column, Column, Column]:
    """(kind, target, tagged) of a ``t:``/``d:`` prefixed alert target."""
    t = F.trim(_c(text))
    kind = F.when(t.startswith("t:"), "team").when(t.startswith("d:"), "donor").otherwise("")
    tagged = kind != ""
    return kind, F.when(tagged, F.substring(t, 3, 1 << 30)).otherwise(t), tagged


def threshold_valid(alert_type, threshold) -> Column:
    k, v = _c(alert_type), _c(threshold)
    return (F.when(k == "rank", v >= 1)
            .when(k == "idle", (v >= 1) & (v <= 720))
            .when(k == "daily", (v >= 0) & (v <= 23))
            .otherwise(F.lit(True)))


def archive_time(published, fetched, grace: int = 300) -> Column:
    """Publish time identifies a snapshot unless absent or too far ahead of the fetch."""
    p, f = _c(published), _c(fetched)
    return F.when(p.isNull() | (p > f + F.lit(grace)), f).otherwise(p)
