"""Parsing verbatim feed files, and writing feed files from snapshot tables.

A record may run over several physical lines because names contain newlines and tabs, so a
file is read in order; files are independent and Spark spreads them over tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywind.schemas import (MAX_DECODED_BYTES, MAX_RECORD_LINES, MAX_TEAM_ID, MAX_TEAM_NAME_BYTES,
                               MAX_USER_NAME_BYTES, NUMERIC_TAIL_BYTES)
from tallywind.session import ship_by_value

ship_by_value(__name__)

PARSED = ("file string, ordinal bigint, name string, name_raw binary, team_id int, score bigint, wus bigint, "
          "feed_timestamp string, header string, row_count bigint, malformed bigint, error string")

# What a record ends with, and a team record starts with. A name is everything
# between, tabs and newlines too.
_TAIL = {"team": re.compile(rb"\t([0-9]{1,19})\t([0-9]{1,19})$", re.M),
         "user": re.compile(rb"\t([0-9]{1,19})\t([0-9]{1,19})\t([0-9]{1,19})$", re.M)}
_HEAD = {"team": re.compile(rb"([0-9]{1,19})\t"), "user": re.compile(rb"()")}
_NAME_BYTES = {"team": MAX_TEAM_NAME_BYTES, "user": MAX_USER_NAME_BYTES}
_MAX_INT64 = (1 << 63) - 1
_BATCH = 50_000


def _line_starts(body: bytes, low: int, at: int, least: int) -> list[int]:
    """Starts of the line that holds ``at`` and of the lines before it a record may begin with,
    the earliest first: not before ``low`` or ``least``, MAX_RECORD_LINES at most."""
    starts = []
    while len(starts) < MAX_RECORD_LINES:
        start = body.rfind(b"\n", low, at) + 1 or low
        if start < least:
            break
        starts.append(start)
        if start == low:
            break
        at = start - 1
    return starts[::-1]


def read_records(content: bytes, kind: str, stats: dict, max_rows: int | None = None) -> Iterator[tuple]:
    """Yield (name, team_id, score, wus); fill ``stats`` with preamble, rows and malformed.

    A record ends where a line ends in its numbers. It begins at the earliest line after the
    record before it from which it keeps to the limits of lines, bytes and values (and, for
    teams, that begins with an id). Lines passed over count as malformed.
    """
    longest = _NAME_BYTES[kind] + NUMERIC_TAIL_BYTES
    first, second = (content.split(b"\n", 2) + [b"", b""])[:2]
    stats.update(timestamp=first.rstrip(b"\r").decode("utf-8", "backslashreplace"),
                 header=second.rstrip(b"\r").decode("utf-8", "backslashreplace"), rows=0, malformed=0, error=None)
    if not first.rstrip(b"\r"):
        stats["error"] = "empty feed"
        return
    if max(len(first), len(second)) > longest + 1:
        stats["error"] = "preamble line too long"
        return
    body = content[len(first) + len(second) + 2:]
    at = 0
    for tail in _TAIL[kind].finditer(body):
        for start in _line_starts(body, at, tail.start(), tail.end() - longest):
            head = _HEAD[kind].match(body, start, tail.start() + 1)
            if head is None:
                continue
            name = body[head.end():tail.start()] if head.end() <= tail.start() else None
            score, wus, team = (int(tail[1]), int(tail[2]), int(tail[3] if kind == "user" else head[1]))
            if name is None or len(name) > _NAME_BYTES[kind] or team > MAX_TEAM_ID or max(score, wus) > _MAX_INT64:
                continue
            stats["rows"] += 1
            stats["malformed"] += body.count(b"\n", at, start)
            if max_rows is not None and stats["rows"] > max_rows:
                stats["error"] = f"more than {max_rows} rows"
                return
            yield name, team, score, wus
            at = tail.end() + 1
            break
    rest = body[at:]
    stats["malformed"] += rest.count(b"\n") + (not rest.endswith(b"\n") and rest != b"")


def decode(path: str, content: bytes, max_bytes: int) -> bytes:
    """The file's text; files above ``max_bytes`` are refused, compressed or not."""
    out = content
    if path.endswith(".zst"):
        import zstandard
        try:
            with zstandard.ZstdDecompressor().stream_reader(content) as r:
                out = r.read(max_bytes + 1)
        except zstandard.ZstdError as e:
            raise ValueError(f"payload does not decode: {e}") from e
    if len(out) > max_bytes:
        raise ValueError(f"more than {max_bytes} bytes")
    return out


def _rows(kind: str, path: str, content: bytes, max_rows: int | None, max_bytes: int) -> Iterator[tuple]:
    """A file's records, then its statistics, as rows of the parsed table."""
    stats: dict = {}
    n = 0
    try:
        for name, team, score, wus in read_records(decode(path, content, max_bytes), kind, stats, max_rows):
            yield (path, n, name.decode("utf-8", "backslashreplace"), name, team, score, wus,
                   None, None, None, None, None)
            n += 1
    except ValueError as e:
        stats["error"] = str(e)
    yield (path, -1, None, None, None, None, None, stats.get("timestamp"), stats.get("header"),
           stats.get("rows", 0), stats.get("malformed", 0), stats.get("error"))


def parse_files(files: DataFrame, kind: str, max_rows: int | None = None, max_bytes: int = MAX_DECODED_BYTES) -> DataFrame:
    """Parse ``binaryFile`` rows. Records have ordinal >= 0; each file ends with one row of
    ordinal -1 carrying its preamble, counts and error. A file with more than ``max_rows``
    records or ``max_bytes`` of text ends in an error, and :func:`records` leaves it out whole.
    """
    columns = [c.split()[0] for c in PARSED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                for row in _rows(kind, path, bytes(content), max_rows, max_bytes):
                    out.append(row)
                    if len(out) >= _BATCH:
                        yield pd.DataFrame(out, columns=columns, dtype=object)
                        out.clear()
        if out:
            yield pd.DataFrame(out, columns=columns, dtype=object)

    return files.select("path", "content").mapInPandas(run, PARSED)


def open_feed(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(root))


def snapshot_time_of(path_col: str = "file"):
    """Instant of a file from its ``snapshot_ts=`` folder."""
    return F.regexp_extract(path_col, r"snapshot_ts=(\d+)", 1).cast("bigint")


def records(parsed: DataFrame) -> DataFrame:
    """Records of the files that were read without an error: a snapshot enters whole or not at
    all. ``parsed`` should be a table, as it is read twice."""
    refused = parsed.filter("ordinal = -1 AND error IS NOT NULL").select("file")
    return parsed.filter("ordinal >= 0").join(refused, "file", "left_anti").select(
        "file", "ordinal", "name", "name_raw", "team_id", "score", "wus")


def file_stats(parsed: DataFrame) -> DataFrame:
    return parsed.filter("ordinal = -1").select(
        "file", "feed_timestamp", "header", "row_count", "malformed", "error")


def write_feed(snapshot: DataFrame, kind: str, root: str, name: str = "name") -> str:
    """Write one feed file per snapshot: timestamp line, header line, then a row per entity."""
    score, wus, team = (F.col(c).cast("string") for c in ("score", "wus", "team_id"))
    cols = [team, F.col(name), score, wus] if kind == "team" else [F.col(name), score, wus, team]
    # Header lines.
    header = "team\tteamname\tscore\twu" if kind == "team" else "name\tscore\twu\tteam"
    rows = snapshot.select("snapshot_ts", F.lit(2).alias("part"), F.concat_ws("\t", *cols).alias("value"))
    stamp = F.concat(F.date_format(F.timestamp_seconds("snapshot_ts"), "EEE MMM dd HH:mm:ss"), F.lit(" GMT "),
                     F.date_format(F.timestamp_seconds("snapshot_ts"), "yyyy"))
    head = snapshot.select("snapshot_ts").distinct().select("snapshot_ts", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), stamp.alias("value")),
        F.struct(F.lit(1).alias("part"), F.lit(header).alias("value")))).alias("h")).select(
        "snapshot_ts", "h.part", "h.value")
    (rows.unionByName(head).repartition("snapshot_ts").sortWithinPartitions("snapshot_ts", "part", "value")
     .select("snapshot_ts", "value").write.mode("overwrite").partitionBy("snapshot_ts").text(root))
    return root
