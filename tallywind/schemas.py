"""Fixed schemas of the feeds, the derived tables and the alert rules."""

from pyspark.sql import types as T

MEMBER_SNAPSHOT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("team_id", T.IntegerType()),
    T.StructField("snapshot_ts", T.LongType()),
    T.StructField("score", T.LongType()),
    T.StructField("wus", T.LongType()),
])

TEAM_SNAPSHOT = T.StructType([
    T.StructField("team_id", T.IntegerType()),
    T.StructField("team_name", T.StringType()),
    T.StructField("snapshot_ts", T.LongType()),
    T.StructField("score", T.LongType()),
    T.StructField("wus", T.LongType()),
])

# Feed record limits.
MAX_RECORD_LINES = 6
MAX_USER_NAME_BYTES = 128
MAX_TEAM_NAME_BYTES = 256
NUMERIC_TAIL_BYTES = 64
MAX_TEAM_ID = 10_000_000
MAX_DECODED_BYTES = 256 * 1024 * 1024
MAX_TEAM_ROWS = 500_000
MAX_USER_ROWS = 5_000_000

# Spans in seconds.
HOUR = 3600
DAY = 86400
WEEK = 7 * DAY
NANOS = 1_000_000_000
