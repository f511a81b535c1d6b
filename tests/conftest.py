import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallywind.session import cleanup, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8)
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    yield s
    cleanup(s)
    s.stop()


@pytest.fixture
def members(spark):
    """Member snapshot rows: (name, team_id, ts, score, wus)."""
    return lambda rows: spark.createDataFrame(
        rows, "name string, team_id int, snapshot_ts bigint, score bigint, wus bigint")


@pytest.fixture
def teams(spark):
    return lambda rows: spark.createDataFrame(
        rows, "team_id int, team_name string, snapshot_ts bigint, score bigint, wus bigint")


@pytest.fixture
def tmp(request):
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
