"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import sys
import tempfile
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more shuffle further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


#: Of the tables written here; the caller's own output keeps the codec its session names.
CODEC = "zstd"


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    n = shuffle_partitions or (cores if isinstance(cores, int) else 8)
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallywind")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(n))
    )
    for k, v in {**RUNTIME_CONF, **STREAM_CONF}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to a session made elsewhere."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a path that
    one machine alone can see would lose the data with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    named = named or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def ship_by_value(module_name: str) -> None:
    """Pickle a module's functions and classes into the tasks that run them, so that Python
    workers need no copy of this package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tallywind/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{app_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


# Intermediate tables a later build step has made redundant, per building thread.
_scratch = threading.local()


def _scratch_paths() -> list[str]:
    if not hasattr(_scratch, "paths"):
        _scratch.paths = []
    return _scratch.paths


def materialize(df: DataFrame, label: str, scratch: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike a cached frame the table outlives lost executors, and unlike an RDD checkpoint
    later scans of it prune columns and skip row groups. A ``scratch`` table goes away with
    the next :func:`drop_scratch`.
    """
    path = new_path(df.sparkSession, label)
    df.write.mode("overwrite").option("compression", CODEC).parquet(path)
    if scratch:
        _scratch_paths().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, label: str, keys: list[str], buckets: int, order: list[str]) -> DataFrame:
    """Like :func:`materialize`, as a table hashed by ``keys`` into ``buckets`` and sorted by ``order``
    in each. Grouping, windows and joins by these keys (or more) then need no shuffle. ``df`` should
    come in the same distribution, so that a task writes a bucket."""
    path, name = new_path(df.sparkSession, label), f"tallywind_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", CODEC).bucketBy(buckets, *keys).sortBy(*order).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def table_bytes(spark: SparkSession, *paths: str) -> int:
    """Bytes of the files under ``paths``."""
    conf = spark._jsc.hadoopConfiguration()
    found = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in found)


def scratch_mark() -> int:
    return len(_scratch_paths())


def drop_scratch(spark: SparkSession, mark: int = 0) -> None:
    """Delete the scratch tables written since ``mark``; their readers must be done."""
    paths = _scratch_paths()
    for path in paths[mark:]:
        delete_path(spark, path)
    del paths[mark:]


def together(*steps: Callable[[], object]) -> list:
    """Run steps that write tables of their own at the same time, so that the short stages
    of one fill the executors the other leaves idle. Scratch tables pass to the caller."""

    def run(step: Callable[[], object]) -> tuple[object, list[str]]:
        out = step()
        return out, list(_scratch_paths())

    with ThreadPoolExecutor(len(steps)) as pool:
        done = [f.result() for f in [pool.submit(run, s) for s in steps]]
    for _, paths in done:
        _scratch_paths().extend(p for p in paths if p not in _scratch_paths())
    return [out for out, _ in done]


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def list_partitions(spark: SparkSession, path: str, column: str) -> list[int]:
    """Values of the integer partition folders directly under ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return [int(n.partition("=")[2]) for n in names if n.startswith(f"{column}=")]


def cleanup(spark: SparkSession) -> None:
    """Delete every table this application wrote to the shared folder."""
    _scratch_paths().clear()
    delete_path(spark, app_dir(spark))
