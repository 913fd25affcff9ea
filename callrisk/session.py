"""Spark session defaults and lineage checkpoints.

Session settings follow the survey: UTC clock, ANSI arithmetic, adaptive
execution with skew handling.  The checkpoint folder is always read from the
session (``spark.checkpoint.dir``); a private temporary folder is created only
for local sessions that have none (tests, benches).
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # keyed stream state (call sessions, buffers, caches) lives off-heap in RocksDB
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "callrisk",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    Uses ``spark.checkpoint.dir`` when set.  Only a local-mode session without
    one gets a fresh private folder; a cluster session without one is an error,
    because a machine-local folder does not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; a shared folder is required on a cluster")
    folder = tempfile.mkdtemp(prefix="callrisk-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes, _lock, _inside = threading.local(), threading.Lock(), []


@contextmanager
def passing(spark: SparkSession):
    """What this thread writes by ``stored`` inside is deleted at the end, but for what is stored with ``keep`` or
    handed to the function that comes with the scope right after it was stored: that belongs to the scope around, if any.  Only for plans that nothing reads afterwards.  Shuffle files go
    with the query that made them, not when the driver happens to collect its garbage; scopes may be open side by
    side, the last one out sets the session back."""
    with _lock:
        if not _inside:
            _inside.append(spark.conf.get(_CLEANUP, "false"))
            spark.conf.set(_CLEANUP, "true")
        _inside.append(None)
    scopes = _scopes.__dict__.setdefault("open", [])
    scopes.append([])

    def keep(df: DataFrame) -> DataFrame:
        path = scopes[-1].pop()
        if len(scopes) > 1:
            scopes[-2].append(path)
        return df

    try:
        yield keep
    finally:
        for path in scopes.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        with _lock:
            _inside.pop()
            if len(_inside) == 1:
                spark.conf.set(_CLEANUP, _inside.pop())


def stored(df: DataFrame, name: str, keep: bool = False, task_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: what follows reads
    committed files, with their columns pruned, also after an executor is lost.  ``keep``: see ``passing``.
    ``task_rows``: later tasks read about so many rows each."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    scopes = _scopes.__dict__.get("open", [])
    at = len(scopes) - 1 - keep
    if at >= 0:
        scopes[at].append(path)
    df.write.option("maxRecordsPerFile", task_rows or 0).parquet(path)
    reader = spark
    if task_rows and (rows := spark.read.schema(df.schema).parquet(path).count()) > task_rows:
        reader = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())   # the split size is its own
        reader.conf.set("spark.sql.files.minPartitionNum", str(-(-rows // task_rows)))
    return reader.read.schema(df.schema).parquet(path)


#: Rows up to which Spark may choose to broadcast a side of a join that grows with the input.
BROADCAST_ROWS = 100_000


def growing(df: DataFrame, n: int | None = None) -> DataFrame:
    """``df`` as a side of a join whose other side grows alike: beyond ``BROADCAST_ROWS`` rows the join is a
    sort-merge join.  Spark's estimate is the size of the compressed files, with a vector or an array counted
    as a few values, so that what it takes for 10 MB can be far more than the driver holds."""
    return df.hint("merge") if (df.count() if n is None else n) > BROADCAST_ROWS else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
