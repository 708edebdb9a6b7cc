"""Session defaults and the shared checkpoint folder.

Library code never builds its own session; it takes the caller's.  The
helpers here are for tests, the bench and the entry point, and for
operators that must cut lineage (generation loop, exact rank offsets).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Broadcast a side only when it is proven smaller than this (bytes).
DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024


def build_session(master: str | None = None, app: str = "tokenloom",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session with AQE and UTC; UI off (no server)."""
    master = master or os.environ.get("TOKENLOOM_MASTER", "local[8]")
    cores = _cores(master)
    parts = shuffle_partitions or max(8, cores * 2)
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TOKENLOOM_DRIVER_MEMORY", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _cores(master: str) -> int:
    if master.startswith("local[") and master.endswith("]"):
        inner = master[6:-1]
        return (os.cpu_count() or 8) if inner == "*" else int(inner)
    return 8


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Order: a directory already set on the context, then the session
    setting ``spark.checkpoint.dir``.  Only a local-mode session with
    neither (tests, bench) gets a fresh scratch folder of its own; a
    cluster without the setting is an error, because a machine-local
    folder would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running tokenloom jobs")
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def bound_batches(spark: SparkSession) -> None:
    """Cut the session's Arrow batches at ``spark.tokenloom.batchBytes`` (4m), besides Spark's bound on their rows.

    Python workers hold a batch and what is made from it, a worker a core: with texts of any
    length, rows alone do not bound that.  Spark reads the setting when a plan runs, so it stays set.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.tokenloom.batchBytes", "4m"))


_stored: list[str] = []


def intermediate(path: str) -> str:
    """Notes a stored table that ``intermediate_tables`` deletes when the work is done."""
    _stored.append(path)
    return path


@contextmanager
def intermediate_tables(spark: SparkSession):
    """Delete the intermediate tables that are written inside the block when it ends.

    Results must be written or collected inside the block; a lazy result
    that is read later still needs its tables.
    """
    start = len(_stored)
    try:
        yield
    finally:
        for path in _stored[start:]:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        del _stored[start:]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    One job (an RDD checkpoint would compute its input twice), the result
    survives executor loss, and the read-back plan carries real file
    sizes, so Spark's own broadcast threshold sees the true size.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = intermediate(f"{base}/tokenloom-tables/{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
