"""Session and scratch-space helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every tunekiln job relies on.
REQUIRED_CONF = {
    # strict JSON parsing keeps the last of duplicate keys instead of rejecting the line
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
    # rows go to Python workers in batches of about so many bytes; the default counts 10,000 rows of any length
    # and up to 64 MB, of which each task holds copies in the executor's direct memory and in its worker
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "tunekiln") -> SparkSession:
    """Session for tests and local runs. On a cluster use the provided session and call ``prepare``."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings tunekiln needs to an existing session (idempotent)."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or where that is unset one in the warehouse.

    In local mode (tests) a fresh local folder is used where it is unset. Elsewhere a ``file:`` folder, which may be
    mounted by all machines or be one on each, is tried once by a small table (``spark.tunekiln.checkpointDirIsMounted``
    says that it need not be): executors with folders of their own would lose rows silently.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: only the configured shared folder can be used
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for scratch tables")
        return d
    if not sc.getCheckpointDir():
        conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not conf_dir and sc.master.startswith("local"):
            # tests and single-machine runs only: a fresh local folder, removed when the process ends
            conf_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
            atexit.register(shutil.rmtree, conf_dir, ignore_errors=True)
        sc.setCheckpointDir(conf_dir or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tunekiln-scratch")
    current = sc.getCheckpointDir()
    one_process = sc.master == "local" or sc.master.startswith("local[")
    mounted = spark.conf.get("spark.tunekiln.checkpointDirIsMounted", "false") == "true"
    if current.startswith("file:") and not one_process and not mounted and current not in _TRIED:
        try_folder(spark, current)
        _TRIED.add(current)
    return current


_TRIED: set[str] = set()  # file: folders that a small table has shown to be shared


def try_folder(spark: SparkSession, folder: str) -> None:
    """Raise an error unless the driver sees in ``folder`` what the executors write there, and they can read it."""
    n = max(2, spark.sparkContext.defaultParallelism)
    path = folder.rstrip("/") + "/tunekiln-try-" + uuid.uuid4().hex[:12]
    fault = None
    try:
        spark.range(0, n, 1, n).write.parquet(path)
        rows = spark.read.schema("id bigint").parquet(path).count()
    except Exception as e:  # a machine that has not got the folder or the files
        rows, fault = 0, e
    finally:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if rows != n:
        raise RuntimeError(f"{folder} is not shared by all machines ({rows} of {n} rows were read back): set "
                           "spark.checkpoint.dir to a folder that is") from fault


_WRITTEN: list[str] = []  # scratch tables of this process that are still there


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    path = base.rstrip("/") + "/tunekiln-" + name + "-" + uuid.uuid4().hex[:12]
    _WRITTEN.append(path)
    return path


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete the scratch tables of this process beyond the first ``keep``. Frames that still read them
    must have been written or collected by then."""
    jvm = spark.sparkContext._jvm
    while len(_WRITTEN) > keep:
        p = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*frames) -> None:
    """Delete the scratch tables that ``frames`` read, each as ``land`` returned it, once their rows have been used.
    What is derived from them must have been written or collected by then."""
    for df in frames:
        spark = df.sparkSession
        own = {p.rsplit("/", 1)[-1]: p for p in _WRITTEN}
        for name in {f.rsplit("/", 2)[-2] for f in df.inputFiles()} & own.keys():
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own[name])
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            _WRITTEN.remove(own[name])


@contextmanager
def scratch(spark: SparkSession):
    """Delete on leaving what is written to scratch inside: ``with scratch(spark): api.plan(s).write...``"""
    keep = len(_WRITTEN)
    try:
        yield
    finally:
        release(spark, keep)


def land(df, name: str):
    """Write ``df`` once as Parquet under the checkpoint folder and return the re-read frame.

    Used where several passes read the same derived rows (e.g. canonical samples): later passes
    read columnar files with column pruning instead of re-deriving the rows, and the lineage is
    cut (a lost executor does not send the work back to the sources)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
