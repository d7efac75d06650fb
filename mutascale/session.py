"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "mutascale", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may go without; it then gets a
    temporary folder, because every task runs on this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="mutascale-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


#: Scratch tables of this process that were not removed yet.
_SCRATCH: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.add(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table; only paths that ``scratch_path`` gave out are touched."""
    if path in _SCRATCH:
        _SCRATCH.discard(path)
        fs, target = file_system(spark, path)
        fs.delete(target, True)


def release_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this process. Results that were not read or written yet are lost with them."""
    for path in list(_SCRATCH):
        remove_path(spark, path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a pattern, sorted."""
    fs, target = file_system(spark, pattern)
    return sorted(status.getPath().toString() for status in fs.globStatus(target) or [])


#: Bytes of input files per task of a shuffle that an operator deals out itself.
TASK_BYTES = 4 << 20


def shuffle_width(df: DataFrame) -> int:
    """Number of partitions for a shuffle of rows that come from the files behind ``df``.

    The session's number of partitions is fixed, so what a task holds would grow with the input; this number grows instead.
    Only file lengths are read. It is never below the session's number, which also serves where no file lies behind ``df``.
    """
    spark = df.sparkSession
    total = 0
    for path in df.inputFiles():
        fs, target = file_system(spark, path)
        total += fs.getFileStatus(target).getLen()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives the loss of executors."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)
