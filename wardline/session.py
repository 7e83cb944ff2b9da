"""Session defaults and the shared folder for tables written between jobs."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_local_root: str | None = None

# HotSpot does not compile methods above 8,000 bytes of bytecode. Wide rows exceed that in one fused
# method, which then runs interpreted, several times slower than operators compiled one by one.
TUNING = {"spark.sql.codegen.hugeMethodLimit": ("65535", "8000")}


def tune(spark: SparkSession) -> SparkSession:
    """Replace Spark's defaults that do not suit wide rows. Only ``local_session`` calls this; on a cluster it is the
    user's choice, since the setting holds for the whole session."""
    for key, (default, better) in TUNING.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, better)
    return spark


def local_session(app: str = "wardline", cores: int | str = "*") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return tune(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no stack capture per column call
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/") + "/wardline"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="wardline-")
    return _local_root


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; it is removed when this process ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``; asking by a failing read would report that to query listeners."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


# A finished write leaves its shuffle files on disk until the driver happens to collect its garbage.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def unless_set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The settings hold in here; those that the session has itself are left as they are."""
    ours = {k: v for k, v in settings.items() if spark.conf.get(k, None) is None}
    for key, value in ours.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in ours:
            spark.conf.unset(key)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder now instead of at the end of the process."""
    _remove(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


def _remove(jvm, hadoop_conf, path: str) -> None:
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop_conf).delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already; a left-over folder does no harm
        pass
