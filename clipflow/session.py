"""Session helpers: recommended settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Rows of one key above which its rows are split over several tasks.
HOT_ROWS = ("spark.clipflow.hotRows", 500_000)

CHECKPOINT_DIR = "spark.checkpoint.dir"

_own_dirs: dict[str, str] = {}
_scratch: set[str] = set()


def setting(spark: SparkSession, entry: tuple[str, int]) -> int:
    name, default = entry
    return int(spark.conf.get(name, str(default)))


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for local runs; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(master)
        .appName("clipflow")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A session inside one process, which shares its folders with itself, gets one of its own
    that goes when the process ends. Anywhere else a missing setting is an error.
    """
    context = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = own = tempfile.mkdtemp(prefix="clipflow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return _own_dirs[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's folder under the shared one, which goes when the session's JVM ends."""
    home = f"{shared_dir(spark)}/clipflow-{spark.sparkContext.applicationId}"
    if home not in _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(home)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _scratch.add(home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the session's scratch files now; results that read them must have been written or collected."""
    home = f"{shared_dir(spark)}/clipflow-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(home)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _scratch.discard(home)
