"""Session helpers: local test sessions and the shared folder for lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "tsspark", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: The folder a local session without ``spark.checkpoint.dir`` got, by application.
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own: there is one machine then. The
    setting itself is a core setting, which a running session can't change, so the folder is kept here.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors.")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="tsspark-")
    return _LOCAL_DIRS[context.applicationId]


#: What this process has put below the shared folder, by process: workers are forks and must not clean up for the driver.
_MADE: dict[int, list[str]] = {}


def _remember(path: str) -> None:
    if os.getpid() not in _MADE:
        atexit.register(remove_scratch)
    _MADE.setdefault(os.getpid(), []).append(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _remember(path)
    return path


def remove_scratch() -> None:
    """Remove what this process has put below the shared folder: intermediate tables, cut lineages, checkpoints of fits.

    Results that are not computed yet read these files, so this is for the end of a job; it runs by itself at the exit.
    """
    made, gateway = _MADE.pop(os.getpid(), []), SparkContext._gateway
    if not made or gateway is None:
        return
    hadoop = gateway.jvm.org.apache.hadoop
    active = SparkContext._active_spark_context
    settings = active._jsc.hadoopConfiguration() if active is not None and active._jsc is not None else hadoop.conf.Configuration()
    for path in made:
        where = hadoop.fs.Path(path)
        where.getFileSystem(settings).delete(where, True)


def findable(spark: SparkSession) -> None:
    """Let Python workers import this package where it was found here, whatever folder they start in.

    On a cluster the package is installed, or sent along with ``--py-files``; then this changes nothing.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints, also those of iterative fits, to a folder of their own below the shared one.

    A folder that was set before may hold others' checkpoints and is left; Spark clears those it no longer needs where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
        _remember(context.getCheckpointDir())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from there; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
