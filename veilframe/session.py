"""Session helpers: a tuned local session for tests/bench and the shared
checkpoint folder read from the session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "veilframe") -> SparkSession:
    """Session for tests and the bench (local mode, UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder; it is
    only filled in here when unset *and* the master is local (tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not current:
        current = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
        if current:
            sc.setCheckpointDir(current)
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder for this cluster")
    current = tempfile.mkdtemp(prefix="veilframe-ckpt-")
    atexit.register(shutil.rmtree, current, ignore_errors=True)
    sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """This package on the executors, once a session: tasks that run its Python functions import them wherever it is installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="veilframe-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(path := os.path.realpath(f"{folder}/{root.name}-core.zip"), "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


SPREAD_MAX_BYTES = 4 * 1024 ** 3      # never add a shuffle for inputs above this
_ROW_LOCAL = {"Project", "Filter", "SubqueryAlias", "View"}


def _streamed(join):
    """The side of a join whose other side is hinted as broadcast, else None: its rows stay in the scan's splits."""
    sides = [join.children().apply(i) for i in range(2)]
    small = [s.nodeName() == "ResolvedHint" and "broadcast" in s.hints().toString() for s in sides]
    return sides[small.index(False)] if sum(small) == 1 else None


def _scan(df, joins: bool = False):
    """The file scan that ``df`` is a row-local projection of, with ``joins`` also over broadcast joins, else None.  Reads the plan
    only: no job, no listing."""
    plan = df._jdf.queryExecution().analyzed()
    while plan is not None:
        if plan.children().size() == 1 and plan.nodeName() in _ROW_LOCAL:
            plan = plan.children().head()
        elif joins and plan.children().size() == 2 and plan.nodeName() == "Join":
            plan = _streamed(plan)
        else:
            break
    if plan is None:
        return None
    return plan if plan.nodeName().startswith("LogicalRelation") or plan.nodeName().startswith("Relation") else None


def is_file_scan(df) -> bool:
    """Whether ``df`` is a row-local projection of one scan of files."""
    return not df.isStreaming and hasattr(df, "_jdf") and _scan(df) is not None


def spread(df, max_bytes: int = SPREAD_MAX_BYTES):
    """``df`` dealt out over all task slots before CPU-heavy row work
    (regex scans, hashing) when its scan cannot use them: a scan of few
    files (a parquet row group is the unit of scan parallelism) whose size
    statistic is below ``max_bytes``, so the added shuffle is bounded; broadcast joins leave rows in the scan's splits.  Large inputs, and
    those behind a shuffle or not read from files, are returned unchanged: they are spread already."""
    if df.isStreaming or not hasattr(df, "_jdf"):
        return df
    scan = _scan(df, joins=True)
    if scan is None or int(str(scan.stats().sizeInBytes())) > max_bytes:
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    if len(scan.relation().location().inputFiles()) >= slots:      # only the length leaves the JVM
        return df
    # by row number: columns the caller never uses are still pruned at the scan, and unlike a round-robin no task sorts its rows
    # first (a scan gives a retried task the same rows in the same order, so every row goes to the same place)
    return df.repartition(slots, F.monotonically_increasing_id())
