"""Session settings and the two places where tables are read and lineage is cut."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: What the library needs of a session: UTC instants, maps whose later keys win, runtime re-planning.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", app: str = "paperloom", **extra: str) -> SparkSession:
    """A session with SETTINGS; `extra` overrides them (dots written as double underscores)."""
    conf = SETTINGS | {k.replace("__", "."): v for k, v in extra.items()}
    builder = SparkSession.builder.master(master).appName(app).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table `name` of the directory `root`, one Parquet file or directory each."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder and read again, so that lost executors don't recompute it.

    The folder is the session's `spark.checkpoint.dir`; where that is unset a local one is made if all runs in one process
    (tests), and on a cluster, whose executors share no local folder, it is an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or Path(os.path.join(tempfile.gettempdir(), "paperloom-checkpoints")).as_uri())
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """`df` over as many tasks as a shuffle has partitions: for few small rows that are much work each, which runtime
    re-planning would put into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the session's Python workers, once a session: they may start without it on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="paperloom-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))  # served by the driver to every executor, also to one that joins later
    _shipped.add(context.applicationId)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`df.mapInArrow` with the package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
