"""Session set-up shared by the bench, the tests and interactive use."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators are planned for. A hot user leaves a join in one
# huge partition; forceOptimizeSkewedJoin lets AQE split it even where the next
# aggregate would otherwise have reused the join's partitioning.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Without it, shuffle files stay until the driver's garbage collector meets their frame.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str, cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster use ``configure``."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        # recording the Python line of every column expression slows plan building down
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, removed at exit.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder")
            folder = tempfile.mkdtemp(prefix="stayline-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_written: list[str] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute a frame once and cut its lineage, in storage that outlives executors.

    The rows are written as a table to the checkpoint folder, so later reads take only the
    columns they need. The tables stay until ``scratch_tables`` ends or the folder is cleaned.
    The shuffle files of the write go when it ends.
    """
    return _stored(df)[1]


def _stored(df: DataFrame) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    _written.append(path)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return path, spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Remove the tables that ``checkpointed`` wrote inside the block when it ends.

    Frames built inside must have been used or written by then. The block is given a
    function that writes a frame as ``checkpointed`` does, but so that it outlives the block;
    it goes with the block around, if there is one.
    """
    start, kept = len(_written), []

    def keep(df: DataFrame) -> DataFrame:
        path, stored = _stored(df)
        kept.append(path)
        return stored

    try:
        yield keep
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _written[start:]:
            if path not in kept:
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(conf).delete(place, True)
        _written[start:] = kept
