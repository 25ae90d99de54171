"""Session helpers: configuration that suits wide tables, and reliable checkpoints."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "widetab", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps; ``conf`` adds or overrides settings.

    Shuffle partitions are left to the cluster: adaptive execution merges small ones, and a fixed
    number chosen here would be wrong for any other data size.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster a folder on one
    machine would be lost with the machine, so there the setting is required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="widetab-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that stores a frame in the shared folder and returns it as a table; the files go with the block.

    For what a loop of joins carries on. A checkpoint keeps the size that was estimated for its plan, for a join the
    product of both sides; carried on, its digits double from step to step, until the driver is busy multiplying
    them. A stored table has the size of its files.
    """
    folder, steps = f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}", itertools.count()

    def store(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(steps)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield store
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def task_count(spark: SparkSession, factor: int = 2) -> int:
    """How many partial results to build when each one is as large as the model itself."""
    return max(1, spark.sparkContext.defaultParallelism * factor)
