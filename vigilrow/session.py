"""Session helpers: a local session for tests and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "vigilrow") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # Texts are large: keep the batches sent to Python small.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's own setting, else a test folder.

    Iterative fits cut their lineage there, so that a lost executor does not
    replay every earlier iteration.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        current = tempfile.mkdtemp(prefix="vigilrow-checkpoint-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a relation as a table in the checkpoint folder and read it back.

    Used where an expensive relation feeds several jobs.  The table survives a
    lost executor, is read column by column, and keeps later filters from being
    rewritten in terms of the text expressions that made the columns.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df, label))


def written(df: DataFrame, label: str) -> str:
    """Write a relation to a new folder in the checkpoint folder; the folder's path."""
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return path


def scratch_folder(spark: SparkSession, label: str) -> str:
    """The name of a new folder in the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: What Spark reads, or sends to Python, at a time.
_BATCHES = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 250) -> Iterator[None]:
    """Actions inside take so many rows at a time at most from tables of wide rows, such as the weights of texts.

    Each task holds a whole batch in the heap, and outside of it twice what it sends to Python: with
    4,096 rows of 30 kB hundreds of MB.
    """
    own = {key: spark.conf.get(key, None) for key in _BATCHES}
    for key in _BATCHES:
        now = int(spark.conf.get(key))
        spark.conf.set(key, str(min(now, rows) if now > 0 else rows))
    try:
        yield
    finally:
        for key, value in own.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
