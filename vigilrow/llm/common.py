"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilrow.session import materialize, written

_KINDS = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(),
    "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32()), "array<string>": pa.list_(pa.string()),
}

#: ASCII white space: what separates words in the word contracts.
SPACES = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a flat column list such as ``"doc_id long, text string"``."""
    return pa.schema([(name, _KINDS[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def modest_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Lower the session's rows for each Arrow batch: whole texts are far larger than Spark's default assumes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], ddl: str, rows: int = 256) -> DataFrame:
    """Run a function over small slices of Arrow batches.

    ``make`` runs once in each task (vocabularies and tables are built there);
    the function it returns turns a slice into columns.  Slices keep memory in
    proportion to ``rows`` texts, whatever the size of the incoming batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, schema = make(), arrow_schema(ddl)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pydict(work(batch.slice(at, rows)), schema=schema)

    modest_batches(df.sparkSession)
    return df.mapInArrow(run, ddl)


def unused(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores as it takes to differ from all columns (in any case of letters)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def every(df: DataFrame, *names: str) -> list[Column]:
    """The named columns, or all, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names or df.columns]


class Scratch:
    """Tables written for one run of an operator, each dropped when nothing reads it any more.

    A table may go only after what was made from it is written itself, so a lost
    executor never needs it again.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = written(df, label)
        self.paths.setdefault(label, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Delete the tables with these labels; all of them if none is named."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for label in labels or tuple(self.paths):
            for path in self.paths.pop(label, []):
                place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(conf).delete(place, True)


def crc_fold(doc_id: str, folds: int):
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def ordered(df: DataFrame, label: str, *keys) -> DataFrame:
    """Write rows in one global order and number them without a single-task window.

    Rows are range-partitioned by ``keys``, sorted inside each part and written
    to the checkpoint folder, so file order is the global order.  Adds ``part``
    (rank of the file), ``row`` (place in the file) and ``position`` (place in
    the whole table, gapless from 0).  Ties in ``keys`` may cross a part border,
    so a key that a third of all rows share is still split if ``keys`` goes on
    with another column.
    """
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = materialize(spread, label).select("*", F.col("_metadata.file_name").alias("part_file"), F.col("_metadata.row_index").alias("row"))
    # One row for each file: a number of rows that is bounded by the number of tasks.
    files = kept.groupBy("part_file").agg(F.count(F.lit(1)).alias("part_rows"))
    order = Window.orderBy("part_no")
    files = files.withColumn("part_no", F.regexp_extract("part_file", r"part-(\d+)", 1).cast("long"))
    files = files.select(
        "part_file", F.row_number().over(order).cast("long").alias("part"),
        (F.sum("part_rows").over(order) - F.col("part_rows")).alias("part_start"),
    )
    return (
        kept.join(F.broadcast(files), "part_file")
        .withColumn("position", F.col("part_start") + F.col("row"))
        .drop("part_file", "part_start")
    )


# --- words and shingles as numbers -------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers (at least) of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                _powers[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, np.uint64(base))]), dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (a finalizer of multiplications and shifts)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of values; equal runs have equal hashes wherever they stand.

    Prefix sums of value * base**place; a run's difference is moved to place 0 by the inverse power.
    """
    up, down = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
        return mix((total[first + size] - total[first]) * down[first] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets [start, end) of the words of a UTF-8 text."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word.  Words are equal if (and nearly surely only if) hashes are."""
    return run_hashes(data, start, end - start)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive words; empty if there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(_BASE) + words[k : k + count]
        return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values, by doubling; there must be as many."""
    known = 1
    while known < width:
        step = min(known, width - known)
        values = np.minimum(values[: len(values) - step], values[step:])
        known += step
    return values
