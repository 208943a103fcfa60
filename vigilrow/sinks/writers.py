"""Reports, tables and models to storage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.functions.columns import FEATURES
from vigilrow.operators.reports import export_names, status_counts
from vigilrow.operators.scoring import Thresholds
from vigilrow.plans.scan import results
from vigilrow.sources import stores


def write_report(judged: DataFrame, limits: Thresholds, folder: str) -> None:
    """``results`` sorted by probability, and a one-row ``summary`` with the counts."""
    rows = results(judged)
    rows.orderBy(F.desc("probability"), "file").write.mode("overwrite").json(f"{folder}/results")
    counts = status_counts(judged)  # at most seven rows
    summary = counts.agg(F.map_from_entries(F.collect_list(F.struct("status", "files"))).alias("stats")).select(
        F.current_timestamp().alias("scan_time"),
        F.lit(limits.mode).alias("mode"),
        F.lit(limits.threshold).alias("threshold"),
        "stats",
    )
    summary.write.mode("overwrite").json(f"{folder}/summary")


def write_exports(judged: DataFrame, folder: str) -> None:
    """The export list, one folder per verdict."""
    export_names(results(judged)).write.mode("overwrite").partitionBy("verdict").parquet(folder)


def write_files(files: DataFrame, folder: str, openers: stores.Openers | None = None) -> DataFrame:
    """Write each row's ``content`` to ``name`` below the folder, in any store; ``name, path, size`` of what was written.

    Nothing is written until the result is used.  Rows go out from the tasks that
    hold them; a repeated task writes the same bytes again.  Null content makes an
    empty file.
    """
    root, known = stores.local_path(folder).rstrip("/"), dict(openers or {})
    schema = pa.schema([("name", pa.string()), ("path", pa.string()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = stores.join(root, name)
                stores.write(root, path, content or b"", known)
                rows.append({"name": name, "path": path, "size": len(content or b"")})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, path string, size long")


def copy_exports(judged: DataFrame, files: DataFrame, folder: str, openers: stores.Openers | None = None) -> DataFrame:
    """Copy the files of exported verdicts to ``folder/verdict/export_name``; ``files`` holds ``path`` and ``content``."""
    named = export_names(results(judged)).select(F.col("file").alias("path"), F.concat_ws("/", "verdict", "export_name").alias("name"))
    return write_files(named.join(files.select("path", "content"), "path"), folder, openers)


def write_importances(importances: DataFrame, folder: str) -> None:
    importances.orderBy(F.desc("importance"), "feature").write.mode("overwrite").csv(folder, header=True)


def write_metadata(metrics: DataFrame, folder: str, features: tuple[str, ...] | None = FEATURES, version: str = "") -> None:
    """One row of thresholds and rates, with the frozen feature order."""
    row = metrics.withColumn("extractor_version", F.lit(version))
    if features is not None:
        row = row.withColumns(
            {
                "feature_names": F.array(*map(F.lit, features)),
                "aspx_features": F.lit(sum("aspx" in f for f in features)).cast("long"),
            }
        )
    row.coalesce(1).write.mode("overwrite").json(folder)


def write_model(model: Model, folder: str) -> None:
    model.write().overwrite().save(folder)
