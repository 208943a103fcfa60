"""From raw documents to packed training windows: five stages, each one operator.

Each stage takes all documents that the one before it kept and returns rows with
the columns of ``documents``; the last one returns packed pieces.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilrow.llm import decontaminate, langid, neardup, packing, substring
from vigilrow.llm.catalog import word_encoder
from vigilrow.llm.common import every, table, unused
from vigilrow.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those far from every known language."""
    added = unused(docs.columns, *langid.ADDED)
    found = langid.predict(docs, langid.fit(docs), added=added)
    return found.where(~F.col(added[-1])).select(*every(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    return neardup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out word windows that a document with a smaller id has too; rows stay."""
    cut = substring.without_repeats(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


#: Pieces that an encoder of the pipeline keeps.  Workers outlive their stage, so its memory is missing in all later ones.
PIECES_KEPT = 100_000


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows."""
    return packing.pack(docs, partial(word_encoder, most=PIECES_KEPT), end_id=2)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("windows", windows),
]

#: Classification, connected components and alignment have no SQL twin; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
