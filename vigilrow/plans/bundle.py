"""Trained models as one thing that can be saved, loaded and used to score a scan.

A bundle is tables only: the nodes of the trees, the scaler, the thresholds and,
if there is a linear model, its vocabulary with a coefficient for each term.

Saving never touches what is there.  A bundle goes into a new version folder,
and only when all of it is written a row is added to the folder's manifest, in
one file.  Loading reads the manifest and takes the newest version in it, so a
save that breaks at any step leaves the one before in use.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilrow.functions.columns import FEATURES
from vigilrow.operators import dataset as D
from vigilrow.operators import ngram as N
from vigilrow.operators import trees as T
from vigilrow.operators.scoring import Thresholds, align, boost, thresholds
from vigilrow.plans.train import NgramRun, TreeRun
from vigilrow.sinks.writers import write_metadata
from vigilrow.sources.files import frozen_features, read_metadata

MANIFEST = "version long, place string, parts array<string>, intercept double, saved timestamp"


@dataclass(frozen=True)
class ModelBundle:
    """What a scan needs: trees with their scaler and thresholds, and, if trained, a linear n-gram model."""

    nodes: DataFrame
    scaler: DataFrame
    metadata: DataFrame
    vocabulary: DataFrame | None = None  # block, term, term_id, idf, coefficient
    intercept: float = 0.0

    @classmethod
    def of(cls, trees: TreeRun, ngrams: NgramRun | None = None) -> ModelBundle:
        if ngrams is None:
            return cls(trees.nodes, trees.scaler, trees.metrics)
        weighed = ngrams.vocabulary.join(F.broadcast(ngrams.coefficients), ["block", "term"])  # 23,000 rows at most
        return cls(trees.nodes, trees.scaler, trees.metrics, weighed, float(ngrams.model.intercept))

    def save(self, folder: str) -> int:
        """Write a new version and return its number."""
        spark = self.nodes.sparkSession
        version = max((r["version"] for r in versions(spark, folder)), default=0) + 1
        place = f"v{version:06d}-{uuid.uuid4().hex[:12]}"
        parts = {"nodes": self.nodes, "scaler": self.scaler}
        if self.vocabulary is not None:
            parts["vocabulary"] = self.vocabulary
        for name, df in parts.items():
            df.write.parquet(f"{folder}/{place}/{name}")
        write_metadata(self.metadata.drop("feature_names", "extractor_version", "aspx_features"), f"{folder}/{place}/metadata")
        row = spark.createDataFrame([(version, place, [*parts, "metadata"], self.intercept)], MANIFEST.rsplit(",", 1)[0])
        row.withColumn("saved", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
        return version

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int | None = None) -> ModelBundle:
        """The newest complete version, or the one asked for."""
        found = [r for r in versions(spark, folder) if version in (None, r["version"])]
        if not found:
            raise FileNotFoundError(f"no complete bundle in {folder}")
        # Of two saves at the same moment, which share a number, the later one counts.
        newest = max(found, key=lambda r: (r["version"], r["saved"]))
        place = f"{folder}/{newest['place']}"
        metadata = read_metadata(spark, f"{place}/metadata")
        if frozen_features(metadata) != FEATURES:
            raise ValueError("the bundle was trained with other features")
        table = {name: spark.read.parquet(f"{place}/{name}") for name in newest["parts"] if name != "metadata"}
        return cls(table["nodes"], table["scaler"], metadata, table.get("vocabulary"), newest["intercept"])

    def limits(self, mode: str = "hunting") -> Thresholds:
        row = self.metadata.select("blocking_threshold", "hunting_threshold").first()
        return thresholds(mode, row["blocking_threshold"], row["hunting_threshold"])

    def scorer(self) -> Callable[[DataFrame], DataFrame]:
        """Adds ``prob_tree`` and, with a linear model, ``prob_ngram`` to evidence that still has its ``code``."""

        def score(evidence: DataFrame) -> DataFrame:
            # The verdict reads the features as they were, so they are set aside while the trees see theirs.
            held = evidence.withColumn("place", F.struct(*evidence.columns))
            scaled = D.apply_scaler(boost(held.select("place", *align(held)), "serve"), self.scaler)
            df = T.with_probability(scaled, self.nodes).select("place.*", "prob_tree")
            if self.vocabulary is None:
                return df
            given = [r["coefficient"] for r in self.vocabulary.orderBy("term_id").select("coefficient").collect()]  # 23,000 at most
            linear = linear_scorer(np.array(given), self.intercept, self.vocabulary)
            return N.scoring_view(df).withColumn("prob_ngram", linear(F.col("clean"))).drop("clean")

        return score


def versions(spark: SparkSession, folder: str) -> list:
    """The rows of a folder's manifest: one for each complete save."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def linear_scorer(coefficients: np.ndarray, intercept: float, vocabulary: DataFrame, blocks=(N.CHAR, N.WORD)):
    """A column function: the linear model's probability of a text, its n-grams counted and weighed in the same pass.

    The vocabulary and the coefficients (23,000 rows at most) go to every task.
    """
    known = {b.name: {} for b in blocks}
    for row in vocabulary.select("block", "term", "term_id", "idf").collect():
        if row["block"] in known:
            known[row["block"]][row["term"]] = (row["term_id"], row["idf"])
    sent = vocabulary.sparkSession.sparkContext.broadcast((known, coefficients))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, weight = sent.value
        matchers = [N.Matcher(block, terms[block.name]) for block in blocks]
        for clean in batches:
            out = []
            for text in clean:
                total = intercept
                for matcher in matchers:
                    ids, values = N.weigh(text or "", matcher)
                    total += float(np.dot(weight[ids], values))
                out.append(1.0 / (1.0 + np.exp(-total)))
            yield pd.Series(out)

    return score
