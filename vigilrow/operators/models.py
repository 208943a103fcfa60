"""The two models: boosted trees on features, linear model on n-grams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilrow.functions.columns import FEATURES
from vigilrow.operators.dataset import SEED, balanced_weights
from vigilrow.session import ensure_checkpoint_dir, small_batches, written


# ---------------------------------------------------------------------------
# Model settings and the search grid.
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class TreeSettings:
    """Boosted trees.  Depth 6 stands for 64 leaves, as trees grow level by level here."""

    rounds: int = 800
    step: float = 0.03
    depth: int = 6
    row_share: float = 0.85
    column_share: str = "0.85"
    least_rows: int = 10
    bins: int = 255
    seed: int = SEED


@dataclass(frozen=True)
class LinearSettings:
    """Elastic-net logistic regression; ``c`` is the inverse strength of the penalty."""

    c: float = 0.5
    l1_share: float = 0.3
    rounds: int = 2000


@dataclass(frozen=True)
class Grid:
    c: tuple[float, ...] = (0.3, 0.5, 0.7, 1.0)
    l1_share: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7)
    folds: int = 3
# End of the fixed values.


def assemble(df: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error").transform(df)


def fit_trees(train: DataFrame, settings: TreeSettings = TreeSettings()) -> GBTClassificationModel:
    """``features, label, weight`` -> model.  Long fits cut their lineage by checkpoints."""
    ensure_checkpoint_dir(train.sparkSession)
    return GBTClassifier(
        labelCol="label", featuresCol="features", weightCol="weight", maxIter=settings.rounds,
        stepSize=settings.step, maxDepth=settings.depth, subsamplingRate=settings.row_share,
        featureSubsetStrategy=settings.column_share, minInstancesPerNode=settings.least_rows,
        maxBins=settings.bins, seed=settings.seed, checkpointInterval=10, cacheNodeIds=True,
    ).fit(train)


def bad_probability(model, df: DataFrame, name: str) -> DataFrame:
    """Adds the probability of label 1 under the given name."""
    scored = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability", "prediction")


def importances(model, names: tuple[str, ...], df: DataFrame) -> DataFrame:
    """``feature, importance``: one row per feature."""
    rows = [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def stored_vectors(weighted: DataFrame, size: int, label: str = "ngram-vectors") -> tuple[DataFrame, DataFrame]:
    """``weights`` (ids and values) -> one written table, read in two ways.

    As ``features``, a sparse vector per file: the struct is what such a vector
    is stored as, so no row passes through Python.  And as ``ids, values``.
    """
    stored = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.col("weights.ids").alias("indices"), F.col("weights.values").alias("values"),
    )
    rows = weighted.withColumn("features", stored).drop("weights")
    path, reader = written(rows, label), rows.sparkSession.read
    fields = [T.StructField("features", VectorUDT()) if f.name == "features" else f for f in rows.schema.fields]
    lists = reader.schema(rows.schema).parquet(path).withColumns({"ids": F.col("features.indices"), "values": F.col("features.values")})
    return reader.schema(T.StructType(fields)).parquet(path), lists.drop("features")


def with_vectors(weighted: DataFrame, size: int, label: str = "ngram-vectors") -> DataFrame:
    """``weights`` (ids and values) -> ``features``, one sparse vector per file, as a written table."""
    return stored_vectors(weighted, size, label)[0]


def _linear(rows: int, settings: LinearSettings) -> LogisticRegression:
    return LogisticRegression(
        labelCol="label", featuresCol="features", weightCol="weight", standardization=False,
        elasticNetParam=settings.l1_share, regParam=1.0 / (settings.c * rows), maxIter=settings.rounds,
    )


def with_balance(train: DataFrame) -> DataFrame:
    """Adds ``weight`` so that both classes weigh the same."""
    per_class = balanced_weights(train).select("label", "weight")
    return train.join(F.broadcast(per_class), "label")  # one row per label


def fit_linear(train: DataFrame, settings: LinearSettings = LinearSettings()) -> LogisticRegressionModel:
    """``features, label, weight`` -> model; weights sum to the row count, so the
    penalty per row is 1 / (C n)."""
    with small_batches(train.sparkSession):
        return _linear(train.count(), settings).fit(train)


def coefficients(model: LogisticRegressionModel, vocab: DataFrame) -> DataFrame:
    """``block, term, coefficient``: at most one row per vocabulary term."""
    rows = [(i, float(v)) for i, v in enumerate(model.coefficients.toArray())]
    table = vocab.sparkSession.createDataFrame(rows, "term_id int, coefficient double")
    return vocab.join(table, "term_id").select("block", "term", "coefficient")


def nonzero(coefs: DataFrame) -> DataFrame:
    return coefs.agg(
        F.count("*").alias("terms"), F.count(F.when(F.col("coefficient") != 0, 1)).alias("nonzero")
    ).withColumn("percent", F.col("nonzero") / F.col("terms") * 100)
