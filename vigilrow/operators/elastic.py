"""Elastic-net logistic regression: many models from one pass over the rows per step.

All models of a search (penalties x folds) are columns of one matrix.  A step is
one job: tasks multiply their rows with the matrix, mask each row's error where
a model does not train on it, and add up gradients; Spark sums the tasks'
gradients by blocks of terms.  The driver then moves every model by an
accelerated proximal step (momentum is dropped where it points uphill).  So 48
models read the rows as often as one would, and what the driver holds is terms
x models numbers (23,000 x 48), whatever the number of rows.

A model is done when its *violation* is below the tolerance: how far its
gradient is from what the optimum demands, term by term.  That certificate can
be had for any coefficients, also those of other solvers.

The objective is the weighted mean of the logistic loss plus
``(l1_share * |w| + (1 - l1_share) / 2 * w^2) / (c * rows)``; the intercept is free.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.operators.evaluation import roc_auc_by
from vigilrow.session import materialize, small_batches

#: Terms of a block of the summed gradient, and rows that are multiplied at once.
_BLOCK = 1_000
_ROWS = 128
#: Twice the largest squared length of a row: two blocks of unit length and the intercept.
_LENGTH = 3.0


@dataclass(frozen=True)
class Penalty:
    c: float
    l1_share: float
    fold: int = -1  # the fold that the model does not train on; -1: none


@dataclass
class Fitted:
    """Coefficients (terms + 1 rows, the last one the intercept) of each model, and how far each is from its optimum."""

    models: list[Penalty]
    coefficients: np.ndarray
    violation: np.ndarray
    steps: int


def _products(batch: pa.RecordBatch, matrix: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows: their terms (the intercept last), their values and their margins under every model."""
    lists = batch["ids"], batch["values"]
    ends = np.asarray(lists[0].offsets)
    ids, values = (np.asarray(x.values) for x in lists)
    for at in range(0, batch.num_rows, _ROWS):
        part = slice(at, min(at + _ROWS, batch.num_rows))
        a, b = ends[part.start], ends[part.stop]
        terms, column = np.unique(ids[a:b], return_inverse=True)
        x = np.zeros((part.stop - at, len(terms) + 1))
        x[np.repeat(np.arange(part.stop - at), np.diff(ends[part.start : part.stop + 1])), column] = values[a:b]
        x[:, -1] = 1.0
        terms = np.append(terms, len(matrix) - 1)
        yield part, terms, x, x @ matrix[terms]


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch[name].to_numpy(zero_copy_only=False)


def _gradients(rows: DataFrame, models: list[Penalty], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the rows: gradient of the loss for each term and model, and the weight of each model's rows."""
    sent = rows.sparkSession.sparkContext.broadcast(matrix)  # terms x models numbers
    folds = np.array([m.fold for m in models])
    shape = matrix.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        total, weight = np.zeros(shape), np.zeros(shape[1])
        for batch in batches:
            label, heavy, fold = _numbers(batch, "label"), _numbers(batch, "weight"), _numbers(batch, "fold")
            for part, terms, x, margin in _products(batch, w):
                used = heavy[part, None] * (fold[part, None] != folds)
                total[terms] += x.T @ (used * (1.0 / (1.0 + np.exp(-margin)) - label[part, None]))
                weight += used.sum(axis=0)
        total = np.vstack([total, weight])
        starts = range(0, len(total), _BLOCK)
        columns = [pa.array([s // _BLOCK for s in starts], pa.int32()), pa.array([total[s : s + _BLOCK].tobytes() for s in starts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "sums"])

    def added(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in part["sums"])
        return pd.DataFrame({"block": [part["block"].iloc[0]], "sums": [total.tobytes()]})

    given = rows.select("ids", "values", F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"), F.col("fold").cast("int").alias("fold"))
    parts = given.mapInArrow(run, "block int, sums binary")
    with small_batches(rows.sparkSession):
        got = parts.groupBy("block").applyInPandas(added, "block int, sums binary").collect()
    sent.destroy()
    if not got:
        raise ValueError("no rows to fit")
    both = np.concatenate([np.frombuffer(r["sums"]).reshape(-1, shape[1]) for r in sorted(got, key=lambda r: r["block"])])
    return both[:-1], both[-1]


def _strengths(models: list[Penalty], counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """L1 and L2 strength of each model; ``counts``: rows of each fold."""
    total = sum(counts.values())
    rows = np.array([total - counts.get(m.fold, 0) for m in models], float)
    each = 1.0 / (np.array([m.c for m in models]) * np.maximum(rows, 1.0))
    share = np.array([m.l1_share for m in models])
    return each * share, each * (1 - share)


def _violation(w: np.ndarray, gradient: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    slope = gradient[:-1] + l2 * w[:-1]
    free = np.where(w[:-1] != 0, np.abs(slope + l1 * np.sign(w[:-1])), np.maximum(np.abs(slope) - l1, 0))
    return np.maximum(free.max(axis=0, initial=0), np.abs(gradient[-1]))


def fit_models(
    rows: DataFrame, size: int, models: list[Penalty], rounds: int = 2_000, tolerance: float = 1e-4, start: np.ndarray | None = None, check: int = 20
) -> Fitted:
    """``ids, values, label, weight, fold`` -> all models.

    ``start``: coefficients to begin from (a column for each model).  Every
    ``check`` steps the violations are looked at, and models that are done leave.
    """
    counts = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}  # one row per fold
    l1, l2 = _strengths(models, counts)
    w = np.zeros((size + 1, len(models))) if start is None else start.copy()
    before, ahead, momentum = w.copy(), w.copy(), np.ones(len(models))
    violation, going, steps = np.full(len(models), np.inf), np.arange(len(models)), 0
    while len(going):
        active = [models[k] for k in going]
        if steps % check == 0 or steps >= rounds:
            sums, weight = _gradients(rows, active, w[:, going])
            violation[going] = _violation(w[:, going], sums / weight, l1[going], l2[going])
            if steps >= rounds:
                break
            going = going[violation[going] > tolerance]
            if not len(going):
                break
            active = [models[k] for k in going]
        sums, weight = _gradients(rows, active, ahead[:, going])
        # The curvature of a mean of logistic losses is a quarter of a row's squared length at most.
        step = 1.0 / (0.25 * _LENGTH + l2[going])
        point = ahead[:, going]
        moved = point - step * (sums / weight + np.vstack([l2[going] * point[:-1], np.zeros(len(going))]))
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - step * l1[going], 0)
        before[:, going], w[:, going] = w[:, going], moved
        uphill = ((point - moved) * (moved - before[:, going])).sum(axis=0) > 0
        then = np.where(uphill, 1.0, (1 + np.sqrt(1 + 4 * momentum[going] ** 2)) / 2)
        push = np.where(uphill, 0.0, (momentum[going] - 1) / then)
        ahead[:, going] = moved + push * (moved - before[:, going])
        momentum[going] = then
        steps += 1
    return Fitted(models, w, violation, steps)


def violations(rows: DataFrame, coefficients: np.ndarray, models: list[Penalty]) -> np.ndarray:
    """How far given coefficients are from the optimum of each model: 0 there."""
    counts = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    sums, weight = _gradients(rows, models, coefficients)
    return _violation(coefficients, sums / weight, *_strengths(models, counts))


def held_out_scores(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """``model, label, score``: each row under the models that did not train on it."""
    sent = rows.sparkSession.sparkContext.broadcast(fitted.coefficients)
    folds = np.array([m.fold for m in fitted.models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, fold = _numbers(batch, "label"), _numbers(batch, "fold")
            for part, _, _, margin in _products(batch, sent.value):
                row, model = np.nonzero(fold[part, None] == folds)
                score = 1.0 / (1.0 + np.exp(-margin[row, model]))
                columns = pa.array(model.astype(np.int32)), pa.array(label[part][row].astype(np.int32)), pa.array(score)
                yield pa.RecordBatch.from_arrays(list(columns), names=["model", "label", "score"])

    given = rows.select("ids", "values", F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold"))
    return given.mapInArrow(run, "model int, label int, score double")


def grid_auc(rows: DataFrame, fitted: Fitted, digits: int = 9) -> DataFrame:
    """``c, l1_share, fold, auc``: each model on its own held-out fold.  Scores equal to that many digits are ties."""
    table = [(k, m.c, m.l1_share, m.fold) for k, m in enumerate(fitted.models)]
    names = rows.sparkSession.createDataFrame(table, "model int, c double, l1_share double, fold int")
    scored = held_out_scores(rows, fitted).withColumn("score", F.round("score", digits))
    with small_batches(rows.sparkSession):
        scored = materialize(scored, "grid-scores")
    auc = roc_auc_by(scored, ["model"])
    return auc.join(F.broadcast(names), "model").select("c", "l1_share", "fold", "auc")  # one row per model


def grid_models(c: tuple[float, ...], l1_share: tuple[float, ...], folds: int) -> list[Penalty]:
    return [Penalty(a, b, k) for a in c for b in l1_share for k in range(folds)]


def search(rows: DataFrame, size: int, models: list[Penalty], rounds: int = 2_000, tolerance: float = 1e-4) -> tuple[Penalty, DataFrame, Fitted]:
    """The penalty with the best mean AUC, the table of AUCs (``c, l1_share, auc``), and all fitted models."""
    fitted = fit_models(rows, size, models, rounds, tolerance)
    table = grid_auc(rows, fitted).groupBy("c", "l1_share").agg(F.avg("auc").alias("auc"))
    table = materialize(table, "grid-auc")
    best = table.orderBy(F.desc(F.round("auc", 9)), "c", "l1_share").first()
    return Penalty(best["c"], best["l1_share"]), table, fitted


def refit(rows: DataFrame, size: int, best: Penalty, fitted: Fitted, rounds: int = 2_000, tolerance: float = 1e-4) -> Fitted:
    """The best penalty on all rows, from the mean of its folds' coefficients."""
    mine = [k for k, m in enumerate(fitted.models) if (m.c, m.l1_share) == (best.c, best.l1_share)]
    start = fitted.coefficients[:, mine].mean(axis=1, keepdims=True)
    return fit_models(rows, size, [replace(best, fold=-1)], rounds, tolerance, start)
