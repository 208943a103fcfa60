"""The two training runs, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.functions.columns import FEATURES
from vigilrow.operators import boosting as B
from vigilrow.operators import dataset as D
from vigilrow.operators import elastic as EN
from vigilrow.operators import evaluation as E
from vigilrow.operators import models as M
from vigilrow.operators import ngram as N
from vigilrow.operators import trees as T
from vigilrow.operators.oversample import borderline_smote
from vigilrow.operators.scoring import align, boost
from vigilrow.session import materialize, small_batches

QUICK_TREES = M.TreeSettings(rounds=10, depth=4)
QUICK_LEAFWISE = B.LeafwiseSettings(rounds=3)
QUICK_LINEAR = M.LinearSettings(rounds=50)


@dataclass(frozen=True)
class TreeRun:
    nodes: DataFrame  # trees.NODES
    scaler: DataFrame
    metrics: DataFrame
    importances: DataFrame
    model: GBTClassificationModel | None = None  # if MLlib grew the trees


@dataclass(frozen=True)
class NgramRun:
    model: LogisticRegressionModel
    vocabulary: DataFrame
    metrics: DataFrame
    coefficients: DataFrame
    search: DataFrame | None


def three_way_split(labelled: DataFrame, id_column: str) -> DataFrame:
    """Test rows first, then validation rows from what is left."""
    first = D.stratified_split(labelled, id_column, D.NGRAM_TEST_SHARE)
    rest = first.where("part = 'train'").drop("part")
    second = D.stratified_split(rest, id_column, D.NGRAM_TEST_SHARE, seed=D.SEED + 1)
    second = second.withColumn("part", F.when(F.col("part") == "test", "validation").otherwise("train"))
    return first.where("part = 'test'").unionByName(second)


def tree_features(features: DataFrame, scaler: DataFrame, profile: str) -> DataFrame:
    """Aligned, boosted and scaled features."""
    others = [c for c in features.columns if c not in FEATURES]
    return D.apply_scaler(boost(features.select(*others, *align(features)), profile), scaler)


def train_trees(
    labelled: DataFrame, settings: B.LeafwiseSettings | M.TreeSettings = B.LeafwiseSettings(), oversample: bool = True
) -> TreeRun:
    """Feature rows with labels -> trees, scaler, thresholds and rates, importances.

    Trees grow leaf by leaf, or level by level in MLlib with its settings.
    Oversampling comes before boosting and scaling and touches only the
    training side.
    """
    parts = materialize(D.stratified_split(labelled, "file_id", D.TREE_TEST_SHARE), "tree-split")
    train = parts.where("part = 'train'").select("label", *align(parts))
    if oversample:
        train = materialize(borderline_smote(train, FEATURES), "tree-oversampled")
    weighted = train.withColumn("weight", D.sample_weight())
    scaler = materialize(D.fit_scaler(boost(train, "train")), "tree-scaler")
    model = None
    if isinstance(settings, M.TreeSettings):
        matrix = M.assemble(tree_features(weighted, scaler, "train")).drop(*FEATURES)
        model = M.fit_trees(materialize(matrix, "tree-matrix"), settings)
        nodes, weights = T.nodes_of(model), M.importances(model, FEATURES, train)
    else:
        matrix = materialize(tree_features(weighted, scaler, "train"), "tree-matrix")
        nodes = materialize(B.fit_leafwise(matrix, settings), "tree-nodes")
        weights = T.split_counts(nodes)
    held_out = parts.where("part = 'test'").select("file_id", "label", *align(parts))
    scored = T.with_probability(tree_features(held_out, scaler, "train"), nodes, name="score")
    scored = materialize(scored.select("label", "score"), "tree-scores")
    return TreeRun(nodes, scaler, tree_metrics(scored, train), weights, model)


def tree_metrics(scored: DataFrame, train: DataFrame) -> DataFrame:
    """One row: AUC, thresholds after repair, error rates, sample counts."""
    fitted = E.tree_thresholds(E.pr_points(scored))
    blocking = fitted.select("blocking_threshold").scalar()
    hunting = E.repaired_hunting(scored, fitted.select("hunting_threshold").scalar(), blocking)
    row = fitted.select("blocking_threshold").withColumn(
        "hunting_threshold", hunting.select("hunting_threshold").scalar()
    )
    row = materialize(row, "tree-thresholds")
    for mode in ("hunting", "blocking"):
        rates = E.confusion(scored, row.select(f"{mode}_threshold").scalar())
        row = row.withColumns(
            {
                f"fp_rate_{mode}": rates.select("fp_rate").scalar(),
                f"fn_rate_{mode}": rates.select("fn_rate").scalar(),
            }
        )
    return row.withColumns(
        {
            "validation_auc": E.roc_auc(scored).select("auc").scalar(),
            "train_samples": train.select(F.count("*")).scalar(),
            "val_samples": scored.select(F.count("*")).scalar(),
            # The two rules can cross; say so instead of changing them.
            "thresholds_inverted": F.col("blocking_threshold") < F.col("hunting_threshold"),
        }
    )


def train_ngrams(
    labelled_texts: DataFrame, settings: M.LinearSettings = M.LinearSettings(), grid: M.Grid | None = None
) -> NgramRun:
    """``file_id, code, label`` -> model, vocabulary, thresholds and rates, coefficients.

    Vocabulary and idf come from the training side only.
    """
    texts = N.training_view(D.require_samples(labelled_texts)).select("file_id", "label", "clean")
    parts = materialize(three_way_split(texts, "file_id"), "ngram-split")
    side = lambda name: parts.where(F.col("part") == name)
    vocab = materialize(N.vocabulary(side("train").select("file_id", "clean")), "ngram-vocabulary")
    size = vocab.count()
    with small_batches(parts.sparkSession):
        vectors, lists = M.stored_vectors(N.with_weights(parts, vocab, drop=("clean",)), size)
    train = M.with_balance(vectors.where("part = 'train'"))
    search = None
    if grid is not None:
        # All models of the grid and its folds step together.
        with small_batches(parts.sparkSession):
            rows = materialize(D.stratified_folds(M.with_balance(lists.where("part = 'train'")), "file_id", grid.folds), "grid-rows")
        best, search, _ = EN.search(rows, size, EN.grid_models(grid.c, grid.l1_share, grid.folds), settings.rounds)
        settings = M.LinearSettings(c=best.c, l1_share=best.l1_share, rounds=settings.rounds)
    model = M.fit_linear(train, settings)
    with small_batches(parts.sparkSession):
        scored = materialize(
            M.bad_probability(model, vectors, "score").select("file_id", "label", "part", "score"), "ngram-scores"
        )
    coefs = M.coefficients(model, vocab)
    return NgramRun(model, vocab, ngram_metrics(scored, vocab), coefs, search)


def ngram_metrics(scored: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: AUCs, thresholds from the validation side, rates on the test side."""
    side = lambda name: scored.where(F.col("part") == name)
    row = materialize(E.ngram_thresholds(E.pr_points(side("validation"))), "ngram-thresholds")
    rates = E.confusion(side("test"), row.select("threshold_f1").scalar())
    row = row.withColumns(
        {f"{p}_auc": E.roc_auc(side(n)).select("auc").scalar() for p, n in
         (("train", "train"), ("val", "validation"), ("test", "test"))}
    )
    n = lambda block: vocab.where(F.col("block") == block).select(F.count("*")).scalar()
    return row.withColumns(
        {
            "overfit": F.col("train_auc") - F.col("test_auc") > E.OVERFIT_GAP,
            "fp_rate": rates.select("fp_rate").scalar(),
            "fn_rate": rates.select("fn_rate").scalar(),
            "char_features": n("char"),
            "word_features": n("word"),
        }
    )
