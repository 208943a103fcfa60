"""The scan: files in, one judged row per file out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilrow.operators.features import feature_table
from vigilrow.operators.gates import with_gate
from vigilrow.operators.scoring import Thresholds, ensemble, judge, thresholds, vocabulary_hits
from vigilrow.session import materialize

VERDICTS = ("CLEAN", "SUSPICIOUS", "WEBSHELL")
RESULT_COLUMNS = (
    "file", "extension", "probability", "probability_lgbm", "probability_ngram", "confidence", "verdict",
    "blob_score", "threat_score", "is_framework", "detected_framework",
)

Scorer = Callable[[DataFrame], DataFrame]


def evidence(files: DataFrame, scan_all: bool = False, keep_text: bool = False) -> DataFrame:
    """Every input file with its gate, and for files that pass it the features.

    Skipped files pass through with a null text: the input is read once and
    their features cost nothing.  The text is kept only for a scorer that reads it.
    """
    gated = with_gate(files, scan_all)
    text = F.when(F.col("gate").isNull(), F.col("code"))
    gated = gated.select("file_id", "path", "ext", "size", "gate", text.alias("code"))
    keep = ("file_id", "path", "ext", "size", "gate", "code")
    df = feature_table(gated, keep=keep, drop_short=False)
    return df.withColumn("vocabulary_hits", vocabulary_hits("code")).drop(*(() if keep_text else ("code",)))


def triage(
    evidence: DataFrame,
    scorer: Scorer,
    limits: Thresholds | None = None,
    use_framework_name: bool = False,
) -> DataFrame:
    """Every file with its ``status``: a verdict, or why it was skipped.

    ``scorer`` adds ``prob_tree`` and, if there is an n-gram model,
    ``prob_ngram``.
    """
    df = scorer(evidence)
    ngram: Column | None = F.col("prob_ngram") if "prob_ngram" in df.columns else None
    df = df.withColumn("prob", ensemble(F.col("prob_tree"), ngram))
    if ngram is None:
        df = df.withColumn("prob_ngram", F.lit(0.0))
    df = judge(df, limits or thresholds(), use_framework_name)
    return df.withColumn("status", F.coalesce(F.col("gate"), F.col("verdict")))


def scan(
    files: DataFrame, scorer: Scorer, mode: str = "hunting", scan_all: bool = False, limits: Thresholds | None = None
) -> DataFrame:
    """The whole scan; the features and scores are written once, as every report reads them.

    ``scorer`` is a trained bundle's (``plans.bundle``) or any function that adds
    ``prob_tree`` and, optionally, ``prob_ngram``.
    """
    scored = scorer(evidence(files, scan_all, keep_text=True))
    table = materialize(scored.drop("code"), "evidence")
    return triage(table, lambda df: df, limits or thresholds(mode))


def results(judged: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """The result rows of the scanned files, scores to four digits."""
    four = lambda c: F.round(F.col(c), 4)
    return judged.where(F.col("gate").isNull()).select(
        *also,
        F.col("path").alias("file"),
        F.col("ext").alias("extension"),
        four("prob").alias("probability"),
        four("prob_tree").alias("probability_lgbm"),
        four("prob_ngram").alias("probability_ngram"),
        four("confidence").alias("confidence"),
        "verdict",
        four("benign_data_blob_score").alias("blob_score"),
        four("overall_threat_score").alias("threat_score"),
        "is_framework",
        "detected_framework",
    )
