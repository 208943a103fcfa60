"""Model evaluation over a ``(label, score)`` relation of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilrow.operators.ranking import running_totals, with_quantile_bucket

# ---------------------------------------------------------------------------
# Targets and fall-backs of the threshold rules.
# ---------------------------------------------------------------------------
TREE_BLOCKING = {"precision": 0.99, "otherwise": 0.9}
TREE_HUNTING = {"recall": 0.96, "otherwise": 0.5}
NGRAM_BLOCKING = {"precision": 0.95, "otherwise": 0.9}
NGRAM_HUNTING = {"recall": 0.95, "otherwise": 0.3}
F1_EPSILON = 1e-10
REPAIR = {"above": 0.10, "target": 0.08, "points": 100}
OVERFIT_GAP = 0.05
# End of the fixed values.


def score_groups(scored: DataFrame) -> DataFrame:
    """One row per distinct score: positives and negatives at that score."""
    bad = F.col("label").cast("long")
    return scored.groupBy("score").agg(F.sum(bad).alias("pos"), F.sum(1 - bad).alias("neg"))


def cumulative(scored: DataFrame) -> DataFrame:
    """``score, pos, neg, tp, fp``: hits and false alarms with the rule score >= t."""
    groups = with_quantile_bucket(score_groups(scored), "score", "part", descending=True)
    runs = running_totals(groups, [], F.col("part"), [F.desc("score")], {"tp": "pos", "fp": "neg"})
    return runs.drop("part")


def _total(scored: DataFrame, label: int) -> Column:
    return scored.select(F.sum((F.col("label") == label).cast("long"))).scalar()


def pr_points(scored: DataFrame) -> DataFrame:
    """``threshold, precision, recall`` per distinct score."""
    positives = _total(scored, 1)
    return cumulative(scored).select(
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        # With no positives at all, recall is 1 by convention.
        F.when(positives == 0, F.lit(1.0)).otherwise(F.col("tp") / positives).alias("recall"),
    )


def pr_curve(scored: DataFrame) -> DataFrame:
    """The points plus the closing point (precision 1, recall 0), which has no threshold."""
    end = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return pr_points(scored).unionByName(end)


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve; tied scores count one half."""
    runs = cumulative(scored)
    wins = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    return runs.agg(
        (F.sum(wins) / (F.sum("pos") * F.sum("neg"))).alias("auc"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )


def roc_auc_by(scored: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, auc, positives, negatives``: the area for each group, all groups in one pass."""
    bad = F.col("label").cast("long")
    groups = scored.groupBy(*keys, "score").agg(F.sum(bad).alias("pos"), F.sum(1 - bad).alias("neg"))
    groups = with_quantile_bucket(groups, "score", "part", descending=True)
    runs = running_totals(groups, keys, F.col("part"), [F.desc("score")], {"tp": "pos", "fp": "neg"})
    wins = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    return runs.groupBy(*keys).agg(
        (F.sum(wins) / (F.sum("pos") * F.sum("neg"))).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")
    )


def tree_thresholds(points: DataFrame) -> DataFrame:
    """Blocking: most recall at enough precision; hunting: most precision at
    enough recall; the lowest threshold wins ties."""
    safe = F.col("precision") >= TREE_BLOCKING["precision"]
    wide = F.col("recall") >= TREE_HUNTING["recall"]
    # On equal first fields the larger negated threshold, i.e. the lowest, wins.
    return points.agg(
        F.coalesce(
            -F.max(F.when(safe, F.struct(F.col("recall").alias("best"), (-F.col("threshold")).alias("t"))))["t"],
            F.lit(TREE_BLOCKING["otherwise"]),
        ).alias("blocking_threshold"),
        F.coalesce(
            -F.max(F.when(wide, F.struct(F.col("precision").alias("best"), (-F.col("threshold")).alias("t"))))["t"],
            F.lit(TREE_HUNTING["otherwise"]),
        ).alias("hunting_threshold"),
    )


def ngram_thresholds(points: DataFrame) -> DataFrame:
    """F1-optimal (lowest on ties), lowest precise, and highest sensitive threshold."""
    precision, recall = F.col("precision"), F.col("recall")
    f1 = 2 * (precision * recall) / (precision + recall + F1_EPSILON)
    return points.agg(
        (-F.max(F.struct(f1.alias("best"), (-F.col("threshold")).alias("t")))["t"]).alias("threshold_f1"),
        F.coalesce(
            F.min(F.when(precision >= NGRAM_BLOCKING["precision"], F.col("threshold"))),
            F.lit(NGRAM_BLOCKING["otherwise"]),
        ).alias("threshold_blocking"),
        F.coalesce(
            F.max(F.when(recall >= NGRAM_HUNTING["recall"], F.col("threshold"))),
            F.lit(NGRAM_HUNTING["otherwise"]),
        ).alias("threshold_hunting"),
    )


def confusion(scored: DataFrame, threshold: Column) -> DataFrame:
    """Counts and error rates with the rule score >= threshold."""
    hit = F.col("score") >= threshold
    bad = F.col("label") == 1
    cell = lambda when: F.sum(F.coalesce(when.cast("long"), F.lit(0)))
    cells = scored.agg(
        cell(~bad & ~hit).alias("tn"), cell(~bad & hit).alias("fp"),
        cell(bad & ~hit).alias("fn"), cell(bad & hit).alias("tp"),
    )
    rate = lambda part, rest: F.when(
        F.col(part) + F.col(rest) > 0, F.col(part) / (F.col(part) + F.col(rest))
    ).otherwise(0.0)
    return cells.withColumns({"fp_rate": rate("fp", "tn"), "fn_rate": rate("fn", "tp")})


def classification_report(scored: DataFrame, threshold: Column) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and averages."""
    guess = (F.col("score") >= threshold).cast("int")
    cells = scored.groupBy(F.col("label").cast("int").alias("label"), guess.alias("guess")).agg(
        F.count("*").alias("n")
    )
    # From here on at most four rows exist.
    rows = cells.select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("class"), *_marks(0)),
                F.struct(F.lit(1).alias("class"), *_marks(1)),
            )
        ).alias("c")
    ).select("c.*")
    per_class = rows.groupBy("class").agg(
        F.sum("right").alias("right"), F.sum("guessed").alias("guessed"), F.sum("support").alias("support")
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per_class = per_class.withColumns(
        {
            "precision": ratio(F.col("right"), F.col("guessed")),
            "recall": ratio(F.col("right"), F.col("support")),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    per_class = per_class.withColumn("f1", ratio(2 * p * r, p + r))
    names = ("precision", "recall", "f1")
    classes = per_class.select(
        F.when(F.col("class") == 1, "bad").otherwise("clean").alias("row"), *names, "support"
    )
    averages = per_class.agg(
        (F.sum("right") / F.sum("support")).alias("acc"),
        *[F.avg(c).alias(f"m_{c}") for c in names],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"w_{c}") for c in names],
        F.sum("support").alias("support"),
    )
    averages = averages.select(
        F.explode(
            F.array(
                F.struct(F.lit("accuracy").alias("row"), *[F.col("acc").alias(c) for c in names], "support"),
                F.struct(F.lit("macro avg").alias("row"), *[F.col(f"m_{c}").alias(c) for c in names], "support"),
                F.struct(F.lit("weighted avg").alias("row"), *[F.col(f"w_{c}").alias(c) for c in names], "support"),
            )
        ).alias("a")
    ).select("a.*")
    return classes.unionByName(averages)


def _marks(label: int) -> list[Column]:
    is_label, is_guess = F.col("label") == label, F.col("guess") == label
    take = lambda when: F.when(when, F.col("n")).otherwise(0)
    return [
        take(is_label & is_guess).alias("right"),
        take(is_guess).alias("guessed"),
        take(is_label).alias("support"),
    ]


def false_alarm_grid(scored: DataFrame, hunting: Column, blocking: Column) -> DataFrame:
    """False-alarm and miss rates at evenly spaced thresholds from hunting to blocking.

    A score only needs the number of grid points at or below it, so the data is
    read once and grouped into at most 101 rows; no join with the grid.
    """
    n = REPAIR["points"]
    first, last = F.col("first_"), F.col("last_")
    point = lambda k: F.when(k == n - 1, last).otherwise(first + k * ((last - first) / (n - 1)))
    at_or_below = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point), lambda t: t <= F.col("score"))
    counts = (
        scored.withColumns({"first_": hunting, "last_": blocking})
        .groupBy("first_", "last_", F.size(at_or_below).alias("m"))
        .agg(
            F.sum((F.col("label") == 0).cast("long")).alias("clean"),
            F.sum((F.col("label") == 1).cast("long")).alias("bad"),
        )
    )
    passed = F.when(first <= last, F.col("k") < F.col("m")).otherwise(F.col("k") >= n - F.col("m"))
    spread = counts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rates = spread.groupBy("k", point(F.col("k")).alias("threshold")).agg(
        (F.sum(F.when(passed, F.col("clean")).otherwise(0)) / F.sum("clean")).alias("fp_rate"),
        (F.sum(F.when(passed, 0).otherwise(F.col("bad"))) / F.sum("bad")).alias("fn_rate"),
    )
    return rates


def repaired_hunting(scored: DataFrame, hunting: Column, blocking: Column) -> DataFrame:
    """Hunting threshold, moved towards blocking if it raises too many false alarms."""
    grid = false_alarm_grid(scored, hunting, blocking)
    first_ok = F.min(
        F.when(F.col("fp_rate") <= REPAIR["target"], F.struct("k", F.col("threshold").alias("t")))
    )["t"]
    at_start = F.max(F.when(F.col("k") == 0, F.col("fp_rate")))
    return grid.agg(
        F.when(at_start > REPAIR["above"], F.coalesce(first_ok, hunting)).otherwise(hunting).alias(
            "hunting_threshold"
        ),
        at_start.alias("fp_rate_before"),
    )


def overfit_check(train_auc: DataFrame, test_auc: DataFrame) -> DataFrame:
    """Train and test AUC (one-row inputs) and whether their gap is too wide."""
    return train_auc.select(F.col("auc").alias("train_auc")).withColumn(
        "test_auc", test_auc.select("auc").scalar()
    ).withColumn("overfit", F.col("train_auc") - F.col("test_auc") > OVERFIT_GAP)
