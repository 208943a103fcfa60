"""Training data: labelled union, exact split, weights, robust scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilrow.functions.columns import FEATURES
from vigilrow.operators.ranking import hash_bucket, running_totals
from vigilrow.operators.scoring import any_set
from vigilrow.operators.selection import quantiles
from vigilrow.session import materialize

# ---------------------------------------------------------------------------
# Weights, split shares, smallest class.
# ---------------------------------------------------------------------------
WEIGHT_CRITICAL, WEIGHT_BAD, WEIGHT_CLEAN = 3.0, 1.5, 1.0
CRITICAL_FOR_WEIGHT = (
    "behavior_input_decode_exec", "behavior_password_backdoor", "behavior_jscript_webshell",
    "behavior_dotnet_memory_shell", "behavior_aspx_process_shell", "behavior_jsp_memory_shell",
    "behavior_jsp_hardcoded_backdoor",
)
TREE_TEST_SHARE, NGRAM_TEST_SHARE = 0.2, 0.15
SEED = 42
MIN_PER_CLASS = 100
# End of the fixed values.


def labelled_union(clean: list[DataFrame], bad: list[DataFrame]) -> DataFrame:
    """Several clean and several bad relations appended, labelled by origin."""
    parts = [df.withColumn("label", F.lit(0)) for df in clean] + [df.withColumn("label", F.lit(1)) for df in bad]
    return reduce(DataFrame.unionByName, parts)


def class_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count("*").alias("n"))


def require_samples(labelled: DataFrame, least: int = MIN_PER_CLASS) -> DataFrame:
    """The input unchanged; fails if it is empty or a class is too small."""
    counts = {row["label"]: row["n"] for row in class_counts(labelled).collect()}  # two rows
    if not counts:
        raise RuntimeError("no rows with features: check the input folders and suffixes")
    if min(counts.get(0, 0), counts.get(1, 0)) < least:
        raise ValueError(f"need at least {least} samples per class, got {counts}")
    return labelled


def stratified_split(
    labelled: DataFrame, id_column: str, test_share: float = TREE_TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Adds ``part`` (train / test) with exact sizes per label.

    Each label's rows are ordered by a hash of id and seed, and the first ones
    are the test rows: the same on every run and every partitioning.  The test
    size is rounded up in total and shared out by largest remainder.
    """
    counts = class_counts(labelled)
    # One row per label from here to the join.
    everything = Window.partitionBy(F.lit(0))
    counts = counts.withColumn("total", F.sum("n").over(everything))
    counts = counts.withColumn("want", F.ceil(F.col("total") * F.lit(test_share)))
    counts = counts.withColumn("ideal", F.col("want") * F.col("n") / F.col("total"))
    counts = counts.withColumn("base", F.floor("ideal"))
    counts = counts.withColumn("left_over", F.col("want") - F.sum("base").over(everything))
    by_remainder = everything.orderBy(F.desc(F.round(F.col("ideal") - F.col("base"), 9)), "label")
    quota = counts.select(
        F.col("label").alias("label_q"),
        (
            F.col("base") + F.when(F.row_number().over(by_remainder) <= F.col("left_over"), 1).otherwise(0)
        ).alias("quota"),
    )
    digest_of = lambda c: F.md5(F.concat_ws(":", F.col(c).cast("string"), F.lit(str(seed))))
    # Only labels, ids and digests are ranked; the rows themselves are marked in place.
    keys = labelled.select("label", F.col(id_column).alias("id_")).withColumn("digest_", digest_of("id_"))
    ranked = running_totals(keys, ["label"], hash_bucket(F.col("digest_")), [F.col("digest_"), F.col("id_")], {"rank_": F.lit(1)})
    # One row per label: the last test row of each.  Always small enough to broadcast.
    last = ranked.join(F.broadcast(quota), F.col("label") == F.col("label_q")).where("rank_ = quota")
    cut = last.select("label_q", F.struct("digest_", "id_").alias("cut_"))
    own = F.struct(digest_of(id_column).alias("digest_"), F.col(id_column).alias("id_"))
    marked = labelled.join(F.broadcast(cut), F.col("label") == F.col("label_q"), "left")
    return marked.withColumn("part", F.when(own <= F.col("cut_"), "test").otherwise("train")).select(*labelled.columns, "part")


def stratified_folds(labelled: DataFrame, id_column: str, folds: int = 3, seed: int = SEED) -> DataFrame:
    """Adds ``fold`` 0..folds-1, even within each label."""
    digest = F.md5(F.concat_ws(":", F.col(id_column).cast("string"), F.lit(f"fold{seed}")))
    keys = labelled.select("label", id_column).withColumn("digest_", digest)
    ranked = running_totals(
        keys, ["label"], hash_bucket(F.col("digest_")), [F.col("digest_"), F.col(id_column)], {"rank_": F.lit(1)}
    )
    # Ids alone are ranked; their fold comes back by a join.
    fold = ranked.select(id_column, ((F.col("rank_") - 1) % folds).cast("int").alias("fold"))
    return labelled.join(fold, id_column).select(*labelled.columns, "fold")


def sample_weight() -> Column:
    """Bad files with a critical sign weigh most, other bad files more than clean ones."""
    manager_gate = (F.col("behavior_file_manager") > 0) & (F.col("behavior_password_backdoor") > 0)
    critical = any_set(CRITICAL_FOR_WEIGHT) | manager_gate
    bad = F.col("label") == 1
    return F.when(bad & critical, WEIGHT_CRITICAL).when(bad, WEIGHT_BAD).otherwise(WEIGHT_CLEAN)


def balanced_weights(labelled: DataFrame) -> DataFrame:
    """Per label, the weight that gives both classes the same total."""
    counts = class_counts(labelled)
    every = Window.partitionBy(F.lit(0))  # one row per label
    return counts.select(
        "label", "n", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight")
    )


def fit_scaler(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """``feature, median, scale``: exact median and interquartile range per column.

    A zero range scales by 1.  The rows are written once, as each round of the
    selection reads them.
    """
    rows = materialize(features.select(*columns), "scaler-rows")
    found = quantiles(rows, columns, (0.25, 0.5, 0.75))
    table = [(c, q[1], None if q[1] is None else (q[2] - q[0]) or 1.0) for c, q in found.items()]
    return features.sparkSession.createDataFrame(table, "feature string, median double, scale double")  # one row per feature


def apply_scaler(features: DataFrame, fitted: DataFrame) -> DataFrame:
    """(x - median) / scale; the parameters are one number pair per feature."""
    params = {row["feature"]: row for row in fitted.collect()}  # one row per feature
    return features.withColumns(
        {c: F.expr(f"(cast({c} AS double) - {p['median']!r}D) / {p['scale']!r}D") for c, p in params.items()}
    )


