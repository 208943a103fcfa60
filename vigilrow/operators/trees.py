"""Boosted trees as rows: one table of nodes, scored by a column expression.

A row is one node: ``tree, node, feature`` (index; -1 for a leaf), ``cut``
(values up to it go ``below``), ``below, above`` (nodes) and ``value`` (what a
leaf adds to the margin).  Root nodes have number 0.  The number of rows is
bounded by the model's settings (rounds times leaves), not by any data, so the
table may become literals of an expression.  Scoring stays in the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilrow.functions.columns import FEATURES
from vigilrow.session import scratch_folder

NODES = "tree int, node int, feature int, cut double, below int, above int, value double"


def nodes_of(model: GBTClassificationModel) -> DataFrame:
    """The nodes of an MLlib model, read from its saved form.

    MLlib's margin counts twice: its probability is the logistic function of two
    times the weighted sum of the trees.
    """
    spark = SparkSession.active()
    folder = scratch_folder(spark, "trees")
    model.write().save(folder)
    data = spark.read.parquet(f"{folder}/data")
    weights = F.element_at(F.lit([2.0 * float(w) for w in model.treeWeights]), F.col("treeID") + 1)
    leaf = F.col("n.leftChild") < 0
    return data.select(F.col("treeID").alias("tree"), F.col("nodeData").alias("n"), weights.alias("w")).select(
        "tree", F.col("n.id").alias("node"), F.when(leaf, -1).otherwise(F.col("n.split.featureIndex")).cast("int").alias("feature"),
        F.when(~leaf, F.get("n.split.leftCategoriesOrThreshold", 0)).alias("cut"), F.col("n.leftChild").alias("below"),
        F.col("n.rightChild").alias("above"), F.when(leaf, F.col("w") * F.col("n.prediction")).otherwise(0.0).alias("value"),
    )


def _constant(values: list, kind: str) -> str:
    """An array literal that is parsed once, whatever its length."""
    return f"CAST(split('{','.join(map(repr, values))}', ',') AS array<{kind}>)"


def margin(nodes: DataFrame, columns: tuple[str, ...] = FEATURES) -> Column:
    """The sum of the leaves that a row reaches; a missing or NaN value goes above."""
    # Rounds times leaves rows, a model parameter.
    rows = sorted(nodes.collect(), key=lambda r: (r["tree"], r["node"]))
    if not rows:
        return F.lit(0.0)
    place = {(r["tree"], r["node"]): k for k, r in enumerate(rows)}
    low, high = [], []
    for r in rows:
        is_leaf = r["feature"] < 0
        low.append(-1 if is_leaf else place[r["tree"], r["below"]])
        high.append(-1 if is_leaf else place[r["tree"], r["above"]])
    roots = [place[t, 0] for t in sorted({r["tree"] for r in rows})]
    level, frontier = 0, roots
    while frontier := [c for k in frontier if low[k] >= 0 for c in (low[k], high[k])]:
        level += 1
    features = _constant([r["feature"] for r in rows], "int")
    cuts = _constant([0.0 if r["cut"] is None else r["cut"] for r in rows], "double")
    values = _constant([r["value"] for r in rows], "double")
    step = f"IF(get({features}, n) < 0, n, IF(get(x, get({features}, n)) <= get({cuts}, n), get({_constant(low, 'int')}, n), get({_constant(high, 'int')}, n)))"
    reached = f"aggregate(sequence(0, {level}), root, (n, i) -> {step})"
    total = f"aggregate({_constant(roots, 'int')}, 0D, (sum, root) -> sum + get({values}, {reached}))"
    given = ", ".join(f"CAST(`{c}` AS double)" for c in columns)
    # The row's values are bound once, as an element, and not made anew at every node.
    return F.expr(f"element_at(transform(array(array({given})), x -> {total}), 1)")


def with_probability(df: DataFrame, nodes: DataFrame, columns: tuple[str, ...] = FEATURES, name: str = "prob_tree") -> DataFrame:
    """Adds the probability of label 1."""
    return df.withColumn(name, 1.0 / (1.0 + F.exp(-margin(nodes, columns))))


def split_counts(nodes: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """``feature, importance``: how many nodes ask for each feature."""
    names = F.element_at(F.lit(list(columns)), F.col("feature") + 1)
    used = nodes.where("feature >= 0").groupBy(names.alias("feature")).agg(F.count("*").cast("double").alias("importance"))
    every = nodes.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return every.join(F.broadcast(used), "feature", "left").na.fill(0.0, ["importance"])  # one row per feature
