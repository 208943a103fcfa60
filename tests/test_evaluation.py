"""Metrics on small score tables with ties, and the ranking behind them."""

import math
import random

from pyspark.sql import functions as F

from vigilrow.operators import dataset as D
from vigilrow.operators import evaluation as E
from vigilrow.operators import ranking as K
from vigilrow.operators import scoring as S

TIES = [(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.4), (1, 0.4), (0, 0.1)]


def scored(spark, rows=TIES):
    return spark.createDataFrame([(a, float(b)) for a, b in rows], "label int, score double")


def test_auc(spark):
    assert math.isclose(E.roc_auc(scored(spark)).first()["auc"], 6 / 9)


def test_pr_curve(spark):
    got = {r["threshold"]: (r["precision"], r["recall"]) for r in E.pr_curve(scored(spark)).collect()}
    want = {0.9: (1 / 2, 1 / 3), 0.8: (2 / 3, 2 / 3), 0.4: (3 / 5, 1.0), 0.1: (3 / 6, 1.0), None: (1.0, 0.0)}
    assert got.keys() == want.keys()
    for t, (p, r) in want.items():
        assert math.isclose(got[t][0], p) and math.isclose(got[t][1], r)


def test_thresholds(spark):
    points = E.pr_points(scored(spark))
    tree = E.tree_thresholds(points).first()
    assert (tree["blocking_threshold"], tree["hunting_threshold"]) == (0.9, 0.4)
    gram = E.ngram_thresholds(points).first()
    assert (gram["threshold_f1"], gram["threshold_blocking"], gram["threshold_hunting"]) == (0.4, 0.9, 0.4)


def test_confusion_and_report(spark):
    row = E.confusion(scored(spark), F.lit(0.4)).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (1, 2, 0, 3)
    report = {r["row"]: r for r in E.classification_report(scored(spark), F.lit(0.4)).collect()}
    assert math.isclose(report["bad"]["precision"], 0.6) and report["bad"]["recall"] == 1.0
    assert math.isclose(report["accuracy"]["f1"], 4 / 6) and report["macro avg"]["support"] == 6


def test_repair_in_both_directions(spark):
    rows = [(0, i / 100) for i in range(100)] + [(1, 0.5 + i / 200) for i in range(100)]
    for first, last in ((0.3, 0.99), (0.8, 0.2)):
        grid = [first + k * (last - first) / 99 for k in range(99)] + [last]
        rate = lambda t: sum(1 for a, s in rows if a == 0 and s >= t) / 100
        want = first
        if rate(first) > 0.10:
            want = next((t for t in grid if rate(t) <= 0.08), first)
        got = E.repaired_hunting(scored(spark, rows), F.lit(first), F.lit(last)).first()
        assert math.isclose(got["hunting_threshold"], want)


def test_running_totals_equal_a_plain_sum(spark):
    random.seed(3)
    rows = [(random.choice("aaab"), random.random(), random.randint(1, 5)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double, n int")
    got = K.running_totals(
        K.with_quantile_bucket(df, "v", "part", 16), ["k"], F.col("part"), [F.col("v")], {"upto": "n"}
    ).collect()
    for key in "ab":
        total = 0
        for r in sorted((r for r in got if r["k"] == key), key=lambda r: r["v"]):
            total += r["n"]
            assert r["upto"] == total


def test_split_is_exact_and_stable(spark):
    df = spark.range(1003).select(F.col("id").alias("file_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    one = {r["file_id"]: r["part"] for r in D.stratified_split(df, "file_id").collect()}
    two = {r["file_id"]: r["part"] for r in D.stratified_split(df.repartition(5), "file_id").collect()}
    assert one == two and sum(p == "test" for p in one.values()) == math.ceil(0.2 * 1003)
    assert sum(p == "test" and i % 3 == 0 for i, p in one.items()) in (66, 67)


def test_scaler_is_exact(spark):
    import numpy as np

    random.seed(5)
    rows = [(random.gauss(0, 1), float(random.random() < 0.1), float(random.randint(0, 4))) for _ in range(777)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {r["feature"]: r for r in D.fit_scaler(df, ("a", "b", "c")).collect()}
    for i, name in enumerate("abc"):
        q1, q2, q3 = np.percentile([r[i] for r in rows], [25, 50, 75])
        assert math.isclose(got[name]["median"], q2)
        assert math.isclose(got[name]["scale"], (q3 - q1) or 1.0)


def test_working_thresholds():
    assert S.thresholds("hunting").threshold == 0.55
    assert S.thresholds("blocking").threshold == S.BLOCKING_THRESHOLD
    assert S.thresholds("hunting", hunting=0.2).threshold == 0.2 * 1.5
