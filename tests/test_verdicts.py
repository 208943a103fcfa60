"""Hand-made rows for every branch of the verdict."""

import pytest
from pyspark.sql import functions as F

from vigilrow.functions.columns import FEATURES
from vigilrow.operators import scoring as S

BASE = {f: 0.0 for f in FEATURES} | {"entropy": 4.0, "overall_threat_score": 0.25}
SHELL = {"has_superglobal_var_call": 1.0}
MEDIUM = {"behavior_upload_chmod": 1.0}
WORDS = {"vocabulary_hits": 3}
LOW = S.Thresholds("blocking", 0.3)  # low enough for every multiple to stay below 1

CASES = [
    # specific signatures
    (LOW, ".aspx", 0.13, {"behavior_jscript_webshell": 1.0}, "WEBSHELL"),
    (LOW, ".aspx", 0.07, {"behavior_dotnet_memory_shell": 1.0}, "SUSPICIOUS"),
    (LOW, ".aspx", 0.01, {"behavior_jscript_webshell": 1.0}, "SUSPICIOUS"),
    (LOW, ".js", 0.01, {"behavior_jscript_webshell": 1.0, "benign_data_blob_score": 0.9, "string_literal_ratio": 0.9,
                        "overall_threat_score": 0.1}, "CLEAN"),
    # framework
    (LOW, ".php", 0.40, SHELL | WORDS, "WEBSHELL"),
    (LOW, ".php", 0.30, SHELL | WORDS, "SUSPICIOUS"),
    (LOW, ".php", 0.20, SHELL | WORDS, "CLEAN"),
    (LOW, ".php", 0.50, MEDIUM | WORDS, "SUSPICIOUS"),
    (LOW, ".php", 0.40, MEDIUM | WORDS, "CLEAN"),
    (LOW, ".php", 0.80, WORDS, "SUSPICIOUS"),
    (LOW, ".php", 0.80, WORDS | {"overall_threat_score": 0.1}, "CLEAN"),
    (LOW, ".php", 0.70, WORDS, "CLEAN"),
    # harmless bulk data
    (LOW, ".php", 0.99, {"benign_data_blob_score": 0.7}, "CLEAN"),
    # front-end files
    (LOW, ".js", 0.65, SHELL, "WEBSHELL"),
    (LOW, ".js", 0.50, SHELL, "SUSPICIOUS"),
    (LOW, ".css", 0.70, MEDIUM, "SUSPICIOUS"),
    (LOW, ".js", 0.80, {}, "SUSPICIOUS"),
    (LOW, ".js", 0.80, {"overall_threat_score": 0.1}, "CLEAN"),
    (LOW, ".js", 0.40, SHELL, "CLEAN"),
    # evidence, then the probability tiers
    (LOW, ".php", 0.19, MEDIUM, "WEBSHELL"),
    (LOW, ".php", 0.13, MEDIUM, "SUSPICIOUS"),
    (LOW, ".php", 0.05, MEDIUM, "CLEAN"),
    (LOW, ".php", 0.60, {}, "SUSPICIOUS"),
    (LOW, ".php", 0.60, {"overall_threat_score": 0.4}, "WEBSHELL"),
    (LOW, ".php", 0.60, {"overall_threat_score": 0.4, "benign_data_blob_score": 0.55}, "SUSPICIOUS"),
    (LOW, ".php", 0.45, {"overall_threat_score": 0.4}, "WEBSHELL"),
    (LOW, ".php", 0.45, {}, "SUSPICIOUS"),
    (LOW, ".php", 0.45, {"benign_data_blob_score": 0.45}, "CLEAN"),
    (LOW, ".php", 0.20, {"overall_threat_score": 0.4}, "SUSPICIOUS"),
    (LOW, ".php", 0.20, {}, "CLEAN"),
    (LOW, ".php", 0.05, {"overall_threat_score": 0.9}, "CLEAN"),
    # hunting downgrade
    (S.Thresholds("hunting", 0.3), ".php", 0.19, SHELL, "WEBSHELL"),
    (S.Thresholds("hunting", 0.3), ".php", 0.40, SHELL | WORDS, "SUSPICIOUS"),
    (S.Thresholds("hunting", 0.3), ".php", 0.19, MEDIUM | {"overall_threat_score": 0.1, "string_literal_ratio": 0.72}, "SUSPICIOUS"),
    (S.Thresholds("hunting", 0.3), ".php", 0.19, SHELL | {"benign_data_blob_score": 0.55}, "SUSPICIOUS"),
]


def row(ext, prob, changes):
    return {"vocabulary_hits": 0, "size": 1000, "ext": ext, "prob": prob, "detected_framework": ""} | BASE | changes


def judged(spark, limits, rows):
    return S.judge(spark.createDataFrame(rows), limits).collect()


@pytest.mark.parametrize("mode", ["blocking", "hunting"])
def test_verdict_branches(spark, mode):
    cases = [c for c in CASES if c[0].mode == mode]
    rows = [row(ext, prob, changes) | {"n": i} for i, (_, ext, prob, changes, _) in enumerate(cases)]
    for r in judged(spark, cases[0][0], rows):
        assert r["verdict"] == cases[r["n"]][4], cases[r["n"]]


def test_framework_tests(spark):
    big = {"size": 100_001}
    cases = [
        (".php", big, True), (".php", big | SHELL, False), (".jsp", big | SHELL, True),
        (".php", {"size": 100_000}, False), (".php", {"entropy": 4.6}, True),
        (".php", {"entropy": 4.6, "has_exec_function": 1.0, "has_input_access": 1.0}, False),
        (".ascx", {"entropy": 4.6, "has_exec_function": 1.0, "has_input_access": 1.0,
                   "aspx_databinding_eval_count": 1.0}, True),
        (".php", {"string_literal_ratio": 0.8}, True), (".php", {"string_literal_ratio": 0.8} | SHELL, False),
        (".php", {"benign_data_blob_score": 0.9}, True), (".php", WORDS, True), (".php", {"vocabulary_hits": 2}, False),
        (".php", {"detected_framework": "vue"}, False),
    ]
    rows = [row(ext, 0.5, changes) | {"n": i} for i, (ext, changes, _) in enumerate(cases)]
    for r in judged(spark, LOW, rows):
        assert r["is_framework"] == cases[r["n"]][2], cases[r["n"]]
    named = spark.createDataFrame([row(".php", 0.5, {"detected_framework": "vue"})])
    assert named.select(S.likely_framework(True).alias("x")).first()["x"]


def test_missing_and_text_features_become_zero(spark):
    df = spark.createDataFrame([(1.5, "x", None)], "entropy double, has_goto string, log_code_size double")
    got = df.select(*S.align(df, ("entropy", "has_goto", "log_code_size", "has_xyz"))).first()
    assert tuple(got) == (1.5, 0.0, 0.0, 0.0)
    assert [r["feature"] for r in S.missing_features(df, ("entropy", "has_xyz")).collect()] == ["has_xyz"]


def test_ensemble(spark):
    df = spark.createDataFrame([(0.8, 0.4), (0.8, None)], "a double, b double")
    got = [r[0] for r in df.select(S.ensemble(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.7) and got[1] == pytest.approx(0.6)
    assert df.select(S.ensemble(F.col("a"), None)).first()[0] == 0.8
