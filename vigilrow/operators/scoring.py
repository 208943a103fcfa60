"""From features and probabilities to confidence and verdict."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilrow.functions.columns import BINDING_FAMILY, DOTNET_FAMILY, FEATURES, JAVA_FAMILY
from vigilrow.functions.match import sql_text

# ---------------------------------------------------------------------------
# Model thresholds, boost groups, evidence groups, weights.
# ---------------------------------------------------------------------------
BLOCKING_THRESHOLD = 0.8597691138350111
HUNTING_THRESHOLD = 0.8939398041139585
HUNTING_FACTOR, HUNTING_CAP = 1.5, 0.55
SUSPICIOUS_SHARE = 0.35
TREE_SHARE, NGRAM_SHARE = 0.75, 0.25

BOOST_CRITICAL = (
    "behavior_input_decode_exec", "behavior_password_backdoor", "behavior_upload_chmod",
    "has_assign_input_then_call", "behavior_aspx_process_shell", "behavior_aspx_privilege_pipe",
    "behavior_aspx_file_manager", "behavior_jsp_memory_shell", "behavior_jsp_request_exec",
    "behavior_jsp_hardcoded_backdoor", "behavior_jscript_webshell", "behavior_dotnet_memory_shell",
)
BOOST_STRONG_SERVE = (
    "behavior_cookie_hash_gate_dyn_call", "behavior_aspx_tunneling", "behavior_jsp_http_tunneling",
    "behavior_jsp_http_backdoor", "has_superglobal_var_call", "behavior_filterinput_exec",
    "behavior_arbitrary_upload_path", "behavior_file_manager",
)
BOOST_STRONG_TRAIN = BOOST_STRONG_SERVE + ("behavior_cookie_exec", "behavior_rawbody_backdoor")
BOOST_INTENT_TRAIN = (
    "intent_webshell_score", "intent_backdoor_score", "intent_c2_score", "intent_privilege_escalation",
    "overall_threat_score",
)
BOOSTS: dict[str, tuple[tuple[float, tuple[str, ...]], ...]] = {
    "serve": ((1.8, BOOST_CRITICAL), (1.4, BOOST_STRONG_SERVE)),
    "train": ((3.5, BOOST_CRITICAL), (2.5, BOOST_STRONG_TRAIN), (2.0, BOOST_INTENT_TRAIN)),
}

ANY_SHARED = ("behavior_reverse_shell", "behavior_rawbody_backdoor")
ANY_PHP = (
    "behavior_input_decode_exec", "behavior_password_backdoor", "behavior_upload_chmod",
    "behavior_cookie_hash_gate_dyn_call", "has_superglobal_var_call", "behavior_arbitrary_upload_path",
    "behavior_sqlmap_uploader", "behavior_filterinput_exec", "behavior_file_manager",
)
ANY_DOTNET = (
    "behavior_aspx_process_shell", "behavior_aspx_file_manager", "behavior_aspx_tunneling",
    "behavior_aspx_privilege_pipe", "behavior_jscript_webshell", "behavior_dotnet_memory_shell",
)
ANY_JAVA = ("behavior_jsp_memory_shell", "behavior_jsp_request_exec", "behavior_jsp_http_tunneling")
FIRM_PHP = (
    "behavior_input_decode_exec", "behavior_password_backdoor", "behavior_cookie_hash_gate_dyn_call",
    "has_superglobal_var_call",
)
FIRM_DOTNET = (
    "behavior_aspx_process_shell", "behavior_aspx_privilege_pipe", "behavior_aspx_tunneling",
    "behavior_jscript_webshell", "behavior_dotnet_memory_shell",
)
FIRM_JAVA = (
    "behavior_jsp_memory_shell", "behavior_jsp_request_exec", "behavior_jsp_hardcoded_backdoor",
    "behavior_jsp_http_backdoor",
)
EVIDENCE_STRONG = (
    "behavior_cookie_hash_gate_dyn_call", "behavior_aspx_process_shell", "behavior_aspx_privilege_pipe",
    "behavior_jsp_memory_shell", "behavior_jsp_request_exec", "behavior_jsp_hardcoded_backdoor",
    "behavior_jsp_http_backdoor", "behavior_jscript_webshell", "behavior_dotnet_memory_shell",
    "has_superglobal_var_call", "behavior_input_decode_exec", "behavior_password_backdoor",
)
EVIDENCE_MEDIUM = (
    "has_assign_input_then_call", "behavior_upload_chmod", "behavior_aspx_file_manager",
    "behavior_aspx_tunneling", "behavior_jsp_http_tunneling", "behavior_file_manager",
)
VOCABULARY = (
    "jquery", "angular", "react", "vue", "bootstrap", "lodash", "moment", "axios", "webpack", "babel",
    "/*!", "* @license", "@preserve", "copyright", "use strict", "define.amd", "exports.", "module.exports",
)
LARGE_FILE_BYTES = 100_000
CONFIDENCE_STEPS = (
    ("behavior_cookie_hash_gate_dyn_call", 0.20),
    ("has_superglobal_var_call", 0.15),
    ("behavior_password_backdoor", 0.15),
    ("behavior_input_decode_exec", 0.12),
    ("behavior_aspx_process_shell", 0.25),
    ("behavior_jscript_webshell", 0.35),
    ("behavior_dotnet_memory_shell", 0.35),
    ("behavior_aspx_privilege_pipe", 0.30),
    ("behavior_aspx_tunneling", 0.28),
    ("behavior_aspx_file_manager", 0.18),
    ("behavior_jsp_memory_shell", 0.35),
    ("behavior_jsp_request_exec", 0.28),
    ("behavior_jsp_http_tunneling", 0.25),
    ("behavior_jsp_hardcoded_backdoor", 0.40),
    ("behavior_jsp_http_backdoor", 0.35),
)
# End of the fixed values.


@dataclass(frozen=True)
class Thresholds:
    """A mode's working threshold and the lower edge of its suspicious band."""

    mode: str
    threshold: float

    @property
    def suspicious_from(self) -> float:
        return self.threshold * SUSPICIOUS_SHARE


def thresholds(
    mode: str = "hunting", blocking: float = BLOCKING_THRESHOLD, hunting: float = HUNTING_THRESHOLD
) -> Thresholds:
    if mode not in ("hunting", "blocking"):
        raise ValueError("mode is 'hunting' or 'blocking'")
    return Thresholds(mode, blocking if mode == "blocking" else min(hunting * HUNTING_FACTOR, HUNTING_CAP))


def effective_thresholds(fitted: DataFrame) -> DataFrame:
    """One row of fitted thresholds -> working threshold and band per mode."""
    both = F.array(
        F.struct(F.lit("blocking").alias("mode"), F.col("blocking_threshold").alias("threshold")),
        F.struct(
            F.lit("hunting").alias("mode"),
            F.least(F.col("hunting_threshold") * HUNTING_FACTOR, F.lit(HUNTING_CAP)).alias("threshold"),
        ),
    )
    return fitted.select(F.explode(both).alias("m")).select(
        "m.mode",
        "m.threshold",
        (F.col("m.threshold") * SUSPICIOUS_SHARE).alias("suspicious_lower"),
        F.col("m.threshold").alias("suspicious_upper"),
    )


def any_set(names: tuple[str, ...]) -> Column:
    return F.expr(" OR ".join(f"{n} > 0" for n in names))


def boost(features: DataFrame, profile: str) -> DataFrame:
    """Multiply the chosen features; serving and training use different factors."""
    return features.withColumns(
        {name: F.expr(f"{name} * {factor!r}D") for factor, names in BOOSTS[profile] for name in names}
    )


def align(df: DataFrame, names: tuple[str, ...] = FEATURES) -> list[Column]:
    """The frozen feature order; missing or text-valued columns count as 0."""
    kinds = dict(df.dtypes)
    return [
        F.expr(f"0D AS {n}" if kinds.get(n, "string") == "string" else f"coalesce(cast({n} AS double), 0D) AS {n}")
        for n in names
    ]


def missing_features(df: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Names the frozen order asks for and the relation lacks."""
    lacking = [(n,) for n in names if n not in df.columns]
    return df.sparkSession.createDataFrame(lacking, "feature string")


def by_family(java: Column, dotnet: Column, other: Column) -> Column:
    return (
        F.when(F.col("ext").isin(*JAVA_FAMILY), java).when(F.col("ext").isin(*DOTNET_FAMILY), dotnet).otherwise(other)
    )


def any_behaviour() -> Column:
    shared = any_set(ANY_SHARED)
    return by_family(any_set(ANY_JAVA) | shared, any_set(ANY_DOTNET) | shared, any_set(ANY_PHP) | shared)


def firm_behaviour() -> Column:
    return by_family(any_set(FIRM_JAVA), any_set(FIRM_DOTNET), any_set(FIRM_PHP))


def vocabulary_hits(code: str) -> Column:
    """How many of the front-end and licence words occur in the text named ``code``."""
    return F.expr(" + ".join(f"cast(contains(lower({code}), {sql_text(w)}) AS int)" for w in VOCABULARY))


def likely_framework(use_framework_name: bool = False) -> Column:
    """Ordered tests; the first that applies decides.

    By default a known framework name alone does not decide: a scan reports the
    name without using it.  ``use_framework_name`` adds that test in front.
    """
    binding_only = (
        F.col("ext").isin(*BINDING_FAMILY)
        & (F.col("aspx_databinding_eval_count") > 0)
        & (F.col("aspx_code_eval_count") == 0)
    )
    runs = (F.col("has_exec_function") > 0) & ~binding_only
    reads = F.col("has_input_access") > 0
    tests = F
    if use_framework_name:
        tests = tests.when(F.col("detected_framework") != "", ~any_behaviour())
    tests = tests.when(F.col("size") > LARGE_FILE_BYTES, ~firm_behaviour())
    tests = tests.when((F.col("entropy") > 4.5) & ~(runs & reads), True)
    tests = tests.when(F.col("string_literal_ratio") > 0.75, ~any_behaviour())
    tests = tests.when(F.col("benign_data_blob_score") > 0.8, True)
    return tests.when(F.col("vocabulary_hits") >= 3, True).otherwise(False)


def confidence() -> Column:
    """0.5 plus and minus evidence, in a fixed order of addition, held in 0..1."""
    steps: list[tuple[Column, float]] = [(F.col("is_framework"), -0.3)]
    steps += [(F.col(name) > 0, gain) for name, gain in CONFIDENCE_STEPS]
    blob, ratio = F.col("benign_data_blob_score"), F.col("string_literal_ratio")
    tagged = F.col("ext").isin(*DOTNET_FAMILY, *JAVA_FAMILY)
    steps += [
        (blob > 0.4, -0.25),
        (blob > 0.7, -0.20),
        (tagged & (ratio > 0.85), -0.15),
        (~tagged & (ratio > 0.7), -0.20),
        (F.col("overall_threat_score") < 0.2, -0.15),
    ]
    value = reduce(lambda acc, s: acc + F.when(s[0], F.lit(s[1])).otherwise(F.lit(0.0)), steps, F.lit(0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def strong_evidence() -> Column:
    return any_set(EVIDENCE_STRONG)


def medium_evidence() -> Column:
    reads = F.col("has_input_access") > 0
    return any_set(EVIDENCE_MEDIUM) | (reads & ((F.col("has_exec_function") > 0) | (F.col("has_decode_function") > 0)))


def verdict(limits: Thresholds) -> Column:
    """The decision tree, then the hunting mode's downgrade."""
    t = limits.threshold
    prob, threat, blob = F.col("prob"), F.col("overall_threat_score"), F.col("benign_data_blob_score")
    sure, strong, medium = F.col("confidence"), F.col("strong_evidence"), F.col("medium_evidence")
    clean, suspicious, webshell = F.lit("CLEAN"), F.lit("SUSPICIOUS"), F.lit("WEBSHELL")
    unless_harmless = F.when(threat < 0.2, clean).otherwise(suspicious)

    specific = (
        F.when(prob >= t * 0.4, webshell)
        .when(prob >= t * 0.2, suspicious)
        .otherwise(F.when(sure > 0.3, suspicious).otherwise(clean))
    )
    framework = (
        F.when(
            strong, F.when(prob >= t * 1.2, webshell).when(prob >= t * 0.8, suspicious).otherwise(clean)
        )
        .when(medium, F.when(prob >= t * 1.5, suspicious).otherwise(clean))
        .when(prob >= t * 2.5, unless_harmless)
        .otherwise(clean)
    )
    front_end = (
        F.when(strong & (prob >= t * 2.0), webshell)
        .when(strong & (prob >= t * 1.5), suspicious)
        .when(medium & (prob >= t * 2.2), suspicious)
        .when(prob >= t * 2.5, unless_harmless)
        .otherwise(clean)
    )
    other = (
        F.when(
            strong | medium, F.when(prob >= t * 0.6, webshell).when(prob >= t * 0.4, suspicious).otherwise(clean)
        )
        .when(prob >= t * 1.8, F.when((blob > 0.5) | (threat < 0.3), suspicious).otherwise(webshell))
        .when(
            prob >= t * 1.3, F.when(threat > 0.3, webshell).when(blob < 0.4, suspicious).otherwise(clean)
        )
        .when(
            prob >= limits.suspicious_from,
            F.when((threat > 0.35) & (sure > 0.4), suspicious).otherwise(clean),
        )
        .otherwise(clean)
    )
    first = (
        F.when(any_set(("behavior_jscript_webshell", "behavior_dotnet_memory_shell")), specific)
        .when(F.col("is_framework"), framework)
        .when((blob > 0.6) & (threat < 0.3), clean)
        .when(F.col("ext").isin(".js", ".css"), front_end)
        .otherwise(other)
    )
    if limits.mode != "hunting":
        return first
    doubtful = (sure < 0.35) | F.col("is_framework") | (blob > 0.5)
    return F.when((first == webshell) & doubtful, suspicious).otherwise(first)


def ensemble(tree: Column, ngram: Column | None) -> Column:
    """Three parts tree, one part n-gram; a failed n-gram score counts as 0."""
    if ngram is None:
        return tree
    return TREE_SHARE * tree + NGRAM_SHARE * F.coalesce(ngram, F.lit(0.0))


def judge(df: DataFrame, limits: Thresholds, use_framework_name: bool = False) -> DataFrame:
    """``features + ext, size, vocabulary_hits, prob`` -> adds framework test, confidence, evidence, verdict."""
    df = df.withColumn("is_framework", likely_framework(use_framework_name))
    df = df.withColumns(
        {"confidence": confidence(), "strong_evidence": strong_evidence(), "medium_evidence": medium_evidence()}
    )
    return df.withColumn("verdict", verdict(limits))
