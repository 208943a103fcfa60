"""The feature table: one row of 167 features per file.

All work is per row: no stage shuffles, so the job scales with the input
splits.  Each stage is its own projection; a later stage reads the earlier
stage's columns instead of repeating its text work, and column pruning drops
every regex whose feature a query does not ask for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from vigilrow.functions import comment_runs as R
from vigilrow.functions import patterns as P
from vigilrow.functions import text as T
from vigilrow.functions.columns import FEATURES, REAL_VALUED, TEMPLATE_SUFFIXES
from vigilrow.functions.cookie_gate import has_cookie_gate
from vigilrow.functions.match import (
    CALL_NEEDS, WordFinder, flag, fold, gaps, hits, literal_count, may_match, may_match_sql, plain_regex, sql_text,
)
from vigilrow.functions.password_gate import has_password_gate
from vigilrow.functions.python_columns import with_python_columns
from vigilrow.functions.shape import SHAPE_TYPE, _measure as measure_shape

MIN_CHARS = 20
LEAST_BASE64 = 80  # characters of the shortest ``LONG_BASE64``

# Matched by places, not by their patterns.
PASSWORD, COOKIE = "behavior_password_backdoor", "behavior_cookie_hash_gate_dyn_call"
# Flags whose pattern steps over comments, and their field in ``runs``.
OVER_COMMENTS = {"has_assign_input_then_exec": "assign_exec", "behavior_filterinput_exec": "filter_exec"}


def has_long_word(folded: str) -> bool:
    """False only for texts without ``LONG_BASE64``, which holds no white space."""
    return any(len(word) >= LEAST_BASE64 for word in folded.split())


def total(names: tuple[str, ...]) -> Column:
    """How many of the flag columns are set."""
    return F.expr(" + ".join(f"cast({n} AS int)" for n in names))


def weighted(terms: dict[str, float]) -> Column:
    """Sum of columns, each times its weight, added in order."""
    return F.expr(" + ".join(f"cast({c} AS double) * {w!r}D" for c, w in terms.items()))


def path_ends(suffixes: tuple[str, ...]) -> Column:
    return F.expr(" OR ".join(f"endswith(lower(path), {sql_text(s)})" for s in suffixes))


def suffix_of(path: Column) -> Column:
    """Last suffix with its dot, lower case; none for names that start with their only dot."""
    name = F.substring_index(path, "/", -1)
    found = F.regexp_extract(name, r"(?s)[^.].*(\.[^.]*)\z", 1)
    return F.lower(found)


# --- text ------------------------------------------------------------------


def with_decoded_text(files: DataFrame) -> DataFrame:
    """Adds ``norm``: escapes decoded, all unicode escapes first, then all hex escapes."""
    return files.withColumn("norm", T.decode_unicode_escapes(F.col("code"))).withColumn(
        "norm", T.decode_hex_escapes(F.col("norm"))
    )


def with_stripped_text(files: DataFrame) -> DataFrame:
    """Adds ``stripped`` (no comments, no string literals) and ``string_literal_ratio``."""
    df = files.withColumn("stripped", T.blank_blocks(F.col("code"), "<%--", "--%>"))
    df = df.withColumn("stripped", T.blank_blocks(F.col("stripped"), "/*", "*/"))
    df = df.withColumn("stripped", T.blank_line_comments(F.col("stripped"), "//"))
    df = df.withColumn("stripped", T.blank_line_comments(F.col("stripped"), "#"))
    blanked, held = T.blank_strings(F.col("stripped"), T.VERBATIM_STRING, '@"')
    df = df.withColumns({"stripped": blanked, "held_verbatim": held})
    blanked, held = T.blank_strings(F.col("stripped"), T.QUOTED_STRING, "")
    df = df.withColumns({"stripped": blanked, "held_quoted": held})
    ratio = (F.col("held_verbatim") + F.col("held_quoted")) / F.greatest(F.length("code"), F.lit(1))
    return df.withColumn("string_literal_ratio", ratio).drop("held_verbatim", "held_quoted")


# --- counts, positions, flags ----------------------------------------------


def with_searchable_text(df: DataFrame) -> DataFrame:
    """Adds ``words`` and ``code_words`` for pre-tests, and takes texts with very long comment runs aside.

    The words are those that some pre-test asks for, of the decoded and of the given text, found in one pass
    over each: some hundred searches a text cost more than all else.  For texts with long runs ``norm_calls`` is empty and ``runs`` holds what the patterns that
    step over comments would find; for all others ``runs`` is null.

    Python sees each text once: where ``stripped`` is there, ``shape`` is
    measured in the same pass, and ``stripped`` ends here.
    """
    df = df.withColumn("folded", fold(F.col("norm")))
    adjacent = F.regexp_count("norm", F.lit(plain_regex(R.ADJACENT, "")))
    df = df.withColumn("long_runs", F.contains("norm", F.lit("*/")) & (adjacent >= R.MOST_ADJACENT))
    df = df.withColumns(
        {
            "runs_in": F.when(F.col("long_runs"), F.col("norm")),
            "password_in": F.when(may_match("folded", P.BY_COLUMN[PASSWORD].need), F.col("norm")),
            "cookie_in": F.when(may_match("folded", P.BY_COLUMN[COOKIE].need), F.col("norm")),
            "code_in": F.when(F.col("norm") != F.col("code"), fold(F.col("code"))),
            # Most texts have no escapes: the decoded text travels only where it differs.
            "norm": F.nullif("norm", "code"),
        }
    )
    numbers = ST.ArrayType(ST.ShortType())
    rules = {
        "words": (numbers, WordFinder(), ("folded",)),
        "code_words": (numbers, WordFinder(), ("code_in",)),
        "long_word": (ST.BooleanType(), has_long_word, ("folded",)),
        "runs": (R.RUNS_TYPE, R.measure, ("runs_in",)),
        "password_gate": (ST.BooleanType(), has_password_gate, ("password_in",)),
        "cookie_gate": (ST.BooleanType(), has_cookie_gate, ("cookie_in",)),
    }
    if "stripped" in df.columns:
        rules["shape"] = (SHAPE_TYPE, measure_shape, ("code", "stripped"))
    df = with_python_columns(df, rules, drop=("folded", "code_in", "runs_in", "password_in", "cookie_in", "stripped"))
    df = df.withColumn("norm", F.coalesce("norm", "code"))
    return df.withColumns(
        {
            "code_words": F.coalesce("code_words", "words"),
            "norm_calls": F.when(F.col("long_runs"), F.lit("")).otherwise(F.col("norm")),
        }
    )


def with_match_counts(df: DataFrame) -> DataFrame:
    """Call and input counts, first and last positions, template-eval disambiguation."""
    norm, calls = F.col("norm"), F.col("norm_calls")
    has_paren = F.contains(norm, F.lit("("))
    exec_may, decode_may, dynamic_may = (may_match("words", (CALL_NEEDS[k],)) & has_paren for k in ("exec", "decode", "dynamic"))
    input_may = may_match("words", (CALL_NEEDS["input"],))

    def count(text: Column, regex: str, may: Column) -> Column:
        return F.when(may, F.regexp_count(text, F.lit(plain_regex(regex)))).otherwise(0).cast("int")

    is_template = path_ends(TEMPLATE_SUFFIXES)
    df = df.withColumns(
        {
            "exec_hits": hits(calls, P.EXEC_CALL, exec_may),
            "exec_gaps": gaps(calls, P.EXEC_CALL, exec_may),
            "input_hits": hits(calls, P.INPUT_ACCESS, input_may),
            "input_gaps": gaps(calls, P.INPUT_ACCESS, input_may),
            "decode_func_count": F.coalesce("runs.decode_count", count(calls, P.DECODE_CALL, decode_may)),
            "dynamic_count": F.coalesce("runs.dynamic_count", count(calls, P.DYNAMIC_CALL, dynamic_may)),
            "aspx_databinding_eval_count": count(
                F.col("code"), P.BINDING_EVAL_TAG, is_template & F.contains("code", F.lit("<%"))
            ),
            "aspx_code_eval_count": count(norm, P.CODE_EVAL_CALL, is_template & may_match("words", ("eval",))),
            "is_template": is_template,
        }
    )
    drop_eval = F.col("is_template") & (F.col("aspx_code_eval_count") == 0)
    df = df.withColumn(
        "exec_keep",
        F.coalesce(
            F.transform("runs.exec_eval", lambda has_eval: ~(drop_eval & has_eval)),
            F.transform("exec_hits", lambda m: ~(drop_eval & F.contains(F.lower(m), F.lit("eval")))),
        ),
    )
    df = df.withColumns(
        {
            "exec_func_count": F.size(F.filter("exec_keep", lambda k: k)),
            "input_count": F.coalesce(F.array_size("runs.input_at"), F.size("input_hits")),
            "exec_first": F.array_position("exec_keep", F.lit(True)).cast("int"),
            "exec_last": (
                F.size("exec_keep") + 1 - F.array_position(F.reverse(F.col("exec_keep")), F.lit(True))
            ).cast("int"),
        }
    )

    def start(kind: str, index: Column) -> Column:
        """Where the index-th hit (from 1) starts, in code points."""
        before = F.array_join(F.slice(f"{kind}_gaps", F.lit(1), index), "")
        earlier = F.array_join(F.slice(f"{kind}_hits", F.lit(1), index - 1), "")
        return F.coalesce(F.get(f"runs.{kind}_at", index - 1), F.length(before) + F.length(earlier))

    both = (F.col("exec_func_count") > 0) & (F.col("input_count") > 0)
    df = df.withColumns(
        {
            "exec_from": F.when(both, start("exec", F.col("exec_first"))),
            "exec_to": F.when(both, start("exec", F.col("exec_last"))),
            "input_from": F.when(both, start("input", F.lit(1))),
            "input_to": F.when(both, start("input", F.col("input_count"))),
        }
    )
    size = F.greatest(F.length("code"), F.lit(1))
    return df.withColumns(
        {
            "has_exec_function": F.col("exec_func_count") > 0,
            "has_decode_function": F.col("decode_func_count") > 0,
            "has_input_access": F.col("input_count") > 0,
            "has_dynamic_exec": F.col("dynamic_count") > 0,
            "input_exec_distance": F.coalesce(
                F.least(F.abs(F.col("exec_from") - F.col("input_from")) / size, F.lit(1.0)), F.lit(1.0)
            ),
            "short_input_exec_distance": F.coalesce(
                F.greatest("exec_to", "input_to") - F.least("exec_from", "input_from") < 300, F.lit(False)
            ),
        }
    ).drop(
        "exec_hits", "exec_gaps", "input_hits", "input_gaps", "exec_keep", "exec_first", "exec_last",
        "exec_from", "exec_to", "input_from", "input_to", "is_template",
    )


def framework_name(sample: str, folded: str) -> Column:
    """First framework, in priority order, whose fingerprint occurs; '' if none."""
    tests = " ".join(
        f"WHEN {may_match_sql(folded, P.FRAMEWORK_NEEDS[name])} "
        f"AND rlike({sample}, {sql_text(plain_regex(regex))}) THEN {sql_text(name)}"
        for name, regex in P.FRAMEWORKS
    )
    return F.expr(f"CASE {tests} ELSE '' END")


def with_framework(df: DataFrame, sample_chars: int | None = None) -> DataFrame:
    """Adds the framework found in the whole text, or in its head where a limit is given."""
    df = df.withColumn("sample", T.head_of(F.col("code"), sample_chars))
    df = df.withColumn("sample_folded", fold(F.col("sample")))
    known = sample_chars is None and "code_words" in df.columns
    df = df.withColumn("detected_framework", framework_name("sample", "code_words" if known else "sample_folded"))
    return df.withColumn("is_known_framework", F.col("detected_framework") != "").drop("sample", "sample_folded")


def with_signature_flags(df: DataFrame) -> DataFrame:
    """One boolean per signature, plus the two counted ones."""
    def one(s: P.Signature) -> Column:
        if s.column in OVER_COMMENTS:
            return F.coalesce(F.col(f"runs.{OVER_COMMENTS[s.column]}"), flag(s, "norm_calls", "words"))
        if s.column == PASSWORD:
            return F.coalesce(F.col("password_gate"), F.lit(False))
        if s.column == COOKIE:
            return F.coalesce(F.col("cookie_gate"), F.lit(False))
        return flag(s, "code", "code") if s.scope == "raw" else flag(s, "norm", "words")

    df = df.withColumns({s.column: one(s) for s in P.SIGNATURES})
    df = df.withColumns(
        {
            "long_base64_count": F.when(F.col("long_word"), F.regexp_count("norm", F.lit(P.LONG_BASE64))).otherwise(0).cast("int"),
            "deep_array_access_count": F.when(
                F.contains(F.col("norm"), F.lit("$")) & F.contains(F.col("norm"), F.lit("][")),
                # Nothing follows the repeated subscript, so it need never be given back.
                F.regexp_count("norm", F.lit(plain_regex(P.DEEP_SUBSCRIPT, "") + "+")),
            ).otherwise(0).cast("int"),
        }
    )
    return df.withColumns(
        {
            "has_long_base64": F.col("long_base64_count") > 0,
            "has_deep_array_access": F.col("deep_array_access_count") > 0,
            "has_java_runtime_exec": F.col("has_jsp_runtime_exec"),
            "has_java_reflection": F.col("has_jsp_reflection"),
        }
    ).drop("words", "code_words", "long_word", "norm_calls", "runs", "long_runs", "password_gate", "cookie_gate")


def with_blob_flags(df: DataFrame) -> DataFrame:
    """Signs of harmless bulk data: drawings, serialised values, language tables."""
    code, size = F.col("code"), F.length("code")
    lower = F.lower(code)
    quiet = ~(F.col("has_exec_function") | F.col("has_decode_function") | F.col("has_dynamic_exec"))
    svg = (
        (size > 400)
        & F.contains(lower, F.lit("<svg"))
        & code.rlike(plain_regex(r"<svg\b"))
        & ((literal_count(lower, "<path") >= 2) | (literal_count(lower, 'd="') >= 3))
    )
    # A token holds two colons.
    serialized = (size > 600) & (literal_count(code, ":") >= 50) & (F.regexp_count(code, F.lit(plain_regex(P.SERIALIZED_TOKEN))) >= 25)
    table = (size > 5000) & quiet & (literal_count(code, "=>") >= 200)
    df = df.withColumns({"has_svg_blob": svg, "has_serialized_blob": serialized, "has_large_lang_array": table})
    score = weighted({"has_svg_blob": 0.45, "has_serialized_blob": 0.45, "has_large_lang_array": 0.35})
    return df.withColumn("benign_data_blob_score", F.least(F.lit(1.0), score))


# --- shape statistics ------------------------------------------------------


def with_shape(df: DataFrame) -> DataFrame:
    """Entropy, character shares, line length, densities."""
    size, lines = F.col("shape.chars"), F.col("shape.lines")
    return df.withColumns(
        {
            "entropy": F.col("shape.entropy"),
            "entropy_nostrings": F.col("shape.stripped_entropy"),
            "special_char_ratio_nostrings": F.col("shape.stripped_symbols")
            / F.greatest(F.col("shape.stripped_chars"), F.lit(1)),
            "avg_line_length": size / lines,
            "log_code_size": F.log1p(size),
            "digit_ratio": F.col("shape.digits") / size,
            "special_char_ratio": F.col("shape.symbols") / size,
            "whitespace_ratio": F.col("shape.spaces") / size,
            "input_density": F.col("input_count") / lines,
            "exec_density": F.col("exec_func_count") / lines,
            "decode_density": F.col("decode_func_count") / lines,
            "dynamic_exec_density": F.col("dynamic_count") / lines,
        }
    ).drop("shape")


# --- composite behaviours and scores ---------------------------------------


def with_behaviours(df: DataFrame) -> DataFrame:
    """Behaviours that combine several flags."""
    c = F.col
    df = df.withColumns(
        {
            "behavior_form_file_upload_loose": c("has_form_file_upload_loose") & c("has_file_write_ops"),
            "behavior_aspx_privilege_pipe": c("has_aspx_named_pipe") & c("has_aspx_privilege_esc"),
            "behavior_aspx_process_shell": c("has_aspx_exec") & c("aspx_request_input") & c("aspx_process_pipe"),
            "behavior_jsp_memory_shell": c("has_jsp_classloader")
            & (c("has_jsp_base64_classload") | c("has_jsp_custom_classloader")),
            "has_jsp_compiled_backdoor": c("has_jsp_compiled_class")
            & c("has_jsp_runtime_exec_command")
            & c("has_jsp_hardcoded_command"),
            "behavior_jsp_hardcoded_backdoor": (
                c("has_jsp_compiled_class")
                & (c("has_jsp_hardcoded_command") | c("has_jsp_suspicious_url_pattern"))
            )
            | (c("has_jsp_runtime_exec") & (c("has_hardcoded_backdoor_cmd") | c("has_hardcoded_c2")))
            | c("has_jsp_exec_hardcoded_cmd"),
            "behavior_jsp_http_backdoor": c("has_jsp_http_client")
            & (c("has_hardcoded_c2") | c("has_jsp_http_external_suspicious")),
            "behavior_jscript_webshell": c("has_jscript_directive")
            & c("has_input_access")
            & (c("has_jscript_eval_encoded") | c("has_exec_function")),
            "behavior_assign_input_then_exec": c("has_assign_input_then_exec"),
            "behavior_exec_comment_split": c("has_exec_comment_split"),
            # No text pattern feeds the tunnelling score: it is zero by definition.
            "aspx_tunneling_score": F.lit(0.0),
            "behavior_aspx_tunneling": F.lit(False),
            "dotnet_memory_shell_score": weighted(
                {
                    "has_dotnet_frombase64": 1.0,
                    "has_dotnet_aes_decrypt": 2.0,
                    "has_dotnet_assembly_load": 2.5,
                    "has_dotnet_memorystream": 0.5,
                    "has_dotnet_session_cache": 1.0,
                    "has_dotnet_createinstance": 1.5,
                }
            ),
        }
    )
    return df.withColumn(
        "behavior_dotnet_memory_shell",
        (c("dotnet_memory_shell_score") >= 5.0)
        & (c("has_dotnet_webservice") | path_ends((".asmx",))),
    )


# ---------------------------------------------------------------------------
# Score weights and the signature groups.
# ---------------------------------------------------------------------------
WEBSHELL_WEIGHTS = {
    "behavior_input_decode_exec": 3.0,
    "behavior_password_backdoor": 2.0,
    "behavior_cookie_exec": 2.0,
    "behavior_cookie_hash_gate_dyn_call": 2.5,
    "behavior_aspx_process_shell": 2.5,
    "behavior_jsp_memory_shell": 3.0,
    "behavior_jsp_request_exec": 2.5,
    "behavior_jsp_hardcoded_backdoor": 3.5,
    "behavior_jsp_http_backdoor": 3.0,
    "behavior_jscript_webshell": 3.5,
    "behavior_dotnet_memory_shell": 3.5,
    "behavior_obfuscated_exec": 1.5,
    "behavior_rawbody_backdoor": 1.5,
    "behavior_file_manager": 2.0,
    "behavior_upload_chmod": 2.0,
    "behavior_aspx_file_manager": 2.0,
    "short_input_exec_distance": 1.0,
    "exec_path_regex": 2.5,
    "has_assign_input_then_call": 1.0,
}
BACKDOOR_WEIGHTS = {
    "behavior_password_backdoor": 2.0,
    "behavior_sql_backdoor": 2.0,
    "has_md5_cookie_check": 1.5,
    "behavior_cookie_exec": 1.0,
}
C2_WEIGHTS = {
    "behavior_reverse_shell": 2.5,
    "behavior_data_exfiltration": 2.0,
    "behavior_aspx_tunneling": 3.0,
    "behavior_jsp_http_tunneling": 2.5,
}
DROPPER_WEIGHTS = {"has_file_write_ops": 2.0, "has_long_base64": 1.5, "behavior_obfuscated_exec": 1.0}
PRIVILEGE_WEIGHTS = {
    "behavior_aspx_privilege_pipe": 3.0,
    "has_aspx_winapi": 2.0,
    "has_aspx_privilege_esc": 2.5,
}
THREAT_WEIGHTS = {
    "intent_webshell_score": 3.0,
    "intent_backdoor_score": 2.5,
    "intent_c2_score": 2.0,
    "intent_dropper_score": 1.5,
    "intent_privilege_escalation": 2.0,
    "stealth_score_enhanced": 1.0,
    "exec_path_regex": 1.0,
}
STEALTH_FLAGS = (
    "behavior_obfuscated_exec", "has_decode_chain", "has_string_index_obfusc", "has_alphabet_builder",
    "has_variable_function_call", "has_superglobal_var_call", "has_assign_input_then_call",
    "has_reflection", "has_comment_obfusc", "has_bitwise_chr",
)
CRITICAL_FLAGS = (
    "behavior_input_decode_exec", "behavior_password_backdoor", "behavior_upload_chmod",
    "has_assign_input_then_call", "behavior_aspx_process_shell", "behavior_aspx_privilege_pipe",
    "behavior_aspx_file_manager", "behavior_jsp_memory_shell", "behavior_jsp_request_exec",
    "behavior_jsp_hardcoded_backdoor", "behavior_jsp_http_backdoor", "behavior_jscript_webshell",
    "behavior_dotnet_memory_shell",
)
STRONG_FLAGS = (
    "behavior_cookie_hash_gate_dyn_call", "behavior_aspx_tunneling", "behavior_jsp_http_tunneling",
    "has_superglobal_var_call", "behavior_filterinput_exec", "behavior_arbitrary_upload_path",
    "behavior_cookie_exec", "behavior_rawbody_backdoor", "behavior_file_manager",
)
ASPX_FLAGS = (
    "behavior_aspx_process_shell", "behavior_aspx_privilege_pipe", "behavior_aspx_file_manager",
    "behavior_aspx_tunneling", "behavior_jscript_webshell", "behavior_dotnet_memory_shell",
)
JSP_FLAGS = (
    "behavior_jsp_memory_shell", "behavior_jsp_request_exec", "behavior_jsp_http_tunneling",
    "behavior_jsp_hardcoded_backdoor", "behavior_jsp_http_backdoor",
)
# End of the fixed values.


def with_scores(df: DataFrame) -> DataFrame:
    """Intent, stealth and threat scores, execution paths, signature totals."""
    c = F.col
    reads, runs, decodes = c("has_input_access"), c("has_exec_function"), c("has_decode_function")
    hidden_call = c("hidden_call")
    df = df.withColumns(
        {
            "exec_path_regex": reads & c("has_regex_exec"),
            "hidden_call": c("has_variable_function_call")
            | c("has_superglobal_var_call")
            | c("has_assign_input_then_call"),
        }
    )
    df = df.withColumns(
        {
            "intent_webshell_score": weighted(WEBSHELL_WEIGHTS) / 44.5,
            "intent_backdoor_score": weighted(BACKDOOR_WEIGHTS) / 6.5,
            "intent_c2_score": (
                weighted(C2_WEIGHTS) + (c("has_fsockopen") | c("has_socket_create")).cast("double")
            )
            / 11.0,
            "intent_dropper_score": weighted(DROPPER_WEIGHTS) / 4.5,
            "intent_privilege_escalation": weighted(PRIVILEGE_WEIGHTS) / 7.5,
            "stealth_technique_count": total(STEALTH_FLAGS),
            "exec_path_direct": reads
            & runs
            & (c("input_exec_distance") < 0.2)
            & ~c("behavior_obfuscated_exec")
            & ~decodes,
            "exec_path_decoded": reads
            & decodes
            & runs
            & (c("behavior_input_decode_exec") | c("has_decode_chain")),
            "exec_path_hidden": reads & (hidden_call | c("has_reflection") | c("has_invoke_pattern")),
            "exec_path_indirect": reads & c("has_dynamic_exec"),
            "data_flow_complexity": F.when(
                reads,
                total(
                    ("has_exec_function", "has_decode_function", "has_dynamic_exec", "hidden_call", "has_reflection")
                ),
            ).otherwise(0),
            "critical_signature_score": total(CRITICAL_FLAGS).cast("double"),
            "strong_signature_score": total(STRONG_FLAGS).cast("double"),
            "aspx_signature_score": total(ASPX_FLAGS).cast("double"),
            "jsp_signature_score": total(JSP_FLAGS).cast("double"),
        }
    )
    df = df.withColumn("stealth_score_enhanced", c("stealth_technique_count") / 10.0)
    df = df.withColumn("overall_threat_score", weighted(THREAT_WEIGHTS) / 13.0)
    critical, strong = c("critical_signature_score"), c("strong_signature_score")
    return df.withColumns(
        {
            "has_any_critical_signature": critical > 0,
            "has_any_strong_signature": strong > 0,
            "has_multiple_signatures": critical + strong >= 2,
            "total_weighted_signature_score": critical * 3.0 + strong * 2.0 + c("overall_threat_score") * 1.5,
        }
    )


def clean_number(name: str) -> Column:
    """A number column in which missing, NaN and infinite values are 0."""
    bad = f"{name} IS NULL OR isnan({name}) OR abs({name}) = double('Infinity')"
    return F.expr(f"CASE WHEN {bad} THEN 0D ELSE cast({name} AS double) END AS {name}")


def long_enough(files: DataFrame) -> DataFrame:
    """Files with a text of at least 20 characters."""
    return files.where(F.length("code") >= MIN_CHARS)


def feature_table(
    files: DataFrame, keep: tuple[str, ...] = ("file_id",), drop_short: bool = True
) -> DataFrame:
    """``files(path, code, ..)`` -> ``keep`` + 167 features + ``detected_framework``.

    With ``drop_short=False`` every row stays; a null ``code`` costs nothing
    and its features are not meaningful.
    """
    df = with_stripped_text(with_decoded_text(long_enough(files) if drop_short else files))
    df = with_searchable_text(df)
    df = with_framework(with_match_counts(df))
    df = with_blob_flags(with_signature_flags(df))
    df = with_scores(with_behaviours(with_shape(df)))
    columns = [
        clean_number(f) if f in REAL_VALUED else F.expr(f"cast({f} AS int) AS {f}") for f in FEATURES
    ]
    return df.select(*keep, *columns, "detected_framework")
