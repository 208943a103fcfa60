"""Shared SQL building blocks: the same relations, written for DuckDB."""

from __future__ import annotations

from vigilrow.functions import patterns as P
from vigilrow.functions.columns import FEATURES, REAL_VALUED
from vigilrow.sources.corpus import CASES, STEMS, WHOLE_ROW_SHORT


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(regex: str | tuple[str, ...], flags: str = "i") -> str:
    """A SQL string literal holding the pattern in RE2 form."""
    body = ".*?".join(regex) if isinstance(regex, tuple) else regex
    mode = ("i" if "i" in flags else "") + ("s" if "s" in flags else "-s")
    return quote(f"(?{mode})" + body)


def with_clause(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def corpus_cte() -> str:
    exts = ", ".join(quote(e) for e, _ in CASES)
    fragments = ", ".join(quote(c) for _, c in CASES)
    stems = ", ".join(quote(s) for s in STEMS)
    return f"""corpus AS (
  SELECT file_id, '/srv/' || source || '/' || file_id || '/' || stem || ext AS path, ext,
         strlen(code)::BIGINT AS size, code, source, lang
  FROM (
    SELECT doc_id AS file_id, source, lang,
           ([{exts}])[1 + doc_id % {len(CASES)}] AS ext,
           ([{stems}])[1 + (doc_id // 7) % {len(STEMS)}] AS stem,
           CASE WHEN doc_id % {len(CASES)} = {WHOLE_ROW_SHORT} THEN '' ELSE chr(10) || text END AS rest,
           ([{fragments}])[1 + doc_id % {len(CASES)}] || rest AS code
    FROM documents))"""


def decoded_ctes(source: str = "corpus") -> list[str]:
    def step(col: str, marker: str, digits: int) -> str:
        pattern = quote(rf"\\{marker}[0-9a-fA-F]{{{digits}}}")
        return (
            f"array_to_string(list_transform(list_zip(string_split_regex({col}, {pattern}), "
            f"list_append(list_transform(regexp_extract_all({col}, {pattern}), "
            f"lambda m: chr(CAST('0x' || substr(m, 3) AS INTEGER))), '')), lambda z: z[1] || z[2]), '')"
        )

    return [
        f"decoded_u AS (SELECT *, {step('code', 'u', 4)} AS norm_u FROM {source})",
        f"decoded AS (SELECT *, {step('norm_u', 'x', 2)} AS norm FROM decoded_u)",
    ]


VERBATIM = quote(r'(?s)@"(?:[^"]|"")*"')
QUOTED = quote(r"""(?s)"(?:\\\\.|[^"\\])*"|'(?:\\\\.|[^'\\])*'""")


def stripped_ctes(source: str) -> list[str]:
    held = "coalesce(list_sum(list_transform(regexp_extract_all({0}, {1}), lambda m: length(m))), 0)"
    return [
        f"""cut_comments AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(code,
      '(?s)<%--.*?--%>', ' ', 'g'), '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\\n]*', ' ', 'g'), '#[^\\n]*', ' ', 'g')
      AS s4 FROM {source})""",
        f"cut_verbatim AS (SELECT *, {held.format('s4', VERBATIM)} AS held_a, "
        f"regexp_replace(s4, {VERBATIM}, ' ', 'g') AS s5 FROM cut_comments)",
        f"cut_strings AS (SELECT *, {held.format('s5', QUOTED)} AS held_b, "
        f"regexp_replace(s5, {QUOTED}, ' ', 'g') AS stripped FROM cut_verbatim)",
        "plain AS (SELECT *, (held_a + held_b) / greatest(length(code), 1)::DOUBLE AS string_literal_ratio "
        "FROM cut_strings)",
    ]


EXEC_RE2 = P.EXEC_CALL.removeprefix(r"(?<!<%[#=]\s)")


def match_ctes(source: str) -> list[str]:
    """Counts and positions.  RE2 has no look-behind: guarded names get a '!' first."""
    pieces = "length(array_to_string({0}_gaps[1:{1}], '')) + length(array_to_string({0}_hits[1:{1} - 1], ''))"
    return [
        f"""guarded AS (SELECT *,
      regexp_replace(norm, {quote(r'(<%[#=]\s)\w')}, '\\1!', 'g') AS exec_text,
      regexp_matches(lower(path), '\\.(aspx|ascx|asax|ashx|asmx)$') AS is_template
      FROM {source})""",
        f"""found AS (SELECT *,
      regexp_extract_all(exec_text, {re2(EXEC_RE2)}) AS exec_hits,
      string_split_regex(exec_text, {re2(EXEC_RE2)}) AS exec_gaps,
      regexp_extract_all(norm, {re2(P.INPUT_ACCESS)}) AS input_hits,
      string_split_regex(norm, {re2(P.INPUT_ACCESS)}) AS input_gaps,
      len(regexp_extract_all(norm, {re2(P.DECODE_CALL)})) AS decode_func_count,
      len(regexp_extract_all(norm, {re2(P.DYNAMIC_CALL)})) AS dynamic_count,
      CASE WHEN is_template THEN len(regexp_extract_all(code, {re2(P.BINDING_EVAL_TAG)})) ELSE 0 END
        AS aspx_databinding_eval_count,
      CASE WHEN is_template THEN len(regexp_extract_all(exec_text, {quote(r'(?i)\beval\s*\(')})) ELSE 0 END
        AS aspx_code_eval_count
      FROM guarded)""",
        """kept AS (SELECT *, list_filter(range(1, len(exec_hits) + 1), lambda i:
      NOT (is_template AND aspx_code_eval_count = 0 AND contains(lower(exec_hits[i]), 'eval'))) AS exec_ids,
      range(1, len(input_hits) + 1) AS input_ids FROM found)""",
        f"""placed AS (SELECT *,
      list_transform(exec_ids, lambda i: {pieces.format('exec', 'i')}) AS exec_at,
      list_transform(input_ids, lambda i: {pieces.format('input', 'i')}) AS input_at FROM kept)""",
        """counted AS (SELECT *, len(exec_ids) AS exec_func_count, len(input_hits) AS input_count,
      CASE WHEN len(exec_ids) > 0 AND len(input_hits) > 0
        THEN least(abs(exec_at[1] - input_at[1]) / greatest(length(code), 1)::DOUBLE, 1.0) ELSE 1.0 END
        AS input_exec_distance,
      (len(exec_ids) > 0 AND len(input_hits) > 0 AND
        list_max(list_concat(exec_at, input_at)) - list_min(list_concat(exec_at, input_at)) < 300)
        AS short_input_exec_distance FROM placed)""",
    ]


def framework_case(column: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({column}, {re2(rx)}) THEN {quote(name)}" for name, rx in P.FRAMEWORKS)
    return f"CASE {whens} ELSE '' END"


def _assign_then(head: str, tail_before: str, tail_after: str) -> str:
    """A name assigned from input, then used: the name is cut out of each
    assignment and put into the pattern for the text behind it."""
    return (
        f"len(list_filter(range(1, len(regexp_extract_all(norm, {head})) + 1), lambda i: "
        f"regexp_matches(array_to_string(list_transform(list_zip("
        f"string_split_regex(norm, {head})[i + 1:], "
        f"list_append(regexp_extract_all(norm, {head})[i + 1:], '')), lambda z: z[1] || z[2]), ''), "
        f"{tail_before} || regexp_extract_all(norm, {head}, 1)[i] || {tail_after}))) > 0"
    )


SPECIAL = {
    "has_jsp_http_external_suspicious": (
        "len(list_filter(regexp_extract_all(norm, "
        + quote(r'(?i-s)(?:HttpGet|HttpPost|URL)\s*\(\s*"https?://[^"]*(?:shell|backdoor|c2)[^"]*"\s*\)')
        + "), lambda m: NOT regexp_matches(m, "
        + quote(r'(?i)^\w+\s*\(\s*"https?://(?:localhost|127\.0\.0\.1)')
        + "))) > 0"
    ),
    "has_form_file_upload_loose": "regexp_matches(norm, "
    + quote(
        r"""(?is)<form[^>]*\benctype\s*=\s*(?:["']?multipart/form-data["']?)[^>]*>"""
        r""".{0,1000}?.{0,500}?<input[^>]*\btype\s*=\s*(?:["']?file["']?)"""
    )
    + ")",
    "behavior_sqlmap_uploader": "regexp_matches(norm, "
    + quote(
        r"(?is)(sqlmap\s+file\s+uploader|File\s+uploaded|MAX_FILE_SIZE)"
        r".{0,1000}?.{0,200}?(move_uploaded_file|\$_FILES|\$HTTP_POST_FILES)"
    )
    + ")",
    "has_assign_input_then_call": _assign_then(
        quote(r"(?i)\$([a-zA-Z_][a-zA-Z0-9_]{0,3})\s*=\s*@?\$_(?:GET|POST|REQUEST|COOKIE)\b"),
        quote(r"(?is)^.{0,300}?@?\$"),
        quote(r"\s*\("),
    ),
    "has_assign_input_then_exec": _assign_then(
        quote(
            r"(?i)\$([a-zA-Z_][a-zA-Z0-9_]{0,15})\s*=\s*(?:@?\$_(?:GET|POST|REQUEST|COOKIE|FILES)\b|"
            r"filter_input\s*\(|filter_var\s*\(|Request\.(?:Form|QueryString|Params|Cookies)\s*\[)"
        ),
        quote(
            r"(?is)^.{0,500}?\b(?:eval|assert|system|exec|shell_exec|passthru)\b"
            r"\s*(?:/\*.{0,80}?\*/\s*)*\(\s*(?:\w+\s*\(\s*){0,3}\$"
        ),
        quote(r"\b"),
    ),
}


def signature_sql(sig: P.Signature) -> str:
    if sig.column in SPECIAL:
        return SPECIAL[sig.column]
    text = "code" if sig.scope == "raw" else "norm"
    return f"regexp_matches({text}, {re2(sig.regex, sig.flags)})"


def flag_cte(source: str) -> str:
    flags = ",\n      ".join(f"{signature_sql(s)} AS {s.column}" for s in P.SIGNATURES)
    return f"""flagged AS (SELECT *,
      {flags},
      len(regexp_extract_all(norm, {re2(P.LONG_BASE64, '')})) AS long_base64_count,
      len(regexp_extract_all(norm, {re2(P.DEEP_SUBSCRIPT, '')})) AS deep_array_access_count,
      {framework_case("code")} AS detected_framework
      FROM {source})"""


SPACE = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def shape_cte(source: str) -> str:
    left = "length(regexp_replace({0}, {1}, '', 'g'))"
    return f"""shaped AS (SELECT *,
      greatest(length(code), 1)::DOUBLE AS n_chars_,
      greatest(len(regexp_extract_all(code, {quote(BREAKS)})) +
        CASE WHEN regexp_matches(code, {quote(f'(?:{BREAKS})$')}) THEN 0 ELSE 1 END, 1)::DOUBLE AS n_lines_,
      coalesce(list_aggregate(string_split(code, ''), 'entropy'), 0.0) AS entropy,
      CASE WHEN stripped = '' THEN 0.0 ELSE list_aggregate(string_split(stripped, ''), 'entropy') END
        AS entropy_nostrings,
      {left.format('stripped', quote(f'[a-zA-Z0-9{SPACE}]'))} / greatest(length(stripped), 1)::DOUBLE
        AS special_char_ratio_nostrings,
      {left.format('code', quote(r'[^\p{Nd}]'))} AS n_digits_,
      {left.format('code', quote(r'[\p{L}\p{N}' + SPACE + ']'))} AS n_symbols_,
      {left.format('code', quote(f'[^{SPACE}]'))} AS n_spaces_
      FROM {source})"""


def blob_cte(source: str) -> str:
    def times(text: str, needle: str) -> str:
        return f"((length({text}) - length(replace({text}, {quote(needle)}, ''))) // {len(needle)})"

    return f"""blobbed AS (SELECT *,
      (regexp_matches(code, '(?i)<svg\\b') AND length(code) > 400 AND
        ({times('lower(code)', '<path')} >= 2 OR {times('lower(code)', 'd="')} >= 3)) AS has_svg_blob,
      (len(regexp_extract_all(code, {re2(P.SERIALIZED_TOKEN)})) >= 25 AND length(code) > 600) AS has_serialized_blob,
      ({times('code', '=>')} >= 200 AND length(code) > 5000 AND exec_func_count = 0
        AND decode_func_count = 0 AND dynamic_count = 0) AS has_large_lang_array
      FROM {source})"""


# Composite behaviours, scores and paths, stated in SQL on their own terms.
COMPOSITES = [
    """behaved AS (SELECT *,
      exec_func_count > 0 AS x, input_count > 0 AS i, decode_func_count > 0 AS d, dynamic_count > 0 AS y,
      least(1.0, has_svg_blob::INT * 0.45::DOUBLE + has_serialized_blob::INT * 0.45::DOUBLE
        + has_large_lang_array::INT * 0.35::DOUBLE) AS benign_data_blob_score,
      (has_form_file_upload_loose AND has_file_write_ops) AS behavior_form_file_upload_loose,
      (has_aspx_named_pipe AND has_aspx_privilege_esc) AS behavior_aspx_privilege_pipe,
      (has_aspx_exec AND aspx_request_input AND aspx_process_pipe) AS behavior_aspx_process_shell,
      (has_jsp_classloader AND (has_jsp_base64_classload OR has_jsp_custom_classloader)) AS behavior_jsp_memory_shell,
      (has_jsp_compiled_class AND has_jsp_runtime_exec_command AND has_jsp_hardcoded_command)
        AS has_jsp_compiled_backdoor,
      ((has_jsp_compiled_class AND has_jsp_runtime_exec_command AND has_jsp_hardcoded_command)
        OR (has_jsp_compiled_class AND has_jsp_hardcoded_command)
        OR (has_jsp_compiled_class AND has_jsp_suspicious_url_pattern)
        OR (has_jsp_runtime_exec AND has_hardcoded_backdoor_cmd)
        OR (has_jsp_runtime_exec AND has_hardcoded_c2)
        OR has_jsp_exec_hardcoded_cmd) AS behavior_jsp_hardcoded_backdoor,
      (has_jsp_http_client AND (has_hardcoded_c2 OR has_jsp_http_external_suspicious)) AS behavior_jsp_http_backdoor,
      (has_jscript_directive AND input_count > 0 AND (has_jscript_eval_encoded OR exec_func_count > 0))
        AS behavior_jscript_webshell,
      (1.0 * has_dotnet_frombase64::INT + 2.0 * has_dotnet_aes_decrypt::INT + 2.5 * has_dotnet_assembly_load::INT
        + 0.5 * has_dotnet_memorystream::INT + 1.0 * has_dotnet_session_cache::INT
        + 1.5 * has_dotnet_createinstance::INT)::DOUBLE AS dotnet_memory_shell_score,
      (dotnet_memory_shell_score >= 5 AND (has_dotnet_webservice OR ends_with(lower(path), '.asmx')))
        AS behavior_dotnet_memory_shell,
      (input_count > 0 AND has_regex_exec) AS exec_path_regex
      FROM blobbed)""",
    """scored_a AS (SELECT *,
      (behavior_input_decode_exec::INT * 3.0 + behavior_password_backdoor::INT * 2.0
        + behavior_cookie_exec::INT * 2.0 + behavior_cookie_hash_gate_dyn_call::INT * 2.5
        + behavior_aspx_process_shell::INT * 2.5 + behavior_jsp_memory_shell::INT * 3.0
        + behavior_jsp_request_exec::INT * 2.5 + behavior_jsp_hardcoded_backdoor::INT * 3.5
        + behavior_jsp_http_backdoor::INT * 3.0 + behavior_jscript_webshell::INT * 3.5
        + behavior_dotnet_memory_shell::INT * 3.5 + behavior_obfuscated_exec::INT * 1.5
        + behavior_rawbody_backdoor::INT * 1.5 + behavior_file_manager::INT * 2.0
        + behavior_upload_chmod::INT * 2.0 + behavior_aspx_file_manager::INT * 2.0
        + short_input_exec_distance::INT * 1.0 + exec_path_regex::INT * 2.5
        + has_assign_input_then_call::INT * 1.0)::DOUBLE / 44.5::DOUBLE AS intent_webshell_score,
      (behavior_password_backdoor::INT * 2.0 + behavior_sql_backdoor::INT * 2.0 + has_md5_cookie_check::INT * 1.5
        + behavior_cookie_exec::INT * 1.0)::DOUBLE / 6.5::DOUBLE AS intent_backdoor_score,
      (behavior_reverse_shell::INT * 2.5 + behavior_data_exfiltration::INT * 2.0
        + behavior_jsp_http_tunneling::INT * 2.5 + (has_fsockopen OR has_socket_create)::INT * 1.0)::DOUBLE
        / 11::DOUBLE AS intent_c2_score,
      (has_file_write_ops::INT * 2.0 + (long_base64_count > 0)::INT * 1.5
        + behavior_obfuscated_exec::INT * 1.0)::DOUBLE / 4.5::DOUBLE AS intent_dropper_score,
      (behavior_aspx_privilege_pipe::INT * 3.0 + has_aspx_winapi::INT * 2.0 + has_aspx_privilege_esc::INT * 2.5)
        ::DOUBLE / 7.5::DOUBLE AS intent_privilege_escalation,
      behavior_obfuscated_exec::INT + has_decode_chain::INT + has_string_index_obfusc::INT
        + has_alphabet_builder::INT + has_variable_function_call::INT + has_superglobal_var_call::INT
        + has_assign_input_then_call::INT + has_reflection::INT + has_comment_obfusc::INT
        + has_bitwise_chr::INT AS stealth_technique_count,
      behavior_input_decode_exec::INT + behavior_password_backdoor::INT + behavior_upload_chmod::INT
        + has_assign_input_then_call::INT + behavior_aspx_process_shell::INT + behavior_aspx_privilege_pipe::INT
        + behavior_aspx_file_manager::INT + behavior_jsp_memory_shell::INT + behavior_jsp_request_exec::INT
        + behavior_jsp_hardcoded_backdoor::INT + behavior_jsp_http_backdoor::INT
        + behavior_jscript_webshell::INT + behavior_dotnet_memory_shell::INT AS crit,
      behavior_cookie_hash_gate_dyn_call::INT + behavior_jsp_http_tunneling::INT
        + has_superglobal_var_call::INT + behavior_filterinput_exec::INT + behavior_arbitrary_upload_path::INT
        + behavior_cookie_exec::INT + behavior_rawbody_backdoor::INT + behavior_file_manager::INT AS strong
      FROM behaved)""",
    """scored AS (SELECT *,
      (intent_webshell_score * 3.0::DOUBLE + intent_backdoor_score * 2.5::DOUBLE + intent_c2_score * 2.0::DOUBLE
        + intent_dropper_score * 1.5::DOUBLE + intent_privilege_escalation * 2.0::DOUBLE
        + stealth_technique_count / 10::DOUBLE + exec_path_regex::INT) / 13::DOUBLE AS overall_threat_score
      FROM scored_a)""",
]

# Feature columns that are not plain columns of the last relation.
DERIVED = {
    "aspx_tunneling_score": "0.0::DOUBLE",
    "behavior_aspx_tunneling": "0",
    "is_known_framework": "detected_framework <> ''",
    "has_exec_function": "x",
    "has_decode_function": "d",
    "has_input_access": "i",
    "has_dynamic_exec": "y",
    "has_long_base64": "long_base64_count > 0",
    "has_deep_array_access": "deep_array_access_count > 0",
    "has_java_runtime_exec": "has_jsp_runtime_exec",
    "has_java_reflection": "has_jsp_reflection",
    "input_density": "input_count / n_lines_",
    "exec_density": "exec_func_count / n_lines_",
    "decode_density": "decode_func_count / n_lines_",
    "dynamic_exec_density": "dynamic_count / n_lines_",
    "avg_line_length": "n_chars_ / n_lines_",
    "log_code_size": "ln(1 + n_chars_)",
    "digit_ratio": "n_digits_ / n_chars_",
    "special_char_ratio": "n_symbols_ / n_chars_",
    "whitespace_ratio": "n_spaces_ / n_chars_",
    "behavior_assign_input_then_exec": "has_assign_input_then_exec",
    "behavior_exec_comment_split": "has_exec_comment_split",
    "stealth_score_enhanced": "stealth_technique_count / 10::DOUBLE",
    "exec_path_direct": "i AND x AND input_exec_distance < 0.2 AND NOT behavior_obfuscated_exec AND NOT d",
    "exec_path_decoded": "i AND d AND x AND (behavior_input_decode_exec OR has_decode_chain)",
    "exec_path_hidden": (
        "i AND (has_variable_function_call OR has_superglobal_var_call OR has_assign_input_then_call "
        "OR has_reflection OR has_invoke_pattern)"
    ),
    "exec_path_indirect": "i AND y",
    "data_flow_complexity": (
        "CASE WHEN NOT i THEN 0 ELSE x::INT + d::INT + y::INT + (has_variable_function_call OR "
        "has_superglobal_var_call OR has_assign_input_then_call)::INT + has_reflection::INT END"
    ),
    "critical_signature_score": "crit",
    "strong_signature_score": "strong",
    "has_any_critical_signature": "crit > 0",
    "has_any_strong_signature": "strong > 0",
    "has_multiple_signatures": "crit + strong >= 2",
    "aspx_signature_score": (
        "behavior_aspx_process_shell::INT + behavior_aspx_privilege_pipe::INT + behavior_aspx_file_manager::INT "
        "+ behavior_jscript_webshell::INT + behavior_dotnet_memory_shell::INT"
    ),
    "jsp_signature_score": (
        "behavior_jsp_memory_shell::INT + behavior_jsp_request_exec::INT + behavior_jsp_http_tunneling::INT "
        "+ behavior_jsp_hardcoded_backdoor::INT + behavior_jsp_http_backdoor::INT"
    ),
    "total_weighted_signature_score": "crit * 3.0::DOUBLE + strong * 2.0::DOUBLE + overall_threat_score * 1.5::DOUBLE",
}


def feature_ctes(source: str = "corpus") -> list[str]:
    """From a ``files`` relation to ``features``."""
    columns = ",\n      ".join(
        f"({DERIVED.get(f, f)})::{'DOUBLE' if f in REAL_VALUED else 'INTEGER'} AS {f}" for f in FEATURES
    )
    return [
        f"long_enough AS (SELECT * FROM {source} WHERE length(code) >= 20)",
        *decoded_ctes("long_enough"),
        *stripped_ctes("decoded"),
        *match_ctes("plain"),
        flag_cte("counted"),
        shape_cte("flagged"),
        blob_cte("shaped"),
        *COMPOSITES,
        f"""features AS MATERIALIZED (SELECT file_id, path, ext, size, code, {columns}, detected_framework
      FROM scored)""",
    ]


def rounded(columns: tuple[str, ...] | list[str]) -> str:
    """Output list: real-valued features to six digits, the rest as they are."""
    return ", ".join(f"round({c}, 6) AS {c}" if c in REAL_VALUED else c for c in columns)
