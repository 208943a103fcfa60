"""The feature table's columns, in their frozen order."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Names and order of the feature columns.
# ---------------------------------------------------------------------------
FEATURES: tuple[str, ...] = tuple(
    """
    string_literal_ratio entropy_nostrings special_char_ratio_nostrings has_regex_exec exec_path_regex
    aspx_tunneling_score is_known_framework has_exec_function exec_func_count has_decode_function
    decode_func_count has_input_access input_count has_dynamic_exec aspx_databinding_eval_count
    aspx_code_eval_count has_svg_blob has_serialized_blob has_large_lang_array benign_data_blob_score
    has_var_vars has_reflection has_magic_method has_aspx_exec has_aspx_runat has_asp_createobject
    has_asp_scripting has_aspx_file_write has_aspx_file_upload has_aspx_winapi has_aspx_named_pipe
    has_aspx_privilege_esc has_jsp_classloader has_jsp_base64_classload has_jsp_compiled_class
    has_jsp_hardcoded_command has_jsp_runtime_exec_command has_jsp_suspicious_url_pattern
    has_jsp_compiled_backdoor has_jsp_custom_classloader has_jsp_runtime_exec has_jsp_reflection
    has_jsp_http_client has_jsp_script_engine has_jscript_directive has_jscript_eval_encoded
    has_hardcoded_backdoor_cmd has_hardcoded_c2 has_jsp_runtime_suspicious
    has_jsp_http_external_suspicious has_jsp_exec_hardcoded_cmd has_jsp_linux_enum
    has_jsp_hardcoded_curl_k has_dotnet_frombase64 has_dotnet_aes_decrypt has_dotnet_assembly_load
    has_dotnet_memorystream has_dotnet_session_cache has_dotnet_createinstance has_dotnet_webservice
    has_md5_cookie_check has_fake_mage_class has_fake_wp_plugin has_class_construct_exec has_long_base64
    long_base64_count has_hex_escape has_unicode_escape has_octal_escape has_comment_obfusc
    has_string_concat has_chr_concat has_bitwise_chr has_string_index_obfusc has_alphabet_builder
    has_decode_chain has_file_write_ops has_file_read_ops has_db_ops has_fsockopen has_socket_create
    has_form_textarea has_form_file_upload has_form_file_upload_loose behavior_form_file_upload_loose
    has_dynamic_include has_unserialize_input has_goto has_backticks has_error_suppress_exec
    has_java_runtime_exec has_java_reflection has_python_exec has_python_os_system input_density
    exec_density decode_density dynamic_exec_density input_exec_distance short_input_exec_distance
    has_variable_function_call has_superglobal_var_call has_assign_input_then_call
    has_assign_input_then_exec has_exec_comment_split has_invoke_pattern has_newinstance_with_input
    has_nested_functions has_function_chain deep_array_access_count has_deep_array_access
    has_reflection_newinstance entropy avg_line_length log_code_size digit_ratio special_char_ratio
    whitespace_ratio behavior_input_decode_exec behavior_password_backdoor behavior_sql_backdoor
    behavior_obfuscated_exec behavior_cookie_exec behavior_cookie_hash_gate_dyn_call
    behavior_aspx_file_manager behavior_aspx_tunneling behavior_aspx_privilege_pipe
    behavior_aspx_process_shell behavior_jsp_memory_shell behavior_jsp_request_exec
    behavior_jsp_http_tunneling behavior_jsp_hardcoded_backdoor behavior_jsp_http_backdoor
    behavior_jscript_webshell dotnet_memory_shell_score behavior_dotnet_memory_shell
    behavior_reverse_shell behavior_data_exfiltration behavior_rawbody_backdoor behavior_file_manager
    behavior_upload_chmod behavior_filterinput_exec behavior_sqlmap_uploader
    behavior_arbitrary_upload_path behavior_assign_input_then_exec behavior_exec_comment_split
    intent_webshell_score intent_backdoor_score intent_c2_score intent_dropper_score
    intent_privilege_escalation stealth_technique_count stealth_score_enhanced overall_threat_score
    exec_path_direct exec_path_decoded exec_path_hidden exec_path_indirect data_flow_complexity
    critical_signature_score strong_signature_score has_any_critical_signature
    has_any_strong_signature has_multiple_signatures aspx_signature_score jsp_signature_score
    total_weighted_signature_score
    """.split()
)

# Columns holding ratios and scores; all others are flags and counts.
REAL_VALUED: frozenset[str] = frozenset(
    """
    string_literal_ratio entropy_nostrings special_char_ratio_nostrings aspx_tunneling_score
    benign_data_blob_score input_density exec_density decode_density dynamic_exec_density
    input_exec_distance entropy avg_line_length log_code_size digit_ratio special_char_ratio
    whitespace_ratio dotnet_memory_shell_score intent_webshell_score intent_backdoor_score
    intent_c2_score intent_dropper_score intent_privilege_escalation stealth_score_enhanced
    overall_threat_score critical_signature_score strong_signature_score aspx_signature_score
    jsp_signature_score total_weighted_signature_score
    """.split()
)

# Suffix groups.  They differ from place to place on purpose.
TEMPLATE_SUFFIXES = (".aspx", ".ascx", ".asax", ".ashx", ".asmx")
DOTNET_FAMILY = (".aspx", ".ascx", ".asax", ".ashx")
BINDING_FAMILY = (".aspx", ".ascx", ".asax")
JAVA_FAMILY = (".jsp", ".jspx", ".java")
SCAN_SUFFIXES = (
    ".php", ".asp", ".aspx", ".jsp", ".jspx", ".py", ".js", ".txt", ".cs", ".config", ".inc",
    ".phtml", ".cgi", ".pl", ".ascx", ".asax", ".ashx", ".asmx", "",
)
TRAIN_SUFFIXES = tuple(s for s in SCAN_SUFFIXES if s)
NGRAM_SUFFIXES = tuple(s for s in TRAIN_SUFFIXES if s not in (".config", ".cgi", ".pl"))
AMBIGUOUS_SUFFIXES = (".txt", ".config", ".log", ".dat", ".bak", "")
# End of the fixed values.
