"""The signature table: which text patterns exist, where they look, what they feed.

Each row names the feature column it feeds.  ``scope`` says which text is
searched: ``norm`` (escape-decoded), ``raw`` (as read).  ``flags`` holds ``i``
(ignore case) and ``s`` (dot matches newline).  A ``regex`` given as a tuple is
a chain: its parts must follow one another with any text in between.

``need`` is our own cheap pre-test and no part of the pattern: every string in
it lists lower-case literals, at least one of which occurs in any matching
text.  A text that lacks them all is never handed to the regex engine.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# The pattern texts below must stay as they are for right results.
# ---------------------------------------------------------------------------

COMMENT_RUN = r"\s*(?:/\*[\s\S]{0,80}?\*/\s*)*\("

EXEC_CALL = (
    r"(?<!<%[#=]\s)"
    r"\b(eval|exec|system|shell_exec|passthru|popen|proc_open|assert|create_function|pcntl_exec)\b"
    + COMMENT_RUN
)
CODE_EVAL_CALL = r"(?<!<%[#=]\s)\beval\s*\("
BINDING_EVAL_TAG = r"<%[#=]\s*Eval\s*\("
DECODE_CALL = (
    r"\b(base64_decode|gzinflate|gzuncompress|str_rot13|urldecode|rawurldecode|convert_uudecode)\b"
    + COMMENT_RUN
)
DYNAMIC_CALL = (
    r"\b(call_user_func|call_user_func_array|array_map|array_walk|register_shutdown_function|preg_replace)\b"
    + COMMENT_RUN
)
INPUT_ACCESS = (
    r"\$_(GET|POST|REQUEST|COOKIE|FILES|SERVER)\b"
    r"|\$(HTTP_GET_VARS|HTTP_POST_VARS|HTTP_COOKIE_VARS|HTTP_SERVER_VARS|HTTP_POST_FILES)\b"
    r"|filter_input\s*\(|filter_var\s*\("
    r"|Request\s*(?:/\*[\s\S]{0,50}?\*/\s*)*\.\s*(?:/\*[\s\S]{0,50}?\*/\s*)*(Form|QueryString|Params|Cookies)"
    r"\s*(?:/\*[\s\S]{0,50}?\*/\s*)*\["
    r"|Request\s*(?:/\*[\s\S]{0,50}?\*/\s*)*\["
    r"|Request\s*(?:/\*[\s\S]{0,50}?\*/\s*)*\.\s*(?:/\*[\s\S]{0,50}?\*/\s*)*Item\s*(?:/\*[\s\S]{0,50}?\*/\s*)*\["
)
SERIALIZED_TOKEN = r"\b(?:a|O|s|i|b|d):\d+:"
LONG_BASE64 = r"[A-Za-z0-9+/]{80,}={0,2}"
DEEP_SUBSCRIPT = r"\$\w+(\[[^\]]+\]){3,}"


@dataclass(frozen=True)
class Signature:
    column: str
    regex: str | tuple[str, ...]
    flags: str = "i"
    scope: str = "norm"
    need: tuple[str, ...] = ()


SIGNATURES: tuple[Signature, ...] = (
    # --- .NET pages --------------------------------------------------------
    Signature(
        "has_aspx_file_write",
        r"\b(File\.WriteAllText|File\.WriteAllBytes|File\.AppendAllText|StreamWriter|FileStream\.Write|"
        r"File\.Copy|File\.Move|File\.Delete|Directory\.CreateDirectory|Directory\.Delete)\b",
        need=("file. streamwriter filestream. directory.",),
    ),
    Signature(
        "has_aspx_file_upload",
        r"\b(Request\.Files|HttpPostedFile|PostedFile\.SaveAs|InputStream\.CopyTo)\b",
        need=("request.files postedfile inputstream.copyto",),
    ),
    Signature(
        "behavior_aspx_file_manager",
        r"(File\.WriteAllText|SaveAs|File\.Delete|Directory\.GetFiles|Directory\.GetDirectories)"
        r"[\s\S]{0,500}(Request\.(Form|QueryString|Params)|HttpPostedFile)",
        "is",
        need=("file. saveas directory.get", "request. httppostedfile"),
    ),
    Signature(
        "has_aspx_winapi",
        r"""DllImport\s*\(\s*["']+(kernel32|advapi32|user32|ntdll)""",
        need=("dllimport",),
    ),
    Signature(
        "has_aspx_named_pipe",
        r"\b(CreateNamedPipe|ConnectNamedPipe|CreateFile.*?PIPE|NamedPipeClientStream)\b",
        need=("pipe",),
    ),
    Signature(
        "has_aspx_privilege_esc",
        r"\b(ImpersonateNamedPipeClient|OpenProcessToken|DuplicateTokenEx|"
        r"AdjustTokenPrivileges|CreateProcessAsUser|LogonUser)\b",
        need=("impersonatenamedpipe token createprocessasuser logonuser",),
    ),
    Signature(
        "has_aspx_exec",
        r"\b(Process\.Start|ProcessStartInfo|cmd\.exe|powershell|WScript\.Shell|eval\s*\()",
        need=("process.start processstart cmd.exe powershell wscript.shell eval",),
    ),
    Signature(
        "aspx_process_pipe",
        r"(RedirectStandardInput|RedirectStandardOutput|RedirectStandardError|"
        r"StandardInput\.Write(Line)?|UseShellExecute\s*=\s*false)",
        need=("standardinput standardoutput standarderror useshellexecute",),
    ),
    Signature(
        "aspx_request_input",
        r"Request\.(QueryString|Form|Params|Cookies)\s*\[",
        need=("request.",),
    ),
    # --- Java server pages -------------------------------------------------
    Signature(
        "has_jsp_compiled_class",
        r"(?:extends\s+HttpJspBase|implements\s+JspSourceDependent)",
        need=("httpjspbase jspsourcedependent",),
    ),
    Signature(
        "has_jsp_hardcoded_command",
        r'String\s+command\s*=\s*"[^"]*'
        r'(?:curl|wget|ls\s+/|dir\s+[A-Z]:|nc\s+|bash|sh|cmd\.exe|powershell)[^"]*"',
        need=("command", "string"),
    ),
    Signature(
        "has_jsp_runtime_exec_command",
        r"Runtime\.getRuntime\(\)\.exec\s*\(\s*command\s*\)",
        need=("runtime.getruntime().exec",),
    ),
    Signature(
        "has_jsp_suspicious_url_pattern",
        r"""https?://[^"']*(?:shell|backdoor|c2|rokok|bet|hack|cmd)[^"']*""",
        need=("http:// https://", "shell backdoor c2 rokok bet hack cmd"),
    ),
    Signature(
        "has_jsp_classloader",
        r"(defineClass|ClassLoader.*?defineClass|super\.defineClass)\s*\(",
        need=("defineclass",),
    ),
    Signature(
        "has_jsp_base64_classload",
        (r"(BASE64Decoder|Base64\.getDecoder)", r"(defineClass|newInstance|loadClass)"),
        "is",
        need=("base64decoder base64.getdecoder", "defineclass newinstance loadclass"),
    ),
    Signature(
        "has_jsp_custom_classloader",
        (r"class\s+\w+\s+extends\s+ClassLoader", r"(defineClass|super\.defineClass)"),
        "is",
        need=("classloader", "defineclass"),
    ),
    Signature(
        "has_jsp_runtime_exec",
        r"Runtime\.getRuntime\(\)\.exec|ProcessBuilder|new\s+Process",
        need=("runtime.getruntime() process",),
    ),
    Signature(
        "has_jsp_reflection",
        r"(Class\.forName|Method\.invoke|getDeclaredMethod|getMethod\s*\(.*?\)\.invoke)",
        need=("class.forname .invoke getdeclaredmethod",),
    ),
    Signature(
        "has_jsp_http_client",
        r"(HttpClient|CloseableHttpClient|HttpGet|HttpPost|HttpURLConnection|URL\s*\(.*?\)\.openConnection)",
        need=("httpclient httpget httppost httpurlconnection openconnection",),
    ),
    Signature(
        "behavior_jsp_http_tunneling",
        (r"(HttpClient|HttpGet|HttpPost)", r"(request\.getParameter|getInputStream|EntityUtils)"),
        "is",
        need=("httpclient httpget httppost", "request.getparameter getinputstream entityutils"),
    ),
    Signature(
        "behavior_jsp_request_exec",
        (r"request\.getParameter", r"(Runtime\.getRuntime|defineClass|Class\.forName|Method\.invoke)"),
        "is",
        need=("request.getparameter", "runtime.getruntime defineclass class.forname method.invoke"),
    ),
    Signature(
        "has_jsp_script_engine",
        r"ScriptEngineManager|ScriptEngine\.eval|Nashorn",
        need=("scriptengine nashorn",),
    ),
    Signature(
        "has_hardcoded_backdoor_cmd",
        r"""(?:String|final\s+String)\s+(?:command|cmd|shell|exec)\s*=\s*["']"""
        r"(?:"
        r"curl\s+-[kK]|"
        r"wget\s+(?:-q\s+)?https?://|"
        r"nc\s+-[lnvp]+|"
        r"bash\s+-[ic]|sh\s+-[ic]|"
        r"/bin/(?:ba)?sh|cmd\.exe|powershell|"
        r"chmod\s+[0-9]+|"
        r"python\s+-c|perl\s+-e"
        r")",
        need=("string", "curl wget nc sh cmd.exe chmod python perl"),
    ),
    Signature(
        "has_hardcoded_c2",
        r"https?://(?:"
        r"shell\.|c2\.|backdoor\.|admin\.|"
        r"[a-z0-9-]+\.(?:tk|ml|ga|cf|gq)|"
        r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}:\d{4,5}"
        r"""[a-z0-9-]+\.[a-z0-9-]+\.com/[^"']*(?:shell|backdoor|c2)"""
        r")",
        need=("http:// https://",),
    ),
    Signature(
        "has_jsp_runtime_suspicious",
        r"Runtime\.getRuntime\(\)\.exec\s*\(\s*(?:command|cmd|shell|exec)\s*\)",
        need=("runtime.getruntime().exec",),
    ),
    Signature(
        "has_jsp_http_external_suspicious",
        r'(?:HttpGet|HttpPost|URL)\s*\(\s*"https?://(?!localhost|127\.0\.0\.1)[^"]*'
        r'(?:shell|backdoor|c2)[^"]*"\s*\)',
        need=("httpget httppost url", "http:// https://", "shell backdoor c2"),
    ),
    Signature(
        "has_jsp_linux_enum",
        r'String\s+command\s*=\s*"ls\s+/(?:home|root|etc|var)',
        need=("command", "string"),
    ),
    Signature(
        "has_jsp_hardcoded_curl_k",
        r"curl\s+-[kK]\s+https?://",
        need=("curl",),
    ),
    Signature(
        "has_jsp_exec_hardcoded_cmd",
        r"Runtime\.getRuntime\(\)\.exec\s*\(\s*"
        r"""(?:command|cmd|shell|exec|["'])"""
        r"[\s\S]{0,200}"
        r"(?:"
        r"curl\s+-[kK]|"
        r"wget\s+https?://|"
        r"nc\s+-|bash|sh|cmd\.exe|powershell|"
        r"ls\s+/(?:home|root|etc)|"
        r"""https?://[^"']*(?:shell|backdoor|c2|rokok|bet)"""
        r")",
        "is",
        need=("runtime.getruntime().exec",),
    ),
    # --- script-language .NET pages and in-memory loaders ------------------
    Signature(
        "has_jscript_directive",
        (r"<%@\s+Page\s+", r"""Language\s*=\s*["']?Jscript["']?"""),
        "is",
        scope="raw",
        need=("<%@",),
    ),
    Signature(
        "has_jscript_eval_encoded",
        r"(?:\\u0065\\u0076\\u0061\\u006c|\\x65\\x76\\x61\\x6c|eval)\s*\(",
        need=("eval \\u0065 \\x65",),
    ),
    Signature(
        "has_dotnet_frombase64",
        r"Convert\s*\.\s*FromBase64String\s*\(",
        need=("frombase64string",),
    ),
    Signature(
        "has_dotnet_aes_decrypt",
        (r"AesManaged\s*\(\s*\)\s*\.\s*CreateDecryptor", r"TransformFinalBlock"),
        "is",
        need=("aesmanaged", "transformfinalblock"),
    ),
    Signature(
        "has_dotnet_assembly_load",
        r"(AppDomain\s*\.\s*CurrentDomain\s*\.\s*Load|Assembly\s*\.\s*Load)\s*\(",
        need=("currentdomain assembly", "load"),
    ),
    Signature("has_dotnet_memorystream", r"MemoryStream\s*\(", need=("memorystream",)),
    Signature(
        "has_dotnet_session_cache",
        r"""(Context\s*\.\s*Session|Session)\s*\[\s*["']""",
        need=("session",),
    ),
    Signature(
        "has_dotnet_createinstance",
        r"""CreateInstance\s*\(\s*["'][A-Z]{1,5}["']\s*\)""",
        need=("createinstance",),
    ),
    Signature(
        "has_dotnet_webservice",
        r"""<%@\s+WebService\s+Language\s*=\s*["']?C#["']?""",
        scope="raw",
        need=("<%@",),
    ),
    # --- PHP and general script idioms -------------------------------------
    Signature("has_var_vars", r"""\$\$\w+|\$\{['"]?\w+['"]?\}""", "", need=("$$ ${",)),
    Signature(
        "has_reflection",
        r"\b(ReflectionClass|ReflectionMethod|ReflectionFunction|__invoke|__call|__callStatic)\b",
        need=("reflection __invoke __call",),
    ),
    Signature(
        "has_magic_method",
        r"__(invoke|call|callStatic|construct|destruct|get|set)\s*\(",
        need=("__invoke __call __construct __destruct __get __set",),
    ),
    Signature("has_aspx_runat", r"""runat\s*=\s*["']server["']""", need=("runat",)),
    Signature(
        "has_asp_createobject",
        r"Server\.CreateObject|WScript\.Shell|Shell\.Application",
        need=("server.createobject wscript.shell shell.application",),
    ),
    Signature(
        "has_asp_scripting",
        r"(oScriptNet|WScript|Scripting\.FileSystemObject)",
        need=("oscriptnet wscript scripting.filesystemobject",),
    ),
    Signature(
        "has_file_write_ops",
        r"\b(fopen|file_put_contents|fwrite|move_uploaded_file|copy|rename)\s*\(",
        need=("fopen file_put_contents fwrite move_uploaded_file copy rename",),
    ),
    Signature(
        "has_file_read_ops",
        r"\b(file_get_contents|readfile|fread)\s*\(",
        need=("file_get_contents readfile fread",),
    ),
    Signature(
        "has_db_ops",
        r"\b(mysql_query|mysqli_query|pg_query|sqlite_query|PDO)\b",
        need=("_query pdo",),
    ),
    Signature(
        "has_md5_cookie_check",
        r"md5\s*\(\s*@?\$_COOKIE\[.*?\]\s*\)\s*==",
        need=("$_cookie", "md5"),
    ),
    Signature(
        "has_error_suppress_exec",
        r"@\s*(eval|exec|system|shell_exec|passthru|assert)\s*\(",
        need=("@", "eval exec system passthru assert"),
    ),
    Signature("has_goto", r"\bgoto\s+\w+\s*;", need=("goto",)),
    Signature("has_bitwise_chr", r"chr\s*\(\s*\d+\s*\)\s*\^", need=("chr", "^")),
    Signature(
        "has_form_textarea",
        (r"<form[^>]*>", r"<textarea", r"""name\s*=\s*["']?\w+["']?"""),
        "is",
        need=("<form", "<textarea"),
    ),
    Signature(
        "has_form_file_upload",
        (
            r"""<form[^>]*enctype\s*=\s*["']multipart/form-data["'][^>]*>""",
            r"""<input[^>]*type\s*=\s*["']file["']""",
        ),
        "is",
        need=("<form", "multipart/form-data", "<input"),
    ),
    Signature(
        "has_form_file_upload_loose",
        r"""<form[^>]*\benctype\s*=\s*(?:["']?multipart/form-data["']?)[^>]*>"""
        r"""[\s\S]{0,1500}?<input[^>]*\btype\s*=\s*(?:["']?file["']?)""",
        "is",
        need=("<form", "multipart/form-data", "<input"),
    ),
    Signature(
        "behavior_reverse_shell",
        r"\b(fsockopen|socket_create|socket_connect)\s*\("
        r"[\s\S]{0,300}?"
        r"(/bin/(ba)?sh|bash\s+-i|cmd\.exe\s+/c|powershell\s+-)",
        "is",
        need=("fsockopen socket_create socket_connect", "sh cmd.exe powershell"),
    ),
    Signature(
        "has_fsockopen",
        r"""fsockopen\s*\(\s*["']?[\w\.\-]+["']?\s*,\s*\d+""",
        need=("fsockopen",),
    ),
    Signature(
        "has_socket_create",
        r"socket_create|socket_connect|socket_bind",
        need=("socket_create socket_connect socket_bind",),
    ),
    Signature(
        "has_dynamic_include",
        r"\b(include|require|include_once|require_once)\s*\(\s*\$_(GET|POST|REQUEST|COOKIE)",
        need=("$_get $_post $_request $_cookie", "include require"),
    ),
    Signature(
        "has_unserialize_input",
        r"unserialize\s*\(\s*\$_(GET|POST|REQUEST|COOKIE)",
        need=("$_get $_post $_request $_cookie", "unserialize"),
    ),
    Signature(
        "has_alphabet_builder",
        r"""\b[a-zA-Z_]\w*\s*=\s*["'][A-Za-z0-9+/=]{30,}["']""",
        need=("=", "\" '"),
    ),
    Signature("has_string_index_obfusc", r"\$\w+\s*\[\s*\d+\s*\]\s*\.", need=("$",)),
    Signature("has_hex_escape", r"\\x[0-9a-fA-F]{2}", "", scope="raw", need=("\\x",)),
    Signature("has_unicode_escape", r"\\u[0-9a-fA-F]{4}", "", scope="raw", need=("\\u",)),
    Signature("has_octal_escape", r"\\[0-7]{3}", "", scope="raw", need=("\\",)),
    Signature("has_comment_obfusc", r"\w/\*+\*/\w", "", need=("*/",)),
    Signature("has_string_concat", r"""["']\s*\.\s*["']""", "", need=("\" '", ".")),
    Signature("has_chr_concat", r"chr\s*\(\s*\d+\s*\)\s*\.", need=("chr",)),
    Signature("has_backticks", r"`[^`]+`", "", need=("`",)),
    Signature("has_variable_function_call", r"\$\w+\s*\(\s*\$", need=("$", "(")),
    Signature("has_invoke_pattern", r"__invoke|->__call|\$this\s*\(", need=("__invoke ->__call $this",)),
    Signature(
        "has_newinstance_with_input",
        r"newInstance\s*\([^\)]*\$_(GET|POST|REQUEST|COOKIE)",
        need=("$_get $_post $_request $_cookie", "newinstance"),
    ),
    Signature("has_nested_functions", r"\$\w+\(\$\w+\(\$\w+\(", need=("($",)),
    Signature("has_function_chain", r"\w+\s*\(\s*\w+\s*\(\s*\w+\s*\(", need=("(",)),
    Signature(
        "has_class_construct_exec",
        (r"class\s+\w+", r"__construct", r"(eval|exec|system|call_user_func)"),
        "is",
        need=("__construct", "eval exec system call_user_func"),
    ),
    Signature(
        "has_reflection_newinstance",
        (r"new\s+ReflectionClass", r"newInstance"),
        "is",
        need=("reflectionclass", "newinstance"),
    ),
    Signature(
        "has_fake_mage_class",
        (r"class\s+(Mage|Varien)_\w+", r"\$_COOKIE", r"(eval|exec|base64_decode)"),
        "is",
        need=("mage_ varien_", "$_cookie", "eval exec base64_decode"),
    ),
    Signature(
        "has_fake_wp_plugin",
        (r"Plugin\s+Name:", r"(@eval|base64_decode.*?eval)"),
        "is",
        need=("name:", "eval"),
    ),
    Signature("has_superglobal_var_call", r"@?\$_\s*\(|@?\$__+\s*\(", need=("$_",)),
    Signature(
        "has_assign_input_then_call",
        r"\$([a-zA-Z_][a-zA-Z0-9_]{0,3})\s*=\s*@?\$_(GET|POST|REQUEST|COOKIE)\b"
        r"[\s\S]{0,300}?@?\$\1\s*\(",
        need=("$_get $_post $_request $_cookie",),
    ),
    Signature(
        "behavior_cookie_hash_gate_dyn_call",
        r"""md5\s*\(\s*@?\$_COOKIE\[.*?\]\s*\)\s*==={0,2}\s*["'][0-9a-f]{16,32}["']"""
        r"[\s\S]{0,600}?@?\$_\s*\(",
        need=("$_cookie", "md5"),
    ),
    Signature("has_python_exec", r"\b(exec|eval|compile|__import__)\s*\(", need=("exec eval compile __import__",)),
    Signature(
        "has_python_os_system",
        r"(os\.system|subprocess\.call|subprocess\.run|subprocess\.Popen)",
        need=("os.system subprocess.",),
    ),
    Signature(
        "has_decode_chain",
        r"(base64_decode|gzinflate|gzuncompress|str_rot13)\s*\(\s*"
        r"(base64_decode|gzinflate|gzuncompress|str_rot13)",
        need=("base64_decode gzinflate gzuncompress str_rot13",),
    ),
    Signature(
        "has_regex_exec",
        r"""preg_replace\s*\(\s*["'][^"']*e[^"']*["']""",
        need=("preg_replace",),
    ),
    # --- behaviours --------------------------------------------------------
    Signature(
        "behavior_input_decode_exec",
        (
            r"\$_(GET|POST|REQUEST|COOKIE)",
            r"(base64_decode|gzinflate|gzuncompress|str_rot13)",
            r"(eval|assert|system|exec|shell_exec)",
        ),
        "is",
        need=(
            "$_get $_post $_request $_cookie",
            "base64_decode gzinflate gzuncompress str_rot13",
            "eval assert system exec",
        ),
    ),
    Signature(
        "behavior_password_backdoor",
        r"(?:"
        r"if\s*\(\s*\$_(POST|REQUEST|COOKIE)\[.*?(pass|pwd|key|auth).*?\]\s*===?"
        r"|"
        r"if\s*\(\s*\$_(POST|REQUEST|COOKIE)\[.*?(pass|pwd|key|auth).*?\]\s*!==?"
        r"|"
        r"if\s*\([^)]*\$_(POST|REQUEST|COOKIE)\[.*?(pass|pwd|key|auth).*?\][^)]*===?\s*\$\w+"
        r"|"
        r"if\s*\([^)]*\$_(POST|REQUEST|COOKIE)\[.*?(pass|pwd|key|auth).*?\][^)]*!==?\s*\$\w+"
        r"|"
        r"if\s*\([^)]*\$_SESSION[^)]*\|\|[^)]*\$_(POST|REQUEST|COOKIE)\[.*?(pass|pwd|key|auth).*?\]\s*!==?"
        r")",
        need=("$_post $_request $_cookie", "pass pwd key auth", "if"),
    ),
    Signature("behavior_rawbody_backdoor", r"php://input|php://stdin", need=("php://input php://stdin",)),
    Signature(
        "behavior_sql_backdoor",
        r"(select|insert|update|delete).{0,200}\$_(GET|POST|REQUEST|COOKIE)",
        "is",
        need=("$_get $_post $_request $_cookie", "select insert update delete"),
    ),
    Signature(
        "behavior_obfuscated_exec",
        r"(chr\s*\(|\\x[0-9a-f]{2}|\\u[0-9a-f]{4}|\\[0-7]{3}).{0,200}"
        r"(eval|assert|system|exec|shell_exec)",
        "is",
        need=("chr \\", "eval assert system exec"),
    ),
    Signature(
        "behavior_cookie_exec",
        r"\$_COOKIE.{0,150}(eval|assert|system|exec|shell_exec|passthru)",
        "is",
        need=("$_cookie", "eval assert system exec passthru"),
    ),
    Signature(
        "behavior_data_exfiltration",
        r"(curl_exec|file_get_contents).{0,120}http",
        "is",
        need=("curl_exec file_get_contents", "http"),
    ),
    Signature(
        "behavior_file_manager",
        r"(scandir|opendir|readdir|unlink|chmod|chown).{0,200}\$_(GET|POST|REQUEST)",
        "is",
        need=("$_get $_post $_request", "scandir opendir readdir unlink chmod chown"),
    ),
    Signature(
        "behavior_upload_chmod",
        r"move_uploaded_file.{0,500}chmod",
        "is",
        need=("move_uploaded_file", "chmod"),
    ),
    Signature(
        "has_exec_comment_split",
        r"\b(eval|assert|system|exec|shell_exec|passthru)\b\s*/\*[\s\S]{0,80}?\*/\s*\(",
        "is",
        need=("*/", "eval assert system exec passthru"),
    ),
    Signature(
        "has_assign_input_then_exec",
        r"\$([a-zA-Z_][a-zA-Z0-9_]{0,15})\s*=\s*"
        r"(?:@?\$_(GET|POST|REQUEST|COOKIE|FILES)\b|filter_input\s*\(|filter_var\s*\(|"
        r"Request\.(?:Form|QueryString|Params|Cookies)\s*\[)"
        r"[\s\S]{0,500}?\b(eval|assert|system|exec|shell_exec|passthru)\b"
        r"\s*(?:/\*[\s\S]{0,80}?\*/\s*)*\(\s*(?:\w+\s*\(\s*){0,3}\$\1\b",
        "is",
        need=("$_ filter_input filter_var request.", "eval assert system exec passthru"),
    ),
    Signature(
        "behavior_filterinput_exec",
        r"(filter_input\s*\(|filter_var\s*\(|Request\.(?:Form|QueryString|Params|Cookies)\s*\[)"
        r"[\s\S]{0,350}?\b(eval|assert|system|exec|shell_exec|passthru)\b"
        r"\s*(?:/\*[\s\S]{0,80}?\*/\s*)*\(",
        "is",
        need=("filter_input filter_var request.", "eval assert system exec passthru"),
    ),
    Signature(
        "behavior_sqlmap_uploader",
        r"(sqlmap\s+file\s+uploader|File\s+uploaded|MAX_FILE_SIZE)"
        r"[\s\S]{0,1200}?(move_uploaded_file|\$_FILES|\$HTTP_POST_FILES)",
        "is",
        need=("uploader uploaded max_file_size", "move_uploaded_file $_files $http_post_files"),
    ),
    Signature(
        "behavior_arbitrary_upload_path",
        r"""\$\w{1,20}\s*=\s*\$_(REQUEST|POST|GET)\s*\[\s*["']uploadDir["']\s*\]"""
        r"[\s\S]{0,600}?move_uploaded_file",
        "is",
        need=("uploaddir", "move_uploaded_file"),
    ),
)

# Framework fingerprints in priority order: the first one found names the framework.
FRAMEWORKS: tuple[tuple[str, str], ...] = (
    ("cakephp", r"namespace\s+Cake\\|class\s+\w+\s+extends\s+AppController|use\s+Cake\\"),
    ("joomla", r"""defined\s*\(\s*["']_JEXEC["']|JFactory::|jimport\s*\(|class\s+\w+\s+extends\s+JController"""),
    ("k2", r"""K2HelperUtilities|class\s+K2\w+|JTable::getInstance\s*\(\s*["']K2"""),
    ("elfinder", r"class\s+elFinder|elFinder::.*?driver|connector\.php.*?elFinder"),
    ("wordpress", r"""defined\s*\(\s*["']ABSPATH["']|get_option\s*\(|wp_enqueue_script|add_action\s*\("""),
    ("drupal", r"drupal_bootstrap|module_invoke|drupal_get_path|db_query"),
    ("laravel", r"namespace\s+App\\|use\s+Illuminate\\|class\s+\w+\s+extends\s+Controller"),
    ("symfony", r"namespace\s+Symfony\\|use\s+Symfony\\|extends\s+ContainerAware"),
    ("sharepoint", r"Microsoft\.SharePoint|SPWeb|SPSite|ApplicationPage"),
    ("jquery", r"jQuery\.fn\.jquery|@version\s+\d+\.\d+\.\d+.*?jQuery"),
    ("angular", r"angular\.module\(|ng-app|@angular/core"),
    ("react", r"""React\.createElement|from\s+["']react["']|@jsx"""),
    ("vue", r"new\s+Vue\(|Vue\.component|@vue/cli"),
)
# End of the fixed values.

# Pre-tests for the fingerprints, as ``need`` above.
FRAMEWORK_NEEDS: dict[str, tuple[str, ...]] = {
    "cakephp": ("cake\\ appcontroller",),
    "joomla": ("_jexec jfactory:: jimport jcontroller",),
    "k2": ("k2",),
    "elfinder": ("elfinder",),
    "wordpress": ("abspath get_option wp_enqueue_script add_action",),
    "drupal": ("drupal_bootstrap module_invoke drupal_get_path db_query",),
    "laravel": ("app\\ illuminate\\ controller",),
    "symfony": ("symfony\\ containeraware",),
    "sharepoint": ("microsoft.sharepoint spweb spsite applicationpage",),
    "jquery": ("jquery",),
    "angular": ("angular ng-app",),
    "react": ("react @jsx",),
    "vue": ("vue",),
}

BY_COLUMN: dict[str, Signature] = {s.column: s for s in SIGNATURES}
