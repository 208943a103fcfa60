"""Signatures: the guarded JVM form against plain Python matching."""

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import files
from vigilrow.functions import comment_runs as R
from vigilrow.functions import patterns as P
from vigilrow.functions.cookie_gate import has_cookie_gate
from vigilrow.functions.match import WORD_NUMBERS, WordFinder, python_regex
from vigilrow.functions.password_gate import has_password_gate
from vigilrow.operators import features as O
from vigilrow.sources.corpus import CASES

ODD = [
    "ſystem ($x); $_GET['a'] filler filler",
    "checK md5(@$_COOKIE['k']) == '' filler filler",
    "a\u0085eval\u001c( \u001f$_POST)\r\n filler filler",
    "\U0001F600\U0001F600 eval($_GET['a']); \U0001F600 system ( x )",
    "Fİle.Delete x; fıle.copy y; FİLE.COPY z  w",
    "new URL('x'); https://a.b/\"shell https://\"x https://c.d/cmd.txt end",
    "class a__construct eval; class b { function __construct() { exec(",
    "Plugin Name: x base64_decode y; and then nothing at all, no call",
    "Plugin Name: x base64_decode y; and then EVAL comes a bit later",
    "<form a><textarea b name = c <form enctype='multipart/form-data'><input type='file'",
    "if ($_POST[x] != 1) pass; if(strlen($a) && $_COOKIE['auth'] === $b) {} xxxx",
    "$a[1][2] $b[1][2][3] $c[1][2][3][4] $d['x']['y']['z'].filler",
    "eval /* a */ b */ ($x); eval/**//* c */(1); exec/*" + "x" * 90 + "*/(2)",
]


def expected(sig, code, norm):
    return bool(python_regex(sig).search(code if sig.scope == "raw" else norm))


def test_flags_equal_plain_matching_and_every_signature_fires(spark):
    texts = [c + "\n" + " filler text" * 3 for _, c in CASES] + ODD + ["".join(ODD)]
    rows = files(spark, *[("/a/x.php", t) for t in texts])
    df = O.with_signature_flags(O.with_searchable_text(O.with_decoded_text(rows)))
    got = df.select("code", *[s.column for s in P.SIGNATURES]).collect()
    norms = {r["code"]: r["norm"] for r in O.with_decoded_text(rows).select("code", "norm").collect()}
    fired = set()
    for row in got:
        for sig in P.SIGNATURES:
            want = expected(sig, row["code"], norms[row["code"]])
            assert row[sig.column] == want, (sig.column, row["code"][:80])
            if want:
                fired.add(sig.column)
    assert fired == set(P.BY_COLUMN)


def test_match_counts_equal_plain_matching(spark):
    texts = ODD + [c + "\n" + " filler text" * 3 for _, c in CASES]
    df = O.with_match_counts(O.with_searchable_text(O.with_decoded_text(files(spark, *[("/a/x.php", t) for t in texts]))))
    for row in df.select("norm", "exec_func_count", "input_count", "decode_func_count", "dynamic_count").collect():
        for name, regex in (
            ("exec_func_count", P.EXEC_CALL), ("input_count", P.INPUT_ACCESS),
            ("decode_func_count", P.DECODE_CALL), ("dynamic_count", P.DYNAMIC_CALL),
        ):
            assert row[name] == len(list(re.finditer(regex, row["norm"], re.I))), (name, row["norm"][:80])


PIECES = st.sampled_from(
    ["eval", "exec", " ", "/*", "*/", "a", "(", "$_GET", "Request", ".", "Form", "[", "Item", "filter_var", "$x", "=", "x", "/**/"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_comment_run_search_equals_regex(text):
    starts = [m.start() for m in re.finditer(P.EXEC_CALL, text, re.I)]
    assert [s for s, _ in R.calls(text, R._EXEC)] == starts
    assert R.inputs(text) == [m.start() for m in re.finditer(P.INPUT_ACCESS, text, re.I)]
    for column, check in (
        ("behavior_filterinput_exec", R.filter_then_exec), ("has_assign_input_then_exec", R.assign_then_exec),
    ):
        assert check(text) == bool(python_regex(P.BY_COLUMN[column]).search(text))


def test_long_comment_runs_are_counted(spark):
    run = "/*a*/" * 5000
    row = O.feature_table(files(spark, ("/a.php", f"$q = $_GET['q']; eval{run}($q); exec(1);"))).first()
    assert (row["exec_func_count"], row["input_count"], row["has_assign_input_then_exec"]) == (2, 1, 1)
    assert row["short_input_exec_distance"] == 0
    row = O.feature_table(files(spark, ("/a.aspx", f"eval{run}(1); Request{run}['a']; exec (2)"))).first()
    assert (row["exec_func_count"], row["input_count"], row["aspx_code_eval_count"]) == (1, 1, 0)


def test_hostile_texts_finish(spark):
    rows = files(
        spark, ("/1.php", "$a" + "[1]" * 50_000), ("/2.php", 'x = "' + "a\\\\b" * 50_000 + '";'),
        ("/3.php", '@"' + '""' * 50_000), ("/4.php", "/*" * 100_000), ("/5.php", "http://a.test/ " * 5000),
        ("/6.php", "<form ><textarea " * 5000), ("/7.php", "$_GET base64_decode " * 5000),
        ("/8.php", "if($_POST[pass] " * 12_000), ("/10.php", """md5($_COOKIE["k"]) === "0123456789abcdef" """ * 25_000), ("/9.php", "if(\n$_SESSION||$_POST[key]!" * 8_000),
    )
    got = {r["file_id"]: r for r in O.feature_table(rows).collect()}
    assert len(got) == 10 and got[0]["deep_array_access_count"] == 1 and got[6]["input_count"] == 5000


COOKIE = st.sampled_from(
    ["md5(", "MD5 (", "@", "$_COOKIE[", "k", "]", "])", " ) ", "==", "===", "=====", "'0123456789abcdef'", '"0123456789ABCDEF01"', "'abc'", "\n", "\x1c", "x" * 599, "$_(", "@$_ (", "$_",
     "md5($_COOKIE[", "])=='0123456789abcdef'", "md5\n($_COOKIE["]
)


@settings(max_examples=1500, deadline=None)
@given(st.lists(COOKIE, max_size=10))
def test_cookie_gate_equals_regex(pieces):
    text = "".join(pieces)
    assert has_cookie_gate(text) == bool(python_regex(P.BY_COLUMN["behavior_cookie_hash_gate_dyn_call"]).search(text))


def test_cookie_gate_takes_linear_time():
    for piece in ('md5($_COOKIE["k"]) === "0123456789abcdef" ', "md5($_COOKIE[", "])=='0123456789abcdef'", "md5(" + " " * 50, "])" + " " * 50, "$_" + " " * 50):
        text = piece * (1_000_000 // len(piece))
        start = time.time()
        assert not has_cookie_gate(text)
        assert time.time() - start < 5


GATE = st.sampled_from(
    ["if", "if(", "if (", "(", ")", "$_POST[", "$_COOKIE[", "pass", "key", "]", "] ", "==", "===", "!=", "!==", "=", "!", "$x", " $a",
     "$_SESSION", "||", "|", "\n", " ", "x", "if\n(", "IF( ", "||$_POST[", "\x1c"]
)


@settings(max_examples=1500, deadline=None)
@given(st.lists(GATE, max_size=9), st.booleans(), st.lists(GATE, max_size=6))
def test_password_gate_equals_regex(before, framed, after):
    text = ("if(" if framed else "") + "".join(before) + ("$_POST[pass" if framed else "") + "".join(after)
    assert has_password_gate(text) == bool(python_regex(P.BY_COLUMN["behavior_password_backdoor"]).search(text))


def test_flags_do_not_depend_on_partitioning(spark):
    rows = files(spark, *[("/a/x.php", c + " filler text" * 3) for _, c in CASES])
    one = O.feature_table(rows.coalesce(1)).orderBy("file_id").collect()
    many = O.feature_table(rows.repartition(7)).orderBy("file_id").collect()
    assert one == many
    for r in one:
        assert 0 <= r["overall_threat_score"] <= 1 and 0 <= r["stealth_score_enhanced"] <= 1
        assert r["exec_func_count"] >= r["has_exec_function"]


def test_no_row_waits_for_python(spark):
    # A Python column keeps whole rows, texts and all, in a queue that goes to disk.
    for df in (O.feature_table(files(spark, ("/a.php", "x" * 30))), O.with_match_counts(O.with_searchable_text(O.with_decoded_text(files(spark, ("/a.php", "x" * 30)))))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and plan.count("MapInArrow") == 1


def test_words_of_pre_tests_are_found():
    finder = WordFinder()
    for _, code in CASES:
        folded = code.lower()
        assert sorted(finder(folded)) == sorted(n for w, n in WORD_NUMBERS.items() if w in folded)


def test_long_base64_is_counted_where_a_word_is_long(spark):
    texts = ["a" * 79 + " " + "b" * 79, "a" * 80 + "\n" + "b/" * 45 + "==" + "c" * 80, "'" + "A+" * 40 + "'", "\\x41" * 80]
    df = O.with_signature_flags(O.with_searchable_text(O.with_decoded_text(files(spark, *[("/a", t) for t in texts]))))
    assert [r[0] for r in df.orderBy("file_id").select("long_base64_count").collect()] == [0, 3, 1, 1]


def test_shared_tables_are_written_without_a_queue(spark, monkeypatch):
    # The evidence and the features that verdicts, reports and training read.
    from tests.conftest import SMALL
    from vigilrow.plans import catalog as C

    plans = {}
    monkeypatch.setattr(C, "_TABLES", {})
    monkeypatch.setattr(C, "materialize", lambda df, label: plans.setdefault(label, df))
    C.evidence(spark, SMALL), C.evidence(spark, SMALL, True), C.features(spark, SMALL)
    assert sorted(plans) == ["evidence", "evidence_all", "features"]
    for df in plans.values():
        plan = df._jdf.queryExecution().executedPlan().toString()
        # One pass through Python; nothing is shuffled but the dealing out of a small table.
        assert "EvalPython" not in plan and plan.count("MapInArrow") == 1 and plan.count("Exchange") <= 1
