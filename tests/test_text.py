"""Text clean-up against plain Python."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import files
from vigilrow.functions.shape import _measure
from vigilrow.operators import features as O
from vigilrow.operators import ngram as N

TEXTS = [
    r'\x41B "a\\"b" tail',
    r"\x41 decoded in two steps 😀 end of it",
    'say "one" and \'two\' // gone "x"\nnext # also gone\n<%-- c --%>/* b */ end',
    '@"a""b" @"open ""pair"" x" and "lone \\ slash" \'q\' "un',
    '@"a"" then @"b" more "text" here',
    "/* never closed /* x */ y /* z",
    "line\r\nline\rline line\x85line\x0b",
    "é²½١ 　 \U0001F600 _-",
]


def decoded(text):
    text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
    text = re.sub(r"\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), text)
    return re.sub("[\ud800-\udfff]", "�", text)


def test_escapes(spark):
    for row in O.with_decoded_text(files(spark, *[("/a", t) for t in TEXTS])).collect():
        assert row["norm"] == decoded(row["code"])


def test_strip(spark):
    verbatim = re.compile(r'@"(?:[^"]|"")*"', re.S)
    quoted = re.compile(r"""("(?:\\\\.|[^"\\])*"|'(?:\\\\.|[^'\\])*')""", re.S)
    for row in O.with_stripped_text(files(spark, *[("/a", t) for t in TEXTS])).collect():
        text = row["code"]
        for pattern in (r"<%--[\s\S]*?--%>", r"/\*[\s\S]*?\*/", r"//[^\n]*", r"#[^\n]*"):
            text = re.sub(pattern, " ", text)
        held = sum(len(m[0]) for m in verbatim.finditer(text))
        text = verbatim.sub(" ", text)
        held += sum(len(m[0]) for m in quoted.finditer(text))
        assert row["stripped"] == quoted.sub(" ", text)
        assert math.isclose(row["string_literal_ratio"], held / len(row["code"]))


def test_shape():
    for text in TEXTS:
        chars, lines, entropy, digits, symbols, spaces, *_ = _measure(text, "")
        assert chars == len(text) and lines == len(text.splitlines())
        assert digits == sum(c.isdigit() for c in text) and spaces == sum(c.isspace() for c in text)
        assert symbols == sum(not c.isalnum() and not c.isspace() for c in text)
        shares = [n / len(text) for n in Counter(text).values()]
        assert math.isclose(entropy, -sum(p * math.log2(p) for p in shares))
    assert _measure("", "")[:3] == (1, 1, 0.0)


def test_training_view_labels_base64_by_length(spark):
    cases = [(198, 2), (199, 1), (200, 0), (498, 2), (499, 0), (500, 0), (1998, 2), (1999, 0), (1999, 1), (2500, 2)]
    texts = ["x: " + "A" * run + "=" * pad + " ;" for run, pad in cases]
    for row in N.training_view(files(spark, *[("/a", t) for t in texts])).collect():
        run = re.search(r"[A-Za-z0-9+/]{200,}={0,2}", row["code"])
        size = len(run[0]) if run else 0
        want = "GT2K" if size >= 2000 else "500_2K" if size >= 500 else "200_500" if size else "A" * 150
        assert want in row["clean"], row["code"][-10:]


def test_ngram_terms():
    char = N.count_terms("Ab  Éc", N.Block("char", (3, 4), 10, 1, 1.0))
    assert char == Counter(["ab ", "b e", " ec", "ab e", "b ec"])
    word = N.count_terms("One two, one_2", N.Block("word", (1, 2), 10, 1, 1.0))
    assert word == Counter(["one", "two", "one_2", "one two", "two one_2"])


def test_suffix(spark):
    names = {"/a/b.PHP": ".php", "/a/.bashrc": "", "/a/x.tar.gz": ".gz", "/a.b/c": "", "/a/..php": "", "/a/x.": ".", "/a/.x.js": ".js"}
    df = spark.createDataFrame([(n,) for n in names], "path string")
    for row in df.select("path", O.suffix_of(F.col("path")).alias("ext")).collect():
        assert row["ext"] == names[row["path"]]
