"""Hard negatives, periodic runs and personal data against plain versions."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SMALL
from tests.llm import helpers as H
from vigilrow.llm import catalog, negatives, periodic, pii

# --- hard negatives ------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1, 1), (77, 131, 201), (64, 64, 64), (5, 0, 3), (33, 65, 40), (256, 64, 300)])
@pytest.mark.parametrize("span", [200, 2**62])
def test_products_are_exact_modulo_two_to_64(shape, span):
    r = np.random.default_rng(1)
    m, k, n = shape
    a, b = r.integers(-span, span, (m, k)), r.integers(-span, span, (k, n))
    assert (negatives.multiply(a, b, leaf=8) == a @ b).all()


def plain_negatives(rows, step, size=5):
    """Rows are (id, vector, label); each row stands for itself."""
    sound = [
        (i, [math.floor(256 * float(x)) for x in v], c)
        for i, v, c in rows
        if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for k, (i, v, c) in enumerate(sound):
        if i % step:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, d) for m, (j, w, d) in enumerate(sound) if m != k]
        for s, j, _ in sorted(t for t in scored if t[2] == c)[:size]:
            window = sorted(t for t in scored if t[2] != c and 80 * -s <= 100 * -t[0] <= 100 * -s)[:size]
            out += [(i, j, n + 1, t[1], -s, -t[0]) for n, t in enumerate(window)]
    return sorted(out)


def mined(spark, rows, step=3, **more):
    df = spark.createDataFrame([(i, v, c, 1, "x") for i, v, c in rows], "vec_id long, embedding array<float>, label int, score int, anchor string")
    got = negatives.hard_negatives(df, lambda ident: ident % step == 0, **more).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


def test_negatives_equal_brute_force(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, [float(np.float32(r.gauss(0.3, 0.5))) for _ in range(r.choice([9, 9, 9, 4]))], r.randrange(3)) for i in range(150)]
    rows += [(i, [0.5] * 9, 1) for i in range(150, 190)]  # one vector that many rows share
    rows += [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")], 1), (203, [float("inf")], 2), (204, [1.0], None), (None, [1.0], 1)]
    rows += [(210, [], 1), (0, [0.5] * 9, 1), (0, [0.5] * 9, 1), (-3, [1.0] * 9, 2), (2**62, [0.25] * 9, 0)]
    assert mined(spark, rows) == plain_negatives(rows, 3)
    # Many tiles: the same rows.
    monkeypatch.setattr(negatives, "ANCHOR_TILE", 16)
    monkeypatch.setattr(negatives, "CANDIDATE_TILE", 32)
    assert mined(spark, rows) == plain_negatives(rows, 3)


def test_negatives_of_small_tables(spark):
    assert mined(spark, []) == []
    # An anchor with a window, one whose positive has a negative score, one without a positive.
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.0], 1), (2, [0.8, 0.0], 0), (3, [0.0, 1.0], 5), (4, [0.0, -1.0], 5), (5, [0.0, -0.9], 4), (6, [0.0, 0.5], 7)]
    assert mined(spark, rows) == plain_negatives(rows, 3) == [(0, 1, 1, 2, 256 * 230, 256 * 204)]


# --- periodic runs -------------------------------------------------------------------


def plain_runs(w, least=6, exponent=4):
    """Every period in turn: stretches of words equal to the one a period on."""
    number = {}
    ids, found = np.array([number.setdefault(x, len(number)) for x in w]), {}
    for q in range(1, len(w) // exponent + 1):
        equal = np.concatenate([[0], ids[:-q] == ids[q:], [0]])
        step = np.diff(equal)
        for i, j in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_digest(doc_id, text):
    w = H.WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (
        doc_id, len(runs), *(top or (None, None, None)), top and 1000 * top[1] // top[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=50), st.integers(1, 5), st.lists(st.integers(0, 3), max_size=8))
def test_runs_equal_a_scan_of_every_period(words, times, tail):
    words = words * times + tail
    assert periodic.runs(words) == plain_runs(words)
    text = " ".join("abcd"[w] for w in words).encode()
    assert periodic.text_runs(np.frombuffer(text, np.uint8))[2] == plain_runs(words)


def test_run_digests_equal_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in catalog.QUERIES["op12_maximal_pair_runs"](spark, SMALL).collect()]
    want = [plain_digest(*d) for d in docs]
    assert sorted(got) == sorted(want) and sum(row[1] for row in want) > 5


def test_runs_of_awkward_tables(spark):
    def rows(df):
        return [tuple(r) for r in periodic.digest(periodic.periodic_runs(periodic.with_planted_tails(df))).collect()]

    assert rows(H.empty(spark)) == []
    docs = H.awkward(spark)
    key = lambda r: (str(r[0]), r[7])
    assert sorted(rows(docs), key=key) == sorted((plain_digest(r["doc_id"], r["text"]) for r in docs.collect()), key=key)


def test_long_periodic_texts_finish():
    for words, want in (([0] * 100_000, [(0, 100_000, 1)]), ([i % 7 for i in range(100_000)], [(0, 100_000, 7)])):
        start = time.time()
        assert periodic.runs(words) == want
        assert time.time() - start < 30


# --- personal data -------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_identifiers(text):
    def digits(m):
        return re.sub(r"[^0-9]", "", m[0])

    def checks(number):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(number))) % 10 == 0

    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and checks(digits(m))]
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


@settings(max_examples=1000, deadline=None)
@given(st.one_of(*(st.text(alphabet=a, max_size=60) for a in ("ab@.-_", "12. -+()0", "a@b.c_ 1", "0123456789- ", "+1 ().-2345"))))
def test_plain_identifiers_equal_their_patterns(text):
    assert pii.identifiers(text) == plain_identifiers(text)


DISGUISES = [
    ("write to {} now", "jane dot doe at example dot com", "email", "jane.doe@example.com"),
    ("write to {} now", "jane(at)site.org", "email", "jane@site.org"),
    ("{}, please", "jane [at] mail [dot] example [dot] org", "email", "jane@mail.example.org"),
    ("mail {}!", "bob@example[.]com", "email", "bob@example.com"),
    ("mail {}!", "јоhn@exаmple.com", "email", "john@example.com"),
    ("mail {}!", "john​@exam​ple.com", "email", "john@example.com"),
    ("mail {}!", "ｊａｎｅ＠ｓｉｔｅ．ｏｒｇ", "email", "jane@site.org"),
    ("host {} is up", "192[.]168[.]1[.]10", "ip", "192.168.1.10"),
    ("host {} is up", "10 dot 0 dot 0 dot 1", "ip", "10.0.0.1"),
    ("host {} is up", "one nine two dot one six eight dot zero dot one", "ip", "192.168.0.1"),
    ("pay {} today", "four one one one one one one one one one one one one one one one", "card", "4111111111111111"),
    ("pay {} today", "４１１１ １１１１ １１１１ １１１１", "card", "4111 1111 1111 1111"),
    ("pay {} today", "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", "card", "4111111111111111"),
    ("call {} today", "plus four nine three zero one two three four five six seven", "phone", "+49301234567"),
    ("call {} today", "+33\xa01\xa023\xa045\xa067\xa089", "phone", "+33 1 23 45 67 89"),
    ("call {} today", "+٤٩ 30 1234567", "phone", "+49 30 1234567"),
]


@pytest.mark.parametrize("frame, hidden, kind, plain", DISGUISES)
def test_disguises_map_back_to_the_source(frame, hidden, kind, plain):
    for text in (frame.format(hidden), "naïve​ words\xa0first… " + frame.format(hidden) + " — at last"):
        start = text.index(hidden)
        assert ((kind, start, start + len(hidden)), plain) in pii.disguised(text)
        assert not set(pii.identifiers(text)) & {(kind, start, start + len(hidden))}


@pytest.mark.parametrize(
    "text",
    ["We met at noon.", "Look at example.com for more", "look at this dot here", "one or two of them, three at most", "at a point in time", "Zwei und drei sind fünf", "from 2010–2015", "on page 7, 8 and nine"],
)
def test_plain_prose_stays_clean(text):
    assert pii.disguised(text) == []


def test_personal_data_query_and_awkward_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]

    def want(doc_id, text):
        base = plain_identifiers(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        return (doc_id, *(sum(s[0] == k for s in base) for k in pii.KINDS), hashlib.sha256(joined.encode()).hexdigest())

    got = catalog.QUERIES["op13_deobfuscated_pii"](spark, SMALL).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(want(*d) for d in docs) and sum(sum(tuple(r)[1:5]) for r in got) > 3
    texts = dict(docs)
    for r in got:
        base = {f"{k}:{a}:{b}" for k, a, b in plain_identifiers(texts[r["doc_id"]] or "")}
        assert base <= set(filter(None, r["spans"].split(",")))
    for df in (H.awkward(spark), H.empty(spark)):
        found = pii.digest(pii.scan(df)).collect()
        assert sorted(map(str, (tuple(r)[:6] for r in found))) == sorted(str(want(r["doc_id"], r["text"])) for r in df.collect())


@pytest.mark.parametrize("piece", ["a", "a@", "1", "1.", "+1 ", "a dot ", "one ", "one dot ", " ", "( ", "a at ", "a.", "1 dot ", "[dot]", "a[at]b"])
def test_hostile_texts_take_linear_time(piece):
    text = piece * (200_000 // len(piece))
    start = time.time()
    pii.identifiers(text)
    pii.disguised(text)
    assert time.time() - start < 10
