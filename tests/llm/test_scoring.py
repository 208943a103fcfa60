"""Language, toxicity, licenses, benchmark passages."""

import random

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.llm import helpers as H
from vigilrow.llm import catalog, decontaminate, langid, licenses, toxicity

MEDIUM = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    got = catalog.QUERIES["op1_language_id"](spark, MEDIUM)
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows) and not any(r["rejected"] for r in rows)


def test_language_of_awkward_rows(spark):
    model = langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    got = langid.predict(H.awkward(spark).drop("score"), model).collect()
    assert len(got) == 16
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 and by_id[i]["rejected"] for i in (1, 2, 3, 11))
    assert by_id[4]["lang_pred"] != "und" and by_id[6]["score"] == by_id[7]["score"]
    with pytest.raises(ValueError):
        langid.predict(H.awkward(spark), model)
    assert langid.predict(H.empty(spark).drop("score"), model).count() == 0
    nothing = langid.fit(H.empty(spark))
    assert {r["lang_pred"] for r in langid.predict(H.awkward(spark).drop("score"), nothing).collect()} == {"und"}


def test_strange_scripts_are_rejected(spark):
    model = langid.fit(spark.read.parquet(f"{MEDIUM}/documents.parquet"))
    texts = ["Съешь ещё этих мягких французских булок " * 5, "我们的世界是一个美好的地方" * 20]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [x["rejected"] for x in langid.predict(rows, model).collect()] == [True] * 2


def test_toxicity_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    got = catalog.QUERIES["op2_toxicity"](spark, MEDIUM).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(a > b) + (a == b) / 2 for a in bad for b in good])
    assert len(bad) >= 5 and auc > 0.8


def test_toxicity_features_and_awkward_rows(spark):
    marks = toxicity.Marks(toxicity.Lexicon(frozenset({"grob"}), frozenset({"blod"})))
    at = dict(zip(toxicity.FEATURES, toxicity.features("You are an 1d10t!! SHAME blodmann grob", marks)))
    assert at["disguised_rate"] == 1 / 7 and at["learned_log"] > 0 and at["near_second_rate"] > 0 and at["caps_word_rate"] == 1 / 7 and at["repeat_rate"] > 0
    assert toxicity.features(None, marks) == toxicity.features("  ", marks) == [0.0] * len(toxicity.FEATURES)
    labels = spark.createDataFrame([], "doc_id long, label int")
    model = toxicity.fit(H.awkward(spark), labels)
    got = toxicity.score(H.awkward(spark), model).collect()
    assert len(got) == 16 and {r["score"] for r in got} == {0.0}
    assert toxicity.score(H.empty(spark), model).count() == 0


BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def test_licenses_equal_plain_search(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    extra = [(10_000, "The MIT license. Under the MIT-License, under the mit license"), (10_001, "CC BY-NC 4.0"), (10_002, None)]
    rows = [(r["doc_id"], r["text"]) for r in docs] + extra
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan(df, licenses.template_idf(df))).collect()}
    for i, text in rows:
        words = [w.decode() for w in licenses.words(text)]
        at, labels = [], set()
        for phrase, label in BASE.items():
            p = phrase.split()
            hits = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_license_templates_by_position(spark):
    texts = [
        "This work is licensed under the GNU General Public License, version 3.", "license gnu the under general licensed work version public 3",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
        "All rights reserved.", "rights all reserved",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.digest(licenses.scan(df, licenses.template_idf(df))).collect()}
    assert got == {0: "gpl-3", 1: "", 2: "mit", 3: "all-rights-reserved", 4: ""}
    assert len(licenses.digest(licenses.scan(H.awkward(spark), licenses.template_idf(H.awkward(spark)))).collect()) == 16
    assert licenses.scan(H.empty(spark), licenses.template_idf(H.empty(spark))).count() == 0


def least_edits(pattern: bytes, text: bytes) -> int:
    """Fewest edits between the pattern and any piece of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(r: random.Random, text: str, share: float) -> str:
    s = list(text)
    for _ in range(int(len(s) * share)):
        j = r.randrange(len(s))
        what = r.random()
        if what < 0.4:
            s[j] = r.choice("abcdef")
        elif what < 0.7:
            del s[j]
        else:
            s.insert(j, r.choice("xyz"))
    return "".join(s)


def test_passages_equal_full_alignment():
    r = random.Random(3)
    parts = "the of an thing er in that on re ha st nd ea ou ti es".split()
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 3)))
    items = [(k, decontaminate.fold(" ".join(word() for _ in range(r.choice([4, 12, 30]))))) for k in range(12)]
    match, found = decontaminate.matcher(items), 0
    for _ in range(40):
        text = " ".join(word() for _ in range(r.randint(0, 50)))
        if r.random() < 0.8:
            passage = edited(r, r.choice(items)[1].decode(), r.choice([0, 0.03, 0.1]))
            at = r.randint(0, len(text))
            text = text[:at] + " " + passage + " " + text[at:]
        got = {k: (n, e) for k, n, e, *_ in match(text)}
        data = decontaminate.fold(text)
        for k, item in items:
            windows = decontaminate.windows(item) if len(item) >= decontaminate.LEAST else []
            edits = [e for e, w in ((least_edits(w, data), w) for w in windows) if e <= decontaminate.budget(len(w))[0]]
            assert got.get(k) == ((len(edits), min(edits)) if edits else None)
            found += bool(edits)
    assert found > 15


def test_parts_of_items_and_short_items():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))
    items = [(k, decontaminate.fold(" ".join(word() for _ in range(n)))) for k, n in enumerate([40, 60, 13, 4, 1])]
    find = decontaminate.finder(items)
    own = [" ".join(word() for _ in range(30)) for _ in range(2)]
    size = decontaminate.PASSAGE + decontaminate.STEP - 1
    for k in (0, 1, 2):
        for at in range(len(items[k][1]) - size + 1):
            assert [x[0] for x in find(own[0] + " " + items[k][1][at : at + size].decode() + " " + own[1])] == [k]
    for k in (3, 4):
        held = items[k][1].decode()
        text = f"{own[0]} {held.upper()}, {own[1]}"
        at = decontaminate.fold(text).index(items[k][1])
        assert find(text) == [(k, 1, 0, at, at + len(held))]
        assert find(f"{own[0]} {held}x {own[1]}") == find(f"{own[0]} x{held} {own[1]}") == []
    assert find(None) == find("") == find(own[0]) == []
    # Eight edits in the middle of a hundred bytes: only a long window has the budget.
    piece = bytearray(items[1][1][100:200])
    for j in range(44, 60, 2):
        piece[j] = ord("z")
    assert [x[0] for x in find(own[0] + " " + piece.decode() + " " + own[1])] == [1]


def test_passages_in_documents(spark):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    held = {(d, i) for d, t in docs for i, x in items if x in t}
    got = catalog.QUERIES["op10_benchmark_decontamination"](spark, SMALL).collect()
    assert held and held <= {(r["doc_id"], r["item_id"]) for r in got}
    clean = decontaminate.clean(spark.createDataFrame(docs, "doc_id long, text string"), benchmark)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {r["doc_id"] for r in got}
    # Eight words of an item are no leak; blocks do not change the answer.
    few = spark.createDataFrame([(1, " ".join(items[0][1].split()[:8])), (2, "Before. " + items[0][1].upper() + " After.")], "doc_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(few, benchmark).collect()} == {2}
    assert {r["doc_id"] for r in decontaminate.contaminated(few, benchmark, block_bytes=500).collect()} == {2}


def test_passages_of_awkward_rows(spark):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, "Der Hund und die Katze sind im Haus und schlafen dort jede Nacht")], "item_id long, text string")
    got = decontaminate.contaminated(H.awkward(spark), benchmark).collect()
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in got] == [(8, None, 0)]
    assert decontaminate.clean(H.awkward(spark), benchmark).count() == 15
    assert decontaminate.contaminated(H.empty(spark), benchmark).count() == 0
    assert decontaminate.contaminated(H.awkward(spark), benchmark.where("item_id = 1")).count() == 0
