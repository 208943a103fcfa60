"""Near duplicates, repeated passages and the indexes below them."""

import random

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.llm import helpers as H
from vigilrow.llm import catalog, neardup, substring
from vigilrow.llm.components import components
from vigilrow.llm.fmindex import FMIndex
from vigilrow.llm.wavelet import WaveletMatrix


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def family(seed=5, members=40, size=60):
    """Chains and crowds around the threshold: edited copies of a few texts."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = []
    for base in range(4):
        words = [r.choice(vocabulary) for _ in range(size)]
        for _ in range(members // 4):
            words = list(words) if r.random() < 0.5 else list(rows[-1][1].split()) if rows else list(words)
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((len(rows) * 3 + base, " ".join(words)))
    return rows


def test_query_equals_brute_force(spark):
    want = H.components(documents(spark))
    got = {r["doc_id"]: r for r in catalog.QUERIES["op8_minmax_near_duplicates"](spark, SMALL).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


@pytest.mark.parametrize("block", [256, 3])
def test_families_around_the_threshold(spark, block):
    rows = family()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, block=block).collect()}
    assert got == {i: c for i, (_, c) in H.components(rows).items()}


def test_repeated_ids_lose_no_link_and_no_row(spark):
    r = random.Random(4)
    word = lambda: f"v{r.randrange(10**6)}"
    a, b, c = ([word() for _ in range(60)] for _ in range(3))
    near_b = [*b, word(), word()]
    rows = [(7, a), (7, b), (9, near_b), (7, a), (11, c), (11, [*c, word()]), (12, near_b), (3, []), (3, []), (4, None), (None, a)]
    for order in range(2):
        df = spark.createDataFrame([(i, None if w is None else " ".join(w), order, 1) for i, w in rows[:: 1 - 2 * order]], "doc_id long, text string, own_hash int, KEPT_ID int")
        got = {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(df).collect()}
        assert got == {(7, 56, 7), (9, 58, 7), (11, 56, 11), (11, 57, 11), (12, 58, 7), (3, 0, 3), (4, 0, 4), (None, 56, 7)}
        left = sorted((x["doc_id"] or -1, x["text"] or "") for x in neardup.keep_one(df).collect())
        kept_11 = [t for i, t in left if i == 11]
        assert len(kept_11) == 1 and kept_11[0].startswith(" ".join(c))
        assert [x for x in left if x[0] != 11] == sorted([(7, " ".join(a)), (7, " ".join(b)), (3, ""), (3, ""), (4, ""), (-1, " ".join(a))])
        assert neardup.keep_one(df).columns == df.columns


def passage_in_texts(seed=1, groups=3, short=60):
    """Short texts with parts of a passage, small ids first, then two long ones that only each other resembles."""
    r = random.Random(seed)
    word = lambda: f"v{r.randrange(10**6)}"
    rows = []
    for g in range(groups):
        passage, parts = [word() for _ in range(84)], []
        for _ in range(short):
            k = r.randrange(65)
            parts.append(passage[:k] + passage[k + 20 :])
        parts += [[word() for _ in range(5)] + passage + [word() for _ in range(5)] for _ in range(2)]
        rows += [(1000 * g + k, " ".join(words)) for k, words in enumerate(parts)]
    return rows


def test_one_passage_in_texts_of_different_lengths(spark):
    rows = passage_in_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    want = {i: c for i, (_, c) in H.components(rows).items()}
    assert all(want[1000 * g + 61] == 1000 * g + 60 for g in range(3))
    assert got == want


def test_near_duplicates_of_awkward_rows(spark):
    got = neardup.near_duplicates(H.awkward(spark)).collect()
    assert len(got) == 16
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by_id[5]["component_id"] == 4 and not by_id[5]["kept"]
    assert by_id[7]["component_id"] == 6 and by_id[1]["component_id"] == 1 and by_id[1]["n_shingles"] == 0
    assert by_id[2]["kept"] and by_id[3]["kept"] and by_id[6]["n_shingles"] == 1
    assert neardup.near_duplicates(H.empty(spark)).count() == 0
    kept = neardup.keep_one(H.awkward(spark))
    assert kept.columns == H.awkward(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [-5, 1, 2, 3, 4, 6, 8, 9, 10, 11, 2**62]


def test_min_max_estimates_similarity():
    r = np.random.default_rng(1)
    factors = neardup._multipliers(256)
    for share in (0.3, 0.75, 0.95):
        both = r.integers(0, 2**63, int(2000 * share), dtype=np.uint64)
        a, b = (np.concatenate([both, r.integers(0, 2**63, 1000 - int(1000 * share), dtype=np.uint64)]) for _ in range(2))
        true = len(both) / (len(a) + len(b) - len(both))
        got = (neardup.min_max_signature(a, factors) == neardup.min_max_signature(b, factors)).mean()
        assert abs(got - true) < 0.08


def test_components_of_a_path_a_star_and_loops(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeats_query_equals_brute_force(spark):
    got = {r[0]: tuple(r)[1:] for r in catalog.QUERIES["op6_fm_index_dedup"](spark, SMALL).collect()}
    assert got == H.cut_words(documents(spark))


def test_repeats_with_hot_anchors_and_small_shards(spark):
    r = random.Random(2)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{r.random()}" for _ in range(8)] + passage[r.randint(0, 20) : r.randint(30, 60)] + [f"b{i}"] * 20)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x[0]: tuple(x)[1:] for x in substring.digest(df, shard_words=300, hot=5).collect()}
    assert got == H.cut_words(rows)


def test_repeats_of_awkward_rows(spark):
    got = substring.digest(H.awkward(spark)).collect()
    assert len(got) == 16
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by_id[4]["n_removed"] == 0 and by_id[5]["n_removed"] == by_id[5]["n_words"] == 30_000
    assert by_id[1]["n_words"] == by_id[2]["n_words"] == 0 and by_id[7]["n_removed"] == 0
    assert substring.digest(H.empty(spark)).count() == 0
    cut = {r["doc_id"]: r["text"] for r in substring.without_repeats(H.awkward(spark)).collect() if r["doc_id"] is not None}
    assert cut[5] == "" and cut[4] and cut[3] == "   \n\t " and cut[1] is None


def test_passages_go_and_the_rest_stays(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, f"start one\n{passage} end one"), (2, f"start two\n{passage}\tfin  two"), (3, "nothing  shared\nhere")]
    cut = {r["doc_id"]: r["text"] for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert cut == {1: rows[0][1], 2: "start two\tfin  two", 3: rows[2][1]}


@pytest.mark.parametrize(("n", "levels"), [(0, 4), (1, 3), (200, 6), (5000, 16)])
def test_wavelet_matrix_round_trip(n, levels):
    r = np.random.default_rng(n)
    values = r.integers(0, min(1 << levels, 50), n)
    wave = WaveletMatrix.from_bytes(WaveletMatrix.of(values, levels).to_bytes())
    assert (wave.values() == values).all()
    if n:
        at, to, symbol = r.integers(0, n, 50), r.integers(0, n + 1, 50), r.integers(0, min(1 << levels, 50), 50)
        assert (wave.access(at) == values[at]).all()
        assert wave.rank(symbol, to).tolist() == [(values[:k] == c).sum() for c, k in zip(symbol, to)]
        assert wave.occurrences(int(values[0])).tolist() == np.flatnonzero(values == values[0]).tolist()


def test_wavelet_matrix_refuses_large_values():
    with pytest.raises(ValueError):
        WaveletMatrix.of(np.array([16]), 4)


def test_matching_statistics_equal_brute_force():
    r = np.random.default_rng(0)
    for _ in range(40):
        depth, most = int(r.integers(1, 6)), int(r.integers(1, 5))
        parts = [r.integers(1, most + 1, r.integers(0, 12)) for _ in range(r.integers(1, 8))]
        text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.int64)
        queries = [r.integers(1, most + 2, r.integers(0, 10)) for _ in range(5)]
        words = np.concatenate(queries).astype(np.int64)
        words[~np.isin(words, text)] = -1
        ends = np.cumsum([len(q) for q in queries])
        starts = ends - [len(q) for q in queries]
        length, row = FMIndex(text, depth).matching_statistics(words, starts, ends)
        held = {tuple(p[i : i + k]) for p in map(list, parts) for i in range(len(p)) for k in range(1, depth + 1) if i + k <= len(p)}
        for a, b in zip(starts, ends):
            for i in range(a, b):
                assert length[i] == max(k for k in range(depth + 1) if i + k <= b and (not k or tuple(words[i : i + k]) in held))


def test_streamed_segments_need_not_be_indexed():
    got = substring.first_documents([b"a b c d e", b"b c d x"], np.array([7, 3]), 3, streamed=[b"z b c d q", b"a b"])
    none = np.iinfo(np.int64).max
    assert [g.tolist() for g in got] == [[none, 3, none], []]
