"""Shards, fingerprints, token files, packing, and the whole pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tests.llm import helpers as H
from vigilrow.llm import catalog, lempelziv, packing, sharding, tokenstore


def plain_minimax(sizes, shards=16):
    def fits(capacity):
        used, room = 1, capacity
        for size in sizes:
            if size > capacity:
                return False
            if size > room:
                used, room = used + 1, capacity
            room -= size
        return used <= shards

    low, high = 1, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def check_shards(rows, texts):
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in texts)
    by_text = {}
    for r in rows:
        text = dict(texts)[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
        assert by_text.setdefault(text, r["shard"]) == r["shard"]
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def test_shards_are_minimax(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = catalog.QUERIES["op3_minimax_shards"](spark, SMALL).collect()
    check_shards(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["law"] for r in rows} == {"bytes"} and all(0 <= r["shard"] < 16 for r in rows)
    groups = docs.groupBy(F.xxhash64("text").alias("key")).agg(F.sum(F.octet_length("text") + 1).alias("n")).orderBy("key").collect()
    largest = max(sum(r["size"] for r in rows if r["shard"] == k) for k in range(16))
    assert largest == plain_minimax([g["n"] for g in groups])


@pytest.mark.parametrize("seed", range(4))
def test_cuts_equal_plain_search(spark, seed):
    r = random.Random(seed)
    near = r.choice([0, 1 << 40])
    groups = sorted({(near + r.randrange(1 << 20)) if near else r.randrange(-(2**63), 2**63): r.choice([1, 5, 1000]) for _ in range(200)}.items())
    table = spark.createDataFrame(groups, "key long, size long")
    capacity, cuts = sharding.minimax_cuts(table, 7)
    assert capacity == plain_minimax([n for _, n in groups], 7)
    sums = [sum(n for k, n in groups if a < k <= b) for a, b in zip([-(2**63) - 1, *cuts], [*cuts, 2**63])]
    assert len(sums) <= 7 and max(sums) == capacity


def test_shards_of_awkward_rows(spark):
    rows = sharding.shard(H.awkward(spark)).collect()
    assert len(rows) == 16 and all(r["size"] == 1 and r["text_crc32"] == 0 for r in rows if r["doc_id"] in (1, 2))
    assert len({r["shard"] for r in rows if r["doc_id"] in (6, 7)}) == 1
    assert sharding.shard(H.empty(spark)).count() == 0


def plain_fingerprints(rows):
    key = lambda r: (r[0] is None, -(r[0] or 0), r[1])
    rows = sorted(((i, t or "") for i, t in rows), key=key)
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 3
        copy = text[: len(text) - cut] + following[:cut]
        a, b, c = map(lempelziv.fingerprint, (text, copy, following))
        out.append((i, len(text), hashlib.sha256(copy.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), lempelziv.likeness(a, b), lempelziv.likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [1, 7, None])
def test_fingerprints_equal_plain_walk(spark, blocks):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = lempelziv.compare_with_next(docs, blocks=blocks).collect()
    want = plain_fingerprints([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, got), key=str) == want
    assert np.mean([w[5] > w[6] for w in want]) > 0.95


def test_fingerprints_of_awkward_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in H.awkward(spark).collect()]
    assert sorted(map(tuple, lempelziv.compare_with_next(H.awkward(spark), blocks=4).collect()), key=str) == plain_fingerprints(rows)
    assert lempelziv.compare_with_next(H.empty(spark)).count() == 0
    one = spark.createDataFrame([(5, "abcabcabc")], "doc_id long, text string")
    assert lempelziv.compare_with_next(one).first()["near_next"] == 1.0
    same = {r["doc_id"]: r["fingerprint"] for r in lempelziv.fingerprints(H.awkward(spark)).collect()}
    assert same[4] == same[5] and same[6] == same[7] != same[8] and same[1] == same[2]


def whole_ids(path, rows, end):
    encoder = Tokenizer.from_file(path)
    return {i: np.array([*e.ids, end], "<u4") for (i, _), e in zip(rows, encoder.encode_batch([t or "" for _, t in rows], add_special_tokens=False))}


@pytest.mark.parametrize(("make", "file"), [("byte_encoder", "byte_bpe_50k.json"), ("word_encoder", "word_bpe_49k.json")])
def test_pieces_encode_like_whole_texts(make, file):
    import public_tokenizers

    encoder = getattr(catalog, make)()
    r = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\xa0", "\x1c", "\x85", "a", "B", "'s", "é", "é", "1", "23", "!", "　", "中", "the", "Σ", "ΑΣ", "​", "İ", "ͅ", " \n ", "ﬁ", "\U0001f600"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    plain = Tokenizer.from_file(public_tokenizers.path(file))
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    encoder.most = 50
    assert [x for at in range(0, 3000, 100) for x in encoder.encode(texts[at : at + 100])] == want
    assert encoder.encode([None]) == [b""]


@pytest.mark.parametrize(("make", "file"), [("byte_encoder", "byte_bpe_50k.json"), ("word_encoder", "word_bpe_49k.json")])
@pytest.mark.parametrize("block", [1, 50, 1 << 20])
def test_columns_of_texts_encode_like_whole_texts(make, file, block):
    """Texts that lie next to each other in memory do not touch each other, whatever the blocks; slices and nulls too."""
    import public_tokenizers
    import pyarrow as pa

    encoder = type(getattr(catalog, make)())(public_tokenizers.path(file), " | " if make == "word_encoder" else "\n", make == "word_encoder", most=20)
    texts = ["skipped", "a  ", "b", None, "", "c\n", "d", "x" * 500, "x" * 500, "I", "\u0307", "don't", "'", "s", " ", "e", "H", "\u0331", "(a|b)", " | ", "x\xd7y \xf7"] * 3
    rows = [(k, t) for k, t in enumerate(texts[1:])]
    ids, ends = encoder.column(pa.array(texts).slice(1), 7, block)
    want = whole_ids(public_tokenizers.path(file), rows, 7)
    assert [part.tolist() for part in np.split(ids, ends[:-1])] == [want[k].tolist() for k, _ in rows]
    ids, ends = encoder.column(pa.array([], pa.string()), 7, block)
    assert len(ids) == len(ends) == 0


@pytest.mark.parametrize("shard_tokens", [2_000, 2_000_000])
def test_token_files_round_trip(spark, shard_tokens):
    import public_tokenizers

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    path = tokenstore.write(docs, catalog.byte_encoder, 0, shard_tokens=shard_tokens)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenstore.digest(spark, path).collect()}
    start, want = 0, {}
    for i, ids in whole_ids(public_tokenizers.path("byte_bpe_50k.json"), rows, 0).items():
        want[i] = start, len(ids), zlib.crc32(ids.tobytes())
        start += len(ids)
    assert got == want


def test_token_files_of_awkward_rows(spark):
    path = tokenstore.write(H.awkward(spark), catalog.byte_encoder, 0, shard_tokens=1000)
    got = tokenstore.digest(spark, path).collect()
    assert len(got) == 16 and sorted(r["n_tokens"] for r in got)[:3] == [1, 1, 1]
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert tokenstore.digest(spark, tokenstore.write(H.empty(spark), catalog.byte_encoder, 0)).count() == 0


def test_ids_of_whole_documents_stay_in_the_task(spark):
    path = tokenstore.write(H.awkward(spark), catalog.byte_encoder, 0, shard_tokens=1000)
    place = lambda r: (r["part"], r["seq"], r["first"])
    plain = {place(r): r for r in tokenstore.pieces(spark, path).collect()}
    summed = {place(r): r for r in tokenstore.pieces(spark, path, sums=True).collect()}
    assert plain.keys() == summed.keys()
    whole = 0
    for at, r in summed.items():
        ids = plain[at]["ids"]
        if len(ids) == 4 * r["doc_tokens"]:
            whole += 1
            assert (r["ids"], r["ids_crc32"]) == (None, zlib.crc32(ids))
        else:
            assert (r["ids"], r["ids_crc32"]) == (ids, None)
    assert 0 < whole < len(summed)


def check_pieces(rows, ids, window=4096):
    sequences = {}
    for i, expect in ids.items():
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(expect)
            assert r["ids_crc32"] == zlib.crc32(expect[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(expect)
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@pytest.mark.parametrize("shard_tokens", [20_000, 4_000_000])
def test_packing_places_each_id_once(spark, shard_tokens):
    import public_tokenizers

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packing.pack(docs, catalog.word_encoder, 2, shard_tokens=shard_tokens).collect()
    ids = whole_ids(public_tokenizers.path("word_bpe_49k.json"), [(r["doc_id"], r["text"]) for r in docs.collect()], 2)
    assert check_pieces(rows, ids) == 0


def test_packing_of_awkward_rows(spark):
    rows = packing.pack(H.awkward(spark), catalog.word_encoder, 2).collect()
    assert sum(r["start"] == 0 for r in rows) == 16
    assert packing.pack(H.empty(spark), catalog.word_encoder, 2).count() == 0


def test_seed_gets_its_nearest_documents():
    docs = [np.array(d) for d in ([1, 2, 3, 4], [9, 9, 8], [1, 2, 3, 5], [8, 7, 9])]
    shelf = packing.Shelf(docs, np.ones(10), 3.5)
    assert packing.fill([4, 3, 4, 3], shelf.scores, window=8)[0] == [(0, 0, 4), (2, 0, 4)]


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert set(kept["language"]) == {i for i, _ in rows}
    assert set(kept["near_duplicates"]) == {c for _, c in H.components(rows).values()}
    left = H.cut_words([(i, t) for i, t in kept["near_duplicates"].items()])
    assert {i: hashlib.sha256(" ".join(H.WORD.findall(t)).encode()).hexdigest() for i, t in kept["repeated_passages"].items()} == {i: w[2] for i, w in left.items()}
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert not any(x in t for x in items for t in kept["benchmark_leaks"].values())
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in pieces} == set(kept["benchmark_leaks"])


def test_pipeline_stages_take_empty_and_awkward_tables(spark):
    import corpus_pipeline

    from pyspark.sql import functions as F

    clashing = ["score", "rejected", "n_grams", "lang_pred", "cut_id", "cut_text", "CUT_KEY", "kept_id", "own_hash", "label", "node", "text_hash", "set_key", "n_shingles", "item_id", "ids"]
    for docs in (H.empty(spark), H.awkward(spark)):
        docs = docs.drop("score").withColumns({c: F.lit(k) for k, c in enumerate(clashing)})
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            if name != "windows":
                docs = corpus_pipeline.materialize(docs, f"awkward-{name}")
                assert docs.columns == columns
        docs.count()


class Counted:
    """A tokenizer that notes how many texts each call gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.calls.append(len(texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_encoder_bounds_what_it_holds(monkeypatch):
    """Few results of the library at a time, and no more pieces kept than the pipeline asks for."""
    encoder = catalog.word_encoder(most=2_000)
    counted = Counted(encoder.tokenizer)
    monkeypatch.setattr(encoder, "tokenizer", counted)
    text = " ".join(f"w{k}x{k % 89}" for k in range(20_000)) + "\u00a0 \u2003".join("ab" for _ in range(500))
    (ids,) = encoder.encode([text])
    assert max(counted.calls) <= 64 and sum(counted.calls) > 64
    whole = counted.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == whole
    assert len(encoder.number) <= 2_000
