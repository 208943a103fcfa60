"""Removal of repeated passages with one FM-index per shard.

A window is ``window`` consecutive words.  A word goes if a window over it also
starts in a document with a smaller id.

Searching every document in every shard would cost documents times shards.
Instead windows are dealt to shards by content: the smallest hash among a
window's ``ANCHOR``-word runs (its anchor) is the same wherever the window
stands, and neighbouring windows mostly share it, so a document becomes a few
overlapping segments, each with one anchor.  An anchor that only one document
has cannot belong to a repeated window; such segments need no search (exact,
not a heuristic).  All segments of an anchor lie in one shard.  There the
distinct segments are indexed (words as numbers, wavelet-matrix BWT), and
backward search gives the matching statistics of the streamed segments; where
they reach the window length, the suffix range yields the smallest document.

Equal texts are one class: only its smallest id is searched, and its later copies
consist of repeated windows.  Equal segments are one index row, with their
smallest document, before the shuffle.  Segments of an anchor with very many rows are dealt as single windows by the
hash of the window, so no shard holds a hot anchor whole.

Cases: words are runs of non-space bytes (ASCII white space), unchanged.  A null
text has no words.  Texts shorter than a window stay whole.  Repeated rows share
an id and so remove nothing from each other.  Rows with a null id lose nothing
and make nothing else go.  Empty tables give empty results; other columns are
passed over.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import SPACES, Scratch, arrow_schema, every, gram_hashes, map_rows, run_hashes, sliding_min, unused, word_bounds, word_hashes
from vigilrow.llm.fmindex import FMIndex

WINDOW = 13
#: Words in an anchor.
ANCHOR = 4
#: Words that a shard indexes, about.
SHARD_WORDS = 400_000
#: Segments of one anchor from which its windows are dealt singly.
HOT = 4_000


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _joined(data: bytes) -> bytes:
    """The words with one space between them."""
    return b" ".join(data.split())


class Words:
    """Word places and hashes of a joined text, and hashes of any run of its words."""

    def __init__(self, joined: bytes):
        raw = np.frombuffer(joined, np.uint8)
        space = np.flatnonzero(raw == 32)
        self.start = np.concatenate([[0], space + 1]) if len(raw) else space
        self.end = np.append(space, len(raw)) if len(raw) else space
        self.hashes = word_hashes(raw, self.start, self.end)

    def runs(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A 64-bit key of each run of words."""
        return run_hashes(self.hashes, first, size).view(np.int64)

    def segments(self, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, first window and number of windows of each run of windows with one anchor."""
        grams = gram_hashes(self.hashes, anchor)
        width = window - anchor + 1
        if len(grams) < width:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = sliding_min(grams, width)
        start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        return least[start].view(np.int64), start, np.diff(np.append(start, len(least)))


def _key(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def _profile(docs: DataFrame, window: int) -> DataFrame:
    """What one pass over the texts gives: keys, number of words, digest of all words, anchors."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = defaultdict(list)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = _bytes(text.as_py())
                joined, key = _joined(data), _key(data)
                words = Words(joined)
                out["doc_id"].append(doc)
                out["text_key"].append(key)
                out["text_hash"].append(int.from_bytes(key[:8], "little", signed=True))
                out["n_words"].append(len(words.start))
                out["whole_sha256"].append(hashlib.sha256(joined).digest())
                out["anchors"].append(np.unique(words.segments(window)[0]) if doc is not None else [])
            return out or {n: [] for n in ("doc_id", "text_key", "text_hash", "n_words", "whole_sha256", "anchors")}

        return work

    return map_rows(docs, make, "doc_id long, text_key binary, text_hash long, n_words long, whole_sha256 binary, anchors array<long>")


def _pack(docs: DataFrame) -> DataFrame:
    """doc_id, the key of the text, and the zstd block of its joined words."""

    def make():
        pack = zstandard.ZstdCompressor(level=3)

        def work(batch: pa.RecordBatch) -> dict:
            texts = [_bytes(t.as_py()) for t in batch.column(1)]
            return {"doc_id": batch.column(0), "text_key": [_key(t) for t in texts], "packed": [pack.compress(t) for t in texts]}

        return work

    return map_rows(docs, make, "doc_id long, text_key binary, packed binary")


def _unpack(unpack: zstandard.ZstdDecompressor, block: bytes) -> bytes:
    return unpack.decompress(block, max_output_size=1 << 31)


_CUT = "shard long, key long, content binary, doc_id long, text_hash long, first long"


def _cut(texts: DataFrame, window: int, shards: int, flush: int = 100_000) -> DataFrame:
    """Two kinds of rows from the texts whose shared anchors are listed with them.

    Occurrences (no content): each segment's key and place.  Index rows (with
    content, first = -1): each different segment of a task once, with its
    smallest document; so copies are combined before the shuffle.
    """
    schema = arrow_schema(_CUT)
    names = schema.names

    def run(batches):
        unpack, held = zstandard.ZstdDecompressor(), {}

        def flushed():
            rows = [(shard, key, content, doc, 0, -1) for (shard, key), (doc, content) in held.items()]
            held.clear()
            return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)) if rows else [[]] * 6, strict=True)), schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [[np.zeros(0, np.int64)] for _ in range(5)]
                for doc, text_hash, block, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3), strict=True):
                    joined = _joined(_unpack(unpack, block.as_py()))
                    words = Words(joined)
                    anchor, first, count = words.segments(window)
                    listed, split = (np.asarray(wanted.values.field(n)) for n in ("anchor", "parts"))
                    order = np.argsort(listed)
                    slot = np.minimum(np.searchsorted(listed[order], anchor), len(listed) - 1)
                    ok = listed[order][slot] == anchor
                    anchor, first, count, split = anchor[ok], first[ok], count[ok], split[order][slot][ok].astype(np.int64)
                    if (split > 1).any():  # windows of a hot anchor one by one
                        times = np.where(split > 1, count, 1)
                        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        anchor, split, first = (np.repeat(x, times) for x in (anchor, split, first))
                        count = np.where(split > 1, 1, np.repeat(count, times))
                        first = first + step
                    size = count + window - 1
                    key = words.runs(first, size)
                    shard = (anchor + (key & 0x7FFFFFFF) % split * 0x9E3779B9) % shards
                    low, high = words.start[first], words.end[first + size - 1]
                    for place in zip(shard.tolist(), key.tolist(), low.tolist(), high.tolist(), strict=True):
                        known = held.get(place[:2])
                        if known is None:
                            held[place[:2]] = doc, joined[place[2] : place[3]]
                        elif doc < known[0]:
                            held[place[:2]] = doc, known[1]
                    n = len(key)
                    for column, values in zip(found, (shard, key, np.full(n, doc), np.full(n, text_hash), first), strict=True):
                        column.append(values)
                shard, key, doc, text_hash, first = (np.concatenate(f) for f in found)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(key), pa.nulls(len(key), pa.binary()), pa.array(doc), pa.array(text_hash), pa.array(first)], schema=schema)
                if len(held) > flush:
                    yield flushed()
        yield flushed()

    return texts.select("doc_id", "text_hash", "packed", "anchors").mapInArrow(run, _CUT)


def first_documents(contents: list[bytes], owner: np.ndarray, window: int, streamed: list[bytes] | None = None) -> list[np.ndarray]:
    """For each window of the streamed segments, the smallest owner of an indexed segment that has it.

    Words become numbers of the shard's own vocabulary, so equality is exact.
    A window that is in no indexed segment gets the largest integer.
    """
    tokens = [c.split() for c in contents]
    flat = [w for part in tokens for w in [*part, b""]]
    codes, vocabulary = pd.factorize(pd.Series(flat, dtype=object))
    end_code = codes[-1]
    # 0 ends a segment; words count from 1.
    numbers = np.where(codes == end_code, 0, np.where(codes < end_code, codes + 1, codes)).astype(np.int64)
    index = FMIndex(numbers, window)
    sizes = np.array([len(part) for part in tokens])
    least = index.least(np.repeat(owner, sizes + 1))
    if streamed is None:
        at = np.cumsum(sizes + 1) - sizes - 1
        words, starts, ends = numbers, at, at + sizes
    else:
        number = {w: (c + 1 if c < end_code else c) for c, w in enumerate(vocabulary) if c != end_code}
        parts = [s.split() for s in streamed]
        sizes = np.array([len(p) for p in parts])
        words = np.array([number.get(w, -1) for p in parts for w in p], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
    length, row = index.matching_statistics(words, starts, ends)
    found = np.where(length >= window, least[row], np.iinfo(np.int64).max)
    return [found[s : max(s, e - window + 1)] for s, e in zip(starts, ends, strict=True)]


def _search(index: DataFrame, window: int) -> DataFrame:
    def search(part: pd.DataFrame) -> pd.DataFrame:
        part = part.groupby("key", sort=True, as_index=False).agg({"content": "first", "doc_id": "min", "shard": "first"})
        found = first_documents(part["content"].tolist(), part["doc_id"].to_numpy(), window)
        return pd.DataFrame({"shard": part["shard"], "key": part["key"], "firsts": found})

    return index.groupBy("shard").applyInPandas(search, "shard long, key long, firsts array<long>")


@dataclass
class Repeats:
    """profile: one row for each row of the input.  classes: text_key, rep (smallest id with that text).
    texts and hits: the packed texts of representatives, and their windows that start in a smaller document."""

    profile: DataFrame
    classes: DataFrame
    texts: DataFrame
    hits: DataFrame
    scratch: Scratch


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                 shard_words: int = SHARD_WORDS, hot: int = HOT) -> Repeats:
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scratch = Scratch(docs.sparkSession)
    # Read once; the anchors, the larger part, are dropped when they have been looked up.
    wide = scratch.keep(_profile(docs, window), "anchors")
    profile = scratch.keep(wide.drop("anchors"), "profile")
    named = profile.where("doc_id IS NOT NULL")
    classes = named.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.min("text_hash").alias("text_hash"), F.max("n_words").alias("n_words"))
    anchors = wide.where("doc_id IS NOT NULL").select("text_hash", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    shared = shared.select("anchor", F.ceil(F.col("n") / F.lit(hot)).cast("int").alias("parts"))
    # Copies list the same anchors; the set is combined before the shuffle.
    wanted = anchors.join(shared, "anchor").groupBy("text_hash").agg(F.collect_set(F.struct("anchor", "parts")).alias("anchors"))
    wanted = classes.select("text_key", "text_hash", F.col("rep").alias("doc_id")).join(wanted, "text_hash")
    texts = scratch.keep(_pack(docs).join(wanted, ["doc_id", "text_key"]), "texts")
    scratch.drop("anchors")
    rows = texts.agg(F.sum(F.size("anchors"))).first()[0] or 0
    # A segment is a window and a few words; copies make the real shards smaller.
    shards = max(1, -(-rows * (window + 5) // shard_words))
    cut = scratch.keep(_cut(texts, window, shards), "segments")
    found = _search(cut.where("content IS NOT NULL").select("shard", "key", "content", "doc_id"), window)
    places = cut.where("content IS NULL").select("shard", "key", "doc_id", "text_hash", "first").join(found, ["shard", "key"])
    starts = F.expr("filter(transform(firsts, (d, i) -> IF(d < doc_id, first + i, -1L)), p -> p >= 0)")
    hits = places.select("doc_id", "text_hash", starts.alias("starts")).where(F.size("starts") > 0)
    hits = hits.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    hits = scratch.keep(hits, "hits")
    scratch.drop("segments")
    return Repeats(profile, classes, texts.select("doc_id", "text_key", "text_hash", "packed"), hits, scratch)


def _covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + window, n), -1)
    return np.cumsum(step[:-1]) > 0


def _cuts(found: Repeats, make, ddl: str) -> DataFrame:
    """``make`` over (doc_id, text_key, packed, starts), one row for each representative with hits."""
    rows = found.texts.join(found.hits, ["doc_id", "text_hash"]).select("doc_id", "text_key", "packed", "starts")
    cut = found.scratch.keep(map_rows(rows, make, ddl).dropDuplicates(["doc_id", "text_key"]), "cut")
    found.scratch.drop("texts", "hits")
    return cut


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row."""
    found = find_repeats(docs, doc_id, text, window, **options)

    def make():
        unpack = zstandard.ZstdDecompressor()

        def work(batch: pa.RecordBatch) -> dict:
            removed, sha = [], []
            for block, starts in zip(batch.column(2), batch.column(3), strict=True):
                tokens = _unpack(unpack, block.as_py()).split()
                gone = _covered(len(tokens), np.asarray(starts.values), window)
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, g in zip(tokens, gone.tolist(), strict=True) if not g])).digest())
            return {"doc_id": batch.column(0), "text_key": batch.column(1), "n_removed": removed, "cut_sha256": sha}

        return work

    cut = _cuts(found, make, "doc_id long, text_key binary, n_removed long, cut_sha256 binary")
    rows = found.profile.select("doc_id", "text_key", "n_words", "whole_sha256")
    rows = rows.join(found.classes.select("text_key", "rep"), "text_key", "left").join(cut, ["doc_id", "text_key"], "left")
    # A later copy of a whole text that has a window consists of repeated windows.
    copy = (F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= window)
    return rows.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.lower(F.hex(F.coalesce("cut_sha256", "whole_sha256")))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """The same rows with repeated words taken out of their texts (space before a word goes with it).

    Texts without repeated windows stay byte for byte; no row is dropped.
    """
    found = find_repeats(docs, doc_id, text, window, **options)

    def make():
        unpack = zstandard.ZstdDecompressor()

        def work(batch: pa.RecordBatch) -> dict:
            cut = []
            for block, starts in zip(batch.column(2), batch.column(3), strict=True):
                raw = np.frombuffer(_unpack(unpack, block.as_py()), np.uint8)
                first, last = word_bounds(raw)
                gone = _covered(len(first), np.asarray(starts.values), window)
                step = np.zeros(len(raw) + 1, np.int64)
                # A word goes from the end of the word before it.
                np.add.at(step, np.concatenate([[0], last[:-1]])[gone] if len(first) else first, 1)
                np.add.at(step, last[gone], -1)
                cut.append(raw[np.cumsum(step[:-1]) == 0].tobytes().strip(SPACES).decode("utf-8", "replace"))
            return {"doc_id": batch.column(0), "text_key": batch.column(1), "cut_text": cut}

        return work

    cut = _cuts(found, make, "doc_id long, text_key binary, cut_text string")
    copies = found.profile.join(found.classes.select("text_key", "rep"), "text_key").where(f"doc_id > rep AND n_words >= {window}")
    changed = cut.unionByName(copies.select("doc_id", "text_key", F.lit("").alias("cut_text")).distinct())
    ident, key, new = unused(docs.columns, "cut_id", "cut_key", "cut_text")
    changed = changed.select(F.col("doc_id").alias(ident), F.hex("text_key").alias(key), F.col("cut_text").alias(new))
    (value,), (own,) = every(docs, text), every(docs, doc_id)
    whole = F.coalesce(value, F.lit("")).cast("binary")
    same = (own == F.col(ident)) & (F.substring(F.upper(F.sha2(whole, 256)), 1, 32) == F.col(key))
    columns = [F.coalesce(F.col(new), value).alias(c) if c == text else column for c, column in zip(docs.columns, every(docs), strict=True)]
    return docs.join(changed, same, "left").select(*columns)
