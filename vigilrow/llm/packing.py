"""Packing by lexical retrieval: windows filled with a seed document and its BM25 neighbours.

Documents become token ids once and are dealt to shards of about
``SHARD_TOKENS`` ids.  Term statistics (document frequency of each id, mean
length) cover all documents; they are as large as the vocabulary.  In a shard
an inverted index over the ids ranks the unused documents for each seed, and
they fill the seed's window in that order.  The one that does not fit is cut,
and its rest goes on as an unused document.  Documents longer than a window give full
windows first and take part with what is left.  The last window of a shard is
cut into lengths that are powers of two, which need no padding.

Cases: a null or empty text is its end id alone.  Repeated rows are packed
each.  Rows without an id are packed with a null doc_id.  An empty table gives no
pieces.  Other columns are passed over.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.llm import tokens
from vigilrow.llm.common import map_rows
from vigilrow.session import materialize

WINDOW = 4096
SHARD_TOKENS = 2_000_000
#: Ids of the seed that are looked up, those with the largest weight.
QUERY_TERMS = 24
K1, B = 1.2, 0.75
#: Bits for the number of a sequence within its shard.
SEQUENCE_BITS = 32
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, encoder: Callable[[], tokens.Encoder], end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (16-bit if the vocabulary allows, else 32-bit), the end id included."""

    def make():
        encode = encoder()
        kind = id_type(encode)
        wide = np.dtype(kind).itemsize

        def work(batch: pa.RecordBatch) -> dict:
            ids, ends = encode.column(batch.column(1), end_id)
            bounds = np.concatenate([[0], ends])
            offsets, data = pa.py_buffer((bounds * wide).astype(np.int32)), pa.py_buffer(ids.astype(kind))
            return {"doc_id": batch.column(0), "n_tokens": np.diff(bounds), "ids": pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, data])}

        return work

    return map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), make, "doc_id long, n_tokens long, ids binary", rows=2_000)


def id_type(encoder: tokens.Encoder) -> str:
    return "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def statistics(table: DataFrame, kind: str) -> tuple[np.ndarray, int, int]:
    """Document frequency of each id, documents, ids; all over the whole table."""

    def run(batches):
        uses, n, total = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for block in batch.column(0):
                used = np.unique(np.frombuffer(block.as_py(), kind))
                if used[-1] >= len(uses):
                    uses = np.concatenate([uses, np.zeros(int(used[-1]) + 1 - len(uses), np.int64)])
                uses[used] += 1
                n += 1
                total += len(block.as_py()) // np.dtype(kind).itemsize
        hit = np.flatnonzero(uses)
        yield pa.RecordBatch.from_pydict({"id": np.concatenate([hit, [-1, -2]]), "n": np.concatenate([uses[hit], [n, total]])}, schema=pa.schema([("id", pa.int64()), ("n", pa.int64())]))

    found = table.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    by_id = dict(zip(found["id"], found["n"], strict=True))
    uses = np.zeros(max([0, *by_id]) + 1, np.int64)
    for i, n in by_id.items():
        if i >= 0:
            uses[i] = n
    return uses, int(by_id.get(-1, 0)), int(by_id.get(-2, 0))


class Shelf:
    """BM25 inverted index over the documents of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.terms, self.weights = [], []
        for ids in docs:
            term, tf = np.unique(ids, return_counts=True)
            self.terms.append(term.astype(np.int32))
            self.weights.append((idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))).astype(np.float32))
        n = len(docs)
        flat = np.concatenate([np.zeros(0, np.int32), *self.terms])
        owner = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in self.terms])
        order = np.argsort(flat, kind="stable")
        self.owner, self.weight = owner[order], np.concatenate([np.zeros(0, np.float32), *self.weights])[order]
        self.ends = np.cumsum(np.bincount(flat, minlength=len(idf)))
        self.idf, self.n = idf, n

    def scores(self, seed: int, terms: int = QUERY_TERMS) -> np.ndarray:
        """BM25 of every document for the seed's weightiest terms."""
        best = self.terms[seed][np.lexsort((self.terms[seed], -self.weights[seed]))[:terms]]
        spans = [(self.ends[t - 1] if t else 0, self.ends[t]) for t in best]
        rows = np.concatenate([np.arange(a, b) for a, b in spans]) if spans else np.zeros(0, np.int64)
        return np.bincount(self.owner[rows], self.weight[rows], minlength=self.n)


def fill(sizes: list[int], rank: Callable[[int], np.ndarray], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length).  ``rank(seed)``: score of every document for that seed."""
    out = [[(d, s, window)] for d, size in enumerate(sizes) for s in range(0, size - window + 1, window)]
    start = np.array([size - size % window for size in sizes], np.int64)
    left = np.array(sizes, np.int64) - start
    free = left > 0
    at = 0
    while at < len(sizes):
        if not free[at]:
            at += 1
            continue
        row, room, seed = [], window, at
        order = iter(())
        ranked = False
        pick = seed
        while True:
            length = min(room, int(left[pick]))
            row.append((pick, int(start[pick]), length))
            start[pick] += length
            left[pick] -= length
            free[pick] = left[pick] > 0
            room -= length
            if not room or not free.any():
                break
            if not ranked:
                score = rank(seed)
                order, ranked = iter(np.lexsort((np.arange(len(sizes)), -score)).tolist()), True
            pick = next((d for d in order if free[d]), None)
            if pick is None:
                break
        if room and room < window:  # the shard's last window
            out += _powers_of_two(row, window - room)
        else:
            out.append(row)
    return out


def _powers_of_two(row: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    parts, rest = [], list(row)
    for bit in range(total.bit_length() - 1, -1, -1):
        need = total & (1 << bit)
        part = []
        while need:
            d, s, n = rest.pop(0)
            take = min(n, need)
            part.append((d, s, take))
            need -= take
            if n > take:
                rest.insert(0, (d, s + take, n - take))
        if part:
            parts.append(part)
    return parts


def pack(docs: DataFrame, encoder: Callable[[], tokens.Encoder], end_id: int, doc_id: str = "doc_id", text: str = "text",
         window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; and, if asked for, ids (32-bit).

    ``encoder`` makes the encoder in a task (a path need not exist on the driver's side alone).
    """
    kind = id_type(encoder())
    table = materialize(tokenized(docs, encoder, end_id, doc_id, text), "tokens")
    uses, n, total = statistics(table, kind)
    idf = np.log(1 + (n - uses + 0.5) / (uses + 0.5))
    mean = max(1.0, total / max(n, 1))
    shards = max(1, -(-total // shard_tokens))
    # Rows without an id are dealt by their place in the table.
    key = F.coalesce(F.xxhash64("doc_id") * F.when(F.col("doc_id").isNotNull(), 1), F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index")))
    # Ids stay whole numbers in pandas: a null is 0 with a flag.
    dealt = table.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.isnull("doc_id").alias("nameless"), "ids", F.pmod(key, F.lit(shards)).alias("shard"))

    columns = f"{PIECES}, ids binary" if with_ids else PIECES

    def pack_shard(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["nameless", "doc_id", "ids"], ignore_index=True)
        ids = [np.frombuffer(b, kind) for b in part["ids"]]
        sizes, names = [len(i) for i in ids], [None if null else i for i, null in zip(part["doc_id"].tolist(), part["nameless"].tolist(), strict=True)]
        shelf = Shelf(ids, idf, mean)
        base = int(part["shard"].iloc[0]) << SEQUENCE_BITS
        rows = []
        for k, sequence in enumerate(fill(sizes, shelf.scores, window)):
            offset = 0
            for d, start, length in sequence:
                data = ids[d][start : start + length].astype("<u4").tobytes()
                rows.append((names[d], start, length, zlib.crc32(data), sizes[d], base + k, offset, *([data] if with_ids else [])))
                offset += length
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return dealt.groupBy("shard").applyInPandas(pack_shard, columns)
