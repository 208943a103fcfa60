"""Benchmark passages in documents: q-gram lemma filter, then banded alignment.

Texts are folded (lower case, everything but letters, digits and non-ASCII bytes
becomes one space).  Each benchmark item is cut into overlapping windows of
``WINDOW`` bytes (shorter items are one window) and, for passages of an item,
into short ones of ``PASSAGE`` bytes that start every ``STEP`` bytes: each exact
piece of ``PASSAGE + STEP - 1`` bytes holds one.  A document region within
``e`` edits of a window of w bytes shares at least ``w + 1 - (e + 1) q`` q-grams with
it, all on e + 1 neighbouring diagonals (place in document minus place in
window).  Shared q-grams are counted in diagonal bands that overlap by half, so
no such interval falls between two bands; bands with enough of them are
verified by an alignment that stays inside the band, widened by the budget.

An item is found in a document if one of its windows is within budget.  Items
below ``LEAST`` folded bytes are found where all their words stand in a row,
without edits.  The
benchmark goes out in blocks of bounded size, each against all documents.

Cases: null and empty texts contain nothing.  Rows are treated one by one, so
repeated rows and null ids come out as they went in.  An item whose text occurs twice in
the benchmark is found under both ids.  Empty tables give empty results; other
columns are passed over.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import map_rows, modest_batches

WINDOW, STRIDE = 100, 50
PASSAGE, STEP = 60, 10
#: Edits for each byte of a window.
EDIT_SHARE = 0.08
Q = 10
LEAST = 40
#: Folded benchmark bytes in one block.
BLOCK_BYTES = 4_000_000
_TABLE_BITS = 21

_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def fold(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_FOLD).split())


def _cut(data: bytes, window: int, stride: int) -> list[bytes]:
    if len(data) <= window:
        return [data]
    starts = [*range(0, len(data) - window, stride), len(data) - window]
    return [data[s : s + window] for s in starts]


def windows(data: bytes, window: int = WINDOW, stride: int = STRIDE, passage: int = PASSAGE, step: int = STEP) -> list[bytes]:
    """Overlapping windows that cover the whole folded item, long ones and then short ones."""
    return _cut(data, window, stride) + (_cut(data, passage, step) if len(data) > passage else [])


def budget(size: int, share: float = EDIT_SHARE, q: int = Q) -> tuple[int, int]:
    """Edits allowed for a window, and the q-grams that must be shared then (at least 1)."""
    edits = int(size * share)
    while edits and size + 1 - (edits + 1) * q < 1:
        edits -= 1
    return edits, max(1, size + 1 - (edits + 1) * q)


def _grams(data: bytes, q: int = Q) -> np.ndarray:
    """A hash of each q-gram (8 to 16 bytes): two overlapping 8-byte reads."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    read = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        value = read[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (read[q - 8 : q - 8 + n] * np.uint64(0xD6E8FEB86659FD93))
        return value ^ (value >> np.uint64(32))


def banded_edits(pattern: bytes, text: bytes, low: int, high: int) -> tuple[int, int]:
    """Fewest edits between the pattern and a piece of the text, on diagonals low to high; where the piece ends.

    Row by row over the pattern; entry k is the diagonal low + k.
    """
    exact = text.find(pattern, max(low, 0), max(high, 0) + len(pattern)) if high >= 0 else -1
    if exact >= 0:
        return 0, exact + len(pattern)
    p, width = np.frombuffer(pattern, np.uint8), high - low + 1
    padded = np.zeros(len(p) + width + 2, np.int16) - 1
    start, stop = max(low, 0), min(len(text), len(p) + high + 1)
    if start < stop:
        padded[start - low : stop - low] = np.frombuffer(text[start:stop], np.uint8)
    step = np.arange(width)
    # A piece starts inside the text, so diagonals outside are closed at first.
    cost = np.where((step + low >= 0) & (step + low <= len(text)), 0, len(p) + 1)
    for i, c in enumerate(p):
        best = cost + (padded[i : i + width] != c)
        best[:-1] = np.minimum(best[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(best - step) + step
    ends = step + low + len(p)
    cost = np.where((ends >= 0) & (ends <= len(text)), cost, len(p) + 1)
    at = int(cost.argmin())
    return int(cost[at]), int(ends[at])


def matcher(items: list[tuple[int, bytes]], q: int = Q, share: float = EDIT_SHARE) -> Callable[[str | None], list[tuple[int, int, int, int, int]]]:
    """A function from a text to its (item place, windows found, fewest edits, first byte, last byte)."""
    parts = [(k, w) for k, (_, data) in enumerate(items) if len(data) >= LEAST for w in windows(data)]
    allowed = [budget(len(w), share, q) for _, w in parts]
    grams = [_grams(w, q) for _, w in parts]
    flat = np.concatenate([np.zeros(0, np.uint64), *grams])
    order = np.argsort(flat, kind="stable")
    keys, first = np.unique(flat[order], return_index=True)
    counts = np.diff(np.append(first, len(flat)))
    owner = np.repeat(np.arange(len(parts)), [len(g) for g in grams])[order]
    place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]]).astype(np.int64)[order]
    table = np.zeros(1 << _TABLE_BITS, bool)
    shift = np.uint64(64 - _TABLE_BITS)
    table[keys >> shift] = True
    edits = np.array([a[0] for a in allowed], np.int64)
    least = np.array([a[1] for a in allowed], np.int64)
    # The weakest demand of any window, for a quick no: that many hits within a span.
    need = int(least.min(initial=1))
    span = max((len(w) + e for (_, w), e in zip(parts, edits, strict=True)), default=0)

    def match(text: str | None) -> list[tuple[int, int, int, int, int]]:
        data = fold(text)
        if len(data) < LEAST or not len(keys):
            return []
        every = _grams(data, q)
        hit = np.flatnonzero(table[every >> shift])
        if len(hit) < need:
            return []
        slot = np.searchsorted(keys, every[hit])
        known = (slot < len(keys)) & (keys[np.minimum(slot, len(keys) - 1)] == every[hit])
        hit, slot = hit[known], slot[known]
        if len(hit) < need or not (hit[need - 1 :] - hit[: len(hit) - need + 1] <= span).any():
            return []
        # Hits that have enough hits around them, with their postings.
        crowd = np.searchsorted(hit, hit + span, side="right") - np.searchsorted(hit, hit - span)
        hit, slot = hit[crowd >= need], slot[crowd >= need]
        repeat = counts[slot]
        posting = np.repeat(first[slot] - np.cumsum(repeat) + repeat, repeat) + np.arange(repeat.sum())
        which, at = owner[posting], place[posting]
        diagonal = np.repeat(hit, repeat) - at
        width = edits[which] + 1
        band = diagonal // width
        # Each hit counts in two bands of double width; a window place counts once in a band.
        # One number for window, band and place: 8 bits hold a place, 32 a band (from a little below 0).
        spot = (which << 40) + ((band + 256) << 8) + at
        spot = np.unique(np.concatenate([spot, spot - 256]))
        step = np.flatnonzero(np.concatenate([[True], spot[1:] >> 8 != spot[:-1] >> 8]))
        size = np.diff(np.append(step, len(spot)))
        row = np.stack([spot[step] >> 40, (spot[step] >> 8 & 0xFFFFFFFF) - 256], 1)
        good = size >= least[row[:, 0]]
        found: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)
        for w, b in row[good].tolist():
            item, pattern = parts[w]
            e = int(edits[w])
            cost, end = banded_edits(pattern, data, b * (e + 1) - e, (b + 2) * (e + 1) - 1 + e)
            if cost <= e and (w not in found[item] or cost < found[item][w][0]):
                found[item][w] = cost, end
        return [
            (item, len(got), min(c for c, _ in got.values()), max(0, min(e - len(parts[w][1]) for w, (_, e) in got.items())), max(e for _, e in got.values()))
            for item, got in sorted(found.items()) if got
        ]

    return match


def short_matcher(items: list[tuple[int, bytes]]) -> Callable[[str | None], list[tuple[int, int, int, int, int]]]:
    """Like ``matcher``, for the items below ``LEAST`` bytes: whole words in a row, the same in the text."""
    runs: dict[bytes, list[tuple[int, bytes]]] = defaultdict(list)
    for k, (_, data) in enumerate(items):
        if 0 < len(data) < LEAST:
            runs[data.split(b" ", 1)[0]].append((k, data + b" "))

    def match(text: str | None) -> list[tuple[int, int, int, int, int]]:
        if not runs:
            return []
        data, at, found = fold(text) + b" ", 0, {}
        for word in data.split():
            for k, run in runs.get(word, ()):
                if data.startswith(run, at):
                    first = found[k][3] if k in found else at
                    found[k] = k, 1, 0, first, at + len(run) - 1
            at += len(word) + 1
        return list(found.values())

    return match


def finder(items: list[tuple[int, bytes]]) -> Callable[[str | None], list[tuple[int, int, int, int, int]]]:
    """All items, by alignment or, if short, as words in a row."""
    long, short = matcher(items), short_matcher(items)
    return lambda text: sorted(long(text) + short(text))


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> list[list[tuple[int, bytes]]]:
    """The benchmark in lists of (id, folded text), each of about ``block_bytes`` at most."""
    items = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    found = ([(r["item_id"], fold(r["text"])) for r in items.where(place == k).orderBy("item_id", "text").collect()] for k in range(count))
    return [block for block in found if block]


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, n_found (windows), edits, first_byte, last_byte (folded text)."""
    ddl = "doc_id long, item_id long, n_found long, edits long, first_byte long, last_byte long"
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = docs.sparkSession.createDataFrame([], ddl)
    for block in blocks(benchmark, **options):

        def make(block=block):
            match = finder(block)

            def work(batch: pa.RecordBatch) -> dict:
                rows = [(doc.as_py(), block[k][0], *rest) for doc, value in zip(batch.column(0), batch.column(1), strict=True) for k, *rest in match(value.as_py())]
                return dict(zip((f.split()[0] for f in ddl.split(", ")), map(list, zip(*rows, strict=True)) if rows else [[]] * 6, strict=True))

            return work

        out = out.unionByName(map_rows(docs, make, ddl))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found; no shuffle, one pass for each benchmark block."""
    modest_batches(docs.sparkSession)
    for block in blocks(benchmark, **options):

        def run(batches, block=block, place=docs.columns.index(text)):
            match = finder(block)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    yield part.filter(pa.array([not match(t.as_py()) for t in part.column(place)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
