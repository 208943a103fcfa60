"""Hard negatives by exact integer scores of anchors against all rows.

Components become whole numbers (``floor(scale * x)``) and a score is the
integer inner product.  Anchors and candidates are dealt to tiles of bounded
size; a cell is one anchor tile with one candidate tile, and its scores are one
matrix product by Strassen's recursion on int64 tiles (odd sides are padded with
zeros; additions are exact).  A cell keeps small heaps, each in the order
"higher score, then smaller id", which merge across cells by taking the best of
their union:

1. *positive heaps*: for each anchor its best other rows of the same label.
   Rows are tiled in label order, so only tiles that share a label meet;
2. *window heaps*: for each anchor and positive the best rows of other labels
   whose score lies in the window below the positive's.

Every anchor meets every row; nothing is sampled or capped.  Memory of a task is
that of one cell, whatever the labels and ties are.

Cases: rows with a null id or label, a null vector, or a null or non-finite
component take no part.  A vector shorter than another counts as padded with
zeros.  Each row stands for itself: of two rows with one id, each is an anchor
(if the id is one) and the other may be its positive.  Ties go to the smaller id.
An anchor without positives, or a window without rows, gives no rows; so does an
empty table.  Scores are taken modulo 2**64, as long arithmetic does.  Other
columns are passed over.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilrow.llm.common import arrow_schema, ordered
from vigilrow.session import materialize

ANCHOR_TILE = 4_096
CANDIDATE_TILE = 8_192
#: Anchors of a tile whose scores are in memory at once.
_SLICE = 256
#: Sides up to this are multiplied directly.
LEAF = 32
_NONE = np.iinfo(np.int64).min


# --- the product ---------------------------------------------------------------------


def _direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of small blocks; in floating point where every sum is surely below 2**53, so exact."""
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if bound < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _even(x: np.ndarray) -> np.ndarray:
    return np.pad(x, [(0, x.shape[0] % 2), (0, x.shape[1] % 2)])


def multiply(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices, modulo 2**64, with seven products of half the size at each level."""
    rows, columns = a.shape[0], b.shape[1]
    if min(rows, a.shape[1], columns) <= leaf:
        return _direct(a, b)
    a, b = _even(a), _even(b)
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = multiply(a11 + a22, b11 + b22, leaf)
    p2 = multiply(a21 + a22, b11, leaf)
    p3 = multiply(a11, b12 - b22, leaf)
    p4 = multiply(a22, b21 - b11, leaf)
    p5 = multiply(a11 + a12, b22, leaf)
    p6 = multiply(a21 - a11, b11 + b12, leaf)
    p7 = multiply(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out[:rows, :columns]


# --- heaps ---------------------------------------------------------------------------


def best(group: np.ndarray, score: np.ndarray, ident: np.ndarray, size: int) -> np.ndarray:
    """Places of the first ``size`` entries of each group: higher score first, then smaller id."""
    order = np.lexsort((ident, -score, group))
    sorted_groups = group[order]
    start = np.flatnonzero(np.concatenate([[True], sorted_groups[1:] != sorted_groups[:-1]])) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < size]


class Tile:
    """Rows of one tile as arrays."""

    def __init__(self, column: pa.ChunkedArray):
        rows = column.combine_chunks()
        rows = (rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows).flatten()
        self.seq, self.ident, self.label = (np.asarray(rows.field(k)) for k in ("seq", "ident", "label"))
        self.vectors = _matrix(rows.field("vector"))
        self.top = rows.field("top") if "top" in {f.name for f in rows.type} else None


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of whole numbers, short ones padded with zeros."""
    size = np.diff(np.asarray(lists.offsets))
    values = np.asarray(lists.flatten()).astype(np.int64)
    width = int(size.max(initial=0))
    if (size == width).all():
        return values.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = values
    return out


def _scores(anchors: Tile, candidates: Tile):
    """Slices of anchors with their scores against all candidates of the tile."""
    width = max(anchors.vectors.shape[1], candidates.vectors.shape[1])
    a, b = (np.pad(t.vectors, [(0, 0), (0, width - t.vectors.shape[1])]) for t in (anchors, candidates))
    b = np.ascontiguousarray(b.T)
    for at in range(0, len(a), _SLICE):
        yield slice(at, at + _SLICE), multiply(a[at : at + _SLICE], b)


_POSITIVE = "anchor long, ident long, score long"
_NEGATIVE = "anchor long, slot int, ident long, score long"


def _positives(anchors: Tile, candidates: Tile, size: int) -> list[tuple]:
    found = []
    for part, score in _scores(anchors, candidates):
        allowed = (anchors.label[part, None] == candidates.label) & (anchors.seq[part, None] != candidates.seq)
        kept = min(size, score.shape[1])
        least = np.partition(np.where(allowed, score, _NONE), -kept, axis=1)[:, -kept, None]
        row, column = np.nonzero(allowed & (score >= least))
        value, ident = score[row, column], candidates.ident[column]
        take = best(row, value, ident, size)
        found.append((anchors.seq[part][row[take]], ident[take], value[take]))
    return found


def _negatives(anchors: Tile, candidates: Tile, size: int, low: tuple[int, int]) -> list[tuple]:
    """The window of a positive score p holds the scores from ceil(p * low) to p; none if p is negative."""
    top = _matrix(anchors.top)
    exists = np.arange(top.shape[1]) < np.diff(np.asarray(anchors.top.offsets))[:, None]
    exists &= top >= 0
    part_of, whole = low
    # p - floor(p * (1 - low)), written so that nothing overflows.
    cut = whole - part_of
    least = top - (top // whole * cut + top % whole * cut // whole)
    found = []
    for part, score in _scores(anchors, candidates):
        if not exists[part].any():
            continue
        floor = np.where(exists[part], least[part], np.iinfo(np.int64).max).min(axis=1)
        roof = np.where(exists[part], top[part], _NONE).max(axis=1)
        row, column = np.nonzero((score >= floor[:, None]) & (score <= roof[:, None]) & (anchors.label[part, None] != candidates.label))
        value, ident = score[row, column], candidates.ident[column]
        for slot in range(top.shape[1]):
            inside = exists[part, slot][row] & (value >= least[part, slot][row]) & (value <= top[part, slot][row])
            r, v, i = row[inside], value[inside], ident[inside]
            take = best(r, v, i, size)
            found.append((anchors.seq[part][r[take]], np.full(len(take), slot), i[take], v[take]))
    return found


def _per_cell(work: Callable[[Tile, Tile], list[tuple]], ddl: str, same_label: bool):
    schema = arrow_schema(ddl)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            anchors, candidates = Tile(left["rows"]), Tile(right["rows"])
            one = (anchors.label == anchors.label[0]).all() and (candidates.label == anchors.label[0]).all()
            if same_label or not one:
                found = work(anchors, candidates)
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(schema)
        return pa.table([pa.array(c).cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


# --- the job -------------------------------------------------------------------------


def _first(df: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """Merge heaps: the best entries of each, numbered from 1.  Spark cuts each part's entries before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "ident")
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= size)


def _tiles(rows: DataFrame, group: str, *fields: str) -> DataFrame:
    """One row for each tile; a tile's size is bounded."""
    return rows.groupBy(group).agg(F.collect_list(F.struct("seq", "ident", "label", "vector", *fields)).alias("rows"))


def whole_vectors(table: DataFrame, ident: str, vector: str, label: Column, scale: int) -> DataFrame:
    """ident, label and vector (longs) of the rows that take part."""
    taken = table.select(F.col(ident).cast("long").alias("ident"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    taken = taken.where(F.col("ident").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False)))
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return taken.where(finite).withColumn("vector", F.transform("vector", lambda x: F.floor(x * float(scale)).cast("long")))


def hard_negatives(
    table: DataFrame, anchors: Callable[[Column], Column], ident: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` tells from an id whether its row is an anchor; ``low`` is the
    window's lower end as a fraction of the positive score.
    """
    rows = whole_vectors(table, ident, vector, F.col(label) if isinstance(label, str) else label, scale)
    rows = rows.withColumn("arrival", F.monotonically_increasing_id())
    # Tiles in label order; the arrival splits an id that very many rows share.
    placed = ordered(rows, "negative-rows", "label", "ident", "arrival")
    placed = placed.select(F.col("position").alias("seq"), "ident", "label", "vector")
    chosen = ordered(placed.where(anchors(F.col("ident"))), "negative-anchors", "seq")
    chosen = chosen.select("seq", "ident", "label", "vector", F.floor(F.col("position") / ANCHOR_TILE).alias("a_tile"))
    placed = placed.withColumn("c_tile", F.floor(F.col("seq") / CANDIDATE_TILE))
    candidates = materialize(_tiles(placed, "c_tile"), "negative-tiles")

    # Tiles that share a label.
    cells = chosen.select("label", "a_tile").distinct().join(placed.select("label", "c_tile").distinct(), "label").select("a_tile", "c_tile").distinct()
    cells = materialize(cells, "negative-cells")
    left, right = (t.groupBy("a_tile", "c_tile") for t in (_tiles(chosen, "a_tile").join(cells, "a_tile"), candidates.join(cells, "c_tile")))
    heaps = left.cogroup(right).applyInArrow(_per_cell(lambda a, c: _positives(a, c, positives), _POSITIVE, True), _POSITIVE)
    heaps = materialize(_first(heaps, ["anchor"], positives, "slot"), "positive-heaps")

    # Every anchor tile with every candidate tile: the counts of tiles are two numbers.
    by_anchor = heaps.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "score"))).alias("heap"))
    by_anchor = by_anchor.select(F.col("anchor").alias("seq"), F.col("heap.score").alias("top"))
    asking = chosen.join(by_anchor, "seq")
    n_anchors, n_candidates = chosen.agg(F.max("a_tile")).first()[0], placed.agg(F.max("c_tile")).first()[0]
    every_candidate = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_candidates or 0).cast("long"))).alias("c_tile")
    every_anchor = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_anchors or 0).cast("long"))).alias("a_tile")
    left = _tiles(asking, "a_tile", "top").select("a_tile", "rows", every_candidate).groupBy("a_tile", "c_tile")
    right = candidates.select("c_tile", "rows", every_anchor).groupBy("a_tile", "c_tile")
    mined = left.cogroup(right).applyInArrow(_per_cell(lambda a, c: _negatives(a, c, negatives, low), _NEGATIVE, False), _NEGATIVE)
    mined = _first(mined, ["anchor", "slot"], negatives, "rank")
    named = heaps.select("anchor", (F.col("slot") - 1).alias("slot"), F.col("ident").alias("positive_id"), F.col("score").alias("positive_score"))
    names = chosen.select(F.col("seq").alias("anchor"), F.col("ident").alias("anchor_id"))
    return mined.join(named, ["anchor", "slot"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("ident").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
