"""Boosted trees grown leaf by leaf, best split first, from distributed histograms.

Values become bins once (``bin_table``).  Each step of a tree is one job: tasks
walk their rows down the tree so far, add gradients and curvatures per (leaf,
feature, bin), and Spark sums these, runs along each feature's bins, and keeps
the best split of each leaf.  The driver sees one row per leaf.

Best-first growth needs the best split of both children before it can go on, so
one leaf a job would be natural and slow.  Instead a step asks for the children
of *all* leaves that may still be split; growth is then replayed from the root
with the splits known so far, and only what it reaches stays.  The tree is the
same as that of one leaf a job, in about as many jobs as the tree is deep.

Rows keep their margin.  Trees of the last few rounds are added to it inside the
tasks; every ``write_every`` rounds the margins are written as a table, which
ends the lineage and survives a lost executor.

What grows with the data stays in the tasks: a histogram has at most (leaves
asked for) x features x bins cells, whatever the number of rows.
"""

from __future__ import annotations

import heapq
import random
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isnan, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilrow.functions.columns import FEATURES
from vigilrow.operators.dataset import SEED
from vigilrow.operators.trees import NODES
from vigilrow.session import materialize


# ---------------------------------------------------------------------------
# Model settings.
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class LeafwiseSettings:
    rounds: int = 800
    step: float = 0.03
    leaves: int = 64
    row_share: float = 0.9
    rows_anew: int = 5  # rounds after which other rows are drawn
    column_share: float = 0.9
    least_rows: int = 10
    least_curvature: float = 0.001
    l1: float = 0.2
    l2: float = 0.2
    bins: int = 255
    seed: int = SEED
    write_every: int = 10
# End of the fixed values.


#: Leaves whose histograms one job makes: bounds a task's memory.
_LEAVES_AT_ONCE = 32


# --- bins ----------------------------------------------------------------------------


def cut_points(train: DataFrame, columns: tuple[str, ...] = FEATURES, bins: int = 255) -> list[list[float]]:
    """For each column at most ``bins - 1`` cut values, about evenly many rows apart; a value belongs to the bin of its cuts below."""
    shares = [k / bins for k in range(1, bins)]
    ask = [F.percentile_approx(F.col(c).cast("double"), shares, 10 * bins).alias(c) for c in columns]
    row = train.agg(*ask).first()  # columns x bins numbers
    # Missing and NaN values lie above every cut, the one at the largest value too.
    return [sorted({v for v in row[c] or [] if not isnan(v)}) for c in columns]


def bin_table(train: DataFrame, cuts: list[list[float]], columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """``key, label, weight, margin, bins``: one byte for each column."""
    if any(len(c) > 255 for c in cuts):
        raise ValueError("at most 255 cuts for a column")
    edges = [np.array(c) for c in cuts]
    schema = pa.schema([("key", pa.int64()), ("label", pa.float64()), ("weight", pa.float64()), ("margin", pa.float64()), ("bins", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch[f"x{k}"].to_numpy(zero_copy_only=False) for k in range(len(edges))], axis=1)
            out = np.empty(values.shape, np.uint8)
            for k, edge in enumerate(edges):
                out[:, k] = np.searchsorted(edge, values[:, k], side="left")
            fixed = [batch[n] for n in ("key", "label", "weight")]
            margin = pa.array(np.zeros(batch.num_rows))
            yield pa.RecordBatch.from_arrays([*fixed, margin, pa.array([row.tobytes() for row in out], pa.binary())], schema=schema)

    given = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"x{k}") for k, c in enumerate(columns)]
    rows = train.select(
        F.monotonically_increasing_id().alias("key"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"), *given
    )
    return materialize(rows.mapInArrow(run, "key long, label double, weight double, margin double, bins binary"), "boost-bins")


# --- gains ---------------------------------------------------------------------------


def _score(g: Column, h: Column, l1: float, l2: float) -> Column:
    """What a leaf with these sums takes off the loss, twice."""
    shrunk = F.greatest(F.abs(g) - l1, F.lit(0.0))
    return shrunk * shrunk / (h + l2)


def split_gains(sums: DataFrame, settings: LeafwiseSettings = LeafwiseSettings()) -> DataFrame:
    """Sums ``leaf, feature, bin, g, h, n`` -> every allowed split with its gain and the sums below it and in all.

    A window holds one leaf's bins of one feature: 256 rows at most.
    """
    every = Window.partitionBy("leaf", "feature")
    upto = every.orderBy("bin")
    total = {f"all_{c}": F.sum(c).over(every) for c in ("g", "h", "n")}
    below = {f"below_{c}": F.sum(c).over(upto) for c in ("g", "h", "n")}
    s = settings
    rest = {c: F.col(f"all_{c}") - F.col(f"below_{c}") for c in ("g", "h", "n")}
    gain = _score(F.col("below_g"), F.col("below_h"), s.l1, s.l2) + _score(rest["g"], rest["h"], s.l1, s.l2) - _score(F.col("all_g"), F.col("all_h"), s.l1, s.l2)
    allowed = (
        (F.least("below_n", rest["n"]) >= s.least_rows) & (F.least("below_h", rest["h"]) >= s.least_curvature)
    )
    return sums.withColumns(total).withColumns(below).where(allowed).withColumn("gain", gain).drop("g", "h", "n")


def best_splits(sums: DataFrame, settings: LeafwiseSettings) -> DataFrame:
    """One row for each leaf; ties go to the first feature, then the lowest cut."""
    order = F.struct(F.round("gain", 9), -F.col("feature"), -F.col("bin"))
    row = F.struct("feature", "bin", "gain", "below_g", "below_h", "below_n")
    best = F.max_by(F.when(F.col("gain") > 1e-9, row), F.when(F.col("gain") > 1e-9, order))
    return split_gains(sums, settings).groupBy("leaf").agg(best.alias("split"))


# --- rows in the tasks ---------------------------------------------------------------


@dataclass
class Node:
    g: float
    h: float
    n: int
    asked: bool = False
    split: tuple | None = None  # feature, bin, gain, below_g, below_h, below_n
    children: tuple[int, int] | None = None


class Walk:
    """A tree as arrays; rows of bins go down it together."""

    def __init__(self, feature: list[int], cut: list[int], below: list[int], above: list[int], value: list[float]):
        self.feature, self.cut, self.below, self.above = (np.array(x, np.int32) for x in (feature, cut, below, above))
        self.value = np.array(value)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int32)
        going = np.arange(len(bins)) if self.feature[0] >= 0 else np.zeros(0, int)
        while len(going):
            node = at[going]
            lower = bins[going, self.feature[node]] <= self.cut[node]
            node = np.where(lower, self.below[node], self.above[node])
            at[going] = node
            going = going[self.feature[node] >= 0]
        return at


def _walk(nodes: list[Node], values: dict[int, float] | None = None) -> Walk:
    def part(k: int):
        return [n.split[k] if n.children else -1 for n in nodes]

    children = [n.children or (-1, -1) for n in nodes]
    return Walk(part(0), part(1), [c[0] for c in children], [c[1] for c in children], [(values or {}).get(k, 0.0) for k in range(len(nodes))])


def _uniform(key: np.ndarray, seed: int) -> np.ndarray:
    """A number from 0 to 1 for each key: the same in every task."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**64) * np.uint64(0xD6E8FEB86659FD93)
        for shift in (32, 29):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


@dataclass
class Rows:
    """The binned rows, the trees that their margins lack, and the sizes of the bins."""

    table: DataFrame
    width: int
    pending: list[Walk] = field(default_factory=list)

    def _margin(self):
        trees, width = list(self.pending), self.width

        def margin(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            bins = np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(-1, width)
            total = batch["margin"].to_numpy(zero_copy_only=False).copy()
            for tree in trees:
                total += tree.value[tree.leaves(bins)]
            return bins, total

        return margin

    def histogram(self, tree: Walk, asked: list[int], columns: list[int], share: float, seed: int) -> DataFrame:
        """``leaf, feature, bin, g, h, n`` of the drawn rows in the leaves asked for, summed over all tasks."""
        margin, width = self._margin(), self.width
        names = ("leaf", "feature", "bin", "g", "h", "n")
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = np.full(len(tree.feature), -1, np.int64)
            number[asked] = np.arange(len(asked))
            cells = len(asked) * width * 256
            sums = np.zeros((3, cells))
            used = np.array(columns)
            for batch in batches:
                bins, total = margin(batch)
                p = 1.0 / (1.0 + np.exp(-total))
                weight = batch["weight"].to_numpy(zero_copy_only=False)
                leaf = number[tree.leaves(bins)]
                keep = leaf >= 0
                if share < 1.0:
                    keep &= _uniform(batch["key"].to_numpy(zero_copy_only=False), seed) < share
                g = (weight * (p - batch["label"].to_numpy(zero_copy_only=False)))[keep]
                h = (weight * p * (1.0 - p))[keep]
                at = ((leaf[keep, None] * width + used) * 256 + bins[keep][:, used]).ravel()
                for k, w in enumerate((np.repeat(g, len(used)), np.repeat(h, len(used)), None)):
                    sums[k] += np.bincount(at, w, cells)
            some = np.flatnonzero(sums[2])
            leaf, feature, bin_ = np.array(asked)[some // (width * 256)] if len(some) else some, some // 256 % width, some % 256
            columns_out = (leaf, feature, bin_, sums[0][some], sums[1][some], sums[2][some])
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns_out, kinds)], names=list(names))

        parts = self.table.mapInArrow(run, "leaf int, feature int, bin int, g double, h double, n long")
        return parts.groupBy("leaf", "feature", "bin").agg(*(F.sum(c).alias(c) for c in ("g", "h", "n")))

    def written(self) -> Rows:
        """The same rows with all trees in their margins."""
        margin = self._margin()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, total = margin(batch)
                yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(total))

        return Rows(materialize(self.table.mapInArrow(run, self.table.schema), "boost-margins"), self.width)


# --- growth --------------------------------------------------------------------------


def _replay(nodes: list[Node], leaves: int) -> tuple[list[int], list[int]]:
    """Best-first growth with the splits known so far: nodes split, in order, and those whose split it lacks."""
    heap, done, count = [], [], 1

    def offer(k: int) -> bool:
        if not nodes[k].asked:
            return False
        if nodes[k].split:
            heapq.heappush(heap, (-round(nodes[k].split[2], 9), k))
        return True

    missing = [] if offer(0) else [0]
    while heap and count < leaves and not missing:
        _, k = heapq.heappop(heap)
        done.append(k)
        count += 1
        missing = [c for c in nodes[k].children or () if not offer(c)]
    return done, missing


def _grow(rows: Rows, columns: list[int], settings: LeafwiseSettings, seed: int, root: Node) -> tuple[Walk, list[Node], dict[int, float]]:
    nodes, asked = [root], [0]
    while asked:
        sums = rows.histogram(_walk(nodes), asked, columns, settings.row_share, seed)
        found = {r["leaf"]: r["split"] for r in best_splits(sums, settings).collect()}  # one row per leaf
        for k in asked:
            nodes[k].asked, nodes[k].split = True, found.get(k) and tuple(found[k])
            if nodes[k].split:
                _, _, _, g, h, n = nodes[k].split
                nodes[k].children = len(nodes), len(nodes) + 1
                nodes += [Node(g, h, n), Node(nodes[k].g - g, nodes[k].h - h, nodes[k].n - n)]
        done, missing = _replay(nodes, settings.leaves)
        if not missing:
            break
        # Needed now, and what may be needed next: the children of other leaves, largest gains first.
        others = sorted((k for k, n in enumerate(nodes) if n.children and k not in done), key=lambda k: -nodes[k].split[2])
        more = [c for k in others for c in nodes[k].children if not nodes[c].asked and nodes[c].n >= 2 * settings.least_rows]
        asked = list(dict.fromkeys(missing + more))[:_LEAVES_AT_ONCE]
    kept, values = set(done), {}
    for k, node in enumerate(nodes):
        if k not in kept:
            node.children = None
    for k in _reached(nodes):
        if not nodes[k].children:
            shrunk = max(abs(nodes[k].g) - settings.l1, 0.0) * (1 if nodes[k].g > 0 else -1)
            values[k] = -settings.step * shrunk / (nodes[k].h + settings.l2)
    return _walk(nodes, values), nodes, values


def _reached(nodes: list[Node]) -> list[int]:
    out, open_ = [], [0]
    while open_:
        k = open_.pop()
        out.append(k)
        open_ += nodes[k].children or ()
    return sorted(out)


def fit_leafwise(
    train: DataFrame, settings: LeafwiseSettings = LeafwiseSettings(), columns: tuple[str, ...] = FEATURES
) -> DataFrame:
    """``label`` (0, 1), ``weight`` and the columns -> a table of nodes (``trees.NODES``).

    The first tree is one leaf: the log odds of the weighted labels.  Rows whose
    value is missing or NaN go above every cut.  The model is the same for any
    partitioning, up to the rounding of sums.
    """
    spark = train.sparkSession
    cuts = cut_points(train, columns, settings.bins)
    rows = Rows(bin_table(train, cuts, columns), len(columns))
    share = rows.table.agg(F.sum(F.col("weight") * F.col("label")) / F.sum("weight")).first()[0]
    if share is None:
        raise ValueError("no rows to fit")
    share = min(max(share, 1e-9), 1 - 1e-9)
    base = log(share / (1 - share))
    out: list[tuple] = [(0, 0, -1, None, -1, -1, base)]
    rows.pending.append(Walk([-1], [-1], [-1], [-1], [base]))
    for k in range(settings.rounds):
        seed = settings.seed * 1_000_003 + k // max(1, settings.rows_anew)
        take = max(1, round(settings.column_share * len(columns)))
        chosen = sorted(random.Random(settings.seed * 7_919 + k).sample(range(len(columns)), take))
        tree, nodes, values = _grow(rows, chosen, settings, seed, _root(rows, settings, seed))
        if not nodes[0].children:
            break
        rows.pending.append(tree)
        for i in _reached(nodes):
            n = nodes[i]
            if n.children:
                out.append((k + 1, i, n.split[0], float(cuts[n.split[0]][n.split[1]]), *n.children, 0.0))
            else:
                out.append((k + 1, i, -1, None, -1, -1, float(values[i])))
        if len(rows.pending) > settings.write_every:
            rows = rows.written()
    return spark.createDataFrame(out, NODES)  # rounds x leaves rows


def _root(rows: Rows, settings: LeafwiseSettings, seed: int) -> Node:
    """Sums over all drawn rows: those of any one column."""
    tree = Walk([-1], [-1], [-1], [-1], [0.0])
    row = rows.histogram(tree, [0], [0], settings.row_share, seed).agg(*(F.sum(c) for c in ("g", "h", "n"))).first()
    return Node(*(v or 0 for v in row))
