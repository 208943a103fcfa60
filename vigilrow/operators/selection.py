"""Exact order statistics of many columns at once, by repeated range counts over wide rows.

Doubles are put in order as whole numbers.  For each rank that is asked for, an
interval is known that holds its value; a round cuts every interval into parts
and counts rows per part, with the smallest and largest value seen in it.  The
part that holds the rank is the next interval, already shrunk to values that
occur.  When its ends are equal, the value is found.  Each round is one pass
over the rows as they are, without a row per column; what leaves a task is
parts x ranks numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARTS = 64
#: Ranks whose counts are summed together.
_BLOCK = 64
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def ordered_numbers(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order; both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(_HIGH), bits)


def as_doubles(k: np.ndarray) -> np.ndarray:
    k = np.asarray(k, np.int64)
    return np.where(k < 0, k ^ np.int64(_HIGH), k).view(np.float64)


@dataclass
class Target:
    column: int
    rank: int  # from 0
    low: int = _LOW
    high: int = _HIGH
    before: int = 0  # rows below ``low``


def _edges(t: Target) -> np.ndarray:
    """Where the parts of an interval begin."""
    width = t.high - t.low  # Python integers: may exceed 64 bits
    return np.array(sorted({t.low + width * k // _PARTS for k in range(_PARTS)}), np.int64)


def _round(rows: DataFrame, targets: list[Target]) -> list[np.ndarray]:
    """For each target: rows per part, and the smallest and largest number in each."""
    edges = [_edges(t) for t in targets]
    wanted = sorted({t.column for t in targets})
    blocks = range(0, len(targets), _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(targets), _PARTS), np.int64)
        least, most = np.full(count.shape, _HIGH), np.full(count.shape, _LOW)
        for batch in batches:
            column = {}
            for c in wanted:
                x = batch[f"x{c}"].to_numpy(zero_copy_only=False)
                column[c] = np.sort(ordered_numbers(x[~np.isnan(x)]))
            for k, t in enumerate(targets):
                x = column[t.column]
                cut = np.append(np.searchsorted(x, edges[k]), np.searchsorted(x, t.high, side="right"))
                some = np.flatnonzero(np.diff(cut) > 0)
                count[k, some] += np.diff(cut)[some]
                least[k, some] = np.minimum(least[k, some], x[cut[some]])
                most[k, some] = np.maximum(most[k, some], x[cut[some + 1] - 1])
        for b in blocks:
            part = slice(b, b + _BLOCK)
            columns = [[b], [count[part].tobytes()], [least[part].tobytes()], [most[part].tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "n", "low", "high"])

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        both = [np.stack([np.frombuffer(v, np.int64) for v in part[c]]) for c in ("n", "low", "high")]
        out = both[0].sum(axis=0), both[1].min(axis=0), both[2].max(axis=0)
        return pd.DataFrame({"block": [part["block"].iloc[0]], **{c: [v.tobytes()] for c, v in zip(("n", "low", "high"), out)}})

    schema = "block int, n binary, low binary, high binary"
    got = sorted(rows.mapInArrow(run, schema).groupBy("block").applyInPandas(merged, schema).collect(), key=lambda r: r["block"])
    n, low, high = (np.concatenate([np.frombuffer(r[c], np.int64).reshape(-1, _PARTS) for r in got]) for c in ("n", "low", "high"))
    return [np.stack([n[k], low[k], high[k]]) for k in range(len(targets))]


def quantiles(df: DataFrame, columns: tuple[str, ...], shares: tuple[float, ...]) -> dict[str, tuple[float | None, ...]]:
    """The exact quantiles of each column, between two values by their distance; missing and NaN values do not count."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"x{k}") for k, c in enumerate(columns)]
    rows = df.select(*values)
    sizes = rows.agg(*[F.count(F.when(~F.isnan(f"x{k}"), 1)).alias(f"n{k}") for k in range(len(columns))]).first()
    known: dict[tuple[int, int], int] = {}
    places = {}
    for k in range(len(columns)):
        for share in shares:
            at = (sizes[k] - 1) * share
            low = int(np.floor(at))
            places[k, share] = low, int(np.ceil(at)), at - low
    targets = [Target(k, r) for k, r in sorted({(k, r) for (k, _), place in places.items() for r in place[:2] if sizes[k]})]
    while targets:
        left = []
        for t, (n, low, high) in zip(targets, _round(rows, targets), strict=True):
            upto = t.before + np.cumsum(n)
            part = int(np.searchsorted(upto, t.rank, side="right"))
            t.before, t.low, t.high = int(upto[part] - n[part]), int(low[part]), int(high[part])
            if t.low == t.high:
                known[t.column, t.rank] = t.low
            else:
                left.append(t)
        targets = left
    found = {key: float(as_doubles(np.array([v]))[0]) for key, v in known.items()}
    out = {}
    for k, name in enumerate(columns):
        row = []
        for share in shares:
            low, high, beyond = places[k, share]
            if not sizes[k]:
                row.append(None)
            elif not beyond:  # infinite values have no distance
                row.append(found[k, low])
            else:
                row.append(found[k, low] + (found[k, high] - found[k, low]) * beyond)
        out[name] = tuple(row)
    return out
