"""Character statistics of texts.

Counting every character needs one pass over the text.  Spark has no built-in
for it: with array and replace functions the cost is distinct characters times
length (measured 20 times slower than this), so this is the one place in the
feature job where text goes to Python by default.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import types as T

SHAPE_TYPE = T.StructType(
    [
        T.StructField(name, T.DoubleType() if name.endswith("entropy") else T.IntegerType())
        for name in (
            "chars", "lines", "entropy", "digits", "symbols", "spaces",
            "stripped_chars", "stripped_entropy", "stripped_symbols",
        )
    ]
)


def char_histogram(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points, counts)"""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if points.size and points.max() < 0x4000:
        counts = np.bincount(points)
        seen = np.flatnonzero(counts)
        return seen, counts[seen]
    return np.unique(points, return_counts=True)


def entropy_of(counts: np.ndarray) -> float:
    if not counts.size:
        return 0.0
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum())


def _measure(code: str | None, stripped: str | None) -> tuple:
    if code is None:
        return (None,) * len(SHAPE_TYPE.names)
    points, counts = char_histogram(code)
    digits = symbols = spaces = 0
    for point, n in zip(points.tolist(), counts.tolist()):
        char = chr(point)
        if char.isalnum():
            if char.isdigit():
                digits += n
        elif char.isspace():
            spaces += n
        else:
            symbols += n
    plain_points, plain_counts = char_histogram(stripped)
    plain_symbols = 0
    for point, n in zip(plain_points.tolist(), plain_counts.tolist()):
        char = chr(point)
        if not (char.isspace() or (point < 128 and char.isalnum())):
            plain_symbols += n
    return (
        max(len(code), 1), max(len(code.splitlines()), 1), entropy_of(counts), digits, symbols, spaces,
        len(stripped), entropy_of(plain_counts), plain_symbols,
    )
