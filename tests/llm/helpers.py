"""Plain-Python versions of the operators' results, and small awkward tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, words string, score string"


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    rows = [
        (None, None), (None, "alpha beta gamma"), (1, None), (2, ""), (3, "   \n\t "), (4, long), (5, long), (6, "a b c"), (7, "a b c"), (7, "a b c"),
        (8, "Der Hund und die Katze sind im Haus und schlafen dort jede Nacht ohne Decke weil es warm ist"), (9, "x" * 5000), (10, "é\U0001f600 " * 40), (11, "... !!! ???"),
        (2**62, "last one of them all"), (-5, "first one of them all"),
    ]
    return spark.createDataFrame([(i, t, "de" if i == 8 else "en" if t else None, None, None, 1, "w", "s") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(rows, percent=75, shingle=5):
    """doc_id -> (set size, smallest reachable id), comparing all pairs that share a shingle."""
    sets = {}
    for i, text in rows:
        w = WORD.findall(fold(text or ""))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < shingle else [tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for g in sets[i]:
            for j in owners[g]:
                shared[j] += 1
            owners[g].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def cut_words(rows, window=13):
    """doc_id -> (words, removed, digest of the kept words)."""
    first, out = {}, {}
    for i, text in sorted(rows):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(a for a, g in zip(w, gone) if not g)
        out[i] = len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out
