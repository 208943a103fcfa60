"""Periodic runs of words, from maximal pairs of a bottom-up LCP-interval tree.

A run is a stretch of words with smallest period q and at least ``exponent * q``
words that no neighbour extends.  Its start s and s + q are a *maximal pair*: the
words from both places are equal for exactly length - q words, and the words to
their left differ.  Conversely a maximal pair at distance d with at least
(exponent - 1) * d equal words spans a stretch with period d that ends where the
pair ends, on both sides; so pairs need no extension, only the length test.

For each text: a suffix array of the places whose first ``seed`` words occur
again (no other place can be in such a pair), the lengths of common prefixes, and
the tree of LCP intervals from the leaves upward.  A node holds its places in
text order with their classes, the words to their left.  Where children meet,
neighbouring places of different children and different classes are the pairs.
Only neighbours matter: another occurrence between two places of a pair would
give a smaller period.  A multiple of the smallest period spans the same stretch,
so of pairs with one start and end the nearest counts.

Texts are independent: a map over rows, no shuffle, and nothing is collected.

Cases: a null or empty text has no words, no runs, and four nulls for the longest
run.  Ties for the longest run go to the smallest start, then period.  Texts are
taken whole; the smaller child is merged into the larger, so a long text costs
n log n.  Repeated rows give repeated rows; an empty table gives none.  Other
columns, whatever their names, are passed over.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import gram_hashes, map_rows, word_bounds, word_hashes

#: A run has at least EXPONENT periods and LEAST words.
EXPONENT = 4
LEAST = 6

Run = tuple[int, int, int]  # start, length, period


def repeated_places(words: np.ndarray, seed: int) -> np.ndarray:
    """Places whose first ``seed`` words (given as hashes) stand at another place too."""
    grams = gram_hashes(words, seed)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return np.flatnonzero(twice)


def suffix_order(ids: np.ndarray) -> np.ndarray:
    """The suffix array of a list of numbers, by doubling; only suffixes still tied are sorted again."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(np.concatenate([[True], ids[order[1:]] != ids[order[:-1]]]), np.arange(n), 0))
    rank[order] = head
    size = np.bincount(head, minlength=n)
    open_places = order[size[head] > 1]
    width = 1
    while len(open_places):
        # Tied places stand together and in order of rank; a rank is the place of its group's first member.
        group = rank[open_places]
        beyond = open_places + width
        then = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], -1)
        by = np.lexsort((then, group))
        open_places, group, then = open_places[by], group[by], then[by]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])])
        first = np.concatenate([[True], group[1:] != group[:-1]])
        at = np.arange(len(group))
        inside = at - np.maximum.accumulate(np.where(first, at, 0))
        order[group + inside] = open_places
        head = (group + inside)[np.maximum.accumulate(np.where(new, at, 0))]
        rank[open_places] = head
        tied = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
        open_places = open_places[tied]
        width *= 2
    return order


def common_prefixes(ids: list[int], order: list[int]) -> list[int]:
    """For each entry of the suffix array the words it shares with the one before; in text order, so linear."""
    n = len(ids)
    before = [-1] * n
    for k in range(1, n):
        before[order[k]] = order[k - 1]
    shared, h = [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0:
            h = 0
            continue
        limit = n - max(i, j)
        while h < limit and ids[i + h] == ids[j + h]:
            h += 1
        shared[i] = h
        if h:
            h -= 1
    return [shared[i] for i in order]


def _meet(children: list[list[int]], pair: Callable[[int, int], None]) -> list[int]:
    """All places of a node in text order; ``pair`` sees neighbours of different children."""
    children.sort(key=len)
    large = children.pop()
    if sum(map(len, children)) > 8:
        owner = {place: k for k, child in enumerate(children) for place in child}
        for child in children:
            large += child
        large.sort()
        for i, j in zip(large, large[1:]):
            if owner.get(i, -1) != owner.get(j, -1):
                pair(i, j)
        return large
    for child in children:
        at = [bisect_left(large, i) for i in child]
        for i, k in zip(child, at):
            if k:
                pair(large[k - 1], i)
            if k < len(large):
                pair(i, large[k])
        for i, k in zip(reversed(child), reversed(at)):
            large.insert(k, i)
    return large


def runs(ids: list[int], exponent: int = EXPONENT, least: int = LEAST) -> list[Run]:
    """All runs of a list of numbers, by start, then period."""
    n = len(ids)
    if n < least:
        return []
    order = suffix_order(np.asarray(ids, np.int64)).tolist()
    shared = common_prefixes(ids, order)
    # A pair's words: at least (exponent - 1) periods, and with the period at least ``least``.
    lowest = min(max((exponent - 1) * d, least - d) for d in range(1, least + 1))
    nearest: dict[tuple[int, int], int] = {}
    height = 0

    def pair(i: int, j: int) -> None:
        d = j - i
        if (exponent - 1) * d <= height and d + height >= least and (i == 0 or ids[i - 1] != ids[j - 1]):
            key = i, j + height
            if d < nearest.get(key, n):
                nearest[key] = d

    stack: list[tuple[int, list[list[int]]]] = []
    for k in range(1, n + 1):
        h = shared[k] if k < n else 0
        if h < lowest:
            h = 0
            if not stack:
                continue
        node = [order[k - 1]]
        while stack and stack[-1][0] > h:
            height, children = stack.pop()
            children.append(node)
            node = _meet(children, pair)
        if h:
            if stack and stack[-1][0] == h:
                stack[-1][1].append(node)
            else:
                stack.append((h, [node]))
    return sorted((start, end - start, d) for (start, end), d in nearest.items())


def text_runs(data: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, list[Run]]:
    """Word bounds of a UTF-8 text and its runs."""
    start, end = word_bounds(data)
    if len(start) < least:
        return start, end, []
    seed = min(max((exponent - 1) * d, least - d) for d in range(1, least + 1))
    places = repeated_places(word_hashes(data, start, end), seed)
    if not len(places):
        return start, end, []
    # Stretches of words that repeated places begin, apart from each other by a word that occurs nowhere else.
    wanted = np.zeros(len(start) + 1, np.int64)
    np.add.at(wanted, places, 1)
    np.add.at(wanted, np.minimum(places + seed, len(start)), -1)
    inside = np.cumsum(wanted[:-1]) > 0
    raw = data.tobytes()
    numbers: dict[bytes, int] = {}
    at = np.flatnonzero(inside)
    ids, origin, last = [], [], -2
    for i, a, b in zip(at.tolist(), start[at].tolist(), end[at].tolist()):
        if i != last + 1:
            ids.append(-len(ids) - 1)
            origin.append(i - 1)
        ids.append(numbers.setdefault(raw[a:b], len(numbers)))
        origin.append(i)
        last = i
    ids.append(-len(ids) - 1)
    return start, end, [(origin[s], length, q) for s, length, q in runs(ids, exponent, least)]


_RUNS = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"


def collapse(words: list[bytes], found: list[Run]) -> bytes:
    """The text with each run cut to its first period."""
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        gone[start + q] += 1
        gone[start + length] -= 1
    kept = np.cumsum(gone) == 0
    return b" ".join(w for w, k in zip(words, kept) if k)


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, the runs as three lists (by start, then period) and the collapsed text of each row."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = {name.split()[0]: [] for name in _RUNS.split(", ")}
            out["doc_id"] = batch["doc_id"]
            for value in batch["text"].to_pylist():
                raw = (value or "").encode()
                start, end, found = text_runs(np.frombuffer(raw, np.uint8), exponent, least)
                out["n_words"].append(len(start))
                for k, name in enumerate(("starts", "lengths", "periods")):
                    out[name].append([run[k] for run in found])
                out["collapsed"].append(collapse(raw.split(), found).decode())
            return out

        return work

    return map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), make, _RUNS)




def digest(found: DataFrame) -> DataFrame:
    """The number of runs, the longest one, and digests of the list of runs and of the collapsed text."""
    listed = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.concat_ws(",", r["starts"], r["lengths"], r["periods"]))
    lines = F.concat_ws("", F.transform(listed, lambda r: F.concat(r, F.lit("\n"))))
    # Longest first, then the smaller start and period.
    ranked = F.array_max(
        F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.struct(r["lengths"].alias("n"), (-r["starts"]).alias("s"), (-r["periods"]).alias("p")))
    )
    return found.withColumn("top", ranked).select(
        "doc_id", F.size("starts").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.n").alias("length"),
        (-F.col("top.p")).alias("period"), F.floor(F.col("top.n") * 1000 / -F.col("top.p")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_tails(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text; every tenth document (by the digest of its id) ends in a periodic tail of its own words.

    With h the crc32 of the id, g = h div 10 and n words: for h mod 10 = 0 the
    words from a = g mod n on become the words a + (i - a) mod p, where
    p = 1 + (n - a) div (3 + g mod 8).  Other texts stay as they are, as do those
    with a null id.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chosen = chosen.withColumn("plant", F.coalesce(h % 10 == 0, F.lit(False))).withColumn("words", F.when(F.col("plant"), words))
    n = F.size("words")
    chosen = chosen.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    tail = F.transform(
        F.sequence(F.lit(0).cast("long"), n.cast("long") - 1),
        lambda i: F.element_at("words", (F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")) + 1).cast("int")),
    )
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))
