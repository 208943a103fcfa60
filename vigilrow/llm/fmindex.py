"""A compressed FM-index over word numbers, for matching statistics up to a depth.

The text is cut into segments; suffixes are sorted by their first ``depth``
words, which is all that patterns of up to ``depth`` words need.  The
Burrows-Wheeler transform is kept as a wavelet matrix, and backward search adds
one word on the left of all streamed sequences at once.
"""

from __future__ import annotations

import numpy as np

from vigilrow.llm.wavelet import WaveletMatrix


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the keys and the dense rank of each."""
    order = np.argsort(key, kind="stable")
    step = np.concatenate([[False], key[order][1:] != key[order][:-1]])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(step)
    return order, rank


class FMIndex:
    """``words``: numbers from 1; 0 ends each segment, the last one too."""

    def __init__(self, words: np.ndarray, depth: int):
        self.depth, self.n = depth, len(words)
        order, rank = _dense(words)
        known = 1
        while known < depth:
            step = min(known, depth - known)
            later = np.zeros(self.n, np.int64)
            later[: self.n - step] = rank[step:] + 1 if step < self.n else 0
            order, rank = _dense(rank * (self.n + 2) + later)
            known += step
        self.suffix = order
        padded = np.concatenate([words, np.zeros(depth, words.dtype)])
        alive = np.ones(self.n, bool)
        alive[0] = False
        self.common = np.zeros(self.n, np.int16)
        for d in range(depth):  # words that a suffix shares with the one before it
            alive[1:] &= padded[order[1:] + d] == padded[order[:-1] + d]
            self.common += alive
        self.levels = max(1, int(words.max()).bit_length()) if self.n else 1
        self.bwt = WaveletMatrix.of(words[order - 1], self.levels)
        counts = np.bincount(words, minlength=(1 << self.levels))
        self.first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        every = np.arange(len(self.first))
        self.base = self.first - self.bwt.descend(every, np.zeros(len(every), np.int64))
        self._spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def span(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix, the range of suffixes that share its first ``depth`` words."""
        if depth not in self._spans:
            starts = np.flatnonzero(self.common < depth) if depth else np.zeros(1, np.int64)
            sizes = np.diff(np.append(starts, self.n))
            self._spans[depth] = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
        return self._spans[depth]

    def extend(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the patterns with one more word on their left."""
        return self.base[word] + self.bwt.descend(word, low), self.base[word] + self.bwt.descend(word, high)

    def matching_statistics(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest match (up to ``depth``) that starts at each word, and its lowest suffix row.

        ``words`` holds many sequences, [start, end) each; numbers unknown to
        the index must be given as -1.  All sequences advance together.
        """
        length, row = np.zeros(len(words), np.int16), np.zeros(len(words), np.int64)
        order = np.argsort(-(ends - starts), kind="stable")
        starts, ends = starts[order], ends[order]
        sizes = ends - starts
        low, high, depth = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64), np.zeros(len(starts), np.int64)
        for back in range(1, int(sizes.max(initial=0)) + 1):
            live = int(np.searchsorted(-sizes, -back, side="right"))  # the longest sequences come first
            at = ends[:live] - back
            word = words[at]
            todo = np.arange(live)
            lost = todo[word < 0]
            low[lost], high[lost], depth[lost] = 0, self.n, 0
            todo = todo[word >= 0]
            while len(todo):
                full = todo[depth[todo] == self.depth]
                self._shorten(full, low, high, depth)
                new_low, new_high = self.extend(word[todo], low[todo], high[todo])
                ok = new_low < new_high
                done = todo[ok]
                low[done], high[done] = new_low[ok], new_high[ok]
                depth[done] += 1
                todo = todo[~ok]
                todo = todo[depth[todo] > 0]  # a word that never occurs keeps depth 0
                self._shorten(todo, low, high, depth)
            length[at], row[at] = depth[:live], low[:live]
        return length, row

    def _shorten(self, which: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> None:
        """Drop the last word of some patterns."""
        for d in np.unique(depth[which]):
            part = which[depth[which] == d]
            start, end = self.span(int(d) - 1)
            low[part], high[part] = start[low[part]], end[low[part]]
            depth[part] = d - 1

    def least(self, owner: np.ndarray) -> np.ndarray:
        """For each suffix row, the smallest owner among the suffixes that share all ``depth`` words."""
        start, _ = self.span(self.depth)
        starts = np.flatnonzero(self.common < self.depth)
        return np.repeat(np.minimum.reduceat(owner[self.suffix], starts), np.diff(np.append(starts, self.n))) if self.n else owner
