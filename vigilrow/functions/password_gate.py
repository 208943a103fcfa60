"""The password-gate signature, found from the places of its parts.

Its table pattern has several open gaps in a row, which a backtracking engine
tries against each other: some thousand characters of a hostile text hold a
task for minutes.  Here each part is listed once, and the gaps are resolved by
searching the sorted places, so a text costs about its length.

All gaps of the pattern are of two kinds: ``.*?`` stays on one line, and
``[^)]*`` passes no closing parenthesis.  So the earliest keyword after an input
access on its line is as good as any, and of the parts before an access the
last ones are.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

_ACCESS = r"\$_(?:POST|REQUEST|COOKIE)\["
_IF, _SESSION = re.compile(r"if\s*\(", re.I), re.compile(r"\$_SESSION", re.I)
_DIRECT = re.compile(rf"if\s*\(\s*{_ACCESS}", re.I)
_INPUT = re.compile(_ACCESS, re.I)
_KEYWORD = re.compile("pass|pwd|key|auth", re.I)
_COMPARED = re.compile(r"\](?=\s*(?:==|!=)=?)")
_UNEQUAL = re.compile(r"\](?=\s*!=)")
_WITH_VARIABLE = re.compile(r"(?:==|!=)=?(?=\s*\$\w)")


def _starts(pattern: re.Pattern, text: str) -> list[int]:
    return [m.start() for m in pattern.finditer(text)]


def _places(text: str, what: str) -> list[int]:
    return [m.start() for m in re.finditer(re.escape(what), text)]


def _next(places: list[int], at: int, none: int) -> int:
    k = bisect_left(places, at)
    return places[k] if k < len(places) else none


def _last(places: list[int], before: int) -> int:
    """The last place below ``before``, -1 if there is none."""
    k = bisect_left(places, before)
    return places[k - 1] if k else -1


def has_password_gate(text: str) -> bool:
    """Whether the signature's pattern matches anywhere in the text."""
    words = [(m.start(), m.end()) for m in _KEYWORD.finditer(text)]
    if not words:
        return False
    word_starts = [w[0] for w in words]
    lines, closings, compared = _places(text, "\n"), _places(text, ")"), _starts(_COMPARED, text)
    n = len(text)

    def line_after(at: int) -> tuple[int, int]:
        """End of the first keyword after ``at`` on its line, and the end of the line; (n + 1, n) if there is none."""
        end = _next(lines, at, n)
        k = bisect_left(word_starts, at)
        return (words[k][1], end) if k < len(words) and words[k][1] <= end else (n + 1, n)

    for m in _DIRECT.finditer(text):
        word, end = line_after(m.end())
        if _next(compared, word, n + 1) < end:
            return True

    # Brackets after which a comparison with a variable comes before any closing parenthesis.
    # Two tests may overlap in '!==' or '===$x': the later start is tried as well.
    tests = sorted({*_starts(_WITH_VARIABLE, text), *(k + 1 for k in _starts(_WITH_VARIABLE, text) if _WITH_VARIABLE.match(text, k + 1))})
    brackets = _places(text, "]")
    tested = [b for b in brackets if _next(tests, b + 1, n) < _next(closings, b + 1, n)]
    unequal = _starts(_UNEQUAL, text)
    ifs = [(m.start(), m.end()) for m in _IF.finditer(text)]
    if_ends = [e for _, e in ifs]
    sessions, ors = [(m.start(), m.end()) for m in _SESSION.finditer(text)], _places(text, "||")
    session_ends = [e for _, e in sessions]
    ors = sorted({*ors, *(k + 1 for k in ors if text.startswith("||", k + 1))})

    def if_before(at: int) -> int:
        """Start of the last ``if (`` that ends at ``at`` or before, -1 if there is none."""
        k = bisect_right(if_ends, at)
        return ifs[k - 1][0] if k else -1

    for m in _INPUT.finditer(text):
        closed = _last(closings, m.start())
        if if_before(m.start()) <= closed:
            continue
        word, end = line_after(m.end())
        if word > n:
            continue
        if _next(tested, word, n + 1) < end:
            return True
        if _next(unequal, word, n + 1) < end:
            either = _last(ors, m.start() - 1)
            k = bisect_right(session_ends, either)
            if either >= 0 and k and if_before(sessions[k - 1][0]) > closed:
                return True
    return False
