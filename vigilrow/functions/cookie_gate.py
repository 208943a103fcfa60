"""The cookie-hash-gate signature, found from the places of its parts.

Its table pattern has two open gaps, one to the end of the line and one of up to
600 characters, which a backtracking engine tries against each other: a text of
repeated comparisons with no call at the end holds a task for a time that grows
with the square of its length.  Here heads, comparisons and calls are listed
once, and each comparison looks up the head before it and the call after it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

# The parts between the gaps; a comparison begins with the only bracket in it.
_HEAD = re.compile(r"md5\s*\(\s*@?\$_COOKIE\[", re.I)
_COMPARED = re.compile(r"""\]\s*\)\s*==={0,2}\s*["'][0-9a-f]{16,32}["']""", re.I)
_CALL = re.compile(r"@?\$_\s*\(")
_REACH = 600


def has_cookie_gate(text: str) -> bool:
    """Whether the signature's pattern matches anywhere in the text."""
    heads = [m.end() for m in _HEAD.finditer(text)]
    if not heads:
        return False
    calls = [m.start() for m in _CALL.finditer(text)]
    lines = [m.start() for m in re.finditer("\n", text)]
    for m in _COMPARED.finditer(text, heads[0]):
        k = bisect_left(calls, m.end())
        if k == len(calls) or calls[k] > m.end() + _REACH:
            continue
        # The last head that ends here or before, if no line ends between.
        head = heads[bisect_right(heads, m.start()) - 1]
        line = bisect_left(lines, head)
        if line == len(lines) or lines[line] >= m.start():
            return True
    return False
