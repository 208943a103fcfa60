"""Calls and input reads in texts with very long runs of block comments.

Several signatures allow any number of comments between a name and its
bracket.  The JVM's regex engine needs stack for each repetition, so a run of
some thousand comments, an easy trick for a hostile file, would end the
executor.  Such texts are matched here instead, with a plain search over the
places where a run can stop.  All other texts never come here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import types as T

from vigilrow.functions import patterns as P

MOST_ADJACENT = 400  # adjacent comments the JVM takes safely
ADJACENT = r"\*/\s*/\*"

RUNS_TYPE = T.StructType(
    [
        T.StructField("exec_at", T.ArrayType(T.IntegerType())),
        T.StructField("exec_eval", T.ArrayType(T.BooleanType())),
        T.StructField("input_at", T.ArrayType(T.IntegerType())),
        T.StructField("decode_count", T.IntegerType()),
        T.StructField("dynamic_count", T.IntegerType()),
        T.StructField("assign_exec", T.BooleanType()),
        T.StructField("filter_exec", T.BooleanType()),
    ]
)

_SPACE = re.compile(r"\s*")
_EXEC = re.compile(P.EXEC_CALL.removesuffix(P.COMMENT_RUN), re.I)
_DECODE = re.compile(P.DECODE_CALL.removesuffix(P.COMMENT_RUN), re.I)
_DYNAMIC = re.compile(P.DYNAMIC_CALL.removesuffix(P.COMMENT_RUN), re.I)
_DIRECT_INPUT, _ = P.INPUT_ACCESS.split(r"|Request\s*", 1)
_INPUT = re.compile(f"(?P<direct>{_DIRECT_INPUT})|Request", re.I)
_PART = re.compile(r"Form|QueryString|Params|Cookies", re.I)
_ITEM = re.compile(r"Item", re.I)
_SINK = re.compile(r"\b(eval|assert|system|exec|shell_exec|passthru)\b", re.I)
_FILTER_HEAD, _ = P.BY_COLUMN["behavior_filterinput_exec"].regex.split(r"[\s\S]{0,350}?", 1)
_ASSIGN_HEAD, _ = P.BY_COLUMN["has_assign_input_then_exec"].regex.split(r"[\s\S]{0,500}?", 1)
_FILTER = re.compile(_FILTER_HEAD, re.I | re.S)
_ASSIGN = re.compile(_ASSIGN_HEAD, re.I | re.S)


def run_stops(text: str, at: int, longest: int) -> Iterator[int]:
    """Where a run of comments of at most ``longest`` characters, starting at
    ``at``, can stop: the preferred stop first, every stop once."""
    seen: set[int] = set()
    todo = [_SPACE.match(text, at).end()]
    while todo:
        here = todo.pop()
        if here in seen:
            continue
        seen.add(here)
        if not text.startswith("/*", here):
            yield here
            continue
        ends, end = [], text.find("*/", here + 2, here + longest + 4)
        while end >= 0:
            ends.append(_SPACE.match(text, end + 2).end())
            end = text.find("*/", end + 1, here + longest + 4)
        todo += reversed(ends)  # the shortest comment is tried first


def after_run(text: str, at: int, longest: int, closing: str) -> Iterator[int]:
    """Ends of ``closing`` behind a run that starts at ``at``."""
    for stop in run_stops(text, at, longest):
        if text.startswith(closing, stop):
            yield stop + len(closing)


def calls(text: str, names: re.Pattern) -> list[tuple[int, int]]:
    """(start, end) of each name followed by a run and an opening bracket."""
    found, at = [], 0
    while match := names.search(text, at):
        end = next(after_run(text, match.end(), 80, "("), None)
        if end is not None:
            found.append((match.start(), end))
        at = match.start() + 1 if end is None else end
    return found


def _request_end(text: str, at: int) -> int | None:
    """End of a request accessor whose ``Request`` ends at ``at``."""

    def member(names: re.Pattern) -> int | None:
        for dot in after_run(text, at, 50, "."):
            for stop in run_stops(text, dot, 50):
                if name := names.match(text, stop):
                    for end in after_run(text, name.end(), 50, "["):
                        return end
        return None

    return member(_PART) or next(after_run(text, at, 50, "["), None) or member(_ITEM)


def inputs(text: str) -> list[int]:
    found, at = [], 0
    while match := _INPUT.search(text, at):
        end = match.end() if match["direct"] is not None else _request_end(text, match.end())
        if end is not None:
            found.append(match.start())
        at = match.start() + 1 if end is None else end
    return found


def _sink_calls(text: str, start: int, gap: int) -> Iterator[int]:
    """Ends of sink calls that begin at most ``gap`` characters behind ``start``."""
    at = start
    while (match := _SINK.search(text, at)) and match.start() <= start + gap:
        yield from after_run(text, match.end(), 80, "(")
        at = match.start() + 1


def filter_then_exec(text: str) -> bool:
    return any(True for head in _FILTER.finditer(text) for _ in _sink_calls(text, head.end(), 350))


def assign_then_exec(text: str) -> bool:
    at = 0
    while head := _ASSIGN.search(text, at):
        same = re.compile(r"\s*(?:\w+\s*\(\s*){0,3}\$" + re.escape(head[1]) + r"\b", re.I)
        if any(same.match(text, end) for end in _sink_calls(text, head.end(), 500)):
            return True
        at = head.start() + 1
    return False


def measure(text: str) -> tuple:
    found = calls(text, _EXEC)
    return (
        [start for start, _ in found],
        ["eval" in text[start:end].lower() for start, end in found],
        inputs(text),
        len(calls(text, _DECODE)),
        len(calls(text, _DYNAMIC)),
        assign_then_exec(text),
        filter_then_exec(text),
    )
