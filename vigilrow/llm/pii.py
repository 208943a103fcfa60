"""Personal data in plain sight and in disguise, with spans in the source text.

Plain identifiers (email, ip, card, phone) are found by their patterns.  For
disguised ones a text passes three transducers, each of which rewrites pieces
and remembers where they stood:

1. *look-alikes*: full-width, mathematical, circled and other-script forms of
   ASCII characters, Cyrillic and Greek letters that look Latin, typographic
   dashes and spaces; invisible characters vanish;
2. *spelled digits*: runs of digit words (four languages), with "plus", "dot";
3. *at and dot*: bracketed forms anywhere in an address, bare " at " only
   before a domain whose dot is disguised too and that ends in a known label ("jane
   at site dot org"), so that plain prose ("look at example.com", "at this dot") stays.

The same patterns then run on the rewritten text, and a match that covers a
rewritten piece is mapped back, through each transducer, to code points of the
source.  Plain matches always stay; a disguised one is added.

Texts are independent: a map over rows, no shuffle.  Patterns take time linear
in the text: no repeat can start again inside a failed one.

Cases: a null or empty text has no spans.  Ties: by start, then kind as listed,
then end.  Repeated rows give repeated rows, an empty table none; other columns
are passed over.  Very long texts are taken whole.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import map_rows

KINDS = ("email", "ip", "card", "phone")

Span = tuple[str, int, int]

# --- plain identifiers ---------------------------------------------------------------

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match never ends before a digit, so none starts after one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # All of a run of name characters before an @ belongs to the match, unless an earlier match holds a part of it.
    least, at = 0, text.find("@")
    while at >= 0:
        name = text[least:at]
        start = least + len(name.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            at = domain.end() - 1
        least = at + 1
        at = text.find("@", least)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def identifiers(text: str) -> list[Span]:
    """Plain identifiers by start, then kind."""
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- transducers ---------------------------------------------------------------------


class Rewritten:
    """A text with pieces replaced, and the way back to the source."""

    def __init__(self, source: str, pieces: list[tuple[int, int, str]]):
        parts, self.old, self.new = [], [], []
        last = size = 0
        for start, end, value in pieces:
            parts += (source[last:start], value)
            size += start - last
            self.old.append((start, end))
            self.new.append((size, size + len(value)))
            size, last = size + len(value), end
        self.text = "".join(parts) + source[last:]

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of the rewritten text; a replaced piece counts as a whole."""
        return self._place(start)[0], self._place(end - 1)[1]

    def _place(self, at: int) -> tuple[int, int]:
        k = bisect_right(self.new, at, key=lambda piece: piece[0]) - 1
        # Pieces replaced by nothing share their place with what follows them.
        if k < 0:
            return at, at + 1
        (_, new_end), (old_start, old_end) = self.new[k], self.old[k]
        if at < new_end:
            return old_start, old_end
        return old_end + at - new_end, old_end + at - new_end + 1


# Letters that look like Latin ones.
_CYRILLIC = "АВЕЅІЈКМНОРСТХУаеѕіјорсухԁԛԝһ"
_CYRILLIC_AS = "ABESIJKMHOPCTXYaesijopcyxdqwh"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ"
_GREEK_AS = "ABEZHIKMNOPTYXovp"
# Typographic dashes, spaces, full stops, and invisible characters.
_DASHES = "‐‑‒–—―−"
_SPACES = "              　"
_STOPS = "。｡․"
_INVISIBLE = "­᠎​‌‍⁠﻿"


@cache
def look_alikes() -> dict[int, str]:
    """Code point -> the one ASCII character that it stands for."""
    found = {}
    for point in range(0x80, 0x110000):
        char = chr(point)
        form = unicodedata.decomposition(char)
        if form.startswith(("<wide>", "<narrow>", "<font>", "<circle>", "<small>")):
            plain = unicodedata.normalize("NFKC", char)
            if len(plain) == 1 and " " <= plain <= "~":
                found[point] = plain
        elif unicodedata.category(char) == "Nd":
            found[point] = str(unicodedata.digit(char))
    for chars, plain in ((_CYRILLIC, _CYRILLIC_AS), (_GREEK, _GREEK_AS), (_DASHES, "-" * 7), (_SPACES, " " * 15), (_STOPS, "...")):
        found |= {ord(a): b for a, b in zip(chars, plain, strict=True)}
    return found


_HIDDEN = re.compile(f"[{_INVISIBLE}]+")


def _all_plain(text: str) -> bool:
    """Whether a text holds no look-alike: below U+0100 only two characters are ones."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "\xa0" not in text and "\xad" not in text


def plain_characters(text: str) -> Rewritten | None:
    """First transducer; None if nothing is to be rewritten."""
    if _all_plain(text):
        return None
    out = Rewritten(text, [(m.start(), m.end(), "") for m in _HIDDEN.finditer(text)])
    out.text = out.text.translate(look_alikes())
    return out


# Digit words in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
DOT_WORDS = ("dot", "punkt", "point", "punto")
AT_WORDS = ("at", "ät", "arobase", "arroba")

_DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_DOT_WORD = "(?:" + "|".join(DOT_WORDS) + ")"
_AT_WORD = "(?:" + "|".join(AT_WORDS) + ")"
_GAP = "[ ,-]{1,3}"
_TOKEN = rf"(?:{_DIGIT}|[0-9]+|{_DOT_WORD}|plus)(?!\w)"
#: A run: a digit word or figures, then tokens; two digit words at least, with at most one token between two of them.
_SPELLED = re.compile(rf"(?<!\w)(?:plus{_GAP}|\+)?+(?:{_DIGIT}|[0-9]+)(?!\w)(?:{_GAP}{_TOKEN})++", re.I)
_PART = re.compile(rf"{_DIGIT}(?!\w)|[0-9]+|{_DOT_WORD}(?!\w)|plus(?!\w)|\+", re.I)


def _in_a_row(words: list[str]) -> bool:
    hits = [k for k, w in enumerate(words) if w in DIGIT_WORDS]
    return any(b - a <= 2 for a, b in zip(hits, hits[1:]))


def _as_figures(parts: list[str]) -> str:
    return "".join(DIGIT_WORDS.get(p) or ("." if p in DOT_WORDS else "+" if p == "plus" else p) for p in parts)


def spelled_digits(text: str) -> Rewritten | None:
    """Second transducer: runs of at least three tokens, two of them digit words next but one at most."""
    words = text.lower().replace(",", " ").replace("-", " ").split()
    if DIGIT_WORDS.keys().isdisjoint(words) or not _in_a_row(words):
        return None
    pieces = []
    for m in _SPELLED.finditer(text):
        parts = [part.lower() for part in _PART.findall(m[0])]
        if len(parts) > 2 and _in_a_row(parts):
            pieces.append((m.start(), m.end(), _as_figures(parts)))
    return Rewritten(text, pieces) if pieces else None


_OPEN, _CLOSE = r"[ ]{0,2}[\[({<][ ]{0,2}", r"[ ]{0,2}[\])}>][ ]{0,2}"
_BOXED_AT = rf"{_OPEN}(?:{_AT_WORD}|@){_CLOSE}"
_BOXED_DOT = rf"{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}"
_BARE_DOT = rf"[ ]{{1,2}}{_DOT_WORD}[ ]{{1,2}}"
_ANY_DOT = rf"(?:{_BOXED_DOT}|{_BARE_DOT}|\.)"
_HIDDEN_DOT = rf"(?:{_BOXED_DOT}|{_BARE_DOT})"
_ATOM = "[A-Za-z0-9_%+-]++"
_LABEL = "[A-Za-z0-9-]++"
# Last labels that make a bare "at ... dot ..." an address.
_LAST = "(?:com|org|net|edu|gov|mil|info|biz|name|io|dev|app|eu|de|fr|es|uk|us|ca|ch|nl|be|pl|ru|cn|jp|br|au|example|test|invalid|localhost)"
#: Up to eight dots on either side of the sign.
_NAME = rf"(?<![A-Za-z0-9_%+-]){_ATOM}(?:{_ANY_DOT}{_ATOM}){{0,8}}"
_SITE = rf"{_LABEL}(?:{_ANY_DOT}{_LABEL}){{1,8}}"
_BOXED_MAIL = re.compile(rf"{_NAME}{_BOXED_AT}{_SITE}", re.I)
_BARE_MAIL = re.compile(rf"{_NAME}(?:@|[ ]{{1,2}}(?:{_AT_WORD}|@)[ ]{{1,2}})(?={_LABEL}(?:\.{_LABEL}){{0,4}}{_HIDDEN_DOT}){_LABEL}(?:{_ANY_DOT}{_LABEL}){{0,7}}{_ANY_DOT}{_LAST}(?![A-Za-z0-9-])", re.I)
_BARE_DOTS = tuple(f" {word} " for word in DOT_WORDS)
_BOX = re.compile(rf"[\[({{<][ ]{{0,2}}(?:{_AT_WORD}|{_DOT_WORD}|@|\.)[ ]{{0,2}}[\])}}>]", re.I)
_SPREAD_IP = re.compile(rf"(?<![0-9])[0-9]++(?:{_ANY_DOT}[0-9]++){{3}}", re.I)
_SIGN = re.compile(rf"({_BOXED_AT}|[ ]{{1,2}}(?:{_AT_WORD}|@)[ ]{{1,2}})|({_HIDDEN_DOT})", re.I)


def at_and_dot(text: str) -> Rewritten | None:
    """Third transducer: signs inside what has the shape of an address."""
    folded = text.lower()
    if not any(word in folded for word in _BARE_DOTS) and not _BOX.search(text):
        return None
    found = sorted((m.start(), m.end()) for p in (_BOXED_MAIL, _BARE_MAIL, _SPREAD_IP) for m in p.finditer(text))
    pieces, last = [], 0
    for start, end in found:
        for m in _SIGN.finditer(text, max(start, last), end):
            pieces.append((m.start(), m.end(), "@" if m[1] else "."))
        last = max(last, end)
    return Rewritten(text, pieces) if pieces else None


TRANSDUCERS = (plain_characters, spelled_digits, at_and_dot)


def disguised(text: str) -> list[tuple[Span, str]]:
    """Identifiers that show only after rewriting: span in the source, and plain form."""
    stages, plain = [], text
    for transducer in TRANSDUCERS:
        out = transducer(plain)
        if out is not None:
            stages.append(out)
            plain = out.text
    if not stages:
        return []
    found = []
    for kind, start, end in identifiers(plain):
        value, a, b = plain[start:end], start, end
        for stage in reversed(stages):
            a, b = stage.back(a, b)
        if text[a:b] != value:
            found.append(((kind, a, b), value))
    return found


_SPANS = "doc_id long, kinds array<string>, starts array<long>, ends array<long>, plain array<string>, origins array<string>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its spans as lists: kind, start, end (code points, end exclusive), plain form, ``base`` or ``disguise``."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = {name.split()[0]: [] for name in _SPANS.split(", ")}
            out["doc_id"] = batch["doc_id"]
            for value in batch["text"].to_pylist():
                value = value or ""
                base = identifiers(value)
                known = set(base)
                rows = {span: (value[span[1] : span[2]], "base") for span in base}
                rows |= {span: (plain, "disguise") for span, plain in disguised(value) if span not in known}
                spans = in_order(list(rows))
                for k, name in enumerate(("kinds", "starts", "ends")):
                    out[name].append([s[k] for s in spans])
                for k, name in enumerate(("plain", "origins")):
                    out[name].append([rows[s][k] for s in spans])
            return out

        return work

    return map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), make, _SPANS)


def digest(found: DataFrame) -> DataFrame:
    """Counts of plain identifiers, the digest of their list, and all spans as one text."""
    spans = F.arrays_zip("kinds", "starts", "ends", "origins")
    base = F.filter(spans, lambda s: s["origins"] == "base")

    def joined(items: Column) -> Column:
        return F.concat_ws(",", F.transform(items, lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"])))

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kinds"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
