"""Text normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Labels that must stay as they are for right results.
# ---------------------------------------------------------------------------
BASE64_BUCKETS = (
    (2000, " BASE64_LEN_GT2K "),
    (500, " BASE64_LEN_500_2K "),
    (200, " BASE64_LEN_200_500 "),
)
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

VERBATIM_STRING = r"""(?s)@"(?:[^"]*+(?:""[^"]*+)*+"|.*"(?="[^"]*\z))"""
QUOTED_STRING = r"""(?s)"(?:[^"\\]++|\\\\.)*+"|'(?:[^'\\]++|\\\\.)*+'"""


def _swap_codes(text: Column, marker: str, digits: int, charset: str) -> Column:
    """Replace each ``marker`` + hex digits by the character it stands for."""
    pattern = rf"\\{marker}([0-9a-fA-F]{{{digits}}})"

    def to_char(code: Column) -> Column:
        # A lone surrogate is no character: it becomes U+FFFD, length kept.
        safe = F.when(code.rlike("^[dD][89a-fA-F]"), F.lit("FFFD")).otherwise(code) if digits == 4 else code
        return F.decode(F.unhex(safe), charset)

    around = F.split(text, pattern, -1)
    chars = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), to_char)
    joined = F.array_join(
        F.zip_with(around, F.concat(chars, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), ""
    )
    return F.when(F.contains(text, F.lit("\\" + marker)), joined).otherwise(text)


def decode_unicode_escapes(text: Column) -> Column:
    return _swap_codes(text, "u", 4, "UTF-16BE")


def decode_hex_escapes(text: Column) -> Column:
    return _swap_codes(text, "x", 2, "ISO-8859-1")


def blank_blocks(text: Column, opening: str, closing: str) -> Column:
    """Replace every ``opening .. closing`` block by one space.

    An opening after the last closing can never end, so only the text up to
    that point is searched: unclosed openings cost nothing.
    """
    tail = F.substring_index(text, closing, -1)
    head = F.left(text, F.length(text) - F.length(tail))
    pattern = rf"(?s)\Q{opening}\E.*?\Q{closing}\E"
    return F.when(
        F.contains(text, F.lit(opening)) & F.contains(text, F.lit(closing)),
        F.concat(F.regexp_replace(head, F.lit(pattern), F.lit(" ")), tail),
    ).otherwise(text)


def blank_line_comments(text: Column, opening: str) -> Column:
    return F.when(
        F.contains(text, F.lit(opening)), F.regexp_replace(text, rf"\Q{opening}\E[^\n]*", " ")
    ).otherwise(text)


def blank_strings(text: Column, pattern: str, guard: str) -> tuple[Column, Column]:
    """(text with string literals replaced by a space, characters they held)."""
    has = F.contains(text, F.lit(guard)) if guard else (
        F.contains(text, F.lit('"')) | F.contains(text, F.lit("'"))
    )
    blanked = F.when(has, F.regexp_replace(text, pattern, " ")).otherwise(text)
    held = F.when(
        has, F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    ).otherwise(F.lit(0))
    return blanked, held


def bucket_base64(text: Column) -> Column:
    """Replace base64 runs of 200 and more characters by a length label.

    The run's length includes up to two ``=``, so the longer buckets are
    matched with the padding counted in.
    """
    given = text
    for least, label in BASE64_BUCKETS:
        run = rf"[A-Za-z0-9+/]{{{max(least, 200)},}}={{0,2}}"
        if least > 200:
            run += rf"|[A-Za-z0-9+/]{{{least - 1}}}={{1,2}}|[A-Za-z0-9+/]{{{least - 2}}}=="
        text = F.regexp_replace(text, run, label)
    # Every bucket starts at such a run; one search instead of seven for all other texts.
    return F.when(given.rlike("[A-Za-z0-9+/]{200}"), text).otherwise(given)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACE_CLASS}]+", " "))


def head_of(text: Column, max_chars: int | None) -> Column:
    """The whole text, or its first characters where a limit is asked for."""
    return text if max_chars is None else F.substring(text, 1, max_chars)


def scoring_text(code: Column, max_chars: int | None = None) -> Column:
    """The n-gram model's scoring view: no clean-up besides dropping NULs."""
    return head_of(F.replace(code, F.lit("\x00"), F.lit("")), max_chars)
