"""From the signature table to Column expressions."""

from __future__ import annotations

import re
from functools import reduce

import ahocorasick
from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilrow.functions import patterns as P
from vigilrow.functions.patterns import Signature

# Letters outside ASCII that ignore-case matching treats as s, k and i.
FOLD_FROM, FOLD_TO = "ſKıİ", "skii"

# White space that the JVM's Unicode class leaves out.
EXTRA_SPACE = r"\x1c-\x1f"


def widen_space(regex: str) -> str:
    """Let every ``\\s`` also cover the four information separators."""
    out, in_class, i = [], False, 0
    while i < len(regex):
        pair = regex[i : i + 2]
        if pair[0] == "\\":
            if pair == r"\s":
                out.append(r"\s" + EXTRA_SPACE if in_class else rf"[\s{EXTRA_SPACE}]")
            else:
                out.append(pair)
            i += 2
            continue
        if pair[0] == "[":
            in_class = True
        elif pair[0] == "]":
            in_class = False
        out.append(pair[0])
        i += 1
    return "".join(out)


def jvm_flags(flags: str) -> str:
    """Inline flags: Unicode classes, LF-only line ends, and the pattern's own."""
    return "(?" + ("iu" if "i" in flags else "") + "Ud" + ("s" if "s" in flags else "") + ")"


def chain_regex(parts: tuple[str, ...]) -> str:
    """A yes/no search for parts in order, in one pass over the text.

    Every part but the last is matched once, as early as possible, and never
    reconsidered: an earlier end only leaves more room for what follows.  A
    trailing ``+`` before a gap adds nothing and could swallow the next part.
    """
    heads = [p[:-1] if p.endswith("+") else p for p in parts[:-1]]
    return r"\A" + "".join(f"(?>.*?(?:{h}))" for h in heads) + f".*?(?:{parts[-1]})"


# The same yes/no answer as the table's pattern, without rescanning: a URL and
# the word after it always lie between two quotes, or text start and quote; of
# the first name in a call chain the last letter suffices.
ONE_PASS = {
    "has_function_chain": r"\w\s*\(\s*\w+\s*\(\s*\w+\s*\(",
    "has_jsp_suspicious_url_pattern": (
        r"""(?:\A|["'])(?>[^"']*?https?://)[^"']*?(?:shell|backdoor|c2|rokok|bet|hack|cmd)"""
    ),
    "has_fake_wp_plugin": r"\A(?>.*?Plugin\s+Name:)(?:.*?@eval|(?>.*?base64_decode).*?eval)",
}


def jvm_regex(sig: Signature) -> str:
    if sig.column in ONE_PASS:
        body = ONE_PASS[sig.column]
    elif isinstance(sig.regex, tuple):
        body = chain_regex(sig.regex)
    else:
        body = sig.regex
    return jvm_flags(sig.flags) + widen_space(body)


def plain_regex(regex: str, flags: str = "i") -> str:
    return jvm_flags(flags) + widen_space(regex)


def fold(text: Column) -> Column:
    """Lower case, with the odd case partners of s, k and i mapped to ASCII."""
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in FOLD_FROM])
    return F.lower(F.when(odd, F.translate(text, FOLD_FROM, FOLD_TO)).otherwise(text))


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Columns that hold the numbers of the pre-test words found in a text, instead of the text.
FOUND = ("words", "code_words")
CALL_NEEDS = {
    "exec": "eval exec system passthru popen proc_open assert create_function",
    "decode": "base64_decode gzinflate gzuncompress str_rot13 urldecode convert_uudecode",
    "dynamic": "call_user_func array_map array_walk register_shutdown_function preg_replace",
    "input": "$_ $http_ filter_input filter_var request",
}


_NEEDS = [*(s.need or () for s in P.SIGNATURES), *P.FRAMEWORK_NEEDS.values(), tuple(CALL_NEEDS.values())]
#: All words of all pre-tests on folded text, numbered.
WORD_NUMBERS = {w: k for k, w in enumerate(sorted({w for need in _NEEDS for group in need for w in group.split(" ")}))}


class WordFinder:
    """Numbers of the words in a folded text, found in one pass over it; a task builds the automaton once."""

    def __init__(self):
        self.numbers, self.automaton = WORD_NUMBERS, None

    def __call__(self, folded: str) -> list[int]:
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for word, number in self.numbers.items():
                self.automaton.add_word(word, number)
            self.automaton.make_automaton()
        return list({number for _, number in self.automaton.iter(folded)})


def has_word_sql(folded: str, word: str) -> str:
    if folded in FOUND:
        return f"array_contains({folded}, {WORD_NUMBERS[word]}S)"
    return f"contains({folded}, {sql_text(word)})"


# Wide expressions are written as SQL text: one call each, instead of one call
# to the JVM per operator.


def may_match_sql(folded: str, need: tuple[str, ...]) -> str:
    """False only for texts that cannot match; ``folded`` names the folded text, or the words found in it."""
    groups = [" OR ".join(has_word_sql(folded, w) for w in group.split(" ")) for group in need]
    return "(" + " AND ".join(f"({g})" for g in groups) + ")"


def may_match(folded: str, need: tuple[str, ...]) -> Column:
    return F.expr(may_match_sql(folded, need))


def flag(sig: Signature, text: str, folded: str) -> Column:
    """Whether the signature occurs; the regex runs only where the pre-test allows.

    ``folded`` names the folded text, or for raw scope the text itself, whose
    pre-test literals have no letter case.
    """
    hit = f"rlike({text}, {sql_text(jvm_regex(sig))})"
    if not sig.need:
        return F.expr(hit)
    return F.expr(f"CASE WHEN {may_match_sql(folded, sig.need)} THEN {hit} ELSE false END")


def hits(text: Column, regex: str, guard: Column, flags: str = "i") -> Column:
    """The matched pieces of text, in order; empty where the guard is false."""
    found = F.regexp_extract_all(text, F.lit(plain_regex(regex, flags)), F.lit(0))
    return F.when(guard, found).otherwise(F.array().cast("array<string>"))


def gaps(text: Column, regex: str, guard: Column, flags: str = "i") -> Column:
    """The text around the hits: one more entry than there are hits."""
    return F.when(guard, F.split(text, plain_regex(regex, flags), -1)).otherwise(
        F.array().cast("array<string>")
    )


def literal_count(text: Column, needle: str) -> Column:
    """How often a literal occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def python_regex(sig: Signature) -> re.Pattern:
    """The signature as an ordinary Python pattern, for checks."""
    flags = (re.I if "i" in sig.flags else 0) | (re.S if "s" in sig.flags else 0)
    body = ".*?".join(sig.regex) if isinstance(sig.regex, tuple) else sig.regex
    return re.compile(body, flags)
