"""Which files get scanned, and why the others do not."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilrow.functions.columns import AMBIGUOUS_SUFFIXES, SCAN_SUFFIXES
from vigilrow.operators.features import MIN_CHARS

# ---------------------------------------------------------------------------
# The code probe's markers and share of plain bytes.
# ---------------------------------------------------------------------------
PLAIN_SHARE = 0.7
CODE_MARKERS = (
    "<?php", "<?=",
    "<%@", "<%=", 'runat="server"', "runat='server'",
    "using System", "namespace ",
    "function ", "class ", "var ", "const ", "let ",
    "import ", "from ", "def ",
    "<%!", "<%--",
    "eval(", "exec(", "system(",
    "base64_decode", "gzinflate",
    "$_GET", "$_POST", "$_REQUEST", "$_COOKIE",
)
# End of the fixed values.


def looks_like_code(content: Column, probe_bytes: int | None = None) -> Column:
    """Whether the bytes (or the first ones, where a limit is given) hold a code marker or are mostly plain ASCII."""
    head = F.decode(content if probe_bytes is None else F.substring(content, 1, probe_bytes), "ISO-8859-1")
    marked = reduce(or_, [F.contains(head, F.lit(m)) for m in CODE_MARKERS])
    plain = F.length(head) - F.length(F.regexp_replace(head, r"[\x20-\x7e\t\n\r]+", ""))
    return (F.length(head) > 0) & (marked | (plain / F.length(head) > PLAIN_SHARE))


def _content(files: DataFrame) -> Column:
    return F.col("content") if "content" in files.columns else F.encode(F.col("code"), "UTF-8")


def gate_status(files: DataFrame, scan_all: bool = False) -> Column:
    """Why a file is not scanned; null if it is."""
    too_short = F.coalesce(F.length("code"), F.lit(0)) < MIN_CHARS
    if scan_all:
        blocked = F.col("ext").isin(*AMBIGUOUS_SUFFIXES) & ~F.coalesce(
            looks_like_code(_content(files)), F.lit(False)
        )
        reason = "skipped_no_code"
    else:
        blocked = ~F.col("ext").isin(*SCAN_SUFFIXES)
        reason = "skipped_by_ext"
    # A file that could not be read has no bytes at all; an empty one has none of length 0.
    unread = F.col("content").isNull() if "content" in files.columns else F.lit(False)
    return F.when(unread, "errors").when(blocked, reason).when(too_short, "skipped")


def with_gate(files: DataFrame, scan_all: bool = False) -> DataFrame:
    return files.withColumn("gate", gate_status(files, scan_all))
