"""Counts, rates, top lists and export names from judged files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilrow.functions.columns import FEATURES
from vigilrow.operators.ranking import hash_bucket, running_totals

TOP_RESULTS = 50
TOP_FEATURES = 20
TOP_TERMS = 15


def status_counts(judged: DataFrame) -> DataFrame:
    """How many files got each verdict or were skipped, and why."""
    return judged.groupBy("status").agg(F.count("*").alias("files"))


def coverage(judged: DataFrame) -> DataFrame:
    """Totals, detection and flag rates, and the share of files scanned, in percent."""
    n = lambda *names: F.count(F.when(F.col("status").isin(*names), 1))
    totals = judged.agg(
        n("WEBSHELL").alias("webshells"),
        n("SUSPICIOUS", "WEBSHELL").alias("detections"),
        n("CLEAN", "SUSPICIOUS", "WEBSHELL").alias("scanned"),
        n("skipped").alias("skipped"),
        n("skipped_by_ext").alias("skipped_by_ext"),
        n("skipped_no_code").alias("skipped_no_code"),
        n("errors").alias("errors"),
        F.count("*").alias("files"),
    )
    pct = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) * 100).otherwise(0.0)
    return totals.withColumns(
        {
            "detection_rate": pct("detections", "scanned"),
            "webshell_rate": pct("webshells", "scanned"),
            "coverage": pct("scanned", "files"),
        }
    )


def top_results(results: DataFrame, n: int = TOP_RESULTS) -> DataFrame:
    """The report's head: highest probability first, path breaks ties."""
    return results.orderBy(F.desc("probability"), "file").limit(n)


# --- export names ----------------------------------------------------------

ID_SPAN = 100_000  # integers per bucket when numbers are ranked


def export_names(results: DataFrame) -> DataFrame:
    """One free file name per exported file: ``name``, ``name_1``, ``name_2`` ..

    Within a verdict the first copy of a name keeps it.  Later copies take the
    next number whose name no other file holds.  Copies are ordered by the hash
    of their path: any order is as good, and a hash splits a name shared by a
    third of all files evenly over many tasks.
    """
    stem, suffix = _split_name(F.col("basename"))
    named = results.select(
        "verdict", "file", F.substring_index("file", "/", -1).alias("basename"), F.md5("file").alias("digest")
    )
    ranked = running_totals(
        named, ["verdict", "basename"], hash_bucket(F.col("digest")), [F.col("digest"), F.col("file")],
        {"rank": F.lit(1)},
    ).withColumn("copy", F.col("rank") - 1)
    shifts = _taken_numbers(named)
    # Copies before the first taken number keep their own number; the rest pass
    # every taken number below them.
    copies = ranked.withColumns({"stem": stem, "suffix": suffix})
    free = _skip_taken(copies, shifts)
    name = F.when(F.col("copy") == 0, F.col("basename")).otherwise(
        F.concat("stem", F.lit("_"), F.col("number").cast("string"), "suffix")
    )
    return free.select("verdict", "file", name.alias("export_name"))


def _split_name(basename: Column) -> tuple[Column, Column]:
    """(name without its last suffix, suffix with dot or '')"""
    suffix = F.regexp_extract(basename, r"(?s)[^.].*(\.[^.]*)\z", 1)
    return F.left(basename, F.length(basename) - F.length(suffix)), suffix


def _taken_numbers(named: DataFrame) -> DataFrame:
    """Per name, its numbers that exist as files of their own.

    ``gap`` is how many free numbers lie below a taken one: copy k must pass
    every taken number with gap < k.
    """
    stem, suffix = _split_name(F.col("basename"))
    numbered = (
        named.select("verdict", "basename")
        .distinct()
        .withColumns({"stem": stem, "suffix": suffix})
        .select(
            "verdict",
            F.regexp_extract("stem", r"(?s)\A(.*)_[1-9][0-9]{0,17}\z", 1).alias("base"),
            F.regexp_extract("stem", r"(?s)\A.*_([1-9][0-9]{0,17})\z", 1).alias("digits"),
            F.col("stem").rlike(r"(?s)\A.*_[1-9][0-9]{0,17}\z").alias("is_numbered"),
            "suffix",
        )
        .where("is_numbered")
        .select(
            "verdict",
            F.concat("base", "suffix").alias("basename"),
            F.col("digits").cast("long").alias("taken"),
        )
    )
    ranked = running_totals(
        numbered, ["verdict", "basename"], F.floor(F.col("taken") / ID_SPAN), [F.col("taken")],
        {"nth": F.lit(1)},
    )
    return ranked.groupBy("verdict", "basename", (F.col("taken") - F.col("nth")).alias("gap")).agg(
        F.count("*").alias("blocked")
    )


def _skip_taken(copies: DataFrame, shifts: DataFrame) -> DataFrame:
    """Adds ``number``: the copy's rank, moved past the taken numbers below it."""
    blocked_names = shifts.select("verdict", "basename").distinct()
    plain = copies.join(blocked_names, ["verdict", "basename"], "left_anti").withColumn("number", F.col("copy"))
    clash = copies.join(blocked_names, ["verdict", "basename"], "left_semi")
    # Taken numbers sort in front of the copy that has to pass them.
    events = clash.select(
        *copies.columns, F.col("copy").alias("at"), F.lit(0).cast("long").alias("blocked")
    ).unionByName(
        shifts.select("verdict", "basename", (F.col("gap") + 1).alias("at"), "blocked"), allowMissingColumns=True
    )
    moved = running_totals(
        events,
        ["verdict", "basename"],
        F.floor(F.col("at") / ID_SPAN),
        [F.col("at"), F.col("file").isNotNull()],
        {"passed": "blocked"},
    ).where(F.col("file").isNotNull())
    number = F.col("copy") + F.when(F.col("copy") > 0, F.col("passed")).otherwise(0)
    return plain.unionByName(moved.withColumn("number", number).select(*plain.columns))


# --- feature and data-set summaries ----------------------------------------


def feature_families(names: DataFrame) -> DataFrame:
    """How many feature names belong to each family."""
    n = lambda word: F.count(F.when(F.contains(F.lower("feature"), F.lit(word)), 1))
    return names.agg(
        F.count("*").alias("features"),
        n("aspx").alias("aspx_features"),
        n("behavior_").alias("behavior_features"),
        n("intent_").alias("intent_features"),
    )


def feature_activity(features: DataFrame) -> DataFrame:
    """Per feature, how many files have it non-zero and its sum; long form, 167 rows."""
    pairs = F.expr(
        "array(" + ", ".join(f"named_struct('feature', '{f}', 'value', cast({f} AS double))" for f in FEATURES) + ")"
    )
    return (
        features.select(F.explode(pairs).alias("p"))
        .groupBy("p.feature")
        .agg(F.count(F.when(F.col("p.value") != 0, 1)).alias("files"), F.sum("p.value").alias("total"))
    )


def dataset_summary(labelled: DataFrame) -> DataFrame:
    """Rows in total and per class, and the class balance."""
    return labelled.agg(
        F.count("*").alias("total"),
        F.count(F.when(F.col("label") == 0, 1)).alias("clean"),
        F.count(F.when(F.col("label") == 1, 1)).alias("bad"),
    ).withColumn("balance", F.when(F.col("clean") > 0, F.col("bad") / F.col("clean")))


def top_importances(importances: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)


def top_terms(coefficients: DataFrame, n: int = TOP_TERMS) -> DataFrame:
    """The terms that speak most for and most against, tagged by block."""
    tagged = coefficients.select(
        F.concat(F.upper("block"), F.lit(":"), F.col("term")).alias("term"), "coefficient"
    )
    bad = tagged.orderBy(F.desc("coefficient"), "term").limit(n).withColumn("side", F.lit("bad"))
    clean = tagged.orderBy("coefficient", "term").limit(n).withColumn("side", F.lit("clean"))
    return bad.unionByName(clean)


def weight_audit(weighted: DataFrame) -> DataFrame:
    n = lambda when: F.count(F.when(when, 1))
    w = F.col("weight")
    return weighted.agg(
        F.count("*").alias("samples"), n(w > 1.0).alias("weighted"), n(w == 3.0).alias("high"), n(w == 1.5).alias("medium")
    )

