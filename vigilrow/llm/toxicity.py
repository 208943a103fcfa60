"""Toxicity: boosted trees over dense text features, with isotonic calibration.

Features of a whole text: densities of two lexicons (a fixed one and one learned
from labelled texts, whole words and word beginnings), how close their words
stand to second-person words and to each other, shares of capitals, punctuation
and obfuscated words (letters written as digits or signs, which are read back
before the lexicons are asked).

The learned lexicon, the trees and the calibration use a bounded sample of the
labelled rows (``fit_rows`` of each label, chosen by hash, copies mostly once);
the sample is the only thing broadcast.  Three quarters of it grow the trees,
the rest calibrates them.  Scoring is one pass over all texts.

Cases: null and empty texts have all features 0 and get a score like any other.
Rows without a label or an id are scored and not learned from; of several
labels of one document the largest counts.  If one of the labels is missing from
the sample, every score is the share of label 1 in it (0 without rows).  Equal
texts get equal scores; other columns are passed over.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import gram_hashes, map_rows, word_bounds, word_hashes
from vigilrow.session import materialize

FIT_ROWS = 16_000
#: Entries of the learned lexicon, at most, and how telling one must be.
LEXICON = 400
LOG_ODDS = 2.0

# --- fixed values ---------------------------------------------------------------
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash garbage clown clowns disgusting "
    "filth vermin fool fools ugly hate shut kill freak creep jerk imbecile degenerate".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself ur u du dich dir dein deine deiner ihr euch tu te ton ta tes toi vous votre vos usted ustedes vosotros ti tus".split()
)
#: Signs that stand for letters in obfuscated words.
DISGUISE = str.maketrans("013457@$!|", "oieastasil")
# --------------------------------------------------------------------------------

PREFIXES = (4, 5, 6)
_EDGES = "\"'`.,;:!?()[]{}<>*_-~#%&+=/\\|…«»„“”‘’¿¡"
_LETTERS = re.compile(r"[^\W\d_]+")
FEATURES = (
    "log_words", "fixed_rate", "learned_rate", "learned_log", "distinct_log", "disguised_rate", "second_rate", "near_second_rate",
    "crowding", "caps_rate", "caps_word_rate", "punctuation_rate", "shout_rate", "question_rate", "repeat_rate", "digit_rate", "odd_rate",
)
_FIXED, _LEARNED, _DISGUISED, _SECOND, _CAPS, _ODD = (1 << k for k in range(6))


@dataclass(frozen=True)
class Lexicon:
    words: frozenset[str]
    beginnings: frozenset[str]

    def __contains__(self, word: str) -> bool:
        return word in self.words or any(word[:k] in self.beginnings for k in PREFIXES)


class Marks(dict):
    """What a token is, worked out once for each different token (and forgotten when too many are held)."""

    def __init__(self, lexicon: Lexicon, most: int = 300_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, token: str) -> int:
        if len(self) > self.most:
            self.clear()
        bare = token.strip(_EDGES)
        word = bare.lower()
        mark = _FIXED * (word in INSULTS) | _LEARNED * (word in self.lexicon) | _SECOND * (word in SECOND_PERSON)
        mark |= _CAPS * (len(bare) > 1 and bare.isupper())
        if word and not word.isalpha() and any(c.isalpha() for c in word):
            plain = "".join(_LETTERS.findall(word.translate(DISGUISE)))
            hidden = plain in INSULTS or plain in self.lexicon
            mark |= _ODD | _DISGUISED * (hidden and not mark & (_FIXED | _LEARNED))
        self[token] = mark
        return mark


def features(text: str | None, marks: Marks) -> list[float]:
    """The dense features of a whole text, in the order of ``FEATURES``."""
    tokens = (text or "").split()
    if not tokens:
        return [0.0] * len(FEATURES)
    n = len(tokens)
    mark = np.fromiter(map(marks.__getitem__, tokens), np.int16, n)
    hits = np.flatnonzero(mark & (_FIXED | _LEARNED | _DISGUISED))
    second = np.flatnonzero(mark & _SECOND)
    near = 0
    if len(hits) and len(second):
        near = int((np.searchsorted(second, hits + 5, side="right") > np.searchsorted(second, hits - 5)).sum())
    crowding = int((np.searchsorted(hits, hits + 20, side="right") - np.arange(len(hits))).max()) if len(hits) else 0
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    count = np.bincount(data, minlength=256)
    upper, lower, digit = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    punctuation = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    repeated = ((data[1:] == data[:-1]) & ((data[1:] == 33) | (data[1:] == 63))).sum() if len(data) > 1 else 0
    rate = lambda bit: float((mark & bit != 0).sum()) / n
    learned = mark & (_LEARNED | _DISGUISED) != 0
    return [
        math.log1p(n), rate(_FIXED), rate(_LEARNED | _DISGUISED), math.log1p(float(learned.sum())),
        math.log1p(len({tokens[i].strip(_EDGES).lower() for i in hits})), rate(_DISGUISED), rate(_SECOND), near / n,
        float(crowding), float(upper) / max(1.0, float(upper + lower)), rate(_CAPS), float(punctuation) / len(data), float(count[33]) / n,
        float(count[63]) / n, float(repeated) / n, float(digit) / len(data), rate(_ODD),
    ]


def _units(text: str | None) -> set[str]:
    """Different words of a text, and their beginnings marked with a trailing ``*``."""
    words = {w.lower() for w in _LETTERS.findall(text or "")}
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}


def learn_lexicon(sample: DataFrame, most: int = LEXICON, log_odds: float = LOG_ODDS) -> Lexicon:
    """Units that are far likelier in texts with label 1.  ``sample``: text, label; bounded by its caller."""
    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    least = max(4, math.ceil(0.015 * bad))

    def counted(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
        def make():
            def work(batch: pa.RecordBatch) -> dict:
                seen: Counter = Counter()
                for text in batch.column(0).to_pylist():
                    found = _units(text)
                    seen.update(found & only if only is not None else found)
                return {"unit": list(seen), "uses": list(seen.values())}

            return work

        return map_rows(rows.select("text"), make, "unit string, uses long").groupBy("unit").agg(F.sum("uses").alias("uses"))

    # What is frequent among texts with label 1: at most units-per-text / share of them.
    common = {r["unit"]: r["uses"] for r in counted(sample.where("label = 1"), None).where(F.col("uses") >= least).collect()}
    other = {r["unit"]: r["uses"] for r in counted(sample.where("label = 0"), frozenset(common)).collect()} if common else {}
    odds = {u: math.log((n + 0.5) / (bad + 1)) - math.log((other.get(u, 0) + 0.5) / (good + 1)) for u, n in common.items()}
    best = sorted((u for u in odds if odds[u] >= log_odds), key=lambda u: (-odds[u], u))[:most]
    return Lexicon(frozenset(u for u in best if not u.endswith("*")), frozenset(u[:-1] for u in best if u.endswith("*")))


def with_features(docs: DataFrame, lexicon: Lexicon, keys: dict[str, str], text: str = "text") -> DataFrame:
    """The named key columns (name to type) and one double column for each feature."""
    names = list(keys)

    def make():
        marks = Marks(lexicon)

        def work(batch: pa.RecordBatch) -> dict:
            rows = [features(t, marks) for t in batch.column(len(names)).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(FEATURES)
            return {n: batch.column(k) for k, n in enumerate(names)} | dict(zip(FEATURES, columns, strict=True))

        return work

    ddl = ", ".join([*(f"{n} {kind}" for n, kind in keys.items()), *(f"{f} double" for f in FEATURES)])
    return map_rows(docs.select(*(F.col(n).cast(kind).alias(n) for n, kind in keys.items()), F.col(text).alias("text")), make, ddl)


@dataclass
class Model:
    """``stages`` is None where one label was missing: then ``prior`` is every score."""

    lexicon: Lexicon
    stages: PipelineModel | None
    prior: float


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """text, label, key of about ``fit_rows`` rows of each label at most.  ``labels``: doc_id, label.

    Equal texts with one label come once, and most near copies too: texts with the same
    smallest hash of a 5-word run count as one, lest a group of copies fill the lexicon.
    """
    labels = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    count = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for value, n in sorted(count.items()):
        share = F.when(F.col("label") == value, min(1.0, fit_rows / n)).otherwise(share)
    chosen = labels.where(draw < share)
    # The sample's ids: bounded by fit_rows for each label.
    rows = docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("label", "text")

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            least = []
            for text in batch.column(1).to_pylist():
                data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
                words = word_hashes(data, *word_bounds(data))
                grams = gram_hashes(words, min(5, len(words))) if len(words) else np.zeros(1, np.uint64)
                least.append(int(grams.min().view(np.int64)))
            return {"key": least, "label": batch.column(0), "text": batch.column(1)}

        return work

    return map_rows(rows, make, "key long, label int, text string").groupBy("key", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = 20, depth: int = 4) -> Model:
    """Learn from the labelled documents; ``labels`` has doc_id and label (0 or 1)."""
    sample = materialize(labelled_sample(docs, labels, fit_rows), "toxic-sample")
    count = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    total = sum(count.values())
    prior = count.get(1, 0) / total if total else 0.0
    if not count.get(0) or not count.get(1):
        return Model(Lexicon(frozenset(), frozenset()), None, prior)
    lexicon = learn_lexicon(sample)
    # A bounded table of numbers: a few partitions are enough for the many small jobs of the fit.
    table = materialize(with_features(sample, lexicon, {"key": "long", "label": "int"}).coalesce(6), "toxic-features")
    held = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(4)) == 0
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    grow, calibrate = vectors.transform(table.where(~held)), vectors.transform(table.where(held))
    if grow.select("label").distinct().count() < 2 or calibrate.limit(1).count() == 0:
        grow = calibrate = vectors.transform(table)
    trees = GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, maxBins=64, stepSize=0.2, seed=7, checkpointInterval=-1).fit(grow)
    raw = _probability(trees.transform(calibrate).drop("features"))
    steps = IsotonicRegression(labelCol="label", featuresCol="raw_score", predictionCol="calibrated").fit(raw.select("raw_score", F.col("label").cast("double").alias("label")))
    return Model(lexicon, PipelineModel([vectors, trees, steps]), prior)


def _probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("raw_score", vector_to_array("probability")[1])


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score, predicted for each row.

    The score is the calibrated probability; a thousandth of the raw one keeps the order within a step.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if model.stages is None:
        out = rows.select("doc_id", F.lit(float(model.prior)).alias("score"))
    else:
        vectors, trees, steps = model.stages.stages
        scored = _probability(trees.transform(vectors.transform(with_features(rows, model.lexicon, {"doc_id": "long"}))))
        scored = steps.transform(scored.select("doc_id", "raw_score"))
        out = scored.select("doc_id", (F.lit(0.999) * F.col("calibrated") + F.lit(0.001) * F.col("raw_score")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
