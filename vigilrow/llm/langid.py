"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed 1- to 3-grams of its folded letters (weight
``(1 + ln tf) * idf``, length 1).  Each language has a few centroids, the
clusters of spherical k-means over a bounded sample of labelled texts.  A text
gets the language of the centroid with the largest cosine, and is rejected if
that cosine is too small for a text of its size.

Document frequencies come from all learning rows; only the clustering uses the
sample (``fit_rows`` distinct texts per language, chosen by hash).

Cases: a null text, an empty one or one without any letter is ``und`` with score
0 and is rejected.  Rows with a null language are not learned from.  Without
learning rows every text is ``und``.  Equal texts get equal answers; columns
other than the named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import arrow_schema, modest_batches

#: Hashed n-grams: dimension of the vectors.
DIMENSIONS = 8192
#: Distinct labelled texts for each language that the clustering sees, about.
FIT_ROWS = 1_200
#: Centroids for each language, at most.
CLUSTERS = 12
#: A text of g different n-grams is rejected below REJECT * sqrt(g / (g + HALF)).
REJECT = 0.09
HALF = 400


def _fold_table() -> np.ndarray:
    """Code point to folded letter, 0 for anything that is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def gram_slots(text: str, fold: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The slots of all 1- to 3-grams of a whole text; grams across words keep only their border."""
    letters = fold[_codes(text)]
    if not letters.any():
        return np.zeros(0, np.int64)
    x = np.concatenate([[0], letters, [0]]).astype(np.uint32)
    # Runs of non-letters count as one border.
    x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
    with np.errstate(over="ignore"):
        one = x[x != 0] * np.uint32(2654435761)
        two = x[:-1] * np.uint32(2246822519) ^ x[1:] * np.uint32(3266489917)
        three = (x[:-2] * np.uint32(668265263) ^ x[1:-1] * np.uint32(374761393) ^ x[2:] * np.uint32(2869860233))[x[1:-1] != 0]
        every = np.concatenate([one, two * np.uint32(40503) + np.uint32(1), three * np.uint32(69069) + np.uint32(2)])
        every = (every ^ (every >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return ((every ^ (every >> np.uint32(13))) % np.uint32(dimensions)).astype(np.int64)


def vectors(texts: list[str | None], fold: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised TF-IDF rows, and the number of different n-grams of each text (0: no letter)."""
    out, sizes = np.zeros((len(texts), len(idf)), np.float32), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        slots = gram_slots(text or "", fold, len(idf))
        if len(slots):
            count = np.bincount(slots, minlength=len(idf))
            used = np.flatnonzero(count)
            weight = (1 + np.log(count[used])) * idf[used]
            length = np.sqrt((weight * weight).sum())
            out[i, used] = weight / length if length else 0
            sizes[i] = len(used)
    return out, sizes


@dataclass
class Model:
    """Centroids: ``len(languages)`` rows, several for each language."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray


def _idf(rows: DataFrame, dimensions: int) -> np.ndarray:
    """IDF of each slot over all learning rows (text, lang); one vector per task and language is summed up.

    Every language weighs the same, so the n-grams of a common language are not
    taken for common n-grams.
    """

    def run(batches):
        fold = _fold_table()
        used: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                slots = gram_slots(text.as_py() or "", fold, dimensions)
                if len(slots):
                    row = used.setdefault(lang, np.zeros(dimensions + 1, np.int64))
                    row[:dimensions] += np.bincount(slots, minlength=dimensions) > 0
                    row[dimensions] += 1
        for lang, row in used.items():
            hit = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(hit), "slot": hit, "uses": row[hit]}, schema=arrow_schema("lang string, slot long, uses long"))

    counts = rows.mapInArrow(run, "lang string, slot long, uses long").groupBy("lang", "slot").agg(F.sum("uses").alias("uses"))
    total = counts.where(F.col("slot") == dimensions).select("lang", F.col("uses").alias("total"))
    # At most dimensions rows come back.
    share = counts.where(F.col("slot") < dimensions).join(F.broadcast(total), "lang").groupBy("slot").agg(F.sum(F.col("uses") / F.col("total")).alias("share"), F.count(F.lit(1)).alias("n")).toPandas()
    languages = max(1, total.count())
    mean = np.zeros(dimensions)
    mean[share["slot"].to_numpy(int)] = share["share"].to_numpy(float) / languages
    return np.log(1.001 / (0.001 + mean)) + 0.05


def _k_means(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the centre of each row.  The first centre is the mean, the next ones the rows farthest from all centres."""
    mean = x.sum(0)
    centres = (mean / max(np.linalg.norm(mean), 1e-12))[None]
    near = (x @ centres.T).max(1)
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[near.argmin()][None]])
        near = np.maximum(near, x @ centres[-1])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.stack([x[own == j].sum(0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres, (x @ centres.T).argmax(1)


def _clusters(x: np.ndarray, k: int, rounds: int = 10, least: int = 3, tries: int = 6) -> np.ndarray:
    """Spherical k-means without stray texts: rows of clusters of fewer than ``least`` rows are set aside and the rest is clustered again."""
    for _ in range(tries):
        centres, own = _k_means(x, k, rounds)
        size = np.bincount(own, minlength=len(centres))
        good = (size >= least) | (size == size.max())
        if good.all():
            break
        x = x[good[own]]
    return centres[good]


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", clusters: int = CLUSTERS, fit_rows: int = FIT_ROWS,
        dimensions: int = DIMENSIONS) -> Model:
    """Learn from all rows with a language: IDF from every row, centroids from the bounded sample.

    The model is bounded by languages x clusters x dimensions.
    """
    modest_batches(rows.sparkSession)
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    idf = _idf(rows.select("text", "lang"), dimensions)
    count = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not count:
        return Model([], np.zeros((0, dimensions), np.float32), idf)
    share = F.create_map(*[F.lit(v) for name, n in sorted(count.items()) for v in (name, min(1.0, fit_rows / n))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # Copies hash alike, so they are drawn together and count once.
    sample = rows.where(draw < share[F.col("lang")]).groupBy("lang", F.xxhash64("text").alias("key")).agg(F.min("text").alias("text"))

    def centres(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key")
        x, sizes = vectors(part["text"].tolist(), _fold_table(), idf)
        x = x[sizes > 0]
        found = _clusters(x, clusters) if len(x) else np.zeros((0, dimensions), np.float32)
        return pd.DataFrame({"lang": part["lang"].iloc[0], "cluster": range(len(found)), "centroid": list(found.astype(np.float32))})

    got = sample.groupBy("lang").applyInPandas(centres, "lang string, cluster int, centroid array<float>").toPandas()
    got = got.sort_values(["lang", "cluster"])
    matrix = np.stack(got["centroid"]).astype(np.float32) if len(got) else np.zeros((0, dimensions), np.float32)
    return Model(got["lang"].tolist(), matrix, idf)


#: Columns that ``predict`` adds.
ADDED = ("lang_pred", "score", "n_grams", "rejected")


def predict(
    docs: DataFrame, model: Model, text: str = "text", reject: float = REJECT, half: float = HALF, added: tuple[str, ...] | list[str] = ADDED
) -> DataFrame:
    """Add lang_pred, score (cosine to the nearest centroid), n_grams and rejected to every row, under the names given."""
    extra = ", ".join(f"`{n}` {kind}" for n, kind in zip(added, ("string", "double", "long", "boolean"), strict=True))
    names = [f.name for f in docs.schema.fields]

    def run(batches):
        fold = _fold_table()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                x, sizes = vectors(part.column(names.index(text)).to_pylist(), fold, model.idf)
                near = x @ model.centroids.T if model.languages else np.zeros((len(x), 1), np.float32)
                best = near.argmax(1)
                score = np.where(sizes > 0, near.max(1), 0).astype(float).clip(0, 1)
                known = (sizes > 0) & bool(model.languages)
                lang = [model.languages[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
                out = ~known | (score < reject * np.sqrt(sizes / (sizes + half)))
                more = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sizes, pa.int64()), pa.array(out, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*names, *added])

    taken = {n.lower() for n in added} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"columns that the result adds are there already: {sorted(taken)}")
    modest_batches(docs.sparkSession)
    schema = docs.schema.simpleString().removeprefix("struct<").removesuffix(">")
    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {extra}" if schema else extra)
