"""License scans with a positional index of rare license words.

A template is the notice text of a license.  The corpus tells how rare each
template word is (document frequency over all texts).  For each text, the
template words it holds are looked up by falling IDF in an index ``word ->
(template, place)``; every common word votes for ``place in text - place in
template``.  Votes that agree on a relative position make a candidate, and a
candidate counts only if one of the template's mandatory key phrases stands
where the alignment puts it.

Cases: a null text is an empty one.  Empty texts, texts without letters or
digits and empty tables give no places and no labels (score 0).  Rows are
treated one by one, so repeated rows and null ids come out as they went in.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import map_rows

# --- fixed values: phrases, template notices and their key phrases --------------
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: label, notice, key phrases (one must stand at its place)
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("terms of the gnu general public license",)),
    ("lgpl", "this library is free software under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "under the terms of the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
# --------------------------------------------------------------------------------

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Runs of a-z, 0-9 and non-ASCII characters after folding A-Z."""
    return _WORD.findall((text or "").encode("utf-8", "replace").lower())


def _split(phrase: str) -> tuple[bytes, ...]:
    return tuple(phrase.encode().split())


def _places(tokens: list[bytes], at: dict[bytes, list[int]], phrase: tuple[bytes, ...]) -> list[int]:
    """Starts of a phrase, found from its least frequent word."""
    if any(w not in at for w in phrase):
        return []
    k = min(range(len(phrase)), key=lambda i: len(at[phrase[i]]))
    n = len(tokens) - len(phrase)
    return [p - k for p in at[phrase[k]] if 0 <= p - k <= n and tuple(tokens[p - k : p - k + len(phrase)]) == phrase]


def template_idf(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> dict[bytes, float]:
    """IDF of the template words over all texts.  One row for each template word comes back."""
    vocabulary = {w for _, notice, _ in templates for w in _split(notice)}

    def make():
        def count(batch: pa.RecordBatch) -> dict:
            seen: Counter = Counter()
            for value in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(words(value)))
            return {"word": [*(w.decode() for w in seen), ""], "uses": [*seen.values(), batch.num_rows]}

        return count

    counts = map_rows(docs.select(text), make, "word string, uses long").groupBy("word").agg(F.sum("uses").alias("uses"))
    uses = {r["word"].encode(): r["uses"] for r in counts.collect()}
    total = uses.get(b"", 0)
    return {w: math.log(1 + (total + 1) / (uses.get(w, 0) + 0.5)) for w in sorted(vocabulary)}


def scan(docs: DataFrame, idf: dict[bytes, float], doc_id: str = "doc_id", text: str = "text",
         phrases: dict[str, str] = PHRASES, templates=TEMPLATES, rare: int = 6, agree: float = 0.75) -> DataFrame:
    """Scan whole texts for phrases and templates.

    rare: rarest words looked up for each template.  agree: share of their IDF
    that must vote for one relative position.
    Returns doc_id, n_words, base_starts, base_labels, hit_labels, hit_starts
    and hit_scores (one entry for each aligned template place).
    """
    plain = [(_split(p), label) for p, label in phrases.items()]
    index: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    size = []
    keys = []
    for t, (_, notice, needed) in enumerate(templates):
        body = _split(notice)
        size.append(len(body))
        for place, w in enumerate(body):
            index[w].append((t, place))
        keys.append([(phrase, _places(list(body), _at(body), phrase)) for phrase in map(_split, needed)])
    # The words of each template by falling IDF; ties by spelling.
    by_idf = [sorted(set(_split(notice)), key=lambda w: (-idf[w], w)) for _, notice, _ in templates]
    vocabulary = set(index) | {w for p, _ in plain for w in p}
    index = dict(index)

    def aligned(tokens: list[bytes], at: dict[bytes, list[int]]) -> list[tuple[str, int, float]]:
        found = {}
        for t, (label, _, _) in enumerate(templates):
            if not any(all(w in at for w in phrase) for phrase, _ in keys[t]):
                continue
            chosen = [w for w in by_idf[t] if w in at][:rare]
            most = sum(idf[w] for w in by_idf[t][:rare])
            votes: dict[int, set[bytes]] = defaultdict(set)
            for w in chosen:
                for owner, place in index[w]:
                    if owner == t:
                        for p in at[w]:
                            votes[p - place].add(w)
            for start, voters in votes.items():
                score = min(1.0, sum(sorted(idf[w] for w in voters)) / most)
                if score < agree:
                    continue
                if any(tuple(tokens[max(start + k, 0) : start + k + len(phrase)]) == phrase and start + k >= 0 for phrase, where in keys[t] for k in where):
                    found[label, start] = max(score, found.get((label, start), 0.0))
        return sorted((label, start, score) for (label, start), score in found.items())

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = defaultdict(list)
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = words(value)
                starts, labels, hits = [], set(), []
                if vocabulary.intersection(tokens):
                    at = _at(tokens, vocabulary)
                    for phrase, label in plain:
                        if got := _places(tokens, at, phrase):
                            starts += got
                            labels.add(label)
                    hits = aligned(tokens, at)
                out["doc_id"].append(key)
                out["n_words"].append(len(tokens))
                out["base_starts"].append(sorted(starts))
                out["base_labels"].append(sorted(labels))
                out["hit_labels"].append([h[0] for h in hits])
                out["hit_starts"].append([h[1] for h in hits])
                out["hit_scores"].append([h[2] for h in hits])
            return out or {n: [] for n in ("doc_id", "n_words", "base_starts", "base_labels", "hit_labels", "hit_starts", "hit_scores")}

        return work

    return map_rows(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), make,
        "doc_id long, n_words long, base_starts array<long>, base_labels array<string>, hit_labels array<string>, hit_starts array<long>, hit_scores array<float>",
    )


def _at(tokens, vocabulary: set[bytes] | None = None) -> dict[bytes, list[int]]:
    at: dict[bytes, list[int]] = defaultdict(list)
    for i, w in enumerate(tokens):
        if vocabulary is None or w in vocabulary:
            at[w].append(i)
    return dict(at)


def digest(found: DataFrame) -> DataFrame:
    """The flat form of ``scan``: counts, first and last base place, labels, score (1 with a base place)."""
    none = F.size("base_starts") == 0
    return found.select(
        "doc_id", "n_words", F.size("base_starts").cast("long").alias("n_base"),
        F.when(~none, F.array_min("base_starts")).alias("first_word"),
        F.when(~none, F.array_max("base_starts")).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base_labels", "hit_labels"))), ",").alias("labels"),
        F.when(~none, F.lit(1.0)).otherwise(F.coalesce(F.array_max("hit_scores").cast("double"), F.lit(0.0))).alias("score"),
    )
