"""Near-duplicate documents by min-max hashing.

A document is the set of its 5-word shingles (A-Z folded).  Under each hash
function both the smallest and the largest value of the set are kept, so half
as many hash evaluations give a signature of the same length, and its estimate
of the Jaccard similarity is unbiased with a lower variance than minima alone.
Bands of the signature propose pairs, and every proposed pair is confirmed on
the full sets.

Work stays linear where many documents share a band:

* documents with equal sets are one class, and only its smallest id goes on;
* in each band bucket one hub is compared with all others (a star); members that
  are connected by then need no comparison, nor those with so many shingles of
  their own that they cannot reach the threshold (an exact bound);
* in buckets that still hold several components, members outside the largest one
  are compared with the others, block against block.  So each pair that shares
  a band is confirmed, or refuted, or already connected.

Cases: a text with fewer words than a shingle is one shingle; a null text, an
empty one or one without words has an empty set and is linked with nothing.
Repeated rows have equal sets, so they fall into one class; different texts under
one id are different classes, each linked by its own set.  Rows with a null id
take part only as copies (their component is that of the class, or null).
Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import Scratch, every, gram_hashes, map_rows, mix, unused, word_bounds, word_hashes
from vigilrow.llm.components import components

SHINGLE = 5
#: Similarity in per cent from which documents are linked.
PERCENT = 75
#: Hash functions; the signature has twice as many values.
FUNCTIONS = 64
#: Values in a band: at similarity 0.75 all 32 bands miss with probability 5e-6.
BAND = 4


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    data = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    words = word_hashes(data, *word_bounds(data))
    return np.unique(gram_hashes(words, min(shingle, len(words)))) if len(words) else np.zeros(0, np.uint64)


def _multipliers(functions: int) -> np.ndarray:
    return mix(np.arange(1, functions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def min_max_signature(shingles: np.ndarray, factors: np.ndarray, block: int = 2048) -> np.ndarray:
    """Smallest and largest value of the set under each hash function, side by side."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(factors), np.uint64)
    for at in range(0, len(shingles), block):
        value = shingles[None, at : at + block] * factors[:, None]
        low, high = np.minimum(low, value.min(1)), np.maximum(high, value.max(1))
    return np.stack([low, high], 1).ravel()


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", functions: int = FUNCTIONS, band: int = BAND, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (equal for equal sets, null for the empty one), bands."""

    def make():
        factors = _multipliers(functions)
        n_bands = 2 * functions // band

        def work(batch: pa.RecordBatch) -> dict:
            sizes, keys, bands = [], [], []
            for value in batch.column(1):
                found = shingle_set(value.as_py(), shingle)
                sizes.append(len(found))
                if not len(found):
                    keys.append(None)
                    bands.append([])
                    continue
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                signature = min_max_signature(found, factors)[: n_bands * band].reshape(n_bands, band)
                folded = np.arange(n_bands, dtype=np.uint64)
                for k in range(band):
                    folded = mix(folded * np.uint64(0x9E3779B97F4A7C15) + signature[:, k])
                bands.append(folded.view(np.int64).tolist())
            return {"doc_id": batch.column(0), "text_hash": batch.column(2), "n_shingles": sizes, "set_key": keys, "bands": bands}

        return work

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    return map_rows(rows, make, "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>")


def _packed(docs: DataFrame) -> DataFrame:
    """Texts as zstd blocks: a third of the shuffle."""

    def make():
        pack = zstandard.ZstdCompressor(level=3)
        return lambda batch: {"node": batch.column(0), "packed": [pack.compress((t or "").encode("utf-8", "replace")) for t in batch.column(1).to_pylist()]}

    return map_rows(docs, make, "node long, packed binary")


def confirm(pairs: DataFrame, packed: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, with their similarity."""

    def make():
        unpack = zstandard.ZstdDecompressor()
        last: dict[bytes, np.ndarray] = {}

        def sets(block: bytes) -> np.ndarray:
            if block not in last:
                if len(last) > 64:
                    last.clear()
                last[block] = _unpacked(unpack, block, shingle)
            return last[block]

        def work(batch: pa.RecordBatch) -> dict:
            out = {"a": [], "b": [], "similarity": []}
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                one, two = sets(x), sets(y)
                if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
                    continue
                shared = len(np.intersect1d(one, two, assume_unique=True))
                union = len(one) + len(two) - shared
                if union and 100 * shared >= percent * union:
                    out["a"].append(a)
                    out["b"].append(b)
                    out["similarity"].append(shared / union)
            return out

        return work

    first = pairs.join(packed.select(F.col("node").alias("a"), F.col("packed").alias("one")), "a")
    return map_rows(first.join(packed.select(F.col("node").alias("b"), F.col("packed").alias("two")), "b").select("a", "b", "one", "two"), make, "a long, b long, similarity double")


def _similar_size(a: str = "n_a", b: str = "n_b", percent: int = PERCENT):
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _may_link(n_a: str, most_a: str, n_b: str, most_b: str, percent: int):
    """Whether two sets of these sizes can be similar enough if they share at most that many shingles."""
    shared = f"least({most_a}, {most_b})"
    return F.expr(f"100 * {shared} >= {percent} * ({n_a} + {n_b} - {shared})")


def _size_bands(rows: DataFrame, percent: int) -> DataFrame:
    """Buckets cut by size: each row is in its own band and the next, so sets that can be similar enough share one."""
    # A little wider than the largest ratio of sizes, against rounding.
    width = max(math.log(100 / percent), 1e-6) * (1 + 1e-9)
    band = F.floor(F.log("n") / width)
    return rows.withColumn("band", F.explode(F.array(band, band + 1))).withColumn("key", F.xxhash64("key", "band")).drop("band")


def _mixed(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows (key, node, ...) of buckets with more than one component, with m (members) and cross (pairs between components)."""
    placed = rows.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    cross = (F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2
    return placed.join(groups.groupBy("key").agg(F.sum("c").alias("m"), cross.alias("cross")).where("cross > 0"), "key")


def _compare_blocks(open_rows: DataFrame, packed: DataFrame, percent: int, shingle: int, block: int) -> DataFrame:
    """Links (a, b) between different components of a bucket.

    In each bucket, the members outside its largest component are compared with
    all others, ``block`` against ``block`` members in a task, by counting
    shared shingles; so neither a bucket nor its pairs are ever gathered.  Each
    member gives one link to a component at most.
    """
    sizes = open_rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("c", "component"))["component"].alias("main"), (F.sum("c") - F.max("c")).alias("few"))
    rows = open_rows.join(sizes, "key").join(packed, "node").select("key", "node", "component", "packed", "main", "m", "few")
    part = lambda n: F.ceil(F.col(n) / block).cast("int")
    place = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), part(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), part(n) - 1))
    one = rows.where("component <> main").select("key", place("few", 1).alias("x"), every("m").alias("y"), F.lit(0).alias("side"), "node", "component", "packed")
    two = rows.select("key", every("few").alias("x"), place("m", 2).alias("y"), F.lit(1).alias("side"), "node", "component", "packed")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        left, right = (group[group["side"] == k] for k in (0, 1))
        node_a, node_b, c_a, c_b = (p[c].to_numpy() for c in ("node", "component") for p in (left, right))
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        known = {n: _unpacked(unpack, p, shingle) for n, p in zip(group["node"], group["packed"], strict=True)}
        xs, ys = [known[n] for n in node_a], [known[n] for n in node_b]
        flat, owner = np.concatenate(ys), np.repeat(np.arange(len(ys)), [len(y) for y in ys])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        n_b = np.array([len(y) for y in ys])
        out = []
        for i, x in enumerate(xs):
            first, last = np.searchsorted(flat, x), np.searchsorted(flat, x, side="right")
            count = last - first
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            shared = np.bincount(owner[at], minlength=len(ys))
            ok = (100 * shared >= percent * (len(x) + n_b - shared)) & (c_b != c_a[i])
            _, pick = np.unique(c_b[ok], return_index=True)
            out += [(node_a[i], b) for b in node_b[ok][pick]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return one.unionByName(two).groupBy("key", "x", "y").applyInPandas(compare, "a long, b long").distinct()


def _unpacked(unpack: zstandard.ZstdDecompressor, block: bytes, shingle: int) -> np.ndarray:
    return shingle_set(unpack.decompress(block, max_output_size=1 << 31).decode() if block else "", shingle)


def _own_shingles(packed: DataFrame, shingle: int) -> DataFrame:
    """node, own: how many of its shingles no other of these documents has.  They cannot be shared."""

    def make():
        unpack = zstandard.ZstdDecompressor()
        return lambda batch: {"node": batch.column(0), "shingles": [_unpacked(unpack, b, shingle).view(np.int64) for b in batch.column(1).to_pylist()]}

    found = map_rows(packed.select("node", "packed"), make, "node long, shingles array<long>").select("node", F.explode("shingles").alias("shingle"))
    single = found.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
    return single.groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def _numbered(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """Adds ``node``: the class's smallest id, or, where another class has that id too, a number below all ids.

    The flag says whether there are such numbers.
    """
    repeated = classes.groupBy("doc").agg(F.min("set_key").alias("first_key"), F.count(F.lit(1)).alias("m")).where("m > 1")
    if not repeated.limit(1).count():
        return classes.withColumn("node", F.col("doc")), False
    marked = classes.join(repeated, "doc", "left").withColumn("later", F.coalesce(F.col("set_key") != F.col("first_key"), F.lit(False)))
    least = min(0, classes.agg(F.min("doc")).first()[0])
    node = F.when(F.col("later"), F.lit(least) - 1 - F.monotonically_increasing_id()).otherwise(F.col("doc"))
    return scratch.keep(marked.select("set_key", "doc", node.alias("node")), "numbers"), True


def _grouped(docs: DataFrame, doc_id: str, text: str, percent: int, functions: int, band: int, shingle: int, block: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key, label (of the group; null without shingles), component_id of each row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scratch = Scratch(docs.sparkSession)
    signed = scratch.keep(signatures(docs, functions=functions, band=band, shingle=shingle), "signatures")
    classes = signed.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("doc"))
    classes, renumbered = _numbered(scratch.keep(classes, "classes"), scratch)
    # One row for each class: repeated ids with other texts stay apart by their set.
    nodes = (
        signed.where("doc_id IS NOT NULL").join(classes, "set_key").where("doc_id = doc")
        .groupBy("node", "set_key", "doc").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.min("text_hash").alias("text_hash"))
        .select("node", "doc", "text_hash", "n", F.explode("bands").alias("key"))
    )
    shared = nodes.groupBy("key").agg(F.min("node").alias("hub"), F.min(F.struct("node", "n"))["n"].alias("n_hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = scratch.keep(nodes.join(shared, "key"), "members")
    wanted = members.select("node", F.col("doc").alias("doc_id"), "text_hash").distinct()
    texts = docs.withColumn("text_hash", F.xxhash64("text")).join(wanted, ["doc_id", "text_hash"]).select("node", "text")
    packed = scratch.keep(_packed(texts).groupBy("node").agg(F.min("packed").alias("packed")), "packed")

    star = members.where("node <> hub").where(_similar_size("n", "n_hub", percent)).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = scratch.keep(confirm(star, packed, percent, shingle), "confirmed").select("a", "b")
    joined = components(links)
    rest = scratch.keep(_mixed(members.where("m > 2 AND node <> hub").select("key", "node", "n"), joined), "mixed")
    lonely = _own_shingles(packed.join(rest.select("node").distinct(), "node", "left_semi"), shingle)
    rest = rest.select("key", "node", "n").join(lonely, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    rest = _size_bands(rest.where(_may_link("n", "n - own", "n - own", "n - own", percent)), percent)
    # A member stays if its best possible partner, within the sizes of its bucket, would reach the threshold.
    reach = rest.groupBy("key").agg(F.min("n").alias("n_low"), F.max(F.col("n") - F.col("own")).alias("most"))
    rest = rest.join(reach, "key").where(_may_link("n", "n - own", "greatest(n_low, least(n - own, most))", "most", percent)).select("key", "node", "n", "own")
    open_rows = scratch.keep(_mixed(rest, joined), "open")
    if open_rows.limit(1).count():
        more = scratch.keep(_compare_blocks(open_rows, packed, percent, shingle, block), "confirmed")
        joined = components(links.unionByName(more))
    scratch.drop("members", "packed", "confirmed", "mixed", "open")
    grouped = classes.join(joined.select("node", "component"), "node", "left").withColumn("label", F.coalesce("component", "node"))
    if renumbered:
        name = grouped.groupBy("label").agg(F.min("doc").alias("name"))
        grouped = grouped.join(name, "label")
    else:
        grouped = grouped.withColumn("name", F.col("label"))
    placed = signed.select("doc_id", "text_hash", "n_shingles", "set_key").join(grouped.select("set_key", "label", "name"), "set_key", "left")
    return placed.withColumn("component_id", F.coalesce("name", "doc_id")).drop("name")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT,
                    functions: int = FUNCTIONS, band: int = BAND, shingle: int = SHINGLE, block: int = 256) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    block: members of a bucket that one task compares with as many others.
    """
    placed = _grouped(docs, doc_id, text, percent, functions, band, shingle, block)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.isnull("component_id"))
    return placed.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT,
             functions: int = FUNCTIONS, band: int = BAND, shingle: int = SHINGLE, block: int = 256) -> DataFrame:
    """The rows of ``docs`` without all but one row of each group: a row with the group's smallest id.

    Rows without an id stay, and so do those without a word, which are in no
    group.  Different texts under one id stay, unless they are in one group.
    """
    placed = _grouped(docs, doc_id, text, percent, functions, band, shingle, block)
    own = placed.where("set_key IS NOT NULL AND doc_id = component_id").groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("own"))
    name, key, hashed = unused(docs.columns, "kept_id", "kept_hash", "own_hash")
    own = own.select(F.col("own.doc_id").alias(name), F.col("own.text_hash").alias(key)).distinct()
    ident = every(docs, doc_id)[0].cast("long")
    rows = docs.withColumn(hashed, F.xxhash64(*every(docs, text)))
    free = ident.isNull() | ~F.coalesce(every(docs, text)[0].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = rows.where(~free).join(own, (ident == F.col(name)) & (F.col(hashed) == F.col(key)), "left_semi")
    named = named.dropDuplicates([doc_id, hashed])
    return named.unionByName(rows.where(free)).select(*every(docs))
