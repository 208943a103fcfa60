"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed left to right into phrases, each the shortest piece that is not
in the dictionary yet.  The set of phrases is hashed, and the fingerprint keeps
the smallest value under each of ``SLOTS`` hash functions.  The share of equal
slots estimates how many phrases two texts have in common, which follows how
well one text compresses the other.

``compare_with_next`` walks the documents in descending id order and compares
each with the next one and with an edited copy of itself that ends with the
start of the next one.  Documents lie in blocks of ids; each block also gets
the first document of the block after it.  A document and its edited copy share
the parse of what they have in common.

Cases: a null text is the empty one.  The empty text has no phrases; it equals
only texts without phrases (likeness 1) and is 0 to all others.  Repeated ids
are ordered by their texts; rows without an id come after all others.  A single
document is its own next one.  Equal texts have equal fingerprints.  An empty
table gives no rows; other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import arrow_schema, map_rows, mix, modest_batches

SLOTS = 64
#: Cells of the histogram of ids from which blocks are made.
CELLS = 1 << 14
_BASE = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint32(0xFFFFFFFF)


def _multipliers(slots: int) -> np.ndarray:
    return mix(np.arange(1, slots + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def parse(text: str, phrases: dict[str, None], open_phrase: str = "") -> str:
    """Add the phrases of ``text`` to a parse; what is left over at the end comes back."""
    for c in text:
        open_phrase += c
        if open_phrase not in phrases:
            phrases[open_phrase] = None
            open_phrase = ""
    return open_phrase


def phrase_hashes(phrases: list[str]) -> np.ndarray:
    """A 64-bit hash of each phrase, all at once."""
    if not phrases:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, phrases), np.int64, len(phrases))
    start = np.cumsum(size) - size
    code = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    place = np.arange(len(code)) - np.repeat(start, size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max()), _BASE)]), dtype=np.uint64)
        return mix(np.add.reduceat((code + np.uint64(1)) * power[place], start) + size.astype(np.uint64))


def signature(hashes: np.ndarray, factors: np.ndarray, block: int = 4096) -> np.ndarray:
    """The smallest value of the set under each hash function, as 32 bits."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), block):
        low = np.minimum(low, (hashes[None, at : at + block] * factors[:, None]).min(1))
    return (low >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str, slots: int = SLOTS) -> np.ndarray:
    phrases: dict[str, None] = {}
    parse(text, phrases)
    return signature(phrase_hashes(list(phrases)), _multipliers(slots))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots; a text without phrases is like another one without phrases only."""
    none_a, none_b = bool((a == _EMPTY).all()), bool((b == _EMPTY).all())
    return float(none_a and none_b) if none_a or none_b else float((a == b).mean())


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id and fingerprint (hex) of each row."""
    def work(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "fingerprint": [fingerprint(t or "", slots).tobytes().hex() for t in batch.column(1).to_pylist()]}

    return map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), lambda: work, "doc_id long, fingerprint string")


_PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS, blocks: int | None = None) -> DataFrame:
    """Each row's fingerprint, that of its edited copy, and how like the copy and the next document are.

    blocks: number of id ranges; four for each shuffle partition if not given.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = min(CELLS, blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    block = _block_of(rows.select("doc_id"), blocks)
    rows = rows.withColumn("block", block)
    # The first id of each block, and the block before it; the last block is followed by the first one.
    firsts = rows.groupBy("block").agg(F.max("doc_id").alias("top")).orderBy("block").collect()
    if not firsts:
        return spark.createDataFrame([], _PAIRED)
    tops: list[int | None] = [None] * (firsts[-1]["block"] + 1)
    before = [0] * len(tops)
    for f, earlier in zip(firsts, [firsts[-1], *firsts], strict=False):
        tops[f["block"]], before[f["block"]] = f["top"], earlier["block"]
    at = F.col("block") + 1
    heads = F.col("doc_id").eqNullSafe(F.element_at(F.lit(tops) if any(t is not None for t in tops) else F.array(F.lit(None).cast("long")), at))
    previous = F.element_at(F.lit(before), at)
    # Each row goes to its block; heads are lent to the block before as well, behind its rows.
    own, lent = F.struct(F.col("block").alias("block"), F.lit(0).alias("lent")), F.struct(previous.alias("block"), F.lit(1).alias("lent"))
    spread = rows.withColumn("to", F.explode(F.when(heads, F.array(own, lent)).otherwise(F.array(own))))
    spread = spread.select(F.col("to.block").alias("block"), F.col("to.lent").alias("lent"), "doc_id", "text")
    dealt = spread.repartition("block").sortWithinPartitions("block", "lent", F.desc_nulls_last("doc_id"), "text")
    schema = arrow_schema(_PAIRED)

    def run(batches):
        factors = _multipliers(slots)

        def sign(phrases):
            return signature(phrase_hashes(list(phrases)), factors)

        def one(doc, own, following, own_sign=None):
            n = len(own)
            keep = n - n // 3
            phrases: dict[str, None] = {}
            left = parse(own[:keep], phrases)
            ending = following[: n // 3]
            if ending == own[keep:]:
                parse(ending, phrases, left)
                mine = other = sign(phrases)
            else:
                edited = dict(phrases)
                parse(own[keep:], phrases, left)
                parse(ending, edited, left)
                mine, other = sign(phrases), sign(edited)
            return mine, other, hashlib.sha256((own[:keep] + ending).encode("utf-8", "surrogatepass")).hexdigest()

        def emit(rows):
            return pa.RecordBatch.from_pydict(rows, schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

        held = None  # (block, doc, text): the row whose next one is to come
        waiting = None  # its results without near_next
        out = defaultdict(list)

        def finish(next_sign):
            doc, n, sha, mine, other = waiting
            for name, value in zip(schema.names, (doc, n, sha, mine.tobytes().hex(), other.tobytes().hex(), likeness(mine, other), likeness(mine, next_sign)), strict=True):
                out[name].append(value)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for where, lent, doc, text_ in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                    if held is not None and held[0] == where:
                        mine, other, sha = one(held[1], held[2], text_)
                        if waiting is not None:
                            finish(mine)
                        waiting = held[1], len(held[2]), sha, mine, other
                    if lent:  # the block is over: the first lent row is the next one of its last row
                        if waiting is not None:
                            phrases: dict[str, None] = {}
                            parse(text_, phrases)
                            finish(sign(phrases))
                        held = waiting = None
                    else:
                        held = where, doc, text_
                if out:
                    yield emit(dict(out))
                    out.clear()
        yield emit(dict(out))

    modest_batches(spark)
    return dealt.mapInArrow(run, _PAIRED)


def _block_of(ids: DataFrame, blocks: int):
    """A column: the block of an id, largest ids first, about equally many rows in each; null ids come last.

    Ids are counted in ``CELLS`` cells of equal width; blocks are runs of cells.
    """
    low, high, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    if low is None:
        return F.lit(0)
    width = (float(high) - float(low)) / CELLS or 1.0
    cell = F.least(F.floor((F.col("doc_id").cast("double") - F.lit(float(low))) / F.lit(width)).cast("int"), F.lit(CELLS - 1))
    count = {r["cell"]: r["count"] for r in ids.where("doc_id IS NOT NULL").groupBy(cell.alias("cell")).count().collect()}
    most, block, rows, of_cell = -(-n // blocks), 0, 0, [0] * CELLS
    for k in range(CELLS - 1, -1, -1):
        if rows and rows + count.get(k, 0) > most:
            block, rows = block + 1, 0
        rows += count.get(k, 0)
        of_cell[k] = block
    return F.when(F.col("doc_id").isNull(), block + 1).otherwise(F.element_at(F.lit(of_cell), cell + 1)).cast("int")
