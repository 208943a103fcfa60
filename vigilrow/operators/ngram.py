"""Character and word n-gram weights (TF-IDF) as a long table."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilrow.functions import text as X
from vigilrow.functions.python_columns import slices
from vigilrow.session import materialize, small_batches


@dataclass(frozen=True)
class Block:
    """One family of n-grams and the limits of its vocabulary."""

    name: str
    sizes: tuple[int, ...]
    limit: int
    min_files: int
    max_share: float


# ---------------------------------------------------------------------------
# The two n-gram blocks.
# ---------------------------------------------------------------------------
CHAR = Block("char", (3, 4, 5, 6), 15_000, 2, 0.90)
WORD = Block("word", (1, 2, 3), 8_000, 3, 0.85)
# End of the fixed values.


def training_view(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Adds ``clean``: the text as the n-gram model is trained on it, whole unless a limit is given."""
    df = files.withColumn("clean", F.replace(F.col("code"), F.lit("\x00"), F.lit("")))
    for opening, closing in (("<!--", "-->"), ("<%--", "--%>"), ("/*", "*/")):
        df = df.withColumn("clean", X.blank_blocks(F.col("clean"), opening, closing))
    df = df.withColumn("clean", X.blank_line_comments(F.col("clean"), "//"))
    df = df.withColumn("clean", X.bucket_base64(F.col("clean")))
    df = df.withColumn("clean", X.collapse_space(F.col("clean")))
    return df.withColumn("clean", X.head_of(F.col("clean"), max_chars))


def scoring_view(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Adds ``clean``: the text as a scan scores it, hardly cleaned at all."""
    return files.withColumn("clean", X.scoring_text(F.col("code"), max_chars))


# --- taking texts apart ----------------------------------------------------
#
# A text of n characters has about 4 n grams.  Counting them inside the row, in
# one Arrow batch helper, needs neither a shuffle nor a hash table over all
# files; exploding and grouping them in Spark was measured six times slower and
# spills.  Spark does the rest: counting terms over tasks, choosing, joining.

SQUEEZE = re.compile(r"\s\s+")
WORDS = re.compile(r"\w+")


def fold_text(text: str) -> str:
    """Lower case, compatibility decomposition, no combining marks."""
    low = text.lower()
    if low.isascii():
        return low
    return "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


def units(text: str, block: Block) -> str | list[str]:
    """What the n-grams of a block are runs of: the characters or the words of a text."""
    folded = fold_text(text)
    return SQUEEZE.sub(" ", folded) if block.name == "char" else WORDS.findall(folded)


def _runs(line: str | list[str], n: int, block: Block) -> list[str]:
    if block.name == "char":
        return [line[i : i + n] for i in range(len(line) - n + 1)]
    return line if n == 1 else [" ".join(p) for p in zip(*(line[k:] for k in range(n)))]


def count_terms(text: str, block: Block) -> Counter:
    """How often each n-gram of the block occurs in a text."""
    line = units(text, block)
    found: Counter = Counter()
    for n in block.sizes:
        found.update(_runs(line, n, block))
    return found


class Matcher:
    """The terms of a vocabulary block; counts those that a text holds.

    Characters are matched by one automaton over all terms, in one pass over the
    text, so substrings that are no term cost nothing.  Runs of words are looked
    up, longer ones only from words that some longer term begins with.
    """

    def __init__(self, block: Block, known: dict[str, tuple[int, float]]):
        self.block = block
        self.number = {term: at for term, (at, _) in known.items()}
        self.idf = np.zeros(max(self.number.values(), default=0) + 1)
        for at, idf in known.values():
            self.idf[at] = idf
        if block.name == "char":
            self.automaton = ahocorasick.Automaton()
            for term, at in self.number.items():
                self.automaton.add_word(term, at)
            self.automaton.make_automaton()
        self.longer = {t.split(" ", 1)[0] for t in known if " " in t}

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the terms in a text, in order, and how often each occurs."""
        if not self.number:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        line = units(text, self.block)
        if self.block.name == "char":
            found = map(itemgetter(1), self.automaton.iter(line))
        else:
            number = self.number
            starts = [i for i, w in enumerate(line) if w in self.longer]
            runs = (" ".join(line[i : i + n]) for n in self.block.sizes if n > 1 for i in starts if i + n <= len(line))
            found = [number[r] for r in chain(line, runs) if r in number]
        times = np.bincount(np.fromiter(found, np.int64))
        ids = np.flatnonzero(times)
        return ids, times[ids]


COUNTS_TYPE = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("term", T.StringType()),
        T.StructField("tf", T.IntegerType()),
    ]
)


def term_counts(texts: DataFrame, block: Block) -> DataFrame:
    """``file_id, term, tf``"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in zip(batch["file_id"].to_pylist(), batch["clean"].to_pylist()):
                found = count_terms(text or "", block)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([at] * len(found), pa.int64()),
                        pa.array(list(found.keys()), pa.string()),
                        pa.array(list(found.values()), pa.int32()),
                    ],
                    names=COUNTS_TYPE.names,
                )

    return texts.select(F.col("file_id").cast("long"), "clean").mapInArrow(run, COUNTS_TYPE)


#: Characters (or words) whose n-grams a task counts together before it hands the counts on.
_UNITS_AT_ONCE = 1_000_000


#: N-grams fall by a hash into so many buckets; what a bucket holds bounds the uses of each of its n-grams.
BUCKETS = 1 << 20
#: Rows that a table of buckets is cut into.
_PARTS = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Pile:
    """Some texts in one line of digits: an n-gram is one number, exactly.

    Characters (or words) become digits of a base that is the number of different ones.
    """

    def __init__(self, lines: list, block: Block):
        self.block = block
        if block.name == "char":
            self.whole = "".join(lines)
            codes = np.frombuffer(self.whole.encode("utf-32-le", "surrogatepass"), np.uint32)
            there = np.zeros(int(codes.max(initial=0)) + 1, bool)
            there[codes] = True
            self.base = int(there.sum())
            self.digits = (np.cumsum(there) - 1)[codes]
            marks = np.flatnonzero(there).astype(np.uint64) + np.uint64(1)
        else:
            self.whole = list(chain.from_iterable(lines))
            self.digits, words = pd.factorize(np.array(self.whole, object))
            self.base = len(words)
            marks = np.array([int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in words], np.uint64)
        marks *= _MIX
        self.marks = (marks ^ (marks >> np.uint64(29)))[self.digits]
        self.text = np.repeat(np.arange(len(lines)), [len(line) for line in lines])
        self.hashed = 0, np.zeros(len(self.digits), np.uint64)

    def inside(self, n: int) -> np.ndarray:
        """Whether n digits of one text stand at each place."""
        count = max(0, len(self.digits) - n + 1)
        return self.text[:count] == self.text[n - 1 : n - 1 + count]

    def buckets(self, n: int) -> np.ndarray:
        """The bucket of the n-gram at each place; the same in every pile."""
        count = max(0, len(self.digits) - n + 1)
        known, key = self.hashed if self.hashed[0] <= n else (0, np.zeros(len(self.digits), np.uint64))
        key = key[:count].copy()
        for k in range(known, n):  # goes on from the hashes of shorter n-grams
            key *= _MIX
            key ^= key >> np.uint64(32)
            key += self.marks[k : k + count]
        self.hashed = n, key
        key = (key + np.uint64(n)) * _MIX
        return (key >> np.uint64(44)).astype(np.int64)

    def counts(self, n: int, wanted: np.ndarray | None = None) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        """Terms of n characters, texts that hold each, and uses; None if the alphabet is too large for one number.

        ``wanted`` marks the buckets whose n-grams are counted; null: all.
        """
        if self.base**n >= 2**63:
            return None
        count = max(0, len(self.digits) - n + 1)
        inside = self.inside(n)
        if wanted is not None:
            inside &= wanted[self.buckets(n)]
        inside = np.flatnonzero(inside)
        key = np.zeros(count, np.int64)
        for k in range(n):
            key *= self.base
            key += self.digits[k : k + count]
        # Places of one term stay in text order, so a text's places stand together.
        room = count.bit_length()
        if self.base**n < 2 ** (63 - room):  # term and place in one number: sorting plain numbers is several times faster
            place = np.sort(key[inside] << room | inside) & ((1 << room) - 1)
        else:
            place = inside[np.argsort(key[inside], kind="stable")]
        if not len(place):
            return [], place, place
        key, text = key[place], self.text[place]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        other_text = new | np.concatenate([[True], text[1:] != text[:-1]])
        whole, at = self.whole, place[first].tolist()
        terms = [whole[p : p + n] if self.block.name == "char" else " ".join(whole[p : p + n]) for p in at]
        return terms, np.add.reduceat(other_text.astype(np.int64), first), np.diff(np.append(first, len(key)))


def _plain_counts(lines: list, n: int, block: Block) -> tuple[list[str], np.ndarray, np.ndarray]:
    uses: Counter = Counter()
    files: Counter = Counter()
    for line in lines:
        found = Counter(_runs(line, n, block))
        files.update(found.keys())
        for term, tf in found.items():
            uses[term] += tf
    terms = list(uses)
    return terms, np.array([files[t] for t in terms], np.int64), np.array([uses[t] for t in terms], np.int64)


def _piles(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[list]:
    """The units of some texts at a time."""
    lines, held = [], 0
    for batch in slices(batches):
        for text in batch["clean"].to_pylist():
            lines.append(units(text or "", block))
            held += len(lines[-1])
            if held > _UNITS_AT_ONCE:
                yield lines
                lines, held = [], 0
    if lines:
        yield lines


def bucket_uses(texts: DataFrame, block: Block) -> np.ndarray:
    """Uses of all n-grams of each bucket: a table of fixed size, summed over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, np.int64)
        for lines in _piles(batches, block):
            pile = Pile(lines, block)
            for n in block.sizes:
                table += np.bincount(pile.buckets(n)[pile.inside(n)], minlength=BUCKETS)
        parts = [zstandard.compress(p.tobytes(), 1) for p in np.split(table, _PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "uses"])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zstandard.decompress(u), np.int64) for u in pdf["uses"])
        return pd.DataFrame({"part": pdf["part"][:1], "uses": [total.tobytes()]})

    kind = "part int, uses binary"
    rows = texts.select("clean").mapInArrow(run, kind).groupBy("part").applyInPandas(summed, kind).collect()  # 8 MB, at any size
    by_part = {r["part"]: np.frombuffer(r["uses"], np.int64) for r in rows}
    return np.concatenate([by_part.get(k, np.zeros(BUCKETS // _PARTS, np.int64)) for k in range(_PARTS)])


def merged_counts(texts: DataFrame, block: Block, wanted: np.ndarray | None = None) -> DataFrame:
    """``term, files, uses`` summed within a task: no row per file, nothing but terms and counts is shuffled.

    A term comes once from each pile of texts that a task counts together.
    With ``wanted``, terms of other buckets are left out, or counted in part.
    """
    schema = pa.schema([("term", pa.string()), ("files", pa.int64()), ("uses", pa.int64())])
    bits = None if wanted is None else np.packbits(wanted).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for lines in _piles(batches, block):
            pile = Pile(lines, block)
            for n in block.sizes:
                terms, files, uses = pile.counts(n, asked) or _plain_counts(lines, n, block)
                for at in range(0, len(terms), 50_000):
                    part = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(terms[part], pa.string()), pa.array(files[part]), pa.array(uses[part])], schema=schema)

    return texts.select("clean").mapInArrow(run, "term string, files long, uses long")


def _eligible(texts: DataFrame, block: Block, wanted: np.ndarray | None) -> DataFrame:
    """``term, files, uses, n`` of the terms within the block's limits of files."""
    n = texts.select(F.count("*")).scalar()
    return (
        merged_counts(texts, block, wanted)
        .groupBy("term")
        .agg(F.sum("files").alias("files"), F.sum("uses").alias("uses"))
        .where(F.col("files") >= block.min_files)
        .withColumn("n", n)
        .where(F.col("files") <= F.col("n") * block.max_share)
    )


def fit_vocabulary(texts: DataFrame, block: Block) -> DataFrame:
    """``block, term, files, uses, idf`` of the most used terms within the limits.

    Ties at the limit go to the alphabetically first term.

    Nearly all different n-grams are rare.  A first pass sums uses by buckets; a term with at least ``least``
    uses lies in a bucket with as many, so only such buckets are counted by term.  If too few terms have that
    many uses, ``least`` falls, at last to 0: the result is always that of counting all.
    """
    with small_batches(texts.sparkSession):
        bounds, rank, stats = bucket_uses(texts, block), 4 * block.limit, None
        while stats is None:
            least = int(np.partition(bounds, -rank)[-rank]) if rank < (bounds > 0).sum() else 0
            if least <= 1:
                stats = materialize(_eligible(texts, block, None), "terms")
                break
            found = materialize(_eligible(texts, block, bounds >= least).where(F.col("uses") >= least), "terms")
            stats = found if found.count() >= block.limit else None
            rank *= 4
    top = stats.orderBy(F.desc("uses"), "term").limit(block.limit)
    idf = F.log((1 + F.col("n")) / (1 + F.col("files"))) + 1
    return top.select(F.lit(block.name).alias("block"), "term", "files", "uses", idf.alias("idf"))


def vocabulary(texts: DataFrame, blocks: tuple[Block, ...] = (CHAR, WORD)) -> DataFrame:
    """All blocks' terms with dense ids, block after block, terms in order."""
    # Each block reads the texts at least twice: they are cleaned once and written.
    texts = materialize(texts.select("clean"), "gram-texts")
    terms = reduce(DataFrame.unionByName, [fit_vocabulary(texts, b) for b in blocks])
    # At most 23,000 rows: the vocabulary limits bound this window.
    order = Window.partitionBy(F.lit(0)).orderBy("block", "term")
    return terms.withColumn("term_id", F.row_number().over(order) - 1)


VECTOR_TYPE = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)


def weigh(text: str, matcher: Matcher) -> tuple[np.ndarray, np.ndarray]:
    """Term ids and unit-length weights of one text, in id order."""
    ids, times = matcher.count(text)
    values = (1.0 + np.log(times)) * matcher.idf[ids]
    return ids, values / np.sqrt((values * values).sum()) if len(ids) else values


#: Weights that a task holds before it hands them on.
_CELLS_AT_ONCE = 250_000


def with_weights(texts: DataFrame, vocab: DataFrame, blocks: tuple[Block, ...] = (CHAR, WORD), drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``weights``: term ids and TF-IDF weights of each text, in one pass, without a shuffle.  Leaves out ``drop``.

    The vocabulary has at most 23,000 rows, so it is fetched once and sent to
    every task.  A text has several times its length of weights, so rows leave
    in batches of so many weights, whatever number of rows comes at a time.
    """
    known: dict[str, dict[str, tuple[int, float]]] = {b.name: {} for b in blocks}
    for row in vocab.select("block", "term", "term_id", "idf").collect():
        if row["block"] in known:
            known[row["block"]][row["term"]] = (row["term_id"], row["idf"])
    sent = vocab.sparkSession.sparkContext.broadcast(known)
    kept = [f for f in texts.schema.fields if f.name not in ("weights", *drop)]
    passed = [f.name for f in kept]

    def weighed(rows: pa.RecordBatch, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ends = pa.array(np.cumsum([0, *(len(ids) for ids, _ in found)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), kind)) for x, kind in zip(zip(*found), (pa.int32(), pa.float64()))]
        both = pa.StructArray.from_arrays(lists, names=VECTOR_TYPE.names)
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in passed), both], names=[*passed, "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(block, sent.value[block.name]) for block in blocks]
        for batch in slices(batches):
            found, cells, start = [], 0, 0
            for at, text in enumerate(batch["clean"], 1):
                parts = [weigh(text.as_py() or "", matcher) for matcher in matchers]
                found.append(tuple(np.concatenate(p) for p in zip(*parts)))
                cells += len(found[-1][0])
                if cells >= _CELLS_AT_ONCE or at == batch.num_rows:
                    yield weighed(batch.slice(start, at - start), found)
                    found, cells, start = [], 0, at

    return texts.mapInArrow(run, T.StructType([*kept, T.StructField("weights", VECTOR_TYPE)]))


def weights(texts: DataFrame, vocab: DataFrame, blocks: tuple[Block, ...] = (CHAR, WORD)) -> DataFrame:
    """``file_id, term_id, value``: the long form of the weights."""
    cells = F.explode(F.arrays_zip("weights.ids", "weights.values"))
    long = with_weights(texts.select("file_id", "clean"), vocab, blocks, drop=("clean",)).select("file_id", cells.alias("c"))
    return long.select("file_id", F.col("c.ids").alias("term_id"), F.col("c.values").alias("value"))


def fill_share(texts: DataFrame, vocab: DataFrame, weighted: DataFrame) -> DataFrame:
    """How much of the file-by-term matrix is filled, in percent."""
    return weighted.agg(F.count("*").alias("filled")).select(
        "filled",
        texts.select(F.count("*")).scalar().alias("files"),
        vocab.select(F.count("*")).scalar().alias("terms"),
    ).withColumn("fill_percent", F.col("filled") / (F.col("files") * F.col("terms")) * 100)
