"""File sources: folders of files in, ``files`` relations out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilrow.functions.columns import FEATURES, NGRAM_SUFFIXES, SCAN_SUFFIXES, TRAIN_SUFFIXES
from vigilrow.functions.python_columns import slices
from vigilrow.operators.dataset import labelled_union
from vigilrow.operators.features import MIN_CHARS, suffix_of
from vigilrow.session import materialize
from vigilrow.sources import stores

# ---------------------------------------------------------------------------
# Encodings in the order they are tried.
# ---------------------------------------------------------------------------
SCAN_ENCODINGS = ("utf-16", "utf-16-le", "utf-16-be")
NGRAM_ENCODINGS = (
    "utf-8", "utf-16", "utf-16-le", "utf-16-be", "latin-1", "cp1252", "iso-8859-1", "gb2312", "gbk", "big5", "ascii",
)
# End of the fixed values.

DECODED = T.StructType([T.StructField("code", T.StringType()), T.StructField("encoding", T.StringType())])


def _printable(text: str) -> str:
    """Lone surrogates cannot be stored as text: each becomes U+FFFD."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if not text.isascii() else text


def decode_for_scan(raw: bytes) -> tuple[str, str]:
    """UTF-16 forms without their NULs, else Latin-1; for bytes that are not UTF-8."""
    for name in SCAN_ENCODINGS:
        try:
            return _printable(raw.decode(name).replace("\x00", "")), name
        except UnicodeError:
            continue
    return raw.decode("latin-1"), "latin-1"


def decode_for_ngrams(raw: bytes) -> tuple[str | None, str | None]:
    """The first encoding that reads all bytes and gives 20 characters, else lenient UTF-8."""
    for name in NGRAM_ENCODINGS:
        try:
            text = raw.decode(name)
        except UnicodeError:
            continue
        if len(text) >= MIN_CHARS:
            return _printable(text), name
    text = raw.decode("utf-8", "replace")
    return (text, "utf-8-replace") if len(text) >= MIN_CHARS else (None, None)


def decode_any(raw: bytes) -> tuple[str, str]:
    """UTF-8 if the bytes are valid UTF-8, else the other scan encodings."""
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeError:
        return decode_for_scan(raw)


def _decoded(files: DataFrame, rule: Callable[[bytes], tuple[str | None, str | None]]) -> DataFrame:
    """Adds ``code`` and ``encoding``, one Arrow batch at a time.

    Spark's own decoder refuses bytes that are not valid, so the trial of
    encodings runs in Python.  As an operator of its own it is also planned on
    its own: later text work is not rewritten in terms of it.
    """
    schema = T.StructType([*files.schema.fields, *DECODED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(None, None) if raw is None else rule(raw) for raw in batch.column("content").to_pylist()]
            more = [pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    return files.mapInArrow(run, schema)


def with_code(files: DataFrame) -> DataFrame:
    """Adds ``code`` and ``encoding``: every file gets a text."""
    return _decoded(files, decode_any)


def with_ngram_code(files: DataFrame) -> DataFrame:
    """As ``with_code`` by the n-gram corpus rules: texts of 20 and more characters only."""
    return _decoded(files, decode_for_ngrams).where(F.col("code").isNotNull())


LISTED = "root string, path string, size long, is_folder boolean"
_LISTED = pa.schema([("root", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("is_folder", pa.bool_())])
#: Names of a folder that leave a task at once.
_LISTED_AT_ONCE = 10_000


def list_files(spark: SparkSession, folders: list[str], recursive: bool = True, openers: stores.Openers | None = None) -> DataFrame:
    """``root, path, size`` of every file below the folders, in any store (see ``stores``).

    Folder by folder, one level a round: the folders found so far are rows, and
    tasks list them.  Nothing is left out: names that start with a dot or an
    underscore, what lies below such folders, and empty files are all listed.
    A folder that cannot be read comes back as a row with size -1.  ``root`` is
    the given folder that a file was found below.
    """
    known = dict(openers or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: list[tuple[str, int, bool]] = []

                def rows() -> pa.RecordBatch:
                    # Names that are no UTF-8 cannot be stored; they are marked, and reading them fails.
                    paths = [stores.join(folder, n).encode("utf-8", "surrogateescape").decode("utf-8", "replace") for n, _, _ in found]
                    columns = [root] * len(found), paths, [size for _, size, _ in found], [is_folder for _, _, is_folder in found]
                    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LISTED)], schema=_LISTED)

                try:
                    for entry in stores.entries(root, folder, known):
                        found.append(entry)
                        if len(found) >= _LISTED_AT_ONCE:
                            yield rows()
                            found.clear()
                    yield rows()
                except OSError:
                    yield rows()
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((root, folder, -1, False), _LISTED)], schema=_LISTED)

    # The given folders are the only rows made on the driver.
    roots = [stores.local_path(f).rstrip("/") or "/" for f in folders]
    frontier = spark.createDataFrame([(r, r) for r in roots], "root string, path string")
    files: DataFrame | None = None
    while True:
        level = materialize(frontier.repartition("path").mapInArrow(run, LISTED), "listing")
        found = level.where("NOT is_folder").select("root", "path", "size")
        files = found if files is None else files.unionByName(found)
        frontier = level.where("is_folder").select("root", "path")
        if not recursive or not frontier.limit(1).count():
            return files


def read_files(paths: DataFrame, openers: stores.Openers | None = None) -> DataFrame:
    """``path, size`` rows (``root`` too, from a listing) to ``file_id, path, ext, size, content``.

    Unreadable files have no content.
    """
    known = dict(openers or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, path, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                content = None
                if size >= 0:
                    try:
                        content = stores.read(root, path, known)
                    except OSError:
                        pass
                yield pa.RecordBatch.from_pydict({"path": [path], "size": [size], "content": [content]}, schema=pa.schema([("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())]))

    root = F.col("root") if "root" in paths.columns else F.col("path")
    raw = paths.select(root.alias("root"), "path", "size").repartition("path").mapInArrow(run, "path string, size long, content binary")
    return raw.select(F.xxhash64("path").alias("file_id"), "path", suffix_of(F.col("path")).alias("ext"), F.greatest("size", F.lit(0)).alias("size"), "content")


def read_folder(
    spark: SparkSession, folders: str | list[str], suffixes: tuple[str, ...] | None = SCAN_SUFFIXES,
    recursive: bool = True, max_bytes: int | None = None, openers: stores.Openers | None = None,
) -> DataFrame:
    """Files below (or directly in) the folders of any store: ``file_id, path, ext, size, content``.

    Suffixes and the size limit are applied to the listing, before any file is
    read; ``suffixes=None`` takes every file.
    """
    paths = list_files(spark, [folders] if isinstance(folders, str) else list(folders), recursive, openers)
    if suffixes is not None:
        paths = paths.where(suffix_of(F.col("path")).isin(*suffixes))
    if max_bytes is not None:
        paths = paths.where(F.col("size") <= max_bytes)
    return read_files(paths, openers)


def scan_source(spark: SparkSession, folders: str | list[str], openers: stores.Openers | None = None) -> DataFrame:
    """All files of a scan, decoded; the gates decide which are scanned."""
    return with_code(read_folder(spark, folders, None, openers=openers))


def ngram_source(
    spark: SparkSession, folders: str | list[str], max_bytes: int | None = None, openers: stores.Openers | None = None
) -> DataFrame:
    raw = read_folder(spark, folders, NGRAM_SUFFIXES, max_bytes=max_bytes, openers=openers)
    return with_ngram_code(raw.where(F.col("size") > 0))


def folder_list(folders: str | list[str]) -> list[str]:
    """A list, or one string with commas between the folders."""
    parts = folders.split(",") if isinstance(folders, str) else folders
    return [p.strip() for p in parts if p.strip()]


def labelled_source(
    spark: SparkSession, clean: str | list[str], bad: str | list[str], openers: stores.Openers | None = None
) -> DataFrame:
    """Training files with their label, from several clean and bad folders."""
    load = lambda f: with_code(read_folder(spark, f, TRAIN_SUFFIXES, openers=openers))
    return labelled_union([load(f) for f in folder_list(clean)], [load(f) for f in folder_list(bad)])


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A model's metadata document: one row."""
    return spark.read.json(path, multiLine=True)


def read_importances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="feature string, importance double")


def frozen_features(metadata: DataFrame) -> tuple[str, ...]:
    """The feature order a model was trained with; the built-in order if it names none."""
    if "feature_names" not in metadata.columns:
        return FEATURES
    return tuple(metadata.select("feature_names").first()[0])
