"""File sources and sinks on real folders."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import files
from vigilrow.functions.python_columns import ROWS_AT_ONCE, slices
from vigilrow.operators import evaluation as E
from vigilrow.operators import reports as R
from vigilrow.operators import scoring as S
from vigilrow.plans import scan as Z
from vigilrow.plans.catalog import stand_in_scores
from vigilrow.sinks import writers as W
from vigilrow.sources import files as SF
from vigilrow.sources.corpus import spread

TEXT = "<?php echo 'grün'; // some text ?>"
RAW = {
    "a/utf8.php": TEXT.encode(),
    "a/bom16.PHP": TEXT.encode("utf-16"),
    "a/latin.asp": TEXT.encode("latin-1") + b"x" * (1 - len(TEXT) % 2),
    "a/deep/even.js": b"\xe9" * 30,
    "a/odd.txt": b"\xe9" * 31,
    "a/big.php": b"x" * 2000,
    "a/empty.php": b"",
    "a/short.php": b"<?php",
    "a/skip.png": b"\x89PNG and some more bytes here",
    "a/noext": b"plain words without any marker at all",
    ".hidden.php": b"<?php eval($_GET['hidden one']);",
    "_under.php": b"<?php eval($_GET['under one']);",
    "__init__.py": b"import os, sys, subprocess",
    "_vendor/a.php": b"<?php echo 'vendor file text';",
    ".git/b.php": b"<?php echo 'file in a dot folder';",
    "glob[1]*/c.php": b"<?php echo 'odd folder name';",
}


LISTED = set(RAW)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for name, raw in RAW.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(raw)
    return root


def names(df, folder):
    return {r["path"].removeprefix(f"{folder}/") for r in df.select("path").collect()}


def test_recursive_and_flat_listing(spark, folder):
    every = names(SF.read_folder(spark, str(folder), None), folder)
    assert every == LISTED
    trained = names(SF.read_folder(spark, str(folder), SF.TRAIN_SUFFIXES), folder)
    assert trained == {n for n in LISTED if n.lower().endswith((".php", ".asp", ".js", ".txt", ".py"))}
    flat = names(SF.read_folder(spark, f"{folder}/a", SF.SCAN_SUFFIXES, recursive=False), folder)
    assert "a/deep/even.js" not in flat and "a/noext" in flat
    small = names(SF.read_folder(spark, str(folder), SF.SCAN_SUFFIXES, max_bytes=1000), folder)
    assert "a/big.php" not in small


def depot(folder):
    """Another store: everything in it lies below ``depot://box``."""
    base = str(folder)

    def opened(place):
        from pyarrow.fs import LocalFileSystem, SubTreeFileSystem

        return SubTreeFileSystem(base, LocalFileSystem()), place.removeprefix("depot://box").strip("/")

    return {"depot": opened}


def rows_below(df, root):
    return sorted((r["path"].removeprefix(root).strip("/"), r["ext"], r["size"], bytes(r["content"])) for r in df.collect())


def test_every_store_gives_the_same_rows(spark, folder):
    want = rows_below(SF.read_folder(spark, str(folder), None), str(folder))
    assert {name for name, *_ in want} == LISTED
    assert want == sorted((n, "." + n.rsplit(".", 1)[1].lower() if "." in n.rsplit("/", 1)[-1] else "", len(b), b) for n, b in RAW.items())
    assert rows_below(SF.read_folder(spark, f"file://{folder}/", None), str(folder)) == want
    openers = depot(folder)
    assert rows_below(SF.read_folder(spark, "depot://box", None, openers=openers), "depot://box") == want
    flat = SF.read_folder(spark, ["depot://box/a", "depot://box/glob[1]*"], (".php",), recursive=False, max_bytes=1000, openers=openers)
    assert {n for n, *_ in rows_below(flat, "depot://box")} == {"a/utf8.php", "a/bom16.PHP", "a/empty.php", "a/short.php", "glob[1]*/c.php"}
    texts = {r["path"]: r["code"] for r in SF.ngram_source(spark, "depot://box/a", openers=openers).collect()}
    assert texts["depot://box/a/utf8.php"] == TEXT and "depot://box/a/empty.php" not in texts


def test_what_a_store_cannot_list_or_read_is_marked(spark, folder):
    openers = depot(folder)
    gone = SF.list_files(spark, ["depot://box/none", "depot://box/a/deep"], openers=openers).collect()
    assert {(r["path"], r["size"]) for r in gone} == {("depot://box/none", -1), ("depot://box/a/deep/even.js", 30)}
    rows = spark.createDataFrame([("depot://box/a/short.php", 5), ("depot://box/gone.php", 5)], "path string, size long")
    read = {r["path"]: r["content"] for r in SF.read_files(rows, openers).collect()}
    assert bytes(read["depot://box/a/short.php"]) == b"<?php" and read["depot://box/gone.php"] is None


def test_large_folders_leave_a_task_in_pieces(spark, folder, monkeypatch):
    monkeypatch.setattr(SF, "_LISTED_AT_ONCE", 2)
    assert names(SF.list_files(spark, [str(folder)]), folder) == LISTED


@pytest.mark.parametrize("store", ["local", "depot"])
def test_files_are_written_and_exports_copied(spark, folder, tmp_path, store):
    root, openers = (f"{tmp_path}/out", None) if store == "local" else ("depot://box/out", depot(tmp_path))
    given = [("x/a b.txt", b"one"), (".h/_c", b""), ("100%/d", bytes(range(256))), ("e", None)]
    wrote = W.write_files(spark.createDataFrame(given, "name string, content binary"), root, openers)
    assert sorted((r["name"], r["path"], r["size"]) for r in wrote.collect()) == sorted((n, f"{root}/{n}", len(c or b"")) for n, c in given)
    assert {r[0]: r[3] for r in rows_below(SF.read_folder(spark, root, None, openers=openers), root)} == {n: c or b"" for n, c in given}
    judged = Z.scan(SF.scan_source(spark, str(folder)), stand_in_scores)
    done = W.copy_exports(judged, SF.read_folder(spark, str(folder), None), f"{root}/exports", openers).collect()
    kept = {r["file"]: r["verdict"] for r in Z.results(judged).collect()}
    assert len(done) == len(kept)
    back = rows_below(SF.read_folder(spark, f"{root}/exports", None, openers=openers), f"{root}/exports")
    assert sorted(c for *_, c in back) == sorted(RAW[p.removeprefix(f"{folder}/")] for p in kept)
    assert {n.split("/")[0] for n, *_ in back} == set(kept.values())


def test_unreadable_files_are_counted_as_errors(spark, folder):
    rows = spark.createDataFrame([(f"{folder}/a/utf8.php", 10), (f"{folder}/gone.php", 10), (f"{folder}/noaccess", -1)], "path string, size long")
    judged = Z.triage(Z.evidence(SF.with_code(SF.read_files(rows))), stand_in_scores)
    status = {r["path"].removeprefix(f"{folder}/"): r["status"] for r in judged.select("path", "status").collect()}
    assert status["gone.php"] == status["noaccess"] == "errors" and status["a/utf8.php"] in Z.VERDICTS


def test_counts_add_up_to_the_walk(spark, folder):
    judged = Z.scan(SF.scan_source(spark, str(folder)), stand_in_scores)
    row = R.coverage(judged).first()
    assert row["files"] == len(RAW) == row["scanned"] + row["skipped"] + row["skipped_by_ext"] + row["errors"]


def test_decoding(spark, folder):
    got = {r["path"].removeprefix(f"{folder}/"): r for r in SF.scan_source(spark, str(folder)).collect()}
    assert (got["a/utf8.php"]["code"], got["a/utf8.php"]["encoding"]) == (TEXT, "utf-8")
    assert (got["a/bom16.PHP"]["code"], got["a/bom16.PHP"]["encoding"]) == (TEXT, "utf-16")
    assert got["a/bom16.PHP"]["ext"] == ".php"
    assert got["a/odd.txt"]["encoding"] == "latin-1" and got["a/odd.txt"]["code"] == "é" * 31
    assert got["a/deep/even.js"]["encoding"] == "utf-16" and len(got["a/deep/even.js"]["code"]) == 15


def test_ngram_source(spark, folder):
    got = {r["path"].removeprefix(f"{folder}/"): r for r in SF.ngram_source(spark, str(folder)).collect()}
    assert "a/empty.php" not in got and "a/short.php" not in got and "a/noext" not in got
    # 30 bytes give 15 characters as UTF-16, too few, so the next encoding is tried.
    assert got["a/deep/even.js"]["encoding"] == "latin-1"


def test_labelled_source(spark, folder):
    df = SF.labelled_source(spark, f"{folder}/a/deep", f" {folder}/a/deep , {folder}/a/deep")
    assert {(r["label"], r["count"]) for r in df.groupBy("label").count().collect()} == {(0, 1), (1, 2)}


def test_surrogates_become_replacement_characters():
    assert SF.decode_for_scan(b"\xff\xfe\x00\xd8a\x00")[0] == "\ufffe\u00d8\u6100"
    assert "\ud800" not in SF.decode_for_scan(b"\x00\xd8" * 3)[0]


def test_scan_report_and_exports(spark, folder, tmp_path):
    judged = Z.scan(SF.scan_source(spark, str(folder)), stand_in_scores)
    status = {r["path"].removeprefix(f"{folder}/"): r["status"] for r in judged.select("path", "status").collect()}
    assert status["a/skip.png"] == "skipped_by_ext" and status["a/short.php"] == "skipped"
    assert status["a/utf8.php"] in Z.VERDICTS
    limits = S.thresholds()
    W.write_report(judged, limits, str(tmp_path / "report"))
    summary = spark.read.json(str(tmp_path / "report/summary")).first()
    assert summary["threshold"] == 0.55 and summary["stats"]["skipped_by_ext"] == 1
    rows = [json.loads(line) for p in sorted((tmp_path / "report/results").glob("part-*")) for line in p.open()]
    shares = [r["probability"] for r in rows]
    assert shares == sorted(shares, reverse=True) and set(rows[0]) <= set(Z.RESULT_COLUMNS)
    W.write_exports(judged, str(tmp_path / "exports"))
    assert spark.read.parquet(str(tmp_path / "exports")).count() == len(rows)


def test_scan_all_keeps_what_looks_like_code(spark, folder):
    judged = Z.scan(SF.scan_source(spark, str(folder)), stand_in_scores, scan_all=True)
    status = {r["path"].removeprefix(f"{folder}/"): r["status"] for r in judged.select("path", "status").collect()}
    assert status["a/odd.txt"] == "skipped_no_code" and status["a/noext"] in Z.VERDICTS
    assert status["a/skip.png"] in Z.VERDICTS


def test_metadata_and_importances(spark, tmp_path):
    scored = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.4), (0, 0.5)], "label int, score double")
    W.write_metadata(E.tree_thresholds(E.pr_points(scored)), str(tmp_path / "meta"), ("b", "a"), "1")
    meta = SF.read_metadata(spark, str(tmp_path / "meta"))
    assert SF.frozen_features(meta) == ("b", "a") and meta.first()["extractor_version"] == "1"
    assert len(SF.frozen_features(scored)) == 167
    table = spark.createDataFrame([("x", 1.0), ("y", 3.0)], "feature string, importance double")
    W.write_importances(table, str(tmp_path / "imp"))
    back = SF.read_importances(spark, str(tmp_path / "imp"))
    assert [r["feature"] for r in back.orderBy(F.desc("importance")).collect()] == ["y", "x"]


def test_code_probe(spark):
    from vigilrow.operators.gates import looks_like_code

    cases = [
        (b"\x00" * 3000 + b"<?php", True), (b"\x00" * 3000 + b"?", False), (b"\x00" * 2000 + b"<?php", True), (b"<?PHP" + b"\x00" * 50, False),
        (b"", False), (b"a" * 71 + b"\x00" * 29, True), (b"a" * 70 + b"\x00" * 30, False), (b"\t\r\n", True),
    ]
    df = spark.createDataFrame([(i, bytearray(c)) for i, (c, _) in enumerate(cases)], "i int, content binary")
    for r in df.select("i", looks_like_code(F.col("content")).alias("x")).collect():
        assert r["x"] == cases[r["i"]][1], r["i"]


def test_binary_and_text_rows_agree(spark):
    rows = files(spark, ("/a.txt", "plain words that are long enough"))
    assert Z.evidence(rows, True).first()["gate"] is None


def test_decoding_holds_few_texts_at_a_time(spark):
    raw = spark.range(0, 1000, 1, 1).select(F.col("id").alias("file_id"), F.encode(F.lit("text of some length"), "UTF-8").alias("content"))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        run = SF._decoded(raw, SF.decode_any)
        assert run.count() == 1000 and run.where("code <> 'text of some length'").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    whole = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["a"])
    parts = list(slices([whole, whole.slice(0, 0), whole.slice(0, 1)]))
    assert max(p.num_rows for p in parts) == ROWS_AT_ONCE and pa.Table.from_batches(parts).num_rows == 1001


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    import pyarrow.parquet as pq

    table = pa.table({"doc_id": range(4000), "text": [f"text {k} " * 20 for k in range(4000)]})
    pq.write_table(table, tmp_path / "one.parquet", row_group_size=4000, compression="none")
    pq.write_table(table, tmp_path / "many.parquet", row_group_size=100, compression="none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        for name, shuffled in (("one", True), ("many", False)):
            given = spark.read.parquet(str(tmp_path / f"{name}.parquet"))
            assert given.rdd.getNumPartitions() >= 4
            dealt = spread(given)
            rows = dealt.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
            assert sum(rows) == 4000 and max(rows) <= 2 * 4000 / 4
            assert dealt.exceptAll(given).isEmpty()
            assert (dealt is not given) == shuffled
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
