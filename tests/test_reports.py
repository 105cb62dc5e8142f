"""Checks of files and projects, page cleaning, prices and guarded replacement."""

import pytest
from pyspark.sql import functions as F

from sievework.functions.text import token_count
from sievework.operators.costs import current_prices, token_estimate, token_sample
from sievework.operators.pages import clean_pages
from sievework.operators.report import check_files, check_project
from sievework.sinks import replace_records, table_digest
from sievework.sources.files import read_files, read_ris
from sievework.sources.logs import not_imported_before, read_import_log
from sievework.sources.prices import read_prices
from sievework.sources.ranges import read_chunks
from sievework.sources.tables import read_records_table

PROJECT = "source_label string, exclusion_reason string, abstract_quality string, has_abstract boolean, is_duplicate boolean, is_retracted boolean"


def test_files_before_an_import(spark):
    files = spark.createDataFrame([("a.ris", "ris"), ("b.ris", "ris"), ("c.ris", "ris"), ("d.pdf", "pdf"), ("e", None), ("f", "E101"), ("g.nbib", "nbib")], "source_file string, format string")
    records = spark.createDataFrame([("a.ris", "x"), ("b.ris", " "), ("b.ris", None), ("c.ris", "x"), ("c.ris", ""), ("other", "x")], "source_file string, abstract string")
    got = {r["source_file"]: (r["n"], r["n_abstract"], r["status"], r["issue"], r["error_code"]) for r in check_files(files, records).collect()}
    assert got == {
        "a.ris": (1, 1, "OK", "", None), "b.ris": (2, 0, "ERROR", "NO_ABSTRACTS", None), "c.ris": (2, 1, "WARNING", "LOW_ABSTRACT_RATIO", None), "d.pdf": (0, 0, "ERROR", "UNSUPPORTED_TYPE", "E101"),
        "e": (0, 0, "ERROR", "PARSE_FAILED", "E101"), "f": (0, 0, "ERROR", "PARSE_FAILED", "E101"), "g.nbib": (0, 0, "ERROR", "NO_RECORDS", "E102"),
    }
    assert check_files(files.limit(0), records).count() == 0


def test_a_ris_file_without_a_start_has_no_records(spark, tmp_path):
    (tmp_path / "x.ris").write_text("TI  - a\nAU  - b\nAB  - c\n")
    for files in (read_files(spark, str(tmp_path)), read_chunks(spark, str(tmp_path), 8, 8)):
        assert [r["error_code"] for r in check_files(files.select("source_file", "format").distinct(), read_ris(files)).collect()] == ["E102"]


@pytest.mark.parametrize(
    ("rows", "status", "issues"),
    [
        ([], "ERROR", ["NO_RECORDS"]),
        ([("a", "DUPLICATE", None, True, True, None)], "ERROR", ["NOTHING_TO_SCREEN"]),
        ([("a", "", "", True, False, False)], "OK", []),
        ([("a", None, "suspect_concat", False, None, True), (None, "RETRACTED", "", True, False, True)], "WARNING", ["LOW_ABSTRACT_RATIO", "SUSPECT_ABSTRACTS", "RETRACTED_INCLUDED"]),
    ],
)
def test_a_project_before_a_run(spark, rows, status, issues):
    got = check_project(spark.createDataFrame(rows, PROJECT)).collect()
    assert len(got) == 1 and (got[0]["status"], got[0]["issues"], got[0]["records"]) == (status, issues, len(rows))
    if len(rows) == 2:
        assert got[0]["by_reason"] == {"RETRACTED": 1} and got[0]["retracted_included"] == 1 and [s["source_label"] for s in got[0]["sources"]] == [None, "a"]


def test_pages_of_documents(spark):
    body = "words of a body " * 40
    rows = [
        ("x/some_file-name.pdf", 2, "HEAD\n two-\nfold and exam-"), ("x/some_file-name.pdf", 3, "HEAD\nple\n\n\n\nlast ﬁne line\nPage 3 / 4"), ("x/some_file-name.pdf", 1, "HEAD\n12\ndoi: 10.1/x\n" + body + "\nshort"),
        ("x/some_file-name.pdf", 4, "References\nGone 1999"), ("b.pdf", 1, "HEAD\n7\n"), ("b.pdf", 2, None), (None, 1, "A line of text"), ("c_d.pdf", 1, None),
    ]
    got = {r["doc"]: r for r in clean_pages(spark.createDataFrame(rows, "doc string, page int, text string")).collect()}
    x = got["x/some_file-name.pdf"]
    assert x["text"] == "doi: 10.1/x\n" + body.strip() + "\nshort\ntwofold and example\n\nlast fine line" and x["title"] == body.strip() and x["n_pages"] == 4
    assert (got["b.pdf"]["text"], got["b.pdf"]["title"]) == ("HEAD\n7", "b")  # of two pages nothing is a running head
    assert (got[None]["text"], got[None]["title"], got["c_d.pdf"]["title"], got["c_d.pdf"]["text"]) == ("A line of text", "A line of text", "c d", "")
    named = spark.createDataFrame([("d", 1, "text of a page", " A given title ")], "doc string, page int, text string, meta_title string")
    assert clean_pages(named).first()["title"] == "A given title" and clean_pages(named.limit(0)).count() == 0


def test_of_prices_to_come_the_first_line_counts(spark):
    rows = [("p", "m", 1.0, 1.0, "2031-01-01", 1), ("p", "m", 2.0, 2.0, "2030-01-01", 2), ("q", "m", 3.0, 1.0, "2030-01-01", 1), ("q", "m", 4.0, 1.0, None, 2), ("q", "m", 5.0, 1.0, "2020-01-01", 3), ("q", "m", 6.0, 1.0, "2020-01-01", 4)]
    got = {r["provider"]: r["price_in"] for r in current_prices(spark.createDataFrame(rows, "provider string, model string, price_in double, price_out double, valid_from string, line int"), "2025-01-01").collect()}
    assert got == {"p": 1.0, "q": 5.0}


def test_a_table_is_replaced_whole_and_backed_up(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ris").write_text("".join(f"TY  - JOUR\nTI  - title {i}\nAB  - text\nER  - \n" for i in range(9)))
    records = read_ris(read_files(spark, str(tmp_path / "in")))
    at, backups = str(tmp_path / "records"), tmp_path / "backups"
    assert replace_records(records, at, str(backups), keep=2) and list(backups.iterdir()) == []
    assert not replace_records(records.repartition(3), at, str(backups), keep=2)  # the same rows
    for k in range(4):
        assert replace_records(records.where(F.col("source_row") > k + 1), at, str(backups), keep=2)
    assert read_records_table(spark, at).count() == 5 and [p.name for p in sorted(backups.iterdir())] == ["records.00000003", "records.00000004"]
    assert read_records_table(spark, str(backups / "records.00000004")).count() == 6
    assert table_digest(records.limit(0)) == "0-0-0" and table_digest(records) != table_digest(records.union(records))


def test_sampled_tokens_lie_within_their_bound(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    full = texts.agg(F.sum(token_count(F.col("text")))).first()[0]
    off = []
    for seed in range(4):
        sample = token_sample(texts.withColumn("key", F.concat(F.lit(f"{seed}-"), F.col("doc_id").cast("string"))), "key", "text", rate=0.05, least=30)
        est = token_estimate(sample).first()
        assert est["n"] == 1000 and est["m"] < 500 and est["bound"] < 0.2 * full
        off.append(abs(est["total"] - full) <= est["bound"])
    assert all(off)
    halves = [token_sample(texts.where(F.col("doc_id") % 2 == k), "doc_id", "text", rate=0.2) for k in (0, 1)]
    merged = token_estimate(halves[0].union(halves[1])).first()  # rows of two tables, put together
    assert merged["n"] == 1000 and abs(merged["total"] - full) <= max(merged["bound"], 1)
    whole = token_estimate(token_sample(texts, "doc_id", "text", rate=1.0)).first()
    assert (whole["total"], whole["bound"], whole["m"]) == (full, 0, 1000)
    none = token_estimate(token_sample(texts.limit(0), "doc_id", "text")).first()
    assert (none["n"], none["m"], none["total"]) == (0, 0, 0)
    assert token_estimate(spark.createDataFrame([(3, 9, 1, 4, 16)], "stratum int, n long, m long, s long, q long")).first()["bound"] is None


def test_price_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Provider; MODEL ;price_input_per_1k;price_output_per_1k;valid_from\nOpenX;M1;0,5;1,5;2024-01-01\nopenx ; m1;0.7;x;2024-02-01\nopenx;m1;-1;2;\n;m2;1;1;\nopenx;m2;inf;1;\nopenx;"m;3";0;0.25;\n')
    got = [tuple(r) for r in read_prices(spark, str(tmp_path / "a.csv")).drop("line").collect()]
    assert got == [("openx", "m1", 0.5, 1.5, "USD", "2024-01-01"), ("openx", "m;3", 0.0, 0.25, "USD", "")]
    (tmp_path / "b.csv").write_text("provider,model,price_input_per_1k,currency,price_output_per_1k\np,m,1,eur,2\np,m,3,,4\n")
    priced = current_prices(read_prices(spark, str(tmp_path / "b.csv")), "2025-01-01").first()
    assert (priced["price_in"], priced["price_out"]) == (1.0, 2.0)
    for text in ("provider;model\n", ""):
        (tmp_path / "c.csv").write_text(text)
        with pytest.raises(ValueError, match="E203: missing columns"):
            read_prices(spark, str(tmp_path / "c.csv"))


def test_a_file_is_imported_once(spark, tmp_path):
    log = tmp_path / "imports.jsonl"
    files = spark.createDataFrame([("a.ris", "s1"), ("b.ris", "s2"), ("c.ris", None)], "source_file string, sha256 string")
    assert not_imported_before(files, read_import_log(spark, str(log))).count() == 3
    log.write_text('{"timestamp":"t1","source_file":"x","sha256":"s9","source_label":"L"}\n{"timestamp":"t2","source_file":"old.ris","sha256":"s2","source_label":"L"}\n{"timestamp":"t3","source_file":"again.ris","sha256":"s2","source_label":"M"}\n{"torn')
    entries = read_import_log(spark, str(log))
    with pytest.raises(Exception, match=r"E106: imported before, at t3 as again.ris \(M\)"):
        not_imported_before(files, entries).collect()
    assert not_imported_before(files, entries, force=True).count() == 3 and not_imported_before(files.where("sha256 = 's1'"), entries).count() == 1
