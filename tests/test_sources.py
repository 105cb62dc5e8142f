"""Files read, written and read again; logs; the stream."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sievework.sinks import records_as_bibtex, records_as_nbib, records_as_ris, write_csv, write_records, write_text_blocks
from sievework.sources.files import bib_entries, decode, detect, new_files, read_bibtex, read_delimited, read_files, read_nbib, read_records, read_ris
from sievework.sources.logs import RESULT_SCHEMA, append_results, read_events, read_log
from sievework.sources.tables import read_records_table
from sievework.operators.flow import event_numbers, fold_flow
from sievework.streaming.live import fold_batches, windowed_counts

RIS = "junk\nTY  - JOUR\nTI  - A first title\nAB  - Line one\ngoes on\nAU  - Doe, J\nAU  - Roe, R\nPY  - 2001/05\nDO  - https://doi.org/10.1000/AB\nER  - \nTY  - JOUR\nPY  - x\nER  - \n"
NBIB = "PMID- 12\nTI  - A long\n      title\nLID - 10.1000/q [doi]\nFAU - Poe, E\nDP  - 1999 Jan\n\nPMID- 13\nAB  - Text\n"
BIB = '@article{k1,\n title = {The {BIG} one},\n year = 2003,\n author = "A B and C D",\n keywords = {x; y}\n}\n@comment{z}\n@book{k2, title={Second}, abstract = {Has, commas} }\n'


@pytest.mark.parametrize(("name", "content", "kind"), [
    ("a.txt", RIS.encode(), "ris"), ("a.ris", NBIB.encode(), "nbib"), ("x", BIB.encode(), "bib"), ("t.csv", b"title,year\na,1\nb,2\n", "csv"),
    ("e", b"", "E102"), ("p.pdf", b"%PDF-1", "pdf"), ("b", b"ab\0c", "E101"), ("x.ris", b"hello", "ris"),
])
def test_detect(name, content, kind):
    assert detect(name, content)[0] == kind


def test_read_records(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(RIS.replace("\n", "\r\n").encode())
    (tmp_path / "b.nbib").write_text(NBIB)
    (tmp_path / "c.bib").write_text(BIB)
    r = {(x["source_format"], x["source_row"]): x for x in read_records(spark, str(tmp_path)).collect()}
    a = r["ris", 1]
    assert (a["title"], a["abstract"], a["authors"], a["year"], a["doi"]) == ("A first title", "Line one goes on", "Doe, J; Roe, R", 2001, "10.1000/ab")
    assert r["ris", 2]["exclusion_reason"] == "EMPTY_RECORD"
    assert (r["nbib", 1]["title"], r["nbib", 1]["doi"], r["nbib", 1]["pmid"], r["nbib", 1]["year"]) == ("A long title", "10.1000/q", "12", 1999)
    assert r["nbib", 2]["abstract"] == "Text"
    assert r["bib", 2]["record_type"] == "book" and r["bib", 1]["source_label"] == "c"
    assert (r["bib", 1]["title"], r["bib", 1]["authors"], r["bib", 1]["year"], r["bib", 1]["keywords"]) == ("The BIG one", "A B; C D", 2003, "x; y")
    assert r["bib", 2]["abstract"] == "Has, commas"
    files = read_files(spark, str(tmp_path))
    assert new_files(files, files.where("format = 'ris'").select("sha256")).count() == 2


def test_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ris").write_text(RIS)
    r = read_records(spark, str(tmp_path / "in")).where("source_row = 1").withColumn("pmid", F.lit("5"))
    for write, column in ((records_as_ris, "ris"), (records_as_nbib, "nbib"), (records_as_bibtex, "bibtex")):
        out = str(tmp_path / column)
        write_text_blocks(write(r), column, out)
        back = read_records(spark, f"{out}/*.txt").first()
        assert (back["title"], back["abstract"], back["doi"], back["year"]) == ("A first title", "Line one goes on", "10.1000/ab", 2001)


def texts(spark, fmt, *contents):
    return spark.createDataFrame([(f"f{i}", fmt, c) for i, c in enumerate(contents)], "source_file string, format string, text string")


def test_delimited(spark):
    table = 'Article Title;Publication-Year;PMID;;Notes;Notes\n"A; ""b""";2004;77.0;x;n1;n2\n; ;;;;\nC;n.d.;007;;;\nD;;;;;\n'
    a, c, _ = read_delimited(texts(spark, "csv", table)).orderBy("source_row").collect()
    assert (a["title"], a["year"], a["pmid"], a["source_row"]) == ('A; "b"', 2004, "77", 1)
    assert json.loads(a["extra_json"]) == {"col_col_4": ["x"], "col_Notes": ["n1"], "col_Notes_2": ["n2"]}
    assert (c["title"], c["year"], c["pmid"], c["source_row"]) == ("C", None, "007", 2)
    named = read_delimited(texts(spark, "csv", "x,y\n1,2\n"), columns={"title": "y"}).first()
    assert named["title"] == "2"
    for columns in (None, {"title": "z"}):
        with pytest.raises(Exception, match="E104"):
            read_delimited(texts(spark, "csv", "x,y\n1,2\n"), columns=columns).collect()


def test_ris_fields(spark):
    note = "long " * 60
    t = (
        "Export of today\n\nTY  - CPAPER\nT1  - Other\nTI  - A &amp; B\nAB  - one\nN2  - two\nAB  - one\nA1  - Z, Y\nAU  - D, J\nA2  - Ed, E\nJO  - Short\nJF  - Full\nVL  - 3\nIS  - 4\nSN  - 1234-5678\nSP  - 10\nEP  - 12\nDO  - not a doi\n"
        "UR  - file:///home/x\nUR  - https://x.org/1\nDA  - 2016///\nKW  - k\nKW  - k\nKW  - l\nN1  - short\nC5  - odd\n\ngoes on\nER  - \nstray line\n"
        f"TI  - No type\nN1  - {note}\nTY  - JOUR\nTI  - Open end\n"
    )
    a, b, c = read_ris(texts(spark, "ris", t, "TI  - no type at all\n")).orderBy("source_row").collect()
    assert [a[k] for k in ("record_type", "title", "abstract", "abstract_source", "authors", "editors", "journal", "volume", "issue", "issn_isbn", "pages", "doi", "url", "year", "keywords")] == [
        "conference_paper", "A & B", "one two", "AB", "D, J; Z, Y", "Ed, E", "Full", "3", "4", "1234-5678", "10-12", "", "https://x.org/1", 2016, "k; l"]
    more = json.loads(a["extra_json"])
    assert (more["doi_invalid"], more["ris_C5"], more["notes"], more["ris_UR"], more["ris_JO"], more["ris_T1"]) == (["not a doi"], ["odd goes on"], ["short"], ["file:///home/x"], ["Short"], ["Other"])
    assert (b["title"], b["abstract_source"], b["import_notes"]) == ("No type", "N1", "record without TY line; record not terminated by ER")
    assert (c["title"], c["import_notes"], c["exclusion_reason"]) == ("Open end", "record not terminated by ER", "")


def test_nbib_fields(spark):
    t = (
        "PMID- 1\nTI  - Retracted: a thing\n      goes on\nPT  - Journal Article\nPT  - Retracted Publication\nAID - S1 [pii]\nAID - 10.1000/z [DOI]\nFAU - A, B\nAU  - A B\nMH  - *Humans\nOT  - k\nLA  - eng\nJT  - J\nTA  - Jx\nDP  - 2020 Oct-Dec\nVI  - 7\nPMC - PMC1\n\n"
        "stray\nTI  - Blockless\n\nAB  - only\n\nFAU - no title\n\nPMID- 2\nTT  - Translated\n"
    )
    r = read_nbib(texts(spark, "nbib", t)).orderBy("source_row").collect()
    a = r[0]
    assert [a[k] for k in ("title", "record_type", "is_retracted", "doi", "authors", "keywords_mesh", "keywords", "journal", "year", "volume", "pmcid")] == ["Retracted: a thing goes on", "journal_article", True, "10.1000/z", "A, B", "*Humans", "k", "J", 2020, "7", "PMC1"]
    assert "retraction: Retracted Publication" in a["import_notes"] and json.loads(a["extra_json"])["nbib_AID"] == ["S1 [pii]"]
    assert [(x["title"], x["abstract"], x["source_row"]) for x in r[1:]] == [("Blockless", "", 2), ("", "only", 3), ("Translated", "", 4)]


def test_bibtex_fields(spark):
    t = (
        '@string{jx = "Journal of " # {X}}\n@ARTICLE{k,\n title = "A {Big {one}} \\& {"}x", author = {Doe, J and {World Health and Co} and Roe, R}, journal = jx # " Y", month = mar, year = {n.d.}, date = {2019-04}, pages = {1--9},\n keywords = {a; b, a}, file = {/home/x.pdf}, eprint = {e1}, doi = {10.1000/AA}\n}\n'
        "@misc(p2, title = {Round}, number = 5)\n@article{open, title = {Never closed, abstract = {x}\n@inproceedings{t, author = {NCT01234567}, journal = {https://clinicaltrials.gov/x}, title={T}}\n"
    )
    r = read_bibtex(texts(spark, "bib", t)).orderBy("source_row").collect()
    a = r[0]
    assert [a[k] for k in ("title", "authors", "journal", "year", "pages", "keywords", "doi", "record_type")] == ['A Big one & "x', "Doe, J; World Health and Co; Roe, R", "Journal of X Y", 2019, "1-9", "a; b", "10.1000/aa", "journal_article"]
    more = json.loads(a["extra_json"])
    assert more["bib_month"] == ["3"] and more["bib_eprint"] == ["e1"] and more["bib_key"] == ["k"] and "bib_file" not in more and "file field" in a["import_notes"]
    assert (r[1]["title"], r[1]["issue"]) == ("Round", "5")
    assert "unbalanced" in r[2]["import_notes"] and r[2]["title"].startswith("Never closed")
    assert (r[3]["record_type"], r[3]["authors"]) == ("trial_registry", "")


def test_bibtex_long_line_in_time(spark):
    began = time.time()
    assert len(list(bib_entries("@article{k, abstract = {" + "word {x} " * 22_000 + "}, year = 2000}"))) == 1
    assert time.time() - began < 2


def test_files_of_other_kinds_are_errors(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    with pytest.raises(Exception, match="E101"):
        read_records(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="E103"):
        decode(b"\xff\xfe\xfd", "ascii")


def test_records_table(spark, tmp_path):
    r = read_ris(texts(spark, "ris", 'TY  - JOUR\nTI  - A "quoted", title\nAB  - x\nPY  - 2001\nER  - \nTY  - JOUR\nER  - \n'))
    write_records(r, str(tmp_path / "r"))
    back = read_records_table(spark, str(tmp_path / "r"))
    assert back.columns == r.columns and sorted(map(tuple, back.collect())) == sorted(map(tuple, r.collect()))
    (tmp_path / "bad.csv").write_text("study_uid,title\na,b\n")
    with pytest.raises(ValueError, match="E404"):
        read_records_table(spark, str(tmp_path / "bad.csv"))


def test_csv_guard(spark, tmp_path):
    write_csv(spark.createDataFrame([("=1+1", 2)], "a string, b int"), str(tmp_path / "o"))
    assert "'=1+1,2" in "".join(f.read_text() for f in (tmp_path / "o").glob("*.csv"))


def test_logs(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"study_uid":"a","run_id":"r","status":"ok"}\n{"study_uid":"b","run_id":"r","status":"ok"}\n{"study_u')
    assert [x["study_uid"] for x in read_log(spark, str(tmp_path / "r.jsonl"), RESULT_SCHEMA).orderBy("line_no").collect()] == ["a", "b"]
    (tmp_path / "s.jsonl").write_text('{"study_uid":"a"}\n{bad\n{"study_uid":"b"}\n')
    with pytest.raises(Exception, match="E404"):
        read_log(spark, str(tmp_path / "s.jsonl"), RESULT_SCHEMA).collect()


def test_log_of_several_blocks(spark, tmp_path):
    lines = [json.dumps({"study_uid": f"u{i}", "run_id": "r", "status": "ok", "flags": ["f"], "tokens_in": i}) for i in range(3000)]
    (tmp_path / "r.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        d = read_log(spark, str(tmp_path / "r.jsonl"), RESULT_SCHEMA)
        assert spark.read.text(str(tmp_path / "r.jsonl")).rdd.getNumPartitions() > 5
        assert [x["study_uid"] for x in d.orderBy("line_no").collect()] == [f"u{i}" for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    append_results(d.select("study_uid", "run_id", "status").limit(2), str(tmp_path / "out"))
    append_results(d.select("study_uid", "run_id", "status").limit(3), str(tmp_path / "out"))
    assert read_log(spark, f"{tmp_path}/out/*.json", RESULT_SCHEMA).count() == 5
    (tmp_path / "e.jsonl").write_text('{"event_type":"SOURCE_IMPORTED","source_label":"A","payload":{"records_identified":4}}\n{"event_type":"INFO","payload":{"kind":"validity"}}\n')
    assert fold_flow(event_numbers(read_events(spark, str(tmp_path / "e.jsonl")))).first()["identified"] == 4


def test_stream_folds_like_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(path)
    src = tmp_path / "src"
    events.limit(300).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(events.schema).parquet(str(src))
    fold = lambda d: d.groupBy("event_type").agg(F.count("*").alias("n"))
    q = fold_batches(stream, fold, str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(fold(spark.read.parquet(str(src))).collect())
    src2 = tmp_path / "src2"
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(src2))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(src2))
    total = lambda d: d.groupBy("event_type").agg(F.sum("n").alias("n"))
    q = fold_batches(stream, fold, str(tmp_path / "log2"), str(tmp_path / "out2"), str(tmp_path / "cp2"), total)
    q.awaitTermination(60)
    assert len(list((tmp_path / "log2-folds").glob("batch=*"))) == 3
    assert sorted(spark.read.parquet(str(tmp_path / "out2")).collect()) == sorted(fold(events).collect())
    q = windowed_counts(spark.readStream.schema(events.schema).parquet(str(src))).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("hours").agg(F.sum("n")).first()[0] == 300


def test_tables_of_runs(spark, tmp_path):
    from sievework.operators.agreement import pairwise
    from sievework.sources.tables import full_outer_runs, read_legacy_runs, read_result_table

    for k, rows in (("01", "a;1\nb;0\nc;1\n"), ("02", "a;1\nb;1\nd;x\n")):
        (tmp_path / f"p_run-{k}.csv").write_text("study_uid;label\n" + rows)
    d = read_legacy_runs(spark, str(tmp_path))
    assert sorted(map(tuple, full_outer_runs(d, ["run-01", "run-02"]).collect())) == [("a", "INCLUDE", "INCLUDE"), ("b", "EXCLUDE", "INCLUDE"), ("c", "INCLUDE", None)]
    assert tuple(pairwise(d).first())[:4] == ("run-01", "run-02", 2, 0.5)
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.csv").write_text("study_uid,title,outcome,cost,consistent\nu,'=1,include,\"0,5\",ja\n")
    r = read_result_table(spark, str(tmp_path / "t/x.csv")).first()
    assert (r["title"], r["outcome"], r["cost"], r["consistent"]) == ("=1", "INCLUDE", 0.5, True)
    (tmp_path / "t/x.csv").write_text("outcome\nwhat\n")
    with pytest.raises(Exception, match="E203"):
        read_result_table(spark, str(tmp_path / "t/x.csv")).collect()
