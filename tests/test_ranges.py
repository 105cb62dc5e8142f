"""Splittable readers against whole files, and the growing log as a stream against the batch scan, at any cut."""

import json
import random

import pytest

from sievework.sources.files import read_bibtex, read_files, read_nbib, read_ris
from sievework.sources.logs import RESULT_SCHEMA, read_log
from sievework.sources.ranges import listed, read_chunks, stream_log


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(1)
    at = tmp_path_factory.mktemp("files")
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "Gämma", "a@b", "x{y}"]) for _ in range(n))
    ris, nbib, bib = ["T1  - before any\n"], ["AU  - before\n\n"], ['@string{jj = "Journal of Things"}\n']
    for i in range(24):
        ris.append(f"TY  - JOUR\r\nTI  - {say(4)}\r\nAB  - {say(9)}\r\n  goes on TY  - not a start\r\nPY  - {1990 + i % 30}\r\n{'ER  - ' if i % 7 else ''}\r\n")
        nbib.append(f"PMID- {i}\nTI  - {say(5)}\n      {say(3)}\nDP  - 2001 Jan\n\n{'TI  - without number' + chr(10) + chr(10) if i % 9 == 0 else ''}")
        bib.append(f"@article{{k{i},\n  title = {{{say(4)}}},\n  journal = jj,\n  abstract = {{{say(6)}\n@ not an entry\n{say(3)}}},\n year = {1990 + i % 9}}}\n{'@STRING{jj = {Other}}' + chr(10) if i == 12 else ''}")
    for name, text in (("a.ris", ris), ("b.nbib", nbib), ("c.bib", bib)):
        (at / name).write_text("".join(text), newline="")
    (at / "d.ris").write_bytes("TY  - JOUR\nTI  - a\nER  - \nTY  - JOUR\nTI  - caf\xe9 \x93q\x94\nER  - \n".encode("latin-1"))
    (at / "e.ris").write_bytes("﻿TY  - JOUR\nTI  - wide é\nER  - \n".encode("utf-16-le"))
    (at / "f.csv").write_text("title,year\na,1\nb,2\n")
    (at / "_hidden.ris").write_text("TY  - JOUR\n")
    return str(at)


@pytest.mark.parametrize("ranges", [(1 << 20, 1 << 20), (700, 300), (97, 1)])
def test_byte_ranges_give_the_records_of_whole_files(spark, folder, ranges):
    whole, parts = read_files(spark, folder).where("source_file NOT LIKE '\\_%'"), read_chunks(spark, folder, *ranges).cache()
    for read, least in ((read_ris, 26), (read_nbib, 24), (read_bibtex, 24)):
        want = rows(read(whole))
        assert len(want) >= least and rows(read(parts)) == want
    assert (parts.where("source_file = 'a.ris'").count() > 1) == (ranges[0] < 1 << 20)
    parts.unpersist()


def test_listed_names(folder):
    assert [p.rsplit("/", 1)[-1] for p, _ in listed(folder)] == ["a.ris", "b.nbib", "c.bib", "d.ris", "e.ris", "f.csv"]
    assert [p for p, _ in listed(f"file://{folder}/*.ris")] == [f"file://{folder}/{n}.ris" for n in "ade"]
    assert listed(f"{folder}/none") == [] and len(listed(f"{folder}/a.ris")) == 1


def test_a_growing_log_streams_the_rows_of_its_whole_lines(spark, tmp_path):
    rng = random.Random(2)
    logs = tmp_path / "logs"
    logs.mkdir()
    lines = [json.dumps({"study_uid": f"u{i}", "run_id": "r", "status": "ok", "reasoning": "é" * rng.randint(0, 40), "cost": i / 7}, ensure_ascii=False) for i in range(60)]
    data = ("\n".join(lines[:20]) + "\n\n" + "\n".join(lines[20:]) + "\n").encode()
    cuts = sorted(rng.sample(range(1, len(data)), 4)) + [len(data)]
    done, seen = 0, 0
    for cut in cuts:
        with (logs / "one.jsonl").open("ab") as f:
            f.write(data[done:cut])
        done = cut
        stream_log(spark, str(logs), RESULT_SCHEMA, range_bytes=rng.choice([50, 1 << 20])).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out")).drop("position", "source_file")
        torn = data[:cut].rpartition(b"\n")[0] + b"\n"
        (tmp_path / f"whole-{cut}.jsonl").write_bytes(torn)
        want = read_log(spark, str(tmp_path / f"whole-{cut}.jsonl"), RESULT_SCHEMA).drop("line_no", "source_file")
        assert rows(got) == rows(want) and got.count() >= seen
        seen = got.count()
    assert seen == 60
    with (logs / "one.jsonl").open("ab") as f:
        f.write(b"{bad}\n")
    with pytest.raises(Exception, match="E404"):
        stream_log(spark, str(logs), RESULT_SCHEMA).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination()
