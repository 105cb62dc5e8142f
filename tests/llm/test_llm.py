"""Operators for training text against brute force on small fixtures, and their defined results for odd rows."""

import collections
import hashlib
import math
import pickle
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import byte_bpe, decontaminate, language_id, license_scan, lm_scoring, near_dedup, near_join, paragraph_dedup, quality_rules, registry, token_counts, token_tables, wordscan
from sievework.llm.session import fresh_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, no words, repeated rows and ids, a very long text."""
    long = " ".join(f"w{i % 9000}" for i in range(60_000))
    data = [(1, None, None, None, None), (2, "", "en", None, 0), (3, " \n\t ", None, "s", 3), (None, "some words in a row here", "en", "s", 1), (4, "same text of six words here", "en", "s", 1), (4, "same text of six words here", "en", "s", 1), (4, "another text of the same id", "de", "s", 1), (5, long, "en", "s", 1), (6, "x", "en", "t", 1), (7, "中文 \U0001f600", "zh", "t", 1), (8, "....", "en", "t", 1)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# -- words


def test_scan_finds_the_words_of_each_text():
    random.seed(1)
    texts = ["".join(random.choice("aB \n\t\x0b\x0c\r.é") for _ in range(random.randint(0, 30))) for _ in range(300)] + [None, ""]
    for table, words in ((wordscan.SPACED, lambda t: t.encode().lower().split()), (wordscan.ALNUM, lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", t.encode().lower()))):
        for i, n, data, offsets in wordscan.text_slices(pa.array(texts), 200):
            s = wordscan.scan(data, offsets, table)
            got = [[] for _ in range(n)]
            for d, a, b in zip(s.doc, s.start, s.end, strict=True):
                got[d].append(s.data[a:b].tobytes())
            assert got == [words(t or "") for t in texts[i : i + n]]
            h = s.hashes()
            assert len(set(h.tolist())) == len({x for g in got for x in g})


# -- 1 language


def test_language_id_on_held_out_documents(spark, docs):
    got = by_id(registry.QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01"))
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert set(got) == set(lang)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in got if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == lang[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_of_odd_rows(docs, odd, none):
    model = language_id.fit_on(docs)
    got = by_id(language_id.identify(odd, model))
    for i in (1, 2, 3, 8):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[6]["lang_pred"] in model.langs and got[7]["rejected"]
    assert language_id.identify(odd, model).count() == odd.count() and got[None]["lang_pred"] in model.langs
    assert language_id.identify(none, model).count() == 0
    empty = language_id.fit_on(none)
    assert {r["lang_pred"] for r in language_id.identify(docs, empty).collect()} == {"und"}
    assert language_id.identified(docs).count() > 0.95 * docs.count()


def test_language_id_rejects_unlearned_scripts_and_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit_on(docs)
    rng = random.Random(5)
    alphabets = ["абвгдежзийклмнопрстуфхцчшщыьэюя", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", [chr(c) for c in range(0x4E00, 0x5800)], "αβγδεζηθικλμνξοπρστυφχψω", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"]
    junk = [" ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 9))) for _ in range(n)) for a in alphabets for n in (100, 2000)]
    got = language_id.identify(spark.createDataFrame(list(enumerate(junk)), "doc_id long, text string"), model).collect()
    assert [r["doc_id"] for r in got if not r["rejected"]] == []
    held = language_id.identify(docs.where(language_id.held_out()), model)
    assert held.where("NOT rejected").count() >= 0.98 * held.count()


def test_language_id_by_brute_force(spark, docs, rows):
    """Vectors, cosines and the nearest centroid of each text, n-gram by n-gram."""
    model = language_id.fit_on(docs)
    full = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    def vector(text):
        data = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in text.encode()]
        tf = collections.Counter()
        for k in language_id.NGRAMS:
            for i in range(len(data) - k + 1):
                gram = data[i : i + k]
                if gram[0] != 32 or gram[-1] != 32:
                    code = 0
                    for b in gram:
                        code = (code * 257 + b) & full
                    tf[mixed(code + (k << 40) & full) % language_id.BUCKETS] += 1
        v = {b: (1 + math.log(n)) * float(model.idf[b]) for b, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {b: x / norm for b, x in v.items()}

    assert all(math.isclose(float(np.linalg.norm(r)), 1, rel_tol=1e-4) for r in model.rows) and max(map(model.langs.count, model.langs)) > 1
    got = by_id(language_id.identify(docs, model))
    for i in sorted(rows)[:40]:
        if rows[i] and re.search(r"[^\W\d_]", rows[i]):
            v = vector(rows[i])
            close = [sum(x * float(r[b]) for b, x in v.items()) for r in model.rows]
            best = max(range(len(close)), key=close.__getitem__)
            assert got[i]["lang_pred"] == model.langs[best] and math.isclose(got[i]["score"], close[best], rel_tol=1e-3)
            size = min(max(len(rows[i].encode()).bit_length() - 1, language_id.SHORTEST), language_id.LONGEST) - language_id.SHORTEST
            if abs(1 - close[best] - model.reach[best][size]) > 1e-3:
                assert got[i]["rejected"] == (1 - close[best] > model.reach[best][size])


def test_language_id_ties_and_many_languages(spark):
    row = np.zeros(language_id.BUCKETS, dtype=np.float32)
    row[:] = 1 / math.sqrt(language_id.BUCKETS)
    tied = language_id.Centroids(np.stack([row, row]), ["aa", "bb"], np.ones((2, language_id.LONGEST - language_id.SHORTEST + 1)), np.ones(language_id.BUCKETS, dtype=np.float32))
    d = spark.createDataFrame([(1, "some text", "x")], "doc_id long, text string, score string")
    got = language_id.identify(d, tied).first()
    assert got["lang_pred"] == "aa" and 0 < got["score"] < 1 and len(got) == 5  # of equal ones the first; a column of the same name is replaced
    many = spark.range(30_000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id % 15000) AS lang")
    sample = language_id.sample_texts(many)
    assert 0.7 * language_id.SAMPLE_TOTAL < sum(map(len, sample.values())) < 1.3 * language_id.SAMPLE_TOTAL


# -- 2 and 4 duplicates


def bag(text):
    w = text.encode().lower().split()
    return collections.Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else collections.Counter()


def alike(a, b):
    c = sum((a & b).values())
    return 10 * c >= 8 * (sum(a.values()) + sum(b.values()) - c)


def test_near_duplicates_by_brute_force(spark, rows):
    random.seed(3)
    extra, n = {}, 10_000
    for i in list(rows)[:25]:  # near copies of several degrees
        for k in (1, 2, 4, 9):
            w = rows[i].split(" ")
            for _ in range(k):
                w[random.randrange(len(w))] = f"edit{random.random()}"
            extra[n] = " ".join(w)
            n += 1
    texts = rows | extra
    got = by_id(near_dedup.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    parent = {i: i for i in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    bags = {i: bag(t) for i, t in texts.items()}
    size = {i: sum(b.values()) for i, b in bags.items()}
    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if bags[a] and bags[b] and min(size[a], size[b]) * 10 >= 8 * max(size[a], size[b]) and alike(bags[a], bags[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    assert {i: got[i]["class_id"] for i in ids} == {i: find(i) for i in ids}
    assert sum(r["keep"] for r in got.values()) == len({find(i) for i in ids})


def test_bag_minhash_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    e = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    w1, w2 = rng.integers(1, 20, 300), rng.integers(1, 20, 300)
    sig = near_dedup.bag_minhash(np.concatenate([e, e]), np.concatenate([w1, w2]), np.repeat([0, 1], 300), 3, 2000)
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.05
    assert np.isinf(sig[2]).all()


def test_near_duplicates_of_odd_rows(odd, none):
    got = near_dedup.near_duplicate_classes(odd).collect()
    assert len(got) == odd.count()
    assert sorted(r["class_size"] for r in got if r["doc_id"] == 4) == [1, 2, 2]
    assert all(r["class_id"] == r["doc_id"] and r["class_size"] == 1 for r in got if r["doc_id"] != 4)
    assert near_dedup.near_duplicate_classes(none).count() == 0
    assert near_dedup.keep_one_of_each(odd).count() == odd.count()


def classes_by_brute_force(bags, tenths=8):
    """The least key of each component of links between multisets."""
    parent = {i: i for i in bags}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    size = {i: sum(b.values()) for i, b in bags.items()}
    ids = sorted(bags)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if min(size[a], size[b]) * 10 >= tenths * max(size[a], size[b]) and alike(bags[a], bags[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_rare_elements_lose_no_link(spark, monkeypatch):
    """Nodes of one bucket with a common core: the same components whether they meet by pairs or by rare elements."""
    rng = random.Random(8)
    for paired, pairs in ((1, 10_000), (64, 10_000), (1000, 50)):
        monkeypatch.setattr(near_join, "PAIRED", paired)
        monkeypatch.setattr(near_join, "PAIRS", pairs)
        core = list(range(40))
        sets = {}
        for i in range(120):
            if i % 3 and i > 3:  # a change of another node
                own = set(sets[rng.randrange(i)])
                for x in rng.sample(sorted(own), rng.randrange(1, 8)):
                    own.remove(x)
                own |= {1000 + rng.randrange(400) for _ in range(rng.randrange(6))}
            else:
                own = set(rng.sample(core, 36)) | {1000 + rng.randrange(400) for _ in range(rng.randrange(4, 20))}
            sets[i] = sorted(own)
        want = classes_by_brute_force({i: collections.Counter(s) for i, s in sets.items()})
        details = spark.createDataFrame([(i, s, [5]) for i, s in sets.items()], "node long, elements array<long>, buckets array<long>")
        shared = spark.createDataFrame([(5, i) for i in sets], "bucket long, node long")
        got = {r["node"]: r["label"] for r in near_join.similarity_classes(shared, lambda n: details.join(n, "node", "left_semi"), 8).collect()}  # noqa: B023
        assert {i: got.get(i, i) for i in sets} == want
        assert 10 < len(set(want.values())) < 110


def test_look_alikes_make_no_square(spark):
    n = 50_000
    shared = spark.range(n).selectExpr("1L AS bucket", "id AS node")
    details = spark.range(n).selectExpr("id AS node", "concat(sequence(1L, 80L), transform(sequence(1L, 20L), i -> 1000 + id * 20 + i)) AS elements", "array(1L) AS buckets")
    assert near_join.similarity_classes(shared, lambda _: details, 8).count() == 0


def test_paragraph_classes_by_brute_force(spark):
    """Paragraphs of 8 words or more against all pairs: which of a document's paragraphs an earlier document has, by components."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(300)}"
    lines = [[word() for _ in range(rng.choice([4, 8, 9, 12, 20, 30]))] for _ in range(25)]
    texts = {}
    for i in range(60):
        own = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(lines))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line.insert(rng.choice([0, len(line), rng.randrange(len(line))]), word())
            own.append(" ".join(line))
        texts[i] = "\n".join(own)
    texts[60], texts[61] = "alpha beta gamma delta epsilon zeta eta theta", "prefix alpha beta gamma delta epsilon zeta eta theta"
    bags = {line: bag(line) for t in texts.values() for line in t.split("\n")}
    label = classes_by_brute_force(bags)
    first = {}
    for i, t in sorted(texts.items()):
        for line in t.split("\n"):
            first.setdefault(label[line], i)
    want = {i: sum(first[label[line]] < i for line in t.split("\n")) for i, t in texts.items()}
    got = by_id(paragraph_dedup.remove_repeated_paragraphs(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), run_words=8))
    assert {i: r["n_repeated"] for i, r in got.items()} == want
    assert want[61] == 1 and sum(map(bool, want.values())) > 20


def test_passages_are_removed_from_later_documents(spark, rows):
    words = [w for t in rows.values() for w in t.split() if w.isalpha()]
    random.seed(4)
    say = lambda n: " ".join(" ".join(random.choice(words).lower() for _ in range(random.randint(8, 14))).capitalize() + "." for _ in range(n))
    passage, common = say(9), say(1)
    texts = [(i, f"{say(6)} {passage} {say(4)}\n{say(3)} {common}" if i % 3 else f"{say(9)} {common}") for i in range(30)]
    got = by_id(paragraph_dedup.remove_repeated_paragraphs(spark.createDataFrame(texts, "doc_id long, text string")))
    for i, t in texts:
        has = sum(s in got[i]["text"] for s in re.findall(r"[^.]+\.", passage))
        if i % 3 == 0 or i == 1:  # clean, but for one common sentence; and the first with the passage
            assert got[i]["text"] == t and got[i]["n_removed"] == 0
        else:
            assert has <= 1 and got[i]["n_removed"] >= 50
            assert common in got[i]["text"]


def test_repeated_windows_by_brute_force(spark):
    rng = random.Random(11)
    texts = {}
    for i in range(60):
        sentences, k = [], 0
        while k < 220:
            n = rng.randint(2, 6)
            sentences.append(" ".join(f"w{i}x{k + j}" for j in range(n)) + rng.choice([".", ". ", ".\n", "!"]))
            k += n
        texts[i] = " ".join(sentences)
    for i in range(20, 60):  # passages of 49 to 90 words that begin and end anywhere
        own, other = texts[i].split(), texts[rng.randrange(i)].split()
        n, at = rng.choice([49, 50, 51, 60, 90]), rng.randrange(100)
        cut = rng.randrange(len(own))
        texts[i] = " ".join([*own[:cut], *other[at : at + n], *own[cut:]])
    seen, repeated = {}, {}
    for i in range(60):
        w = texts[i].lower().split()
        runs = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        repeated[i] = {k for j, r in enumerate(runs) if r in seen for k in range(j, j + 50)}
        for r in runs:
            seen[r] = i
    assert sum(map(bool, repeated.values())) >= 20
    got = by_id(paragraph_dedup.remove_repeated_paragraphs(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    for i, t in texts.items():
        w = t.split()
        left = set(got[i]["text"].split())
        assert not left & {w[k] for k in repeated[i]}
        if i < 20:
            assert got[i]["text"] == t
        assert len({x for x in w if x.startswith(f"w{i}x")} - left) <= 8


def test_paragraphs_of_odd_rows(odd, none):
    got = paragraph_dedup.remove_repeated_paragraphs(odd).collect()
    assert sorted(map(str, (r["text"] for r in got))) == sorted(map(str, (r["text"] for r in odd.collect())))
    assert all(r["n_removed"] == 0 for r in got)
    assert paragraph_dedup.remove_repeated_paragraphs(none).count() == 0
    assert paragraph_dedup.without_repeated_passages(odd).columns == odd.columns


# -- 3, 5 and 9 by SQL


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = df.columns
    want = con.sql(registry.SQL[name])
    order = [want.columns.index(c) for c in cols]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_quality_of_odd_rows(odd, none):
    got = quality_rules.judged(odd).collect()
    assert len(got) == odd.count()
    assert {r["n_words"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert all(r["base_failed"] and not r["kept"] for r in got if r["doc_id"] != 5)
    long = next(r for r in got if r["doc_id"] == 5)
    assert (long["n_words"], long["n_repeat_words"]) == (60_000, 60_000)
    assert quality_rules.judged(none).count() == 0


def test_fences_follow_the_groups_own_tails(spark):
    """Two sources of one language with unlike shares of symbols: the same text is kept in one and goes in the other."""
    text = lambda k, m: " ".join(f"w{k:04d}x{j:02d}" + ("#" if j < m else "") for j in range(60))
    rows = [(k, text(k, 0 if k < 2000 else k % 12), "en", "plain" if k < 2000 else "code", 0) for k in range(4000)]
    rows += [(9000, text(9000, 11), "en", "plain", 0), (9001, text(9001, 11), "en", "code", 0), (9002, text(9002, 60), "en", "plain", 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = by_id(quality_rules.judged(d))
    assert not got[9000]["kept"] and got[9001]["kept"] and not got[9002]["kept"]
    assert all(got[k]["kept"] for k in range(0, 4000, 37))
    m = quality_rules._metrics(quality_rules.text_figures(d)).where("source IS NOT NULL")
    f = {r["source"]: r["at_most"] for r in quality_rules.fences(m).where("metric = 'm_symbols'").collect()}
    assert f["plain"] + 50 < f["code"]


def test_figures_keep_columns_of_any_name(spark, docs):
    names = ["_hashes", "_lines", "_ordered", "_places", "__hashes", "_Units", "_grams", "_hits", "n_words", "licenses"]
    d = docs.limit(5)
    for n in names:
        d = d.withColumn(n, F.lit("own"))
    for out in (quality_rules.text_figures(d), license_scan.scan_licenses(d)):
        assert all(r[n] == "own" for r in out.collect() for n in names[:8])


def test_sketches_merge(spark):
    d = spark.range(1000).selectExpr("IF(id % 3 = 0, 'a', 'b') AS source", *(f"id % {k} AS {m}" for k, m in zip((7, 50, 300, 2), quality_rules.METRICS, strict=True)))
    fine = quality_rules.sketches(d, "source")
    assert sorted(quality_rules.sketches(fine).collect()) == sorted(quality_rules.sketches(d).collect())


def test_licenses_of_odd_rows(spark, odd, none):
    got = license_scan.scan_licenses(odd).collect()
    assert all((r["licenses"], r["best_license"], r["best_dice"]) == ([], None, 0.0) for r in got)
    assert license_scan.scan_licenses(none).count() == 0
    texts = ["Hello. Licensed under the MIT License! Bye", "All rights reserved", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0", "the license of others is another matter"]
    r = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x["best_license"] for x in r] == ["MIT", "all-rights-reserved", "Apache-2.0", None]


def test_whole_licences_however_they_are_wrapped(spark):
    import textwrap

    of = {"MIT": license_scan.TEMPLATES["MIT"][2], "GPL-3.0": license_scan.TEMPLATES["GPL-3.0"][1], "BSD-2-Clause": license_scan.TEMPLATES["BSD-2-Clause"][1], "Apache-2.0": license_scan.TEMPLATES["Apache-2.0"][1]}
    rows, want = [], []
    for name, text in of.items():
        for width, mark in ((70, ""), (60, "# "), (64, " * ")):
            wrapped = "\n".join(mark + line for block in text.split("\n\n") for line in [*textwrap.wrap(block, width), ""])
            rows += [(len(rows), f"Some prose before it.\n\n{wrapped}\n\nAnd some more prose behind it, of no interest."), (len(rows) + 1, f"prose first {wrapped.split(chr(10), 4)[0]}")]
            want += [name, None]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(license_scan.scan_licenses(d))
    assert all(name is None or name in got[i]["licenses"] for i, name in enumerate(want))
    assert all(got[i]["n_matches"] >= 3 for i, name in enumerate(want) if name)
    assert sorted(map(tuple, license_scan.scan_licenses(d, anchored=False).collect())) == sorted(map(tuple, got.values()))


def brute_hits(text, items, window):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = low(text), set(), set()
    for i, t in items:
        x = low(t)
        m = min(window, len(x))
        for j in range(len(x) - m + 1 if x else 0):
            for k in range(len(w) - m + 1):
                if w[k : k + m] == x[j : j + m]:
                    found.add(i)
                    hit |= set(range(k, k + m))
    return len(w), len(hit), found


def test_scans_travel_without_their_lanes():
    data = np.frombuffer(b"some words " * 1000, dtype=np.uint8)
    s = wordscan.scan(data, np.array([0, len(data)]), wordscan.ALNUM)
    bare, h = len(pickle.dumps(s)), s.hashes()
    assert len(pickle.dumps(s)) == bare and (pickle.loads(pickle.dumps(s)).hashes() == h).all()


def test_automaton_by_brute_force():
    random.seed(2)
    for r in range(300):
        letters = "ab" if r % 2 else "abcde"
        window = random.choice([2, 3, 4, 10])
        items = [(str(i), " ".join(random.choice(letters) for _ in range(random.randint(0, 14)))) for i in range(random.randint(0, 5))]
        text = " ".join(random.choice(letters + "Z") for _ in range(60))
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        s = wordscan.scan(data, np.array([0, len(data)]), wordscan.ALNUM)
        automaton, out = decontaminate.ItemAutomaton(items, window), {}
        automaton.match(automaton.places(s, s.hashes()), s.doc, out)
        got = out.get(0, decontaminate.Found([], set(), 0))
        n, hits, want = brute_hits(text, items, window)
        assert (sum(b - a for a, b in got.spans), got.items) == (hits, want)


def test_decontamination(spark, docs, odd, none, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = decontaminate.decontaminated(docs, bench)
    assert decontaminate.contamination(clean, bench).where("n_hit > 0").count() == 0
    assert clean.columns == docs.columns
    one = sorted(map(tuple, decontaminate.contamination(docs, bench).select("doc_id", "n_hit", "items").collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    kind, given = decontaminate.matcher_of(bench)
    matcher = kind(*given)
    assert kind is decontaminate.Several and len(set(np.concatenate([b for _, b in matcher.parts]).tolist())) > 5
    assert sorted(map(tuple, decontaminate.contamination(docs, bench).select("doc_id", "n_hit", "items").collect())) == one
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(decontaminate.decontaminated(docs, bench)) == key(clean)
    got = decontaminate.contamination(odd, bench).collect()
    assert len(got) == odd.count() and all(r["n_hit"] == 0 for r in got)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(odd, empty).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(none, bench).count() == 0
    short = spark.createDataFrame([(1, "two words"), (None, "in a row"), (2, None)], "item_id long, text string")
    d = spark.createDataFrame([(1, "Two, words in a row. two"), (2, None)], "doc_id long, text string")
    got = by_id(decontaminate.contamination(d, short, clean=True))
    assert (got[1]["n_hit"], got[1]["items"], got[1]["cleaned"]) == (5, ["1"], ". two")


def layers_by_hand(words, items, window):
    """What is left of words when all hits go, again and again."""
    runs = {tuple(x[i : i + min(window, len(x))]) for x in items if x for i in range(max(1, len(x) - window + 1))}
    while True:
        hit = {p for r in runs for i in range(len(words) - len(r) + 1) if tuple(words[i : i + len(r)]) == r for p in range(i, i + len(r))}
        if not hit:
            return words
        words = [w for i, w in enumerate(words) if i not in hit]


def cleaned_text(matcher, text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    offsets = np.array([0, len(data)])
    s = wordscan.scan(data, offsets, wordscan.ALNUM)
    found = matcher.finder(s, s.hashes())(np.arange(len(s.start)), s.doc)
    return decontaminate.cleaned(matcher, s, s.hashes(), data, offsets, found).get(0, text.encode()).decode()


def test_nested_hits_go_layer_by_layer(spark, monkeypatch):
    random.seed(6)
    for r in range(200):
        items = [[random.choice("abc") for _ in range(random.randint(2, 13))] for _ in range(3)]
        words = [random.choice("abcd") for _ in range(5)]
        for _ in range(random.randint(0, 12)):  # put an item, or a part of it, into the middle of what is there
            i, x = random.randint(0, len(words)), random.choice(items)
            words[i:i] = x[random.randint(0, 1) :]
        matcher = decontaminate.Only([(str(i), " ".join(x)) for i, x in enumerate(items)])
        assert cleaned_text(matcher, ". ".join(words)).replace(".", " ").split() == layers_by_hand(words, items, decontaminate.WINDOW), r

    item = [f"w{i}" for i in range(10)]
    nested = item[:5] * 1200 + item[5:] * 1200
    bench = spark.createDataFrame([(1, " ".join(item)), *((k, " ".join(f"other{k}x{i}" for i in range(30))) for k in range(2, 40))], "item_id long, text string")
    rows = [(1, "begin. " + " ".join(nested) + " end"), (2, " ".join(item[:5] * 20_000 + item[5:] * 20_000)), (3, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (200_000, 300):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = by_id(decontaminate.contamination(docs, bench, clean=True))
        assert (got[1]["cleaned"], got[2]["cleaned"], got[3]["cleaned"]) == ("begin. end", "", None) and got[1]["n_hit"] == 10


# -- 6, 7 and 10 tokens


@pytest.fixture(scope="module")
def library():
    import tiktoken

    path, pattern = byte_bpe.default_vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def test_bpe_like_the_library(library, rows):
    coder = byte_bpe.loaded(*byte_bpe.default_vocabulary())
    random.seed(5)
    letters = " \n\t'sabcdreltionTHE 123.,!?éüñ中文字　\xa0\x1c😀"
    texts = [*rows.values(), "a" * 5000, "ab" * 3000, "the" * 2000, "z" * 40_000, *("".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(3000))]
    for t in texts:
        ids = coder.encode(t)
        assert ids == library.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()


def test_bpe_documents(library, odd, none):
    enc = byte_bpe.decode_documents(byte_bpe.encode_documents(odd)).collect()
    assert len(enc) == odd.count()
    for r in enc:
        assert list(r["ids"]) == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    for r in byte_bpe.round_trip_digests(odd).collect():
        assert r["n_tokens"] > 0 or r["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert byte_bpe.round_trip_digests(none).count() == 0


def test_bpe_side_by_side(library, rows):
    coder = byte_bpe.ByteBPE(byte_bpe.read_ranks(byte_bpe.default_vocabulary()[0]), byte_bpe.default_vocabulary()[1])
    random.seed(6)
    syllables = ["tion", "eau", "the", "sch", "é", "an", "x", "中", "ß", "re", "'s", "9"]
    words = list({"".join(random.choices(syllables, k=random.randint(1, 14))) for _ in range(20_000)} | {"a" * n for n in range(1, 140)})
    pieces = [(" " * random.randint(0, 1) + w).encode() for w in words]
    start = time.process_time()
    one_by_one = [coder.encode_pretoken(p) for p in pieces]
    between = time.process_time()
    assert [np.frombuffer(x, dtype=np.int32).tolist() for x in coder.encode_pretokens(pieces)] == one_by_one
    assert 2 * (time.process_time() - between) < between - start

    space = [" ", " ", "  ", "\n", " \n", "\n ", "\x1c", "\xa0 ", " . ", "! "]
    texts = [*rows.values(), "", *("".join(random.choice(words) + random.choice(space) for _ in range(random.randint(0, 9))) for _ in range(2000)), *(a + b + c for a in space for b in ("x", "", "'s") for c in space)]
    for _ in range(2):  # some of it is remembered then
        for i in range(0, len(texts), 300):
            for text, ids in zip(texts[i : i + 300], coder.encode_all(texts[i : i + 300]), strict=True):
                assert np.frombuffer(ids, dtype=np.int32).tolist() == library.encode_ordinary(text)


def test_token_tables(spark, docs, odd, none):
    encoder = token_tables.WordEncoder(token_tables.default_tokenizer())
    for d in (docs, odd):
        folder = fresh_path(spark, "t")
        shards = token_tables.write_token_tables(d, folder)
        got = sorted(token_tables.read_token_tables(folder, shards).collect(), key=lambda r: r["start"])
        source = d.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy(F.asc_nulls_first("doc_id"), F.asc_nulls_first("h")).collect()
        at = 0
        for r, s in zip(got, source, strict=True):
            ids = encoder.whole(s["text"] or "", 1)
            assert tuple(r) == (s["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)
    names = [r["shard"] for r in shards.orderBy("shard").collect()]
    assert token_tables.lookup(f"{folder}/{names[0]}", source[0]["doc_id"]) is not None
    assert token_tables.lookup(f"{folder}/{names[0]}", 999_999) is None
    keys = [k for n in names for k, _ in token_tables.read_shard(f"{folder}/{n}")]
    assert len(set(keys)) == len(keys) == odd.count() and keys == sorted(keys)
    assert token_tables.write_token_tables(none, fresh_path(spark, "t")).count() == 0


def test_words_apart_give_the_librarys_ids():
    encoder = token_tables.WordEncoder(token_tables.default_tokenizer())
    random.seed(6)
    letters = " \n\t'sabcdeSΣΟ123.,!?;:éüñ中文字　\xa0\x1c😀ÀÉİǅ́̈ﬁ…\0<|endoftext|>"
    for _ in range(3000):
        t = "".join(random.choice(letters) for _ in range(random.randint(0, 40)))
        assert next(encoder.encode(pa.array([t]), 1))[0].tolist() == encoder.whole(t, 1).tolist()


def test_words_of_one_hash_give_the_librarys_ids(monkeypatch):
    encoder = token_tables.WordEncoder(token_tables.default_tokenizer())
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    texts = [f"{a} {b} word {a[1:]} {b[1:]}", f"{b} {'q' * 3000} {a}", None]
    same = lambda: [x.tolist() for e in encoder.encode(pa.array(texts), 1) for x in e] == [encoder.whole(t or "", 1).tolist() for t in texts]
    assert same()
    monkeypatch.setattr(wordscan.Scan, "hashes", lambda self: np.zeros(len(self.start), dtype=np.uint64))
    assert same()


def test_many_rows_of_one_id(spark):
    d = spark.createDataFrame([(7, f"text {i % 90}") for i in range(400)], "doc_id long, text string").repartition(7)
    folder = fresh_path(spark, "t")
    shards = token_tables.write_token_tables(d, folder)
    keys = [k for r in shards.orderBy("shard").collect() for k, _ in token_tables.read_shard(f"{folder}/{r['shard']}")]
    assert len(set(keys)) == 400 and keys == sorted(keys)


def test_shard_lookup(tmp_path):
    rows = [(token_tables.key_of(i, c), np.arange((i + c) % 50, dtype="<u4")) for i in range(-500, 5000, 3) for c in range(-1, 1 + (i % 2))]
    with (tmp_path / "s.sst").open("wb") as f:
        w = token_tables.ShardWriter(f, 4)
        for row in rows:
            w.add(*row)
        w.close()
    uri = f"file://{tmp_path}/s.sst"
    for i in (-500, -497, 1, 2500, 4996):
        ids = token_tables.lookup(uri, i)
        assert (ids is None) == ((i + 500) % 3 != 0) and (ids is None or ids.tolist() == list(range((i - 1) % 50)))
    assert token_tables.lookup(uri, -497, 1).tolist() == list(range(-497 % 50)) and token_tables.lookup(uri, -497, 3) is None
    assert [k for k, _ in token_tables.read_shard(uri)] == [k for k, _ in rows]


@pytest.mark.parametrize("block", [200, 5000, 1 << 20])
def test_token_counts(spark, docs, odd, library, block):
    d = docs.where("doc_id < 12").unionByName(odd.where("doc_id <> 5 OR doc_id IS NULL"))
    folder = fresh_path(spark, "flat")
    placed = token_counts.write_flat_tokens(d, folder)
    got = token_counts.count_tokens(spark, folder, block_ids=block).join(placed, ["file", "ordinal"]).collect()
    want = [(r["doc_id"], len(library.encode_ordinary(r["text"] or ""))) for r in d.collect()]
    assert sorted(map(repr, ((r["doc_id"], r["n_tokens"]) for r in got))) == sorted(map(repr, want))


def test_token_counts_without_a_last_end(spark, tmp_path):
    np.array([5, 6, 9, 9, 7, 8, 1, 2, 3], dtype="<u2").tofile(tmp_path / "a.u16")
    for block in (1, 2, 4, 100):
        got = token_counts.count_tokens(spark, f"file://{tmp_path}", end=9, block_ids=block).orderBy("ordinal").collect()
        assert [r["n_tokens"] for r in got] == [2, 0, 5]


# -- 8 language model


def test_lm_base_by_brute_force(spark, rows, odd, none):
    got = by_id(registry.QUERIES["op8_lm_scoring"](spark, SF))
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in rows}
    c = collections.Counter(w for i, t in rows.items() if not held[i] for w in words(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows.items():
        w, r = words(t), got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
    out = [r for i, r in got.items() if held[i]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert lm_scoring.score_texts(odd).count() == odd.count()
    assert {r["n_tokens"] for r in lm_scoring.score_texts(odd).where("doc_id IN (1, 2, 3)").collect()} == {1}
    assert lm_scoring.score_texts(none).count() == 0


def test_lm_scores_by_brute_force(spark, rows):
    """Each token's probability from the model's parameters, one by one; all words' probabilities sum to one."""
    docs = spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")
    training = docs.where(~lm_scoring.held_out_column()).select("text")
    counts = lm_scoring.in_batches(training, lm_scoring._count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}
    m = lm_scoring.fit_model(training, counts)
    v = m.vocabulary
    names = [v.words.data[v.words.start[k] : v.words.end[k]].tobytes() for k in v.order]
    place = {w: i for i, w in enumerate(names)}
    assert 100 < len(names) < len(c) and all(c[w] == n for w, n in zip(names, v.counts, strict=True))
    shape = lambda w: int(lm_scoring.shape_class(np.array([len(w)]), np.array([w[-1]]))[0])
    kind = lambda w: 0 if w == b"\n" else int(v.classes[place[w]]) if w in place else shape(w)
    others = [w for w in c if w != b"\n" and w not in place]
    mass = collections.Counter()
    for w in others:
        mass[shape(w)] += c[w] + 0.5
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()

    def distribution(two, one):
        s = m.scores[kind(two) * lm_scoring.CLASSES + kind(one)].astype(float)
        return softmax(s + (m.context[place[one]].astype(float) @ m.q.T if one in place else 0))

    def probability(w, two, one):
        p = distribution(two, one)[kind(w)]
        if w in place and kind(w) > lm_scoring.TOP:
            of = np.flatnonzero(v.classes == kind(w))
            p *= softmax(m.target[of, :-1].astype(float) @ m.r[kind(one)] + m.target[of, -1])[list(of).index(place[w])]
        elif w not in place and w != b"\n":
            p *= (c.get(w, 0) + 0.5) / (mass[shape(w)] + 0.5)  # half a count for all unknown words of the shape
        return p

    got = by_id(lm_scoring.score_texts(docs))
    for i in sorted(rows)[:12]:
        words = [b"\n", b"\n", *(rows[i] or "").encode().lower().split()[:4000], b"\n"]
        if len(words) < 4000:
            want = sum(math.log10(probability(w, two, one)) for two, one, w in zip(words, words[1:], words[2:], strict=False))
            assert math.isclose(got[i]["score"], want, rel_tol=1e-4)
    for two, one in ((b"\n", b"\n"), (names[0], names[5]), (others[0], others[1])):
        bins = sum(probability(w, two, one) for w in names)
        shapes = distribution(two, one)[1 + lm_scoring.TOP + lm_scoring.BINS :].sum()
        known = [k for k in range(lm_scoring.CLASSES) if k == 0 or k > lm_scoring.TOP + lm_scoring.BINS or (v.classes == k).any()]
        assert math.isclose(bins + shapes + distribution(two, one)[0], distribution(two, one)[known].sum(), rel_tol=1e-6)
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 5 == 1]
    order = sorted(held, key=lambda i: got[i]["n_tokens"])[-5:]
    shuffled = [(i, " ".join(random.Random(3).sample(rows[i].split(), len(rows[i].split())))) for i in order]
    mixed = by_id(lm_scoring.score_texts(docs.where(~lm_scoring.held_out_column()).unionByName(spark.createDataFrame(shuffled, "doc_id long, text string"))))
    assert sum(got[i]["score"] - mixed[i]["score"] for i in order) > 0  # the order of words matters


def test_words_fit_by_contrast_reach_the_true_rates():
    rng = np.random.default_rng(4)
    features = np.column_stack([rng.normal(0, 1, (40, 3)), np.ones(40)])
    true = rng.normal(0, 0.7, (5, 4)) - [0, 0, 0, 2.5]
    totals = np.full(40, 100_000.0)
    rates = np.exp(true @ features.T)
    share = np.full((5, 1), 0.05)
    got = lm_scoring.fit_words(rates * totals, lm_scoring.NOISE * totals * share, np.log(share) - np.log(lm_scoring.NOISE * share), features)
    assert np.allclose(got + np.array([0, 0, 0, math.log(0.05)]), true, atol=0.05)


def test_lm_is_normalised():
    rng = np.random.default_rng(0)
    t = rng.integers(0, 5, (8, 8, 8)).astype(float)
    m = lm_scoring.train_log_bilinear(t)
    s = m.scores()
    assert s.shape == (64, 8) and np.allclose(np.exp(s - lm_scoring.log_sum(s)[:, None]).sum(axis=1), 1)
