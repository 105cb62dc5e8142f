"""Source divergence, toxicity and collocations against brute force on small fixtures, and their defined results for odd rows."""

import collections
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from sievework.llm import collocations, source_divergence, toxicity
from sievework.llm.session import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, no words, repeated rows, ends of pieces, a NUL, a very long text; columns with clashing names."""
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice(["ab", "Ab", "c", "été", "d.", "ab;", "x\0y", "c\t", "\n", "d\x0b", "9", "中文", "ab ab"]) + " " for _ in range(n))
    rows = [(None, None, None, None), (1, "", "en", None), (2, "ab c " * 5000, "en", "s"), (3, "ab c ab c", None, "s"), (3, "ab c ab c", None, "s"), (4, ". ; !", "und", "t"), (5, "Ab C\x00 d", "und", "")]
    rows += [(i, say(rng.randint(0, 80)), rng.choice(["en", "de", None, ""]), rng.choice(["s", "t", "u", "", None])) for i in range(6, 60)]
    return spark.createDataFrame([(*r, 0, "", "") for r in rows], SCHEMA + ", n long, phrase string, term string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- source divergence


def divergence_by_hand(rows):
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for r in rows:
        lang, source = r["lang"] or "", r["source"] or ""
        groups.add((lang, source))
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(r["text"]))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        of_lang = sum((counts[g] for g in groups if g[0] == lang), collections.Counter())
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // q
        p, q = shares(counts[lang, source]), shares(of_lang)
        pairs = []
        for _, other in (g for g in groups if g[0] == lang and g[1] != source):
            o = shares(counts[lang, other])
            pairs.append((-sum(f(p[t], o[t]) for t in kept), other))
        terms = sorted(((-f(p[t], q[t]), t) for t in kept if counts[lang, source][t] and p[t] > q[t]), key=lambda x: (x[0], x[1].encode()))
        for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", terms[:200])):
            out |= {(lang, source, part, item, -v, i) for i, (v, item) in enumerate(found, 1)}
    return out


def test_divergence_of_odd_rows_equals_every_pair_and_term_by_hand(odd, none):
    got = source_divergence.source_divergence(odd).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == divergence_by_hand(odd.collect())
    assert source_divergence.source_divergence(none).collect() == []


def test_divergence_is_exact_for_large_counts_and_small_chunks(spark, monkeypatch):
    from pyspark.sql import functions as F

    x = spark.createDataFrame([(10**17, 3 * 10**17), (9 * 10**18 // 10, 9 * 10**18 // 10 + 7)], "n long, size long")
    got = [r[0] for r in x.orderBy("n").select(source_divergence.share(F.col("n"), F.col("size"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // s for n, s in ((10**17, 3 * 10**17), (9 * 10**17, 9 * 10**17 + 7))]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    whole = set(map(tuple, source_divergence.source_divergence(docs).collect()))
    monkeypatch.setattr(source_divergence._chunks, "__defaults__", (3,))
    assert set(map(tuple, source_divergence.source_divergence(docs).collect())) == whole == divergence_by_hand(docs.collect())


def test_terms_with_equal_counts_are_one_vector(spark):
    texts = [(i, "one two three", "en", "s") for i in range(3)] + [(9, "one two four", "en", "t")]
    terms = source_divergence.terms_of(spark.createDataFrame(texts, SCHEMA))
    assert {r["term"]: [tuple(x) for x in r["by_source"]] for r in terms.collect()} == {"one": [("s", 3), ("t", 1)], "two": [("s", 3), ("t", 1)], "three": [("s", 3)]}


# -- collocations


def collocations_by_hand(rows, least, listed):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for r in rows:
        lang = "und" if r["lang"] is None else r["lang"]
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(r["text"])):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            f[lang].update(tuple(ws[i : i + k]) for k in range(1, 5) for i in range(len(ws) - k + 1))
    out = set()
    for lang, counts in f.items():
        kept = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            inside = any(len(q) > len(p) and b >= least and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in counts.items())
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(kept)[:listed], 1):
            out.add((lang, i, p.decode(), -a, left, right, n[lang], -s))
    return out


@pytest.mark.parametrize("bits", [None, 6])
def test_collocations_of_odd_rows_equal_those_by_hand(odd, none, bits, monkeypatch):
    if bits:  # a table that says yes to nearly all changes nothing
        monkeypatch.setattr(collocations, "MOST_BITS", bits)
    rows = odd.collect()
    for least, listed in ((4, 7), (30, 2000)):
        got = collocations.collocations(odd, least=least, listed=listed).collect()
        assert {tuple(r) for r in got} == collocations_by_hand(rows, least, listed) and len(got) == len(set(got))
    assert collocations.collocations(none).collect() == []


def test_phrases_do_not_cross_ends_of_pieces_or_texts(spark):
    docs = spark.createDataFrame([(1, "a b. c", "en", ""), (2, "d a\tb", "en", ""), (3, "a  B\n", "en", "")], SCHEMA)
    found, sizes = collocations.frequent_runs(docs, least=1)
    assert {r["phrase"] for r in found.where("words > 1").collect()} == {"a b", "d a", "d a b"}
    assert found.where("phrase = 'a b'").first()["a"] == 3 and sizes.first()["n"] == 8


# -- toxicity


def kernel_by_hand(u, v):
    def weights(x):
        best = {}
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                for k in range(j + 1, len(x)):
                    s = x[i] << 16 | x[j] << 8 | x[k]
                    best[s] = max(best.get(s, 0), toxicity.DECAY ** (k - i + 1))
        return best

    a, b = weights(u), weights(v)
    own = sum(x * x for x in b.values())
    return (sum(x * b.get(s, 0) for s, x in a.items()) / own) ** toxicity.POWER


def test_kernels_are_those_of_all_subsequences():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abcd\xc3") for _ in range(rng.randint(1, 16))) for _ in range(60)]
    marks = [w for w in words if len(w) > 2][:12]
    kernel = toxicity.Kernel.of(toxicity._padded(marks))
    got = kernel.with_marks(toxicity._padded(words))
    assert np.allclose(got, [[kernel_by_hand(w, m) for m in marks] for w in words], rtol=1e-4)


def units(text):
    data = text.encode()
    u = toxicity.units_of(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
    return [(int(s), u.data[a:b].tobytes().decode()) for s, a, b in zip(u.sentence, u.start, u.end, strict=True)]


def test_units_and_sentences():
    assert units("You i.d.i.o.t! Yes\nno, no") == [(0, "you"), (0, "idiot"), (1, "yes"), (2, "no")]
    assert set(units("you i d i o t now")) == {(0, "you"), (0, "i"), (0, "d"), (0, "o"), (0, "t"), (0, "idiot"), (0, "now")}
    assert units("abcdefghijklmnopqrstuvwxyz") == [(0, "abcdefghijklmnop"), (0, "ijklmnopqrstuvwx"), (0, "qrstuvwxyz")]
    assert units("") == units(" .,! ") == []
    assert [s for s, _ in units(" ".join(f"word{i}" for i in range(100)))] == sorted(i // toxicity.SENTENCE for i in range(100))


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts with an insult for every other one of label 1, from stems with endings, and words at random."""
    rng = random.Random(4)
    parts = "an er th in on re st nd ou ly ti es ing ble".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    insult = lambda: rng.choice(["idiot", "moron", "pathetic", "zumpf" + rng.choice(parts)])
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(toxic * rng.randint(1, 2)):
            words.insert(rng.randint(0, len(words)), insult())
        text = "".join(w + rng.choice([" ", " ", " ", ". ", "\n"]) for w in words)
        rows.append((i, text, None, None))
        labels.append((i, int(toxic), 1))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_held_out_documents_and_hidden_insults_are_told(spark, labelled):
    docs, labels = labelled
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = toxicity.toxicity(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    hidden = ["nd the i.d.i.o.t in on", "then m o r o n ering", "is ly path_etic on", "zumpfarea indes", "an pat-het-ic re"]
    more = spark.createDataFrame([(10_000 + i, t, None, None) for i, t in enumerate(hidden)], SCHEMA)
    assert [r["predicted"] for r in toxicity.toxicity(docs.union(more), labels).where("doc_id >= 10000").orderBy("doc_id").collect()] == [1] * 5


def test_a_letter_put_into_an_insult_is_told_and_its_letters_in_other_words_are_not(spark, labelled):
    docs, labels = labelled
    altered = [w[:i] + "x" + w[i:] for w in ("idiot", "moron", "pathetic") for i in range(1, len(w))]
    plain = ["timorous nd", "romance in on", "apathy the", "diode ly", "patience ering", "es ing the"]
    more = spark.createDataFrame([(10_000 + i, t, None, None) for i, t in enumerate([f"the {w} in on" for w in altered] + plain)], SCHEMA)
    # documents of label 0 have words like the insults, as any corpus does
    known = [(20_000 + i, plain[i % len(plain)], None, None) for i in range(120)]
    docs, labels = docs.union(spark.createDataFrame(known, SCHEMA)), labels.union(spark.createDataFrame([(r[0], 0, 1) for r in known], "doc_id long, toxic int, quality int"))
    got = [r["predicted"] for r in toxicity.toxicity(docs.union(more), labels).where("doc_id BETWEEN 10000 AND 19999").orderBy("doc_id").collect()]
    assert np.mean(got[: len(altered)]) >= 0.9 and got[len(altered) :] == [0] * len(plain)


def test_a_unit_begins_a_word_or_goes_on_with_it():
    data = b"abcdefghijklmnopqrst ijklmnopqrst"
    u = toxicity.units_of(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
    rows = [bytes(x).rstrip(b"\0") for x in u.matrix(np.arange(len(u.start)))]
    assert rows == [b"\1abcdefghijklmnop", b"ijklmnopqrst", b"\1ijklmnopqrst"] and len(set(u.hashes.tolist())) == 3


def test_a_score_depends_on_the_text_alone(spark, labelled, monkeypatch):
    docs, labels = labelled
    whole = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    other = docs.selectExpr("doc_id", "text", "'en' AS lang", "'x' AS source").repartition(5)
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity(other, labels).collect()} == pytest.approx(whole, abs=1e-6)


def test_toxicity_of_odd_rows(spark, odd, none, labelled):
    _, labels = labelled
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert toxicity.toxicity(none, labels).collect() == []
    no_labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(odd, no_labels).collect()} == {0.0}
    all_toxic = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(odd, all_toxic).collect()} == {1.0}


def test_the_sample_is_bounded_and_takes_repeated_rows_once(spark, labelled, monkeypatch):
    docs, labels = labelled
    monkeypatch.setattr(toxicity, "SAMPLE", 50)
    sample, weights = toxicity.labelled_sample(docs.union(docs).union(docs), labels.union(labels))
    assert isinstance(sample, pd.DataFrame) and sample["toxic"].value_counts().max() <= 50 and sample["text"].is_unique and weights[0] > weights[1] > 1
    assert table(spark, SF, "labels").columns[0] == "doc_id"
