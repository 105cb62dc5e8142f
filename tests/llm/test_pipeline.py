"""The corpus pipeline: its stages' columns, what they keep, and the whole against the stages' own rules."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import byte_bpe, decontaminate, language_id, near_dedup
from sievework.llm.session import cut, documents, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, SF)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = cut(stage(spark, docs, SF), name)
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and after <= before
        seen.append((name, len(before), len(after)))
        if name == "near_dedup":
            assert near_dedup.near_duplicate_classes(docs).where("class_size > 1").count() == 0
    assert decontaminate.contamination(docs, table(spark, SF, "benchmark")).where("n_hit > 0").count() == 0
    assert seen[0][2] >= 0.95 * seen[0][1]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    want = byte_bpe.round_trip_digests(docs.select("doc_id", "text")).collect()
    assert sorted(map(tuple, last)) == sorted(map(tuple, want))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, last))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_and_empty_tables(spark):
    """Nulls in every column, texts without words, a very long one, repeated rows and ids, and columns named like the stages' own."""
    long = " ".join(f"word{i % 9000}" for i in range(40_000))
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, " \n\t ", None, "s", 3), (None, "some words in a row here", "en", "s", 1), (4, "same text of six words here", "en", "s", 1), (4, "same text of six words here", "en", "s", 1), (4, "another text of the same id", "de", "s", 1), (5, long, "en", "s", 1), (6, "x", "en", "t", 1)]
    odd = spark.createDataFrame(rows, SCHEMA)
    for n in ("n_words", "n_removed", "score", "items", "repeated", "_own_0", "a`b", "c.d"):
        odd = odd.withColumn(n, F.lit("own"))
    for table in (odd, odd.limit(0)):
        docs, before = table, table.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = cut(stage(spark, docs, SF), name)
            assert docs.columns == table.columns
            left = docs.collect()
            assert len(left) <= before and all(r["n_words"] == r["a`b"] == "own" for r in left)
            before = len(left)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == before
        # each stage by itself takes what the first one would have dropped
        for _, stage in corpus_pipeline.STAGES[1:]:
            assert stage(spark, table, SF).count() >= min(1, table.count())


def test_workers_keep_little_between_stages(monkeypatch):
    """A worker goes from stage to stage, so what a stage keeps or needs for a moment adds up with that of the others."""
    coder = byte_bpe.loaded(*byte_bpe.default_vocabulary())
    vowels = "aeiou"
    tracemalloc.start()
    try:
        held = tracemalloc.get_traced_memory()[0]
        for i in range(0, 200_000, 5000):
            coder.encode_all([" ".join("word" + "".join(vowels[k // 5**j % 5] for j in range(8)) for k in range(i, i + 5000))])
        assert tracemalloc.get_traced_memory()[0] - held < 25_000_000
        coder.forget()
        assert tracemalloc.get_traced_memory()[0] - held < 1_000_000
        texts = np.frombuffer(b"some short text " * 640, dtype=np.uint8)
        offsets = np.arange(0, 16 * 641, 16)
        tracemalloc.reset_peak()
        held = tracemalloc.get_traced_memory()[0]
        counts = language_id.term_counts(texts, offsets)
        assert tracemalloc.get_traced_memory()[1] - held < 10_000_000
    finally:
        tracemalloc.stop()
    dense = np.random.default_rng(1).random((5, language_id.BUCKETS), dtype=np.float32)
    products = counts.times(dense)
    monkeypatch.setattr(language_id, "TEXTS", 64)
    again = language_id.term_counts(texts, offsets)
    assert (again.bucket == counts.bucket).all() and (again.value == counts.value).all() and (again.times(dense) == products).all()
