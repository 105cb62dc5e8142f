"""Hand-made cases of the record operators."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import agreement as AG
from sievework.operators import answers as AN
from sievework.operators import dedup as DD
from sievework.operators import flow as FL
from sievework.operators import marking as MK
from sievework.operators import results as RS
from sievework.operators import running
from sievework.operators import screening as SC
from sievework.operators.components import connected_components

FIELDS = "import_order long, study_uid string, source_label string, title string, abstract string, doi string, pmid string, year int, language string, publication_types string, authors string, keywords string, keywords_mesh string, is_retracted boolean, fulltext_of string, exclusion_reason string, exclusion_details string"


def records(spark, rows):
    base = dict(source_label="s", title="", abstract="", doi="", pmid="", year=None, language="", publication_types="", authors="", keywords="", keywords_mesh="", is_retracted=False, fulltext_of="", exclusion_reason="", exclusion_details="")
    names = [x.split()[0] for x in FIELDS.split(", ")]
    full = [base | {"import_order": i, "study_uid": f"u{i}"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], FIELDS)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [("Größe & Maß", "grosse mass"), ("Ünï–cödé", "uni code"), (None, ""), ("a_b", "a b")])
def test_titles(spark, text, want):
    assert one(spark, text, T.normalize_title) == want


@pytest.mark.parametrize(("text", "want"), [("https://doi.org/10.1000/ABC.", "10.1000/abc"), ("doi: 10.1000/x y", "10.1000/xy"), ("11.1/x", None), (None, None)])
def test_dois(spark, text, want):
    assert one(spark, text, T.normalize_doi) == want


@pytest.mark.parametrize(("text", "want"), [("", ""), ("word " * 40, "ok"), ("too short", "short"), ("x" * 41, "suspect_concat"), (None, "")])
def test_abstracts(spark, text, want):
    assert one(spark, text, T.abstract_quality) == want


@pytest.mark.parametrize(("text", "want"), [("a &amp; b\x01\n  c", "a & b c"), ("x\x85y\u2003z\xa0", "x y z"), ("e\u0301 &#65; \x9d & co", "é A \x9d & co"), (None, ""), ("&nbsp;", "")])
def test_clean_text(spark, text, want):
    assert one(spark, text, T.clean_text) == want


def test_duplicates_by_component_and_guard(spark):
    r = records(spark, [
        {"doi": "10.1000/a", "title": "one two three four"},
        {"doi": "10.1000/A", "title": "other words in here", "abstract": "text"},
        {"title": "other words in here"},
        {"doi": "10.1000/b", "title": "same title four words"},
        {"doi": "10.1000/c", "title": "same title four words"},
        {"doi": "10.1000/a", "fulltext_of": "u0"},
        {"title": "Editorial"}, {"title": "Editorial"},
    ])
    m = {x["study_uid"]: x for x in DD.mark_duplicates(r).collect()}
    assert len(m) == 8
    assert m["u0"]["duplicate_of"] == "u1" and m["u0"]["dedup_method"] == "doi"
    assert m["u2"]["duplicate_of"] == "u1" and m["u2"]["dedup_method"] == "title_norm"
    assert not any(m[f"u{i}"]["is_duplicate"] for i in (1, 3, 4, 5, 6, 7))
    assert {x["duplicate_of"] for x in m.values()} - {""} <= {k for k, x in m.items() if not x["is_duplicate"]}
    again = {x["study_uid"]: x.asDict() for x in DD.mark_duplicates(DD.mark_duplicates(r)).collect()}
    assert again == {k: x.asDict() for k, x in m.items()}


def test_fuzzy_duplicates(spark):
    r = records(spark, [{"title": "a randomised controlled trial of walking in older adults"}, {"title": "a randomized controlled trial of walking in older adults"}, {"title": "something else about the same old topic"}])
    m = [x["duplicate_of"] for x in DD.mark_duplicates(r, strategy="title", fuzzy=True).orderBy("import_order").collect()]
    assert m == ["", "u0", ""]


def test_reasons_and_idempotence(spark):
    p = MK.Prefilters(languages=["eng"], year_from=2000, year_missing_passes=False, exclude_words=["rat"])
    r = records(spark, [
        {"language": "de", "year": 1990, "abstract": "x"}, {"language": "en", "year": 2010, "abstract": "a demonstration"}, {"language": "en; de", "year": 2010, "abstract": "x"},
        {"language": "xx yy", "year": None, "abstract": "x"}, {"title": "Index", "year": 2001, "is_retracted": True}, {"exclusion_reason": "AI_PREFILTER_JEV", "language": "de"}, {"year": 2001},
    ])
    once = MK.mark_validity(MK.mark_prefilters(r, p))
    got = [x["exclusion_reason"] for x in once.orderBy("import_order").collect()]
    assert got == ["PREFILTER_LANGUAGE", "PREFILTER_KEYWORD", "", "PREFILTER_YEAR", "NOT_SCREENABLE", "AI_PREFILTER_JEV", "NO_ABSTRACT"]
    assert [x["exclusion_reason"] for x in MK.mark_validity(MK.mark_prefilters(once, p)).orderBy("import_order").collect()] == got


def test_fleiss_by_hand(spark):
    d = spark.createDataFrame([("r1", "a", "A"), ("r1", "b", "A"), ("r2", "a", "A"), ("r2", "b", "A"), ("r3", "a", "A"), ("r3", "b", "B")], "run_id string, study_uid string, decision string")
    r = AG.fleiss(d).first()
    assert (r["n"], r["kappa"]) == (2, -0.2)
    assert AG.unstable(d).first()["study_uid"] == "b"


def test_metrics_of_a_known_matrix(spark):
    rows = [(True, True)] * 3 + [(True, False)] + [(False, False)] * 763 + [(False, True)] * 31
    m = AG.binary_metrics(spark.createDataFrame(rows, "ai boolean, human boolean")).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (3, 1, 763, 31)
    assert round(m["sensitivity"], 4) == 0.0882 and round(m["kappa"], 4) == 0.1503


@pytest.mark.parametrize(("before", "duplicates", "other"), [(True, 7, 0), (False, 4, 3)])
def test_flow_by_hand(spark, before, duplicates, other):
    rows = [(0, "SOURCE_IMPORTED", "A", None, 20, 0), (1, "SOURCE_IMPORTED", "B", None, 10, 0), (2, "SOURCE_IMPORTED", "C", None, 5, 0), (3, "DEDUP_WITHIN_SOURCE", "A", None, 2, 0), (4, "DEDUP_WITHIN_SOURCE", "B", None, 1, 0), (5, "DEDUP_GLOBAL", None, None, 4, 0)]
    f = FL.fold_flow(spark.createDataFrame(rows, "position long, event_type string, source_label string, run_id string, n long, m long"), before).first()
    assert (f["identified"], f["after_dedup"], f["duplicates_removed"], f["removed_other"]) == (35, 28, duplicates, other)


GOOD = '{"inclusion":[{"criterion":"i","verdict":"met","note":"","quote":"q"}],"exclusion":[],"reasoning":"r","decision":"INCLUDE"}'


def test_answers(spark):
    rows = [
        ("a", GOOD), ("b", f"```json\n{GOOD}\n```"), ("c", f"Sure: {GOOD} Bye"), ("i", GOOD.replace("INCLUDE", "EXCLUDE")), ("j", GOOD.replace('"decision"', '"ambiguities":["x"],"decision"')), ("k", GOOD.replace('"note":"",', "")),
        ("d", GOOD.replace('"met"', '"maybe"')), ("e", GOOD.replace('"reasoning":"r",', "")), ("f", GOOD.replace('"decision"', '"x":1,"decision"')), ("g", ""), ("h", None),
        ("l", GOOD.replace('"r"', "5")), ("m", GOOD.replace('"criterion":"i"', '"criterion":" "')), ("n", GOOD.replace('"criterion":"i",', "")), ("o", GOOD.replace('"quote":"q"', '"quote":7')), ("p", f"[{GOOD}]"),
        ("q", GOOD.replace('"decision"', '"ambiguities":[1],"decision"')), ("r", GOOD.replace('"exclusion":[]', '"exclusion":{}')), ("s", GOOD.replace('"exclusion":[]', '"exclusion":["x"]')), ("t", "not json"),
    ]
    r = {x["study_uid"]: x for x in AN.parse_answers(spark.createDataFrame(rows, "study_uid string, answer string")).collect()}
    assert [k for k in sorted(r) if r[k]["status"] == "ok"] == ["a", "b", "c", "i", "j", "k"]
    assert r["a"]["consistent"] and r["i"]["consistent"] is False and r["a"]["inclusion"][0]["quote"] == "q" and r["j"]["ambiguities"] == ["x"]


def test_quotes_and_last_lines(spark):
    d = spark.createDataFrame([("Big ... Dog!", "The big, brown dog"), ("cat", "The dog"), ("GRÖSSE", "die Größe"), (" … ", "")], "q string, t string")
    assert [x[0] for x in d.select(AN.quotes_found(F.col("q"), F.col("t"))).collect()] == [True, False, True, True]
    assert one(spark, "thinking\n**YYY**\n\n", AN.parse_last_line) == "INCLUDE"
    assert one(spark, "YYY\nor not", AN.parse_last_line) is None
    answers = spark.createDataFrame([("u", [("a", "met", "", "big dog"), ("b", "met", "", "cat")], [("c", "unclear", "", "")]), ("v", [("a", "met", "", "x")], [])], f"study_uid string, inclusion array<{AN.VERDICT}>, exclusion array<{AN.VERDICT}>")
    texts = spark.createDataFrame([("u", "A big  DOG.")], "study_uid string, text string")
    assert {x["study_uid"]: x["quote_unverified"] for x in AN.check_quotes(answers, texts).collect()} == {"u": ["b"], "v": ["a"]}


def test_sections(spark):
    t = "Title\nMethods\nwe did\n1. Results\nResults:\n RESULTS \n\nwe saw\n\nmore\nReferences\nx\nMaterials and Methods\nagain\nDiscussion\n\n"
    d = spark.createDataFrame([("u", t), ("v", "no heading"), ("w", None)], "study_uid string, text string")
    assert {x["section"]: x["text"] for x in SC.section_texts(d).collect()} == {"methods": "we did\n1. Results\nResults:\n\nagain", "results": "we saw\n\nmore", "references": "x"}
    assert one(spark, t, lambda c: SC.screened_text(c, 9000, sections=True)) == "we did\n1. Results\nResults:\n\nagain\n\nwe saw\n\nmore"
    assert one(spark, "no heading", lambda c: SC.screened_text(c, 9000, sections=True)) == "no heading"


def test_fit_of_wide_and_narrow_text(spark):
    for text in ("中" * 3000, "a" * 5000, "a中" * 2000, "abc", "", "a" * 1817 + " " * 300 + "b"):
        got = one(spark, text, lambda c: SC.fit_to_context(c, 2400))
        tokens = lambda x: -(-int(round(((n := sum(c == "中" for c in x)) * 4 + len(x) - n) * 1.1 * 1000)) // 4000)
        if tokens(text) <= 500:
            assert got == text
        else:
            end = max(k for k in range(1, len(text) + 1) if tokens(text[:k]) <= 500)
            assert got == text[:end].rstrip() + SC.NOTICE


def test_fit_looks_no_further_than_the_context(spark):
    """2000 texts of 20,000 characters took minutes when each was counted as a whole, and once for each halving of 2^30."""
    d = spark.range(2000, numPartitions=4).select("id", F.repeat(F.concat(F.lit("ab 中"), F.col("id").cast("string")), F.lit(4000)).alias("t"))
    began = time.time()
    got = d.select(F.length(SC.fit_to_context(F.col("t"), 2400)).alias("n")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("n").alias("all")).first()
    assert got["all"] == 2000 and 800 < got["low"] <= got["high"] < 1818 and time.time() - began < 30
    assert [SC._plain_fit(b) for b in (0, 1, 500)] == [0, 3, 1818]
    assert one(spark, None, lambda c: SC.fit_to_context(c, 2400)) is None and one(spark, "é" * 1818, lambda c: SC.fit_to_context(c, 2400)) == "é" * 1818


@pytest.mark.parametrize("what", ["batches", "sample"])
def test_places_by_ranges_that_are_dealt_once(spark, what):
    """The counts of the ranges were of another dealing, with a column less and so with other merged partitions: rows were lost."""
    n = 60_000
    d = spark.range(n, numPartitions=6).select(((F.col("id") * 7919) % n).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(size, "400KB"), spark.conf.set(least, "1KB")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        if what == "batches":
            got = sorted((r["k"], r["batch"]) for r in RS.batches(d, "k", 64).where("more <> ''").collect())
            assert got == [(k, k // 64) for k in range(n)]
        else:
            assert sorted(r["k"] for r in RS.systematic_sample(d, "k", 300).where("more <> ''").collect()) == list(range(0, n, 200))
    finally:
        for c in (size, least, "spark.sql.adaptive.coalescePartitions.parallelismFirst"):
            spark.conf.unset(c)


def test_fuzzy_links_of_classes(spark):
    """Copies of two titles made a link for every pair of them; nulls and what clashes count as before."""
    titles = ["a randomised trial of walking in old people", "a randomized trial of walking in old people"]
    rows = [{"title": titles[i % 2], "year": (None, 2000, 2009)[i % 3], "authors": ("", "Doe, A", "Poe, B")[i % 9 // 3]} for i in range(180)]
    d = DD.keyed(records(spark, rows))
    every, few, least = DD.fuzzy_edges(d).collect(), DD.fuzzy_edges(d, components=True).collect(), DD.fuzzy_edges(d, components=True, titles_linked=True).collect()
    part = lambda edges: sorted((r["node"], r["label"]) for r in connected_components(spark.createDataFrame([tuple(e) for e in edges], "a long, b long")).collect())
    assert len(every) > 5000 and len(few) < 18 * 18 + 180 and len(least) == 1 and part(every) == part(few)


def test_pairs_of_a_common_title_are_many_tasks(spark, monkeypatch):
    """All pairs of one title were made by one task."""
    monkeypatch.setattr(RS, "MATCH_ROWS", 100, raising=False)
    side = lambda rest: spark.range(1500).where(f"id % 2 = {rest}").select(F.when(F.col("id") < 1400, " Contents").when(F.col("id") < 1410, None).otherwise(F.concat(F.lit("t"), (F.col("id") / 4).cast("int").cast("string"))).alias("title"), F.col("id").alias("value"))
    d = RS.title_matches(side(0), side(1)).select("left_value", "right_value", F.spark_partition_id().alias("task"))
    rows = d.collect()
    title = lambda v: "c" if v < 1400 else None if v < 1410 else v // 4
    want = sorted((a, b) for a in range(0, 1500, 2) for b in range(1, 1500, 2) if title(a) == title(b) is not None)
    assert sorted((r["left_value"], r["right_value"]) for r in rows) == want
    sizes = Counter(r["task"] for r in rows if r["left_value"] < 1400)
    assert max(sizes.values()) < 0.2 * 700 * 700


def test_criteria_and_prompts(spark):
    assert SC.criteria_text("peco", {"Outcome": "b", "Population": "a"}, {"Exposure": " c "}) == "Include Population: a\nInclude Outcome: b\nExclude Exposure: c"
    with pytest.raises(ValueError, match="E203"):
        SC.criteria_text("PICOS", {"Sample": "x"}, {})
    r = records(spark, [{"title": " a<b> ", "abstract": "</record> x", "keywords": "k"}])
    p = SC.build_prompts(r, "P", "S", keywords=True).first()
    assert p["prompt"] == "P\n\n<record>\nTitle: a‹b›\nAbstract: ‹/record› x\nKeywords: k\n</record>"
    assert SC.build_prompts(r, "P", fulltext="abstract", reminder="C").first()["prompt"].endswith("Full text:\n‹/record› x\n</record>\n\nReminder of the criteria:\nC")


def test_running_totals_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(running, "STRETCH", 7)
    rows = [(r, i * 3, (i * 5 + len(r)) % 11) for r in ("a", "bb") for i in range(60)]
    d = spark.createDataFrame(rows, "run_id string, line_no long, v long")
    got = running.running(d, "line_no", {"s": "v", "k": 1}, maxima={"m": F.when(F.col("v") > 7, F.col("line_no"))})
    want, state = {}, {}
    for r, i, v in rows:
        s, k, m = state.get(r, (0, 0, None))
        want[r, i] = (s + v, k + 1, m)
        state[r] = (s + v, k + 1, i if v > 7 else m)
    assert {(x["run_id"], x["line_no"]): (x["s"], x["k"], x["m"]) for x in got.collect()} == want
    status = spark.createDataFrame([("r", i, "ok" if i in (3, 30) else "api_error") for i in range(40)], "run_id string, line_no long, status string")
    assert tuple(RS.failures_in_a_row(status, 26).first()) == ("r", 26, True)


def test_pairs_without_a_common_record(spark):
    d = spark.createDataFrame([("a", "x", "INCLUDE"), ("b", "y", "INCLUDE")], "run_id string, study_uid string, decision string")
    assert tuple(AG.pairwise(d).first()) == ("a", "b", 0, 0.0, None, None)


def test_flow_from_a_log(spark):
    """Payloads of several shapes; what does not fit together, each by itself."""
    def flow(*events):
        log = spark.createDataFrame([(i, *e) for i, e in enumerate(events)], "position long, event_type string, source_label string, run_id string, payload string")
        f = FL.fold_flow(FL.event_numbers(log))
        return f.first(), sorted(x["code"] for x in FL.flow_warnings(f).collect())

    imported = ("SOURCE_IMPORTED", "A", None, '{"records_identified":20}')
    f, w = flow(imported, ("SOURCE_IMPORTED", None, None, '{"source_label":"B","records_identified":"10"}'), ("SOURCE_IMPORTED", "C", None, '{"records_identified":true}'), ("SOURCE_IMPORTED", "D", None, "no json"), ("SOURCE_IMPORTED", "E", None, None))
    assert f["identified"] == 30 and w == []
    f, w = flow(imported, ("DEDUP_GLOBAL", None, None, '{"before":20,"after":18,"removed":2}'), ("INFO", None, None, '{"kind":"prefilter","by_reason":{"PREFILTER_YEAR":3,"PREFILTER_TYPE":1.9}}'), ("INFO", None, None, '{"kind":"ai_prefilter_jev","by_reason":{"AI_PREFILTER_JEV":2}}'),
                ("INFO", None, None, '{"kind":"validity","missing_count":5,"by_reason":{"RETRACTED":1}}'), ("SCREEN_TA", None, "r", '{"included":4,"excluded":6}'), ("SCREEN_TA", None, "r", '{"included":1,"excluded":0}'))
    assert (f["prefiltered"], f["ai_prefiltered"], f["to_screen"], f["screened"], f["included"], f["missing_abstracts"], w) == (5, 2, 11, 11, 5, 5, [])
    assert flow(imported, ("DEDUP_GLOBAL", None, None, '{"before":5,"after":9,"removed":0}'))[1] == ["ARITHMETIC_MISMATCH", "DEDUP_AFTER_EXCEEDS_BEFORE"]
    assert flow(imported, ("MERGE_ALL_SOURCES", None, None, '{"merged_records_before_global_dedup":25}'))[1] == ["ARITHMETIC_MISMATCH", "MERGED_EXCEEDS_IDENTIFIED"]
    assert flow(imported, ("SCREEN_TA", None, "r", '{"included":1,"excluded":90}'), ("SCREEN_FT", None, "r", '{"included":1,"excluded":1}'))[1] == ["FULLTEXT_EXCEEDS_INCLUDED", "SCREENED_EXCEEDS_AVAILABLE"]
    assert flow(("INFO", None, None, '{"kind":"prefilter","by_reason":{}}'), ("INFO", None, None, '{"kind":"validity"}'), ("DEDUP_GLOBAL", None, None, "{}"), imported)[1] == ["STALE_DEDUP", "STALE_PREFILTER", "STALE_VALIDITY"]


def test_large_blocks_and_repeated_titles(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
    rows = [{"title": "a randomised trial of walking and " + " ".join(words[(i * k) % 11] for k in (1, 2, 3))} for i in range(11)] + [{"title": "a randomised trial of walking in old people"}] * 301 + [{"title": "a randomized trial of walking in old people"}]
    r = records(spark, rows)
    d = DD.keyed(r)
    assert DD.fuzzy_edges(d).where("b >= 11").count() == 0  # the block is too large
    assert {(x["b"], x["a"]) for x in DD.fuzzy_edges(d, max_block=None).where("a = 312").collect()} == {(i, 312) for i in range(11, 312)}


def test_titles_of_a_large_block_are_all_compared(spark):
    """By rare letters, against all pairs of 600 titles that begin alike."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    seeds = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(8, 30))) for _ in range(120)]
    titles = set()
    while len(titles) < 600:
        t = list(rng.choice(seeds))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(t))
            t[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "a", "é"])
        titles.add("the same beginning " + "".join(t))
    titles = sorted(titles)
    want = {(a, b) for i, a in enumerate(titles) for b in titles[i + 1 :] if 2 * min(len(a), len(b)) >= 0.94 * (len(a) + len(b)) and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.94}
    placed = spark.createDataFrame([("s", t) for t in titles], "block string, title string")
    for large in ([("s",)], []):
        got = {tuple(r) for r in DD.alike_titles(placed, spark.createDataFrame(large, "block string"), 0.94).collect()}
        assert got == want and len(want) > 100
    assert DD.alike_titles(placed.limit(0), placed.select("block").limit(0), 0.94).count() == 0
