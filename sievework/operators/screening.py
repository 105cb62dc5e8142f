"""Around a model run: criteria, prompts, full texts and their sections, limits; no model is called."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import TOKEN_FACTOR, WIDE, doi_key, normalize_title, strip, title_key
from sievework.operators.running import running

#: Tokens kept free for the rest of a prompt and the answer, the least left for a text, and the notice behind a text that was cut.
RESERVED, LEAST_BUDGET = 2000, 500
NOTICE = "\n\n[... text truncated to fit the model's context window ...]"

#: Headings of articles, by the section they begin.
HEADINGS = {
    "abstract": ["abstract"], "introduction": ["introduction", "background"], "methods": ["methods", "materials and methods", "methodology"],
    "results": ["results", "findings"], "discussion": ["discussion", "conclusion", "conclusions"], "references": ["references", "bibliography", "literatur"],
}
SCREENED = ["methods", "results", "discussion"]

#: The fields of criteria frameworks.
FRAMEWORKS = {
    "PICOS": ["Population", "Intervention", "Comparison", "Outcome", "Study Design"],
    "SPIDER": ["Sample", "Phenomenon of Interest", "Design", "Evaluation", "Research Type"],
    "PECO": ["Population", "Exposure", "Comparison", "Outcome"],
    "PIRD": ["Population", "Index Test", "Reference Standard", "Diagnosis"],
}


def guarded(text: Column) -> Column:
    """Untrusted text whose angle brackets cannot close a prompt's block."""
    return F.translate(F.coalesce(text, F.lit("")), "<>", "‹›")


def criteria_text(framework: str, inclusion: dict[str, str], exclusion: dict[str, str], custom_fields: list[str] | None = None) -> str:
    """The criteria as text: the framework's fields in its order, those to include and those to exclude; a field that the framework lacks is an error (E203)."""
    fields = custom_fields or [] if framework.upper() == "CUSTOM" else FRAMEWORKS.get(framework.upper())
    if fields is None or (unknown := [f for f in [*inclusion, *exclusion] if f not in fields]):
        raise ValueError(f"E203: framework {framework!r}" + ("" if fields is None else f" has no field {unknown[0]!r}"))
    lines = [f"{verb} {f}: {own[f].strip()}" for verb, own in (("Include", inclusion), ("Exclude", exclusion)) for f in fields if own.get(f, "").strip()]
    return "\n".join(lines)


def prompt_prefix(title: str, description: str = "", objectives: list[str] | None = None, criteria: str = "", instructions: str = "") -> str:
    """What all prompts of a run begin with: project, numbered objectives, criteria, instructions; empty parts are left out."""
    goals = [o.strip() for o in objectives or [] if o.strip()]
    head = [f"Project: {title}", *([f"Description: {description.strip()}"] if description.strip() else []), *(["Objectives:"] if goals else []), *(f"{k}. {o}" for k, o in enumerate(goals, 1))]
    return "\n\n".join(x for x in ["\n".join(head), criteria, instructions] if x)


def build_prompts(records: DataFrame, prefix: str, system: str = "", keywords: bool = False, fulltext: str | None = None, reminder: str = "") -> DataFrame:
    """(study_uid, prompt, prefix_hash) for each record: prefix, and title with abstract or with the column ``fulltext``, perhaps with keywords, between record tags.

    ``reminder`` repeats the criteria behind a full text. The hash is that of system prompt and prefix, so it does not depend on the records.
    """
    line = lambda label, c: F.concat(F.lit(label), strip(guarded(F.col(c))))
    words = [F.when(strip(F.coalesce("keywords", F.lit(""))) != "", line("Keywords: ", "keywords"))] if keywords else []
    lines = [line("Title: ", "title"), *words, line("Full text:\n", fulltext)] if fulltext else [line("Title: ", "title"), line("Abstract: ", "abstract"), *words]
    tail = f"\n\nReminder of the criteria:\n{reminder}" if fulltext and reminder else ""
    body = F.concat(F.lit(f"{prefix}\n\n<record>\n"), F.concat_ws("\n", *lines), F.lit(f"\n</record>{tail}"))
    return records.select("study_uid", body.alias("prompt"), F.concat(F.lit("sha256:"), F.sha2(F.lit(f"{system}\n\n{prefix}"), 256)).alias("prefix_hash"))


def chunks(texts: DataFrame, size: int, overlap: int = 200) -> DataFrame:
    """``texts`` (study_uid, text) in windows of ``size`` characters that share ``overlap``; (study_uid, chunk, text)."""
    step = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - size) / F.lit(float(step)))).cast("int")
    d = texts.where(F.length("text") > 0).select("study_uid", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return d.select("study_uid", "chunk", F.substring("text", F.col("chunk") * step + 1, F.lit(size)).alias("text"))


def budget_of(context_tokens: int) -> int:
    """Tokens that a text may have in a context."""
    return max(context_tokens - RESERVED, LEAST_BUDGET)


def _plain_fit(budget: int) -> int:
    """Characters of a text without wide ones that has ``budget`` tokens at most."""
    most = max(0, int(budget * 4 / TOKEN_FACTOR) + 2)
    while most and math.ceil(most / 4.0 * TOKEN_FACTOR) > budget:
        most -= 1
    return most


def fitting(text: Column, budget: int) -> Column:
    """Characters of the longest prefix of a text that has ``budget`` tokens at most; all of them only if it fits as a whole.

    Tokens are a quarter for each character and four quarters for a wide one, so nothing behind the first characters that would fit if none were wide is
    looked at; where some of these are wide, the end is found by halving.
    """
    most = _plain_fit(budget)
    head = F.substring(text, F.lit(1), F.lit(most))
    powers = F.array(*(F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1))) if most else F.array(F.lit(0))

    def halved(h: Column) -> Column:
        narrow = lambda end: F.length(F.regexp_replace(F.substring(h, F.lit(1), end), f"[{WIDE}]+", ""))
        step = lambda end, k: F.when((end + k <= F.length(h)) & (4 * (end + k) - 3 * narrow(end + k) <= most), end + k).otherwise(end)
        return F.aggregate(powers, F.lit(0), step)

    # as a variable of a lambda the head is made once for all steps
    return F.when((F.octet_length(head) > F.length(head)) & head.rlike(f"[{WIDE}]"), F.get(F.transform(F.array(head), halved), F.lit(0))).otherwise(F.length(head))


def fit_to_context(text: Column, context_tokens: int, notice: str = NOTICE) -> Column:
    """The text if it fits, else its longest prefix that does, without white space at its end, and a notice."""
    budget = budget_of(context_tokens)
    cut = lambda n: F.regexp_replace(F.substring(text, F.lit(1), F.greatest(n, F.lit(1))), r"(?U)(?<!\s)\s+$", "")
    whole_or_cut = lambda n: F.when(F.length(text) <= n, text).otherwise(F.concat(cut(n), F.lit(notice)))
    return F.get(F.transform(F.array(fitting(text, budget)), whole_or_cut), F.lit(0))


def _sections(text: Column) -> Column:
    """array of (section, body) in order: what stands under lines that are a known heading and nothing else; empty bodies are left out."""
    names = "|".join(sorted((h for hs in HEADINGS.values() for h in hs), key=len, reverse=True))
    section = F.create_map(*(F.lit(x) for s, hs in HEADINGS.items() for h in hs for x in (h, s)))
    marked = F.regexp_replace(F.translate(text, "\x01\x02", "  "), rf"(?imd)^\s*({names})\s*$", "\x01$1\x02")
    parts = F.transform(F.slice(F.split(marked, "\x01"), 2, 1 << 30), lambda p: F.struct(section[F.lower(F.substring_index(p, "\x02", 1))].alias("s"), strip(F.substring_index(p, "\x02", -1)).alias("b")))
    return F.filter(parts, lambda p: p["b"] != "")


def section_texts(texts: DataFrame, sections: list[str] | None = None) -> DataFrame:
    """(study_uid, section, text): each section that a text (study_uid, text) has, same-named ones joined by an empty line in order."""
    d = texts.select("study_uid", _sections(F.coalesce("text", F.lit(""))).alias("_p"))
    d = d.select("study_uid", "_p", F.explode(F.array(*map(F.lit, sections or list(HEADINGS)))).alias("section"))
    own = F.array_join(F.transform(F.filter("_p", lambda p: p["s"] == F.col("section")), lambda p: p["b"]), "\n\n")
    return d.select("study_uid", "section", own.alias("text")).where("text != ''")


def screened_text(text: Column, context_tokens: int, sections: bool = False) -> Column:
    """A full text fitted to the context; with ``sections`` its methods, results and discussion, or all of it if it has none of these headings."""
    if sections:
        parts = _sections(F.coalesce(text, F.lit("")))
        own = lambda s: F.array_join(F.transform(F.filter(parts, lambda p: p["s"] == s), lambda p: p["b"]), "\n\n")
        reduced = F.array_join(F.filter(F.array(*map(own, SCREENED)), lambda x: x != ""), "\n\n")
        text = F.when(reduced != "", reduced).otherwise(text)
    return fit_to_context(text, context_tokens)


def link_fulltexts(fulltexts: DataFrame, records: DataFrame, min_words: int = 4) -> DataFrame:
    """(fulltext_id, study_uid, by) for each full text (fulltext_id, title, doi): its record by DOI, else by title; null if none.

    Of several records with a key the first one imported counts; attachments are no targets.
    """
    keys = lambda d: d.withColumns({"_d": doi_key(F.col("doi")), "_t": title_key(normalize_title(F.col("title")), min_words)})
    r = keys(records.where("fulltext_of = ''"))
    first = lambda k, name: r.where(F.col(k) != "").groupBy(k).agg(F.min_by("study_uid", "import_order").alias(name))
    d = keys(fulltexts).join(first("_d", "by_doi"), "_d", "left").join(first("_t", "by_title"), "_t", "left")
    by = F.when(F.col("by_doi").isNotNull(), "doi").when(F.col("by_title").isNotNull(), "title")
    return d.select("fulltext_id", F.coalesce("by_doi", "by_title").alias("study_uid"), by.alias("by"))


def requests_in_window(results: DataFrame, seconds: int = 60) -> DataFrame:
    """Per run: the most requests and tokens in any span of seconds, from (run_id, ts in seconds, tokens). Calls of one second are added first."""
    return busiest_windows(results.groupBy("run_id", "ts").agg(F.count("*").alias("r"), F.sum("tokens").alias("t")), seconds)


def busiest_windows(per_second: DataFrame, seconds: int) -> DataFrame:
    """Per run: the most requests and tokens in any span of seconds, from (run_id, ts, r, t), the sums of each second.

    Time is cut into stretches of ``seconds``; a window lies in two of them at most, so each stretch is one group, with
    a copy of the one before it, and a run of any length is many groups.
    """
    per_second = per_second.withColumn("own", F.floor(F.col("ts") / seconds))
    both = per_second.select("run_id", "ts", "r", "t", "own", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("part"))
    w = Window.partitionBy("run_id", "part").orderBy("ts").rangeBetween(-seconds + 1, 0)
    d = both.select("run_id", "own", "part", F.sum("r").over(w).alias("r"), F.sum("t").over(w).alias("t")).where("own = part")
    return d.groupBy("run_id").agg(F.max("r").alias("max_requests"), F.max("t").alias("max_tokens"))


def cost_stop(results: DataFrame, limit: float, concurrency: int = 1) -> DataFrame:
    """Per run: the line at which a run with this cost limit pauses (cost so far and the average of the calls in flight reach it)."""
    d = running(results.select("run_id", "line_no", F.coalesce("cost", F.lit(0.0)).alias("cost")), "line_no", {"c": "cost", "k": 1})
    return d.where(F.col("c") + F.col("c") / F.col("k") * concurrency >= limit).groupBy("run_id").agg(F.min("line_no").alias("stop_line"))


def free_records() -> Column:
    """Whether a record has no reason yet, and a title or an abstract."""
    return (F.coalesce("exclusion_reason", F.lit("")) == "") & ((F.trim("title") != "") | (F.trim("abstract") != ""))


def mark_by_probability(records: DataFrame, floor: float = 0.9) -> DataFrame:
    """``records`` (with p_true and p_false: probabilities that a record is out of scope, or not) marked where the first is greater and at least ``floor``."""
    out = free_records() & (F.col("p_true") > F.col("p_false")) & (F.col("p_true") >= floor)
    return records.withColumn("exclusion_reason", F.when(out, "AI_PREFILTER_JEV").otherwise(F.coalesce("exclusion_reason", F.lit(""))))


def unmatched(links: DataFrame) -> DataFrame:
    """Full texts that belong to no record."""
    return links.where("study_uid IS NULL").select("fulltext_id")


def last_attachments(records: DataFrame) -> DataFrame:
    """For each record with attachments that can be used, the last one."""
    a = records.where("fulltext_of <> '' AND abstract <> ''")
    return a.groupBy(F.col("fulltext_of").alias("study_uid")).agg(F.max_by("import_order", "import_order").alias("attachment"))
