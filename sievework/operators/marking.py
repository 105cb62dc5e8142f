"""Marks on records: filters before screening, validity, and what may replace what. No row is ever dropped."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import NOT_SCREENABLE, abstract_quality, language_codes, normalize_title, normalize_type, split_list

#: Reasons set by each step. A step first clears its own.
PREFILTER_REASONS = ["PREFILTER_LANGUAGE", "PREFILTER_YEAR", "PREFILTER_TYPE", "PREFILTER_KEYWORD"]
VALIDITY_REASONS = ["NOT_SCREENABLE", "RETRACTED", "NO_ABSTRACT"]
#: Reasons that a duplicate mark replaces.
REPLACED_BY_DUPLICATE = PREFILTER_REASONS + VALIDITY_REASONS


@dataclass(frozen=True)
class Prefilters:
    """Settings of the filters before screening; an empty or absent setting leaves its filter off."""

    languages: list[str] = field(default_factory=list)
    language_missing_passes: bool = True
    year_from: int | None = None
    year_to: int | None = None
    year_missing_passes: bool = True
    excluded_types: list[str] = field(default_factory=list)
    include_words: list[str] = field(default_factory=list)
    exclude_words: list[str] = field(default_factory=list)
    case_sensitive: bool = False


def language_hit(language: Column, p: Prefilters) -> Column:
    """Details of a language that is not allowed, or null; one allowed language is enough."""
    if not p.languages:
        return F.lit(None).cast("string")
    codes = language_codes(language)
    wrong = ~F.arrays_overlap(codes, F.array(*map(F.lit, p.languages)))
    named = F.concat(F.lit("language: "), F.array_join(codes, ", "))
    missing = F.lit(None).cast("string") if p.language_missing_passes else F.lit("language: missing")
    return F.when(F.size(codes) == 0, missing).when(wrong, named)


def year_hit(year: Column, p: Prefilters) -> Column:
    if p.year_from is None and p.year_to is None:
        return F.lit(None).cast("string")
    out = F.lit(False)
    if p.year_from is not None:
        out |= year < p.year_from
    if p.year_to is not None:
        out |= year > p.year_to
    missing = F.lit(None).cast("string") if p.year_missing_passes else F.lit("year: missing")
    return F.when(year.isNull(), missing).when(out, F.concat(F.lit("year: "), year.cast("string")))


def type_hit(types: Column, p: Prefilters) -> Column:
    if not p.excluded_types:
        return F.lit(None).cast("string")
    bad = F.filter(F.transform(split_list(types), normalize_type), lambda t: t.isin(*[" ".join(x.lower().split()) for x in p.excluded_types]))
    return F.when(F.size(bad) > 0, F.concat(F.lit("type: "), F.get(bad, F.lit(0))))


def keyword_hit(texts: list[Column], p: Prefilters) -> Column:
    """A word that excludes wins over words that include; words are looked for anywhere, also inside others."""
    if not p.include_words and not p.exclude_words:
        return F.lit(None).cast("string")
    fold = (lambda x: x) if p.case_sensitive else F.lower
    whole = fold(F.concat_ws("\n", *texts))
    has = lambda w: F.contains(whole, fold(F.lit(w)))
    hit = F.lit(None).cast("string")
    if p.include_words:
        some = F.lit(False)
        for w in p.include_words:
            some |= has(w)
        hit = F.when(~some, F.lit("keyword: none of the required words"))
    for w in reversed(p.exclude_words):
        hit = F.when(has(w), F.lit(f"keyword: {w}")).otherwise(hit)
    return hit


def mark_prefilters(records: DataFrame, p: Prefilters) -> DataFrame:
    """``records`` with exclusion_reason and exclusion_details by the first filter that hits; details name all hits.

    A record with a reason of another step but validity's is left alone. Running it again changes nothing.
    """
    own = F.col("exclusion_reason").isin(*PREFILTER_REASONS, *VALIDITY_REASONS)
    blank = F.coalesce("exclusion_reason", F.lit("")) == ""
    hits = [
        language_hit(F.col("language"), p), year_hit(F.col("year"), p), type_hit(F.col("publication_types"), p),
        keyword_hit([F.col(c) for c in ("title", "abstract", "keywords", "keywords_mesh")], p),
    ]
    reason = F.coalesce(*(F.when(h.isNotNull(), F.lit(r)) for r, h in zip(PREFILTER_REASONS, hits, strict=True)))
    kept = F.when(F.col("exclusion_reason").isin(*PREFILTER_REASONS), "").otherwise(F.coalesce("exclusion_reason", F.lit("")))
    d = records.withColumn("_reason", F.when(own | blank, reason)).withColumn("_details", F.concat_ws("; ", *hits))
    d = d.withColumn("exclusion_details", F.when(F.col("_reason").isNotNull(), F.col("_details")).when(F.col("exclusion_reason").isin(*PREFILTER_REASONS), "").otherwise(F.col("exclusion_details")))
    return d.withColumn("exclusion_reason", F.coalesce("_reason", kept)).drop("_reason", "_details")


def mark_validity(records: DataFrame, title_only: bool = False, retracted: bool = True) -> DataFrame:
    """``records`` with has_abstract, abstract_quality and, where no other step has a reason, a validity reason.

    A title that is no study comes before a retraction, and that before a missing abstract. Attachments of other records are not judged.
    """
    quality = abstract_quality(F.col("abstract"))
    none = F.lit(None).cast("string")
    why = (
        F.when(F.col("fulltext_of") != "", none).when(normalize_title(F.col("title")).isin(*NOT_SCREENABLE), "NOT_SCREENABLE")
        .when(F.col("is_retracted") & F.lit(retracted), "RETRACTED").when((quality == "") & F.lit(not title_only), "NO_ABSTRACT")
    )
    reason = F.coalesce("exclusion_reason", F.lit(""))
    free = (reason == "") | reason.isin(*VALIDITY_REASONS)
    return records.withColumn("abstract_quality", quality).withColumn("has_abstract", F.col("abstract_quality") != "").withColumn("exclusion_reason", F.when(free, F.coalesce(why, F.lit(""))).otherwise(reason))


def prefilter_counts(before: DataFrame, after: DataFrame, p: Prefilters) -> DataFrame:
    """(kind, name, n): records the filters removed (``removed``), by reason (``by_reason``), let pass though a field is missing (``passed_on_missing``: language,
    year), and left alone for another step's reason (``skipped``). ``before`` and ``after`` are records before and after :func:`mark_prefilters`.
    """
    reason = F.coalesce("exclusion_reason", F.lit(""))
    ours = reason.isin(*PREFILTER_REASONS)
    free = (reason == "") | reason.isin(*PREFILTER_REASONS, *VALIDITY_REASONS)
    none = F.lit(False)
    missing = {
        "language": (F.size(language_codes(F.col("language"))) == 0) if p.languages and p.language_missing_passes else none,
        "year": F.col("year").isNull() if (p.year_from is not None or p.year_to is not None) and p.year_missing_passes else none,
    }
    # each table is read once; the second line's rollup has all reasons in one row
    line = lambda kind, name, n: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), n.cast("long").alias("n"))
    own = before.agg(F.array(*(line("passed_on_missing", name, F.count_if(free & c)) for name, c in missing.items()), line("skipped", "", F.count_if(~free))).alias("rows"))
    found = after.where(ours).rollup(reason.alias("name")).agg(F.count("*").alias("n"))
    named = found.select(F.when(F.col("name").isNull(), "removed").otherwise("by_reason").alias("kind"), F.coalesce("name", F.lit("")).alias("name"), "n")
    return own.select(F.inline("rows")).unionByName(named)


def eligible_with_fulltext(records: DataFrame, fulltexts: DataFrame) -> DataFrame:
    """Records without a reason whose full text, from (study_uid, text), can be used."""
    usable = fulltexts.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("study_uid")
    own = records.where((F.coalesce("exclusion_reason", F.lit("")) == "") & (F.coalesce("fulltext_of", F.lit("")) == ""))
    return own.join(usable, "study_uid", "left_semi")


def in_scope(records: DataFrame, scope: str) -> DataFrame:
    """The records of an export: ``all``, ``screenable`` (without a reason) or ``excluded``."""
    reason = F.coalesce("exclusion_reason", F.lit("")) != ""
    scopes = {"all": F.lit(True), "screenable": ~reason, "excluded": reason}
    if scope not in scopes:
        raise ValueError(f"E203: unknown scope {scope!r}, not one of {', '.join(scopes)}")
    return records.where(scopes[scope])


def project_status(records: DataFrame) -> DataFrame:
    """(source_label, n, n_abstract, n_empty, n_duplicate) of each source, and of all under a null label."""
    d = records.rollup("source_label").agg(
        F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("abstract", F.lit(""))) != "").alias("n_abstract"),
        F.count_if(F.col("exclusion_reason") == "EMPTY_RECORD").alias("n_empty"), F.count_if(F.col("is_duplicate")).alias("n_duplicate"),
    )
    return d


def preflight(records: DataFrame, by: str = "source_file", least_share: float = 0.6) -> DataFrame:
    """(by, n, n_abstract, status, issue) of each file before it is imported: no abstract is an error, too few a warning."""
    d = records.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("abstract", F.lit(""))) != "").alias("n_abstract"))
    none, few = F.col("n_abstract") == 0, F.col("n_abstract") / F.col("n") < least_share
    return d.withColumns({"status": F.when(none, "ERROR").when(few, "WARNING").otherwise("OK"), "issue": F.when(none, "NO_ABSTRACTS").when(few, "LOW_ABSTRACT_RATIO").otherwise("")})


def eligible(records: DataFrame, title_only: bool = False) -> DataFrame:
    """Records that go to the model."""
    return records.where((F.coalesce("exclusion_reason", F.lit("")) == "") & (F.col("fulltext_of") == "") & ((F.trim("abstract") != "") | F.lit(title_only)))


def reason_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("exclusion_reason").agg(F.count("*").alias("n"))


def source_report(records: DataFrame) -> DataFrame:
    """Per source: records, with abstract, duplicates, valid, and a level by the share of abstracts and valid records."""
    own = records.where("fulltext_of = ''")
    dup = F.col("exclusion_reason") == "DUPLICATE"
    d = own.groupBy("source_label").agg(
        F.count("*").alias("n_records"), F.count_if(F.col("has_abstract")).alias("n_abstract"),
        F.count_if(dup).alias("n_duplicate"), F.count_if(F.col("exclusion_reason") == "").alias("n_valid"),
    )
    level = F.when((F.col("n_abstract") == 0) | (F.col("n_valid") == 0), "ERROR").when(F.col("n_abstract") < 0.6 * F.col("n_records"), "WARNING").otherwise("OK")
    return d.withColumn("level", level)
