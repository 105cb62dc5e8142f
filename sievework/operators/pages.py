"""Clean text of documents that were read page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import strip

# What marks a page number, a heading from which references follow, and a line with a DOI; ligatures and their letters.
PAGE_NUMBER = r"^\s*(?:[Pp]age\s+)?\d{1,4}(?:\s*/\s*\d{1,4})?\s*$"
REFERENCES = r"^\s*(references|bibliography|literatur|literaturverzeichnis)\s*$"
DOI_LINE = r"(?i)^\s*doi\s*:?\s*10\."
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st"}
HYPHEN_BREAK = r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])"
#: Characters before a references heading for it to count, and of a title.
BODY, TITLE = 500, 8


def page_number(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER)


def without_references(text: Column) -> Column:
    """A text up to its references, if more than BODY characters come before them."""
    before = F.regexp_extract(text, rf"(?ims)\A(.*?){REFERENCES}", 1)
    return F.when(text.rlike(rf"(?im){REFERENCES}") & (F.length(before) > BODY), before).otherwise(text)


def clean_pages(pages: DataFrame) -> DataFrame:
    """(doc, n_pages, title, text) of each document of (doc, page, text) and, where there is one, meta_title.

    In documents of three pages or more lines lose outer blanks, and go where they are page numbers or stand on more than half of the pages, as running heads do. Pages are joined in order; words cut
    at a line's end, page ends among them, are put together, ligatures become letters, blank lines become one, and references go. The title is the
    meta_title of eight characters or more, else the first such line that is no page number and no DOI, else the document's name.

    Lines vote by document and line, so a long document's votes are many groups; only its repeated lines, two pages' worth at most, and its text are put together.
    Nulls: a page's null text is empty; a null doc is a document of its own. Pages of equal number come in the order of their texts. No pages, no rows.
    """
    p = pages.select("doc", "page", F.coalesce("text", F.lit("")).alias("text"), (F.col("meta_title") if "meta_title" in pages.columns else F.lit(None).cast("string")).alias("meta_title"))
    p = p.withColumn("doc", F.struct("doc")).withColumn("lines", F.transform(F.split("text", "\n"), strip))
    sizes = p.groupBy("doc").agg(F.count("*").alias("n_pages"))
    votes = p.select("doc", F.explode(F.array_distinct("lines")).alias("line")).where("line != ''").groupBy("doc", "line").agg(F.count("*").alias("n"))
    heads = votes.where("n > 1").join(sizes.where("n_pages > 2"), "doc").where(F.col("n") * 2 > F.col("n_pages")).groupBy("doc").agg(F.collect_list("line").alias("heads"))
    d = p.join(sizes, "doc").join(heads, "doc", "left")
    head = lambda x: F.array_contains(F.coalesce("heads", F.array().cast("array<string>")), x)
    kept = F.array_join(F.filter("lines", lambda x: ~head(x) & ~page_number(x)), "\n")
    d = d.withColumn("text", F.when(F.col("n_pages") > 2, kept).otherwise(F.col("text")))
    d = d.groupBy("doc", "n_pages").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("ps"), F.max("meta_title").alias("meta_title"))
    text = F.array_join(F.transform("ps", lambda x: x["text"]), "\n")
    for one, letters in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(letters))
    text = F.regexp_replace(F.regexp_replace(text, HYPHEN_BREAK, "$1$2"), r"\n{3,}", "\n\n")
    d = d.select(F.col("doc.doc").alias("doc"), "n_pages", "meta_title", strip(without_references(text)).alias("text"))
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: (F.length(x) >= TITLE) & ~page_number(x) & ~x.rlike(DOI_LINE))
    meta = strip(F.coalesce("meta_title", F.lit("")))
    name = strip(F.regexp_replace(F.regexp_replace(F.regexp_extract("doc", r"([^/]*)$", 1), r"\.[^.]*$", ""), "[_-]+", " "))
    title = F.when(F.length(meta) >= TITLE, meta).otherwise(F.coalesce(F.get(lines, F.lit(0)), name, F.lit("")))
    return d.select("doc", "n_pages", title.alias("title"), "text")
