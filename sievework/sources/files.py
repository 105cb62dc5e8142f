"""Bibliographic files as records: what a file is, its text, and its fields."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievework.functions.text import clean_text, coerce_year, normalize_doi, normalize_list, strip
from sievework.schemas import BIBTEX_TYPES, LISTS, RECORD_COLUMNS, RIS_TYPES, TEXTS

#: Bytes of a file that are looked at to tell its format.
SNIFF_BYTES = 64 * 1024
_RIS, _NBIB, _BIB = re.compile(r"(?m)^TY {1,2}- +\S"), re.compile(r"(?m)^PMID- +\d"), re.compile(r"(?m)^[ \t]*@\w+[{(]")
_RIS_TAG = re.compile(r"(?m)^[A-Z][A-Z0-9] {1,2}-( |$)")


def decode(content: bytes, encoding: str | None = None) -> str:
    """Text of bytes: UTF-16 by its mark, else UTF-8, else Windows-1252, else Latin-1; a named encoding is the only one tried (E103). Line ends become \\n."""
    if encoding:
        try:
            return content.decode(encoding).replace("\r\n", "\n").replace("\r", "\n")
        except (UnicodeDecodeError, LookupError) as e:
            raise ValueError(f"E103: not {encoding}") from e
    codes = ["utf-16"] if content[:2] in (b"\xff\xfe", b"\xfe\xff") else ["utf-8-sig", "cp1252", "latin-1"]
    for code in codes:
        try:
            return content.decode(code).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def best_delimiter(text: str) -> str:
    """The mark that parts the first lines into most columns, four fifths of them alike; nothing if none does."""
    lines = [x for x in text[:SNIFF_BYTES].split("\n") if x.strip()][:200]
    best = ("", 0)
    for mark in ",;\t|":
        widths = [x.count(mark) + 1 for x in lines]
        mode = max(set(widths), key=widths.count) if widths else 1
        if len(lines) >= 2 and mode >= 2 and widths.count(mode) >= 0.8 * len(lines) and mode > best[1]:
            best = (mark, mode)
    return best[0]


def detect(name: str, content: bytes) -> tuple[str, float]:
    """(format, confidence): content counts before the name's ending; an empty or binary file has an error for format."""
    head = content[:SNIFF_BYTES]
    if not head.strip():
        return "E102", 1.0
    if head.startswith(b"%PDF"):
        return "pdf", 1.0
    if head.startswith(b"PK\x03\x04"):
        return ("xlsx" if b"xl/" in head or name.endswith(".xlsx") else "zip"), 1.0
    if head.startswith(b"\xd0\xcf\x11\xe0") or (b"\0" in head and head[:2] not in (b"\xff\xfe", b"\xfe\xff")):
        return "E101", 1.0
    text = decode(head)
    ris, nbib = _RIS.search(text), _NBIB.search(text)
    if ris and nbib:
        return ("ris" if ris.start() < nbib.start() else "nbib"), 0.6
    for found, kind in ((nbib, "nbib"), (ris, "ris"), (_BIB.search(text), "bib")):
        if found:
            return kind, 0.95
    if len(_RIS_TAG.findall(text)) >= 3:
        return "ris", 0.5
    ending = name.rsplit(".", 1)[-1].lower()
    lines = [x for x in text.split("\n") if x.strip()]
    if best_delimiter(text):
        return "csv", 0.9 if ending in ("csv", "tsv", "txt") else 0.8 if len(lines) >= 5 else 0.6
    return (ending, 0.3) if ending in ("ris", "nbib", "bib", "csv") else ("E101", 1.0)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, sha256, format, confidence, text) of the files at a path; text is null for formats that are not text."""

    @F.pandas_udf("format string, confidence double, text string")
    def look(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        found = [detect(n, c) for n, c in zip(names, contents, strict=True)]
        texts = [decode(c) if k in ("ris", "nbib", "bib", "csv") else None for (k, _), c in zip(found, contents, strict=True)]
        return pd.DataFrame({"format": [k for k, _ in found], "confidence": [p for _, p in found], "text": texts})

    d = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return d.select(name.alias("source_file"), F.sha2("content", 256).alias("sha256"), look(name, F.col("content")).alias("l")).select("source_file", "sha256", "l.*")


def new_files(files: DataFrame, log: DataFrame, force: bool = False) -> DataFrame:
    """The files whose checksum the import log does not have; all of them with ``force``."""
    return files if force else files.join(log.select("sha256"), "sha256", "left_anti")


def _tagged_lines(files: DataFrame, tag: str) -> DataFrame:
    """Lines of files of tagged lines that are not blank: i, tag (null for a line without one), value, blanks (blank lines so far), and the same of the last tagged line before."""
    d = files.select("source_file", "start", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    before = Window.partitionBy("source_file", "start").orderBy("i")
    has = F.col("line").rlike(tag)
    d = d.withColumns({"tag": F.when(has, F.regexp_extract("line", tag, 1)), "value": F.when(has, strip(F.regexp_extract("line", tag, 2))).otherwise(strip(F.col("line"))), "blanks": F.sum(F.when(strip(F.col("line")) == "", 1).otherwise(0)).over(before)})
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(F.when(F.col("tag").isNotNull(), F.col(c)), ignorenulls=True).over(earlier)
    return d.withColumns({"last_tag": last("tag"), "last_blanks": last("blanks")}).where((F.col("value") != "") | F.col("tag").isNotNull())


def _tagged_records(lines: DataFrame, begins: Column, inside: Column) -> DataFrame:
    """(source_file, start, source_row, fields map<tag, values>, first, last): a record begins at each line that ``begins`` one; lines without a tag go on with the one before where ``inside``."""
    w = Window.partitionBy("source_file", "start").orderBy("i")
    d = lines.where(F.col("tag").isNotNull() | inside)
    d = d.withColumns({"source_row": F.sum(F.when(begins, 1).otherwise(0)).over(w), "field": F.sum(F.when(F.col("tag").isNotNull(), 1).otherwise(0)).over(w)}).where("source_row > 0")
    joined = strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]), " "))
    d = d.groupBy("source_file", "start", "source_row", "field").agg(F.max("tag").alias("tag"), joined.alias("value"))
    ends = d.groupBy("source_file", "start", "source_row").agg(F.min_by("tag", "field").alias("first"), F.max_by("tag", "field").alias("last"))
    by_tag = d.where("value != ''").groupBy("source_file", "start", "source_row", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("field", "value"))), lambda x: x["value"]).alias("v"))
    maps = by_tag.groupBy("source_file", "start", "source_row").agg(F.map_from_entries(F.collect_list(F.struct("tag", "v"))).alias("fields"))
    return ends.join(maps, ["source_file", "start", "source_row"], "left").withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,array<string>>")))


def _parts(files: DataFrame, fmt: str, start: str | None = None) -> DataFrame:
    """The texts of a format, whole files or rows of records (see :mod:`sievework.sources.ranges`); where ``start`` is given, those of files in which it matches."""
    d = files.where(F.col("format") == fmt).select("source_file", (F.col("start") if "start" in files.columns else F.lit(0)).alias("start"), "text")
    if start:
        d = d.join(d.where(F.col("text").rlike(start)).select("source_file").distinct(), "source_file", "left_semi")
    return d


def _numbered(d: DataFrame) -> DataFrame:
    """``d`` with source_row as the number of the record in its file: its place in its row, and the records of the rows before."""
    own = d.withColumn("source_row", F.row_number().over(Window.partitionBy("source_file", "start").orderBy("source_row")))
    sizes = d.groupBy("source_file", "start").agg(F.count("*").alias("n"))
    before = sizes.select("source_file", "start", (F.sum("n").over(Window.partitionBy("source_file").orderBy("start")) - F.col("n")).alias("before"))
    return own.join(before, ["source_file", "start"]).withColumn("source_row", F.col("source_row") + F.col("before")).drop("start", "before")


def _values(*tags: str) -> Column:
    """All values of some tags, in the order of the tags."""
    return F.flatten(F.array(*(F.coalesce(F.try_element_at("fields", F.lit(t)), F.array().cast("array<string>")) for t in tags)))


def _first(*tags: str) -> Column:
    """The first value of the first of the tags that has one, or nothing."""
    return F.coalesce(F.get(_values(*tags), F.lit(0)), F.lit(""))


def _all(*tags: str, join: str = "; ") -> Column:
    return F.array_join(F.array_distinct(_values(*tags)), join)


def _rest(prefix: str, used: list[str]) -> Column:
    """map<name, values> of the fields that no column takes, and of the values after a column's own."""
    single = F.map_filter("fields", lambda k, _: ~k.isin(*used))
    return F.transform_keys(single, lambda k, _: F.concat(F.lit(prefix), k))


def _record(d: DataFrame, fmt: str, extra: Column, notes: Column, **cols: Column) -> DataFrame:
    """The records table of raw fields: texts cleaned, lists tidied, DOI and year normalised; what has no column is in extra_json, as lists by name.

    A DOI that is none stays there as doi_invalid. A record with neither title nor abstract is marked EMPTY_RECORD.
    """
    raw = lambda c: cols.get(c, F.lit(""))
    d = d.select("source_file", "source_row", *(raw(c).alias(c) for c in [*TEXTS, *LISTS, "doi"]), cols["record_type"].alias("record_type"), raw("year").alias("_year"), cols.get("is_retracted", F.lit(False)).alias("is_retracted"), extra.alias("_extra"), notes.alias("import_notes"))
    d = d.withColumns({c: clean_text(F.col(c)) for c in [*TEXTS, *LISTS, "doi"]})
    d = d.withColumns({**{c: normalize_list(F.col(c)) for c in LISTS}, "_doi": normalize_doi(F.col("doi")), "year": coerce_year(F.col("_year"))})
    invalid = F.when((F.col("doi") != "") & F.col("_doi").isNull(), F.create_map(F.lit("doi_invalid"), F.array("doi")))
    more = F.map_concat("_extra", F.coalesce(invalid, F.create_map().cast("map<string,array<string>>")))
    empty = (F.col("title") == "") & (F.col("abstract") == "")
    made = {
        "study_uid": F.sha2(F.concat_ws("\n", "source_file", F.col("source_row").cast("string")), 256), "source_label": F.regexp_replace("source_file", r"\.[^.]*$", ""), "source_row": F.col("source_row").cast("long"),
        "source_format": F.lit(fmt), "abstract_quality": F.lit(""), "doi": F.coalesce("_doi", F.lit("")), "is_duplicate": F.lit(False), "duplicate_of": F.lit(""), "dedup_method": F.lit(""), "has_abstract": F.col("abstract") != "",
        "exclusion_reason": F.when(empty, "EMPTY_RECORD").otherwise(""), "exclusion_details": F.when(empty, "neither title nor abstract").otherwise(""), "has_fulltext": F.lit(False),
        "fulltext_path": F.lit(""), "fulltext_of": F.lit(""), "zip_member": F.lit(""), "extra_json": F.when(F.size(more) > 0, F.to_json(more)).otherwise(""),
    }
    return d.withColumns(made).select(*RECORD_COLUMNS)


def _types(table: dict[str, str], name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), name), F.lit("other"))


def read_ris(files: DataFrame) -> DataFrame:
    """Records of RIS texts. A record begins with TY, or with any other tag where none is open, and ends with ER; lines without a tag outside records are skipped. A file without TY has no record."""
    lines = _tagged_lines(_parts(files, "ris", r"(?m)^TY\s{1,2}-"), r"^([A-Z][A-Z0-9])\s{1,2}-\s?(.*)$")
    none_open = F.col("last_tag").isNull() | (F.col("last_tag") == "ER")
    start = (F.col("tag") == "TY") | (F.col("tag").isNotNull() & (F.col("tag") != "ER") & none_open)
    d = _tagged_records(lines.where("tag IS NULL OR tag <> 'ER' OR NOT (last_tag IS NULL OR last_tag = 'ER')"), F.coalesce(start, F.lit(False)), ~none_open)
    d = _numbered(d)
    ab, notes = F.array_distinct(_values("AB", "N2")), _values("N1")
    longest = F.get(F.array_sort(notes, lambda a, b: F.length(b) - F.length(a)), F.lit(0))
    from_note = (F.size(ab) == 0) & (F.coalesce(F.length(longest), F.lit(0)) > 200)
    kept_notes = F.when(from_note, F.array_remove(notes, F.coalesce(longest, F.lit("")))).otherwise(notes)
    urls = F.filter(F.array_distinct(_values("UR")), lambda u: u.rlike(r"(?i)^https?://\S+$"))
    sp, ep = _first("SP"), _first("EP")
    columns = {
        "title": ["TI", "T1"], "journal": ["JF", "JO", "T2", "JA", "J2"], "issn_isbn": ["SN"], "volume": ["VL", "VO"], "issue": ["IS"], "doi": ["DO"], "accession_number": ["AN"], "language": ["LA"],
    }
    used = ["TY", "ER", "AB", "N2", "N1", "AU", "A1", "A2", "PY", "Y1", "UR", "SP", "EP", "KW", *(t for ts in columns.values() for t in ts)]
    others = lambda t, chosen: F.filter(_values(t), lambda v: v != chosen)
    left = {t: others(t, _first(*ts)) for ts in columns.values() for t in ts}
    left |= {"TY": _values("TY"), "UR": F.filter(F.array_distinct(_values("UR")), lambda u: u != F.coalesce(F.get(urls, F.lit(0)), F.lit(""))), "notes": F.when(F.size(kept_notes) > 0, F.array(F.array_join(kept_notes, "; "))).otherwise(kept_notes)}
    more = F.map_filter(F.map_from_arrays(F.array(*(F.lit(k if k == "notes" else f"ris_{k}") for k in left)), F.array(*left.values())), lambda _, v: F.size(v) > 0)
    note = F.concat_ws("; ", F.when(F.col("first") != "TY", "record without TY line"), F.when(F.col("last") != "ER", "record not terminated by ER"))
    source = F.when(F.size(_values("AB")) > 0, "AB").when(F.size(ab) > 0, "N2").when(from_note, "N1").otherwise("")
    return _record(
        d, "ris", F.map_concat(_rest("ris_", used), more), note, **{c: _first(*ts) for c, ts in columns.items()}, abstract=F.when(from_note, longest).otherwise(F.array_join(ab, "\n\n")), abstract_source=source,
        authors=_all("AU", "A1"), editors=_all("A2"), keywords=_all("KW"), pages=F.when((sp != "") & (ep != "") & (sp != ep), F.concat_ws("-", sp, ep)).when(sp != "", sp).otherwise(ep),
        url=F.coalesce(F.get(urls, F.lit(0)), F.lit("")), year=F.array_join(_values("PY", "Y1", "DA"), " "), record_type=_types(RIS_TYPES, F.upper(_first("TY"))),
    )


def read_nbib(files: DataFrame) -> DataFrame:
    """Records of MEDLINE texts. A record begins with PMID, or with a tag after a blank line, which ends one; then it counts only with a title, an abstract or UID.

    UID is no tag of MEDLINE: :func:`sievework.sinks.records_as_nbib` writes it for every record, also for one that has neither number, title nor abstract. A file without PMID and UID has no record.
    """
    lines = _tagged_lines(_parts(files, "nbib", r"(?m)^(PMID *|UID )-"), r"^([A-Z][A-Za-z0-9]{1,3}) {0,2}-(?: (.*))?$")
    apart = F.col("last_tag").isNull() | (F.col("blanks") > F.col("last_blanks"))
    d = _tagged_records(lines, F.coalesce((F.col("tag") == "PMID") | (F.col("tag").isNotNull() & apart), F.lit(False)), ~apart)
    d = d.where((F.col("first") == "PMID") | (F.size(_values("TI", "AB", "UID")) > 0))
    d = _numbered(d)
    ids = _values("LID", "AID")
    marked = F.transform(F.filter(ids, lambda x: x.rlike(r"(?i)\[doi\]\s*$")), lambda x: strip(F.regexp_replace(x, r"(?i)\s*\[doi\]\s*$", "")))
    doi = F.coalesce(F.get(marked, F.lit(0)), F.lit(""))
    others = F.array_distinct(F.filter(ids, lambda x: strip(F.regexp_replace(x, r"(?i)\s*\[doi\]\s*$", "")) != doi))
    types = F.array_distinct(_values("PT"))
    withdrawn = F.array_intersect(types, F.array(F.lit("Retracted Publication"), F.lit("Retraction of Publication")))
    title = F.when(_first("TI") != "", _first("TI")).otherwise(_first("TT"))
    retracted = (F.size(withdrawn) > 0) | title.rlike(r"(?i)^\s*retracted\s*:")
    note = F.concat_ws("; ", F.when((_first("TI") == "") & (_first("TT") != ""), "title taken from TT (translated title)"), F.when(retracted, F.concat(F.lit("retraction: "), F.when(F.size(withdrawn) > 0, F.array_join(withdrawn, "; ")).otherwise("title starts with 'Retracted:'"))))
    columns = {"pmid": ["PMID"], "volume": ["VI"], "issue": ["IP"], "pages": ["PG"], "pmcid": ["PMC"]}
    used = ["PT", "TI", "AB", "FAU", "AU", "JT", "TA", "LID", "AID", "LA", "MH", "OT", *(t for ts in columns.values() for t in ts)]
    more = F.map_filter(F.map_from_arrays(F.array(*(F.lit(f"nbib_{t}") for ts in columns.values() for t in ts), F.lit("nbib_AID")), F.array(*(F.slice(_values(t), F.lit(2), F.lit(1 << 30)) for ts in columns.values() for t in ts), others)), lambda _, v: F.size(v) > 0)
    return _record(
        d, "nbib", F.map_concat(_rest("nbib_", used), more), note, **{c: _first(*ts) for c, ts in columns.items()}, title=title, abstract=_all("AB", join="\n\n"), abstract_source=F.when(_first("AB") != "", "AB").otherwise(""),
        authors=F.when(_all("FAU") != "", _all("FAU")).otherwise(_all("AU")), journal=_first("JT", "TA"), keywords=_all("OT"), keywords_mesh=_all("MH"), language=_all("LA"), publication_types=F.array_join(types, "; "),
        doi=doi, year=F.array_join(_values("DP"), " "), is_retracted=retracted, record_type=F.when(F.array_contains(types, "Journal Article"), "journal_article").otherwise("other"),
    )


_ENTRY = re.compile(r"(?m)^[ \t]*@([A-Za-z]+)[ \t]*([{(])")
#: What parts a value: brackets, quotes, a joint, white space, or a bare word.
_TOKEN = re.compile(r"[{}]|\"|#|,|[^{}\"#,\s]+|\s+")
#: Month names, which stand for their numbers.
MONTHS = {m: str(k) for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}


def bib_fields(body: str, macros: dict[str, str]) -> list[tuple[str, str]]:
    """(name, value) of the fields of an entry's body: braces nest, quotes end outside braces, ``#`` joins parts, and bare words may be macros or months."""
    out: list[tuple[str, str]] = []
    at = 0
    while (eq := body.find("=", at)) >= 0:
        name = "_".join(body[at:eq].replace(",", " ").split()).lower()
        parts, depth, quoted, begin, joint, at = [], 0, False, -1, True, len(body)
        for m in _TOKEN.finditer(body, eq + 1):
            t = m[0]
            if depth or quoted:
                depth += (t == "{") - (t == "}")
                if not depth and (t == '"' if quoted else t == "}"):
                    parts.append(body[begin : m.start()])
                    quoted = False
            elif t.isspace():
                continue
            elif t == "#":
                joint = True
            elif t == "," or t == "}" or not joint:  # the value is over
                at = m.end() if t in ",}" else m.start()
                break
            else:
                joint = False
                if t in '{"':
                    depth, quoted, begin = int(t == "{"), t == '"', m.end()
                else:
                    parts.append(macros.get(t.lower()) or MONTHS.get(t.lower(), t))
        if depth or quoted:
            parts.append(body[begin:])
        if name:
            out.append((name, "".join(parts)))
    return out


def bib_entries(text: str) -> Iterator[tuple[str, str, bool, list[tuple[str, str]]]]:
    """(type, key, whether its brackets match, fields) of the entries of a BibTeX text; one whose brackets do not match ends where the next begins."""
    starts = list(_ENTRY.finditer(text))
    macros: dict[str, str] = {}
    for m, nxt in zip(starts, [*starts[1:], None], strict=True):
        limit, kind = nxt.start() if nxt else len(text), m[1].lower()
        end = -1
        if m[2] == "(":
            end = text.rfind(")", m.end(), limit)
        else:
            depth = 1
            for b in re.finditer(r"[{}]", text[m.end() : limit]):
                depth += 1 if b[0] == "{" else -1
                if not depth:
                    end = m.end() + b.start()
                    break
        body = text[m.end() : end if end >= 0 else limit]
        if kind == "string":
            macros |= dict(bib_fields(body, macros))
        elif kind not in ("preamble", "comment"):
            comma, equals = body.find(","), body.find("=")
            key = body[:comma].strip() if comma >= 0 and not 0 <= equals < comma else ""
            yield kind, key, end >= 0, bib_fields(body[comma + 1 :] if key or comma >= 0 and not 0 <= equals < comma else body, macros)


@F.pandas_udf(StringType())
def macro_entries(texts: pd.Series) -> pd.Series:
    """The @string entries of BibTeX texts."""

    def of(text: str) -> str:
        at = [*(m.start() for m in _ENTRY.finditer(text)), len(text)]
        return "\n".join(text[a:b] for a, b in zip(at, at[1:], strict=False) if text[a:b].lstrip().lower().startswith("@string"))

    return texts.map(of)


def people(value: str) -> list[str]:
    """Names parted by ``and`` outside braces."""
    names, depth, own = [], 0, []
    for word in value.split():
        if word.lower() == "and" and not depth:
            names.append(" ".join(own))
            own = []
        else:
            depth += word.count("{") - word.count("}")
            own.append(word)
    return [n for n in [*names, " ".join(own)] if n]


def read_bibtex(files: DataFrame) -> DataFrame:
    """Records of BibTeX texts; macros and months are resolved, LaTeX escapes undone, local file paths left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, start, text, strings in zip(b.source_file, b.start, b.text, b.strings, strict=True):
                for k, (kind, key, whole, fields) in enumerate(bib_entries(f"{strings or ''}\n{text}"), 1):
                    own: dict[str, list[str]] = {"bib_type": [kind]} | ({"bib_key": [key]} if key else {})
                    for f, v in fields:
                        if v.strip():
                            own.setdefault(f, []).extend(people(v) if f in ("author", "editor") else [v.strip()])
                    rows.append((name, start, k, own, whole))
            yield pd.DataFrame(rows, columns=["source_file", "start", "source_row", "fields", "whole"])

    parts = _parts(files, "bib")
    if "start" in files.columns:  # macros hold in the rows behind their own too
        named = parts.where(F.lower("text").contains("@string")).select("source_file", F.col("start").alias("at"), macro_entries("text").alias("macro"))
        earlier = parts.select("source_file", "start").join(named, "source_file").where("at < start")
        earlier = earlier.groupBy("source_file", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "macro"))), lambda x: x["macro"]), "\n").alias("strings"))
        parts = parts.join(earlier, ["source_file", "start"], "left")
    else:
        parts = parts.withColumn("strings", F.lit(""))
    d = parts.select("source_file", "start", "text", "strings").mapInPandas(run, "source_file string, start long, source_row long, fields map<string,array<string>>, whole boolean")
    d = _numbered(d)
    unlatex = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\([&%$#_])", "$1"), r"[{}]", "")
    names = lambda t: F.array_join(F.array_distinct(F.transform(_values(t), unlatex)), "; ")
    tags = {
        "volume": ["volume"], "issue": ["number"], "doi": ["doi"], "pmid": ["pmid"], "pmcid": ["pmcid"], "accession_number": ["accession_number"], "language": ["language", "langid"], "publication_types": ["publication_type"],
        "title": ["title"], "journal": ["journal", "journaltitle", "booktitle"], "url": ["url"], "issn_isbn": ["issn", "isbn"],
    }
    plain = {c: _first(*ts) if c in ("doi", "url", "issn_isbn") else unlatex(_first(*ts)) for c, ts in tags.items()}
    year = F.when(F.regexp_count(_first("year"), F.lit(r"\b(1[4-9][0-9]{2}|20[0-9]{2}|2100)\b")) > 0, _first("year")).otherwise(_first("date"))
    registry = F.regexp_like(names("author"), F.lit(r"(?i)^\s*NCT[0-9]+\s*,?\s*$")) & F.regexp_like(plain["journal"], F.lit("(?i)^https?://"))
    used = ["title", "abstract", "author", "editor", "pages", "keywords", "file", "bib_type", "bib_key", *(ts[0] for ts in tags.values())]
    note = F.concat_ws("; ", F.when(F.size(_values("file")) > 0, "file field (local path) was not imported"), F.when(registry, "trial registry entry: author field held only the registry number"), F.when(~F.col("whole"), "entry has unbalanced braces; read up to the next entry"))
    more = F.map_filter("fields", lambda k, _: k.isin("bib_type", "bib_key"))
    words = F.filter(F.transform(F.split(unlatex(_first("keywords")), r"\s*[;,]\s*"), strip), lambda x: x != "")
    return _record(
        d, "bib", F.map_concat(_rest("bib_", used), more), note, **plain, abstract=F.regexp_replace(_first("abstract"), r"\\([&%$#_{}])", "$1"), abstract_source=F.when(_first("abstract") != "", "AB").otherwise(""),
        authors=F.when(registry, "").otherwise(names("author")), editors=names("editor"), keywords=F.array_join(F.array_distinct(words), "; "), pages=F.regexp_replace(unlatex(_first("pages")), r"\s*(?:--+|–|—)\s*", "-"), year=year,
        record_type=F.when(registry, "trial_registry").otherwise(_types(BIBTEX_TYPES, _first("bib_type"))),
    )


#: Headers of tables, without case, spaces, underscores and dashes, by field, the preferred first.
HEADERS = {
    "title": ["title", "titel", "ti", "t1", "articletitle", "documenttitle", "primarytitle"],
    "abstract": ["abstract", "zusammenfassung", "ab", "n2", "abstractnote", "summary"],
    "authors": ["authors", "autoren", "author", "au", "a1", "authorfullnames"],
    "year": ["year", "jahr", "py", "publicationyear", "publishedyear", "date"],
    "journal": ["journal", "zeitschrift", "sourcetitle", "publicationtitle", "jo", "jf", "t2", "journalname"],
    "doi": ["doi", "do", "digitalobjectidentifier"],
    "pmid": ["pmid", "pubmedid"],
    "keywords": ["keywords", "schlagwörter", "schlagworter", "kw", "authorkeywords"],
    "url": ["url", "link", "ur"],
}


def unique_headers(names: list[str]) -> list[str]:
    """Trimmed headers; empty ones are ``col_N``, repeated ones get a number."""
    out: list[str] = []
    for k, name in enumerate(names, 1):
        clean = (name or "").strip() or f"col_{k}"
        n = sum(o == clean or re.fullmatch(re.escape(clean) + r"_[0-9]+", o) is not None for o in out)
        out.append(f"{clean}_{n + 1}" if clean in out else clean)
    return out


def read_delimited(files: DataFrame, sep: str | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """Records of delimited tables with headers; ``columns`` names the header of a field, ``sep`` the delimiter (else the one that parts most lines alike).

    A table with neither title nor abstract, or without a named header, is an error (E104). Rows of blank cells are left out; source_row counts the others.
    Cells of columns that no field takes are kept in extra_json. A file is one task.
    """
    columns = columns or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(1 << 30)
        for b in batches:
            rows = []
            for name, text in zip(b.source_file, b.text, strict=True):
                table = (row for row in csv.reader(io.StringIO(text), delimiter=sep or best_delimiter(text) or ",") if any(c.strip() for c in row))
                headers = unique_headers(next(table, []))
                plain = [re.sub(r"[\s_-]+", "", h.lower()) for h in headers]
                for f, h in columns.items():
                    if f not in HEADERS or h not in headers:
                        raise ValueError(f"E104: no column {h!r} for {f!r}")
                place = {f: headers.index(columns[f]) if f in columns else next((plain.index(h) for h in hs if h in plain), None) for f, hs in HEADERS.items()}
                if place["title"] is None and place["abstract"] is None:
                    raise ValueError("E104: no column for title or abstract")
                taken = {k: f for f, k in place.items() if k is not None}
                for k, row in enumerate(table, 1):
                    own = {taken.get(i, f"col_{headers[i]}"): [re.sub(r"^([0-9]+)\.0+$", r"\1", v.strip()) if taken.get(i) in ("pmid", "doi") else v] for i, v in enumerate(row[: len(headers)]) if v.strip()}
                    rows.append((name, k, own))
            yield pd.DataFrame(rows, columns=["source_file", "source_row", "fields"])

    d = files.where("format = 'csv'").select("source_file", "text").mapInPandas(run, "source_file string, source_row long, fields map<string,array<string>>")
    return _record(d, "csv", _rest("", list(HEADERS)), F.lit(""), **{f: _first(f) for f in HEADERS}, abstract_source=F.when(_first("abstract") != "", "AB").otherwise(""), record_type=F.lit("other"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all RIS, MEDLINE, BibTeX and delimited files at a path; files of other kinds are an error (E101), empty ones too (E102)."""
    files = read_files(spark, path)
    wrong = F.when(F.col("format").isin("pdf", "zip", "xlsx"), "E101").when(F.col("format").isin("E101", "E102"), F.col("format"))
    checked = files.withColumn("format", F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(": "), F.col("source_file"))).cast("string")).otherwise(F.col("format")))
    return read_ris(checked).unionByName(read_nbib(checked)).unionByName(read_bibtex(checked)).unionByName(read_delimited(checked))
