"""Text normalisers as Column expressions, and the few that need Unicode tables as Arrow UDFs."""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Languages by ISO 639-2/B code, with names and codes that records use for them.
LANGUAGES = {
    "eng": ["en", "eng", "english"],
    "ger": ["de", "ger", "deu", "german", "deutsch"],
    "fre": ["fr", "fre", "fra", "french", "français", "francais"],
    "spa": ["es", "spa", "spanish", "español", "espanol"],
    "ita": ["it", "ita", "italian", "italiano"],
    "dut": ["nl", "dut", "nld", "dutch", "nederlands"],
    "por": ["pt", "por", "portuguese", "português", "portugues"],
    "rus": ["ru", "rus", "russian"],
    "chi": ["zh", "chi", "zho", "chinese"],
    "jpn": ["ja", "jpn", "japanese"],
    "kor": ["ko", "kor", "korean"],
    "swe": ["sv", "swe", "swedish"],
    "dan": ["da", "dan", "danish"],
    "nor": ["no", "nor", "norwegian"],
    "fin": ["fi", "fin", "finnish"],
    "pol": ["pl", "pol", "polish"],
    "cze": ["cs", "cze", "ces", "czech"],
    "tur": ["tr", "tur", "turkish"],
    "ara": ["ar", "ara", "arabic"],
    "heb": ["he", "heb", "hebrew"],
    "gre": ["el", "gre", "ell", "greek"],
    "hun": ["hu", "hun", "hungarian"],
    "rum": ["ro", "rum", "ron", "romanian"],
    "lat": ["la", "lat", "latin"],
}

#: Words for an unknown language.
UNKNOWN_LANGUAGES = ["und", "undetermined", "mul", "multiple", "zxx", "unk", "unknown", "nan", "null", "none", "n/a"]

#: Normalised titles of front and back matter.
NOT_SCREENABLE = [
    "front matter", "frontmatter", "back matter", "backmatter", "index", "author index", "subject index",
    "table of contents", "contents", "cover", "cover page", "title page", "copyright page",
]

_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{1,31});")
WORD_BREAK = r"[^\p{L}\p{N}]+"


#: Control characters that go; tabs and line ends are white space.
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]+"
#: White space by Unicode.
_BLANK = r"[\t\n\r \x{85}\p{Z}]+"


def _combining() -> str:
    """A pattern of the characters with a canonical combining class."""
    marks = [c for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))]
    starts = [c for c in marks if not unicodedata.combining(chr(c - 1))]
    ends = [c for c in marks if not unicodedata.combining(chr(c + 1))]
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True)) + "]+"


_COMBINING = _combining()


def clean_array(texts: pa.Array, single_line: bool = True) -> pa.Array:
    """HTML entities resolved, control characters dropped, composed (NFC), white space collapsed or, for several lines, cut at the ends; null is empty."""
    texts = texts.fill_null("")
    if pc.any(pc.match_substring(texts, "&")).as_py():
        texts = pa.array([html.unescape(x) if "&" in x and _ENTITY.search(x) else x for x in texts.to_pylist()], texts.type)
    texts = pc.replace_substring_regex(texts, _CONTROL, "")
    if not pc.all(pc.string_is_ascii(texts)).as_py():
        texts = pa.array([unicodedata.normalize("NFC", x) for x in texts.to_pylist()], texts.type)
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(texts, _BLANK, " ") if single_line else texts)


@F.arrow_udf(StringType())
def clean_text(texts: pa.Array) -> pa.Array:
    """HTML entities resolved, control characters dropped, composed (NFC), white space collapsed; null is empty."""
    return clean_array(texts)


@F.arrow_udf(StringType())
def clean_lines(texts: pa.Array) -> pa.Array:
    """As clean_text, but line ends stay and white space goes at the ends only."""
    return clean_array(texts, single_line=False)


@F.arrow_udf(StringType())
def fold_text(texts: pa.Array) -> pa.Array:
    """Compatibility-decomposed (NFKD) without combining marks, case-folded; null is empty."""
    texts = texts.fill_null("")
    if pc.all(pc.string_is_ascii(texts)).as_py():
        return pc.ascii_lower(texts)
    texts = pc.replace_substring_regex(pc.utf8_normalize(texts, "NFKD"), _COMBINING, "")
    return pa.array([x.casefold() for x in texts.to_pylist()], pa.string())


def normalize_title(title: Column) -> Column:
    """Folded words joined by one space."""
    return F.trim(F.regexp_replace(fold_text(title), WORD_BREAK, " "))


def title_key(normalized: Column, min_words: int = 4) -> Column:
    """A normalised title as a key; empty if it has fewer than ``min_words`` words."""
    return F.when(F.size(F.split(normalized, " ")) >= min_words, normalized).otherwise("")


def normalize_doi(value: Column) -> Column:
    """A DOI without resolver or prefix, lower-cased, without closing punctuation; null if it has not the form of one."""
    v = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"\s+", "")
    v = F.regexp_replace(v, r"^(https?://(www\.)?(dx\.)?doi\.org/|doi:)+", "")
    v = F.regexp_replace(v, r"""[.,;)\]}>"']+$""", "")
    return F.when(v.rlike(r"^10\.[0-9]{4,9}/\S+$"), v)


def doi_key(value: Column) -> Column:
    return F.coalesce(normalize_doi(value), F.lower(F.trim(F.coalesce(value, F.lit("")))))


def coerce_year(value: Column) -> Column:
    """The first year from 1400 to 2100 in a text, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(value, F.lit("")), r"\b(1[4-9][0-9]{2}|20[0-9]{2}|2100)\b", 1), F.lit("")).cast("int")


def split_list(value: Column, pattern: str = ";") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")


def normalize_list(value: Column) -> Column:
    """The distinct items of a ``;`` list in order, joined by ``; ``."""
    return F.array_join(F.array_distinct(split_list(value)), "; ")


def first_author(authors: Column) -> Column:
    """The family name of the first author, folded: what stands before a comma, else the last word."""
    first = F.trim(F.element_at(F.split(F.coalesce(authors, F.lit("")), ";"), 1))
    family = F.when(F.contains(first, F.lit(",")), F.element_at(F.split(first, ","), 1)).otherwise(F.element_at(F.split(first, " "), -1))
    return normalize_title(family)


def block_keys(key: Column) -> Column:
    """Blocking keys of a title key: its first and last 18 characters, and its three longest words if there are three."""
    words = F.array_distinct(F.split(key, " "))
    longest = F.slice(F.array_sort(words, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), 1, 3)
    three = F.when(F.size(longest) == 3, F.concat(F.lit("w:"), F.array_join(F.array_sort(longest), " ")))
    ends = [F.concat(F.lit("s:"), F.substring(key, 1, 18)), F.concat(F.lit("e:"), F.substring(key, F.greatest(F.length(key) - 17, F.lit(1)), F.lit(18)))]
    return F.when(key != "", F.filter(F.array(*ends, three), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def language_codes(value: Column) -> Column:
    """The ISO 639-2/B codes of the languages named, distinct, in order; three lower-case letters stand for themselves."""
    table = F.create_map(*[F.lit(x) for code, names in LANGUAGES.items() for n in names for x in (n, code)])
    parts = F.filter(F.transform(F.split(F.lower(F.coalesce(value, F.lit(""))), r"[;,/|]+"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.isin(*UNKNOWN_LANGUAGES))

    def code(x: Column) -> Column:
        head = F.element_at(F.split(x, r"[-_\s(]"), 1)
        return F.coalesce(F.try_element_at(table, x), F.try_element_at(table, head), F.when(head.rlike("^[a-z]{3}$"), head))

    return F.array_distinct(F.filter(F.transform(parts, code), lambda x: x.isNotNull()))


def normalize_type(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"\s+", " "))


def abstract_quality(value: Column, short_words: int = 40) -> Column:
    """empty, ``ok``, ``short`` or ``suspect_concat`` (words run together) for an abstract."""
    text = F.coalesce(value, F.lit(""))
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), 1), F.length)
    letters = F.aggregate(runs, F.lit(0), lambda a, b: a + b)
    wide = F.length(F.regexp_replace(text, r"[^฀-๿぀-ヿ㐀-䶿一-鿿가-힯]", ""))
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return (
        F.when(F.trim(text) == "", "")
        .when(wide * 2 > letters, F.when(F.length(text) < 120, "short").otherwise("ok"))
        .when(F.coalesce(F.array_max(runs), F.lit(0)) > 40, "suspect_concat")
        .when((F.size(runs) >= 30) & (letters > F.size(runs) * 9), "suspect_concat")
        .when(words < short_words, "short")
        .otherwise("ok")
    )


def landis_koch(kappa: Column) -> Column:
    """The usual verbal label of a kappa; null stays null."""
    return (
        F.when(kappa < 0, "poor").when(kappa <= 0.2, "slight").when(kappa <= 0.4, "fair")
        .when(kappa <= 0.6, "moderate").when(kappa <= 0.8, "substantial").when(kappa.isNotNull(), "almost perfect")
    )


#: Wide characters, of which each is a token by itself, and what tokens by length are multiplied with.
WIDE, TOKEN_FACTOR = "฀-๿ᄀ-ᇿ぀-ヿ㐀-䶿一-鿿가-힯", 1.1


def token_count(text: Column, factor: float = TOKEN_FACTOR) -> Column:
    """Tokens by length: a quarter per character, one per wide character, times ``factor``; 0 for an empty text."""
    t = F.coalesce(text, F.lit(""))
    wide = F.length(F.regexp_replace(t, f"[^{WIDE}]", ""))
    size = F.ceil((wide + (F.length(t) - wide) / F.lit(4.0)) * F.lit(factor))
    return F.when(t == "", F.lit(0)).otherwise(F.greatest(F.lit(1), size)).cast("long")


def cost_of(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return tokens_in / F.lit(1000.0) * price_in + tokens_out / F.lit(1000.0) * price_out


def neutralise_formula(cell: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets an apostrophe."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def squash(text: Column) -> Column:
    """Case-folded letters, digits and underscores only, to look for quotes."""
    folded = F.translate(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss")), "ς", "σ")
    return F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", "")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def format_duration(seconds: Column) -> Column:
    """Seconds, rounded up, as ``45 s``, ``12 min`` or ``2 h 05 min``."""
    total = F.greatest(F.lit(0), F.ceil(seconds)).cast("long")
    minutes = F.ceil(total / 60).cast("long")
    hours = F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit(" min"))
    return F.when(total < 60, F.concat(total.cast("string"), F.lit(" s"))).when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(hours)


def cell(value: Column) -> Column:
    """A value as text of an exported table: nothing for null, true and false for booleans."""
    return F.coalesce(value.cast("string"), F.lit(""))


def percent(part: Column, whole: Column) -> Column:
    """The share of ``part`` as ``75 %``; ``-`` of nothing."""
    return F.when(whole == 0, "-").otherwise(F.concat(F.bround(part * 100.0 / whole).cast("long").cast("string"), F.lit(" %")))


def outcome(reason: Column, status: Column, decision: Column) -> Column:
    """The outcome of a record from its exclusion reason and its last result."""
    return (
        F.when(F.coalesce(reason, F.lit("")) != "", "PRE_EXCLUDED").when(F.coalesce(status, F.lit("")) == "", "NOT_SCREENED")
        .when((status != "ok") | ~F.coalesce(decision, F.lit("")).isin("INCLUDE", "EXCLUDE", "UNCERTAIN"), "ERROR").otherwise(decision)
    )
