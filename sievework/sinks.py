"""Sinks: exports of records and tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import neutralise_formula, split_list, strip
from sievework.schemas import BIBTEX_TYPES, BOOLEANS, RECORD_COLUMNS, RIS_TYPES


def _items(*columns: str) -> Column:
    """The items of semicolon lists, in order."""
    return F.flatten(F.array(*(split_list(F.col(c)) for c in columns)))


def _one_line(value: Column) -> Column:
    return strip(F.regexp_replace(value, r"(?U)\s+", " "))


def _lines(prefix: str, value: Column) -> Column:
    """A line for each item of an array that is not blank."""
    return F.transform(F.filter(value, lambda v: strip(F.coalesce(v, F.lit(""))) != ""), lambda v: F.concat(F.lit(prefix), _one_line(v)))


def _one(column: str) -> Column:
    return F.array(F.coalesce(F.col(column).cast("string"), F.lit("")))


def _notes() -> Column:
    """What an export says of a record that is not screened."""
    return F.array_compact(
        F.array(
            F.when(F.coalesce("exclusion_reason", F.lit("")) != "", F.concat(F.lit("Excluded before screening: "), "exclusion_reason")),
            F.when(F.col("is_duplicate") & (F.col("duplicate_of") != ""), F.concat(F.lit("Duplicate of: "), "duplicate_of")), F.when(F.col("is_retracted"), F.lit("Retracted publication")),
        )
    )


def _named(table: dict[str, str], other: str) -> Column:
    """The written name of record_type: the first name of a type."""
    first: dict[str, str] = {}
    for name, kind in table.items():
        first.setdefault(kind, name)
    first["other"] = other
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in first.items() for x in pair)), F.col("record_type")), F.lit(other))


def records_as_ris(records: DataFrame) -> DataFrame:
    """(study_uid, ris): each record of a whole records table as a RIS block; empty fields have no line."""
    start, end = F.substring_index("pages", "-", 1), F.when(F.contains(F.col("pages"), F.lit("-")), F.regexp_replace("pages", "^[^-]*-", "")).otherwise("")
    number = F.when(F.coalesce("pmid", F.lit("")) != "", F.col("pmid")).otherwise(F.col("accession_number"))
    parts = [
        F.array(F.concat(F.lit("TY  - "), _named(RIS_TYPES, "GEN"))), _lines("ID  - ", _one("study_uid")), _lines("TI  - ", _one("title")), _lines("AU  - ", _items("authors")), _lines("A2  - ", _items("editors")),
        _lines("PY  - ", _one("year")), _lines("JO  - ", _one("journal")), _lines("VL  - ", _one("volume")), _lines("IS  - ", _one("issue")), _lines("SP  - ", F.array(start)), _lines("EP  - ", F.array(end)),
        _lines("DO  - ", _one("doi")), _lines("UR  - ", _one("url")), _lines("AN  - ", F.array(number)), _lines("SN  - ", _one("issn_isbn")), _lines("LA  - ", _items("language")), _lines("KW  - ", _items("keywords", "keywords_mesh")),
        _lines("AB  - ", _one("abstract")), _lines("N1  - ", _notes()), F.array(F.lit("ER  - ")),
    ]
    return records.select("study_uid", F.array_join(F.concat(*parts), "\n").alias("ris"))


def records_as_bibtex(records: DataFrame) -> DataFrame:
    """(study_uid, bibtex): each record of a whole records table as an entry."""
    braced = lambda v: F.regexp_replace(_one_line(v), r"([\\{}])", r"\\$1")
    field = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), braced(v), F.lit("}")))
    plain = {"year": "year", "journal": "journal", "volume": "volume", "number": "issue", "pages": "pages", "doi": "doi", "url": "url", "issn": "issn_isbn"}
    fields = [
        field("title", F.col("title")), field("author", F.array_join(_items("authors"), " and ")), *(field(n, F.col(c).cast("string")) for n, c in plain.items()), field("langid", F.array_join(_items("language"), "; ")),
        field("keywords", F.array_join(_items("keywords", "keywords_mesh"), "; ")), field("abstract", F.col("abstract")), field("note", F.array_join(_notes(), "; ")),
    ]
    head = F.concat(F.lit("@"), _named(BIBTEX_TYPES, "misc"), F.lit("{"), "study_uid", F.lit(",\n"))
    return records.select("study_uid", F.concat(head, F.array_join(F.array_compact(F.array(*fields)), ",\n"), F.lit("\n}")).alias("bibtex"))


def records_as_nbib(records: DataFrame) -> DataFrame:
    """(study_uid, nbib): each record of a whole records table as a MEDLINE block."""
    doi = F.array(F.when(F.coalesce("doi", F.lit("")) != "", F.concat("doi", F.lit(" [doi]"))).otherwise(""))
    values = [
        ("PMID", _one("pmid")), ("UID", _one("study_uid")), ("TI", _one("title")), ("FAU", _items("authors")), ("JT", _one("journal")), ("TA", _one("journal")), ("DP", _one("year")), ("VI", _one("volume")), ("IP", _one("issue")),
        ("PG", _one("pages")), ("AID", doi), ("PMC", _one("pmcid")), ("LA", _items("language")), ("MH", _items("keywords_mesh")), ("OT", _items("keywords")), ("AB", _one("abstract")),
    ]
    return records.select("study_uid", F.array_join(F.concat(*(_lines(f"{t:<4}- ", v) for t, v in values)), "\n").alias("nbib"))


def write_records(records: DataFrame, path: str) -> None:
    """A records table as CSV files: its columns in order, quotes doubled, true and false, nothing for null."""
    cells = {c: F.coalesce(F.col(c).cast("string"), F.lit("false") if c in BOOLEANS else F.lit("")) for c in RECORD_COLUMNS}
    records.select(*(v.alias(c) for c, v in cells.items())).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def table_digest(table: DataFrame) -> str:
    """A digest of a table's rows, whatever their order and partitions: sums of two hashes of each row, and their number."""
    row = F.struct(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in sorted(table.columns)))
    whole = F.to_json(row)
    sums = table.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.xxhash64(F.lit(k), whole).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"s{k}") for k in (1, 2))).first()
    return f"{sums['n']}-{sums['s1']}-{sums['s2']}"


def replace_records(records: DataFrame, path: str, backup_dir: str, keep: int = 5) -> bool:
    """Write a records table in place of the one at ``path``; whether anything was written.

    A table of the same rows stays as it is. Another one is written beside it and takes its place by a rename when it is whole; the old one becomes the newest of ``keep`` backups, unless
    the newest is the same already. A table that is being written when the job dies leaves the old one where it was.
    """
    spark = records.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    digest = table_digest(records)
    mark = lambda p: _read_mark(spark, fs, at(f"{p}/{MARK}"))
    there = fs.exists(at(path))
    if there and mark(path) == digest:
        return False
    new = f"{path.rstrip('/')}._new"
    write_records(records, new)
    out = fs.create(at(f"{new}/{MARK}"), True)
    out.write(bytearray(digest.encode()))
    out.close()
    fs.mkdirs(at(backup_dir))
    if there:
        backups = sorted(s.getPath().toString() for s in fs.listStatus(at(backup_dir)) if s.getPath().getName().startswith("records."))
        if backups and mark(backups[-1]) == mark(path) is not None:
            fs.delete(at(path), True)
        else:
            number = int(backups[-1].rsplit(".", 1)[1]) + 1 if backups else 1
            backups.append(f"{backup_dir.rstrip('/')}/records.{number:08d}")
            fs.rename(at(path), at(backups[-1]))
        for old in backups[:-keep] if keep > 0 else backups:
            fs.delete(at(old), True)
    fs.rename(at(new), at(path))
    return True


#: The file in a table's folder that has its digest.
MARK = "_digest"


def _read_mark(spark, fs, path) -> str | None:
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def guarded_cells(table: DataFrame) -> DataFrame:
    """``table`` with all text cells safe to open in a spreadsheet."""
    return table.select(*(neutralise_formula(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in table.schema))


def write_csv(table: DataFrame, path: str) -> None:
    """CSV files with header, quotes doubled, CRLF line ends and guarded cells; UTF-8 without a mark, as Spark writes parts of one table."""
    guarded_cells(table).write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def write_text_blocks(blocks: DataFrame, column: str, path: str) -> None:
    """Text files of one block after another, with an empty line between."""
    blocks.select(F.concat(F.col(column), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
