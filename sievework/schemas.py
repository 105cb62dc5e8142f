"""The records table and the values its columns may have."""

from __future__ import annotations

#: The columns of a records table, in order.
RECORD_COLUMNS = [
    "study_uid", "source_label", "source_file", "source_row", "source_format", "record_type", "title", "abstract", "abstract_source", "abstract_quality",
    "authors", "editors", "year", "journal", "volume", "issue", "pages", "doi", "pmid", "pmcid",
    "accession_number", "issn_isbn", "url", "language", "keywords", "keywords_mesh", "publication_types", "is_retracted", "is_duplicate", "duplicate_of",
    "dedup_method", "has_abstract", "exclusion_reason", "exclusion_details", "has_fulltext", "fulltext_path", "fulltext_of", "zip_member", "import_notes", "extra_json",
]
BOOLEANS = ["is_retracted", "is_duplicate", "has_abstract", "has_fulltext"]
INTEGERS = ["source_row", "year"]

#: Text columns that are cleaned to one line, and lists joined by semicolons.
TEXTS = ["title", "abstract", "abstract_source", "journal", "volume", "issue", "pages", "pmid", "pmcid", "accession_number", "issn_isbn", "url", "language"]
LISTS = ["authors", "editors", "keywords", "keywords_mesh", "publication_types"]

#: Record types by RIS type, in the order in which a type's first name is the one that is written.
RIS_TYPES = {
    "JOUR": "journal_article", "EJOUR": "journal_article", "MGZN": "journal_article", "NEWS": "journal_article",
    "CONF": "conference_paper", "CPAPER": "conference_paper", "CHAP": "book_chapter", "ECHAP": "book_chapter",
    "BOOK": "book", "EBOOK": "book", "RPRT": "report", "GEN": "other", "UNPB": "preprint", "THES": "thesis", "DISS": "thesis",
    "ELEC": "web", "WEB": "web", "BLOG": "web", "CTLG": "dataset", "DATA": "trial_registry",
}
#: Record types by BibTeX entry.
BIBTEX_TYPES = {
    "article": "journal_article", "book": "book", "incollection": "book_chapter", "inbook": "book_chapter",
    "inproceedings": "conference_paper", "conference": "conference_paper", "proceedings": "conference_paper",
    "techreport": "report", "phdthesis": "thesis", "mastersthesis": "thesis", "unpublished": "preprint",
    "online": "web", "electronic": "web", "www": "web", "misc": "other",
}


def spark_type(column: str) -> str:
    return "boolean" if column in BOOLEANS else "int" if column == "year" else "long" if column == "source_row" else "string"
