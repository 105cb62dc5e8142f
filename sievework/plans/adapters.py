"""Domain tables of the library derived from the sample tables; the same expressions serve Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RECORDS = [
    "doc_id AS import_order",
    "concat('d', CAST(doc_id AS STRING)) AS study_uid",
    "source AS source_label",
    "CASE WHEN doc_id % 61 = 0 THEN 'Table of Contents' ELSE split_part(text, chr(10), 1) END AS title",
    "CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, CAST(instr(text, chr(10)) AS INT) + 1) ELSE '' END AS abstract",
    "CASE WHEN doc_id % 3 = 0 THEN concat('10.1234/', md5(text)) ELSE '' END AS doi",
    "CASE WHEN doc_id % 4 = 1 THEN CAST(doc_id % 400 AS STRING) ELSE '' END AS pmid",
    "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(1990 + doc_id % 35 AS INT) END AS year",
    "CASE WHEN doc_id % 13 = 0 THEN concat(lang, '; english') ELSE lang END AS language",
    "CASE doc_id % 5 WHEN 0 THEN 'Journal Article' WHEN 1 THEN 'Review' WHEN 2 THEN 'Letter;  Comment' WHEN 3 THEN 'editorial' ELSE '' END AS publication_types",
    "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Doe, Jane; Roe, R' WHEN 2 THEN 'Jané Doe; Roe, R' ELSE 'Poe, E' END AS authors",
    "CASE WHEN doc_id % 6 = 0 THEN concat('topic ', lang, '; license') WHEN doc_id % 6 = 1 THEN concat('topic ', lang) ELSE '' END AS keywords",
    "CASE WHEN doc_id % 10 = 3 THEN 'Humans; Licensure' ELSE '' END AS keywords_mesh",
    "doc_id % 97 = 0 AS is_retracted",
    "CASE WHEN doc_id % 101 = 0 THEN concat('d', CAST(doc_id + 1 AS STRING)) ELSE '' END AS fulltext_of",
    "CASE WHEN doc_id % 89 = 0 THEN 'AI_PREFILTER_JEV' ELSE '' END AS exclusion_reason",
    "'' AS exclusion_details",
]

RESULTS = [
    "'run1' AS run_id",
    "doc_id * 2 + k AS line_no",
    "concat('d', CAST(doc_id AS STRING)) AS study_uid",
    "CASE WHEN (doc_id + k) % 11 <= 7 THEN 'ok' WHEN (doc_id + k) % 11 = 8 THEN 'parse_error' WHEN (doc_id + k) % 11 = 9 THEN 'api_error' ELSE 'truncated' END AS status",
    "CASE WHEN (doc_id + k) % 11 > 7 THEN '' WHEN (doc_id + k) % 3 = 0 THEN 'INCLUDE' WHEN (doc_id + k) % 3 = 1 THEN 'EXCLUDE' ELSE 'UNCERTAIN' END AS decision",
    "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 6 <> 0 END AS consistent",
    "CASE WHEN doc_id % 9 = 0 THEN 'quote_unverified;inconsistent' WHEN doc_id % 9 = 1 THEN 'length_retry' ELSE '' END AS flags",
    "CAST(length(text) AS BIGINT) AS tokens_in",
    "doc_id % 70 + 30 AS tokens_out",
    "CASE WHEN doc_id % 19 = 0 THEN NULL ELSE CAST(doc_id % 50 AS DOUBLE) / 1000 END AS cost",
    "CAST(doc_id % 500 AS DOUBLE) / 10 AS latency_s",
    "CAST(floor(doc_id / 100) AS INT) AS batch",
]

EVENTS = [
    "event_id AS position",
    "CASE event_type WHEN 'signup' THEN 'SOURCE_IMPORTED' WHEN 'purchase' THEN 'DEDUP_WITHIN_SOURCE' WHEN 'error' THEN 'DEDUP_GLOBAL' WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'SCREEN_TA' ELSE 'PREFILTER' END WHEN 'click' THEN 'VALIDITY' ELSE 'SCREEN_FT' END AS event_type",
    "concat('s', CAST(user_id % 4 AS STRING)) AS source_label",
    "CAST(user_id AS STRING) AS run_id",
    "CAST(greatest(floor(value), 0) AS BIGINT) AS n",
    "CAST(user_id % 5 AS BIGINT) AS m",
]


RUNS = [
    "CASE n_nationkey WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'run1' ELSE concat('r', CAST(n_nationkey AS STRING)) END AS run_id",
    "CASE n_nationkey % 5 WHEN 0 THEN 'full' WHEN 1 THEN 'sample' WHEN 2 THEN 'adjudication' ELSE 'full' END AS kind",
]

WHOLE = [
    "study_uid", "source_label", "concat(source_label, '.ris') AS source_file", "import_order + 1 AS source_row", "'ris' AS source_format",
    "CASE import_order % 5 WHEN 0 THEN 'journal_article' WHEN 1 THEN 'book_chapter' WHEN 2 THEN 'thesis' WHEN 3 THEN 'other' ELSE 'trial_registry' END AS record_type",
    "title", "abstract", "CASE WHEN abstract <> '' THEN 'AB' ELSE '' END AS abstract_source", "'' AS abstract_quality", "authors", "CASE WHEN import_order % 9 = 0 THEN 'Ed, A' ELSE '' END AS editors",
    "year", "CASE WHEN import_order % 2 = 0 THEN 'J  Test' ELSE '' END AS journal", "CASE WHEN import_order % 3 = 0 THEN '12' ELSE '' END AS volume", "'' AS issue",
    "CASE import_order % 3 WHEN 0 THEN '1-9' WHEN 1 THEN 'e5' ELSE '' END AS pages", "doi", "pmid", "'' AS pmcid", "CASE WHEN import_order % 8 = 0 THEN 'A{1}' ELSE '' END AS accession_number", "'' AS issn_isbn",
    "CASE WHEN import_order % 4 = 0 THEN 'https://x.org/a' ELSE '' END AS url", "language", "keywords", "keywords_mesh", "publication_types", "is_retracted", "import_order % 7 = 0 AS is_duplicate",
    "CASE WHEN import_order % 7 = 0 THEN 'd1' ELSE '' END AS duplicate_of", "'' AS dedup_method", "trim(abstract) <> '' AS has_abstract", "exclusion_reason", "exclusion_details", "false AS has_fulltext",
    "'' AS fulltext_path", "fulltext_of", "'' AS zip_member", "'' AS import_notes", "'' AS extra_json",
]

LOG = [
    "event_id AS position",
    "CASE event_type WHEN 'signup' THEN 'SOURCE_IMPORTED' WHEN 'purchase' THEN 'DEDUP_WITHIN_SOURCE' WHEN 'error' THEN 'DEDUP_GLOBAL' WHEN 'view' THEN 'INFO' WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'MERGE_ALL_SOURCES' WHEN 1 THEN 'SCREEN_TA' ELSE 'SCREEN_FT' END ELSE 'OTHER' END AS event_type",
    "CASE WHEN event_id % 2 = 0 THEN concat('s', CAST(user_id % 4 AS STRING)) END AS source_label",
    "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS run_id",
    "CASE event_type WHEN 'signup' THEN concat('{\"records_identified\":', CAST(user_id % 9 AS STRING), ',\"source_label\":\"s', CAST(user_id % 4 AS STRING), '\"}')"
    " WHEN 'purchase' THEN concat('{\"source_label\":\"s', CAST(user_id % 4 AS STRING), '\",\"removed\":\"', CAST(user_id % 5 AS STRING), '\"}')"
    " WHEN 'error' THEN concat('{\"before\":', CAST(user_id + 9 AS STRING), ',\"after\":', CAST(user_id AS STRING), ',\"removed\":9}')"
    " WHEN 'click' THEN CASE WHEN event_id % 3 > 0 THEN concat('{\"included\":', CAST(user_id % 5 AS STRING), ',\"excluded\":1,\"reasons\":{\"wrong population\":1}}') ELSE concat('{\"merged_records_before_global_dedup\":', CAST(user_id AS STRING), '.7}') END"
    " WHEN 'view' THEN CASE event_id % 4 WHEN 0 THEN concat('{\"kind\":\"prefilter\",\"by_reason\":{\"PREFILTER_YEAR\":', CAST(user_id % 3 AS STRING), ',\"PREFILTER_TYPE\":true}}')"
    " WHEN 1 THEN concat('{\"kind\":\"validity\",\"missing_count\":-4,\"by_reason\":{\"RETRACTED\":', CAST(user_id % 2 AS STRING), '}}')"
    " WHEN 2 THEN concat('{\"kind\":\"ai_prefilter_jev\",\"by_reason\":{\"AI_PREFILTER_JEV\":', CAST(user_id % 6 AS STRING), '}}') ELSE 'no json' END"
    " ELSE '' END AS payload",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr(*RECORDS)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two result lines of each record in one run; the second is the later."""
    return read(spark, sf_dir, "documents").selectExpr("*", "explode(array(0, 1)) AS k").selectExpr(*RESULTS)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over the labelled records."""
    return read(spark, sf_dir, "labels").selectExpr(
        "concat('d', CAST(doc_id AS STRING)) AS study_uid",
        "explode(map('a', quality = 1, 'b', toxic = 1, 'c', doc_id % 3 = 0)) AS (run_id, yes)",
    ).selectExpr("run_id", "study_uid", "CASE WHEN yes THEN 'INCLUDE' ELSE 'EXCLUDE' END AS decision")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of several kinds, some without results."""
    return read(spark, sf_dir, "nation").selectExpr(*RUNS)


def whole_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A records table with all its columns."""
    return records(spark, sf_dir).selectExpr(*WHOLE)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an event log with payloads in JSON, odd ones among them."""
    return read(spark, sf_dir, "events").selectExpr(*LOG)


def prisma_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(*EVENTS)


SQL_RECORDS = f"records AS (SELECT {', '.join(RECORDS)} FROM documents)"
SQL_RESULTS = f"results AS (SELECT {', '.join(RESULTS)} FROM (SELECT *, unnest([0, 1]) AS k FROM documents))"
SQL_DECISIONS = """decisions AS (
  SELECT run_id, study_uid, CASE WHEN yes THEN 'INCLUDE' ELSE 'EXCLUDE' END AS decision FROM (
    SELECT 'a' AS run_id, 'd' || doc_id AS study_uid, quality = 1 AS yes FROM labels UNION ALL
    SELECT 'b', 'd' || doc_id, toxic = 1 FROM labels UNION ALL SELECT 'c', 'd' || doc_id, doc_id % 3 = 0 FROM labels))"""
SQL_EVENTS = f"ev AS (SELECT {', '.join(EVENTS)} FROM events)"
#: DuckDB form of a normalised title.
SQL_TITLE = r"trim(regexp_replace(strip_accents(replace(lower({0}), 'ß', 'ss')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
SQL_RUNS = f"runs AS (SELECT {', '.join(RUNS)} FROM nation)"
SQL_WHOLE = f"whole AS (SELECT {', '.join(WHOLE)} FROM records)"
SQL_LOG = f"log AS (SELECT {', '.join(LOG)} FROM events)"
