"""PRISMA flow numbers folded from an event log, and warnings about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an event's payload tells, as columns of :func:`event_numbers`.
NUMBERS = ["n", "m", "before", "after"]


def _count(payload: Column, path: str) -> Column:
    """A number of a payload that is not negative: whole, cut or of digits in text; anything else is 0."""
    found, kind = F.try_variant_get(payload, path, "variant"), F.schema_of_variant(F.try_variant_get(payload, path, "variant"))
    number = F.try_variant_get(found, "$", "double")
    text = F.try_variant_get(found, "$", "string")
    whole = F.when(kind.isin("BOOLEAN", "VOID"), 0).when(kind == "STRING", F.when(F.trim(text).rlike(r"^[0-9]+$"), F.trim(text).try_cast("long"))).when(~F.isnan(number) & (F.abs(number) < 9e18), number.cast("long"))
    return F.greatest(F.coalesce(whole, F.lit(0)), F.lit(0)).cast("long")


def _counts(payload: Column, path: str) -> Column:
    """map<name, number> of an object of a payload; anything else is empty."""
    found = F.try_variant_get(payload, path, "map<string,variant>")
    return F.coalesce(F.transform_values(found, lambda _, v: _count(v, "$")), F.create_map().cast("map<string,bigint>"))


def event_numbers(log: DataFrame) -> DataFrame:
    """(position, event_type, source_label, run_id, n, m, before, after, reasons) of log rows (position, event_type, source_label, run_id, payload as JSON text).

    Snapshots, which the log has as INFO events of a kind, become event types of their own: VALIDITY, PREFILTER and AI_PREFILTER. n and m are: records identified; marked
    duplicates; merged records; records without abstract and retracted ones; records removed; included and excluded ones. ``before`` and ``after`` are those of the
    last kind of deduplication (null where the payload has none). A payload that is no JSON object has no numbers.
    """
    p = F.coalesce(F.try_parse_json("payload"), F.parse_json(F.lit("{}")))
    d = log.withColumn("_p", p)
    p = F.col("_p")
    kind = F.try_variant_get(p, "$.kind", "string")
    info = F.col("event_type") == "INFO"
    named = (
        F.when(info & (kind == "validity"), "VALIDITY").when(info & (kind == "prefilter"), "PREFILTER").when(info & (kind == "ai_prefilter_jev"), "AI_PREFILTER")
        .when(F.col("event_type") == "MERGE_ALL_SOURCES", "MERGE").otherwise(F.col("event_type"))
    )
    d = d.withColumns({"event_type": named, "source_label": F.coalesce(F.try_variant_get(p, "$.source_label", "string"), F.col("source_label"), F.lit("")), "reasons": F.when(named.isin("SCREEN_TA", "SCREEN_FT"), _counts(p, "$.reasons")).otherwise(_counts(p, "$.by_reason"))})
    t = F.col("event_type")
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)
    n = (
        F.when(t == "SOURCE_IMPORTED", _count(p, "$.records_identified")).when(t.isin("DEDUP_WITHIN_SOURCE", "DEDUP_GLOBAL"), _count(p, "$.removed"))
        .when(t == "MERGE", _count(p, "$.merged_records_before_global_dedup")).when(t == "VALIDITY", _count(p, "$.missing_count"))
        .when(t.isin("PREFILTER", "AI_PREFILTER"), total(F.col("reasons"))).when(t.isin("SCREEN_TA", "SCREEN_FT"), _count(p, "$.included")).otherwise(0)
    )
    m = F.when(t == "VALIDITY", F.coalesce(F.try_element_at("reasons", F.lit("RETRACTED")), F.lit(0))).when(t.isin("SCREEN_TA", "SCREEN_FT"), _count(p, "$.excluded")).otherwise(0)
    there = lambda path: F.when(F.try_variant_get(p, path, "variant").isNotNull() & (F.schema_of_variant(F.try_variant_get(p, path, "variant")) != "VOID"), _count(p, path))
    return d.select("position", "event_type", "source_label", "run_id", n.cast("long").alias("n"), m.cast("long").alias("m"), there("$.before").alias("before"), there("$.after").alias("after"), "reasons")


def _last(kind: str, value: str) -> Column:
    """``value`` of the last event of a kind, or null."""
    return F.max_by(value, F.when(F.col("event_type") == kind, F.col("position")))


def _at(kind: str) -> Column:
    return F.coalesce(F.max(F.when(F.col("event_type") == kind, F.col("position"))), F.lit(-1))


def fold_flow(events: DataFrame, before_screening: bool = True) -> DataFrame:
    """One row of flow numbers.

    ``events`` has position, event_type, source_label, run_id and the counts n and m of its payload (see :func:`event_numbers`): records identified
    (SOURCE_IMPORTED); removed (DEDUP_WITHIN_SOURCE: the last of each label counts; DEDUP_GLOBAL, PREFILTER, AI_PREFILTER: the last); merged (MERGE: the last); missing and
    retracted (VALIDITY: the last); included and excluded (SCREEN_TA, SCREEN_FT: all of the last event's run). Filters and validity
    before the last global deduplication are stale and count as 0, but for the AI prefilter, whose marks no deduplication replaces; an import after it makes it stale. before and after of
    the last global deduplication, where ``events`` has them, are kept for :func:`flow_warnings`.
    """
    whole = events
    for c in ("before", "after"):
        if c not in events.columns:
            whole = whole.withColumn(c, F.lit(None).cast("long"))
    e = whole.withColumns({c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in ("n", "m")})
    within = e.where("event_type = 'DEDUP_WITHIN_SOURCE'").groupBy("source_label").agg(F.max_by("n", "position").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("within"))
    one = e.agg(
        F.coalesce(F.sum(F.when(F.col("event_type") == "SOURCE_IMPORTED", F.col("n"))), F.lit(0)).alias("identified"),
        *(_at(k).alias(f"at_{a}") for k, a in (("SOURCE_IMPORTED", "import"), ("DEDUP_GLOBAL", "dedup"), ("PREFILTER", "prefilter"), ("VALIDITY", "validity"))),
        F.coalesce(_last("DEDUP_GLOBAL", "n"), F.lit(0)).alias("across"), F.coalesce(_last("PREFILTER", "n"), F.lit(0)).alias("prefilter"), F.coalesce(_last("AI_PREFILTER", "n"), F.lit(0)).alias("ai_prefiltered"),
        F.coalesce(_last("VALIDITY", "n"), F.lit(0)).alias("missing"), F.coalesce(_last("VALIDITY", "m"), F.lit(0)).alias("retracted"), _last("MERGE", "n").alias("merged"),
        _last("DEDUP_GLOBAL", "before").alias("dedup_before"), _last("DEDUP_GLOBAL", "after").alias("dedup_after"),
        _last("SCREEN_TA", "run_id").alias("ta_run"), _last("SCREEN_FT", "run_id").alias("ft_run"),
        _at("SCREEN_TA").alias("ta_at"), _at("SCREEN_FT").alias("ft_at"),
    )
    one = one.crossJoin(within)  # one row each
    s = e.where("event_type IN ('SCREEN_TA', 'SCREEN_FT')").crossJoin(F.broadcast(one.select("ta_run", "ft_run", "ta_at", "ft_at")))
    mine = lambda p: (F.col("event_type") == f"SCREEN_{p.upper()}") & ((F.col("run_id") == F.col(f"{p}_run")) | (F.col(f"{p}_run").isNull() & (F.col("position") == F.col(f"{p}_at"))))
    sums = s.agg(*(F.coalesce(F.sum(F.when(mine(p), F.col(c))), F.lit(0)).alias(f"{p}_{k}") for p in ("ta", "ft") for c, k in (("n", "included"), ("m", "excluded"))))
    d = one.crossJoin(sums)
    has = F.col("at_dedup") >= 0
    stale = lambda c: has & (F.col(f"at_{c}") >= 0) & (F.col(f"at_{c}") < F.col("at_dedup"))
    d = d.withColumns(
        {
            "stale_dedup": has & (F.col("at_import") > F.col("at_dedup")), "stale_prefilter": stale("prefilter"), "stale_validity": stale("validity"),
            "prefiltered": F.when(stale("prefilter"), 0).otherwise(F.col("prefilter")) + F.when(stale("validity"), 0).otherwise(F.col("retracted")),
            "missing_abstracts": F.when(stale("validity"), 0).otherwise(F.col("missing")),
            "all_duplicates": F.least("identified", F.col("within") + F.col("across")),
        }
    )
    across_only = F.least("identified", "across")
    d = d.withColumn("duplicates_removed", F.col("all_duplicates") if before_screening else across_only)
    gone = F.col("prefiltered") + F.col("ai_prefiltered")
    return d.select(
        "identified", "duplicates_removed", (F.col("all_duplicates") - F.col("duplicates_removed") + gone).alias("removed_other"), "prefiltered", "ai_prefiltered",
        (F.col("identified") - F.col("all_duplicates")).alias("after_dedup"), F.greatest(F.lit(0), F.col("identified") - F.col("all_duplicates") - gone).alias("to_screen"),
        "missing_abstracts", (F.col("ta_included") + F.col("ta_excluded")).alias("screened"), F.col("ta_excluded").alias("excluded_ta"),
        (F.col("ft_included") + F.col("ft_excluded")).alias("assessed_ft"), F.col("ft_excluded").alias("excluded_ft"),
        F.when(F.col("ft_included") + F.col("ft_excluded") > 0, F.col("ft_included")).otherwise(F.col("ta_included")).alias("included"),
        "ta_included", "merged", F.col("within").alias("within_removed"), "dedup_before", "dedup_after", F.when(has, F.col("across")).alias("dedup_removed"), "stale_dedup", "stale_prefilter", "stale_validity",
    )


def flow_by_name(events: DataFrame) -> DataFrame:
    """(part, name, n): records identified by source, and reasons of the last PREFILTER, AI_PREFILTER (stale ones too) and of the last full-text run."""
    by_source = events.where("event_type = 'SOURCE_IMPORTED'").groupBy(F.lit("identified").alias("part"), F.col("source_label").alias("name")).agg(F.sum("n").alias("n"))
    last = events.where("event_type IN ('PREFILTER', 'AI_PREFILTER')").groupBy("event_type").agg(F.max_by("reasons", "position").alias("r"))
    snapshot = last.select(F.lower("event_type").alias("part"), F.explode("r").alias("name", "n"))
    ft = events.where("event_type = 'SCREEN_FT'")
    run = ft.agg(F.max_by("run_id", "position").alias("_run"), F.max("position").alias("_at"))
    own = ft.crossJoin(F.broadcast(run)).where((F.col("run_id") == F.col("_run")) | (F.col("_run").isNull() & (F.col("position") == F.col("_at"))))  # one row
    reasons = own.select(F.explode("reasons").alias("name", "n")).groupBy(F.lit("excluded_ft").alias("part"), "name").agg(F.sum("n").alias("n"))
    return by_source.unionByName(snapshot).unionByName(reasons)


def flow_warnings(flow: DataFrame) -> DataFrame:
    """(code): what does not fit together in a flow row; a code may come twice, for two reasons."""
    checks = [
        ("STALE_DEDUP", F.col("stale_dedup")), ("STALE_PREFILTER", F.col("stale_prefilter")), ("STALE_VALIDITY", F.col("stale_validity")),
        ("DEDUP_AFTER_EXCEEDS_BEFORE", F.col("dedup_after") > F.col("dedup_before")),
        ("ARITHMETIC_MISMATCH", F.col("dedup_after") != F.greatest(F.lit(0), F.col("dedup_before") - F.col("dedup_removed"))),
        ("ARITHMETIC_MISMATCH", ~F.col("stale_dedup") & (F.col("merged") != F.col("identified") - F.col("within_removed"))),
        ("MERGED_EXCEEDS_IDENTIFIED", F.col("merged") > F.col("identified")),
        ("SCREENED_EXCEEDS_AVAILABLE", F.col("screened") > F.col("to_screen")), ("FULLTEXT_EXCEEDS_INCLUDED", F.col("assessed_ft") > F.col("ta_included")),
    ]
    codes = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks)))
    return flow.select(F.explode(codes).alias("code"))


def flow_json(events: DataFrame, before_screening: bool = True) -> DataFrame:
    """One row (json): the flow's numbers, its warnings, the mode and the number of events."""
    flow = fold_flow(events, before_screening)
    warnings = flow_warnings(flow).agg(F.array_sort(F.collect_list("code")).alias("warnings"))
    hidden = {"ta_included", "merged", "within_removed", "dedup_before", "dedup_after", "dedup_removed", "stale_dedup", "stale_prefilter", "stale_validity"}
    numbers = flow.select(F.struct(*(c for c in flow.columns if c not in hidden)).alias("flow"))
    mode = "ALL_BEFORE_SCREENING" if before_screening else "BETWEEN_DATABASES_ONLY"
    one = numbers.crossJoin(warnings).crossJoin(events.agg(F.count("*").alias("events")))  # one row each
    return one.select(F.to_json(F.struct("flow", "warnings", F.lit(mode).alias("mode"), "events")).alias("json"))
