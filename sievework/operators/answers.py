"""Answers of a model: their JSON, verdicts and quotes, and the result rows that calls fold to; no model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import squash, strip

#: Lengths at which the texts of an answer are cut, its fields, verdicts and decisions.
CUTS = {"note": 200, "quote": 300, "reasoning": 600}
NEEDED = ["inclusion", "exclusion", "reasoning", "decision"]
KNOWN = [*NEEDED, "ambiguities"]
INCLUSION = ["met", "not_met", "unclear"]
EXCLUSION = ["triggered", "not_triggered", "unclear"]
DECISIONS = ["INCLUDE", "EXCLUDE", "UNCERTAIN"]

VERDICT = "struct<criterion:string,verdict:string,note:string,quote:string>"


def derive_decision(inclusion: Column, exclusion: Column) -> Column:
    """EXCLUDE if an exclusion criterion is triggered; INCLUDE if there are inclusion criteria and all are met; EXCLUDE if one is not met; else UNCERTAIN."""
    return (
        F.when(F.exists(exclusion, lambda v: v["verdict"] == "triggered"), "EXCLUDE")
        .when((F.size(inclusion) > 0) & F.forall(inclusion, lambda v: v["verdict"] == "met"), "INCLUDE")
        .when(F.exists(inclusion, lambda v: v["verdict"] == "not_met"), "EXCLUDE").otherwise("UNCERTAIN")
    )


def _kind(value: Column, path: str) -> Column:
    """The JSON kind of what lies at a path: STRING, ARRAY<..>, OBJECT<..>, VOID for null; null where there is nothing."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _verdicts(items: Column, allowed: list[str]) -> tuple[Column, Column]:
    """(verdicts, whether all are as they must be) of an array of JSON objects."""
    text = lambda v, f: F.try_variant_get(v, f"$.{f}", "string")
    is_text = lambda v, f: _kind(v, f"$.{f}") == "STRING"
    optional = lambda v, f: F.coalesce(_kind(v, f"$.{f}"), F.lit("STRING")) == "STRING"
    good = lambda v: (
        F.schema_of_variant(v).startswith("OBJECT") & is_text(v, "criterion") & (strip(text(v, "criterion")) != "") & is_text(v, "verdict") & text(v, "verdict").isin(*allowed)
        & optional(v, "note") & optional(v, "quote")
    )
    cut = lambda v, f: F.substring(F.coalesce(text(v, f), F.lit("")), 1, CUTS[f])
    row = lambda v: F.struct(strip(text(v, "criterion")).alias("criterion"), text(v, "verdict").alias("verdict"), cut(v, "note").alias("note"), cut(v, "quote").alias("quote"))
    return F.transform(items, row), F.forall(items, lambda v: F.coalesce(good(v), F.lit(False)))


def parse_answers(raw: DataFrame) -> DataFrame:
    """``raw`` (with answer) with status, decision, derived_decision, consistent, reasoning, inclusion, exclusion and ambiguities.

    The answer is JSON, perhaps in a code fence; if it is not JSON as a whole, what stands between the first and the last brace is. Missing or
    unknown fields, values of another kind or outside the lists, and verdicts without a criterion make it a parse_error; texts that are too long
    are cut. The model's decision is kept beside the derived one. A null answer is a parse_error.
    """
    plain = strip(F.regexp_replace(strip(F.coalesce("answer", F.lit(""))), r"(?is)^```(?:json)?\s*|\s*```$", ""))
    inner = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    d = raw.withColumn("_whole", F.try_parse_json(F.nullif(plain, F.lit(""))))
    d = d.withColumn("_v", F.coalesce("_whole", F.try_parse_json(F.nullif(inner, F.lit("")))))
    d = d.withColumn("_keys", F.json_object_keys(F.when(F.col("_whole").isNotNull(), plain).otherwise(inner)))
    v = F.col("_v")
    listed = lambda f: F.try_variant_get(v, f"$.{f}", "array<variant>")
    d = d.withColumns({"_in": listed("inclusion"), "_ex": listed("exclusion"), "_am": listed("ambiguities")})
    known, needed = (F.array(*map(F.lit, names)) for names in (KNOWN, NEEDED))
    inclusion, good_in = _verdicts(F.col("_in"), INCLUSION)
    exclusion, good_ex = _verdicts(F.col("_ex"), EXCLUSION)
    decision = F.when(_kind(v, "$.decision") == "STRING", F.try_variant_get(v, "$.decision", "string"))
    has = F.array_contains(F.col("_keys"), "ambiguities")
    good = (
        (F.size(F.array_except("_keys", known)) == 0) & (F.size(F.array_except(needed, F.col("_keys"))) == 0) & decision.isin(*DECISIONS) & (_kind(v, "$.reasoning") == "STRING")
        & good_in & good_ex & (~has | F.forall("_am", lambda a: F.coalesce(F.schema_of_variant(a) == "STRING", F.lit(False))))
    )
    d = d.withColumn("_good", F.coalesce(good, F.lit(False))).withColumns({"_in": F.when(F.col("_good"), inclusion), "_ex": F.when(F.col("_good"), exclusion)})
    derived = derive_decision(F.col("_in"), F.col("_ex"))
    when = lambda c, other=None: F.when(F.col("_good"), c).otherwise(F.lit(other))
    none = F.array().cast(f"array<{VERDICT}>")
    return d.select(
        *raw.columns, F.when(F.col("_good"), "ok").otherwise("parse_error").alias("status"), when(decision, "").alias("decision"), when(derived, "").alias("derived_decision"),
        when(decision == derived).alias("consistent"), when(F.substring(F.try_variant_get(v, "$.reasoning", "string"), 1, CUTS["reasoning"]), "").alias("reasoning"),
        F.coalesce("_in", none).alias("inclusion"), F.coalesce("_ex", none).alias("exclusion"),
        F.when(F.col("_good") & has, F.transform("_am", lambda a: F.try_variant_get(a, "$", "string"))).otherwise(F.array().cast("array<string>")).alias("ambiguities"),
    )


def parse_last_line(answer: Column) -> Column:
    """The old answer form: the last line that is not empty is XXX (EXCLUDE) or YYY (INCLUDE), perhaps in quotes or marks; else null."""
    lines = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"\R"), strip), lambda x: x != "")
    last = F.upper(F.regexp_replace(F.coalesce(F.get(lines, F.size(lines) - 1), F.lit("")), r"""^['"`*. ]+|['"`*. ]+$""", ""))
    return F.when(last == "XXX", "EXCLUDE").when(last == "YYY", "INCLUDE")


def quote_parts(quote: Column) -> Column:
    """The parts of a quote, cut at dots of omission, squashed; those of no letter or digit are left out."""
    return F.filter(F.transform(F.split(quote, r"\.\.\.|…"), squash), lambda p: p != "")


def quotes_found(quote: Column, text: Column) -> Column:
    """Whether all parts of a quote stand in the text; case, spaces and punctuation aside."""
    return F.forall(quote_parts(quote), lambda p: F.contains(squash(text), p))


def check_quotes(answers: DataFrame, texts: DataFrame) -> DataFrame:
    """``answers`` (study_uid, inclusion, exclusion) with ``quote_unverified``: the criteria whose quote is not in the record's own text (study_uid, text).

    Each text is squashed once, and each quote. A record without a text has none of its quotes. Blank quotes are not looked for.
    """
    t = texts.select("study_uid", squash(F.col("text")).alias("_text"))
    d = answers.withColumn("_quotes", F.transform(F.concat("inclusion", "exclusion"), lambda v: F.struct(v["criterion"].alias("c"), quote_parts(v["quote"]).alias("p"))))
    missing = F.filter("_quotes", lambda q: F.exists(q["p"], lambda p: ~F.contains(F.coalesce("_text", F.lit("")), p)))
    return d.join(t, "study_uid", "left").withColumn("quote_unverified", F.transform(missing, lambda q: q["c"])).drop("_text", "_quotes")


def results_of_calls(calls: DataFrame, texts: DataFrame) -> DataFrame:
    """One result row of each (run_id, study_uid) from its calls in order: status, error_code, decisions, flags, attempts, tokens and latency.

    ``calls`` has run_id, study_uid, position, outcome (``answer``, ``too_long``, ``refused`` or ``error``), finish_reason, answer, model_returned,
    tokens_in, tokens_out and latency_s. The last call gives the status: too_long, api_error, truncated (cut off at the length limit), parse_error or ok. Flags: length_retry and
    parse_retry for earlier calls cut off or not valid, model_changed where a further model of the run is met first, quote_unverified, inconsistent.
    """
    parsed = parse_answers(calls)
    cut_off = F.col("finish_reason") == "length"
    kind = F.when(F.col("outcome") == "too_long", "too_long").when(F.col("outcome") != "answer", "api_error").when(cut_off, "truncated").otherwise(F.col("status"))
    parsed = parsed.withColumn("_kind", kind)
    models = calls.where("model_returned <> ''").groupBy("run_id", "model_returned").agg(F.min("position").alias("position"))
    first = models.groupBy("run_id").agg(F.min("position").alias("first"))
    fresh = models.join(first, "run_id").where("position > first").select("run_id", "position", F.lit(True).alias("_fresh"))
    d = parsed.join(fresh, ["run_id", "position"], "left")
    rest = ["_kind", "decision", "derived_decision", "consistent", "reasoning", "inclusion", "exclusion", "ambiguities", "model_returned"]
    d = d.groupBy("run_id", "study_uid").agg(
        F.max_by(F.struct(*rest), "position").alias("r"), F.count("*").alias("attempts"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.round(F.sum("latency_s"), 3).alias("latency_s"),
        F.array_sort(F.collect_list(F.struct("position", F.col("_kind").alias("kind"), F.coalesce("_fresh", F.lit(False)).alias("fresh")))).alias("all"),
    )
    d = d.select("run_id", "study_uid", F.col("r._kind").alias("status"), *(F.col(f"r.{c}").alias(c) for c in rest[1:]), "attempts", "tokens_in", "tokens_out", "latency_s", "all")
    d = check_quotes(d, texts)
    n = F.size("all")
    per_call = F.flatten(
        F.transform(
            "all",
            lambda c, i: F.concat(
                F.when(c["fresh"], F.array(F.lit("model_changed"))).otherwise(F.array().cast("array<string>")),
                F.when((i < n - 1) & (c["kind"] == "truncated"), F.array(F.lit("length_retry"))).when((i < n - 1) & (c["kind"] == "parse_error"), F.array(F.lit("parse_retry"))).otherwise(F.array().cast("array<string>")),
            ),
        )
    )
    ok, failed = F.col("status") == "ok", F.col("status").isin("api_error", "too_long")
    own = F.array_compact(F.array(F.when(ok & (F.size("quote_unverified") > 0), "quote_unverified"), F.when(ok & ~F.col("consistent"), "inconsistent")))
    code = F.when(F.col("status") == "too_long", "E303").when(F.col("status") == "api_error", "E301").when(~ok, "E304").otherwise("")
    blank = lambda c: F.when(ok, F.col(c)).otherwise("").alias(c)
    return d.select(
        "run_id", "study_uid", "status", code.alias("error_code"), blank("decision"), blank("derived_decision"), F.when(ok, F.col("consistent")).alias("consistent"),
        F.when(failed, F.array().cast("array<string>")).otherwise(F.concat(per_call, own)).alias("flags"), "attempts",
        F.when(failed, 0).otherwise(F.col("tokens_in")).alias("tokens_in"), F.when(failed, 0).otherwise(F.col("tokens_out")).alias("tokens_out"), F.when(ok, F.col("latency_s")).alias("latency_s"),
    )


def adjudicated(disputed: DataFrame, answers: DataFrame, master_run: str) -> DataFrame:
    """Result rows of a resolution: the master's answer to each disputed item, with all runs' decisions beside it.

    ``disputed`` has (study_uid, decisions map<run, decision>), ``answers`` (study_uid, status, decision) of the master; an item without an answer, or with one that is
    not valid, is an error row.
    """
    d = disputed.join(answers.select("study_uid", "status", "decision"), "study_uid", "left")
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    return d.select(F.lit(master_run).alias("run_id"), "study_uid", F.coalesce("status", F.lit("api_error")).alias("status"), F.when(ok, F.col("decision")).otherwise("").alias("decision"), F.col("decisions").alias("source_decisions"))
