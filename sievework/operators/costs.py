"""Prices, and what a run would take: tokens, cost and time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import cost_of, token_count


def current_prices(prices: DataFrame, today: str) -> DataFrame:
    """The price in force of each provider and model on a day (ISO): the latest of those begun, then those without a date, then the first line of those to come.

    Of equal ones the first line counts. Prices that are null, negative or not numbers are no prices.
    """
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.col(c) >= 0)
    d = prices.where(ok("price_in") & ok("price_out")).withColumns({"provider": F.lower(F.trim("provider")), "model": F.lower(F.trim("model"))})
    since = F.coalesce("valid_from", F.lit(""))
    begun = since <= today
    d = d.withColumn("_key", F.struct(begun.cast("int"), F.when(begun, since).otherwise(""), -F.col("line")))
    best = d.groupBy("provider", "model").agg(F.max_by(F.struct("price_in", "price_out", "valid_from"), "_key").alias("p"))
    return best.select("provider", "model", "p.*")


def price_of(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """``requests`` (provider, model, ...) with price_in and price_out, null where :func:`current_prices` has none; case and outer spaces aside."""
    p = prices.select(F.col("provider").alias("_p"), F.col("model").alias("_m"), "price_in", "price_out")
    d = requests.drop("price_in", "price_out")
    return d.join(p, (F.lower(F.trim("provider")) == F.col("_p")) & (F.lower(F.trim("model")) == F.col("_m")), "left").drop("_p", "_m")


def item_text(title: str = "title", text: Column | str = "abstract") -> Column:
    """What is counted of a record: title and text with their labels."""
    text = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\nAbstract: "), F.coalesce(text, F.lit("")))


@dataclass(frozen=True)
class RunLimits:
    """Assumptions and limits of an estimate: answer lengths in tokens, how far the cost may be off, and what a run may cost."""

    out_per_record: int = 150
    out_at_most: int = 800
    uncertainty: float = 0.2
    max_cost: float | None = None


def run_estimate(items: DataFrame, shared_text: str, price_in: float | None, price_out: float | None, limits: RunLimits = RunLimits()) -> DataFrame:
    """One row of a run over ``items`` (text): n, shared and item tokens, tokens in and out, cost with its band, worst case, and whether that exceeds the limit.

    Without a price the costs are null and nothing is over the limit.
    """
    d = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(token_count(F.col("text"))), F.lit(0)).alias("item_tokens"))
    d = d.withColumn("shared_tokens", token_count(F.lit(shared_text)))
    d = d.withColumns({"tokens_in": F.col("item_tokens") + F.col("n") * F.col("shared_tokens"), "tokens_out": F.col("n") * limits.out_per_record})
    price = F.lit(price_in).cast("double"), F.lit(price_out).cast("double")
    cost, worst = cost_of(F.col("tokens_in"), F.col("tokens_out"), *price), cost_of(F.col("tokens_in"), F.col("n") * limits.out_at_most, *price)
    over = F.coalesce(worst > F.lit(limits.max_cost).cast("double"), F.lit(False))
    return d.select(
        "n", "shared_tokens", "item_tokens", "tokens_in", "tokens_out", F.round(cost, 6).alias("cost"), F.round(cost * (1 - limits.uncertainty), 6).alias("cost_low"),
        F.round(cost * (1 + limits.uncertainty), 6).alias("cost_high"), F.round(worst, 6).alias("cost_max"), over.alias("over_limit"),
    )


def duration_estimate(estimate: DataFrame, rpm: float, tpm: float, seconds_per_call: float, concurrency: int) -> DataFrame:
    """The longest of what requests a minute, tokens a minute and latency allow, and which of them it is (``none`` without records)."""
    by = {"rpm": F.col("n") / rpm * 60, "tpm": (F.col("tokens_in") + F.col("tokens_out")) / tpm * 60, "latency": F.col("n") * seconds_per_call / concurrency}
    longest = F.greatest(*by.values())
    limit = F.when(F.col("n") == 0, "none").when(by["rpm"] == longest, "rpm").when(by["tpm"] == longest, "tpm").otherwise("latency")
    return estimate.select("n", F.round(longest, 3).alias("seconds"), limit.alias("limit"))


def prefilter_estimate(records: DataFrame, criteria: str, price_in: float | None) -> DataFrame:
    """One row (n, tokens_in, cost) of a run of the AI prefilter: the records without a reason that have a text, each sent with the criteria; only what goes in costs."""
    free = (F.coalesce("exclusion_reason", F.lit("")) == "") & ((F.trim("title") != "") | (F.trim("abstract") != ""))
    shared = token_count(F.lit(criteria))
    d = records.where(free).agg(F.count("*").alias("n"), F.coalesce(F.sum(token_count(F.concat_ws("\n", "title", "abstract"))), F.lit(0)).alias("t"))
    d = d.select("n", (F.col("t") + F.col("n") * shared).alias("tokens_in"))
    return d.withColumn("cost", F.round(F.col("tokens_in") / F.lit(1000.0) * F.lit(price_in).cast("double"), 6))


#: Standard errors of a bound: all but one in a hundred estimates are within it.
ERRORS = 2.576


def token_sample(items: DataFrame, key: str, text: str, count: Callable[[Column], Column] = token_count, rate: float = 0.01, least: int = 200) -> DataFrame:
    """(stratum, n, m, s, q): for each length class of texts their number, and the number, tokens and squared tokens of those in the sample.

    A class holds texts of one length in bits of bytes. Of its texts ``rate``, and ``least`` at least, are drawn by a hash of ``key``, so a draw does not depend on partitions, and only these
    are counted: ``count`` may be a tokenizer. Rows of several tables, or days, are put together by adding them up. Nulls: a null text is empty, a null key is drawn like others; repeated keys are
    drawn together.
    """
    d = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(text, F.lit("")).alias("text")).withColumn("stratum", F.length(F.bin(F.octet_length("text"))))
    sizes = d.groupBy("stratum").agg(F.count("*").alias("n"))  # 32 classes at most
    share = F.greatest(F.lit(float(rate)), F.lit(float(least)) / F.col("n"))
    place = F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long")
    drawn = d.join(F.broadcast(sizes), "stratum").where(place < share * F.lit(2.0**32)).withColumn("tokens", count(F.col("text")).cast("long"))
    sums = drawn.groupBy("stratum").agg(F.count("*").alias("m"), F.sum("tokens").alias("s"), F.sum(F.col("tokens") * F.col("tokens")).alias("q"))
    return sizes.join(sums, "stratum", "left").na.fill(0, ["m", "s", "q"]).select("stratum", "n", "m", "s", "q")


def token_estimate(sample: DataFrame) -> DataFrame:
    """One row of (stratum, n, m, s, q), summed up first: n texts, m counted, total tokens, and ``bound``, by which the total is off at most in 99 of 100 draws.

    A class of which fewer than two texts were drawn, and not all, has no bound, and then the whole has none (null). No rows give zeros.
    """
    d = sample.groupBy("stratum").agg(*(F.sum(c).alias(c) for c in ("n", "m", "s", "q")))
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    spread = F.greatest((F.col("q") - F.col("s") * F.col("s") / m) / (m - 1), F.lit(0.0))
    variance = F.when(F.col("m") >= F.col("n"), 0.0).when(F.col("m") > 1, n * n * (1 - m / n) * spread / m)
    total = F.coalesce(F.sum(F.when(F.col("m") > 0, F.col("s") * n / m)), F.lit(0.0))
    bound = F.when(F.count_if(variance.isNull()) == 0, F.ceil(F.coalesce(F.sqrt(F.sum(variance)), F.lit(0.0)) * ERRORS))
    return d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.round(total).cast("long").alias("total"), bound.cast("long").alias("bound"))
