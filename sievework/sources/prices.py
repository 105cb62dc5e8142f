"""Price lists of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns that a price list must have.
REQUIRED = ["provider", "model", "price_input_per_1k", "price_output_per_1k"]


def price_number(text: Column) -> Column:
    """``0.0006`` or ``0,0006`` as a number; null for what is none, not finite or negative."""
    value = F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")
    return F.when((value >= 0) & (value < float("inf")), value)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """(provider, model, price_in, price_out, currency, valid_from, line) of a price list, for :func:`sievework.operators.costs.current_prices`.

    The delimiter is a semicolon if the header has more of them than commas. Headers count without case and blanks; one that lacks a column is an error (E203). Rows
    without a model or a valid price are left out; a currency that is not given is USD. An empty file lacks all columns.
    """
    first = spark.read.text(path).first()
    header = (first["value"] if first else "").lstrip("﻿")
    d = spark.read.option("header", True).option("sep", ";" if header.count(";") > header.count(",") else ",").option("escape", '"').option("enforceSchema", False).csv(path)
    named: dict[str, str] = {}
    for c in d.columns:
        named.setdefault(c.lstrip("﻿").strip().lower(), c)
    if missing := [c for c in REQUIRED if c not in named]:
        raise ValueError(f"E203: missing columns {', '.join(missing)}")
    text = lambda c: F.trim(F.coalesce(F.col(f"`{named[c]}`"), F.lit(""))) if c in named else F.lit("")
    currency = F.upper(text("currency"))
    d = d.select(
        F.lower(text("provider")).alias("provider"), F.lower(text("model")).alias("model"), price_number(text("price_input_per_1k")).alias("price_in"), price_number(text("price_output_per_1k")).alias("price_out"),
        F.when(currency == "", "USD").otherwise(currency).alias("currency"), text("valid_from").alias("valid_from"), F.monotonically_increasing_id().alias("line"),
    )
    return d.where("provider <> '' AND model <> '' AND price_in IS NOT NULL AND price_out IS NOT NULL")
