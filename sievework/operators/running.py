"""Running totals over long logs: many tasks for one run, whatever its length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a run in a stretch that is summed by itself.
STRETCH = 100_000


def running(d: DataFrame, order: str, sums: dict[str, str | int | Column], key: str = "run_id", maxima: dict[str, Column] | None = None) -> DataFrame:
    """``d`` with running sums, and running maxima over the rows before, by ``key`` in the order of a whole number.

    The numbers are cut into stretches of STRETCH; each stretch's totals are summed up over the stretches before it, so a window sees one stretch's rows, or one row for each stretch.
    Rows of equal number come in no certain order. Sums of null are 0.
    """
    maxima = maxima or {}
    d = d.withColumn("_part", F.floor(F.col(order) / STRETCH)).withColumns({f"_m_{n}": c for n, c in maxima.items()})
    value = {n: F.lit(c) if isinstance(c, int) else F.coalesce(c, F.lit(0)) for n, c in sums.items()}
    totals = d.groupBy(key, "_part").agg(F.count("*").alias("_n"), *(F.sum(v).alias(f"_t_{n}") for n, v in value.items()), *(F.max(f"_m_{n}").alias(f"_t_{n}") for n in maxima))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        key, "_part", *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums), *(F.max(f"_t_{n}").over(earlier).alias(f"_b_{n}") for n in maxima)
    )
    own = Window.partitionBy(key, "_part").orderBy(order)
    rows = own.rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(before, [key, "_part"])
    d = d.withColumns({n: F.col(f"_b_{n}") + F.sum(v).over(rows) for n, v in value.items()} | {n: F.greatest(f"_b_{n}", F.max(f"_m_{n}").over(own.rowsBetween(Window.unboundedPreceding, -1))) for n in maxima})
    return d.drop("_part", *(f"_b_{n}" for n in [*sums, *maxima]), *(f"_m_{n}" for n in maxima))
