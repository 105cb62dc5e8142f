"""Connected components of an edge table, by rounds of joins and partial aggregations over a shrinking graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.storage import cut, drop_paths, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label): every node of ``edges`` with the least node of its component.

    In each round nodes are ordered by a hash of their own, so that no order of the input makes long chains. A node takes
    the first of its neighbours, if that comes before itself, for parent, and the parent's parent's parent for
    place; the edges are then drawn between places, and those that have become loops or copies go. A dense
    component is gone after a round or two. Rounds are cut to the shared
    folder; nothing but whether edges are left reaches the driver. Nulls: an edge with a null end is no edge, and
    makes no node. Loops make no node, repeated edges change nothing. An empty table gives an empty table.
    """
    spark = edges.sparkSession
    low, high = F.least(a, b).alias("x"), F.greatest(a, b).alias("y")
    e = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(low, high).distinct(), "edges")
    labels = cut(e.select(F.col("x").alias("node"), F.col("x").alias("label")).limit(0), "labels")
    for turn in range(max_rounds):
        if e.limit(1).count() == 0:
            least = labels.groupBy("label").agg(F.min("node").alias("least"))
            named = cut(labels.join(least, "label").select("node", F.col("least").alias("label")), "labels")
            drop_paths(spark, e, labels)
            release(spark)
            return named
        near = e.select(F.col("y").alias("node"), F.col("x").alias("near")).union(e.select("x", "y"))
        rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: B023, E731
        first = near.withColumn("h", rank("near")).groupBy("node").agg(F.min("h").alias("h"), F.min_by("near", "h").alias("near"))
        parents = cut(first.select("node", F.when(F.col("h") < rank("node"), F.col("near")).otherwise(F.col("node")).alias("parent")), "parents")
        # every parent is a node of this round, so no row is lost
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        once = parents.join(up, "parent").select("node", F.col("up").alias("parent"))
        steps = cut(once.join(up, "parent").select("node", F.col("up").alias("step")), "steps")
        drawn = e.join(steps.select(F.col("node").alias("x"), F.col("step").alias("p")), "x").join(steps.select(F.col("node").alias("y"), F.col("step").alias("q")), "y")
        shrunk = cut(drawn.where("p != q").select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct(), "edges")
        if turn:
            moved = labels.join(steps.select(F.col("node").alias("label"), "step"), "label", "left").select("node", F.coalesce("step", "label").alias("label"))
        else:
            moved = steps.select("node", F.col("step").alias("label"))
        moved = cut(moved, "labels")
        drop_paths(spark, e, parents, steps, labels)
        e, labels = shrunk, moved
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
