"""From hash bands to exact similarity classes, without pairing a group with itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.session import cut, drop_paths
from sievework.operators.components import connected_components

#: Nodes of a bucket outside its head's component up to which they are compared with all others there, pair by pair, and pairs that a bucket
#: makes that way at most; the nodes of buckets with more are compared where they share rare elements.
PAIRED, PAIRS = 1000, 10_000_000


def shared_buckets(entries: DataFrame) -> DataFrame:
    """The buckets of (bucket, node) that hold several nodes."""
    return entries.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket")


def _linked(a: str, b: str, tenths: int, agree: int | None) -> Column:
    """Whether the details ``a`` and ``b`` (structs) belong to a link: cheap tests first, then their elements."""
    x, y = F.col(f"{a}.elements"), F.col(f"{b}.elements")
    test = F.least(F.size(x), F.size(y)) * 10 >= F.greatest(F.size(x), F.size(y)) * tenths
    if agree is not None:
        same = F.zip_with(F.col(f"{a}.sketch"), F.col(f"{b}.sketch"), lambda p, q: p == q)
        test &= F.size(F.filter(same, lambda s: s)) >= agree
    common = F.size(F.array_intersect(x, y))
    return test & (common * 10 >= (F.size(x) + F.size(y) - common) * tenths)


def _star(groups: DataFrame, packed: DataFrame, score: str, tenths: int, agree: int | None) -> tuple[DataFrame, DataFrame]:
    """Links (x, y) of the nodes of each group of (grp, node, ``score``) to its head, the node of greatest score, and the heads (grp, head)."""
    heads = groups.groupBy("grp").agg(F.max_by("node", F.struct(score, "node")).alias("head"))
    pairs = groups.join(heads, "grp").where("node != head").select(F.col("node").alias("x"), F.col("head").alias("y")).distinct()
    met = pairs.join(packed.select(F.col("node").alias("x"), F.col("own").alias("a")), "x").join(packed.select(F.col("node").alias("y"), F.col("own").alias("b")), "y")
    return met.where(_linked("a", "b", tenths, agree)).select("x", "y"), heads


def _mixed(placed: DataFrame) -> DataFrame:
    """(grp, n): the groups of (grp, node, label) with nodes of several components."""
    return placed.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high").select("grp", "n")


def rare_elements(nodes: DataFrame, details: DataFrame, tenths: int) -> DataFrame:
    """(grp, node, size, first): those elements of ``nodes`` that a similar node must share, of the rarest ones.

    Of two sets with a Jaccard similarity of t or more, and all elements in one order, the larger one has one of the smaller's first
    s - ceil(2 t s / (1 + t)) + 1 elements (s: its size; ``first``) among its own first s - ceil(t s) + 1. In order of rarity these are elements
    that few others have, so nodes that have no more than a common core in common do not meet. Elements of one node only are left out.
    """
    listed = details.join(nodes, "node", "left_semi").select("node", F.size("elements").alias("size"), F.explode("elements").alias("grp"))
    many = listed.groupBy("grp").agg(F.count("*").alias("many"))
    first = F.col("size") - F.ceil(F.col("size") * tenths / F.lit(10.0)).cast("int") + 1
    own = listed.join(many, "grp").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("many", "grp"))).alias("o"))
    ranked = own.select("node", "size", F.posexplode(F.slice("o", F.lit(1), first)).alias("place", "e"))
    index = F.col("size") - F.ceil(F.col("size") * (2 * tenths) / F.lit(10.0 + tenths) - 1e-9).cast("int") + 1
    return ranked.where("e.many > 1").select(F.col("e.grp").alias("grp"), "node", "size", (F.col("place") < index).alias("first"))


def _some(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, label) of components after further links (x, y), which are drawn between components, so that only they are looked at."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}l"))
    drawn = links.join(of("x"), "x", "left").join(of("y"), "y", "left").select(F.coalesce("xl", "x").alias("x"), F.coalesce("yl", "y").alias("y")).where("x != y")
    drawn = cut(drawn.distinct(), "drawn")
    if not _some(drawn):
        return labels
    moved = connected_components(drawn, "x", "y").select(F.col("node").alias("label"), F.col("label").alias("to"))
    known = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    alone = moved.join(labels.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("node"), F.col("to").alias("label"))
    return cut(known.union(alone), "labels")


def similarity_classes(shared: DataFrame, details_of: Callable[[DataFrame], DataFrame], tenths: int, agree: int | None = None) -> DataFrame:
    """(node, label): components of the links between nodes that share a bucket.

    ``shared`` has (bucket, node) for buckets of several nodes. ``details_of`` gives, for a table of nodes, (node,
    elements, buckets) and, with ``agree``, sketch. A link is a Jaccard similarity of elements of ``tenths`` tenths
    or more between sketches that agree in ``agree`` places or more.

    The head of a bucket is its node that shares buckets with most others, as the text does that others are
    copies of. Every node is compared with the heads of its buckets, so a bucket of n nodes gives n pairs. Where its
    nodes then belong to several components, more is to be looked at: in a bucket with PAIRED nodes or fewer outside the
    head's component, and PAIRS pairs or fewer of these with all its nodes, they are compared with the nodes of other components, each pair in the first bucket of both. In others nodes
    meet where they share a rare element (see rare_elements): where many share one first with a head, then, where several components are
    left, with each other. A thousand texts that share a template but are not similar share none, so they make no pairs. No link between nodes that share a bucket is lost.
    """
    shared = shared.withColumnRenamed("bucket", "grp")
    spark = shared.sparkSession
    sizes = shared.groupBy("grp").agg(F.count("*").alias("n"))
    scores = shared.join(sizes, "grp").groupBy("node").agg(F.sum("n").alias("score"))
    shared = cut(shared.join(scores, "node"), "shared")
    details = cut(details_of(shared.select("node").distinct()), "details")
    packed = details.select("node", F.struct("elements", "buckets", *(["sketch"] if agree is not None else [])).alias("own"))
    found, heads = _star(shared, packed, "score", tenths, agree)
    labels = connected_components(cut(found, "links"), "x", "y")

    place = lambda g: g.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = cut(place(shared.join(heads, "grp")).select("grp", "head", "node", "label"), "placed")
    head_label = placed.where("node = head").select("grp", F.col("label").alias("head_label"))
    mixed = placed.join(head_label, "grp").groupBy("grp", "head_label").agg(F.count_if(F.col("label") != F.col("head_label")).alias("n"), F.count("*").alias("all"))
    mixed = cut(mixed.where("n > 0").select("grp", "head_label", ((F.col("n") > PAIRED) | (F.col("n") * F.col("all") > PAIRS)).alias("many")), "mixed")
    crowded = cut(placed.join(mixed.where("many"), "grp", "left_semi").select("node").distinct(), "crowded")

    few = mixed.where("NOT many").drop("many")
    if _some(few):
        open_ = placed.join(few, "grp").join(packed, "node").select("grp", "node", "label", "head_label", F.col("own").alias("b"))
        outside = open_.where("label != head_label").select("grp", F.col("node").alias("o"), F.col("label").alias("ol"), F.col("b").alias("a"))
        # two nodes outside meet once, an outside one and one of the head's component once
        apart = (F.col("ol") != F.col("label")) & ((F.col("label") == F.col("head_label")) | (F.col("o") < F.col("node")))
        once = F.element_at(F.array_intersect("a.buckets", "b.buckets"), 1) == F.col("grp")
        labels = _merged(labels, cut(outside.join(open_, "grp").where(apart & once & _linked("a", "b", tenths, agree)).select(F.col("o").alias("x"), F.col("node").alias("y")), "links"))

    if _some(crowded):
        rare = cut(rare_elements(crowded, details, tenths), "rare")
        crowds = cut(rare.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > PAIRED).select("grp"), "crowds")
        if _some(crowds):
            found, _ = _star(rare.where("first").join(crowds, "grp", "left_semi"), packed, "size", tenths, agree)
            labels = _merged(labels, cut(found, "links"))
        by_rare = place(rare)
        left = by_rare.join(_mixed(by_rare), "grp", "left_semi")
        # where an element's nodes are of one component but for a few, only these few are paired with others
        most = left.groupBy("grp", "label").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("usual"))
        left = cut(left.join(most, "grp").withColumn("odd", F.col("label") != F.col("usual")).drop("usual"), "left")
        small = left.where("first").select("grp", F.col("node").alias("x"), F.col("label").alias("xl"), F.col("size").alias("xs"), F.col("odd").alias("xo"))
        large = left.select("grp", F.col("node").alias("y"), F.col("label").alias("yl"), F.col("size").alias("ys"), F.col("odd").alias("yo"))
        apart = (F.col("xl") != F.col("yl")) & ((F.col("xs") < F.col("ys")) | (F.col("xs") == F.col("ys")) & (F.col("x") != F.col("y"))) & (F.col("xs") * 10 >= F.col("ys") * tenths)
        met = small.where("xo").join(large, "grp").where(apart).select("x", "y").union(small.where("NOT xo").join(large.where("yo"), "grp").where(apart).select("x", "y"))
        pairs = cut(met.distinct(), "pairs")
        if _some(pairs):
            met = pairs.join(packed.select(F.col("node").alias("x"), F.col("own").alias("a")), "x").join(packed.select(F.col("node").alias("y"), F.col("own").alias("b")), "y")
            labels = _merged(labels, cut(met.where(_linked("a", "b", tenths, agree)).select("x", "y"), "links"))
        drop_paths(spark, rare, left, pairs)
    drop_paths(spark, shared, details, placed, mixed, crowded)
    return labels
