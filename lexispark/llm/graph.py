"""Connected components of a table of links, without collecting a component anywhere; joins with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise


def join_groups(members: DataFrame, groups: DataFrame, by: str, hot_rows: int, most: int = 200_000) -> DataFrame:
    """``members`` joined with ``groups`` (``by``, rows, ...), a row a key; members of hot groups by broadcast.

    Hot are the groups of over ``hot_rows`` rows, so there are at most members / ``hot_rows`` of them;
    they are counted, and beyond ``most`` all go by shuffle.
    """
    hot = groups.where(F.col("rows") > hot_rows)
    if not 0 < hot.count() <= most:
        return members.join(groups, by)
    hot = F.broadcast(hot)
    cold = members.join(hot.select(by), by, "left_anti").join(groups.where(F.col("rows") <= hot_rows), by)
    return members.join(hot, by).unionByName(cold)


def _toward_least(links: DataFrame) -> DataFrame:
    """For each node the least of itself and its neighbours. Partial sums first: hot nodes are cheap."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _are_stars(edges: DataFrame) -> bool:
    """Has each upper node one link, to a node that is no upper node itself?"""
    shape = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    twice = shape.where("n > 1").limit(1).count()
    return not twice and not edges.select("v").distinct().join(shape, F.col("v") == F.col("u"), "left_semi").limit(1).count()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), a work table; root is the least node of its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each an aggregation and a
    join on the node, until the links are stars; every round is written in the shared folder. The
    rounds grow with the logarithm of the longest path.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(most):
        if _are_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_toward_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "links")
        least = _toward_least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, edges = edges, materialise(small.where("u <> v").distinct(), "links")
        discard(old, large)
    else:
        raise RuntimeError("components did not settle")
    named = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    named = materialise(named, "components")
    discard(edges)
    return named


def rooted(df: DataFrame, comp: DataFrame, node: str, name: str = "root") -> DataFrame:
    """``df`` with the component of the column ``node``; a node without links is its own."""
    return df.join(comp.select(F.col("node").alias(node), F.col("root").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def grown(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``comp`` (node, root) after further links: those of the contracted links, spread over
    the members. ``comp`` is deleted."""
    between = rooted(rooted(links.select("a", "b"), comp, "a", "a_root"), comp, "b", "b_root")
    delta = components(between.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b").distinct())
    moved = comp.join(delta.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    new = delta.join(comp.select("node"), "node", "left_anti")
    out = materialise(moved.unionByName(new.select("node", "root")), "components")
    discard(delta, comp)
    return out
