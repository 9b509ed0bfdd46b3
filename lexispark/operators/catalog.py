"""Operators of a library of books, on the caller's own tables.

Each takes DataFrames with the named columns and returns one; nothing is collected. Column names
are parameters where more than one could be meant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import SPARK, fold
from .ranking import global_rank


def _starts(word: str):
    return lambda part: part.startswith(word)


def search(books: DataFrame, needle: str, *columns: str) -> DataFrame:
    """The books of which a column holds every word of ``needle`` as the start of a word, after folding.

    The query is folded like the text; an empty one finds all. It never becomes part of a pattern.
    """
    words = [w for w in books.sparkSession.range(1).select(fold(SPARK.lit(needle))).first()[0].replace("'", " ").split(" ") if w]

    def holds(column: str) -> Column:
        parts = F.split(fold(column), "[ ']")
        tests = [F.exists(parts, _starts(w)) for w in words]
        test = F.lit(True)
        for t in tests:
            test = test & t
        return test

    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(holds(c), F.lit(False))
    return books.where(found)


def canonical_authors(books: DataFrame, author: str = "author") -> DataFrame:
    """(author_key, author): of the spellings that share a key the commonest, then the shortest, then the first."""
    clean = books.selectExpr(f"{SPARK.clean_name(f'`{author}`')} AS clean").selectExpr("clean", f"{SPARK.fold('clean')} AS folded")
    keyed = clean.selectExpr("clean", f"{SPARK.author_tokens('folded')} AS tokens").selectExpr("clean", f"{SPARK.author_key('tokens')} AS author_key").where("author_key <> ''")
    votes = keyed.groupBy("author_key", "clean").agg(F.count(F.lit(1)).alias("n"))
    # A partial aggregate a key: a hot one is never gathered.
    return votes.groupBy("author_key").agg(F.min(F.struct((-F.col("n")).alias("n"), F.octet_length("clean").alias("bytes"), "clean")).alias("v")).select("author_key", F.col("v.clean").alias("author"))


def reconcile(scanned: DataFrame, prior: DataFrame, path: str = "path", size: str = "size", first_seen: str = "first_seen") -> DataFrame:
    """Every path with its status (unchanged, renamed, added, removed) and number of arrival.

    Paths that are in both are unchanged. Of the others, those of equal size are matched one to one,
    in order of path and of arrival: a rename. New books get the numbers after the last one given,
    in path order. Sizes of many files are no task's work alone: the matching ranks by (size, path).
    """
    now, was = scanned.select(F.col(path).alias("path"), F.col(size).alias("size")), prior.select(F.col(path).alias("path"), F.col(size).alias("size"), F.col(first_seen).alias("first_seen"))
    kept = now.join(was.select("path", "first_seen"), "path").select("path", F.lit("unchanged").alias("status"), "first_seen")

    def placed(df: DataFrame, order: str) -> DataFrame:
        """Adds the place within the size: the global rank less the least rank of that size."""
        ranks = global_rank(df, [F.col("size"), F.col(order)], "__rank")
        least = ranks.groupBy("size").agg(F.min("__rank").alias("__least"))
        return ranks.join(least, "size").withColumn("place", F.col("__rank") - F.col("__least")).drop("__rank", "__least")

    fresh, gone = placed(now.join(was, "path", "left_anti"), "path"), placed(was.join(now, "path", "left_anti"), "first_seen")
    met = fresh.alias("f").join(gone.alias("g"), ["size", "place"], "full_outer").select(F.col("f.path").alias("path"), F.col("g.path").alias("old"), "first_seen")
    last = prior.agg(F.coalesce(F.max(first_seen), F.lit(0)).alias("last")).first()["last"]
    added = global_rank(met.where("old is null").select("path"), [F.col("path")], "nth").select("path", F.lit("added").alias("status"), (F.col("nth") + last).alias("first_seen"))
    moved = met.where("path is not null and old is not null").select("path", F.lit("renamed").alias("status"), "first_seen")
    lost = met.where("path is null").select(F.col("old").alias("path"), F.lit("removed").alias("status"), "first_seen")
    return kept.unionByName(moved).unionByName(added).unionByName(lost)


def asof(probes: DataFrame, starts: DataFrame, by: str, probe: str, start: str, value: str, forward: bool = False) -> DataFrame:
    """``probes`` with the ``value`` of the last start at or before each probe (``forward``: the first at or
    after, else the last of all), within ``by``. One sort, whatever the numbers of probes and starts."""
    left = probes.select("*", F.col(probe).alias("__pos"), F.lit(0 if forward else 1).alias("__side"), F.lit(None).cast(starts.schema[value].dataType).alias("__v"))
    right = starts.select(by, F.col(start).alias("__pos"), F.lit(1 if forward else 0).alias("__side"), F.col(value).alias("__v"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("__pos", "__side")
    if forward:
        following = F.first("__v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        before = F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        got = F.coalesce(following, before)
    else:
        got = F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, got).where(F.col("__side") == (0 if forward else 1)).select(*probes.columns, value)


def merged_intervals(df: DataFrame, by: str, lo: str, hi: str, gap: int = 0) -> DataFrame:
    """Intervals of a group that meet, or lie within ``gap``, as one: (by, lo, hi, n)."""
    w = Window.partitionBy(by).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = df.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).withColumn("__new", F.when(F.col(lo) <= reach + gap, 0).otherwise(1))
    island = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return starts.withColumn("__island", island).groupBy(by, "__island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count(F.lit(1)).alias("n")).drop("__island")


def ranked_page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows in a total order, however far it is, without a sort in one task."""
    return global_rank(df, order, "__rank").where(F.col("__rank").between(number * size + 1, (number + 1) * size)).drop("__rank")


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Points with the ranges (closed) that hold them, by bins of ``width``; only whole numbers."""
    bins = F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    cut = ranges.where(F.col(lo) <= F.col(hi)).withColumn("__bin", bins)
    return points.withColumn("__bin", F.floor(F.col(at) / width)).join(cut, "__bin").where(F.col(at).between(F.col(lo), F.col(hi))).drop("__bin")
