"""Hyphenation by patterns, and its evaluation against golden words.

Patterns are a table (pattern, as in ``a1b``, ``.un1``): letters with levels between them, a full
stop for the edge of a word. They are not part of the library; any public list can be read into
that form. All is built of joins and aggregates: a word's n-grams are joined with the patterns'
letters, the greatest level at each place decides, and odd levels allow a break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern_levels(patterns: DataFrame, col: str = "pattern") -> DataFrame:
    """(letters, at, level): the levels of each pattern by the number of letters before them."""
    p = F.col(col)
    letters = F.regexp_replace(p, "[0-9]", "")
    # Every letter but the last is followed by its level, 0 where none is written; the first may have one before it.
    marks = F.regexp_extract_all(p, F.lit("([0-9]?[^0-9]|[0-9]$)"), F.lit(1))
    cells = F.transform(marks, lambda m, i: F.struct(i.alias("at"), F.coalesce(F.regexp_extract(m, "^([0-9])", 1).try_cast("int"), F.lit(0)).alias("level")))
    return patterns.where(p.isNotNull()).select(letters.alias("letters"), F.explode(cells).alias("c")).select("letters", "c.*").where("level > 0")


def hyphenate(words: DataFrame, patterns: DataFrame, word_col: str = "word", least_before: int = 2, least_after: int = 2, broadcast_rows: int = 500_000) -> DataFrame:
    """(word, breaks): the places (characters before them) where each distinct word may break, in order.

    Null and empty words give no row; case is ignored; a word that no pattern matches has no breaks.
    The patterns are broadcast only while they are within ``broadcast_rows``.
    """
    levels = pattern_levels(patterns)
    distinct = words.select(F.col(word_col).alias("word")).where("word <> ''").distinct()
    longest = levels.agg(F.max(F.length("letters"))).first()[0] or 0
    dotted = F.concat(F.lit("."), F.lower("word"), F.lit("."))
    n = F.length("word") + 2
    grams = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(max(1, longest)), n - i)), lambda k: F.struct(i.alias("start"), F.substring(dotted, i + 1, k).alias("letters")))))
    levels = F.broadcast(levels) if levels.count() <= broadcast_rows else levels
    hits = distinct.select("word", F.explode(grams).alias("g")).select("word", "g.*").join(levels, "letters")
    # A place counts the letters before it; the first of the dotted word is the full stop.
    scores = hits.groupBy("word", (F.col("start") + F.col("at") - 1).alias("place")).agg(F.max("level").alias("level"))
    good = scores.where((F.col("level") % 2 == 1) & (F.col("place") >= least_before) & (F.col("place") <= F.length("word") - least_after))
    breaks = good.groupBy("word").agg(F.array_sort(F.collect_set("place")).alias("breaks"))
    return distinct.join(breaks, "word", "left").select("word", F.coalesce("breaks", F.array().cast("array<int>")).alias("breaks"))


def golden(rows: DataFrame, col: str = "value") -> DataFrame:
    """Golden rows from lines ``word|hyphen=ated|frequency``; lines that start with ``#`` and others are left out."""
    part = lambda k: F.regexp_extract(col, r"^([^|#][^|]*)\|([^|]+)\|([0-9]+)\s*$", k)
    pieces = F.split(part(2), "=")
    ends = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda _, i: F.length(F.array_join(F.slice(pieces, F.lit(1), i + 1), "")))
    return rows.select(part(1).alias("word"), ends.alias("expected"), part(3).try_cast("long").alias("frequency")).where("word <> ''")


def measures(expected: Column, actual: Column) -> Column:
    """struct<precision, recall, f1, weighted> of two arrays of places; false breaks weigh twice in ``weighted``."""
    both = F.size(F.array_intersect(actual, expected))
    false, missed = F.size(F.array_except(actual, expected)), F.size(F.array_except(expected, actual))
    none = (F.size(expected) == 0) & (F.size(actual) == 0)
    precision = F.when(none, 1.0).when(both + false > 0, both / (both + false)).otherwise(0.0)
    recall = F.when(none, 1.0).when(both + missed > 0, both / (both + missed)).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    weighted = F.when(F.size(expected) > 0, F.greatest(F.lit(0.0), 1 - (2 * false + missed) / (2 * F.size(expected)))).when(false == 0, 1.0).otherwise(0.0)
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), weighted.alias("weighted"))


def evaluate(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Each golden word with its measures; a word without a row in ``actual`` has no breaks."""
    joined = expected.join(actual, "word", "left").withColumn("breaks", F.coalesce("breaks", F.array().cast("array<int>")))
    return joined.withColumn("m", measures(F.col("expected"), F.col("breaks"))).select("word", "frequency", "expected", "breaks", "m.*")


def summary(evaluated: DataFrame) -> DataFrame:
    """One row: words, mean F1, mean breaks expected and found."""
    return evaluated.agg(F.count(F.lit(1)).alias("words"), F.avg("f1").alias("f1"), F.avg(F.size("expected")).alias("expected"), F.avg(F.size("breaks")).alias("found"))


def worst(evaluated: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` words of the least weighted score."""
    return evaluated.where("weighted < 0.999999").orderBy("weighted", F.desc("frequency"), "word").limit(k)
