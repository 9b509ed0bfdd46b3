"""Queries that lay out whole texts. Line breaking is a fold over a paragraph: no SQL twin, see its tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout

#: Cells of a line, lines of a page, pages laid out in a turn.
WIDTH, LINES, TURN = 60, 20, 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of every text."""
    return layout.pages(documents(spark, sf_dir), WIDTH, LINES)


def text_pages_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next pages of every text from an offset within it."""
    start = F.expr("CAST(doc_id * 37 % (length(coalesce(text, '')) + 1) AS INT)")
    return layout.next_pages(documents(spark, sf_dir).withColumn("offset", start), WIDTH, LINES, TURN)


def line_break_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.even_lines(documents(spark, sf_dir), WIDTH, indent=2)
    return out.select("doc_id", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("shown"))


def line_break_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.filled_lines(documents(spark, sf_dir), WIDTH, indent=2)
    return out.select("doc_id", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("shown"))


_SHOWN = rf"list_transform(raw, lambda p, i: CASE WHEN ends_with(p, chr(10)) OR i = ends THEN left(regexp_replace(p, '\r?\n?\z', ''), {WIDTH}) ELSE regexp_replace(p, ' \z', '') END)"

TEXT_PAGES_SQL = f"""WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{layout.piece_pattern(WIDTH)}') AS raw FROM documents),
both_ AS (SELECT doc_id, raw, {_SHOWN} AS seen, unnest(range(0, (ends - 1) // {LINES} + 1)) AS page FROM (SELECT *, len(raw) AS ends FROM cut) AS c WHERE ends > 0)
SELECT doc_id, CAST(page AS INT) AS page, CAST(len(raw[page * {LINES} + 1 : page * {LINES} + {LINES}]) AS INT) AS n_lines, CAST(length(array_to_string(raw[page * {LINES} + 1 : page * {LINES} + {LINES}], '')) AS INT) AS n_chars, array_to_string(seen[page * {LINES} + 1 : page * {LINES} + {LINES}], chr(10)) AS shown FROM both_"""

RESUMED_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x, CAST(doc_id * 37 % (length(coalesce(text, '')) + 1) AS INT) AS "offset" FROM documents),
cut AS (SELECT doc_id, "offset", length(x) AS total, regexp_extract_all(substr(x, "offset" + 1), '{layout.piece_pattern(WIDTH)}')[1:{TURN * LINES}] AS raw FROM d),
taken AS (SELECT *, CAST("offset" + length(array_to_string(raw, '')) AS INT) AS next_offset FROM cut WHERE len(raw) > 0),
placed AS (SELECT *, CASE WHEN next_offset = total THEN len(raw) ELSE 0 END AS ends FROM taken)
SELECT doc_id, "offset", next_offset, CAST(ceil(len(raw) / {LINES}.0) AS INT) AS n_pages, array_to_string({_SHOWN}, chr(10)) AS shown, next_offset < total AS is_partial FROM placed"""

QUERIES = {"text_pages": (text_pages, TEXT_PAGES_SQL), "text_pages_resumed": (text_pages_resumed, RESUMED_SQL), "line_break_dp": (line_break_dp, None), "line_break_filled": (line_break_filled, None)}
