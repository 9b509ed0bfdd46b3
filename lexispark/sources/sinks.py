"""Sinks: the library's index, book caches, sections, JSON stores, progress and bookmarks.

All write Parquet or JSON by Spark's committers into a folder of their own and are read back
whole; a folder that is not finished has no ``_SUCCESS`` and is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import global_rank


def finished(spark: SparkSession, path: str) -> bool:
    """Was the folder's last write committed?"""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def read_finished(spark: SparkSession, path: str) -> DataFrame:
    if not finished(spark, path):
        raise FileNotFoundError(f"{path} was not written to its end")
    return spark.read.parquet(path)


def emit_index(books: DataFrame, path: str, version: int = 1) -> None:
    """The index: records in title order with their ranks by title, author and arrival, the header in ``header``.

    ``books`` has path, title_key, author_key, first_seen. Files are ranges of the title rank, so a
    page of the list is a read of few row groups.
    """
    ranks = global_rank(books, [F.col("title_key"), F.col("path")], "title_rank")
    ranks = global_rank(ranks, [F.col("author_key") == "", F.col("author_key"), F.col("title_key"), F.col("path")], "author_rank")
    ranks = global_rank(ranks, [F.col("first_seen"), F.col("path")], "arrival_rank")
    ranks.repartitionByRange("title_rank").sortWithinPartitions("title_rank").write.mode("overwrite").parquet(f"{path}/records")
    records = books.sparkSession.read.parquet(f"{path}/records")
    records.agg(F.lit("CLIX").alias("magic"), F.lit(version).alias("version"), F.count(F.lit(1)).alias("books")).write.mode("overwrite").parquet(f"{path}/header")


def read_index(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """The records, if the header fits them; a count or version that differs is an error."""
    head = read_finished(spark, f"{path}/header").first()
    records = read_finished(spark, f"{path}/records")
    if head["magic"] != "CLIX" or head["version"] != version or head["books"] != records.count():
        raise ValueError("the index does not fit its header")
    return records


def write_book_cache(spine: DataFrame, toc: DataFrame, path: str) -> None:
    """Spine and contents of books, partitioned by nothing, sorted by book for reads of one."""
    for name, df in (("spine", spine), ("toc", toc)):
        df.repartitionByRange("book").sortWithinPartitions("book", "idx").write.mode("overwrite").parquet(f"{path}/{name}")


def commit_sections(sections: DataFrame, path: str) -> None:
    """Sections, whole or partial: ``bytes_consumed`` below ``total_bytes`` marks a partial one.

    Only the chapters in ``sections`` are replaced.
    """
    marked = sections.withColumn("is_partial", F.col("bytes_consumed") < F.col("total_bytes"))
    marked.repartition("book").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book", "chapter").parquet(path)


def resume_points(spark: SparkSession, path: str) -> DataFrame:
    """Where partial sections go on: (book, chapter, bytes_consumed), and the share done."""
    parts = spark.read.parquet(path).where("is_partial")
    return parts.groupBy("book", "chapter").agg(F.max("bytes_consumed").alias("bytes_consumed"), (F.max("bytes_consumed") / F.max("total_bytes")).alias("share"))


def json_rows(df: DataFrame, most_bytes: int = 512) -> DataFrame:
    """(value): each row as a JSON object; those of ``most_bytes`` or more are left out."""
    return df.select(F.to_json(F.struct("*")).alias("value")).where(F.octet_length("value") < most_bytes)


def save_store(df: DataFrame, path: str) -> None:
    """A JSON object a line."""
    df.write.mode("overwrite").json(path)


def save_progress(progress: DataFrame, path: str) -> None:
    """The last position of each book by ``saved_at``; written beside the old file, then put in its place by the committer."""
    last = progress.groupBy("book").agg(F.max_by(F.struct("spine", "page", "pct"), "saved_at").alias("p"), F.max("saved_at").alias("saved_at"))
    last.select("book", "p.*", "saved_at").write.mode("overwrite").parquet(path)


def save_bookmarks(marks: DataFrame, path: str) -> None:
    """Bookmarks as JSON, a folder a book: its path without the first slash, slashes flattened, the last suffix cut."""
    flat = F.regexp_replace(F.regexp_replace(F.expr("substring(path, 2)"), r"[/\\]", "_"), r"\.[^.]*$", "")
    marks.withColumn("book", flat).write.mode("overwrite").partitionBy("book").json(path)


def write_deltas(df: DataFrame, key: str, order: str, value: str, path: str) -> None:
    """CSV with each value's change from the one before of its key."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    df.withColumn("delta", F.col(value) - before).write.mode("overwrite").option("header", "true").csv(path)
