"""Readers of library files; all are lazy scans that executors read in parallel.

A file that cannot be parsed gives no entries (containers) or nulls (metadata); null and empty
input is treated alike.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOOK = r"(?i)\.(epub|txt|md|xtc)$"


def library_files(spark: SparkSession, root: str, depth: int = 5) -> DataFrame:
    """(path, name, file_size, mtime) of the books under ``root``, not hidden, not empty, to a depth."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.expr(f"substr(path, locate('{root.rstrip('/').split('://')[-1].lstrip('/')}', path) + {len(root.rstrip('/').split('://')[-1].lstrip('/')) + 1})")
    listed = got.select(rel.alias("path"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("file_size"), F.unix_timestamp("modificationTime").alias("mtime"))
    return listed.where(F.col("name").rlike(BOOK) & ~F.col("name").startswith(".") & (F.col("file_size") > 0) & (F.size(F.split("path", "/")) <= depth))


def zip_entries(spark: SparkSession, root: str, entry: str | None = None) -> DataFrame:
    """(path, entry, method, packed, size, content) of the containers under ``root``.

    ``content`` is read only for entries whose name matches the pattern ``entry``; it is null where an
    entry is encrypted, damaged or packed by an unknown method.
    """
    import re

    wanted = re.compile(entry) if entry else None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    names = ["path", "entry", "method", "packed", "size", "content"]

    def content(z: zipfile.ZipFile, e: zipfile.ZipInfo) -> bytes | None:
        try:
            return z.read(e)
        except (RuntimeError, zipfile.BadZipFile, zlib.error, EOFError, OSError):  # NotImplementedError is a RuntimeError
            return None

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(raw.as_py() or b"")) as z:
                        for e in z.infolist():
                            rows.append((path, e.filename, e.compress_type, e.compress_size, e.file_size, content(z, e) if wanted and wanted.search(e.filename) else None))
                except zipfile.BadZipFile:
                    continue
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    return files.mapInArrow(listed, "path string, entry string, method int, packed long, size long, content binary")


def opf_metadata(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Adds title (the first) and author (all creators, joined) of package documents."""
    def each(tag: str) -> str:
        return f"transform(xpath({xml}, '//*[name()=\"{tag}\"]/text()'), x -> trim(regexp_replace(x, '\\\\s+', ' ')))"

    return df.withColumn("title", F.expr(f"get({each('dc:title')}, 0)")).withColumn("author", F.expr(f"nullif(array_join({each('dc:creator')}, ', '), '')"))


def opf_spine(df: DataFrame, keep: list[str], xml: str = "xml") -> DataFrame:
    """A row an item of the spine in order, with the manifest's href (the first of a repeated id); items not
    in it are left out."""
    def attr(path: str) -> str:
        return f"xpath({xml}, '//*[name()=\"{path.split('/')[0]}\"]/@{path.split('/')[1]}')"

    got = df.selectExpr(*keep, f"arrays_zip({attr('item/id')}, {attr('item/href')}) AS m", f"posexplode({attr('itemref/idref')}) AS (idx, idref)")
    return got.selectExpr(*keep, "idx", "idref", "get(filter(m, x -> x.`0` = idref), 0).`1` AS href").where("href IS NOT NULL")


def feed_entries(df: DataFrame, keep: list[str], xml: str = "xml") -> DataFrame:
    """A row an entry of a feed: title and href, a plain book link preferred; others are left out."""
    schema = "entry array<struct<title:string, id:string, link:array<struct<_href:string, _rel:string, _type:string>>>>"
    got = df.select(*keep, F.expr(f"explode(from_xml({xml}, '{schema}').entry) AS e"))
    best = "array_sort(transform(e.link, (l, i) -> struct(CASE WHEN l._type = 'application/epub+zip' AND l._href LIKE '%.epub' THEN 0 WHEN l._type = 'application/epub+zip' THEN 1 ELSE 2 END AS rank, i AS at, l._href AS href)))"
    return got.selectExpr(*keep, "e.title AS title", f"get({best}, 0).href AS href").where("title IS NOT NULL AND href IS NOT NULL")


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of lines ``KEY: "value"``."""
    line = r'^([A-Za-z_][A-Za-z0-9_]*):\s*"(.*)"\s*$'
    return spark.read.text(path).where(F.col("value").rlike(line)).select(F.regexp_extract("value", line, 1).alias("key"), F.regexp_extract("value", line, 2).alias("value"))


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Replace the table at ``path`` unless it holds the same rows; whether it was written.

    The new rows are written aside and moved over the old ones, so a lost job leaves the old table.
    """
    spark = df.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    at, aside, old = jvm_path(path), jvm_path(path + ".new"), jvm_path(path + ".old")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) and fs.exists(old):  # a move was cut off
        fs.rename(old, at)
    df.write.mode("overwrite").parquet(path + ".new")
    if fs.exists(at):
        now, new = spark.read.parquet(path), spark.read.parquet(path + ".new")
        if now.schema == new.schema and not now.exceptAll(new).limit(1).count() and not new.exceptAll(now).limit(1).count():
            fs.delete(aside, True)
            return False
        fs.delete(old, True)
        fs.rename(at, old)
    fs.rename(aside, at)
    fs.delete(old, True)
    return True


def stardict(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Dictionaries under ``root``: (path, ordinal, headword, at, size) of the index files and (path, word, ordinal)
    of the synonym files. ``path`` is without the suffix. Indexes of 64-bit offsets are refused: they give no rows."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    of = lambda suffix: scan.option("pathGlobFilter", f"*.{suffix}").load(root).select(F.regexp_replace("path", r"\.[a-z]+$", "").alias("path"), "content")
    wide = of("ifo").where(F.decode("content", "UTF-8").rlike(r"(?m)^idxoffsetbits\s*=\s*64")).select("path")

    def words(raw: bytes, tail: str) -> Iterator[tuple]:
        at, size = 0, struct.calcsize(tail)
        while (end := raw.find(b"\0", at)) >= 0 and end + 1 + size <= len(raw):
            yield raw[at:end].decode("utf-8", "replace"), *struct.unpack(tail, raw[end + 1 : end + 1 + size])
            at = end + 1 + size

    def parsed(tail: str, names: list[str], kinds: list[pa.DataType], shape):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                    rows = [(path, *shape(i, w)) for i, w in enumerate(words(raw.as_py() or b"", tail))]
                    for k in range(0, len(rows), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 50_000]), kinds)], names=names)

        return run

    index = of("idx").join(wide, "path", "left_anti").mapInArrow(parsed(">II", ["path", "ordinal", "headword", "at", "size"], [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], lambda i, w: (i, w[0], w[1], w[2])), "path string, ordinal long, headword string, at long, size long")
    synonyms = of("syn").mapInArrow(parsed(">I", ["path", "word", "ordinal"], [pa.string(), pa.string(), pa.int64()], lambda i, w: (w[0], w[1])), "path string, word string, ordinal long")
    return index, synonyms
