"""Exact dedup with a log-structured merge index of text digests.

* **Memtable**: each task gathers (digest, id) rows in a table of bounded size; when it is
  full, or the task ends, it is collapsed to one row a digest, sorted and flushed as a run.
* **Filters**: run files carry Parquet Bloom filters and min/max statistics on the digest,
  so a point lookup skips the row groups that cannot hold it.
* **Compaction**: runs of one level are merged by digest into one run of the next level;
  of equal digests the smallest identifier is kept (largest with ``keep="largest"``).
* **Byte verification**: rows whose digest hits are compared by their bytes: equal digests
  with different texts become different groups.

Defined results: a null text counts as the empty text. Null ids never stay unless all ids of
the group are null. Rows that repeat an id *and* a text are the same document and share one
verdict. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, work_path

RUN_SCHEMA = "run string, digest binary, least long, greatest long, n long"


def memtables(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Collapse (digest, id) batches into sorted runs of at most ``limit`` input rows each."""
    from pyspark import TaskContext

    part, flushed, held, rows = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal flushed, held, rows
        if rows:
            t = pa.Table.from_batches(held).group_by("digest").aggregate([("id", "min"), ("id", "max"), ("digest", "count")])
            t = t.sort_by("digest")
            run = pa.array([f"{part:06d}-{flushed:04d}"] * len(t))
            out = pa.table([run, t["digest"], t["id_min"], t["id_max"], t["digest_count"]], names=["run", "digest", "least", "greatest", "n"])
            yield from out.combine_chunks().to_batches(max_chunksize=50_000)
            flushed, held, rows = flushed + 1, [], 0

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= limit:
            yield from flush()
    yield from flush()


class DigestIndex:
    """The merge index: level-0 runs, compacted levels, and lookups with byte verification."""

    def __init__(self, spark: SparkSession, keep: str = "smallest", memtable_rows: int = 250_000, broadcast_rows: int = 500_000):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is 'smallest' or 'largest'")
        self.spark, self.keep, self.memtable_rows, self.broadcast_rows = spark, keep, memtable_rows, broadcast_rows
        self.root, self.level0, self.compacted = work_path(spark, "digest-index"), [], None

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.root}/{name}"
        df.write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.expected.ndv#digest", "100000").parquet(path)
        return path

    def append(self, rows: DataFrame) -> None:
        """Flush the memtables of ``rows`` (digest binary, id long) as level-0 runs."""
        limit = self.memtable_rows
        runs = rows.select("digest", "id").mapInArrow(lambda it: memtables(it, limit), RUN_SCHEMA)
        self.level0.append(self._write(runs, f"level0-{len(self.level0):05d}"))

    def compact(self) -> DataFrame:
        """Merge all runs into one sorted run: digest, least, greatest, n."""
        parts = [self.spark.read.schema(RUN_SCHEMA).parquet(p) for p in self.level0]
        if self.compacted is not None:
            parts.append(self.spark.read.schema(RUN_SCHEMA).parquet(self.compacted))
        merged = parts[0]
        for p in parts[1:]:
            merged = merged.unionByName(p)
        out = (
            merged.groupBy("digest")
            .agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("n").alias("n"))
            .select(F.lit("compacted").alias("run"), "digest", "least", "greatest", "n")
            .sortWithinPartitions("digest")
        )
        self.compacted = self._write(out, f"level1-{len(self.level0):05d}")
        self.level0 = []
        return self.entries()

    def entries(self) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(self.compacted).drop("run")

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """Point lookup of a few digests; the run filters skip row groups."""
        return self.entries().where(F.col("digest").isin([F.lit(bytearray(d)) for d in digests]))

    def small(self, df: DataFrame) -> DataFrame:
        """Broadcast hint for ``df`` only if its counted rows are within the bound (64 bytes each)."""
        return F.broadcast(df) if df.count() <= self.broadcast_rows else df

    def verified(self, texts: DataFrame) -> DataFrame:
        """Groups of equal bytes among the rows whose digest occurs more than once.

        ``texts`` has digest, id, text. Grouping by digest *and* text is the byte comparison;
        each task first collapses its own copies, so a hot group leaves it as one row.
        """
        hits = self.entries().where("n > 1").select("digest")
        same = (
            texts.join(self.small(hits), "digest", "left_semi")
            .groupBy("digest", "text")
            .agg(F.min("id").alias("least"), F.max("id").alias("greatest"), F.count(F.lit(1)).alias("n"))
        )
        return materialise(same.withColumn("text", F.when(F.count(F.lit(1)).over(_by_digest()) > 1, F.col("text"))), "digest-verified")


def _by_digest():
    from pyspark.sql import Window

    return Window.partitionBy("digest")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "smallest", normalise=None, **limits: int) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    ``normalise``: Column -> Column applied to the text first (default: none).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = base.select(F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), "id", "text")
    index = DigestIndex(spark, keep, **limits)
    index.append(rows)
    index.compact()
    groups = index.verified(rows)
    stays = F.col("least") if keep == "smallest" else F.col("greatest")
    # Usual case: one text a digest. The join needs the digest alone, and AQE splits a hot one.
    plain = index.small(groups.where("text is null").select("digest", stays.alias("keep_id"), F.col("n").alias("group_size")))
    joined = rows.select("digest", "id").join(plain, "digest", "left")
    # Digest collisions: the text decides. Normally this branch has no rows.
    clashing = groups.where("text is not null")
    if clashing.limit(1).count():
        odd = clashing.select("digest").distinct()
        joined = rows.select("digest", "id").join(odd, "digest", "left_anti").join(plain, "digest", "left").unionByName(
            rows.join(clashing.select("digest", "text", stays.alias("keep_id"), F.col("n").alias("group_size")), ["digest", "text"]).drop("text")
        )
    alone = F.col("group_size").isNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1)).alias("group_size"),
        F.when(alone, True).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
