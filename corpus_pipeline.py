"""Corpus pipeline: language ID, near-dedup, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``.

Defined results: null texts and texts without a letter go in the first stage; null and repeated
ids pass all stages as rows of their own; rows of equal id, text and source count as one in the mix,
taken as often as all of them together; an empty table gives an empty result, and a benchmark
without words drops nothing; further columns of ``documents`` are carried along, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.decontaminate import without_leaks
from lexispark.llm.language_id import identify, learn
from lexispark.llm.mixing import mix
from lexispark.llm.near_copies import near_copies
from lexispark.llm.queries import table, tokenizer_path
from lexispark.llm.simhash import keep_first
from lexispark.llm.token_output import read_tokens, write_tokens
from lexispark.session import arrow_batches, materialise, work_path

#: A document goes if no language is recognised with at least this score.
LEAST_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; texts that are null or hold no letter go."""
    texts = docs.where(F.col("text").isNotNull())
    # Only the digests of texts that go are written, inside the bound on what the workers get at a time.
    with arrow_batches(spark):
        named = identify(texts.select(F.md5("text").alias("digest"), "text"), learn(docs), keep=("digest",))
        gone = named.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_LANGUAGE_SCORE)).select("digest").distinct()
        gone = materialise(gone, "no-language")
    few = F.broadcast(gone) if gone.count() <= 200_000 else gone
    return texts.join(few, F.md5(texts["text"]) == gone["digest"], "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (five words, 0.8 or more)."""
    return keep_first(docs, near_copies(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a row a copy."""
    key = F.struct(F.col("doc_id").alias("id"), F.md5("text").alias("text"), F.col("source").alias("source"))
    keyed = docs.withColumn("__key", key)
    copies = mix(keyed, id_col="__key").where("copies > 0").groupBy("__key").agg(F.sum("copies").cast("int").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    copies = materialise(copies, "mix-copies")
    taken = keyed.join(copies, keyed["__key"].eqNullSafe(copies["__key"])).drop(keyed["__key"])
    # Equal rows: one stands for all. Usually there are none, and nothing more is shuffled.
    if copies.where("__rows > 1").limit(1).count():
        taken = taken.where("__rows = 1").unionByName(taken.where("__rows > 1").dropDuplicates(["__key"]))
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Arrow files; a row a document, read back from them."""
    return read_tokens(write_tokens(docs, tokenizer_path()))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_files", token_files),
]

#: XXH64, a trained classifier and a tokenizer: not expressible in DuckDB SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = work_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
