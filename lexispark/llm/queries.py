"""The queries of this subpackage and their SQL, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, in_fold, learn

    docs = table(spark, sf_dir, "documents").withColumn("held_out", in_fold(F.col("doc_id"), 4, 2))
    return identify(docs, learn(docs.where("not held_out")), keep=("doc_id", "held_out"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import in_fold
    from .toxicity import learn, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    docs = docs.withColumn("held_out", in_fold(F.col("doc_id"), 3, 1))
    labels = labels.where(~in_fold(F.col("doc_id"), 3, 1))
    model = learn(docs.where("not held_out"), labels)
    return score(docs, model, keep=("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, find_pii

    return digest(find_pii(table(spark, sf_dir, "documents")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import read_tokens, write_tokens

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), tokenizer_path()))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": op1_secrets,
        "op2_language_id": op2_language_id,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_source_mix": op4_source_mix,
        "op5_toxicity": op5_toxicity,
        "op6_main_text": op6_main_text,
        "op7_pii": op7_pii,
        "op8_decontaminate": op8_decontaminate,
        "op9_token_files": op9_token_files,
        "op10_exact_dedup": op10_exact_dedup,
        "pipeline": pipeline,
    }


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": OP10_SQL}
