"""What the stages leave in Python workers, and how much they send them at a time."""

import time

import pyarrow as pa
import pytest

import corpus_pipeline
from lexispark.llm import token_output
from lexispark.llm.queries import tokenizer_path

LIMITS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
WORDS = {"en": "the house stands near the old river and we walk there", "de": "das haus steht am alten fluss und wir gehen oft dorthin"}


def documents(spark, n=200):
    rows = [(i, f"{WORDS[lang]} {i}", lang, "s", 0) for i in range(n) for lang in ["en" if i % 2 else "de"]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8)


def test_idle_workers_let_go_of_their_encoder(spark):
    token_output.write_tokens(documents(spark), tokenizer_path())
    time.sleep(4)

    def held(batches):
        from lexispark.llm import token_output

        for b in batches:
            yield pa.record_batch([pa.array([len(token_output._encoders)] * b.num_rows, pa.int64())], names=["n"])

    assert {r.n for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()} == {0}


def test_encoder_stays_while_tasks_follow(monkeypatch):
    monkeypatch.setattr(token_output, "IDLE_S", 0.3)
    first = token_output.encoder_of(tokenizer_path(), "<u2")
    token_output.let_go_when_idle()
    assert token_output.encoder_of(tokenizer_path(), "<u2") is first
    time.sleep(0.6)  # a task of that worker runs on
    assert list(token_output._encoders.values()) == [first]
    token_output.let_go_when_idle()
    time.sleep(0.6)
    assert not token_output._encoders


@pytest.mark.parametrize("module, stage", [(token_output, "token_files"), (corpus_pipeline, "language_id")])
def test_stages_send_few_texts_at_a_time(spark, monkeypatch, module, stage):
    docs, before, seen, write = documents(spark), [spark.conf.get(k) for k in LIMITS], set(), module.materialise

    def noted(df, name, **options):
        seen.add(tuple(spark.conf.get(k) for k in LIMITS))
        return write(df, name, **options)

    monkeypatch.setattr(module, "materialise", noted)
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs, "").count() == 200
    assert seen == {("1024", "8m")}
    assert [spark.conf.get(k) for k in LIMITS] == before


def test_language_id_writes_no_text_and_keeps_columns(spark, monkeypatch):
    docs = documents(spark, 40).unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in [(90, None), (91, ""), (92, "1 2 3"), (93, "1 2 3"), (None, f"{WORDS['en']} 1")]], documents(spark, 1).schema))
    docs = docs.selectExpr("*", "doc_id AS digest", "1 AS lang_pred", "2 AS score")
    wrote, write = [], corpus_pipeline.materialise
    monkeypatch.setattr(corpus_pipeline, "materialise", lambda df, name: wrote.append(write(df, name)) or wrote[-1])
    got = corpus_pipeline.language_id(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted([*range(40), None], key=str)
    assert [(t.columns, t.count()) for t in wrote] == [(["digest"], 2)]
