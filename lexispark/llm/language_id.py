"""Language identification by a string kernel.

The kernel of two texts is the number of hashed byte n-grams (orders 1 to 3, blended) present in
both, normalised by the numbers present in each. ``landmarks`` texts of the training sample give
the Nyström approximation of the kernel's feature space, in which one ridge regression a language
is solved against the rest. Scoring multiplies a batch's presence matrix with the landmarks and
the result with the regressions.

Training rows are a bounded sample, ``per_class`` texts a language, chosen by a hash of the id;
whole texts are read, in training as in scoring. The driver gets the presence bits of the sample,
1 KB a text however long it is. The model is a few MB, whatever the corpus.

Defined results: ``und`` with score 0 for texts that are null or hold no letter, and for all texts
if there is nothing to learn from; rows with null language or text are not learned from; repeated
rows are scored alike; an empty table gives an empty result; other columns are ignored, and a kept
column of the same name as one of the result's gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import hand_back

NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Odd multipliers of the n-gram hash, one an order.
MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263)


def presence(texts: list[str], bits: int, orders: int) -> np.ndarray:
    """One row a text: 1 where a hashed byte n-gram of the lower-cased letters is present."""
    out = np.zeros((len(texts), 1 << bits), dtype=np.float32)
    for row, t in zip(out, texts):
        b = np.frombuffer(NOT_LETTERS.sub(" ", f" {t.lower()} ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        code = np.zeros(len(b), np.uint32)
        for n in range(orders):
            code = code[: len(b) - n] * np.uint32(257) + b[n:] + np.uint32(n)
            row[(code * np.uint32(MULTIPLIERS[n])) >> np.uint32(32 - bits)] = 1
    return out


@dataclass
class KernelModel:
    classes: list[str]
    marks: np.ndarray  # landmarks, normalised: bins x landmarks
    weights: np.ndarray  # landmarks x classes
    bits: int
    orders: int

    def values(self, texts: list[str]) -> np.ndarray:
        x = presence(texts, self.bits, self.orders)
        k = x @ self.marks / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return k @ self.weights

    def predict(self, texts: list[str], sharpness: float = 4.0) -> tuple[list[str], np.ndarray]:
        f = self.values(texts) * sharpness
        e = np.exp(f - f.max(1, keepdims=True))
        return [self.classes[i] for i in f.argmax(1)], (e.max(1) / e.sum(1)).astype(float)


def train(texts: list[str], labels: list[str], landmarks: int = 64, ridge: float = 1e-2, bits: int = 13, orders: int = 3) -> KernelModel | None:
    return fit([np.packbits(presence([t], bits, orders)[0] > 0) for t in texts], labels, landmarks, ridge, bits, orders)


def fit(present: list[np.ndarray], labels: list[str], landmarks: int = 64, ridge: float = 1e-2, bits: int = 13, orders: int = 3) -> KernelModel | None:
    """The model of texts given by their packed presence bits."""
    if not present:
        return None

    def rows(some: list[np.ndarray]) -> np.ndarray:
        return np.unpackbits(np.stack(some), axis=1).astype(np.float32)

    classes = sorted(set(labels))
    turn: dict[str, int] = {}
    rank = []
    for y in labels:  # landmarks go round the languages
        turn[y] = turn.get(y, -1) + 1
        rank.append(turn[y])
    chosen = np.argsort(rank, kind="stable")[:landmarks]
    marks = rows([present[i] for i in chosen])
    marks = (marks / np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))).T.copy()
    knm = []
    for at in range(0, len(present), 64):
        x = rows(present[at : at + 64])
        knm.append(x @ marks / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)))
    knm = np.vstack(knm).astype(np.float64)
    val, vec = np.linalg.eigh((marks.T @ marks).astype(np.float64))
    good = val > 1e-8 * val.max()
    root = vec[:, good] / np.sqrt(val[good])
    z = knm @ root
    y = np.where(np.array(labels)[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    balance = 1.0 / np.array([labels.count(c) for c in labels])  # each language weighs the same
    w = np.linalg.solve(z.T @ (z * balance[:, None]) + ridge * np.eye(z.shape[1]) / max(1, len(classes)), z.T @ (y * balance[:, None]))
    return KernelModel(classes, marks.astype(np.float32), (root @ w).astype(np.float32), bits, orders)


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_class: int = 400, bits: int = 13, orders: int = 3, **options) -> KernelModel | None:
    """Train on at most ``per_class`` rows a language, those with the least hash of id and text.

    Two passes over the texts, however many languages there are: one counts them, one takes the sample.
    """
    rows = rows.select(F.col(lang_col).cast("string").alias("y"), F.col(text_col).alias("t"), F.xxhash64(F.lit(7), F.col(id_col).cast("string")).alias("h")).where("y is not null and t is not null")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not counts:
        return None
    # Twice the wanted share by hash, then the first of each language among these few: no sort of all texts.
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, min(1.0, 2.0 * per_class / n)).otherwise(share)
    some = rows.where((F.pmod("h", F.lit(1 << 20)) / float(1 << 20)) < share).where(F.col("t").rlike(r"\p{L}"))
    first = some.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h", "t"))).where(F.col("k") <= per_class)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.packbits(presence([t.as_py()], bits, orders)[0] > 0).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], names=["y", "k", "bits"])

    taken = first.select("y", "k", "t").mapInArrow(packed, "y string, k int, bits binary").collect()
    taken.sort(key=lambda r: (r["y"], r["k"]))
    return fit([np.frombuffer(r["bits"], np.uint8) for r in taken], [r["y"] for r in taken], bits=bits, orders=orders, **options)


def identify(docs: DataFrame, model: KernelModel | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), batch: int = 32, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns, the language and its score (``names``) of every row of ``docs``."""
    lang_name, score_name = names
    keep = tuple(c for c in keep if c not in names)
    if model is None:
        return docs.select(*keep, F.lit("und").alias(lang_name), F.lit(0.0).alias(score_name))
    # The text goes to the workers once, also where it is kept.
    sent = keep if text_col in keep else (*keep, text_col)
    rows = docs.select(*sent, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    schema = docs.select(*keep).schema.add(lang_name, "string").add(score_name, "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB: landmarks x bins

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(sent.index(text_col))
            lang, prob = ["und"] * len(texts), np.zeros(len(texts))
            at = np.flatnonzero(b.column(len(sent)).to_numpy(zero_copy_only=False))
            for k in range(0, len(at), batch):
                own = at[k : k + batch].tolist()
                got, p = m.predict([texts[i].as_py() for i in own])
                for i, g, q in zip(own, got, p):
                    lang[i], prob[i] = g, q
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(lang), pa.array(prob)], names=[*keep, *names])
        hand_back()

    return rows.mapInArrow(score, schema)


def in_fold(id_col: Column, folds: int, fold: int) -> Column:
    """Is crc32 of the id as text, modulo ``folds``, the given fold? (A null id is in none.)"""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))
