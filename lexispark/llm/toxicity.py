"""Toxicity by a counterfactually regularised linear classifier.

Features are the distinct lower-cased words of a text and their first 4, 5 and 6 letters (marked by
a hyphen), so endings unseen in training still count; those most associated with a label by the
likelihood-ratio statistic are taken, and the model is logistic. Beside the labelled
sentences it sees their counterfactuals, in which identity terms are swapped for one another, and
pays for each change of the score: ``lam`` times the mean squared difference of the logits of a
sentence and its counterfactual. Sentences that name no group get a neutral mention, so the
penalty holds also where labelled data name no group; a group's name alone then moves no score.

Training rows are a bounded sample of labelled rows, at most ``per_label`` of each label, chosen
by a hash of the id among the ids that ``docs`` holds. Whole texts are read, in training as in
scoring; the driver gets the distinct words of each, not the texts.

Defined results: null and empty texts get the score of no words; with nothing to learn from all
scores are the share of toxic labels (0 if there are none); labels that are null or that differ
between rows of one document are settled by the largest; documents that repeat an id are scored
alike and learned from once, by the least text; an empty table gives an empty result; other columns
are ignored, and a kept column named ``score`` gives way to the result's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Identity terms, by the group of words that can stand for one another.
IDENTITY = [
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"],
    ["black", "white", "asian", "latino", "african", "european", "arab"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["women", "men", "girls", "boys"],
    ["immigrant", "refugee", "foreigner", "native"],
    ["disabled", "blind", "deaf", "autistic"],
    ["frauen", "männer"], ["femmes", "hommes"], ["mujeres", "hombres"],
]
GROUP = {w: i for i, g in enumerate(IDENTITY) for w in g}
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


STEMS = (4, 5, 6)


def features(own: set[str]) -> set[str]:
    """Words and their stems."""
    out = set(own)
    for k in STEMS:
        out.update([w[:k] + "-" for w in own if len(w) >= k])
    return out


def associated(bags: list[set[str]], labels: list[int], most: int, least: int) -> list[str]:
    """The ``most`` features with the greatest likelihood ratio against the label."""
    n, n1 = len(bags), sum(labels)
    both, pos = {}, {}
    for b, y in zip(bags, labels):
        for w in b:
            both[w] = both.get(w, 0) + 1
            if y:
                pos[w] = pos.get(w, 0) + 1
    names = sorted(w for w, k in both.items() if k >= least)
    c = np.array([both[w] for w in names], float)
    a = np.array([pos.get(w, 0) for w in names], float)

    def part(o: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-300) / np.maximum(e, 1e-300)), 0.0)

    p = n1 / n
    g = part(a, c * p) + part(c - a, c * (1 - p)) + part(n1 - a, (n - c) * p) + part(n - c - n1 + a, (n - c) * (1 - p))
    return [names[i] for i in np.argsort(-g, kind="stable")[:most]]


def counterfactual(own: set[str], pick: int) -> tuple[set[str], set[str]]:
    """A pair of word sets that differ in their identity terms only."""
    named = sorted(w for w in own if w in GROUP)
    if named:
        swap = {w: IDENTITY[GROUP[w]][(IDENTITY[GROUP[w]].index(w) + 1 + pick) % len(IDENTITY[GROUP[w]])] for w in named}
        return own, (own - set(named)) | set(swap.values())
    group = IDENTITY[pick % len(IDENTITY)]
    return own, own | {group[pick // len(IDENTITY) % len(group)]}


@dataclass
class ToxicModel:
    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.slots = {w: i for i, w in enumerate(self.weights)}
        self.values = np.array(list(self.weights.values()), float)
        self.known: dict[str, tuple[int, ...]] = {}

    def _slots(self, word: str) -> tuple[int, ...]:
        """The weights that a word touches; those of recent words are kept, up to a bounded number."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            got = self.known[word] = tuple(self.slots[x] for x in features({word}) if x in self.slots)
        return got

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of a batch: the distinct (text, weight) pairs are summed by one count."""
        n, of = max(1, len(self.values)), self._slots
        at = [row * n + i for row, t in enumerate(texts) for w in words(t) for i in of(w)]
        at = np.unique(np.array(at, np.int64))
        logit = self.bias + (np.bincount(at // n, self.values[at % n], len(texts)) if len(at) else np.zeros(len(texts)))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def train(texts: list[str], labels: list[int], **options) -> ToxicModel:
    return fit([words(t) for t in texts], labels, **options)


def fit(plain: list[set[str]], labels: list[int], lam: float = 20.0, l2: float = 1e-4, most: int = 300, least: int = 5, rounds: int = 300, rate: float = 0.1) -> ToxicModel:
    """Full-batch Adam on the logistic loss, the weights' size and the counterfactual penalty."""
    if not plain or len(set(labels)) < 2:
        p = sum(labels) / len(labels) if labels else 0.0
        return ToxicModel({}, float(np.clip(np.log(max(p, 1e-9) / max(1 - p, 1e-9)), -30, 30)))
    pairs = [(features(a - b), features(b - a)) for a, b in (counterfactual(x, i) for i, x in enumerate(plain))]
    bags = [features(b) for b in plain]
    chosen = associated(bags, labels, most, least)
    vocab = {w: i for i, w in enumerate(sorted({*chosen, *GROUP}))}

    def sparse(sets: list[set[str]]) -> tuple[np.ndarray, np.ndarray]:
        at = [[vocab[w] for w in s if w in vocab] for s in sets]
        return np.repeat(np.arange(len(sets)), [len(a) for a in at]), np.array([i for a in at for i in a], dtype=np.int64)

    rows, cols = sparse(bags)
    n, d = len(bags), len(vocab)
    # A pair's difference needs only the words that differ.
    plus, minus = sparse([a - b for a, b in pairs]), sparse([b - a for a, b in pairs])
    y = np.array(labels, float)
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    w, b = np.zeros(d), 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[cols], n), -30, 30)))
        e = share * (p - y)
        gap = np.bincount(plus[0], w[plus[1]], n) - np.bincount(minus[0], w[minus[1]], n)
        pay = 2 * lam * gap / n
        g = np.bincount(cols, e[rows], d) + np.bincount(plus[1], pay[plus[0]], d) - np.bincount(minus[1], pay[minus[0]], d) + l2 * w
        g = np.append(g, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8) * (1 - (k - 1) / rounds)
        w, b = w - step[:-1], b - step[-1]
    return ToxicModel({x: float(w[i]) for x, i in vocab.items()}, float(b))


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", per_label: int = 1500, **options) -> ToxicModel:
    """Train on at most ``per_label`` rows of each label, those with the least hash of the id."""
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    # Only ids that ``docs`` holds count towards the bound.
    held = docs.select(F.col(id_col).alias("__id")).where("__id is not null")
    y = y.join(held, "__id", "left_semi").withColumn("h", F.xxhash64(F.lit(11), F.col("__id").cast("string")))
    keys = [y.where(F.col("y") == k).orderBy("h", "__id").limit(per_label) for k in (0, 1)]
    keys = keys[0].unionByName(keys[1])  # at most 2 x per_label rows
    one = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t")).join(F.broadcast(keys), "__id").groupBy("__id", "y", "h").agg(F.min("t").alias("t"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(words(t.as_py())) for t in b.column(2)], pa.list_(pa.string()))], names=["h", "y", "words"])

    rows = sorted(one.select("h", "y", "t").mapInArrow(distinct, "h long, y int, words array<string>").collect(), key=lambda r: (r["h"], r["y"]))
    return fit([set(r["words"]) for r in rows], [r["y"] for r in rows], **options)


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), batch: int = 256) -> DataFrame:
    """``keep`` columns and the score of every row of ``docs``."""
    keep = tuple(c for c in keep if c != "score")
    rows = docs.select(*keep, F.col(text_col).alias("__t"))
    schema = rows.drop("__t").schema.add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight a word of the bounded sample

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            got = [m.scores(texts[k : k + batch]) for k in range(0, len(texts), batch)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate([np.zeros(0), *got]), pa.float64())], names=[*keep, "score"])

    return rows.mapInArrow(scored, schema)
