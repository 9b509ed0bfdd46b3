"""Odd rows, folds, brute force and held-out figures of the operators; the pipeline and its stages."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import language_id, mixing, secrets, simhash, toxicity
from lexispark.llm.decontaminate import contaminated, without_leaks
from lexispark.llm.exact_dedup import exact_dedup
from lexispark.llm.html_extract import extract
from lexispark.llm.pii import digest, find_pii
from lexispark.llm.token_output import read_tokens, write_tokens

#: Columns that the operators use inside, carried by every row.
CLASH = ["score", "lang_pred", "fp", "node", "least", "sid", "size", "n", "salt", "copies", "key", "root", "component", "th", "item", "words", "at", "y", "h", "t", "text_hash", "row", "shard", "digest", "id", "value", "path"]


def docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(i, t, "en", s, 0, *(["x"] * len(CLASH))) for i, t, s in rows], schema)


WORDS = "the house of rising sun and then some more words that stand in a row for all".split()
LONG = "some words in a row " * 40_000
ODD = [(1, " ".join(WORDS), "a"), (2, None, None), (3, "", "a"), (None, " ".join(WORDS), "b"), (None, None, None), (5, "one two", "a"), (5, "one two", "a"), (5, "other words here", "b"), (6, LONG, "b"), (7, "  \t ", "a")]


def model():
    return language_id.train(["the house of the sun"] * 3 + ["la maison des hommes"] * 3, ["en"] * 3 + ["fr"] * 3, landmarks=4)


def tox():
    return toxicity.ToxicModel({"scum": 3.0, "scum-": 1.0}, -2.0)


def bench(spark, rows=((7, " ".join(WORDS)), (8, ""), (9, None), (None, " ".join(WORDS)), (7, " ".join(WORDS)))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def tokenizer():
    return str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))


RUNS = {
    "secrets": lambda s, d: secrets.find_secrets(d, dictionary=[]),
    "language": lambda s, d: language_id.identify(d, model(), keep=tuple(d.columns)),
    "simhash": lambda s, d: simhash.near_dedup(d),
    "mix": lambda s, d: mixing.mix(d),
    "toxicity": lambda s, d: toxicity.score(d, tox(), keep=tuple(d.columns)),
    "pages": lambda s, d: extract(d, html_col="text", keep=("doc_id", "source")),
    "pii": lambda s, d: digest(find_pii(d)),
    "leaks": lambda s, d: without_leaks(d, bench(s)),
    "tokens": lambda s, d: read_tokens(write_tokens(d, tokenizer())),
    "exact": lambda s, d: exact_dedup(d),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows(spark, name):
    out = RUNS[name](spark, docs(spark, ODD)).collect()
    drops = {"secrets": len(ODD), "leaks": 2}.get(name, 0)  # the text that is the item stands twice
    assert len(out) == len(ODD) - drops
    assert RUNS[name](spark, docs(spark, [])).count() == 0
    if name in ("language", "toxicity"):  # the result's columns take the place of kept ones
        assert out[0]["score"] != "x" and len(set(out[0].asDict())) == len(out[0])


# --- op1 ----------------------------------------------------------------------------------------


def test_secret_forest_on_held_out_findings(spark):
    forest = secrets.default_forest(spark, [])
    rows = secrets.with_features(secrets.sample_findings(spark, 3000, first=1_000_000), []).withColumn("p", F.expr(forest) >= 0.5)
    n = {(r["label"], r["p"]): r["count"] for r in rows.groupBy("label", "p").count().collect()}
    right, wrong, missed = n[1.0, True], n.get((0.0, True), 0), n.get((1.0, False), 0)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_dictionary_is_learned(spark):
    rows = [(i, "Manager häuser manager " + "ab " * i, "s") for i in range(6)]
    assert secrets.learn_dictionary(docs(spark, rows)) == ["manager"]
    assert secrets.learn_dictionary(docs(spark, [])) == [] == secrets.learn_dictionary(docs(spark, [(1, None, None)]))
    one = spark.createDataFrame([("getManagerName7", "", "", "")], "candidate string, before string, after string, path string")
    assert secrets.with_features(one, ["manager"]).first()["covered"] > secrets.with_features(one, []).first()["covered"] - 1e-9


# --- op2 ----------------------------------------------------------------------------------------


def test_language_learns_from_its_rows_only(spark):
    en, fr = "the house and the river with many trees", "la maison et le fleuve avec des arbres"
    rows = [(i, f"{en if i % 2 else fr} {i}", "s") for i in range(40)]
    df = docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 3, F.lit(None)).when(F.col("doc_id") % 2 == 1, "en").otherwise("fr"))
    m = language_id.learn(df, per_class=8, landmarks=4)
    assert m.classes == ["en", "fr"]
    got = language_id.identify(df, m).collect()
    assert all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "fr") and 0 <= r["score"] <= 1 for r in got)
    assert language_id.learn(df.limit(0)) is None and language_id.learn(df.withColumn("lang", F.lit(None).cast("string"))) is None
    again = language_id.learn(df.repartition(7), per_class=8, landmarks=4)
    assert np.allclose(again.weights, m.weights, atol=1e-4)


def test_fold(spark):
    got = {r[0]: r[1] for r in spark.range(200).select("id", language_id.in_fold(F.col("id"), 4, 2)).collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 4 == 2) for k, v in got.items())


# --- op3 ----------------------------------------------------------------------------------------


def test_links_come_from_the_gray_tree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 30).astype(np.uint64)
    codes = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40)]))
    node = np.arange(len(codes)) % 3
    called = []
    ranks = simhash.gray_rank
    monkeypatch.setattr(simhash, "gray_rank", lambda x: called.append(len(x)) or ranks(x))
    order = np.argsort(node, kind="stable")
    links = simhash.tree_links(codes[order], 3, node[order])
    want = {(i, j) for i in range(len(codes)) for j in range(i) if node[order][i] == node[order][j] and int(codes[order][i] ^ codes[order][j]).bit_count() <= 3}
    assert called == [len(codes)] and {tuple(sorted(p, reverse=True)) for p in links} <= want
    import pyarrow as pa

    called.clear()
    batch = pa.record_batch([pa.array(node[order]), pa.array(codes[order].view(np.int64))], names=["node", "fp"])
    assert sum(b.num_rows for b in simhash._node_links(iter([batch]), 3)) == len(links) and called


# --- op4 ----------------------------------------------------------------------------------------


def test_rates_balance_and_say_when_they_do_not(spark):
    hist = spark.createDataFrame([(0, 10, 5), (0, 100, 5)], "sid int, size long, n long")
    source = {"sid": 0, "size": 550, "target": 700.0, "mean": 55.0}
    lam = mixing.balance(hist, [source], 2.0)[0]
    rate = lambda x: 2 * math.exp(lam * x / 55) / (1 + math.exp(lam * x / 55))
    assert abs(50 * rate(10) + 500 * rate(100) - 700) < 1e-3
    with pytest.raises(RuntimeError):
        mixing.balance(hist, [source], 2.0, most=1)
    with pytest.raises(ValueError):
        mixing.mix(docs(spark, [(1, "a", "p"), (2, "b", "q")]), most_sources=1)


# --- op5 ----------------------------------------------------------------------------------------


def toxic_rows(n=400):
    rng = np.random.default_rng(1)
    some = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    return [(i, " ".join(rng.choice(some, 20)) + (" scum" if i % 2 else ""), "s") for i in range(n)]


def test_toxicity_with_folds_and_labels(spark):
    rows = toxic_rows(1500)
    df = docs(spark, [*rows, rows[0], (None, "scum scum", "s"), (2000, None, "s")])
    labels = spark.createDataFrame([(i, 0, i % 2) for i, _, _ in rows] + [(0, 0, 0), (2, 0, None), (None, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    held = language_id.in_fold(F.col("doc_id"), 3, 1)
    m = toxicity.learn(df.where(~held), labels.where(~held), per_label=450)
    got = toxicity.score(df, m).collect()
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 2 == 1) for r in got if r["doc_id"] is not None and r["doc_id"] < 1500)
    assert {r["score"] >= 0.7 for r in got if r["doc_id"] is None} == {True} and all(0 <= r["score"] <= 1 for r in got)
    again = toxicity.learn(df.where(~held).repartition(5), labels.where(~held), per_label=450)
    assert again.weights == m.weights
    assert toxicity.learn(df, labels.limit(0)).score("scum") == pytest.approx(0.0, abs=1e-6)
    one = toxicity.learn(df, labels.where("toxic = 1"))
    assert one.score(None) > 0.9


def test_the_bound_counts_the_fold_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda plain, labels, **o: seen.append(Counter(labels)))
    rows = toxic_rows(300)
    labels = spark.createDataFrame([(i, 0, i % 2) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    toxicity.learn(docs(spark, rows).where("doc_id % 3 <> 1"), labels, per_label=70)
    assert seen == [Counter({0: 70, 1: 70})]


def test_batch_scores_are_single_scores():
    m = toxicity.ToxicModel({"scum": 3.0, "scum-": 1.0, "vile": 0.5, "vile-": 0.2}, -2.0)
    texts = ["scum scums", "", None, "vile Vile scum", "plain"]
    want = [1 / (1 + math.exp(-(m.bias + sum(m.weights[x] for x in toxicity.features(toxicity.words(t)) & m.weights.keys())))) for t in texts]
    assert m.scores(texts) == pytest.approx(want)


# --- op6 ----------------------------------------------------------------------------------------


def test_pages_of_every_length(spark):
    article = "<article>" + "".join(f"<p>This is paragraph {i} of a long article, with some words.</p>" for i in range(100_000)) + "</article>"
    rows = [(1, "u", article), (1, "u", article), (2, "u", "<article style='overflow:hidden'><h1>A title of it</h1><p>First words of the text here.</p><p>Second words of the text <svg><text>in a drawing</text></svg>.</p></article>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = extract(df).collect()
    assert [r["text"].count("\n") for r in got if r["page_id"] == 1] == [99_999] * 2
    assert [r["text"] for r in got if r["page_id"] == 2] == ["A title of it\nFirst words of the text here.\nSecond words of the text in a drawing."]
    assert extract(df.limit(0)).count() == 0


# --- op7 ----------------------------------------------------------------------------------------


def test_many_matches_in_one_text(spark):
    n = 30_000
    text = " ".join(f"10.0.{i % 256}.{i // 256}" for i in range(n))
    began = time.time()
    row = digest(find_pii(docs(spark, [(1, text, "s")]))).first()
    spans = [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"\S+", text)]
    assert row["n_ip"] == n and row["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
    assert time.time() - began < 90


def test_context_on_both_sides(spark):
    rows = [(1, "x 10.0.0.1 y", "s"), (2, "host 10.0.0.1 y", "s"), (3, "x 10.0.0.1 is the host", "s"), (4, "10.0.0.1 10.0.0.2 10.0.0.3 host", "s"), (5, "version 10.0.0.1" + " " * 60 + "host", "s")]
    got = {r["doc_id"]: [s["score"] for s in r["ip"]] for r in find_pii(docs(spark, rows)).collect()}
    assert got == {1: [0.7], 2: [0.9], 3: [0.9], 4: [0.9] * 3, 5: [0.5]}


# --- op8 ----------------------------------------------------------------------------------------


def brute_leaks(rows, items, k=5, threshold=0.8):
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    runs = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    bags = {i: Counter(runs(cut(t))) for i, t in items}
    held = Counter(s for b in bags.values() for s in b)
    weight = lambda s: 1 + math.log(len(bags) / max(1, held[s]))
    out = set()
    for d, t in rows:
        w = cut(t)
        for i, bag in bags.items():
            n = len(cut(dict(items)[i]))
            for at in range(max(1, len(w) - n + 1)):
                own = Counter(runs(w[at : at + n]))
                if not own.keys() & bag.keys():
                    continue
                shared = sum(min(own[s], bag[s]) * weight(s) for s in own)
                both = sum(max(own[s], bag[s]) * weight(s) for s in own | bag)
                if shared >= threshold * both - 1e-9:
                    out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(0, 400)}"
    items = [(i, " ".join(word() for _ in range(int(rng.integers(15, 60))))) for i in range(25)]
    items += [(100, items[0][1]), (101, items[1][1] + " " + items[2][1])]
    rows = []
    for d in range(400):
        words = items[d % 25][1].split()
        for _ in range(int(rng.integers(0, 4))):
            at, what = int(rng.integers(0, len(words))), rng.random()
            words[at : at + 1] = [] if what < 0.2 else [word(), word()] if what < 0.4 else [word()]
        rows.append((d, " ".join([*(word() for _ in range(int(rng.integers(0, 30)))), *words, *(word() for _ in range(10))])))
    want = brute_leaks(rows, items)
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs(spark, [(i, t, "s") for i, t in rows]), bench(spark, items)).collect()}
    assert got <= want and len(want) > 60
    assert len(got) / len(want) >= 0.95, (len(got), len(want))


def test_leaks_of_odd_benchmarks(spark):
    d = docs(spark, ODD)
    assert contaminated(d, bench(spark, [])).count() == 0 and without_leaks(d, bench(spark, [])).count() == len(ODD)
    got = sorted((str(r["doc_id"]), str(r["item_id"])) for r in contaminated(d, bench(spark)).collect())
    assert got == [("1", "7"), ("1", "None"), ("None", "7"), ("None", "None")]
    same_id = docs(spark, [(5, " ".join(WORDS), "a"), (5, "clean words of another text", "a")])
    assert [r["text"] for r in without_leaks(same_id, bench(spark)).collect()] == ["clean words of another text"]


# --- op9 ----------------------------------------------------------------------------------------


def test_token_files_of_ties_and_nulls(spark):
    rows = [(None, "b", "s"), (None, None, "s"), (4, "x y", "s"), (4, "z", "s"), (4, "x y", "s"), (1, "", "s")]
    runs = [sorted((r["start"], str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in read_tokens(write_tokens(docs(spark, rows).repartition(k), tokenizer())).collect()) for k in (1, 5)]
    assert runs[0] == runs[1] and [r[1] for r in runs[0]] == ["None", "None", "1", "4", "4", "4"]
    starts = [r[0] for r in runs[0]]
    assert starts == [sum(x[2] for x in runs[0][:k]) for k in range(len(rows))]


# --- the pipeline -------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").where("length(text) > 60").first()["text"]
    some = base.orderBy("doc_id").limit(80)
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34", "en", "s", 0), (9003, f"And so {item} and so on", "en", None, 0), (None, "these are the words of a row without any name at all", "en", "s", 0), (None, "another one of the rows that have no name but a text", "en", "s", 0)], base.schema)
    kept = some.unionByName(some.limit(5)).unionByName(extra)
    for c in CLASH:
        kept = kept if c in kept.columns else kept.withColumn(c, F.lit("x"))
    d, sizes = kept, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, "/root/testdata/sf0.001")
        if name != "token_files":
            assert out.columns == kept.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        d = spark.read.schema(out.schema).parquet(path)
        sizes[name] = {(r["doc_id"], r["text"]) for r in d.collect()} if "text" in d.columns else d.count()
    ids = {k: {i for i, _ in v} for k, v in sizes.items() if k != "token_files"}
    assert not ids["language_id"] & {9001, 9002} and 9003 in ids["near_duplicates"] and 9003 not in ids["decontamination"]
    near = spark.read.schema(kept.schema).parquet(str(tmp_path / "near_duplicates"))
    assert near.count() == near.select("text").distinct().count() == len(sizes["near_duplicates"])
    assert sum(i is None for i, _ in sizes["near_duplicates"]) == 2  # rows without an id stay apart
    mixed = spark.read.schema(kept.schema).parquet(str(tmp_path / "source_mix"))
    leaked = spark.read.schema(kept.schema).parquet(str(tmp_path / "decontamination"))
    want = mixing.mix(leaked).agg(F.sum("copies")).first()[0]
    assert mixed.count() == want == sizes["token_files"]
    empty = kept.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_equal_rows_share_the_mix(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "a b c d", "p")] * 5 + [(1, "e f", "p"), (None, "g h i", "q"), (None, "g h i", "q"), (2, "j " * 50, "q")]
    d = docs(spark, rows)
    got = Counter(r["text"] for r in corpus_pipeline.source_mix(spark, d, "").collect())
    want = Counter()
    for r in mixing.mix(d.withColumn("doc_id", F.struct(F.col("doc_id").alias("id"), F.md5("text").alias("text"), F.col("source").alias("source")))).collect():
        want[r["doc_id"]["text"]] += r["copies"]
    assert {hashlib.md5(t.encode()).hexdigest(): n for t, n in got.items()} == {k: n for k, n in want.items() if n}
