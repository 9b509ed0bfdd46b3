"""The operators against brute force, with nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from lexispark.llm.decontaminate import contaminated, without_leaks
from lexispark.llm.exact_dedup import exact_dedup
from lexispark.llm.html_extract import default_labeller, extract, leaf_blocks, made_page, main_texts
from lexispark.llm.language_id import identify, train
from lexispark.llm.mixing import capped_targets, mix
from lexispark.llm.pii import PATTERNS, digest, find_pii
from lexispark.llm.secrets import find_secrets
from lexispark.llm.simhash import LOWER, hamming_links, keep_first, near_dedup, tree_links
from lexispark.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `id` string, `digest` string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y") for i, t, s in rows], SCHEMA)


ODD = [(1, "The quick brown fox jumps", "a"), (2, None, None), (3, "", "a"), (None, "The quick brown fox jumps", "b"), (4, "   ", "b"), (5, "The quick brown fox jumps", "a"), (5, "The quick brown fox jumps", "a"), (6, "word " * 30_000, "c")]


def test_exact_dedup(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs(spark, ODD), keep="largest").collect()}
    assert got == {(1, 5, 4, False), (None, 5, 4, False), (5, 5, 4, True), (2, 3, 2, False), (3, 3, 2, True), (4, 4, 1, True), (6, 6, 1, True)}
    assert exact_dedup(docs(spark, [])).count() == 0
    small = exact_dedup(docs(spark, ODD), keep="smallest", memtable_rows=1)
    assert {r.keep_id for r in small.where("doc_id = 5").collect()} == {1}


def roots(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def codes(seed=0, n=3000):
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 1 << 62, 40)]
    out = set()
    for k in range(n):
        x = base[k % 40]
        for b in rng.integers(0, 64, int(rng.integers(0, 6))):
            x ^= 1 << int(b)
        out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


def brute(x, radius=3):
    return [(i, int(j) + i + 1) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= radius)]


def test_tree_loses_no_link():
    x = codes()
    assert roots(len(x), tree_links(x, 3)) == roots(len(x), brute(x))


@pytest.mark.parametrize("node_rows", [8192, 20])
def test_index_loses_no_link(spark, node_rows):
    x = codes(1, 600)
    at = {int(v): i for i, v in enumerate(x.view(np.int64))}
    links = hamming_links(spark.createDataFrame([(k,) for k in at], "fp long"), 3, node_rows).collect()
    assert roots(len(x), [(at[r.a], at[r.b]) for r in links]) == roots(len(x), brute(x))


def test_near_dedup(spark):
    def fp(t):
        w = (t or "").encode().translate(LOWER).split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        return f"{sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h)):016x}"

    got = near_dedup(docs(spark, ODD)).collect()
    text = {i: t for i, t, _ in ODD}
    assert all(r.fingerprint == fp(text[r.doc_id]) for r in got)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (None, 1), (5, 1), (2, 2), (3, 2), (4, 2), (6, 6)}
    assert sorted(r.doc_id for r in keep_first(docs(spark, ODD), near_dedup(docs(spark, ODD))).collect()) == [1, 2, 6]
    assert near_dedup(docs(spark, [])).count() == 0


def test_mix(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 3}") for i in range(600)] + [(None, "a b", None), (700, None, "s0")]
    got = mix(docs(spark, rows), salt_rows=8).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 2).all()
    again = mix(docs(spark, rows), salt_rows=8).toPandas()
    assert sorted(map(str, got[["doc_id", "taken"]].values.tolist())) == sorted(map(str, again[["doc_id", "taken"]].values.tolist()))
    assert mix(docs(spark, [])).count() == 0
    assert capped_targets([10, 10], [5, 2], 30, 2) == pytest.approx([20, 10])


def test_pii(spark):
    texts = ["mail a.b@c.de_f@g.hi or x@y 1.2.3.4 1.2.3.400", "card 4012 4290-1115 8754 no 4012429011158755", "+1 (244) 555-4688 é +12", "DE89 3704 0044 0532 0130 00", "9" * 5000, None, ""]
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    got = {r.doc_id: r for r in digest(find_pii(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]))).collect()}
    for i, t in enumerate(texts):
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in plain.items() for m in re.finditer(p, t or "") if ok(k, m.group())]
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
    assert got[3].n_iban == 1 and set(PATTERNS) >= {"iban"}


def test_decontaminate(spark):
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(7, item), (8, ""), (9, None), (10, "only three words")], "item_id long, text string")
    leak = "before some text. " + item.upper() + " and after " * 5
    rows = [(1, leak, "s"), (2, "nothing of the kind here at all", "s"), (3, None, "s"), (None, leak, "s"), (4, item.replace("w29", "zz"), "s"), (5, "x only, three WORDS y", "s"), (6, " ".join(f"w{i}" for i in range(15)), "s")]
    got = {(r.doc_id, r.item_id) for r in contaminated(docs(spark, rows), bench).collect()}
    assert got == {(1, 7), (None, 7), (4, 7)} or got == {(1, 7), (None, 7), (4, 7), (5, 10)}
    assert 2 in {r.doc_id for r in without_leaks(docs(spark, rows), bench).collect()}
    assert contaminated(docs(spark, []), bench).count() == 0


def test_decontaminate_short_items(spark):
    bench = spark.createDataFrame([(10, "only three words"), (11, "lone"), (12, " ".join(f"w{i}" for i in range(20))), (13, "Only three, words!")], "item_id long, text string")
    rows = [(5, "x only, three WORDS y and more words than five", "s"), (6, "only three", "s"), (7, "a Lone", "s"), (8, None, "s"), (9, "", "s"), (3, "only three words only three words", "s"), (4, " ".join(f"w{i}" for i in range(25)), "s")]
    got = sorted((r.doc_id, r.item_id, r.similarity, r.start, r.distance) for r in contaminated(docs(spark, rows), bench).collect())
    assert got == [(3, 10, 1.0, 0, 0), (3, 13, 1.0, 0, 0), (4, 12, 1.0, 0, 0), (5, 10, 1.0, 1, 0), (5, 13, 1.0, 1, 0), (7, 11, 1.0, 1, 0)]
    assert {r.doc_id for r in without_leaks(docs(spark, rows), bench).collect()} == {6, 8, 9}


def test_secrets(spark):
    rows = [(1, 'and token = "841d82b07cb9b9f1fcb7cce52fad63a992695314" un', "src1"), (2, "password=changeme123 example", "docs"), (3, None, None), (4, "thation erthing andhere", "s")]
    assert {r.doc_id for r in find_secrets(docs(spark, rows)).collect()} == {1}


def test_long_secrets_are_whole(spark):
    key = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(8))[:480]
    slack = "xoxb-" + "-".join(key[i : i + 12].upper() for i in range(0, 120, 12))
    rows = [(1, f'and token = "{key}" un', "src1"), (2, f"le {slack} un", "src1")]
    got = {r.doc_id: (r.start, r.end, r.candidate) for r in find_secrets(docs(spark, rows)).collect()}
    assert got == {1: (13, 493, key), 2: (3, 3 + len(slack), slack)}


def test_language(spark):
    en, fr = "the house of the rising sun and then some more words", "la maison des hommes et les enfants de la ville"
    m = train([en, en + " with", fr, fr + " que"], ["en", "en", "fr", "fr"], landmarks=4)
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs(spark, [(1, en[:25], "s"), (2, fr[:25], "s"), (3, None, "s"), (4, "123 !", "s")]), m).collect()}
    assert got[1][0] == "en" and got[2][0] == "fr" and got[3] == got[4] == ("und", 0.0)
    assert train([], []) is None


def test_toxicity():
    rng = np.random.default_rng(0)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    texts = [" ".join(rng.choice(words, 30)) + (" scum women" if i % 2 else "") for i in range(300)]
    m = toxicity.train(texts, [i % 2 for i in range(300)])
    assert m.score("wordaa scum") >= 0.7 > m.score("wordaa") and m.score(None) < 0.7
    assert abs(m.score("wordaa women") - m.score("wordaa men")) < 0.15


def test_pages(spark):
    page = "<html><head><title>t</title><script>x('<p>')</script></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>First  para\ntext here.<p>Second one, of the article.</p></article><footer>&copy; me</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in extract(df).collect()}
    assert got[1].text == "A & B\nFirst para text here.\nSecond one, of the article." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == ""
    rng, right, n = np.random.default_rng(99), 0, 0
    for _ in range(100):
        b, y = made_page(rng)
        if b:
            right, n = right + int((default_labeller().label([b])[0] == (y > 0)).sum()), n + len(y)
    assert right / n > 0.97 and main_texts([None], default_labeller()) == [""] and leaf_blocks("<p>a<br>b")[1].text == "b"


def test_hidden_elements():
    def texts(page):
        return [b.text for b in leaf_blocks(page)]

    for attr in ('class="overflow-hidden"', 'style="overflow:hidden"', 'aria-hidden="false"', 'class="hidden-xs"', 'title="The hidden city"', 'style="x-display:none"'):
        assert texts(f"<div {attr}>one<p>two</div><p>three") == ["one", "two", "three"]
    for attr in ("hidden", 'hidden=""', 'style="color:red; DISPLAY : none"', "class=a hidden id=b"):
        assert texts(f"<div {attr}>one<div>two</div>three</div><p>four") == ["four"]
        assert texts(f"<p {attr}>one<p>two") == texts(f"<ul><li {attr}>one<li>two</ul>") == ["two"]
        assert texts(f"<p>one <span {attr}>two <span>x</span> three</span>four") == ["one four"]
        assert texts(f"<p>one<div {attr}>two<p>three") == ["one", "two", "three"]


def test_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from lexispark.llm.token_output import read_tokens, write_tokens

    rows = [(3, "a b\n c  d", "s"), (1, None, "s"), (2, "it's é <|endoftext|> x", "s"), (9, " the end. Of it, all", "s"), (5, "x" * 9000, "s")]
    tok, at = tokenizers.Tokenizer.from_file(str(path)), 0
    got = {r.doc_id: r for r in read_tokens(write_tokens(docs(spark, rows), str(path), length=16, rows=2)).collect()}
    for i, t, _ in sorted(rows):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert read_tokens(write_tokens(docs(spark, []), str(path))).count() == 0
