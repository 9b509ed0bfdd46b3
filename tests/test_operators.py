"""Operators on own tables, hyphenation and sinks, against known rows and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lexispark.operators import catalog, hyphenation
from lexispark.sources import sinks


def test_search(spark):
    books = spark.createDataFrame([(1, "Wuthering Heights"), (2, "L'Énéide"), (3, "Le bureau d'à côté"), (4, None)], "id int, title string")
    find = lambda q: [r["id"] for r in catalog.search(books, q, "title").orderBy("id").collect()]
    assert find("wut hei") == find("heights WUTHERING") == [1] and find("eights") == find("wuthering blue") == []
    assert find("eneide") == find("ÉNÉIDE") == [2] and find("cote") == [3] and find("") == [1, 2, 3, 4][:4] and find("a.*") == [3]


def test_canonical_authors(spark):
    rows = ["Victor Hugo", "Hugo, Victor", "Hugo Victor", "Victor Hugo [ed.]", "Jules Verne", "", None, "Q."]
    got = {tuple(r) for r in catalog.canonical_authors(spark.createDataFrame([(x,) for x in rows], "author string")).collect()}
    assert got == {("hugo victor", "Victor Hugo"), ("jules verne", "Jules Verne")}


def test_reconcile(spark):
    prior = spark.createDataFrame([("/a", 10, 1), ("/b", 20, 2), ("/c", 20, 3), ("/d", 30, 4)], "path string, size int, first_seen long")
    now = spark.createDataFrame([("/a", 10), ("/x", 20), ("/new", 5), ("/also", 6)], "path string, size int")
    got = {tuple(r) for r in catalog.reconcile(now, prior).collect()}
    assert got == {("/a", "unchanged", 1), ("/x", "renamed", 2), ("/c", "removed", 3), ("/d", "removed", 4), ("/also", "added", 5), ("/new", "added", 6)}
    assert {r["status"] for r in catalog.reconcile(now, prior.limit(0)).collect()} == {"added"}
    assert catalog.reconcile(now.limit(0), prior.limit(0)).count() == 0


def test_asof_and_ranges(spark):
    rng = random.Random(2)
    starts = [(b, rng.randrange(100), i) for b in range(3) for i in range(8)]
    starts = list({(b, s): (b, s, i) for b, s, i in starts}.values())
    probes = [(b, rng.randrange(-5, 110), k) for k, b in enumerate([0, 1, 2, 3] * 12)]
    s, p = spark.createDataFrame(starts, "book int, start int, page int"), spark.createDataFrame(probes, "book int, at int, id int")
    back = {r["id"]: r["page"] for r in catalog.asof(p, s, "book", "at", "start", "page").collect()}
    on = {r["id"]: r["page"] for r in catalog.asof(p, s, "book", "at", "start", "page", forward=True).collect()}
    for b, at, k in probes:
        own = sorted((x, i) for c, x, i in starts if c == b)
        assert back[k] == next((i for x, i in reversed(own) if x <= at), None)
        assert on[k] == next((i for x, i in own if x >= at), own[-1][1] if own else None)
    ranges = spark.createDataFrame([(1, 0, 9), (2, 10, 35), (3, 8, 8), (4, 9, 2)], "r int, lo int, hi int")
    got = {(r["id"], r["r"]) for r in catalog.range_join(p, ranges, "at", "lo", "hi", 7).collect()}
    assert got == {(k, r) for _, at, k in probes for r, lo, hi in [(1, 0, 9), (2, 10, 35), (3, 8, 8)] if lo <= at <= hi}


def test_merged_intervals_and_pages(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 4), (1, 6, 9), (1, 20, 21), (2, 1, 1), (2, None, 3)], "k int, a int, b int")
    assert {tuple(r) for r in catalog.merged_intervals(df, "k", "a", "b", gap=1).collect()} == {(1, 0, 9, 3), (1, 20, 21, 1), (2, 1, 1, 1)}
    ids = [r["id"] for r in catalog.ranked_page(spark.range(100), [F.desc("id")], 7, 2).orderBy(F.desc("id")).collect()]
    assert ids == list(range(85, 78, -1)) and catalog.ranked_page(spark.range(10), [F.col("id")], 7, 5).count() == 0


PATTERNS = ["1ba", "a1b", "2bb", ".ab1", "b3c2.", "o2o1p", "e1e", "4ee."]


def brute_breaks(word, patterns, before=2, after=2):
    dotted, levels = f".{word.lower()}.", {}
    for p in patterns:
        letters = "".join(c for c in p if not c.isdigit())
        for start in range(len(dotted)):
            if dotted[start : start + len(letters)] == letters:
                at = 0
                for c in p:
                    if c.isdigit():
                        levels[start + at - 1] = max(levels.get(start + at - 1, 0), int(c))
                    else:
                        at += 1
    return [k for k in sorted(levels) if levels[k] % 2 and before <= k <= len(word) - after]


def test_hyphenation(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abceop") for _ in range(rng.randrange(1, 12))) for _ in range(300)] + ["ABBA", "", None, "zzz", "zzz"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    pats = spark.createDataFrame([(p,) for p in [*PATTERNS, None]], "pattern string")
    got = {r["word"]: r["breaks"] for r in hyphenation.hyphenate(df, pats).collect()}
    assert got == {w: brute_breaks(w, PATTERNS) for w in words if w}
    assert all(not r["breaks"] for r in hyphenation.hyphenate(df, pats.limit(0)).collect())


def test_hyphenation_measures(spark):
    lines = spark.createDataFrame([("# words",), ("abba|ab=ba|9",), ("Silbentrennung|Sil=ben=tren=nung|2",), ("ohne|ohne|1",), ("broken",), (None,)], "value string")
    gold = hyphenation.golden(lines)
    assert {(r["word"], tuple(r["expected"]), r["frequency"]) for r in gold.collect()} == {("abba", (2,), 9), ("Silbentrennung", (3, 6, 10), 2), ("ohne", (), 1)}
    found = spark.createDataFrame([("abba", [2]), ("Silbentrennung", [3, 5])], "word string, breaks array<int>")
    each = hyphenation.evaluate(gold, found)
    got = {r["word"]: (r["precision"], r["recall"], round(r["f1"], 6), round(r["weighted"], 6)) for r in each.collect()}
    assert got == {"abba": (1, 1, 1, 1), "ohne": (1, 1, 1, 1), "Silbentrennung": (0.5, pytest.approx(1 / 3), 0.4, round(1 - 4 / 6, 6))}
    assert [r["word"] for r in hyphenation.worst(each).collect()] == ["Silbentrennung"]
    one = hyphenation.summary(each).first()
    assert one["words"] == 3 and one["f1"] == pytest.approx(0.8) and one["expected"] == pytest.approx(4 / 3)


def test_index(spark, tmp_path):
    books = spark.createDataFrame([("/b", "zeta", "hugo victor", 1), ("/a", "alpha", "", 3), ("/c", "alpha", "austen jane", 2)], "path string, title_key string, author_key string, first_seen long")
    sinks.emit_index(books, str(tmp_path / "i"))
    got = {r["path"]: (r["title_rank"], r["author_rank"], r["arrival_rank"]) for r in sinks.read_index(spark, str(tmp_path / "i")).collect()}
    assert got == {"/a": (1, 3, 3), "/c": (2, 1, 2), "/b": (3, 2, 1)}
    with pytest.raises(ValueError):
        sinks.read_index(spark, str(tmp_path / "i"), version=2)
    (tmp_path / "i/records/_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):
        sinks.read_index(spark, str(tmp_path / "i"))


def test_sections_and_stores(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    schema = "book long, chapter int, pages int, bytes_consumed long, total_bytes long"
    sinks.commit_sections(spark.createDataFrame([(1, 0, 5, 100, 100), (1, 1, 2, 40, 80)], schema), at("s"))
    assert [tuple(r) for r in sinks.resume_points(spark, at("s")).collect()] == [(1, 1, 40, 0.5)]
    sinks.commit_sections(spark.createDataFrame([(1, 1, 4, 80, 80)], schema), at("s"))
    assert sinks.resume_points(spark, at("s")).count() == 0 and spark.read.parquet(at("s")).count() == 2
    rows = spark.createDataFrame([("a", 1), ("b" * 600, 2)], "name string, size int")
    assert [r["value"] for r in sinks.json_rows(rows).collect()] == ['{"name":"a","size":1}']
    sinks.save_store(rows, at("j"))
    assert spark.read.json(at("j")).count() == 2
    sinks.save_progress(spark.createDataFrame([(1, 0, 3, 0.1, 5), (1, 2, 1, 0.6, 9), (2, 0, 0, 0.0, 1)], "book long, spine int, page int, pct double, saved_at int"), at("p"))
    assert {(r["book"], r["spine"], r["page"]) for r in sinks.read_finished(spark, at("p")).collect()} == {(1, 2, 1), (2, 0, 0)}
    sinks.save_bookmarks(spark.createDataFrame([("/x/y.z.epub", "note")], "path string, summary string"), at("m"))
    assert [r["book"] for r in spark.read.json(at("m")).collect()] == ["x_y.z"]
    sinks.write_deltas(spark.createDataFrame([("r", 1, 10), ("r", 2, 7)], "k string, o int, v int"), "k", "o", "v", at("d"))
    assert sorted((r["o"], r["delta"]) for r in spark.read.option("header", "true").csv(at("d")).collect()) == [("1", None), ("2", "-3")]
    spine = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "book long, idx int, href string")
    sinks.write_book_cache(spine, spine, at("c"))
    assert sinks.read_finished(spark, at("c") + "/toc").count() == 2
