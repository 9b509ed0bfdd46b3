"""Lines and pages against plain loops and brute force."""

import random
from functools import lru_cache

from pyspark.sql import functions as F

from lexispark.operators import layout


def plain_pages(text, width, per_page):
    """The rule by hand: a line's longest start that fits, cut at its last space."""
    out, lines = [], text.split("\n")
    for line in lines[:-1] if lines[-1] == "" else lines:
        line = line[:-1] if line.endswith("\r") else line
        if not line:
            out.append("")
        while line:
            if len(line) <= width:
                out.append(line)
                break
            at = line.rfind(" ", 1, width + 1)
            at = at if at > 0 else width
            out.append(line[:at])
            line = line[at + 1 :] if line[at] == " " else line[at:]
    return ["\n".join(out[i : i + per_page]) for i in range(0, len(out), per_page)]


def made(seed, n=300):
    rng = random.Random(seed)
    for i in range(n):
        yield i, "".join(rng.choice("ab é\n  c\r\n漢") for _ in range(rng.randrange(0, 90)))


ODD = [(-1, None), (-2, ""), (-3, "\n\n"), (-4, "a" * 50), (-5, "aaaaaaa "), (-6, "aaaaaaa \nb"), (-7, " " * 20), (-8, "a\r"), (-9, "aaaaaaa\r\nb")]


def test_pages(spark):
    rows = list(made(1)) + ODD
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {}
    for r in layout.pages(df, 7, 3).orderBy("doc_id", "page").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        assert [r["shown"] for r in got.get(i, [])] == plain_pages(t or "", 7, 3), (i, t)
        assert sum(r["n_chars"] for r in got.get(i, [])) == len(t or "")
    assert layout.pages(df.limit(0), 7, 3).count() == 0


def test_resume(spark):
    rows = list(made(2, 60)) + ODD
    df = spark.createDataFrame(rows, "doc_id int, text string")
    want = {i: "\n".join(plain_pages(t or "", 7, 2)) for i, t in rows}
    turn, got = df.withColumn("offset", F.lit(0)), {i: [] for i, _ in rows}
    for _ in range(40):
        out = layout.next_pages(turn, 7, 2, 2).collect()
        for r in out:
            assert r["n_pages"] <= 2
            got[r["doc_id"]].append(r["shown"])
        left = {r["doc_id"]: r["next_offset"] for r in out if r["is_partial"]}
        if not left:
            break
        turn = spark.createDataFrame([(i, t, left[i]) for i, t in rows if i in left], "doc_id int, text string, offset int")
    assert {i: "\n".join(p) for i, p in got.items()} == want


def raggedness(words, width):
    n = len(words)

    @lru_cache(None)
    def best(i):
        if i == n:
            return 0
        costs = [0 if j == n else (width - len(" ".join(words[i:j]))) ** 2 + best(j) for j in range(i + 1, n + 1) if len(" ".join(words[i:j])) <= width]
        return min(costs)

    return best(0)


def test_even_lines(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("x" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 40)))) for i in range(200)]
    df = spark.createDataFrame(rows + [(-1, None), (-2, "")], "doc_id int, text string")
    got = {r["doc_id"]: r["lines"] for r in layout.even_lines(df, 12).collect()}
    assert got[-1] == got[-2] == []
    for i, t in rows:
        assert " ".join(got[i]) == t and all(len(x) <= 12 for x in got[i])
        assert sum((12 - len(x)) ** 2 for x in got[i][:-1]) == raggedness(tuple(t.split()), 12)


def test_even_rules():
    assert layout.even("aa bb cc dd", 5) == ["aa bb", "cc dd"]
    assert layout.even("\u6f22\u5b57\u6f22\u5b57\u6f22", 2) == ["\u6f22\u5b57", "\u6f22\u5b57", "\u6f22"]  # of equal raggedness the longer line first
    assert layout.even("abcdefghij", 5) == ["abcd-", "efgh-", "ij"]
    assert layout.even("12\u00a0km of it", 6) == ["12\u00a0km", "of it"]
    assert layout.even("aa well-known", 8) == ["aa well-", "known"]
    assert layout.even("a bb", 4, indent=2) == ["a", "bb"] and layout.even("!!!!!!!!", 3) == ["!!!!!!!!"]


def test_filled_lines(spark):
    assert layout.filled("the cat sat", 7) == ["the cat", "sat"]
    places = {"example": [2, 4]}.get
    assert layout.filled("an example", 6, places=places) == ["an ex-", "ample"]
    assert layout.filled("an example", 5, places=places) == ["an", "exam-", "ple"]
    assert layout.filled("so exam\u00adple", 8) == ["so exam-", "ple"]
    assert layout.filled("abcdefghij", 5) == ["abcd-", "efgh-", "ij"]
    assert layout.filled("aa 12\u00a0km", 6) == ["aa", "12\u00a0km"]
    df = spark.createDataFrame([(1, "the cat sat\n\non a mat"), (2, None)], "doc_id int, text string")
    assert {r["doc_id"]: r["lines"] for r in layout.filled_lines(df, 7).collect()} == {1: ["the cat", "sat", "on a", "mat"], 2: []}
