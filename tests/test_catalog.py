"""Each catalogue query against its SQL twin, and the text functions against known rows."""

import numbers
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lexispark.functions.dialect import DUCK, SPARK
from lexispark.plans import QUERIES

DATA = Path("/root/testdata/sf0.001")


def norm(v):
    """Exact: whole numbers alike whatever their type, doubles by all their digits."""
    if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
        return "null"
    return repr(float(v)) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)


def rows(df):
    return sorted(tuple(map(norm, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_twin(spark, duck, name):
    run, sql = QUERIES[name]
    assert rows(run(spark, str(DATA)).toPandas()) == rows(duck.execute(sql).df())


KNOWN = [
    ("fold", "Pand\u00e9mie", "pandemie"),
    ("fold", "pande\u0301mie", "pandemie"),
    ("fold", "E\u0301clipse totale", "eclipse totale"),
    ("fold", "Derrie\u0300re les collines", "derriere les collines"),
    ("fold", "S\u00f8ren \u00d8rsted \u00c6sop Stra\u00dfe \u0141odz s\u0153ur", "soren orsted aesop strasse lodz soeur"),
    ("fold", "L\u2019\u00c9n\u00e9ide", "l'eneide"),
    ("fold", "O\u2019Malley", "o'malley"),
    ("fold", "a\u2014b \u201cquoted\u201d a---b", "a b quoted a b"),
    ("fold", "\u1ee8ng \u1ebf", "ung e"),
    ("fold", "  spaced   out  ", "spaced out"),
    ("fold", "!!!", ""),
    ("fold", "\u05e9\u05b8\u05c1\u05dc\u05d5\u05b9\u05dd", "\u05e9\u05dc\u05d5\u05dd"),
    ("fold", "\u041a\u043d\u0438\u0433\u0430 \u0399", "\u041a\u043d\u0438\u0433\u0430 \u0399"),
    ("clean_name", "Austen, Jane", "Jane Austen"),
    ("clean_name", "Smith, John, Jr.", "Smith, John, Jr"),
    ("clean_name", "Austen,", "Austen"),
    ("clean_name", "J_R_R Tolkien_", "J.R.R Tolkien"),
    ("clean_name", "George Sand [Sand, (George)] x", "George Sand x"),
    ("clean_name", "Emile Erckmann (open; Alexandre", "Emile Erckmann"),
    ("surname_key", "herbert g wells", "wells herbert g"),
    ("surname_key", "voltaire", "voltaire"),
    ("plain_text", "<p>a</p><p>b</p>", "a\n\nb"),
    ("plain_text", "<h1>title</h1>body", "title\n\nbody"),
    ("plain_text", "a < b and c > d", "a < b and c > d"),
    ("plain_text", "x &#8212; y &#x2014;&eacute; &nope; &amp;", "x \u2014 y \u2014\u00e9 &nope; &"),
    ("plain_text", "one  <br>two\t\tthree<div>\n<p>four", "one\ntwo three\n\nfour"),
    ("safe_filename", ' a/b:c". ', "a_b_c_"),
    ("safe_filename", "\x7f..", "book"),
    ("safe_filename", "\u00e9" * 60, "\u00e9" * 50),
    ("natural_key", "Part 007b", "part 017b"),
]


@pytest.mark.parametrize(("name", "text", "want"), KNOWN)
def test_text(spark, duck, name, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.selectExpr(f"{getattr(SPARK, name)('x')} AS y").first()["y"] == want
    assert duck.execute(f"SELECT {getattr(DUCK, name)('x')} FROM (SELECT ? AS x) AS t", [text]).fetchone()[0] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("The Iliad", "iliad"), ("Les Mis\u00e9rables", "miserables"), ("L\u2019\u00c9n\u00e9ide", "eneide"), ("The", "the"), ("Du c\u00f4t\u00e9", "cote"), ("una cosa", "una cosa")],
)
def test_article(spark, duck, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.selectExpr(f"{SPARK.fold('x', True)} AS y").first()["y"] == want
    assert duck.execute(f"SELECT {DUCK.fold('x', True)} FROM (SELECT ? AS x) AS t", [text]).fetchone()[0] == want


def test_author_key(spark):
    names = ["Lu Xun", "Lu, Xun", "Xun, Lu", "Lu Xun_", "Lu Xun [Xun, Lu]", "  lu   xun  ", "Herbert G Wells", "Wells, Herbert G.", "Herbert G_ Wells", "Wells_ Herbert", "Wollstonecraft, Mary", "Q. X. Z.", "", "\u00c9\u4e66\u4e66\u4e66\u4e66\u4e66"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i int, x string").selectExpr("i", f"{SPARK.clean_name('x')} AS c").selectExpr("i", f"{SPARK.fold('c')} AS f")
    got = [r.k for r in df.selectExpr("i", f"{SPARK.author_tokens('f')} AS t").selectExpr("i", f"{SPARK.author_key('t')} AS k").orderBy("i").collect()]
    assert set(got[:6]) == {"lu xun"} and set(got[6:10]) == {"herbert well"}
    assert got[10:] == ["mary wollsto", "", "", "e\u4e66\u4e66\u4e66"]
