"""Personal data in texts: proposed by regular expressions, confirmed by checksums, scored by context.

Native: one projection of SQL functions, no shuffle. Spark has no function that gives the places
of all matches, so they are found by two that walk a text alike: ``regexp_extract_all`` gives the
matches and ``split`` what lies between, and sums of their lengths give the places.

Kinds: email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits), and
iban (mod-97), which this method adds. Patterns are written with possessive quantifiers and
look-behinds that change no match but keep the time linear in the text.

``score`` starts from the kind's prior and the words within ``window`` characters on both sides of a
span raise or lower it; spans of the base kinds stay whatever their score.

Defined results: a null text counts as empty and has no spans; null ids stay null; repeated rows
are scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds, their patterns and the character each match must hold.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None),
}
PRIOR = {"email": 0.95, "ip": 0.7, "card": 0.85, "phone": 0.75, "iban": 0.95}
SUPPORT = {
    "email": r"mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|host|server|client|login|adresse",
    "card": r"card|visa|master|amex|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|call|tel|mobile|fax|anruf|appel|llam",
    "iban": r"iban|bank|account|konto|compte|cuenta",
}
DOUBT = r"example|sample|dummy|test|version|order|invoice|isbn"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn sum?"""
    d = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    add = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.when(c.cast("int") >= 5, 1).otherwise(0)))
    return F.aggregate(add, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(iban: Column) -> Column:
    """Does an IBAN pass mod-97? Letters count as 10 to 35, the first four characters go last."""
    s = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    value = lambda c: F.conv(c, 36, 10).cast("int")
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(value(c) > 9, a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97)
    return F.length(s).between(15, 34) & (rest == 1)


CONFIRM = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("000"), F.ltrim(p, F.lit("0"))), F.lit(3)).cast("int") <= 255)),
    "card": lambda m: F.length(_digits(m)).between(13, 19) & luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
    "iban": mod97,
}


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def placed(text: Column, pattern: str, window: int = 40, block: int = 64) -> Column:
    """array<struct<value,start,before,after>>: all matches of ``pattern`` (without groups), their places in
    code points and up to ``window`` characters on both sides.

    A place is the sum of the lengths of all pieces and matches before. Sums are taken within blocks
    of ``block`` matches, then over the blocks, so an array is never copied once a match; context is
    cut from the neighbouring pieces, not from the text. Both keep the time near linear in the matches.
    """
    match = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))
    pieces = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<value:string,start:int,before:string,after:string>>")

    def places(x: Column) -> Column:
        """array<struct<start,value,i>> relative to the start of the block, and the block's length."""
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("got"))
        step = lambda acc, m: F.struct((acc["at"] + m["gap"] + m["len"]).alias("at"), F.concat(acc["got"], F.array(acc["at"] + m["gap"])).alias("got"))
        sized = F.transform(F.arrays_zip(x["match"].alias("m"), F.slice(x["piece"], F.lit(1), F.size(x["match"])).alias("p")), lambda z: F.struct(F.length(z["p"]).alias("gap"), F.length(z["m"]).alias("len")))
        n = F.size(x["match"])
        cut = lambda z: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda k: F.aggregate(F.slice(z, k * block + 1, F.lit(block)), zero, step))
        whole = lambda bs: F.flatten(F.transform(bs, lambda b, k: let(F.aggregate(F.slice(bs, F.lit(1), k), F.lit(0), lambda a, c: a + c["at"]), lambda base: F.transform(b["got"], lambda g: g + base))))
        return let(let(sized, cut), whole)

    def beside(x: Column, i: Column) -> tuple[Column, Column]:
        """The last characters before match i, the first after it; few pieces reach, else as many as could be needed."""
        near = F.get(x["piece"], i)
        first = F.greatest(i - window, F.lit(0))
        before = F.concat(F.array_join(F.transform(F.sequence(first, i), lambda k: F.when(k < i, F.concat(F.get(x["piece"], k), F.get(x["match"], k))).otherwise(near)), ""))
        following = F.get(x["piece"], i + 1)
        # Piece k + 1 follows match k; the pieces go one further than the matches.
        after = F.array_join(F.transform(F.sequence(i + 1, F.least(i + window, F.size(x["match"]))), lambda k: F.concat(F.get(x["piece"], k), F.coalesce(F.get(x["match"], k), F.lit("")))), "")
        left = F.when(F.length(near) >= window, F.right(near, F.lit(window))).otherwise(F.right(before, F.lit(window)))
        right = F.when(F.length(following) >= window, F.left(following, F.lit(window))).otherwise(F.left(after, F.lit(window)))
        return left, right

    def found(x: Column) -> Column:
        def one(at: Column, i: Column) -> Column:
            left, right = beside(x, i)
            return F.struct(F.get(x["match"], i).alias("value"), at.alias("start"), left.alias("before"), right.alias("after"))

        return F.when(F.size(x["match"]) == 0, none).otherwise(F.transform(places(x), one))

    return let(F.struct(match.alias("match"), pieces.alias("piece")), found)


def kind_spans(text: Column, kind: str, window: int) -> Column:
    """array<struct<kind,start,end,value,score>> of one kind in ``text`` (never null)."""
    pattern, needs = PATTERNS[kind]
    good = F.filter(placed(text, pattern, window), lambda s: CONFIRM[kind](s["value"]))

    def scored(s: Column) -> Column:
        about = F.lower(F.concat_ws("\n", s["before"], s["after"]))
        score = F.lit(PRIOR[kind]) + F.when(about.rlike(SUPPORT[kind]), 0.2).otherwise(0.0) - F.when(about.rlike(DOUBT), 0.2).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"), s["value"].alias("value"), F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3).alias("score"))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>")
    maybe = text.contains(needs) if needs else text.rlike("[0-9]{2}|[0-9][ -][0-9]")
    return F.when(maybe, F.transform(good, scored)).otherwise(none)


def find_pii(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = 40) -> DataFrame:
    """One row per document: id and, for each kind, the array of its spans (``email`` ... ``iban``)."""
    base = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return base.select(F.col("__id").alias(id_col), *[kind_spans(F.col("__text"), k, window).alias(k) for k in PATTERNS])


def _listed(kinds: list[str]) -> Column:
    spans = F.flatten(F.array(*[F.transform(F.col(k), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])) for k in kinds]))
    return F.array_join(spans, ",")


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and span lists per document, from the arrays of ``find_pii``."""
    base = ["email", "ip", "card", "phone"]
    mean = F.aggregate(F.flatten(F.array(*[F.transform(F.col(k), lambda s: s["score"]) for k in PATTERNS])), F.lit(0.0), lambda a, b: F.greatest(a, b))
    return spans.select(id_col, *[F.size(k).cast("long").alias(f"n_{k}") for k in base], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(list(PATTERNS)).alias("spans"), F.size("iban").cast("long").alias("n_iban"), mean.alias("top_score"))
