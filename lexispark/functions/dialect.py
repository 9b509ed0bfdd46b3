"""Scalar text functions as SQL, in the dialect of Spark or of the engine that checks it.

``Dialect("spark")`` is what the library runs; ``Dialect("duckdb")`` gives the same function for
the correctness gate. All are built-in expressions, so they stay in whole-stage code generation.
"""

from __future__ import annotations

import unicodedata
from html.entities import entitydefs as entity_latin
from html.entities import html5 as entity_names

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that fold to others without a canonical decomposition, and leading articles.
EXPLICIT = {"Ø": "o", "ø": "o", "Ł": "l", "ł": "l", "Ð": "d", "ð": "d", "Đ": "d", "đ": "d", "ı": "i", "’": "'", "‘": "'"}
DOUBLE = {"Æ": "ae", "æ": "ae", "Œ": "oe", "œ": "oe", "ß": "ss", "Þ": "th", "þ": "th"}
ARTICLES = ["the ", "a ", "an ", "le ", "la ", "les ", "l'", "un ", "une ", "de ", "du ", "des ", "der ", "die ", "das ", "el ", "los ", "las ", "il ", "lo ", "gli ", "i ", "o ", "os "]
# Code points that are letters, numbers and marks of a key.
LETTERS = """0041-005A 0061-007A 00C0-00D6 00D8-00F6 00F8-02AF 0370-0373 0376-037D 037F-0386 0388-03F5 03F7-03FF 1F00-1FFF
0400-0481 048A-052F 0531-0556 0560-0588 05D0-05EA 05EF-05F2 FB1D FB1F-FB4F 0620-064A 066E-066F 0671-06D3 06D5 06E5-06E6
06EE-06EF 06FA-06FC 06FF 0750-077F 08A0-08C9 FB50-FDF9 FE70-FEFC 10A0-10C5 10D0-10FF 1C90-1CBF 2D00-2D25 1200-135A
1380-138F 2D80-2DDE 13A0-13F5 13F8-13FD AB70-ABBF 2D30-2D67 3041-3096 30A1-30FA 3105-312F 31A0-31BF 3400-4DBF 4E00-9FFF
F900-FAFF 1100-11FF 3131-318E A960-A97F AC00-D7FF 20000-2EBEF 2F800-2FA1F 30000-323AF"""
NUMBERS = "0030-0039 0660-0669 06F0-06F9 0966-096F FF10-FF19"
MARKS = """0300-036F 1DC0-1DFF 20D0-20FF FE20-FE2F 0483-0489 0591-05BD 05BF 05C1-05C2 05C4-05C5 05C7 0610-061A 064B-065F
0670 06D6-06DC 06DF-06E4 06E7-06E8 06EA-06ED 08D3-08FF FB1E"""


def char_class(*ranges: str) -> str:
    """The inside of a character class of both engines."""
    return "".join("-".join(f"\\x{{{e}}}" for e in r.split("-")) for part in ranges for r in part.split())


def _base(c: str) -> str:
    """The letter that a precomposed one is made from, by canonical decomposition of pairs."""
    for _ in range(4):
        pair = unicodedata.decomposition(c).split()
        if len(pair) != 2 or pair[0].startswith("<"):
            break
        c = chr(int(pair[0], 16))
    return c


#: Letters and what they fold to: plain capitals, the explicit ones, and all that decompose, by rule.
FOLDS = {chr(c): chr(c + 32) for c in range(65, 91)} | EXPLICIT
FOLDS |= {chr(c): b.lower() if b.isascii() else b for c in range(0xC0, 0x2000) if (b := _base(chr(c))) != chr(c)}


class Dialect:
    def __init__(self, name: str):
        self.name, self.spark = name, name == "spark"

    def rx(self, x: str, pattern: str, to: str) -> str:
        """Replace all matches."""
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to)})" if self.spark else f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to)}, 'g')"

    def lit(self, s: str) -> str:
        s = s.replace("'", "\\'" if self.spark else "''")
        return f"r'{s}'" if self.spark and "\\" in s and "\\'" not in s else f"'{s}'"

    def like(self, x: str, pattern: str) -> str:
        return f"{x} rlike {self.lit(pattern)}" if self.spark else f"regexp_matches({x}, {self.lit(pattern)})"

    def first(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def every(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {group})"

    def explode(self, x: str) -> str:
        return f"explode({x})" if self.spark else f"unnest({x})"

    def bytes_of(self, x: str) -> str:
        return f"octet_length({x})" if self.spark else f"strlen({x})"

    def at(self, x: str, i: int) -> str:
        """Element ``i`` of an array, from 1."""
        return f"get({x}, {i - 1})" if self.spark else f"{x}[{i}]"

    def words(self, x: str, sep: str = " ") -> str:
        return f"filter(split({x}, '{sep}'), w -> w <> '')" if self.spark else f"list_filter(string_split({x}, '{sep}'), lambda w: w <> '')"

    # --- the catalogue's keys -------------------------------------------------------------

    def fold(self, x: str, article: bool = False) -> str:
        """The key of a text: no marks, ASCII lower case, other characters one space; optionally without one leading article."""
        x = self.rx(x, f"[{char_class(MARKS)}]", "")
        for c, to in DOUBLE.items():
            x = f"replace({x}, '{c}', '{to}')"
        x = f"translate({x}, {self.lit(''.join(FOLDS))}, {self.lit(''.join(FOLDS.values()))})"
        out = f"trim({self.rx(x, self.keep, ' ')})"
        return self.rx(out, f"^({'|'.join(ARTICLES)})(.)".replace("'", r"\x27"), "$2" if self.spark else r"\2") if article else out

    #: What folding keeps: letters, numbers and the apostrophe.
    keep = rf"[^{char_class(LETTERS, NUMBERS)}\x27]+"

    def initial(self, folded: str) -> str:
        """The first letter of a folded text, else ``#``."""
        return f"CASE WHEN {self.like(folded, f'^[{char_class(LETTERS)}]')} THEN substr({folded}, 1, 1) ELSE '#' END"

    def cut(self, x: str, n: int) -> str:
        """The longest start of a text within ``n`` bytes of UTF-8 that ends between characters."""
        if not self.spark:
            return f"left({x}, list_max(list_filter(range(0, {n + 1}), lambda k: strlen(left({x}, CAST(k AS INT))) <= {n})))"
        part = lambda k: f"CAST(substring(CAST({x} AS BINARY), 1, {k}) AS STRING)"
        ends = " ".join(f"WHEN is_valid_utf8({part(k)}) THEN {part(k)}" for k in range(n, max(n - 4, -1), -1))
        return f"CASE WHEN octet_length({x}) <= {n} THEN {x} {ends} END"

    def author_tokens(self, folded: str) -> str:
        """The identity of a folded name: of its first twelve words those of two characters or more, in byte order."""
        if self.spark:
            return f"array_join(array_sort(filter(slice({self.words(folded)}, 1, 12), w -> length(w) > 1)), ' ')"
        return f"coalesce(array_to_string(list_sort(list_filter(list_slice({self.words(folded)}, 1, 12), lambda w: length(w) > 1)), ' '), '')"

    def author_key(self, tokens: str) -> str:
        """The key of ``author_tokens``: twelve bytes, cut between characters."""
        return f"rtrim({self.cut(tokens, 12)})"

    def surname_key(self, x: str) -> str:
        """The last word first."""
        return self.rx(x, "^(.*) ([^ ]+)$", "$2 $1" if self.spark else r"\2 \1")

    def clean_name(self, x: str) -> str:
        """A person's name: no bracketed parts however nested, cut at a semicolon, an underscore between letters a
        full stop, 'Last, First' turned round."""
        x = self.rx(x, "(?s);.*", "")
        for _ in range(2):  # letters between two underscores belong to both
            x = self.rx(x, "([A-Za-z])_([A-Za-z])", "$1.$2" if self.spark else r"\1.\2")
        x = f"replace({x}, '_', ' ')"
        if self.spark:
            step = "CASE WHEN c IN ('[', '(') THEN named_struct('d', a.d + 1, 'o', a.o) WHEN c IN (']', ')') THEN named_struct('d', greatest(a.d - 1, 0), 'o', a.o) WHEN a.d > 0 THEN a ELSE named_struct('d', a.d, 'o', concat(a.o, c)) END"
            x = f"CASE WHEN {self.like(x, r'[\[\]()]')} THEN aggregate(split({x}, ''), named_struct('d', 0, 'o', ''), (a, c) -> {step}, a -> a.o) ELSE {x} END"
        else:
            for _ in range(4):
                x = self.rx(x, r"[\[(][^\[\]()]*[\])]", "")
            x = self.rx(self.rx(x, r"(?s)[\[(].*", ""), r"[\])]", "")
        x = self.rx(self.rx(self.rx(x, "[ ,._-]+$", ""), "^ +", ""), " +", " ")
        return self.rx(x, "^([^,]*[^, ]) *, *([^, ][^,]*)$", "$2 $1" if self.spark else r"\2 \1")

    def plain_text(self, x: str) -> str:
        """HTML to text: paragraphs and headings end in an empty line, other breaks in one newline; a bare ``<`` stays."""
        one = "$1" if self.spark else r"\1"
        x = self.rx(x, r"(?i)<(?:/[/\s]*)?(?:p|h[1-6]|hr)(?:[^A-Za-z0-9>][^>]*)?>", "\x01")
        x = self.rx(x, r"(?i)<(?:/[/\s]*)?(?:br|div|li|tr)(?:[^A-Za-z0-9>][^>]*)?>|\n", "\x02")
        x = self.rx(self.rx(x, "<[/!?A-Za-z][^>]*>", ""), r"[\r\t]+", "\x03")
        x = self.rx(self.rx(x, "^[ \x01\x02\x03]*[\x01\x02]", ""), "^\x03+", "")
        x = self.rx(x, "[ \x02\x03]*\x01(?:[ \x01\x02\x03]*[\x01\x02])?", "\x04")
        x = self.rx(x, "[ \x03]*\x02(?:[ \x02\x03]*\x02)?", "\x05")
        x = f"replace({self.rx(x, '([ \x04\x05])\x03+', one)}, '\x03', ' ')"
        x = f"replace(replace({x}, '\x05', chr(10)), '\x04', concat(chr(10), chr(10)))"
        return self.rx(self.entities(x), r"[ \n]+$", "")

    def entities(self, x: str) -> str:
        """Decodes character references: names of the common list, and numbers; others stay."""
        pattern = "&[^;&]{1,15};"
        named = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "\x27", "&amp;": "&"} | {f"&{n}": c for n, c in entity_names.items() if len(c) == 1 and n.endswith(";") and ord(c) < 0x2700 and len(n) <= 9 and n[:-1] in entity_latin}
        found, gaps = self.every(x, pattern), f"split({x}, {self.lit(pattern)}, -1)" if self.spark else f"string_split_regex({x}, {self.lit(pattern)})"
        keys, values = list(named), list(named.values())
        if self.spark:
            table = "map(" + ", ".join(f"{self.lit(k)}, {self.lit(v)}" for k, v in zip(keys, values)) + ")"
            number = "CASE WHEN e rlike '^&#[xX][0-9A-Fa-f]{1,6};$' THEN conv(substring(e, 4, length(e) - 4), 16, 10) WHEN e rlike '^&#[0-9]{1,7};$' THEN substring(e, 3, length(e) - 3) END"
            shown = f"coalesce(element_at({table}, e), CASE WHEN n IS NULL OR n > 1114111 THEN e WHEN n = 0 OR n BETWEEN 55296 AND 57343 THEN '' ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END)"
            done = f"transform({found}, e -> get(transform(array(CAST({number} AS INT)), n -> {shown}), 0))"
            return f"CASE WHEN instr({x}, '&') = 0 THEN {x} ELSE array_join(flatten(transform(arrays_zip({gaps} AS g, {done} AS d), z -> array(z.g, coalesce(z.d, '')))), '') END".replace(" AS g,", ",").replace(" AS d)", ")").replace("z.g", "z.`0`").replace("z.d", "z.`1`")
        table = "MAP {" + ", ".join(f"{self.lit(k)}: {self.lit(v)}" for k, v in zip(keys, values)) + "}"
        number = "CASE WHEN regexp_matches(e, '^&#[xX][0-9A-Fa-f]{1,6};$') THEN CAST(concat('0x', e[4:-2]) AS BIGINT) WHEN regexp_matches(e, '^&#[0-9]{1,7};$') THEN CAST(e[3:-2] AS BIGINT) END"
        shown = f"coalesce({table}[e], CASE WHEN ({number}) IS NULL OR ({number}) > 1114111 THEN e WHEN ({number}) = 0 OR ({number}) BETWEEN 55296 AND 57343 THEN '' ELSE chr(CAST(({number}) AS INT)) END)"
        return f"array_to_string(list_transform(list_zip({gaps}, list_transform({found}, lambda e: {shown})), lambda z: concat(z[1], coalesce(z[2], ''))), '')"

    def visible(self, x: str) -> str:
        """HTML without the elements that are not shown and without tags."""
        for tag in ("head", "style", "script", "title", "rp"):
            x = self.rx(x, rf"(?is)<{tag}\b.*?</{tag}>", "")
        return self.rx(x, "<[^>]*>", "")

    def safe_filename(self, x: str, most: int = 100) -> str:
        """A name for a file: signs that file systems refuse become ``_``, control characters go, cut at ``most`` bytes."""
        x = self.rx(self.rx(self.rx(x, "^[ .]+", ""), r'[\\/:*?"<>|]', "_"), r"[\x00-\x1f\x7f]", "")
        return f"coalesce(nullif({self.rx(self.cut(x, most), '[ .]+$', '')}, ''), 'book')"

    def natural_key(self, x: str) -> str:
        """Digit runs without leading zeros, each after its two-digit length."""
        x = self.rx(f"lower({x})", "0*([0-9]+)", "<$1>" if self.spark else r"<\1>")
        for n in range(18, 0, -1):
            x = self.rx(x, f"<([0-9]{{{n}}})>", f"{n:02d}$1" if self.spark else f"{n:02d}\\1")
        return x


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


def _column(name: str):
    def of(column: str) -> Column:
        return F.expr(getattr(SPARK, name)(column))

    of.__name__, of.__doc__ = name, getattr(Dialect, name).__doc__
    return of


fold, surname_key, clean_name, plain_text, visible, safe_filename, natural_key = map(_column, ("fold", "surname_key", "clean_name", "plain_text", "visible", "safe_filename", "natural_key"))
