"""Lines and pages of texts in cells of fixed width.

* ``pages`` and ``next_pages``: plain text, wrapped at the last space that fits; expressions only.
  ``next_pages`` lays out a bounded number of pages from a given offset and says where to go on.
* ``even_lines``: paragraphs in lines of least raggedness; of equally ragged ones the longer first line.
* ``filled_lines``: each line as full as it can be; the word that overflows is split at its break places.

Null texts are empty; an empty text has no lines. A word without a fitting break place keeps a line of
its own, however wide.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signs after which a word may break. The soft hyphen shows only where a line breaks at it.
VISIBLE_HYPHENS = "-\u058a\u2010\u2012\u2013\u2014\u2015"
SOFT_HYPHEN = "\u00ad"
GLUE = "\u00a0\u202f"
EAST = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_EAST = re.compile(f"[{EAST}]")
_TOKEN = re.compile(rf"[{GLUE}]|[{EAST}]|[^\s{GLUE}{EAST}{re.escape(VISIBLE_HYPHENS)}]*[{re.escape(VISIBLE_HYPHENS)}]+|[^\s{GLUE}{EAST}{re.escape(VISIBLE_HYPHENS)}]+")


# --- pages of plain text ---------------------------------------------------------------------------


def piece_pattern(width: int) -> str:
    """A line of at most ``width`` characters with what ends it: a line end, the space it breaks at, or nothing."""
    return rf"[^\n]{{1,{width}}}(?: ?\r?\n| ?\r?\z| )|[^\n]{{{width}}}|\n"


def _shown(pieces: Column, width: int, last: Column) -> Column:
    """Pieces as they are shown. ``last`` is the place of the one that ends the text."""
    def show(piece: Column, i: Column) -> Column:
        whole = F.substring(F.regexp_replace(piece, r"\r?\n?\z", ""), 1, width)
        return F.when(piece.endswith("\n") | (i == last), whole).otherwise(F.regexp_replace(piece, r" \z", ""))

    return F.transform(pieces, show)


def pages(texts: DataFrame, width: int, lines: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, page, n_lines, n_chars, shown): the pages of each text from 0, the characters each one takes."""
    cut = texts.select(F.col(id_col), F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(piece_pattern(width)), F.lit(0)).alias("raw"))
    cut = cut.where(F.size("raw") > 0).select(id_col, "raw", _shown(F.col("raw"), width, F.size("raw") - 1).alias("seen"))
    at = lambda of, p: F.slice(of, p * lines + 1, F.lit(lines))
    numbers = F.sequence(F.lit(0), F.floor((F.size("raw") - 1) / lines).cast("int"))
    page = F.transform(numbers, lambda p: F.struct(p.alias("page"), F.size(at(F.col("raw"), p)).alias("n_lines"), F.length(F.array_join(at(F.col("raw"), p), "")).alias("n_chars"), F.array_join(at(F.col("seen"), p), "\n").alias("shown")))
    return cut.select(id_col, F.explode(page).alias("p")).select(id_col, "p.*")


def next_pages(texts: DataFrame, width: int, lines: int, most: int, text_col: str = "text", id_col: str = "doc_id", offset_col: str = "offset") -> DataFrame:
    """(id, offset, next_offset, n_pages, shown, is_partial): at most ``most`` pages from ``offset`` on.

    ``next_offset`` is the watermark to go on from; pages laid out in turns are those of ``pages``.
    Only as much of the text is cut out as the pages can take. At the end of a text there is no row.
    """
    x, most_lines = F.coalesce(F.col(text_col), F.lit("")), most * lines
    start = F.coalesce(F.col(offset_col), F.lit(0)).cast("int")
    # A piece takes at most three characters more than the width, and is known by as many after it.
    some = F.substring(x, start + 1, F.lit((most_lines + 1) * (width + 3)))
    cut = texts.select(F.col(id_col), start.alias("offset"), F.length(x).alias("total"), F.regexp_extract_all(some, F.lit(piece_pattern(width)), F.lit(0)).alias("all"))
    cut = cut.where(F.size("all") > 0).withColumn("raw", F.slice("all", 1, most_lines))
    end = (F.col("offset") + F.length(F.array_join("raw", ""))).alias("next_offset")
    cut = cut.select(id_col, "offset", end, "total", "raw")
    last = F.when(F.col("next_offset") == F.col("total"), F.size("raw") - 1).otherwise(-1)
    shown = F.array_join(_shown(F.col("raw"), width, last), "\n")
    return cut.select(id_col, "offset", "next_offset", F.ceil(F.size("raw") / lines).cast("int").alias("n_pages"), shown.alias("shown"), (F.col("next_offset") < F.col("total")).alias("is_partial"))


# --- lines of paragraphs ---------------------------------------------------------------------------


def tokens(paragraph: str) -> list[tuple[str, int, bool]]:
    """(text, gap before it, may a line break before it?) of a paragraph's tokens.

    Words stand apart by one cell. Glued spaces are tokens that hold both neighbours; East Asian
    characters stand one by one without a gap; after visible hyphens a word may go on in the next line.
    """
    out, end, last = [], 0, ""
    for m in _TOKEN.finditer(paragraph.replace("\ufeff", "")):
        token, apart = m[0], m.start() > end or not out
        glued = token in GLUE or (last != "" and last in GLUE)
        east = bool(_EAST.match(token) or _EAST.match(last[-1:]))
        after_hyphen = last[-1:] != "" and last[-1] in VISIBLE_HYPHENS
        out.append((token, int(apart and not glued), not glued and (apart or east or after_hyphen)))
        end, last = m.end(), token
    return out


def cells(word: str) -> int:
    """Cells of a word: soft hyphens and marks that stand on letters take none."""
    return len(word) if word.isascii() else sum(c != SOFT_HYPHEN and not unicodedata.combining(c) for c in word)


def split_word(word: str, room: int, any_place: bool, places: Callable[[str], list[int]] | None) -> tuple[str, str] | None:
    """The widest start of a word that fits with its hyphen, and the rest; None if there is none.

    Soft hyphens come first, then the ``places`` of the word; where it has none, ``any_place`` allows
    all that leave two letters on each side.
    """
    soft = [i for i, c in enumerate(word) if c == SOFT_HYPHEN and 0 < i < len(word) - 1]
    at = soft or list(places(word) or [] if places else [])
    if not at and any_place:
        core = re.search(r"\w(?:.*\w)?", word, re.S)
        at = range(core.start() + 2, core.end() - 1) if core else []
    for i in sorted(at, reverse=True):
        mark = "" if i < len(word) and _EAST.match(word[i]) else "-"
        if 0 < i < len(word) and cells(word[:i]) + len(mark) <= room:
            return word[:i] + mark, word[i:].lstrip(SOFT_HYPHEN)
    return None


def _line(part: list[tuple[str, int, bool]]) -> str:
    return "".join(" " * gap * (i > 0) + token for i, (token, gap, _) in enumerate(part)).replace(SOFT_HYPHEN, "")


def even(paragraph: str, width: int, indent: int = 0, places=None) -> list[str]:
    """Lines with the least sum of squared empty cells, the last line's not counted."""
    row, i = tokens(paragraph), 0
    while i < len(row):  # words that no line holds are split wherever it goes
        token, gap, free = row[i]
        parts = split_word(token, width - indent * (i == 0), True, places) if cells(token) > width - indent * (i == 0) else None
        if parts:
            row[i : i + 1] = [(parts[0], gap, free), (parts[1], 1, True)]
        i += 1
    n = len(row)
    if not n:
        return []
    own, gaps, free = [cells(t) for t, _, _ in row], [g for _, g, _ in row], [f for _, _, f in row]
    least, last = [0] * (n + 1), list(range(n))
    for i in range(n - 2, -1, -1):
        room = width - indent * (i == 0)
        left, best, at = room - own[i], None, i
        for j in range(i, n):  # no more steps than a line has tokens
            left -= own[j] + gaps[j] if j > i else 0
            if left < 0:
                break
            if j + 1 == n or free[j + 1]:
                cost = 0 if j + 1 == n else left * left + least[j + 1]
                if best is None or cost <= best:
                    best, at = cost, j
        # One wide word or group: a line for its first token.
        least[i], last[i] = least[i + 1] if best is None else best, at
    lines, i = [], 0
    while i < n:
        lines.append(_line(row[i : last[i] + 1]))
        i = last[i] + 1
    return lines


def filled(paragraph: str, width: int, indent: int = 0, places=None) -> list[str]:
    """Lines filled one by one; what may not stand at the start of a line takes its group along."""
    rest, lines = tokens(paragraph)[::-1], []
    while rest:
        part, taken, room = [], 0, width - indent * (not lines)
        while rest:
            token, gap, free = rest[-1]
            need = cells(token) + gap * bool(part)
            if taken + need <= room:
                part.append(rest.pop())
                taken += need
                continue
            parts = split_word(token, room - taken - gap * bool(part), not part, places)
            if parts:
                rest[-1] = (parts[1], 1, True)
                part.append((parts[0], gap, free))
            elif not part:
                part.append(rest.pop())
            break
        while rest and len(part) > 1 and not rest[-1][2]:
            rest.append(part.pop())
        lines.append(_line(part))
    return lines


def _laid_out(batches: Iterator[pa.RecordBatch], of: Callable[[str], list[str]]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 256):
            some = b.slice(k, 256)
            lines = [[line for p in (t or "").split("\n") for line in of(p)] for t in some.column(1).to_pylist()]
            yield pa.record_batch([some.column(0), pa.array(lines, pa.list_(pa.string()))], names=b.schema.names[:1] + ["lines"])


def _lines(texts: DataFrame, of: Callable[[str], list[str]], text_col: str, id_col: str) -> DataFrame:
    given = texts.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = given.schema[0].dataType.simpleString()
    return given.mapInArrow(partial(_laid_out, of=of), f"`{id_col}` {kind}, lines array<string>")


def even_lines(texts: DataFrame, width: int, indent: int = 0, places: Callable[[str], list[int]] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, lines): each text's paragraphs in lines of least raggedness. One pass, no shuffle."""
    return _lines(texts, partial(even, width=width, indent=indent, places=places), text_col, id_col)


def filled_lines(texts: DataFrame, width: int, indent: int = 0, places: Callable[[str], list[int]] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, lines): each text's paragraphs in lines filled in turn, words split at their ``places``."""
    return _lines(texts, partial(filled, width=width, indent=indent, places=places), text_col, id_col)
