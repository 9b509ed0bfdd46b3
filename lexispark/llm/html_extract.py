"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks: text between block borders, with the path of open tags and
their class and id words. A bidirectional LSTM in numpy reads the sequence of a page's blocks
(hashed tag paths, hashed words and a few measures) and labels each block as main text or not,
so a decision sees the whole document. What is not rendered (head, scripts, styles, templates,
frames, form fields, comments in markup) never becomes a block; nor does text in an element with the
attribute ``hidden`` or the style ``display: none``, up to where that element closes. One that
nothing closes hides nothing.

The labeller is trained here, on ``pages`` pages made by rule from a grammar of layouts; no page
of the corpus is used, so the model does not depend on the input.

Memory: pages are labelled together while blocks times pages stay within ``CELLS``; a longer page is
read alone, a chunk of blocks at a time, its states carried from chunk to chunk.

Defined results: a null or empty page has an empty text; markup that is cut off is closed at the
end; pages of one block or none are labelled alike; repeated rows are extracted each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr svg math object canvas audio video".split())
DRAWN = frozenset(("svg", "math"))
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
NAMED = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
P_ENDS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details".split())


#: Elements from the root and from the leaf that a path's features take.
DEEP = 32


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: float


def hidden(attributes: str) -> bool:
    """True for an attribute named ``hidden`` or a style that displays nothing."""
    low = attributes.lower()
    if "hidden" not in low and "display" not in low:
        return False
    named = [(a[1].lower(), a[2] or a[3] or a[4] or "") for a in NAMED.finditer(attributes)]
    return any(k == "hidden" or k == "style" and NOT_SHOWN.search(v) for k, v in named)


def leaf_blocks(page: str | None) -> list[Block]:
    """The rendered blocks of a page in order, white space inside each turned into one space."""
    page = page or ""
    # Text pieces with the hidden elements around them; such a one is a list that its close fills.
    cut: list[tuple[list[tuple[str, bool, tuple[list, ...]]], tuple[str, ...]]] = []
    stack: list[tuple[str, tuple[str, ...], list | None]] = []
    held: list[tuple[str, bool, tuple[list, ...]]] = []
    around: tuple[list, ...] = ()
    links = drawn = 0

    def inline(tag: str) -> bool:
        return drawn > 0 or tag in INLINE

    def end() -> None:
        nonlocal held
        if held:
            # Features of a path are those of its outer and inner elements, however deep it is.
            near = stack if len(stack) <= 2 * DEEP else stack[:DEEP] + stack[-DEEP:]
            cut.append((held, tuple(w for _, ws, _ in near for w in ws)))
            held = []

    def close_from(k: int) -> None:
        nonlocal around, drawn
        if drawn:
            drawn -= sum(t in DRAWN for t, _, _ in stack[k:])
        if around:
            for _, _, mark in stack[k:]:
                if mark is not None:
                    mark.append(True)
            around = tuple(mark for _, _, mark in stack[:k] if mark is not None)
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            held.append((page[at:], links > 0, around))
            break
        if m.start() > at:
            held.append((page[at : m.start()], links > 0, around))
        at = max(m.end(), m.start() + 1)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if not inline(tag):
                end()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close_from(k)
                    break
                if inline(tag) and not drawn and stack[k][0] not in INLINE:
                    break
            continue
        if tag in RAW or tag == "head" or tag == "title":
            if tag not in VOID and not (m[3] or "").endswith("/"):
                if not inline(tag):
                    end()
                close = re.compile(rf"</{re.escape(tag)}\s*>" + (r"|<body\b" if tag == "head" else ""), re.I).search(page, at)
                at = (close.start() if close[0].lower().startswith("<body") else close.end()) if close else n
            continue
        mark = [] if tag not in VOID and hidden(m[3] or "") else None
        if mark is not None and (m[3] or "").endswith("/"):
            continue
        if drawn and tag in P_ENDS:  # a block ends a drawing that was left open
            close_from(next(k for k, (t, _, _) in enumerate(stack) if t in DRAWN))
        if inline(tag):
            links += tag == "a"
            if tag not in VOID and not ((drawn or tag in DRAWN) and (m[3] or "").endswith("/")):
                drawn += tag in DRAWN
                stack.append((tag, (), mark))
                around += () if mark is None else (mark,)
            continue
        end()
        if tag in VOID:
            continue
        closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ()) + (("p",) if tag in P_ENDS else ())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in closes:
                close_from(k)
                break
            if stack[k][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "nav", "aside"):
                break
        words = [f"<{tag}"]
        for a in ATTR.finditer(m[3] or ""):
            words += [w.lower() for w in PART.findall(a[1] or a[2] or a[3] or "")]
        stack.append((tag, tuple(words), mark))
        around += () if mark is None else (mark,)
    end()
    out: list[Block] = []
    for pieces, path in cut:
        shown = [(t, a) for t, a, marks in pieces if not any(marks)]
        text = SPACE.sub(" ", entities.unescape("".join(t for t, _ in shown))).strip()
        if text:
            inner = sum(len(t) for t, a in shown if a)
            out.append(Block(text, path, inner / max(1, sum(len(t) for t, _ in shown))))
    return out


# --- features and the labeller ------------------------------------------------------------------

PATH_DIM, WORD_DIM, EXTRA = 160, 48, 8
#: Blocks times pages that are labelled together, and the blocks of a chunk of a longer page.
CELLS, CHUNK = 1 << 16, 4096
#: Pages a matrix product takes at once: wider ones start BLAS threads, which cost more than they save here.
NARROW = 16


@lru_cache(maxsize=1 << 16)
def _slot(word: str, dim: int) -> int:
    return zlib.crc32(word.encode()) % dim


@lru_cache(maxsize=1 << 14)
def _path_slots(path: tuple[str, ...]) -> np.ndarray:
    """Columns of a tag path: its words and, apart, its last tag."""
    last = ["last" + next((w for w in reversed(path) if w[0] == "<"), "")] if path else []
    return np.array([_slot(w, PATH_DIM) for w in (*path, *last)], np.int64)


def encode(blocks: list[Block], first: int = 0, total: int = 0) -> np.ndarray:
    """One row a block: its tag path, words and measures. ``blocks`` start at ``first`` of a page's ``total``."""
    total = total or len(blocks)
    x = np.zeros((len(blocks), PATH_DIM + WORD_DIM + EXTRA), np.float32)
    measures = []
    for i, b in enumerate(blocks):
        x[i, _path_slots(b.path)] = 1
        own, n, row = b.text.lower().split(), len(b.text), x[i, PATH_DIM : PATH_DIM + WORD_DIM]
        row[[_slot(w, WORD_DIM) for w in own]] = 1 / math.sqrt(max(1, len(own)))
        measures.append((min(1.5, math.log1p(n) / 6), min(1.5, math.log1p(len(own)) / 4), b.linked, b.text[-1] in ".!?…", b.text.count(",") * 10 / (n + 10), min(1, len(b.path) / 12), (first + i) / total, 1))
    if measures:
        x[:, -EXTRA:] = measures
    return x


@dataclass
class BlockLabeller:
    """Bidirectional LSTM with a logistic output a block, trained by back-propagation through time."""

    hidden: int = 16
    seed: int = 5
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, dim: int) -> None:
        rng, h = np.random.default_rng(self.seed), self.hidden
        for d in "fb":
            self.p["W" + d] = (rng.standard_normal((dim, 4 * h)) * np.sqrt(1 / 20)).astype(np.float32)
            self.p["U" + d] = (rng.standard_normal((h, 4 * h)) * np.sqrt(1 / h)).astype(np.float32)
            self.p["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        self.p["v"] = (rng.standard_normal(2 * h) * 0.2).astype(np.float32)
        self.p["o"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, start: tuple[np.ndarray, np.ndarray] | None = None):
        """States of one direction, from ``start`` on; x: time x batch x dim."""
        h = self.hidden
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        z0 = np.concatenate([x[:, k : k + NARROW] @ self.p["W" + d] for k in range(0, x.shape[1], NARROW)], axis=1) + self.p["c" + d]
        s, c = start or (np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32))
        out, trace = np.zeros((*x.shape[:2], h), np.float32), []
        for t in steps:
            z = z0[t] + s @ self.p["U" + d]
            g = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            i, f, o, u = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :], np.tanh(z[:, 3 * h :])
            m = mask[t][:, None]
            c1 = (f * c + i * u) * m
            tc = np.tanh(c1)
            if keep:
                trace.append((t, s, c, i, f, o, u, tc, m))
            s, c = o * tc * m, c1
            out[t] = s
        self.last = s, c
        return out, trace

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2)
        return both @ self.p["v"] + self.p["o"]

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss over the blocks of a batch."""
        h, runs = self.hidden, {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        e = (1 / (1 + np.exp(-np.clip(both @ self.p["v"] + self.p["o"], -30, 30))) - y) * mask / mask.sum()
        g = {"v": np.einsum("tb,tbh->h", e, both), "o": np.array([e.sum()])}
        for k, d in enumerate("fb"):
            ds_out = e[:, :, None] * self.p["v"][k * h : (k + 1) * h]
            gW, gc = np.zeros_like(self.p["W" + d]), np.zeros(4 * h, np.float32)
            ds, dc, gU = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32), np.zeros_like(self.p["U" + d])
            for t, s, c, i, f, o, u, tc, m in reversed(runs[d][1]):
                ds = (ds + ds_out[t]) * m
                dc = (dc + ds * o * (1 - tc * tc)) * m
                dz = np.concatenate([dc * u * i * (1 - i), dc * c * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                for at in range(0, len(dz), NARROW):
                    gW += x[t, at : at + NARROW].T @ dz[at : at + NARROW]
                gc += dz.sum(0)
                gU += s.T @ dz
                ds, dc = dz @ self.p["U" + d].T, dc * f
            g["U" + d], g["W" + d], g["c" + d] = gU, gW, gc
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 4, batch: int = 32, rate: float = 0.01) -> None:
        self.start(pages[0][0].shape[1])
        rng, m, v, k = np.random.default_rng(self.seed), {}, {}, 0
        for _ in range(rounds):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                own = [pages[i] for i in order[at : at + batch]]
                x, mask, y = pad([p[0] for p in own], [p[1] for p in own])
                k += 1
                for name, g in self.step(x, mask, y).items():
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                    v[name] = 0.999 * v.get(name, 0) + 0.001 * g * g
                    self.p[name] = (self.p[name] - rate * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[list[Block]], batch: int = 64) -> list[np.ndarray]:
        """True where a block is main text; pages of like length are run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            own = order[at : at + batch]
            while len(own) > 1 and len(own) * len(pages[own[-1]]) > CELLS:
                own = own[: len(own) // 2]
            at += len(own)
            if len(pages[own[-1]]) > CELLS:
                out[own[0]] = self.label_long(pages[own[0]])
                continue
            x, mask, _ = pad([encode(pages[i]) for i in own])
            z = self.logits(x, mask)
            for k, i in enumerate(own):
                out[i] = z[: len(pages[i]), k] > 0
        return out

    def label_long(self, page: list[Block], chunk: int = CHUNK) -> np.ndarray:
        """``label`` of one page, of which the features of one chunk are held at a time."""
        z = np.zeros(len(page), np.float32)
        starts = list(range(0, len(page), chunk))
        for k, d in enumerate("fb"):
            state, v = None, self.p["v"][k * self.hidden : (k + 1) * self.hidden]
            for s in starts if d == "f" else reversed(starts):
                part = page[s : s + chunk]
                x = encode(part, s, len(page))[:, None]
                z[s : s + len(part)] += self._run(x, np.ones((len(part), 1), np.float32), d, False, state)[0][:, 0] @ v
                state = self.last
        return z + self.p["o"] > 0


def pad(xs: list[np.ndarray], ys: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = max(map(len, xs))
    x, mask, y = np.zeros((t, len(xs), xs[0].shape[1]), np.float32), np.zeros((t, len(xs)), np.float32), np.zeros((t, len(xs)), np.float32)
    for k, own in enumerate(xs):
        x[: len(own), k], mask[: len(own), k] = own, 1
        if ys is not None:
            y[: len(own), k] = ys[k]
    return x, mask, y


# --- training pages -----------------------------------------------------------------------------

# Class and id words of layouts, and words that frames use.
MAIN_WORDS = "content main article post entry story body text page single blog news hentry prose".split()
FRAME_WORDS = "sidebar side widget related recommended promo ad ads advert banner sponsored social share newsletter subscribe popular trending breadcrumb breadcrumbs pagination tags meta toolbar menu nav navigation navbar top header masthead logo footer foot bottom copyright legal cookie cookies consent notice alert popup modal overlay gdpr privacy login signup search comment comments reply respond discussion disqus user rail".split()
FRAME_TEXT = "home about contact us terms privacy policy cookies accept all rights reserved © 2024 subscribe newsletter sign up log in register share tweet follow facebook menu search next previous advertisement sponsored buy now related articles read more comments reply posted by we use cookies your email submit send back to top".split()


def made_page(rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A page by rule and its labels: main text is marked while it is written."""
    syll = ["er", "tion", "the", "an", "ing", "sch", "keit", "eau", "ment", "cion", "ado", "re", "st", "ha", "en", "de", "la", "ou", "ung"]
    mark = "⁣"  # an invisible sign that starts the words of main blocks

    def draws(of: list[str], k: int) -> list[str]:
        return [of[i] for i in rng.integers(0, len(of), k)]

    def prose(n: int) -> str:
        return " ".join("".join(draws(syll, rng.integers(1, 4))) for _ in range(n)).capitalize() + str(rng.choice([".", ".", "!", "", "?", "***"]))

    def some(kind: list[str], k: int) -> str:
        return " ".join(draws(kind, k))

    def attr(kind: list[str]) -> str:
        joined = str(rng.choice(["-", "_", " "])).join(draws(kind, rng.integers(1, 3)))
        return f'{rng.choice(["class", "class", "id"])}="{joined}"'

    def frame_text(low: int, high: int) -> str:
        return some(FRAME_TEXT, rng.integers(low, high)) if rng.random() < 0.5 else prose(rng.integers(low, high))

    def links(k: int) -> str:
        items = [f'<a href="/">{frame_text(1, 4)}</a>' for _ in range(k)]
        return "<ul>" + "".join(f"<li>{a}</li>" for a in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)

    def frame() -> str:
        kind = rng.integers(0, 9)
        inner = links(rng.integers(2, 8)) if rng.random() < 0.4 else "".join(rng.choice(["<p>{}</p>", "<div>{}</div>", "<h3>{}</h3>", "{}<br>"]).format(frame_text(2, 30)) for _ in range(rng.integers(1, 4)))
        if kind == 0:
            return f"<nav>{links(rng.integers(2, 9))}</nav>"
        if kind == 1:
            return f"<aside {attr(FRAME_WORDS)}>{inner}</aside>" if rng.random() < 0.5 else f"<aside>{inner}</aside>"
        if kind == 2:
            return f"<form>{inner}<label>{frame_text(1, 4)}</label><input name=q><button>{frame_text(1, 3)}</button></form>"
        if kind == 3:
            return f'<section {attr(["comments", "comment", "respond", "discussion"])}><h3>{frame_text(1, 3)}</h3>' + "".join(f'<div class="comment"><p>{prose(rng.integers(4, 40))}</p></div>' for _ in range(rng.integers(1, 5))) + "</section>"
        if kind == 4:
            return f'<div {attr(["ad", "ads", "advert", "banner", "promo", "sponsored"])}>{frame_text(3, 30)}</div>'
        if kind == 5:
            return f'<div {attr(["cookie", "notice", "alert", "consent", "banner", "popup", "newsletter"])}><p>{frame_text(4, 30)}</p><button>{frame_text(1, 2)}</button></div>'
        return f"<{(t := rng.choice(['div', 'section', 'ul', 'div']))} {attr(FRAME_WORDS)}>{inner}</{t}>"

    def main(text: str) -> str:
        return mark + text

    def article() -> str:
        parts = [f"<h1>{main(prose(rng.integers(2, 10)))}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.integers(1, 9)):
            kind, n = rng.random(), int(rng.choice([rng.integers(1, 6), rng.integers(6, 60), rng.integers(40, 160)]))
            if kind < 0.66:
                parts.append(f"<p>{'<b>' if rng.random() < 0.2 else ''}{main(prose(n))}" + str(rng.choice(["</p>", "</p>", "<br>", ""])))
            elif kind < 0.74:
                parts.append(f"<h2>{main(prose(rng.integers(1, 7)))}</h2>")
            elif kind < 0.82:
                parts.append("<ul>" + "".join(f"<li>{main(prose(rng.integers(1, 14)))}</li>" for _ in range(rng.integers(1, 5))) + "</ul>")
            elif kind < 0.88:
                parts.append(f"<blockquote><p>{main(prose(n))}</p></blockquote>")
            elif kind < 0.92:
                parts.append("<table><tr>" + "".join(f"<td>{main(prose(rng.integers(1, 5)))}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.95:
                parts.append(f"<pre>{main(prose(n))}</pre>")
            else:
                parts.append(f"<div>{main(prose(n))}</div>")
            if rng.random() < 0.06:
                parts.append(frame())
        return "".join(parts)

    box = rng.random()
    inner = article()
    if box < 0.45:
        inner = f"<article>{inner}</article>" if rng.random() < 0.6 else f"<article {attr(MAIN_WORDS)}>{inner}</article>"
    elif box < 0.6:
        inner = f"<main>{inner}</main>"
    elif box < 0.92:
        inner = f"<div {attr(MAIN_WORDS)}>{inner}</div>"
    before = "".join(frame() for _ in range(rng.integers(0, 4)))
    if rng.random() < 0.4:
        before = f"<header><h2>{frame_text(1, 4)}</h2>{before if rng.random() < 0.5 else ''}</header>" + before
    after = "".join(frame() for _ in range(rng.integers(0, 4)))
    if rng.random() < 0.7:
        after += f"<footer>{rng.choice(['&copy; ', '', ''])}{frame_text(3, 25)}</footer>"
    if rng.random() < 0.3:
        inner = f"<div class='wrapper container'>{inner}{frame() if rng.random() < 0.5 else ''}</div>"
    blocks = leaf_blocks(f"<html><head><title>x</title></head><body>{before}{inner}{after}</body></html>")
    y = np.array([mark in b.text for b in blocks], np.float32)
    for b in blocks:
        b.text = b.text.replace(mark, "") or "."
    return blocks, y


_fitted: dict[tuple[int, int], BlockLabeller] = {}


def default_labeller(pages: int = 1500, seed: int = 5) -> BlockLabeller:
    """The labeller fitted on made pages, once a process: it depends on no table."""
    if (pages, seed) not in _fitted:
        rng = np.random.default_rng(seed)
        made = [(encode(b), y) for b, y in (made_page(rng) for _ in range(pages)) if b]
        model = BlockLabeller(seed=seed)
        model.fit(made)
        _fitted[pages, seed] = model
    return _fitted[pages, seed]


def main_texts(pages: list[str | None], model: BlockLabeller) -> list[str]:
    blocks = [leaf_blocks(p) for p in pages]
    keep = model.label(blocks)
    return ["\n".join(b.text for b, k in zip(own, ks) if k) for own, ks in zip(blocks, keep)]


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: BlockLabeller | None = None, batch: int = 128) -> DataFrame:
    """``keep`` columns, text and n_chars (code points) of every row of ``pages``."""
    rows = pages.select(*keep, F.col(html_col).alias("__h"))
    schema = rows.drop("__h").schema.add("text", "string").add("n_chars", "long")
    shared = pages.sparkSession.sparkContext.broadcast(model or default_labeller())  # some 100 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = main_texts(part.column(part.num_columns - 1).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
