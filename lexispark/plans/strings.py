"""Queries of scalar functions: names, paths, words, styles, lines of logs, each with the SQL that checks it."""

from __future__ import annotations

from ..functions.dialect import DUCK, char_class
from .catalog import Dialect, _run, books, keyed
from .records import RULES
from .shelves import numbered

D = Dialect
STATEMENTS = {}


def query(f):
    STATEMENTS[f.__name__] = f
    return f


def mapped(d: D, array: str, body: str) -> str:
    """``body`` of each element ``t``."""
    return f"transform({array}, t -> {body})" if d.spark else f"list_transform({array}, lambda t: {body})"


def joined(d: D, array: str, sep: str = "") -> str:
    return f"array_join({array}, '{sep}')" if d.spark else f"coalesce(array_to_string({array}, '{sep}'), '')"


def reference(d: D, n: int) -> str:
    return f"${n}" if d.spark else f"\\{n}"


# --- names and paths -----------------------------------------------------------------------------


@query
def author_keys(d):
    return f"WITH {keyed(d)} SELECT doc_id, clean, author_fold AS author_key FROM keyed"


@query
def byte_truncate(d):
    """The longest start of a text within 72 bytes, and the text without its last three characters."""
    return f"SELECT doc_id, {d.cut('text', 72)} AS short, CASE WHEN length(text) > 3 THEN substr(text, 1, length(text) - 3) ELSE '' END AS dropped FROM documents"


@query
def fat_component(d):
    bad = r'[\\/:*?"<>| \x01-\x1f]'
    return f"SELECT doc_id, {d.rx(d.cut('text', 63), bad, '-')} AS name FROM documents"


@query
def feed_filename(d):
    """File name of a feed's book: author and title, either way round, or the title alone."""
    base = "CASE doc_id % 3 WHEN 0 THEN CASE WHEN author = '' THEN title ELSE concat(author, ' - ', title) END WHEN 1 THEN CASE WHEN author = '' THEN title ELSE concat(title, ' - ', author) END ELSE title END"
    return f"WITH {books(d)}, named AS (SELECT doc_id, {base} AS base FROM (SELECT doc_id, title, CASE WHEN source_author = 'Unknown' THEN '' ELSE source_author END AS author FROM books) AS b) SELECT doc_id, concat({d.safe_filename('base')}, '.epub') AS filename FROM named"


@query
def bookmark_summary(d):
    """Of white space in a row the first stays, newlines go, edges are trimmed, 72 bytes are kept."""
    x = d.rx("text", r"([ \t\n\x0b\f\r])[ \t\n\x0b\f\r]+", reference(d, 1))
    x = d.rx(f"replace({x}, chr(10), '')", r"^[ \t\x0b\f\r]+|[ \t\x0b\f\r]+$", "")
    return f"SELECT doc_id, {d.cut('summary', 72)} AS summary FROM (SELECT doc_id, {x} AS summary FROM documents) AS s"


@query
def bookmark_path(d):
    """The file that keeps a book's bookmarks: its path flattened, the last suffix exchanged."""
    flat = d.rx(d.rx("substr(path, 2)", r"[/\\]", "_"), "[.][^.]*$", "")
    return f"WITH {books(d)} SELECT doc_id, concat('/bookmarks/', {flat}, '.json') AS file FROM books"


@query
def path_join(d):
    """A folder and a name with one slash between them."""
    folder = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN concat('/', lang) ELSE concat('/', lang, '/') END"
    return f"SELECT doc_id, concat(CASE WHEN folder = '' THEN '/' WHEN folder LIKE '%/' THEN folder ELSE concat(folder, '/') END, source) AS path FROM (SELECT doc_id, source, {folder} AS folder FROM documents) AS f"


@query
def safe_component(d):
    """May a name be part of a path?"""
    name = "CASE doc_id % 5 WHEN 0 THEN '..' WHEN 1 THEN '' WHEN 2 THEN concat(lang, '/', source) WHEN 3 THEN '...' ELSE source END"
    test = d.like("name", r"[/\\]")
    return f"SELECT doc_id, name, name <> '' AND name <> '.' AND name <> '..' AND NOT {test} AS safe FROM (SELECT doc_id, {name} AS name FROM documents) AS n"


@query
def uri_decode(d):
    """Escapes of two hex digits become bytes; a lone per cent sign and a plus stay."""
    raw = "concat(source, '%20a+b%C3%A9', CASE doc_id % 3 WHEN 0 THEN '%zz%4' WHEN 1 THEN '%2Fx' ELSE '%' END, 'n', CAST(doc_id AS STRING))"
    if d.spark:
        parts = "regexp_extract_all(raw, r'%[0-9A-Fa-f]{2}|%|[^%]+', 0)"
        shown = f"make_valid_utf8(CAST(unhex(array_join(transform({parts}, p -> CASE WHEN p rlike '^%[0-9A-Fa-f]{{2}}$' THEN substr(p, 2) ELSE hex(p) END), '')) AS STRING))"
    else:
        shown = "url_decode(raw)"
    return f"SELECT doc_id, {shown} AS path FROM (SELECT doc_id, {raw} AS raw FROM documents) AS r"


@query
def search_template(d):
    """A feed's search address with the query's words escaped."""
    words = d.first("title", "^[^ ]* ?[^ ]*")
    if d.spark:
        escaped = "replace(replace(replace(url_encode(q), '+', '%20'), '%7E', '~'), '*', '%2A')"
    else:
        escaped = "url_encode(q)"
    return f"WITH {books(d)} SELECT doc_id, replace('/find?q={{searchTerms}}&n=1', '{{searchTerms}}', {escaped}) AS url FROM (SELECT doc_id, {words} AS q FROM books) AS b"


@query
def url_parts(d):
    """Scheme, host, port, path, query and anchor of an address."""
    part = lambda p: f"nullif({d.first('u', p, 1)}, '')"
    made = "concat(url, CASE page_id % 3 WHEN 0 THEN '?a=1&b=2#top' WHEN 1 THEN '#x' ELSE '' END)"
    host = r"^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)"
    return f"SELECT page_id, {part('^([a-z]+)://')} AS scheme, {part(host)} AS host, {part('^[a-z]+://[^/?#]*:([0-9]+)')} AS port, {part('^[a-z]+://[^/?#]*([^?#]*)')} AS path, {part('^[^?#]*[?]([^#]*)')} AS query, {part('#(.*)$')} AS anchor FROM (SELECT page_id, {made} AS u FROM pages) AS p"


@query
def xml_local_name(d):
    """Names of tags without their prefix."""
    return f"SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, {d.rx('t', '^[^:]*:', '')} AS tag FROM (SELECT page_id, concat('x:', tag) AS t FROM (SELECT page_id, {d.explode(d.every('html', '<([a-zA-Z][a-zA-Z0-9]*)', 1))} AS tag FROM pages) AS o) AS a) AS b GROUP BY page_id, tag"


@query
def version_newer(d):
    """Is a release newer than the build? By three numbers; a candidate build gives way to an equal release."""
    current = "concat(CAST(o_orderkey % 3 AS STRING), '.', CAST(o_orderkey % 12 AS STRING), '.', CAST(o_orderkey % 5 AS STRING), CASE WHEN o_orderkey % 4 = 0 THEN '-rc1' ELSE '' END)"
    latest = "concat(CAST(o_custkey % 3 AS STRING), '.', CAST(o_custkey % 12 AS STRING), '.', CAST(o_custkey % 5 AS STRING))"
    num = lambda x, k: f"CAST({d.first(x, '^([0-9]+)[.]([0-9]+)[.]([0-9]+)', k)} AS INT)"
    parts = ", ".join(f"{num(x, k)} AS {x[0]}{k}" for x in ("latest", "built") for k in (1, 2, 3))
    verdict = "CASE WHEN latest = built THEN false WHEN l1 <> b1 THEN l1 > b1 WHEN l2 <> b2 THEN l2 > b2 WHEN l3 <> b3 THEN l3 > b3 ELSE built LIKE '%-rc%' END"
    return f"SELECT o_orderkey, {verdict} AS newer FROM (SELECT *, {parts} FROM (SELECT o_orderkey, {current} AS built, {latest} AS latest FROM orders) AS v) AS w"


@query
def font_filename(d):
    """Family and size of a font file; names of another form are no fonts."""
    name = "concat(replace(p_name, ' ', '_'), '_', CAST(p_size * 7 AS STRING), CASE p_partkey % 4 WHEN 0 THEN '.cpfont.tmp' WHEN 1 THEN '' ELSE '.cpfont' END)"
    whole = r"^(.+)_([0-9]+)[.]cpfont$"
    return f"SELECT p_partkey, family, size FROM (SELECT p_partkey, {d.first('name', whole, 1)} AS family, CAST(nullif({d.first('name', whole, 2)}, '') AS INT) AS size FROM (SELECT p_partkey, {name} AS name FROM part) AS n) AS f WHERE size BETWEEN 1 AND 255 AND length(family) <= 127"


# --- words ---------------------------------------------------------------------------------------

#: Bytes that are no part of a word at its edges: ASCII that is no letter or digit, and general punctuation.
EDGE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{2000}-\x{207F}]"


def clean_word(d: D, x: str) -> str:
    return f"translate({d.rx(x, f'^{EDGE}+|{EDGE}+$', '')}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def stem_variants(d: D, w: str) -> list[str]:
    """What a word may be a form of, in order; null where a rule does not apply."""
    n = f"length({w})"
    ends = lambda s: f"{w} LIKE '_%{s}'"
    less = lambda k: f"substr({w}, 1, {n} - {k})"
    twice = lambda k: f"{n} >= {k + 1} AND substr({w}, {n} - {k - 1}, 1) = substr({w}, {n} - {k}, 1)"
    when = lambda test, value: f"CASE WHEN {test} THEN {value} END"
    possessive = ends("’s") + " OR " + (f"{w} LIKE '_%\\'s'" if d.spark else f"{w} LIKE '_%''s'")
    return [when(possessive, less(2)), when(ends("ies"), f"concat({less(3)}, 'y')"), when(ends("es"), less(2)), when(ends("s"), less(1)), when(ends("ed"), less(2)), when(ends("ed"), less(1)), when(f"{ends('ed')} AND {twice(3)}", less(3)), when(ends("ing"), less(3)), when(ends("ing"), f"concat({less(3)}, 'e')"), when(f"{ends('ing')} AND {twice(4)}", less(4))]


def asked_words(d: D, table: str) -> str:
    return f"SELECT DISTINCT {clean_word(d, 't')} AS w FROM (SELECT {d.explode(d.words('text'))} AS t FROM {table}) AS raw"


@query
def word_clean(d):
    return f"SELECT w, length(w) AS n FROM ({asked_words(d, 'documents')}) AS a WHERE w <> ''"


@query
def word_stems(d):
    """The distinct variants of each word."""
    listed = f"array({', '.join(stem_variants(d, 'w'))})" if d.spark else f"[{', '.join(stem_variants(d, 'w'))}]"
    return f"SELECT DISTINCT w, variant FROM (SELECT w, {d.explode(listed)} AS variant FROM ({asked_words(d, 'benchmark')}) AS a) AS b WHERE variant IS NOT NULL AND variant <> ''"


@query
def dictionary_lookup(d):
    """Headword of each word: itself, else by its synonym, else by the first variant that is one; one pass over the words."""
    heads = f"SELECT headword, min(item_id) AS ordinal FROM (SELECT item_id, {clean_word(d, 't')} AS headword FROM (SELECT item_id, {d.explode(d.words('text'))} AS t FROM benchmark) AS r) AS h WHERE length(headword) >= 3 GROUP BY headword"
    synonym = "CASE WHEN w LIKE '%x' THEN concat(substr(w, 1, length(w) - 1), 'ks') END"
    listed = ", ".join(["w", synonym, *stem_variants(d, "w")])
    cands = numbered(d, f"({asked_words(d, 'documents')}) AS a", "w", f"array({listed})" if d.spark else f"[{listed}]", "cand")
    found = f"SELECT c.w, h.headword, h.ordinal, row_number() OVER (PARTITION BY c.w ORDER BY c.pos) AS pick FROM ({cands}) AS c JOIN heads h ON c.cand = h.headword"
    return f"WITH heads AS ({heads}), found AS ({found}) SELECT w, headword, ordinal FROM found WHERE pick = 1"


# Signs that are trimmed from words, and those that break a word visibly.
PUNCTUATION = "-.,!?;:\"')(«»‘’‚“”„ {}[]/‹›…"
HYPHENS = "002D 058A 2010 2012 2013 2014 2015 2043 207B 208B 2212 2E17 2E3A 2E3B FE58 FE63 FF0D 005F 2026"


@query
def punctuation_trim(d):
    """Words without a trailing note number in brackets and without signs at their edges."""
    signs = "[" + "".join(f"\\x{{{ord(c):04X}}}" for c in PUNCTUATION) + "]"
    noted = "concat(t, CASE length(t) % 4 WHEN 0 THEN '[12].' WHEN 1 THEN '…)' ELSE '' END)"
    x = d.rx(noted, rf"\[[0-9]+{signs}*$", "")
    return f"SELECT DISTINCT t, {d.rx(x, f'^{signs}+|{signs}+$', '')} AS word FROM (SELECT {d.explode(d.words('text'))} AS t FROM benchmark) AS r"


@query
def tokenise(d):
    """Tokens of a text: runs without white space, glued spaces by themselves, East Asian characters one by one."""
    x = "replace(concat(text, ' a b 漢字かな ﻿z'), '﻿', '')"
    east = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}"
    tokens = d.every(x, rf"[\x{{A0}}\x{{202F}}]|[{east}]|[^ \t\n\x0b\f\r\x{{A0}}\x{{202F}}{east}]+")
    return f"SELECT token, count(*) AS n FROM (SELECT {d.explode(tokens)} AS token FROM documents) AS t GROUP BY token"


@query
def token_boundary(d):
    """At each boundary: may a line break, may the gap stretch, and does a visible hyphen allow a break?"""
    last = d.like("token", f"[{char_class(HYPHENS)}]$")
    return f"SELECT event_id, NOT continues OR no_space AS breaks, NOT continues OR (is_space AND NOT no_space) AS stretches, {last} AS after_hyphen FROM (SELECT event_id, event_id % 2 = 0 AS continues, event_id % 3 = 0 AS no_space, event_id % 5 = 0 AS is_space, CASE event_id % 7 WHEN 0 THEN 'a-' WHEN 1 THEN 'b—' WHEN 2 THEN 'c‑' WHEN 3 THEN 'd­' ELSE event_type END AS token FROM events) AS e"


@query
def bidi_level(d):
    """Direction of a text by its first strong character among the first 64; without one the fallback."""
    right = r"\x{0590}-\x{05FF}\x{0600}-\x{07BF}\x{0800}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFC}"
    x = "concat(CASE doc_id % 3 WHEN 0 THEN '12 — ' WHEN 1 THEN '… שלום ' ELSE '' END, text)"
    first = d.first("x", rf"^[^\p{{L}}]{{0,63}}(\p{{L}})", 1)
    return f"SELECT doc_id, CASE WHEN c = '' THEN 0 WHEN {d.like('c', f'[{right}]')} THEN 1 ELSE 0 END AS level FROM (SELECT doc_id, {first} AS c FROM (SELECT doc_id, {x} AS x FROM documents) AS a) AS b"


# --- markup and styles ---------------------------------------------------------------------------

VOID_TAGS = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"


@query
def xhtml(d):
    """Markup made well-formed: comments and declarations go, names in lower case, void elements closed, stray signs escaped."""
    parts = d.every("html", r"(?s)<!--.*?(?:-->|\z)|<[!?][^>]*(?:>|\z)|</?[A-Za-z](?:\"[^\"]*\"|'[^']*'|[^'\">])*>|&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);|[^<&]+|[<&]".replace("'", r"\x27"))
    name = f"lower({d.first('t', '^</?([A-Za-z0-9]*)', 1)})"
    rest = d.rx("t", "^</?[A-Za-z0-9]*", "")
    void = d.like(name, f"^({VOID_TAGS})$")
    done = f"CASE WHEN t LIKE '<!%' OR t LIKE '<?%' THEN '' WHEN t = '<' THEN '&lt;' WHEN t = '&' THEN '&amp;' WHEN t LIKE '</%' THEN CASE WHEN {void} THEN '' ELSE concat('</', {name}, {rest}) END WHEN t LIKE '<%' THEN CASE WHEN {void} AND t NOT LIKE '%/>' THEN concat('<', {name}, substr({rest}, 1, length({rest}) - 1), '/>') ELSE concat('<', {name}, {rest}) END ELSE t END"
    return f"SELECT page_id, concat('<html><body>', {joined(d, mapped(d, parts, done))}, '</body></html>') AS xhtml FROM pages"


SHEET = "sheet AS (SELECT concat('/* c */ p, div.content { text-indent: 1.5em; margin: 0 2px } .a > b { color: red } H1 { font-weight: BOLD !important; text-align: Center } #x { a: b } .note{margin-top:-3pt;font-weight:650}', ' ') AS css)"


def declarations(d: D) -> str:
    """(rule, selector, pos, prop, val) of a sheet; only selectors of a tag, a class or both are kept."""
    rules = numbered(d, "sheet", "css", d.every(d.rx("css", r"(?s)/\*.*?\*/", ""), r"[^{}]+\{[^}]*\}"), "rule")
    split = (lambda x, s: f"split({x}, '{s}')") if d.spark else (lambda x, s: f"string_split({x}, '{s}')")
    chosen = f"SELECT pos AS rule_nr, {d.first('rule', '[{]([^}]*)[}]', 1)} AS body, {d.explode(split(d.first('rule', '^([^{]*)', 1), ','))} AS raw FROM ({rules}) AS r"
    chosen = f"SELECT rule_nr, body, trim(raw) AS selector FROM ({chosen}) AS k"
    lines = numbered(d, f"({chosen}) AS c", "rule_nr, selector", split("body", ";"), "decl")
    kept = d.like("selector", "^[A-Za-z0-9-]*([.][A-Za-z0-9_-]+)?$")
    value = d.rx(f"trim({d.first('decl', ':(.*)$', 1)})", "(?i) *! *important$", "")
    return f"SELECT CAST(rule_nr AS INT) AS rule_nr, lower(selector) AS selector, CAST(pos AS INT) AS pos, lower(trim({d.first('decl', '^([^:]*):', 1)})) AS prop, {value} AS val FROM ({lines}) AS l WHERE {kept} AND {d.like('decl', ':')}"


@query
def css_sheet(d):
    return f"WITH {SHEET} {declarations(d)}"


@query
def css_values(d):
    """Values of declarations as numbers with units, weights and alignments."""
    number = f"nullif({d.first('v', r'^([-+]?[0-9]*[.]?[0-9]+)', 1)}, '')"
    unit = f"lower({d.rx('v', r'^[-+.0-9]*', '')})"
    length = f"CASE WHEN {number} IS NOT NULL THEN CASE {unit} WHEN 'em' THEN 'em' WHEN 'rem' THEN 'rem' WHEN 'pt' THEN 'pt' WHEN '%' THEN '%' ELSE 'px' END END"
    bold = f"CASE WHEN lower(v) IN ('bold', 'bolder') THEN true WHEN {d.like('v', '^[0-9]+$')} THEN CAST(CASE WHEN {d.like('v', '^[0-9]+$')} THEN v END AS INT) >= 600 ELSE false END"
    align = "CASE lower(v) WHEN 'left' THEN 'left' WHEN 'start' THEN 'left' WHEN 'right' THEN 'right' WHEN 'end' THEN 'right' WHEN 'center' THEN 'center' WHEN 'justify' THEN 'justify' END"
    extra = "SELECT selector, prop, val AS v FROM rules"
    return f"WITH {RULES}, {SHEET}, vals AS ({extra} UNION ALL SELECT selector, prop, val AS v FROM ({declarations(d)}) AS d) SELECT selector, prop, v, CAST({number} AS DOUBLE) AS number, {length} AS unit, {bold} AS bold, {align} AS align FROM vals"


@query
def css_files(d):
    """Style sheets of a book: those that its manifest lists and those in its container, each once."""
    return "SELECT DISTINCT book, file FROM (SELECT l_orderkey AS book, concat('s', CAST(l_partkey % 9 AS STRING), '.css') AS file FROM lineitem WHERE l_linenumber % 2 = 0 UNION ALL SELECT l_orderkey AS book, concat('s', CAST(l_suppkey % 9 AS STRING), '.CSS') AS file FROM lineitem WHERE l_linenumber % 3 = 0) AS f WHERE lower(file) LIKE '%.css'"


@query
def xpath_parse(d):
    """Chapter, steps, text node and offset of a position path; null where it has another form."""
    path = "concat('/body/DocFragment[', CAST(o_orderkey % 90 + 1 AS STRING), ']/body/div[', CAST(o_custkey % 9 + 1 AS STRING), ']/', CASE o_orderkey % 3 WHEN 0 THEN 'ul/li[4]' WHEN 1 THEN 'p[12]' ELSE 'p' END, CASE o_orderkey % 4 WHEN 0 THEN '/text()' WHEN 1 THEN '/text()[2]' ELSE '' END, '.', CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE CAST(o_custkey % 500 AS STRING) END)"
    whole = r"^/body/DocFragment\[([0-9]+)\]/body/((?:[a-z0-9]+(?:\[[0-9]+\])?/?)+?)(?:/text\(\)(?:\[([0-9]+)\])?)?[.]([0-9]+)$"
    part = lambda k: f"nullif({d.first('path', whole, k)}, '')"
    steps = d.every(part(2), r"([a-z0-9]+(?:\[[0-9]+\])?)", 1)
    known = f"CASE WHEN {part(2)} IS NOT NULL THEN {steps} END"
    shown = f"coalesce({joined(d, known, '|')}, '')"
    return f"SELECT o_orderkey, path, CAST({part(1)} AS INT) - 1 AS spine, {shown} AS steps, CASE WHEN {part(1)} IS NOT NULL THEN coalesce(CAST({part(3)} AS INT), 1) END AS text_node, CAST({part(4)} AS INT) AS off FROM (SELECT o_orderkey, {path} AS path FROM orders) AS p"


# --- lines, times and pictures -------------------------------------------------------------------


@query
def memory_lines(d):
    """Free, total and largest block of lines about memory."""
    line = "concat('[MEM] Free: ', CAST(event_id AS STRING), ' bytes, Total: ', CAST(user_id * 1000 AS STRING), ' bytes, Min Free: 7 bytes', CASE WHEN event_id % 3 = 0 THEN '' ELSE ', MaxAlloc: 99 bytes' END)"
    n = lambda name: f"CAST(nullif({d.first('line', rf'\b{name}:\s*([0-9]+)', 1)}, '') AS BIGINT)"
    return f"SELECT event_id, {n('Free')} AS free, {n('Total')} AS total, {n('MaxAlloc')} AS largest FROM (SELECT event_id, {line} AS line FROM events) AS l"


@query
def size_history(d):
    """Sizes of builds from their reports, with the change from the build before."""
    line = "concat(CASE WHEN o_orderkey % 2 = 0 THEN 'RAM:   [==  ] 21% used ' ELSE 'Flash: [=== ] 80% (used ' END, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ' bytes from ', CAST(o_custkey * 4096 AS STRING), ' bytes)')"
    whole = r"^(RAM|Flash):.*?([0-9]+)\s+bytes\s+from\s+([0-9]+)\s+bytes"
    return f"SELECT o_orderkey, kind, used, available, used - lag(used) OVER (PARTITION BY o_custkey, kind ORDER BY o_orderkey) AS delta FROM (SELECT o_orderkey, o_custkey, {d.first('line', whole, 1)} AS kind, CAST({d.first('line', whole, 2)} AS BIGINT) AS used, CAST({d.first('line', whole, 3)} AS BIGINT) AS available FROM (SELECT o_orderkey, o_custkey, {line} AS line FROM orders) AS l) AS p"


def pad2(x: str) -> str:
    return f"lpad(CAST({x} AS STRING), 2, '0')"


@query
def utc_offset_label(d):
    """An offset in quarter hours as it is shown."""
    q = "(CAST(n_nationkey AS INT) * 7 - 48)"
    return f"SELECT n_nationkey, CASE WHEN q = 0 THEN 'UTC' ELSE concat('UTC', CASE WHEN q < 0 THEN '-' ELSE '+' END, CAST(CAST(floor(abs(q) / 4) AS INT) AS STRING), ':', {pad2('abs(q) % 4 * 15')}) END AS label FROM (SELECT n_nationkey, {q} AS q FROM nation) AS n"


@query
def local_clock(d):
    """Time of day at an offset from UTC, in 24 and in 12 hours."""
    minutes = "(CAST(extract(HOUR FROM ts) AS INT) * 60 + CAST(extract(MINUTE FROM ts) AS INT) + CAST(user_id % 97 - 48 AS INT) * 15 + 2880) % 1440"
    h = "CAST(floor(m / 60) AS INT)"
    return f"SELECT event_id, concat({pad2(h)}, ':', {pad2('m % 60')}) AS clock_24, concat(CAST(CASE WHEN {h} % 12 = 0 THEN 12 ELSE {h} % 12 END AS STRING), ':', {pad2('m % 60')}, CASE WHEN {h} < 12 THEN ' AM' ELSE ' PM' END) AS clock_12 FROM (SELECT event_id, {minutes} AS m FROM events) AS e"


@query
def percent_shown(d):
    """A share as whole per cent, between 0 and 100."""
    return "SELECT o_orderkey, CAST(floor(least(greatest(o_totalprice / 400000, 0), 1) * 100 + 0.5) AS INT) AS pct FROM orders"


BAYER = [0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5]  # fixed values, row by row


@query
def gray_levels(d):
    """A gray as one of four levels: by thresholds, and by an ordered dither of four by four."""
    cell = f"array({', '.join(map(str, BAYER))})" if d.spark else f"[{', '.join(map(str, BAYER))}]"
    g = "least(greatest(gray + (b - 8) * 5, 0), 255)"
    place = "CAST(y % 4 * 4 + x % 4 AS INT)"
    at = f"get({cell}, {place})" if d.spark else f"{cell}[{place} + 1]"
    return f"SELECT event_id, CASE WHEN gray < 45 THEN 0 WHEN gray < 70 THEN 1 WHEN gray < 140 THEN 2 ELSE 3 END AS plain, CASE WHEN {g} < 64 THEN 0 WHEN {g} < 128 THEN 1 WHEN {g} < 192 THEN 2 ELSE 3 END AS dithered FROM (SELECT event_id, gray, {at} AS b FROM (SELECT event_id, CAST(event_id * 7 % 256 AS INT) AS gray, CAST(event_id % 480 AS INT) AS x, CAST(user_id % 800 AS INT) AS y FROM events) AS p) AS q"


QUERIES = {n: (_run(f), f(DUCK)) for n, f in STATEMENTS.items()}
