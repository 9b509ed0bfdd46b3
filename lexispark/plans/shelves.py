"""Queries over contents, positions, dictionaries, devices and counters, each with the SQL that checks it."""

from __future__ import annotations

from ..functions.dialect import DUCK
from .catalog import Dialect, _ranked_sql, _run, _run_ranked, books, dictionary, keyed, spine

D = Dialect
STATEMENTS = {}
RANKED = {}


def query(f):
    STATEMENTS[f.__name__] = f
    return f


def ranked(*order):
    def keep(f):
        RANKED[f.__name__] = (f, list(order))
        return f

    return keep


def numbered(d: D, table: str, keep: str, items: str, name: str) -> str:
    """A row (``keep``, pos, ``name``) an element of the array ``items``, numbered from 0."""
    if d.spark:
        return f"SELECT {keep}, pos, {name} FROM {table} LATERAL VIEW posexplode({items}) x AS pos, {name}"
    return f"SELECT {keep}, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS {name} FROM (SELECT {keep}, {items} AS l FROM {table}) AS t"


def last_known(d: D, x: str, over: str) -> str:
    return f"last_value({x}) IGNORE NULLS OVER ({over})" if d.spark else f"last_value({x} IGNORE NULLS) OVER ({over})"


def listed(d: D, x: str, order: str, sep: str = "") -> str:
    """The strings ``x`` of a group joined in order."""
    if d.spark:
        return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {x} AS v))), z -> z.v), '{sep}')"
    return f"string_agg({x}, '{sep}' ORDER BY {order}, {x})"


# --- listings -----------------------------------------------------------------------------------

# Names that listings never show, and the suffixes of books.
PROTECTED = ["System Volume Information", "XTCache"]
BOOK_SUFFIX = [".epub", ".xtc", ".txt", ".md"]


def items(d: D) -> str:
    """A listing of files and folders of every kind, from the books."""
    end = "CASE doc_id % 7 WHEN 0 THEN '.EPUB' WHEN 1 THEN '.txt' WHEN 2 THEN '.Md' WHEN 3 THEN '.jpg' WHEN 4 THEN '' WHEN 5 THEN '.xtch' ELSE '.tXt' END"
    name = f"CASE WHEN doc_id % 31 = 0 THEN '{PROTECTED[0]}' WHEN doc_id % 37 = 0 THEN '{PROTECTED[1]}' WHEN doc_id % 17 = 0 THEN concat('.', source) ELSE concat(source, ' ', CAST(doc_id % 1000 AS STRING), {end}) END"
    return f"items AS (SELECT doc_id, concat('/', lang) AS folder, {name} AS name, doc_id % 7 = 4 AS is_dir, n_chars AS size FROM documents)"


def has_suffix(name: str, suffixes: list[str]) -> str:
    return "(" + " OR ".join(f"lower({name}) LIKE '%{s}'" for s in suffixes) + ")"


def hidden(name: str) -> str:
    return f"({name} LIKE '.%' OR {name} IN ('" + "', '".join(PROTECTED) + "'))"


@query
def folder_listing(d):
    """Folders and books of one level; hidden and protected names do not show."""
    return f"WITH {items(d)} SELECT doc_id, folder, name, is_dir FROM items WHERE NOT {hidden('name')} AND (is_dir OR {has_suffix('name', BOOK_SUFFIX)})"


@query
def protected_paths(d):
    """A path is protected if any part of it is hidden."""
    return f"WITH {items(d)}, paths AS (SELECT doc_id, concat(folder, '/', name, '/', CAST(doc_id AS STRING)) AS path FROM items) SELECT doc_id, path, {d.like('path', '(^|/)([.][^/]*|' + '|'.join(PROTECTED) + ')(/|$)')} AS protected FROM paths"


@ranked(("not_dir", "place"), ("sort_key", ""), ("name", ""), ("doc_id", ""))
def directories_first(d):
    """Folders first, then by natural order of the names."""
    return f"WITH {items(d)} SELECT doc_id, name, NOT is_dir AS not_dir, {d.natural_key('name')} AS sort_key FROM items"


@ranked(("low", "place"), ("p_partkey", ""))
def name_sort(d):
    return "SELECT p_partkey, lower(p_name) AS low FROM part"


@ranked(("other", "place"), ("lang", ""))
def english_first(d):
    """Languages with English first, then by tag."""
    return "SELECT lang, lang <> 'en' AS other, count(*) AS texts FROM documents GROUP BY lang"


@query
def listing_json(d):
    """A JSON object an entry; those of 512 bytes or more are skipped."""
    row = "to_json(named_struct('name', name, 'size', size, 'isDirectory', is_dir))" if d.spark else "CAST(json_object('name', name, 'size', size, 'isDirectory', is_dir) AS VARCHAR)"
    return f"WITH {items(d)}, j AS (SELECT doc_id, {row} AS entry FROM items) SELECT doc_id, entry FROM j WHERE {'octet_length' if d.spark else 'strlen'}(entry) < 512"


@query
def feed_truncated(d):
    """Entries of a feed with a flag where more than 50 stand in it; the entries past that do not show."""
    return "SELECT source, least(count(*), 50) AS shown, count(*) > 50 AS truncated FROM documents GROUP BY source"


@query
def feed_books_only(d):
    """Of the entries of feeds those that are books: they link an acquisition, the others lead on."""
    return "WITH e AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'NAVIGATION' ELSE 'BOOK' END AS kind FROM pages) SELECT page_id, url FROM e WHERE kind = 'BOOK'"


@query
def cache_folders(d):
    """Folders of book caches, and how many of them could be removed."""
    names = "SELECT doc_id, concat(CASE doc_id % 5 WHEN 0 THEN 'epub_' WHEN 1 THEN 'txt_' WHEN 2 THEN 'xtc_' WHEN 3 THEN 'fonts_' ELSE 'xepub_' END, CAST(doc_id AS STRING)) AS name, lang FROM documents"
    return f"SELECT lang, count(*) AS folders, CAST(sum(CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM ({names}) AS n WHERE {d.like('name', '^(epub|txt|xtc)_')} GROUP BY lang"


# --- tables of contents --------------------------------------------------------------------------


def entries(d: D, rows: str, key: str, opens: str, closes: str, label: str, target: str) -> str:
    """(key, pos, level, label, href, anchor) of each target of numbered marks (key, pos, mark)."""
    by = f"PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    step = f"CASE WHEN {d.like('mark', opens)} THEN 1 WHEN {d.like('mark', closes)} THEN -1 ELSE 0 END"
    said = f"CASE WHEN {d.like('mark', label)} THEN {d.rx('mark', '<[^>]*>?', '')} END"
    to = f"CASE WHEN {d.like('mark', target)} THEN {d.first('mark', target, 1)} END"
    return f"""SELECT {key}, CAST(pos AS BIGINT) AS pos, CAST(level AS BIGINT) AS level, label, {d.first('t', '^[^#]*')} AS href, {d.first('t', '#(.*)$', 1)} AS anchor FROM
    (SELECT {key}, pos, sum({step}) OVER ({by}) AS level, {last_known(d, said, by)} AS label, {to} AS t FROM ({rows}) AS m) AS n WHERE t IS NOT NULL"""


def nav_entries(d: D) -> str:
    """Links of lists, with the depth of the lists around them."""
    marks = d.every("html", r"(?is)<(?:ol|ul)\b|</(?:ol|ul)>|<a\b[^>]*>.*?</a>")
    return entries(d, numbered(d, "pages", "page_id", marks, "mark"), "page_id", "(?i)^<[ou]l", "(?i)^</[ou]l", "(?i)^<a", r'(?i)^<a\b[^>]*href="([^"]*)"')


def ncx_docs(d: D) -> str:
    """A navigation map a book: points, every second one within the one before."""
    point = "concat('<navPoint id=\"n', CAST(idx AS STRING), '\"><navLabel><text>Part ', CAST(href AS STRING), '</text></navLabel><content src=\"c', CAST(href AS STRING), '.xhtml#p', CAST(idx AS STRING), '\"/>', CASE WHEN idx % 2 = 0 THEN '</navPoint></navPoint>' ELSE '' END)"
    return f"ncx AS (SELECT book, concat('<navMap>', {listed(d, point, 'idx')}, '</navMap>') AS xml FROM spine GROUP BY book)"


def ncx_entries(d: D) -> str:
    marks = d.every("xml", r"<navPoint\b|</navPoint>|<text>[^<]*|<content\b[^>]*>")
    return entries(d, numbered(d, "ncx", "book", marks, "mark"), "book", "^<navPoint", "^</navPoint", "^<text", r'^<content\b[^>]*src="([^"]*)"')


@query
def nav_toc(d):
    return f"SELECT * FROM ({nav_entries(d)}) AS e WHERE level > 0"


@query
def ncx_toc(d):
    return f"WITH {spine(d)}, {ncx_docs(d)} {ncx_entries(d)}"


@query
def toc_source(d):
    """Entries of the navigation document; books that have none take those of the navigation map."""
    nav = "nav AS (SELECT book, CAST(toc_idx AS BIGINT) AS pos, CAST(href AS STRING) AS href FROM toc WHERE book % 3 <> 0)"
    return f"WITH {spine(d)}, {ncx_docs(d)}, {nav}, m AS ({ncx_entries(d)}) SELECT book, pos, href, 'nav' AS origin FROM nav UNION ALL SELECT book, pos, href, 'ncx' AS origin FROM m WHERE NOT EXISTS (SELECT 1 FROM nav WHERE nav.book = m.book)"


@query
def first_toc_of_spine(d):
    return f"WITH {spine(d)}, firsts AS (SELECT book, href, min(toc_idx) AS toc_idx FROM toc GROUP BY book, href) SELECT s.book, s.idx, f.toc_idx FROM spine s LEFT JOIN firsts f ON s.book = f.book AND s.href = f.href"


@query
def spine_zip_sizes(d):
    """Size of each spine item in its container by path; 0 where the container has no such entry."""
    return f"WITH {spine(d)}, zip AS (SELECT concat('OEBPS/c', CAST(p_partkey AS STRING), '.xhtml') AS name, p_size * 100 AS size FROM part WHERE p_partkey % 5 <> 0) SELECT s.book, s.idx, coalesce(z.size, 0) AS size FROM (SELECT book, idx, concat('OEBPS/c', CAST(href AS STRING), '.xhtml') AS path FROM spine) s LEFT JOIN zip z ON s.path = z.name"


# --- positions -----------------------------------------------------------------------------------


@query
def spine_at_size(d):
    """The first chapter whose cumulative size reaches a share of the book, else the last."""
    return f"""WITH {spine(d)}, c AS (SELECT book, idx, sum(size) OVER (PARTITION BY book ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(size) OVER (PARTITION BY book) AS total FROM spine)
    SELECT book, coalesce(min(CASE WHEN 100 * cum >= (book % 101) * total THEN idx END), max(idx)) AS idx FROM c GROUP BY book"""


@query
def href_to_spine(d):
    """The first chapter whose path or file name is that of the target, before its anchor; -1 without one."""
    links = "links AS (SELECT book, toc_idx, concat(CASE WHEN toc_idx % 2 = 0 THEN 'OEBPS/' ELSE 'text/' END, 'c', CAST(CASE WHEN toc_idx % 5 = 0 THEN href + 1 ELSE href END AS STRING), '.xhtml', CASE WHEN book % 2 = 0 THEN '#a' ELSE '' END) AS target FROM toc)"
    return f"""WITH {spine(d)}, {links}, files AS (SELECT book, concat('c', CAST(href AS STRING), '.xhtml') AS file, min(idx) AS idx FROM spine GROUP BY book, href)
    SELECT l.book, l.toc_idx, CAST(coalesce(f.idx - 1, -1) AS INT) AS spine FROM (SELECT book, toc_idx, {d.first(d.first('target', '^[^#]*'), '([^/]*)$', 1)} AS file FROM links) l LEFT JOIN files f ON l.book = f.book AND l.file = f.file"""


@query
def anchor_pages(d):
    """The page of an anchor: of anchors that repeat the first holds."""
    return f"""WITH {spine(d)}, anchors AS (SELECT book, concat('p', CAST(href % 50 AS STRING)) AS anchor, min(idx) AS page FROM spine GROUP BY book, href % 50)
    SELECT t.book, t.toc_idx, a.page FROM (SELECT book, toc_idx, concat('p', CAST(href % 60 AS STRING)) AS anchor FROM toc) t LEFT JOIN anchors a ON t.book = a.book AND t.anchor = a.anchor"""


@query
def text_reference(d):
    """The chapter where the text begins: that of the reference, else the first."""
    return f"WITH {spine(d)}, refs AS (SELECT book, max(href) AS href FROM spine WHERE book % 4 <> 0 GROUP BY book), found AS (SELECT s.book, min(s.idx) - 1 AS idx FROM spine s JOIN refs r ON s.book = r.book AND s.href = r.href GROUP BY s.book) SELECT b.book, CAST(coalesce(f.idx, 0) AS INT) AS start_at FROM (SELECT DISTINCT book FROM spine) b LEFT JOIN found f ON b.book = f.book"


@query
def saved_progress(d):
    """A position as it is saved: offset, else page, else share, else the start of the chapter."""
    return "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'offset' WHEN o_orderkey % 3 = 0 THEN 'page' WHEN o_totalprice > 200000 THEN 'share' ELSE 'chapter' END AS kind, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END, CASE WHEN o_totalprice > 200000 THEN o_orderkey % 100 END, 0) AS place FROM orders"


@query
def library_page(d):
    """The third page of twenty in title order: rows by rank, however far the page is."""
    return f"WITH {keyed(d)} SELECT doc_id, title_fold, path FROM (SELECT doc_id, title_fold, path FROM keyed ORDER BY title_fold, path LIMIT 60) AS t ORDER BY title_fold DESC, path DESC LIMIT 20"


# --- recents and reconciling ---------------------------------------------------------------------

RECENTS = "recents AS (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id)"


@query
def recent_identity(d):
    """Index rows of recent books, by the digest of the path; sizes are compared first."""
    return f"WITH {books(d)}, {RECENTS}, known AS (SELECT md5(path) AS h, file_size, doc_id FROM books), asked AS (SELECT r.user_id, md5(b.path) AS h, CASE WHEN r.user_id % 9 = 0 THEN b.file_size + 1 ELSE b.file_size END AS file_size FROM recents r JOIN books b ON r.user_id = b.doc_id) SELECT a.user_id, k.doc_id AS ordinal FROM asked a LEFT JOIN known k ON a.file_size = k.file_size AND a.h = k.h"


@query
def prune_recents(d):
    """Recent books whose file is there."""
    return f"WITH {books(d)}, {RECENTS} SELECT user_id, event_id FROM recents WHERE EXISTS (SELECT 1 FROM books WHERE books.doc_id = recents.user_id)"


def fresh_books(d: D) -> str:
    return f"WITH {books(d)}, prior AS (SELECT path, doc_id AS first_seen FROM books WHERE doc_id % 7 <> 0) SELECT b.path, (SELECT max(first_seen) FROM prior) AS last_given FROM books b LEFT JOIN prior p ON b.path = p.path WHERE p.path IS NULL"


def first_seen(spark, sf_dir):
    """New books get the numbers after the last one given, in path order."""
    return _run_ranked(fresh_books, [("path", "nth")])(spark, sf_dir).selectExpr("path", "last_given + nth AS first_seen")


FIRST_SEEN_SQL = f"SELECT path, last_given + nth AS first_seen FROM ({_ranked_sql(fresh_books, [('path', 'nth')])}) AS f"


@query
def no_recent_repeat(d):
    """Does an event's kind stand among the user's last three?"""
    last = " OR ".join(f"lag(event_type, {k}) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type" for k in (1, 2, 3))
    return f"SELECT event_id, coalesce({last}, false) AS repeated FROM events".replace("coalesce(", "coalesce((").replace(", false)", "), false)")


@query
def random_pick(d):
    """A picture a folder: the one that a hash draws among those not shown in the last ones."""
    return f"WITH {items(d)}, free AS (SELECT lang AS folder, doc_id FROM documents WHERE doc_id % 10 <> 3) SELECT folder, doc_id FROM (SELECT folder, doc_id, row_number() OVER (PARTITION BY folder ORDER BY md5(CAST(doc_id AS STRING)), doc_id) AS pick FROM free) AS t WHERE pick = 1"


@query
def saved_networks(d):
    """Networks by strength, those with saved credentials first and flagged."""
    return "WITH nets AS (SELECT event_type AS ssid, user_id, max(-(event_id % 60) - 35) AS rssi FROM events GROUP BY event_type, user_id), saved AS (SELECT DISTINCT event_type AS ssid, user_id FROM events WHERE event_id % 50 = 0) SELECT n.ssid, n.user_id, n.rssi, s.ssid IS NOT NULL AS saved, row_number() OVER (PARTITION BY n.user_id ORDER BY CASE WHEN s.ssid IS NULL THEN 1 ELSE 0 END, n.rssi DESC, n.ssid) AS place FROM nets n LEFT JOIN saved s ON n.ssid = s.ssid AND n.user_id = s.user_id"


# --- dictionaries and languages -------------------------------------------------------------------


@query
def synonym_hop(d):
    """A word that is no headword leads by its synonym's ordinal to a headword."""
    return f"WITH {dictionary(d)}, ordinals AS (SELECT headword, ordinal * 100000 + row_number() OVER (PARTITION BY ordinal ORDER BY headword) AS ordinal FROM dict), syn AS (SELECT concat(substr(headword, 1, length(headword) - 1), 'x') AS word, min(ordinal) AS ordinal FROM ordinals GROUP BY 1) SELECT a.w, o.headword FROM (SELECT DISTINCT concat(substr(w, 1, length(w) - 1), 'x') AS w FROM asked) a JOIN syn s ON a.w = s.word JOIN ordinals o ON s.ordinal = o.ordinal"


@query
def dictionary_roots(d):
    """Dictionaries of two roots; those of both show twice, and the first root's resolves."""
    roots = "SELECT n_name AS name, 1 AS root FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name AS name, 2 AS root FROM nation WHERE n_nationkey % 3 = 0"
    return f"SELECT name, root, root = min(root) OVER (PARTITION BY name) AS resolves FROM ({roots}) AS r"


# Language codes of three letters and the tags that patterns are known for.
ISO_639 = {"eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "rus": "ru", "spa": "es", "ita": "it", "ukr": "uk", "swe": "sv", "fin": "fi"}


@query
def hyphenator_language(d):
    """The language of a tag: its first part in lower case, three letters turned into two."""
    tag = "CASE doc_id % 6 WHEN 0 THEN 'ENG' WHEN 1 THEN concat(lang, '-XX') WHEN 2 THEN upper(lang) WHEN 3 THEN 'ger_DE' WHEN 4 THEN '' ELSE 'zz' END"
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ISO_639.items())
    return f"SELECT doc_id, tag, nullif(CASE p {known} ELSE p END, '') AS language FROM (SELECT doc_id, tag, lower({d.first('tag', '^[^_-]*')}) AS p FROM (SELECT doc_id, {tag} AS tag FROM documents) AS a) AS b"


@query
def translation_coverage(d):
    """Keys a language has itself, falls back for, and has without their being used; English first."""
    has = "SELECT DISTINCT l_suppkey % 7 AS lang, l_partkey % 50 AS k FROM lineitem WHERE l_quantity > 48"
    used = "SELECT DISTINCT l_partkey % 50 AS k FROM lineitem WHERE l_discount > 0.05 AND l_partkey % 50 <> 7"
    return f"WITH has AS ({has}), used AS ({used}) SELECT h.lang, CAST(sum(CASE WHEN u.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS own, (SELECT count(*) FROM used) - CAST(sum(CASE WHEN u.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS fallback, CAST(sum(CASE WHEN u.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unused, h.lang <> 0 AS other FROM has h LEFT JOIN used u ON h.k = u.k GROUP BY h.lang"


@query
def missing_keys(d):
    """Keys in use that no dictionary has."""
    return "SELECT DISTINCT l_partkey AS k FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_partkey % 3 <> 0)"


# --- glyphs --------------------------------------------------------------------------------------

# Intervals of code points with the first glyph of each, and the glyph of all others.
GLYPHS = "glyphs AS (SELECT * FROM (VALUES (32, 126, 0), (160, 255, 95), (256, 383, 191), (8211, 8230, 319)) AS v(lo, hi, base))"
FALLBACK_GLYPH = 339


def glyphed(d: D) -> str:
    code = "ascii(c)" if d.spark else "unicode(c)"
    chars = "split(text, '')" if d.spark else "string_split(text, '')"
    return f"{GLYPHS}, chars AS (SELECT doc_id, c, {code} AS cp FROM (SELECT DISTINCT doc_id, {d.explode(chars)} AS c FROM documents) AS t WHERE c <> ''), drawn AS (SELECT k.doc_id, k.c, k.cp, coalesce(g.base + k.cp - g.lo, {FALLBACK_GLYPH}) AS glyph FROM chars k LEFT JOIN glyphs g ON k.cp BETWEEN g.lo AND g.hi)"


@query
def glyph_lookup(d):
    return f"WITH {glyphed(d)} SELECT DISTINCT c, CAST(glyph AS INT) AS glyph FROM drawn"


@query
def glyph_groups(d):
    """Distinct groups of 16 glyphs that a text needs, and their bytes."""
    return f"WITH {glyphed(d)} SELECT doc_id, count(DISTINCT CAST(floor(glyph / 16) AS INT)) AS glyph_groups, CAST(sum(20 + glyph % 9) AS BIGINT) AS bytes FROM (SELECT DISTINCT doc_id, glyph FROM drawn) AS t GROUP BY doc_id"


@query
def kerning_pairs(d):
    """Neighbouring letters by their classes on the left and right; pairs without a cell have no kerning."""
    table = "cells AS (SELECT * FROM (VALUES (1, 2, -3), (2, 1, -2), (3, 3, 1), (1, 3, -1)) AS v(lc, rc, kern)), classes AS (SELECT * FROM (VALUES ('a', 1, 2), ('e', 2, 2), ('o', 3, 1), ('l', 1, 1), ('r', 2, 3), ('t', 3, 3)) AS w(ch, lc, rc))"
    chars = "split(p_name, '')" if d.spark else "string_split(p_name, '')"
    rows = numbered(d, "part", "p_partkey", chars, "ch")
    return f"WITH {table}, letters AS (SELECT * FROM ({rows}) AS x WHERE ch <> ''), pairs AS (SELECT p_partkey, ch AS l, lead(ch) OVER (PARTITION BY p_partkey ORDER BY pos) AS r FROM letters) SELECT p.p_partkey, CAST(sum(coalesce(k.kern, 0)) AS BIGINT) AS kerning FROM pairs p LEFT JOIN classes a ON p.l = a.ch LEFT JOIN classes b ON p.r = b.ch LEFT JOIN cells k ON a.lc = k.lc AND b.rc = k.rc GROUP BY p.p_partkey"


@query
def ligature_closure(d):
    """Characters of a text and the ligatures that both of their parts are there for, one pass in order."""
    chars = "split(text, '')" if d.spark else "string_split(text, '')"
    have = f"have AS (SELECT DISTINCT doc_id, {d.explode(chars)} AS c FROM documents WHERE text LIKE '%f%')"
    first = "one AS (SELECT a.doc_id, l.o AS c FROM have a JOIN ligs l ON a.c = l.x JOIN have b ON a.doc_id = b.doc_id AND b.c = l.y)"
    second = "two AS (SELECT a.doc_id, m.o AS c FROM one a JOIN ligs2 m ON a.c = m.x JOIN have b ON a.doc_id = b.doc_id AND b.c = m.y)"
    return f"WITH ligs AS (SELECT * FROM (VALUES ('f', 'i', 'ﬁ'), ('f', 'l', 'ﬂ'), ('f', 'f', 'ﬀ')) AS v(x, y, o)), ligs2 AS (SELECT * FROM (VALUES ('ﬀ', 'i', 'ﬃ'), ('ﬀ', 'l', 'ﬄ')) AS w(x, y, o)), {have}, {first}, {second} SELECT doc_id, c FROM one UNION SELECT doc_id, c FROM two"


# --- counters and estimates ------------------------------------------------------------------------


@query
def list_counters(d):
    """Numbers of paragraphs of a page, and of items of each list by its depth; a new list starts anew."""
    marks = d.every("html", r"(?i)<(?:p|li)\b|</?(?:ol|ul)\b")
    by = "PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""WITH m AS ({numbered(d, 'pages', 'page_id', marks, 'raw')}), n AS (SELECT page_id, pos, lower(raw) AS mark FROM m),
    depths AS (SELECT page_id, pos, mark, sum(CASE WHEN mark IN ('<ol', '<ul') THEN 1 WHEN mark IN ('</ol', '</ul') THEN -1 ELSE 0 END) OVER ({by}) AS depth FROM n),
    lists AS (SELECT *, sum(CASE WHEN mark IN ('<ol', '<ul') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, depth ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS list FROM depths)
    SELECT page_id, CAST(pos AS BIGINT) AS pos, mark, CAST(CASE WHEN mark = '<p' THEN sum(CASE WHEN mark = '<p' THEN 1 ELSE 0 END) OVER ({by}) ELSE sum(CASE WHEN mark = '<li' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, depth, list ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS BIGINT) AS nth FROM lists WHERE mark IN ('<p', '<li')"""


def builds(d: D) -> str:
    """A build a conversation: bytes taken and pages made after each turn, of a total."""
    by = "PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"builds AS (SELECT conv_id, turn, sum(length(text)) OVER ({by}) AS consumed, CAST(floor(sum(length(text)) OVER ({by}) / 40) AS BIGINT) + turn AS pages, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations)"


@query
def page_estimate(d):
    """Pages of the whole by the share that is done, between those there are and 60000."""
    whole = "CAST(pages AS BIGINT) * CAST(total AS BIGINT)"
    est = f"({whole} - {whole} % CAST(consumed AS BIGINT)) / CAST(consumed AS BIGINT)"
    return f"WITH {builds(d)} SELECT conv_id, turn, CASE WHEN consumed = 0 OR total <= consumed THEN CAST(pages AS BIGINT) ELSE greatest(CAST(pages AS BIGINT), least(60000, CAST({est} AS BIGINT))) END AS estimate FROM builds"


@query
def ema_pages(d):
    """The estimate smoothed by a quarter of each change, seeded by the first, stepped when bytes were taken."""
    raws = "raws AS (SELECT conv_id, turn, CAST(floor(CAST(pages AS DOUBLE) * total / consumed) AS DOUBLE) AS raw FROM builds WHERE consumed > 0 AND total > consumed)"
    if d.spark:
        fold = "aggregate(slice(l, 2, size(l)), l[0].raw, (a, z) -> a + 0.25D * (z.raw - a))"
        return f"WITH {builds(d)}, {raws}, g AS (SELECT conv_id, array_sort(collect_list(struct(turn, raw))) AS l FROM raws GROUP BY conv_id) SELECT conv_id, least(60000, CAST(floor({fold} + 0.5D) AS BIGINT)) AS pages FROM g"
    return f"WITH {builds(d)}, {raws}, g AS (SELECT conv_id, list(raw ORDER BY turn) AS l FROM raws GROUP BY conv_id) SELECT conv_id, least(60000, CAST(floor(list_reduce(l, lambda a, z: a + CAST(0.25 AS DOUBLE) * (z - a)) + 0.5) AS BIGINT)) AS pages FROM g"


@query
def merge_runs(d):
    """Two sorted runs as one, the first run's row of equal keys, at most 100 a group."""
    runs = "SELECT p_brand AS grp, p_partkey AS k, p_size AS v, 0 AS run FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_brand AS grp, p_partkey AS k, p_size + 1 AS v, 1 AS run FROM part WHERE p_partkey % 3 = 0"
    return f"WITH r AS ({runs}), one AS (SELECT grp, k, v, row_number() OVER (PARTITION BY grp, k ORDER BY run) AS pick FROM r), capped AS (SELECT grp, k, v, row_number() OVER (PARTITION BY grp ORDER BY k) AS place FROM one WHERE pick = 1) SELECT grp, k, v FROM capped WHERE place <= 100"


@query
def any_failed(d):
    """Has a customer any order that failed?"""
    return f"SELECT o_custkey, bool_or(o_orderstatus = 'F') AS failed FROM orders GROUP BY o_custkey"


@query
def line_start_offsets(d):
    """The least offset of each line of a table over its cells."""
    return "SELECT l_orderkey, l_linenumber, min(l_partkey) AS start_at FROM lineitem GROUP BY l_orderkey, l_linenumber"


@query
def break_offsets(d):
    """Sorted breaks without repeats; of equal ones that without an inserted hyphen stays."""
    return "SELECT l_orderkey AS word, l_partkey % 40 AS off, min(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 AS inserted FROM lineitem GROUP BY l_orderkey, l_partkey % 40"


@query
def partial_sections(d):
    """Sections with their state: whole, or partial with the bytes that were taken."""
    return f"WITH {spine(d)} SELECT book, count(*) AS chapters, CAST(sum(size) AS BIGINT) AS total_bytes, CAST(sum(CASE WHEN (book + idx) % 5 <> 0 THEN size ELSE 0 END) AS BIGINT) AS bytes_consumed, sum(CASE WHEN (book + idx) % 5 = 0 THEN 1 ELSE 0 END) > 0 AS is_partial FROM spine GROUP BY book"


@query
def capability_filter(d):
    """Settings that a device can show: those whose capability it has, or that need none."""
    return "WITH settings AS (SELECT p_partkey AS setting, CASE p_size % 4 WHEN 0 THEN 'clock' WHEN 1 THEN 'touch' WHEN 2 THEN 'light' END AS needs FROM part), devices AS (SELECT n_nationkey AS device, CASE n_nationkey % 3 WHEN 0 THEN 'clock' WHEN 1 THEN 'touch' ELSE 'light' END AS has FROM nation) SELECT d.device, count(*) AS settings FROM settings s JOIN devices d ON s.needs = d.has GROUP BY d.device UNION ALL SELECT -1 AS device, count(*) AS settings FROM settings WHERE needs IS NULL"


@query
def header_validity(d):
    """The first fault of an index header: magic, version, count, flag, size, sections; then an old fold."""
    made = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'CLIY' ELSE 'CLIX' END AS magic, 1 + CAST(o_orderkey % 17 = 0 AS INT) AS version, o_custkey AS books, CAST(o_orderkey % 3 AS INT) AS flag, o_custkey * 10 + CAST(o_orderkey % 5 = 0 AS INT) AS size, o_custkey * 10 AS told, o_orderkey % 200 AS folders, o_orderkey % 2 + 1 AS fold FROM orders"
    return f"SELECT k, CASE WHEN magic <> 'CLIX' THEN 'bad_magic' WHEN version <> 1 THEN 'unknown_version' WHEN books > 4096 THEN 'count_out_of_range' WHEN flag > 1 THEN 'sections_inconsistent' WHEN size <> told THEN 'size_mismatch' WHEN folders > size THEN 'sections_inconsistent' WHEN fold <> 2 THEN 'stale_fold' ELSE 'ok' END AS validity FROM ({made}) AS h"


QUERIES = {"first_seen": (first_seen, FIRST_SEEN_SQL)} | {n: (_run_ranked(f, o), _ranked_sql(f, o)) for n, (f, o) in RANKED.items()} | {n: (_run(f), f(DUCK)) for n, f in STATEMENTS.items()}
