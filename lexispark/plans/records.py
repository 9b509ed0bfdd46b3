"""Queries over positions, links, styles, names and manifests, each with the SQL that checks it."""

from __future__ import annotations

from .catalog import Dialect, books, _run
from ..functions.dialect import DUCK

D = Dialect
STATEMENTS = {}


def query(f):
    STATEMENTS[f.__name__] = f
    return f


PRIOR = "prior AS (SELECT CASE WHEN doc_id % 11 = 0 THEN concat('/moved', path) ELSE path END AS path, file_size, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE mtime END AS mtime, title FROM books WHERE doc_id % 7 <> 0)"


def span(d: D, lo: str, hi: str, width: int) -> str:
    """The bins of ``width`` that a range meets, a row each."""
    made = "sequence" if d.spark else "generate_series"
    return d.explode(f"{made}(CAST(floor(({lo}) / {width}.0) AS INT), CAST(floor(({hi}) / {width}.0) AS INT))")


@query
def library_noop_check(d):
    """How many rows of two snapshots differ; none means that nothing is written."""
    sides = "SELECT path, file_size, mtime, 1 AS side FROM books UNION ALL SELECT path, file_size, mtime, -1 AS side FROM prior"
    return f"WITH {books(d)}, {PRIOR}, u AS (SELECT path, file_size, mtime, sum(side) AS s FROM ({sides}) AS x GROUP BY path, file_size, mtime) SELECT count(*) AS differing, count(*) = 0 AS unchanged FROM u WHERE s <> 0"


@query
def metadata_reuse(d):
    """Metadata of the prior snapshot holds where path, size and a known time are the same."""
    return f"WITH {books(d)}, {PRIOR} SELECT b.path, b.file_size, CASE WHEN p.path IS NULL THEN 'read' ELSE 'reused' END AS metadata, coalesce(p.title, b.title) AS title FROM books b LEFT JOIN prior p ON b.path = p.path AND b.file_size = p.file_size AND b.mtime = p.mtime AND p.mtime <> 0"


@query
def link_hit_test(d):
    """First link box that holds a touch, widened on all sides by the slop and at least to a width; right and
    bottom edges are outside. Boxes of a page are cut into bins of x; pages grow with the links."""
    boxes = """boxes AS (SELECT p_partkey AS link, CAST(floor(p_partkey / 40) AS BIGINT) AS page, p_partkey % 40 * 20 - wide AS lo, p_partkey % 40 * 20 + p_size + wide AS hi, p_size * 10 - 6 AS top, p_size * 10 + 12 + 6 AS bottom
    FROM (SELECT *, greatest(6, CAST(floor(greatest(24 - p_size, 0) / 2) AS INT)) AS wide FROM part) AS p)"""
    return f"""WITH {boxes}, binned AS (SELECT link, page, lo, hi, top, bottom, {span(d, 'lo', 'hi', 64)} AS bin FROM boxes),
    touches AS (SELECT event_id, event_id % (SELECT max(page) + 1 FROM boxes) AS page, event_id * 7 % 800 AS x, event_id * 13 % 520 AS y FROM events)
    SELECT t.event_id, min(b.link) AS link FROM touches t JOIN binned b ON t.page = b.page AND CAST(floor(t.x / 64.0) AS INT) = b.bin AND t.x >= b.lo AND t.x < b.hi AND t.y >= b.top AND t.y < b.bottom GROUP BY t.event_id"""


@query
def bookmark_overlap(d):
    """A bookmark is on a page if chapter, page count and page are the same, or if its share of the book is within
    half a page step of the page's (a thousandth of tolerance). Every event is a bookmark and a page shown."""
    pages = "5 + user_id % 40"
    rows = f"SELECT event_id, user_id AS book, event_id % 5 AS spine, {pages} AS pages, event_id % ({pages}) AS page, event_id * 37 % 10000 AS pct FROM events"
    # In ten-thousandths of a book of five chapters: a page's place, and half a step.
    at, half = "spine * 2000 + CAST(floor(2000 * page / (pages - 1)) AS BIGINT)", "CAST(floor(1000 / (pages - 1)) AS BIGINT)"
    return f"""WITH r AS ({rows}), shown AS (SELECT *, greatest(spine * 2000, {at} - {half}) - 10 AS lo, least((spine + 1) * 2000, {at} + {half}) + 10 AS hi FROM r),
    near AS (SELECT event_id, book, lo, hi, {span(d, 'lo', 'hi', 200)} AS bin FROM shown)
    SELECT s.event_id AS shown_id, m.event_id AS mark_id FROM shown s JOIN r m ON s.book = m.book AND s.spine = m.spine AND s.pages = m.pages AND s.page = m.page
    UNION SELECT s.event_id AS shown_id, m.event_id AS mark_id FROM near s JOIN r m ON s.book = m.book AND CAST(floor(m.pct / 200.0) AS INT) = s.bin AND m.pct BETWEEN s.lo AND s.hi"""


RULES = "rules AS (SELECT * FROM (VALUES ('p', 'indent', '1em', 1), ('div', 'margin', '0', 2), ('.content', 'margin', '2em', 3), ('div.content', 'align', 'left', 4), ('.sidebar', 'align', 'right', 5), ('div.sidebar', 'margin', '1em', 6), ('.ad', 'margin', '9px', 7), ('.comment', 'indent', '0', 8), ('div', 'align', 'justify', 9)) AS v(selector, prop, val, pos))"


@query
def css_cascade(d):
    """Each property from the most specific rule: tag, then class (the later one), then tag with class."""
    tag, names = d.first("el", "^<([a-z0-9]+)", 1), d.words(d.first("el", 'class="([^"]*)"', 1))
    return f"""WITH {RULES}, els AS (SELECT DISTINCT {d.explode(d.every('html', '<[a-z0-9]+ class="[^"]*"'))} AS el FROM pages),
    parts AS (SELECT el, {tag} AS tag, {names} AS names FROM els), singles AS (SELECT el, tag, names, {d.explode('names')} AS c FROM parts),
    cands AS (SELECT el, tag AS selector, 0 AS prec FROM parts UNION ALL SELECT el, concat('.', c) AS selector, 1000 + array_position(names, c) AS prec FROM singles UNION ALL SELECT el, concat(tag, '.', c) AS selector, 2000 + array_position(names, c) AS prec FROM singles),
    hits AS (SELECT c.el, r.prop, r.val, row_number() OVER (PARTITION BY c.el, r.prop ORDER BY c.prec DESC, r.pos DESC) AS pick FROM cands c JOIN rules r ON c.selector = r.selector)
    SELECT el, prop, val FROM hits WHERE pick = 1"""


@query
def sibling_index(d):
    """Ordinal of each opened tag among those of its name in a page."""
    tags = d.every("html", "<([a-z][a-z0-9]*)", 1)
    rows = f"SELECT page_id, pos, tag FROM pages LATERAL VIEW posexplode({tags}) x AS pos, tag" if d.spark else f"SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS tag FROM (SELECT page_id, {tags} AS l FROM pages) AS t"
    return f"SELECT page_id, CAST(pos AS INT) AS pos, tag, CAST(row_number() OVER (PARTITION BY page_id, tag ORDER BY pos) AS INT) AS nth FROM ({rows}) AS y"


def normalised(d: D, path: str) -> str:
    """Resolves ``..`` and drops empty parts and the leading slash; a single dot stays."""
    step = "CASE WHEN x = '' THEN acc WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE concat(acc, '/', x) END"
    fold = f"aggregate(split({path}, '/'), '', (acc, x) -> {step})" if d.spark else f"list_reduce(string_split({path}, '/'), lambda acc, x: {step}, '')"
    return f"ltrim({fold}, '/')" if not d.spark else f"ltrim('/', {fold})"


@query
def path_normalise(d):
    raw = "concat('/../', lang, '/', CASE WHEN doc_id % 2 = 0 THEN '../' ELSE './' END, source, '//', CAST(doc_id AS STRING), CASE WHEN doc_id % 3 = 0 THEN '/../..' ELSE '' END)"
    return f"SELECT doc_id, {normalised(d, raw)} AS path FROM documents"


@query
def release_asset_pick(d):
    """The last asset of a name wins."""
    made = """concat('{"tag_name":"v', CAST(user_id AS STRING), '","assets":[{"name":"fw.bin","size":', CAST(event_id AS STRING), '},{"name":"x.bin","size":2}', CASE WHEN event_id % 2 = 0 THEN ',{"name":"fw.bin","size":7}' ELSE '' END, ']}')"""
    if d.spark:
        got = "element_at(filter(j.assets, a -> a.name = 'fw.bin'), -1).size"
        return f"SELECT event_id, j.tag_name AS tag, {got} AS size FROM (SELECT event_id, from_json({made}, 'tag_name string, assets array<struct<name:string,size:bigint>>') AS j FROM events) AS t"
    return f"SELECT event_id, json_extract_string(j, '$.tag_name') AS tag, list_filter(CAST(json_extract(j, '$.assets') AS STRUCT(name VARCHAR, size BIGINT)[]), lambda a: a.name = 'fw.bin')[-1].size AS size FROM (SELECT event_id, {made} AS j FROM events) AS t"


@query
def manifest_nested(d):
    """Distinct sizes and files of each family, in order."""
    sizes = "array_join(array_sort(collect_set(p_size)), ',')" if d.spark else "array_to_string(list_sort(list(DISTINCT p_size)), ',')"
    return f"SELECT p_brand, count(*) AS files, {sizes} AS sizes FROM part GROUP BY p_brand"


@query
def library_display(d):
    """Title, else file name; 'Last, First' heading; an author named unknown is none."""
    author = f"nullif({d.fold('clean')}, 'unknown')"
    heading = d.rx(author, "^(.*) ([^ ]+)$", "$2, $1" if d.spark else r"\2, \1")
    return f"WITH {books(d)}, cleaned AS (SELECT *, {d.clean_name('source_author')} AS clean FROM books) SELECT doc_id, coalesce(nullif(trim(title), ''), {d.first('path', '([^/]*)$', 1)}) AS shown, {heading} AS heading FROM cleaned"


@query
def size_label(d):
    return "SELECT doc_id, CASE WHEN n_chars < 1024 THEN concat(CAST(n_chars AS STRING), ' B') WHEN n_chars < 1048576 THEN concat(CAST(CAST(floor(n_chars / 1024.0) AS INT) AS STRING), ' KB') ELSE concat(CAST(CAST(floor(n_chars / 1048576.0) AS INT) AS STRING), ' MB') END AS label FROM documents"


@query
def unique_destination(d):
    """Later files of a name get a number."""
    return "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, concat(CAST(l_linenumber AS STRING), CASE WHEN k = 1 THEN '' ELSE concat(' (', CAST(k - 1 AS STRING), ')') END, '.epub') AS name FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem) AS t"


@query
def log_line_class(d):
    """The first keyword that a line holds names its class."""
    return "SELECT event_id, CASE WHEN line LIKE '%error%' THEN 'error' WHEN line LIKE '%purchase%' OR line LIKE '%buy%' THEN 'sale' WHEN line LIKE '%view%' THEN 'view' ELSE 'other' END AS class FROM (SELECT event_id, lower(concat(event_type, ' ', props)) AS line FROM events) AS t"


@query
def translation_keys_used(d):
    """Names in capitals that texts mention, with the texts that do."""
    return f"SELECT k, count(*) AS n FROM (SELECT DISTINCT doc_id, {d.explode(d.every('text', '[A-Z][A-Z0-9_]{3,}'))} AS k FROM documents) AS t GROUP BY k"


QUERIES = {n: (_run(f), f(DUCK)) for n, f in STATEMENTS.items()}
