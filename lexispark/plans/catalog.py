"""The queries over the catalogue, each with the SQL that checks it.

A query is a function of a dialect giving one statement; Spark runs it over the tables of a
folder. ``RANKED`` queries get their global ranks from ``global_rank`` in Spark instead of a
window over all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import DUCK, SPARK, Dialect
from ..operators.ranking import global_rank

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
D = Dialect
STATEMENTS: dict[str, Callable[[D], str]] = {}
RANKED: dict[str, tuple[Callable[[D], str], list[tuple[str, str]]]] = {}


def books(d: D) -> str:
    """The library derived from ``documents``; authors have spelling variants, some books have none."""
    name = "CASE WHEN k.doc_id % 29 = 0 THEN 'Unknown' WHEN k.doc_id % 3 = 0 THEN concat('Nr, ', c.c_name) WHEN k.doc_id % 3 = 1 THEN concat(c.c_name, ' Nr') ELSE concat(c.c_name, ' [ed.] NR') END"
    return f"""books AS (SELECT k.doc_id, concat('/', lang, '/', source, '/', CAST(k.doc_id AS STRING), '.txt') AS path, concat('/', lang, '/', source) AS folder,
    n_chars AS file_size, k.doc_id % 97 AS mtime, {d.first('text', '^[^\\n]*')} AS title, {name} AS source_author
    FROM (SELECT *, CAST(floor(doc_id / 8) AS BIGINT) % (SELECT count(*) FROM customer) + 1 AS author_nr FROM documents) k JOIN customer c ON c.c_custkey = k.author_nr)"""


def keyed(d: D) -> str:
    return f"""{books(d)}, cleaned AS (SELECT *, {d.clean_name('source_author')} AS clean FROM books), folded AS (SELECT *, {d.fold('title', True)} AS title_fold, {d.fold('clean')} AS clean_fold FROM cleaned),
    tokens AS (SELECT *, {d.author_tokens('clean_fold')} AS identity FROM folded), keyed AS (SELECT *, CASE WHEN clean_fold = 'unknown' THEN '' ELSE {d.author_key('identity')} END AS author_fold FROM tokens)"""


def voted(d: D) -> str:
    """The commonest spelling of each author; of equally common ones the shorter, then the first."""
    return f"""{keyed(d)}, spellings AS (SELECT author_fold, clean, count(*) AS n FROM keyed WHERE author_fold <> '' GROUP BY author_fold, clean),
    votes AS (SELECT author_fold, clean AS author, n, row_number() OVER (PARTITION BY author_fold ORDER BY n DESC, {d.bytes_of('clean')}, clean) AS pick FROM spellings),
    canon AS (SELECT author_fold, author FROM votes WHERE pick = 1)"""


def ranked(name: str, order: list[tuple[str, str]]):
    def keep(f):
        RANKED[name] = (f, order)
        return f

    return keep


def query(f):
    STATEMENTS[f.__name__] = f
    return f


ranked("library_title_order", [("title_fold", "title_rank"), ("path", "")])(lambda d: f"WITH {keyed(d)} SELECT doc_id, path, title_fold FROM keyed")
ranked("library_author_order", [("nameless", "author_rank"), ("surname", ""), ("title_fold", ""), ("path", "")])(lambda d: f"WITH {voted(d)}, shown AS (SELECT k.doc_id, k.path, k.title_fold, {d.fold('c.author')} AS name FROM keyed k LEFT JOIN canon c ON k.author_fold = c.author_fold) SELECT doc_id, path, title_fold, name IS NULL AS nameless, coalesce({d.surname_key('name')}, '') AS surname FROM shown")
ranked("library_arrival_order", [("mtime", "arrival_rank"), ("title_fold", ""), ("path", "")])(lambda d: f"WITH {keyed(d)} SELECT doc_id, path, mtime, title_fold FROM keyed")


@query
def library_canonical_author(d):
    return f"WITH {voted(d)} SELECT author_fold, author FROM canon"


def matches(d: D, hay: str, needle: str) -> str:
    """Every word of the query is a prefix of a word of the text."""
    tests = [d.like(hay, f"(^|[ \\x27]){w}") for w in needle.split()]
    return "(" + " AND ".join(tests) + ")"


@query
def library_search_prefix(d):
    return f"WITH {keyed(d)} SELECT doc_id, path, title_fold FROM keyed WHERE {matches(d, 'title_fold', 'th er')} OR {matches(d, 'clean_fold', 'cust nr')}"


@query
def library_group_counts(d):
    return f"WITH {keyed(d)}, g AS (SELECT {d.initial('title_fold')} AS initial, title_fold FROM keyed) SELECT initial, count(*) AS n, min(title_fold) AS first_title FROM g GROUP BY initial"


@query
def library_page_desc(d):
    return f"WITH {keyed(d)} SELECT doc_id, title_fold, path FROM keyed ORDER BY title_fold DESC, path DESC LIMIT 20"


@query
def library_reconcile(d):
    prior = "prior AS (SELECT CASE WHEN doc_id % 11 = 0 THEN concat('/moved', path) ELSE path END AS path, file_size, doc_id AS first_seen FROM books WHERE doc_id % 7 <> 0)"
    return f"""WITH {books(d)}, {prior},
    kept AS (SELECT b.path, 'unchanged' AS status, p.first_seen FROM books b JOIN prior p ON b.path = p.path),
    fresh AS (SELECT b.path, b.file_size, row_number() OVER (PARTITION BY b.file_size ORDER BY b.path) AS k FROM books b LEFT JOIN prior p ON b.path = p.path WHERE p.path IS NULL),
    gone AS (SELECT p.path, p.file_size, p.first_seen, row_number() OVER (PARTITION BY p.file_size ORDER BY p.first_seen) AS k FROM prior p LEFT JOIN books b ON b.path = p.path WHERE b.path IS NULL)
    SELECT path, status, first_seen FROM kept
    UNION ALL SELECT coalesce(f.path, g.path) AS path, CASE WHEN f.path IS NULL THEN 'removed' WHEN g.path IS NULL THEN 'added' ELSE 'renamed' END AS status, g.first_seen FROM fresh f FULL OUTER JOIN gone g ON f.file_size = g.file_size AND f.k = g.k"""


@query
def library_build_stats(d):
    return f"SELECT status, count(*) AS n FROM ({library_reconcile(d)}) AS r GROUP BY status"


@query
def library_pinned_overlay(d):
    return f"WITH {books(d)}, pinned AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) SELECT b.doc_id, b.path, CASE WHEN p.doc_id IS NULL THEN 1 ELSE 0 END AS section FROM books b LEFT JOIN pinned p ON b.doc_id = p.doc_id"


@query
def directory_entry_dedup(d):
    return f"WITH {books(d)} SELECT folder, file_size, min(path) AS path, count(*) AS n FROM books GROUP BY folder, file_size"


def spine(d: D) -> str:
    return "spine AS (SELECT l_orderkey AS book, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx, l_partkey AS href, CAST(l_quantity AS BIGINT) AS size FROM lineitem), toc AS (SELECT book, idx AS toc_idx, href FROM spine WHERE idx % 3 = 2)"


@query
def spine_manifest_join(d):
    return f"WITH {spine(d)} SELECT s.book, s.idx, p.p_name AS href_name FROM spine s JOIN (SELECT * FROM part WHERE p_partkey % 5 <> 0) p ON s.href = p.p_partkey"


@query
def toc_left_join_first(d):
    return f"WITH {spine(d)}, firsts AS (SELECT book, href, min(idx) AS spine_idx FROM spine WHERE idx % 2 = 0 GROUP BY book, href) SELECT t.book, t.toc_idx, f.spine_idx FROM toc t LEFT JOIN firsts f ON t.book = f.book AND t.href = f.href"


@query
def spine_cumulative_size(d):
    return f"WITH {spine(d)} SELECT book, idx, CAST(sum(coalesce(size, 0)) OVER (PARTITION BY book ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_size FROM spine"


@query
def toc_forward_fill(d):
    return f"WITH {spine(d)} SELECT s.book, s.idx, last_value(t.toc_idx) IGNORE NULLS OVER (PARTITION BY s.book ORDER BY s.idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS toc_idx FROM spine s LEFT JOIN toc t ON s.book = t.book AND s.idx = t.toc_idx".replace("last_value(t.toc_idx) IGNORE NULLS", "last_value(t.toc_idx) IGNORE NULLS" if d.spark else "last_value(t.toc_idx IGNORE NULLS)")


@query
def book_progress(d):
    """A quarter into each chapter; whole numbers up to the one quotient, so both engines give the same double."""
    return f"WITH {spine(d)}, c AS (SELECT book, idx, size, sum(size) OVER (PARTITION BY book ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(size) OVER (PARTITION BY book) AS total FROM spine) SELECT book, idx, CAST(4 * (cum - size) + size AS DOUBLE) / CAST(4 * total AS DOUBLE) AS progress FROM c"


def page_table(d: D) -> str:
    return "turns AS (SELECT conv_id, turn, length(text) AS len FROM conversations), page_starts AS (SELECT conv_id, turn AS page, coalesce(sum(len) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM turns), probes AS (SELECT conv_id, turn AS probe, turn * 137 % 900 AS off FROM conversations)"


@query
def page_asof_backward(d):
    last = "last_value(page) IGNORE NULLS" if d.spark else "last_value(page IGNORE NULLS)"
    return f"""WITH {page_table(d)}, both_rows AS (SELECT conv_id, CAST(start_at AS BIGINT) AS pos, 0 AS kind, page, CAST(NULL AS BIGINT) AS probe FROM page_starts UNION ALL SELECT conv_id, off AS pos, 1 AS kind, CAST(NULL AS BIGINT) AS page, probe FROM probes),
    filled AS (SELECT conv_id, probe, kind, pos, {last} OVER (PARTITION BY conv_id ORDER BY pos, kind, page, probe ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM both_rows) SELECT conv_id, probe, pos AS off, page FROM filled WHERE kind = 1"""


@query
def page_asof_forward_clamped(d):
    return f"WITH {page_table(d)} SELECT p.conv_id, p.probe, coalesce(min(CASE WHEN s.start_at >= p.off THEN s.page END), max(s.page)) AS page FROM probes p JOIN page_starts s ON p.conv_id = s.conv_id GROUP BY p.conv_id, p.probe"


@query
def chapter_range_join(d):
    """Disjoint ranges cut into bins of 100, so the range join is an equi-join on the bin."""
    return f"""WITH chapters AS (SELECT n_nationkey AS idx, n_nationkey * 150 AS lo, n_nationkey * 150 + 119 AS hi FROM nation),
    binned AS (SELECT idx, lo, hi, {d.explode('sequence(CAST(floor(lo / 100) AS INT), CAST(floor(hi / 100) AS INT))' if d.spark else 'generate_series(CAST(floor(lo / 100) AS INT), CAST(floor(hi / 100) AS INT))')} AS bin FROM chapters),
    hits AS (SELECT event_id, min(idx) AS idx FROM (SELECT event_id, event_id % 4000 AS page FROM events) e JOIN binned b ON CAST(floor(e.page / 100) AS INT) = b.bin AND e.page BETWEEN b.lo AND b.hi GROUP BY event_id)
    SELECT e.event_id, CAST(coalesce(h.idx, 0) AS INT) AS chapter FROM events e LEFT JOIN hits h ON e.event_id = h.event_id"""


def compared(a: str, b: str) -> str:
    """Which of two positions (spine, page, off, pct; null where unknown) is ahead: by chapter, equal page, offset, page, share."""
    ordered = lambda x: f"CASE WHEN {a}.{x} > {b}.{x} THEN 'local_ahead' WHEN {a}.{x} < {b}.{x} THEN 'remote_ahead' ELSE 'synced' END"
    both = lambda x: f"{a}.{x} IS NOT NULL AND {b}.{x} IS NOT NULL"
    # Shares are single precision, as is their difference.
    gap = f"(CAST({a}.pct AS FLOAT) - CAST({b}.pct AS FLOAT))"
    share = f"CASE WHEN {both('pct')} THEN CASE WHEN abs({gap}) <= CAST(0.001 AS FLOAT) THEN 'synced' WHEN {gap} > 0 THEN 'local_ahead' ELSE 'remote_ahead' END ELSE 'unknown' END"
    return f"CASE WHEN {both('spine')} AND {a}.spine <> {b}.spine THEN {ordered('spine')} WHEN {both('spine')} AND {both('page')} AND {a}.page = {b}.page THEN 'synced' WHEN {both('spine')} AND {both('off')} THEN {ordered('off')} WHEN {both('spine')} AND {both('page')} THEN {ordered('page')} ELSE {share} END"


def positions(key: str, salt: int) -> str:
    """Positions made from orders, with gaps."""
    k = f"({key} + {salt})"
    return f"SELECT o_orderkey AS k, CASE WHEN {k} % 4 <> 0 THEN {k} % 5 END AS spine, CASE WHEN {k} % 6 <> 1 THEN {k} % 7 END AS page, CASE WHEN {k} % 3 = 0 THEN {k} % 50 END AS off, CASE WHEN {k} % 11 <> 2 THEN {k} % 1000 / 1000.0 END AS pct FROM orders"


@query
def progress_compare(d):
    return f"SELECT a.k, {compared('a', 'b')} AS verdict FROM ({positions('o_orderkey', 0)}) AS a JOIN ({positions('o_custkey', 1)}) AS b ON a.k = b.k"


@query
def select_remote_record(d):
    """The alternate record only if it is strictly ahead of the primary."""
    return f"SELECT a.k, CASE WHEN {compared('a', 'b')} = 'remote_ahead' THEN 'alternate' ELSE 'primary' END AS choice FROM ({positions('o_custkey', 3)}) AS a JOIN ({positions('o_orderkey', 2)}) AS b ON a.k = b.k"


def dictionary(d: D) -> str:
    return f"dict AS (SELECT headword, min(item_id) AS ordinal FROM (SELECT item_id, {d.explode(d.words(d.fold('text')))} AS headword FROM benchmark) AS x WHERE length(headword) >= 3 GROUP BY headword), asked AS (SELECT DISTINCT w FROM (SELECT {d.explode(d.words(d.fold('text')))} AS w FROM documents) AS y WHERE length(w) >= 3)"


@query
def dictionary_exact(d):
    return f"WITH {dictionary(d)} SELECT a.w, x.ordinal FROM asked a JOIN dict x ON lower(a.w) = lower(x.headword)"


@query
def dictionary_fallback_chain(d):
    stems = "SELECT w, w AS cand, 0 AS prio FROM asked UNION ALL SELECT w, concat(substr(w, 1, length(w) - 3), 'y') AS cand, 1 AS prio FROM asked WHERE w LIKE '%ies' UNION ALL SELECT w, substr(w, 1, length(w) - 2) AS cand, 2 AS prio FROM asked WHERE w LIKE '%es' OR w LIKE '%ed' UNION ALL SELECT w, substr(w, 1, length(w) - 1) AS cand, 3 AS prio FROM asked WHERE w LIKE '%s' UNION ALL SELECT w, substr(w, 1, length(w) - 3) AS cand, 4 AS prio FROM asked WHERE w LIKE '%ing'"
    return f"WITH {dictionary(d)}, cands AS ({stems}), found AS (SELECT c.w, x.headword, x.ordinal, row_number() OVER (PARTITION BY c.w ORDER BY c.prio, x.headword) AS pick FROM cands c JOIN dict x ON c.cand = x.headword) SELECT w, headword, ordinal FROM found WHERE pick = 1"


@query
def translation_fallback(d):
    return "WITH tr AS (SELECT n_regionkey AS lang, n_nationkey % 5 AS k, max(n_name) AS v FROM nation GROUP BY n_regionkey, n_nationkey % 5), grid AS (SELECT r.r_regionkey AS lang, ks.k FROM region r CROSS JOIN (SELECT DISTINCT n_nationkey % 5 AS k FROM nation) ks) SELECT g.lang, g.k, coalesce(t.v, e.v) AS v, t.v IS NULL AS inherited FROM grid g LEFT JOIN tr t ON g.lang = t.lang AND g.k = t.k LEFT JOIN (SELECT k, v FROM tr WHERE lang = 0) e ON g.k = e.k"


@query
def uniqueness_violations(d):
    return "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"


@query
def unused_keys(d):
    return "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)"


@query
def family_group_counts(d):
    return f"SELECT tag, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total_size, CAST(sum(CASE WHEN p_partkey % 4 = 0 THEN p_size ELSE 0 END) AS BIGINT) AS missing_size FROM (SELECT p_partkey, p_size, {d.explode(d.words('p_type'))} AS tag FROM part) AS t GROUP BY tag"


@query
def update_detection(d):
    return "WITH disk AS (SELECT l_partkey AS k, CAST(max(l_quantity) AS INT) AS size FROM lineitem GROUP BY l_partkey) SELECT p_brand, count(*) AS files, count(k) AS installed, CAST(sum(CASE WHEN k IS NULL OR size <> p_size THEN 1 ELSE 0 END) AS BIGINT) AS stale FROM part LEFT JOIN disk ON p_partkey = k GROUP BY p_brand"


@query
def nearest_size(d):
    return "SELECT p_brand, p_partkey, p_size FROM (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_size - 17), p_size, p_partkey) AS pick FROM part) AS t WHERE pick = 1"


@query
def strongest_signal(d):
    return "WITH s AS (SELECT user_id, event_type, CAST(-(event_id % 60) - 35 AS INT) AS rssi, event_id FROM events), b AS (SELECT user_id, rssi, event_type, row_number() OVER (PARTITION BY user_id ORDER BY rssi DESC, event_id) AS pick FROM s) SELECT user_id, rssi, event_type, CASE WHEN rssi >= -50 THEN 4 WHEN rssi >= -60 THEN 3 WHEN rssi >= -70 THEN 2 ELSE 1 END AS bars FROM b WHERE pick = 1"


@query
def natural_sort_key(d):
    return f"SELECT p_partkey, {d.natural_key('p_name')} AS sort_key FROM part"


@query
def next_books_topk(d):
    return "SELECT p_partkey, p_name FROM part WHERE p_name > 'm' ORDER BY p_name, p_partkey LIMIT 10"


@query
def recent_mru_top10(d):
    return "SELECT user_id, ts FROM (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id) AS t ORDER BY ts DESC, user_id LIMIT 10"


@query
def distinct_charset(d):
    chars = "split(text, '')" if d.spark else "string_split(text, '')"
    return f"SELECT DISTINCT lang, c FROM (SELECT lang, {d.explode(chars)} AS c FROM documents) AS t WHERE c <> ''"


@query
def word_frequency_top(d):
    return f"SELECT w, count(*) AS n FROM (SELECT {d.explode(d.every('text', chr(92) + 'p{L}+'))} AS w FROM documents) AS t WHERE length(w) >= 6 GROUP BY w ORDER BY n DESC, lower(w), w LIMIT 5000"


@query
def interval_merge(d):
    return "WITH r AS (SELECT l_suppkey AS k, CAST(l_partkey * 3 AS BIGINT) AS lo, CAST(l_partkey * 3 + l_quantity AS BIGINT) AS hi, l_orderkey AS o FROM lineitem), f AS (SELECT k, lo, hi, o, CASE WHEN lo <= max(hi) OVER (PARTITION BY k ORDER BY lo, hi, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM r), g AS (SELECT k, lo, hi, sum(fresh) OVER (PARTITION BY k ORDER BY lo, hi, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isle FROM f) SELECT k, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY k, isle"


@query
def delta_skip_failed(d):
    last = "last_value(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END) IGNORE NULLS" if d.spark else "last_value(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END IGNORE NULLS)"
    return f"SELECT o_custkey, o_orderkey, round(o_totalprice - {last} OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2) AS delta FROM orders"


@query
def rolling_last_n(d):
    return "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS peak FROM events"


@query
def group_start_flags(d):
    return "SELECT event_id, user_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS starts FROM events"


@query
def html_plain_text(d):
    return f"SELECT page_id, {d.plain_text('html')} AS body FROM pages"


@query
def html_visible_length(d):
    return f"SELECT page_id, length({d.visible('html')}) AS n_visible FROM pages"


@query
def html_links(d):
    return f"SELECT page_id, href, count(*) AS n FROM (SELECT page_id, {d.explode(d.every('html', '<a [^>]*href=\"([^\"]*)\"', 1))} AS href FROM pages) AS t GROUP BY page_id, href"


@query
def url_host_build(d):
    host = d.first("url", "^[a-z]+://[^/?#]*")
    return f"SELECT page_id, {host} AS host, concat({host}, '/feed') AS feed FROM pages"


@query
def path_parts(d):
    return f"WITH {books(d)} SELECT path, {d.first('path', '^(.*)/[^/]*$', 1)} AS parent, {d.first('path', '([^/]*)$', 1)} AS name, {d.first('path', '([^/]*)[.][^./]*$', 1)} AS stem FROM books"


@query
def json_props_parse(d):
    k = "CAST(get_json_object(props, '$.k') AS BIGINT)" if d.spark else "CAST(json_extract_string(props, '$.k') AS BIGINT)"
    return f"SELECT event_id, coalesce({k}, 0) AS k FROM events"


@query
def filename_sanitise(d):
    return f"SELECT doc_id, concat({d.safe_filename('text')}, '.epub') AS filename FROM documents"


@query
def content_dedup(d):
    return "SELECT h AS content_md5, n_chars, min(doc_id) AS first_id, count(*) AS n FROM (SELECT md5(text) AS h, n_chars, doc_id FROM documents) AS t GROUP BY h, n_chars"


@query
def first_root_wins(d):
    return "SELECT k, name, root FROM (SELECT k, name, root, row_number() OVER (PARTITION BY k ORDER BY root) AS pick FROM (SELECT c_nationkey AS k, min(c_name) AS name, 1 AS root FROM customer WHERE c_nationkey % 2 = 0 GROUP BY c_nationkey UNION ALL SELECT s_nationkey AS k, min(s_name) AS name, 2 AS root FROM supplier GROUP BY s_nationkey) AS u) AS t WHERE pick = 1"


@query
def focus_split(d):
    n = "CAST(least(greatest(floor(0.45 * length(w)), 1), 9) AS INT)"
    return f"SELECT w, substr(w, 1, {n}) AS bold, substr(w, {n} + 1) AS rest FROM (SELECT DISTINCT {d.explode(d.words(d.fold('text')))} AS w FROM documents) AS t"


@query
def row_profile_classes(d):
    """Rows with equal profiles share a class: suppliers by the sorted set of kinds of their lines."""
    listed = "array_join(array_sort(collect_set(p_brand)), ',')" if d.spark else "array_to_string(list_sort(list(DISTINCT p_brand)), ',')"
    return f"SELECT profile, count(*) AS members, min(l_suppkey) AS representative FROM (SELECT l_suppkey, {listed.replace('p_brand', 'k')} AS profile FROM (SELECT l_suppkey, concat(l_returnflag, l_linestatus, CAST(l_linenumber AS STRING), CASE WHEN l_quantity > 49 AND l_discount > 0.09 THEN '+' ELSE '' END) AS k FROM lineitem) AS p GROUP BY l_suppkey) AS t GROUP BY profile"


def views(spark: SparkSession, sf_dir: str, statement: str) -> None:
    for t in TABLES:
        if t in statement:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _run(f: Callable[[D], str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        statement = f(SPARK)
        views(spark, sf_dir, statement)
        return spark.sql(statement)

    return run


def _run_ranked(f: Callable[[D], str], order: list[tuple[str, str]]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: global_rank(_run(f)(spark, sf_dir), [F.col(c) for c, _ in order], order[0][1])


def _ranked_sql(f: Callable[[D], str], order: list[tuple[str, str]]) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {', '.join(c for c, _ in order)}) AS {order[0][1]} FROM ({f(DUCK)}) AS t"


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {n: (_run_ranked(f, o), _ranked_sql(f, o)) for n, (f, o) in RANKED.items()} | {n: (_run(f), f(DUCK)) for n, f in STATEMENTS.items()}
