"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints of equal value are one entry. The index over the distinct ones has two parts:

* **Upper nodes** are masked bit patterns: the bits are cut into ``radius + 1`` blocks, and two
  fingerprints within the radius agree in one block at least, so each entry goes to the node of
  each of its block values. A node with more than ``node_rows`` entries is not one task's work:
  its remaining bits are cut into blocks again, and so on until all nodes are small. No link is
  lost and no node is capped.
* **Within a node**, entries are sorted by Gray rank, so neighbours share most bits. Runs of the
  sorted entries form the groups of a tree, each with the mask and pattern of the bits its entries
  share. The self-join walks pairs of groups from the top; the differences in bits that both masks
  cover accumulate down the tree, and a pair of groups beyond the radius is dropped whole. The
  many small nodes of a task are walked as one tree, whose groups are ordered by node, then rank.

A node's task emits a spanning forest of the links it finds, never all pairs; the connected
components of all forests are those of all links.

Defined results: a text without words (null, empty, blanks) has fingerprint zero, linked like any
other; null ids count as larger than any id; repeated rows are in one component; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialise
from .graph import components, join_groups

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words (fewer words: the whole sequence; none: no hash)."""
    from xxhash import xxh64_intdigest

    got = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not got:
        return np.zeros(0, np.uint64)
    line = b" ".join(got)
    ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(got) - words + 1)
    last = ends[min(words, len(got)) - 1 :]
    return np.array([xxh64_intdigest(line[s:e], seed) for s, e in zip(starts[:k].tolist(), last.tolist())], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is set if it is in more than half of the hashes.

    Bits are counted eight bytes at a time: a byte of the sum cannot overflow within 255 rows.
    """
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").view(np.uint64)
    counts = np.add.reduceat(bits, np.arange(0, n, 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column(1)], dtype=np.uint64)
        yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _fingerprints(it, words), "doc_id long, fp long")


# --- the tree inside a node -------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class Forest:
    """Union-find over entries; ``add`` keeps the pairs that joined two trees."""

    def __init__(self, n: int):
        self.up, self.links = np.arange(n), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        # Roots of all at once first: most pairs of a dense group are joined already.
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                break
            self.up = up
        new = self.up[a] != self.up[b]
        for i, j in zip(a[new].tolist(), b[new].tolist()):
            ri, rj = self.root(i), self.root(j)
            if ri != rj:
                self.up[max(ri, rj)] = min(ri, rj)
                self.links.append((i, j))


def tree_links(codes: np.ndarray, radius: int, node: np.ndarray | None = None, leaf: int = 16, fan: int = 8, chunk: int = 1 << 18) -> list[tuple[int, int]]:
    """Forest of the links (positions in ``codes``) at ``radius`` or fewer differing bits.

    With ``node``, only codes of one node link; all nodes are walked as one tree, whose groups hold
    neighbouring nodes. A pair of groups carries the bits compared so far and their differences: a
    step down adds the differences in the bits that only the smaller groups' masks cover.
    """
    node = np.zeros(len(codes), np.int64) if node is None else node
    order = np.lexsort((gray_rank(codes), node))
    x, own, forest = codes[order], node[order], Forest(len(codes))
    levels, size = [], leaf  # from the leaves up: mask, pattern, first and last node of each group
    while True:
        at = np.arange(0, len(x), size)
        same_1, any_1 = np.bitwise_and.reduceat(x, at), np.bitwise_or.reduceat(x, at)
        levels.append((~(same_1 ^ any_1), same_1, own[at], own[np.append(at[1:], len(x)) - 1]))
        if len(at) == 1:
            break
        size *= fan

    def further(a: np.ndarray, b: np.ndarray, seen: np.ndarray, differing: np.ndarray, level: int):
        """The pairs within the radius by all bits that both cover, with those bits and their differences."""
        if level >= 0:
            mask, pattern, first, last = levels[level]
            both, gap = mask[a] & mask[b], pattern[a] ^ pattern[b]
            met = (first[b] <= last[a]) & (first[a] <= last[b])
        else:
            both, gap, met = ~np.zeros(len(a), np.uint64), x[a] ^ x[b], own[a] == own[b]
        differing = differing + np.bitwise_count(gap & both & ~seen)
        ok = met & (differing <= radius)
        return a[ok], b[ok], both[ok], differing[ok]

    # A stack of (level, i, j, bits seen, differences) of pairs of groups, i <= j, expanded a bounded chunk at a time.
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1, np.int64))]
    while stack:
        level, i, j, seen, differing = stack.pop()
        step = fan if level else leaf
        if len(i) > max(1, chunk // (step * step)):
            half = len(i) // 2
            stack += [(level, i[half:], j[half:], seen[half:], differing[half:]), (level, i[:half], j[:half], seen[:half], differing[:half])]
            continue
        below = len(levels[level - 1][0]) if level else len(x)
        a = (i[:, None, None] * step + np.arange(step)[None, :, None]) + np.zeros((1, 1, step), np.int64)
        b = (j[:, None, None] * step + np.arange(step)[None, None, :]) + np.zeros((1, step, 1), np.int64)
        a, b = a.ravel(), b.ravel()
        ok = (a < below) & (b < below) & ((a <= b) if level else (a < b))
        a, b, seen, differing = further(a[ok], b[ok], np.repeat(seen, step * step)[ok], np.repeat(differing, step * step)[ok], level - 1)
        if level and len(a):
            stack.append((level - 1, a, b, seen, differing))
        elif len(a):
            forest.add(a, b)
    return [(int(order[i]), int(order[j])) for i, j in forest.links]


def _node_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the nodes of one partition, whose rows (node, fp) come sorted by node: some whole nodes
    at a time form one Gray-ordered tree."""

    def work(node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        links = tree_links(fp.view(np.uint64), radius, node)
        i, j = np.array(links).T if links else (np.zeros(0, np.int64),) * 2
        return pa.record_batch([pa.array(fp[i]), pa.array(fp[j])], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for t in batches:
        held.append((t.column(0).to_numpy(zero_copy_only=False), t.column(1).to_numpy(zero_copy_only=False)))
        rows += t.num_rows
        if rows >= 200_000:
            node, fp = (np.concatenate(z) for z in zip(*held))
            cut = int(np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))[-1])  # the last node may go on
            if cut:
                yield work(node[:cut], fp[:cut])
            held, rows = [(node[cut:], fp[cut:])], len(node) - cut
    if rows:
        yield work(*(np.concatenate(z) for z in zip(*held)))


def _blocks(free: int, parts: int) -> list[int]:
    """Masks that cut the bits of ``free`` into ``parts`` blocks of like width, from the top."""
    bits = [b for b in range(63, -1, -1) if free >> b & 1]
    cut = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[s:e]) for s, e in zip(cut, cut[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hamming_links(entries: DataFrame, radius: int = 3, node_rows: int = 8192) -> DataFrame:
    """(a, b): a spanning forest of the links between the distinct longs ``fp`` of ``entries``, a work table."""
    parts: list[DataFrame] = []
    todo, paths = entries.select("fp", F.lit(0).cast("long").alias("node")), {(): (1 << 64) - 1}
    left: list[DataFrame] = []
    while True:
        # ``paths``: the free bits after each choice of blocks so far; ``node``: choice and values.
        dealt = None
        following: dict[tuple[int, ...], int] = {}
        for path, free in paths.items():
            own = todo if path == () else todo.where(F.col("path") == "-".join(map(str, path)))
            masks = _blocks(free, radius + 1)
            if not masks[0]:  # no bits are left to cut by: such a node holds one code only
                continue
            keys = F.array(*[F.struct(F.lit("-".join(map(str, (*path, k)))).alias("path"), F.xxhash64("node", F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))).alias("node")) for k, m in enumerate(masks)])
            part = own.select("fp", F.explode(keys).alias("k")).select("fp", "k.path", "k.node")
            dealt = part if dealt is None else dealt.unionByName(part)
            following |= {(*path, k): free & ~m for k, m in enumerate(masks)}
        if dealt is None:
            break
        big = materialise(dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > node_rows), "big-nodes")
        wide = big.count()
        # At most rows / node_rows big nodes; broadcast only while that is few.
        hot = F.broadcast(big.select("node")) if wide <= 200_000 else big.select("node")
        fit = dealt.join(hot, "node", "left_anti") if wide else dealt
        links = fit.select("node", "fp").repartition("node").sortWithinPartitions("node", "fp").mapInArrow(lambda it: _node_links(it, radius), "a long, b long")
        parts.append(materialise(links, "simhash-links"))
        following_todo = materialise(dealt.join(hot, "node", "left_semi"), "simhash-big") if wide else None
        discard(big, *left)
        if following_todo is None:
            break
        todo, paths, left = following_todo, following, [following_todo]
    if not parts:
        return entries.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    found = materialise(reduce(DataFrame.unionByName, parts), "simhash-links") if len(parts) > 1 else parts[0]
    if len(parts) > 1:
        discard(*parts)
    return found


def near_dedup(docs: DataFrame, words: int = 3, radius: int = 3, text_col: str = "text", id_col: str = "doc_id", node_rows: int = 8192, hot_rows: int = 2048) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    prints = materialise(fingerprints(docs, words, text_col, id_col), "fingerprints")
    entries = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "simhash-entries")
    links = hamming_links(entries, radius, node_rows)
    comp = components(links)
    # Least id of each component over its distinct fingerprints; entries without links stay alone.
    linked = comp.join(entries, comp["node"] == entries["fp"]).select("fp", "root", "least")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.select("fp", "root").join(ids, "root").select("fp", "component_id")
    of = materialise(entries.join(named, "fp", "left").select("fp", "rows", F.coalesce("component_id", "least").alias("component_id")), "simhash-named")
    discard(links, comp, entries)
    return join_groups(prints, of, "fp", hot_rows).select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_hash(text: Column) -> Column:
    """64-bit hash that names a text; a null one is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_first(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its class's smallest; of rows that repeat it, one stays.

    Where ``classes`` has ``component`` and ``text_hash``, one row of each component stays, also if
    components share an id or have a null one; otherwise one row of each id.
    """
    firsts = classes.where(F.col(id_col).eqNullSafe(F.col("component_id")))
    by = [id_col]
    if {"component", "text_hash"} <= set(classes.columns):
        firsts = firsts.groupBy("component").agg(F.min(F.struct("text_hash", id_col)).alias("first")).select(F.col("first.text_hash").alias("__hash"), F.col(f"first.{id_col}").alias("__id"))
        docs, columns = docs.withColumn("__h", text_hash(F.col(text_col))), docs.columns
        kept = docs.join(firsts, docs[id_col].eqNullSafe(firsts["__id"]) & (docs["__h"] == firsts["__hash"]), "left_semi")
        by = [id_col, "__h"]
    else:
        firsts, columns = firsts.select(id_col).distinct(), docs.columns
        kept = docs.join(firsts, docs[id_col].eqNullSafe(firsts[id_col]), "left_semi")
    again = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.limit(1).count():
        return kept.select(columns)
    one = Window.partitionBy(*by).orderBy(*[F.col(c) for c in columns if c != id_col])
    return kept.withColumn("__row", F.row_number().over(one)).where("__row = 1").select(columns)
