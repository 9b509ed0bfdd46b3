"""Near copies by verified similarity: SimHash candidates, then exact shares of word shingles.

Fingerprints within 3 bits find close copies only; at a similarity of 0.8 about 10 of 64 bits
differ, too many for an index of blocks. So candidates come from two sides:

* the Gray-order index of ``simhash`` at ``radius`` bits, over fingerprints of distinct runs of ``words`` words;
* **clean strata**: a text's distinct shingle hashes fall into strata of about two by their value
  modulo the size class, and a key is the sum of a stratum. Two sets at the similarity leave more
  than half of their strata untouched, so of ``strata`` keys a pair of long texts misses all with a
  chance of about 2 in a thousand; one of a few shingles misses all more often. Sizes of a pair differ by at most a class, so keys are
  made for two classes. Never all pairs of a key are formed: in the first round each text is paired
  with one head, that of its keys whose own keys most texts share (the original of many copies). Then
  components are contracted: of each key one text a component stays, keys of one component drop
  out, and what stays is paired with a head drawn by hash. Pairs whose fingerprints differ in over
  ``far`` bits (five deviations above what is expected) are left to the third side.

These two only join most copies cheaply; what they miss is left to a third, exact side, a
**prefix join** of the texts not yet in one component. In one order of all hashes, two sets at the
similarity share one of the first n - ceil(similarity * n) + 1 hashes of each. So texts that share
such a hash and are in different components are all compared, a text with a block of texts at a
time; hashes whose texts are all in one component drop out first. Frequent hashes, known from a
sample of texts, come last in the order, which loses nothing.

Every candidate is verified: shared over all distinct shingles, ``similarity`` or more. Only
verified pairs link, and no pair at the similarity is left in two components.

Defined results: texts with equal sets of shingles are one class, those without words too; null
texts are empty; null ids count as larger than any id, and a component of them only has a null
component_id; different texts of one id are apart unless they are alike; repeated rows are in one
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import arrow_batches, discard, hand_back, materialise
from .graph import components, grown, join_groups, rooted
from .simhash import fingerprint, hamming_links, shingle_hashes, text_hash


def strata_keys(distinct: np.ndarray, similarity: float, strata: int, load: float = 2.0) -> np.ndarray:
    """Keys of the first strata of sorted distinct hashes, in its own size class and the next."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    ratio, out = 1 / similarity, []
    own = floor(log(len(distinct)) / log(ratio))
    for size_class in (own, own + 1):
        parts = max(1, round(ratio**size_class / load))
        at = distinct % np.uint64(parts)
        few, at = distinct[at < strata], at[at < strata]
        if not len(at):
            continue
        order = np.argsort(at, kind="stable")
        few, at = few[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        key = np.add.reduceat(few, first) + at[first] * np.uint64(0x9E3779B97F4A7C15) + np.uint64((size_class + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)
        key ^= key >> np.uint64(31)
        out.append(key * np.uint64(0x9FB21C651E98DF25))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    longs = [a.view(np.int64) for a in arrays]
    ends = pa.array(np.concatenate([[0], np.cumsum([len(a) for a in longs])]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(longs) if longs else np.zeros(0, np.int64), pa.int64()))


SKETCH = "text_hash long, fp long, n long, set long, keys array<long>, prefix array<long>"


def _sketches(batches: Iterator[pa.RecordBatch], words: int, similarity: float, strata: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest

    for b in batches:
        fps, ns, sets, keys, firsts = [], [], [], [], []
        for t in b.column(1):
            u = np.unique(shingle_hashes(t.as_py(), words))
            fps.append(fingerprint(u))  # over distinct shingles, as the similarity: one for a class
            ns.append(len(u))
            sets.append(xxh64_intdigest(u.astype("<u8").tobytes()))
            keys.append(strata_keys(u, similarity, strata))
            firsts.append(prefix_hashes(u, similarity, frequent))
        signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
        yield pa.record_batch([b.column(0), signed(fps), pa.array(ns, pa.int64()), signed(sets), _lists(keys), _lists(firsts)], names=["text_hash", "fp", "n", "set", "keys", "prefix"])
    hand_back()


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sorted sets of hashes reach the similarity."""
    for batch in batches:
        good = []
        for mine, its in zip(batch.column(2), batch.column(3)):
            mine, its = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (mine, its))
            shared = len(np.intersect1d(mine, its, assume_unique=True))
            good.append(shared >= similarity * (len(mine) + len(its) - shared) - 1e-9)
        kept = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])
        yield kept.filter(pa.array(good, pa.bool_()))


def _alike(similarity: float, far: int) -> Column:
    """May (fp, n) and (b_fp, b_n) be of two texts at the similarity, by fingerprint and size?"""
    return (F.bit_count(F.col("fp").bitwiseXOR(F.col("b_fp"))) <= far) & (F.least("n", "b_n") >= similarity * F.greatest("n", "b_n") - 1e-9)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("least", "b").alias("a"), F.least("least", "b").alias("b")).distinct()


def _first_heads(shared: DataFrame, by: str, similarity: float, far: int, hot_rows: int) -> DataFrame:
    """(a, b): each member of a group with its head, the one whose keys most texts share (the least of
    those); a member of several groups takes one of their heads, by the same measure. A work table."""
    head = F.min(F.struct((-F.col("shares")).alias("less"), F.col("least").alias("b"), F.col("fp").alias("b_fp"), F.col("n").alias("b_n"))).alias("h")
    groups = materialise(shared.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), head), "near-heads")
    dealt = join_groups(shared.select(by, "least", "fp", "n"), groups, by, hot_rows).select("least", "fp", "n", "h.*")
    best = dealt.where("least <> b").where(_alike(similarity, far)).groupBy("least").agg(F.min(F.struct("less", "b")).alias("h"))
    pairs = materialise(_ordered(best.select("least", F.col("h.b").alias("b"))), "near-pairs")
    discard(groups)
    return pairs


def _next_heads(shared: DataFrame, comp: DataFrame, by: str, similarity: float, far: int, hot_rows: int, turn: int) -> DataFrame:
    """(a, b) between the components that share a key: of each key one text a component, paired with the
    text that a hash draws among them. Components joined already form no pair. A work table."""
    least = F.min(F.struct(F.xxhash64("least", F.lit(turn)).alias("h"), "least", "fp", "n")).alias("one")
    one = materialise(rooted(shared, comp, "least").groupBy(by, "root").agg(least).select(by, "root", "one.*"), "near-contracted")
    head = F.min(F.struct(F.xxhash64("root", by, F.lit(turn)).alias("first"), F.col("root").alias("b_root"), F.col("least").alias("b"), F.col("fp").alias("b_fp"), F.col("n").alias("b_n"))).alias("h")
    groups = materialise(one.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), head).where("rows > 1"), "near-heads")
    dealt = join_groups(one.select(by, "root", "least", "fp", "n"), groups, by, hot_rows).select("root", "least", "fp", "n", "h.*")
    pairs = materialise(_ordered(dealt.where("root <> b_root").where(_alike(similarity, far))), "near-pairs")
    discard(one, groups)
    return pairs


def _sets(rows: DataFrame, wanted: DataFrame, words: int, broadcast_rows: int, of=lambda u: u) -> DataFrame:
    """(doc_id, hashes) of the wanted texts, once each; a work table."""
    few = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    texts = rows.join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return materialise(texts.mapInArrow(lambda it: _each_set(it, words, of), "doc_id long, hashes array<long>"), "near-sets")


def _links(pairs: DataFrame, rows: DataFrame, words: int, similarity: float, broadcast_rows: int) -> DataFrame:
    """The pairs whose texts reach the similarity, a work table; ``pairs`` is deleted."""
    wanted = materialise(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "near-wanted")
    sets = _sets(rows, wanted, words, broadcast_rows)
    # The set of a hot head is dealt to several tasks.
    share = materialise(pairs.groupBy("b").agg(F.floor(F.count(F.lit(1)) / 256).cast("int").alias("parts")), "near-shares")
    dealt = join_groups(pairs, share.withColumn("rows", F.col("parts") * 256), "b", 256).select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts") + 1).cast("int").alias("part"))
    theirs = share.join(sets, share["b"] == sets["doc_id"]).select("b", F.explode(F.sequence(F.lit(0), "parts")).alias("part"), F.col("hashes").alias("its"))
    both = dealt.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("mine")), "a").join(theirs, ["b", "part"])
    links = materialise(both.select("a", "b", "mine", "its").mapInArrow(lambda it: _verified(it, similarity), "a long, b long"), "near-links")
    discard(pairs, wanted, sets, share)
    return links


def prefix_hashes(distinct: np.ndarray, similarity: float, frequent: np.ndarray) -> np.ndarray:
    """The hashes, first in the order, of which similar sets share one; the sorted ``frequent`` come last."""
    most = len(distinct) - ceil(similarity * len(distinct) - 1e-9) + 1
    if len(distinct) and len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, distinct), len(frequent) - 1)] == distinct
        distinct = np.concatenate([distinct[~late], distinct[late]])
    return distinct[:most]


def _each_set(batches: Iterator[pa.RecordBatch], words: int, of) -> Iterator[pa.RecordBatch]:
    """(doc_id, hashes): ``of`` the distinct hashes of each text."""
    for b in batches:
        yield pa.record_batch([b.column(0), _lists([of(np.unique(shingle_hashes(t.as_py(), words))) for t in b.column(1)])], names=["doc_id", "hashes"])


def _counts(distinct: np.ndarray) -> np.ndarray:
    """How many hashes fall to each of 1024 places; two texts share no more than the lesser counts."""
    return np.bincount((distinct % np.uint64(1024)).astype(np.int64), minlength=1024).astype(np.uint16)


def _may_link(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b): texts and those of their blocks where by the counts a link to another root is possible.

    Rows (block, part, side, id, root, counts) come sorted, those of the block (side 0) first."""
    last, held, index = None, [], None
    for batch in batches:
        a_out, b_out = [], []
        sides, ids, roots = (batch.column(k).to_pylist() for k in (2, 3, 4))
        for i, at in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            mine = batch.column(5)[i].values.to_numpy().view(np.uint16)
            if at != last:
                last, held, index = at, [], None
            if sides[i] == 0:
                held.append((roots[i], mine))
                continue
            if index is None:
                counts = np.stack([c for _, c in held])
                index = counts, counts.sum(1, dtype=np.int64), np.array([r for r, _ in held])
                held = []
            counts, sizes, theirs = index
            n = mine.sum(dtype=np.int64)
            for k in range(0, len(counts), 512):  # a block of short texts has many rows
                most = np.minimum(counts[k : k + 512], mine).sum(1, dtype=np.int64)
                if ((most >= similarity * (n + sizes[k : k + 512] - most) - 1e-9) & (theirs[k : k + 512] != roots[i])).any():
                    a_out.append(ids[i])
                    b_out.append(at[0])
                    break
        yield pa.record_batch([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def _block_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of texts with the texts of a block: rows (block, part, side, id, root, hashes) come sorted,
    those of the block (side 0) first. Of a text's links to one root the first is given."""
    last, held, index = None, [], None
    for batch in batches:
        a_out, b_out = [], []
        sides, ids, roots = (batch.column(k).to_pylist() for k in (2, 3, 4))
        for i, at in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            mine = batch.column(5)[i].values.to_numpy()
            if at != last:
                last, held, index = at, [], None
            if sides[i] == 0:
                held.append((ids[i], roots[i], mine))
                continue
            if index is None:
                sizes = np.array([len(h) for _, _, h in held])
                flat, owner = np.concatenate([h for _, _, h in held]), np.repeat(np.arange(len(held)), sizes)
                order = np.argsort(flat, kind="stable")
                index = flat[order], owner[order], sizes, np.array([k for k, _, _ in held]), np.array([r for _, r, _ in held])
                held = []
            flat, owner, sizes, names, theirs = index
            low, high = np.searchsorted(flat, mine), np.searchsorted(flat, mine, "right")
            n = high - low
            hits = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared = np.bincount(owner[hits], minlength=len(sizes))
            good = np.flatnonzero((shared >= similarity * (len(mine) + sizes - shared) - 1e-9) & (theirs != roots[i]))
            good = good[np.unique(theirs[good], return_index=True)[1]]
            a_out += [ids[i]] * len(good)
            b_out += names[good].tolist()
        yield pa.record_batch([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def _frequent(rows: DataFrame, words: int, sample: int, most: int) -> np.ndarray:
    """The commonest hashes of a share 1 / ``sample`` of the texts, at most ``most``: they only set the order."""
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0).dropDuplicates(["doc_id"])
    seen = some.mapInArrow(lambda it: _each_set(it, words, lambda u: u), "doc_id long, hashes array<long>")
    often = seen.select(F.explode("hashes").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").orderBy(F.desc("rows"), "key").limit(most)
    return np.sort(np.array([r["key"] for r in often.collect()], dtype=np.int64).view(np.uint64))


def _rest(firsts: DataFrame, rows: DataFrame, comp: DataFrame, words: int, similarity: float, hot_rows: int, broadcast_rows: int, block_hashes: int = 400_000) -> DataFrame:
    """Links between texts of different components: every pair that shares a prefix hash is compared.

    ``firsts`` holds (least, n, prefix), a row a class. A text's home is the commonest of its open
    prefix hashes; texts of one home and like size form blocks of about ``block_hashes`` hashes.
    Texts are dealt to the blocks that hold a text of another component under a hash of theirs, so
    many texts that share many hashes meet once a block, not once a hash. A work table.
    """
    keyed = rooted(firsts.select("least", "n", "prefix"), comp, "least").select("least", "root", "n", F.posexplode("prefix").alias("pos", "key"))
    keyed = materialise(keyed, "near-prefixes")
    # Keys whose texts are all in one component need nothing more.
    groups = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "rows"), "near-open")
    # Of a pair whose first common hash has this place, the other text can't be larger than ``cap``.
    live = join_groups(keyed, groups, "key", hot_rows).withColumn("cap", (F.col("n") - F.col("pos")) * ((1 + similarity) / similarity) - F.col("n") + 1e-6)
    live = materialise(live, "near-live")
    discard(keyed, groups)
    homes = live.groupBy("least").agg(F.max(F.struct("rows", "key")).alias("home"), F.first("root").alias("root"), F.first("n").alias("n")).select("least", "root", "n", F.col("home.key").alias("home"))
    homes = homes.withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / log(1 / similarity)))
    parts = homes.groupBy("home", "size_class").agg((F.floor(F.sum("n") / block_hashes) + 1).alias("parts"))
    homes = homes.join(parts, ["home", "size_class"]).select("least", "root", F.xxhash64("home", "size_class", F.pmod(F.xxhash64("least"), "parts")).alias("block"))
    homes = materialise(homes, "near-homes")
    salt = F.floor(F.col("rows") / hot_rows).cast("int")
    members = live.select("key", "least", "rows", "n", "cap").join(homes, "least").select("key", "least", "root", "block", "n", "cap", F.pmod(F.xxhash64("least"), salt + 1).cast("int").alias("salt"), "rows")
    members = materialise(members, "near-members")
    held = members.groupBy("key", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("rows").alias("rows"), F.min("n").alias("lo_n"), F.max("n").alias("hi_n"), F.max("cap").alias("hi_cap"))
    held = held.select("key", F.col("block").alias("to"), "lo", "hi", "lo_n", "hi_n", "hi_cap", F.explode(F.sequence(F.lit(0), salt)).alias("salt"))
    # A pair meets in the block of the one or of the other, or in both if they share it.
    fits = (F.col("lo_n") <= F.col("cap")) & (F.col("n") <= F.col("hi_cap")) & (F.col("hi_n") >= similarity * F.col("n") - 1e-6) & (similarity * F.col("lo_n") <= F.col("n") + 1e-6)
    dealt = members.drop("rows").join(held, ["key", "salt"]).where("block <= to AND (lo <> root OR hi <> root)").where(fits).select("least", "root", F.col("to").alias("block")).distinct()
    dealt = materialise(dealt, "near-dealt")
    discard(live, members)

    def meet(dealt: DataFrame, of, work) -> DataFrame:
        wide = materialise(dealt.groupBy("block").agg(F.floor(F.count(F.lit(1)) / 1024).cast("int").alias("parts")), "near-wide")
        theirs = homes.join(wide, "block").select("block", F.explode(F.sequence(F.lit(0), "parts")).alias("part"), F.lit(0).alias("side"), "least", "root")
        mine = dealt.join(wide, "block").select("block", F.pmod(F.xxhash64("least"), F.col("parts") + 1).cast("int").alias("part"), F.lit(1).alias("side"), "least", "root")
        both = materialise(theirs.unionByName(mine), "near-both")
        wanted = materialise(both.select(F.col("least").alias("doc_id")).distinct(), "near-wanted")
        sets = _sets(rows, wanted, words, broadcast_rows, of)
        full = both.join(sets, both["least"] == sets["doc_id"]).select("block", "part", "side", F.col("least").alias("id"), "root", "hashes")
        links = materialise(full.repartition("block", "part").sortWithinPartitions("block", "part", "side").mapInArrow(lambda it: work(it, similarity), "a long, b long"), "near-links")
        discard(wide, both, wanted, sets)
        return links

    # First by counts, which are small, then the rest by whole sets.
    maybe = meet(dealt, _counts, _may_link)
    possible = materialise(maybe.select(F.col("a").alias("least"), F.col("b").alias("block")).join(homes.select("least", "root"), "least"), "near-dealt")
    links = meet(possible, lambda u: u, _block_links)
    discard(maybe, possible, dealt, homes)
    return links


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 3, far: int = 24, strata: int = 6, rounds: int = 1, text_col: str = "text", id_col: str = "doc_id", hot_rows: int = 2048, broadcast_rows: int = 1_000_000, sample: int = 16, frequent: int = 100_000, batch_rows: int = 1024, batch_size: str = "8m") -> DataFrame:
    """One row per document: id, component_id (smallest id in the component), component and its text's hash.

    Components are those of texts, named by ``text_hash``; ids only name the result, so null and
    repeated ids join nothing. Python workers get at most ``batch_rows`` rows and about ``batch_size`` bytes at
    a time: all that needs them is written here, the rows returned are joined from work tables.
    """
    with arrow_batches(docs.sparkSession, batch_rows, batch_size):
        return _near_copies(docs, words, similarity, radius, far, strata, rounds, text_col, id_col, hot_rows, broadcast_rows, sample, frequent)


def _near_copies(docs: DataFrame, words: int, similarity: float, radius: int, far: int, strata: int, rounds: int, text_col: str, id_col: str, hot_rows: int, broadcast_rows: int, sample: int, frequent: int) -> DataFrame:
    given = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(F.col(text_col)).alias("text_hash"))
    rows = docs.select(text_hash(F.col(text_col)).alias("doc_id"), F.col(text_col).alias("text"))
    late = _frequent(rows, words, sample, frequent)
    # The one pass over all texts: set, fingerprint, strata keys and prefix of each.
    sketch = rows.mapInArrow(lambda it: _sketches(it, words, similarity, strata, late), SKETCH)
    sketch = materialise(sketch.withColumn("row", F.monotonically_increasing_id()), "near-sketches")
    # Equal sets are one class, named by its least text hash.
    classes = sketch.groupBy("set", "n").agg(F.min(F.struct("text_hash", "row")).alias("one"), F.first("fp").alias("fp"))
    classes = materialise(classes.select("set", "n", "fp", F.col("one.text_hash").alias("least"), "one.row"), "near-classes")
    firsts = sketch.select(F.col("text_hash").alias("least"), "fp", "n", "keys", "prefix", "row").join(classes.select("row"), "row", "left_semi").drop("row")
    keyed = materialise(firsts.select("least", "fp", "n", F.explode("keys").alias("key")), "near-keys")
    groups = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "near-groups")
    owned = materialise(join_groups(keyed, groups, "key", hot_rows), "near-shared")
    shared = materialise(owned.join(owned.groupBy("least").agg(F.sum("rows").alias("shares")), "least").drop("rows"), "near-shares")
    discard(keyed, groups, owned)

    # Classes of one fingerprint, and fingerprints that the Gray-order index links.
    prints = classes.select("least", "fp", "n", F.col("fp").alias("print"), F.lit(0).alias("shares"))
    heads = materialise(classes.groupBy("fp").agg(F.min("least").alias("id")), "near-prints")
    at = lambda side: heads.select(F.col("fp").alias(side), F.col("id").alias(f"{side}_id"))
    index = hamming_links(heads, radius)
    close = index.join(at("a"), "a").join(at("b"), "b").select(F.greatest("a_id", "b_id").alias("a"), F.least("a_id", "b_id").alias("b"))
    by_key, by_print = _first_heads(shared, "key", similarity, far, hot_rows), _first_heads(prints, "print", similarity, far, hot_rows)
    pairs = materialise(by_key.unionByName(by_print).unionByName(close).distinct(), "near-pairs")
    discard(by_key, by_print, index, heads)
    links = _links(pairs, rows, words, similarity, broadcast_rows)
    comp = components(links)
    discard(links)

    # Again with other heads, for components that share a key and are apart yet.
    for turn in range(1, rounds + 1):
        links = _links(_next_heads(shared, comp, "key", similarity, far, hot_rows, turn), rows, words, similarity, broadcast_rows)
        comp = grown(comp, links)
        discard(links)
    discard(shared)

    # What is in different components still is compared exactly.
    links = _rest(firsts, rows, comp, words, similarity, hot_rows, broadcast_rows)
    comp = grown(comp, links)
    discard(links)

    of = rooted(classes.select("set", "n", "least"), comp, "least", "component").drop("least")
    of = sketch.select("text_hash", "set", "n").groupBy("text_hash", "set", "n").agg(F.count(F.lit(1)).alias("rows")).join(of, ["set", "n"])
    of = materialise(of.select("text_hash", "rows", "component"), "near-named")
    discard(sketch, classes, comp)
    all_rows = materialise(join_groups(given, of, "text_hash", hot_rows).drop("rows"), "near-rows")
    discard(of)
    ids = all_rows.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    ids = materialise(ids, "near-ids")
    return join_groups(all_rows, ids, "component", hot_rows).select(F.col("id").alias(id_col), "component_id", "component", "text_hash")
