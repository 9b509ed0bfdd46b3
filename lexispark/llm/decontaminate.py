"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

Texts are lower-cased and cut into words of letters and digits; shingles are ``k`` words. For each
benchmark item, windows of the item's own number of words slide over a document. A window's
64-bit SimHash is looked up in ``parts`` blocks of the items of that size: fingerprints within the
radius differ in at most ``radius // parts`` bits of one block at least, so the index holds each
block of an item under all values that differ from it in so few bits, and none is missed. Four
blocks of 16 bits let some 4 % of unrelated fingerprints meet at a radius of 15. Candidates are
then verified by the exact weighted similarity of their shingles (sum of the lesser over sum of the greater
weight), at ``threshold`` or more.

Which windows are formed: only those that can reach the threshold. A window with similarity t has
all but a share 1 - t of the item's weight, so it holds one of any set of the item's shingles
that weighs more than that share: its *anchors*. Windows are laid where an anchor occurs,
shifted by as many words as insertions can move them. Windows without an anchor cannot match.

Weights: 1 + ln(items / items with the shingle), so phrases that items share count less; shingles
that no item has weigh as those of one item.

Native: DataFrame and SQL functions only. The benchmark side is broadcast only while its counted
rows are within ``broadcast_rows``; beyond, Spark joins by shuffle. Hits carry the digest of the
text, not the id, so copies of a text are examined once and null or repeated ids do no harm.

Defined results: null and empty texts and items without words match nothing; items of fewer
words than ``k`` match where a document holds all their words in a row; items of equal text are one
and give a row for each of their ids, a null one too; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialise
from .pii import let


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(clean, " "), lambda w: w != "")


def digest(text: Column) -> Column:
    """Names a text; null stays null and matches nothing."""
    return F.unhex(F.md5(text))


def with_shingles(df: DataFrame, text_col: str, k: int) -> DataFrame:
    """Adds ``n`` (words) and ``s`` (hashes of the ``k``-word shingles in order; fewer words: of the whole)."""

    def shingles(words: Column) -> Column:
        short = F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.array_join(words, " "))))
        starts = F.sequence(F.lit(0), F.size(words) - k)
        run = lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + d) for d in range(k)]))
        s = F.when(F.size(words) < k, short).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), run))
        return F.struct(F.size(words).alias("n"), s.alias("s"))

    return df.withColumn("__x", let(words_of(F.col(text_col)), shingles)).withColumn("n", F.col("__x.n")).withColumn("s", F.col("__x.s")).drop("__x")


def simhash(s: Column) -> Column:
    """64-bit SimHash of an array of hashes: a bit is set if more than half of them have it."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(s, F.lit(0), lambda a, h: a + F.call_function("getbit", h, b).cast("int")))
    return F.aggregate(bits, F.struct(F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("m")), lambda a, c: F.struct(F.when(c * 2 > F.size(s), a["v"].bitwiseOR(a["m"])).otherwise(a["v"]).alias("v"), F.shiftleft(a["m"], 1).alias("m")), lambda a: a["v"])


def blocks(fp: Column, parts: int) -> Column:
    """array<struct<block, value>>: ``parts`` blocks that cover the 64 bits."""
    cut = [64 * i // parts for i in range(parts + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << (e - s)) - 1).cast("long")).alias("value")) for i, (s, e) in enumerate(zip(cut, cut[1:]))])


def near_values(value: Column, bits: int, radius: int) -> Column:
    """All values of ``bits`` bits that differ from ``value`` in at most ``radius``."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return F.transform(F.expr(f"array({', '.join(f'{m}L' for m in masks)})"), lambda m: value.bitwiseXOR(m))


def item_key(text: Column) -> Column:
    """Names an item by its text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def matches(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 15, parts: int = 4, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per distinct text and item that match: th (digest of the text), item (``item_key``), similarity,
    start (word), distance (bits). A work table."""
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    distinct = benchmark.select(item_key(F.col(item_text)).alias("item"), F.col(item_text).alias("__t")).dropDuplicates(["item"])
    items = with_shingles(distinct, "__t", k).drop("__t").where("n > 0")
    plain = materialise(items.withColumn("fp", simhash(F.col("s"))), "bench-items")
    n_items = float(max(1, plain.count()))
    each = plain.select("item", "n", F.posexplode("s").alias("j", "h"))
    weight = each.groupBy("h").agg((1 + F.log(F.lit(n_items) / F.count_distinct("item"))).alias("w"))
    bag = each.join(weight, "h").groupBy("item", "h").agg(F.count(F.lit(1)).alias("c"), F.first("w").alias("w"))
    bags = bag.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("h", "c"))).alias("bag"), F.sum(F.col("c") * F.col("w")).alias("total"))
    items = materialise(plain.join(bags, "item"), "bench-bags")
    weight = materialise(weight, "bench-weights")
    # Anchors: an item's heaviest shingles until their weight exceeds the share that may be missing.
    by_item = Window.partitionBy("item").orderBy(F.desc("w"), F.xxhash64("h"), "j")
    ranked = each.join(weight, "h").withColumn("before", F.coalesce(F.sum("w").over(by_item.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("all", F.sum("w").over(Window.partitionBy("item")))
    anchors = materialise(ranked.where(F.col("before") <= (1 - threshold) * F.col("all") + 1e-9).select("h", "j", "n").distinct(), "bench-anchors")

    # Items of fewer words than k are one shingle: they match the runs of as many words that are equal.
    short = items.where(F.col("n") < k).select("item", "n", F.get("s", F.lit(0)).alias("h"))
    sizes = sorted(r["n"] for r in short.select("n").distinct().collect())

    # Where anchors occur: (hash of the text, size and start of the windows).
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).withColumn("th", digest(F.col("__t")))
    cut = with_shingles(texts, "__t", k)
    hits = cut.select("th", F.col("n").alias("words"), F.posexplode("s").alias("p", "h")).join(small(anchors), "h")
    windows = hits.select("th", "words", "n", (F.col("p") - F.col("j")).alias("at")).distinct()
    shift = F.ceil((1 - threshold) * F.col("n") / k).cast("int")
    windows = windows.select("th", "n", "words", F.explode(F.transform(F.sequence(-shift, shift), lambda d: F.greatest(F.lit(0), F.least(F.col("at") + d, F.col("words") - F.col("n"))))).alias("at"))
    windows = materialise(windows.groupBy("th").agg(F.collect_set(F.struct("n", "at")).alias("windows")), "bench-windows")

    # Their shingles, from one row a distinct text, and their fingerprints.
    one = texts.join(small(windows), "th").groupBy("th").agg(F.first("__t").alias("__t"), F.first("windows").alias("windows"))
    some = with_shingles(one, "__t", k).withColumn("v", F.explode("windows"))
    some = some.select("th", "v.n", "v.at", F.slice("s", F.col("v.at") + 1, F.greatest(F.lit(1), F.col("v.n") - k + 1)).alias("s")).where("size(s) > 0")
    prints = materialise(some.withColumn("fp", simhash(F.col("s"))), "bench-prints")

    # Multi-index lookup among the items of that size, then verification by weighted shingles.
    widths = {64 * (i + 1) // parts - 64 * i // parts for i in range(parts)}
    keyed = items.select("item", "n", F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"), parts)).alias("b"))
    keyed = materialise(keyed.select("item", "n", "item_fp", F.col("b.block").alias("block"), F.explode(near_values(F.col("b.value"), max(widths), radius // parts)).alias("value")), "bench-index")
    looked = prints.select("th", "n", "at", "fp", F.explode(blocks(F.col("fp"), parts)).alias("b")).select("th", "n", "at", "fp", "b.*")
    pairs = looked.join(small(keyed), ["n", "block", "value"]).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).where(F.col("distance") <= radius).select("th", "n", "at", "item", "distance").distinct()
    weights = items.select("item", F.col("s").alias("item_s"), "total", "bag")
    both = pairs.join(prints.select("th", "n", "at", "s"), ["th", "n", "at"]).join(small(weights), "item")
    # Shared: for each distinct shingle of the window the lesser count times its weight.
    counted = both.select("th", "item", "at", "distance", "total", F.size("s").alias("m"), "bag", F.explode(F.array_distinct("s")).alias("h"), F.col("s"))
    counted = counted.select("th", "item", "at", "distance", "total", "h", F.size(F.filter("s", lambda x: x == F.col("h"))).alias("here"), F.coalesce(F.try_element_at("bag", F.col("h")), F.lit(0)).alias("there"))
    w = F.coalesce("w", F.lit(1.0) + F.log(F.lit(n_items)))  # unseen: as in one item
    scored = counted.join(small(weight), "h", "left").groupBy("th", "item", "at", "distance").agg(F.sum(F.least("here", "there") * w).alias("shared"), F.sum(F.col("here") * w).alias("own"), F.first("total").alias("total"))
    good = scored.withColumn("similarity", F.col("shared") / (F.col("own") + F.col("total") - F.col("shared"))).where(F.col("similarity") >= threshold - 1e-9)
    best = good.groupBy("th", "item").agg(F.max(F.struct("similarity", (-F.col("distance")).alias("d"), (-F.col("at")).alias("a"))).alias("b"))
    best = materialise(best.select("th", "item", F.round("b.similarity", 6).alias("similarity"), (-F.col("b.a")).alias("start"), (-F.col("b.d")).alias("distance")), "bench-matches")
    first_best, spent = best, []
    if sizes:
        run = lambda w, m: lambda i: F.struct(F.lit(m).alias("n"), i.alias("start"), F.xxhash64(F.array_join(F.slice(w, i + 1, m), " ")).alias("h"))
        runs = lambda w: F.flatten(F.array(*[F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - m, F.lit(0))), run(w, m)), lambda r: r["start"] + m <= F.size(w)) for m in sizes]))
        held = texts.select("th", F.explode(let(words_of(F.col("__t")), runs)).alias("r")).select("th", "r.*").join(small(short), ["n", "h"])
        held = held.groupBy("th", "item").agg(F.lit(1.0).alias("similarity"), F.min("start").cast("int").alias("start"), F.lit(0).alias("distance"))
        best = best.join(short.select("item"), "item", "left_anti").select("th", "item", "similarity", "start", "distance").unionByName(held)
        spent.append(first_best)
        best = materialise(best, "bench-short")
    discard(plain, items, weight, anchors, windows, prints, keyed, *spent)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """One row per (document id, item id) that match: similarity, start (word), distance (bits)."""
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    best = matches(docs, benchmark, text_col=text_col, id_col=id_col, item_text=item_text, broadcast_rows=broadcast_rows, **options)
    ids = benchmark.select(F.col(item_id).alias("__item"), item_key(F.col(item_text)).alias("item")).distinct()
    named = best.join(small(ids), "item").select("th", F.col("__item").alias("item"), "similarity", "start", "distance")
    near = docs.select(F.col(id_col).alias("__id"), digest(F.col(text_col)).alias("th"))
    return near.join(small(named), "th").select(F.col("__id").alias(id_col), F.col("item").alias(item_id), "similarity", "start", "distance").distinct()


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """The rows of ``docs`` whose texts match no benchmark item; ids play no part."""
    best = matches(docs, benchmark, text_col=text_col, id_col=id_col, broadcast_rows=broadcast_rows, **options)
    bad = materialise(best.select(F.col("th").alias("__bad")).distinct(), "leaks")
    discard(best)
    bad = F.broadcast(bad) if bad.count() <= broadcast_rows else bad
    return docs.withColumn("__th", digest(F.col(text_col))).join(bad, F.col("__th") == F.col("__bad"), "left_anti").select(docs.columns)
