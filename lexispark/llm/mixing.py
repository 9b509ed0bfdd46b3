"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``cap``; the rates are those of least (bounded) relative
entropy from the base rate 1 under one token constraint a source: the rates times the sizes sum
up to the source's target. The dual of that problem is convex, and its solution is an
exponential tilt, r = cap * e / (cap - 1 + e) with e = exp(lambda_s * size / mean size of s).
Newton's method finds lambda: each iteration is one distributed aggregation of the constraint's
value and slope over a (source, size, documents) histogram, safeguarded by a bracket.

Rates are then rounded into copies: equal sizes have equal rates, so a histogram cell needs only
the number of copies it gets. Going down the sizes of a source, each cell takes its rounded
share plus what earlier cells left over, which brings the source within about its smallest
documents of the target. Inside a cell, the documents that get one copy more are those first in
the order of a hash of the id; large cells are split into salts with a prefix sum of counts.

Memory: the driver holds one row a source, at most ``most_sources`` of them (beyond, an error); a
task holds the distinct sizes of one source.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source
of its own, last; equal rows may get different copies, the same ones in every run; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Words are runs of anything but these.
WHITE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in ``text`` (null: 0), by the blanks between them."""
    t = F.coalesce(text, F.lit(""))
    inner = F.regexp_replace(t, r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, WHITE, -1))).cast("long")


def capped_targets(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Share ``total`` by weight; targets stop at ``cap`` times the size, the excess is shared anew."""
    target, free, rest = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}, float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if rest * weights[i] / w > cap * sizes[i]}
        if not over:
            for i in free:
                target[i] = rest * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
            rest -= target[i]
        free -= over
    return target


def _rates(lam: Column, size: Column, mean: Column, cap: float) -> tuple[Column, Column]:
    """The rate and its slope in lambda."""
    x = size / mean
    e = F.exp(F.least(F.greatest(lam * x, F.lit(-60.0)), F.lit(60.0)))
    return cap * e / (cap - 1 + e), cap * (cap - 1) * e * x / ((cap - 1 + e) * (cap - 1 + e))


def balance(hist: DataFrame, sources: list[dict], cap: float, tolerance: float = 1e-9, most: int = 60) -> dict[int, float | None]:
    """Lambda of each source (``sid``) by Newton steps; None where the target is the cap itself.

    A source that has not settled after ``most`` steps is an error, unless it is within a thousandth.
    """
    lam = {s["sid"]: 0.0 for s in sources}
    low, high = dict.fromkeys(lam, -math.inf), dict.fromkeys(lam, math.inf)
    at_cap = {s["sid"] for s in sources if s["size"] <= 0 or s["target"] >= cap * s["size"] * (1 - 1e-12)}
    left = {s["sid"]: s for s in sources if s["sid"] not in at_cap}
    spark, off = hist.sparkSession, {}
    for _ in range(most):
        if not left:
            break
        now = spark.createDataFrame([(k, lam[k], s["mean"]) for k, s in left.items()], "sid int, lam double, mean double")
        rate, slope = _rates(F.col("lam"), F.col("size"), F.col("mean"), cap)
        now = F.broadcast(now) if len(left) <= 100_000 else now
        got = hist.join(now, "sid").groupBy("sid").agg(F.sum(F.col("n") * F.col("size") * rate).alias("g"), F.sum(F.col("n") * F.col("size") * slope).alias("h")).collect()
        for r in got:
            k, s = r["sid"], left[r["sid"]]
            gap = r["g"] - s["target"]
            off[k] = abs(gap) / max(1.0, s["target"])
            if abs(gap) <= tolerance * max(1.0, s["target"]):
                del left[k]
                continue
            low[k], high[k] = (low[k], lam[k]) if gap > 0 else (lam[k], high[k])
            step = lam[k] - gap / r["h"] if r["h"] > 0 else math.nan
            if not low[k] < step < high[k]:  # Newton left the bracket: halve or widen it
                step = (low[k] + high[k]) / 2 if math.isfinite(low[k] + high[k]) else lam[k] + math.copysign(max(1.0, abs(lam[k])), -gap)
            lam[k] = step
    if unsettled := [k for k in left if off.get(k, math.inf) > 1e-3]:
        raise RuntimeError(f"the rates of {len(unsettled)} sources did not settle")
    return {k: None if k in at_cap else v for k, v in lam.items()}


def _round(cap: float):
    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        """Copies of the cells of one source, largest documents first, carrying over what is left."""
        pdf = pdf.sort_values("size", ascending=False)
        due, copies = 0.0, []
        for size, n, rate in zip(pdf["size"].to_numpy(), pdf["n"].to_numpy(), pdf["rate"].to_numpy()):
            due += float(size) * n * rate
            k = min(max(round(due / size), 0), int(cap) * int(n))
            copies.append(k)
            due -= float(size) * k
        return pd.DataFrame({"sid": pdf["sid"], "size": pdf["size"], "n": pdf["n"], "copies": copies})

    return share


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), volume: float = 1.5, cap: float = 2.0, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", salt_rows: int = 256, most_sources: int = 1_000_000) -> DataFrame:
    """One row per document: id, source, size, source_size, target, rate, copies, taken.

    ``weights`` repeat over the sources in code-point order, null last; the mix has ``volume``
    times all words. Copies are whole, at most ``cap``.
    """
    spark = docs.sparkSession
    sized = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    order = F.asc_nulls_last("source")
    totals = [r.asDict() for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.sum((F.col("size") > 0).cast("long")).alias("docs")).orderBy(order).limit(most_sources + 1).collect()]  # a row a source
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources: the driver holds a row each")
    shares = [float(weights[i % len(weights)]) for i in range(len(totals))]
    target = capped_targets([t["size"] for t in totals], shares, volume * sum(t["size"] for t in totals), cap)
    for i, t in enumerate(totals):
        t |= {"sid": i, "target": target[i], "mean": max(1.0, t["size"] / max(1, t["docs"]))}
    known = spark.createDataFrame([(t["sid"], t["source"], t["size"], t["target"], t["mean"]) for t in totals], "sid int, source string, source_size long, target double, mean double")
    # One row a source: small, but still only broadcast while it is.
    known = F.broadcast(known) if len(totals) <= 100_000 else known
    rows = sized.join(known, sized["source"].eqNullSafe(known["source"])).drop(known["source"])
    hist = materialise(rows.where("size > 0").groupBy("sid", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    lam = balance(hist, totals, cap)
    tilt = spark.createDataFrame([(t["sid"], lam[t["sid"]], t["mean"]) for t in totals], "sid int, lam double, mean double")
    rate = F.when(F.col("lam").isNull(), F.lit(cap)).otherwise(_rates(F.col("lam"), F.col("size"), F.col("mean"), cap)[0])
    rated = hist.join(F.broadcast(tilt) if len(totals) <= 100_000 else tilt, "sid").withColumn("rate", rate)
    cells = rated.groupBy("sid").applyInPandas(_round(cap), "sid int, size long, n long, copies long")
    cells = materialise(cells.join(rated.select("sid", "size", "rate"), ["sid", "size"]), "mix-cells")
    # Every document of a cell gets floor(copies / n); ``more`` of them get one more.
    cells = cells.select("sid", "size", "rate", F.floor(F.col("copies") / F.col("n")).alias("each"), (F.col("copies") % F.col("n")).alias("more"), "n", F.ceil(F.col("n") / salt_rows).alias("salts"))
    dealt = rows.join(cells, ["sid", "size"], "left").withColumn("h", F.xxhash64(F.lit(17), "doc_id")).withColumn("salt", F.pmod("h", F.coalesce("salts", F.lit(1))))
    split = dealt.where("more > 0")
    salts = split.groupBy("sid", "size", "salt").agg(F.count(F.lit(1)).alias("m"), F.first("more").alias("more"), F.first("n").alias("n"))
    upto = Window.partitionBy("sid", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda c: F.floor(F.col("more") * c / F.col("n"))
    quota = salts.withColumn("c", F.sum("m").over(upto)).select("sid", "size", "salt", (share(F.col("c")) - share(F.col("c") - F.col("m"))).alias("quota"))
    rank = F.row_number().over(Window.partitionBy("sid", "size", "salt").orderBy(F.xxhash64(F.lit(23), "doc_id"), "doc_id"))
    ranked = split.withColumn("rank", rank).join(quota, ["sid", "size", "salt"]).withColumn("copies", F.col("each") + (F.col("rank") <= F.col("quota")).cast("long"))
    plain = dealt.where("more is null or more = 0").withColumn("copies", F.coalesce("each", F.lit(0)))
    cols = ["doc_id", "source", "size", "source_size", "target", "rate", "copies"]
    out = plain.select(cols).unionByName(ranked.select(cols))
    return out.select(F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))
