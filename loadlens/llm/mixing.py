"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length per source. Whole passes over a source are taken first; what is left of its target
is spread over the lengths in proportion, fractions rounded by the seed, and a bounded-knapsack dynamic programme over the
unused counts fits what remains. The result is a number of documents for each length; which documents those are is decided
by a seeded hash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.llm.common import materialize, word_count

WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of a source and length that are ranked together; the rest are settled by counts.
_RANKED = 256


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_words: int, seed: int | tuple[int, ...] = 17) -> np.ndarray:
    """How many documents to take of each length so that their words come as near to budget as the search finds, without
    passing it: the nearest sum there is, if a table of dp_words holds the budget. Every length is first taken in proportion; fractions are rounded by the
    seed but for a reserve of half a table, so that of lengths with few documents the seed chooses and not the size. The dynamic programme covers what is
    left, in words up to dp_words and in larger units above, and has lengths in seeded order too. No document that
    still fits is left."""
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return counts.copy()
    rng = np.random.default_rng(seed)
    order = np.argsort(sizes, kind="stable")[rng.permutation(len(sizes))]
    share = counts * (budget / total)
    take = np.floor(share).astype(np.int64)
    left = budget - int((sizes * take).sum())
    reserve = min(dp_words // 2, left)
    # systematic rounding: one more of a length where the running sum of the fractions passes a whole number
    passed = np.floor(np.cumsum((share - take)[order]) * (1 - reserve / max(left, 1)) + rng.random())
    take[order] += np.diff(passed, prepend=0.0).astype(np.int64)
    take = np.minimum(take, counts)
    left = budget - int((sizes * take).sum())
    while left < reserve:  # one of each length in seeded order, until the reserve is there again
        some = order[(take[order] > 0) & (sizes[order] > 0)]
        some = some[: int(np.searchsorted(np.cumsum(sizes[some]), reserve - left)) + 1]
        take[some] -= 1
        left += int(sizes[some].sum())
    while left > dp_words:  # and the other way, as long as half a table is left
        some = order[(take[order] < counts[order]) & (sizes[order] > 0) & (sizes[order] <= left - dp_words // 2)]
        some = some[: max(int(np.searchsorted(np.cumsum(sizes[some]), left - dp_words // 2, "right")), 1)]
        if not len(some):
            break
        take[some] += 1
        left -= int(sizes[some].sum())
    take += _tables(sizes, counts - take, left, dp_words, order)
    for _ in range(4):  # shorter ones are put back where a longer one then fits and less is left
        left = budget - int((sizes * take).sum())
        rest = sizes[(take < counts) & (sizes > left)]
        if not left or not len(rest):
            break
        gap = int(rest.min()) - left
        some = order[(take[order] > 0) & (sizes[order] > 0) & (sizes[order] <= gap)]
        back = np.zeros(len(sizes), np.int64)
        back[some] = np.minimum(take[some], -(-(gap + reserve) // max(len(some), 1) // sizes[some]))
        some = some[: int(np.searchsorted(np.cumsum((sizes * back)[some]), gap)) + 1]
        kept = take.copy()
        kept[some] -= back[some]
        kept += _tables(sizes, counts - kept, budget - int((sizes * kept).sum()), dp_words, order)
        if budget - int((sizes * kept).sum()) >= left:
            break
        take = kept
    if int((sizes * take).sum()) < budget and budget // int(np.gcd.reduce(sizes[sizes > 0])) <= dp_words:
        best = _table(sizes, counts, budget, dp_words, order)  # a table holds all of it, so it finds the best sum there is
        if int((sizes * best).sum()) > int((sizes * take).sum()):
            return best
    return take


def _tables(sizes: np.ndarray, free: np.ndarray, left: int, dp_words: int, order: np.ndarray) -> np.ndarray:
    """A table in larger units leaves some words, which the next one fits more closely, until no document fits."""
    take = np.zeros(len(sizes), np.int64)
    while (more := _table(sizes, free - take, left, dp_words, order)).any():
        take += more
        left -= int((sizes * more).sum())
    return take


def _table(sizes: np.ndarray, free: np.ndarray, left: int, dp_words: int, order: np.ndarray) -> np.ndarray:
    """Bounded knapsack over at most dp_words units: how many more of each length, in all at most left words."""
    take = np.zeros(len(sizes), np.int64)
    items = order[(free[order] > 0) & (sizes[order] > 0) & (sizes[order] <= left)]
    if not len(items):
        return take
    unit = int(np.gcd.reduce(sizes[items]))
    if left // unit > dp_words:
        unit = -(-left // dp_words)
    cap, units = left // unit, -(-sizes // unit)  # lengths are rounded up, so that no sum passes what is left
    # by[w]: the first item by which a sum of w was reached; used counts of that item along the way are bounded
    by = np.full(cap + 1, -1, np.int32)
    by[0] = len(sizes)
    for i in items:
        if by[cap] >= 0:
            break
        size, copies, step = int(units[i]), int(free[i]), 1
        before = by >= 0
        now = before.copy()
        while copies > 0:  # binary splitting
            k = min(step, copies)
            copies -= k
            step *= 2
            if k * size > cap:
                break
            now[k * size :] |= now[: -k * size].copy()
        by[now & ~before] = i
    w = int(np.flatnonzero(by >= 0).max())
    if not w:  # rounded up, none fits: the longest that does
        take[items[np.argmax(sizes[items])]] = 1
    while w > 0:
        i = int(by[w])
        take[i] += 1
        w -= int(units[i])
    return take


def _fit(dp_words: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        whole = int((sizes * counts).sum())
        target = float(pdf["target"].iloc[0])
        passes = int(target // whole) if whole else 0
        source = zlib.crc32(str(pdf["source"].iloc[0]).encode())
        pdf = pdf.assign(passes=passes, extra=fit_counts(sizes, counts, int(round(target - passes * whole)), dp_words, (seed % 2**32, source)))
        return pdf[["source", "size", "n", "passes", "extra"]]

    return run


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code-point order, null last, get the weights in turn. The targets add up to share of all words, none is
    above most times its source's words, and the excess is dealt again by weight: target = min(most*size, level*weight)
    with the one level that gives the sum. One row per source passes through a window without partitions, so it is
    bounded by the number of sources and not by the documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.withColumn("i", F.row_number().over(order) - 1)
    weighed = weighed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    # sources fill up in the order of cap/weight; the level is found where the rest of the weights carries the rest of the sum
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "i").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weighed = weighed.withColumn("want", share * F.sum("source_size").over(everything)).withColumn("caps", F.coalesce(F.sum("cap").over(filled), F.lit(0.0)))
    weighed = weighed.withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
    weighed = weighed.withColumn("level", (F.col("want") - F.col("caps")) / F.col("left"))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    # no such source: every one is full
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))
    return weighed.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _seeded(seed: int, doc_id: Column) -> Column:
    """A number from 0 to below 2**31, from the seed and doc_id alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id.cast("string")), 33)


def mix_sources(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, most: float = 2.0, seed: int = 17, dp_words: int = 50_000) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) for each row of docs; taken is a multiple of size.

    A document's size is its number of words; null, empty and blank texts have 0 and give nothing. A null source is a
    source of its own, the last in order. Equal rows and rows that share a doc_id count one by one; among rows that tie
    in the seeded order it makes no difference which is taken. No document is taken more than ceil(most) times. An empty
    table gives an empty table. Reruns agree: nothing depends on partitions or on the order of rows.
    """
    rows = materialize(docs.select("doc_id", word_count(F.col("text")).alias("size"), "source"), "sizes")
    lengths = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    targets = source_targets(rows, share, weights, most)
    known = lengths.alias("l").join(targets.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source"))).select("l.source", "l.size", "l.n", "t.target")
    # a source's histogram has a row for each distinct length, however many documents there are
    fitted = materialize(known.groupBy("source").applyInPandas(_fit(dp_words, seed), "source string, size long, n long, passes long, extra long"), "fitted")

    j = rows.alias("r").join(fitted.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r.size") == F.col("f.size")))
    u = _seeded(seed, F.col("r.doc_id"))
    shelf = F.floor(u * F.ceil(F.col("f.n") / _RANKED) / F.lit(2**31)).cast("long")
    shelved = j.select("r.doc_id", "r.size", "r.source", "f.n", "f.passes", "f.extra", u.alias("u"), shelf.alias("shelf"))
    torn = shelved.where("extra > 0 and extra < n")
    # how many are taken from each shelf: all before the count is reached, none after it
    each = torn.groupBy("source", "size", "shelf", "extra").agg(F.count("*").alias("here"))
    upto = Window.partitionBy("source", "size").orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("before", F.coalesce(F.sum("here").over(upto), F.lit(0)))
    edge = each.where("before < extra and before + here > extra").select("source", "size", F.col("shelf").alias("edge"), (F.col("extra") - F.col("before")).alias("part"))
    full = each.where("before + here <= extra").groupBy("source", "size").agg(F.max("shelf").alias("full"))
    t, e, g = torn.alias("t"), edge.alias("e"), full.alias("g")
    same = lambda x: F.col("t.source").eqNullSafe(F.col(f"{x}.source")) & (F.col("t.size") == F.col(f"{x}.size"))
    placed = t.join(e, same("e"), "left").join(g, same("g"), "left").select("t.*", "edge", "part", F.coalesce("full", F.lit(-1)).alias("full"))
    on_edge = placed.where("shelf = edge").withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "shelf").orderBy("u", "doc_id"))).withColumn("once", (F.col("rank") <= F.col("part")).cast("long"))
    off_edge = placed.where("edge is null or shelf <> edge").withColumn("once", (F.col("shelf") <= F.col("full")).cast("long"))
    plain = shelved.where("not (extra > 0 and extra < n)").withColumn("once", (F.col("extra") > 0).cast("long"))
    cols = ["doc_id", "size", "source", (F.col("size") * (F.col("passes") + F.col("once"))).alias("taken"), (F.col("passes") + F.col("once")).alias("times")]
    done = plain.select(*cols).unionByName(off_edge.select(*cols)).unionByName(on_edge.select(*cols))
    return done.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.doc_id", "d.size", "d.source", "t.source_size", "t.target", "d.taken", "d.times")
