"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most e edits, cut into e+1 pieces, has one piece there unchanged. So pieces are
looked up exactly, all at once, by an Aho-Corasick automaton; around each hit the item is aligned with Myers' bit-parallel
algorithm, which gives the least edit distance to any passage of the window. The pieces form a binary tree in which a run
of k pieces may have k-1 edits. If a run matches within its budget, one of its halves does within its own, so from the
piece that was hit runs are checked upwards, and the whole item only where all runs below it matched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import scratch_path

#: Text of the items that one automaton holds. A larger benchmark is scanned in blocks of about this size.
BLOCK_CHARS = 4_000_000


def normalise(text: str | None) -> str:
    """Lower case, each run of white space one blank, none at the ends."""
    return " ".join((text or "").lower().split())


def pieces_of(item: str, rate: float) -> tuple[int, list[tuple[int, str]]]:
    """The error budget of an item and its budget-plus-one pieces with their offsets."""
    budget = int(len(item) * rate)
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return budget, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def positions(item: str) -> dict[str, int]:
    """For each character, the bits of the places where it stands."""
    eq: dict[str, int] = {}
    for i, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << i
    return eq


def myers(eq: dict[str, int], m: int, window: str, enough: int = 0) -> tuple[int, int]:
    """Least edit distance of an item of m characters (given as positions) to a substring of window, and where the first such
    substring ends; or the first distance found that is not above enough."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(window):
        e = eq.get(c, 0)
        xv = e | mv
        xh = ((((e & pv) + pv) ^ pv) | e) & full
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if best <= enough:
                break
    return best, end


def runs_above(n: int) -> list[list[tuple[int, int]]]:
    """For each of n pieces, the runs of pieces that hold it, from the smallest of two or more up to all but the whole."""
    above: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    todo = [(0, n)]
    while todo:
        i, j = todo.pop()
        if j - i > 1:
            if j - i < n:
                for p in range(i, j):
                    above[p].insert(0, (i, j))
            todo += [(i, (i + j) // 2), ((i + j) // 2, j)]
    return above


@lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[int, str], ...], rate: float):
    import ahocorasick

    found: dict[str, list[tuple[int, int]]] = {}
    known = []
    for k, (_, item) in enumerate(items):
        budget, pieces = pieces_of(item, rate)
        cuts = [at for at, _ in pieces] + [len(item)]
        runs = {r: positions(item[cuts[r[0]] : cuts[r[1]]]) for above in runs_above(len(pieces)) for r in above}
        known.append((budget, cuts, runs_above(len(pieces)), runs, positions(item)))
        for p, (_, piece) in enumerate(pieces):
            found.setdefault(piece, []).append((k, p))
    a = ahocorasick.Automaton()
    for piece, places in found.items():
        a.add_word(piece, (len(piece), places))
    a.make_automaton()
    return a, known


@lru_cache(maxsize=2)
def _items(path: str) -> tuple[tuple[int, str], ...]:
    """The items of a block, from the shared folder, in order; blank ones are left out."""
    system, inside = pafs.FileSystem.from_uri(path)
    rows = pads.dataset(inside, filesystem=system, format="parquet").to_table(columns=["item_id", "text"]).to_pylist()
    return tuple(sorted({(r["item_id"], t) for r in rows if (t := normalise(r["text"]))}, key=lambda x: (x[0] is not None, x[0] or 0, x[1])))


def matches(text: str, items: tuple[tuple[int, str], ...], rate: float, whole_words: int = 0) -> Iterator[tuple[int, int, int]]:
    """(item number, edit distance, end in the normalised text) of each item that text holds within its budget. Items of
    fewer than whole_words code points only count unedited, between blanks."""
    automaton, known = _automaton(items, rate)
    text = normalise(text)
    starts: dict[int, set[int]] = {}
    for end, (length, places) in automaton.iter(text):
        for k, p in places:
            _, cuts, above, runs, _ = known[k]
            start = end - length + 1 - cuts[p]
            for i, j in above[p]:
                slack = j - i - 1
                window = text[max(0, start + cuts[i] - slack) : max(0, start + cuts[j] + slack)]
                if myers(runs[i, j], cuts[j] - cuts[i], window, slack)[0] > slack:
                    break
            else:
                starts.setdefault(k, set()).add(start)
    for k, at in starts.items():
        item, (e, _, _, _, eq) = items[k][1], known[k]
        m, best = len(item), None
        e = 0 if m < whole_words else e
        for start in at:
            if start >= 0 and text.startswith(item, start):
                stop = start + m
                if m >= whole_words or (start == 0 or text[start - 1] == " ") and (stop == len(text) or text[stop] == " "):
                    best = (0, stop) if best is None else min(best, (0, stop))
        if best is None and e:
            # starts that lie close share a window
            lo = hi = None
            for start in [*sorted(at), None]:
                if lo is not None and (start is None or start > hi + e):
                    a = max(0, lo - e)
                    d, stop = myers(eq, m, text[a : max(0, hi + m + e)])
                    if d <= e and (best is None or d < best[0]):
                        best = (d, a + stop)
                    lo = None
                if start is not None:
                    lo, hi = (start if lo is None else lo), start
        if best is not None:
            yield k, *best


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, whole_words: int = 0) -> DataFrame:
    """(doc_id, item_id, distance, end) for each document and each benchmark item that it holds, whole texts searched.

    docs has doc_id and text, benchmark item_id and text. Case and runs of white space do not count. An item of n code
    points may have floor(n*rate) edits, whatever its length; with whole_words, items of fewer code points only count
    unedited and between blanks. end is the offset after the best passage in the normalised text. Null and empty texts and
    items match nothing; a null id is kept as null. Rows that share ids give one row, the nearest. Items lie in blocks of
    bounded size in the shared folder, from which workers read the block at hand; each block scans the documents once, so
    the benchmark may have any length and never passes through the driver. Empty tables give an empty table; other columns
    are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n_chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-n_chars // BLOCK_CHARS)
    schema = docs.select("doc_id").schema.add("item_id", "long").add("distance", "integer").add("end", "long")
    root = scratch_path(spark, "items")
    items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))).repartition("block").write.partitionBy("block").parquet(root)

    def of(path: str):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chosen = _items(path)
            for batch in batches:
                rows = [(i, chosen[k][0], d, end) for i, t in enumerate(batch.column(1)) if t.is_valid for k, d, end in matches(t.as_py(), chosen, rate, whole_words)]
                if rows:
                    at, item, d, end = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(item, pa.int64()), pa.array(d, pa.int32()), pa.array(end, pa.int64())], names=schema.fieldNames())

        return docs.select("doc_id", "text").mapInArrow(scan, schema)

    out = spark.createDataFrame([], schema)
    # a block is empty only where hashes leave it so
    for block in sorted(r.block for r in spark.read.parquet(root).select("block").distinct().collect()) if blocks else []:
        out = out.unionByName(of(f"{root}/block={block}"))
    best = F.min(F.struct("distance", "end")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.distance", "best.end")
