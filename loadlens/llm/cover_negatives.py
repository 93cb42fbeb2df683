"""Hard negatives by inner product, with cover trees over norm-augmented candidates.

A candidate x gets one more component, sqrt(M - |x|^2) with M the largest squared norm, and an anchor q gets a 0 there. Then
|q' - x'|^2 = |q|^2 + M - 2 q.x, so that the largest inner products are the nearest neighbours, and a node of a tree, whose
centre has distance D and whose members lie within r of it, bounds their inner products from both sides by D - r and D + r.

The upper levels are shared: candidates belong to the nearest of a few pivots and, sorted by their distance from it, are cut
into blocks of bounded size, shells with a least and a largest radius. Each block holds a cover tree, whose levels halve the
covering radius. Anchors travel, a few dozen of a block at a time, to the blocks whose shells may hold what they look for. There
a best-first descent opens the nodes with the highest bounds, skips those outside of all windows of the anchor or below
what it has found, and verifies the members of leaves exactly.

First the positives are found, with what an anchor's own block holds as a bound. They give the windows of the negatives.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.llm.common import materialize, small_batches

#: Vectors that choose the pivots, and the most pivots. They decide the order of the work and no result.
PIVOT_SAMPLE, _PIVOTS = 10_000, 64
#: Most vectors and bytes of a block, which has _LEAST vectors of any length; members of a leaf, children of a node, and nodes
#: that are opened at once.
_BLOCK, _BLOCK_BYTES, _LEAST, _LEAF, _FANOUT, _OPENED = 4096, 16_000_000, 256, 64, 16, 64
#: Anchors that travel together; bits of a row's place inside its block.
_TOGETHER, _PLACE_BITS = 64, 20
_ANY = 1 << 62


def _farthest_first(x: np.ndarray, extra: np.ndarray, most: int, reach: float, first: int = 0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres until all rows are within reach of one, or most of them; each row's nearest centre and the distance to it."""
    centres, owner = [first], np.zeros(len(x), np.int64)
    gap = _distances(x, extra, first)
    while len(centres) < most and (far := int(gap.argmax())) is not None and gap[far] > reach:
        new = _distances(x, extra, far)
        owner[new < gap] = len(centres)
        gap = np.minimum(gap, new)
        centres.append(far)
    return centres, owner, gap


def _distances(x: np.ndarray, extra: np.ndarray, i: int) -> np.ndarray:
    d = x - x[i]
    return np.sqrt(np.einsum("ij,ij->i", d, d) + (extra - extra[i]) ** 2)


@dataclass
class CoverTree:
    """Nodes in arrays; the members of node k are order[start[k]:stop[k]], its children are first[k] to last[k] (none: a leaf)."""

    x: np.ndarray
    labels: np.ndarray
    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    last: np.ndarray
    least: np.ndarray
    most: np.ndarray

    @classmethod
    def plant(cls, x: np.ndarray, labels: np.ndarray, top: float) -> CoverTree:
        """The tree of the rows of x; top is the largest squared norm of all candidates. A child's members lie within half of
        its parent's radius, or in the nearest of _FANOUT centres where that takes more."""
        extra = np.sqrt(np.maximum(0.0, top - np.einsum("ij,ij->i", x, x)))
        order = np.arange(len(x))
        nodes: list[list] = [[0, float(_distances(x, extra, 0).max()) if len(x) else 0.0, 0, len(x), 0, 0]]
        k = 0
        while k < len(nodes):
            centre, radius, start, stop, _, _ = nodes[k]
            if stop - start > _LEAF and radius > 0:
                members = order[start:stop].copy()
                at = int(np.flatnonzero(members == centre)[0])
                centres, owner, gap = _farthest_first(x[members], extra[members], _FANOUT, radius / 2, at)
                order[start:stop] = members[np.argsort(owner, kind="stable")]
                nodes[k][4] = len(nodes)
                begin = start
                for c, i in enumerate(centres):
                    mine = owner == c
                    nodes.append([int(members[i]), float(gap[mine].max()), begin, begin := begin + int(mine.sum()), 0, 0])
                nodes[k][5] = len(nodes)
            k += 1
        centre, radius, start, stop, first, last = (np.array(c) for c in zip(*nodes, strict=True))
        sorted_ = labels[order] if len(order) else np.zeros(1, np.int64)
        spans = [sorted_[a:b] if b > a else sorted_[:1] for a, b in zip(start, stop, strict=True)]
        return cls(x, labels, order, centre, radius * (1 + 1e-9) + 1e-6, start, stop, first, last, np.array([s.min() for s in spans]), np.array([s.max() for s in spans]))

    def nearest(self, ids: np.ndarray, q: np.ndarray, label: np.ndarray, same: bool, own: np.ndarray, windows: list[list[tuple[int, int]]], count: int, top: float) -> list[list[list[tuple[int, int]]]]:
        """For each anchor, a row of q, and each of its windows (low, high): the first count (score, id) with a score in it, by
        falling score, then id, among the rows that have the anchor's label (same) or another; own is a row that is left out,
        or -1. The anchors descend together, each node as long as one of them wants it."""
        wide = max(map(len, windows), default=0)
        found: list[list[list[tuple[int, int]]]] = [[[] for _ in w] for w in windows]
        low, high = np.full((wide, len(q)), np.inf), np.full((wide, len(q)), -np.inf)
        for a, ws in enumerate(windows):
            for w, (least, most) in enumerate(ws):
                low[w, a], high[w, a] = least, most
        floor = low.copy()  # no lower score is wanted any more
        sum_ = np.einsum("ij,ij->i", q, q) + top
        slack = 0.5 + 1e-9 * sum_  # scores are whole numbers

        def wanted(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Whether some anchor wants a node, and the highest bound among those that do."""
            d, r = np.sqrt(np.maximum(0.0, sum_ - 2 * (self.x[self.centre[nodes]] @ q.T))), self.radius[nodes][:, None]
            upper, lower = (sum_ - np.maximum(0.0, d - r) ** 2) / 2 + slack, (sum_ - (d + r) ** 2) / 2 - slack
            least, most = self.least[nodes][:, None], self.most[nodes][:, None]
            fits = np.zeros(upper.shape, bool)
            for w in range(wide):
                fits |= (upper >= floor[w]) & (lower <= high[w])
            fits &= (least <= label) & (label <= most) if same else (least != label) | (most != label)
            return fits.any(axis=1), np.where(fits, upper, -np.inf).max(axis=1, initial=-np.inf)

        def offer(nodes: np.ndarray) -> None:
            some, upper = wanted(nodes)
            for i in np.flatnonzero(some):
                heapq.heappush(heap, (-upper[i], int(nodes[i])))

        def verify(rows: np.ndarray) -> None:
            scores = self.x[rows] @ q.T
            fit = ((self.labels[rows][:, None] == label) == same) & (rows[:, None] != own)
            for w in range(wide):
                r, a = np.nonzero(fit & (scores >= floor[w]) & (scores <= high[w]))
                if not len(r):
                    continue
                hit, name = scores[r, a], ids[rows[r]]
                order = np.lexsort((name, -hit, a))
                a, hit, name = a[order], hit[order], name[order]
                begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                for i, j in zip(begin, np.append(begin[1:], len(a)), strict=True):
                    k, j = int(a[i]), min(j, i + count)
                    best = sorted([*found[k][w], *zip(hit[i:j].astype(np.int64).tolist(), name[i:j].tolist(), strict=True)], key=lambda f: (-f[0], f[1]))[:count]
                    found[k][w] = best
                    if len(best) == count:
                        floor[w, k] = max(floor[w, k], best[-1][0])

        heap: list[tuple[float, int]] = []
        offer(np.zeros(1, np.int64))
        while heap:
            at = np.array([heapq.heappop(heap)[1] for _ in range(min(_OPENED, len(heap)))])
            at = at[wanted(at)[0]]  # found since they were offered
            leaves, inner = at[self.first[at] == 0], at[self.first[at] > 0]
            if len(leaves):
                verify(np.concatenate([self.order[i:j] for i, j in zip(self.start[leaves], self.stop[leaves], strict=True)]))
            if len(inner):
                offer(np.concatenate([np.arange(i, j) for i, j in zip(self.first[inner], self.last[inner], strict=True)]))
        return found


def _matrix(column, n: int) -> np.ndarray:
    return np.asarray(column.flatten() if hasattr(column, "flatten") else column, np.float64).reshape(n, -1)


def _cells(pivots: np.ndarray, extra: np.ndarray, top: float):
    """Rows with their cell, the nearest pivot's, and their distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(3), batch.num_rows)
                rest = np.sqrt(np.maximum(0.0, top - np.einsum("ij,ij->i", x, x)))
                gap = np.stack([np.sqrt(((x - p) ** 2).sum(axis=1) + (rest - e) ** 2) for p, e in zip(pivots, extra, strict=True)], axis=1)
                cell = gap.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(gap[np.arange(len(cell)), cell])], names=["vec_id", "label", "anchor", "v", "cell", "gap"])

    return run


def _blocks(size: int, dim: int):
    """One row per block: up to size consecutive rows of a cell, packed."""

    def pack(number: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        x = np.asarray(t["v"].combine_chunks().flatten(), np.float64)
        single = x.astype(np.float32)
        short = bool((single.astype(np.float64) == x).all())
        packed = lambda name, kind: np.asarray(t[name], kind).tobytes()
        return pa.RecordBatch.from_pydict({
            "block": pa.array([(TaskContext.get().partitionId() << 24) + number], pa.int64()), "cell": pa.array([t["cell"][0].as_py()], pa.int32()), "n": pa.array([t.num_rows], pa.int64()),
            "near": [min(t["gap"].to_pylist())], "far": [max(t["gap"].to_pylist())], "ids": [packed("vec_id", np.int64)], "labels": [packed("label", np.int64)], "anchors": [packed("anchor", np.uint8)], "short": [short], "x": [(single if short else x).tobytes()],
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, cell, number = [], 0, None, 0
        for batch in batches:
            cells = np.asarray(batch.column(4))
            edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(edges, edges[1:], strict=False):
                while a < b:
                    if held and (cells[a] != cell or n == size):
                        yield pack(number, held)
                        held, n, number = [], 0, number + 1
                    cell, take = cells[a], min(b - a, size - n)
                    held.append(batch.slice(a, take))
                    n, a = n + take, a + take
        if held:
            yield pack(number, held)

    return run


def _open(row: dict, dim: int, top: float) -> tuple[np.ndarray, CoverTree]:
    ids = np.frombuffer(row["ids"], np.int64)
    x = np.frombuffer(row["x"], np.float32 if row["short"] else np.float64).astype(np.float64).reshape(len(ids), dim)
    return ids, CoverTree.plant(x, np.frombuffer(row["labels"], np.int64), top)


def _anchors(pivots: np.ndarray, dim: int, top: float, count: int):
    """(key, together, anchor_id, label, q, gaps, low) for the anchors of a block: their distances from the pivots, and the score of
    the last positive that the block itself gives, if it gives enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(row["anchors"], np.uint8))
                if not len(at):
                    continue
                ids, tree = _open(row, dim, top)
                q = tree.x[at]
                gaps = np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", q, q)[:, None] + top - 2 * q @ pivots.T))
                own = []
                for i in range(0, len(at), _TOGETHER):
                    some = at[i : i + _TOGETHER]
                    own += [f[0] for f in tree.nearest(ids, tree.x[some], tree.labels[some], True, some, [[(-_ANY, _ANY)]] * len(some), count, top)]
                key = (row["block"] << _PLACE_BITS) + at
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(key), "together": pa.array((row["block"] << _PLACE_BITS) + np.arange(len(at)) // _TOGETHER), "anchor_id": pa.array(ids[at]), "label": pa.array(tree.labels[at]), "q": list(q), "gaps": list(gaps),
                    "low": pa.array([f[-1][0] if len(f) == count else -_ANY for f in own], pa.int64()),
                })

    return run


def _search(dim: int, top: float, same: bool, count: int):
    """(key, window, id, score) from rows sorted by block, the block itself before the anchors that come to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, tree = None, None, None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["who"] is None:
                    block, (ids, tree) = row["block"], _open(row, dim, top)
                    continue
                who = row["who"]
                own = np.array([a["key"] & ((1 << _PLACE_BITS) - 1) if a["key"] >> _PLACE_BITS == block else -1 for a in who])
                windows = [[(w["low"], w["high"]) for w in a["windows"]] for a in who]
                found = tree.nearest(ids, np.array([a["q"] for a in who], np.float64), np.array([a["label"] for a in who]), same, own, windows, count, top)
                out += [(a["key"], w["window"], id_, score) for a, fs in zip(who, found, strict=True) for w, f in zip(a["windows"], fs, strict=True) for score, id_ in f]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["key", "window", "id", "score"])

    return run


def _found(blocks: DataFrame, seekers: DataFrame, dim: int, top: float, same: bool, count: int) -> DataFrame:
    """(key, window, place, id, score): the first count of each window of each seeker (key, together, label, q, gaps, windows)."""
    spark = blocks.sparkSession
    low = F.array_min(F.transform("windows", lambda w: w["low"]))
    high = F.array_max(F.transform("windows", lambda w: w["high"]))
    square = F.aggregate("q", F.lit(0.0), lambda s, v: s + v * v)
    apart = seekers.select("together", square.alias("qq"), low.alias("low"), high.alias("high"), F.posexplode("gaps").alias("cell", "gap"))
    apart = apart.groupBy("together", "cell").agg(F.min("gap").alias("from"), F.max("gap").alias("to"), F.max("qq").alias("most"), F.min("qq").alias("least"), F.min("low").alias("low"), F.max("high").alias("high"))
    # the shell of a block bounds the distances of its members, and so their inner products
    between = F.greatest(F.lit(0.0), F.col("from") - F.col("far"), F.col("near") - F.col("to")) * (1 - 1e-9)
    across = (F.col("to") + F.col("far")) * (1 + 1e-9)
    meets = ((F.col("most") + top - between * between) / 2 + 1 >= F.col("low")) & ((F.col("least") + top - across * across) / 2 - 1 <= F.col("high"))
    seats = apart.join(blocks.select("block", "cell", "near", "far"), "cell").where(meets).select("together", "block")
    who = seekers.groupBy("together").agg(F.collect_list(F.struct("key", "label", "q", "windows")).alias("who"))  # at most _TOGETHER
    none = lambda name: F.lit(None).cast(blocks.schema[name].dataType).alias(name)
    coming = seats.join(who, "together").select("block", *(none(n) for n in ("ids", "labels", "short", "x")), "who")
    here = blocks.select("block", "ids", "labels", "short", "x", F.lit(None).cast(coming.schema["who"].dataType).alias("who"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = here.unionByName(coming).repartition(parts, "block").sortWithinPartitions("block", F.col("who").isNotNull())
    found = dealt.mapInArrow(_search(dim, top, same, count), "key long, window int, id long, score long")
    with small_batches(spark):
        found = materialize(found, "found")
    place = F.row_number().over(Window.partitionBy("key", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= count)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors: (vec_id long, label, v array of whole numbers); the rows for which anchor holds are anchors, and candidates too. A
    score is the inner product, exact while it stays below 2^53. An anchor's positives are its first rows of the same label,
    itself left out; each positive's negatives are the first rows of other labels whose scores are from low to high per cent
    of the positive's. Higher scores come first, ties by smaller vec_id. Fewer where there are fewer; anchors without positives
    and positives without negatives give no rows. Rows with a null in vec_id, label or v take no part; vectors only meet others
    of their length. Rows that share a vec_id are rows of their own; other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("v").cast("array<double>").alias("v"))
    rows = materialize(rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & whole), "candidates")
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("top")).collect()
    out = None
    for s in sorted(sizes):
        own = rows.where(F.size("v") == s.dim)
        own = own if s.dim else own.withColumn("v", F.array(F.lit(0.0)))
        part = _mine(own, max(s.dim, 1), s.n, s.top, positives, negatives, low, high)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _mine(rows: DataFrame, dim: int, n: int, top: float, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    size = max(_LEAST, min(_BLOCK, _BLOCK_BYTES // (8 * max(dim, 1))))
    sample = rows if n <= PIVOT_SAMPLE else rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < math.ceil(1_000_000 * PIVOT_SAMPLE / n))
    some = np.array([r.v for r in sample.select("v").limit(2 * PIVOT_SAMPLE).collect()] or [[0.0] * dim], np.float64)
    rest = np.sqrt(np.maximum(0.0, top - np.einsum("ij,ij->i", some, some)))
    chosen, _, _ = _farthest_first(some, rest, min(_PIVOTS, -(-n // size)), 0.0)
    pivots, extra = some[chosen], rest[chosen]
    placed = rows.select("vec_id", "label", "anchor", "v").mapInArrow(_cells(pivots, extra, top), "vec_id long, label long, anchor boolean, v array<double>, cell int, gap double")
    ordered = placed.repartitionByRange(max(1, -(-n // (2 * size))), "cell", "gap", "vec_id").sortWithinPartitions("cell", "gap", "vec_id")
    blocks = materialize(ordered.mapInArrow(_blocks(size, dim), "block long, cell int, n long, near double, far double, ids binary, labels binary, anchors binary, short boolean, x binary"), "cover-blocks")
    with small_batches(spark):
        anchors = materialize(blocks.mapInArrow(_anchors(pivots, dim, top, positives), "key long, together long, anchor_id long, label long, q array<double>, gaps array<double>, low long"), "anchors")
    seekers = anchors.withColumn("windows", F.array(F.struct(F.lit(0).alias("window"), F.col("low"), F.lit(_ANY).alias("high"))))
    near = materialize(_found(blocks, seekers, dim, top, True, positives).select("key", F.col("place").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 100 * score >= low * positive and <= high * positive, in whole numbers
    bound = lambda percent, up: F.expr(f"({'-' if up else ''}((({'-' if up else ''}{percent}) * positive_score) - pmod(({'-' if up else ''}{percent}) * positive_score, 100L)) div 100L)")
    windows = near.withColumn("low", bound(low, True)).withColumn("high", bound(high, False)).where("low <= high")
    windows = windows.groupBy("key").agg(F.collect_list(F.struct("window", "low", "high")).alias("windows"))  # at most as many as positives
    hard = _found(blocks, anchors.drop("low").join(windows, "key"), dim, top, False, negatives)
    named = near.join(anchors.select("key", "anchor_id"), "key")
    return hard.join(named, ["key", "window"]).select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
