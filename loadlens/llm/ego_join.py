"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors are projected on their leading principal dimensions, cut into cells as wide as the distance threshold, and
sorted by cell. The sorted sequence is cut into blocks with bounding boxes. Projection shortens distances, so two blocks,
or two intervals of blocks, whose boxes lie further apart than the threshold hold no link and are skipped. The rest are
halved recursively down to small intervals, which are compared by matrix products in double precision.

Runs of blocks are hosts. A host's vectors travel once, to one task; to it come the blocks that lie near one of its own,
of half of the other hosts, the other half having it as a guest. So a vector travels at most half as often as there are
hosts, whose number is fixed until they are full, and not at all where boxes tell hosts apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens.llm.common import materialize
from loadlens.llm.graph import components

#: Vectors used to find the principal dimensions. They decide the order of the work and no result.
PCA_SAMPLE = 10_000
_LEAF = 256
#: Hosts that are wanted, and the least and most vectors of one: as many as fit 32 MB in double precision.
_HOSTS, _HOST_LEAST, _HOST_BYTES = 24, 512, 32_000_000
#: Bytes of guests that a task reads at once.
_BATCH_BYTES, _BATCH_CONF = 16_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


def principal(sample: np.ndarray, dims: int) -> np.ndarray:
    """Columns: the leading principal directions of unit vectors."""
    centred = sample - sample.mean(axis=0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    return np.ascontiguousarray(vectors[:, ::-1][:, :dims])


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _cells(axes: np.ndarray, eps: float):
    """The vectors with their cells on the principal dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(2).flatten(), np.float64).reshape(batch.num_rows, -1)
            cells = np.floor(_unit(x) @ axes / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in cells.T)], names=["cls", "copies", "v", *(f"c{i}" for i in range(cells.shape[1]))])

    return run


def _blocks(axes: np.ndarray, size: int):
    """One row per block of the sorted sequence: its vectors, packed, and its bounding box."""

    def pack(number: int, ids: list, copies: list, vectors: list) -> pa.RecordBatch:
        x = np.asarray(vectors, np.float64)
        z = _unit(x) @ axes
        with np.errstate(over="ignore", under="ignore"):
            single = x.astype(np.float32)
        short = bool((single.astype(np.float64) == x).all())  # single precision holds all of them exactly
        return pa.RecordBatch.from_pydict({
            "block": [(TaskContext.get().partitionId() << 32) + number], "n": pa.array([len(ids)], pa.int64()), "lo": [z.min(axis=0)], "hi": [z.max(axis=0)],
            "ids": pa.array([ids], pa.list_(pa.int64())), "copies": pa.array([copies], pa.list_(pa.int64())), "short": [short], "x": [(single if short else x).tobytes()],
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, copies, vectors, number = [], [], [], 0
        for batch in batches:
            ids += batch.column(0).to_pylist()
            copies += batch.column(1).to_pylist()
            vectors += list(np.asarray(batch.column(2).flatten(), np.float64).reshape(batch.num_rows, -1)) if batch.num_rows else []
            while len(ids) >= size:
                yield pack(number, ids[:size], copies[:size], vectors[:size])
                ids, copies, vectors, number = ids[size:], copies[size:], vectors[size:], number + 1
        if ids:
            yield pack(number, ids, copies, vectors)

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def join_blocks(u: np.ndarray, v: np.ndarray | None, zu: np.ndarray, zv: np.ndarray | None, copies_u: np.ndarray, copies_v: np.ndarray | None, cosine: float, eps: float):
    """Links between the unit vectors u and v, or within u if v is None: copies linked to each row, and a spanning forest
    of (row, row) edges in which rows of v follow those of u."""
    same = v is None
    v, zv, copies_v = (u, zu, copies_u) if same else (v, zv, copies_v)
    shift = 0 if same else len(u)
    links = np.zeros(len(u) + (0 if same else len(v)), np.int64)
    forest = _Forest(len(links))
    todo = [(0, len(u), 0, len(v))]
    while todo:
        a, b, c, d = todo.pop()
        if same and c < a:
            continue
        gap = np.maximum(0, np.maximum(zu[a:b].min(axis=0) - zv[c:d].max(axis=0), zv[c:d].min(axis=0) - zu[a:b].max(axis=0)))
        if gap @ gap > eps * eps:
            continue
        if max(b - a, d - c) > _LEAF:
            m, n = (a + b) // 2, (c + d) // 2
            rows = [(a, b)] if b - a <= _LEAF else [(a, m), (m, b)]
            cols = [(c, d)] if d - c <= _LEAF else [(c, n), (n, d)]
            todo += [(*r, *k) for r in rows for k in cols]
            continue
        hit = u[a:b] @ v[c:d].T >= cosine
        if same and a == c:
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        links[a:b] += hit @ copies_v[c:d]
        if not (same and a == c):
            links[shift + c : shift + d] += hit.T @ copies_u[a:b]
        row, col = np.arange(a, b), np.arange(shift + c, shift + d)
        before = None
        far = len(links)
        while before is None or (before != row).any():  # smallest label along the hits of this leaf
            before = row
            col = np.minimum(col, np.where(hit, row[:, None], far).min(axis=0))
            row = np.minimum(row, np.where(hit, col[None, :], far).min(axis=1))
        for i in np.flatnonzero(row != np.arange(a, b)):
            forest.join(a + int(i), int(row[i]))
        for j in np.flatnonzero(col != np.arange(shift + c, shift + d)):
            forest.join(shift + c + int(j), int(col[j]))
    return links, [(i, r) for i in range(len(links)) if (r := forest.root(i)) != i]


def _compare(axes: np.ndarray, cosine: float, eps: float):
    """(a, b, links) from blocks sorted by host, its own first: a's links, b being null, and edges between a and b."""
    dim = len(axes)

    def stacked(batch: pa.RecordBatch, at: list[int]):
        col = {n: batch.column(batch.schema.get_field_index(n)) for n in ("ids", "copies", "short", "x")}
        x = [np.frombuffer(col["x"][i].as_buffer(), np.float32 if col["short"][i].as_py() else np.float64).reshape(-1, dim).astype(np.float64) for i in at]
        unit = _unit(np.concatenate(x))
        return tuple(np.concatenate([np.asarray(col[n][i].values, np.int64) for i in at]) for n in ("ids", "copies")) + (unit, unit @ axes)

    def found(names: np.ndarray, links: np.ndarray, edges: list) -> Iterator[pa.RecordBatch]:
        at, e = np.flatnonzero(links), np.array(edges, np.int64).reshape(-1, 2)
        if len(at):
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(names[at]), pa.array(names[e[:, 0]])]), pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(names[e[:, 1]])]),
                pa.concat_arrays([pa.array(links[at]), pa.nulls(len(e), pa.int64())]),
            ], names=["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, own = None, []
        for batch in batches:
            hosts, guests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            i = 0
            while i < len(hosts):
                j = i
                while j < len(hosts) and (hosts[j], guests[j]) == (hosts[i], guests[i]):
                    j += 1
                if hosts[i] != host:
                    host, own = hosts[i], []
                part = stacked(batch, list(range(i, j)))
                for mine in own:  # own blocks come in one batch, or in a few of bounded size
                    yield from found(np.concatenate([mine[0], part[0]]), *join_blocks(mine[2], part[2], mine[3], part[3], mine[1], part[1], cosine, eps))
                if not guests[i]:
                    yield from found(part[0], *join_blocks(part[2], None, part[3], None, part[1], None, cosine, eps))
                    own.append(part)
                i = j

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95, block: int = 512, dims: int = 8, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Two vectors link when their cosine, in double precision, is at least the threshold. n_links counts the other vectors
    linked directly, exact copies included; component_id is the smallest vec_id reachable by links and kept says whether
    it is the vector's own. Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    and so do vectors of different length and those with a null vec_id. Rows are never merged. Rows that share a vec_id
    count as vectors of their own but form one vertex. Other columns are ignored; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = base.select("vec_id", F.when(F.col("vec_id").isNotNull() & fine, F.col("v")).alias("v"))
    # equal vectors are one class, named by its smallest vec_id, so that copies of a vector never meet each other
    rows = rows.withColumn("h", F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256))
    classes = rows.where("v is not null").groupBy("h").agg(F.min("vec_id").alias("cls"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("dim", F.size("v")), "classes")
    found = None
    for dim in sorted(r.dim for r in classes.select("dim").distinct().collect()):
        part = _bounded_batches(spark, lambda dim=dim: _join(classes.where(F.col("dim") == dim), cosine, block, min(dims, dim)))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, links long")
    found = materialize(found, "links")
    n_links = found.where("links is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    # classes that share a name (a vec_id on several rows) are one vertex, and so are the rows of a class
    member = rows.join(classes.select("h", "cls", "copies"), "h", "left").select("vec_id", "h", "cls", "copies")
    edges = found.where("b is not null").select("a", "b").unionByName(member.where("vec_id <> cls").select(F.col("vec_id").alias("a"), F.col("cls").alias("b")))
    label = components(edges)
    out = member.join(n_links, "cls", "left").join(label.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    links = F.when(F.col("copies").isNull(), 0).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long")
    return out.select("vec_id", links.alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _bounded_batches(spark: SparkSession, work: Callable[[], DataFrame]) -> DataFrame:
    """work(), which runs its jobs, while what is handed to Python at once is bounded in bytes, as blocks are large rows."""
    before = spark.conf.get(_BATCH_CONF, None)
    spark.conf.set(_BATCH_CONF, _BATCH_BYTES)
    try:
        return work()
    finally:
        spark.conf.unset(_BATCH_CONF) if before is None else spark.conf.set(_BATCH_CONF, before)


def _join(classes: DataFrame, cosine: float, block: int, dims: int) -> DataFrame:
    n = classes.count()
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-9
    sample = classes if n <= PCA_SAMPLE else classes.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < int(1_000_000 * PCA_SAMPLE / n))
    axes = principal(_unit(np.array([r.v for r in sample.select("v").limit(2 * PCA_SAMPLE).collect()], np.float64)), dims)
    names = [f"c{i}" for i in range(dims)]
    placed = classes.select("cls", "copies", "v").mapInArrow(_cells(axes, eps), "cls long, copies long, v array<double>, " + ", ".join(f"{c} int" for c in names))
    parts = max(1, -(-n // (4 * block)))
    ordered = placed.repartitionByRange(parts, *names, "cls").sortWithinPartitions(*names, "cls").select("cls", "copies", "v")
    blocks = materialize(ordered.mapInArrow(_blocks(axes, block), "block long, n long, lo array<double>, hi array<double>, ids array<long>, copies array<long>, short boolean, x binary"), "blocks")
    size = min(max(-(-n // _HOSTS), _HOST_LEAST), max(_HOST_BYTES // (8 * len(axes)), block))
    # a row for each block passes through this window, without its vectors
    upto = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    box = materialize(blocks.select("block", F.floor((upto - F.col("n")) / size).alias("host"), "lo", "hi"), "boxes")
    hosts = box.agg(F.max("host")).first()[0]
    hosts = 1 if hosts is None else hosts + 1

    # hosts and blocks meet where their intervals on the first two dimensions come within one cell
    d = min(2, dims)
    cells = [f"s{i}" for i in range(d)]

    def celled(more: int, *columns: str) -> DataFrame:
        out = box
        for i, c in enumerate(cells):
            at = lambda side: F.floor(F.col(side)[i] / eps).cast("long")  # noqa: B023, E731
            out = out.withColumn(c, F.explode(F.sequence(at("lo") - more, at("hi") + more)))
        return out.select(*columns, *cells).distinct()

    p, q = celled(0, "host").alias("p"), celled(1, "host", "block").alias("q")
    # of two hosts the one that the other follows within half the round takes the other's blocks as guests
    ahead = F.pmod(F.col("q.host") - F.col("p.host"), F.lit(hosts))
    takes = (ahead > 0) & ((2 * ahead < hosts) | ((2 * ahead == hosts) & (F.col("p.host") < F.col("q.host"))))
    met = p.join(q, cells).where(takes).select(F.col("p.host").alias("taker"), F.col("q.block").alias("block")).distinct()
    # a host has a bounded number of blocks
    boxes = box.groupBy(F.col("host").alias("taker")).agg(F.collect_list(F.struct("lo", "hi")).alias("boxes"))
    gap = lambda b: F.zip_with(F.zip_with(F.col("lo"), b["hi"], lambda x, y: x - y), F.zip_with(b["lo"], F.col("hi"), lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = lambda b: F.aggregate(gap(b), F.lit(0.0), lambda s, x: s + x * x) <= eps * eps
    guests = met.join(box.select("block", "lo", "hi"), "block").join(boxes, "taker").where(F.exists("boxes", near)).select(F.col("taker").alias("host"), F.lit(True).alias("guest"), "block")
    seats = materialize(box.select("host", F.lit(False).alias("guest"), "block").unionByName(guests), "seats")
    sent = seats.join(blocks.select("block", "ids", "copies", "short", "x"), "block").select("host", "guest", "block", "ids", "copies", "short", "x")
    sent = sent.repartition(max(1, hosts), "host").sortWithinPartitions("host", "guest", "block")
    return materialize(sent.mapInArrow(_compare(axes, cosine, eps), "a long, b long, links long"), "found")
