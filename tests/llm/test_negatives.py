"""Hard negatives against brute force: cover trees alone, and whole tables with ties, copies, odd rows and several blocks."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens.llm import cover_negatives, queries
from loadlens.llm.cover_negatives import CoverTree, mine

SF = "/root/testdata/sf0.001"
ROWS = "vec_id long, label int, v array<double>"


def mined_by_force(rows, every=100, low=80, high=100):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    out = []
    for i, (anchor, label, q) in enumerate(rows):
        if anchor % every:
            continue
        score = [int(sum(a * b for a, b in zip(q, r[2]))) if len(q) == len(r[2]) else None for r in rows]
        order = sorted((j for j in range(len(rows)) if j != i and score[j] is not None), key=lambda j: (-score[j], rows[j][0]))
        for p in [j for j in order if rows[j][1] == label][:5]:
            hard = [j for j in order if rows[j][1] != label and low * score[p] <= 100 * score[j] <= high * score[p]][:5]
            out += [(anchor, rows[p][0], k + 1, rows[n][0], score[p], score[n]) for k, n in enumerate(hard)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def vectors(n, seed=7, dim=6):
    """Clusters, exact copies, ties, zero vectors and very different norms."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(-60, 60, (12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.integers(-9, 9, (n, dim))
    x[: n // 5] = x[0]
    x[n // 5 : n // 4] = 0
    x[n // 4 : n // 3] *= 7
    return [(int(i), int(rng.integers(0, 4)), [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("block", [4096, 40])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cover_negatives, "_BLOCK", block)
    monkeypatch.setattr(cover_negatives, "_TOGETHER", 7)
    monkeypatch.setattr(cover_negatives, "_LEAF", 4)
    if block < 256:
        monkeypatch.setattr(cover_negatives, "_LEAST", block)
    rows = vectors(600)
    assert found(mine(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 10 == 0)) == mined_by_force(rows, 10)
    assert found(mine(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 30 == 0, low=95, high=130)) == mined_by_force(rows, 30, 95, 130)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    want = con.sql(queries.oracle_sql()["op11_hard_negatives"])
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    at = [want.columns.index(n) for n in names]
    assert found(queries.op11_hard_negatives(spark, SF)) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_odd_rows(spark):
    """Nulls in every column, components that are no numbers, other lengths, repeated ids and rows, clashing columns."""
    rows = vectors(60) + [(None, 1, [1.0] * 6), (100, None, [1.0] * 6), (101, 1, None), (102, 1, [None] * 6), (103, 1, [float("nan")] * 6), (104, 1, [float("inf")] * 6), (110, 1, [3.0, 4.0]), (111, 1, [3.0, 4.0]), (112, 2, [3.0, 4.0]), (113, 2, []), (120, 2, []), (114, 1, [])]
    rows += rows[10:14] + [(20, 3, [5.0] * 6)]
    df = spark.createDataFrame(rows, ROWS)
    for c in ("key", "id", "anchor", "block", "together", "cell", "gap", "score", "window", "q"):
        df = df.withColumn(c, F.lit("clash"))
    want = mined_by_force(rows, 10)
    got = found(mine(df, F.col("vec_id") % 10 == 0))
    assert got == want and len(want) > 20


def test_empty(spark):
    empty = spark.createDataFrame([], ROWS)
    assert mine(empty, F.col("vec_id") % 10 == 0).count() == 0
    assert mine(spark.createDataFrame(vectors(20), ROWS), F.lit(False)).count() == 0


def test_descent_opens_few_nodes(monkeypatch):
    """Far clusters are never verified: their nodes' bounds exclude them."""
    for name, value in (("_LEAF", 16), ("_OPENED", 8)):
        monkeypatch.setattr(cover_negatives, name, value)
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (64, 16))
    x = np.concatenate([c + rng.integers(-3, 3, (60, 16)) for c in centres]).astype(float)
    labels, ids = np.arange(len(x)) % 3, np.arange(len(x))
    top = float((x * x).sum(axis=1).max())
    tree, seen = CoverTree.plant(x, labels, top), []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            seen.append(np.size(at))
            return np.asarray(self)[at]

    tree.x = x.view(Watched)
    for k in range(0, len(x), 311):
        seen.clear()
        got = tree.nearest(ids, x[k : k + 1], labels[k : k + 1], True, np.array([k]), [[(-(1 << 62), 1 << 62)]], 5, top)[0][0]
        scores = x @ x[k]
        assert got == [(int(scores[i]), int(i)) for i in np.lexsort((ids, -scores)) if labels[i] == labels[k] and i != k][:5]
        assert sum(seen) < len(x) / 2
