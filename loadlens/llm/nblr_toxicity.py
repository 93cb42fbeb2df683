"""Toxicity by a character n-gram linear classifier on naive Bayes log-count ratios.

The text's distinct character n-grams are hashed to buckets. Counting documents by bucket and label gives each bucket its
naive Bayes log-count ratio; a logistic regression is trained on the binary features scaled by those ratios.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import discard, materialize

_BITS = 18
_MULTIPLIERS = {3: 0x9E3779B97F4A7C15, 4: 0xD6E8FEB86659FD93, 5: 0xA24BAED4963EE407, 6: 0xC2B2AE3D27D4EB4F}
#: Bytes of a text that are hashed at once; the pieces overlap, so that no n-gram is missed.
_PIECE = 1 << 20


@dataclass(frozen=True)
class ToxicityModel:
    """Weights by bucket (already times the log-count ratio), the intercept and the n-gram lengths."""

    weights: np.ndarray
    intercept: float
    orders: tuple[int, ...]


def _grams(text: str | None, orders: tuple[int, ...], keep: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a text's byte n-grams, lower-cased and with a blank at either end; only those in keep, if given."""
    data = b" " + (text or "").encode("utf-8", "surrogatepass").lower() + b" "
    found = []
    for start in range(0, len(data), _PIECE):
        b = np.frombuffer(data[start : start + _PIECE + max(orders) - 1], np.uint8).astype(np.uint64)
        for n in orders:
            if len(b) < n:
                continue
            g = b[: len(b) - n + 1].copy()
            for i in range(1, n):
                g = (g << np.uint64(8)) | b[i : len(b) - n + 1 + i]
            at = ((g * np.uint64(_MULTIPLIERS[n])) >> np.uint64(64 - _BITS)).astype(np.int32)
            found.append(np.unique(at[keep[at]] if keep is not None else at))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)


def _count(orders: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << _BITS), np.int64)
        with np.errstate(over="ignore"):
            for batch in batches:
                for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    seen[label, _grams(text.as_py(), orders)] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["bucket", "clean", "toxic"])

    return run


def _features(orders: tuple[int, ...], keep: np.ndarray, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                out = [np.sort(rank[_grams(t.as_py(), orders, keep)]) for t in batch.column(0)]
                yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.float64()), pa.array(out, pa.list_(pa.int32()))], names=["label", "at"])

    return run


def train(docs: DataFrame, labels: DataFrame, orders: tuple[int, ...] = (4, 6), max_rows: int = 20_000, max_features: int = 20_000, alpha: float = 1.0, reg: float = 1e-4, seed: int = 11) -> ToxicityModel:
    """Fit on rows of docs (doc_id, text) that have a label in labels (doc_id, toxic).

    At most about max_rows labelled documents are used, chosen by a seeded hash of doc_id: the documented bound of the
    fit. Null doc_id and null toxic are left out; with one class only or no rows, the model gives the share of the
    toxic label for every text (0 where there are none). max_features bounds the buckets that may get a weight.
    """
    marked = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") != 0).cast("int").alias("label"))
    n = marked.count()
    if n > max_rows:
        marked = marked.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    rows = materialize(docs.select("doc_id", "text").join(marked, "doc_id").select("text", "label"), "training")
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    flat = ToxicityModel(np.zeros(1 << _BITS), 20.0 if sizes.get(1) and not sizes.get(0) else -20.0, orders)
    if len(sizes) < 2:
        discard(rows)
        return flat
    # one row for each bucket at most: bounded by the number of buckets, not by the rows
    counted = rows.mapInArrow(_count(orders), "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean"), F.sum("toxic")).toPandas().to_numpy(np.int64)
    at, clean, toxic = counted.T
    ratio = np.log((toxic + alpha) / (toxic + alpha).sum()) - np.log((clean + alpha) / (clean + alpha).sum())
    often = clean + toxic >= 3
    # buckets in which the label matters most: the log-count ratio in units of its standard error
    score = np.where(often, np.abs(ratio) / np.sqrt(1 / (clean + alpha) + 1 / (toxic + alpha)), -1.0)
    best = np.sort(at[np.lexsort((at, -score))[:max_features]])
    keep, rank, r = np.zeros(1 << _BITS, bool), np.zeros(1 << _BITS, np.int32), np.zeros(1 << _BITS)
    keep[best], rank[best], r[at] = True, np.arange(len(best), dtype=np.int32), ratio
    scale = r[best]

    width = len(best)
    as_vector = F.udf(lambda i: SparseVector(width, i, scale[i]), VectorUDT())
    features = materialize(rows.mapInArrow(_features(orders, keep, rank), "label double, at array<int>"), "features")
    data = features.select("label", as_vector("at").alias("features"))
    fitted = LogisticRegression(maxIter=60, regParam=reg, standardization=False, tol=1e-5).fit(data)
    weights = np.zeros(1 << _BITS)
    weights[best] = fitted.coefficients.toArray() * scale
    discard(rows)
    discard(features)
    return ToxicityModel(weights, float(fitted.intercept), orders)


def score(docs: DataFrame, model: ToxicityModel, *keep: str) -> DataFrame:
    """The columns keep of docs, then score (0 to 1) and predicted (1 from 0.5), for the whole text of each row.

    Null and empty texts have no n-grams beyond the blanks at the ends and get the score of the intercept.
    """
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    weights, bias, orders = model.weights, model.intercept, model.orders
    live = weights != 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                z = np.array([weights[_grams(t.as_py(), orders, live)].sum() + bias for t in batch.column(batch.num_columns - 1)])
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.fieldNames())

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents that no fit may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
