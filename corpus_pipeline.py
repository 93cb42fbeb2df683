"""The corpus pipeline: reject toxic documents, keep one of each near-duplicate group, drop documents that hold benchmark
items, mix sources to target weights, and shard the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm import edit_decontam, mixing, nblr_toxicity, parity_join, tier_compaction
from loadlens.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The key of a row inside a stage; no column of docs comes into a stage's own tables but COLUMNS and this.
KEY = "__row"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with COLUMNS and a key for each row: doc_id where that is unique, else a number in the order of doc_id, nulls last,
    then of the texts' hashes; equal rows have keys of their own."""
    rows = docs.select(*COLUMNS)
    shared = rows.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if shared.isEmpty():
        return rows.withColumn(KEY, F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text", "lang", "source", "n_chars")]
    return materialize(rows.orderBy(*order).withColumn(KEY, F.monotonically_increasing_id()), "keyed")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text the classifier does not call toxic. It learns from all labelled documents but the held-out fifth.

    Each row is judged by its text alone, so null and repeated doc_ids, null and empty texts and ties are no matter; columns
    beyond COLUMNS are dropped; an empty table gives an empty table."""
    learn = table(spark, sf_dir, "documents").where(~nblr_toxicity.held_out())
    model = nblr_toxicity.train(learn, table(spark, sf_dir, "labels"))
    columns = docs.select(*COLUMNS)
    return nblr_toxicity.score(columns, model, *COLUMNS).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of five-word shingle sets at 0.8: that with the smallest doc_id.

    Rows are compared as rows, also those that share a doc_id or have none (they come last); of equal doc_ids the one with
    the smallest hash stays, of equal rows one. Null, empty and blank texts link with nothing and all stay. Columns beyond
    COLUMNS are dropped; an empty table gives an empty table."""
    rows = _keyed(docs)
    found = parity_join.jaccard_components(rows, shingle=5, percent=80, doc_id=KEY)
    others = found.where("doc_id <> component_id").select(F.col("doc_id").alias(KEY))
    return rows.join(others, KEY, "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item within its edit budget.

    Each row is judged by its own text, also where rows share a doc_id or have none; null and empty texts hold nothing.
    Columns beyond COLUMNS are dropped; an empty table gives an empty table."""
    rows = _keyed(docs)
    leaky = edit_decontam.leaks(rows.select(F.col(KEY).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(KEY)).distinct()
    return rows.join(leaky, KEY, "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice.

    Rows are drawn one by one, also where they share a doc_id or have none, so the words per source meet the targets.
    A null source is a source; rows without words are not taken. Columns beyond COLUMNS are dropped; an empty table gives
    an empty table."""
    rows = _keyed(docs)
    times = mixing.mix_sources(rows.select(F.col(KEY).alias("doc_id"), "text", "source")).where("times > 0").select(F.col("doc_id").alias(KEY), "times")
    return rows.join(times, KEY).select(*COLUMNS, F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, shard, shard_bytes, version) for each row, from the shards that were written: repeated rows, null doc_ids and
    null or empty texts have a row each. An empty table gives an empty table."""
    return tier_compaction.shard_map(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: Edit distances, the fitted classifier and the seeded choice have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
