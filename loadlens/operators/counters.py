"""Operators over counter samples (source_id, capture_s, sample_order, counter_name, value and the columns of a kind)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# The metrics that counter exports may have, and the columns by which their kinds are known, in order.
METRICS = (
    "processor_pct_time", "sqlserver_processes_pct_time", "signal_wait_time_pct", "batch_requests_per_sec", "runnable_tasks_count", "sql_compilations_per_sec", "sql_re_compilations_per_sec", "cache_hit_ratio_plan_cache_pct",
    "resource_semaphore_query_compile_waiting_tasks", "active_worker_threads", "max_worker_threads", "work_queue_count", "pending_diskio_count", "memory_grants_pending", "memory_grants_outstanding", "granted_workspace_memory_kb",
    "tempdb_data_file_size_kb", "resource_semaphore_waiting_tasks",
)
KINDS = (
    ("Scheduler counters", ("processor_pct_time", "signal_wait_time_pct", "runnable_tasks_count")), ("Compilation counters", ("sql_compilations_per_sec", "batch_requests_per_sec")),
    ("Worker counters", ("active_worker_threads", "max_worker_threads", "work_queue_count")), ("Memory counters", ("memory_grants_pending", "granted_workspace_memory_kb", "tempdb_data_file_size_kb")),
    ("Query Store", ("query_id", "plan_id", "avg_duration_ms")), ("Query Store", ("query_id", "plan_id", "query_sql_text")),
)


def counter_kind(headers: list[str]) -> str | None:
    """The kind of an export by its headers; null if it is none."""
    there = {plain_header(h) for h in headers}
    return next((kind for kind, needed in KINDS if there.issuperset(needed)), None)


def plain_header(header: str) -> str:
    return re.sub("[^a-z0-9]+", "_", header.removeprefix("\ufeff").strip().lower()).strip("_")


def read_counters(table: DataFrame, keys: list[str]) -> DataFrame:
    """A counter export, its columns under any spelling, to (keys, kind, metric, value); cells without a number are left out, and
    so are columns that are no metric. A table of no known kind is an error."""
    kind = counter_kind(table.columns)
    if kind is None:
        raise ValueError(f"no counter export: {', '.join(table.columns)}")
    found = {m: c for c in table.columns if c not in keys and (m := plain_header(c)) in METRICS}
    number = lambda c: F.replace(F.col(f"`{c}`").cast("string"), F.lit(","), F.lit("")).try_cast("double")
    wide = table.select(*keys, *(number(c).alias(m) for m, c in found.items()))
    return wide.unpivot(keys, list(found), "metric", "value").where("value is not null").select(*keys, F.lit(kind).alias("kind"), "metric", "value")


def counter_movement(samples: DataFrame) -> DataFrame:
    """First and last value of each counter of each source, in sample order."""
    rows = samples.where("value is not null")
    return rows.groupBy("source_id", "counter_name").agg(F.min_by("value", "sample_order").alias("first_value"), F.max_by("value", "sample_order").alias("last_value"), F.count("*").alias("n"))


def counter_delta(samples: DataFrame) -> DataFrame:
    """Last minus first, not below 0."""
    return counter_movement(samples).select("source_id", "counter_name", F.greatest(F.col("last_value") - F.col("first_value"), F.lit(0.0)).alias("delta"))


def scheduler_samples(samples: DataFrame) -> DataFrame:
    """Per source: samples with runnable tasks, and whether that lasts: two or more, not all of them single rows.

    Rows of a sample are summed by its id, else its time, else alone."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("sample_id").cast("string")), F.concat(F.lit("t"), F.col("capture_s").cast("string")), F.concat(F.lit("r"), F.col("sample_order").cast("string")))
    sums = samples.groupBy("source_id", key.alias("k")).agg(F.sum("runnable_tasks").alias("tasks"))
    g = sums.groupBy("source_id").agg(F.count_if(F.col("tasks") > 0).alias("positive"), F.bool_or(~F.col("k").startswith("r")).alias("scoped"))
    return g.select("source_id", "positive", ((F.col("positive") >= 2) & F.col("scoped")).alias("sustained"))


def worker_ceiling(samples: DataFrame) -> DataFrame:
    """Per source: whether any sample has all workers active and work queued."""
    return samples.groupBy("source_id").agg(F.bool_or((F.col("active_workers") >= F.col("max_workers")) & (F.col("work_queue") > 0)).alias("ceiling"))


def compile_ratio(samples: DataFrame) -> DataFrame:
    """Per source: the largest share of compilations in batches, over samples with batches."""
    return samples.groupBy("source_id").agg(F.max(F.when(F.col("batches") > 0, F.col("compilations") / F.col("batches"))).alias("ratio"))


def compile_corroboration(samples: DataFrame, ratio: float) -> DataFrame:
    """One row (corroborated): whether a source has a compilation ratio of at least ratio, waiters for the compile semaphore
    (compile_waiters) and a plan-cache hit ratio (cache_hit_ratio) that falls from its first sample to its last. Samples
    without one of these columns corroborate nothing."""
    known = lambda c: F.col(c) if c in samples.columns else F.lit(None).cast("double")
    share = F.max(F.when(F.col("batches") > 0, F.col("compilations") / F.col("batches")))
    at = F.when(known("cache_hit_ratio").isNotNull(), F.col("sample_order"))
    falling = F.max_by(known("cache_hit_ratio"), at) < F.min_by(known("cache_hit_ratio"), at)
    each = samples.groupBy("source_id").agg(((share >= ratio) & (F.max(known("compile_waiters")) > 0) & falling).alias("all"))
    return each.agg(F.coalesce(F.bool_or("all"), F.lit(False)).alias("corroborated"))


def counter_ratio(deltas: DataFrame, of: str, to: str) -> DataFrame:
    """(source_id, ratio): what one counter gained for each unit of another, from counter_delta; none where the other stood still."""
    gained = lambda name: F.max(F.when(F.col("counter_name") == name, F.col("delta")))
    g = deltas.groupBy("source_id").agg(gained(of).alias("a"), gained(to).alias("b")).where("a is not null and b > 0")
    return g.select("source_id", (F.col("a") / F.col("b")).alias("ratio"))
