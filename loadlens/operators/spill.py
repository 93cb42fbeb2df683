"""Spill triage: candidate rows from plan-cache exports, their metrics and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions import scalars as S
from loadlens.sources.files import shared_path


# What the columns of a plan-cache export are called, once normalised; the first name that is there counts.
ALIASES = {
    "total": ("total_spills", "total_spill", "total_spilled_pages", "total_spills_pages", "total_spills_8kb_pages"),
    "avg": ("avg_spills", "average_spills", "average_spill", "avg_spilled_pages", "average_spills_pages"),
    "executions": ("number_executions", "executions", "execution_count", "number_of_executions"),
    "last_execution": ("last_execution", "last_execution_time", "last_executed"),
    "database_name": ("database", "database_name", "database_context"),
    "object_name": ("object", "object_name", "procedure_name"),
    "warnings": ("warnings", "warning", "findings", "blitzcache_info"),
    "plan_handle": ("plan_handle", "planhandle"),
    "sql_handle": ("sql_handle", "sqlhandle"),
    "query_hash": ("query_hash", "queryhash"),
    "plan_hash": ("query_plan_hash", "queryplanhash"),
    "start_offset": ("statement_start_offset", "start_offset"),
    "end_offset": ("statement_end_offset", "end_offset"),
    "database_id": ("database_id", "dbid"),
}


def _metric(cells: Column, names: tuple[str, ...]) -> Column:
    """struct<value, state, explanation, unit> of the first cell that says something: of the columns in pages, then of those that
    name a unit after one of the names."""
    bases = dict.fromkeys(n.removesuffix("_8kb_pages").removesuffix("_pages") for n in names)
    columns = [(n, "pages") for n in names] + [(f"{b}_{u}", u) for b in bases for u in S.PAGES if u != "pages"]
    read = lambda name, unit: S.spill_number(F.element_at(cells, name), unit)
    told = [F.when(S.spill_text(F.element_at(cells, n)).isNotNull(), read(n, u).withField("unit", F.lit(u))) for n, u in columns]
    return F.coalesce(*told, S.spill_number(F.lit(None).cast("string")).withField("unit", F.lit(None).cast("string")))


def read_candidates(raw: DataFrame) -> DataFrame:
    """Typed candidates of raw rows (source_order, cells as map of header to text): metrics in pages with their state, unit and
    what is wrong with them, executions, times, identity and warnings."""
    rows = raw.withColumn("c", F.transform_keys("cells", lambda k, _: S.header_norm_spill(k)))
    text = lambda k: F.coalesce(*(S.spill_text(F.element_at("c", n)) for n in ALIASES[k]))
    whole = lambda k: text(k).try_cast("long")
    rows = rows.withColumns({"t": _metric(F.col("c"), ALIASES["total"]), "a": _metric(F.col("c"), ALIASES["avg"])})
    rows = rows.withColumn("said_last", text("last_execution"))
    return rows.select(
        "source_order", F.col("t.value").alias("total_pages"), F.col("t.state").alias("total_state"), F.col("t.unit").alias("total_unit"), F.col("a.value").alias("avg_pages"), F.col("a.state").alias("avg_state"), F.coalesce("t.explanation", "a.explanation").alias("explanation"),
        whole("executions").alias("executions"), S.last_execution(F.col("said_last")).alias("last_execution"), (F.col("said_last").isNotNull() & S.last_execution(F.col("said_last")).isNull()).alias("bad_time"),
        *(text(k).alias(k) for k in ("database_name", "object_name", "plan_handle", "sql_handle", "query_hash", "plan_hash", "warnings")), *(whole(k).alias(k) for k in ("start_offset", "end_offset", "database_id")))


def spill_candidates(rows: DataFrame) -> DataFrame:
    """Typed candidates (source_order, total_pages, avg_pages, executions, last_execution, warnings): the average is derived
    where it is missing, warnings are parted."""
    derived = F.when(F.col("avg_pages").isNull() & (F.col("total_pages") > 0) & (F.col("executions") > 0), F.col("total_pages") / F.col("executions"))
    parts = F.filter(F.transform(F.split(F.coalesce("warnings", F.lit("")), r"[;|]"), lambda w: F.trim(w)), lambda w: w != "")
    state = F.when(F.col("avg_pages").isNotNull(), "imported").when(derived.isNotNull(), "derived").otherwise("missing")
    if "avg_state" in rows.columns:
        state = F.when(derived.isNotNull(), "derived").otherwise(F.col("avg_state"))
    return rows.withColumn("average", F.coalesce("avg_pages", derived)).withColumn("average_state", state).withColumn("warning_list", parts)


def spill_rank(candidates: DataFrame) -> DataFrame:
    """Ranked: those with a total first, by total, average and last execution, then those with an average alone. Zero and
    missing ones are kept without a rank. The ranking is global: rows are dealt by ranges of the sort keys and written, and
    the rank inside a range follows the number of rows in the ranges before it, so no task sees more than its range."""
    backed = F.col("total_pages") > 0
    only = ~F.coalesce(backed, F.lit(False)) & (F.col("average") > 0) & F.col("total_pages").isNull()
    keyed = candidates.withColumn("basis", F.when(backed, 1).when(only, 2))
    order = [F.asc("basis"), F.desc_nulls_last("total_pages"), F.desc_nulls_last("average"), F.desc_nulls_last("last_execution"), F.asc("source_order")]
    ranged = keyed.where("basis is not null").repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    path = shared_path(candidates.sparkSession, "ranges")
    ranged.write.parquet(path)  # the ranges are sampled, so they are fixed before they are counted
    ranged = candidates.sparkSession.read.schema(ranged.schema).parquet(path)
    # one row a range
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order))).join(F.broadcast(before), "_range")
    placed = placed.select(*keyed.columns, (F.col("_place") + F.col("_before")).cast("long").alias("rank"))
    return placed.unionByName(keyed.where("basis is null").withColumn("rank", F.lit(None).cast("long")))


def highest_per_execution(candidates: DataFrame) -> DataFrame:
    return candidates.where("average > 0").orderBy(F.desc("average"), "source_order").limit(1)


def spill_import_summary(candidates: DataFrame) -> DataFrame:
    """One row of counts of an import of read_candidates and spill_candidates."""
    total, avg, n = F.col("total_pages"), F.col("avg_pages"), F.col("executions")
    off = (total > 0) & (avg > 0) & (n > 0) & (F.abs(total - avg * n) > 0.01 * total)
    gone = F.col("total_state").isin("missing", "invalid") & F.col("avg_state").isin("missing", "invalid")
    handles, hashes = F.coalesce("plan_handle", "sql_handle"), F.col("query_hash")
    c = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    return candidates.agg(
        F.count("*").alias("n_rows"), c((total > 0) | (total.isNull() & (F.col("average") > 0))).alias("rankable"), c((F.col("total_state") == "missing") & (F.col("avg_state") == "missing")).alias("missing_metrics"),
        c((F.col("total_state") == "invalid") | (F.col("avg_state") == "invalid")).alias("invalid"), c(F.col("total_unit").isNotNull() & (F.col("total_unit") != "pages") & total.isNotNull()).alias("converted"), c(F.col("explanation").contains("the column")).alias("conflicting"),
        c(F.col("average_state") == "derived").alias("derived"), c(gone & (F.size("warning_list") > 0)).alias("warning_only"), c(F.col("bad_time")).alias("bad_times"), c(handles.isNull() & hashes.isNull()).alias("incomplete_identity"),
        c(F.col("sql_handle").isNotNull() & F.col("plan_handle").isNull() & hashes.isNull() & F.col("start_offset").isNull()).alias("batch_only_handles"), c(off).alias("inconsistent_totals"))


def topn_disclosure(candidates: DataFrame, *keys: str) -> DataFrame:
    """Inputs of exactly ten rows look like a top ten of more."""
    return candidates.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("probable_top_n", F.col("n") == 10)
