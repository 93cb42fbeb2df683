"""What is known of input files from their headers: (input_id, line_no, event_id as order, header)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions import scalars as S

# The recognised columns of a capture.
COLUMNS = (
    "session_id", "dd hh:mm:ss.mss", "dd hh:mm:ss.mss (avg)", "avg_elapsed_time", "physical_io", "physical_io_delta", "reads", "reads_delta", "writes", "writes_delta",
    "physical_reads", "physical_reads_delta", "CPU", "CPU_delta", "context_switches", "context_switches_delta", "used_memory", "used_memory_delta", "tasks", "status",
    "wait_info", "tran_start_time", "tran_log_writes", "implicit_tran", "open_tran_count", "tempdb_allocations", "tempdb_allocations_delta", "tempdb_current", "tempdb_current_delta",
    "blocking_session_id", "blocked_session_count", "percent_complete", "host_name", "login_name", "database_name", "program_name", "additional_info", "start_time", "login_time",
    "request_id", "collection_time", "sql_text", "sql_command", "query_plan", "locks", "memory_info", "requested_memory", "granted_memory", "max_used_memory", "max_used_memory_delta",
)
#: Columns that would help a family of findings; of names with "or" between them one is enough.
FAMILY_COLUMNS = {
    "blocking": ("locks", "tran_start_time", "query_plan", "sql_text or sql_command"), "resource": ("query_plan", "sql_text or sql_command"),
    "wait": ("query_plan", "memory_info", "sql_text or sql_command"), "transaction": ("tran_start_time", "locks", "sql_text or sql_command"),
}


def known(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, c.lower()) for c in COLUMNS], "name string, lower_name string")


def _named(headers: DataFrame) -> DataFrame:
    """headers with the canonical name (null if unknown) and the normalised header."""
    h = headers.withColumn("shown", S.header_norm_capture(F.col("header"))).withColumn("lower_name", F.lower("shown"))
    return h.join(F.broadcast(known(headers)), "lower_name", "left")


def canonical_headers(headers: DataFrame) -> DataFrame:
    """Per line: each column's name; a name that is there already gets its position."""
    base = _named(headers).withColumn("base", F.coalesce("name", "shown"))
    order = Window.partitionBy("input_id", "line_no").orderBy("event_id")
    again = Window.partitionBy("input_id", "line_no", "base").orderBy("event_id")
    rows = base.withColumn("position", F.row_number().over(order)).withColumn("nth", F.row_number().over(again))
    return rows.select("input_id", "line_no", "position", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat_ws("__", "base", "position")).alias("name"))


def locate_header(headers: DataFrame, first: int = 20, least: int = 2) -> DataFrame:
    """The line with most distinct recognised names among the first ones; none if there are too few."""
    score = _named(headers.where(F.col("line_no") < first)).groupBy("input_id", "line_no").agg(F.countDistinct("name").alias("score")).where(F.col("score") >= least)
    best = F.max_by(F.struct("line_no", "score"), F.struct("score", -F.col("line_no")))
    return score.groupBy("input_id").agg(best.alias("b")).select("input_id", "b.line_no", "b.score")


def schema_profile(headers: DataFrame, few: int = 5) -> DataFrame:
    g = _named(headers).groupBy("input_id").agg(F.array_sort(F.collect_set("name")).alias("r"), F.array_sort(F.collect_set(F.when(F.col("name").isNull(), F.col("lower_name")))).alias("u"))
    joined = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))
    return g.select("input_id", joined("r").alias("recognised"), joined("u").alias("unknown"), (F.size("r") < few).alias("few"))


def present_columns(headers: DataFrame) -> DataFrame:
    return _named(headers).where("name is not null").select("name").distinct()


def missing_columns(headers: DataFrame) -> DataFrame:
    return known(headers).select("name").join(present_columns(headers), "name", "left_anti")


def unknown_columns(headers: DataFrame) -> DataFrame:
    return _named(headers).where("name is null").select(F.col("lower_name").alias("name")).distinct()


def evidence_gaps(headers: DataFrame) -> DataFrame:
    """Per family of findings, the columns that would help and were not captured, and so what to capture next."""
    wanted = headers.sparkSession.createDataFrame([(f, c, n) for f, cs in FAMILY_COLUMNS.items() for c in cs for n in c.split(" or ")], "family string, wanted string, name string")
    seen = wanted.join(present_columns(headers).withColumn("here", F.lit(True)), "name", "left").groupBy("family", "wanted").agg(F.bool_or("here").alias("here"))
    return seen.where("here is null").groupBy("family").agg(F.array_join(F.array_sort(F.collect_list("wanted")), ", ").alias("missing"))


def data_quality(headers: DataFrame, acts: DataFrame, not_run: DataFrame | None = None) -> DataFrame:
    """One row: columns present, missing and unknown, waits that could not be parsed, warnings, and rules that were not run
    (not_run has rule_id)."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    waits = one(acts.where("wait_info is not null and wait_type is null"), "unparsed_waits")
    present = present_columns(headers)
    out = one(present, "present").crossJoin(one(missing_columns(headers), "missing")).crossJoin(one(unknown_columns(headers), "unknown")).crossJoin(waits)
    out = out.crossJoin(present.agg(F.coalesce(F.bool_or(F.col("name").isin("tempdb_current", "tempdb_allocations")), F.lit(False)).alias("tempdb")))
    rules = (not_run if not_run is not None else headers.sparkSession.createDataFrame([], "rule_id string")).agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ", ").alias("not_run"))
    warnings = F.concat_ws(" | ", F.when(F.col("unparsed_waits") > 0, F.concat(F.col("unparsed_waits").cast("string"), F.lit(" wait_info observations could not be parsed."))), F.when(F.col("tempdb"), "TempDB pages show request-level consumption only."))
    return out.withColumn("warnings", warnings).drop("tempdb").crossJoin(rules)


def import_preview(headers: DataFrame, acts: DataFrame) -> DataFrame:
    """Per input: its headers, how many are recognised, and the first and last capture of its rows (acts has input_id)."""
    h = _named(headers).groupBy("input_id").agg(F.count("*").alias("n_headers"), F.countDistinct("name").alias("recognised"))
    t = acts.groupBy("input_id").agg(F.min("capture_s").alias("first_s"), F.max("capture_s").alias("last_s"))
    return h.join(t, "input_id", "left")
