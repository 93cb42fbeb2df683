"""Evidence tables of ten kinds, derived from the tables at hand, as files and as rows; what the adapters make of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.catalog.base import Query
from loadlens.operators import adapters as X
from loadlens.operators import inventory as J
from loadlens.sources import delimited as D
from loadlens.sources import files as W

#: Times are seconds after this one.
EPOCH = 1_704_067_200
_WARNINGS = ("Plan Cache Instability; Single-Use plans", "Forced Serialization;Compilation Timeout", "Unused Memory Grant|Filter UDF", "non-SARGable predicate")


def _time(c: str):
    return F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.col(c)), "yyyy-MM-dd HH:mm:ss")


def _parts(v) -> tuple[list[DataFrame], list[DataFrame]]:
    """(artifact_id, line, cells, root_session_id): the rows of evidence of each kind, and the first lines of its artifacts, their columns."""
    exact = lambda c: F.col(c).cast("decimal(18,4)").cast("string")
    plain = lambda c: F.col(c).cast("string")
    number = F.expr("cast(substr(plan_id, 6) as int)")
    fixed = lambda x: F.lit(x)
    none = F.lit(None).cast("long")
    each, firsts = [], []

    def add(df: DataFrame, artifact, line: str, root, **cells) -> None:
        names = [n.replace("__", " ") for n in cells]
        rows = df.select(artifact.alias("artifact_id"), (F.col(line).cast("long") + 1).alias("line"), F.array(*(F.coalesce(c, F.lit("NULL")) for c in cells.values())).alias("cells"), root.cast("long").alias("root_session_id"))
        heads = rows.groupBy("artifact_id").agg(F.first("root_session_id").alias("root_session_id")).select("artifact_id", F.lit(-1).cast("long").alias("line"), F.array(*map(F.lit, names)).alias("cells"), "root_session_id")
        each.append(rows)
        firsts.append(heads)

    add(v.samples, F.concat(F.lit("smp-"), F.substring("source_id", 5, 9), F.lit("-"), "capture_s"), "sample_order", none, Captured__At=_time("capture_s"), Sample__ID=plain("sample_id"), Runnable__Tasks__Count=plain("runnable_tasks"), Active_Worker_Threads=plain("active_workers"),
        Max__Worker__Threads=plain("max_workers"), work_queue_count=plain("work_queue"), SQL__Compilations__Per__Sec=exact("compilations"), Batch__Requests__Per__Sec=exact("batches"), Resource__Semaphore__Query__Compile__Waiting__Tasks=plain("compile_waiters"), Cache_Hit_Ratio_Plan_Cache_Pct=F.concat(F.col("cache_hit_ratio").cast("decimal(18,6)").cast("string"), F.lit("%")))
    k = F.col("session_id") % 50
    add(v.locks, F.concat(F.lit("lck-"), k), "id", k, request_session_id=plain("session_id"), request_mode=fixed("X"), Request__Status=plain("request_status"), resource_type=F.lower("resource_type"), resource_database_id=plain("database_id"), resource_associated_entity_id=plain("entity_id"), resource_description=plain("description"))
    k = F.col("session_id") % 20
    add(v.activity.where("row_number % 3 = 0"), F.concat(F.lit("trn-"), k), "row_number", k, spid=plain("session_id"), open_tran_count=plain("open_tran_count"), collection_time=_time("capture_s"), dbid=F.substring("database_name", 3, 1))
    add(v.plan_stmts.where("granted_mb is not null"), F.concat(F.lit("grt-"), "database_id"), "statement_id", none, session_id=plain("statement_id"), Requested__Memory__KB=F.concat((F.col("granted_mb") * 1024).cast("long").cast("string"), F.lit(" KB")),
        granted_memory_kb=(F.col("granted_mb") * 1024).cast("long").cast("string"), used_memory_kb=(F.col("used_mb") * 1024).cast("decimal(18,4)").cast("string"), grant_time=F.when(F.col("statement_id") % 3 != 0, "2024-01-01"), query_hash=plain("query_hash"))
    name = F.when(F.col("counter_name") == "view", "Batch Requests/sec").when(F.col("counter_name") == "click", " sql compilations/sec").otherwise("Page life expectancy")
    add(v.samples, F.concat(F.lit("cnt-"), F.substring("source_id", 5, 9)), "sample_order", none, counter_name=name, cntr_value=exact("value"), captured_at=_time("capture_s"))
    warning = F.when(F.col("source_order") % 5 == 0, F.coalesce(F.get(F.array(*map(F.lit, _WARNINGS)), F.col("database_id").cast("int")), F.col("warnings")))
    add(v.spills, F.concat(F.lit("rpt-"), "database_id"), "source_order", none, Warnings=warning, Plan__Handle=plain("plan_handle"), Query__Hash=plain("query_hash"), Total__Spills=plain("total_pages"), Avg__Spills=plain("avg_pages"), Last__Execution=F.date_format("last_execution", "yyyy-MM-dd HH:mm:ss"))
    uses = F.when(F.col("database_id") % 2 == 0, F.col("executions") - 5).otherwise(F.col("executions")).cast("string")
    add(v.spills, F.concat(F.lit("cch-"), "database_id"), "source_order", none, usecounts=uses, cacheobjtype=fixed("Compiled Plan"), objtype=fixed("Adhoc"))
    n = number % 40
    kind = F.element_at(F.array(F.lit("request_plan"), F.lit("LAST_KNOWN_ACTUAL_PLAN"), F.lit("Query_Store")), (n % 3 + 1).cast("int"))
    plan = F.when(F.col("actual") & (n % 4 > 0), "<ShowPlanXML/>")
    add(v.plan_stmts.withColumn("at_s", F.when(n % 4 > 0, n * 15)), F.concat(F.lit("lkp-"), n), "statement_id", none, evidence_set=kind, captured_at=_time("at_s"), plan_handle=plain("plan_handle"), query_hash=plain("query_hash"), query_plan=plan)
    word = F.element_at(F.create_map(F.lit(3), F.lit("RESOURCE_SEMAPHORE wait"), F.lit(4), F.lit("threadpool")), (F.col("user_id") % 5).cast("int"))
    add(v.events.where("event_id % 40 = 0"), F.concat(F.lit("xev-"), F.col("user_id") % 5), "event_id", none, name=fixed("query_post_execution_showplan"), wait=word, session_id=plain("user_id"))
    add(v.supplier, F.concat(F.lit("srv-"), F.col("s_suppkey") % 5), "s_suppkey", none, evidence_set=fixed("SERVER_CAPABILITIES"), server_name=plain("s_name"))
    return each, firsts


def tables(v) -> DataFrame:
    """(artifact_id, line, cells, root_session_id): rows of evidence, each artifact's columns in its first line."""
    each, firsts = _parts(v)
    return reduce(DataFrame.unionByName, (*each, *firsts))


def typed(v, as_files: bool = False) -> DataFrame:
    """evidence_rows of the tables; as_files: written as one file for each artifact and read back."""
    each, firsts = _parts(v)
    heads = W.saved(reduce(DataFrame.unionByName, firsts), "firsts")
    roots = heads.select("artifact_id", "root_session_id")
    if as_files:
        quoted = F.array_join(F.transform("cells", lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))), ",")
        path = W.shared_path(v.spark, "evidence")
        reduce(DataFrame.unionByName, (*each, heads)).select("artifact_id", "line", quoted.alias("value")).repartition("artifact_id").sortWithinPartitions("artifact_id", "line").select("artifact_id", "value").write.partitionBy("artifact_id").text(path)
        read = D.read_capture(v.spark, path).select(F.substring_index(F.substring_index("path", "artifact_id=", -1), "/", 1).alias("artifact_id"), "line", "cells")
        return X.evidence_rows(read, roots)
    matrix = W.saved(reduce(DataFrame.unionByName, (*each, heads)), "matrix")
    return X.evidence_rows(matrix.drop("root_session_id"), roots)


def signals(v, as_files: bool = False) -> DataFrame:
    rows = W.saved(typed(v, as_files), "evidence")
    shapes = W.saved(X.evidence_shape(rows), "shapes")
    return X.evidence_signals(rows, shapes)


_D4 = lambda c: f"CAST(CAST({c} AS DECIMAL(18,4)) AS DOUBLE)"
_HIT = "CAST(CAST(cache_hit_ratio AS DECIMAL(18,6)) AS DOUBLE)"
_N = "CAST(substr(plan_id, 6) AS INTEGER) % 40"
_FULL = "(entity_id IS NOT NULL OR description IS NOT NULL) AND (resource_type = 'OBJECT' OR description IS NOT NULL)"
_SMP = "concat('smp-', substr(source_id, 5), '-', CAST(capture_s AS VARCHAR))"
_GAIN = f"""gains AS (SELECT artifact_id, max(CASE WHEN name = 'c' THEN gain END) AS c, max(CASE WHEN name = 'b' THEN gain END) AS b FROM (SELECT concat('cnt-', substr(source_id, 5)) AS artifact_id, CASE counter_name WHEN 'view' THEN 'b' ELSE 'c' END AS name, greatest(0, arg_max({_D4('value')}, sample_order) - arg_min({_D4('value')}, sample_order)) AS gain, count(*) AS n
 FROM samples WHERE value IS NOT NULL AND counter_name IN ('view', 'click') GROUP BY 1, 2) z WHERE n >= 2 GROUP BY 1)"""
_USES = "uses AS (SELECT concat('cch-', CAST(database_id AS VARCHAR)) AS artifact_id, count(*) AS n, count(*) FILTER (WHERE CASE WHEN database_id % 2 = 0 THEN executions - 5 ELSE executions END <= 1) AS one FROM spills GROUP BY 1)"
#: (artifact_id, signal) of the tables, from the views.
SIGNALS = f"""{_GAIN}, {_USES}, found AS (
 SELECT {_SMP} AS artifact_id, [CASE WHEN max(runnable_tasks) > 0 THEN 'scheduler-runnable-queue' END, CASE WHEN max(work_queue) > 0 THEN 'worker-queue' END, CASE WHEN bool_or(active_workers >= max_workers AND work_queue > 0) THEN 'worker-exhaustion-confirmed' END,
  CASE WHEN max(compile_waiters) > 0 AND max(CASE WHEN {_D4('batches')} > 0 THEN {_D4('compilations')} / {_D4('batches')} ELSE 0 END) >= 0.1 THEN 'compilation-pressure' END, CASE WHEN max(compile_waiters) > 0 AND arg_max({_HIT}, sample_order) < arg_min({_HIT}, sample_order) THEN 'plan-cache-pressure-wide' END] AS s FROM samples GROUP BY 1
 UNION ALL SELECT artifact_id, [CASE WHEN count(*) FILTER (WHERE t > 0) >= 2 THEN 'scheduler-pressure-sustained' END] FROM (SELECT {_SMP} AS artifact_id, sample_id, sum(runnable_tasks) AS t FROM samples GROUP BY 1, 2) z GROUP BY 1
 UNION ALL SELECT concat('lck-', CAST(session_id % 50 AS VARCHAR)), [CASE WHEN bool_or(session_id = session_id % 50 AND request_status = 'GRANT') THEN 'root-locks-granted' END] FROM locks GROUP BY 1
 UNION ALL SELECT DISTINCT artifact_id, ['lock-resource-match'] FROM (SELECT concat('lck-', CAST(session_id % 50 AS VARCHAR)) AS artifact_id FROM locks WHERE {_FULL} GROUP BY session_id % 50, resource_type, database_id, coalesce(CAST(entity_id AS VARCHAR), ''), coalesce(description, '')
  HAVING bool_or(session_id = session_id % 50 AND request_status = 'GRANT') AND bool_or(session_id <> session_id % 50 AND request_status = 'WAIT')) z
 UNION ALL SELECT concat('trn-', CAST(session_id % 20 AS VARCHAR)), [CASE WHEN bool_or(session_id = session_id % 20 AND open_tran_count > 0) THEN 'root-open-transaction' END] FROM activity WHERE row_number % 3 = 0 GROUP BY 1
 UNION ALL SELECT concat('grt-', CAST(database_id AS VARCHAR)), [CASE WHEN bool_or(granted_mb > 0 AND statement_id % 3 = 0) THEN 'pending-memory-grant' END] FROM plan_stmts WHERE granted_mb IS NOT NULL GROUP BY 1
 UNION ALL SELECT artifact_id, [CASE WHEN b > 0 AND c / b >= 0.1 THEN 'compilation-pressure' END] FROM gains
 UNION ALL SELECT concat('rpt-', CAST(database_id AS VARCHAR)), list_concat([CASE WHEN bool_or(total_pages > 0 OR avg_pages > 0) THEN 'spill-evidence' END], CASE WHEN bool_or(source_order % 5 = 0) THEN CASE database_id WHEN 0 THEN ['plan-cache-warning', 'plan-cache-instability', 'single-use-warning'] WHEN 1 THEN ['plan-cache-warning', 'forced-serialization', 'compilation-timeout']
  WHEN 2 THEN ['plan-cache-warning', 'unused-memory-grant', 'filter-udf'] WHEN 3 THEN ['plan-cache-warning', 'non-sargable'] ELSE [] END ELSE [] END) FROM spills GROUP BY database_id
 UNION ALL SELECT artifact_id, [CASE WHEN n >= 1000 AND one >= 0.9 * n THEN 'plan-cache-instability-measured' END] FROM uses
 UNION ALL SELECT concat('lkp-', CAST({_N} AS VARCHAR)), [CASE WHEN bool_or(actual AND {_N} % 4 > 0) THEN 'embedded-plan-captured' ELSE 'plan-lookup-null' END, CASE WHEN {_N} % 3 = 2 THEN 'query-store-evidence' END] FROM plan_stmts GROUP BY {_N}
 UNION ALL SELECT concat('xev-', CAST(user_id % 5 AS VARCHAR)), ['extended-events-evidence', CASE user_id % 5 WHEN 3 THEN 'pending-memory-grant' WHEN 4 THEN 'worker-queue' END] FROM events WHERE event_id % 40 = 0 GROUP BY user_id % 5
 UNION ALL SELECT DISTINCT concat('srv-', CAST(s_suppkey % 5 AS VARCHAR)), ['server-capabilities'] FROM supplier),
signals AS (SELECT DISTINCT artifact_id, signal FROM (SELECT artifact_id, unnest(s) AS signal FROM found) z WHERE signal IS NOT NULL)"""


def _observations(v):
    rows = W.saved(typed(v, True), "evidence")
    o = X.evidence_observations(rows, X.evidence_shape(rows))
    seconds = (F.unix_seconds("at") - EPOCH).alias("at_s")
    return o.select("artifact_id", "kind", "metric", F.round("value", 6).alias("value"), "text", "unit", seconds, "directness", "detail", F.array_join("signals", ",").alias("signals"), *(F.col(c).cast("long").alias(c) for c in ("session_id", "database_id")), "plan_handle", "query_hash")


def _seen(source, artifact, kind, metric, value, unit, at, directness="Direct", text="NULL", detail="NULL", signals="NULL", session="NULL", database="NULL", handle="NULL", query="NULL", where="true"):
    quote = lambda x: "NULL" if x is None else f"'{x}'"
    return f"SELECT {artifact} AS artifact_id, '{kind}' AS kind, '{metric}' AS metric, round(CAST({value} AS DOUBLE), 6) AS value, CAST({text} AS VARCHAR) AS text, {quote(unit)} AS unit, CAST({at} AS BIGINT) AS at_s, '{directness}' AS directness, CAST({detail} AS VARCHAR) AS detail, CAST({signals} AS VARCHAR) AS signals, CAST({session} AS BIGINT) AS session_id, CAST({database} AS BIGINT) AS database_id, CAST({handle} AS VARCHAR) AS plan_handle, CAST({query} AS VARCHAR) AS query_hash FROM {source} WHERE {where}"


_RPT, _LKP = "concat('rpt-', CAST(database_id AS VARCHAR))", f"concat('lkp-', CAST({_N} AS VARCHAR))"
_SIGNED = "CASE database_id WHEN 0 THEN 'plan-cache-instability,single-use-warning' WHEN 1 THEN 'forced-serialization,compilation-timeout' WHEN 2 THEN 'unused-memory-grant,filter-udf' WHEN 3 THEN 'non-sargable' ELSE '' END"
_WARN = "CASE database_id " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WARNINGS)) + " ELSE warnings END"
_LAST = "CAST(floor(epoch(CAST(last_execution AS TIMESTAMP))) AS BIGINT) - 1704067200"
_RES = f"CASE WHEN {_FULL} THEN concat(resource_type, '|', CAST(database_id AS VARCHAR), '|', coalesce(CAST(entity_id AS VARCHAR), ''), '|', coalesce(description, '')) ELSE 'Incomplete lock resource identity' END"
_CNT = "(SELECT g.*, (SELECT min(capture_s) FROM samples s WHERE concat('cnt-', substr(s.source_id, 5)) = g.artifact_id) AS at_s FROM gains g) y"
_SEEN = "\n UNION ALL ".join([
    _seen("samples", _SMP, "Scheduler", "runnable_tasks_count", "runnable_tasks", "tasks", "capture_s"),
    *(_seen("samples", _SMP, "Worker", m, c, u, "capture_s") for m, c, u in (("active_worker_threads", "active_workers", "workers"), ("max_worker_threads", "max_workers", "workers"), ("work_queue_count", "work_queue", "tasks"))),
    _seen("samples", _SMP, "Compilation", "compilation_to_batch_ratio", f"CASE WHEN {_D4('batches')} > 0 THEN {_D4('compilations')} / {_D4('batches')} ELSE 0 END", "ratio", "capture_s", "Derived"), _seen("samples", _SMP, "Compilation", "compile_waiting_tasks", "compile_waiters", "tasks", "capture_s"),
    _seen("samples", _SMP, "Plan cache", "cache_hit_ratio_pct", _HIT, "percent", "capture_s", where="cache_hit_ratio IS NOT NULL"),
    _seen("locks", "concat('lck-', CAST(session_id % 50 AS VARCHAR))", "Lock", "request_status", "NULL", None, "NULL", text="lower(request_status)", detail=_RES),
    _seen("activity", "concat('trn-', CAST(session_id % 20 AS VARCHAR))", "Transaction", "open_transaction_count", "open_tran_count", "transactions", "capture_s", session="session_id", database="substr(database_name, 3, 1)", where="row_number % 3 = 0"),
    *(_seen("plan_stmts", "concat('grt-', CAST(database_id AS VARCHAR))", "Memory grant", f"{n}_memory_kb", c, "KB", "NULL", session="statement_id", query="query_hash", where="granted_mb IS NOT NULL") for n, c in (("requested", "granted_mb * 1024"), ("granted", "granted_mb * 1024"), ("used", _D4("used_mb * 1024")))),
    _seen("spills", _RPT, "Plan-cache report", "warning", "NULL", None, "NULL", text=_WARN, signals=_SIGNED, handle="plan_handle", query="query_hash", where=f"source_order % 5 = 0 AND {_WARN} IS NOT NULL"),
    _seen("spills", _RPT, "Plan-cache report", "total_spill_pages", "total_pages", "8 KB pages", _LAST, handle="plan_handle", query="query_hash", where="total_pages IS NOT NULL"), _seen("spills", _RPT, "Plan-cache report", "average_spill_pages", "avg_pages", "8 KB pages/execution", _LAST, handle="plan_handle", query="query_hash", where="avg_pages IS NOT NULL"),
    _seen("plan_stmts", _LKP, "Plan lookup", "query_plan_available", "NULL", None, f"CASE WHEN {_N} % 4 > 0 THEN {_N} * 15 END", text=f"CASE WHEN actual AND {_N} % 4 > 0 THEN 'true' ELSE 'false' END", handle="plan_handle", query="query_hash"),
    _seen(_CNT, "artifact_id", "Compilation", "compilation_delta", "c", "compilations", "at_s", "Derived", where="c IS NOT NULL"), _seen(_CNT, "artifact_id", "Compilation", "batch_delta", "b", "batches", "at_s", "Derived", where="b IS NOT NULL"), _seen(_CNT, "artifact_id", "Compilation", "compilation_to_batch_ratio", "c / b", "ratio", "at_s", "Derived", where="b > 0 AND c IS NOT NULL"),
    _seen("uses", "artifact_id", "Plan cache", "total_plan_count", "n", "plans", "NULL"), _seen("uses", "artifact_id", "Plan cache", "single_use_plan_count", "one", "plans", "NULL"), _seen("uses", "artifact_id", "Plan cache", "single_use_percentage", "100.0 * one / n", "percent", "NULL", "Derived"),
])


def _shape(v):
    s = X.evidence_shape(typed(v, True))
    return s.select("artifact_id", F.array_join("shapes", ",").alias("shapes"), "adapter", "kind", F.array_join("result_sets", ",").alias("result_sets"), (F.unix_seconds("captured_at") - EPOCH).alias("at_s"), "rows")


def _shaped(source, artifact, shapes, adapter, kind, sets, at="NULL", where="true"):
    return f"SELECT {artifact} AS artifact_id, '{shapes}' AS shapes, '{adapter}' AS adapter, '{kind}' AS kind, {sets} AS result_sets, CAST(min({at}) AS BIGINT) AS at_s, count(*) AS rows FROM {source} WHERE {where} GROUP BY ALL"


_NAMES = "CASE WHEN {0} % 3 = 0 THEN 'REQUEST_PLAN' WHEN {0} % 3 = 1 THEN 'LAST_KNOWN_ACTUAL_PLAN' ELSE 'QUERY_STORE' END".format(_N)
_SHAPED = "\n UNION ALL ".join([
    _shaped("samples", _SMP, "scheduler,worker,compile", "compilation-counters", "Plan cache", "'COMPILATION_COUNTERS,SCHEDULERS,WORKER_COUNTERS'", "capture_s"),
    _shaped("locks", "concat('lck-', CAST(session_id % 50 AS VARCHAR))", "lock", "native", "Locks", "'TRANSACTIONS_LOCKS'"), _shaped("activity", "concat('trn-', CAST(session_id % 20 AS VARCHAR))", "transaction", "native", "Diagnostic result", "'TRANSACTIONS_LOCKS'", "capture_s", "row_number % 3 = 0"),
    _shaped("plan_stmts", "concat('grt-', CAST(database_id AS VARCHAR))", "grant", "native", "Memory grants", "'MEMORY_GRANTS'", where="granted_mb IS NOT NULL"), _shaped("samples", "concat('cnt-', substr(source_id, 5))", "counter", "native", "Diagnostic result", "'COMPILATION_COUNTERS'", "capture_s"),
    _shaped("spills", _RPT, "report", "plan-cache-report", "Plan cache", "'BLITZCACHE'"), _shaped("spills", "concat('cch-', CAST(database_id AS VARCHAR))", "plan-cache", "generic-tabular", "Diagnostic result", "''"),
    _shaped("plan_stmts", _LKP, "plan-lookup", "native", "Diagnostic result", _NAMES, f"CASE WHEN {_N} % 4 > 0 THEN {_N} * 15 END", f"{_N} % 3 < 2"), _shaped("plan_stmts", _LKP, "plan-lookup,query-store", "query-store", "Diagnostic result", _NAMES, f"CASE WHEN {_N} % 4 > 0 THEN {_N} * 15 END", f"{_N} % 3 = 2"),
    _shaped("events", "concat('xev-', CAST(user_id % 5 AS VARCHAR))", "extended-events", "extended-events", "Diagnostic result", "'EXTENDED_EVENTS'", where="event_id % 40 = 0"), _shaped("supplier", "concat('srv-', CAST(s_suppkey % 5 AS VARCHAR))", "", "generic-tabular", "Diagnostic result", "'SERVER_CAPABILITIES'"),
])

QUERIES = [
    Query("evidence_observations", _observations, f"WITH {_GAIN}, {_USES} {_SEEN}"),
    Query("evidence_shape", _shape, _SHAPED),
    Query("evidence_signals", lambda v: signals(v, True), f"WITH {SIGNALS} SELECT artifact_id, signal FROM signals"),
    Query("evidence_kinds", lambda v: J.counted(signals(v), "signal"), f"WITH {SIGNALS} SELECT signal, count(*) AS count FROM signals GROUP BY signal"),
]
