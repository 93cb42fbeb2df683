"""Queries of plan shredding and plan rules. The documents are built from order lines, one statement per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.catalog.base import Query
from loadlens.operators import inventory as J
from loadlens.plans import shred as H



def documents(v):
    """One plan document per order: the operators nested in the order of their lines."""
    say = lambda name, c, form="string": F.concat(F.lit(f' {name}="'), (F.expr(c) if isinstance(c, str) else c).cast(form).cast("string"), F.lit('"'))
    some = lambda when, *parts: F.when(F.expr(when), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))).otherwise("")
    runtime = some("actual_rows is not null", '<RunTimeInformation><RunTimeCountersPerThread Thread="0"', say("ActualRows", "actual_rows"), '/><RunTimeCountersPerThread Thread="1" ActualRows="0"/></RunTimeInformation>')
    details = some("spilled and object_no % 2 = 0", "<SortSpillDetails", say("WritesToTempDb", "object_no * 8"), say("GrantedMemoryKb", "statement_id % 900"), say("UsedMemoryKB", "object_no"), "/>")
    convert = some("converted", "<PlanAffectingConvert", say("Expression", F.concat(F.lit("CONVERT_IMPLICIT(int,c"), F.col("object_no").cast("string"), F.lit(")"))), "/>")
    warned = some("spilled or converted", "<Warnings", some("spilled and object_no % 2 = 1", ' SpillToTempDb="1"'), ">", details, convert, "</Warnings>")
    touched = some("object_no % 3 = 0", '<Object Schema="dbo"', say("Table", F.concat(F.lit("t"), F.col("object_no").cast("string"))), "/>")
    residual = some("residual", '<Residual><ScalarOperator ScalarString="a = 1"/></Residual>')
    udf = some("scalar_udf", F.when(F.col("object_no") % 2 == 0, "<UserDefinedFunction/>").otherwise('<ScalarOperator ScalarString="dbo.UDF (a)"/>'))
    open_ = F.concat(F.lit("<RelOp"), say("NodeId", "node_id"), say("PhysicalOp", "physical_op"), F.lit(' LogicalOp="x"'), say("EstimateRows", "estimated_rows"), F.lit(">"), runtime, warned, touched, residual, udf)
    # order lines meet by order once, while they are narrow: the window of plan_ops and the documents both keep to that
    ops = v.by("lineitem", "l_orderkey").plan_ops.groupBy("statement_id").agg(F.sort_array(F.collect_list(F.struct(F.col("node_id").alias("k"), open_.alias("o")))).alias("ops"))
    body = F.concat(F.array_join("ops.o", ""), F.repeat(F.lit("</RelOp>"), F.size("ops")))
    statement = F.concat(F.lit("<StmtSimple"), say("StatementText", F.concat(F.lit("s"), F.col("statement_id").cast("string"))), F.lit(' StatementType="SELECT"'), say("StatementSubTreeCost", "statement_id / 4"), say("QueryHash", "statement_id % 50"), some("statement_id % 3 = 0", say("StatementStartOffset", "statement_id % 90")), say("RetrievedFromCache", "statement_id % 2 = 0"), F.lit(">"))
    plan = F.concat(F.lit('<QueryPlan DegreeOfParallelism="1"'), some("statement_id % 7 = 0", ' NonParallelPlanReason="NoParallel"'), say("CompileTime", "statement_id % 100 - 1"), F.lit(">"))
    grant = some("statement_id % 2 = 0", "<MemoryGrantInfo", say("GrantedMemory", "statement_id % 1000"), say("MaxUsedMemory", "statement_id % 10"), "/>")
    statistic = lambda n: F.concat(F.lit('<StatisticsInfo Schema="dbo"'), say("Table", "statement_id % 20"), F.lit(f' Statistics="s{n}"'), say("ModificationCount", "statement_id % 7"), say("SamplingPercent", "statement_id % 100"), F.lit("/>"))
    statistics = some("statement_id % 4 <> 0", "<OptimizerStatsUsage>", statistic(1), some("statement_id % 4 = 1", statistic(2)), "</OptimizerStatsUsage>")
    good = F.concat(F.lit('<ShowPlanXML xmlns="http://schemas.microsoft.com/sqlserver/2004/07/showplan"><BatchSequence>'), statement, plan, grant, statistics, body, F.lit("</QueryPlan></StmtSimple></BatchSequence></ShowPlanXML>"))
    x = F.when(F.col("statement_id") % 101 == 0, "").when(F.col("statement_id") % 103 == 0, "<a><b></a>").when(F.col("statement_id") % 107 == 0, "<other/>").otherwise(good)
    return ops.select(F.col("statement_id").alias("plan_id"), x.alias("xml"))


def read_operators(v, *columns):
    """The operators of all documents with their warnings and these columns, under the number of their statement."""
    spilled = F.exists("warnings", lambda w: w.contains("pill")).alias("spilled")
    return H.shred(documents(v), columns=("warnings", *columns), kinds=("operator",)).withColumn("statement_id", F.col("plan_id").cast("long")).select("*", spilled)


def read_statements(v, *columns):
    return H.shred(documents(v), columns=columns, kinds=("statement",))


_GOOD = "statement_id % 101 <> 0 AND statement_id % 103 <> 0 AND statement_id % 107 <> 0"


_WALK = """WITH RECURSIVE line AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY node_id) AS nth FROM plan_ops), down AS (SELECT statement_id, node_id AS start, node_id, nth, 0 AS depth FROM line WHERE {start} UNION ALL SELECT d.statement_id, d.start, p.node_id, p.nth, d.depth + 1 FROM down d JOIN line p ON p.statement_id = d.statement_id AND p.nth = d.nth + 1)"""


def _predicates(v):
    o = F.col("object_no")
    return v.plan_ops.withColumn("predicate", F.when(o % 4 == 0, F.concat(F.lit("name like N'%x"), o.cast("string"), F.lit("'"))).when(o % 4 == 1, "CONVERT_IMPLICIT(int, a)").when(o % 4 == 2, "b = 2"))


def _joined(name):
    return F.array_join(F.col(name).cast("array<string>"), ",")


_NULL = "CAST(NULL AS BIGINT)"
_RATIO = "greatest(actual_rows, estimated_rows) / greatest(1.0, least(actual_rows, estimated_rows))"

QUERIES = [
    Query("plan_operators", lambda v: read_operators(v, "node_id", "physical_op", "estimated_rows", "actual_rows", "residual", "scalar_function", "object_name", "child_node_ids", "ancestors").select("statement_id", "node_id", "physical_op", "estimated_rows", "actual_rows", "spilled", "residual", "scalar_function", "object_name", _joined("child_node_ids").alias("children"), _joined("ancestors").alias("ancestors")),
          f"""SELECT p.statement_id, p.node_id, p.physical_op, CAST(p.estimated_rows AS DOUBLE) AS estimated_rows, p.actual_rows, p.spilled, p.residual, p.scalar_udf AS scalar_function, CASE WHEN object_no % 3 = 0 THEN concat('dbo.t', CAST(object_no AS VARCHAR)) END AS object_name, coalesce(CAST(lead(node_id) OVER (PARTITION BY statement_id ORDER BY node_id) AS VARCHAR), '') AS children,
 coalesce(string_agg(CAST(node_id AS VARCHAR), ',') OVER (PARTITION BY statement_id ORDER BY node_id DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS ancestors FROM plan_ops p WHERE {_GOOD}"""),
    Query("plan_statements", lambda v: read_statements(v, "statement_text", "statement_type", "cost", "actual", "dop", "nonparallel_reason", "compile_ms", "notes", "granted_kb", "used_kb", "identity", "from_cache").select(F.col("plan_id").cast("long").alias("statement_id"), "statement_text", "statement_type", "cost", "actual", "dop", "nonparallel_reason", "compile_ms", F.size("notes").alias("notes"), "granted_kb", "used_kb", "identity.query_hash", "identity.start_offset", "from_cache"),
          f"""SELECT statement_id, concat('s', CAST(statement_id AS VARCHAR)) AS statement_text, 'SELECT' AS statement_type, CAST(statement_id AS DOUBLE) / 4 AS cost, bool_or(actual_rows IS NOT NULL) AS actual, 1 AS dop, CASE WHEN statement_id % 7 = 0 THEN 'NoParallel' END AS nonparallel_reason, CASE WHEN statement_id % 100 > 0 THEN CAST(statement_id % 100 - 1 AS DOUBLE) END AS compile_ms, CASE WHEN statement_id % 100 = 0 THEN 1 ELSE 0 END AS notes,
 CASE WHEN statement_id % 2 = 0 THEN CAST(statement_id % 1000 AS DOUBLE) END AS granted_kb, CASE WHEN statement_id % 2 = 0 THEN CAST(statement_id % 10 AS DOUBLE) END AS used_kb, CAST(statement_id % 50 AS VARCHAR) AS query_hash, CASE WHEN statement_id % 3 = 0 THEN statement_id % 90 END AS start_offset, statement_id % 2 = 0 AS from_cache FROM plan_ops WHERE {_GOOD} GROUP BY statement_id"""),
    Query("operator_warnings", lambda v: read_operators(v, "node_id").where("size(warnings) > 0").select("statement_id", "node_id", F.array_join("warnings", "; ").alias("warnings")),
          f"SELECT statement_id, node_id, concat_ws('; ', CASE WHEN spilled AND object_no % 2 = 1 THEN 'Spill to tempdb' END, CASE WHEN spilled AND object_no % 2 = 0 THEN 'Runtime spill' END, CASE WHEN converted THEN concat('Plan-affecting conversion: CONVERT_IMPLICIT(int,c', CAST(object_no AS VARCHAR), ')') END, CASE WHEN residual THEN 'Residual predicate' END, CASE WHEN scalar_udf THEN 'Scalar function' END) AS warnings FROM plan_ops WHERE (spilled OR converted OR residual OR scalar_udf) AND {_GOOD}"),
    Query("read_plans", lambda v: H.shred(documents(v), columns=()).groupBy("plan_id").agg(F.max("reject").alias("reject"), F.count_if(F.col("kind") == "operator").alias("operators")), "SELECT CAST(statement_id AS VARCHAR) AS plan_id, CASE WHEN statement_id % 101 = 0 THEN 'empty' WHEN statement_id % 103 = 0 THEN 'malformed' WHEN statement_id % 107 = 0 THEN 'wrong root' END AS reject, CASE WHEN statement_id % 101 = 0 OR statement_id % 103 = 0 OR statement_id % 107 = 0 THEN 0 ELSE count(*) END AS operators FROM plan_ops GROUP BY statement_id"),
    Query("quarantine", lambda v: H.shred(documents(v), columns=(), kinds=("reject",)).select("plan_id", "reject"), "SELECT DISTINCT CAST(statement_id AS VARCHAR) AS plan_id, CASE WHEN statement_id % 101 = 0 THEN 'empty' WHEN statement_id % 103 = 0 THEN 'malformed' ELSE 'wrong root' END AS reject FROM plan_ops WHERE statement_id % 101 = 0 OR statement_id % 103 = 0 OR statement_id % 107 = 0"),
    Query("embedded_plans", lambda v: H.embedded_plans(v.activity.select("source_id", "row_number", F.when(F.col("row_number") % 5 != 0, F.concat(F.lit("<p n='"), F.col("session_id") % 100, F.lit("'/>"))).otherwise("not xml").alias("query_plan"))).select("source_id", "row_number", "copies"),
          "SELECT source_id, row_number, copies FROM (SELECT source_id, row_number, count(*) OVER (PARTITION BY session_id % 100) AS copies, row_number() OVER (PARTITION BY session_id % 100 ORDER BY source_id, row_number) AS n FROM activity WHERE row_number % 5 <> 0) z WHERE n = 1"),
    Query("statistics_usage", lambda v: read_statements(v, "statistics").select("plan_id", F.explode("statistics").alias("s")).select("plan_id", "s.schema", "s.table", "s.statistics", "s.modifications", "s.sampling_percent"),
          f"SELECT CAST(statement_id AS VARCHAR) AS plan_id, 'dbo' AS schema, CAST(statement_id % 20 AS VARCHAR) AS table, s AS statistics, CAST(statement_id % 7 AS DOUBLE) AS modifications, CAST(statement_id % 100 AS DOUBLE) AS sampling_percent FROM (SELECT statement_id, unnest(CASE WHEN statement_id % 4 = 1 THEN ['s1', 's2'] ELSE ['s1'] END) AS s FROM (SELECT DISTINCT statement_id FROM plan_ops WHERE statement_id % 4 <> 0 AND {_GOOD}) y) z"),
    Query("spill_details", lambda v: read_operators(v, "node_id", "spills").select("statement_id", "node_id", F.explode("spills").alias("s")).select("statement_id", "node_id", "s.kind", "s.inferred", "s.pages_written", "s.granted_kb", "s.used_kb", F.size("s.raw").alias("attributes")),
          f"SELECT statement_id, node_id, CASE WHEN object_no % 2 = 0 OR physical_op = 'Sort' THEN 'Sort' WHEN physical_op = 'Hash Match' THEN 'Hash' ELSE 'Generic' END AS kind, object_no % 2 = 1 AS inferred, CASE WHEN object_no % 2 = 0 THEN CAST(object_no * 8 AS DOUBLE) END AS pages_written, CASE WHEN object_no % 2 = 0 THEN CAST(statement_id % 900 AS DOUBLE) END AS granted_kb, CASE WHEN object_no % 2 = 0 THEN CAST(object_no AS DOUBLE) END AS used_kb, CASE WHEN object_no % 2 = 0 THEN 3 ELSE 0 END AS attributes FROM plan_ops WHERE spilled AND {_GOOD}"),
    Query("plan_estimate", lambda v: H.plan_estimate(v.plan_ops), f"SELECT 'PLAN-ESTIMATE' AS rule_id, statement_id, CAST(node_id AS BIGINT) AS node_id, CASE WHEN {_RATIO} >= 100 AND actual_rows >= 100000 THEN 'High' ELSE 'Medium' END AS severity, 'High' AS confidence, CAST(round({_RATIO} * log10(actual_rows + 1), 6) AS DOUBLE) AS impact FROM plan_ops WHERE actual_rows >= 10000 AND {_RATIO} >= 10"),
    Query("plan_spill", lambda v: H.plan_spill(v.plan_ops), "SELECT 'PLAN-SPILL' AS rule_id, statement_id, CAST(node_id AS BIGINT) AS node_id, CASE WHEN coalesce(actual_rows, 0) >= 100000 THEN 'High' ELSE 'Medium' END AS severity, 'High' AS confidence, coalesce(actual_rows, 0) AS impact FROM plan_ops WHERE spilled"),
    Query("plan_convert", lambda v: H.plan_convert(v.plan_ops), "SELECT 'PLAN-CONVERT' AS rule_id, statement_id, CAST(node_id AS BIGINT) AS node_id, 'Medium' AS severity, 'High' AS confidence, CAST(coalesce(actual_rows, estimated_rows) AS DOUBLE) AS impact FROM plan_ops WHERE converted"),
    Query("plan_residual", lambda v: H.plan_residual(v.plan_ops, v.plan_stmts), "SELECT 'PLAN-RESIDUAL-PREDICATE' AS rule_id, o.statement_id, CAST(node_id AS BIGINT) AS node_id, CASE WHEN NOT actual THEN 'Low' WHEN coalesce(actual_rows, estimated_rows, 0) < 10000 THEN 'Informational' ELSE 'Medium' END AS severity, CASE WHEN actual THEN 'High' ELSE 'Low' END AS confidence, CAST(coalesce(actual_rows, estimated_rows, 0) AS DOUBLE) AS impact FROM plan_ops o JOIN plan_stmts s ON s.statement_id = o.statement_id WHERE residual"),
    Query("plan_scalar_udf", lambda v: H.plan_scalar_udf(v.plan_ops), f"SELECT 'PLAN-SCALAR-UDF' AS rule_id, statement_id, {_NULL} AS node_id, 'High' AS severity, 'High' AS confidence, CAST(count(*) AS DOUBLE) AS impact FROM plan_ops WHERE scalar_udf GROUP BY statement_id"),
    Query("plan_serialization", lambda v: H.plan_serialization(v.plan_stmts, v.plan_ops), f"SELECT 'PLAN-SERIALIZATION' AS rule_id, statement_id, {_NULL} AS node_id, 'High' AS severity, 'High' AS confidence, CAST(round(cost, 6) AS DOUBLE) AS impact FROM plan_stmts WHERE nonparallel_reason IS NOT NULL AND dop = 1 AND (nonparallel_reason <> 'EstimatedDOPIsOne' OR statement_id IN (SELECT statement_id FROM plan_ops WHERE scalar_udf))"),
    Query("plan_missing_index", lambda v: H.plan_missing_index(v.plan_stmts, v.plan_ops), f"SELECT 'PLAN-MISSING-INDEX' AS rule_id, statement_id, {_NULL} AS node_id, CASE WHEN missing_index_impact >= 70 AND statement_id IN (SELECT statement_id FROM plan_ops WHERE physical_op LIKE '%Scan%') THEN 'Medium' ELSE 'Low' END AS severity, 'Medium' AS confidence, missing_index_impact AS impact FROM plan_stmts WHERE missing_index_impact > 0"),
    Query("plan_memory_grant", lambda v: H.plan_memory_grant(v.plan_stmts), f"SELECT 'PLAN-MEMORY-GRANT' AS rule_id, statement_id, {_NULL} AS node_id, CASE WHEN granted_mb - used_mb >= 512 AND (used_mb = 0 OR granted_mb / used_mb >= 8) THEN 'High' ELSE 'Medium' END AS severity, 'High' AS confidence, round(greatest(0, granted_mb - used_mb), 6) AS impact FROM plan_stmts WHERE granted_mb > 0 AND granted_mb - used_mb >= 128 AND (used_mb = 0 OR granted_mb / used_mb >= 4)"),
    Query("plan_runtime_unavailable", lambda v: H.plan_runtime_unavailable(v.plan_stmts), f"SELECT 'PLAN-RUNTIME-UNAVAILABLE' AS rule_id, statement_id, {_NULL} AS node_id, 'Not Evaluated' AS severity, 'High' AS confidence, CAST(0 AS DOUBLE) AS impact FROM plan_stmts WHERE NOT actual"),
    Query("plan_qualifications", lambda v: H.plan_qualifications(v.plan_stmts.withColumn("compile_ms", F.when(F.col("statement_id") % 2 == 0, F.col("statement_id") % 100)).withColumn("optimization_level", F.lit("FULL"))).select("statement_id", F.array_join("qualifications", ";").alias("q")), "SELECT statement_id, concat_ws(';', CASE WHEN statement_id % 2 = 0 THEN concat('Compile time=', CAST(statement_id % 100 AS VARCHAR)) END, 'Optimization level=FULL') AS q FROM plan_stmts"),
    Query("predicate_class", lambda v: H.predicate_class(_predicates(v)).select("statement_id", "node_id", "class"), f"SELECT statement_id, node_id, CASE WHEN residual THEN 'residual' WHEN lower(physical_op) LIKE '%scan%' AND object_no % 4 < 2 THEN 'non-sargable' WHEN object_no % 4 < 3 THEN 'ordinary' ELSE 'none' END AS class FROM plan_ops"),
    Query("plan_source_kind", lambda v: H.plan_source_kind(v.plan_stmts.withColumn("file_name", F.when(F.col("statement_id") % 4 == 0, "QueryStore_1.sqlplan").when(F.col("statement_id") % 4 == 1, "Last-Known-7.sqlplan"))).select("statement_id", "source_kind"), "SELECT statement_id, CASE WHEN statement_id % 4 = 0 THEN 'Query Store' WHEN statement_id % 4 = 1 THEN 'Last-known actual' WHEN actual THEN 'Actual' ELSE 'Cached estimated' END AS source_kind FROM plan_stmts"),
    Query("statement_warning_owner", lambda v: H.statement_warning_owner(v.plan_stmts.select("statement_id", F.when(F.col("statement_id") % 2 == 0, "spill").otherwise("conversion").alias("warning"), F.lit("CONVERT_IMPLICIT").alias("expression")), _predicates(v)),
          "SELECT statement_id, CASE WHEN statement_id % 2 = 0 THEN 'spill' ELSE 'conversion' END AS warning, min(node_id) AS node_id FROM plan_ops WHERE (statement_id % 2 = 0 AND (physical_op LIKE '%Sort%' OR physical_op LIKE '%Hash%')) OR (statement_id % 2 = 1 AND object_no % 4 = 1) GROUP BY ALL"),
    Query("actual_spill_operators", lambda v: H.actual_spill_operators(v.plan_ops, v.plan_stmts), "SELECT statement_id, node_id, physical_op FROM plan_ops WHERE spilled AND statement_id IN (SELECT statement_id FROM plan_stmts WHERE actual)"),
    Query("feeding_estimate_error", lambda v: H.feeding_estimate_error(read_operators(v, "node_id", "estimated_rows", "actual_rows", "ancestors")).select("statement_id", "start", F.col("node_id").cast("long").alias("node_id"), "depth", "ratio"), f"{_WALK.format(start='spilled AND ' + _GOOD)} SELECT statement_id, start, CAST(node_id AS BIGINT) AS node_id, depth, round(ratio, 6) AS ratio FROM (SELECT d.*, {_RATIO} AS ratio, row_number() OVER (PARTITION BY d.statement_id, start ORDER BY depth DESC, {_RATIO} DESC, actual_rows DESC, d.node_id) AS n FROM down d JOIN plan_ops p ON p.statement_id = d.statement_id AND p.node_id = d.node_id WHERE depth > 0 AND actual_rows >= 10000 AND {_RATIO} >= 10) z WHERE n = 1"),
    Query("plan_signals", lambda v: J.plan_signals(v.plan_stmts.withColumn("query_hash", F.when(F.col("statement_id") % 3 != 0, F.col("query_hash"))).withColumn("plan_handle", F.when(F.col("statement_id") % 2 != 0, F.col("plan_handle"))), v.plan_ops.withColumn("non_sargable", (F.lower("physical_op").contains("scan")) & (F.col("object_no") % 4 == 1))),
          """SELECT plan_id, true AS captured, bool_or(actual) AS actual, coalesce(bool_or(o.warning), false) AS warning, bool_or(nonparallel_reason IS NOT NULL) AS nonparallel, coalesce(bool_or(granted_mb > 0 AND granted_mb >= 4 * used_mb), false) AS grant_waste, coalesce(bool_or(o.scalar), false) AS scalar_function, coalesce(bool_or(o.bad), false) AS non_sargable, bool_or(s.statement_id % 6 = 0) AS missing_identity
 FROM plan_stmts s LEFT JOIN (SELECT statement_id, bool_or(spilled OR converted) AS warning, bool_or(scalar_udf) AS scalar, bool_or(lower(physical_op) LIKE '%scan%' AND object_no % 4 = 1) AS bad FROM plan_ops GROUP BY 1) o USING (statement_id) GROUP BY plan_id"""),
]
