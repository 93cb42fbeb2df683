"""Queries of the guide, redaction and report checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.catalog.activity import acts
from loadlens.catalog.base import Query
from loadlens.catalog.rules import _MISSING, _SEV, ALL, _missing, _shown, found
from loadlens.operators import guide as G
from loadlens.operators import rules as R

_CONF = "CASE confidence WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END"
_KIND = "CASE WHEN severity = 'Not Evaluated' THEN 'Not Evaluated' ELSE rule_id END"
_PRIORITY = "CASE kind WHEN 'Not Evaluated' THEN 1 WHEN 'WIA-WORKER-EXHAUSTION' THEN 2 WHEN 'WIA-COMPILE-PRESSURE' THEN 2 WHEN 'WIA-SCHEDULER-PRESSURE' THEN 2 WHEN 'WIA-BLOCKING' THEN 2 WHEN 'WIA-RESOURCE' THEN 3 WHEN 'WIA-WAIT' THEN 5 WHEN 'WIA-TRANSACTION' THEN 6 ELSE 9 END"
STEP_CTES = f"k AS (SELECT *, {_KIND} AS kind FROM findings WHERE severity <> 'Informational'), g AS (SELECT kind, max({_SEV}) AS worst, count(*) AS sources, max(impact) AS impact FROM k GROUP BY kind), st AS (SELECT row_number() OVER (ORDER BY {_PRIORITY}, worst DESC, impact DESC, kind) AS step, kind, {_PRIORITY} AS priority, sources FROM g)"
STEPS = f"{ALL}, {STEP_CTES}"


def _touched(v):
    return found(v).where("rule_id in ('WIA-RESOURCE', 'WIA-TRANSACTION') and severity = 'High'").select(F.col("subject").alias("episode"))


def _redacted_findings(v):
    k = F.col("row_number")
    token = F.when(k % 3 == 0, "bad_token.1").otherwise(F.concat(F.lit("secret "), F.col("login_name")))
    pair = lambda a, x, c, y: F.struct(F.lit(x).alias(a), y.alias(c))
    f = v.activity.select(
        k.alias("finding_id"), k.alias("first_row"), F.array(k).alias("row_ids"), F.array(pair("label", "SQL text", "value", F.col("sql_text")), pair("label", "Status", "value", F.col("status"))).alias("evidence"),
        F.array(pair("kind", "Optimization level", "value", token), pair("kind", "Compile time", "value", F.when(k % 2 == 0, "12 ms").otherwise("12 ms of SELECT 1"))).alias("qualifications"), F.struct(F.col("database_name"), F.col("blocking_session_id").alias("root")).alias("blocking"))
    out = G.redact_findings(f)
    shown = F.array_join(F.transform("evidence", lambda e: F.concat_ws("=", e["label"], e["value"])), ";")
    return out.select("finding_id", shown.alias("shown"), F.col("qualifications")[0]["value"].alias("token"), F.col("qualifications")[1]["value"].alias("compiled"), "blocking.database_name", F.lit(",".join(out.columns)).alias("fields"))


def _redacted_plans(v):
    """Statements with their few operators inside."""
    warning = F.when(F.col("converted"), F.concat(F.lit("plan-affecting conversion: t"), F.col("object_no")))
    ops = v.plan_ops.groupBy("statement_id").agg(F.collect_list(F.struct("node_id", "physical_op", "estimated_rows", "actual_rows", F.concat(F.lit("dbo.t"), "object_no").alias("object_name"), F.lit("a = 1").alias("predicate"), F.array_compact(F.array(warning)).alias("warnings"))).alias("operators"))
    reason = F.when((F.col("statement_id") % 4 == 0) | F.col("nonparallel_reason").isNull(), F.col("nonparallel_reason")).otherwise(F.concat(F.col("nonparallel_reason"), F.lit(" of t")))
    out = G.redact_plans(v.plan_stmts.withColumn("nonparallel_reason", reason).join(ops, "statement_id"))
    once = lambda c: F.array_join(F.array_distinct(c), "|")
    return out.select("statement_id", "statement_text", "cost", "nonparallel_reason", once(F.transform("operators", lambda o: o["object_name"])).alias("objects"), once(F.flatten(F.transform("operators", lambda o: o["warnings"]))).alias("warnings"), F.size("operators").cast("long").alias("operators"), F.lit(",".join(out.columns)).alias("fields"))


def _redacted_cases(v):
    text = F.concat(F.lit("session "), F.col("session_id"), F.lit(" held 0xAB"), F.col("session_id"))
    cases = v.activity.groupBy("session_id").agg(F.collect_list(F.struct(F.lit("chain").alias("assertion"), F.lit("Observed").alias("state"), text.alias("basis"))).alias("assertions"))
    out = G.redact_case(cases.select(F.concat(F.lit("case-"), "session_id").alias("case_id"), F.col("session_id").alias("root_session_id"), F.lit("said by Ann").alias("notes"), "assertions"))
    return out.select("case_id", F.size("assertions").cast("long").alias("assertions"), F.array_join(F.array_distinct(F.transform("assertions", lambda a: a["basis"])), "|").alias("basis"), F.lit(",".join(out.columns)).alias("fields"))


QUERIES = [
    Query("guide_conclusion", lambda v: G.guide_conclusion(_shown(found(v))), f"{ALL} SELECT rule_id, subject, severity FROM findings WHERE severity IN ('Critical', 'High') ORDER BY {_SEV} DESC, {_CONF} DESC, round(impact, 6) DESC, subject LIMIT 2"),
    Query("guide_subjects", lambda v: G.guide_subjects(acts(v), _touched(v)), f"{ALL} SELECT episode, min(row_number) AS first_row, arg_max(status, row(coalesce(capture_s, 4611686018427387904), row_number)) AS status, max(duration_seconds) AS duration, coalesce(bool_or(blocking_session_id > 0), false) AS blocked FROM acts WHERE episode IN (SELECT subject FROM findings WHERE rule_id IN ('WIA-RESOURCE', 'WIA-TRANSACTION') AND severity = 'High') GROUP BY episode ORDER BY first_row LIMIT 5"),
    Query("guide_steps", lambda v: G.guide_steps(found(v)), f"{STEPS} SELECT CAST(step AS INTEGER) AS step, kind, priority, sources FROM st WHERE step <= 5"),
    Query("missing_evidence", lambda v: G.missing_evidence(R.unavailable_findings(_missing(v))), f"SELECT concat('missing: ', missing) AS subject, count(*) AS n FROM ({_MISSING}) m GROUP BY 1 ORDER BY subject LIMIT 8"),
    Query("redact_findings", _redacted_findings, "SELECT row_number AS finding_id, concat('SQL text=[redacted];Status=', status) AS shown, CASE WHEN row_number % 3 = 0 THEN 'bad_token.1' ELSE '[redacted optimizer value]' END AS token, CASE WHEN row_number % 2 = 0 THEN '12 ms' ELSE '[redacted compile value]' END AS compiled, '[redacted]' AS database_name, 'finding_id,evidence,qualifications,blocking' AS fields FROM activity"),
    Query("redact_plans", _redacted_plans, """SELECT statement_id, '[redacted SQL]' AS statement_text, cost, CASE WHEN nonparallel_reason IS NOT NULL THEN CASE WHEN statement_id % 4 = 0 THEN nonparallel_reason ELSE '[redacted optimizer value]' END END AS nonparallel_reason, '[redacted object]' AS objects, CASE WHEN bool_or(converted) THEN 'Plan-affecting conversion: [redacted expression]' ELSE '' END AS warnings, count(*) AS operators,
 'statement_id,plan_id,actual,cost,missing_index_impact,granted_mb,used_mb,nonparallel_reason,dop,statement_text,operators' AS fields FROM plan_stmts JOIN plan_ops USING (statement_id) GROUP BY statement_id, cost, nonparallel_reason"""),
    Query("redact_case", _redacted_cases, "SELECT concat('case-', CAST(session_id AS VARCHAR)) AS case_id, count(*) AS assertions, 'session [n] held [identity]' AS basis, 'case_id,assertions' AS fields FROM activity GROUP BY session_id"),
    Query("report_checks", lambda v: G.report_checks(found(v), G.guide_steps(found(v)), v.plan_stmts.where("statement_id % 10 <> 3"), v.plan_ops), "SELECT 'operator without statement' AS \"check\", count(*) AS n FROM plan_ops WHERE statement_id NOT IN (SELECT statement_id FROM plan_stmts WHERE statement_id % 10 <> 3) HAVING count(*) > 0"),
]
