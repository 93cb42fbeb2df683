"""The investigation guide, redaction, and checks of a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from loadlens.operators.rules import SEVERITIES, finding_order, rank

# The order in which kinds of steps are offered, and what each does.
STEP_ORDER = {"Not Evaluated": 1, "WIA-WORKER-EXHAUSTION": 2, "WIA-COMPILE-PRESSURE": 2, "WIA-SCHEDULER-PRESSURE": 2, "WIA-BLOCKING": 2, "WIA-RESOURCE": 3, "PLAN": 4, "WIA-WAIT": 5, "WIA-TRANSACTION": 6}
# Evidence labels whose values are hidden; forms of optimizer tokens and of compile numbers that are shown.
_SENSITIVE = r"(?i)(sql|command|database|host|login|program|parameter|object|predicate|expression|warning|statement text|table|column|index)"
_TOKEN, _COMPILED = r"^[A-Za-z0-9_.:-]{1,128}$", r"(?i)^([0-9]+([.][0-9]+)?|[.][0-9]+)(e[+-]?[0-9]+)? (ms|KB)$"
_CONVERSION = r"(?i)^plan-affecting conversion:.*"


def guide_conclusion(findings: DataFrame, n: int = 2) -> DataFrame:
    """The best findings of Critical or High severity."""
    return findings.where(F.col("severity").isin("Critical", "High")).orderBy(*finding_order()).limit(n).select("rule_id", "subject", "severity")


def guide_subjects(acts: DataFrame, touched: DataFrame, n: int = 5) -> DataFrame:
    """At most n episodes touched by actionable findings, first rows first: latest state, longest duration, whether blocked."""
    rows = acts.join(touched.select("episode").distinct(), "episode", "left_semi")
    latest = F.max_by("status", F.struct(F.coalesce("capture_s", F.lit(2**62)), "row_number"))
    g = rows.groupBy("episode").agg(F.min("row_number").alias("first_row"), latest.alias("status"), F.max("duration_seconds").alias("duration"), F.coalesce(F.bool_or(F.col("blocking_session_id") > 0), F.lit(False)).alias("blocked"))
    return g.orderBy("first_row").limit(n)


def guide_steps(findings: DataFrame, n: int = 5) -> DataFrame:
    """Candidate steps in their fixed order; the same action for the same kind of finding is one step."""
    kind = F.when(F.col("severity") == "Not Evaluated", "Not Evaluated").when(F.col("rule_id").startswith("PLAN-"), "PLAN").otherwise(F.col("rule_id"))
    loud = findings.where("severity <> 'Informational'").withColumn("kind", kind)
    g = loud.groupBy("kind").agg(F.max(rank(F.col("severity"), SEVERITIES)).alias("worst"), F.count("*").alias("sources"), F.max("impact").alias("impact"))
    g = g.withColumn("priority", F.coalesce(rank(F.col("kind"), STEP_ORDER), F.lit(9)))
    place = F.row_number().over(Window.orderBy("priority", F.desc("worst"), F.desc("impact"), "kind"))
    return g.withColumn("step", place).where(F.col("step") <= n).select("step", "kind", "priority", "sources")


def missing_evidence(findings: DataFrame, n: int = 8) -> DataFrame:
    return findings.where("severity = 'Not Evaluated'").groupBy("subject").agg(F.count("*").alias("n")).orderBy("subject").limit(n)


KEEP, DROP = object(), object()
#: What becomes of a field: KEEP, DROP, a text that stands for it, a function of its column, or rules for the fields inside.
Rule = object | str | Callable[[Column], Column] | dict


def redacted(df: DataFrame, rules: dict[str, Rule], path: str = "") -> DataFrame:
    """df with each field as rules say, down to the last nested one. A field without a rule, or a nested one that is kept as a
    whole, is an error, so that what is added later cannot get out by itself."""
    return df.select(*_ruled(lambda name: F.col(f"`{name}`"), df.schema, rules, path))


def _ruled(get: Callable[[str], Column], kind: StructType, rules: dict[str, Rule], path: str) -> list[Column]:
    missing = [f"{path}{f.name}" for f in kind.fields if f.name not in rules]
    if missing:
        raise ValueError(f"no rule for {', '.join(missing)}")
    return [_rule(get(f.name), f.dataType, rules[f.name], f"{path}{f.name}").alias(f.name) for f in kind.fields if rules[f.name] is not DROP]


def _rule(c: Column, kind: DataType, rule: Rule, path: str) -> Column:
    inner = kind.elementType if isinstance(kind, ArrayType) else kind
    if rule is KEEP:
        if isinstance(inner, (StructType, MapType, ArrayType)):
            raise ValueError(f"no rules for the fields of {path}")
        return c
    if isinstance(rule, str):
        return F.transform(c, lambda x: F.when(x.isNotNull(), rule)) if isinstance(kind, ArrayType) else F.when(c.isNotNull(), rule)
    if callable(rule):
        return F.transform(c, rule) if isinstance(kind, ArrayType) else rule(c)
    if not isinstance(inner, StructType):
        raise ValueError(f"{path} has no fields for its rules")
    whole = lambda x: F.when(x.isNotNull(), F.struct(*_ruled(lambda name: x[name], inner, rule, f"{path}.")))
    return F.transform(c, whole) if isinstance(kind, ArrayType) else whole(c)


def shown_token(c: Column) -> Column:
    return F.when(c.rlike(_TOKEN), c).otherwise(F.when(c.isNotNull(), "[redacted optimizer value]"))


def shown_warning(c: Column) -> Column:
    return F.regexp_replace(c, _CONVERSION, "Plan-affecting conversion: [redacted expression]")


def redact_label(label: Column, value: Column) -> Column:
    return F.when(label.rlike(_SENSITIVE), "[redacted]").otherwise(value)


def redact_text(text: Column) -> Column:
    """Session numbers and hexadecimal identities in generated text are replaced."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)\b(session|spid)\s+\d+", "$1 [n]"), r"(?i)\b0x[0-9a-f]+\b", "[identity]")


def _evidence(e: Column) -> Column:
    return F.struct(e["label"].alias("label"), redact_label(e["label"], e["value"]).alias("value"))


def _qualification(q: Column) -> Column:
    token = q["kind"].isin("Optimizer early abort", "Optimization level")
    return F.struct(q["kind"].alias("kind"), F.when(token, shown_token(q["value"])).when(q["value"].rlike(_COMPILED), q["value"]).otherwise("[redacted compile value]").alias("value"))


#: Findings, plans and cases as they may leave: every field that they can have, and what becomes of it.
FINDING_RULES: dict[str, Rule] = {
    **dict.fromkeys(("finding_id", "rule_id", "severity", "confidence", "category", "title", "impact", "n_rows", "first_s", "last_s", "persistence", "profile"), KEEP), "subject": redact_text, "summary": redact_text, "limitations": redact_text, "next_capture": redact_text,
    "row_ids": DROP, "first_row": DROP, "evidence": _evidence, "qualifications": _qualification,
    "blocking": {**dict.fromkeys(("root_status", "victims", "depth", "open_transactions"), KEEP), "root": KEEP, "database_name": "[redacted]", "command_preview": "[redacted command preview]"},
}
PLAN_RULES: dict[str, Rule] = {
    **dict.fromkeys(("plan_id", "statement_id", "actual", "cost", "dop", "missing_index_impact", "granted_mb", "used_mb"), KEEP), **dict.fromkeys(("plan_handle", "sql_handle", "query_hash", "plan_hash", "qs_query_id", "qs_plan_id", "database_id"), DROP),
    "statement_text": "[redacted SQL]", "nonparallel_reason": shown_token, "early_abort": shown_token, "optimization_level": shown_token, "warnings": shown_warning,
    "operators": {**dict.fromkeys(("node_id", "physical_op", "logical_op", "estimated_rows", "actual_rows", "parallel"), KEEP), "object_name": "[redacted object]", **dict.fromkeys(("predicate", "seek_predicate", "residual_predicate", "non_sargable_predicate"), "[redacted expression]"), "warnings": shown_warning},
}
CASE_RULES: dict[str, Rule] = {
    **dict.fromkeys(("case_id", "profile", "status", "first_s", "last_s"), KEEP), **dict.fromkeys(("root_session_id", "root_identity", "ticket", "notes", "title"), DROP), "headline": redact_text,
    "assertions": {**dict.fromkeys(("assertion", "state", "confidence", "artifacts"), KEEP), "basis": redact_text, "missing": redact_text}, "artifacts": {**dict.fromkeys(("kind", "adapter", "captured_at", "signals"), KEEP), "file_name": DROP, "hash": DROP, "identity": DROP, "details": DROP},
}


def redact_findings(findings: DataFrame) -> DataFrame:
    """Findings without record ids, with sensitive values hidden by their labels."""
    return redacted(findings, FINDING_RULES)


def redact_plans(stmts: DataFrame) -> DataFrame:
    """Statements, with their operators inside, without texts, identities, objects and predicates; numbers are kept."""
    return redacted(stmts, PLAN_RULES)


def redact_case(cases: DataFrame) -> DataFrame:
    """Cases with their assertions and artifacts, of which only listed fields are kept, generated texts without identities."""
    return redacted(cases, CASE_RULES)


def report_checks(findings: DataFrame, steps: DataFrame, stmts: DataFrame, ops: DataFrame) -> DataFrame:
    """(check, n) of the violations of each check; no row means a valid report."""
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    parts = [
        count("operator without statement", ops.join(stmts, "statement_id", "left_anti")),
        count("statement without plan", stmts.where("plan_id is null")),
        count("unknown severity", findings.where(rank(F.col("severity"), SEVERITIES).isNull())),
        count("negative impact", findings.where("impact < 0 and rule_id <> 'WIA-BLOCKING'")),
        count("step order", steps.withColumn("want", F.row_number().over(Window.orderBy("step"))).where("step <> want")),
        count("estimate without rows", ops.where("estimated_rows is null or estimated_rows < 0")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")
