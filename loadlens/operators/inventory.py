"""What a run holds, counted: plans, keys of the whole, kinds of evidence, states, and memory and plan-cache pressure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.operators.rules import SEVERITIES, rank


def severity_profile(findings: DataFrame) -> DataFrame:
    """Findings per severity, zeros included."""
    all_ = findings.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return all_.join(findings.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def findings_view(findings: DataFrame, severity: str | None = None, category: str | None = None, text: str | None = None) -> DataFrame:
    """Findings of a severity and category whose rule, title, summary or subject holds the text, in any case."""
    out = findings if severity is None else findings.where(F.col("severity") == severity)
    out = out if category is None else out.where(F.col("category") == category)
    if text:
        out = out.where(F.lower(F.concat_ws("\n", *(c for c in ("rule_id", "title", "summary", "subject") if c in findings.columns))).contains(text.lower()))
    return out


def plan_record_link(plans: DataFrame, activity: DataFrame) -> DataFrame:
    """Each plan (source_record) with the activity row that carried it."""
    p, a = plans.alias("p"), activity.alias("a")
    return p.join(a, F.col("p.source_record") == F.col("a.row_number")).select("p.*", "a.session_id", "a.source_id").drop("source_record")


def plan_inventory(stmts: DataFrame, shown: int = 4) -> DataFrame:
    """Per plan: actual or estimated, version, statements, and the texts of the first ones (by statement_id).

    The first texts are the smallest of pairs, so only so many of a plan are kept while it is gathered."""
    version = F.max("version") if "version" in stmts.columns else F.lit(None).cast("string")
    first = stmts.select("plan_id", "statement_id", "statement_text").withColumn("n", F.row_number().over(Window.partitionBy("plan_id").orderBy("statement_id"))).where(F.col("n") <= shown)
    texts = first.groupBy("plan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "statement_text"))), lambda x: x["statement_text"]), "; ").alias("texts"))
    g = stmts.groupBy("plan_id").agg(F.when(F.bool_or("actual"), "actual").otherwise("estimated").alias("kind"), version.alias("version"), F.count("*").alias("statements"))
    return g.join(texts, "plan_id", "left")


def kpi_summary(activity: DataFrame, findings: DataFrame, stmts: DataFrame, present: DataFrame, not_run: DataFrame) -> DataFrame:
    """One row: the highest severity, urgent and all findings, activity, captures and their span, sources, plans, statements,
    columns present and rules not run."""
    rows = activity.agg(F.count("*").alias("activity_rows"), F.countDistinct("capture_s").alias("capture_points"), (F.max("capture_s") - F.min("capture_s")).cast("long").alias("capture_span"), F.countDistinct("source_id").alias("sources"))
    loud = findings.agg(F.max_by("severity", rank(F.col("severity"), SEVERITIES)).alias("highest"), F.count_if(F.col("severity").isin("Critical", "High")).alias("urgent"), F.count("*").alias("findings"))
    plans = stmts.agg(F.countDistinct("plan_id").alias("plans"), F.count("*").alias("statements"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return rows.crossJoin(loud).crossJoin(plans).crossJoin(one(present, "columns_present")).crossJoin(one(not_run, "rules_not_run"))


def grant_pressure(grants: DataFrame, *keys: str) -> DataFrame:
    """Per group of memory grants (requested_kb, grant_time, wait_ms): requests that were not granted yet, and the longest wait."""
    asked = F.col("requested_kb") > 0
    g = grants.groupBy(*keys).agg(F.count_if(asked & F.col("grant_time").isNull()).alias("pending"), F.max(F.when(asked, F.col("wait_ms"))).alias("longest_wait_ms"), F.count_if(asked).alias("requests"))
    return g.withColumn("signal", F.when(F.col("pending") > 0, "grant-pending"))


def single_use_plans(plans: DataFrame, *keys: str, least: int = 1000, share: float = 0.9) -> DataFrame:
    """Per group of cached plans: how many, how many were used once at most, and whether the cache is unstable.

    plans has use_count, or the two counts as they were reported (total_plans, single_use), of which the largest count."""
    if "use_count" in plans.columns:
        g = plans.groupBy(*keys).agg(F.count("*").alias("plans"), F.count_if(F.col("use_count") <= 1).alias("single"))
    else:
        g = plans.groupBy(*keys).agg(F.max("total_plans").cast("long").alias("plans"), F.max("single_use").cast("long").alias("single"))
    return g.withColumn("unstable", (F.col("plans") >= least) & (F.col("single") >= share * F.col("plans")))


def counted(rows: DataFrame, by: str) -> DataFrame:
    """Rows per value: states of assertions, kinds of evidence."""
    return rows.groupBy(by).agg(F.count("*").alias("count"))


def history_summary(cases: DataFrame, captures: DataFrame) -> DataFrame:
    """One row: cases (case_id, resolved) by state, and the captures (capture_id, actual) that hold actual plans."""
    c = cases.groupBy("case_id").agg(F.bool_or("resolved").alias("resolved")).agg(F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"))
    return c.crossJoin(captures.agg(F.countDistinct(F.when(F.col("actual"), F.col("capture_id"))).alias("actual_captures")))


def tool_inventory(tools: DataFrame) -> DataFrame:
    """One row: tools that are installed, and those of them with a usable signature."""
    return tools.agg(F.count_if("installed").alias("installed"), F.count_if(F.col("installed") & F.col("usable")).alias("usable"))


def plan_signals(stmts: DataFrame, ops: DataFrame) -> DataFrame:
    """Per plan, what its statements and operators (statement_id) say: captured, actual, warning, nonparallel, grant of four times
    what was used, scalar function, non-sargable predicate, and no identity."""
    no = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    has = lambda df, name: F.col(name) if name in df.columns else F.lit(False)
    o = ops.groupBy("statement_id").agg(no(F.col("spilled") | F.col("converted")).alias("warning"), no(F.col("scalar_udf")).alias("scalar"), no(has(ops, "non_sargable")).alias("unsargable"))
    known: Column = F.coalesce(*(F.col(c).cast("string") for c in ("query_hash", "plan_handle", "sql_handle") if c in stmts.columns), F.lit(None).cast("string")).isNotNull()
    j = stmts.join(o, "statement_id", "left")
    return j.groupBy("plan_id").agg(
        F.lit(True).alias("captured"), no(F.col("actual")).alias("actual"), no(F.col("warning")).alias("warning"), no(F.col("nonparallel_reason").isNotNull()).alias("nonparallel"),
        no((F.col("granted_mb") > 0) & (F.col("granted_mb") >= 4 * F.col("used_mb"))).alias("grant_waste"), no(F.col("scalar")).alias("scalar_function"), no(F.col("unsargable")).alias("non_sargable"), no(~known).alias("missing_identity"))
