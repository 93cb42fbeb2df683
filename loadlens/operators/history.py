"""Recurrence over cases: captures, targets and issues per object, statistics, and which evidence a server can give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadlens.plans.shred import nearest_objects

STALE_DAYS = 30


def history_captures(stmts: DataFrame, ops: DataFrame) -> DataFrame:
    """One capture per actual statement, with the objects it touches."""
    touched = ops.groupBy("statement_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("object_no")), lambda x: x.cast("string")), ",").alias("objects"))
    return stmts.where("actual").dropDuplicates(["statement_id"]).join(touched, "statement_id").select("statement_id", "plan_id", "objects")


def nearest_target(ops: DataFrame, start: DataFrame) -> DataFrame:
    """The object of each starting operator: its own, else that of the first level below with objects, if it is one object."""
    return nearest_objects(ops, start).select("statement_id", "start", "target", F.when(F.col("depth") == 0, "Exact").otherwise("Nearest access").alias("via"))


def history_observations(ops: DataFrame) -> DataFrame:
    """(statement_id, node_id, object_no, issue): each issue of each operator once."""
    a, e = F.col("actual_rows"), F.col("estimated_rows")
    off = F.greatest(a, e) / F.greatest(F.lit(1.0), F.least(a, e)) >= 10
    issues = F.array_compact(F.array(
        F.when(off & (a >= 10_000) & (a > e), "under-estimate"), F.when(off & (e >= 10_000) & (e > a), "over-estimate"), F.when(F.col("spilled"), "spill"), F.when(F.col("converted"), "conversion"), F.when(F.col("residual"), "non-sargable")))
    return ops.select("statement_id", "node_id", "object_no", F.explode(issues).alias("issue")).dropDuplicates()


def statistics_observations(verified: DataFrame) -> DataFrame:
    """(key, issue) of verified statistics: never updated, nothing sampled, or changed since."""
    issues = F.array_compact(F.array(F.when(F.col("last_updated").isNull(), "never-updated"), F.when(F.col("rows_sampled") == 0, "zero-sample"), F.when(F.col("modifications") > 0, "changed-since-update")))
    return verified.select("key", F.explode(issues).alias("issue"))


def history_upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old without the rows whose keys new has, and new."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def history_targets(observations: DataFrame) -> DataFrame:
    """Per target: servers, captures, distinct captures per issue, and when it was first and last seen; most issues first."""
    per = lambda issue: F.countDistinct(F.when(F.col("issue") == issue, F.col("capture_id")))
    return observations.groupBy("target").agg(
        F.countDistinct("server").alias("servers"), F.countDistinct("capture_id").alias("captures"), per("spill").alias("spills"), per("conversion").alias("conversions"), per("non-sargable").alias("non_sargable"),
        per("under-estimate").alias("under"), per("over-estimate").alias("over"), F.count("*").alias("issues"), F.min("seen_s").alias("first_s"), F.max("seen_s").alias("last_s")).orderBy(F.desc("issues"), "target")


def eligible_servers(snapshots: DataFrame, as_of_s: int) -> DataFrame:
    """Servers with a snapshot of at most STALE_DAYS days, a compatible tool and a statistics signal."""
    age = F.lit(as_of_s) - F.col("captured_s")
    return snapshots.where((age >= 0) & (age <= STALE_DAYS * 86400) & F.col("compatible") & F.col("statistics")).select("server").distinct()


def capability_snapshot(rows: DataFrame, as_of_s: int) -> DataFrame:
    """One row per artifact: its context if it is one, an error if it is mixed, and whether it is stale."""
    g = rows.groupBy("artifact_id").agg(F.countDistinct("server").alias("n"), F.min("server").alias("one"), F.max("captured_s").alias("captured_s"), F.max("version").alias("version"), F.max("edition").alias("edition"), F.count_if("installed").alias("tools"))
    warnings = F.array_compact(F.array(F.when(F.col("edition").isNull(), "edition"), F.when(F.col("tools") == 0, "tools"), F.when(F.lit(as_of_s) - F.col("captured_s") > STALE_DAYS * 86400, "stale")))
    return g.select("artifact_id", F.when(F.col("n") == 1, F.col("one")).alias("server"), F.when(F.col("n") > 1, "mixed contexts").when(F.col("version") < 1, "bad version").alias("error"), "version", F.array_join(warnings, ",").alias("warnings"))


def step_availability(candidates: DataFrame) -> DataFrame:
    """(candidate, step, usable, priority) from a candidate joined to its server's snapshot."""
    step = lambda n, name, ok: F.struct(F.lit(n).alias("priority"), F.lit(name).alias("step"), F.coalesce(ok, F.lit(False)).alias("usable"))
    steps = F.array(
        step(1, "query-store", (F.col("version") >= 16) & F.col("same_database") & F.col("query_hash").isNotNull()),
        step(2, "last-actual-plan", (F.col("version") >= 15) & F.col("plan_handle").isNotNull()),
        step(3, "cached-plan", F.col("plan_handle").isNotNull()), step(4, "reproduce", F.lit(True)))
    return candidates.select("candidate_id", F.explode(steps).alias("s")).select("candidate_id", "s.step", "s.usable", "s.priority")


def recommended_step(steps: DataFrame, held: DataFrame) -> DataFrame:
    """The first usable step that gives what is not held already (candidate_id, step)."""
    todo = steps.where("usable").join(held, ["candidate_id", "step"], "left_anti")
    return todo.groupBy("candidate_id").agg(F.min_by("step", "priority").alias("step"))
