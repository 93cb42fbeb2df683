"""Evidence tables of every shape, each signal made once, and what cases make of signals whatever the order of imports."""

import itertools

from pyspark.sql import functions as F

from loadlens.functions import scalars as S
from loadlens.operators import adapters as X
from loadlens.operators import evidence as E

AT = "2026-08-28T12:00:0"
TABLES = {
    "two samples": (104, ["captured_at", "scheduler_id", "runnable_tasks_count", "work_queue_count"], [AT + "0Z", "0", "7", "1"], [AT + "2Z", "0", "5", "0"]),
    "one sample": (104, ["evidence_set", "sample_id", "captured_at", "runnable_tasks_count"], ["schedulers", "1", AT + "0.000Z", "7"], ["SCHEDULERS", "1", AT + "0.001Z", "5"]),
    "no key": (104, ["runnable_tasks_count"], ["3"], ["4"]),
    "workers": (None, ["Active Worker Threads", "Max_Worker_Threads", "Work Queue Count"], ["511", "512", "2"], ["512", "512", "3"]),
    "queued": (None, ["active_worker_threads", "max_worker_threads", "work_queue_count"], ["10", "512", "3"]),
    "compiles": (None, ["captured_at", "SQL Compilations Per Sec", "Batch Requests Per Sec", "resource semaphore query compile waiting tasks", "cache_hit_ratio_plan_cache_pct"], [AT + "0Z", "30", "100", "2", "90 %"], [AT + "1Z", "1,000", "4000", "0", "80%"]),
    "locks": (104, ["request_session_id", "request_status", "request_mode", "resource_type", "resource_database_id", "resource_associated_entity_id"], ["104", "GRANT", "IX", "OBJECT", "5", "9001"], ["301", "WAIT", "IX", "object", "5", "9001"]),
    "bare locks": (104, ["request_session_id", "request_status", "request_mode"], ["104", "GRANT", "IX"], ["301", "WAIT", "IX"]),
    "described": (104, ["session_id", "request_status", "request_mode", "resource_type", "resource_database_id", "resource_associated_entity_id", "resource_description"], ["104", "", "X", "KEY", "5", "1", None], ["301", "convert", "X", "KEY", "5", "1", None]),
    "transactions": (104, ["spid", "open_tran_count"], ["104", "2"], ["9", "0"]),
    "grants": (None, ["session_id", "requested_memory_kb", "granted_memory_kb", "grant_time"], ["7", "2,048 KB", "NULL", "n/a"]),
    "counters": (None, ["captured_at", "counter_name", "cntr_value"], *[[AT + t, n, v] for t, n, v in (("0Z", "Batch Requests/sec", "10000"), ("0Z", "SQL Compilations/sec", "2000"), ("2Z", "Batch Requests/sec", "10100"), ("2Z", "SQL Compilations/sec", "2030"))]),
    "report": (None, ["captured_at", "session_id", "plan_handle", "Warnings", "plan_count", "single_use_plan_count"], [AT + "1Z", "104", "0xABCD", "Plan Cache Instability; Single-Use; Forced Serialization; Compilation Timeout; Unused Memory Grant; Filter UDF; non-SARGable", "35600", "35000"]),
    "spills": (None, ["Total Spills", "Avg Spills", "# Executions", "Plan Handle", "Query Hash"], ["158870", "15887", "10", "0xAAA", "0x111"]),
    "inventory": (None, ["usecounts", "cacheobjtype", "objtype"], *[["1", "Compiled Plan", "Adhoc"]] * 1000),
    "plan": (None, ["evidence_set", "session_id", "query_plan"], ["REQUEST_PLAN", "5", '<x:ShowPlanXML xmlns:x="u"/>']),
    "no plan": (None, ["evidence_set", "session_id", "query_plan"], ["REQUEST_PLAN", "5", "NULL"]),
    "store": (None, ["query_id", "plan_id", "avg_duration"], ["1", "2", "3"]),
    "events": (None, ["name", "note"], ["query_post_execution_showplan", "THREADPOOL and RESOURCE_SEMAPHORE"]),
    "server": (None, ["result_set", "edition"], ["server_capabilities", "x"]),
    "other": (None, ["a", "b"], ["1", "2"], [None, " "]),
    "empty": (None, ["request_mode", "session_id"]),
}
SIGNALS = {
    "two samples": {"scheduler-runnable-queue", "scheduler-pressure-sustained", "worker-queue"}, "one sample": {"scheduler-runnable-queue"}, "no key": {"scheduler-runnable-queue"}, "workers": {"worker-exhaustion-confirmed"}, "queued": {"worker-queue"},
    "compiles": {"compilation-pressure", "plan-cache-pressure-wide"}, "locks": {"root-locks-granted", "lock-resource-match"}, "bare locks": {"root-locks-granted"}, "described": {"root-locks-granted"}, "transactions": {"root-open-transaction"},
    "grants": {"pending-memory-grant"}, "counters": {"compilation-pressure"},
    "report": {"plan-cache-warning", "plan-cache-instability", "single-use-warning", "forced-serialization", "compilation-timeout", "unused-memory-grant", "filter-udf", "non-sargable", "plan-cache-instability-measured"}, "spills": {"spill-evidence"},
    "inventory": {"plan-cache-instability-measured"}, "plan": {"embedded-plan-captured"}, "no plan": {"plan-lookup-null"}, "store": {"query-store-evidence"}, "events": {"extended-events-evidence", "worker-queue", "pending-memory-grant"}, "server": {"server-capabilities"},
}


def rows_of(spark, tables):
    cells = [(name, i, row) for name, (_, *rows) in tables.items() for i, row in enumerate(rows)]
    return X.evidence_rows(spark.createDataFrame(cells, "artifact_id string, line long, cells array<string>"), spark.createDataFrame([(n, t[0]) for n, t in tables.items()], "artifact_id string, root_session_id long"))


def test_each_shape_and_signal(spark):
    rows = rows_of(spark, TABLES).cache()
    shapes = X.evidence_shape(rows).cache()
    got = {}
    for r in X.evidence_signals(rows, shapes).collect():
        got.setdefault(r.artifact_id, set()).add(r.signal)
    assert got == SIGNALS
    made = set().union(*SIGNALS.values()) | {"plan-captured", "nonparallel-reason", "plan-memory-overgrant"}  # the last three are of plans
    assert {s for rule in E.RULES for s in rule[1]} <= made  # no rule waits for what nothing gives
    seen = {r.artifact_id: r for r in shapes.collect()}
    assert seen["compiles"].adapter == "compilation-counters" and seen["report"].shapes == ["report", "plan-cache"] and seen["store"].result_sets == ["QUERY_STORE"]
    assert "empty" not in seen and seen["other"].rows == 1
    found = {(r.artifact_id, r.metric): r for r in X.evidence_observations(rows, shapes).collect()}
    assert round(found["report", "single_use_percentage"].value, 3) == 98.315 and found["counters", "compilation_to_batch_ratio"].value == 0.3 and found["counters", "compilation_to_batch_ratio"].directness == "Derived"
    assert found["spills", "total_spill_pages"].value == 158870 and found["spills", "total_spill_pages"].plan_handle == "0xAAA" and found["grants", "requested_memory_kb"].value == 2048
    assert found["bare locks", "request_status"].detail == "Incomplete lock resource identity" and found["no plan", "query_plan_available"].text == "false" and len(found["report", "warning"].signals) == 7


def test_one_lock_with_many_waiters_makes_no_product(spark):
    """A resource is one row: as many rows as locks come out of no join, whatever waits for it."""
    n = 20_000
    table = (104, TABLES["locks"][1], ["104", "GRANT", "IX", "OBJECT", "5", "9001"], *[[str(1000 + i), "WAIT", "IX", "OBJECT", "5", "9001"] for i in range(n)])
    rows = rows_of(spark, {"hot": table})
    shapes = X.evidence_shape(rows)
    assert {r.signal for r in X.evidence_signals(rows, shapes).collect()} == {"root-locks-granted", "lock-resource-match"}
    assert X.evidence_observations(rows, shapes).count() == n + 1


CASES = "case_id string, source_id string, profile string, chain boolean, root_status string, open_transactions long, plan_rule boolean"
PLACED = "source_id string, artifact_id string, signal string, import_order int, overlap string, correlated boolean"


def states(spark, signals, profile="cpu-backed-blocking", status="runnable", trans=1, spills=None):
    cases = spark.createDataFrame([("c", "s", profile, True, status, trans, False)], CASES)
    placed = spark.createDataFrame([("s", a, x, i, o, t) for i, (a, x, o, t) in enumerate(signals)], PLACED)
    sp = spark.createDataFrame([("c", *spills)], "case_id string, candidates long, ranked long, plan string") if spills else None
    return {r.assertion: r for r in E.assertion_states(E.initial_assertions(cases), placed, cases, sp).collect()}


FULL = [("a1", "scheduler-pressure-sustained", "Exact", False), ("a2", "lock-resource-match", "Unknown", False), ("a3", "embedded-plan-captured", "Exact", True), ("a4", "compilation-pressure", "Overlapping", False), ("a5", "forced-serialization", "Unknown", False), ("a6", "worker-queue", "Exact", False)]


def test_all_four_states(spark):
    got = states(spark, FULL)
    assert {a: got[a].state for a in ("blocking-chain", "root-lock-owner", "scheduler-pressure", "serialization", "plan-captured", "memory-grant-pressure", "causal-theory")} == {
        "blocking-chain": "Observed", "root-lock-owner": "Observed", "scheduler-pressure": "Supported", "serialization": "Not Evaluated", "plan-captured": "Observed", "memory-grant-pressure": "Not Evaluated", "causal-theory": "Supported"}
    assert got["serialization"].missing == ["an identity shared with the root"] and got["serialization"].artifacts == 1 and got["scheduler-pressure"].confidence == "Medium" and got["causal-theory"].missing == ["the same pattern again"]
    zero = states(spark, [*FULL, ("a7", "root-locks-granted", "Exact", False)], status="sleeping", trans=0)
    assert (zero["root-runnable"].state, zero["open-transactions"].state, zero["causal-theory"].state) == ("Contradicted", "Contradicted", "Not Evaluated")
    assert zero["causal-theory"].basis == "no open transaction at first, root locks later"
    old = states(spark, [(a, s, "Context only", t) for a, s, _, t in FULL])
    assert old["scheduler-pressure"].state == "Not Evaluated" and old["causal-theory"].missing == ["queues in several samples", "a lock of the root that victims wait for"]


def test_profiles(spark):
    assert states(spark, [("a", "worker-exhaustion-confirmed", "Exact", False)], "worker-exhaustion")["causal-theory"].state == "Supported"
    half = states(spark, [("a", "compilation-pressure", "Exact", False)], "compile-pressure")["causal-theory"]
    assert (half.state, half.missing) == ("Not Evaluated", ["reuse of the plan cache"])
    assert states(spark, [], "plan-specific")["causal-theory"].state == "Supported"
    assert states(spark, [("a", "lock-resource-match", "Exact", False)], "transaction-blocking", "sleeping")["causal-theory"].state == "Supported"
    spill = states(spark, [], "spill-triage", spills=(5, 0, "manual"))
    assert (spill["spill-candidates"].state, spill["spill-candidates"].basis, spill["plan-captured"].state) == ("Not Evaluated", "rows without positive pages", "Supported")
    assert states(spark, [], "spill-triage", spills=(5, 3, "exact"))["spill-candidates"].state == "Observed"


def test_the_order_of_imports_changes_only_the_way(spark):
    signals = [("a1", "nonparallel-reason", "Exact", True), ("a2", "forced-serialization", "Exact", False), ("a3", "nonparallel-reason", "Unknown", True)]
    cases = spark.createDataFrame([("c", "s", "cpu-backed-blocking", True, "runnable", 1, False)], CASES)
    starts = E.initial_assertions(cases)
    ends, ways = set(), set()
    for order in itertools.permutations(range(3)):
        placed = spark.createDataFrame([("s", a, x, order[i], o, t) for i, (a, x, o, t) in enumerate(signals)], PLACED)
        ends.add(next(r.state for r in E.assertion_states(starts, placed, cases).collect() if r.assertion == "serialization"))
        steps = sorted((r.import_order, r.before, r.state) for r in E.assertion_history(starts, placed, cases).collect() if r.assertion == "serialization")
        ways.add(tuple(s[1:] for s in steps))
        assert steps[-1][2] == "Observed" and all(a[2] == b[1] for a, b in zip(steps, steps[1:]))
    assert ends == {"Observed"} and len(ways) > 1


def test_artifacts_meet_their_rows_by_a_broadcast_and_flags_need_no_sort(spark):
    cells = spark.createDataFrame([(a, line, cells) for a in ("a", "b") for line, cells in ((0, ["Session ID", "Captured At", "Runnable Tasks Count"]), (1, [" 7", "2024-01-01 00:00:15", "1,000 ms"]), (2, ["null", "n/a", " "]))], "artifact_id string, line long, cells array<string>")
    rows = X.evidence_rows(cells, spark.createDataFrame([("a", 7)], "artifact_id string, root_session_id long"))
    assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.artifact_id, r.line, r.session_id, r.runnable, str(r["at"]), r.root_session_id) for r in rows.collect()) == [("a", 1, 7.0, 1000.0, "2024-01-01 00:00:15", 7.0), ("b", 1, 7.0, 1000.0, "2024-01-01 00:00:15", None)]
    plan = X.evidence_shape(rows)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_signals_of_rows_are_those_of_the_observations(spark):
    rows = rows_of(spark, TABLES).cache()
    shapes = X.evidence_shape(rows).cache()
    told = {(r.artifact_id, s, r.plan_handle) for r in X.evidence_observations(rows, shapes).where("size(signals) > 0").collect() for s in r.signals}
    assert {(r.artifact_id, r.signal, r.plan_handle) for r in X.report_signals(rows, shapes).collect()} == told and len(told) >= 7


def test_numbers_with_and_without_units(spark):
    texts = ["7", " 1,000 ", "2,048 KB", "90 %", "5 kb 7", "1,", "ms", "", None, "3s\t", "x9", "4\t", "1e3", "-5"]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(S.evidence_number(F.col("t")).alias("n")).collect()]
    assert got == [7, 1000, 2048, 90, None, 1, None, None, None, 3, None, None, 1000, -5]
