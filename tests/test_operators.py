"""Small cases of the operators: boundaries, nulls, ties and the order of rows."""

import re

import pytest
from pyspark.sql import functions as F

from loadlens.functions import scalars as S
from loadlens.operators import activity as A
from loadlens.operators import blocking as B
from loadlens.operators import correlation as K
from loadlens.operators import counters as C
from loadlens.operators import rules as R
from loadlens.operators import spill as P
from loadlens.plans import shred as H
from loadlens.plans.reader import shred_one
from loadlens.sources import files as W
from loadlens.sources.delimited import read_capture

COLUMNS = "row_number long, source_id string, session_id long, request_id long, capture_s int, start_s int, login_s int, duration_seconds double, blocking_session_id long, blocked_session_count long, wait_info string, cpu double, reads double, writes double, used_memory double, tempdb_current double, status string, open_tran_count long, tran_start_s int, implicit_tran boolean, sql_text string"


def capture(spark, *rows):
    base = {"source_id": "s", "request_id": 0, "capture_s": 0, "start_s": 0, "status": "running", "open_tran_count": 0}
    names = [c.strip().split(" ")[0] for c in COLUMNS.split(",")]
    full = [base | {"row_number": i} | r for i, r in enumerate(rows)]
    return A.observed(spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], COLUMNS))


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "c string").select(f(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("1,234.5", 1234.5), ("2 KB", 2000.0), ("3GiB", 3e9), ("x -7e1 y", -70.0), ("null", None), ("", None), (None, None)])
def test_as_number(spark, text, want):
    assert one(spark, text, S.as_number) == want


@pytest.mark.parametrize(("text", "want"), [
    ("(12ms)LCK_M_X", ("LCK_M_X", 12, 1, "Locking")), ("(2x: 1,000ms/5ms)CXPACKET:3", ("CXPACKET", 1000, 2, "Parallelism")), ("WRITELOG waittime = 7", ("WRITELOG", 7, None, "Transaction log")),
    ("(broken", None), ("NULL", None), ("ON", None), ("N/A", None), ("(0x: 1ms)A", None),
])
def test_parse_wait(spark, text, want):
    w = one(spark, text, S.parse_wait)
    assert (w and (w.type, w.duration_ms, w.task_count, w.category)) == want


@pytest.mark.parametrize(("seconds", "want"), [(5.04, "5.0s"), (59.4, "59s"), (61.0, "1m 1s"), (3700.0, "1h 2m"), (90000.0, "1d 1h"), (None, "—")])
def test_format_duration(spark, seconds, want):
    assert spark.createDataFrame([(seconds,)], "c double").select(S.format_duration(F.col("c"))).first()[0] == want


def test_chain_of_three_and_a_cycle(spark):
    acts = capture(spark, {"session_id": 1}, {"session_id": 2, "blocking_session_id": 1}, {"session_id": 3, "blocking_session_id": 2}, {"session_id": 8, "blocking_session_id": 9}, {"session_id": 9, "blocking_session_id": 8}, {"session_id": 7, "blocking_session_id": 7})
    got = {r.row_number: (r.path, r.root, r.complete) for r in B.blocking_chain(acts).collect()}
    assert got == {1: ([2, 1], 1, True), 2: ([3, 2, 1], 1, True), 3: ([8, 9, 8], 8, False), 4: ([9, 8, 9], 8, False), 5: ([7, 7], 7, False)}


def test_missing_root_is_not_complete(spark):
    acts = capture(spark, {"session_id": 2, "blocking_session_id": 50})
    s = B.blocking_snapshots(acts).first()
    assert (s.root, s.victims, s.complete, s.root_present) == (50, 1, False, False)


def test_episodes_break_at_a_gap(spark):
    rows = [{"session_id": 1, "capture_s": t} for t in (0, 15, 30, 45)] + [{"session_id": 2, "blocking_session_id": 1, "capture_s": t} for t in (0, 15, 45)]
    acts = capture(spark, *rows)
    got = sorted((r.capture_s, r.episode_no) for r in B.blocking_episodes(B.blocking_snapshots(acts), acts).collect())
    assert got == [(0, 0), (15, 0), (45, 1)]


@pytest.mark.parametrize(("victims", "gap", "want"), [(1, 0, "Informational"), (2, 0, "Medium"), (1, 15, "Medium"), (5, 0, "High"), (1, 60, "High")])
def test_blocking_boundaries(spark, victims, gap, want):
    times = [0] if not gap else [0, gap]
    rows = [r for t in times for r in [{"session_id": 1, "capture_s": t}] + [{"session_id": 10 + i, "blocking_session_id": 1, "capture_s": t} for i in range(victims)]]
    assert R.blocking_findings(capture(spark, *rows)).first().severity == want


def test_reset_is_no_growth(spark):
    acts = capture(spark, *({"session_id": 1, "capture_s": t, "cpu": float(c)} for t, c in ((0, 10), (10, 30), (20, 5), (30, 15))))
    r = A.derived_rates(acts, "cpu").first()
    assert (r.rate, r.reset) == (30 / 20, True)


def test_latest_row_takes_null_time_first(spark):
    acts = capture(spark, {"session_id": 1, "capture_s": 5}, {"session_id": 1, "capture_s": None}, {"session_id": 1, "capture_s": 9})
    assert A.latest_row(acts, "episode").first().row_number == 1


@pytest.mark.parametrize("n", [1, 2])
def test_transient_rollup_needs_two(spark, n):
    rows = [{"session_id": i, "wait_info": "(5ms)IO_COMPLETION"} for i in range(n)]
    rules = sorted(r.rule_id for r in R.transient_rollup(R.wait_findings(capture(spark, *rows))).collect())
    assert rules == (["WIA-WAIT"] if n == 1 else ["WIA-WAIT-TRANSIENT-SUMMARY"])


def test_findings_do_not_depend_on_partitions(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    from loadlens.catalog.activity import acts
    from loadlens.sources.views import Views

    a = acts(Views(spark, "/root/testdata/sf0.001"))
    pick = lambda df: sorted((r.rule_id, r.severity, r.subject, round(r.impact, 6)) for r in df.collect())
    want = pick(R.wait_findings(a).unionByName(R.transaction_findings(a)))
    b = a.orderBy(F.desc("row_number")).repartition(7)
    assert pick(R.wait_findings(b).unionByName(R.transaction_findings(b))) == want and v.count() > 0


@pytest.mark.parametrize(("xml", "why"), [("", "empty"), ("a\0b", "NUL bytes"), ("&lt;a&gt;", "escaped XML"), ("<!DOCTYPE x><a/>", "DOCTYPE"), ("<a>", "malformed"), ("<a/>", "wrong root"), ("<ShowPlanXML/>", "no statement")])
def test_rejected_plans(xml, why):
    assert shred_one(xml) == [{"kind": "reject", "reject": why}]


def test_plan_with_nested_operators():
    xml = """<ShowPlanXML xmlns="u"><StmtSimple StatementText="q" StatementType="SELECT" StatementSubTreeCost="1.5"><QueryPlan DegreeOfParallelism="1" NonParallelPlanReason="X"><MissingIndexGroup Impact="80"/>
    <RelOp NodeId="0" PhysicalOp="Sort" EstimateRows="10"><Warnings SpillToTempDb="1"/><RunTimeInformation><RunTimeCountersPerThread ActualRows="3"/><RunTimeCountersPerThread ActualRows="4"/></RunTimeInformation>
    <RelOp NodeId="1" PhysicalOp="Index Seek"><SeekPredicates><ScalarOperator ScalarString="a=1"/></SeekPredicates><Predicate><ScalarOperator ScalarString="b=2"/></Predicate><Object Schema="dbo" Table="t" Index="i"/></RelOp></RelOp></QueryPlan></StmtSimple></ShowPlanXML>"""
    st, sort, seek = shred_one(xml)
    assert (st["cost"], st["missing_index_impact"], st["dop"], st["nonparallel_reason"]) == (1.5, 80.0, 1, "X")
    assert (sort["actual_rows"], sort["child_node_ids"], sort["warnings"], sort["object_name"]) == (7.0, [1], ["Spill to tempdb"], None)
    assert (seek["actual_rows"], seek["residual"], seek["object_name"], seek["predicate"]) == (None, True, "dbo.t.i", "b=2")


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_capture_with_any_separator(spark, tmp_path, sep):
    (tmp_path / "c.csv").write_text(f'a{sep}b\n"x{sep}\ny"{sep}"say ""hi"""\n\n1{sep}2\n')
    other = ";" if sep == "," else ","
    (tmp_path / "d.csv").write_text(f'{other.join("cdef")}\n', encoding="utf-16")
    rows = sorted(read_capture(spark, f"file://{tmp_path}").collect(), key=lambda r: r.line)
    assert [(r.cells[0], r.cells[3], r.encoding) for r in rows if r.path.endswith("d.csv")] == [("c", "f", "UTF-16LE")]
    got = [tuple(r.cells) for r in rows if r.path.endswith("c.csv")]
    assert got == [("a", "b"), (f"x{sep}\ny", 'say "hi"'), ("1", "2")]


def test_a_hot_query_makes_rows_in_proportion(spark):
    """Half of all rows are of one query: equal identities meet once, whatever their number; the results are those of pairs."""
    kind = "id long, plan_handle string, query_hash string, plan_hash string, session_id long, request_id long"
    side = lambda n, first: spark.createDataFrame([(first + i, "h" if i % 2 else f"h{i % 7}", "q" if i % 2 else f"q{i % 5}", "p" if i % 2 else None, i % 11, 0) for i in range(n)], kind)
    none = spark.createDataFrame([], "l_id long, chosen long")
    sizes = []
    for n in (60, 600):
        left, right = side(n, 0), side(n, 10_000).withColumn("actual", F.col("id") % 2 == 0)
        (lc, _), (rc, _) = K.identity_classes(left), K.identity_classes(right, "artifact", "actual")
        sizes.append(K.class_match(lc, rc, "Strong").count())
        if n == 60:
            pairs = K.identity_match(left, right).join(right.select(F.col("id").alias("r_id"), "actual"), "r_id")
            by_pairs, by_class = K.candidate_plan(pairs, none), K.candidate_plans(left, right, none)
            assert sorted(map(tuple, by_pairs.collect())) == sorted(map(tuple, by_class.collect())) and by_class.count() > 0
    assert sizes[1] <= 2 * sizes[0]


def test_a_conflict_by_key_counts_against_a_match_by_session(spark):
    """As with pairs of rows, whichever way the two statements are met; and what was chosen is compared by itself."""
    kind = "id long, plan_handle string, database_id long, session_id long, request_id long"
    left = spark.createDataFrame([(1, "h", 1, 5, 0), (2, None, None, 6, 0), (3, "k", 1, None, None)], kind)
    right = spark.createDataFrame([(10, "h", 2, None, None), (11, None, None, 5, 0), (12, None, None, 6, 0), (13, None, None, 6, 0), (14, "k", 1, None, None), (15, "k", 1, None, None)], kind).withColumn("actual", F.lit(True))
    picked = spark.createDataFrame([(2, 13), (3, 14), (1, 11)], "l_id long, chosen long")
    pairs = K.identity_match(left, right).withColumn("actual", F.lit(True))
    by_pairs, by_class = (sorted((r.l_id, r.state, r.r_id, r.ties) for r in df.collect()) for df in (K.candidate_plan(pairs, picked), K.candidate_plans(left, right, picked)))
    assert by_pairs == by_class == [(1, "blocked", None, 1), (2, "selected", 13, 2), (3, "selected", 14, 2)]


def test_candidates_are_counted_in_one_pass(spark):
    """No list is gathered, and no pair is shuffled to drop copies."""
    kind = "id long, plan_handle string, sql_handle string, query_hash string, plan_hash string, session_id long, request_id long"
    df = spark.createDataFrame([(1, "h", "s", "q", "p", 5, 0)], kind)
    plan = re.sub(r"#\d+L?", "", K.candidate_plans(df, df.withColumn("actual", F.lit(True)), spark.createDataFrame([], "l_id long, chosen long"))._jdf.queryExecution().optimizedPlan().toString())
    assert "collect_" not in plan and "Aggregate [l_cls, " in plan and "Aggregate [l_cls, r_cls]" not in plan
    all_, named = K.identity_match(df, df).select("l_id", "r_id", "quality", "matched"), K.named_pairs(df, df, spark.createDataFrame([(1, 1), (1, 2)], "l_id long, r_id long"))
    assert all_.collect() == named.select(*all_.columns).collect()


def test_many_waiters_on_one_lock(spark):
    n = 100_000
    locks = spark.range(n).selectExpr("id as session_id", "case when id < 300 then 'GRANT' else 'WAIT' end as request_status", "'OBJECT' as resource_type", "5 as database_id", "1 as entity_id", "cast(null as string) as description")
    (row,) = K.lock_resources(locks).collect()
    assert (row.holders, row.waiters, row.pairs) == (300, n - 300, 300 * (n - 300))
    assert K.lock_resource_match(locks, spark.createDataFrame([(7,)], "session_id long")).count() == n - 300
    sizes = [len(r.sessions) for r in K.lock_members(locks).collect()]
    assert sum(sizes) == n and max(sizes) < 1000


def test_entry_lists_without_session():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_sibling_statements_do_not_block(spark):
    kind = "id long, artifact string, plan_handle string, sql_handle string, start_offset long, end_offset long, query_hash string, plan_hash string"
    left = spark.createDataFrame([(1, None, "h", "s", 0, 40, "q", "p"), (2, None, "h", None, None, None, None, None), (3, None, "h", "z", 0, 40, "q", "p")], kind)
    batch = [(10, "a", "h", "s", 0, 40, "q", "p"), (11, "a", "h", "s", 42, 90, "q2", "p2")]

    def states(rows, **kinds):
        m = K.identity_match(left, spark.createDataFrame(rows, kind)).withColumn("actual", F.lit(False))
        if kinds:
            m = m.withColumn("actual", F.col("r_id").isin(kinds["actual"])).withColumn("cached", F.col("r_id").isin(kinds["cached"]))
        return {r.l_id: (r.state, r.r_id) for r in K.candidate_plan(m, spark.createDataFrame([], "l_id long, chosen long")).collect()}

    assert states(batch) == {1: ("resolved", 10), 2: ("ambiguous", None)}
    assert states([batch[0], (11, "b", *batch[1][2:])])[1] == ("blocked", None)  # of another artifact
    assert states([batch[0], (11, "a", "h", "other", 42, 90, "q2", "p2")])[1] == ("blocked", None)  # not a conflict of the statement alone
    same = [(i, f"a{i}", "h", None, None, None, None, None) for i in (10, 11, 12)]
    assert states(same, actual=[], cached=[11])[2] == ("resolved", 11)
    assert states(same, actual=[12], cached=[11])[2] == ("resolved", 12)


def test_sidecar_tiers_and_conflicts(spark):
    kind = "plan_id string, {} long, plan_handle string, sql_handle string, query_hash string, plan_hash string, start_offset long, end_offset long, qs_query_id long, qs_plan_id long, database_id long"
    st = spark.createDataFrame([("a", 1, None, "s", "q", "p", 0, 40, 7, 1, 5), ("a", 2, "h", "s", "q", "p", 42, 90, 7, 2, 5), ("b", 3, "h", "s", "q", "p", None, None, None, None, None)], kind.format("statement_id"))
    sc = [
        ("a", 1, None, None, None, None, 42, 90, None, None, None), ("a", 2, None, None, "q", "p", None, None, 7, 1, 5), ("a", 3, None, None, None, None, 42, 90, 7, 1, 6), ("a", 4, None, None, "q", "p", None, None, None, None, None),
        ("b", 5, " H ", "x", None, None, None, None, None, None, None), ("b", 6, "g", "x", "Q", None, None, None, None, None, None),
    ]
    got = {r.sidecar_id: (r.statement_id, r.tier, r.conflicts) for r in K.sidecar_identity(st, spark.createDataFrame(sc, kind.format("sidecar_id"))).collect()}
    assert got == {1: (2, "offset", []), 2: (1, "store", []), 3: (2, "offset", ["qs_plan_id", "database_id"]), 4: (None, "none", []), 5: (3, "only", []), 6: (3, "only", ["sql_handle", "plan_handle"])}


def test_compile_counters_must_all_agree(spark):
    def agrees(*rows, drop=()):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "sample_order long, source_id string, batches double, compilations double, compile_waiters double, cache_hit_ratio double").drop(*drop)
        acts = capture(spark, {"session_id": 1, "wait_info": "(5ms)RESOURCE_SEMAPHORE_QUERY_COMPILE"})
        samples = df.withColumns({"counter_name": F.lit("c"), "value": F.lit(1.0), "active_workers": F.lit(0), "max_workers": F.lit(9), "work_queue": F.lit(0)})
        found = {r.rule_id: r.confidence for r in R.all_findings(acts, samples).collect()}["WIA-COMPILE-PRESSURE"]
        assert C.compile_corroboration(df, 0.1).first().corroborated == (found == "High")
        return found == "High"

    first, last = ("a", 10.0, 1.0, 0.0, 90.0), ("a", 10.0, 0.0, 2.0, 80.0)
    assert agrees(first, last) and agrees(first, last, ("a", 0.0, 0.0, 0.0, None))
    assert not agrees(first, last, drop=["compile_waiters"]) and not agrees(first, last, drop=["cache_hit_ratio"])
    assert not agrees(first, (*last[:4], 90.0)) and not agrees(first, (*last[:3], 0.0, 80.0)) and not agrees(("a", 10.0, 0.9, 0.0, 90.0), last)
    assert not agrees(first, ("b", *last[1:])) and not agrees(first)


def test_file_queries_take_all_rows(spark):
    from loadlens import catalog

    q, sf = catalog.queries(), "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/events.parquet").agg(F.count("*").alias("n"), F.sum("event_id").alias("s"), F.countDistinct(F.floor(F.col("event_id") / 2000)).alias("files")).first()
    read = q["text_encoding"](spark, sf).collect()
    assert len(read) == 2 and (sum(r.n_rows for r in read), sum(r.n_read for r in read), sum(r.row_numbers for r in read), sum(r["count"] for r in read)) == (n.n, n.n, n.s, n.files)
    states = {r.state: r["sum(count)"] for r in q["dedupe_evidence"](spark, sf).groupBy("state").sum("count").collect()}
    assert states["taken"] == n.files > 2 and 0 < states["copy"] < n.files
    files = [r for r in q["source_manifest"](spark, sf).collect() if r.kind == "file"]
    assert len(files) == sum(states.values()) and len({r.hash for r in files}) == n.files and all(r.n > 0 for r in files)


def test_json_arrays_beside_objects_with_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rows": [{"x": 1, "y": "a"}, {"x": 2, "z": "t"}], "made": "now"}')
    (tmp_path / "b.json").write_text('[{"x": 3, "w": true}, {"x": 4, "z": 5}]')
    got = W.read_json_evidence(spark, f"file://{tmp_path}")
    assert sorted(got.columns) == ["w", "x", "y", "z"]
    assert sorted((r.x, r.y, r.z, r.w) for r in got.collect()) == [(1, "a", None, None), (2, None, "t", None), (3, None, None, True), (4, None, "5", None)]


def test_spill_ranks_over_many_ranges(spark):
    rows = [(i, float(i * 7 % 50) if i % 5 else None, float(i * 11 % 40) if i % 3 else None, i % 9) for i in range(3000)]
    df = spark.createDataFrame(rows, "source_order long, total_pages double, average double, last_execution long")
    down = lambda x: (x is None, -(x or 0))
    ranked = [r for r in rows if (r[1] or 0) > 0] + [r for r in rows if r[1] is None and (r[2] or 0) > 0]
    ranked.sort(key=lambda r: (r[1] is None, down(r[1]), down(r[2]), down(r[3]), r[0]))
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", False)  # which would join ranges this small
    try:
        out = P.spill_rank(df)
        assert {r.source_order: r["rank"] for r in out.collect()} == {r[0]: None for r in rows} | {r[0]: k + 1 for k, r in enumerate(ranked)}
        assert out.columns == [*df.columns, "basis", "rank"]
        assert "windowspecdefinition(basis" not in out._jdf.queryExecution().analyzed().toString()  # all rows of a basis in one task
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


def test_statement_warnings_go_to_an_operator():
    xml = """<ShowPlanXML><StmtSimple StatementText="q" QueryHash="0xA" StatementSqlHandle="0xB" StatementStartOffset="12" RetrievedFromCache="TRUE"><QueryPlan CompileCPU="x" CompileMemory="7"><Warnings NoJoinPredicate="1"><PlanAffectingConvert Expression="CONVERT_IMPLICIT(int, a)"/><SpillToTempDb SpillLevel="2" SpilledThreadCount="1"/></Warnings>
    <OptimizerStatsUsage><StatisticsInfo Table="[t]" Statistics="[s]" ModificationCount="3" SamplingPercent="12.5" LastUpdate="2024-01-01"/></OptimizerStatsUsage><MemoryGrantInfo GrantedMemory="8"/>
    <RelOp NodeId="0" PhysicalOp="Nested Loops" LogicalOp="Inner Join"><RelOp NodeId="1" PhysicalOp="Sort" Parallel="1"><Warnings><HashSpillDetails WritesToTempDb="5" GrantedMemoryKB="9"/></Warnings><RelOp NodeId="2" PhysicalOp="Table Scan"><Predicate><ScalarOperator ScalarString="convert_implicit(int,  A) like N'%x'"/></Predicate><Object Database="d" Table="t"/></RelOp></RelOp></RelOp></QueryPlan></StmtSimple></ShowPlanXML>"""
    st, join, sort, scan = shred_one(xml)
    assert st["identity"] | {"sql_handle": "0xB", "query_hash": "0xA", "start_offset": 12, "plan_handle": None} == st["identity"] and st["from_cache"] and not st["actual"]
    assert st["statistics"] == [{"database": None, "schema": None, "table": "[t]", "statistics": "[s]", "modifications": 3.0, "sampling_percent": 12.5, "last_update": "2024-01-01"}]
    assert (st["compile_cpu"], st["compile_memory"], st["granted_kb"], st["used_kb"], len(st["notes"])) == (None, 7.0, 8.0, 0.0, 1)
    assert join["warnings"] == ["No join predicate"] and sort["warnings"] == ["Runtime spill"] and scan["warnings"] == ["Plan-affecting conversion: CONVERT_IMPLICIT(int, a)"]
    assert scan["ancestors"] == [1, 0] and scan["non_sargable"] and scan["object"]["database"] == "d" and scan["object_name"] == "t" and sort["parallel"]
    assert [(s["kind"], s["pages_written"], s["granted_kb"], s["inferred"]) for s in sort["spills"]] == [("Hash", 5.0, 9.0, False)]


def test_descent_reaches_the_bottom(spark):
    """300 levels from an operator's children, without a cap; a ring is an error."""
    ops = spark.createDataFrame([(1, i, [i + 1] if i < 300 else []) for i in range(301)] + [(2, 0, [1, 2]), (2, 1, []), (2, 2, [])], "statement_id long, node_id long, child_node_ids array<long>")
    start = spark.createDataFrame([(1, 0), (1, 298), (2, 0)], "statement_id long, node_id long")
    got = sorted((r.statement_id, r.start, r.node_id, r.depth) for r in H.descend(ops, start).collect())
    assert got == sorted([(1, 0, i, i) for i in range(1, 301)] + [(1, 298, 299, 1), (1, 298, 300, 2), (2, 0, 1, 1), (2, 0, 2, 1)])
    with pytest.raises(ValueError, match="below itself"):
        H.with_ancestors(spark.createDataFrame([(1, 1, [2]), (1, 2, [3]), (1, 3, [1])], "statement_id long, node_id long, child_node_ids array<long>"))


@pytest.mark.parametrize(("text", "unit", "want"), [("12 8KB pages", "pages", (12.0, "imported")), ("1,024 KiB", "kib", (128.0, "imported")), ("3 MB", "pages", (None, "invalid")), ("n/a", "pages", (None, "missing")), ("0", "gb", (0.0, "zero-or-nonpositive")), ("-1", "pages", (None, "invalid")), ("2 furlongs", "pages", (None, "invalid"))])
def test_spill_number(spark, text, unit, want):
    got = one(spark, text, lambda c: S.spill_number(c, unit))
    assert (got.value, got.state) == want


@pytest.mark.parametrize(("text", "want"), [("1 02:03:04.5 more", 93784.5), ("00:00:59", 59.0), ("1:2:3", None), ("2 days", None), (None, None)])
def test_duration_seconds(spark, text, want):
    assert one(spark, text, S.duration_seconds) == want


@pytest.mark.parametrize(("text", "want"), [("1:00:02.5", 3602500.0), ("2 min, 3 secs", 123000.0), ("5 fortnights", None), ("not supplied", None), ("1:99:00", None)])
def test_spill_duration(spark, text, want):
    assert one(spark, text, S.spill_duration_ms) == want


def test_deep_chains_in_few_rounds(spark, monkeypatch):
    """200 sessions in a row, and a ring of 50 with a tail: as many rounds as the logarithm of the depth."""
    rows = [{"session_id": i, "blocking_session_id": i - 1 if i > 1 else None} for i in range(1, 201)] + [{"session_id": 500 + i, "blocking_session_id": 500 + (i + 1) % 50} for i in range(50)] + [{"session_id": 900, "blocking_session_id": 510}]
    rounds, plain = [], B.saved
    monkeypatch.setattr(B, "saved", lambda *a: rounds.append(1) or plain(*a))
    got = {r.row_number: r for r in B.blocking_chain(capture(spark, *rows)).collect()}
    assert len(rounds) <= 10
    assert got[199].path == list(range(200, 0, -1)) and got[199].root == 1 and got[199].complete
    assert (got[200].root, got[200].complete, len(got[200].path)) == (500, False, 51) and (got[250].root, len(got[250].path)) == (500, 52)


def test_healthy_only_without_loud_findings(spark):
    acts = capture(spark, {"session_id": 1, "capture_s": 0}, {"session_id": 1, "capture_s": 15})
    finding = R.wait_findings(capture(spark, {"session_id": 1, "wait_info": "(2000ms)WRITELOG"}))
    assert R.capture_healthy(acts, finding.where("false")).count() == 1
    assert R.capture_healthy(acts, finding).count() == 0
    assert R.capture_healthy(acts, finding.withColumn("severity", F.lit("Not Evaluated"))).count() == 1
    assert R.capture_healthy(acts.where("capture_s = 0"), finding.where("false")).count() == 0


def test_caps_and_their_disclosure(spark):
    f = spark.createDataFrame([("WIA-RESOURCE", f"s{i:02d}", float(i), i) for i in range(25)] + [("WIA-BLOCKING", "b", 1.0, 1)], "rule_id string, subject string, impact double, first_row long")
    kept = R.finding_caps(f).collect()
    assert sorted(r.place for r in kept if r.rule_id == "WIA-RESOURCE") == list(range(1, 21)) and {r.subject for r in kept if r.place == 1} == {"s24"}
    assert [(r.retained, r.suppressed) for r in R.cap_disclosure(f).collect()] == [(20, 5)]
    # of equal impacts those that come first in the input are kept
    even = spark.createDataFrame([("WIA-WAIT", f"s{99 - i}", 7.0, i) for i in range(30)], "rule_id string, subject string, impact double, first_row long")
    assert {r.first_row for r in R.finding_caps(even).collect()} == set(range(24))


def test_what_could_not_be_evaluated(spark):
    columns = lambda *c: spark.createDataFrame([(x,) for x in c], "column string")
    kinds, plans = spark.createDataFrame([("Scheduler counters",), ("Worker counters",)], "kind string"), spark.range(1)
    missing = lambda *a: {r.rule_id: r.missing for r in R.rule_availability(*a).collect()}
    assert missing(columns("blocking_session_id", "wait_info", "status"), kinds, plans) == {"WIA-SCHEDULER-PRESSURE": "collection_time, cpu", "WIA-RESOURCE": "collection_time, start_time", "WIA-TRANSACTION": "open_tran_count"}
    assert missing(columns("blocking_session_id", "wait_info", "status", "open_tran_count", "start_time", "collection_time"), kinds.where("kind like 'W%'"), plans.where("false")) == {"PLAN": "a plan document"}


def test_a_whole_run(spark):
    acts = capture(spark, {"session_id": 1, "capture_s": 0}, {"session_id": 1, "capture_s": 15})
    none = R.wait_findings(acts).where("false")
    gone = spark.createDataFrame([("PLAN", "a plan document")], "rule_id string, missing string")
    calm = {(r.rule_id, r.severity, r.confidence, r.category) for r in R.whole_run(acts, none, none, gone).collect()}
    assert calm == {("PLAN-UNAVAILABLE", "Not Evaluated", "High", "Data quality"), ("CAPTURE-HEALTHY", "Informational", "High", "Assessment")}
    loud = R.wait_findings(capture(spark, {"session_id": 1, "wait_info": "(2000ms)WRITELOG"}))
    assert {r.rule_id for r in R.whole_run(acts, loud, none, gone).collect()} == {"WIA-WAIT", "PLAN-UNAVAILABLE"}


def test_serial_plans(spark):
    st = spark.createDataFrame([(1, "X", 1, 2.0), (2, "X", 4, 2.0), (3, "EstimatedDOPIsOne", 1, 2.0), (4, "EstimatedDOPIsOne", 1, 2.0), (5, None, 1, 2.0)], "statement_id long, nonparallel_reason string, dop int, cost double")
    ops = spark.createDataFrame([(4, 0, True)], "statement_id long, node_id int, scalar_udf boolean")
    assert {r.statement_id for r in H.plan_serialization(st, ops).collect()} == {1, 4}


def test_no_field_gets_out_without_a_rule(spark):
    from loadlens.operators import guide as G

    df = spark.sql("select 1L as statement_id, 'select 1' as statement_text, array(named_struct('node_id', 0, 'predicate', 'a = 1', 'warnings', array('Plan-affecting conversion: x', 'Spill'))) as operators, '0xAB' as plan_handle")
    (row,) = G.redact_plans(df).collect()
    assert row.asDict(True) == {"statement_id": 1, "statement_text": "[redacted SQL]", "operators": [{"node_id": 0, "predicate": "[redacted expression]", "warnings": ["Plan-affecting conversion: [redacted expression]", "Spill"]}]}
    for leak in ("named_struct('node_id', 0, 'new', 'x')", "named_struct('node_id', 0, 'object_name', 't', 'cost_text', 'y')"):
        with pytest.raises(ValueError, match="no rule for operators"):
            G.redact_plans(df.withColumn("operators", F.expr(f"array({leak})")))
    with pytest.raises(ValueError, match="no rule for extra"):
        G.redact_plans(df.withColumn("extra", F.lit(1)))
    with pytest.raises(ValueError, match="no rules for the fields"):
        G.redacted(df, {**G.PLAN_RULES, "operators": G.KEEP})
    assert G.redact_plans(df.withColumn("operators", F.lit(None).cast(df.schema["operators"].dataType))).first().operators is None


def test_threshold_profiles(spark):
    import hashlib
    import json

    from loadlens.operators.thresholds import Thresholds, check_profiles

    t = Thresholds()
    assert [len(g) for g in t.document().values()] == [5, 8, 4, 3, 4, 2, 9] and t.document()["plans"]["mediumGrantWasteKb"] == 131072
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def kept(change=lambda d: None, digest=None, canonical=None):
        d = json.loads(canonical or t.canonical())
        change(d)
        d["digest"] = digest or sha(json.dumps(d, separators=(",", ":"), ensure_ascii=False))
        return json.dumps(d, indent=1, ensure_ascii=False)

    put = lambda g, n, x: lambda d: d["thresholds"][g].__setitem__(n, x)
    cases = {
        "": kept(), "digest differs": kept(digest="0" * 64), "digest form": kept(digest="x"), "blocking.mediumVictims order": kept(put("blocking", "mediumVictims", 9)), "blocking.highVictims number": kept(put("blocking", "highVictims", "9")),
        "waits.corroboratingCaptures range": kept(put("waits", "corroboratingCaptures", 1)), "transactions.highAgeSeconds whole": kept(put("transactions", "highAgeSeconds", 900.5)), "resources.mediumPercentile range": kept(put("resources", "mediumPercentile", 0)),
        "thresholds.plans.extra unknown": kept(put("plans", "extra", 1)), "resources.minimumDurationSeconds order": kept(put("resources", "minimumDurationSeconds", 61)), "name form": kept(lambda d: d.update(name="a\nb")), "id form": kept(lambda d: d.update(id="No")), "version form": kept(lambda d: d.update(version="1.0")),
        "profile.other unknown": kept(lambda d: d.update(other=1)), "thresholds.waits object": kept(lambda d: d["thresholds"].update(waits=5)),
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "want string, body string")
    for r in check_profiles(rows).collect():
        assert (r.faults.split("|")[0], r.valid) == (r.want, r.want == ""), r
    assert not check_profiles(spark.createDataFrame([("no json",), ("[]",), ("{}",)], "body string")).where("valid").count()
    other = t.canonical(id_="mine"), t.canonical(id_="mine").replace('"highVictims":5', '"highVictims":6')
    assert {r.faults for r in check_profiles(spark.createDataFrame([(kept(canonical=c),) for c in other], "body string")).collect()} == {"conflict"}
