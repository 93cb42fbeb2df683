"""Queries of evidence, assertions, history and capability."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.catalog import adapters as A2
from loadlens.catalog.activity import acts
from loadlens.catalog.adapters import SIGNALS
from loadlens.catalog.base import Query
from loadlens.catalog.plans import _GOOD, read_operators
from loadlens.catalog.rules import WHOLE, _plan_rules, _shown
from loadlens.operators import adapters as X
from loadlens.operators import blocking as B
from loadlens.operators import evidence as E
from loadlens.operators import history as H
from loadlens.operators import inventory as J
from loadlens.operators import rules as R
from loadlens.sources.files import saved

#: Cases: each profile for each of five sources, whose number is that of their artifacts; artifacts are imported in batches.
_PROFILES = list(E.ASSERTIONS)
_PLANS = list(E.SPILL_PLANS)[:5]
_NUM = "CAST(split_part(artifact_id, '-', 2) AS INTEGER)"
_K = "CAST(substr(plan_id, 6) AS INTEGER)"
_SQ = lambda x: "'" + x.replace("'", "''") + "'"
SIG = f"""{SIGNALS}, planned AS (SELECT plan_id AS artifact_id, ['plan-captured', CASE WHEN bool_or(actual) THEN 'actual-plan' END, CASE WHEN bool_or(nonparallel_reason IS NOT NULL) THEN 'nonparallel-reason' END, CASE WHEN bool_or(granted_mb > 0 AND granted_mb >= 4 * used_mb) THEN 'plan-memory-overgrant' END, CASE WHEN bool_or(granted_mb > 0 AND granted_mb >= 4 * used_mb) THEN 'unused-memory-grant' END] AS s FROM plan_stmts GROUP BY 1),
sg AS (SELECT artifact_id, signal FROM signals UNION ALL SELECT artifact_id, signal FROM (SELECT artifact_id, unnest(s) AS signal FROM planned) z WHERE signal IS NOT NULL),
art AS (SELECT artifact_id, concat('ctr-', CAST({_NUM} % 5 AS VARCHAR)) AS source_id, {_NUM} % 17 AS import_order, CASE split_part(artifact_id, '-', 1) WHEN 'smp' THEN CAST(split_part(artifact_id, '-', 3) AS INTEGER) WHEN 'lkp' THEN CASE WHEN {_NUM} % 4 > 0 THEN {_NUM} * 15 END WHEN 'plan' THEN CASE WHEN {_NUM} % 4 > 0 THEN {_NUM} % 40 * 15 END
  WHEN 'cnt' THEN (SELECT min(capture_s) FROM samples s WHERE substr(s.source_id, 5) = split_part(artifact_id, '-', 2)) WHEN 'trn' THEN (SELECT min(capture_s) FROM activity a WHERE row_number % 3 = 0 AND session_id % 20 = {_NUM}) END AS at_s FROM (SELECT DISTINCT artifact_id FROM sg) d),
root AS (SELECT concat('ctr-', CAST({_K} % 5 AS VARCHAR)) AS source_id, arg_min(plan_handle, statement_id) AS h FROM plan_stmts GROUP BY 1),
tied AS (SELECT DISTINCT plan_id AS artifact_id FROM plan_stmts JOIN root ON h = plan_handle UNION SELECT concat('lkp-', CAST({_K} % 40 AS VARCHAR)) FROM plan_stmts JOIN root ON h = plan_handle UNION SELECT concat('rpt-', CAST(database_id AS VARCHAR)) FROM spills JOIN root ON h = plan_handle),
scoped AS (SELECT concat('rpt-', CAST(database_id AS VARCHAR)) AS artifact_id, bool_or(coalesce(plan_handle = h, false)) AS own FROM spills JOIN root ON source_id = concat('ctr-', CAST(database_id AS VARCHAR)) WHERE source_order % 5 = 0 GROUP BY 1),
win AS (SELECT source_id, min(capture_s) + 60 AS f, max(capture_s) - 200 AS l FROM samples GROUP BY 1),
sig AS (SELECT a.source_id, s.artifact_id, signal, import_order, CASE WHEN at_s IS NULL OR f IS NULL OR l IS NULL THEN 'Unknown' WHEN at_s BETWEEN f AND l THEN 'Exact' WHEN at_s BETWEEN f - 30 AND l + 30 THEN 'Overlapping' ELSE 'Context only' END AS overlap,
  CASE WHEN own IS NOT NULL AND signal IN ({", ".join(sorted({_SQ(x) for x in X.REPORT_TERMS.values()}))}) THEN own ELSE s.artifact_id IN (SELECT artifact_id FROM tied) END AS correlated FROM sg s JOIN art a USING (artifact_id) LEFT JOIN win w ON w.source_id = a.source_id LEFT JOIN scoped c ON c.artifact_id = s.artifact_id)"""
_MARKED = ", ".join(f"({_SQ(p)}, {_SQ(a.rstrip('!'))}, {str(a.endswith('!')).lower()})" for p, each in E.ASSERTIONS.items() for a in each)
STARTS = f"""marked(profile, assertion, given) AS (VALUES {_MARKED}), src AS (SELECT concat('ctr-', CAST(session_id % 5 AS VARCHAR)) AS source_id, session_id % 5 AS k, bool_or(blocking_session_id > 0) AS chain, arg_min(status, row_number) AS root_status, arg_min(open_tran_count, row_number) AS trans FROM acts GROUP BY 1, 2),
cases AS (SELECT concat(source_id, ':', profile) AS case_id, s.*, profile FROM src s CROSS JOIN (SELECT DISTINCT profile FROM marked) m),
starts AS (SELECT case_id, source_id, k, profile, assertion, CASE WHEN given THEN 'Observed' WHEN assertion = 'blocking-chain' AND coalesce(chain, false) THEN 'Observed' WHEN assertion = 'root-runnable' AND lower(root_status) = 'runnable' THEN 'Observed' WHEN assertion = 'root-runnable' AND root_status IS NOT NULL THEN 'Contradicted'
  WHEN assertion = 'open-transactions' AND trans > 0 THEN 'Observed' WHEN assertion = 'open-transactions' AND trans IS NOT NULL AND profile = 'cpu-backed-blocking' THEN 'Contradicted' WHEN assertion = 'plan-captured' AND profile = 'memory-grants' AND k % 2 = 0 THEN 'Observed' ELSE 'Not Evaluated' END AS state FROM cases JOIN marked USING (profile))"""
_LISTED = ", ".join(f"({i}, {_SQ(a)}, {_SQ(x)}, {str(t).lower()}, {str(w).lower()}, {_SQ(state)}, {_SQ(why)}, {_SQ('|'.join(lacks))})" for i, (a, on, (t, w), state, why, lacks) in enumerate(E.RULES) for x in on)
_SPILLS = ", ".join(f"({_SQ(p)}, {_SQ(s)}, {_SQ(b)}, {_SQ('|'.join(m))})" for p, (s, b, m) in E.SPILL_PLANS.items())
MET = f"""{SIG}, {STARTS}, rules(rule, assertion, signal, tied, timed, state, why, lacks) AS (VALUES {_LISTED}),
met AS (SELECT case_id, s.assertion, rule, r.state, why, lacks, min(import_order) AS since, count(DISTINCT artifact_id) AS artifacts FROM starts s JOIN sig USING (source_id) JOIN rules r ON r.signal = sig.signal AND r.assertion = s.assertion WHERE overlap <> 'Context only' AND (NOT tied OR correlated) AND (NOT timed OR overlap IN ('Exact', 'Overlapping'))
  AND NOT (profile = 'spill-triage' AND s.assertion = 'plan-captured') GROUP BY ALL)"""
THEORY = f"""seen AS (SELECT case_id, list(DISTINCT signal) AS s, count(DISTINCT CASE WHEN CASE profile WHEN 'worker-exhaustion' THEN signal = 'worker-exhaustion-confirmed' WHEN 'compile-pressure' THEN signal IN ('compilation-pressure', 'plan-cache-pressure-wide', 'plan-cache-instability-measured') WHEN 'transaction-blocking' THEN signal = 'lock-resource-match' WHEN 'plan-specific' THEN false
  ELSE signal IN ({", ".join(map(_SQ, E._WIDE))}) END THEN artifact_id END) AS artifacts, bool_or(signal IN ('plan-captured', 'embedded-plan-captured') AND correlated) AS root_plan FROM cases JOIN sig USING (source_id) WHERE overlap <> 'Context only' GROUP BY 1),
own AS (SELECT case_id, max(state) FILTER (WHERE assertion = 'blocking-chain') AS chain, max(state) FILTER (WHERE assertion = 'root-runnable') AS runnable, max(state) FILTER (WHERE assertion = 'open-transactions') AS tran FROM starts GROUP BY 1),
base AS (SELECT st.case_id, st.profile, artifacts, root_plan, tran, coalesce(s, []) AS s, list_contains(coalesce(s, []), 'scheduler-pressure-sustained') AS queue, list_contains(coalesce(s, []), 'lock-resource-match') AS locks, list_has_any(coalesce(s, []), ['plan-cache-instability-measured', 'compilation-pressure', 'plan-cache-warning']) AS cache,
  coalesce(tran = 'Contradicted', false) AND list_contains(coalesce(s, []), 'root-locks-granted') AS apart, coalesce(chain = 'Observed', false) AND coalesce(runnable = 'Observed', false) AND coalesce(tran = 'Observed', false) AS links FROM starts st LEFT JOIN seen USING (case_id) JOIN own USING (case_id) WHERE assertion = 'causal-theory'),
judged AS (SELECT *, CASE profile WHEN 'worker-exhaustion' THEN list_contains(s, 'worker-exhaustion-confirmed') WHEN 'compile-pressure' THEN list_contains(s, 'compilation-pressure') AND list_has_any(s, ['plan-cache-pressure-wide', 'plan-cache-instability-measured']) WHEN 'plan-specific' THEN true WHEN 'transaction-blocking' THEN locks ELSE NOT apart AND links AND queue AND locks END AS yes FROM base),
theory AS (SELECT case_id, profile, CASE WHEN yes THEN 'Supported' ELSE 'Not Evaluated' END AS theory, CASE profile WHEN 'worker-exhaustion' THEN CASE WHEN yes THEN 'thread waits and workers at their ceiling' ELSE 'thread waits alone' END WHEN 'compile-pressure' THEN CASE WHEN yes THEN 'compile waits, many compilations and little reuse' ELSE 'compile waits, not all of their cause' END WHEN 'plan-specific' THEN 'the plan names the cause'
  WHEN 'transaction-blocking' THEN CASE WHEN yes THEN 'an idle open transaction holds what victims wait for' ELSE 'an idle open transaction' END ELSE CASE WHEN apart THEN 'no open transaction at first, root locks later' WHEN yes AND cache THEN 'chain, runnable root, transaction, queues and locks agree; the plan cache may add to it' WHEN yes THEN 'chain, runnable root, transaction, queues and locks agree' ELSE 'not all links are shown' END END AS basis,
  CASE profile WHEN 'worker-exhaustion' THEN CASE WHEN yes THEN 'what took the workers' ELSE 'workers and queue of the incident' END WHEN 'compile-pressure' THEN CASE WHEN yes THEN 'where the variants come from' WHEN NOT list_contains(s, 'compilation-pressure') THEN 'repeated compilation rates' ELSE 'reuse of the plan cache' END WHEN 'plan-specific' THEN 'a run after the change' WHEN 'transaction-blocking' THEN CASE WHEN yes THEN 'the owner of the connection' ELSE 'granted and waiting locks|the outer command' END
  ELSE CASE WHEN apart THEN 'transactions, locks and queues of one time' WHEN yes AND coalesce(root_plan, false) THEN 'the same pattern again' WHEN yes AND cache THEN 'a plan of the root' WHEN yes THEN 'plan cache, compilations and a plan of the root' ELSE concat_ws('|', CASE WHEN NOT queue THEN 'queues in several samples' END, CASE WHEN NOT locks THEN 'a lock of the root that victims wait for' END, CASE WHEN coalesce(tran, '') <> 'Observed' THEN 'an open transaction of the time' END) END END AS missing, coalesce(artifacts, 0) AS artifacts FROM judged)"""
STATES = f"""{MET}, {THEORY}, plans(plan, pstate, pbasis, pmissing) AS (VALUES {_SPILLS}), spilled AS (SELECT database_id AS k, count(*) FILTER (WHERE total_pages > 0 OR avg_pages > 0) AS ranked, count(*) AS candidates FROM spills GROUP BY 1),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, assertion ORDER BY rule) AS n FROM met) z WHERE n = 1),
st AS (SELECT s.case_id, s.profile, s.assertion, CASE WHEN s.profile = 'spill-triage' AND s.assertion = 'plan-captured' THEN pstate WHEN s.profile = 'spill-triage' AND s.assertion = 'spill-candidates' THEN CASE WHEN ranked > 0 THEN 'Observed' ELSE 'Not Evaluated' END ELSE coalesce(b.state, s.state) END AS state, coalesce(b.why, CASE WHEN s.profile = 'spill-triage' AND s.assertion = 'plan-captured' THEN pbasis END) AS decided, coalesce(b.artifacts, 0) AS artifacts
  FROM starts s LEFT JOIN picked b ON b.case_id = s.case_id AND b.assertion = s.assertion LEFT JOIN plans ON plan = {_PLANS}[CAST(s.k + 1 AS INTEGER)] LEFT JOIN spilled sp ON sp.k = s.k WHERE s.assertion <> 'causal-theory' UNION ALL SELECT case_id, profile, 'causal-theory', theory, basis, artifacts FROM theory)"""


def _evidence(v):
    """(signals, shapes, observations) of the evidence tables, with the signals of the plans, which are artifacts too."""
    rows = saved(A2.typed(v), "evidence")
    shapes = saved(X.evidence_shape(rows), "shapes")
    waste = F.col("granted_mb") >= 4 * F.col("used_mb")
    yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    plans = v.plan_stmts.groupBy(F.col("plan_id").alias("artifact_id")).agg(yes(F.col("actual")).alias("actual"), yes(F.col("nonparallel_reason").isNotNull()).alias("serial"), yes((F.col("granted_mb") > 0) & waste).alias("waste"))
    of = F.array_compact(F.array(F.lit("plan-captured"), F.when(F.col("actual"), "actual-plan"), F.when(F.col("serial"), "nonparallel-reason"), F.when(F.col("waste"), "plan-memory-overgrant"), F.when(F.col("waste"), "unused-memory-grant")))
    return rows, shapes, X.evidence_signals(rows, shapes).unionByName(plans.select("artifact_id", F.explode(of).alias("signal")))


def _placed(v):
    rows, shapes, signals = _evidence(v)
    n = F.split_part("artifact_id", F.lit("-"), F.lit(2)).cast("int")
    source = F.concat(F.lit("ctr-"), n % 5)
    number = F.expr("cast(substr(plan_id, 6) as int)")
    seconds = F.unix_seconds("captured_at") - A2.EPOCH
    plans = v.plan_stmts.select(F.col("plan_id").alias("artifact_id"), F.when(number % 4 > 0, number % 40 * 15).cast("long").alias("at_s")).distinct()
    known = shapes.select("artifact_id", seconds.alias("at_s")).unionByName(plans).withColumns({"source_id": source, "import_order": n % 17})
    roots = v.plan_stmts.groupBy(F.concat(F.lit("ctr-"), number % 5).alias("source_id")).agg(F.min_by("plan_handle", "statement_id").alias("plan_handle"))
    named = rows.where("plan_handle is not null").select("artifact_id", "plan_handle").unionByName(v.plan_stmts.select(F.col("plan_id").alias("artifact_id"), "plan_handle")).withColumn("source_id", source)
    tied = named.join(roots, ["source_id", "plan_handle"]).select("artifact_id").distinct()
    reported = X.report_signals(rows, shapes).select("artifact_id", "signal", F.col("plan_handle").alias("own_handle"), source.alias("source_id"))
    scoped = reported.join(roots, "source_id").select("artifact_id", "signal", F.coalesce(F.col("own_handle") == F.col("plan_handle"), F.lit(False)).alias("tied"))
    windows = v.samples.groupBy("source_id").agg((F.min("capture_s") + 60).alias("first_s"), (F.max("capture_s") - 200).alias("last_s"))
    return saved(E.placed_signals(signals, known, windows, tied, scoped), "placed")


def _cases(v):
    k = F.col("session_id") % 5
    per = acts(v).groupBy(F.concat(F.lit("ctr-"), k).alias("source_id"), k.alias("k")).agg(F.bool_or(F.col("blocking_session_id") > 0).alias("chain"), F.min_by("status", "row_number").alias("root_status"), F.min_by("open_tran_count", "row_number").alias("open_transactions"))
    return per.withColumn("profile", F.explode(F.array(*map(F.lit, _PROFILES)))).withColumns({"case_id": F.concat_ws(":", "source_id", "profile"), "plan_rule": F.col("k") % 2 == 0})


def _spilled(v, cases):
    per = v.spills.groupBy(F.col("database_id").alias("k")).agg(F.count("*").alias("candidates"), F.count_if((F.col("total_pages") > 0) | (F.col("avg_pages") > 0)).alias("ranked"))
    return cases.where("profile = 'spill-triage'").join(per, "k").select("case_id", "candidates", "ranked", F.element_at(F.array(*map(F.lit, _PLANS)), (F.col("k") + 1).cast("int")).alias("plan"))


def _states(v):
    cases = saved(_cases(v), "cases")
    return E.assertion_states(E.initial_assertions(cases), _placed(v), cases, _spilled(v, cases))


def _decided(v):
    """What is told in the same words for every case: the basis where a rule or theory decided, else null."""
    s = _states(v)
    rule = F.col("basis").isin(*{r[4] for r in E.RULES}, *(p[1] for p in E.SPILL_PLANS.values())) | (F.col("assertion") == "causal-theory")
    return s.select("case_id", "profile", "assertion", "state", F.when(rule, F.col("basis")).alias("decided"), "artifacts")


#: A case for each finding that has a profile, without caps, and what it starts from.
_LAST_ROOT = "coalesce(capture_s, 4611686018427387904)) FILTER (WHERE root_status IS NOT NULL)"
OPENED = f"""{WHOLE}, marked(profile, assertion, given) AS (VALUES {_MARKED}), lasts AS (SELECT concat(source_id, ':', CAST(root AS VARCHAR), ':', CAST(CAST(episode_no AS BIGINT) AS VARCHAR)) AS s, arg_max(root_status, {_LAST_ROOT} AS root_status, arg_max(root_open_tran, {_LAST_ROOT} AS trans FROM eps GROUP BY 1),
opened AS (SELECT concat(rule_id, ':', subject) AS case_id, rule_id, root_status, trans, CASE WHEN severity = 'Informational' THEN NULL WHEN rule_id = 'WIA-BLOCKING' THEN CASE WHEN root_status = 'runnable' THEN 'cpu-backed-blocking' ELSE 'transaction-blocking' END WHEN rule_id = 'WIA-WAIT' AND upper(subject) LIKE '%RESOURCE_SEMAPHORE%' THEN 'memory-grants'
  ELSE CASE rule_id {" ".join(f"WHEN '{k}' THEN '{x}'" for k, x in R.PROFILES.items())} END END AS profile FROM fin LEFT JOIN lasts ON rule_id = 'WIA-BLOCKING' AND s = subject),
begun AS (SELECT case_id, profile, assertion, CASE WHEN given THEN 'Observed' WHEN assertion = 'blocking-chain' AND rule_id = 'WIA-BLOCKING' THEN 'Observed' WHEN assertion = 'root-runnable' AND lower(root_status) = 'runnable' THEN 'Observed' WHEN assertion = 'root-runnable' AND root_status IS NOT NULL THEN 'Contradicted' WHEN assertion = 'open-transactions' AND trans > 0 THEN 'Observed'
  WHEN assertion = 'open-transactions' AND trans IS NOT NULL AND profile = 'cpu-backed-blocking' THEN 'Contradicted' WHEN assertion = 'plan-captured' AND profile = 'memory-grants' AND starts_with(rule_id, 'PLAN-') THEN 'Observed' ELSE 'Not Evaluated' END AS state FROM opened JOIN marked USING (profile))"""


def _opened(v):
    """A case for each finding that has a profile, with the last known state of its root."""
    a = saved(acts(v), "acts")
    episodes = saved(B.blocking_episodes(B.blocking_snapshots(a), a), "episodes")
    found = _shown(R.all_findings(a, v.samples).unionByName(R.plan_rule_findings(_plan_rules(v))))
    last = F.max_by(F.struct("root_status", F.col("root_open_tran").alias("open_transactions")), F.when(F.col("root_status").isNotNull(), F.coalesce("capture_s", F.lit(2**62))))
    subject = F.concat_ws(":", "source_id", F.col("root").cast("string"), F.col("episode_no").cast("string"))
    roots = episodes.groupBy("source_id", "root", "episode_no").agg(last.alias("r")).select(F.lit("WIA-BLOCKING").alias("rule_id"), subject.alias("subject"), "r.root_status", "r.open_transactions")
    routed = R.profile_routing(found, episodes).where("profile is not null").join(roots, ["rule_id", "subject"], "left")
    return routed.select(F.concat_ws(":", "rule_id", "subject").alias("case_id"), "profile", (F.col("rule_id") == "WIA-BLOCKING").alias("chain"), "root_status", "open_transactions", F.col("rule_id").startswith("PLAN-").alias("plan_rule"))


_HIST = "hist AS (SELECT concat('case-', CAST(user_id % 50 AS VARCHAR)) AS case_id, concat('a', CAST(user_id % 3 AS VARCHAR)) AS assertion, event_id AS import_order, CASE WHEN event_type IN ('view', 'click') THEN 'Observed' ELSE 'Supported' END AS state FROM events)"


def _hist(v):
    return v.events.select(F.concat(F.lit("case-"), F.col("user_id") % 50).alias("case_id"), F.concat(F.lit("a"), F.col("user_id") % 3).alias("assertion"), F.col("event_id").alias("import_order"), F.when(F.col("event_type").isin("view", "click"), "Observed").otherwise("Supported").alias("state"))


_R = "greatest(actual_rows, estimated_rows) / greatest(1.0, least(actual_rows, estimated_rows))"
OBS = f"""obs AS (SELECT DISTINCT statement_id, node_id, object_no, i AS issue FROM (SELECT statement_id, node_id, object_no, unnest([CASE WHEN {_R} >= 10 AND actual_rows >= 10000 AND actual_rows > estimated_rows THEN 'under-estimate' END, CASE WHEN {_R} >= 10 AND estimated_rows >= 10000 AND estimated_rows > actual_rows THEN 'over-estimate' END, CASE WHEN spilled THEN 'spill' END, CASE WHEN converted THEN 'conversion' END, CASE WHEN residual THEN 'non-sargable' END]) AS i FROM plan_ops) z WHERE i IS NOT NULL)"""


def _observed(v):
    o = H.history_observations(v.plan_ops).join(v.orders.select(F.col("o_orderkey").alias("statement_id"), "o_custkey", F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long").alias("seen_s")), "statement_id")
    return o.select(F.concat(F.lit("obj"), "object_no").alias("target"), (F.col("o_custkey") % 25).alias("server"), F.col("statement_id").alias("capture_id"), "issue", "seen_s")


def _nearest(v):
    ops = saved(read_operators(v, "node_id", "object_name", "ancestors").select("statement_id", "node_id", "object_name", "ancestors", "spilled"), "operators")
    return H.nearest_target(ops, ops.where("spilled").select("statement_id", "node_id"))


_SNAPV = "cap AS (SELECT s_suppkey AS snapshot_id, s_nationkey AS server, s_suppkey % 60 * 86400 AS captured_s, s_suppkey % 3 <> 0 AS compatible, s_suppkey % 4 <> 0 AS statistics, 14 + s_suppkey % 4 AS version FROM supplier)"


def _caps(v):
    k = F.col("s_suppkey")
    return v.supplier.select(k.alias("snapshot_id"), F.col("s_nationkey").alias("server"), (k % 60 * 86400).alias("captured_s"), (k % 3 != 0).alias("compatible"), (k % 4 != 0).alias("statistics"), (14 + k % 4).alias("version"))


def _steps(v):
    c = v.spills.select(F.col("source_order").alias("candidate_id"), "plan_handle", "query_hash", (14 + F.col("source_order") % 4).alias("version"), (F.col("database_id") < 3).alias("same_database"))
    return H.step_availability(c)


_STEPS = "steps AS (SELECT source_order AS candidate_id, unnest(['query-store', 'last-actual-plan', 'cached-plan', 'reproduce']) AS step, unnest([1, 2, 3, 4]) AS priority, unnest([14 + source_order % 4 >= 16 AND database_id < 3 AND query_hash IS NOT NULL, 14 + source_order % 4 >= 15 AND plan_handle IS NOT NULL, plan_handle IS NOT NULL, true]) AS usable FROM spills)"

_ALIAS = {"session": ["spid", "session_id"], "rows": ["n_rows", "reads"], "none": ["absent"]}

QUERIES = [
    Query("read_evidence_tables", lambda v: E.read_evidence_tables(v.activity.withColumn("spid", F.when(F.col("row_number") % 2 == 0, F.col("session_id"))), _ALIAS).select("session", "rows", F.col("none").cast("string").alias("none")), "SELECT session_id AS session, reads AS rows, CAST(NULL AS VARCHAR) AS none FROM activity"),
    Query("root_identity", lambda v: E.root_identity(acts(v).withColumn("query_hash", F.sha2("sql_text", 256)), "episode"), "SELECT episode, " + ", ".join(f"r.{c} AS {c}" for c in ("session_id", "request_id", "database_name", "login_name", "query_hash")) + " FROM (SELECT episode, arg_max(struct_pack(session_id := session_id, request_id := request_id, database_name := database_name, login_name := login_name, query_hash := sha256(sql_text)), row_number) AS r FROM acts GROUP BY episode) z"),
    Query("incident_window", lambda v: E.incident_window(v.plan_stmts.select(F.col("plan_id").alias("finding_id")).distinct().withColumn("first_s", F.lit(-1)).withColumn("last_s", F.lit(-2)), acts(v).select(F.concat(F.lit("plan-"), F.col("session_id")).alias("finding_id"), "capture_s")),
          "SELECT p.plan_id AS finding_id, coalesce(min(a.capture_s), -1) AS first_s, coalesce(max(a.capture_s), -2) AS last_s FROM (SELECT DISTINCT plan_id FROM plan_stmts) p LEFT JOIN activity a ON concat('plan-', CAST(a.session_id AS VARCHAR)) = p.plan_id GROUP BY p.plan_id"),
    Query("assertion_states", _decided, f"WITH {STATES} SELECT case_id, profile, assertion, state, decided, artifacts FROM st"),
    Query("placed_signals", _placed, f"WITH {SIG} SELECT source_id, artifact_id, signal, import_order, overlap, correlated FROM sig"),
    Query("state_counts", lambda v: J.counted(_states(v), "state"), f"WITH {STATES} SELECT state, count(*) AS count FROM st GROUP BY state"),
    Query("causal_theory", lambda v: E.causal_theory(E.initial_assertions(_cases(v)), _placed(v), _cases(v)).withColumn("missing", F.array_join("missing", "|")), f"WITH {MET}, {THEORY} SELECT case_id, profile, theory, basis, missing, artifacts FROM theory"),
    Query("initial_assertions", lambda v: E.initial_assertions(_opened(v)).select("case_id", "profile", "assertion", "state"), f"{OPENED} SELECT case_id, profile, assertion, state FROM begun"),
    Query("state_transitions", lambda v: E.assertion_history(E.initial_assertions(_cases(v)), _placed(v), _cases(v)), f"""WITH {MET}, best AS (SELECT *, min(rule) OVER (PARTITION BY case_id, assertion ORDER BY since, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM met), steps AS (SELECT b.*, s.state AS start FROM best b JOIN starts s USING (case_id, assertion) WHERE least IS NULL OR rule < least)
 SELECT case_id, assertion, since AS import_order, state, before, why AS basis FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY case_id, assertion ORDER BY since, rule), start) AS before FROM steps) z WHERE before <> state"""),
    Query("import_states", lambda v: E.state_transitions(_hist(v)), f'WITH {_HIST} SELECT case_id, assertion, import_order, state, before FROM (SELECT *, lag(state) OVER (PARTITION BY case_id, assertion ORDER BY import_order) AS before FROM hist) z WHERE before <> state'),
    Query("capture_attempts", lambda v: E.capture_attempts(*reversed(_evidence(v)[1:])), f"WITH {SIG} SELECT DISTINCT artifact_id, CASE WHEN split_part(artifact_id, '-', 1) = 'lkp' THEN CASE {_NUM} % 3 WHEN 2 THEN 'Query Store' WHEN 1 THEN 'Last-known actual' ELSE 'Live cache' END ELSE 'Live cache' END AS method, CASE signal WHEN 'plan-lookup-null' THEN 'null' ELSE 'captured' END AS outcome FROM sg WHERE signal IN ('plan-captured', 'embedded-plan-captured', 'plan-lookup-null')"),
    Query("case_narrative", lambda v: E.case_narrative(_states(v)), f"WITH {STATES} SELECT case_id, " + ", ".join(f"coalesce(string_agg(CASE WHEN state = '{s}' THEN assertion END, ',' ORDER BY assertion), '') AS {n}" for s, n in (("Observed", "established"), ("Supported", "supported"), ("Contradicted", "contradicted"), ("Not Evaluated", "unanswered"))) + ", min(CASE WHEN state = 'Not Evaluated' THEN assertion END) AS next_check FROM st GROUP BY case_id"),
    Query("collection_status", lambda v: E.collection_status(v.events.select((F.col("user_id") % 700).alias("case_id"), (F.col("event_id") % 5 == 0).alias("recognised"))), "SELECT case_id, CASE WHEN n >= 3 THEN 'Imported' WHEN n > 0 THEN 'Partially imported' ELSE 'Not imported' END AS status FROM (SELECT user_id % 700 AS case_id, count(*) FILTER (WHERE event_id % 5 = 0) AS n FROM events GROUP BY 1) z"),
    Query("latest_snapshot", lambda v: E.latest_snapshot(_caps(v), "server"), f"WITH {_SNAPV} SELECT server, snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY server ORDER BY captured_s DESC, snapshot_id DESC) AS n FROM cap) z WHERE n = 1"),
    Query("history_captures", lambda v: H.history_captures(v.plan_stmts, v.plan_ops), "SELECT s.statement_id, s.plan_id, o.objects FROM plan_stmts s JOIN (SELECT statement_id, string_agg(CAST(object_no AS VARCHAR), ',' ORDER BY object_no) AS objects FROM (SELECT DISTINCT statement_id, object_no FROM plan_ops) z GROUP BY 1) o USING (statement_id) WHERE actual"),
    Query("nearest_target", lambda v: _nearest(v).select("statement_id", F.col("start").cast("long").alias("start"), "target", "via"),
          "SELECT s.statement_id, CAST(s.node_id AS BIGINT) AS start, concat('dbo.t', CAST(t.object_no AS VARCHAR)) AS target, CASE WHEN t.node_id = s.node_id THEN 'Exact' ELSE 'Nearest access' END AS via FROM plan_ops s JOIN plan_ops t ON t.statement_id = s.statement_id AND t.node_id >= s.node_id AND t.object_no % 3 = 0 WHERE s.spilled AND s." + _GOOD.replace("AND statement_id", "AND s.statement_id") + " AND NOT EXISTS (SELECT 1 FROM plan_ops u WHERE u.statement_id = s.statement_id AND u.node_id >= s.node_id AND u.node_id < t.node_id AND u.object_no % 3 = 0)"),
    Query("history_observations", lambda v: H.history_observations(v.plan_ops), f"WITH {OBS} SELECT * FROM obs"),
    Query("history_targets", lambda v: H.history_targets(_observed(v)), f"WITH {OBS}, o2 AS (SELECT concat('obj', CAST(object_no AS VARCHAR)) AS target, o_custkey % 25 AS server, statement_id AS c, issue, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS seen_s FROM obs JOIN orders ON o_orderkey = statement_id) SELECT target, count(DISTINCT server) AS servers, count(DISTINCT c) AS captures, " + ", ".join(f"count(DISTINCT CASE WHEN issue = '{i}' THEN c END) AS {n}" for i, n in (("spill", "spills"), ("conversion", "conversions"), ("non-sargable", "non_sargable"), ("under-estimate", "under"), ("over-estimate", "over"))) + ", count(*) AS issues, min(seen_s) AS first_s, max(seen_s) AS last_s FROM o2 GROUP BY target"),
    Query("statistics_observations", lambda v: H.statistics_observations(v.part.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 5 != 0, F.lit(1)).alias("last_updated"), (F.col("p_partkey") % 7).alias("rows_sampled"), (F.col("p_partkey") % 3).alias("modifications"))), "SELECT key, i AS issue FROM (SELECT p_partkey AS key, unnest([CASE WHEN p_partkey % 5 = 0 THEN 'never-updated' END, CASE WHEN p_partkey % 7 = 0 THEN 'zero-sample' END, CASE WHEN p_partkey % 3 > 0 THEN 'changed-since-update' END]) AS i FROM part) z WHERE i IS NOT NULL"),
    Query("history_upsert", lambda v: H.history_upsert(v.orders.select("o_orderkey", F.lit("old").alias("version")), v.orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("version")), "o_orderkey"), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM orders"),
    Query("history_summary", lambda v: J.history_summary(v.orders.select((F.col("o_custkey") % 300).alias("case_id"), (F.col("o_orderstatus") == "F").alias("resolved")), v.plan_stmts.select(F.col("plan_id").alias("capture_id"), "actual")), "SELECT * FROM (SELECT count(*) FILTER (WHERE r) AS resolved, count(*) FILTER (WHERE NOT r) AS unresolved FROM (SELECT o_custkey % 300 AS c, bool_or(o_orderstatus = 'F') AS r FROM orders GROUP BY 1) z) a, (SELECT count(DISTINCT CASE WHEN actual THEN plan_id END) AS actual_captures FROM plan_stmts) b"),
    Query("tool_inventory", lambda v: J.tool_inventory(_caps(v).select(F.col("compatible").alias("installed"), F.col("statistics").alias("usable"))), f"WITH {_SNAPV} SELECT count(*) FILTER (WHERE compatible) AS installed, count(*) FILTER (WHERE compatible AND statistics) AS usable FROM cap"),
    Query("eligible_servers", lambda v: H.eligible_servers(_caps(v), 59 * 86400), f"WITH {_SNAPV} SELECT DISTINCT server FROM cap WHERE compatible AND statistics AND 59 * 86400 - captured_s BETWEEN 0 AND 30 * 86400"),
    Query("capability_snapshot", lambda v: H.capability_snapshot(v.customer.select((F.col("c_custkey") % 400).alias("artifact_id"), F.when(F.col("c_custkey") % 11 == 0, F.lit("other")).otherwise("main").alias("server"), (F.col("c_custkey") % 50 * 86400).alias("captured_s"), F.lit(1).alias("version"), F.when(F.col("c_custkey") % 3 == 0, "Std").alias("edition"), (F.col("c_custkey") % 2 == 0).alias("installed")), 45 * 86400),
          "SELECT artifact_id, CASE WHEN n = 1 THEN one END AS server, CASE WHEN n > 1 THEN 'mixed contexts' END AS error, 1 AS version, concat_ws(',', CASE WHEN edition IS NULL THEN 'edition' END, CASE WHEN tools = 0 THEN 'tools' END, CASE WHEN 45 * 86400 - cs > 30 * 86400 THEN 'stale' END) AS warnings FROM (SELECT c_custkey % 400 AS artifact_id, count(DISTINCT CASE WHEN c_custkey % 11 = 0 THEN 'other' ELSE 'main' END) AS n, min(CASE WHEN c_custkey % 11 = 0 THEN 'other' ELSE 'main' END) AS one, max(c_custkey % 50 * 86400) AS cs, max(CASE WHEN c_custkey % 3 = 0 THEN 'Std' END) AS edition, count(*) FILTER (WHERE c_custkey % 2 = 0) AS tools FROM customer GROUP BY 1) z"),
    Query("step_availability", _steps, f"WITH {_STEPS} SELECT candidate_id, step, usable, priority FROM steps"),
    Query("recommended_step", lambda v: H.recommended_step(_steps(v), v.spills.where("source_order % 2 = 0").select(F.col("source_order").alias("candidate_id"), F.lit("query-store").alias("step"))), f"WITH {_STEPS} SELECT candidate_id, arg_min(step, priority) AS step FROM steps WHERE usable AND NOT (candidate_id % 2 = 0 AND step = 'query-store') GROUP BY candidate_id"),
]
