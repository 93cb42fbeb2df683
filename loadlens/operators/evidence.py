"""Evidence of a case: observations, signals, assertions and what they say together.

The adapters give observations and signals of artifacts. Signals that are usable in a case's incident window decide its
assertions by a table of rules: of an assertion's rules that some signal meets, the first gives the state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadlens.operators.correlation import incident_overlap

#: Signals of an artifact, whether it must be tied to the root of the case and its time must lie in the incident window.
_ANY, _TIED, _ALIGNED = (False, False), (True, False), (True, True)
# Assertions with their rules in order (signals, ties, state); of those that a case meets, the first decides. With each
# the texts of what the state rests on and of what is missing.
RULES = (
    ("scheduler-pressure", ("scheduler-pressure-sustained",), _ANY, "Supported", "runnable queues in several samples", ("scheduler delay or host CPU",)),
    ("scheduler-pressure", ("scheduler-runnable-queue",), _ANY, "Not Evaluated", "a runnable queue in one sample", ("a second sample with a time",)),
    ("worker-exhaustion", ("worker-exhaustion-confirmed",), _ANY, "Observed", "all workers active while work was queued", ("what took the workers",)),
    ("worker-exhaustion", ("worker-queue",), _ANY, "Supported", "work was queued below the ceiling", ("active and maximum workers of the same samples",)),
    ("worker-ceiling", ("worker-exhaustion-confirmed",), _ANY, "Supported", "all workers active while work was queued", ()),
    ("worker-ceiling", ("worker-queue",), _ANY, "Supported", "work was queued below the ceiling", ("active and maximum workers of the same samples",)),
    ("root-lock-owner", ("lock-resource-match",), _ANY, "Observed", "a victim waits for a resource that the root holds", ()),
    ("root-lock-owner", ("root-locks-granted",), _ANY, "Supported", "the root holds locks", ("waiting locks of victims",)),
    ("plan-cache-pressure", ("plan-cache-instability-measured",), _ANY, "Supported", "most plans of the inventory were used once", ("an inventory of a normal time", "compilation rates of the same time")),
    ("plan-cache-pressure", ("plan-cache-pressure-wide",), _ANY, "Supported", "compile waits while the hit ratio falls", ("a plan inventory",)),
    ("plan-cache-pressure", ("plan-cache-instability", "plan-cache-warning"), _ANY, "Supported", "warnings of a plan-cache report", ("a plan inventory", "compilation rates")),
    ("compilation-pressure", ("compilation-pressure",), _ANY, "Supported", "many compilations for the batches", ("rates of a normal time", "the queries that compile")),
    ("compilation-pressure", ("compilation-timeout",), _ANY, "Supported", "a report names compilation timeouts", ("counters of compilations and batches",)),
    ("serialization", ("nonparallel-reason",), _ALIGNED, "Observed", "the root's plan of the time names a reason", ()),
    ("serialization", ("nonparallel-reason",), _TIED, "Supported", "the root's plan names a reason", ("the time of the plan",)),
    ("serialization", ("forced-serialization",), _TIED, "Supported", "a report row of the root names it", ("the root's plan",)),
    ("serialization", ("forced-serialization",), _ANY, "Not Evaluated", "a report row of no known query names it", ("an identity shared with the root",)),
    ("memory-grant-symptom", ("plan-memory-overgrant",), _ALIGNED, "Observed", "the root's plan of the time used little of its grant", ()),
    ("memory-grant-symptom", ("unused-memory-grant",), _TIED, "Supported", "evidence of the root names an unused grant", ("the root's actual plan",)),
    ("memory-grant-symptom", ("unused-memory-grant",), _ANY, "Not Evaluated", "evidence of no known query names an unused grant", ("an identity shared with the root",)),
    ("memory-grant-pressure", ("pending-memory-grant",), _ANY, "Supported", "grants were pending", ("persistence", "the queries that wait")),
    ("memory-grant-pressure", ("unused-memory-grant",), _ANY, "Not Evaluated", "an unused grant of one plan", ("pending grants",)),
    ("plan-captured", ("plan-captured", "embedded-plan-captured"), _ALIGNED, "Observed", "a plan of the root and of the time", ()),
    ("plan-captured", ("plan-captured", "embedded-plan-captured"), _TIED, "Supported", "a plan of the root", ("the time of the plan",)),
    ("plan-captured", ("plan-captured", "embedded-plan-captured"), _ANY, "Not Evaluated", "a plan of no known statement", ("an identity shared with the root",)),
    ("plan-captured", ("plan-lookup-null",), _ANY, "Not Evaluated", "a look-up of the plan gave none", ("a plan of the same moment", "a last-known actual plan", "a stored plan")),
)
# Of an investigation that starts from a spill, what decides on its plan: the state of the chosen candidate's plan.
SPILL_PLANS = {
    "exact": ("Observed", "one statement with an exact identity", ()), "manual": ("Supported", "a statement chosen by hand among equals", ("an identity of one statement",)), "strong": ("Supported", "one statement with a strong identity", ("an exact identity",)),
    "blocked": ("Not Evaluated", "plans conflict with the candidate", ("a plan without conflict",)), "ambiguous": ("Not Evaluated", "several statements fit equally", ("a choice, or an identity of one statement",)), "none": ("Not Evaluated", "no plan fits", ("a plan with a matching identity",)),
}
# The assertions that investigations of a profile make, those observed from the start by their source marked.
ASSERTIONS = {
    "cpu-backed-blocking": ("blocking-chain", "root-runnable", "open-transactions", "root-lock-owner", "scheduler-pressure", "plan-cache-pressure", "compilation-pressure", "serialization", "memory-grant-symptom", "memory-grant-pressure", "plan-captured", "causal-theory"),
    "transaction-blocking": ("blocking-chain!", "open-transactions", "root-lock-owner", "causal-theory"), "worker-exhaustion": ("worker-exhaustion!", "worker-ceiling", "causal-theory"),
    "compile-pressure": ("compile-semaphore!", "compilation-pressure", "plan-cache-pressure", "causal-theory"), "memory-grants": ("memory-grant-symptom!", "memory-grant-pressure", "plan-captured", "causal-theory"),
    "plan-specific": ("plan-cause!", "plan-captured!", "causal-theory"), "spill-triage": ("spill-candidates!", "plan-captured"), "actual-plan": ("plan-captured",),
}


def read_evidence_tables(table: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns under their canonical names: of each name's aliases, the first that is there and not null."""
    return table.select(*(F.coalesce(*(F.col(a) for a in names if a in table.columns), F.lit(None)).alias(name) for name, names in aliases.items()))


def placed_signals(signals: DataFrame, artifacts: DataFrame, windows: DataFrame, tied: DataFrame, scoped: DataFrame | None = None) -> DataFrame:
    """signals with their source, the import_order of their artifact (artifact_id, source_id, at_s, import_order), how it overlaps
    the source's window (source_id, first_s, last_s), and whether it is tied to the root: its own row in scoped (artifact_id,
    signal, tied) decides where there is one, else whether the artifact is among tied (artifact_id)."""
    o = incident_overlap(artifacts.select("artifact_id", F.col("source_id").alias("window_id"), "at_s"), windows.withColumnRenamed("source_id", "window_id"))
    t = tied.select("artifact_id").distinct().withColumn("tied", F.lit(True))
    j = signals.join(o.withColumnRenamed("window_id", "source_id"), "artifact_id").join(artifacts.select("artifact_id", "import_order"), "artifact_id").join(t, "artifact_id", "left")
    own = F.lit(None).cast("boolean")
    if scoped is not None:
        j, own = j.join(scoped.groupBy("artifact_id", "signal").agg(F.bool_or("tied").alias("own")), ["artifact_id", "signal"], "left"), F.col("own")
    return j.select("source_id", "artifact_id", "signal", "import_order", "overlap", F.coalesce(own, "tied", F.lit(False)).alias("correlated"))


def root_identity(rows: DataFrame, *keys: str) -> DataFrame:
    """What identifies the root of each group, from its last row: all keys of an identity that the rows have, and its names."""
    known = [c for c in ("session_id", "request_id", "transaction_id", "database_id", "database_name", "login_name", "sql_handle", "plan_handle", "query_hash", "plan_hash", "start_offset", "end_offset", "qs_query_id", "qs_plan_id") if c in rows.columns and c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*known), "row_number").alias("r")).select(*keys, "r.*")


def incident_window(findings: DataFrame, rows: DataFrame) -> DataFrame:
    """(finding_id, first_s, last_s) over the affected rows; the finding's own span where none was captured."""
    span = rows.groupBy("finding_id").agg(F.min("capture_s").alias("a"), F.max("capture_s").alias("b"))
    return findings.join(span, "finding_id", "left").select("finding_id", F.coalesce("a", "first_s").alias("first_s"), F.coalesce("b", "last_s").alias("last_s"))


def initial_assertions(cases: DataFrame) -> DataFrame:
    """(case_id, assertion, state, basis, missing) from which a case (case_id, profile, chain, root_status, open_transactions,
    plan_rule) starts: what its source observed, what it contradicts, and what is open. plan_rule: the case's finding is of a plan rule."""
    marked = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(a.rstrip("!")).alias("assertion"), F.lit(a.endswith("!")).alias("given")) for p, each in ASSERTIONS.items() for a in each))
    rows = cases.select("*", F.explode(F.filter(marked, lambda x: x["p"] == F.col("profile"))).alias("a")).select("case_id", "profile", "chain", "root_status", "open_transactions", "plan_rule", "a.assertion", "a.given")
    whole = F.col("profile") == "cpu-backed-blocking"
    known, open_ = F.col("open_transactions").isNotNull(), F.coalesce(F.col("open_transactions") > 0, F.lit(False))
    is_ = lambda a: F.col("assertion") == a
    state = (
        F.when(F.col("given"), "Observed").when(is_("blocking-chain") & F.coalesce("chain", F.lit(False)), "Observed")
        .when(is_("root-runnable") & (F.lower("root_status") == "runnable"), "Observed").when(is_("root-runnable") & F.col("root_status").isNotNull(), "Contradicted")
        .when(is_("open-transactions") & open_, "Observed").when(is_("open-transactions") & known & whole, "Contradicted")
        .when(is_("plan-captured") & (F.col("profile") == "memory-grants") & F.coalesce("plan_rule", F.lit(False)), "Observed").otherwise("Not Evaluated")
    )
    basis = F.when(F.col("given"), "the source of the case").when(is_("blocking-chain") & (state == "Observed"), "a whole chain with its root").when(is_("root-runnable") & F.col("root_status").isNotNull(), F.concat(F.lit("status of the root: "), "root_status"))
    basis = basis.when(is_("open-transactions") & known, F.concat(F.lit("open transactions of the root: "), F.col("open_transactions").cast("string"))).when(is_("plan-captured") & (state == "Observed"), "a finding of a plan rule")
    missing = F.when(state.isin("Observed", "Contradicted"), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("evidence of "), "assertion")))
    return rows.select("case_id", "profile", "assertion", state.alias("state"), basis.alias("basis"), missing.alias("missing"))


def _rules(spark):
    return spark.createDataFrame([(i, a, s, t, w, state, basis, list(missing)) for i, (a, on, (t, w), state, basis, missing) in enumerate(RULES) for s in on], "rule int, assertion string, signal string, tied boolean, timed boolean, to string, why string, lacks array<string>")


def _met(starts: DataFrame, signals: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, assertion, rule, to, why, lacks, since, artifacts): the rules that a case's usable signals meet, and the first import
    by which they do."""
    usable = cases.select("case_id", "source_id").join(signals.where("overlap <> 'Context only'"), "source_id")
    met = usable.join(F.broadcast(_rules(signals.sparkSession)), "signal").where((~F.col("tied") | F.col("correlated")) & (~F.col("timed") | F.col("overlap").isin("Exact", "Overlapping")))
    asked = starts.where("assertion <> 'causal-theory' and not (profile = 'spill-triage' and assertion = 'plan-captured')").select("case_id", "assertion")
    return met.join(asked, ["case_id", "assertion"]).groupBy("case_id", "assertion", "rule").agg(F.first("to").alias("to"), F.first("why").alias("why"), F.first("lacks").alias("lacks"), F.min("import_order").alias("since"), F.countDistinct("artifact_id").alias("artifacts"))


def assertion_states(starts: DataFrame, signals: DataFrame, cases: DataFrame, spills: DataFrame | None = None) -> DataFrame:
    """(case_id, profile, assertion, state, confidence, basis, missing, artifacts) of all assertions of cases (case_id, source_id).

    Of an assertion's rules that usable signals (placed_signals, those of the incident window and of unknown time) meet, the
    first decides, whatever the order of imports; where none is met, the starting state (initial_assertions) stays, Contradicted
    included. spills: (case_id, candidates, ranked, plan) decides the two assertions of cases that start from a spill. The causal
    theory follows from the others and from signals: see causal_theory."""
    best = _met(starts, signals, cases).groupBy("case_id", "assertion").agg(F.min_by(F.struct("to", "why", "lacks", "artifacts"), "rule").alias("b"))
    j = starts.where("assertion <> 'causal-theory'").join(best, ["case_id", "assertion"], "left")
    state, basis, missing, n = F.coalesce("b.to", "state"), F.coalesce("b.why", "basis"), F.coalesce("b.lacks", "missing"), F.coalesce("b.artifacts", F.lit(0)).cast("long")
    if spills is not None:
        spill, none = F.col("profile") == "spill-triage", F.array().cast("array<string>")
        j = j.join(spills.select("case_id", F.struct("candidates", "ranked", "plan").alias("s")), "case_id", "left")
        ranked, plan = spill & (F.col("assertion") == "spill-candidates"), spill & (F.col("assertion") == "plan-captured")
        some = F.coalesce(F.col("s.ranked") > 0, F.lit(False))
        of = lambda i: reduce(lambda out, kv: F.when(F.col("s.plan") == kv[0], F.array(*map(F.lit, kv[1][i])).cast("array<string>") if i == 2 else F.lit(kv[1][i])).otherwise(out), SPILL_PLANS.items(), F.array(F.lit(SPILL_PLANS["none"][2][0])) if i == 2 else F.lit(SPILL_PLANS["none"][i]))
        state = F.when(ranked, F.when(some, "Observed").otherwise("Not Evaluated")).when(plan, of(0)).otherwise(state)
        rows = F.when(some, F.concat(F.col("s.ranked").cast("string"), F.lit(" ranked rows"))).when(F.col("s.candidates") > 0, "rows without positive pages")
        basis = F.when(ranked, rows).when(plan, F.when(F.col("s.plan").isNotNull(), of(1))).otherwise(basis)
        missing = F.when(ranked, F.when(some, none).otherwise(F.array(F.lit("a row with positive pages")))).when(plan, of(2)).otherwise(missing)
    facts = j.select("case_id", "profile", "assertion", state.alias("state"), basis.alias("basis"), missing.alias("missing"), n.alias("artifacts"))
    theory = causal_theory(starts, signals, cases).select("case_id", "profile", F.lit("causal-theory").alias("assertion"), F.col("theory").alias("state"), "basis", "missing", "artifacts")
    out = facts.unionByName(theory)
    return out.select("case_id", "profile", "assertion", "state", F.when(F.col("state") == "Supported", "Medium").otherwise("High").alias("confidence"), "basis", "missing", "artifacts")


_THEORY_SIGNALS = {
    "worker-exhaustion": ("worker-exhaustion-confirmed",), "compile-pressure": ("compilation-pressure", "plan-cache-pressure-wide", "plan-cache-instability-measured"), "transaction-blocking": ("lock-resource-match",), "plan-specific": (),
}
_WIDE = ("scheduler-pressure-sustained", "lock-resource-match", "plan-cache-instability-measured", "compilation-pressure", "plan-captured", "embedded-plan-captured")


def causal_theory(starts: DataFrame, signals: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, profile, theory, basis, missing, artifacts) of cases that have one: Supported where the usable signals and starting
    states show all that the profile's theory wants, else Not Evaluated with what is missing.

    An open transaction that the source contradicts leaves the theory open while root locks are granted."""
    usable = cases.select("case_id", "source_id").join(signals.where("overlap <> 'Context only'"), "source_id")
    profile = starts.where("assertion = 'causal-theory'").select("case_id", "profile")
    counted = F.lit(False)
    for p, names in _THEORY_SIGNALS.items():
        counted = F.when(F.col("profile") == p, F.col("signal").isin(*names) if names else F.lit(False)).otherwise(counted)
    counted = F.when(F.col("profile").isin(*_THEORY_SIGNALS), counted).otherwise(F.col("signal").isin(*_WIDE))
    seen = usable.join(profile, "case_id").groupBy("case_id").agg(
        F.collect_set("signal").alias("seen"), F.count_distinct(F.when(counted, F.col("artifact_id"))).alias("artifacts"), F.coalesce(F.bool_or(F.col("signal").isin("plan-captured", "embedded-plan-captured") & F.col("correlated")), F.lit(False)).alias("root_plan"))
    is_ = lambda a: F.max(F.when(F.col("assertion") == a, F.col("state")))
    own = starts.groupBy("case_id").agg(is_("blocking-chain").alias("chain"), is_("root-runnable").alias("runnable"), is_("open-transactions").alias("tran"))
    j = profile.join(seen, "case_id", "left").join(own, "case_id").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    has = lambda *names: F.arrays_overlap("seen", F.array(*map(F.lit, names)))
    texts = lambda *c: F.array_compact(F.array(*c))
    none = F.array().cast("array<string>")
    queue, locks, cache = has("scheduler-pressure-sustained"), has("lock-resource-match"), has("plan-cache-instability-measured", "compilation-pressure", "plan-cache-warning")
    seen_ = lambda c: F.coalesce(F.col(c) == "Observed", F.lit(False))
    apart = F.coalesce(F.col("tran") == "Contradicted", F.lit(False)) & has("root-locks-granted")
    whole = seen_("chain") & seen_("runnable") & seen_("tran") & queue & locks
    compiles, reuse = has("compilation-pressure"), has("plan-cache-pressure-wide", "plan-cache-instability-measured")
    p = lambda name: F.col("profile") == name
    exhausted = has("worker-exhaustion-confirmed")
    yes = F.when(p("worker-exhaustion"), exhausted).when(p("compile-pressure"), compiles & reuse).when(p("plan-specific"), F.lit(True)).when(p("transaction-blocking"), locks).otherwise(~apart & whole)
    basis = (
        F.when(p("worker-exhaustion"), F.when(exhausted, "thread waits and workers at their ceiling").otherwise("thread waits alone"))
        .when(p("compile-pressure"), F.when(yes, "compile waits, many compilations and little reuse").otherwise("compile waits, not all of their cause")).when(p("plan-specific"), "the plan names the cause")
        .when(p("transaction-blocking"), F.when(yes, "an idle open transaction holds what victims wait for").otherwise("an idle open transaction"))
        .when(apart, "no open transaction at first, root locks later").when(yes & cache, "chain, runnable root, transaction, queues and locks agree; the plan cache may add to it").when(yes, "chain, runnable root, transaction, queues and locks agree").otherwise("not all links are shown")
    )
    missing = (
        F.when(p("worker-exhaustion"), F.when(yes, F.array(F.lit("what took the workers"))).otherwise(F.array(F.lit("workers and queue of the incident"))))
        .when(p("compile-pressure"), F.when(yes, F.array(F.lit("where the variants come from"))).when(~compiles, F.array(F.lit("repeated compilation rates"))).otherwise(F.array(F.lit("reuse of the plan cache")))).when(p("plan-specific"), F.array(F.lit("a run after the change")))
        .when(p("transaction-blocking"), F.when(yes, F.array(F.lit("the owner of the connection"))).otherwise(F.array(F.lit("granted and waiting locks"), F.lit("the outer command"))))
        .when(apart, F.array(F.lit("transactions, locks and queues of one time"))).when(yes & F.coalesce("root_plan", F.lit(False)), F.array(F.lit("the same pattern again"))).when(yes & cache, F.array(F.lit("a plan of the root"))).when(yes, F.array(F.lit("plan cache, compilations and a plan of the root")))
        .otherwise(texts(F.when(~queue, "queues in several samples"), F.when(~locks, "a lock of the root that victims wait for"), F.when(~seen_("tran"), "an open transaction of the time")))
    )
    return j.select("case_id", "profile", F.when(yes, "Supported").otherwise("Not Evaluated").alias("theory"), basis.alias("basis"), F.coalesce(missing, none).alias("missing"), F.coalesce("artifacts", F.lit(0)).cast("long").alias("artifacts"))


def assertion_history(starts: DataFrame, signals: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, assertion, import_order, state, before, basis): each import after which an assertion's state is another one.

    Evidence only adds up, so a rule that is met stays met: its first import is all that counts. Of the rules met by an import
    the first in order decides, a running minimum over an assertion's few rules; imports in another order change the
    way, not where it ends."""
    w = Window.partitionBy("case_id", "assertion").orderBy("since", "rule")
    best = _met(starts, signals, cases).withColumn("least", F.min("rule").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    steps = best.where("least is null or rule < least").withColumn("next", F.lead("since").over(w)).where("next is null or next > since")
    told = steps.join(starts.select("case_id", "assertion", F.col("state").alias("start")), ["case_id", "assertion"])
    before = F.coalesce(F.lag("to").over(w), F.col("start"))
    return told.withColumn("before", before).where(F.col("before") != F.col("to")).select("case_id", "assertion", F.col("since").alias("import_order"), F.col("to").alias("state"), "before", F.col("why").alias("basis"))


def state_transitions(history: DataFrame) -> DataFrame:
    """Rows of history (case_id, assertion, import_order, state) at which the state changes."""
    w = Window.partitionBy("case_id", "assertion").orderBy("import_order")
    return history.withColumn("before", F.lag("state").over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col("state")))


def capture_attempts(signals: DataFrame, shapes: DataFrame) -> DataFrame:
    """(artifact_id, method, outcome): per artifact, whether a plan was captured or its look-up gave none, and how it was sought, from
    its evidence_shape (artifact_id, adapter, result_sets)."""
    outcome = F.when(F.col("signal").isin("plan-captured", "embedded-plan-captured"), "captured").when(F.col("signal") == "plan-lookup-null", "null")
    method = F.when(F.col("adapter") == "query-store", "Query Store").when(F.col("adapter") == "extended-events", "Extended Events").when(F.array_contains("result_sets", "LAST_KNOWN_ACTUAL_PLAN"), "Last-known actual").otherwise("Live cache")
    found = signals.select("artifact_id", outcome.alias("outcome")).where("outcome is not null").distinct()
    return found.join(shapes.select("artifact_id", method.alias("method")), "artifact_id", "left").select("artifact_id", F.coalesce("method", F.lit("Live cache")).alias("method"), "outcome")


def case_narrative(states: DataFrame) -> DataFrame:
    """Per case, its assertions by state, and the next check: the first of those that are not evaluated."""
    of = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("state") == s, F.col("assertion")))), ",")
    open_ = F.min(F.when(F.col("state") == "Not Evaluated", F.col("assertion")))
    return states.groupBy("case_id").agg(of("Observed").alias("established"), of("Supported").alias("supported"), of("Contradicted").alias("contradicted"), of("Not Evaluated").alias("unanswered"), open_.alias("next_check"))


def collection_status(artifacts: DataFrame, whole: int = 3) -> DataFrame:
    n = artifacts.groupBy("case_id").agg(F.count_if("recognised").alias("n"))
    return n.select("case_id", F.when(F.col("n") >= whole, "Imported").when(F.col("n") > 0, "Partially imported").otherwise("Not imported").alias("status"))


def latest_snapshot(snapshots: DataFrame, *keys: str) -> DataFrame:
    return snapshots.groupBy(*keys).agg(F.max_by("snapshot_id", F.struct("captured_s", "snapshot_id")).alias("snapshot_id"))
