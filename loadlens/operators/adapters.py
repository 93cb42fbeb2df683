"""Evidence tables of any form: what their columns say they are, the numbers they hold and the signals they give.

Tables of unlike columns are rows of one DataFrame (artifact_id, line, cells), the first row of an artifact naming its columns.
Every recognised field is one expression that looks its aliases up in the artifact's own columns, so all adapters run in
one plan over all artifacts: a row gives the observations of each shape its artifact has, and one aggregation per artifact
gives the flags behind its signals. Only what is counted by sample, lock or counter is grouped more finely first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.functions import scalars as S
from loadlens.sources.files import saved

# The columns that a field goes by, the first that an artifact has counts.
IDENTITY = {
    "session_id": ("session_id", "spid"), "request_id": ("request_id",), "transaction_id": ("transaction_id", "transaction_uow"), "sql_handle": ("sql_handle", "sqlhandle"), "plan_handle": ("plan_handle", "planhandle"),
    "query_hash": ("query_hash", "queryhash"), "plan_hash": ("query_plan_hash", "queryplanhash"), "start_offset": ("statement_start_offset",), "end_offset": ("statement_end_offset",),
    "qs_query_id": ("query_store_query_id", "query_id"), "qs_plan_id": ("query_store_plan_id", "plan_id"), "database_id": ("database_id", "dbid"),
}
_TEXT_KEYS = ("sql_handle", "plan_handle", "query_hash", "plan_hash")
NUMBERS = {
    "runnable": ("runnable_tasks_count",), "delay": ("total_scheduler_delay_ms",), "queue": ("work_queue_count",), "active": ("active_worker_threads",), "ceiling": ("max_worker_threads",),
    "compilations": ("sql_compilations_per_sec",), "batches": ("batch_requests_per_sec",), "compile_waiters": ("resource_semaphore_query_compile_waiting_tasks",), "cache_hit": ("cache_hit_ratio_plan_cache_pct",),
    "lock_session": ("request_session_id", "session_id"), "open_transactions": ("open_transaction_count", "open_tran_count"), "requested": ("requested_memory_kb",), "granted": ("granted_memory_kb",), "used": ("used_memory_kb", "max_used_memory_kb"),
    "grant_wait": ("wait_time_ms",), "counter": ("cntr_value", "counter_value"), "total_spills": ("total_spills", "totalspills"), "average_spills": ("avg_spills", "average_spills"), "plan_count": ("plan_count", "total_plan_count"),
    "single_count": ("single_use_plan_count", "single_use_plans"), "uses": ("usecounts",),
}
TEXTS = {
    "sample": ("sample_id",), "status": ("request_status",), "resource_type": ("resource_type",), "resource_database": ("resource_database_id",), "entity": ("resource_associated_entity_id",), "description": ("resource_description",),
    "grant_time": ("grant_time",), "counter_name": ("counter_name",), "warning": ("warnings", "warning", "findings", "blitzcache_info"), "plan": ("query_plan", "showplan_xml", "last_query_plan"), "set": ("evidence_set", "result_set", "result_set_type"),
}
TIMES = {"at": ("captured_at", "collection_time"), "grant_at": ("captured_at", "collection_time", "request_time"), "spill_at": ("last_execution", "captured_at", "collection_time"), "any_at": ("captured_at", "collection_time", "runtime_interval_start", "start_time")}
# Named result sets; terms of a plan-cache report with their signals; terms of any text with theirs.
SETS = ("REQUEST_PLAN", "SCHEDULERS", "TRANSACTIONS_LOCKS", "MEMORY_GRANTS", "COMPILATION_COUNTERS", "LAST_KNOWN_ACTUAL_PLAN", "QUERY_STORE", "EXTENDED_EVENTS", "PLAN_CACHE_INVENTORY", "WORKER_COUNTERS", "BLITZCACHE", "SERVER_CAPABILITIES")
NATIVE = ("REQUEST_PLAN", "SCHEDULERS", "TRANSACTIONS_LOCKS", "MEMORY_GRANTS", "COMPILATION_COUNTERS", "LAST_KNOWN_ACTUAL_PLAN")
REPORT_TERMS = {
    "plan cache instability": "plan-cache-instability", "single-use": "single-use-warning", "forced serialization": "forced-serialization", "compilation timeout": "compilation-timeout",
    "unused memory grant": "unused-memory-grant", "filter udf": "filter-udf", "non-sargable": "non-sargable", "non sargable": "non-sargable",
}
TEXT_TERMS = {"resource_semaphore": "pending-memory-grant", "threadpool": "worker-queue"}
_REPORT_KEYS = ("query_hash", "sql_handle", "plan_handle", "query_plan", "database_name", "executions")
_REPORT_SPILLS = ("total_spills", "totalspills", "avg_spills", "average_spills", "min_spills", "max_spills")
#: Lock resources that only their description tells apart.
_DESCRIBED = ("KEY", "PAGE", "RID", "XACT", "APPLICATION", "METADATA")
_SHOWPLAN = r"(?i)<\s*(?:\w+:)?ShowPlanXML\b"


def _said(text: Column) -> Column:
    """A trimmed text, null where it says that there is nothing."""
    return F.when((text != "") & ~F.lower(text).isin("null", "n/a", "none"), text)


def _present(c: Column) -> Column:
    return _said(F.trim(c))


def has(*aliases: str) -> Column:
    return F.arrays_overlap("headers", F.array(*map(F.lit, aliases)))


#: Artifacts whose columns are broadcast, after a count; more of them meet their rows by a shuffle.
MOST_HEADS = 100_000


def _places(fields: dict[str, tuple[str, ...]]) -> Column:
    """Where the fields' cells are in a row: of each the place of the first alias among the artifact's columns, null without one."""
    place = lambda a: F.nullif(F.array_position("headers", a), F.lit(0).cast("long"))
    return F.array(*((F.coalesce(*map(place, aliases)) - 1).cast("int") for aliases in fields.values()))


def evidence_rows(matrix: DataFrame, roots: DataFrame) -> DataFrame:
    """The typed rows of artifacts (artifact_id, line, cells), whose first row names their columns: every field above, the columns
    (headers), the row's text and root_session_id of roots (artifact_id, root_session_id). Rows without values are left out.

    Where a field's cell is, is found once for each artifact, and which cells fields of a kind take: a row reads only these as
    numbers, texts and times, each of them once, whatever the number of fields that take it."""
    numbers = {f"number {n}": a for n, a in NUMBERS.items()} | {f"key {n}": a for n, a in IDENTITY.items() if n not in _TEXT_KEYS}
    texts = {f"text {n}": a for n, a in TEXTS.items()} | {f"key {n}": IDENTITY[n] for n in _TEXT_KEYS}
    kinds = {"numbers": numbers, "texts": texts, "times": TIMES}
    first = matrix.groupBy("artifact_id").agg(F.min("line").alias("head"))
    named = matrix.join(F.broadcast(first) if first.count() <= MOST_HEADS else first, "artifact_id").where("line = head").groupBy("artifact_id", "head").agg(F.first("cells").alias("named"))
    heads = named.select("artifact_id", "head", F.transform("named", S.header_norm_evidence).alias("headers"), F.lower(F.array_join("named", " ")).alias("head_text"))
    root = roots.groupBy("artifact_id").agg(F.max("root_session_id").cast("double").alias("root_session_id"))
    heads = heads.join(root, "artifact_id", "left").select("*", *(_places(f).alias(f"at_{k}") for k, f in kinds.items()))
    # cells that a kind takes, and of each field the place among them
    heads = heads.select("*", *(F.array_distinct(F.array_compact(f"at_{k}")).alias(f"of_{k}") for k in kinds))
    among = lambda k: F.transform(f"at_{k}", lambda p: (F.nullif(F.array_position(f"of_{k}", p), F.lit(0).cast("long")) - 1).cast("int"))
    heads = saved(heads.withColumns({f"at_{k}": among(k) for k in kinds}), "heads")
    rows = matrix.join(F.broadcast(heads) if heads.count() <= MOST_HEADS else heads, "artifact_id").where(F.col("line") > F.col("head"))
    rows = rows.where(F.exists("cells", lambda c: _present(c).isNotNull()))
    # in two steps each, as functions over lists compute what they say twice twice
    read = {"numbers": (S.evidence_digits, S.plain_number), "texts": (F.trim, _said), "times": (F.trim, lambda c: F.try_to_timestamp(_said(c)))}
    taken = lambda k, bare, to: F.transform(F.transform(f"of_{k}", lambda p: bare(F.get("cells", p))), lambda c: to(c)).alias(k)
    rows = rows.select("artifact_id", "line", "headers", "head_text", F.lower(F.array_join("cells", " ", "")).alias("text"), "root_session_id", *(f"at_{k}" for k in kinds), *(taken(k, *steps) for k, steps in read.items()))
    at = lambda k, n: F.lit(list(kinds[k]).index(n))
    of = lambda k, n: F.get(k, F.get(f"at_{k}", at(k, n)))
    fields = {n: of("numbers", f"number {n}") for n in NUMBERS} | {n: of("texts", f"text {n}") for n in TEXTS} | {n: of("times", n) for n in TIMES}
    fields |= {n: of("texts" if n in _TEXT_KEYS else "numbers", f"key {n}") for n in IDENTITY}
    fields["set"] = F.upper(fields["set"])
    return rows.select("artifact_id", "line", "headers", "head_text", "text", "root_session_id", *(c.alias(n) for n, c in fields.items()))


def _identified() -> Column:
    return reduce(lambda x, y: x | y, (F.col(k).isNotNull() for k in IDENTITY))


def _is_report(text: Column) -> Column:
    columns = (has(*TEXTS["warning"]) | has(*_REPORT_SPILLS)) & has(*_REPORT_KEYS)
    return columns | text.contains("sp_blitzcache") | text.contains("plan cache instability")


def _shapes(sets: Column, report: Column, traced: Column) -> dict[str, Column]:
    in_set = lambda s: F.array_contains(sets, s)
    return {
        "scheduler": has("runnable_tasks_count"), "worker": has("active_worker_threads") & has("max_worker_threads"), "compile": has("sql_compilations_per_sec") & has("batch_requests_per_sec"),
        "lock": has("request_mode") & has("request_session_id", "session_id"), "transaction": has(*NUMBERS["open_transactions"]), "grant": has("requested_memory_kb", "granted_memory_kb"),
        "counter": has("counter_name") & has(*NUMBERS["counter"]), "report": report,
        "plan-cache": (has(*NUMBERS["plan_count"]) & has(*NUMBERS["single_count"])) | (has("usecounts") & (in_set("PLAN_CACHE_INVENTORY") | (has("cacheobjtype") & has("objtype")))),
        "plan-lookup": has(*TEXTS["plan"]), "query-store": in_set("QUERY_STORE") | (has("query_id") & has("plan_id") & has("avg_duration", "query_sql_text")),
        "extended-events": in_set("EXTENDED_EVENTS") | (has("event_name", "name") & (has("showplan_xml", "query_plan") | traced)),
    }


def evidence_shape(rows: DataFrame) -> DataFrame:
    """(artifact_id, shapes, adapter, kind, result_sets, captured_at, rows): what each artifact of evidence_rows is."""
    said = lambda term: F.bool_or(F.col("text").contains(term))
    at_head = lambda term: F.col("head_text").contains(term)
    # flags and keys alone, which an aggregation by hash takes; lists would be sorted
    g = rows.groupBy("artifact_id", "headers", "head_text").agg(
        *(F.coalesce(F.bool_or(F.col("set") == s), F.lit(False)).alias(f"set {s}") for s in SETS), F.min("any_at").alias("captured_at"), F.count("*").alias("rows"),
        (said("sp_blitzcache") | said("plan cache instability")).alias("said"), said("query_post_execution_showplan").alias("traced"))
    g = g.withColumns({"named": F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"set {s}"), s) for s in SETS)))), "said": F.col("said") | at_head("sp_blitzcache") | at_head("plan cache instability"), "traced": F.col("traced") | at_head("query_post_execution_showplan")})
    report = ((has(*TEXTS["warning"]) | has(*_REPORT_SPILLS)) & has(*_REPORT_KEYS)) | F.col("said")
    shapes = _shapes(F.col("named"), report, F.col("traced"))
    g = g.select("*", *(c.alias(f"is {n}") for n, c in shapes.items()))
    of = lambda n: F.col(f"is {n}")
    also = {"SCHEDULERS": of("scheduler"), "WORKER_COUNTERS": of("worker"), "COMPILATION_COUNTERS": of("compile") | of("counter"), "TRANSACTIONS_LOCKS": of("lock") | of("transaction"), "MEMORY_GRANTS": of("grant"), "BLITZCACHE": of("report"), "QUERY_STORE": of("query-store"), "EXTENDED_EVENTS": of("extended-events")}
    sets = F.array_sort(F.array_union("named", F.array_compact(F.array(*(F.when(c, s) for s, c in also.items())))))
    # of several adapters the last in this order names the artifact
    adapter = F.lit("generic-tabular")
    for name, on in (("native", F.arrays_overlap("named", F.array(*map(F.lit, NATIVE))) | of("scheduler")), ("worker-counters", of("worker")), ("compilation-counters", of("compile")), ("native", of("lock") | of("transaction") | of("grant") | of("counter")), ("plan-cache-report", of("report")), ("query-store", of("query-store")), ("extended-events", of("extended-events"))):
        adapter = F.when(on, name).otherwise(adapter)
    kind = F.lit("Diagnostic result")
    for name, on in (("Scheduler", of("scheduler") | of("worker")), ("Plan cache", of("compile")), ("Locks", of("lock")), ("Memory grants", of("grant")), ("Plan cache", of("report"))):
        kind = F.when(on, name).otherwise(kind)
    listed = F.array_compact(F.array(*(F.when(of(n), n) for n in shapes)))
    return g.select("artifact_id", listed.alias("shapes"), adapter.alias("adapter"), kind.alias("kind"), sets.alias("result_sets"), "captured_at", "rows")


def _resource() -> Column:
    """A lock's resource in one text; null where the row does not tell it from others."""
    kind = F.upper("resource_type")
    whole = kind.isNotNull() & F.col("resource_database").isNotNull() & ((kind == "DATABASE") | F.col("entity").isNotNull() | F.col("description").isNotNull()) & (~kind.isin(*_DESCRIBED) | F.col("description").isNotNull())
    return F.when(whole, F.concat_ws("|", kind, "resource_database", F.coalesce("entity", F.lit("")), F.coalesce("description", F.lit(""))))


def _status() -> Column:
    return F.coalesce(S.header_norm_evidence(F.col("status")), F.lit(""))


def _report_signals(text: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*(F.when(text.contains(t), s) for t, s in REPORT_TERMS.items()))))


def _counter_deltas(rows: DataFrame) -> DataFrame:
    """(artifact_id, compilations, batches, captured_at): what the two counters gained from their first to their last sample, null
    with fewer than two; a counter that fell has gained nothing."""
    name = F.lower(F.trim("counter_name"))
    of = rows.where(has("counter_name") & has(*NUMBERS["counter"]) & F.col("counter").isNotNull() & name.isin("sql compilations/sec", "batch requests/sec"))
    g = of.groupBy("artifact_id", name.alias("name")).agg(F.count("*").alias("n"), (F.max_by("counter", "line") - F.min_by("counter", "line")).alias("gain"))
    gain = lambda n: F.max(F.when((F.col("name") == n) & (F.col("n") >= 2), F.greatest(F.col("gain"), F.lit(0.0))))
    return g.groupBy("artifact_id").agg(gain("sql compilations/sec").alias("compilations"), gain("batch requests/sec").alias("batches"))


def _plan_counts(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """(artifact_id, plans, single): cached plans and those used once, as reported in the first row, or counted."""
    told = has(*NUMBERS["plan_count"]) & has(*NUMBERS["single_count"])
    g = rows.join(shapes.where(F.array_contains("shapes", "plan-cache")).select("artifact_id"), "artifact_id").groupBy("artifact_id").agg(
        F.bool_or(told).alias("told"), F.min_by("plan_count", "line").alias("plan_count"), F.min_by("single_count", "line").alias("single_count"), F.count("*").cast("double").alias("n"), F.count_if(F.coalesce("uses", F.lit(0.0)) <= 1).cast("double").alias("once"))
    out = g.select("artifact_id", F.when(F.col("told"), F.col("plan_count")).otherwise(F.col("n")).alias("plans"), F.when(F.col("told"), F.col("single_count")).otherwise(F.col("once")).alias("single"))
    return out.where("plans > 0 and single is not null")


OBSERVED = ["kind", "metric", "value", "text", "unit", "at", "directness", "detail", "signals"]


def evidence_observations(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """(artifact_id, line, kind, metric, value, text, unit, at, directness, detail, signals, and the keys of IDENTITY) from
    evidence_rows and their evidence_shape. What is computed from several numbers or samples is Derived, all else Direct; line is
    null for what an artifact shows as a whole."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    null = lambda kind: F.lit(None).cast(kind)
    at_any = lambda *names: reduce(lambda x, y: x | y, (F.array_contains("shapes", n) for n in names))

    def seen(on: Column, kind: str, metric: str, value: Column | None = None, unit: str | None = None, at: str = "at", directness: str = "Direct", text: Column | None = None, detail: Column | None = None, named: bool = True, signals: Column | None = None) -> Column:
        parts = [F.lit(kind), F.lit(metric), (value if value is not None else null("double")), (text if text is not None else null("string")), F.lit(unit).cast("string"), F.col(at), F.lit(directness), (detail if detail is not None else null("string")), (signals if signals is not None else null("array<string>"))]
        return F.when(F.coalesce(on, F.lit(False)), F.struct(*(p.alias(n) for p, n in zip(parts, OBSERVED, strict=True)), F.lit(named).alias("named")))

    s = {n: at_any(n) for n in ("scheduler", "worker", "compile", "lock", "transaction", "grant", "report", "plan-lookup")}
    ratio = F.when(F.col("batches") > 0, zero(F.col("compilations")) / F.col("batches")).otherwise(0.0)
    own, plan_there = _report_signals(F.col("text")), F.coalesce(F.col("plan").rlike(_SHOWPLAN), F.lit(False))
    # by shapes, so that a row of one shape is asked for no other
    each_of = {"scheduler": (
        seen(s["scheduler"], "Scheduler", "runnable_tasks_count", zero(F.col("runnable")), "tasks"), seen(s["scheduler"] & has("total_scheduler_delay_ms"), "Scheduler", "total_scheduler_delay_ms", F.col("delay"), "milliseconds"),
    ), "worker": (
        seen(s["worker"], "Worker", "active_worker_threads", zero(F.col("active")), "workers", named=False), seen(s["worker"], "Worker", "max_worker_threads", zero(F.col("ceiling")), "workers", named=False), seen(s["worker"], "Worker", "work_queue_count", zero(F.col("queue")), "tasks", named=False),
    ), "compile": (
        seen(s["compile"], "Compilation", "compilation_to_batch_ratio", ratio, "ratio", directness="Derived", named=False), seen(s["compile"], "Compilation", "compile_waiting_tasks", zero(F.col("compile_waiters")), "tasks", named=False),
        seen(s["compile"] & F.col("cache_hit").isNotNull(), "Plan cache", "cache_hit_ratio_pct", F.col("cache_hit"), "percent", named=False),
    ), "lock": (
        seen(s["lock"], "Lock", "request_status", text=F.nullif(_status(), F.lit("")), detail=F.coalesce(_resource(), F.lit("Incomplete lock resource identity"))),
    ), "transaction": (
        seen(s["transaction"], "Transaction", "open_transaction_count", F.col("open_transactions"), "transactions"),
    ), "grant": (
        *(seen(s["grant"], "Memory grant", f"{n}_memory_kb", F.col(n), "KB", "grant_at") for n in ("requested", "granted", "used")),
    ), "report": (
        seen(s["report"] & (F.col("warning").isNotNull() | (F.size(own) > 0)), "Plan-cache report", "warning", text=F.coalesce("warning", F.array_join(own, ", ")), signals=own),
        seen(s["report"] & F.col("total_spills").isNotNull(), "Plan-cache report", "total_spill_pages", F.col("total_spills"), "8 KB pages", "spill_at"), seen(s["report"] & F.col("average_spills").isNotNull(), "Plan-cache report", "average_spill_pages", F.col("average_spills"), "8 KB pages/execution", "spill_at"),
    ), "plan-lookup": (
        seen(s["plan-lookup"], "Plan lookup", "query_plan_available", text=plan_there.cast("string")),
    )}
    of = lambda n, seen_: rows.join(shapes.where(at_any(n)).select("artifact_id", "shapes"), "artifact_id").select("artifact_id", "line", *IDENTITY, F.explode(F.array_compact(F.array(*seen_))).alias("o"))
    each = reduce(DataFrame.unionByName, (of(n, seen_) for n, seen_ in each_of.items()))
    out = each.select("artifact_id", "line", *(f"o.{n}" for n in OBSERVED), *(F.when(F.col("o.named"), F.col(k)).alias(k) for k in IDENTITY))
    as_whole = lambda df, kind, metric, value, unit, directness: df.where(value.isNotNull()).join(shapes.select("artifact_id", F.col("captured_at").alias("at")), "artifact_id").select("artifact_id", F.lit(kind).alias("kind"), F.lit(metric).alias("metric"), value.alias("value"), F.lit(unit).alias("unit"), "at", F.lit(directness).alias("directness"))
    deltas, counts = _counter_deltas(rows), _plan_counts(rows, shapes)
    wholes = [
        as_whole(deltas, "Compilation", "compilation_delta", F.col("compilations"), "compilations", "Derived"), as_whole(deltas, "Compilation", "batch_delta", F.col("batches"), "batches", "Derived"),
        as_whole(deltas, "Compilation", "compilation_to_batch_ratio", F.when(F.col("batches") > 0, F.col("compilations") / F.col("batches")), "ratio", "Derived"),
        as_whole(counts, "Plan cache", "total_plan_count", F.col("plans"), "plans", "Direct"), as_whole(counts, "Plan cache", "single_use_plan_count", F.col("single"), "plans", "Direct"), as_whole(counts, "Plan cache", "single_use_percentage", F.col("single") / F.col("plans") * 100, "percent", "Derived"),
    ]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), wholes, out)


def report_signals(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """(artifact_id, signal, and the keys of IDENTITY): the signals that evidence_observations tells of single rows, which only reports
    have; no other observation is made."""
    own = _report_signals(F.col("text"))
    of = rows.join(shapes.where(F.array_contains("shapes", "report")).select("artifact_id"), "artifact_id", "left_semi")
    return of.select("artifact_id", *IDENTITY, F.explode(own).alias("signal"))


def evidence_signals(rows: DataFrame, shapes: DataFrame, ratio: float = 0.1) -> DataFrame:
    """(artifact_id, signal): what the artifacts of evidence_rows show."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    shaped = rows.join(shapes.select("artifact_id", "shapes", "result_sets"), "artifact_id")
    is_ = lambda n: F.array_contains("shapes", n)
    root = F.coalesce(F.col("lock_session") == F.col("root_session_id"), F.lit(False))
    said = {t: yes(F.col("text").contains(t)) | F.col("head_text").contains(t) for t in (*REPORT_TERMS, *TEXT_TERMS)}
    hit = lambda last: (F.max_by if last else F.min_by)("cache_hit", F.when(F.col("cache_hit").isNotNull(), F.col("line")))
    plan_there = F.coalesce(F.col("plan").rlike(_SHOWPLAN), F.lit(False))
    g = shaped.groupBy("artifact_id", "head_text").agg(
        F.max(zero("runnable")).alias("runnable"), F.max(zero("queue")).alias("queue"), yes((zero("active") >= F.col("ceiling")) & (zero("queue") > 0)).alias("exhausted"),
        F.max(F.when(F.col("batches") > 0, zero("compilations") / F.col("batches")).otherwise(0.0)).alias("ratio"), F.max(zero("compile_waiters")).alias("waiters"), hit(False).alias("hit_from"), hit(True).alias("hit_to"),
        yes(is_("lock") & root & _status().isin("", "grant", "granted")).alias("root_locks"), yes(is_("transaction") & (F.col("session_id") == F.col("root_session_id")) & (F.col("open_transactions") > 0)).alias("root_tran"),
        yes(is_("grant") & ((F.col("grant_time").isNull() & (F.col("requested") > 0)) | (F.col("grant_wait") > 0))).alias("pending"), yes(is_("report") & ((F.col("total_spills") > 0) | (F.col("average_spills") > 0))).alias("spill"),
        yes(is_("plan-lookup") & plan_there).alias("plan_there"), yes(_identified()).alias("identified"), *(c.alias(t) for t, c in said.items()))
    g = g.join(shapes.select("artifact_id", "shapes", F.col("result_sets").alias("sets")), "artifact_id")
    any_term = reduce(lambda x, y: x | y, (F.col(f"`{t}`") for t in REPORT_TERMS))
    signal = {
        "scheduler-runnable-queue": is_("scheduler") & (F.col("runnable") > 0), "worker-queue": ((is_("scheduler") | (is_("worker") & ~F.col("exhausted"))) & (F.col("queue") > 0)) | F.col("threadpool"), "worker-exhaustion-confirmed": is_("worker") & F.col("exhausted"),
        "compilation-pressure": is_("compile") & (F.col("waiters") > 0) & (F.col("ratio") >= ratio), "plan-cache-pressure-wide": is_("compile") & (F.col("waiters") > 0) & (F.col("hit_to") < F.col("hit_from")),
        "root-locks-granted": F.col("root_locks"), "root-open-transaction": F.col("root_tran"), "pending-memory-grant": F.col("pending") | F.col("resource_semaphore"), "plan-cache-warning": is_("report") & any_term, "spill-evidence": F.col("spill"),
        "embedded-plan-captured": F.col("plan_there"), "plan-lookup-null": is_("plan-lookup") & ~F.col("plan_there") & F.arrays_overlap("sets", F.array(*map(F.lit, ("REQUEST_PLAN", "LAST_KNOWN_ACTUAL_PLAN", "QUERY_STORE")))) & F.col("identified"),
        "query-store-evidence": is_("query-store"), "extended-events-evidence": is_("extended-events"), "server-capabilities": F.array_contains("sets", "SERVER_CAPABILITIES"),
    }
    signal |= {s: is_("report") & reduce(lambda x, y: x | y, (F.col(f"`{t}`") for t, of in REPORT_TERMS.items() if of == s)) for s in REPORT_TERMS.values()}
    flagged = g.select("artifact_id", F.explode(F.array_compact(F.array(*(F.when(c, s) for s, c in signal.items())))).alias("signal"))
    # samples that are told apart by a number or a time; sums of a sample's rows
    key = F.when(F.col("sample").isNotNull(), F.concat(F.lit("s"), "sample")).when(F.col("at").isNotNull(), F.concat(F.lit("t"), F.col("at").cast("string"))).otherwise(F.concat(F.lit("r"), "line"))
    queues = shaped.where(is_("scheduler")).groupBy("artifact_id", key.alias("key")).agg(F.sum(zero("runnable")).alias("tasks"))
    lasting = queues.groupBy("artifact_id").agg(F.count_if(F.col("tasks") > 0).alias("n"), F.bool_or(~F.col("key").startswith("r")).alias("scoped")).where("n >= 2 and scoped").select("artifact_id", F.lit("scheduler-pressure-sustained").alias("signal"))
    # a resource is one row, whatever the number of its holders and waiters
    waits = ~root & _status().isin("wait", "waiting", "convert")
    held = shaped.where(is_("lock")).select("artifact_id", _resource().alias("resource"), (root & _status().isin("", "grant", "granted")).alias("holds"), waits.alias("waits")).where("resource is not null and (holds or waits)")
    met = held.groupBy("artifact_id", "resource").agg(F.bool_or("holds").alias("holds"), F.bool_or("waits").alias("waits")).where("holds and waits").select("artifact_id", F.lit("lock-resource-match").alias("signal")).distinct()
    rising = _counter_deltas(rows).where((F.col("batches") > 0) & (F.col("compilations") / F.col("batches") >= ratio)).select("artifact_id", F.lit("compilation-pressure").alias("signal"))
    unstable = _plan_counts(rows, shapes).where((F.col("plans") >= 1000) & (F.col("single") / F.col("plans") * 100 >= 90)).select("artifact_id", F.lit("plan-cache-instability-measured").alias("signal"))
    return reduce(DataFrame.unionByName, (flagged, lasting, met, rising, unstable)).distinct()
