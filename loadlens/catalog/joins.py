"""Queries of the joins, of the spill ranking, and of aggregations and sets over inputs and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.catalog.activity import acts
from loadlens.catalog.base import Query
from loadlens.catalog.rules import _MISSING, _SEV, ALL, _missing, found
from loadlens.operators import correlation as K
from loadlens.operators import inventory as J
from loadlens.operators import rules as R
from loadlens.operators import spill as P
from loadlens.sources import inputs as I

_H = "nullif(regexp_replace(lower(trim({0})), '^0x', ''), '')"
_ID = f"idn AS (SELECT * REPLACE ({_H.format('plan_handle')} AS plan_handle, {_H.format('sql_handle')} AS sql_handle, {_H.format('query_hash')} AS query_hash, {_H.format('plan_hash')} AS plan_hash) FROM ident)"
_WHOLE_LOCKS = "f AS (SELECT *, coalesce(description, '') AS about FROM locks WHERE entity_id IS NOT NULL AND (description IS NOT NULL OR resource_type NOT IN ('KEY', 'PAGE', 'RID')))"
_ON = "x.resource_type, x.database_id, x.entity_id, x.about"
_EVEN = "g.resource_type = w.resource_type AND g.database_id = w.database_id AND g.entity_id = w.entity_id AND g.about = w.about"
_S = lambda *k: " AND ".join(f"coalesce(l.{x} = r.{x}, false)" for x in k)
_D = lambda k: f"CASE WHEN l.{k} <> r.{k} THEN 1 ELSE 0 END"
MATCH = f"""{_ID}, m0 AS (SELECT l.id AS l_id, r.id AS r_id, {' + '.join(_D(k) for k in ('plan_handle', 'sql_handle', 'plan_hash', 'qs_query_id', 'qs_plan_id', 'database_id'))} + CASE WHEN l.sql_handle = r.sql_handle AND l.start_offset <> r.start_offset THEN 1 ELSE 0 END + CASE WHEN l.sql_handle = r.sql_handle AND l.end_offset <> r.end_offset THEN 1 ELSE 0 END AS n_conflicts,
 CASE WHEN {_S('qs_query_id', 'qs_plan_id')} THEN CASE WHEN {_S('database_id')} THEN 'Exact' WHEN l.database_id IS NOT NULL AND r.database_id IS NOT NULL THEN 'None' ELSE 'Candidate' END WHEN {_S('plan_handle')} THEN 'Exact'
  WHEN {_S('sql_handle')} THEN CASE WHEN l.start_offset IS NOT NULL AND l.end_offset IS NOT NULL AND r.start_offset IS NOT NULL AND r.end_offset IS NOT NULL THEN CASE WHEN {_S('start_offset', 'end_offset')} THEN 'Exact' ELSE 'None' END ELSE 'Strong' END
  WHEN {_S('query_hash')} THEN CASE WHEN {_S('plan_hash')} THEN 'Strong' ELSE 'Candidate' END WHEN {_S('session_id', 'request_id')} THEN CASE WHEN {_S('transaction_id')} THEN 'Exact' ELSE 'Strong' END ELSE 'None' END AS quality, r.id % 3 <> 0 AS actual
 FROM idn l JOIN idn r ON l.session_id = r.session_id AND l.side = 0 AND r.side = 1 WHERE {_S('qs_query_id', 'qs_plan_id')} OR {_S('plan_handle')} OR {_S('sql_handle')} OR {_S('query_hash')} OR {_S('session_id', 'request_id')}),
mt AS (SELECT *, n_conflicts = 0 AND quality <> 'None' AS matched, CASE quality WHEN 'Exact' THEN 3 WHEN 'Strong' THEN 2 WHEN 'Candidate' THEN 1 ELSE 0 END AS strength FROM m0)"""
SELECTIONS = "sel AS (SELECT l.id AS l_id, r.chosen FROM ident l JOIN (SELECT session_id, max(id) AS chosen FROM ident WHERE side = 1 GROUP BY session_id) r USING (session_id) WHERE l.side = 0 AND l.id % 4 = 0)"
CANDIDATES = f"""{MATCH}, {SELECTIONS}, good AS (SELECT *, strength * 2 + CAST(actual AS INTEGER) AS score FROM mt WHERE matched AND strength >= 2), tops AS (SELECT l_id, count(*) AS ties, min(r_id) AS first_id, max(strength) AS strength, list(r_id) AS alts FROM (SELECT *, max(score) OVER (PARTITION BY l_id) AS most FROM good) z WHERE score = most GROUP BY l_id),
bl AS (SELECT l_id, max(strength) AS against FROM mt WHERE NOT matched AND strength >= 2 GROUP BY l_id), cand AS (SELECT l_id, CASE WHEN against >= strength THEN 'blocked' WHEN ties = 1 THEN 'resolved' WHEN coalesce(list_contains(alts, chosen), false) THEN 'selected' ELSE 'ambiguous' END AS state, first_id, chosen, ties FROM tops LEFT JOIN bl USING (l_id) LEFT JOIN sel USING (l_id))"""
_AVG = "spc AS (SELECT *, coalesce(avg_pages, CASE WHEN total_pages > 0 AND executions > 0 THEN total_pages / executions END) AS average, CASE WHEN avg_pages IS NOT NULL THEN 'imported' WHEN total_pages > 0 AND executions > 0 THEN 'derived' ELSE 'missing' END AS average_state FROM spills)"
_NORM = r"lower(regexp_replace(regexp_replace(trim(header), '^\[|\]$', '', 'g'), '\s+', ' ', 'g'))"
_FAMILIES = ", ".join(f"('{f}', '{c}')" for f, cs in I.FAMILY_COLUMNS.items() for c in cs)
_KNOWN = ", ".join(f"('{c}')" for c in I.COLUMNS)


def _match(v):
    i = v.ident
    return K.identity_match(i.where("side = 0"), i.where("side = 1"))


def _class_counts(v):
    """How many pairs of rows there are of each quality, by counts of classes alone; pairs by session are made of rows."""
    l_, r = v.ident.where("side = 0"), v.ident.where("side = 1")
    (lc, _), (rc, _) = K.identity_classes(l_), K.identity_classes(r)
    of = K.class_match(lc, rc).join(lc.select(F.col("cls").alias("l_cls"), F.col("n").alias("l_n")), "l_cls").select("quality", "matched", (F.col("l_n") * F.col("r_n")).alias("pairs"))
    rows = K._by_session(l_, r).select("quality", "matched", F.lit(1).cast("long").alias("pairs"))
    return of.unionByName(rows).where("quality <> 'None'").groupBy("quality", "matched").agg(F.sum("pairs").alias("pairs"))


def _selections(v):
    last = v.ident.where("side = 1").groupBy("session_id").agg(F.max("id").alias("chosen"))
    return v.ident.where("side = 0 and id % 4 = 0").join(last, "session_id").select(F.col("id").alias("l_id"), "chosen")


def _candidates(v):
    i = v.ident
    return K.candidate_plans(i.where("side = 0"), i.where("side = 1").withColumn("actual", F.col("id") % 3 != 0), _selections(v))


def _valid(v):
    """Only the pairs that selections name are graded."""
    i, chosen = v.ident, _selections(v)
    return K.manual_selection_valid(_candidates(v), K.named_pairs(i.where("side = 0"), i.where("side = 1"), chosen.select("l_id", F.col("chosen").alias("r_id"))), chosen)


def _spills(v):
    return P.spill_candidates(v.spills)


def _raw_spills(v):
    """Rows of plan-cache exports as they are written: other headers, units, words for nothing, and faults."""
    k, text = F.col("source_order"), lambda c: F.col(c).cast("string")
    total = F.when(k % 11 == 0, "not supplied").when(k % 13 == 0, "-5").when(k % 17 == 0, F.concat(text("t"), F.lit(" MB"))).otherwise(text("t"))
    r = v.spills.withColumn("t", F.col("total_pages").cast("long"))
    cells = F.map_filter(F.create_map(
        F.when(k % 3 == 0, "TotalSpills").when(k % 3 == 1, "Total Spills (KB)").otherwise("Total Spills 8 KB pages"), total, F.lit("Avg Spills"), F.col("avg_pages").cast("long").cast("string"), F.lit("# Executions"), text("executions"),
        F.lit("Last Execution"), F.when(k % 19 == 0, "some day").otherwise(F.date_format("last_execution", "yyyy-MM-dd HH:mm:ss")), F.when(k % 2 == 0, "Plan Handle").otherwise("SQL Handle"), F.col("plan_handle"),
        F.lit("Query Hash"), F.when(k % 5 > 1, F.col("query_hash")), F.lit("Warnings"), F.col("warnings")), lambda _, x: x.isNotNull())
    return r.select("source_order", cells.alias("cells"))


def _imported(v):
    return P.spill_candidates(P.read_candidates(_raw_spills(v)))


_IMPORT = """raw AS (SELECT *, CAST(total_pages AS BIGINT) AS t, CAST(avg_pages AS BIGINT) AS g, source_order AS k FROM spills), imp AS (SELECT k, t, CASE WHEN k % 11 = 0 OR (k % 13 <> 0 AND t IS NULL) THEN 'missing' WHEN k % 13 = 0 OR k % 17 = 0 THEN 'invalid' WHEN t = 0 THEN 'zero-or-nonpositive' ELSE 'imported' END AS total_state, k % 11 <> 0 AND k % 13 <> 0 AND k % 17 = 0 AND t IS NOT NULL AS clash,
 CASE WHEN g IS NULL THEN 'missing' WHEN g = 0 THEN 'zero-or-nonpositive' ELSE 'imported' END AS avg_state, CAST(g AS DOUBLE) AS avg_pages, executions, k % 19 = 0 AS bad_time, CASE WHEN k % 2 = 0 THEN plan_handle END AS plan_handle, CASE WHEN k % 2 = 1 THEN plan_handle END AS sql_handle, CASE WHEN k % 5 > 1 THEN query_hash END AS query_hash, warnings FROM raw),
im AS (SELECT *, CASE WHEN total_state IN ('imported', 'zero-or-nonpositive') THEN t / CASE WHEN k % 3 = 1 THEN 8.0 ELSE 1.0 END END AS total_pages FROM imp), ic AS (SELECT *, coalesce(avg_pages, CASE WHEN total_pages > 0 AND executions > 0 THEN total_pages / executions END) AS average, CASE WHEN avg_pages IS NULL AND total_pages > 0 AND executions > 0 THEN 'derived' ELSE avg_state END AS average_state FROM im)"""


def _grants(v):
    """Memory grants of the statements: every seventh has waited, every third is not granted yet."""
    k = F.col("statement_id")
    return v.plan_stmts.select("database_id", (F.col("granted_mb") * 1024).alias("requested_kb"), F.when(k % 3 != 0, k).alias("grant_time"), F.when(k % 7 == 0, k % 5000).alias("wait_ms"))


QUERIES = [
    Query("identity_match", lambda v: _match(v).select("l_id", "r_id", "quality", "n_conflicts", "matched"), f"WITH {MATCH} SELECT l_id, r_id, quality, n_conflicts, matched FROM mt"),
    Query("incident_overlap", lambda v: K.incident_overlap(v.samples.select(F.col("sample_order").alias("artifact_id"), F.concat(F.lit("src-"), F.col("sample_order") % 2).alias("window_id"), F.when(F.col("sample_order") % 17 != 0, F.col("capture_s") - 100).alias("at_s")), v.activity.groupBy(F.col("source_id").alias("window_id")).agg((F.min("capture_s") + 60).alias("first_s"), (F.max("capture_s") - 200).alias("last_s"))),
          "WITH a AS (SELECT sample_order AS artifact_id, concat('src-', sample_order % 2) AS window_id, CASE WHEN sample_order % 17 <> 0 THEN capture_s - 100 END AS t FROM samples), w AS (SELECT source_id AS window_id, min(capture_s) + 60 AS f, max(capture_s) - 200 AS l FROM activity GROUP BY 1) SELECT artifact_id, window_id, CASE WHEN t IS NULL THEN 'Unknown' WHEN t BETWEEN f AND l THEN 'Exact' WHEN t BETWEEN f - 30 AND l + 30 THEN 'Overlapping' ELSE 'Context only' END AS overlap FROM a LEFT JOIN w USING (window_id)"),
    Query("lock_resource_match", lambda v: K.lock_resource_match(v.locks), f"WITH {_WHOLE_LOCKS} SELECT DISTINCT g.session_id AS holder, w.session_id AS waiter, {_ON.replace('x.', 'g.')} FROM f g JOIN f w ON g.request_status = 'GRANT' AND w.request_status = 'WAIT' AND g.session_id <> w.session_id AND {_EVEN}"),
    Query("lock_resources", lambda v: K.lock_resources(v.locks), f"WITH {_WHOLE_LOCKS}, s AS (SELECT resource_type, database_id, entity_id, about, session_id, bool_or(request_status = 'GRANT') AS h, bool_or(request_status = 'WAIT') AS w FROM f GROUP BY ALL) SELECT resource_type, database_id, entity_id, about, count(*) FILTER (WHERE h) AS holders, count(*) FILTER (WHERE w) AS waiters, count(*) FILTER (WHERE h AND w) AS both, count(*) FILTER (WHERE h) * count(*) FILTER (WHERE w) - count(*) FILTER (WHERE h AND w) AS pairs FROM s GROUP BY 1, 2, 3, 4 HAVING pairs > 0"),
    Query("lock_members", lambda v: K.lock_members(v.locks, 4).groupBy(*K.RESOURCE, "side").agg(F.sum(F.size("sessions")).alias("sessions"), F.sum(F.aggregate("sessions", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total")), f"WITH {_WHOLE_LOCKS} SELECT resource_type, database_id, entity_id, about, CASE request_status WHEN 'GRANT' THEN 'holder' ELSE 'waiter' END AS side, count(DISTINCT session_id) AS sessions, sum(DISTINCT session_id) AS total FROM f GROUP BY 1, 2, 3, 4, 5"),
    Query("class_match", _class_counts, f"WITH {MATCH} SELECT quality, matched, count(*) AS pairs FROM mt WHERE quality <> 'None' GROUP BY ALL"),
    Query("shared_resources", lambda v: K.shared_resources(v.locks), "SELECT resource_type, database_id, entity_id, description FROM locks WHERE request_status = 'GRANT' INTERSECT SELECT resource_type, database_id, entity_id, description FROM locks WHERE request_status = 'WAIT'"),
    Query("scheduler_blocking_link", lambda v: K.scheduler_blocking_link(found(v)), f"{ALL}, s AS (SELECT subject, subject AS root FROM findings WHERE rule_id = 'WIA-SCHEDULER-PRESSURE'), b AS (SELECT subject, split_part(subject, ':', 2) AS root FROM findings WHERE rule_id = 'WIA-BLOCKING') SELECT s.subject AS \"from\", b.subject AS \"to\" FROM s JOIN b USING (root) UNION ALL SELECT b.subject, s.subject FROM s JOIN b USING (root)"),
    Query("plan_record_link", lambda v: J.plan_record_link(v.plan_stmts.select("statement_id", "plan_id", F.col("statement_id").alias("source_record")), v.activity), "SELECT statement_id, plan_id, session_id, source_id FROM plan_stmts JOIN activity ON statement_id = row_number"),
    Query("sidecar_identity", lambda v: K.sidecar_identity(v.plan_stmts, v.spills.select(F.col("source_order").alias("sidecar_id"), F.concat(F.lit("plan-"), F.expr("cast(substr(query_hash, 2) as bigint) % 400")).alias("plan_id"), "query_hash", F.concat(F.lit("p"), F.expr("cast(substr(query_hash, 2) as bigint) % 50")).alias("plan_hash"), F.when(F.col("source_order") % 2 == 0, F.col("source_order") % 977).alias("qs_query_id"))).drop("conflicts"),
          """WITH sc AS (SELECT source_order AS sidecar_id, concat('plan-', CAST(CAST(substr(query_hash, 2) AS BIGINT) % 400 AS VARCHAR)) AS plan_id, query_hash, concat('p', CAST(CAST(substr(query_hash, 2) AS BIGINT) % 50 AS VARCHAR)) AS plan_hash, CASE WHEN source_order % 2 = 0 THEN source_order % 977 END AS qs FROM spills),
 h AS (SELECT plan_id, query_hash, plan_hash, min(statement_id) AS x FROM plan_stmts GROUP BY ALL HAVING count(*) = 1), q AS (SELECT plan_id, qs_query_id, min(statement_id) AS x FROM plan_stmts WHERE qs_query_id IS NOT NULL GROUP BY ALL HAVING count(*) = 1), o AS (SELECT plan_id, min(statement_id) AS x FROM plan_stmts GROUP BY ALL HAVING count(*) = 1)
 SELECT sidecar_id, sc.plan_id, coalesce(h.x, q.x, o.x) AS statement_id, CASE WHEN h.x IS NOT NULL THEN 'hash' WHEN q.x IS NOT NULL THEN 'store' WHEN o.x IS NOT NULL THEN 'only' ELSE 'none' END AS tier FROM sc LEFT JOIN h ON h.plan_id = sc.plan_id AND h.query_hash = sc.query_hash AND h.plan_hash = sc.plan_hash LEFT JOIN q ON q.plan_id = sc.plan_id AND q.qs_query_id = sc.qs LEFT JOIN o ON o.plan_id = sc.plan_id"""),
    Query("candidate_plan", _candidates, f"WITH {CANDIDATES} SELECT l_id, state, CASE state WHEN 'resolved' THEN first_id WHEN 'selected' THEN chosen END AS r_id, ties FROM cand"),
    Query("manual_selection_valid", _valid, f"WITH {CANDIDATES} SELECT l_id, chosen FROM sel WHERE l_id IN (SELECT l_id FROM cand WHERE state IN ('ambiguous', 'selected')) AND (l_id, chosen) IN (SELECT (l_id, r_id) FROM mt WHERE matched)"),
    Query("correlated_evidence", lambda v: K.correlated_evidence(_match(v), v.ident.where("session_id = 7").select(F.col("id").alias("artifact_id"))), f"WITH {MATCH} SELECT l_id AS artifact_id FROM mt WHERE matched AND strength > 1 UNION SELECT id FROM ident WHERE session_id = 7"),
    Query("spill_candidates", lambda v: _imported(v).select("source_order", F.round("total_pages", 6).alias("total_pages"), "total_state", F.round("average", 6).alias("average"), "average_state", "executions", "bad_time", "plan_handle", "sql_handle", "query_hash", F.array_join("warning_list", "/").alias("warnings")),
          f"WITH {_IMPORT} SELECT k AS source_order, round(total_pages, 6) AS total_pages, total_state, round(average, 6) AS average, average_state, executions, bad_time, plan_handle, sql_handle, query_hash, coalesce(replace(replace(warnings, '; ', '/'), '|', '/'), '') AS warnings FROM ic"),
    Query("spill_rank", lambda v: P.spill_rank(_spills(v)).select("source_order", "rank"), f"WITH {_AVG}, k AS (SELECT source_order, row_number() OVER (ORDER BY CASE WHEN total_pages > 0 THEN 1 ELSE 2 END, total_pages DESC NULLS LAST, average DESC NULLS LAST, last_execution DESC NULLS LAST, source_order) AS r FROM spc WHERE total_pages > 0 OR (total_pages IS NULL AND average > 0)) SELECT source_order, k.r AS rank FROM spc LEFT JOIN k USING (source_order)"),
    Query("spill_combine", lambda v: P.spill_rank(_spills(v).where("source_order % 2 = 0").unionByName(_spills(v).where("source_order % 2 = 1"))).where("rank is not null").select("source_order", "rank"), f"WITH {_AVG}, k AS (SELECT source_order, row_number() OVER (ORDER BY CASE WHEN total_pages > 0 THEN 1 ELSE 2 END, total_pages DESC NULLS LAST, average DESC NULLS LAST, last_execution DESC NULLS LAST, source_order) AS rank FROM spc WHERE total_pages > 0 OR (total_pages IS NULL AND average > 0)) SELECT * FROM k"),
    Query("highest_per_execution", lambda v: P.highest_per_execution(_spills(v)).select("source_order", F.round("average", 4).alias("average")), f"WITH {_AVG} SELECT source_order, round(average, 4) AS average FROM spc WHERE average > 0 ORDER BY average DESC, source_order LIMIT 1"),
    Query("spill_import_summary", lambda v: P.spill_import_summary(_imported(v)), f"""WITH {_IMPORT} SELECT count(*) AS n_rows, count(*) FILTER (WHERE total_pages > 0 OR (total_pages IS NULL AND average > 0)) AS rankable, count(*) FILTER (WHERE total_state = 'missing' AND avg_state = 'missing') AS missing_metrics, count(*) FILTER (WHERE total_state = 'invalid') AS invalid, count(*) FILTER (WHERE k % 3 = 1 AND total_pages IS NOT NULL) AS converted, count(*) FILTER (WHERE clash) AS conflicting,
 count(*) FILTER (WHERE average_state = 'derived') AS derived, count(*) FILTER (WHERE total_state IN ('missing', 'invalid') AND avg_state = 'missing' AND warnings IS NOT NULL) AS warning_only, count(*) FILTER (WHERE bad_time) AS bad_times, count(*) FILTER (WHERE plan_handle IS NULL AND sql_handle IS NULL AND query_hash IS NULL) AS incomplete_identity, count(*) FILTER (WHERE sql_handle IS NOT NULL AND query_hash IS NULL) AS batch_only_handles,
 count(*) FILTER (WHERE total_pages > 0 AND avg_pages > 0 AND executions > 0 AND abs(total_pages - avg_pages * executions) > 0.01 * total_pages) AS inconsistent_totals FROM ic"""),
    Query("topn_disclosure", lambda v: P.topn_disclosure(v.spills, "query_hash"), "SELECT query_hash, count(*) AS n, count(*) = 10 AS probable_top_n FROM spills GROUP BY query_hash"),
    Query("plan_inventory", lambda v: J.plan_inventory(v.plan_stmts.withColumn("version", F.concat(F.lit("1."), F.expr("cast(substr(plan_id, 6) as int) % 7")))), "SELECT plan_id, CASE WHEN bool_or(actual) THEN 'actual' ELSE 'estimated' END AS kind, concat('1.', CAST(substr(plan_id, 6) AS INTEGER) % 7) AS version, count(*) AS statements, array_to_string(list(statement_text ORDER BY statement_id)[1:4], '; ') AS texts FROM plan_stmts GROUP BY plan_id"),
    Query("grant_pressure", lambda v: J.grant_pressure(_grants(v), "database_id"), "SELECT database_id, count(*) FILTER (WHERE granted_mb > 0 AND statement_id % 3 = 0) AS pending, max(CASE WHEN granted_mb > 0 AND statement_id % 7 = 0 THEN statement_id % 5000 END) AS longest_wait_ms, count(*) FILTER (WHERE granted_mb > 0) AS requests, CASE WHEN count(*) FILTER (WHERE granted_mb > 0 AND statement_id % 3 = 0) > 0 THEN 'grant-pending' END AS signal FROM plan_stmts GROUP BY database_id"),
    Query("single_use_plans", lambda v: J.single_use_plans(v.spills.select(F.col("database_id").cast("string").alias("source"), F.col("executions").alias("use_count")), "source").unionByName(J.single_use_plans(v.samples.select("source_id", F.col("sample_order").alias("total_plans"), (F.col("sample_order") * 0.95).alias("single_use")).withColumnRenamed("source_id", "source"), "source")),
          "SELECT CAST(database_id AS VARCHAR) AS source, count(*) AS plans, count(*) FILTER (WHERE executions <= 1) AS single, count(*) >= 1000 AND count(*) FILTER (WHERE executions <= 1) >= 0.9 * count(*) AS unstable FROM spills GROUP BY 1 UNION ALL SELECT source_id, max(sample_order), CAST(floor(max(sample_order * 0.95)) AS BIGINT), max(sample_order) >= 1000 AND floor(max(sample_order * 0.95)) >= 0.9 * max(sample_order) FROM samples GROUP BY 1"),
    Query("kpi_summary", lambda v: J.kpi_summary(acts(v), found(v), v.plan_stmts, I.present_columns(v.inputs), _missing(v)), rf"""{ALL} SELECT * FROM (SELECT count(*) AS activity_rows, count(DISTINCT capture_s) AS capture_points, CAST(max(capture_s) - min(capture_s) AS BIGINT) AS capture_span, count(DISTINCT source_id) AS sources FROM acts) a, (SELECT arg_max(severity, {_SEV}) AS highest, count(*) FILTER (WHERE severity IN ('Critical', 'High')) AS urgent, count(*) AS findings FROM findings) f, (SELECT count(DISTINCT plan_id) AS plans, count(*) AS statements FROM plan_stmts) p,
 (SELECT count(*) AS columns_present FROM (VALUES {_KNOWN}) t(name) WHERE lower(name) IN (SELECT {_NORM} FROM inputs)) c, (SELECT count(DISTINCT rule_id) AS rules_not_run FROM ({_MISSING}) mr) n"""),
    Query("canonical_headers", lambda v: I.canonical_headers(v.inputs), f"WITH n AS (SELECT *, trim(header) AS h, {_NORM} AS k FROM inputs), c AS (SELECT input_id, event_id, line_no, coalesce(kc.name, regexp_replace(regexp_replace(h, '^\\[|\\]$', '', 'g'), '\\s+', ' ', 'g')) AS base FROM n LEFT JOIN (SELECT name, lower(name) AS l FROM (VALUES {_KNOWN}) t(name)) kc ON kc.l = n.k), r AS (SELECT *, row_number() OVER (PARTITION BY input_id, line_no ORDER BY event_id) AS pos, row_number() OVER (PARTITION BY input_id, line_no, base ORDER BY event_id) AS nth FROM c) SELECT input_id, line_no, CAST(pos AS INTEGER) AS position, CASE WHEN nth = 1 THEN base ELSE concat(base, '__', CAST(pos AS VARCHAR)) END AS name FROM r"),
    Query("locate_header", lambda v: I.locate_header(v.inputs), f"WITH s AS (SELECT input_id, line_no, count(DISTINCT kc.name) AS score FROM (SELECT *, {_NORM} AS k FROM inputs) n JOIN (SELECT name, lower(name) AS l FROM (VALUES {_KNOWN}) t(name)) kc ON kc.l = n.k WHERE line_no < 20 GROUP BY ALL HAVING count(DISTINCT kc.name) >= 2) SELECT input_id, line_no, score FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY score DESC, line_no) AS n FROM s) z WHERE n = 1"),
    Query("schema_profile", lambda v: I.schema_profile(v.inputs), f"WITH n AS (SELECT input_id, {_NORM} AS k FROM inputs), j AS (SELECT input_id, k, kc.name FROM n LEFT JOIN (SELECT name, lower(name) AS l FROM (VALUES {_KNOWN}) t(name)) kc ON kc.l = n.k) SELECT input_id, string_agg(DISTINCT name, ',' ORDER BY name) AS recognised, string_agg(DISTINCT CASE WHEN name IS NULL THEN k END, ',' ORDER BY CASE WHEN name IS NULL THEN k END) AS unknown, count(DISTINCT name) < 5 AS few FROM j GROUP BY input_id"),
    Query("present_columns", lambda v: I.present_columns(v.inputs), f"SELECT DISTINCT kc.name FROM (SELECT {_NORM} AS k FROM inputs) n JOIN (SELECT name, lower(name) AS l FROM (VALUES {_KNOWN}) t(name)) kc ON kc.l = n.k"),
    Query("missing_columns", lambda v: I.missing_columns(v.inputs), f"SELECT name FROM (VALUES {_KNOWN}) t(name) WHERE lower(name) NOT IN (SELECT {_NORM} FROM inputs)"),
    Query("unknown_columns", lambda v: I.unknown_columns(v.inputs), f"SELECT DISTINCT {_NORM} AS name FROM inputs WHERE {_NORM} NOT IN (SELECT lower(name) FROM (VALUES {_KNOWN}) t(name))"),
    Query("evidence_gaps", lambda v: I.evidence_gaps(v.inputs), f"WITH w(family, name) AS (VALUES {_FAMILIES}), p AS (SELECT DISTINCT {_NORM} AS k FROM inputs), m AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE list_contains(string_split(lower(name), ' or '), k))) SELECT family, string_agg(name, ', ' ORDER BY name) AS missing FROM m GROUP BY family"),
    Query("data_quality", lambda v: I.data_quality(v.inputs, acts(v), _missing(v)), rf"""WITH k AS (SELECT DISTINCT {_NORM} AS k FROM inputs), t AS (SELECT name FROM (VALUES {_KNOWN}) t(name)) SELECT (SELECT count(*) FROM t WHERE lower(name) IN (SELECT k FROM k)) AS present, (SELECT count(*) FROM t WHERE lower(name) NOT IN (SELECT k FROM k)) AS missing, (SELECT count(*) FROM k WHERE k NOT IN (SELECT lower(name) FROM t)) AS unknown, (SELECT count(*) FROM acts WHERE wait_info IS NOT NULL AND wait_type IS NULL) AS unparsed_waits,
 (SELECT concat_ws(' | ', (SELECT CASE WHEN count(*) > 0 THEN concat(count(*), ' wait_info observations could not be parsed.') END FROM acts WHERE wait_info IS NOT NULL AND wait_type IS NULL), CASE WHEN 'tempdb_current' IN (SELECT k FROM k) OR 'tempdb_allocations' IN (SELECT k FROM k) THEN 'TempDB pages show request-level consumption only.' END)) AS warnings, coalesce((SELECT string_agg(DISTINCT rule_id, ', ' ORDER BY rule_id) FROM ({_MISSING}) mr), '') AS not_run"""),
    Query("import_preview", lambda v: I.import_preview(v.inputs, acts(v).withColumn("input_id", F.concat(F.lit("file-"), F.col("session_id") % 6))), f"SELECT input_id, n_headers, recognised, first_s, last_s FROM (SELECT input_id, count(*) AS n_headers, count(DISTINCT kc.name) AS recognised FROM (SELECT *, {_NORM} AS k FROM inputs) n LEFT JOIN (SELECT name, lower(name) AS l FROM (VALUES {_KNOWN}) t(name)) kc ON kc.l = n.k GROUP BY input_id) i LEFT JOIN (SELECT concat('file-', CAST(session_id % 6 AS VARCHAR)) AS input_id, min(capture_s) AS first_s, max(capture_s) AS last_s FROM acts GROUP BY 1) a USING (input_id)"),
]
