"""Views that give the tables at hand the shape of activity captures, plans, counters and evidence.

The text of each view runs on Spark and, with other type names, on DuckDB, so that a query can be held against SQL over
the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_STR = {"spark": "STRING", "duckdb": "VARCHAR"}
_BASES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    "activity": """
SELECT event_id AS row_number, concat('src-', user_id % 2) AS source_id, user_id AS session_id,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 2 END AS request_id,
  CASE WHEN event_id % 211 = 0 THEN NULL ELSE 15 * (day(ts) - 1) END AS capture_s,
  CASE WHEN user_id % 29 = 0 THEN NULL ELSE -((user_id * 37) % 1200) END AS start_s,
  -2000 - user_id % 500 AS login_s,
  CASE WHEN user_id % 29 = 0 OR event_id % 211 = 0 THEN NULL ELSE CAST(15 * (day(ts) - 1) + (user_id * 37) % 1200 AS DOUBLE) END AS duration_seconds,
  CASE WHEN event_id % 101 = 0 THEN -(2 + event_id % 4) WHEN event_id % 97 = 0 THEN user_id * 2
       WHEN event_id % 103 = 0 THEN user_id
       WHEN event_type IN ('error', 'click') AND user_id >= 4 THEN CAST(floor(user_id / 4.0) AS BIGINT) * 2 + user_id % 2
       ELSE NULL END AS blocking_session_id,
  CASE WHEN event_id % 37 = 0 THEN 3 ELSE NULL END AS blocked_session_count,
  CASE WHEN event_id % 89 = 0 THEN '(oops'
       WHEN event_id % 53 = 0 THEN concat('THREADPOOL waittime=', CAST(user_id % 900 + 100 AS $STR))
       WHEN event_id % 59 = 0 THEN '(2x: 15ms/1,040ms)RESOURCE_SEMAPHORE_QUERY_COMPILE'
       WHEN event_id % 61 = 0 THEN '(12ms)SOS_SCHEDULER_YIELD'
       WHEN event_type = 'error' THEN concat('(', CAST(CAST(floor(value * 10) AS BIGINT) AS $STR), 'ms)LCK_M_X')
       WHEN event_type = 'click' THEN concat('PAGEIOLATCH_SH waittime=', CAST(CAST(floor(value) AS BIGINT) AS $STR))
       WHEN event_type = 'signup' THEN '(3x: 10ms/20ms/30ms)CXPACKET:node 2' WHEN event_type = 'view' THEN 'WAITFOR' ELSE NULL END AS wait_info,
  CASE WHEN event_id % 83 = 0 THEN 0 ELSE CAST(15 * (day(ts) - 1) * (1 + user_id % 5) * 100 AS DOUBLE) END AS cpu,
  CAST(floor(value * 10) AS DOUBLE) AS reads, CAST(floor(value) AS BIGINT) % 97 AS writes, (event_id * 7) % 1000 AS used_memory, event_id % 50 AS tempdb_current,
  CASE event_type WHEN 'error' THEN 'suspended' WHEN 'click' THEN 'running' WHEN 'view' THEN 'sleeping' ELSE 'runnable' END AS status,
  CASE WHEN event_id % 10 < 3 THEN 1 WHEN event_type = 'purchase' THEN 2 ELSE 0 END AS open_tran_count,
  CASE WHEN event_id % 10 < 3 THEN -(user_id % 400) ELSE NULL END AS tran_start_s, event_id % 47 = 0 AS implicit_tran,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE concat('SELECT *  FROM t WHERE id = ', CAST(user_id % 50 AS $STR), ' AND name = ''n', CAST(event_id % 9 AS $STR), ''' AND j = ', props) END AS sql_text,
  CASE WHEN event_id % 3 = 0 THEN concat('EXEC dbo.job_', CAST(user_id % 11 AS $STR)) ELSE NULL END AS sql_command,
  concat('db', CAST(user_id % 4 AS $STR)) AS database_name, concat('login', CAST(user_id % 13 AS $STR)) AS login_name
FROM events""",
    "cells": """
SELECT event_id AS id, CASE CAST(event_id % 26 AS INTEGER)
  WHEN 0 THEN concat(' ', CAST(event_id AS $STR), ' ') WHEN 1 THEN 'null' WHEN 2 THEN '  ' WHEN 3 THEN concat('1,', CAST(100 + event_id % 900 AS $STR), '.5')
  WHEN 4 THEN concat(CAST(event_id % 70 AS $STR), ' KB') WHEN 5 THEN concat(CAST(event_id % 9 AS $STR), '.25 GiB') WHEN 6 THEN concat('about -', CAST(event_id % 50 + 1 AS $STR), 'e2 units')
  WHEN 7 THEN concat(CAST(event_id % 5 AS $STR), ' 0', CAST(event_id % 10 AS $STR), ':15:30.25 x') WHEN 8 THEN '12:34:56' WHEN 9 THEN substr(CAST(ts AS $STR), 1, 19)
  WHEN 10 THEN concat('0xAB', CAST(event_id AS $STR)) WHEN 11 THEN concat('[my ]]tab ', CAST(event_id % 7 AS $STR), ']') WHEN 12 THEN 'YES' WHEN 13 THEN 'n'
  WHEN 14 THEN 'granted' WHEN 15 THEN '=SUM(A1)' WHEN 16 THEN concat('[ Session  ID', CAST(event_id % 3 AS $STR), ']') WHEN 17 THEN concat('AvgSpills # 8KB pages', CAST(event_id % 3 AS $STR))
  WHEN 18 THEN 'CPU Time %/sec' WHEN 19 THEN concat('(1x: ', CAST(event_id % 99 AS $STR), 'ms/7 ms)LCK_M_S: key 7') WHEN 20 THEN concat('LATCH_EX waittime = 1,', CAST(100 + event_id % 900 AS $STR))
  WHEN 21 THEN 'N/A' WHEN 22 THEN '(broken' WHEN 23 THEN concat('select N''it''''s'', ', CAST(event_id AS $STR), '.5 from t', CAST(event_id % 8 AS $STR), '  where a=1')
  WHEN 24 THEN concat(CAST(event_id % 40 AS $STR), ' min 5 s') ELSE concat('Opt.Level:', CAST(event_id % 5 AS $STR)) END AS raw,
  event_type, value, user_id, CAST(event_id % 1000 AS DOUBLE) * CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN 0.001 WHEN 1 THEN 1.37 WHEN 2 THEN 977.5 ELSE 54321.25 END AS num
FROM events""",
    "plan_ops": """
SELECT l_orderkey AS statement_id, l_linenumber AS node_id,
  CASE WHEN l_linestatus = 'O' THEN 'Sort' WHEN l_returnflag = 'N' THEN 'Index Scan' ELSE 'Hash Match' END AS physical_op,
  l_quantity * 10 AS estimated_rows, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(floor(l_extendedprice) AS DOUBLE) END AS actual_rows,
  l_returnflag = 'R' AS spilled, l_partkey % 17 = 0 AS converted, l_partkey % 19 = 0 AS residual, l_suppkey % 23 = 0 AS scalar_udf, l_partkey % 40 AS object_no
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS dup FROM lineitem) z WHERE dup = 1""",
    "plan_stmts": """
SELECT o_orderkey AS statement_id, concat('plan-', CAST(o_custkey % 400 AS $STR)) AS plan_id, o_orderkey % 5 <> 0 AS actual, CAST(floor(o_totalprice) AS DOUBLE) / 1000 AS cost,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 100 AS DOUBLE) ELSE NULL END AS missing_index_impact,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 1500 AS DOUBLE) ELSE NULL END AS granted_mb, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 1500 AS DOUBLE) / (1 + o_orderkey % 12) ELSE NULL END AS used_mb,
  CASE WHEN o_orderkey % 4 = 0 THEN 'EstimatedDOPIsOne' WHEN o_orderkey % 7 = 0 THEN 'TSQLUserDefinedFunctionsNotParallelizable' ELSE NULL END AS nonparallel_reason, CASE WHEN o_custkey % 6 = 0 THEN 4 ELSE 1 END AS dop,
  concat('h', CAST(o_orderkey AS $STR)) AS plan_handle, concat('q', CAST(o_custkey AS $STR)) AS query_hash, concat('p', CAST(o_custkey % 50 AS $STR)) AS plan_hash,
  CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 977 ELSE NULL END AS qs_query_id, o_custkey % 5 AS database_id, concat('SELECT ', CAST(o_orderkey % 20 AS $STR), ' FROM sales') AS statement_text
FROM orders""",
    "spills": """
SELECT o_orderkey AS source_order, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 40 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS DOUBLE) END AS total_pages,
  CASE WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice / 8) AS DOUBLE) ELSE NULL END AS avg_pages, o_custkey % 7 AS executions, o_orderdate AS last_execution,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE concat('h', CAST(o_orderkey AS $STR)) END AS plan_handle, concat('q', CAST(o_custkey AS $STR)) AS query_hash, o_custkey % 5 AS database_id,
  CASE WHEN o_orderkey % 8 = 0 THEN 'Sort spill; Memory grant|Implicit conversion' WHEN o_orderkey % 3 = 0 THEN 'Spill' ELSE NULL END AS warnings
FROM orders""",
    "samples": """
SELECT event_id AS sample_order, concat('ctr-', CAST(user_id % 5 AS $STR)) AS source_id, 15 * (day(ts) - 1) AS capture_s, event_type AS counter_name,
  CASE WHEN event_id % 43 = 0 THEN NULL WHEN user_id % 5 = 0 THEN value + event_id ELSE value END AS value, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 60 END AS sample_id, user_id % 3 AS runnable_tasks,
  user_id % 30 AS active_workers, 25 AS max_workers, CASE WHEN user_id % 11 = 0 THEN 1 ELSE 0 END AS work_queue, value AS batches, value * (user_id % 4) / 10 AS compilations, user_id % 3 AS compile_waiters,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN user_id % 5 = 0 THEN 90 - event_id / 1000000.0 ELSE 80 + event_id / 1000000.0 END AS cache_hit_ratio
FROM events""",
    "locks": """
SELECT event_id AS id, user_id AS session_id, CASE WHEN event_type IN ('view', 'signup') THEN 'GRANT' ELSE 'WAIT' END AS request_status,
  CASE WHEN event_id % 5 = 0 THEN 'KEY' WHEN event_id % 5 = 1 THEN 'OBJECT' ELSE 'PAGE' END AS resource_type, user_id % 3 AS database_id,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id % 10 END AS entity_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('(', CAST(event_id % 20 AS $STR), ')') END AS description
FROM events""",
    "ident": """
SELECT o_orderkey AS id, o_orderkey % 2 AS side, CASE WHEN o_orderkey % 6 < 2 THEN o_custkey END AS qs_query_id, CASE WHEN o_orderkey % 6 < 2 THEN o_orderkey % 5 END AS qs_plan_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey % 4 END AS database_id,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('0xH', CAST(o_custkey * 3 AS $STR)) WHEN o_orderkey % 4 = 1 THEN concat('h', CAST(o_custkey * 3 AS $STR)) END AS plan_handle,
  CASE WHEN o_orderkey % 5 < 3 THEN concat('s', CAST(o_custkey AS $STR)) END AS sql_handle, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 * 0 + 4 WHEN o_orderkey % 3 = 1 THEN 8 END AS start_offset, CASE WHEN o_orderkey % 3 < 2 THEN 40 END AS end_offset,
  concat('q', CAST(o_custkey AS $STR)) AS query_hash, CASE WHEN o_orderkey % 7 < 4 THEN concat('p', CAST(o_custkey % 20 AS $STR)) END AS plan_hash, o_custkey AS session_id, CASE WHEN o_orderkey % 8 < 5 THEN 0 END AS request_id, CASE WHEN o_orderkey % 10 < 6 THEN 77 END AS transaction_id
FROM orders""",
    "inputs": """
SELECT concat('file-', CAST(user_id % 6 AS $STR)) AS input_id, event_id, CASE CAST(event_id % 12 AS INTEGER) WHEN 0 THEN '[Session_ID]' WHEN 1 THEN 'wait_info' WHEN 2 THEN 'CPU' WHEN 3 THEN 'cpu'
  WHEN 4 THEN 'collection_time' WHEN 5 THEN '%cpu' WHEN 6 THEN ' status ' WHEN 7 THEN 'node_id' WHEN 8 THEN 'blocking_session_id' WHEN 9 THEN 'open_tran_count' WHEN 10 THEN 'sql_text_full' ELSE event_type END AS header,
  CAST(floor(event_id / 12) AS BIGINT) % 30 AS line_no
FROM events""",
}


def duck_wait(rows: str, text: str) -> str:
    """DuckDB: rows with their wait text read: t, fine, kind, d (durations), tasks, detail and none (the text says that there
    is no wait). Written from the two forms of a wait text, apart from functions.scalars.parse_wait."""
    trimmed = f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"
    whole = lambda x: f"CASE WHEN regexp_full_match({x}, '[0-9]+') OR regexp_full_match({x}, '[0-9]{{1,3}}(,[0-9]{{3}})+') THEN CAST(replace({x}, ',', '') AS BIGINT) END"
    return rf"""SELECT * EXCLUDE (par, inside, rest, tail), t IS NULL OR upper(t) IN ('NONE', 'N/A') AS none, CASE WHEN par THEN nullif(trim(substr(tail, 2)), '') ELSE nullif(rtrim(tail), '') END AS detail,
 CASE WHEN par THEN coalesce(count, 1) END AS tasks, coalesce(NOT t IS NULL AND upper(t) NOT IN ('NONE', 'N/A') AND kind <> '' AND upper(kind) NOT IN ('ON', 'OFF', 'TRUE', 'FALSE', 'NULL', 'NONE') AND CASE WHEN par THEN
 (len(inside) = 1 OR len(inside) = 2 AND count >= 1) AND len(d) <= 3 AND len(list_filter(d, lambda x: x IS NULL)) = 0 AND (tail = '' OR starts_with(tail, ':')) ELSE regexp_full_match(kind, '[A-Za-z][A-Za-z0-9_]*') END, false) AS fine
FROM (SELECT *, ltrim(substr(rest, length(kind) + 1)) AS tail, CASE WHEN len(inside) = 2 AND lower(trim(inside[1])) LIKE '%x' THEN {whole("left(trim(inside[1]), -1)")} END AS count,
 CASE WHEN par THEN list_transform(list_transform(string_split(inside[-1], '/'), lambda x: trim(x)), lambda x: CASE WHEN lower(x) LIKE '%ms' THEN {whole("rtrim(left(x, -2))")} END)
  ELSE list_filter(list_transform(list_filter(string_split_regex(regexp_replace(rest, '\s*=\s*', '=', 'g'), '\s+'), lambda x: starts_with(lower(x), 'waittime='))[1:1], lambda x: {whole("substr(x, 10)")}), lambda x: x IS NOT NULL) END AS d
FROM (SELECT *, regexp_extract(rest, '^[^:\s]+') AS kind FROM (SELECT *, CASE WHEN par AND strpos(t, ')') > 0 THEN string_split(substr(t, 2, strpos(t, ')') - 2), ':') END AS inside, CASE WHEN NOT par THEN t WHEN strpos(t, ')') > 0 THEN ltrim(substr(t, strpos(t, ')') + 1)) END AS rest
FROM (SELECT *, coalesce(starts_with(t, '('), false) AS par FROM (SELECT *, CASE WHEN {trimmed} <> '' AND upper({trimmed}) <> 'NULL' THEN {trimmed} END AS t FROM {rows}) w1) w2) w3) w4) w5"""


#: For DuckDB alone: activity with its wait parsed and its keys, as operators.activity.observed gives it.
ORACLE_VIEWS = {
    "acts": f"""
SELECT * EXCLUDE (t, kind, d, tasks, count, detail, none, fine), CASE WHEN fine THEN kind END AS wait_type, CASE WHEN fine THEN list_max(d) END AS wait_ms,
  concat(coalesce(CAST(session_id AS VARCHAR), '?'), ':', CAST(coalesce(request_id, 0) AS VARCHAR), ':', coalesce(CAST(coalesce(start_s, login_s) AS VARCHAR), '?')) AS episode
FROM ({duck_wait("activity", "wait_info")}) waits""",
}


def sql(name: str, engine: str) -> str:
    return (VIEWS | ORACLE_VIEWS)[name].replace("$STR", _STR[engine]).strip()


def with_views(query: str) -> str:
    """A DuckDB query with the views that it names in front."""
    named = lambda text: [v for v in VIEWS if re.search(rf"\b{v}\b", text)]
    later = [v for v in ORACLE_VIEWS if re.search(rf"\b{v}\b", query)]
    used = list(dict.fromkeys(named(query) + [x for v in later for x in named(ORACLE_VIEWS[v])])) + later
    head = ", ".join(f"{v} AS ({sql(v, 'duckdb')})" for v in used)
    text = query.strip()
    if not head:
        return text
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {text[len('WITH RECURSIVE'):].strip()}"
    return f"WITH {head}, {text[4:].strip()}" if text.upper().startswith("WITH ") else f"WITH {head} {text}"


class Views:
    """The views over the tables of a folder, each read when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, placed: dict[str, str] | None = None):
        self.spark, self.dir, self.placed = spark, sf_dir, placed or {}

    def by(self, table: str, key: str) -> Views:
        """The same views, with the rows of a table brought together by a key."""
        return Views(self.spark, self.dir, self.placed | {table: key})

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return df.repartition(self.placed[name]) if name in self.placed else df

    def __getattr__(self, name: str) -> DataFrame:
        if name in _BASES:
            return self.table(name)
        if name not in VIEWS:
            raise AttributeError(name)
        text = sql(name, "spark")
        base = next(b for b in _BASES if re.search(rf"FROM {b}\b", text))
        return self.spark.sql(re.sub(rf"FROM {base}\b", "FROM {" + base + "}", text), **{base: self.table(base)})
