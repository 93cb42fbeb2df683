"""Queries of the scalar functions, each over a column of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadlens.catalog.base import Query
from loadlens.functions import scalars as S
from loadlens.sources.views import duck_wait

_TRIM = r"regexp_replace(raw, '^\s+|\s+$', '', 'g')"
_T = rf"CASE WHEN {_TRIM} = '' OR upper({_TRIM}) = 'NULL' THEN NULL ELSE {_TRIM} END"
_BASE = f"WITH t AS (SELECT *, {_T} AS t FROM cells)"
_NUM = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
# DuckDB: what is left of a number's unit, and the number before it.
_UNIT = "upper(regexp_extract(replace(t, ',', ''), '[A-Za-z]*$'))"
_BODY = "rtrim(regexp_replace(replace(t, ',', ''), '[A-Za-z]*$', ''))"
_CATEGORY = """CASE WHEN u IS NULL THEN NULL WHEN regexp_matches(u, '^(WAITFOR|LAZYWRITER_SLEEP|SLEEP_TASK|BROKER_|XE_TIMER_EVENT|ONDEMAND_TASK_QUEUE)') THEN 'Benign / queue'
 WHEN u LIKE 'LCK\\_%' ESCAPE '\\' THEN 'Locking' WHEN u LIKE 'PAGEIOLATCH\\_%' ESCAPE '\\' OR u IN ('IO_COMPLETION', 'ASYNC_IO_COMPLETION') THEN 'Storage I/O' WHEN u = 'WRITELOG' THEN 'Transaction log'
 WHEN u = 'RESOURCE_SEMAPHORE_QUERY_COMPILE' THEN 'Compilation' WHEN starts_with(u, 'RESOURCE_SEMAPHORE') THEN 'Memory grant' WHEN u = 'THREADPOOL' THEN 'Worker threads'
 WHEN u = 'ASYNC_NETWORK_IO' THEN 'Network / client' WHEN starts_with(u, 'PAGELATCH_') OR starts_with(u, 'LATCH_') THEN 'Latch / tempdb' WHEN u IN ('CXPACKET', 'CXCONSUMER', 'CXSYNC_PORT', 'CXSYNC_CONSUMER') THEN 'Parallelism'
 WHEN starts_with(u, 'PREEMPTIVE_') OR u IN ('OLEDB', 'CLR_AUTO_EVENT') THEN 'External' ELSE 'Other' END"""
_WAIT_SQL = "WITH p AS (SELECT *, upper(kind) AS u FROM (" + duck_wait("cells", "raw") + ") waits)"
_SNAKE = "regexp_replace(regexp_replace({}, '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')"
_WS = r"trim(regexp_replace(coalesce(sql_text, ''), '\s+', ' ', 'g'))"


def _cell(name: str, f, expression: str, base: str = _BASE, out: str = "out") -> Query:
    """f(raw) over cells, against a DuckDB expression over t, the trimmed cell."""
    return Query(name, lambda v: v.cells.select("id", f(F.col("raw")).alias(out)), f"{base} SELECT id, {expression} AS {out} FROM t")


def _rounded(f):
    return lambda c: F.round(f(c), 6)


def _trimmed(x: str, places: int) -> str:
    """DuckDB: grouped digits without zeros at the end of the decimals."""
    return rf"regexp_replace(regexp_replace(format('{{:,.{places}f}}', {x}), '(\.\d*?)0+$', '\1'), '\.$', '')"


_FMT_NUM = f"CASE WHEN num IS NULL THEN '—' WHEN abs(num) >= 1000000 THEN concat({_trimmed('num / 1e6', 1)}, 'M') ELSE {_trimmed('num', 1)} END"
_HALF_UP = "CAST(floor({} + 0.5) AS BIGINT)"


def _original(v):
    """A raw row as a map, with a delta on some rows and a cumulative counter on others."""
    return v.cells.select("id", F.create_map(F.lit("Cpu-Delta"), F.when(F.col("id") % 3 == 0, F.col("raw")), F.lit("CPU"), F.col("num").cast("string")).alias("m"), (F.col("id") % 2).alias("k"))


def _metrics(v):
    """Cells of spill exports: those of the view, and words for a missing value, amounts and units."""
    n = F.col("id").cast("string")
    return v.cells.select("id", F.when(F.col("id") % 17 == 0, "Not supplied").when(F.col("id") % 17 == 1, F.concat(n, F.lit(" 8 KB pages"))).when(F.col("id") % 17 == 2, F.concat(n, F.lit(" KiB"))).when(F.col("id") % 17 == 3, F.concat(n, F.lit(" msec"))).when(F.col("id") % 17 == 4, F.lit("none")).when(F.col("id") % 17 == 5, F.concat(F.lit("-"), n)).otherwise(F.col("raw")).alias("raw"))


_SPILL_BASE = r"""WITH r AS (SELECT id, CASE CAST(id % 17 AS INTEGER) WHEN 0 THEN 'Not supplied' WHEN 1 THEN concat(id, ' 8 KB pages') WHEN 2 THEN concat(id, ' KiB') WHEN 3 THEN concat(id, ' msec') WHEN 4 THEN 'none' WHEN 5 THEN concat('-', id) ELSE raw END AS raw FROM cells),
c AS (SELECT id, CASE WHEN trim(raw) = '' OR lower(trim(raw)) IN ('null', 'n/a', 'none', 'not supplied') THEN NULL ELSE replace(trim(raw), ',', '') END AS b FROM r)"""

QUERIES = [
    _cell("as_text", S.as_text, "t"),
    _cell("as_number", _rounded(S.as_number), rf"""round(CASE WHEN regexp_full_match({_BODY}, '{_NUM}') AND regexp_full_match({_UNIT}, '[KMGTPE]?(I?B)?') THEN CAST({_BODY} AS DOUBLE) * pow(1000, CASE WHEN {_UNIT} IN ('', 'B', 'IB') THEN 0 ELSE strpos('KMGTPE', left({_UNIT}, 1)) END)
 ELSE TRY_CAST(nullif(regexp_extract(replace(t, ',', ''), '-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?'), '') AS DOUBLE) END, 6)"""),
    _cell("as_timestamp", lambda c: F.unix_micros(S.as_timestamp(c)), r"epoch_us(TRY_CAST(CASE WHEN regexp_matches(t, '^\d{4}-\d{2}-\d{2}') THEN t END AS TIMESTAMP))"),
    Query("excel_timestamp", lambda v: v.cells.select("id", F.unix_micros(S.excel_timestamp(F.col("num"))).alias("out")), "SELECT id, CASE WHEN num BETWEEN 1 AND 100000 THEN CAST(round((num - 25569) * 86400000) AS BIGINT) * 1000 END AS out FROM cells"),
    _cell("duration_seconds", _rounded(S.duration_seconds), r"""(SELECT CASE WHEN regexp_full_match(c[1], '[0-9]{1,2}') AND regexp_full_match(c[2], '[0-9]{2}') AND regexp_matches(c[3], '^[0-9]{2}') THEN round(days * 86400 + CAST(c[1] AS DOUBLE) * 3600 + CAST(c[2] AS DOUBLE) * 60 + CAST(left(c[3], 2) AS DOUBLE) + coalesce(TRY_CAST('0' || nullif(regexp_extract(substr(c[3], 3), '^\.[0-9]{1,3}'), '') AS DOUBLE), 0), 6) END
 FROM (SELECT CASE WHEN regexp_full_match(x[1], '[0-9]+') THEN CAST(x[1] AS DOUBLE) ELSE 0 END AS days, string_split(CASE WHEN regexp_full_match(x[1], '[0-9]+') THEN x[2] ELSE x[1] END, ':') AS c FROM (SELECT string_split_regex(t, '\s+') AS x) y) z)"""),
    Query("difference_seconds", lambda v: v.activity.select("row_number", S.difference_seconds(F.timestamp_seconds("start_s"), F.timestamp_seconds("capture_s")).alias("forward"), S.difference_seconds(F.timestamp_seconds("capture_s"), F.timestamp_seconds("start_s")).alias("back")),
          "SELECT row_number, CASE WHEN capture_s >= start_s THEN CAST(capture_s - start_s AS DOUBLE) END AS forward, CASE WHEN start_s >= capture_s THEN CAST(start_s - capture_s AS DOUBLE) END AS back FROM activity"),
    Query("parse_wait", lambda v: v.cells.unionByName(v.activity.select(F.col("row_number").alias("id"), F.col("wait_info").alias("raw")), allowMissingColumns=True).withColumn("w", S.parse_wait(F.col("raw"))).select("id", "w.duration_ms", F.when(F.col("w").isNotNull(), F.coalesce(F.size("w.durations"), F.lit(0))).alias("n_durations"), "w.task_count", "w.type", "w.detail", "w.category"),
          "WITH p AS (SELECT *, upper(kind) AS u FROM (" + duck_wait("(SELECT id, raw FROM cells UNION ALL SELECT row_number, wait_info FROM activity)", "raw") + f") waits) SELECT id, CASE WHEN fine THEN list_max(d) END AS duration_ms, CASE WHEN fine THEN CAST(len(d) AS INTEGER) END AS n_durations, CASE WHEN fine THEN tasks END AS task_count, CASE WHEN fine THEN kind END AS type, CASE WHEN fine THEN detail END AS detail, CASE WHEN fine THEN {_CATEGORY} END AS category FROM p"),
    Query("wait_category", lambda v: v.cells.select("id", S.wait_category(F.regexp_replace("raw", "^[^A-Za-z]+", "")).alias("out")), f"SELECT id, {_CATEGORY} AS out FROM (SELECT id, upper(regexp_replace(raw, '^[^A-Za-z]+', '')) AS u FROM cells)"),
    Query("wait_parse_warning", lambda v: v.cells.select("id", S.wait_parse_warning(F.col("raw")).alias("out")), _WAIT_SQL + " SELECT id, NOT fine AND NOT none AS out FROM p"),
    _cell("statement_shape", S.statement_shape, r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(raw, ''), 'N?''(?:''''|[^''])*''', '?', 'g'), '\b\d+(?:\.\d+)?\b', '?', 'g'), '\s+', ' ', 'g')))"""),
    Query("statement_variant", lambda v: v.activity.select("row_number", S.statement_variant(F.col("sql_text")).alias("out")), f"SELECT row_number, {_WS} AS out FROM activity"),
    Query("command_preview", lambda v: v.activity.select("row_number", S.command_preview(F.concat_ws(" ", "sql_text", "sql_command"), 50).alias("out")),
          r"SELECT row_number, CASE WHEN s IS NULL OR length(s) <= 50 THEN s ELSE concat(rtrim(substr(s, 1, 49)), '…') END AS out FROM (SELECT row_number, nullif(trim(regexp_replace(concat_ws(' ', sql_text, sql_command), '\s+', ' ', 'g')), '') AS s FROM activity)"),
    Query("command_label", lambda v: v.activity.select("row_number", S.command_label(F.col("status"), F.col("sql_text"), F.col("sql_command")).alias("out")),
          "SELECT row_number, CASE WHEN sql_text IS NULL AND sql_command IS NULL THEN NULL WHEN status = 'sleeping' THEN 'Last / outer command' WHEN sql_text IS NOT NULL THEN 'Current statement' ELSE 'Outer command' END AS out FROM activity"),
    Query("format_duration", lambda v: v.cells.select("id", S.format_duration(F.col("num") / 100).alias("out")), f"""SELECT id, CASE WHEN r < 60 AND x < 10 THEN concat(format('{{:.1f}}', x), 's') WHEN r < 60 THEN concat(format('{{:.0f}}', x), 's') WHEN r < 3600 THEN concat(CAST(r // 60 AS VARCHAR), 'm ', CAST(r % 60 AS VARCHAR), 's')
 WHEN r < 86400 THEN concat(CAST(r // 3600 AS VARCHAR), 'h ', CAST({_HALF_UP.format('(r % 3600) / 60')} AS VARCHAR), 'm') ELSE concat(CAST(r // 86400 AS VARCHAR), 'd ', CAST({_HALF_UP.format('(r % 86400) / 3600')} AS VARCHAR), 'h') END AS out FROM (SELECT id, num / 100 AS x, {_HALF_UP.format('num / 100')} AS r FROM cells)"""),
    Query("format_number", lambda v: v.cells.select("id", S.format_number(F.floor("num").cast("double")).alias("out")), f"SELECT id, {_FMT_NUM} AS out FROM (SELECT id, floor(num) AS num FROM cells)"),
    Query("format_tempdb_pages", lambda v: v.cells.select("id", S.format_tempdb_pages((F.col("id") * 64).cast("double")).alias("out")),
          f"SELECT id, concat({_FMT_NUM}, ' pages (', CASE WHEN num * 8 / 1024 >= 1024 THEN concat({_trimmed('num * 8 / 1024 / 1024', 2)}, ' GB') ELSE concat({_trimmed('num * 8 / 1024', 2)}, ' MB') END, ')') AS out FROM (SELECT id, CAST(id * 64 AS DOUBLE) AS num FROM cells)"),
    Query("format_ratio", lambda v: v.cells.select("id", S.format_ratio(F.floor("num") / 512).alias("out")), f"SELECT id, CASE WHEN num > 0 AND num < 0.01 THEN '<0.01×' ELSE concat({_FMT_NUM}, '×') END AS out FROM (SELECT id, floor(num) / 512 AS num FROM cells)"),
    Query("counter_label", lambda v: _original(v).select("id", S.counter_label("CPU", F.col("m"), "Cpu-Delta", "CPU").alias("out")), rf"{_BASE} SELECT id, CASE WHEN id % 3 = 0 AND regexp_matches(replace(t, ',', ''), '\d') THEN 'CPU (reported delta)' ELSE 'CPU (cumulative)' END AS out FROM t"),
    Query("original_number", lambda v: _original(v).select("id", F.round(S.original_number(F.col("m"), ["cpu_delta", "cpu"]), 4).alias("out")), f"SELECT id, round(coalesce(CASE WHEN id % 3 = 0 THEN TRY_CAST(CASE WHEN regexp_matches(replace(trim(raw), ',', ''), '^{_NUM}$') THEN replace(trim(raw), ',', '') END AS DOUBLE) END, num), 4) AS out FROM cells"),
    _cell("handle_norm", S.handle_norm, "nullif(regexp_replace(lower(trim(raw)), '^0x', ''), '')"),
    _cell("evidence_number", _rounded(S.evidence_number), rf"round(CASE WHEN regexp_matches(trim(regexp_replace(replace(raw, ',', ''), '(?i)\s*(kb|mb|gb|ms|s|%)\s*$', '')), '^{_NUM}$') THEN TRY_CAST(trim(regexp_replace(replace(raw, ',', ''), '(?i)\s*(kb|mb|gb|ms|s|%)\s*$', '')) AS DOUBLE) END, 6)"),
    Query("spill_number", lambda v: _metrics(v).withColumn("s", S.spill_number(F.col("raw"))).withColumn("k", S.spill_number(F.col("raw"), "kb")).select("id", F.round("s.value", 6).alias("pages"), "s.state", F.round("k.value", 6).alias("kb_pages"), F.col("k.state").alias("kb_state")),
          f"""{_SPILL_BASE}, n AS (SELECT id, b, regexp_extract(b, '^[+]?[0-9.]+([eE][+-]?[0-9]+)?') AS num FROM c), u AS (SELECT id, b, TRY_CAST(num AS DOUBLE) AS x, lower(replace(substr(b, length(num) + 1), ' ', '')) AS said FROM n),
f AS (SELECT id, b, x, CASE WHEN said = '' THEN NULL WHEN said IN ('page', 'pages', '8k', '8kb', '8kpages', '8kbpages') THEN 'pages' WHEN said IN ('byte', 'bytes') THEN 'bytes' WHEN said IN ('kb', 'kib', 'mb', 'mib', 'gb', 'gib') THEN said ELSE '?' END AS unit FROM u)
SELECT id, CASE WHEN b IS NOT NULL AND x IS NOT NULL AND coalesce(unit, 'pages') = 'pages' THEN round(x, 6) END AS pages, CASE WHEN b IS NULL THEN 'missing' WHEN x IS NULL OR coalesce(unit, 'pages') <> 'pages' THEN 'invalid' WHEN x <= 0 THEN 'zero-or-nonpositive' ELSE 'imported' END AS state,
 CASE WHEN b IS NOT NULL AND x IS NOT NULL AND coalesce(unit, 'kb') = 'kb' THEN round(x / 8, 6) END AS kb_pages, CASE WHEN b IS NULL THEN 'missing' WHEN x IS NULL OR coalesce(unit, 'kb') <> 'kb' THEN 'invalid' WHEN x <= 0 THEN 'zero-or-nonpositive' ELSE 'imported' END AS kb_state FROM f"""),
    Query("spill_duration_ms", lambda v: _metrics(v).select("id", F.round(S.spill_duration_ms(F.col("raw")), 6).alias("out")),
          rf"""{_SPILL_BASE} SELECT id, round(CASE WHEN regexp_full_match(b, '[0-9]+:[0-9]+:[0-9.]+') THEN ((CAST(split_part(b, ':', 1) AS DOUBLE) * 60 + CAST(split_part(b, ':', 2) AS DOUBLE)) * 60 + CAST(split_part(b, ':', 3) AS DOUBLE)) * 1000
 WHEN regexp_full_match(b, '[0-9]+ min 5 s') THEN CAST(split_part(b, ' ', 1) AS DOUBLE) * 60000 + 5000 WHEN regexp_full_match(b, '[0-9]+ msec') THEN CAST(split_part(b, ' ', 1) AS DOUBLE) END, 6) AS out FROM c"""),
    Query("metric_state", lambda v: _metrics(v).select("id", S.metric_state(F.col("raw"), S.evidence_number(F.col("raw"))).alias("out")), rf"""{_SPILL_BASE}, n AS (SELECT id, b, trim(regexp_replace(b, '(?i)\s*(kb|mb|gb|ms|s|%)\s*$', '')) AS x FROM c)
SELECT id, CASE WHEN b IS NULL THEN 'missing' WHEN NOT regexp_full_match(x, '{_NUM}') THEN 'invalid' WHEN CAST(x AS DOUBLE) < 0 THEN 'invalid' WHEN CAST(x AS DOUBLE) = 0 THEN 'zero-or-nonpositive' ELSE 'imported' END AS out FROM n"""),
    Query("spill_gib", lambda v: v.spills.select("source_order", F.round(S.spill_gib(F.col("total_pages")), 8).alias("out")), "SELECT source_order, round(total_pages * 8 / 1024 / 1024, 8) AS out FROM spills"),
    Query("last_execution", lambda v: v.cells.select("id", F.unix_micros(S.last_execution(F.when(F.col("id") % 3 == 0, F.date_format(F.timestamp_seconds(F.col("id") * 7919), "M/d/yyyy h:mm:ss a")).when(F.col("id") % 3 == 1, F.col("raw")).otherwise("not supplied"))).alias("out")),
          rf"{_BASE} SELECT id, CASE WHEN id % 3 = 0 THEN id * 7919 * 1000000 WHEN id % 3 = 1 THEN epoch_us(TRY_CAST(CASE WHEN regexp_matches(t, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN t END AS TIMESTAMP)) END AS out FROM t"),
    Query("flag_value", lambda v: v.cells.select("id", S.flag_value(F.col("raw")).alias("plain"), S.flag_value(F.col("raw"), True).alias("capability")),
          f"{_BASE} SELECT id, CASE WHEN lower(t) IN ('1', 'true', 'y', 'yes') THEN true WHEN lower(t) IN ('0', 'false', 'n', 'no') THEN false END AS plain, CASE WHEN lower(t) IN ('1', 'true', 'y', 'yes', 'on', 'granted') THEN true WHEN lower(t) IN ('0', 'false', 'n', 'no', 'off', 'denied') THEN false END AS capability FROM t"),
    _cell("clean_identifier", S.clean_identifier, "nullif(trim(CASE WHEN t LIKE '[%]' THEN replace(substr(t, 2, length(t) - 2), ']]', ']') ELSE t END), '')"),
    Query("portable_key", lambda v: v.part.select("p_partkey", S.portable_key(F.concat(F.lit(" DB"), F.col("p_partkey") % 3), F.lit("dbo "), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))).alias("out")),
          "SELECT p_partkey, concat_ws('|', concat('db', CAST(p_partkey % 3 AS VARCHAR)), 'dbo', lower(trim(p_brand)), CASE WHEN p_partkey % 2 = 0 THEN lower(trim(p_type)) ELSE '<table>' END) AS out FROM part"),
    Query("server_fingerprint", lambda v: v.nation.select("n_nationkey", S.server_fingerprint(F.col("n_name")).alias("out")), "SELECT n_nationkey, sha256(lower(trim(n_name))) AS out FROM nation"),
    _cell("csv_safe_cell", S.csv_safe_cell, r"CASE WHEN regexp_matches(raw, '^[=+\-@\t\r]') THEN concat('''', raw) ELSE raw END"),
    _cell("optimizer_token", S.optimizer_token, "CASE WHEN regexp_matches(raw, '^[A-Za-z0-9_.:-]{1,128}$') THEN raw ELSE '[redacted]' END"),
    _cell("header_norm_capture", S.header_norm_capture, r"regexp_replace(regexp_replace(trim(raw), '^\[|\]$', '', 'g'), '\s+', ' ', 'g')"),
    _cell("header_norm_counter", S.header_norm_counter, _SNAKE.format("lower(trim(raw))")),
    _cell("header_norm_evidence", S.header_norm_evidence, _SNAKE.format("regexp_replace(lower(trim(raw)), '[%/]+', ' ', 'g')")),
    Query("header_norm_spill", lambda v: v.cells.select("id", S.header_norm_spill(F.when(F.col("id") % 5 == 0, F.concat(F.lit("Total Spills Pages (8 KB pages) "), F.col("id") % 3)).otherwise(F.col("raw"))).alias("out")),
          "WITH h AS (SELECT id, CASE WHEN id % 5 = 0 THEN concat('Total Spills Pages (8 KB pages) ', id % 3) ELSE raw END AS raw FROM cells) SELECT id, CASE WHEN id % 5 = 0 THEN concat('total_spills_pages_', id % 3) ELSE " + _SNAKE.format(r"regexp_replace(replace(lower(regexp_replace(trim(raw), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '#', ' number '), '8\s*kb?(\s*pages?)?', ' pages ', 'g')") + " END AS out FROM h"),
]
