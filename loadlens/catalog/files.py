"""Queries of readers and writers. Each writes what Spark derives from the tables to the shared folder and reads it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.catalog.activity import acts
from loadlens.catalog.base import Query
from loadlens.catalog.reports import STEP_CTES, STEPS
from loadlens.catalog.rules import _MISSING, ALL, CAPPED, _missing, _shown, found
from loadlens.operators import guide as G
from loadlens.operators import inventory as J
from loadlens.operators import rules as R
from loadlens.operators.thresholds import Thresholds
from loadlens.sources import delimited as D
from loadlens.sources import files as W
from loadlens.sources import inputs as I
from loadlens.sources.files import saved


def _written(v, df, label, **options):
    path = W.shared_path(v.spark, label)
    df.write.options(**options).csv(path)
    return path


def _read_capture(v):
    """All of activity, a third of it by each separator, side by side, with cells over two lines and quotes in quotes."""
    rows = v.activity.select("row_number", F.when(F.col("row_number") % 50 != 0, F.concat(F.lit('said "x;y"\n'), F.coalesce("sql_text", F.lit("none")))).alias("text"), "status")
    path = W.shared_path(v.spark, "capture")
    for i, sep in enumerate(D.SEPARATORS):
        rows.where(F.col("row_number") % 3 == i).write.options(sep=sep, escape='"', quoteAll=True).csv(f"{path}/{i}")
    return D.read_capture(v.spark, path).select(F.col("cells")[0].cast("long").alias("row_number"), F.nullif(F.col("cells")[1], F.lit("")).alias("text"), F.col("cells")[2].alias("status"))


#: Files of derived rows are bounded, so that their number grows with the tables.
_ROWS_A_FILE = 2_000


def _parted(rows):
    parted = rows.withColumn("part", F.floor(F.col("row_number") / _ROWS_A_FILE))
    return parted.repartition("part").sortWithinPartitions("part", "row_number")


def _encodings(v):
    """All of activity, written by turns in UTF-8 and UTF-16 and read back."""
    path = W.shared_path(v.spark, "encodings")
    rows = _parted(v.activity).select("part", F.col("row_number").cast("string"), F.concat(F.lit("é "), F.coalesce("status", F.lit("none"))))
    rows.where("part % 2 = 0").write.partitionBy("part").csv(f"{path}/encoding=u8")
    rows.where("part % 2 = 1").write.partitionBy("part").option("encoding", "UTF-16").csv(f"{path}/encoding=u16")
    back = D.read_capture(v.spark, path)
    return back.groupBy("encoding").agg(F.countDistinct("path").alias("count"), F.count("*").alias("n_rows"), F.count_if(F.col("cells")[1].startswith("é ")).alias("n_read"), F.sum(F.col("cells")[0].cast("long")).alias("row_numbers"))


def _cells(v):
    s = lambda c: F.col(c).cast("string").alias(c)
    at = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("capture_s")), "yyyy-MM-dd HH:mm:ss").alias("collection_time")
    begin = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("start_s")), "yyyy-MM-dd HH:mm:ss").alias("start_time")
    return v.activity.select("row_number", s("session_id"), at, begin, s("reads"), F.col("cpu").cast("decimal(20,1)").cast("string").alias("CPU"), F.when(F.col("row_number") % 4 == 0, "7").alias("CPU_delta"), F.upper("status").alias("status"), "wait_info")


def _json(v):
    path = W.shared_path(v.spark, "json")
    # a file has at most _ROWS_A_FILE rows; every other one is an array without an object around it
    rows = v.activity.groupBy(F.floor(F.col("row_number") / _ROWS_A_FILE).alias("k")).agg(F.collect_list(F.struct("row_number", "status")).alias("rows"))
    rows.select("k", F.when(F.col("k") % 2 == 0, F.to_json(F.struct("rows"))).otherwise(F.to_json("rows")).alias("value")).write.partitionBy("k").text(path)
    return W.read_json_evidence(v.spark, path).select("row_number", "status")


def _files(v):
    """Source files of bounded size, and some again: all of activity as text, written and read as bytes."""
    path = W.shared_path(v.spark, "evidence")
    rows = _parted(v.activity).select("part", F.concat_ws(",", F.col("row_number").cast("string"), "status", "wait_info").alias("value"))
    rows.write.partitionBy("part").text(f"{path}/first")
    rows.where("part % 3 = 0").write.partitionBy("part").text(f"{path}/again")
    return v.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def _deduped(v):
    """Every fourth content is in the case already, every fifth is there again in a form that is not read."""
    path = W.shared_path(v.spark, "odd")
    rows = _parted(v.activity).select("part", F.concat_ws(",", F.col("row_number").cast("string"), "status").alias("value"))
    rows.where("part % 5 = 0").write.partitionBy("part").option("compression", "gzip").text(path)
    files = _files(v)
    odd = v.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    known = files.where("path like '%/first/%'").where(F.regexp_extract("path", "part=([0-9]+)", 1).cast("int") % 4 == 0).select(F.sha2("content", 256).alias("hash"))
    out = W.dedupe_evidence(files.unionByName(odd), known)
    return out.select(F.when(F.col("state") != "unsupported", F.col("hash")).alias("hash"), "state").groupBy("hash", "state").count()


_PARTS = f"parts AS (SELECT floor(row_number / {_ROWS_A_FILE}) AS part, string_agg(concat_ws(',', CAST(row_number AS VARCHAR), status, wait_info) || chr(10), '' ORDER BY row_number) AS content FROM activity GROUP BY 1), copies AS (SELECT part, content, 'taken' AS state FROM parts UNION ALL SELECT part, content, 'copy' FROM parts WHERE part % 3 = 0)"
_EXPORT = ("record", "rule_id", "severity", "confidence", "category", "subject", "impact", "n_rows", "first_row", "first_s", "last_s", "persistence")


def _write_findings(v):
    path = W.shared_path(v.spark, "findings")
    f = saved(_shown(found(v)), "found")
    W.write_csv(W.findings_export(R.finding_caps(f).drop("place"), R.cap_disclosure(f), G.guide_steps(f), Thresholds().digest()).select(*_EXPORT), path)
    back = v.spark.read.option("header", True).option("escape", '"').csv(path)
    typed = {"impact": "double", "n_rows": "long", "first_row": "long", "first_s": "long", "last_s": "long", "persistence": "double"}
    return back.select(*(F.col(c).cast(typed.get(c, "string")).alias(c) for c in _EXPORT)).withColumn("subject", F.regexp_replace("subject", "^'", ""))


_NONE = ", ".join(f"NULL AS {c}" for c in ("severity", "confidence", "category"))
_REST = "NULL AS first_row, NULL AS first_s, NULL AS last_s, NULL AS persistence"
_WRITTEN = f"""{CAPPED}, {STEP_CTES} SELECT 'finding' AS record, rule_id, severity, confidence, category, subject, round(impact, 6) AS impact, n_rows, first_row, first_s, last_s, persistence FROM capped WHERE kept
 UNION ALL BY NAME SELECT 'cap' AS record, rule_id, {_NONE}, concat(c, ' of ', n, ' findings of ', rule_id, ' are shown') AS subject, NULL AS impact, n - c AS n_rows, {_REST} FROM (SELECT rule_id, count(*) FILTER (WHERE kept) AS c, count(*) AS n FROM capped GROUP BY rule_id HAVING count(*) FILTER (WHERE NOT kept) > 0) z
 UNION ALL BY NAME SELECT 'step' AS record, kind AS rule_id, {_NONE}, concat('step ', step) AS subject, NULL AS impact, sources AS n_rows, {_REST} FROM st WHERE step <= 5
 UNION ALL BY NAME SELECT 'profile' AS record, 'thresholds' AS rule_id, {_NONE}, '{Thresholds().digest()}' AS subject, NULL AS impact, NULL AS n_rows, {_REST}"""


def _write_activity(v):
    path = W.shared_path(v.spark, "activity")
    a = acts(v)
    W.write_csv(a, path)
    back = v.spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    plain = lambda c: F.regexp_replace(c, "^'(?=[-=+@])", "")
    return back.select(*((plain(c) if kind == "string" else plain(c).cast(kind)).alias(c) for c, kind in a.dtypes))


def _write_guide(v):
    path = W.shared_path(v.spark, "guide")
    W.write_csv(G.guide_steps(found(v)), path)
    return v.spark.read.option("header", True).csv(path).select(F.col("step").cast("int").alias("step"), "kind", F.col("priority").cast("int").alias("priority"), F.col("sources").cast("long").alias("sources"))


def _write_report(v):
    path = W.shared_path(v.spark, "report")
    W.write_report(path, findings=_shown(found(v)), inputs=v.inputs.groupBy("input_id").count(), plans=J.plan_inventory(v.plan_stmts), quality=I.data_quality(v.inputs, acts(v)))
    back = lambda name: v.spark.read.json(f"{path}/{name}").select(f"{name}.*")
    parts = [back("findings").groupBy(F.concat(F.lit("finding "), "rule_id").alias("part")).agg(F.count("*").alias("n"), F.round(F.sum("impact"), 3).alias("total")),
             back("inputs").groupBy(F.lit("inputs").alias("part")).agg(F.count("*").alias("n"), F.sum("count").cast("double").alias("total")),
             back("plans").groupBy(F.lit("plans").alias("part")).agg(F.count("*").alias("n"), F.sum("statements").cast("double").alias("total")),
             back("quality").groupBy(F.lit("quality").alias("part")).agg(F.count("*").alias("n"), F.sum("unparsed_waits").cast("double").alias("total"))]
    return reduce(DataFrame.unionByName, parts)


def _manifest(v):
    m = W.run_manifest(_files(v), Thresholds().digest(), activity=v.activity, plans=v.plan_stmts, findings=found(v))
    named = F.when(F.col("kind") == "file", F.lit("file")).otherwise(F.col("name"))
    return m.select("kind", named.alias("name"), F.when(F.col("kind") != "run", F.col("hash")).alias("hash"), "n")


def _log(v):
    a = saved(acts(v), "acts")
    lost = a.where("wait_info is not null and wait_type is null")
    return W.processing_log(**{
        "warning": lost.select(F.concat(F.lit("row "), "row_number").alias("message")), "error": v.inputs.where("line_no = 0").select(F.concat("input_id", F.lit(": "), "header").alias("message")),
        "quality": lost.agg(F.concat(F.count("*").cast("string"), F.lit(" waits could not be parsed")).alias("message")), "not run": _missing(v).select(F.concat("rule_id", F.lit(" lacks "), "missing").alias("message")), "cap": R.cap_disclosure(_shown(R.all_findings(a, v.samples))).select("message"),
    })


QUERIES = [
    Query("read_capture", _read_capture, "SELECT row_number, CASE WHEN row_number % 50 <> 0 THEN concat('said \"x;y\"', chr(10), coalesce(sql_text, 'none')) END AS text, status FROM activity"),
    Query("text_encoding", _encodings, f"SELECT CASE WHEN part % 2 = 0 THEN 'UTF-8' ELSE 'UTF-16BE' END AS encoding, count(DISTINCT part) AS count, count(*) AS n_rows, count(*) AS n_read, sum(row_number) AS row_numbers FROM (SELECT row_number, CAST(floor(row_number / {_ROWS_A_FILE}) AS BIGINT) AS part FROM activity) z GROUP BY 1"),
    Query("normalize_activity", lambda v: W.normalize_activity(_cells(v)), "SELECT row_number, CAST(session_id AS DOUBLE) AS session_id, CAST(1704067200 + capture_s AS BIGINT) AS collection_s, CASE WHEN capture_s >= start_s THEN CAST(capture_s - start_s AS DOUBLE) END AS duration_seconds, CASE WHEN row_number % 4 = 0 THEN CAST(7 AS DOUBLE) ELSE cpu END AS cpu_ms, reads, status, wait_type FROM acts"),
    Query("read_json_evidence", _json, "SELECT row_number, status FROM activity"),
    Query("dedupe_evidence", _deduped, f"WITH {_PARTS}, s AS (SELECT sha256(content) AS hash, CASE WHEN part % 4 = 0 THEN 'already in the case' ELSE state END AS state FROM copies UNION ALL SELECT NULL, 'unsupported' FROM parts WHERE part % 5 = 0) SELECT hash, state, count(*) AS count FROM s GROUP BY ALL"),
    Query("write_findings", _write_findings, _WRITTEN),
    Query("write_guide", _write_guide, f"{STEPS} SELECT CAST(step AS INTEGER) AS step, kind, priority, sources FROM st WHERE step <= 5"),
    Query("write_activity", _write_activity, "SELECT * FROM acts"),
    Query("write_report", _write_report, f"""{ALL} SELECT concat('finding ', rule_id) AS part, count(*) AS n, round(sum(round(impact, 6)), 3) AS total FROM findings GROUP BY rule_id UNION ALL SELECT 'inputs', count(DISTINCT input_id), CAST(count(*) AS DOUBLE) FROM inputs
 UNION ALL SELECT 'plans', count(DISTINCT plan_id), CAST(count(*) AS DOUBLE) FROM plan_stmts UNION ALL SELECT 'quality', 1, CAST(count(*) AS DOUBLE) FROM acts WHERE wait_info IS NOT NULL AND wait_type IS NULL"""),
    Query("run_manifest", _manifest, f"""{ALL}, {_PARTS}, m AS (SELECT 'file' AS kind, 'file' AS name, sha256(content) AS hash, octet_length(encode(content)) AS n FROM copies UNION ALL SELECT 'table', 'activity', NULL, count(*) FROM acts UNION ALL SELECT 'table', 'plans', NULL, count(*) FROM plan_stmts
 UNION ALL SELECT 'table', 'findings', NULL, count(*) FROM findings UNION ALL SELECT 'profile', 'thresholds', '{Thresholds().digest()}', NULL) SELECT * FROM m UNION ALL SELECT 'run', 'run', NULL, count(*) FROM m"""),
    Query("source_manifest", lambda v: W.run_manifest(_files(v), activity=v.activity).where("kind <> 'run'").select("kind", F.when(F.col("kind") == "table", F.col("name")).alias("name"), "hash", "n"), f"WITH {_PARTS} SELECT 'file' AS kind, NULL AS name, sha256(content) AS hash, octet_length(encode(content)) AS n FROM copies UNION ALL SELECT 'table', 'activity', NULL, count(*) FROM activity"),
    Query("processing_log", _log, rf"""{CAPPED} SELECT 'warning' AS kind, concat('row ', CAST(row_number AS VARCHAR)) AS message FROM acts WHERE wait_info IS NOT NULL AND wait_type IS NULL UNION ALL SELECT 'error', concat(input_id, ': ', header) FROM inputs WHERE line_no = 0 UNION ALL SELECT 'quality', concat(CAST(count(*) AS VARCHAR), ' waits could not be parsed') FROM acts WHERE wait_info IS NOT NULL AND wait_type IS NULL
 UNION ALL SELECT 'not run', concat(rule_id, ' lacks ', missing) FROM ({_MISSING}) m UNION ALL SELECT 'cap', concat(CAST(retained AS VARCHAR), ' of ', CAST(retained + suppressed AS VARCHAR), ' findings of ', rule_id, ' are shown') FROM (SELECT rule_id, count(*) FILTER (WHERE kept) AS retained, count(*) FILTER (WHERE NOT kept) AS suppressed FROM capped GROUP BY rule_id) z WHERE suppressed > 0"""),
    Query("spill_header", lambda v: W.spill_header(v.inputs.withColumn("header", F.when(F.col("event_id") % 13 == 0, "TotalSpills").when(F.col("event_id") % 17 == 0, "Plan Handle").otherwise(F.col("header")))), "WITH h AS (SELECT input_id, line_no, CASE WHEN event_id % 13 = 0 THEN 'spill' WHEN event_id % 17 = 0 THEN 'handle' ELSE lower(header) END AS h FROM inputs) SELECT input_id, min(line_no) AS line_no FROM (SELECT input_id, line_no FROM h GROUP BY ALL HAVING bool_or(h LIKE '%spill%' OR h LIKE '%warning%') AND bool_or(regexp_matches(h, 'handle|hash|execution|cpu'))) z GROUP BY input_id"),
]
