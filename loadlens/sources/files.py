"""Readers and writers of captures, evidence and reports."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens.functions import scalars as S

#: Files from this size are reported and not read.
MOST_BYTES = 100_000_000


def shared_path(spark: SparkSession, label: str) -> str:
    """A new place in the folder that the cluster shares. Where none is configured, one of our own serves a local master; on a
    cluster that is an error, as executors would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/loadlens-{label}-{uuid.uuid4().hex}"


@contextmanager
def compiled_methods(spark: SparkSession):
    """Within it, jobs with a stage whose code is more than the JVM compiles (8,000 bytes a method) run it in smaller pieces."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, 8000)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives lost executors and is computed once."""
    path = shared_path(df.sparkSession, label)
    with compiled_methods(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def normalize_activity(cells: DataFrame) -> DataFrame:
    """Typed rows from text cells: reported deltas before cumulative counters, duration from its text or from the times."""
    n = lambda c: S.as_number(F.col(c)) if c in cells.columns else F.lit(None).cast("double")
    t = lambda c: S.as_timestamp(F.col(c)) if c in cells.columns else F.lit(None).cast("timestamp")
    duration = F.coalesce(S.duration_seconds(F.col("duration")) if "duration" in cells.columns else F.lit(None), S.difference_seconds(t("start_time"), t("collection_time")))
    return cells.select(
        "row_number", n("session_id").alias("session_id"), F.unix_seconds(t("collection_time")).alias("collection_s"), F.round(duration, 3).alias("duration_seconds"),
        F.coalesce(n("CPU_delta"), n("CPU")).alias("cpu_ms"), F.coalesce(n("reads_delta"), n("reads")).alias("reads"), F.lower(S.as_text(F.col("status"))).alias("status"),
        S.parse_wait(F.col("wait_info"))["type"].alias("wait_type"))


def read_json_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON files that hold an array or an object with rows, side by side, with the union of their keys. A key of two
    types is text."""
    df = spark.read.option("multiLine", True).json(path)
    if "rows" not in df.columns:
        return df
    nested, plain = df.select(F.explode("rows").alias("r")).select("r.*"), df.where("rows is null").drop("rows")
    # what objects with rows have beside them is not a row's key
    used = plain.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in plain.columns)).first().asDict() if plain.columns else {}
    plain = plain.select(*(F.col(f"`{c}`") for c in plain.columns if used[c]))
    if not plain.columns:
        return nested
    kinds = dict(nested.dtypes)
    clash = {c for c, kind in plain.dtypes if kinds.get(c, kind) != kind}
    text = lambda d: d.select(*((F.to_json(F.col(f"`{c}`")) if kind.startswith(("struct", "array")) else F.col(f"`{c}`").cast("string")).alias(c) if c in clash else F.col(f"`{c}`") for c, kind in d.dtypes))
    return text(nested).unionByName(text(plain), allowMissingColumns=True)


#: Names that evidence files end in.
EVIDENCE_TYPES = (".csv", ".tsv", ".txt", ".json", ".xml", ".sqlplan")


def dedupe_evidence(files: DataFrame, known: DataFrame, types: tuple[str, ...] = EVIDENCE_TYPES) -> DataFrame:
    """(path, hash, state) of files (path, content, length): the first copy of new content is taken, the rest says why not."""
    right = F.lower("path").rlike("(" + "|".join(t.replace(".", "[.]") for t in types) + ")$")
    h = files.withColumns({"hash": F.sha2("content", 256), "right": right}).withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy(F.desc("right"), "path")))
    j = h.join(known.select("hash").distinct().withColumn("old", F.lit(True)), "hash", "left")
    state = F.when(~F.col("right"), "unsupported").when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too large").when(F.col("old"), "already in the case").when(F.col("n") > 1, "copy").otherwise("taken")
    return j.select("path", "hash", state.alias("state"))


def as_text_columns(df: DataFrame) -> DataFrame:
    """Every column as text that a spreadsheet takes as text; lists joined by ' | '."""

    def cell(name: str, kind: str) -> Column:
        c = F.array_join(F.col(name).cast("array<string>"), " | ") if kind.startswith("array") else F.col(name).cast("string")
        return S.csv_safe_cell(c).alias(name)

    return df.select(*(cell(n, k) for n, k in df.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    as_text_columns(df).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def findings_export(findings: DataFrame, caps: DataFrame, steps: DataFrame, profile: str) -> DataFrame:
    """The rows of a findings file: findings, then what caps left out, the guide's steps and the profile that was used."""
    told = lambda df, kind, rule, text, n: df.select(F.lit(kind).alias("record"), rule.alias("rule_id"), text.alias("subject"), n.cast("long").alias("n_rows"))
    extra = [told(caps, "cap", F.col("rule_id"), F.col("message"), F.col("suppressed")), told(steps, "step", F.col("kind"), F.concat(F.lit("step "), F.col("step")), F.col("sources")),
             told(findings.sparkSession.range(1), "profile", F.lit("thresholds"), F.lit(profile), F.lit(None))]
    out = findings.withColumn("record", F.lit("finding"))
    for df in extra:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_report(path: str, **tables: DataFrame) -> None:
    """Each table of a report (findings, inputs, plans, quality and others) as JSON lines below path, a row nested in a line, so
    that no group is gathered."""
    for name, df in tables.items():
        df.select(F.struct(*df.columns).alias(name)).write.json(f"{path}/{name}")


def run_manifest(files: DataFrame, profile: str | None = None, **tables: DataFrame) -> DataFrame:
    """One row per source file (hash, bytes), one per table (count), one for the profile (its digest), and one for the run,
    whose id is the hash of all the others: equal inputs give equal ids."""
    kept = lambda kind, name, h, n: [F.lit(kind).alias("kind"), name.alias("name"), h.cast("string").alias("hash"), n.cast("long").alias("n")]
    out = files.select(*kept("file", F.element_at(F.split("path", "/"), -1), F.sha2("content", 256), F.col("length")))
    for name, df in tables.items():
        out = out.unionByName(df.agg(F.count("*").alias("n")).select(*kept("table", F.lit(name), F.lit(None), F.col("n"))))
    if profile:
        out = out.unionByName(files.sparkSession.range(1).select(*kept("profile", F.lit("thresholds"), F.lit(profile), F.lit(None))))
    # an order of the rows would gather them; a sum of their hashes does not
    run = out.agg(F.count("*").alias("n"), F.sum(F.xxhash64("kind", F.coalesce("hash", "name"), "n").cast("decimal(38,0)")).alias("h"))
    return out.unionByName(run.select(*kept("run", F.lit("run"), F.sha2(F.col("h").cast("string"), 256), F.col("n"))))


def processing_log(**messages: DataFrame) -> DataFrame:
    """Message tables (message) under their kinds."""
    parts = [df.select(F.lit(kind).alias("kind"), "message") for kind, df in messages.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spill_header(headers: DataFrame, first: int = 50) -> DataFrame:
    """The first line of each input with a spill or warning column and a signature column (input_id, line_no, header)."""
    h = S.header_norm_spill(F.col("header"))
    g = headers.where(F.col("line_no") < first).groupBy("input_id", "line_no").agg(F.bool_or(h.rlike("spill|warning")).alias("spill"), F.bool_or(h.rlike("handle|hash|execution|cpu")).alias("signature"))
    return g.where("spill and signature").groupBy("input_id").agg(F.min("line_no").alias("line_no"))
