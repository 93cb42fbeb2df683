"""Operators over captured activity rows: keys, spans, populations, percentiles, rates, timelines and views of rows.

An activity row has source_id, capture_s (seconds; null if not captured), session_id, request_id, start_s, login_s,
row_number (the order of the input), its counters and its wait. Null capture times form one group per source and count as
the latest, as the text "null" sorts after every time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions import scalars as S

CAPTURE = ("source_id", "capture_s")
#: Points of a timeline that are kept: the latest.
TIMELINE_POINTS = 72


def episode() -> Column:
    """The key of one execution: session, request and its start or login. The source is no part of it."""
    begin = F.coalesce("start_s", "login_s").cast("string")
    return F.concat_ws(":", F.coalesce(F.col("session_id").cast("string"), F.lit("?")), F.coalesce("request_id", F.lit(0)).cast("string"), F.coalesce(begin, F.lit("?")))


def observed(activity: DataFrame) -> DataFrame:
    """activity with its parsed wait (wait_type, wait_ms) and its episode."""
    w = S.parse_wait(F.col("wait_info"))
    return activity.withColumn("w", w).withColumn("wait_type", F.col("w.type")).withColumn("wait_ms", F.col("w.duration_ms")).drop("w").withColumn("episode", episode())


def _latest(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.col("capture_s").desc_nulls_first(), F.col("row_number").desc())


# Views of rows

def activity_view(activity: DataFrame, session: str | None = None, sort: str = "duration_seconds", ascending: bool = False, page: int = 0, size: int = 100, ids: DataFrame | None = None) -> DataFrame:
    """One page of the rows whose session id contains the text and whose row_number is in ids, by a column with nulls last either way."""
    rows = activity if ids is None else activity.join(ids, "row_number", "left_semi")
    if session:
        rows = rows.where(F.col("session_id").cast("string").contains(session))
    key = F.col(sort).asc_nulls_last() if ascending else F.col(sort).desc_nulls_last()
    return rows.orderBy(key, F.col("row_number")).offset(page * size).limit(size)


def latest_row(rows: DataFrame, *keys: str) -> DataFrame:
    """The latest row of each group; of equal times the last in input order."""
    return rows.withColumn("_n", F.row_number().over(_latest(*keys))).where("_n = 1").drop("_n")


def first_row_per_session(activity: DataFrame) -> DataFrame:
    """The first captured row of each session of each capture."""
    names = [c for c in activity.columns if c not in ("source_id", "capture_s", "session_id")]
    return activity.where("session_id is not null").groupBy(*CAPTURE, "session_id").agg(F.min_by(F.struct(*names), "row_number").alias("_r")).select(*CAPTURE, "session_id", "_r.*")


def blocker_lookup(activity: DataFrame) -> DataFrame:
    """Each blocked row with the status of the first row of its blocker in the same capture, if there is one."""
    blocker = first_row_per_session(activity).select(*CAPTURE, F.col("session_id").alias("blocking_session_id"), F.col("row_number").alias("blocker_row"), F.col("status").alias("blocker_status"))
    a, b = activity.where("blocking_session_id > 0").alias("a"), blocker.alias("b")
    on = (F.col("a.source_id") == F.col("b.source_id")) & F.col("a.capture_s").eqNullSafe(F.col("b.capture_s")) & (F.col("a.blocking_session_id") == F.col("b.blocking_session_id"))
    return a.join(b, on, "left").select("a.row_number", "a.session_id", "a.blocking_session_id", "b.blocker_row", "b.blocker_status")


def blocking_owner(activity: DataFrame) -> DataFrame:
    """The rows of sessions that are named as a blocker anywhere."""
    named = activity.where("blocking_session_id > 0").select(F.col("blocking_session_id").alias("session_id")).distinct()
    return activity.join(named, "session_id", "left_semi")


# Aggregations

def observation_span(rows: DataFrame, *keys: str) -> DataFrame:
    """First and last capture, and the seconds between; 0 if none was captured."""
    return rows.groupBy(*keys).agg(F.min("capture_s").alias("first_s"), F.max("capture_s").alias("last_s"), F.coalesce(F.max("capture_s") - F.min("capture_s"), F.lit(0)).cast("double").alias("persistence"))


def capture_points(activity: DataFrame, *keys: str) -> DataFrame:
    return activity.groupBy(*keys).agg(F.countDistinct("capture_s").alias("capture_points"))


def peak_concurrent(rows: DataFrame, *keys: str) -> DataFrame:
    """Most distinct sessions in one capture; a row without a session counts by itself."""
    who = F.coalesce(F.col("session_id").cast("string"), F.concat(F.lit("row:"), "row_number"))
    return rows.groupBy(*dict.fromkeys((*keys, *CAPTURE))).agg(F.countDistinct(who).alias("n")).groupBy(*keys).agg(F.max("n").alias("peak"))


def signal_rail(activity: DataFrame) -> DataFrame:
    """Per capture time, of the latest ones: 3 for each blocked row and 1 for each row with a wait."""
    score = F.when(F.col("blocking_session_id") > 0, 3).otherwise(0) + F.when(F.col("wait_type").isNotNull(), 1).otherwise(0)
    return activity.where("capture_s is not null").groupBy("capture_s").agg(F.sum(score).cast("long").alias("score")).orderBy(F.desc("capture_s")).limit(TIMELINE_POINTS)


def timeline(rows: DataFrame, value: Column, *keys: str) -> DataFrame:
    """Per group, over its latest captures: points, first, latest and peak value, and the direction."""
    points = rows.withColumn("_v", value.cast("double")).where("capture_s is not null and _v is not null").groupBy(*keys, "capture_s").agg(F.max("_v").alias("v"))
    kept = timeline_tail(points, *keys)
    first, last = F.min_by("v", "capture_s"), F.max_by("v", "capture_s")
    return kept.groupBy(*keys).agg(F.count("*").alias("points"), first.alias("first_value"), last.alias("latest_value"), F.max("v").alias("peak_value")).withColumn(
        "direction", F.when(F.col("points") == 1, "Single observation").when(F.col("latest_value") > F.col("first_value"), "Increasing").when(F.col("latest_value") < F.col("first_value"), "Decreasing").otherwise("Stable"))


def timeline_tail(points: DataFrame, *keys: str, n: int = TIMELINE_POINTS) -> DataFrame:
    """The latest n captures of each group."""
    w = Window.partitionBy(*keys).orderBy(F.desc("capture_s"))
    return points.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def capture_population(activity: DataFrame) -> DataFrame:
    """Distinct episodes per capture."""
    return activity.groupBy(*CAPTURE).agg(F.countDistinct("episode").alias("population"))


def literal_variants(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct statements, and distinct statement shapes, in each group."""
    return rows.where("sql_text is not null").groupBy(*keys).agg(F.countDistinct(S.statement_variant(F.col("sql_text"))).alias("variants"), F.countDistinct(S.statement_shape(F.col("sql_text"))).alias("shapes"))


# Windows

def capture_percentile(activity: DataFrame, *metrics: str) -> DataFrame:
    """For each metric, the share of the capture's non-null values that are not above the row's; null where the row has none.

    A capture holds the sessions of one moment, so its rows fit a window; all metrics share one exchange."""
    out = activity.repartition(*CAPTURE)
    for m in metrics:
        w = Window.partitionBy(*CAPTURE, F.col(m).isNull()).orderBy(m)
        out = out.withColumn(f"{m}_percentile", F.when(F.col(m).isNotNull(), F.cume_dist().over(w)))
    return out


def derived_rates(activity: DataFrame, counter: str, delta: str | None = None) -> DataFrame:
    """Per episode: growth of a cumulative counter per second over neighbouring captures of one source.

    A drop is a reset and adds nothing; where a reported delta is on either row the pair is skipped, and a negative delta is
    a reset too."""
    w = Window.partitionBy("episode").orderBy("capture_s", "row_number")
    rows = activity.where(F.col("capture_s").isNotNull() & F.col(counter).isNotNull()).withColumn("_d", F.col(delta) if delta else F.lit(None).cast("double"))
    rows = rows.select("episode", "source_id", "capture_s", F.col(counter).alias("v"), "_d", *(F.lag(c).over(w).alias(f"p_{c}") for c in ("source_id", "capture_s", counter, "_d")))
    elapsed = F.col("capture_s") - F.col("p_capture_s")
    pair = (F.col("p_source_id") == F.col("source_id")) & (elapsed > 0) & F.col("_d").isNull() & F.col("p__d").isNull()
    up = pair & (F.col("v") >= F.col(f"p_{counter}"))
    sums = rows.groupBy("episode").agg(F.sum(F.when(up, F.col("v") - F.col(f"p_{counter}"))).alias("growth"), F.sum(F.when(up, elapsed)).alias("seconds"), F.coalesce(F.bool_or((pair & (F.col("v") < F.col(f"p_{counter}"))) | F.coalesce(F.col("_d") < 0, F.lit(False))), F.lit(False)).alias("reset"))
    return sums.select("episode", (F.col("growth") / F.col("seconds")).alias("rate"), "reset")


def cpu_elapsed_ratio(activity: DataFrame, has_delta: bool = False) -> DataFrame:
    """CPU over elapsed time on the longest row of each episode, for cumulative CPU alone."""
    w = Window.partitionBy("episode").orderBy(F.desc_nulls_last("duration_seconds"), "row_number")
    rows = activity.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    ratio = F.when((F.col("duration_seconds") > 0) & F.lit(not has_delta), F.col("cpu") / (F.col("duration_seconds") * 1000))
    return rows.select("episode", "row_number", ratio.alias("ratio"))
