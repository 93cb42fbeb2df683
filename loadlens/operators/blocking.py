"""Blocking chains: who waits for whom in each capture, and for how long over captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.operators.activity import CAPTURE, first_row_per_session
from loadlens.sources.files import saved

def _key() -> Column:
    return F.concat_ws(":", "source_id", F.coalesce(F.col("capture_s").cast("string"), F.lit("unknown")))


def _chains_up(activity: DataFrame) -> DataFrame:
    """(pk, ps, above) for each session of a capture whose first row has a positive blocker: the sessions above it, to the end
    of the chain or into a ring. Chains double in each round by one equi-join, so the rounds follow the logarithm of the
    depth; a session walks once, whatever the rows that wait for it."""
    first = first_row_per_session(activity)
    edge = first.where("blocking_session_id > 0").select(F.col("capture_key").alias("pk"), F.col("session_id").alias("ps"), F.array("blocking_session_id").alias("above"), F.lit(False).alias("done"))
    now = saved(edge, "chains")
    while not now.where("not done").isEmpty():
        a, b = now.alias("a"), now.alias("b")
        joined = a.join(b, (F.col("a.pk") == F.col("b.pk")) & (F.element_at("a.above", -1) == F.col("b.ps")) & ~F.col("a.done"), "left")
        longer = F.concat("a.above", F.coalesce("b.above", F.array().cast("array<long>")))
        ring = F.size(F.array_distinct(F.concat(F.array("a.ps"), longer))) <= F.size(longer)
        now = saved(joined.select("a.pk", "a.ps", longer.alias("above"), (F.col("a.done") | F.col("b.ps").isNull() | F.col("b.done") | ring).alias("done")), "chains")
    return now.drop("done")


def blocking_chain(activity: DataFrame) -> DataFrame:
    """(capture_key, source_id, capture_s, row_number, path, root, complete) for each row with a positive blocker.

    A walk goes from the row to its own blocker, then from first row to first row, until a session has no positive
    blocker. If a session comes back, the walk is not complete and its root is the smallest visited.
    """
    rows = activity.withColumn("capture_key", _key())
    up = _chains_up(rows)
    kept = ["capture_key", "source_id", "capture_s", "row_number"]
    walks = rows.where("session_id is not null and blocking_session_id > 0").select(*kept, "session_id", "blocking_session_id")
    walks = walks.join(up, (F.col("capture_key") == F.col("pk")) & (F.col("blocking_session_id") == F.col("ps")), "left")
    walks = walks.select(*kept, F.concat(F.array("session_id", "blocking_session_id"), F.coalesce("above", F.array().cast("array<long>"))).alias("p"))
    twice = F.filter(F.sequence(F.lit(2), F.size("p")), lambda i: F.array_position("p", F.element_at("p", i)) < i)
    walks = walks.withColumn("cut", F.when(F.size(F.array_distinct("p")) < F.size("p"), F.element_at(twice, 1)))
    path = F.when(F.col("cut").isNotNull(), F.slice("p", F.lit(1), F.col("cut"))).otherwise(F.col("p"))
    root = F.when(F.col("cut").isNotNull(), F.array_min(F.slice("p", F.lit(1), F.greatest(F.col("cut") - 1, F.lit(1))))).otherwise(F.element_at("p", -1))
    return walks.select(*kept, path.alias("path"), root.alias("root"), F.col("cut").isNull().alias("complete"))


def blocking_snapshots(activity: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Per capture and root: participants, victims, depth, whether the chain is complete, and the root's state."""
    chains = blocking_chain(activity) if chains is None else chains
    keys = ["capture_key", "source_id", "capture_s", "root"]
    first = first_row_per_session(activity.withColumn("capture_key", _key())).select(F.col("capture_key").alias("fk"), F.col("session_id").alias("fs"), "status", "open_tran_count", "blocked_session_count", "wait_ms", F.col("row_number").alias("first_row"))
    walks = chains.groupBy(*keys).agg(F.max(F.size("path") - 1).alias("max_chain_depth"), F.bool_and("complete").alias("walks_complete"))
    members = chains.select(*keys, F.explode("path").alias("session_id")).distinct().join(first, (F.col("capture_key") == F.col("fk")) & (F.col("session_id") == F.col("fs")), "left")
    is_root = F.col("session_id") == F.col("root")
    people = members.groupBy(*keys).agg(
        F.count("*").alias("participants"), F.max(F.when(~is_root, F.col("wait_ms"))).alias("longest_wait_ms"), F.bool_or(is_root & F.col("first_row").isNotNull()).alias("root_present"),
        F.max(F.when(is_root, F.col("status"))).alias("root_status"), F.max(F.when(is_root, F.col("open_tran_count"))).alias("root_open_tran"), F.max(F.when(is_root, F.col("blocked_session_count"))).alias("reported"))
    w, p = walks.alias("w"), people.alias("p")
    on = (F.col("w.capture_key") == F.col("p.capture_key")) & (F.col("w.root") == F.col("p.root"))
    joined = w.join(p, on).select("w.*", "participants", "longest_wait_ms", "root_present", "root_status", "root_open_tran", "reported")
    victims = F.greatest(F.col("participants") - 1, F.coalesce("reported", F.lit(0))).cast("long")
    return joined.select("source_id", "capture_s", "root", "participants", victims.alias("victims"), "max_chain_depth", (F.col("walks_complete") & F.col("root_present")).alias("complete"), "root_present", "root_status", "root_open_tran", "longest_wait_ms")


def top_victims(activity: DataFrame, chains: DataFrame, n: int = 5) -> DataFrame:
    """The n longest waiting participants of each snapshot, without its root."""
    first = first_row_per_session(activity.withColumn("capture_key", _key())).select(F.col("capture_key").alias("fk"), F.col("session_id").alias("fs"), "wait_ms")
    people = chains.select("capture_key", "root", F.explode("path").alias("session_id")).distinct().where("session_id <> root").join(first, (F.col("capture_key") == F.col("fk")) & (F.col("session_id") == F.col("fs")), "left")
    w = Window.partitionBy("capture_key", "root").orderBy(F.coalesce("wait_ms", F.lit(-1)).desc(), "session_id")
    return people.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("capture_key", "root", "rank", "session_id", "wait_ms")


def blocking_episodes(snapshots: DataFrame, activity: DataFrame) -> DataFrame:
    """snapshots with the number of their episode: runs of captures of the source whose numbers differ by at most 1.

    Captures are numbered per source over all its distinct times; a null time continues the run before it."""
    times = activity.where("capture_s is not null").select("source_id", "capture_s").distinct()
    index = times.withColumn("index", F.row_number().over(Window.partitionBy("source_id").orderBy("capture_s")))
    s, i = snapshots.alias("s"), index.alias("i")
    placed = s.join(i, (F.col("s.source_id") == F.col("i.source_id")) & (F.col("s.capture_s") == F.col("i.capture_s")), "left").select("s.*", "i.index")
    run = Window.partitionBy("source_id", "root").orderBy(F.col("capture_s").asc_nulls_last())
    broken = F.coalesce(F.col("index") - F.lag("index").over(run) > 1, F.lit(False))
    return placed.withColumn("_b", broken.cast("long")).withColumn("episode_no", F.sum("_b").over(run.rowsBetween(Window.unboundedPreceding, 0))).drop("_b", "index")


def busiest_snapshot(snapshots: DataFrame, *keys: str) -> DataFrame:
    """The snapshot of each group with most victims, the latest of them."""
    order = F.struct("victims", F.coalesce("capture_s", F.lit(2**62)))
    return snapshots.groupBy(*keys).agg(F.max_by(F.struct("capture_s", "victims", "max_chain_depth"), order).alias("_s")).select(*keys, "_s.*")
