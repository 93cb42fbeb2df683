"""Queries over activity: views of rows, look-ups, aggregations, windows and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.catalog.base import Query
from loadlens.operators import activity as A
from loadlens.operators import blocking as B

_FIRST = "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, capture_s, session_id ORDER BY row_number) AS rn FROM acts) z WHERE rn = 1)"
#: The walk in SQL: every row starts from its own blocker, later hops use first rows.
WALK = f"""WITH RECURSIVE {_FIRST}, walk AS (
 SELECT source_id, capture_s, row_number, [session_id] AS path, blocking_session_id AS cur, false AS done, true AS complete, CAST(NULL AS BIGINT) AS root FROM acts WHERE blocking_session_id > 0
 UNION ALL
 SELECT w.source_id, w.capture_s, w.row_number, list_append(w.path, w.cur), CASE WHEN f.blocking_session_id > 0 THEN f.blocking_session_id END,
  list_contains(w.path, w.cur) OR f.blocking_session_id IS NULL OR f.blocking_session_id <= 0, NOT list_contains(w.path, w.cur), CASE WHEN list_contains(w.path, w.cur) THEN list_min(w.path) ELSE w.cur END
 FROM walk w LEFT JOIN first f ON f.source_id = w.source_id AND f.capture_s IS NOT DISTINCT FROM w.capture_s AND f.session_id = w.cur WHERE NOT w.done),
chains AS (SELECT source_id, capture_s, row_number, path, root, complete FROM walk WHERE done)"""
SNAPS = f"""{WALK}, members AS (SELECT DISTINCT source_id, capture_s, root, unnest(path) AS session_id FROM chains),
people AS (SELECT m.source_id, m.capture_s, m.root, count(*) AS participants, max(CASE WHEN m.session_id <> m.root THEN f.wait_ms END) AS longest_wait_ms, bool_or(m.session_id = m.root AND f.row_number IS NOT NULL) AS root_present,
  max(CASE WHEN m.session_id = m.root THEN f.status END) AS root_status, max(CASE WHEN m.session_id = m.root THEN f.open_tran_count END) AS root_open_tran, max(CASE WHEN m.session_id = m.root THEN f.blocked_session_count END) AS reported
 FROM members m LEFT JOIN first f ON f.source_id = m.source_id AND f.capture_s IS NOT DISTINCT FROM m.capture_s AND f.session_id = m.session_id GROUP BY ALL),
walks AS (SELECT source_id, capture_s, root, max(len(path) - 1) AS max_chain_depth, bool_and(complete) AS walks_complete FROM chains GROUP BY ALL),
snaps AS (SELECT w.source_id, w.capture_s, w.root, p.participants, greatest(p.participants - 1, coalesce(p.reported, 0)) AS victims, w.max_chain_depth, w.walks_complete AND p.root_present AS complete, p.root_present, p.root_status, p.root_open_tran, p.longest_wait_ms
 FROM walks w JOIN people p ON p.source_id = w.source_id AND p.capture_s IS NOT DISTINCT FROM w.capture_s AND p.root = w.root)"""
EPISODES = f"""{SNAPS}, idx AS (SELECT source_id, capture_s, row_number() OVER (PARTITION BY source_id ORDER BY capture_s) AS i FROM (SELECT DISTINCT source_id, capture_s FROM acts WHERE capture_s IS NOT NULL) t),
eps AS (SELECT *, sum(broken) OVER (PARTITION BY source_id, root ORDER BY capture_s ASC NULLS LAST ROWS UNBOUNDED PRECEDING) AS episode_no FROM (
 SELECT s.*, CASE WHEN i - lag(i) OVER (PARTITION BY s.source_id, s.root ORDER BY s.capture_s ASC NULLS LAST) > 1 THEN 1 ELSE 0 END AS broken FROM snaps s LEFT JOIN idx ON idx.source_id = s.source_id AND idx.capture_s = s.capture_s) z)"""
_SNAP_COLS = "source_id, capture_s, root, participants, victims, CAST(max_chain_depth AS INTEGER) AS max_chain_depth, complete, root_present, root_status, root_open_tran, longest_wait_ms"


def acts(v):
    return A.observed(v.activity)


def _snaps(v):
    return B.blocking_snapshots(acts(v))


def _eps(v):
    a = acts(v)
    return B.blocking_episodes(B.blocking_snapshots(a), a)


_TL = """pts AS (SELECT {keys}, capture_s, max(CAST({value} AS DOUBLE)) AS v FROM acts WHERE capture_s IS NOT NULL AND {value} IS NOT NULL GROUP BY ALL),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY capture_s DESC) AS rn FROM pts) z WHERE rn <= 72)"""

QUERIES = [
    Query("activity_view", lambda v: A.activity_view(acts(v), session="1", sort="duration_seconds", page=1).select("row_number", "session_id", "duration_seconds"),
          "SELECT row_number, session_id, duration_seconds FROM activity WHERE CAST(session_id AS VARCHAR) LIKE '%1%' ORDER BY duration_seconds DESC NULLS LAST, row_number LIMIT 100 OFFSET 100"),
    Query("latest_row", lambda v: A.latest_row(acts(v), "episode").select("episode", "row_number", "capture_s"), "SELECT episode, row_number, capture_s FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY capture_s DESC NULLS FIRST, row_number DESC) AS n FROM acts) z WHERE n = 1"),
    Query("first_row_per_session", lambda v: A.first_row_per_session(acts(v)).select("source_id", "capture_s", "session_id", "row_number"), f"WITH {_FIRST} SELECT source_id, capture_s, session_id, row_number FROM first"),
    Query("blocker_lookup", lambda v: A.blocker_lookup(acts(v)), f"WITH {_FIRST} SELECT a.row_number, a.session_id, a.blocking_session_id, f.row_number AS blocker_row, f.status AS blocker_status FROM acts a LEFT JOIN first f ON f.source_id = a.source_id AND f.capture_s IS NOT DISTINCT FROM a.capture_s AND f.session_id = a.blocking_session_id WHERE a.blocking_session_id > 0"),
    Query("blocking_owner", lambda v: A.blocking_owner(acts(v)).select("row_number", "session_id"), "SELECT row_number, session_id FROM activity WHERE session_id IN (SELECT blocking_session_id FROM activity WHERE blocking_session_id > 0)"),
    Query("blocking_chain", lambda v: B.blocking_chain(acts(v)).select("source_id", "capture_s", "row_number", F.array_join("path", ">").alias("path"), "root", "complete"), f"{WALK} SELECT source_id, capture_s, row_number, array_to_string(path, '>') AS path, root, complete FROM chains"),
    Query("blocking_snapshots", _snaps, f"{SNAPS} SELECT {_SNAP_COLS} FROM snaps"),
    Query("blocking_episodes", lambda v: _eps(v).select("source_id", "capture_s", "root", "episode_no"), f"{EPISODES} SELECT source_id, capture_s, root, CAST(episode_no AS BIGINT) AS episode_no FROM eps"),
    Query("top_victims", lambda v: B.top_victims(acts(v), B.blocking_chain(acts(v))), f"""{WALK}, m AS (SELECT DISTINCT source_id, capture_s, root, unnest(path) AS session_id FROM chains) SELECT capture_key, root, CAST(rank AS INTEGER) AS rank, session_id, wait_ms FROM (
 SELECT concat(m.source_id, ':', coalesce(CAST(m.capture_s AS VARCHAR), 'unknown')) AS capture_key, m.root, m.session_id, f.wait_ms, row_number() OVER (PARTITION BY m.source_id, m.capture_s, m.root ORDER BY coalesce(f.wait_ms, -1) DESC, m.session_id) AS rank
 FROM m LEFT JOIN first f ON f.source_id = m.source_id AND f.capture_s IS NOT DISTINCT FROM m.capture_s AND f.session_id = m.session_id WHERE m.session_id <> m.root) z WHERE rank <= 5"""),
    Query("busiest_snapshot", lambda v: B.busiest_snapshot(_eps(v), "source_id", "root", "episode_no"), f"{EPISODES} SELECT source_id, root, CAST(episode_no AS BIGINT) AS episode_no, capture_s, victims, CAST(max_chain_depth AS INTEGER) AS max_chain_depth FROM (SELECT *, row_number() OVER (PARTITION BY source_id, root, episode_no ORDER BY victims DESC, capture_s DESC NULLS FIRST) AS n FROM eps) z WHERE n = 1"),
    Query("observation_span", lambda v: A.observation_span(acts(v), "episode"), "SELECT episode, min(capture_s) AS first_s, max(capture_s) AS last_s, CAST(coalesce(max(capture_s) - min(capture_s), 0) AS DOUBLE) AS persistence FROM acts GROUP BY episode"),
    Query("capture_points", lambda v: A.capture_points(acts(v), "source_id"), "SELECT source_id, count(DISTINCT capture_s) AS capture_points FROM activity GROUP BY source_id"),
    Query("peak_concurrent", lambda v: A.peak_concurrent(acts(v), "source_id"), "SELECT source_id, max(n) AS peak FROM (SELECT source_id, capture_s, count(DISTINCT session_id) AS n FROM activity GROUP BY ALL) z GROUP BY source_id"),
    Query("signal_rail", lambda v: A.signal_rail(acts(v)), "SELECT capture_s, CAST(sum(CASE WHEN blocking_session_id > 0 THEN 3 ELSE 0 END + CASE WHEN wait_type IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS score FROM acts WHERE capture_s IS NOT NULL GROUP BY capture_s ORDER BY capture_s DESC LIMIT 72"),
    Query("timeline", lambda v: A.timeline(acts(v), F.col("reads"), "episode"), f"""WITH {_TL.format(keys="episode", value="reads")} SELECT episode, points, first_value, latest_value, peak_value, CASE WHEN points = 1 THEN 'Single observation' WHEN latest_value > first_value THEN 'Increasing' WHEN latest_value < first_value THEN 'Decreasing' ELSE 'Stable' END AS direction
 FROM (SELECT episode, count(*) AS points, arg_min(v, capture_s) AS first_value, arg_max(v, capture_s) AS latest_value, max(v) AS peak_value FROM kept GROUP BY episode) z"""),
    Query("timeline_tail", lambda v: A.timeline_tail(acts(v).where("capture_s is not null").groupBy("source_id", "capture_s").agg(F.max("reads").alias("v")), "source_id", n=12), "SELECT source_id, capture_s, v FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY capture_s DESC) AS n FROM (SELECT source_id, capture_s, max(reads) AS v FROM activity WHERE capture_s IS NOT NULL GROUP BY ALL) y) z WHERE n <= 12"),
    Query("capture_population", lambda v: A.capture_population(acts(v)), "SELECT source_id, capture_s, count(DISTINCT episode) AS population FROM acts GROUP BY ALL"),
    Query("literal_variants", lambda v: A.literal_variants(acts(v), "source_id"), r"""SELECT source_id, count(DISTINCT trim(regexp_replace(sql_text, '\s+', ' ', 'g'))) AS variants,
 count(DISTINCT lower(trim(regexp_replace(regexp_replace(regexp_replace(sql_text, 'N?''(?:''''|[^''])*''', '?', 'g'), '\b\d+(?:\.\d+)?\b', '?', 'g'), '\s+', ' ', 'g')))) AS shapes FROM activity WHERE sql_text IS NOT NULL GROUP BY source_id"""),
    Query("capture_percentile", lambda v: A.capture_percentile(acts(v), "cpu", "reads").select("row_number", F.round("cpu_percentile", 6).alias("cpu_percentile"), F.round("reads_percentile", 6).alias("reads_percentile")),
          "SELECT row_number, round(cume_dist() OVER (PARTITION BY source_id, capture_s ORDER BY cpu), 6) AS cpu_percentile, round(cume_dist() OVER (PARTITION BY source_id, capture_s ORDER BY reads), 6) AS reads_percentile FROM activity"),
    Query("derived_rates", lambda v: A.derived_rates(acts(v), "cpu").select("episode", F.round("rate", 6).alias("rate"), "reset"), """WITH l AS (SELECT episode, source_id, capture_s, cpu, lag(source_id) OVER w AS ps, lag(capture_s) OVER w AS pc, lag(cpu) OVER w AS pv FROM acts WHERE capture_s IS NOT NULL AND cpu IS NOT NULL WINDOW w AS (PARTITION BY episode ORDER BY capture_s, row_number))
 SELECT episode, round(sum(CASE WHEN ps = source_id AND capture_s > pc AND cpu >= pv THEN cpu - pv END) / sum(CASE WHEN ps = source_id AND capture_s > pc AND cpu >= pv THEN capture_s - pc END), 6) AS rate, coalesce(bool_or(ps = source_id AND capture_s > pc AND cpu < pv), false) AS reset FROM l GROUP BY episode"""),
    Query("cpu_elapsed_ratio", lambda v: A.cpu_elapsed_ratio(acts(v)).select("episode", "row_number", F.round("ratio", 6).alias("ratio")), "SELECT episode, row_number, CASE WHEN duration_seconds > 0 THEN round(cpu / (duration_seconds * 1000), 6) END AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY duration_seconds DESC NULLS LAST, row_number) AS n FROM acts) z WHERE n = 1"),
]
