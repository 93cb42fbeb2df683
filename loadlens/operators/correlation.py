"""Operators that tie evidence together: by stable identity, by time, by locked resource, by shared records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions import scalars as S

# The keys of an identity, and ranks of match qualities.
IDENTITY = ("qs_query_id", "qs_plan_id", "database_id", "plan_handle", "sql_handle", "start_offset", "end_offset", "query_hash", "plan_hash", "session_id", "request_id", "transaction_id")
QUALITY = {"Exact": 3, "Strong": 2, "Candidate": 1, "None": 0}
_HANDLES = ("plan_handle", "sql_handle", "query_hash", "plan_hash")
#: The keys of a query, by which identities are classes, and the ways in which classes meet: equi-joins on these.
_QUERY = IDENTITY[:9]
_MEETINGS = (("qs_query_id", "qs_plan_id"), ("plan_handle",), ("sql_handle",), ("query_hash",))
#: Of a meeting by the last, what is at least Strong shares this too.
_STRONG_HASH = ("query_hash", "plan_hash")


def quality_rank(quality: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in QUALITY.items() for x in kv)), quality)


def _keys(df: DataFrame, keys: tuple[str, ...]) -> list[Column]:
    col = lambda k: S.handle_norm(F.col(k)) if k in _HANDLES else F.col(k)
    return [(col(k) if k in df.columns else F.lit(None)).alias(k) for k in keys]


def identity_classes(df: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, keys of an identity) that agree in all keys of a query, and in the columns more, are one class: (cls, n, the
    keys, more), named by its smallest id, and (id, cls) of all rows. A query that half of the rows are of is a few rows."""
    rows = df.select("id", *_keys(df, (*_QUERY, *more)))
    rows = rows.withColumn("h", F.sha2(F.to_json(F.struct(*_QUERY, *more)), 256))
    classes = rows.groupBy("h").agg(F.min("id").alias("cls"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in (*_QUERY, *more)))
    return classes.drop("h"), rows.select("id", "h").join(classes.select("h", "cls"), "h").select("id", "cls")


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns))


def _same(*keys: str) -> Column:
    return reduce(lambda x, y: x & y, (F.coalesce(F.col(f"l_{k}") == F.col(f"r_{k}"), F.lit(False)) for k in keys))


def _meet(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return left.join(right, reduce(lambda x, y: x & y, (F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys)))


def _graded(pairs: DataFrame, *kept: str) -> DataFrame:
    """pairs of sided identities with quality, n_conflicts, same_plan, local, told and matched, and the columns kept."""
    differ = lambda k: F.coalesce(F.col(f"l_{k}") != F.col(f"r_{k}"), F.lit(False))
    whole = lambda s: F.col(f"{s}_start_offset").isNotNull() & F.col(f"{s}_end_offset").isNotNull()
    conflicts = [differ(k) for k in ("plan_handle", "sql_handle", "plan_hash", "qs_query_id", "qs_plan_id", "database_id")] + [_same("sql_handle") & differ(k) for k in ("start_offset", "end_offset")]
    n = reduce(lambda x, y: x + y, (c.cast("int") for c in conflicts))
    scoped = F.col("l_database_id").isNotNull() & F.col("r_database_id").isNotNull()
    session = F.when(_same("session_id", "request_id"), F.when(_same("transaction_id"), "Exact").otherwise("Strong")).otherwise("None") if "l_session_id" in pairs.columns else F.lit("None")
    quality = (
        F.when(_same("qs_query_id", "qs_plan_id"), F.when(_same("database_id"), "Exact").when(scoped, "None").otherwise("Candidate"))
        .when(_same("plan_handle"), "Exact")
        .when(_same("sql_handle"), F.when(whole("l") & whole("r"), F.when(_same("start_offset", "end_offset"), "Exact").otherwise("None")).otherwise("Strong"))
        .when(_same("query_hash"), F.when(_same("plan_hash"), "Strong").otherwise("Candidate")).otherwise(session)
    )
    local = ~reduce(lambda x, y: x | y, (differ(k) for k in ("plan_handle", "sql_handle", "database_id")))
    told = _same("sql_handle", "start_offset", "end_offset") | _same("query_hash", "plan_hash") | _same("database_id", "qs_query_id", "qs_plan_id")
    out = pairs.select(*kept, quality.alias("quality"), n.alias("n_conflicts"), _same("plan_handle").alias("same_plan"), local.alias("local"), told.alias("told"))
    return out.withColumn("matched", (F.col("n_conflicts") == 0) & (F.col("quality") != "None"))


def class_match(left: DataFrame, right: DataFrame, least: str = "Candidate", *kept: str) -> DataFrame:
    """Each pair of identity_classes (l_cls, r_cls) that share a key of a query, graded, with how many rows the right one stands for
    (r_n) and its columns kept. least: Strong leaves out what only shares the hash of a query, which many may."""
    l_, r = _sided(left, "l"), _sided(right, "r")
    ways = [*_MEETINGS[:-1], _STRONG_HASH if QUALITY[least] > 1 else _MEETINGS[-1]]
    # a pair that has met by a way before it is left out of the later ones, so nothing is shuffled to drop what met twice
    met = lambda before: reduce(lambda x, y: x | y, (_same(*k) for k in before), F.lit(False))
    pairs = reduce(DataFrame.unionByName, (_meet(l_, r, keys).where(~met(ways[:i])) for i, keys in enumerate(ways)))
    return _graded(pairs, "l_cls", "r_cls", "r_n", *(f"r_{k}" for k in kept))


def _by_session(left: DataFrame, right: DataFrame, *kept: str) -> DataFrame:
    """Graded pairs of rows that share a session and request and no key of a query."""
    l_ = _sided(left.select("id", *_keys(left, IDENTITY)), "l")
    r = _sided(right.select("id", *_keys(right, (*IDENTITY, *kept))), "r")
    pairs = _meet(l_, r, ("session_id", "request_id")).where(~reduce(lambda x, y: x | y, (_same(*k) for k in _MEETINGS)))
    return _graded(pairs, "l_id", "r_id", *(f"r_{k}" for k in kept))


_GRADES = ["quality", "n_conflicts", "same_plan", "local", "told", "matched"]


def identity_match(left: DataFrame, right: DataFrame, least: str = "Candidate") -> DataFrame:
    """(l_id, r_id, quality, n_conflicts, same_plan, local, told, artifact, matched) for each pair of identities that share
    a key. A conflict on a key that both have blocks the match but leaves its quality. same_plan: the plan handles agree;
    local: no conflict but of the statement; told: offsets, hashes or the Query Store pair tell the statement from its
    siblings; artifact: where the right one is from, null without such a column.

    Equal identities meet once, as classes; pairs of rows are made last, for those who want them. least: see class_match."""
    (lc, lm), (rc, rm) = identity_classes(left), identity_classes(right, "artifact")
    classes = class_match(lc, rc, least, "artifact")
    pairs = classes.join(lm.select(F.col("id").alias("l_id"), F.col("cls").alias("l_cls")), "l_cls").join(rm.select(F.col("id").alias("r_id"), F.col("cls").alias("r_cls")), "r_cls")
    both = pairs.select("l_id", "r_id", *_GRADES, "r_artifact").unionByName(_by_session(left, right, "artifact").select("l_id", "r_id", *_GRADES, "r_artifact"))
    return both.withColumn("artifact", F.col("r_artifact").cast("string")).drop("r_artifact")


def named_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame, *kept: str) -> DataFrame:
    """The pairs (l_id, r_id) of identities that identity_match would give, graded as there; no other pair is made."""
    l_ = _sided(left.select("id", *_keys(left, IDENTITY)), "l")
    r = _sided(right.select("id", *_keys(right, (*IDENTITY, *kept))), "r")
    both = pairs.select("l_id", "r_id").distinct().join(l_, "l_id").join(r, "r_id")
    share = reduce(lambda x, y: x | y, (_same(*k) for k in (*_MEETINGS, ("session_id", "request_id"))))
    return _graded(both.where(share), "l_id", "r_id", *(f"r_{k}" for k in kept))


def incident_overlap(artifacts: DataFrame, windows: DataFrame, tolerance: int = 30) -> DataFrame:
    """Each artifact (artifact_id, window_id, at_s) against its window (window_id, first_s, last_s)."""
    at, first, last = F.col("at_s"), F.col("first_s"), F.col("last_s")
    state = F.when(at.isNull() | first.isNull() | last.isNull(), "Unknown").when(at.between(first, last), "Exact").when(at.between(first - tolerance, last + tolerance), "Overlapping").otherwise("Context only")
    return artifacts.join(windows, "window_id", "left").select("artifact_id", "window_id", state.alias("overlap"))


_NEEDS_DESCRIPTION = ("KEY", "PAGE", "RID")


def _whole_locks(locks: DataFrame) -> DataFrame:
    """Locks whose resource is told from all others, with about for the description."""
    fine = locks.where(F.col("resource_type").isNotNull() & F.col("database_id").isNotNull() & F.col("entity_id").isNotNull() & (F.col("description").isNotNull() | ~F.col("resource_type").isin(*_NEEDS_DESCRIPTION)))
    return fine.withColumn("about", F.coalesce("description", F.lit("")))


RESOURCE = ["resource_type", "database_id", "entity_id", "about"]
#: Sessions of a block of a resource's members.
_MEMBERS = 512


def lock_resources(locks: DataFrame) -> DataFrame:
    """One row for each resource that is both held and waited for: holders, waiters and both (sessions), and pairs, the number of
    pairs of a holder and another session that waits, which nobody has to make."""
    g = _whole_locks(locks).where("request_status in ('GRANT', 'WAIT')").groupBy(*RESOURCE, "session_id").agg(F.bool_or(F.col("request_status") == "GRANT").alias("holds"), F.bool_or(F.col("request_status") == "WAIT").alias("waits"))
    g = g.groupBy(*RESOURCE).agg(F.count_if("holds").alias("holders"), F.count_if("waits").alias("waiters"), F.count_if(F.col("holds") & F.col("waits")).alias("both"))
    return g.withColumn("pairs", F.col("holders") * F.col("waiters") - F.col("both")).where("pairs > 0")


def lock_members(locks: DataFrame, size: int = _MEMBERS) -> DataFrame:
    """The sessions of each resource that is held or waited for, in blocks of about size: (resource, side, block, sessions). The block
    follows from the session, so no list grows with the sessions of a hot resource."""
    each = _whole_locks(locks).where("request_status in ('GRANT', 'WAIT')").select(*RESOURCE, F.when(F.col("request_status") == "GRANT", "holder").otherwise("waiter").alias("side"), "session_id").distinct()
    n = each.groupBy(*RESOURCE, "side").agg(F.count("*").alias("n"))
    placed = each.join(n, [*RESOURCE, "side"]).withColumn("block", F.pmod(F.xxhash64("session_id"), F.ceil(F.col("n") / size)))
    return placed.groupBy(*RESOURCE, "side", "block").agg(F.array_sort(F.collect_list("session_id")).alias("sessions"))


def lock_resource_match(locks: DataFrame, roots: DataFrame | None = None, size: int = _MEMBERS) -> DataFrame:
    """(holder, waiter, resource): the sessions that wait for a resource that another one holds, or only that of roots (session_id).
    Incomplete resources never match. Rows are the pairs of a resource's holders and waiters; lock_resources counts them.

    Blocks of holders meet blocks of waiters (lock_members), and pairs of blocks are dealt out before they are taken apart: a task
    holds two blocks, and the pairs of a hot resource are made by many tasks and never shuffled or sorted."""
    if roots is not None:
        root = roots.select("session_id").distinct()
        locks = locks.where("request_status = 'WAIT'").unionByName(locks.where("request_status = 'GRANT'").join(root, "session_id", "left_semi").select(*locks.columns))
    members = lock_members(locks, size)
    side = lambda name: members.where(F.col("side") == name).select(*RESOURCE, F.col("block").alias(f"{name}_block"), F.col("sessions").alias(f"{name}s"))
    # by a number of its own: pairs of blocks are small and what is made of them is not
    n = int(locks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = side("holder").join(side("waiter"), RESOURCE).repartition(n, *RESOURCE, "holder_block", "waiter_block")
    each = met.select(*RESOURCE, "waiters", F.explode("holders").alias("holder")).select(*RESOURCE, "holder", F.explode("waiters").alias("waiter"))
    return each.where("holder <> waiter").select("holder", "waiter", *RESOURCE)


def shared_resources(locks: DataFrame, *also: str) -> DataFrame:
    """Resources that are both held and waited for, in each group of the columns also."""
    keys = [*also, "resource_type", "database_id", "entity_id", "description"]
    return locks.where("request_status = 'GRANT'").select(*keys).intersect(locks.where("request_status = 'WAIT'").select(*keys))


def scheduler_blocking_link(findings: DataFrame) -> DataFrame:
    """Scheduler and blocking findings of the same root session, linked both ways."""
    root = F.when(F.col("rule_id") == "WIA-BLOCKING", F.split_part("subject", F.lit(":"), F.lit(2))).when(F.col("rule_id") == "WIA-SCHEDULER-PRESSURE", F.col("subject"))
    f = findings.withColumn("root", root).where("root is not null").select("rule_id", "subject", "root")
    s, b = f.where("rule_id = 'WIA-SCHEDULER-PRESSURE'").alias("s"), f.where("rule_id = 'WIA-BLOCKING'").alias("b")
    both = s.join(b, F.col("s.root") == F.col("b.root")).select(F.col("s.subject").alias("from"), F.col("b.subject").alias("to"))
    return both.unionByName(both.select(F.col("to").alias("from"), F.col("from").alias("to")))


_SIDECAR = ("sql_handle", "plan_handle", "query_hash", "plan_hash", "start_offset", "end_offset", "qs_query_id", "qs_plan_id", "database_id")


def sidecar_identity(statements: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Each sidecar row to exactly one statement of its plan (sidecar_id, plan_id, statement_id, tier, conflicts): by unique
    offsets, else a unique hash pair, else a unique Query Store pair, else the only statement.

    conflicts names the fields of which both have different values; where there are any, the identities must not be merged.
    A sql handle is exempt where the sidecar owns it: its plan handle agrees or is the only one, or the plan is from Query
    Store (source_kind of statements) and the sidecar has the pair and the database. Fields that either side lacks as a
    column are null, and a Query Store plan id that neither side has is not asked for.
    """
    filled = lambda df, keys: df.select(*keys, *((F.lower(F.trim(F.col(c).cast("string"))) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in (*_SIDECAR, "source_kind")))
    st, sc = filled(statements, ["plan_id", "statement_id"]), filled(sidecars, ["sidecar_id", "plan_id"])
    pair = ["qs_query_id"] if "qs_plan_id" not in statements.columns and "qs_plan_id" not in sidecars.columns else ["qs_query_id", "qs_plan_id"]
    tiers = {"offset": ["start_offset", "end_offset"], "hash": ["query_hash", "plan_hash"], "store": pair, "only": []}
    placed = sc.drop("source_kind")
    for name, keys in tiers.items():
        unique = st.groupBy("plan_id", *keys).agg(F.count("*").alias("n"), F.min("statement_id").alias(f"by_{name}")).where("n = 1").drop("n").dropna()
        placed = placed.join(unique, ["plan_id", *keys], "left")
    tier = F.coalesce(*(F.when(F.col(f"by_{name}").isNotNull(), F.lit(name)) for name in tiers), F.lit("none"))
    placed = placed.withColumn("tier", tier).withColumn("statement_id", F.coalesce(*(f"by_{name}" for name in tiers)))
    p, t = placed.alias("p"), st.alias("t")
    both = p.join(t, (F.col("p.plan_id") == F.col("t.plan_id")) & (F.col("p.statement_id") == F.col("t.statement_id")), "left")
    filled_in = lambda c: F.nullif(F.col(c), F.lit(""))
    handle = filled_in("p.plan_handle")
    owned = F.coalesce(handle.isNotNull() & (filled_in("t.plan_handle").isNull() | (handle == F.col("t.plan_handle"))), F.lit(False))
    scoped = F.coalesce((F.col("t.source_kind") == "query store") & F.col("p.qs_query_id").isNotNull() & F.col("p.qs_plan_id").isNotNull() & F.col("p.database_id").isNotNull(), F.lit(False))
    differ = lambda c: F.when((filled_in(f"p.{c}") != filled_in(f"t.{c}")) & (~(owned | scoped) if c == "sql_handle" else F.lit(True)), F.lit(c))
    return both.select("p.sidecar_id", "p.plan_id", "p.statement_id", "p.tier", F.array_compact(F.array(*map(differ, _SIDECAR))).alias("conflicts"))


#: What a match may score: its strength, thrice, and the kind of its plan.
_SCORES = range(6, 12)


def _score() -> Column:
    kind = F.when(F.col("actual"), 2).when(F.coalesce("cached", F.lit(False)), 1).otherwise(0)
    return F.when(F.col("matched") & (F.col("strength") >= 2), F.col("strength") * 3 + kind)


def _pooled() -> list[Column]:
    return [*(F.sum(f"ties_{k}").alias(f"ties_{k}") for k in _SCORES), *(F.min(f"first_{k}").alias(f"first_{k}") for k in _SCORES)]


def _tallies(rows: DataFrame, by: str) -> DataFrame:
    """(by, ties and first of each score, against) of graded rows (by, alt, n, first, artifact, actual, cached), each alt once for a
    by: what counts of them, a row for each by. A conflicting statement counts against, but for siblings that are told
    apart. Scores are few, so numbers alone are summed up, in one pass."""
    rows = rows.withColumn("strength", quality_rank(F.col("quality"))).where("strength >= 2").withColumn("score", _score())
    beside = F.col("same_plan") & F.col("local")
    at = rows.groupBy(by, "artifact").agg(
        *(F.sum(F.when(F.col("score") == k, F.col("n"))).alias(f"ties_{k}") for k in _SCORES), *(F.min(F.when(F.col("score") == k, F.col("first"))).alias(f"first_{k}") for k in _SCORES),
        F.bool_or(F.col("matched") & (F.col("quality") == "Exact") & F.col("same_plan") & F.col("told")).alias("told"),
        F.max(F.when(~F.col("matched") & beside, F.col("strength"))).alias("siblings"), F.max(F.when(~F.col("matched") & ~beside, F.col("strength"))).alias("others"))
    against = F.greatest("others", F.when(~(F.col("told") & F.col("artifact").isNotNull()), F.col("siblings")))
    return at.groupBy(by).agg(*_pooled(), F.max(against).alias("against"))


def _decided(tallies: DataFrame, chosen: DataFrame) -> DataFrame:
    """(l_id, state, r_id, ties) from _tallies by l_id and what was chosen (l_id, chosen, chosen_score), for those that match at all."""
    falling = list(_SCORES)[::-1]
    of = lambda name: F.coalesce(*(F.when(F.col(f"ties_{k}").isNotNull(), F.col(f"{name}_{k}") if name else F.lit(k)) for k in falling))
    best = tallies.select("l_id", of("").alias("score"), of("ties").alias("ties"), of("first").alias("first"), "against").where("score is not null")
    strength = F.floor(F.col("score") / 3)
    state = F.when(F.col("against") >= strength, "blocked").when(F.col("ties") == 1, "resolved").when(F.coalesce(F.col("chosen_score") == F.col("score"), F.lit(False)), "selected").otherwise("ambiguous")
    return best.join(chosen, "l_id", "left").select("l_id", state.alias("state"), F.when(state == "resolved", F.col("first")).when(state == "selected", F.col("chosen")).alias("r_id"), "ties")


def _chosen(pairs: DataFrame, selections: DataFrame) -> DataFrame:
    """selections with chosen_score, the score of the chosen one among graded pairs (l_id, r_id, actual, cached)."""
    scores = pairs.withColumn("strength", quality_rank(F.col("quality"))).groupBy("l_id", F.col("r_id").alias("chosen")).agg(F.max(_score()).alias("chosen_score"))
    return selections.select("l_id", "chosen").join(scores, ["l_id", "chosen"], "left")


def candidate_plan(matches: DataFrame, selections: DataFrame) -> DataFrame:
    """The best statement for each candidate of matches (identity_match with actual and, where known, cached): Strong at
    least, actual plans before cached estimated ones before others. A conflicting statement at least as strong blocks, except
    a sibling in the artifact and under the plan handle of an Exact match that its own discriminator tells from it; ties are
    ambiguous unless selections (l_id, chosen) picks one."""
    cached = F.col("cached") if "cached" in matches.columns else F.lit(False)
    rows = matches.select("l_id", "r_id", F.lit(1).alias("n"), F.col("r_id").alias("first"), "artifact", "actual", cached.alias("cached"), *_GRADES)
    return _decided(_tallies(rows, "l_id"), _chosen(rows, selections))


def candidate_plans(left: DataFrame, right: DataFrame, selections: DataFrame) -> DataFrame:
    """candidate_plan of the candidates left and the statements right (identities; right has actual and may have cached and artifact)
    without pairs of rows: equal identities are classes that meet once, a class of candidates keeps the tallies of what it met,
    and its rows take them over. Pairs by session alone are made of rows, as a session and request are few; so are those chosen."""
    right = right.withColumns({c: F.lit(None).cast(k) for c, k in (("cached", "boolean"), ("artifact", "string")) if c not in right.columns})
    kept = ("artifact", "actual", "cached")
    (lc, lm), (rc, _) = identity_classes(left), identity_classes(right, *kept)
    of = lambda by, n, first: [by, n.alias("n"), first.alias("first"), *(F.col(f"r_{k}").alias(k) for k in kept), *_GRADES]
    by_class = _tallies(class_match(lc, rc, "Strong", *kept).select(*of("l_cls", F.col("r_n"), F.col("r_cls"))), "l_cls")
    by_class = by_class.join(lm.select(F.col("id").alias("l_id"), F.col("cls").alias("l_cls")), "l_cls").drop("l_cls")
    by_row = _tallies(_by_session(left, right, *kept).select(*of("l_id", F.lit(1).cast("long"), F.col("r_id"))), "l_id")
    both = by_class.unionByName(by_row)
    picked = named_pairs(left, right, selections.select("l_id", F.col("chosen").alias("r_id")), *kept).select("l_id", "r_id", *(F.col(f"r_{k}").alias(k) for k in kept), *_GRADES)
    return _decided(both.groupBy("l_id").agg(*_pooled(), F.max("against").alias("against")), _chosen(picked, selections))


def manual_selection_valid(candidates: DataFrame, matches: DataFrame, selections: DataFrame) -> DataFrame:
    """selections of candidates that are still undecided without them, for a statement that is a matched one."""
    open_ = candidates.where("state in ('ambiguous', 'selected')").select("l_id")
    listed = matches.where("matched").select("l_id", F.col("r_id").alias("chosen")).distinct()
    return selections.join(open_, "l_id", "left_semi").join(listed, ["l_id", "chosen"], "left_semi")


def correlated_evidence(matches: DataFrame, sessions: DataFrame) -> DataFrame:
    """Artifacts tied to the root: of its session, or with a match better than Candidate."""
    by_id = matches.where(F.col("matched") & (quality_rank(F.col("quality")) > 1)).select(F.col("l_id").alias("artifact_id"))
    return by_id.union(sessions.select("artifact_id")).distinct()
