"""Related findings, whole and by classes, against brute force."""

from collections import Counter

from loadlens.operators import correlation as K
from loadlens.operators import rules as R


def test_related_by_classes_is_all_of_them(spark):
    found = [("PLAN-A", f"statement {i}:node {n}", "High" if n % 2 else "Low", "High", float(n)) for i in range(3) for n in range(4)] + [("PLAN-B", f"statement {i}", "Medium", "High", 1.0) for i in range(3)]
    found += [("WIA-WAIT", x, "High", "Low", 5.0) for x in "abc"] + [("WIA-RESOURCE", "a", "Low", "Low", 2.0), ("WIA-TRANSACTION", "alone", "Low", "Low", 2.0)]
    members = [(r, s, "statement", int(s[10])) for r, s, *_ in found if r.startswith("PLAN")] + [(r, s, "row", int(s[10])) for r, s, *_ in found if r.startswith("PLAN") and s[10] != "2"]
    members += [("WIA-WAIT", "a", "row", 0), ("WIA-WAIT", "a", "row", 7), ("WIA-WAIT", "b", "row", 0), ("WIA-WAIT", "b", "row", 7), ("WIA-WAIT", "c", "row", 7), ("WIA-RESOURCE", "a", "row", 1), ("WIA-TRANSACTION", "alone", "row", 99)]
    f = spark.createDataFrame(found, "rule_id string, subject string, severity string, confidence string, impact double")
    m = spark.createDataFrame(members, "rule_id string, subject string, kind string, evidence long")
    want = set()
    rests = lambda who: {x[2:] for x in members if x[:2] == who}
    for a in found:
        near = [(b, rests(a[:2]) & rests(b[:2])) for b in found if b[:2] != a[:2]]
        near = sorted(((b, x) for b, x in near if x), key=lambda z: (-R.SEVERITIES[z[0][2]], -R.CONFIDENCES[z[0][3]], -z[0][4], *z[0][:2]))
        for place, (b, x) in enumerate(near, 1):
            kinds, mixed = {k for k, _ in x}, a[0].startswith("PLAN") != b[0].startswith("PLAN")
            why = "Embedded plan from the affected activity row" if "row" in kinds and mixed else "Shares activity and statement evidence" if len(kinds) > 1 else "Shares affected activity rows" if "row" in kinds else "Shares execution-plan statement evidence"
            want.add((*a[:2], *b[:2], why, place))
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(R.related_findings(f, m, None)) == sorted(want)
    assert got(R.related_findings(f, m, 2)) == sorted(x for x in want if x[5] <= 2)
    keys = Counter((*x[:2], x[4]) for x in want)
    assert got(R.related_counts(f, m)) == sorted((*k, n, sum((*x[:2], x[4]) == k and x[2].startswith("PLAN") for x in want), max(x[5] for x in want if (*x[:2], x[4]) == k)) for k, n in keys.items())


def test_all_holders_of_a_resource_are_matched(spark):
    locks = spark.createDataFrame([(s, st, "OBJECT", 1, 5, None) for s, st in ((1, "GRANT"), (2, "GRANT"), (7, "GRANT"), (3, "WAIT"), (7, "WAIT"))], "session_id long, request_status string, resource_type string, database_id long, entity_id long, description string")
    pairs = lambda *roots: sorted((r.holder, r.waiter) for r in K.lock_resource_match(locks, *roots).collect())
    assert pairs() == [(1, 3), (1, 7), (2, 3), (2, 7), (7, 3)]
    assert pairs(locks.where("session_id = 7").select("session_id")) == [(7, 3)]


def test_pairs_of_a_hot_resource_are_made_by_blocks(spark):
    rows = [(s, "GRANT" if s % 3 else "WAIT", "KEY", 1, 5, "(k)") for s in range(60)] + [(s, "WAIT", "KEY", 1, 5, "(k)") for s in range(5)] + [(s, "WAIT", "KEY", 1, 5, None) for s in range(9)]
    locks = spark.createDataFrame(rows, "session_id long, request_status string, resource_type string, database_id long, entity_id long, description string")
    holders, waiters = {r[0] for r in rows if r[1] == "GRANT"}, {r[0] for r in rows if r[1] == "WAIT" and r[5]}
    got = K.lock_resource_match(locks, size=8)
    assert sorted((r.holder, r.waiter) for r in got.collect()) == sorted((h, w) for h in holders for w in waiters if h != w)
    # rows of pairs come of blocks, after the last join
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(waiters") < plan.index("Join")
