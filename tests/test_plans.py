"""The reader of plan documents and the walks over its operators, as jobs."""

import pytest

from loadlens.operators import history as H
from loadlens.plans import shred as P
from loadlens.plans.reader import shred_one

XML = """<ShowPlanXML><StmtCond StatementText="o"><Warnings SpillToTempDb="1"/><RelOp NodeId="1" PhysicalOp="Hash Match"><RelOp NodeId="2" PhysicalOp="Scan"/></RelOp>
<StmtSimple StatementText="i"><RelOp NodeId="3" PhysicalOp="Sort"><Warnings><SortSpillDetails WritesToTempDb="4"/></Warnings></RelOp></StmtSimple></StmtCond></ShowPlanXML>"""


def test_only_what_is_asked_for_is_read():
    whole = shred_one(XML)
    for kinds in (("reject",), ("operator",), ("statement",)):
        of = [r for r in whole if r["kind"] in kinds]
        assert shred_one(XML, None, kinds) == of
        assert shred_one(XML, ("warnings",), kinds) == [{k: r[k] for k in ("kind", "statement_no", "warnings")} for r in of]
    assert [shred_one(x, (), ("reject",)) for x in ("<a>", "<a/>", "<ShowPlanXML/>", XML)] == [[{"kind": "reject", "reject": why}] for why in ("malformed", "wrong root", "no statement")] + [[]]


def test_shred_makes_the_columns_asked_for(spark):
    plans = spark.createDataFrame([(1, XML), (2, "<a>"), (3, None)], "plan_id long, xml string")
    assert P.shred(plans, columns=("node_id", "spills"), kinds=("operator",)).columns == ["plan_id", "reject", "statement_no", "node_id", "kind", "spills"]
    whole = P.shred(plans).where("kind = 'operator' and size(spills) > 0")
    assert sorted((r.plan_id, r.node_id, r.spills[0].kind, r.spills[0].raw) for r in whole.collect()) == [("1", 3, "Sort", {"WritesToTempDb": "4"})] * 2
    assert sorted((r.plan_id, r.reject) for r in P.shred(plans, columns=(), kinds=("reject",)).collect()) == [("2", "malformed"), ("3", "empty")]


@pytest.mark.parametrize("walk", ["feeding", "nearest"])
def test_walks_down_a_plan_join_and_broadcast_nothing(spark, walk):
    """The size of what a reader gives is not known to Spark, which then sends operators of all documents to the driver."""
    rows = [(1, 1, True, 10.0, 20_000.0, None, []), (1, 2, False, 1.0, 30_000.0, "a", [1]), (1, 3, True, 1.0, 90_000.0, "b", [2, 1]), (1, 4, False, 5.0, 5.0, "c", [3, 2, 1]), (2, 1, True, 5.0, 5.0, None, []), (2, 2, False, 5.0, 5.0, "a", [1]), (2, 3, False, 5.0, 5.0, "b", [1])]
    ops = spark.createDataFrame(rows, "statement_id long, node_id int, spilled boolean, estimated_rows double, actual_rows double, object_name string, ancestors array<int>")
    out = P.feeding_estimate_error(ops) if walk == "feeding" else H.nearest_target(ops, ops.where("spilled").select("statement_id", "node_id"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan
    want = [(1, 1, 3, 2, 90_000.0)] if walk == "feeding" else [(1, 1, "a", "Nearest access"), (1, 3, "b", "Exact")]
    assert sorted(tuple(r) for r in out.collect()) == want


def test_documents_shuffle_their_rows_once(spark):
    from loadlens.catalog import plans
    from loadlens.sources.views import Views

    plan = plans.documents(Views(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
