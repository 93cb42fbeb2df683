"""Cases over the tables at hand."""

from loadlens import catalog


def test_every_finding_with_a_profile_starts_a_case(spark):
    q, sf = catalog.queries(), "/root/testdata/sf0.001"
    cases = {r.case_id for r in q["initial_assertions"](spark, sf).select("case_id").distinct().collect()}
    found = q["profile_routing"](spark, sf).where("profile is not null").selectExpr("concat(rule_id, ':', subject) as c").distinct().collect()
    assert len(found) > 165 and {r.c for r in found} <= cases
