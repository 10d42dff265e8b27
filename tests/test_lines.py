"""Outcome lines: no step is worked out more than once."""

from boutline.plans import QUERIES


def test_the_plan_of_the_outcome_lines_has_each_logarithm_once(spark):
    """Two corners, three methods, three tallies: 18 logarithms, in no filter and in no second column."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = QUERIES["m07_outcomes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("LOG(") + plan.count("ln(") == 18
