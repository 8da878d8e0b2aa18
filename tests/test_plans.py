"""Plans: what reaches the scan, and what must not appear."""

import __spark_entry__ as entry


def plan(spark, data, name):
    return entry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_years_reach_the_scan(spark, data):
    p = plan(spark, data, "filter_year_month")
    assert "GreaterThanOrEqual(o_orderdate" in p and "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in p


def test_best_replica_is_limited_early(spark, data):
    assert "WindowGroupLimit" in plan(spark, data, "best_replica_per_time")


def test_no_product_joins(spark, data):
    for name in ("match_fuzzy", "previous_next", "failover", "reduce_catalog", "p1_found", "p3_found", "p4_found"):
        p = plan(spark, data, name)
        assert "CartesianProduct" not in p, name
        if name not in ("match_fuzzy",):  # a scalar row is broadcast there
            assert "BroadcastNestedLoopJoin" not in p, name


def test_patterns_are_matched_once(spark, data):
    assert plan(spark, data, "p4_found").count("rlike") <= 4


def test_workers_find_the_package(spark, data):
    import os

    from weftline.session import table

    table(spark, data, "region")
    root = os.path.dirname(os.path.abspath(entry.__file__))
    assert root in spark.sparkContext.environment["PYTHONPATH"].split(os.pathsep)
