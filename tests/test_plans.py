"""Plan shape: filters reach the scan, no cartesian products, no unpartitioned
windows over lines, global orderings are range-partitioned."""

from __future__ import annotations

import contextlib
import io

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["top_products_in_period", "revenue_by_date_range", "dashboard_kpis",
                                  "customer_profiles", "rfm_features", "signals", "pareto_products_count",
                                  "revenue_concentration", "cohort_retention", "product_pairs_all"])
def test_no_cartesian(spark, name):
    p = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_date_filter_pushed_to_scan(spark):
    df = entry.queries()["top_products_in_period"](spark, SF)
    p = plan(df)
    pushed = p.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "GreaterThanOrEqual(invoice_date" in pushed and "LessThan(invoice_date" in pushed


def test_column_pruning(spark):
    df = entry.queries()["total_orders"](spark, SF)
    p = plan(df)
    assert "ReadSchema: struct<invoice:string,_rule:string>" in p
    assert "IsNull(_rule)" in p.split("PushedFilters: [", 1)[1].split("]", 1)[0]


def test_global_order_is_range_partitioned(spark, monkeypatch):
    """The running sum is computed on range partitions of the order (captured from the
    frame that is checkpointed), and it is exact."""
    from pyspark.sql import functions as F
    import tallyframe.functions.ordered as ordered
    seen = []
    real = ordered._pinned

    def spy(df):
        seen.append(plan(df))
        return real(df)

    monkeypatch.setattr(ordered, "_pinned", spy)
    df = spark.createDataFrame([(i, (i * 7919) % 1000) for i in range(2000)], "k long, v long")
    out = ordered.global_running(df, [F.col("v").desc(), F.col("k")], "v", partitions=6).collect()
    assert seen and "rangepartitioning" in seen[0].lower()
    assert sorted(r["_pos"] for r in out) == list(range(1, 2001))


FLAGGED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def test_no_cartesian_or_python_anywhere(spark):
    """Every SQL-checked query: no cartesian / nested-loop join, no Python UDF node."""
    sql = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if name not in sql:
            continue
        p = plan(fn(spark, "/root/testdata/sf0.001"))
        bad = [f for f in FLAGGED if f in p]
        assert not bad, (name, bad)


def test_dedupe_hashes_on_every_column(spark):
    from tallyframe.operators.clean import audited
    from tallyframe.sources.star import star_sales_raw
    p = plan(audited(star_sales_raw(spark, "/root/testdata/sf0.001")))
    assert ("hashpartitioning(invoice#" in p and "stock_code#" in p.split("hashpartitioning(invoice#", 1)[1].split(")", 1)[0]
            and "customer_id#" in p.split("hashpartitioning(invoice#", 1)[1].split("], ", 1)[0])


def test_sql_views(spark):
    from tallyframe.sources import catalog
    catalog.register_views(spark, "/root/testdata/sf0.001")
    got = spark.sql("SELECT COUNT(DISTINCT invoice) AS n FROM sales").first()["n"]
    assert got == entry.queries()["total_orders"](spark, "/root/testdata/sf0.001").first()["total_orders"]


def test_dimension_broadcast_bound_is_respected(spark):
    from tallyframe.sources.star import star_sales_raw
    spark.conf.set("tallyframe.dim.broadcastRows", "10")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(star_sales_raw(spark, "/root/testdata/sf0.001"))
        # nation keeps its fixed 10k-row bound; customer and part exceed 10 rows → sort-merge joins
        assert "SortMergeJoin" in p
    finally:
        spark.conf.unset("tallyframe.dim.broadcastRows")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
