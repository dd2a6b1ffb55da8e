"""Composite frames: the dashboard KPI row and charts, prediction panels.

Each composite is one DataFrame over the shared (materialized) sales table; KPIs
are scalar subqueries, charts are a long (chart, label, value) frame so that all
panels come back from one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.cols import day_key, div, elapsed_days, money, month_key_from_index, rnd
from tallyframe.functions.ordered import top_k
from tallyframe.operators import customers as cu
from tallyframe.operators import forecast as fc
from tallyframe.operators import products as pr
from tallyframe.operators import rollup as ro
from tallyframe.operators import sales as sa

C = F.col


def dashboard_kpis(sales: DataFrame) -> DataFrame:
    """One row: revenue, orders, items, AOV, refund rate, latest MoM, records
    (non-finite values reported as 0)."""
    spark = sales.sparkSession
    kp = sales.agg(F.count(F.lit(1)).alias("records"))
    return spark.range(1).select(
        sa.total_revenue(sales).select("total_revenue").scalar().alias("total_revenue"),
        sa.total_orders(sales).select("total_orders").scalar().alias("total_orders"),
        sa.total_items_sold(sales).select("total_items_sold").scalar().alias("total_items"),
        sa.aov_overall(sales).select("aov").scalar().alias("aov"),
        sa.refund_rate(sales).select("refund_rate_pct").scalar().alias("refund_rate"),
        sa.latest_mom(sales).select("latest_mom").scalar().alias("mom_growth"),
        kp.select("records").scalar().alias("records"))


def dashboard_kpis_of(r: ro.Rollup) -> DataFrame:
    """``dashboard_kpis`` from the rollup: one aggregate over its invoices and the month series."""
    k = ro.totals(r)
    mom = sa.latest_mom_of(ro.months(r).select("month_idx", "rev")).select("latest_mom").scalar()
    return k.select(
        money(C("sale_revenue")).alias("total_revenue"), C("orders").alias("total_orders"),
        C("sale_units").cast("bigint").alias("total_items"),
        F.coalesce(div(C("sale_revenue"), C("orders")), F.lit(0.0)).alias("aov"),
        F.coalesce(div(C("return_lines") * 100, C("lines")), F.lit(0.0)).alias("refund_rate"),
        mom.alias("mom_growth"), C("lines").cast("bigint").alias("records"))


def dashboard_charts(sales: DataFrame, hourly_source: DataFrame | None = None) -> DataFrame:
    """Monthly revenue, top 5 countries, top 8 products and hourly revenue as
    (chart, label, value) rows. ``hourly_source`` lets hour-of-day come from a
    frame with real times (e.g. purchase events)."""
    hs = hourly_source if hourly_source is not None else sales
    m = sa.monthly_revenue(sales).select(F.lit("monthly_revenue").alias("chart"), C("month").alias("label"),
                                         C("revenue").alias("value"))
    c = sa.top_countries_by_revenue(sales, 5).select(F.lit("top_countries").alias("chart"),
                                                      C("country").alias("label"), C("revenue").alias("value"))
    p = sa.top_products_by_revenue(sales, 8).select(F.lit("top_products").alias("chart"),
                                                     C("description").alias("label"), C("revenue").alias("value"))
    h = sa.hourly_sales(hs).select(F.lit("hourly_sales").alias("chart"),
                                   F.format_string("%d:00", C("hour")).alias("label"), C("revenue").alias("value"))
    return m.unionByName(c).unionByName(p).unionByName(h)


def dashboard_charts_of(r: ro.Rollup, hourly_source: DataFrame) -> DataFrame:
    """``dashboard_charts`` from the rollup; hours, which it has not, come from ``hourly_source``."""
    m = ro.months(r).select(F.lit("monthly_revenue").alias("chart"), month_key_from_index(C("month_idx")).alias("label"),
                            money(C("rev")).alias("value"))

    def best(df: DataFrame, key: str, value: str, chart: str, limit: int) -> DataFrame:
        per = df.filter(C(key).isNotNull()).groupBy(key).agg(F.sum(value).alias("_rev"))
        return top_k(per, [C("_rev").desc(), C(key)], limit).select(
            F.lit(chart).alias("chart"), C(key).alias("label"), money(C("_rev")).alias("value"))

    c = best(r.invoices, "country", "revenue", "top_countries", 5)
    p = best(r.products.filter(C("sale_units") > 0), "description", "sale_revenue", "top_products", 8)
    h = sa.hourly_sales(hourly_source).select(F.lit("hourly_sales").alias("chart"),
                                              F.format_string("%d:00", C("hour")).alias("label"), C("revenue").alias("value"))
    return m.unionByName(c).unionByName(p).unionByName(h)


def prediction_metrics_of(r: ro.Rollup, days: int = 90) -> DataFrame:
    """``prediction_metrics`` from the rollup's customers: one aggregate for all its figures."""
    ref = r.invoices.agg(F.max("last")).scalar()
    dated, repeats = C("last").isNotNull(), C("invoices") > 1
    idle = dated & (elapsed_days(C("last"), ref) >= days)
    n, risky, rep = F.count_if(dated), F.count_if(idle), F.count_if(repeats)
    return ro.customers(r).agg(
        F.when(n > 0, day_key(ref)).alias("reference_date"), F.lit(int(days)).alias("days_inactive_threshold"),
        n.alias("total_customers"), risky.alias("at_risk_customers"), (n - risky).alias("healthy_customers"),
        rnd(F.coalesce(div(risky * 100, n), F.lit(0.0)), 1).alias("churn_risk_pct"),
        rep.alias("returned_for_second_purchase"),
        rnd(F.coalesce(div(rep * 100, F.count(F.lit(1))), F.lit(0.0)), 1).alias("repeat_purchase_probability_pct"),
        rnd(F.coalesce(div(F.sum(F.when(repeats, C("invoices"))), rep), F.lit(0.0)), 1)
        .alias("avg_orders_per_returning_customer"))


def prediction_metrics(sales: DataFrame, days: int = 90) -> DataFrame:
    """Churn summary and repeat-purchase figures in one row."""
    ch = cu.churn_risk_summary(sales, days)
    rp = cu.repeat_purchase_probability(sales)
    return sales.sparkSession.range(1).select(
        *[ch.select(c).scalar().alias(c) for c in ch.columns],
        *[rp.select(c).scalar().alias(c) for c in rp.columns if c != "total_customers"])


def prediction_charts(sales: DataFrame) -> DataFrame:
    """Linear forecast (3 months), top 5 growth products, top 8 slow movers as
    (chart, label, value) rows."""
    f = fc.revenue_forecast_linear(sales, 3).select(F.lit("forecast").alias("chart"), C("month").alias("label"),
                                                    C("predicted_gbp").alias("value"))
    g = pr.high_growth_products(sales, 3, 5).select(F.lit("high_growth").alias("chart"),
                                                    C("description").alias("label"), C("growth_pct").alias("value"))
    s = pr.slow_movers(sales, 3, 8).select(F.lit("slow_movers").alias("chart"), C("description").alias("label"),
                                           C("decline_pct").alias("value"))
    return f.unionByName(g).unionByName(s)


def dashboard_kpis_by(sales: DataFrame, by: tuple) -> DataFrame:
    """The KPI row per group of ``by`` (tenant, country): each KPI is a per-group
    aggregate, joined on the group key; MoM uses each group's own month series."""
    keys = list(by)
    base = sales.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"))
    parts = [sa.total_revenue(sales, by), sa.total_orders(sales, by),
             sa.total_items_sold(sales, by).withColumnRenamed("total_items_sold", "total_items"),
             sa.aov_overall(sales, by), sa.refund_rate(sales, by=by).withColumnRenamed("refund_rate_pct", "refund_rate")]
    out = base
    for p in parts:
        out = out.join(p, keys, "left")
    mom = sa.mom_growth(sales, by).filter(C("is_latest")).select(*keys, C("growth_pct").alias("mom_growth"))
    out = out.join(mom, keys, "left").withColumn("mom_growth", F.coalesce(C("mom_growth"), F.lit(0.0)))
    return out.select(*keys, "total_revenue", "total_orders", "total_items", "aov", "refund_rate", "mom_growth",
                      "records")
