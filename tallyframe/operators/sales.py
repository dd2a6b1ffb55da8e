"""Sales KPIs, rankings and calendar time series (survey §2.2).

Conventions: *pos* = lines with quantity > 0, *net* = all lines. Money is summed as
DECIMAL and handed out as DOUBLE rounded to pence. Every operator accepts ``by``
group keys (for example ``("country",)`` or a tenant column) so that a per-entity
question becomes one job over all entities.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe import schema as S
from tallyframe.functions.cols import (rnd, contains_ci, day_key, day_name, dbl, div, elapsed_days, eq_ci, is_return,
                                       is_sale, money, month_index, month_key, sum0, weekday_mon0)
from tallyframe.functions.ordered import global_lag, global_running, top_k
from tallyframe.functions.spine import fill_days, fill_months_by
from tallyframe.functions.stats import pct_change, sample_std

C = F.col


def _agg(df: DataFrame, by: Sequence[str], *exprs) -> DataFrame:
    return df.groupBy(*by).agg(*exprs) if by else df.agg(*exprs)


def _country(df: DataFrame, country: str | None) -> DataFrame:
    return df.filter(eq_ci(S.COUNTRY, country)) if country else df


# ── scalar KPIs ──────────────────────────────────────────────────────────────

def total_revenue(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _agg(sales, by, money(sum0(F.when(is_sale(), C(S.REVENUE)))).alias("total_revenue"))


def total_orders(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct invoices, refund invoices included."""
    return _agg(sales, by, F.count_distinct(S.INVOICE).alias("total_orders"))


def total_items_sold(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _agg(sales, by, sum0(F.when(is_sale(), C(S.QUANTITY))).cast("bigint").alias("total_items_sold"))


def aov_overall(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sales revenue / all distinct invoices (0 when there are none)."""
    rev = sum0(F.when(is_sale(), C(S.REVENUE)))
    n = F.count_distinct(S.INVOICE)
    return _agg(sales, by, F.coalesce(div(rev, n), F.lit(0.0)).alias("aov"))


def aov_positive_invoices(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean net revenue of invoices whose net revenue is positive."""
    inv = sales.groupBy(*by, S.INVOICE).agg(F.sum(S.REVENUE).alias("inv_rev")).filter(C("inv_rev") > 0)
    return _agg(inv, by, rnd(F.coalesce(div(F.sum("inv_rev"), F.count(F.lit(1))), F.lit(0.0)), 2).alias("aov_positive_invoices"))


def average_item_price(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean unit price over all lines."""
    return _agg(sales, by, rnd(div(F.sum(S.PRICE), F.count(S.PRICE)), 2).alias("average_item_price"))


def refund_rate(sales: DataFrame, country: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Return lines / all lines × 100 (0 when nothing matches)."""
    df = _country(sales, country)
    return _agg(df, by, F.coalesce(div(F.count_if(is_return()) * 100, F.count(F.lit(1))), F.lit(0.0)).alias("refund_rate_pct"))


def refund_rate_by_country(sales: DataFrame) -> DataFrame:
    return refund_rate(sales.filter(C(S.COUNTRY).isNotNull()), by=(S.COUNTRY,))


# ── rankings ─────────────────────────────────────────────────────────────────

def top_countries_by_revenue(sales: DataFrame, limit: int = 5, by: Sequence[str] = ()) -> DataFrame:
    per = (sales.filter(C(S.COUNTRY).isNotNull()).groupBy(*by, S.COUNTRY)
           .agg(F.sum(S.REVENUE).alias("_rev")))
    out = top_k(per, [C("_rev").desc(), C(S.COUNTRY)], limit, by)
    return out.select(*by, S.COUNTRY, money(C("_rev")).alias("revenue"))


def country_revenue(sales: DataFrame, country: str | None = None) -> DataFrame:
    """Net revenue of one country (case-insensitive) or of every country."""
    df = _country(sales.filter(C(S.COUNTRY).isNotNull()), country)
    return df.groupBy(S.COUNTRY).agg(money(F.sum(S.REVENUE)).alias("total_revenue_gbp"))


def top_country_by_lines(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    per = sales.filter(C(S.COUNTRY).isNotNull()).groupBy(*by, S.COUNTRY).agg(F.count(F.lit(1)).alias("lines"))
    return top_k(per, [C("lines").desc(), C(S.COUNTRY)], 1, by)


def top_products_by_revenue(sales: DataFrame, limit: int = 5, country: str | None = None,
                            by: Sequence[str] = ()) -> DataFrame:
    df = _country(sales, country).filter(is_sale() & C(S.DESCRIPTION).isNotNull())
    per = df.groupBy(*by, S.DESCRIPTION).agg(F.sum(S.REVENUE).alias("_rev"))
    out = top_k(per, [C("_rev").desc(), C(S.DESCRIPTION)], limit, by)
    return out.select(*by, S.DESCRIPTION, money(C("_rev")).alias("revenue"))


def top_products_in_period(sales: DataFrame, month: str, limit: int = 5) -> DataFrame:
    """Top products by sales revenue within one calendar month 'yyyy-MM'."""
    y, m = (int(x) for x in month.split("-"))
    start = date(y, m, 1)
    end = date(y + (m == 12), m % 12 + 1, 1)
    df = sales.filter((C(S.INVOICE_DATE) >= F.lit(start).cast("timestamp")) &
                      (C(S.INVOICE_DATE) < F.lit(end).cast("timestamp")))
    return top_products_by_revenue(df, limit)


def customers_by_country(sales: DataFrame, country: str | None = None) -> DataFrame:
    df = _country(sales.filter(C(S.COUNTRY).isNotNull()), country)
    return df.groupBy(S.COUNTRY).agg(F.count_distinct(S.CUSTOMER_ID).alias("unique_customers"))


def orders_by_country(sales: DataFrame, limit: int = 3) -> DataFrame:
    per = (sales.filter(C(S.COUNTRY).isNotNull()).groupBy(S.COUNTRY)
           .agg(F.count_distinct(S.INVOICE).alias("orders")))
    return top_k(per, [C("orders").desc(), C(S.COUNTRY)], limit)


def revenue_by_year(sales: DataFrame) -> DataFrame:
    """Sales revenue per calendar year (undated lines are in no year)."""
    return (sales.filter(is_sale() & C(S.INVOICE_DATE).isNotNull())
            .groupBy(F.year(S.INVOICE_DATE).alias("year"))
            .agg(money(F.sum(S.REVENUE)).alias("total_revenue")))


# ── calendar breakdowns ──────────────────────────────────────────────────────

def monthly_revenue(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Net revenue per calendar month; only months with lines, undated lines dropped."""
    return (sales.filter(C(S.INVOICE_DATE).isNotNull())
            .groupBy(*by, month_key().alias("month"))
            .agg(money(F.sum(S.REVENUE)).alias("revenue")))


def revenue_by_date_range(sales: DataFrame, start: str, end: str, strict: bool = False) -> DataFrame:
    """Net revenue for start ≤ date ≤ end (whole end day; ``strict`` compares to midnight).

    One row: start_date, end_date, revenue, lines, dataset_start, dataset_end.
    """
    s = F.to_timestamp(F.lit(start))
    end_d = date.fromisoformat(end)
    e_cond = (C(S.INVOICE_DATE) <= F.to_timestamp(F.lit(end))) if strict else \
        (C(S.INVOICE_DATE) < F.lit(end_d + timedelta(days=1)).cast("timestamp"))
    inside = (C(S.INVOICE_DATE) >= s) & e_cond
    return sales.agg(
        F.lit(start).alias("start_date"), F.lit(end).alias("end_date"),
        money(sum0(F.when(inside, C(S.REVENUE)))).alias("revenue"),
        F.count_if(inside).alias("lines"),
        day_key(F.min(S.INVOICE_DATE)).alias("dataset_start"),
        day_key(F.max(S.INVOICE_DATE)).alias("dataset_end"))


def busiest_days_of_week(sales: DataFrame) -> DataFrame:
    return (sales.filter(C(S.INVOICE_DATE).isNotNull())
            .groupBy(day_name().alias("day_of_week")).agg(F.count(F.lit(1)).alias("transactions")))


def units_by_weekday(sales: DataFrame) -> DataFrame:
    """Units sold (sales lines) per weekday, Monday = 0."""
    return (sales.filter(is_sale() & C(S.INVOICE_DATE).isNotNull())
            .groupBy(weekday_mon0().alias("weekday"), day_name().alias("day_of_week"))
            .agg(F.sum(S.QUANTITY).alias("units_sold")))


def hourly_sales(sales: DataFrame) -> DataFrame:
    return (sales.filter(C(S.INVOICE_DATE).isNotNull())
            .groupBy(F.hour(S.INVOICE_DATE).alias("hour"))
            .agg(money(F.sum(S.REVENUE)).alias("revenue")))


def weekend_vs_weekday(sales: DataFrame) -> DataFrame:
    """Net revenue split Monday–Friday vs Saturday–Sunday; undated lines in neither."""
    wk = weekday_mon0()
    dated = C(S.INVOICE_DATE).isNotNull()
    return sales.agg(
        money(sum0(F.when(dated & (wk < 5), C(S.REVENUE)))).alias("weekday_revenue"),
        money(sum0(F.when(dated & (wk >= 5), C(S.REVENUE)))).alias("weekend_revenue"))


# ── month-over-month family (gap-filled series) ─────────────────────────────

def _monthly_series(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    per = (sales.filter(C(S.INVOICE_DATE).isNotNull())
           .groupBy(*by, month_index().alias("month_idx")).agg(F.sum(S.REVENUE).alias("rev")))
    return fill_months_by(per, list(by), ["rev"])


def _growth(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gap-filled monthly net revenue with previous month and % change.

    The lag runs over months (one row per group and calendar month), never lines;
    without ``by`` it is a single small series.
    """
    return _growth_of(_monthly_series(sales, by), by)


def _growth_of(m: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("month_idx") if by else Window.orderBy("month_idx")
    m = m.withColumn("prev", F.lag("rev").over(w))
    return m.withColumn("growth", pct_change(C("rev"), C("prev")))


def mom_growth(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Month-over-month % on the zero-filled series; non-finite changes dropped.
    With ``by``, every group is its own series (its own first/last month)."""
    g = _growth(sales, by).filter(C("growth").isNotNull())
    if by:
        g = g.withColumn("_last", F.max("month_idx").over(Window.partitionBy(*by)))
    else:
        g = g.withColumn("_last", g.agg(F.max("month_idx")).scalar())
    return g.select(*by, "month", money(C("rev")).alias("revenue"), money(C("prev")).alias("prev_revenue"),
                    rnd(C("growth"), 2).alias("growth_pct"), (C("month_idx") == C("_last")).alias("is_latest"))


def latest_mom(sales: DataFrame) -> DataFrame:
    """One row: latest month-over-month % (0.0 when there is none)."""
    return _latest(_growth(sales))


def latest_mom_of(per_month: DataFrame) -> DataFrame:
    """``latest_mom`` from monthly net revenue (month_idx, rev), gaps and all."""
    return _latest(_growth_of(fill_months_by(per_month, [], ["rev"])))


def _latest(growth: DataFrame) -> DataFrame:
    g = growth.filter(C("growth").isNotNull()).agg(F.max_by(rnd(C("growth"), 2), "month_idx")).scalar()
    return growth.sparkSession.range(1).select(F.coalesce(g, F.lit(0.0)).alias("latest_mom"))


def sales_trend(sales: DataFrame) -> DataFrame:
    g = latest_mom(sales)
    return g.select(
        F.when(C("latest_mom") > 0, F.lit("Up")).when(C("latest_mom") < 0, F.lit("Down"))
        .otherwise(F.lit("Stable")).alias("trend"),
        C("latest_mom").alias("growth_pct"))


def revenue_drops(sales: DataFrame, threshold: float = -15.0) -> DataFrame:
    """Months whose change is below ``threshold``; a fall from 0 counts as −∞."""
    g = _growth(sales)
    pct = F.when((C("prev") == 0) & (C("rev") < 0), F.lit(float("-inf"))).otherwise(C("growth"))
    g = g.withColumn("pct", pct)
    return (g.filter(C("pct") < F.lit(float(threshold)))
            .select("month", rnd(C("pct"), 2).alias("growth_pct")))


# ── daily series ─────────────────────────────────────────────────────────────

def _daily_series(sales: DataFrame) -> DataFrame:
    per = (sales.filter(C(S.INVOICE_DATE).isNotNull())
           .groupBy(F.to_date(S.INVOICE_DATE).alias("day")).agg(F.sum(S.REVENUE).alias("rev")))
    return fill_days(per, ["rev"])


def sales_anomalies(sales: DataFrame) -> DataFrame:
    """Days (zero-filled calendar) with revenue > mean + 2 · sample sd."""
    d = _daily_series(sales).withColumn("rev", C("rev").cast("decimal(18,2)"))
    st = d.agg(F.count(F.lit(1)).alias("n"), F.sum("rev").alias("s1"), F.sum(C("rev") * C("rev")).alias("s2"))
    cut = st.select(div(C("s1"), C("n")) + F.lit(2.0) * sample_std(C("n"), C("s1"), C("s2"))).scalar()
    return (d.filter(dbl(C("rev")) > cut)
            .select(F.date_format("day", "yyyy-MM-dd").alias("day"), money(C("rev")).alias("revenue")))


def simple_forecast_7d(sales: DataFrame, days: int = 14) -> DataFrame:
    """Mean of the last ``days`` calendar days × 7; warns when the baseline ends in December."""
    d = _daily_series(sales)
    last = d.orderBy(C("day").desc()).limit(days)
    return last.agg(
        rnd(div(F.sum("rev"), F.count(F.lit(1))) * F.lit(7), 2).alias("forecast_7_day_gbp"),
        F.date_format(F.max("day"), "yyyy-MM-dd").alias("baseline_end"),
        (F.month(F.max("day")) == 12).alias("december_warning"))


# ── concentration ────────────────────────────────────────────────────────────

def pareto_products_count(sales: DataFrame) -> DataFrame:
    """Products, by net revenue descending, whose cumulative share is < 80 %, plus one."""
    per = (sales.filter(C(S.DESCRIPTION).isNotNull()).groupBy(S.DESCRIPTION)
           .agg(F.sum(S.REVENUE).alias("rev")))
    tot = per.agg(F.sum("rev")).scalar()
    ranked = global_running(per, [C("rev").desc(), C(S.DESCRIPTION)], "rev")
    share = div(C("_cum"), tot)
    return (ranked
            .agg((F.count_if(share < F.lit(0.8)) + 1).alias("pareto_products_count")))


def revenue_concentration(sales: DataFrame, top_share: float = 0.10) -> DataFrame:
    """Share of net revenue from the top max(1, ⌊10 % · customers⌋) customers."""
    per = (sales.filter(C(S.CUSTOMER_ID).isNotNull()).groupBy(S.CUSTOMER_ID)
           .agg(F.sum(S.REVENUE).alias("rev")))
    return concentration_of(per, top_share)


def concentration_of(per: DataFrame, top_share: float = 0.10) -> DataFrame:
    """Concentration from a per-customer (customer_id, rev) frame."""
    n = per.agg(F.count(F.lit(1))).scalar()
    tot = per.agg(F.sum("rev")).scalar()
    k = F.greatest(F.lit(1), F.floor(n * F.lit(top_share)).cast("bigint"))
    ranked = global_running(per, [C("rev").desc(), C(S.CUSTOMER_ID)], "rev")
    return ranked.filter(C("_pos") <= k).agg(
        n.alias("customers"), k.alias("top_customers"),
        (div(F.sum("rev"), tot) * F.lit(100.0)).alias("concentration_pct"))


# ── customers (sales view) ───────────────────────────────────────────────────

def repeat_customers_stats(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Customers with more than one distinct invoice: count, %, average invoices."""
    per = (sales.filter(C(S.CUSTOMER_ID).isNotNull()).select(*by, S.CUSTOMER_ID, S.INVOICE).distinct()
           .groupBy(*by, S.CUSTOMER_ID).agg(F.count(F.lit(1)).alias("n")))
    return _agg(per, by,
        F.count_if(C("n") > 1).alias("repeat_customers_count"),
        F.count(F.lit(1)).alias("total_customers"),
        rnd(div(F.count_if(C("n") > 1) * 100, F.count(F.lit(1))), 2).alias("repeat_pct"),
        rnd(F.coalesce(div(F.sum(F.when(C("n") > 1, C("n"))), F.count_if(C("n") > 1)), F.lit(0.0)), 1)
        .alias("avg_orders_per_returning_customer"))


def avg_days_between_purchases(sales: DataFrame) -> DataFrame:
    """Mean floored day gap between a customer's consecutive invoices.

    Lines are first reduced to one row per (customer, invoice) at its earliest
    timestamp (partial aggregation absorbs hot keys). The previous invoice comes
    from a global lag over (customer, time, invoice) computed on range partitions,
    so a customer with a third of all invoices is spread over many tasks.
    """
    inv = (sales.filter(C(S.CUSTOMER_ID).isNotNull() & C(S.INVOICE_DATE).isNotNull())
           .groupBy(S.CUSTOMER_ID, S.INVOICE).agg(F.min(S.INVOICE_DATE).alias("t")))
    lagged = global_lag(inv, [C(S.CUSTOMER_ID), C("t"), C(S.INVOICE)], [S.CUSTOMER_ID, "t"])
    gaps = lagged.filter(C(f"_prev_{S.CUSTOMER_ID}") == C(S.CUSTOMER_ID))
    g = gaps.select(elapsed_days(C("_prev_t"), C("t")).alias("gap"))
    return g.agg(F.coalesce(div(F.sum("gap"), F.count("gap")), F.lit(0.0)).alias("avg_days_between_purchases"))


# ── product search ───────────────────────────────────────────────────────────

def product_family_revenue(sales: DataFrame, keyword: str) -> DataFrame:
    """Literal keyword family: net revenue, sales units, distinct matching products."""
    fam = sales.filter(contains_ci(S.DESCRIPTION, keyword))
    return fam.agg(
        F.lit(keyword).alias("keyword"),
        F.count_distinct(S.DESCRIPTION).alias("matching_products_count"),
        money(sum0(C(S.REVENUE))).alias("total_revenue_gbp"),
        sum0(F.when(is_sale(), C(S.QUANTITY))).cast("bigint").alias("total_units_sold"))


def product_family_top(sales: DataFrame, keyword: str, limit: int = 10) -> DataFrame:
    fam = sales.filter(contains_ci(S.DESCRIPTION, keyword))
    per = fam.groupBy(S.DESCRIPTION).agg(F.sum(S.REVENUE).alias("_rev"))
    return top_k(per, [C("_rev").desc(), C(S.DESCRIPTION)], limit).select(
        S.DESCRIPTION, money(C("_rev")).alias("revenue"))


def bought_together(sales: DataFrame, product: str, limit: int = 3) -> DataFrame:
    """Other products on sales invoices that contain ``product``, by line count."""
    pos = sales.filter(is_sale())
    invs = pos.filter(C(S.DESCRIPTION) == product).select(S.INVOICE).distinct()
    basket = pos.join(invs, S.INVOICE, "left_semi").filter(C(S.DESCRIPTION) != product)
    per = basket.groupBy(S.DESCRIPTION).agg(F.count(F.lit(1)).alias("lines"))
    return top_k(per, [C("lines").desc(), C(S.DESCRIPTION)], limit)


def search_products(sales: DataFrame, query: str, limit: int = 10) -> DataFrame:
    hits = sales.filter(contains_ci(S.DESCRIPTION, query)).select(S.DESCRIPTION).distinct()
    return hits.orderBy(S.DESCRIPTION).limit(limit)

