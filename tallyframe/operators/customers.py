"""Customer analyses (survey §2.4), bulk over all customers.

Per-customer choices (modal country, favourite product) use ``min_by`` over a
(−count, key) struct: an ordinary aggregate with partial aggregation, so one
customer holding a third of all lines does not end up in a single task unreduced.
The reference date is the latest timestamp of any dated line, computed once as a
one-row aggregate and broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe import schema as S
from tallyframe.functions.cols import (rnd, positive, day_key, div, elapsed_days, eq_ci, is_return, is_sale, money,
                                       month_index, month_key_from_index, sum0)
from tallyframe.functions.ordered import top_k
from tallyframe.functions.stats import sample_std

C = F.col
CID = S.CUSTOMER_ID


def _customers(sales: DataFrame) -> DataFrame:
    return sales.filter(C(CID).isNotNull())


def _is_customer(sales: DataFrame, customer_id: int | str) -> F.Column:
    """Ids are numbers or texts, as the upload has them; the one asked for is read likewise."""
    return C(CID) == F.lit(customer_id).cast(sales.schema[CID].dataType)


def reference_date(sales: DataFrame) -> DataFrame:
    """One row: ``ref`` = latest timestamp over all dated lines (returns included)."""
    return sales.agg(F.max(S.INVOICE_DATE).alias("ref"))


def customer_rollup(sales: DataFrame) -> DataFrame:
    """One row per customer: last / first dated line, distinct invoices, net revenue.

    A shared building block for customer-level signals; invoices are deduplicated
    per (customer, invoice) first, so the count needs no distinct aggregate.
    """
    per_inv = _customers(sales).groupBy(CID, S.INVOICE).agg(
        F.max(S.INVOICE_DATE).alias("l"), F.min(S.INVOICE_DATE).alias("f"), F.sum(S.REVENUE).alias("r"))
    return per_inv.groupBy(CID).agg(F.max("l").alias("last"), F.min("f").alias("first"),
                                    F.count(F.lit(1)).alias("invoices"), F.sum("r").alias("revenue"))


def unique_customers(sales: DataFrame) -> DataFrame:
    return sales.agg(F.count_distinct(CID).alias("unique_customers"))


def top_customer(sales: DataFrame, country: str | None = None, by: tuple = ()) -> DataFrame:
    """Customer with the highest net revenue; ``country`` matches exactly (case-sensitive)."""
    df = _customers(sales)
    if country:
        df = df.filter(C(S.COUNTRY) == country)
    per = df.groupBy(*by, CID).agg(F.sum(S.REVENUE).alias("_rev"))
    out = top_k(per, [C("_rev").desc(), C(CID)], 1, by)
    return out.select(*by, CID, money(C("_rev")).alias("total_revenue_gbp"))


def top_spending_customers(sales: DataFrame, limit: int = 5) -> DataFrame:
    per = _customers(sales).filter(is_sale()).groupBy(CID).agg(F.sum(S.REVENUE).alias("_rev"))
    return top_k(per, [C("_rev").desc(), C(CID)], limit).select(CID, money(C("_rev")).alias("total_spend_gbp"))


def customer_profiles(sales: DataFrame, customer_id: int | str | None = None) -> DataFrame:
    """One row per customer: modal country, sales spend, invoices, sales units,
    return lines, favourite product by sales units, first / last purchase day."""
    df = _customers(sales)
    if customer_id is not None:
        df = df.filter(_is_customer(df, customer_id))
    base = df.groupBy(CID).agg(
        money(sum0(F.when(is_sale(), C(S.REVENUE)))).alias("total_spend_gbp"),
        F.count_distinct(S.INVOICE).alias("total_orders"),
        sum0(F.when(is_sale(), C(S.QUANTITY))).cast("bigint").alias("total_items_bought"),
        F.count_if(is_return()).alias("refund_transactions"),
        day_key(F.min(S.INVOICE_DATE)).alias("first_purchase"),
        day_key(F.max(S.INVOICE_DATE)).alias("last_purchase"))
    ctry = (df.filter(C(S.COUNTRY).isNotNull()).groupBy(CID, S.COUNTRY).agg(F.count(F.lit(1)).alias("n"))
            .groupBy(CID).agg(F.min_by(S.COUNTRY, F.struct(-C("n"), C(S.COUNTRY))).alias("country")))
    fav = (df.filter(is_sale() & C(S.DESCRIPTION).isNotNull()).groupBy(CID, S.DESCRIPTION)
           .agg(F.sum(S.QUANTITY).alias("u"))
           .groupBy(CID).agg(F.min_by(S.DESCRIPTION, F.struct(-C("u"), C(S.DESCRIPTION))).alias("favorite_product")))
    out = base.join(ctry, CID, "left").join(fav, CID, "left")
    return out.select(CID, "country", "total_spend_gbp", "total_orders", "total_items_bought",
                      "refund_transactions", "favorite_product", "first_purchase", "last_purchase")


def customer_orders(sales: DataFrame, customer_id: int | str | None = None) -> DataFrame:
    """Per (customer, invoice): first day, net revenue, net units; revenue > 0 only."""
    df = _customers(sales)
    if customer_id is not None:
        df = df.filter(_is_customer(df, customer_id))
    per = df.groupBy(CID, S.INVOICE).agg(
        day_key(F.min(S.INVOICE_DATE)).alias("date"), F.sum(S.REVENUE).alias("_rev"),
        F.sum(S.QUANTITY).cast("bigint").alias("items_bought"))
    return per.filter(C("_rev") > 0).select(CID, S.INVOICE, "date", money(C("_rev")).alias("total_revenue_gbp"),
                                            "items_bought")


def customer_product_units(sales: DataFrame, customer_id: int | str | None = None, product: str | None = None) -> DataFrame:
    """Bought, returned and kept units per (customer, lower-cased product)."""
    df = _customers(sales).filter(C(S.DESCRIPTION).isNotNull())
    if customer_id is not None:
        df = df.filter(_is_customer(df, customer_id))
    if product is not None:
        df = df.filter(eq_ci(S.DESCRIPTION, product))
    per = df.groupBy(CID, F.lower(S.DESCRIPTION).alias("product")).agg(
        sum0(F.when(is_sale(), C(S.QUANTITY))).cast("bigint").alias("total_units_bought"),
        F.abs(sum0(F.when(is_return(), C(S.QUANTITY)))).cast("bigint").alias("total_units_returned"))
    return per.withColumn("net_units_kept", C("total_units_bought") - C("total_units_returned"))


def vip_customers(sales: DataFrame, min_orders: int = 5, min_spend: float = 1000.0) -> DataFrame:
    """Invoices ≥ min_orders and net spend ≥ min_spend."""
    per = _customers(sales).groupBy(CID).agg(F.count_distinct(S.INVOICE).alias("total_orders"),
                                            F.sum(S.REVENUE).alias("_rev"))
    return (per.filter((C("total_orders") >= min_orders) & (C("_rev") >= F.lit(min_spend)))
            .select(CID, "total_orders", money(C("_rev")).alias("total_spend_gbp")))


def new_customers_by_month(sales: DataFrame, by: tuple = ()) -> DataFrame:
    """Customers counted in the month of their first dated line (per group of ``by``)."""
    first = (_customers(sales).filter(C(S.INVOICE_DATE).isNotNull()).groupBy(*by, CID)
             .agg(F.min(S.INVOICE_DATE).alias("first")))
    return (first.groupBy(*by, F.date_format("first", "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("new_customers")))


def ref_scalar(sales: DataFrame) -> F.Column:
    """The reference date as a scalar subquery (evaluated once, no join)."""
    return reference_date(sales.filter(C(S.INVOICE_DATE).isNotNull())).scalar()


def _last_seen(sales: DataFrame) -> DataFrame:
    dated = _customers(sales).filter(C(S.INVOICE_DATE).isNotNull())
    last = dated.groupBy(CID).agg(F.max(S.INVOICE_DATE).alias("last"))
    return last.withColumn("ref", ref_scalar(sales))


def churn_risk_summary(sales: DataFrame, days: int = 90, by: tuple = ()) -> DataFrame:
    """Customers whose last dated line is ≥ ``days`` before the reference date.

    With ``by`` (a tenant or country column) each group is summarised against its
    own reference date, in one job.
    """
    if by:
        dated = _customers(sales).filter(C(S.INVOICE_DATE).isNotNull())
        last = dated.groupBy(*by, CID).agg(F.max(S.INVOICE_DATE).alias("last"))
        refs = dated.groupBy(*by).agg(F.max(S.INVOICE_DATE).alias("ref"))
        ls = last.join(refs, list(by)).withColumn("idle", elapsed_days(C("last"), C("ref")))
        return ls.groupBy(*by).agg(
            day_key(F.first("ref")).alias("reference_date"), F.lit(int(days)).alias("days_inactive_threshold"),
            F.count(F.lit(1)).alias("total_customers"), F.count_if(C("idle") >= days).alias("at_risk_customers"),
            (F.count(F.lit(1)) - F.count_if(C("idle") >= days)).alias("healthy_customers"),
            rnd(F.coalesce(div(F.count_if(C("idle") >= days) * 100, F.count(F.lit(1))), F.lit(0.0)), 1)
            .alias("churn_risk_pct"))
    ls = _last_seen(sales).withColumn("idle", elapsed_days(C("last"), C("ref")))
    return ls.agg(
        day_key(F.first("ref")).alias("reference_date"),
        F.lit(int(days)).alias("days_inactive_threshold"),
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(C("idle") >= days).alias("at_risk_customers"),
        (F.count(F.lit(1)) - F.count_if(C("idle") >= days)).alias("healthy_customers"),
        rnd(F.coalesce(div(F.count_if(C("idle") >= days) * 100, F.count(F.lit(1))), F.lit(0.0)), 1)
        .alias("churn_risk_pct"))


def at_risk_customers(sales: DataFrame, days: int = 90, limit: int | None = 15, spend: str = "pos") -> DataFrame:
    """At-risk customers by spend descending. ``spend='pos'`` sums sales lines only;
    ``spend='net'`` includes returns (both variants exist in the reference)."""
    ls = _last_seen(sales).withColumn("idle", elapsed_days(C("last"), C("ref"))).filter(C("idle") >= days)
    rev = F.when(is_sale(), C(S.REVENUE)) if spend == "pos" else C(S.REVENUE)
    sp = _customers(sales).groupBy(CID).agg(sum0(rev).alias("_spend"))
    out = ls.join(sp, CID, "left").withColumn("_spend", F.coalesce(C("_spend"), F.lit(0)))
    out = top_k(out, [C("_spend").desc(), C(CID)], limit)
    return out.select(CID, C("idle").alias("days_since_last_purchase"), money(C("_spend")).alias("total_spend_gbp"),
                      day_key(C("last")).alias("last_purchase_date"))


def rfm_features(sales: DataFrame, by: tuple = ()) -> DataFrame:
    """Recency / frequency / monetary features per customer (sales lines, dated).

    recency_days and purchase_span_days are floored elapsed days; purchase_count is
    units; return_rate = return invoices / frequency; std_basket_size is the sample
    sd of invoice totals (0 for one invoice), from exact decimal moment sums.
    """
    keys = list(by)
    dated = sales.filter(C(S.INVOICE_DATE).isNotNull())
    pos = _customers(dated).filter(is_sale())
    inv = pos.groupBy(*keys, CID, S.INVOICE).agg(F.sum(S.REVENUE).cast("decimal(18,2)").alias("r"),
                                          F.min(S.INVOICE_DATE).alias("t0"), F.max(S.INVOICE_DATE).alias("t1"),
                                          F.sum(S.QUANTITY).alias("q"))
    per = inv.groupBy(*keys, CID).agg(
        F.max("t1").alias("last"), F.min("t0").alias("first"), F.count(F.lit(1)).alias("frequency"),
        F.sum("r").alias("mon"), F.sum(C("r") * C("r")).alias("mon2"), F.sum("q").alias("purchase_count"))
    per = per.filter(C("mon") > 0)
    returns = (_customers(sales).filter(is_return()).select(*keys, CID, S.INVOICE).distinct()
               .groupBy(*keys, CID).agg(F.count(F.lit(1)).alias("ret_inv")))
    if keys:
        # each group against its own latest dated line
        refs = dated.groupBy(*keys).agg(F.max(S.INVOICE_DATE).alias("ref"))
        out = per.join(refs, keys).join(returns, [*keys, CID], "left")
    else:
        out = per.withColumn("ref", ref_scalar(dated)).join(returns, CID, "left")
    return out.select(
        *keys, CID,
        elapsed_days(C("last"), C("ref")).alias("recency_days"),
        C("frequency"),
        C("mon").cast("double").alias("monetary"),
        div(C("mon"), C("frequency")).alias("avg_basket_size"),
        C("purchase_count").cast("bigint").alias("purchase_count"),
        F.coalesce(div(F.coalesce(C("ret_inv"), F.lit(0)), C("frequency")), F.lit(0.0)).alias("return_rate"),
        elapsed_days(C("first"), C("last")).alias("purchase_span_days"),
        F.coalesce(sample_std(C("frequency"), C("mon"), C("mon2")), F.lit(0.0)).alias("std_basket_size"))


def customer_clv(sales: DataFrame, months: int = 12, customer_id: int | str | None = None) -> DataFrame:
    """Projected value: AOV(sales invoices) × invoices / max(active_days/30, 1) × months.

    Active days span all of the customer's dated lines, returns included. Customers
    without sales, or whose sales invoices total 0, get no projection.
    """
    months = positive(months, "months")
    df = _customers(sales)
    if customer_id is not None:
        df = df.filter(_is_customer(df, customer_id))
    inv = df.filter(is_sale()).groupBy(CID, S.INVOICE).agg(F.sum(S.REVENUE).alias("r"))
    per = inv.groupBy(CID).agg(F.count(F.lit(1)).alias("orders"), F.sum("r").alias("hist"))
    span = df.groupBy(CID).agg(F.min(S.INVOICE_DATE).alias("f"), F.max(S.INVOICE_DATE).alias("l"))
    j = per.join(span, CID).withColumn("aov", div(C("hist"), C("orders"))).filter(C("aov") != 0)
    active_days = F.coalesce(elapsed_days(C("f"), C("l")), F.lit(0))
    active_months = F.greatest(active_days.cast("double") / F.lit(30.0), F.lit(1.0))
    j = j.withColumn("ad", active_days).withColumn("am", active_months)
    ppm = C("orders").cast("double") / C("am")
    proj = ppm * F.lit(float(months))
    return j.select(
        CID, money(C("hist")).alias("historical_spend_gbp"), C("orders").alias("total_historical_orders"),
        rnd(C("aov"), 2).alias("avg_order_value_gbp"), rnd(C("am"), 1).alias("active_months"),
        rnd(ppm, 2).alias("purchases_per_month"), rnd(proj, 1).alias("projected_orders"),
        rnd(C("aov") * proj, 2).alias("projected_clv_gbp"),
        ((C("orders") == 1) | (C("ad") == 0)).alias("insufficient_history"))


def cohort_retention(sales: DataFrame, max_cohorts: int = 6, max_index: int = 6, by: tuple = ()) -> DataFrame:
    """Acquisition-month cohorts (first dated sales line) and the % of each cohort
    active 0..6 months later. Keeps cohorts with any later activity, then the last
    ``max_cohorts`` of them, then those with at least two points in months 0..6.

    Lines are reduced to distinct (customer, month) pairs before anything else, and
    each customer's cohort comes from an aggregate joined back (no window over
    lines), so the work stays partitioned by customer.
    """
    max_cohorts = positive(max_cohorts, "max_cohorts")
    keys = list(by)
    cm = (_customers(sales).filter(is_sale() & C(S.INVOICE_DATE).isNotNull())
          .select(*keys, CID, month_index().alias("m")).distinct())
    first = cm.groupBy(*keys, CID).agg(F.min("m").alias("cohort_m"))
    idx = cm.join(first, [*keys, CID]).withColumn("k", C("m") - C("cohort_m"))
    counts = idx.groupBy(*keys, "cohort_m", "k").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy(*keys, "cohort_m").agg(
        F.sum(F.when(C("k") == 0, C("n"))).alias("size"),
        F.max("k").alias("max_k"),
        *[F.sum(F.when(C("k") == i, C("n"))).alias(f"c{i}") for i in range(max_index + 1)])
    followed = per.filter(C("max_k") >= 1)
    last = top_k(followed, [C("cohort_m").desc()], max_cohorts, keys)
    pct = [rnd(div(C(f"c{i}") * 100, C("size")), 1).alias(f"month_{i}") for i in range(max_index + 1)]
    points = sum((F.when(C(f"c{i}").isNotNull(), F.lit(1)).otherwise(F.lit(0)) for i in range(max_index + 1)),
                 F.lit(0))
    return (last.filter(points >= 2)
            .select(*keys, month_key_from_index(C("cohort_m")).alias("cohort"), C("size").alias("cohort_size"), *pct))


def repeat_purchase_probability(sales: DataFrame) -> DataFrame:
    per = (_customers(sales).select(CID, S.INVOICE).distinct().groupBy(CID).agg(F.count(F.lit(1)).alias("n")))
    rep = F.count_if(C("n") > 1)
    return per.agg(
        F.count(F.lit(1)).alias("total_customers"), rep.alias("returned_for_second_purchase"),
        rnd(F.coalesce(div(rep * 100, F.count(F.lit(1))), F.lit(0.0)), 1).alias("repeat_purchase_probability_pct"),
        rnd(F.coalesce(div(F.sum(F.when(C("n") > 1, C("n"))), rep), F.lit(0.0)), 1)
        .alias("avg_orders_per_returning_customer"))

