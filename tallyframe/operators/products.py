"""Product analyses (survey §2.3), bulk over all products.

Per-product month series are handled without a spine: the last months of a
product's own zero-filled series are looked up by month index, and least-squares
slopes use closed-form index sums (months without sales contribute 0 to Σxy).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe import schema as S
from tallyframe.functions.cols import (div, eq_ci, is_return, is_sale, month_index, month_key_from_index,
                                       months_before, rnd, sum0)
from tallyframe.functions.ordered import top_k
from tallyframe.functions.spine import fill_months_by
from tallyframe.functions.stats import index_sums, ols_intercept, ols_slope

C = F.col
D = S.DESCRIPTION


def _products(sales: DataFrame) -> DataFrame:
    return sales.filter(C(D).isNotNull())


def top_products_by_quantity(sales: DataFrame, limit: int | None = 10, by: Sequence[str] = ()) -> DataFrame:
    """Net units per product, top N."""
    per = _products(sales).groupBy(*by, D).agg(F.sum(S.QUANTITY).alias("units"))
    return top_k(per, [C("units").desc(), C(D)], limit, by)


def average_price_per_product(sales: DataFrame, limit: int | None = 10) -> DataFrame:
    """Weighted selling price Σrevenue / Σunits over sales lines, top N by that price."""
    per = (_products(sales).filter(is_sale()).groupBy(D)
           .agg(div(F.sum(S.REVENUE), F.sum(S.QUANTITY)).alias("avg_price")))
    return top_k(per, [C("avg_price").desc(), C(D)], limit)


def _monthly_units(sales: DataFrame, base_filter=None) -> DataFrame:
    df = _products(sales).filter(C(S.INVOICE_DATE).isNotNull())
    if base_filter is not None:
        df = df.filter(base_filter)
    return df.groupBy(D, month_index().alias("m")).agg(F.sum(S.QUANTITY).alias("units"))


def _last_months(sales: DataFrame, k: int) -> DataFrame:
    """Per product: first/last month index and units in the last k months of its own
    zero-filled series (u0 = last month, u1 = the one before, ...)."""
    per = _monthly_units(sales)
    bounds = per.groupBy(D).agg(F.min("m").alias("first_m"), F.max("m").alias("last_m"))
    j = per.join(bounds, D)
    aggs = [F.first("first_m").alias("first_m"), F.first("last_m").alias("last_m")]
    for i in range(k):
        aggs.append(sum0(F.when(C("m") == C("last_m") - i, C("units"))).cast("bigint").alias(f"u{i}"))
    return j.groupBy(D).agg(*aggs)


def product_sales_trend(sales: DataFrame, product: str | None = None) -> DataFrame:
    """Last vs previous month of net units on the product's own gap-filled months.

    ``trend`` is 'Up' when the change is positive, 'Down' otherwise (a change from 0
    upward is 'Up'), 'Not enough history' with fewer than two months.
    """
    df = sales.filter(C(D) == product) if product else sales
    t = _last_months(df, 2)
    months = C("last_m") - C("first_m") + 1
    change = F.when(C("u1") != 0, (C("u0") - C("u1")).cast("double") / C("u1").cast("double") * F.lit(100.0))
    trend = (F.when(months < 2, F.lit("Not enough history"))
             .when((C("u1") == 0) & (C("u0") > 0), F.lit("Up"))
             .when(change > 0, F.lit("Up")).otherwise(F.lit("Down")))
    return t.select(D, month_key_from_index(C("last_m")).alias("last_month"),
                    C("u0").alias("last_units"), C("u1").alias("prev_units"),
                    F.when(months >= 2, rnd(change, 2)).alias("change_pct"), trend.alias("trend"))


def product_lifecycle(sales: DataFrame, product: str | None = None) -> DataFrame:
    """Growing / Declining when the last three months strictly rise / fall, else Stable;
    'New Product' with fewer than three months of history."""
    df = sales.filter(C(D) == product) if product else sales
    t = _last_months(df, 3)
    months = C("last_m") - C("first_m") + 1
    status = (F.when(months < 3, F.lit("New Product"))
              .when((C("u0") > C("u1")) & (C("u1") > C("u2")), F.lit("Growing"))
              .when((C("u0") < C("u1")) & (C("u1") < C("u2")), F.lit("Declining"))
              .otherwise(F.lit("Stable")))
    return t.select(D, status.alias("lifecycle"), C("u2").alias("units_m3"), C("u1").alias("units_m2"),
                    C("u0").alias("units_m1"))


def product_return_rate(sales: DataFrame, limit: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """|returned units| / sold units × 100; never returned → 0, returns without sales → 100."""
    per = _products(sales).groupBy(*by, D).agg(
        sum0(F.when(is_sale(), C(S.QUANTITY))).cast("bigint").alias("units_sold"),
        F.abs(sum0(F.when(is_return(), C(S.QUANTITY)))).cast("bigint").alias("units_returned"))
    rate = (F.when(C("units_sold") > 0, C("units_returned") * 100 / C("units_sold"))
            .when(C("units_returned") > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
    out = per.withColumn("return_rate_pct", rate)
    return top_k(out, [C("return_rate_pct").desc(), C(D)], limit, by)


def product_line_refund_rate(sales: DataFrame, declining: DataFrame | None = None,
                             threshold_pct: float = 15.0) -> DataFrame:
    """Return lines / (sale + return lines); > 15 % is a loss risk when promoted, and
    declining plus risky means do not promote. ``declining`` is a frame of
    descriptions (e.g. ``slow_movers``) joined on the product."""
    per = _products(sales).groupBy(D).agg(
        F.count_if(is_sale()).alias("sale_lines"), F.count_if(is_return()).alias("return_lines"))
    tot = C("sale_lines") + C("return_lines")
    out = per.withColumn("refund_rate_pct", F.coalesce(div(C("return_lines") * 100, tot), F.lit(0.0)))
    out = out.withColumn("loss_making_risk", C("refund_rate_pct") > F.lit(threshold_pct))
    if declining is not None:
        dec = declining.select(D).distinct().withColumn("_declining", F.lit(True))
        out = out.join(dec, D, "left").withColumn("declining", F.coalesce(C("_declining"), F.lit(False))).drop("_declining")
    else:
        out = out.withColumn("declining", F.lit(False))
    return out.withColumn("do_not_promote", C("loss_making_risk") & C("declining"))


def product_revenue_share(sales: DataFrame, limit: int | None = 10) -> DataFrame:
    """Product net revenue / total net revenue × 100, top N."""
    per = _products(sales).groupBy(D).agg(F.sum(S.REVENUE).alias("rev"))
    tot = sales.agg(F.sum(S.REVENUE)).scalar()
    out = per.select(D, (div(C("rev"), tot) * F.lit(100.0)).alias("revenue_share_pct"))
    return top_k(out, [C("revenue_share_pct").desc(), C(D)], limit)


def product_popularity(sales: DataFrame, limit: int | None = 10) -> DataFrame:
    """Σ units × distinct invoices (net)."""
    per = _products(sales).groupBy(D).agg(F.sum(S.QUANTITY).alias("units"),
                                         F.count_distinct(S.INVOICE).alias("invoices"))
    out = per.select(D, (C("units").cast("decimal(19,0)") * C("invoices").cast("decimal(19,0)"))
                     .cast("decimal(38,0)").alias("popularity_score"))
    return top_k(out, [C("popularity_score").desc(), C(D)], limit)


def product_purchase_frequency(sales: DataFrame, limit: int | None = 10) -> DataFrame:
    """Share of all invoices that contain the product, × 100."""
    pairs = _products(sales).select(D, S.INVOICE).distinct()
    per = pairs.groupBy(D).agg(F.count(F.lit(1)).alias("invoices"))
    tot = sales.select(S.INVOICE).distinct().agg(F.count(F.lit(1))).scalar()
    out = per.select(D, (div(C("invoices"), tot) * F.lit(100.0)).alias("purchase_frequency_pct"))
    return top_k(out, [C("purchase_frequency_pct").desc(), C(D)], limit)


def best_seller_per_country(sales: DataFrame) -> DataFrame:
    """Product with the most net units in each country (ties: smallest name).

    Chosen with ``min_by`` over (−units, name), an ordinary aggregate, so a country
    with a third of all lines still aggregates partially in every task.
    """
    per = (_products(sales).filter(C(S.COUNTRY).isNotNull())
           .groupBy(S.COUNTRY, D).agg(F.sum(S.QUANTITY).alias("units")))
    best = per.groupBy(S.COUNTRY).agg(F.min_by(F.struct(C(D), C("units")), F.struct(-C("units"), C(D))).alias("b"))
    return best.select(S.COUNTRY, C("b." + D).alias(D), C("b.units").alias("units"))


def product_demand_trend(sales: DataFrame, product: str | None = None) -> DataFrame:
    """OLS slope of monthly sales units over the product's gap-filled months.

    > 5 growing, < −5 declining, otherwise stable; fewer than two months is
    'insufficient data'. Name match is case-insensitive.
    """
    df = sales.filter(eq_ci(D, product)) if product else sales
    per = _monthly_units(df, is_sale())
    bounds = per.groupBy(D).agg(F.min("m").alias("first_m"), F.max("m").alias("last_m"))
    j = per.join(bounds, D)
    agg = j.groupBy(D).agg(
        F.first("first_m").alias("first_m"), F.first("last_m").alias("last_m"),
        F.sum("units").alias("sy"),
        F.sum((C("m") - C("first_m")).cast("bigint") * C("units")).alias("sxy"))
    n = (C("last_m") - C("first_m") + 1).cast("bigint")
    sx, sxx = index_sums(n)
    slope = ols_slope(n, sx, C("sy"), sxx, C("sxy"))
    trend = (F.when(n < 2, F.lit("insufficient data")).when(slope > 5, F.lit("growing"))
             .when(slope < -5, F.lit("declining")).otherwise(F.lit("stable")))
    return agg.select(D, trend.alias("trend"), F.when(n >= 2, rnd(slope, 2)).alias("monthly_slope_units"),
                      C("sy").cast("bigint").alias("total_units_sold"), n.alias("months_of_data"))


def product_demand_months(sales: DataFrame, product: str | None = None) -> DataFrame:
    """The monthly breakdown behind ``product_demand_trend``: units sold in each month from a
    product's first to its last, months without sales as 0."""
    df = sales.filter(eq_ci(D, product)) if product else sales
    filled = fill_months_by(_monthly_units(df, is_sale()), [D], ["units"], "m")
    return filled.select(D, "month", C("units").cast("bigint").alias("units_sold"))


def demand_forecast_by_product(sales: DataFrame, horizon: int = 3) -> DataFrame:
    """Extend each product's monthly unit slope ``horizon`` months (clipped at 0)."""
    per = _monthly_units(sales, is_sale())
    bounds = per.groupBy(D).agg(F.min("m").alias("first_m"), F.max("m").alias("last_m"))
    agg = per.join(bounds, D).groupBy(D).agg(
        F.first("first_m").alias("first_m"), F.first("last_m").alias("last_m"), F.sum("units").alias("sy"),
        F.sum((C("m") - C("first_m")).cast("bigint") * C("units")).alias("sxy"))
    n = (C("last_m") - C("first_m") + 1).cast("bigint")
    sx, sxx = index_sums(n)
    agg = agg.filter(n >= 2).withColumn("slope", ols_slope(n, sx, C("sy"), sxx, C("sxy")))
    agg = agg.withColumn("intercept", ols_intercept(n, sx, C("sy"), C("slope"))).withColumn("n", n)
    h = agg.select("*", F.explode(F.sequence(F.lit(1), F.lit(int(horizon)))).alias("step"))
    pred = C("intercept") + C("slope") * (C("n") - 1 + C("step")).cast("double")
    return h.select(D, month_key_from_index(C("last_m") + C("step")).alias("month"),
                    rnd(F.greatest(pred, F.lit(0.0)), 2).alias("predicted_units"))


def _window_units(sales: DataFrame, months: int, by: Sequence[str] = ()) -> DataFrame:
    """Per product: sales units in [ref − m, ref] and [ref − 2m, ref − m).

    ``ref`` is the latest timestamp of any dated line; both windows are conditional
    sums of one aggregate (no join between the windows).
    """
    dated = sales.filter(C(S.INVOICE_DATE).isNotNull())
    if by:
        # each group against its own latest date (a small per-group table joined back)
        refs = dated.groupBy(*by).agg(F.max(S.INVOICE_DATE).alias("_ref"))
        pos = _products(dated).filter(is_sale()).join(refs, list(by))
        pos = pos.withColumn("cut", months_before(C("_ref"), months))
    else:
        ref = dated.agg(F.max(S.INVOICE_DATE)).scalar()
        pos = _products(dated).filter(is_sale()).withColumn("cut", months_before(ref, months))
    pos = pos.withColumn("pcut", months_before(C("cut"), months))
    recent = C(S.INVOICE_DATE) >= C("cut")
    prior = (C(S.INVOICE_DATE) >= C("pcut")) & (C(S.INVOICE_DATE) < C("cut"))
    per = pos.groupBy(*by, D).agg(F.sum(F.when(recent, C(S.QUANTITY))).alias("recent_units"),
                                 F.sum(F.when(prior, C(S.QUANTITY))).alias("prior_units"))
    return per.filter(C("recent_units").isNotNull() & C("prior_units").isNotNull() & (C("prior_units") > 0))


def high_growth_products(sales: DataFrame, months: int = 3, limit: int | None = 5,
                         by: Sequence[str] = ()) -> DataFrame:
    per = _window_units(sales, months, by)
    g = rnd((C("recent_units") - C("prior_units")).cast("double") / C("prior_units").cast("double") * F.lit(100.0), 1)
    out = per.select(*by, D, "recent_units", "prior_units", g.alias("growth_pct"))
    return top_k(out, [C("growth_pct").desc(), C(D)], limit, by)


def slow_movers(sales: DataFrame, months: int = 3, limit: int | None = 10, by: Sequence[str] = ()) -> DataFrame:
    per = _window_units(sales, months, by)
    g = rnd((C("prior_units") - C("recent_units")).cast("double") / C("prior_units").cast("double") * F.lit(100.0), 1)
    out = per.select(*by, D, "recent_units", "prior_units", g.alias("decline_pct"))
    return top_k(out, [C("decline_pct").desc(), C(D)], limit, by)


def declining_products(sales: DataFrame, months: int = 3) -> DataFrame:
    """Every product that sold fewer units in the last ``months`` than in as many before."""
    return slow_movers(sales, months, None).filter(C("prior_units") > C("recent_units"))
