"""Registered product questions (survey §2.3, §2.5 per product) and their SQL."""

from __future__ import annotations

from tallyframe.operators import products as op
from tallyframe.plans.q_sales import MONTH_IDX
from tallyframe.plans.registry import S, register, with_sales

MONTH_FROM = "printf('%04d-%02d', ({i}) // 12, ({i}) % 12 + 1)"


def top(sql_select: str, order: str, limit: int | None) -> str:
    return f"{sql_select} ORDER BY {order}" + (f" LIMIT {limit}" if limit else "")


@register("top_products_by_quantity", with_sales(top(
    "SELECT description, CAST(SUM(quantity) AS BIGINT) AS units FROM sales WHERE description IS NOT NULL GROUP BY description",
    "units DESC, description", 10)))
def _top_qty(spark, sf):
    return op.top_products_by_quantity(S(spark, sf), 10)


@register("average_price_per_product", with_sales(top(
    "SELECT description, CAST(SUM(revenue) AS DOUBLE) / NULLIF(CAST(SUM(quantity) AS DOUBLE), 0) AS avg_price "
    "FROM sales WHERE description IS NOT NULL AND quantity > 0 GROUP BY description",
    "avg_price DESC, description", 10)))
def _avg_price(spark, sf):
    return op.average_price_per_product(S(spark, sf), 10)


LAST_MONTHS_CTES = [
    f"pm AS (SELECT description, {MONTH_IDX} AS m, SUM(quantity) AS units FROM sales "
    "WHERE description IS NOT NULL AND invoice_date IS NOT NULL GROUP BY 1, 2)",
    "pb AS (SELECT description, MIN(m) AS first_m, MAX(m) AS last_m FROM pm GROUP BY 1)",
    "lm AS (SELECT description, ANY_VALUE(first_m) AS first_m, ANY_VALUE(last_m) AS last_m, "
    "CAST(COALESCE(SUM(CASE WHEN m = last_m THEN units END), 0) AS BIGINT) AS u0, "
    "CAST(COALESCE(SUM(CASE WHEN m = last_m - 1 THEN units END), 0) AS BIGINT) AS u1, "
    "CAST(COALESCE(SUM(CASE WHEN m = last_m - 2 THEN units END), 0) AS BIGINT) AS u2 "
    "FROM pm JOIN pb USING (description) GROUP BY description)",
]


@register("product_sales_trend", with_sales(
    f"SELECT description, {MONTH_FROM.format(i='last_m')} AS last_month, u0 AS last_units, u1 AS prev_units, "
    "CASE WHEN last_m - first_m + 1 >= 2 AND u1 <> 0 THEN ROUND(CAST(u0 - u1 AS DOUBLE) / CAST(u1 AS DOUBLE) * 100.0, 2) END AS change_pct, "
    "CASE WHEN last_m - first_m + 1 < 2 THEN 'Not enough history' WHEN u1 = 0 AND u0 > 0 THEN 'Up' "
    "WHEN u1 <> 0 AND CAST(u0 - u1 AS DOUBLE) / CAST(u1 AS DOUBLE) * 100.0 > 0 THEN 'Up' ELSE 'Down' END AS trend FROM lm",
    *LAST_MONTHS_CTES))
def _product_sales_trend(spark, sf):
    return op.product_sales_trend(S(spark, sf))


@register("product_lifecycle", with_sales(
    "SELECT description, CASE WHEN last_m - first_m + 1 < 3 THEN 'New Product' WHEN u0 > u1 AND u1 > u2 THEN 'Growing' "
    "WHEN u0 < u1 AND u1 < u2 THEN 'Declining' ELSE 'Stable' END AS lifecycle, u2 AS units_m3, u1 AS units_m2, "
    "u0 AS units_m1 FROM lm", *LAST_MONTHS_CTES))
def _product_lifecycle(spark, sf):
    return op.product_lifecycle(S(spark, sf))


RETURN_RATE = (
    "SELECT description, units_sold, units_returned, CASE WHEN units_sold > 0 THEN CAST(units_returned * 100 AS DOUBLE) "
    "/ CAST(units_sold AS DOUBLE) WHEN units_returned > 0 THEN 100.0 ELSE 0.0 END AS return_rate_pct FROM ("
    "SELECT description, CAST(COALESCE(SUM(CASE WHEN quantity > 0 THEN quantity END), 0) AS BIGINT) AS units_sold, "
    "CAST(abs(COALESCE(SUM(CASE WHEN quantity < 0 THEN quantity END), 0)) AS BIGINT) AS units_returned FROM sales "
    "WHERE description IS NOT NULL GROUP BY description)")


@register("product_return_rate", with_sales(RETURN_RATE))
def _product_return_rate(spark, sf):
    return op.product_return_rate(S(spark, sf))


@register("product_return_rate_top", with_sales(top(RETURN_RATE, "return_rate_pct DESC, description", 10)))
def _product_return_rate_top(spark, sf):
    return op.product_return_rate(S(spark, sf), 10)


# Sales-units windows relative to the latest dated line (for growth / slow movers).
WINDOW_CTES = [
    "rf AS (SELECT MAX(invoice_date) - INTERVAL 3 MONTH AS cut, MAX(invoice_date) - INTERVAL 3 MONTH - INTERVAL 3 MONTH AS pcut "
    "FROM sales WHERE invoice_date IS NOT NULL)",
    "wu AS (SELECT description, SUM(CASE WHEN invoice_date >= cut THEN quantity END) AS recent_units, "
    "SUM(CASE WHEN invoice_date >= pcut AND invoice_date < cut THEN quantity END) AS prior_units "
    "FROM sales, rf WHERE description IS NOT NULL AND invoice_date IS NOT NULL AND quantity > 0 GROUP BY description)",
    "wf AS (SELECT description, CAST(recent_units AS BIGINT) AS recent_units, CAST(prior_units AS BIGINT) AS prior_units "
    "FROM wu WHERE recent_units IS NOT NULL AND prior_units IS NOT NULL AND prior_units > 0)",
]
GROWTH = "ROUND(CAST(recent_units - prior_units AS DOUBLE) / CAST(prior_units AS DOUBLE) * 100.0, 1)"
DECLINE = "ROUND(CAST(prior_units - recent_units AS DOUBLE) / CAST(prior_units AS DOUBLE) * 100.0, 1)"


@register("high_growth_products", with_sales(top(
    f"SELECT description, recent_units, prior_units, {GROWTH} AS growth_pct FROM wf",
    "growth_pct DESC, description", 5), *WINDOW_CTES))
def _high_growth(spark, sf):
    return op.high_growth_products(S(spark, sf), 3, 5)


@register("slow_movers", with_sales(top(
    f"SELECT description, recent_units, prior_units, {DECLINE} AS decline_pct FROM wf",
    "decline_pct DESC, description", 10), *WINDOW_CTES))
def _slow_movers(spark, sf):
    return op.slow_movers(S(spark, sf), 3, 10)


@register("product_line_refund_rate", with_sales(
    "SELECT p.description, sale_lines, return_lines, refund_rate_pct, refund_rate_pct > 15.0 AS loss_making_risk, "
    "sm.description IS NOT NULL AS declining, refund_rate_pct > 15.0 AND sm.description IS NOT NULL AS do_not_promote "
    "FROM (SELECT description, COUNT(*) FILTER (WHERE quantity > 0) AS sale_lines, COUNT(*) FILTER (WHERE quantity < 0) AS return_lines, "
    "COALESCE(CAST(COUNT(*) FILTER (WHERE quantity < 0) * 100 AS DOUBLE) / NULLIF(CAST(COUNT(*) FILTER (WHERE quantity > 0) "
    "+ COUNT(*) FILTER (WHERE quantity < 0) AS DOUBLE), 0), 0.0) AS refund_rate_pct FROM sales WHERE description IS NOT NULL "
    "GROUP BY description) p LEFT JOIN (SELECT description FROM wf WHERE prior_units > recent_units) sm "
    "ON p.description = sm.description", *WINDOW_CTES))
def _product_line_refund_rate(spark, sf):
    s = S(spark, sf)
    return op.product_line_refund_rate(s, op.declining_products(s, 3))


@register("product_revenue_share", with_sales(top(
    "SELECT description, CAST(SUM(revenue) AS DOUBLE) / NULLIF(CAST((SELECT SUM(revenue) FROM sales) AS DOUBLE), 0) * 100.0 "
    "AS revenue_share_pct FROM sales WHERE description IS NOT NULL GROUP BY description",
    "revenue_share_pct DESC, description", 10)))
def _product_revenue_share(spark, sf):
    return op.product_revenue_share(S(spark, sf), 10)


@register("product_popularity", with_sales(top(
    "SELECT description, CAST(SUM(quantity) AS DECIMAL(19, 0)) * CAST(COUNT(DISTINCT invoice) AS DECIMAL(19, 0)) AS popularity_score FROM sales "
    "WHERE description IS NOT NULL GROUP BY description", "popularity_score DESC, description", 10)))
def _product_popularity(spark, sf):
    return op.product_popularity(S(spark, sf), 10)


@register("product_purchase_frequency", with_sales(top(
    "SELECT description, CAST(COUNT(DISTINCT invoice) AS DOUBLE) / NULLIF(CAST((SELECT COUNT(DISTINCT invoice) FROM sales) AS DOUBLE), 0) "
    "* 100.0 AS purchase_frequency_pct FROM sales WHERE description IS NOT NULL GROUP BY description",
    "purchase_frequency_pct DESC, description", 10)))
def _product_purchase_frequency(spark, sf):
    return op.product_purchase_frequency(S(spark, sf), 10)


@register("best_seller_per_country", with_sales(
    "SELECT country, description, units FROM (SELECT country, description, CAST(SUM(quantity) AS BIGINT) AS units, "
    "ROW_NUMBER() OVER (PARTITION BY country ORDER BY SUM(quantity) DESC, description) AS rn FROM sales "
    "WHERE description IS NOT NULL AND country IS NOT NULL GROUP BY country, description) WHERE rn = 1"))
def _best_seller(spark, sf):
    return op.best_seller_per_country(S(spark, sf))


DEMAND_CTES = [
    f"dm AS (SELECT description, {MONTH_IDX} AS m, SUM(quantity) AS units FROM sales "
    "WHERE description IS NOT NULL AND invoice_date IS NOT NULL AND quantity > 0 GROUP BY 1, 2)",
    "db AS (SELECT description, MIN(m) AS first_m, MAX(m) AS last_m FROM dm GROUP BY 1)",
    "da AS (SELECT description, ANY_VALUE(first_m) AS first_m, ANY_VALUE(last_m) AS last_m, SUM(units) AS sy, "
    "SUM(CAST(m - first_m AS BIGINT) * units) AS sxy, CAST(ANY_VALUE(last_m) - ANY_VALUE(first_m) + 1 AS BIGINT) AS n "
    "FROM dm JOIN db USING (description) GROUP BY description)",
    "ds AS (SELECT *, CAST(n * (n - 1) / 2 AS BIGINT) AS sx, CAST((n - 1) * n * (n * 2 - 1) / 6 AS BIGINT) AS sxx FROM da)",
    "dl AS (SELECT *, CASE WHEN (CAST(n AS DOUBLE) * CAST(sxx AS DOUBLE) - CAST(sx AS DOUBLE) * CAST(sx AS DOUBLE)) <> 0 THEN "
    "(CAST(n AS DOUBLE) * CAST(sxy AS DOUBLE) - CAST(sx AS DOUBLE) * CAST(sy AS DOUBLE)) / "
    "(CAST(n AS DOUBLE) * CAST(sxx AS DOUBLE) - CAST(sx AS DOUBLE) * CAST(sx AS DOUBLE)) END AS slope FROM ds)",
]


@register("product_demand_trend", with_sales(
    "SELECT description, CASE WHEN n < 2 THEN 'insufficient data' WHEN slope > 5 THEN 'growing' WHEN slope < -5 THEN 'declining' "
    "ELSE 'stable' END AS trend, CASE WHEN n >= 2 THEN ROUND(slope, 2) END AS monthly_slope_units, "
    "CAST(sy AS BIGINT) AS total_units_sold, n AS months_of_data FROM dl", *DEMAND_CTES))
def _product_demand_trend(spark, sf):
    return op.product_demand_trend(S(spark, sf))


@register("product_demand_months", with_sales(
    f"SELECT sp.description, {MONTH_FROM.format(i='sp.m')} AS month, CAST(COALESCE(units, 0) AS BIGINT) AS units_sold FROM "
    "(SELECT description, unnest(range(first_m, last_m + 1)) AS m FROM db) sp LEFT JOIN dm USING (description, m)",
    *DEMAND_CTES[:2]))
def _product_demand_months(spark, sf):
    return op.product_demand_months(S(spark, sf))


@register("demand_forecast_by_product", with_sales(
    f"SELECT description, {MONTH_FROM.format(i='last_m + step')} AS month, "
    "ROUND(greatest(intercept + slope * CAST(n - 1 + step AS DOUBLE), 0.0), 2) AS predicted_units FROM ("
    "SELECT *, (CAST(sy AS DOUBLE) - slope * CAST(sx AS DOUBLE)) / CAST(n AS DOUBLE) AS intercept FROM dl WHERE n >= 2), "
    "(SELECT unnest(range(1, 4)) AS step)", *DEMAND_CTES))
def _demand_forecast(spark, sf):
    return op.demand_forecast_by_product(S(spark, sf), 3)


@register("product_return_rate_by_country", with_sales(
    "SELECT country, description, units_sold, units_returned, return_rate_pct FROM (SELECT *, ROW_NUMBER() OVER ("
    "PARTITION BY country ORDER BY return_rate_pct DESC, description) AS rn FROM (SELECT country, description, units_sold, "
    "units_returned, CASE WHEN units_sold > 0 THEN CAST(units_returned * 100 AS DOUBLE) / CAST(units_sold AS DOUBLE) "
    "WHEN units_returned > 0 THEN 100.0 ELSE 0.0 END AS return_rate_pct FROM (SELECT country, description, "
    "CAST(COALESCE(SUM(CASE WHEN quantity > 0 THEN quantity END), 0) AS BIGINT) AS units_sold, "
    "CAST(abs(COALESCE(SUM(CASE WHEN quantity < 0 THEN quantity END), 0)) AS BIGINT) AS units_returned FROM sales "
    "WHERE description IS NOT NULL GROUP BY 1, 2))) WHERE rn <= 3"))
def _return_rate_by_country(spark, sf):
    return op.product_return_rate(S(spark, sf), 3, by=("country",))


@register("slow_movers_by_country", with_sales(
    "SELECT country, description, recent_units, prior_units, decline_pct FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "
    "country ORDER BY decline_pct DESC, description) AS rn FROM (SELECT country, description, CAST(recent_units AS BIGINT) "
    "AS recent_units, CAST(prior_units AS BIGINT) AS prior_units, ROUND(CAST(prior_units - recent_units AS DOUBLE) / "
    "CAST(prior_units AS DOUBLE) * 100.0, 1) AS decline_pct FROM (SELECT s.country, description, "
    "SUM(CASE WHEN invoice_date >= cut THEN quantity END) AS recent_units, "
    "SUM(CASE WHEN invoice_date >= pcut AND invoice_date < cut THEN quantity END) AS prior_units FROM sales s JOIN ("
    "SELECT country, MAX(invoice_date) - INTERVAL 3 MONTH AS cut, MAX(invoice_date) - INTERVAL 3 MONTH - INTERVAL 3 MONTH "
    "AS pcut FROM sales WHERE invoice_date IS NOT NULL GROUP BY country) r ON s.country IS NOT DISTINCT FROM r.country "
    "WHERE description IS NOT NULL AND invoice_date IS NOT NULL AND quantity > 0 GROUP BY 1, 2) "
    "WHERE recent_units IS NOT NULL AND prior_units IS NOT NULL AND prior_units > 0)) WHERE rn <= 3"))
def _slow_movers_by_country(spark, sf):
    return op.slow_movers(S(spark, sf), 3, 3, by=("country",))
