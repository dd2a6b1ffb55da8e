"""Registered customer questions (survey §2.4) and their SQL."""

from __future__ import annotations

from tallyframe.operators import customers as op
from tallyframe.plans.q_sales import DAYS, MONTH_IDX
from tallyframe.plans.registry import S, money, register, with_sales

POS_REV = "COALESCE(SUM(CASE WHEN quantity > 0 THEN revenue END), 0)"


@register("unique_customers", with_sales("SELECT COUNT(DISTINCT customer_id) AS unique_customers FROM sales"))
def _unique_customers(spark, sf):
    return op.unique_customers(S(spark, sf))


@register("top_customer", with_sales(
    f"SELECT customer_id, {money('SUM(revenue)')} AS total_revenue_gbp FROM sales WHERE customer_id IS NOT NULL "
    "GROUP BY customer_id ORDER BY SUM(revenue) DESC, customer_id LIMIT 1"))
def _top_customer(spark, sf):
    return op.top_customer(S(spark, sf))


@register("top_customer_by_country", with_sales(
    f"SELECT country, customer_id, {money('rev')} AS total_revenue_gbp FROM (SELECT country, customer_id, SUM(revenue) AS rev, "
    "ROW_NUMBER() OVER (PARTITION BY country ORDER BY SUM(revenue) DESC, customer_id) AS rn FROM sales "
    "WHERE customer_id IS NOT NULL GROUP BY country, customer_id) WHERE rn = 1"))
def _top_customer_by_country(spark, sf):
    return op.top_customer(S(spark, sf), by=("country",))


@register("top_spending_customers", with_sales(
    f"SELECT customer_id, {money('SUM(revenue)')} AS total_spend_gbp FROM sales WHERE customer_id IS NOT NULL AND quantity > 0 "
    "GROUP BY customer_id ORDER BY SUM(revenue) DESC, customer_id LIMIT 5"))
def _top_spending(spark, sf):
    return op.top_spending_customers(S(spark, sf), 5)


@register("customer_profiles", with_sales(
    f"SELECT b.customer_id, c.country, {money(POS_REV)} AS total_spend_gbp, COUNT(DISTINCT b.invoice) AS total_orders, "
    "CAST(COALESCE(SUM(CASE WHEN b.quantity > 0 THEN b.quantity END), 0) AS BIGINT) AS total_items_bought, "
    "COUNT(*) FILTER (WHERE b.quantity < 0) AS refund_transactions, ANY_VALUE(f.favorite_product) AS favorite_product, "
    "strftime(MIN(b.invoice_date), '%Y-%m-%d') AS first_purchase, strftime(MAX(b.invoice_date), '%Y-%m-%d') AS last_purchase "
    "FROM sales b LEFT JOIN (SELECT customer_id, country FROM (SELECT customer_id, country, ROW_NUMBER() OVER "
    "(PARTITION BY customer_id ORDER BY COUNT(*) DESC, country) AS rn FROM sales WHERE country IS NOT NULL "
    "GROUP BY customer_id, country) WHERE rn = 1) c USING (customer_id) "
    "LEFT JOIN (SELECT customer_id, description AS favorite_product FROM (SELECT customer_id, description, ROW_NUMBER() OVER "
    "(PARTITION BY customer_id ORDER BY SUM(quantity) DESC, description) AS rn FROM sales WHERE quantity > 0 AND "
    "description IS NOT NULL GROUP BY customer_id, description) WHERE rn = 1) f USING (customer_id) "
    "WHERE b.customer_id IS NOT NULL GROUP BY b.customer_id, c.country"))
def _customer_profiles(spark, sf):
    return op.customer_profiles(S(spark, sf))


@register("customer_orders", with_sales(
    f"SELECT customer_id, invoice, strftime(MIN(invoice_date), '%Y-%m-%d') AS date, {money('SUM(revenue)')} AS total_revenue_gbp, "
    "CAST(SUM(quantity) AS BIGINT) AS items_bought FROM sales WHERE customer_id IS NOT NULL GROUP BY customer_id, invoice "
    "HAVING SUM(revenue) > 0"))
def _customer_orders(spark, sf):
    return op.customer_orders(S(spark, sf))


@register("customer_product_units", with_sales(
    "SELECT customer_id, product, total_units_bought, total_units_returned, total_units_bought - total_units_returned AS net_units_kept "
    "FROM (SELECT customer_id, lower(description) AS product, CAST(COALESCE(SUM(CASE WHEN quantity > 0 THEN quantity END), 0) AS BIGINT) "
    "AS total_units_bought, CAST(abs(COALESCE(SUM(CASE WHEN quantity < 0 THEN quantity END), 0)) AS BIGINT) AS total_units_returned "
    "FROM sales WHERE customer_id IS NOT NULL AND description IS NOT NULL GROUP BY 1, 2)"))
def _customer_product_units(spark, sf):
    return op.customer_product_units(S(spark, sf))


@register("vip_customers", with_sales(
    f"SELECT customer_id, COUNT(DISTINCT invoice) AS total_orders, {money('SUM(revenue)')} AS total_spend_gbp FROM sales "
    "WHERE customer_id IS NOT NULL GROUP BY customer_id HAVING COUNT(DISTINCT invoice) >= 5 AND SUM(revenue) >= 1000.0"))
def _vip_customers(spark, sf):
    return op.vip_customers(S(spark, sf))


@register("new_customers_by_month", with_sales(
    "SELECT strftime(f, '%Y-%m') AS month, COUNT(*) AS new_customers FROM (SELECT customer_id, MIN(invoice_date) AS f "
    "FROM sales WHERE customer_id IS NOT NULL AND invoice_date IS NOT NULL GROUP BY 1) GROUP BY 1"))
def _new_customers(spark, sf):
    return op.new_customers_by_month(S(spark, sf))


LAST_SEEN = [
    "ref AS (SELECT MAX(invoice_date) AS ref FROM sales WHERE invoice_date IS NOT NULL)",
    f"ls AS (SELECT customer_id, MAX(invoice_date) AS last, ANY_VALUE(ref) AS ref, {DAYS.format(a='MAX(invoice_date)', b='ANY_VALUE(ref)')} "
    "AS idle FROM sales, ref WHERE customer_id IS NOT NULL AND invoice_date IS NOT NULL GROUP BY customer_id)",
]


@register("churn_risk_summary", with_sales(
    "SELECT strftime(ANY_VALUE(ref), '%Y-%m-%d') AS reference_date, 90 AS days_inactive_threshold, COUNT(*) AS total_customers, "
    "COUNT(*) FILTER (WHERE idle >= 90) AS at_risk_customers, COUNT(*) - COUNT(*) FILTER (WHERE idle >= 90) AS healthy_customers, "
    "ROUND(COALESCE(CAST(COUNT(*) FILTER (WHERE idle >= 90) * 100 AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0), 0.0), 1) "
    "AS churn_risk_pct FROM ls", *LAST_SEEN))
def _churn_risk_summary(spark, sf):
    return op.churn_risk_summary(S(spark, sf), 90)


def _at_risk_sql(spend_expr: str, limit: int) -> str:
    return with_sales(
        f"SELECT ls.customer_id, idle AS days_since_last_purchase, {money('COALESCE(sp.spend, 0)')} AS total_spend_gbp, "
        "strftime(last, '%Y-%m-%d') AS last_purchase_date FROM ls LEFT JOIN (SELECT customer_id, "
        f"COALESCE(SUM({spend_expr}), 0) AS spend FROM sales WHERE customer_id IS NOT NULL GROUP BY customer_id) sp "
        f"USING (customer_id) WHERE idle >= 90 ORDER BY COALESCE(sp.spend, 0) DESC, ls.customer_id LIMIT {limit}",
        *LAST_SEEN)


@register("at_risk_customers", _at_risk_sql("CASE WHEN quantity > 0 THEN revenue END", 15))
def _at_risk(spark, sf):
    return op.at_risk_customers(S(spark, sf), 90, 15, "pos")


@register("at_risk_customers_net", _at_risk_sql("revenue", 20))
def _at_risk_net(spark, sf):
    return op.at_risk_customers(S(spark, sf), 90, 20, "net")


RFM_SQL = with_sales(
    f"SELECT customer_id, {DAYS.format(a='last', b='ref')} AS recency_days, frequency, CAST(mon AS DOUBLE) AS monetary, "
    "CAST(mon AS DOUBLE) / CAST(frequency AS DOUBLE) AS avg_basket_size, CAST(purchase_count AS BIGINT) AS purchase_count, "
    "COALESCE(CAST(COALESCE(ret_inv, 0) AS DOUBLE) / NULLIF(CAST(frequency AS DOUBLE), 0), 0.0) AS return_rate, "
    f"{DAYS.format(a='first', b='last')} AS purchase_span_days, "
    "COALESCE(CASE WHEN frequency >= 2 THEN sqrt(greatest((CAST(mon2 AS DOUBLE) - CAST(mon AS DOUBLE) * CAST(mon AS DOUBLE) "
    "/ CAST(frequency AS DOUBLE)) / (CAST(frequency AS DOUBLE) - 1.0), 0.0)) END, 0.0) AS std_basket_size "
    "FROM (SELECT customer_id, MAX(t1) AS last, MIN(t0) AS first, COUNT(*) AS frequency, SUM(r) AS mon, SUM(r * r) AS mon2, "
    "SUM(q) AS purchase_count FROM (SELECT customer_id, invoice, CAST(SUM(revenue) AS DECIMAL(18,2)) AS r, MIN(invoice_date) AS t0, "
    "MAX(invoice_date) AS t1, SUM(quantity) AS q FROM sales WHERE customer_id IS NOT NULL AND invoice_date IS NOT NULL "
    "AND quantity > 0 GROUP BY 1, 2) GROUP BY customer_id HAVING SUM(r) > 0) "
    "CROSS JOIN (SELECT MAX(invoice_date) AS ref FROM sales WHERE invoice_date IS NOT NULL) "
    "LEFT JOIN (SELECT customer_id, COUNT(DISTINCT invoice) AS ret_inv FROM sales WHERE customer_id IS NOT NULL AND quantity < 0 "
    "GROUP BY 1) USING (customer_id)")


@register("rfm_features", RFM_SQL)
def _rfm(spark, sf):
    return op.rfm_features(S(spark, sf))


@register("customer_clv", with_sales(
    f"SELECT customer_id, {money('hist')} AS historical_spend_gbp, orders AS total_historical_orders, ROUND(aov, 2) AS avg_order_value_gbp, "
    "ROUND(am, 1) AS active_months, ROUND(CAST(orders AS DOUBLE) / am, 2) AS purchases_per_month, "
    "ROUND(CAST(orders AS DOUBLE) / am * 12.0, 1) AS projected_orders, ROUND(aov * (CAST(orders AS DOUBLE) / am * 12.0), 2) AS projected_clv_gbp, "
    "(orders = 1 OR ad = 0) AS insufficient_history FROM (SELECT *, greatest(CAST(ad AS DOUBLE) / 30.0, 1.0) AS am FROM ("
    "SELECT p.customer_id, orders, hist, CAST(hist AS DOUBLE) / CAST(orders AS DOUBLE) AS aov, "
    f"COALESCE({DAYS.format(a='f', b='l')}, 0) AS ad FROM (SELECT customer_id, COUNT(*) AS orders, SUM(r) AS hist FROM ("
    "SELECT customer_id, invoice, SUM(revenue) AS r FROM sales WHERE customer_id IS NOT NULL AND quantity > 0 GROUP BY 1, 2) "
    "GROUP BY 1) p JOIN (SELECT customer_id, MIN(invoice_date) AS f, MAX(invoice_date) AS l FROM sales WHERE customer_id IS NOT NULL "
    "GROUP BY 1) s USING (customer_id)) WHERE aov <> 0)"))
def _customer_clv(spark, sf):
    return op.customer_clv(S(spark, sf), 12)


COHORT_SQL = with_sales(
    "SELECT printf('%04d-%02d', cohort_m // 12, cohort_m % 12 + 1) AS cohort, size AS cohort_size, "
    + ", ".join(f"ROUND(CAST(c{i} * 100 AS DOUBLE) / NULLIF(CAST(size AS DOUBLE), 0), 1) AS month_{i}" for i in range(7))
    + " FROM (SELECT * FROM per WHERE max_k >= 1 ORDER BY cohort_m DESC LIMIT 6) WHERE "
    + " + ".join(f"(CASE WHEN c{i} IS NOT NULL THEN 1 ELSE 0 END)" for i in range(7)) + " >= 2",
    f"cm AS (SELECT DISTINCT customer_id, {MONTH_IDX} AS m FROM sales WHERE customer_id IS NOT NULL AND quantity > 0 "
    "AND invoice_date IS NOT NULL)",
    "fm AS (SELECT customer_id, MIN(m) AS cohort_m FROM cm GROUP BY 1)",
    "ct AS (SELECT cohort_m, m - cohort_m AS k, COUNT(*) AS n FROM cm JOIN fm USING (customer_id) GROUP BY 1, 2)",
    "per AS (SELECT cohort_m, CAST(SUM(CASE WHEN k = 0 THEN n END) AS BIGINT) AS size, MAX(k) AS max_k, "
    + ", ".join(f"SUM(CASE WHEN k = {i} THEN n END) AS c{i}" for i in range(7)) + " FROM ct GROUP BY cohort_m)")


@register("cohort_retention", COHORT_SQL)
def _cohort_retention(spark, sf):
    return op.cohort_retention(S(spark, sf), 6)


@register("repeat_purchase_probability", with_sales(
    "SELECT COUNT(*) AS total_customers, COUNT(*) FILTER (WHERE n > 1) AS returned_for_second_purchase, "
    "ROUND(COALESCE(CAST(COUNT(*) FILTER (WHERE n > 1) * 100 AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0), 0.0), 1) "
    "AS repeat_purchase_probability_pct, ROUND(COALESCE(CAST(SUM(CASE WHEN n > 1 THEN n END) AS DOUBLE) / "
    "NULLIF(CAST(COUNT(*) FILTER (WHERE n > 1) AS DOUBLE), 0), 0.0), 1) AS avg_orders_per_returning_customer FROM ("
    "SELECT customer_id, COUNT(DISTINCT invoice) AS n FROM sales WHERE customer_id IS NOT NULL GROUP BY 1)"))
def _repeat_purchase_probability(spark, sf):
    return op.repeat_purchase_probability(S(spark, sf))


@register("churn_risk_by_country", with_sales(
    "SELECT country, strftime(ANY_VALUE(ref), '%Y-%m-%d') AS reference_date, 90 AS days_inactive_threshold, "
    "COUNT(*) AS total_customers, COUNT(*) FILTER (WHERE idle >= 90) AS at_risk_customers, "
    "COUNT(*) - COUNT(*) FILTER (WHERE idle >= 90) AS healthy_customers, "
    "ROUND(COALESCE(CAST(COUNT(*) FILTER (WHERE idle >= 90) * 100 AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0), 0.0), 1) "
    f"AS churn_risk_pct FROM (SELECT l.country, l.last, r.ref, {DAYS.format(a='l.last', b='r.ref')} AS idle FROM "
    "(SELECT country, customer_id, MAX(invoice_date) AS last FROM sales WHERE customer_id IS NOT NULL AND invoice_date IS NOT NULL "
    "GROUP BY 1, 2) l JOIN (SELECT country, MAX(invoice_date) AS ref FROM sales WHERE customer_id IS NOT NULL AND "
    "invoice_date IS NOT NULL GROUP BY 1) r ON l.country IS NOT DISTINCT FROM r.country) GROUP BY country"))
def _churn_risk_by_country(spark, sf):
    return op.churn_risk_summary(S(spark, sf), 90, by=("country",))


@register("cohort_retention_by_country", with_sales(
    "SELECT country, printf('%04d-%02d', cohort_m // 12, cohort_m % 12 + 1) AS cohort, size AS cohort_size, "
    + ", ".join(f"ROUND(CAST(c{i} * 100 AS DOUBLE) / NULLIF(CAST(size AS DOUBLE), 0), 1) AS month_{i}" for i in range(7))
    + " FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY cohort_m DESC) AS rn FROM per WHERE max_k >= 1) "
    "WHERE rn <= 6 AND " + " + ".join(f"(CASE WHEN c{i} IS NOT NULL THEN 1 ELSE 0 END)" for i in range(7)) + " >= 2",
    f"cm AS (SELECT DISTINCT country, customer_id, {MONTH_IDX} AS m FROM sales WHERE customer_id IS NOT NULL AND quantity > 0 "
    "AND invoice_date IS NOT NULL)",
    "fm AS (SELECT country, customer_id, MIN(m) AS cohort_m FROM cm GROUP BY 1, 2)",
    "ct AS (SELECT cm.country, cohort_m, m - cohort_m AS k, COUNT(*) AS n FROM cm JOIN fm ON cm.customer_id = fm.customer_id "
    "AND cm.country IS NOT DISTINCT FROM fm.country GROUP BY 1, 2, 3)",
    "per AS (SELECT country, cohort_m, CAST(SUM(CASE WHEN k = 0 THEN n END) AS BIGINT) AS size, MAX(k) AS max_k, "
    + ", ".join(f"SUM(CASE WHEN k = {i} THEN n END) AS c{i}" for i in range(7)) + " FROM ct GROUP BY country, cohort_m)"))
def _cohort_by_country(spark, sf):
    return op.cohort_retention(S(spark, sf), 6, by=("country",))


@register("new_customers_by_month_country", with_sales(
    "SELECT country, strftime(f, '%Y-%m') AS month, COUNT(*) AS new_customers FROM (SELECT country, customer_id, "
    "MIN(invoice_date) AS f FROM sales WHERE customer_id IS NOT NULL AND invoice_date IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2"))
def _new_customers_country(spark, sf):
    return op.new_customers_by_month(S(spark, sf), by=("country",))


@register("rfm_features_by_country", with_sales(
    f"SELECT country, customer_id, {DAYS.format(a='last', b='ref')} AS recency_days, frequency, CAST(mon AS DOUBLE) AS monetary, "
    "CAST(mon AS DOUBLE) / CAST(frequency AS DOUBLE) AS avg_basket_size, CAST(purchase_count AS BIGINT) AS purchase_count, "
    "COALESCE(CAST(COALESCE(ret_inv, 0) AS DOUBLE) / NULLIF(CAST(frequency AS DOUBLE), 0), 0.0) AS return_rate, "
    f"{DAYS.format(a='first', b='last')} AS purchase_span_days, "
    "COALESCE(CASE WHEN frequency >= 2 THEN sqrt(greatest((CAST(mon2 AS DOUBLE) - CAST(mon AS DOUBLE) * CAST(mon AS DOUBLE) "
    "/ CAST(frequency AS DOUBLE)) / (CAST(frequency AS DOUBLE) - 1.0), 0.0)) END, 0.0) AS std_basket_size "
    "FROM (SELECT country, customer_id, MAX(t1) AS last, MIN(t0) AS first, COUNT(*) AS frequency, SUM(r) AS mon, "
    "SUM(r * r) AS mon2, SUM(q) AS purchase_count FROM (SELECT country, customer_id, invoice, CAST(SUM(revenue) AS DECIMAL(18,2)) AS r, "
    "MIN(invoice_date) AS t0, MAX(invoice_date) AS t1, SUM(quantity) AS q FROM sales WHERE customer_id IS NOT NULL AND "
    "invoice_date IS NOT NULL AND quantity > 0 GROUP BY 1, 2, 3) GROUP BY country, customer_id HAVING SUM(r) > 0) "
    "JOIN (SELECT country, MAX(invoice_date) AS ref FROM sales WHERE invoice_date IS NOT NULL GROUP BY country) USING (country) "
    "LEFT JOIN (SELECT country, customer_id, COUNT(DISTINCT invoice) AS ret_inv FROM sales WHERE customer_id IS NOT NULL "
    "AND quantity < 0 GROUP BY 1, 2) USING (country, customer_id)"))
def _rfm_by_country(spark, sf):
    return op.rfm_features(S(spark, sf), by=("country",))
