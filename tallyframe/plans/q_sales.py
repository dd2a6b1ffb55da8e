"""Registered sales questions (survey §2.1, §2.2, §2.8) and their SQL statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import clean as cl
from tallyframe.operators import sales as op
from tallyframe.plans.oracle import RAW_SALES, WHY
from tallyframe.plans.registry import (COUNTRY, KEYWORD, PERIOD, PRODUCT, RANGE, E, S, money, register,
                                       with_events, with_sales)
from tallyframe.sources import catalog

POS = "quantity > 0"
MONTH_IDX = "(year(invoice_date) * 12 + month(invoice_date) - 1)"
MONTH_FROM_IDX = "printf('%04d-%02d', month_idx // 12, month_idx % 12 + 1)"
DAYS = "((epoch_us({b}) - epoch_us({a})) // 86400000000)"

# Gap-filled monthly net revenue with previous month and % change (for MoM family).
GROWTH_CTES = [
    f"m AS (SELECT {MONTH_IDX} AS month_idx, SUM(revenue) AS rev FROM sales WHERE invoice_date IS NOT NULL GROUP BY 1)",
    "sp AS (SELECT unnest(range(MIN(month_idx), MAX(month_idx) + 1)) AS month_idx FROM m)",
    "f AS (SELECT sp.month_idx, COALESCE(m.rev, 0) AS rev FROM sp LEFT JOIN m USING (month_idx))",
    "g AS (SELECT month_idx, rev, LAG(rev) OVER (ORDER BY month_idx) AS prev FROM f)",
    "h AS (SELECT *, CASE WHEN prev <> 0 THEN (CAST(rev AS DOUBLE) / CAST(prev AS DOUBLE) - 1.0) * 100.0 END AS growth FROM g)",
]
MOM_SQL_BODY = (
    f"SELECT {MONTH_FROM_IDX} AS month, {money('rev')} AS revenue, {money('prev')} AS prev_revenue, "
    "ROUND(growth, 2) AS growth_pct, month_idx = MAX(month_idx) OVER () AS is_latest FROM h WHERE growth IS NOT NULL"
)
DAILY_CTES = [
    "d AS (SELECT CAST(invoice_date AS DATE) AS day, SUM(revenue) AS rev FROM sales WHERE invoice_date IS NOT NULL GROUP BY 1)",
    "sp AS (SELECT CAST(unnest(generate_series(MIN(day), MAX(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)",
    "f AS (SELECT sp.day, CAST(COALESCE(d.rev, 0) AS DECIMAL(18,2)) AS rev FROM sp LEFT JOIN d USING (day))",
]


def sample_std_sql(n: str, s1: str, s2: str) -> str:
    nn, a, b = f"CAST({n} AS DOUBLE)", f"CAST({s1} AS DOUBLE)", f"CAST({s2} AS DOUBLE)"
    return f"CASE WHEN {n} >= 2 THEN sqrt(greatest(({b} - {a} * {a} / {nn}) / ({nn} - 1.0), 0.0)) END"


# ── §2.1 cleaning / profile ──────────────────────────────────────────────────

@register("clean_sales", with_sales("SELECT * FROM sales"))
def _clean_sales(spark, sf):
    # Wall-clock timestamps as TIMESTAMP_NTZ: collected values do not depend on the
    # client's time zone.
    return S(spark, sf).withColumn("invoice_date", F.col("invoice_date").cast("timestamp_ntz"))


@register("cleaning_report", (
    f"WITH given AS ({RAW_SALES}), told AS (SELECT *, {WHY} AS why FROM (SELECT DISTINCT * FROM given)) "
    "SELECT 'total' AS rule, COUNT(*) AS rows FROM given UNION ALL "
    "SELECT 'duplicate', (SELECT COUNT(*) FROM given) - (SELECT COUNT(*) FROM told) UNION ALL "
    + "".join(f"SELECT '{r}', COUNT(*) FROM told WHERE why = '{r}' UNION ALL " for r in cl.RULES[1:]) +
    "SELECT 'kept', COUNT(*) FROM told WHERE why IS NULL UNION ALL "
    "SELECT 'unparseable_date', COUNT(*) FROM told WHERE why IS NULL AND invoice_date IS NULL"))
def _cleaning_report(spark, sf):
    return catalog.cleaning_report(spark, sf)


@register("dataset_profile", with_sales(
    "SELECT column_name, null_count, row_count FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count, COUNT(*) AS row_count FROM sales"
        for c in ["invoice", "stock_code", "description", "quantity", "price", "revenue", "invoice_date",
                  "customer_id", "country"]) + ")"))
def _dataset_profile(spark, sf):
    return cl.dataset_profile(S(spark, sf)).select("column_name", "null_count", "row_count")


@register("dataset_summary", with_sales(
    "SELECT COUNT(DISTINCT customer_id) AS total_customers, COUNT(DISTINCT invoice) AS total_orders, "
    f"{money('COALESCE(SUM(CASE WHEN quantity > 0 THEN revenue END), 0)')} AS total_revenue_gbp, "
    "CAST(COALESCE(SUM(CASE WHEN quantity > 0 THEN quantity END), 0) AS BIGINT) AS total_items_sold, "
    "COUNT(DISTINCT description) AS total_products, strftime(MIN(invoice_date), '%Y-%m-%d') AS date_from, "
    "strftime(MAX(invoice_date), '%Y-%m-%d') AS date_to, "
    "(SELECT country FROM sales WHERE quantity > 0 AND country IS NOT NULL GROUP BY country "
    " ORDER BY SUM(revenue) DESC, country LIMIT 1) AS top_country FROM sales"))
def _dataset_summary(spark, sf):
    return cl.dataset_summary(S(spark, sf))


@register("events_sales", with_events("SELECT * FROM event_sales"))
def _events_sales(spark, sf):
    return E(spark, sf).withColumn("invoice_date", F.col("invoice_date").cast("timestamp_ntz"))


# ── §2.2 scalar KPIs ─────────────────────────────────────────────────────────

@register("total_revenue", with_sales(
    f"SELECT {money('COALESCE(SUM(CASE WHEN quantity > 0 THEN revenue END), 0)')} AS total_revenue FROM sales"))
def _total_revenue(spark, sf):
    return op.total_revenue(S(spark, sf))


@register("total_revenue_by_country", with_sales(
    f"SELECT country, {money('COALESCE(SUM(CASE WHEN quantity > 0 THEN revenue END), 0)')} AS total_revenue "
    "FROM sales GROUP BY country"))
def _total_revenue_by_country(spark, sf):
    return op.total_revenue(S(spark, sf), by=("country",))


@register("total_orders", with_sales("SELECT COUNT(DISTINCT invoice) AS total_orders FROM sales"))
def _total_orders(spark, sf):
    return op.total_orders(S(spark, sf))


@register("total_items_sold", with_sales(
    "SELECT CAST(COALESCE(SUM(CASE WHEN quantity > 0 THEN quantity END), 0) AS BIGINT) AS total_items_sold FROM sales"))
def _total_items_sold(spark, sf):
    return op.total_items_sold(S(spark, sf))


@register("aov_overall", with_sales(
    "SELECT COALESCE(CAST(COALESCE(SUM(CASE WHEN quantity > 0 THEN revenue END), 0) AS DOUBLE) "
    "/ NULLIF(CAST(COUNT(DISTINCT invoice) AS DOUBLE), 0), 0.0) AS aov FROM sales"))
def _aov_overall(spark, sf):
    return op.aov_overall(S(spark, sf))


@register("aov_positive_invoices", with_sales(
    "SELECT ROUND(COALESCE(CAST(SUM(inv_rev) AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0), 0.0), 2) "
    "AS aov_positive_invoices FROM (SELECT invoice, SUM(revenue) AS inv_rev FROM sales GROUP BY invoice) "
    "WHERE inv_rev > 0"))
def _aov_positive(spark, sf):
    return op.aov_positive_invoices(S(spark, sf))


@register("average_item_price", with_sales(
    "SELECT ROUND(CAST(SUM(price) AS DOUBLE) / NULLIF(CAST(COUNT(price) AS DOUBLE), 0), 2) AS average_item_price FROM sales"))
def _average_item_price(spark, sf):
    return op.average_item_price(S(spark, sf))


REFUND_SQL = ("COALESCE(CAST(COUNT(*) FILTER (WHERE quantity < 0) * 100 AS DOUBLE) "
              "/ NULLIF(CAST(COUNT(*) AS DOUBLE), 0), 0.0) AS refund_rate_pct")


@register("refund_rate", with_sales(f"SELECT {REFUND_SQL} FROM sales"))
def _refund_rate(spark, sf):
    return op.refund_rate(S(spark, sf))


@register("refund_rate_country", with_sales(f"SELECT {REFUND_SQL} FROM sales WHERE lower(country) = '{COUNTRY}'"))
def _refund_rate_country(spark, sf):
    return op.refund_rate(S(spark, sf), country=COUNTRY)


@register("refund_rate_by_country", with_sales(
    f"SELECT country, {REFUND_SQL} FROM sales WHERE country IS NOT NULL GROUP BY country"))
def _refund_rate_by_country(spark, sf):
    return op.refund_rate_by_country(S(spark, sf))


# ── rankings ─────────────────────────────────────────────────────────────────

@register("top_countries_by_revenue", with_sales(
    f"SELECT country, {money('SUM(revenue)')} AS revenue FROM sales WHERE country IS NOT NULL "
    "GROUP BY country ORDER BY SUM(revenue) DESC, country LIMIT 5"))
def _top_countries(spark, sf):
    return op.top_countries_by_revenue(S(spark, sf), 5)


@register("country_revenue", with_sales(
    f"SELECT country, {money('SUM(revenue)')} AS total_revenue_gbp FROM sales WHERE country IS NOT NULL GROUP BY country"))
def _country_revenue(spark, sf):
    return op.country_revenue(S(spark, sf))


@register("top_country_by_lines", with_sales(
    "SELECT country, COUNT(*) AS lines FROM sales WHERE country IS NOT NULL GROUP BY country "
    "ORDER BY lines DESC, country LIMIT 1"))
def _top_country_by_lines(spark, sf):
    return op.top_country_by_lines(S(spark, sf))


@register("top_products_by_revenue", with_sales(
    f"SELECT description, {money('SUM(revenue)')} AS revenue FROM sales WHERE {POS} AND description IS NOT NULL "
    "GROUP BY description ORDER BY SUM(revenue) DESC, description LIMIT 5"))
def _top_products_by_revenue(spark, sf):
    return op.top_products_by_revenue(S(spark, sf), 5)


@register("top_products_by_revenue_country", with_sales(
    f"SELECT description, {money('SUM(revenue)')} AS revenue FROM sales WHERE {POS} AND description IS NOT NULL "
    f"AND lower(country) = '{COUNTRY}' GROUP BY description ORDER BY SUM(revenue) DESC, description LIMIT 5"))
def _top_products_by_revenue_country(spark, sf):
    return op.top_products_by_revenue(S(spark, sf), 5, country=COUNTRY)


@register("top_products_per_country", with_sales(
    f"SELECT country, description, {money('rev')} AS revenue FROM (SELECT country, description, SUM(revenue) AS rev, "
    "ROW_NUMBER() OVER (PARTITION BY country ORDER BY SUM(revenue) DESC, description) AS rn FROM sales "
    f"WHERE {POS} AND description IS NOT NULL GROUP BY country, description) WHERE rn <= 3"))
def _top_products_per_country(spark, sf):
    return op.top_products_by_revenue(S(spark, sf), 3, by=("country",))


@register("top_products_in_period", with_sales(
    f"SELECT description, {money('SUM(revenue)')} AS revenue FROM sales WHERE {POS} AND description IS NOT NULL "
    f"AND invoice_date >= TIMESTAMP '{PERIOD}-01' AND invoice_date < TIMESTAMP '{PERIOD}-01' + INTERVAL 1 MONTH "
    "GROUP BY description ORDER BY SUM(revenue) DESC, description LIMIT 5"))
def _top_products_in_period(spark, sf):
    return op.top_products_in_period(S(spark, sf), PERIOD, 5)


@register("customers_by_country", with_sales(
    "SELECT country, COUNT(DISTINCT customer_id) AS unique_customers FROM sales WHERE country IS NOT NULL GROUP BY country"))
def _customers_by_country(spark, sf):
    return op.customers_by_country(S(spark, sf))


@register("orders_by_country", with_sales(
    "SELECT country, COUNT(DISTINCT invoice) AS orders FROM sales WHERE country IS NOT NULL GROUP BY country "
    "ORDER BY orders DESC, country LIMIT 3"))
def _orders_by_country(spark, sf):
    return op.orders_by_country(S(spark, sf), 3)


@register("revenue_by_year", with_sales(
    f"SELECT CAST(year(invoice_date) AS INTEGER) AS year, {money('SUM(revenue)')} AS total_revenue FROM sales "
    f"WHERE {POS} AND invoice_date IS NOT NULL GROUP BY 1"))
def _revenue_by_year(spark, sf):
    return op.revenue_by_year(S(spark, sf))


# ── calendar breakdowns ──────────────────────────────────────────────────────

@register("monthly_revenue", with_sales(
    f"SELECT strftime(invoice_date, '%Y-%m') AS month, {money('SUM(revenue)')} AS revenue FROM sales "
    "WHERE invoice_date IS NOT NULL GROUP BY 1"))
def _monthly_revenue(spark, sf):
    return op.monthly_revenue(S(spark, sf))


@register("revenue_by_date_range", with_sales(
    f"SELECT '{RANGE[0]}' AS start_date, '{RANGE[1]}' AS end_date, "
    f"{money(f'COALESCE(SUM(CASE WHEN invoice_date >= TIMESTAMP {chr(39)}{RANGE[0]}{chr(39)} AND invoice_date < TIMESTAMP {chr(39)}{RANGE[1]}{chr(39)} + INTERVAL 1 DAY THEN revenue END), 0)')} AS revenue, "
    f"COUNT(*) FILTER (WHERE invoice_date >= TIMESTAMP '{RANGE[0]}' AND invoice_date < TIMESTAMP '{RANGE[1]}' + INTERVAL 1 DAY) AS lines, "
    "strftime(MIN(invoice_date), '%Y-%m-%d') AS dataset_start, strftime(MAX(invoice_date), '%Y-%m-%d') AS dataset_end FROM sales"))
def _revenue_by_date_range(spark, sf):
    return op.revenue_by_date_range(S(spark, sf), *RANGE)


@register("busiest_days_of_week", with_sales(
    "SELECT dayname(invoice_date) AS day_of_week, COUNT(*) AS transactions FROM sales "
    "WHERE invoice_date IS NOT NULL GROUP BY 1"))
def _busiest_days(spark, sf):
    return op.busiest_days_of_week(S(spark, sf))


@register("units_by_weekday", with_sales(
    "SELECT CAST(isodow(invoice_date) - 1 AS INTEGER) AS weekday, dayname(invoice_date) AS day_of_week, "
    "CAST(SUM(quantity) AS BIGINT) AS units_sold FROM sales WHERE quantity > 0 AND invoice_date IS NOT NULL GROUP BY 1, 2"))
def _units_by_weekday(spark, sf):
    return op.units_by_weekday(S(spark, sf))


@register("hourly_sales", with_events(
    f"SELECT CAST(hour(invoice_date) AS INTEGER) AS hour, {money('SUM(revenue)')} AS revenue FROM event_sales "
    "WHERE invoice_date IS NOT NULL GROUP BY 1"))
def _hourly_sales(spark, sf):
    return op.hourly_sales(E(spark, sf))


@register("weekend_vs_weekday", with_sales(
    f"SELECT {money('COALESCE(SUM(CASE WHEN isodow(invoice_date) <= 5 THEN revenue END), 0)')} AS weekday_revenue, "
    f"{money('COALESCE(SUM(CASE WHEN isodow(invoice_date) >= 6 THEN revenue END), 0)')} AS weekend_revenue "
    "FROM sales"))
def _weekend_vs_weekday(spark, sf):
    return op.weekend_vs_weekday(S(spark, sf))


# ── MoM family ───────────────────────────────────────────────────────────────

@register("mom_growth", with_sales(MOM_SQL_BODY, *GROWTH_CTES))
def _mom_growth(spark, sf):
    return op.mom_growth(S(spark, sf))


LATEST_SQL = ("SELECT COALESCE((SELECT ROUND(growth, 2) FROM h WHERE growth IS NOT NULL "
              "ORDER BY month_idx DESC LIMIT 1), 0.0) AS latest_mom")


@register("sales_trend", with_sales(
    "SELECT CASE WHEN latest_mom > 0 THEN 'Up' WHEN latest_mom < 0 THEN 'Down' ELSE 'Stable' END AS trend, "
    f"latest_mom AS growth_pct FROM ({LATEST_SQL})", *GROWTH_CTES))
def _sales_trend(spark, sf):
    return op.sales_trend(S(spark, sf))


@register("revenue_drops", with_sales(
    f"SELECT {MONTH_FROM_IDX} AS month, ROUND(pct, 2) AS growth_pct FROM (SELECT month_idx, "
    "CASE WHEN prev = 0 AND rev < 0 THEN CAST('-inf' AS DOUBLE) ELSE growth END AS pct FROM h) WHERE pct < -15.0",
    *GROWTH_CTES))
def _revenue_drops(spark, sf):
    return op.revenue_drops(S(spark, sf), -15.0)


@register("sales_anomalies", with_sales(
    f"SELECT strftime(day, '%Y-%m-%d') AS day, {money('rev')} AS revenue FROM f, "
    f"(SELECT CAST(s1 AS DOUBLE) / CAST(n AS DOUBLE) AS mean, {sample_std_sql('n', 's1', 's2')} AS sd "
    " FROM (SELECT COUNT(*) AS n, SUM(rev) AS s1, SUM(rev * rev) AS s2 FROM f)) "
    "WHERE CAST(rev AS DOUBLE) > mean + 2.0 * sd", *DAILY_CTES))
def _sales_anomalies(spark, sf):
    return op.sales_anomalies(S(spark, sf))


@register("simple_forecast_7d", with_sales(
    "SELECT ROUND(CAST(SUM(rev) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 7, 2) AS forecast_7_day_gbp, "
    "strftime(MAX(day), '%Y-%m-%d') AS baseline_end, month(MAX(day)) = 12 AS december_warning "
    "FROM (SELECT * FROM f ORDER BY day DESC LIMIT 14)", *DAILY_CTES))
def _simple_forecast_7d(spark, sf):
    return op.simple_forecast_7d(S(spark, sf))


# ── concentration ────────────────────────────────────────────────────────────

@register("pareto_products_count", with_sales(
    "SELECT COUNT(*) FILTER (WHERE CAST(cum AS DOUBLE) / CAST(tot AS DOUBLE) < 0.8) + 1 AS pareto_products_count "
    "FROM (SELECT SUM(rev) OVER (ORDER BY rev DESC, description ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, "
    "SUM(rev) OVER () AS tot FROM (SELECT description, SUM(revenue) AS rev FROM sales WHERE description IS NOT NULL "
    "GROUP BY description))"))
def _pareto(spark, sf):
    return op.pareto_products_count(S(spark, sf))


@register("revenue_concentration", with_sales(
    "SELECT ANY_VALUE(n) AS customers, ANY_VALUE(k) AS top_customers, "
    "CAST(SUM(rev) AS DOUBLE) / CAST(ANY_VALUE(tot) AS DOUBLE) * 100.0 AS concentration_pct "
    "FROM (SELECT rev, ROW_NUMBER() OVER (ORDER BY rev DESC, customer_id) AS pos FROM p), "
    "(SELECT COUNT(*) AS n, SUM(rev) AS tot, greatest(1, CAST(floor(CAST(COUNT(*) AS DOUBLE) * 0.1) AS BIGINT)) AS k FROM p) "
    "WHERE pos <= k",
    "p AS (SELECT customer_id, SUM(revenue) AS rev FROM sales WHERE customer_id IS NOT NULL GROUP BY customer_id)"))
def _revenue_concentration(spark, sf):
    return op.revenue_concentration(S(spark, sf))


# ── customers (sales view) ───────────────────────────────────────────────────

REPEAT_P = "p AS (SELECT customer_id, COUNT(DISTINCT invoice) AS n FROM sales WHERE customer_id IS NOT NULL GROUP BY 1)"


@register("repeat_customers_stats", with_sales(
    "SELECT COUNT(*) FILTER (WHERE n > 1) AS repeat_customers_count, COUNT(*) AS total_customers, "
    "ROUND(CAST(COUNT(*) FILTER (WHERE n > 1) * 100 AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0), 2) AS repeat_pct, "
    "ROUND(COALESCE(CAST(SUM(CASE WHEN n > 1 THEN n END) AS DOUBLE) / NULLIF(CAST(COUNT(*) FILTER (WHERE n > 1) AS DOUBLE), 0), 0.0), 1) "
    "AS avg_orders_per_returning_customer FROM p", REPEAT_P))
def _repeat_customers_stats(spark, sf):
    return op.repeat_customers_stats(S(spark, sf))


@register("avg_days_between_purchases", with_sales(
    "SELECT COALESCE(CAST(SUM(gap) AS DOUBLE) / NULLIF(CAST(COUNT(gap) AS DOUBLE), 0), 0.0) AS avg_days_between_purchases "
    f"FROM (SELECT {DAYS.format(a='prev', b='t')} AS gap FROM (SELECT t, LAG(t) OVER (PARTITION BY customer_id ORDER BY t, invoice) AS prev "
    "FROM (SELECT customer_id, invoice, MIN(invoice_date) AS t FROM sales WHERE customer_id IS NOT NULL "
    "AND invoice_date IS NOT NULL GROUP BY 1, 2)) WHERE prev IS NOT NULL)"))
def _avg_days_between(spark, sf):
    return op.avg_days_between_purchases(S(spark, sf))


# ── product search ───────────────────────────────────────────────────────────

@register("product_family_revenue", with_sales(
    f"SELECT '{KEYWORD}' AS keyword, COUNT(DISTINCT description) AS matching_products_count, "
    f"{money('COALESCE(SUM(revenue), 0)')} AS total_revenue_gbp, "
    "CAST(COALESCE(SUM(CASE WHEN quantity > 0 THEN quantity END), 0) AS BIGINT) AS total_units_sold "
    f"FROM sales WHERE contains(lower(description), '{KEYWORD}')"))
def _product_family_revenue(spark, sf):
    return op.product_family_revenue(S(spark, sf), KEYWORD)


@register("product_family_top", with_sales(
    f"SELECT description, {money('SUM(revenue)')} AS revenue FROM sales WHERE contains(lower(description), '{KEYWORD}') "
    "GROUP BY description ORDER BY SUM(revenue) DESC, description LIMIT 10"))
def _product_family_top(spark, sf):
    return op.product_family_top(S(spark, sf), KEYWORD)


@register("bought_together", with_sales(
    "SELECT description, COUNT(*) AS lines FROM sales WHERE quantity > 0 AND description <> '" + PRODUCT + "' "
    "AND invoice IN (SELECT invoice FROM sales WHERE quantity > 0 AND description = '" + PRODUCT + "') "
    "GROUP BY description ORDER BY lines DESC, description LIMIT 3"))
def _bought_together(spark, sf):
    return op.bought_together(S(spark, sf), PRODUCT, 3)


@register("search_products", with_sales(
    f"SELECT DISTINCT description FROM sales WHERE contains(lower(description), '{KEYWORD}') "
    "ORDER BY description LIMIT 10"))
def _search_products(spark, sf):
    return op.search_products(S(spark, sf), KEYWORD)



@register("mom_growth_by_country", with_sales(
    "SELECT country, " + MONTH_FROM_IDX + f" AS month, {money('rev')} AS revenue, {money('prev')} AS prev_revenue, "
    "ROUND(growth, 2) AS growth_pct, month_idx = MAX(month_idx) OVER (PARTITION BY country) AS is_latest FROM ("
    "SELECT *, CASE WHEN prev <> 0 THEN (CAST(rev AS DOUBLE) / CAST(prev AS DOUBLE) - 1.0) * 100.0 END AS growth FROM ("
    "SELECT country, month_idx, rev, LAG(rev) OVER (PARTITION BY country ORDER BY month_idx) AS prev FROM ("
    "SELECT sp.country, sp.month_idx, COALESCE(m.rev, 0) AS rev FROM (SELECT country, unnest(range(MIN(month_idx), "
    "MAX(month_idx) + 1)) AS month_idx FROM cm GROUP BY country) sp LEFT JOIN cm m ON sp.country IS NOT DISTINCT FROM "
    "m.country AND sp.month_idx = m.month_idx))) WHERE growth IS NOT NULL",
    f"cm AS (SELECT country, {MONTH_IDX} AS month_idx, SUM(revenue) AS rev FROM sales WHERE invoice_date IS NOT NULL "
    "GROUP BY 1, 2)"))
def _mom_growth_by_country(spark, sf):
    return op.mom_growth(S(spark, sf), by=("country",))


@register("dataset_samples", with_sales(
    "SELECT column_name, sample_values FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, (SELECT array_to_string(list(v ORDER BY v), ', ') FROM (SELECT DISTINCT {c} AS v "
        f"FROM sales WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS sample_values"
        for c in ["invoice", "stock_code", "description", "country"]) + ")"))
def _dataset_samples(spark, sf):
    return cl.dataset_samples(S(spark, sf))


@register("repeat_customers_by_country", with_sales(
    "SELECT country, COUNT(*) FILTER (WHERE n > 1) AS repeat_customers_count, COUNT(*) AS total_customers, "
    "ROUND(CAST(COUNT(*) FILTER (WHERE n > 1) * 100 AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0), 2) AS repeat_pct, "
    "ROUND(COALESCE(CAST(SUM(CASE WHEN n > 1 THEN n END) AS DOUBLE) / NULLIF(CAST(COUNT(*) FILTER (WHERE n > 1) AS DOUBLE), 0), 0.0), 1) "
    "AS avg_orders_per_returning_customer FROM (SELECT country, customer_id, COUNT(DISTINCT invoice) AS n FROM sales "
    "WHERE customer_id IS NOT NULL GROUP BY 1, 2) GROUP BY country"))
def _repeat_by_country(spark, sf):
    return op.repeat_customers_stats(S(spark, sf), by=("country",))
