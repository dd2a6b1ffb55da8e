"""Registered composites and rule tables (survey §2.6) with their SQL."""

from __future__ import annotations

from tallyframe.operators import health as he
from tallyframe.plans import dashboard as db
from tallyframe.plans.oracle import EVENT_SALES_CTE
from tallyframe.plans.q_customers import LAST_SEEN
from tallyframe.plans.q_models import LINEAR_CTES
from tallyframe.plans.q_products import WINDOW_CTES
from tallyframe.plans.q_sales import GROWTH_CTES, REFUND_SQL, REPEAT_P
from tallyframe.plans.registry import E, S, money, register, with_sales
from tallyframe.sources import catalog

LATEST = ("COALESCE((SELECT ROUND(growth, 2) FROM h WHERE growth IS NOT NULL ORDER BY month_idx DESC LIMIT 1), 0.0)")
POS_REV = "COALESCE(SUM(CASE WHEN quantity > 0 THEN revenue END), 0)"

KPI_SQL = with_sales(
    f"SELECT (SELECT {money(POS_REV)} FROM sales) AS total_revenue, "
    "(SELECT COUNT(DISTINCT invoice) FROM sales) AS total_orders, "
    "(SELECT CAST(COALESCE(SUM(CASE WHEN quantity > 0 THEN quantity END), 0) AS BIGINT) FROM sales) AS total_items, "
    f"(SELECT COALESCE(CAST({POS_REV} AS DOUBLE) / NULLIF(CAST(COUNT(DISTINCT invoice) AS DOUBLE), 0), 0.0) FROM sales) AS aov, "
    f"(SELECT {REFUND_SQL.replace(' AS refund_rate_pct', '')} FROM sales) AS refund_rate, "
    f"{LATEST} AS mom_growth, (SELECT COUNT(*) FROM sales) AS records", *GROWTH_CTES)


@register("dashboard_kpis", KPI_SQL)
def _dashboard_kpis(spark, sf):
    return db.dashboard_kpis_of(catalog.sales_rollup(spark, sf))


@register("dashboard_charts", with_sales(
    f"SELECT 'monthly_revenue' AS chart, strftime(invoice_date, '%Y-%m') AS label, {money('SUM(revenue)')} AS value "
    "FROM sales WHERE invoice_date IS NOT NULL GROUP BY 2 UNION ALL "
    f"SELECT * FROM (SELECT 'top_countries', country, {money('SUM(revenue)')} FROM sales WHERE country IS NOT NULL "
    "GROUP BY country ORDER BY SUM(revenue) DESC, country LIMIT 5) UNION ALL "
    f"SELECT * FROM (SELECT 'top_products', description, {money('SUM(revenue)')} FROM sales WHERE quantity > 0 AND "
    "description IS NOT NULL GROUP BY description ORDER BY SUM(revenue) DESC, description LIMIT 8) UNION ALL "
    f"SELECT 'hourly_sales', printf('%d:00', hour(invoice_date)), {money('SUM(revenue)')} FROM event_sales "
    "WHERE invoice_date IS NOT NULL GROUP BY hour(invoice_date)", EVENT_SALES_CTE))
def _dashboard_charts(spark, sf):
    return db.dashboard_charts_of(catalog.sales_rollup(spark, sf), E(spark, sf))


@register("prediction_metrics", with_sales(
    "SELECT strftime(ANY_VALUE(ref), '%Y-%m-%d') AS reference_date, 90 AS days_inactive_threshold, COUNT(*) AS total_customers, "
    "COUNT(*) FILTER (WHERE idle >= 90) AS at_risk_customers, COUNT(*) - COUNT(*) FILTER (WHERE idle >= 90) AS healthy_customers, "
    "ROUND(COALESCE(CAST(COUNT(*) FILTER (WHERE idle >= 90) * 100 AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0), 0.0), 1) "
    "AS churn_risk_pct, (SELECT COUNT(*) FILTER (WHERE n > 1) FROM p) AS returned_for_second_purchase, "
    "(SELECT ROUND(COALESCE(CAST(COUNT(*) FILTER (WHERE n > 1) * 100 AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0), 0.0), 1) FROM p) "
    "AS repeat_purchase_probability_pct, (SELECT ROUND(COALESCE(CAST(SUM(CASE WHEN n > 1 THEN n END) AS DOUBLE) / "
    "NULLIF(CAST(COUNT(*) FILTER (WHERE n > 1) AS DOUBLE), 0), 0.0), 1) FROM p) AS avg_orders_per_returning_customer FROM ls",
    *LAST_SEEN, REPEAT_P))
def _prediction_metrics(spark, sf):
    return db.prediction_metrics_of(catalog.sales_rollup(spark, sf))


@register("prediction_charts", with_sales(
    "SELECT 'forecast' AS chart, printf('%04d-%02d', (last_idx + step) // 12, (last_idx + step) % 12 + 1) AS label, "
    "ROUND(greatest(intercept + slope * CAST(n - 1 + step AS DOUBLE), 0.0), 2) AS value FROM mi, "
    "(SELECT unnest(range(1, 4)) AS step) UNION ALL "
    "SELECT * FROM (SELECT 'high_growth', description, ROUND(CAST(recent_units - prior_units AS DOUBLE) / "
    "CAST(prior_units AS DOUBLE) * 100.0, 1) AS g FROM wf ORDER BY g DESC, description LIMIT 5) UNION ALL "
    "SELECT * FROM (SELECT 'slow_movers', description, ROUND(CAST(prior_units - recent_units AS DOUBLE) / "
    "CAST(prior_units AS DOUBLE) * 100.0, 1) AS d FROM wf ORDER BY d DESC, description LIMIT 8)",
    *LINEAR_CTES, *WINDOW_CTES))
def _prediction_charts(spark, sf):
    return db.prediction_charts(S(spark, sf))


SIGNAL_CTES = [
    *GROWTH_CTES, *LAST_SEEN, *LINEAR_CTES, REPEAT_P,
    "cp AS (SELECT customer_id, SUM(revenue) AS rev FROM sales WHERE customer_id IS NOT NULL GROUP BY customer_id)",
    "ck AS (SELECT COUNT(*) AS n, SUM(rev) AS tot, greatest(1, CAST(floor(CAST(COUNT(*) AS DOUBLE) * 0.1) AS BIGINT)) AS k FROM cp)",
    "cr AS (SELECT rev, ROW_NUMBER() OVER (ORDER BY rev DESC, customer_id) AS pos FROM cp)",
    "nref AS (SELECT MAX(invoice_date) AS ref FROM sales WHERE customer_id IS NOT NULL AND invoice_date IS NOT NULL)",
    "nf AS (SELECT customer_id, MIN(invoice_date) AS f FROM sales WHERE customer_id IS NOT NULL AND invoice_date IS NOT NULL GROUP BY 1)",
    "nc AS (SELECT ref - INTERVAL 3 MONTH AS cut, ref - INTERVAL 3 MONTH - INTERVAL 3 MONTH AS pcut FROM nref)",
    f"sig AS (SELECT {LATEST} AS latest_mom, "
    "COALESCE((SELECT ROUND(COALESCE(CAST(COUNT(*) FILTER (WHERE idle >= 90) * 100 AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0), 0.0), 1) FROM ls), 0.0) AS churn_risk_pct, "
    "(SELECT ROUND(COALESCE(CAST(COUNT(*) FILTER (WHERE n > 1) * 100 AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0), 0.0), 2) FROM p) AS repeat_rate, "
    "COALESCE((SELECT CASE WHEN slope > 0 THEN 'upward' WHEN slope < 0 THEN 'downward' ELSE 'flat' END FROM mi), 'insufficient data') AS forecast_trend, "
    "COALESCE((SELECT CAST(SUM(rev) AS DOUBLE) / CAST(ANY_VALUE(tot) AS DOUBLE) * 100.0 FROM cr, ck WHERE pos <= k), 0.0) AS concentration_pct, "
    "(SELECT COUNT(*) FILTER (WHERE f >= cut) FROM nf, nc) AS new_customers_recent, "
    "(SELECT COUNT(*) FILTER (WHERE f >= pcut AND f < cut) FROM nf, nc) AS new_customers_prior)",
]


def _signals(spark, sf):
    return catalog.sales_signals(spark, sf)


@register("signals", with_sales("SELECT * FROM sig", *SIGNAL_CTES))
def _signals_q(spark, sf):
    return _signals(spark, sf)


@register("health_preview", with_sales(
    "SELECT 'mom_growth' AS signal, ROUND(latest_mom, 1) AS value, CASE WHEN latest_mom > 5 THEN 'Growing' "
    "WHEN latest_mom > -5 THEN 'Stable' ELSE 'Declining' END AS display, CASE WHEN latest_mom >= 5 THEN 'green' "
    "WHEN latest_mom >= -5 THEN 'yellow' ELSE 'red' END AS color FROM sig UNION ALL "
    "SELECT 'churn_risk', ROUND(churn_risk_pct, 1), CASE WHEN churn_risk_pct < 30 THEN 'Low risk' WHEN churn_risk_pct < 55 "
    "THEN 'Moderate' ELSE 'High risk' END, CASE WHEN churn_risk_pct <= 30 THEN 'green' WHEN churn_risk_pct <= 55 THEN 'yellow' "
    "ELSE 'red' END FROM sig UNION ALL "
    "SELECT 'repeat_rate', ROUND(repeat_rate, 1), CASE WHEN repeat_rate > 35 THEN 'Strong' WHEN repeat_rate > 20 THEN 'Average' "
    "ELSE 'Needs work' END, CASE WHEN repeat_rate >= 35 THEN 'green' WHEN repeat_rate >= 20 THEN 'yellow' ELSE 'red' END FROM sig",
    *SIGNAL_CTES))
def _health_preview(spark, sf):
    return he.health_preview(_signals(spark, sf))


@register("business_severity", with_sales(
    "SELECT latest_mom, churn_risk_pct, repeat_rate, forecast_trend, CASE "
    "WHEN latest_mom < -50 OR (latest_mom < -30 AND churn_risk_pct > 60) OR (forecast_trend = 'downward' AND latest_mom < -30) "
    "OR (repeat_rate < 15 AND latest_mom < 0) THEN 'CRISIS' "
    "WHEN (latest_mom >= -50 AND latest_mom <= -15) OR churn_risk_pct > 40 OR (forecast_trend = 'downward' AND latest_mom < 0) "
    "OR repeat_rate < 25 THEN 'WARNING' ELSE 'HEALTHY' END AS mode, CASE "
    "WHEN latest_mom < -50 THEN 'latest_mom < -50' "
    "WHEN latest_mom < -30 AND churn_risk_pct > 60 THEN 'latest_mom < -30 and churn_risk_pct > 60' "
    "WHEN forecast_trend = 'downward' AND latest_mom < -30 THEN 'forecast downward and latest_mom < -30' "
    "WHEN repeat_rate < 15 AND latest_mom < 0 THEN 'repeat_rate < 15 and latest_mom < 0' "
    "WHEN latest_mom >= -50 AND latest_mom <= -15 THEN '-50 <= latest_mom <= -15' "
    "WHEN churn_risk_pct > 40 THEN 'churn_risk_pct > 40' "
    "WHEN forecast_trend = 'downward' AND latest_mom < 0 THEN 'forecast downward and latest_mom < 0' "
    "WHEN repeat_rate < 25 THEN 'repeat_rate < 25' END AS trigger FROM sig", *SIGNAL_CTES))
def _business_severity(spark, sf):
    return he.business_severity(_signals(spark, sf))


@register("diagnostic_triggers", with_sales(
    "SELECT latest_mom < -50 AS t1_sales_collapse, churn_risk_pct > 60 AS t2_high_churn, "
    "(new_customers_recent = 0 OR new_customers_recent <= new_customers_prior * 0.1) AS t3_no_new_customers, "
    "repeat_rate < 15 AS t4_low_repeat, concentration_pct > 70 AS t5_concentration, concentration_pct > 50 AS concentration_flag "
    "FROM sig", *SIGNAL_CTES))
def _diagnostic_triggers(spark, sf):
    return he.diagnostic_triggers(_signals(spark, sf))


PHRASES = " UNION ALL ".join(f"SELECT {float(p)} AS p, '{t}' AS t" for p, t in he.PERCENT_PHRASES)


@register("signal_phrases", with_sales(
    "SELECT signal, value, (SELECT t FROM phr ORDER BY abs(p - value), p LIMIT 1) AS phrase FROM ("
    "SELECT 'churn_risk_pct' AS signal, CAST(churn_risk_pct AS DOUBLE) AS value FROM sig UNION ALL "
    "SELECT 'repeat_rate', CAST(repeat_rate AS DOUBLE) FROM sig UNION ALL "
    "SELECT 'latest_mom_abs', CAST(abs(latest_mom) AS DOUBLE) FROM sig UNION ALL "
    "SELECT 'concentration_pct', CAST(concentration_pct AS DOUBLE) FROM sig)",
    *SIGNAL_CTES, f"phr AS ({PHRASES})"))
def _signal_phrases(spark, sf):
    return he.signal_phrases(_signals(spark, sf))


@register("revenue_at_stake", with_sales(
    "SELECT n AS customers_considered, ROUND(v, 2) AS at_risk_revenue_gbp, ROUND(v * 0.3, 2) AS recoverable_gbp, "
    "tn AS top_customers, ROUND(COALESCE(ts, 0.0), 2) AS top_at_risk_revenue_gbp, ROUND(COALESCE(ts, 0.0) * 0.3, 2) AS top_recoverable_gbp, "
    "CASE WHEN n > 0 THEN 'at_risk_spend' ELSE 'aov_times_at_risk' END AS method FROM (SELECT n, tn, ts, CASE WHEN n > 0 THEN s "
    f"ELSE (SELECT COALESCE(CAST({POS_REV} AS DOUBLE) / NULLIF(CAST(COUNT(DISTINCT invoice) AS DOUBLE), 0), 0.0) FROM sales) "
    "* (SELECT COUNT(*) FILTER (WHERE idle >= 90) FROM ls) END AS v FROM (SELECT COUNT(*) AS n, CAST(SUM(CAST(spend AS DECIMAL(38, 2))) AS DOUBLE) AS s, "
    "COUNT(*) FILTER (WHERE place <= 15) AS tn, CAST(SUM(CAST(spend AS DECIMAL(38, 2))) FILTER (WHERE place <= 15) AS DOUBLE) AS ts FROM ("
    f"SELECT {money('COALESCE(sp.spend, 0)')} AS spend, ROW_NUMBER() OVER (ORDER BY COALESCE(sp.spend, 0) DESC, ls.customer_id) AS place FROM ls LEFT JOIN (SELECT customer_id, "
    "COALESCE(SUM(CASE WHEN quantity > 0 THEN revenue END), 0) AS spend FROM sales WHERE customer_id IS NOT NULL "
    "GROUP BY customer_id) sp USING (customer_id) WHERE idle >= 90)))",
    *LAST_SEEN))
def _revenue_at_stake(spark, sf):
    return he.revenue_at_stake(S(spark, sf))


@register("promotion_gate", with_sales(
    f"SELECT w.description, {money('greatest(pr - rr, 0)')} AS impact_gbp, r.refund_rate_pct, ru < pu AS declining, "
    "CASE WHEN greatest(pr - rr, 0) < 500.0 THEN 'deprioritise' WHEN ru < pu THEN 'ask_first' "
    "WHEN r.refund_rate_pct > 15.0 THEN 'promote_with_risk_warning' ELSE 'promote' END AS decision FROM ("
    "SELECT description, COALESCE(SUM(CASE WHEN invoice_date >= cut THEN revenue END), 0) AS rr, "
    "COALESCE(SUM(CASE WHEN invoice_date >= pcut AND invoice_date < cut THEN revenue END), 0) AS pr, "
    "COALESCE(SUM(CASE WHEN invoice_date >= cut THEN quantity END), 0) AS ru, "
    "COALESCE(SUM(CASE WHEN invoice_date >= pcut AND invoice_date < cut THEN quantity END), 0) AS pu "
    "FROM sales, rf WHERE invoice_date IS NOT NULL AND description IS NOT NULL AND quantity > 0 GROUP BY description) w "
    "LEFT JOIN (SELECT description, COALESCE(CAST(COUNT(*) FILTER (WHERE quantity < 0) * 100 AS DOUBLE) / "
    "NULLIF(CAST(COUNT(*) FILTER (WHERE quantity > 0) + COUNT(*) FILTER (WHERE quantity < 0) AS DOUBLE), 0), 0.0) "
    "AS refund_rate_pct FROM sales WHERE description IS NOT NULL GROUP BY description) r USING (description)",
    *WINDOW_CTES[:1]))
def _promotion_gate(spark, sf):
    return he.promotion_gate(S(spark, sf))


@register("model_uncertainty_flags", None)
def _model_uncertainty_flags(spark, sf):
    from tallyframe.operators import customers as cu
    from tallyframe.operators import products as pr
    from tallyframe.operators import forecast as fc
    from tallyframe.plans.q_models import churn
    s = S(spark, sf)
    return he.model_uncertainty_flags(fc.revenue_forecast(s, 3), cu.customer_clv(s), churn(spark, sf).metrics,
                                      cu.cohort_retention(s), pr.product_demand_trend(s))


@register("dashboard_kpis_by_country", with_sales(
    f"SELECT b.country, {money(POS_REV)} AS total_revenue, COUNT(DISTINCT invoice) AS total_orders, "
    "CAST(COALESCE(SUM(CASE WHEN quantity > 0 THEN quantity END), 0) AS BIGINT) AS total_items, "
    f"COALESCE(CAST({POS_REV} AS DOUBLE) / NULLIF(CAST(COUNT(DISTINCT invoice) AS DOUBLE), 0), 0.0) AS aov, "
    f"{REFUND_SQL.replace(' AS refund_rate_pct', '')} AS refund_rate, "
    "COALESCE(ANY_VALUE(g.mom), 0.0) AS mom_growth, COUNT(*) AS records FROM sales b LEFT JOIN ("
    "SELECT country, ROUND(growth, 2) AS mom FROM (SELECT country, month_idx, growth, MAX(month_idx) OVER (PARTITION BY country) "
    "AS last FROM (SELECT country, month_idx, CASE WHEN prev <> 0 THEN (CAST(rev AS DOUBLE) / CAST(prev AS DOUBLE) - 1.0) * 100.0 "
    "END AS growth FROM (SELECT country, month_idx, rev, LAG(rev) OVER (PARTITION BY country ORDER BY month_idx) AS prev FROM ("
    "SELECT sp.country, sp.month_idx, COALESCE(m.rev, 0) AS rev FROM (SELECT country, unnest(range(MIN(month_idx), "
    "MAX(month_idx) + 1)) AS month_idx FROM cm GROUP BY country) sp LEFT JOIN cm m ON sp.country IS NOT DISTINCT FROM "
    "m.country AND sp.month_idx = m.month_idx))) WHERE growth IS NOT NULL) WHERE month_idx = last) g "
    "ON b.country IS NOT DISTINCT FROM g.country GROUP BY b.country",
    "cm AS (SELECT country, (year(invoice_date) * 12 + month(invoice_date) - 1) AS month_idx, SUM(revenue) AS rev "
    "FROM sales WHERE invoice_date IS NOT NULL GROUP BY 1, 2)"))
def _dashboard_kpis_by_country(spark, sf):
    return db.dashboard_kpis_by(S(spark, sf), ("country",))
