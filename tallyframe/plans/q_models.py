"""Registered model and forecast questions. Fitted models are kept per
(session, state of the tables, parameters): neither another threshold nor changed tables are
served by one."""

from __future__ import annotations

from tallyframe.operators import forecast as fc
from tallyframe.operators import ml
from tallyframe.plans.q_sales import MONTH_IDX
from tallyframe.plans.registry import S, money, register, with_sales
from tallyframe.sources import catalog
from tallyframe.sources.star import STAR_TABLES

_MODELS: dict = {}


def churn(spark, sf, days: int = 90):
    key = ("churn", id(spark), catalog.fingerprint(spark, sf, STAR_TABLES), days)
    if key not in _MODELS:
        _MODELS[key] = ml.churn_model(S(spark, sf), days)
    return _MODELS[key]


def segments(spark, sf, k=None):
    key = ("seg", id(spark), catalog.fingerprint(spark, sf, STAR_TABLES), k)
    if key not in _MODELS:
        _MODELS[key] = ml.customer_segments(S(spark, sf), k)
    return _MODELS[key]


@register("churn_scores", None)
def _churn_scores(spark, sf):
    return churn(spark, sf).scores.drop("_p")


@register("churn_model_metrics", None)
def _churn_metrics(spark, sf):
    return churn(spark, sf).metrics


@register("churn_feature_importances", None)
def _churn_importances(spark, sf):
    return churn(spark, sf).importances


@register("churn_feature_attribution", None)
def _churn_attribution(spark, sf):
    return ml.churn_feature_attribution(S(spark, sf), churn(spark, sf))


@register("churn_customer_attribution", None)
def _churn_customer_attribution(spark, sf):
    return ml.churn_attribution(churn(spark, sf))


@register("customer_segments", None)
def _customer_segments(spark, sf):
    return segments(spark, sf).summary


@register("customer_segment_assignments", None)
def _segment_assignments(spark, sf):
    return segments(spark, sf).assignments


@register("segment_k_scores", None)
def _segment_k(spark, sf):
    return segments(spark, sf).k_scores


@register("clv_by_segment", None)
def _clv_by_segment(spark, sf):
    return ml.clv_by_segment(S(spark, sf), 12, segments(spark, sf))


@register("churn_adjusted_clv", None)
def _churn_adjusted_clv(spark, sf):
    return ml.churn_adjusted_clv(S(spark, sf), 12, churn(spark, sf))


LINEAR_CTES = [
    f"mm AS (SELECT {MONTH_IDX} AS month_idx, SUM(revenue) AS rev FROM sales WHERE quantity > 0 AND invoice_date IS NOT NULL GROUP BY 1)",
    "msp AS (SELECT unnest(range(MIN(month_idx), MAX(month_idx) + 1)) AS month_idx FROM mm)",
    "mf AS (SELECT msp.month_idx, COALESCE(mm.rev, 0) AS rev FROM msp LEFT JOIN mm USING (month_idx))",
    "mp AS (SELECT month_idx, rev, CAST(ROW_NUMBER() OVER (ORDER BY month_idx) - 1 AS BIGINT) AS x FROM mf WHERE rev > 0)",
    "ms AS (SELECT COUNT(*) AS n, SUM(rev) AS sy, SUM(x * rev) AS sxy, MAX(month_idx) AS last_idx, "
    "arg_max(rev, month_idx) AS last_rev, median(rev) AS med FROM mp)",
    "mo AS (SELECT COUNT(*) FILTER (WHERE CAST(rev AS DOUBLE) > 5.0 * CAST(med AS DOUBLE)) AS outlier_months FROM mp, ms)",
    "mx AS (SELECT *, CAST(n * (n - 1) / 2 AS BIGINT) AS sx, CAST((n - 1) * n * (n * 2 - 1) / 6 AS BIGINT) AS sxx FROM ms, mo WHERE n >= 3)",
    "ml AS (SELECT *, CASE WHEN CAST(n AS DOUBLE) * CAST(sxx AS DOUBLE) - CAST(sx AS DOUBLE) * CAST(sx AS DOUBLE) <> 0 THEN "
    "(CAST(n AS DOUBLE) * CAST(sxy AS DOUBLE) - CAST(sx AS DOUBLE) * CAST(sy AS DOUBLE)) / "
    "(CAST(n AS DOUBLE) * CAST(sxx AS DOUBLE) - CAST(sx AS DOUBLE) * CAST(sx AS DOUBLE)) END AS slope FROM mx)",
    "mi AS (SELECT *, (CAST(sy AS DOUBLE) - slope * CAST(sx AS DOUBLE)) / CAST(n AS DOUBLE) AS intercept FROM ml)",
]


@register("revenue_forecast_linear", with_sales(
    "SELECT printf('%04d-%02d', (last_idx + step) // 12, (last_idx + step) % 12 + 1) AS month, "
    "ROUND(greatest(intercept + slope * CAST(n - 1 + step AS DOUBLE), 0.0), 2) AS predicted_gbp, "
    "ROUND(slope, 2) AS monthly_slope_gbp, ROUND(intercept, 2) AS intercept_gbp, "
    "printf('%04d-%02d', last_idx // 12, last_idx % 12 + 1) AS last_actual_month, "
    f"{money('last_rev')} AS last_actual_revenue_gbp, ROUND(CAST(sy AS DOUBLE) / CAST(n AS DOUBLE), 2) AS historical_avg_monthly_gbp, "
    "CASE WHEN slope > 0 THEN 'upward' WHEN slope < 0 THEN 'downward' ELSE 'flat' END AS trend, outlier_months "
    "FROM mi, (SELECT unnest(range(1, 4)) AS step)", *LINEAR_CTES))
def _revenue_forecast_linear(spark, sf):
    return fc.revenue_forecast_linear(S(spark, sf), 3)


@register("revenue_forecast", None)
def _revenue_forecast(spark, sf):
    return fc.revenue_forecast(S(spark, sf), 3)


@register("revenue_forecast_by_country", None)
def _revenue_forecast_by_country(spark, sf):
    return fc.revenue_forecast_by_series(S(spark, sf), "country", 3)


@register("revenue_forecast_backtest", None)
def _revenue_forecast_backtest(spark, sf):
    return fc.forecast_backtest(S(spark, sf), "country")
