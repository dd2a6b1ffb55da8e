"""Registered single-entity lookups (one customer, one product, one country).

The operators filter first, so the scan reads only the entity's rows; the SQL
statements filter the bulk statement's output, which must give the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import customers as cu
from tallyframe.operators import products as pr
from tallyframe.operators import sales as sa
from tallyframe.plans.registry import COUNTRY, PRODUCT, REGISTRY, S, register

CUSTOMER = 100
COUNTRY_EXACT = "NATION_3"          # top_customer matches the country exactly (case-sensitive)


def _filtered(bulk: str, cond: str) -> str:
    return f"SELECT * FROM ({REGISTRY[bulk][1]}) WHERE {cond}"


@register("customer_profile_one", _filtered("customer_profiles", f"customer_id = {CUSTOMER}"))
def _profile_one(spark, sf):
    return cu.customer_profiles(S(spark, sf), customer_id=CUSTOMER)


@register("customer_orders_one", _filtered("customer_orders", f"customer_id = {CUSTOMER}"))
def _orders_one(spark, sf):
    return cu.customer_orders(S(spark, sf), customer_id=CUSTOMER)


@register("customer_clv_one", _filtered("customer_clv", f"customer_id = {CUSTOMER}"))
def _clv_one(spark, sf):
    return cu.customer_clv(S(spark, sf), 12, customer_id=CUSTOMER)


@register("customer_product_units_one",
          _filtered("customer_product_units", f"customer_id = {CUSTOMER} AND product = '{PRODUCT}'"))
def _cpu_one(spark, sf):
    return cu.customer_product_units(S(spark, sf), customer_id=CUSTOMER, product=PRODUCT.upper())


@register("product_sales_trend_one", _filtered("product_sales_trend", f"description = '{PRODUCT}'"))
def _trend_one(spark, sf):
    return pr.product_sales_trend(S(spark, sf), PRODUCT)


@register("product_lifecycle_one", _filtered("product_lifecycle", f"description = '{PRODUCT}'"))
def _lifecycle_one(spark, sf):
    return pr.product_lifecycle(S(spark, sf), PRODUCT)


@register("product_demand_trend_one", _filtered("product_demand_trend", f"lower(description) = '{PRODUCT}'"))
def _demand_one(spark, sf):
    return pr.product_demand_trend(S(spark, sf), PRODUCT.upper())


@register("top_customer_in_country", _filtered("top_customer_by_country", f"country = '{COUNTRY_EXACT}'"))
def _top_customer_country(spark, sf):
    return cu.top_customer(S(spark, sf), country=COUNTRY_EXACT).select(F.lit(COUNTRY_EXACT).alias("country"), "*")


@register("country_revenue_one", _filtered("country_revenue", f"lower(country) = '{COUNTRY}'"))
def _country_revenue_one(spark, sf):
    return sa.country_revenue(S(spark, sf), COUNTRY)
