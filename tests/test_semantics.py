"""Hand-computed frames for the shared rules (survey §1.3) and the fixed defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import basket, customers, health, products, sales


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_never_returned_products_rate_zero(mk_sales):
    s = mk_sales([
        (1, "A", 10, 1.0, "2020-01-01", 1, "UK"), (2, "A", -2, 1.0, "2020-01-02", 1, "UK"),
        (3, "B", 5, 1.0, "2020-01-01", 2, "UK"), (4, "C", -3, 1.0, "2020-01-01", 3, "UK")])
    got = {r["description"]: r["return_rate_pct"] for r in rows(products.product_return_rate(s))}
    assert got == {"A": 20.0, "B": 0.0, "C": 100.0}


def test_gap_month_is_zero_filled(mk_sales):
    s = mk_sales([(1, "A", 1, 100.0, "2020-01-10", 1, "UK"), (2, "A", 1, 50.0, "2020-03-10", 1, "UK")])
    g = rows(sales.mom_growth(s))
    assert g == [{"month": "2020-02", "revenue": 0.0, "prev_revenue": 100.0, "growth_pct": -100.0, "is_latest": True}]
    drops = rows(sales.revenue_drops(s))
    assert [d["month"] for d in drops] == ["2020-02"]


def test_elapsed_days_are_floored(mk_sales):
    s = mk_sales([(1, "A", 1, 1.0, "2020-01-01 12:00", 1, "UK"), (2, "A", 1, 1.0, "2020-01-02 11:00", 2, "UK")])
    r = rows(customers.at_risk_customers(s, days=0, limit=None))
    assert {x["customer_id"]: x["days_since_last_purchase"] for x in r} == {1: 0, 2: 0}


def test_month_offset_keeps_time_and_clamps(spark):
    from tallyframe.functions.cols import months_before
    v = spark.range(1).select(months_before(F.lit("2024-05-31 10:00:00").cast("timestamp"), 3).alias("t")).first()["t"]
    assert (v.year, v.month, v.day, v.hour) == (2024, 2, 29, 10)


def test_end_date_includes_last_day(mk_sales):
    s = mk_sales([(1, "A", 1, 10.0, "2020-01-31 10:00", 1, "UK"), (2, "A", 1, 5.0, "2020-02-01 00:00", 1, "UK")])
    assert rows(sales.revenue_by_date_range(s, "2020-01-01", "2020-01-31"))[0]["revenue"] == 10.0
    assert rows(sales.revenue_by_date_range(s, "2020-01-01", "2020-01-31", strict=True))[0]["revenue"] == 0.0


def test_null_dates_in_totals_but_no_bucket(mk_sales):
    s = mk_sales([(1, "A", 1, 10.0, None, 1, "UK"), (2, "A", 1, 5.0, "2020-01-04 10:00", 1, "UK")])
    assert rows(sales.total_revenue(s))[0]["total_revenue"] == 15.0
    assert rows(sales.monthly_revenue(s)) == [{"month": "2020-01", "revenue": 5.0}]
    wk = rows(sales.weekend_vs_weekday(s))[0]
    assert wk == {"weekday_revenue": 0.0, "weekend_revenue": 5.0}   # 2020-01-04 is a Saturday
    assert sum(r["transactions"] for r in rows(sales.busiest_days_of_week(s))) == 1


def test_ties_pick_smallest_key(mk_sales):
    s = mk_sales([(1, "B", 1, 10.0, "2020-01-01", 2, "UK"), (2, "A", 1, 10.0, "2020-01-01", 1, "UK")])
    assert rows(sales.top_products_by_revenue(s, 1))[0]["description"] == "A"
    assert rows(customers.top_customer(s))[0]["customer_id"] == 1


def test_two_cohorts(mk_sales):
    s = mk_sales([
        (1, "A", 1, 1.0, "2020-01-05", 1, "UK"), (2, "A", 1, 1.0, "2020-01-06", 2, "UK"),
        (3, "A", 1, 1.0, "2020-01-07", 3, "UK"), (4, "A", 1, 1.0, "2020-02-05", 1, "UK"),
        (5, "A", 1, 1.0, "2020-02-06", 4, "UK"), (6, "A", 1, 1.0, "2020-02-07", 5, "UK")])
    r = rows(customers.cohort_retention(s))
    assert len(r) == 1
    assert r[0]["cohort"] == "2020-01" and r[0]["cohort_size"] == 3
    assert r[0]["month_0"] == 100.0 and r[0]["month_1"] == 33.3 and r[0]["month_2"] is None


def test_one_order_customer(mk_sales):
    s = mk_sales([(1, "A", 2, 5.0, "2020-01-05", 1, "UK"), (2, "A", 1, 5.0, "2020-03-05", 2, "UK"),
                  (3, "A", 1, 7.0, "2020-04-05", 2, "UK")])
    clv = {r["customer_id"]: r for r in rows(customers.customer_clv(s))}
    assert clv[1]["active_months"] == 1.0 and clv[1]["insufficient_history"] is True
    assert clv[2]["insufficient_history"] is False
    rfm = {r["customer_id"]: r for r in rows(customers.rfm_features(s))}
    assert rfm[1]["std_basket_size"] == 0.0
    assert abs(rfm[2]["std_basket_size"] - 1.4142135623730951) < 1e-12


def test_baskets_multi_item_consequents_and_denominators(mk_sales):
    data = []
    inv = 0
    for items in (["a", "b", "c"],) * 3 + (["a", "d"], ["e"]):
        inv += 1
        for it in items:
            data.append((inv, it, 1, 1.0, "2020-01-01", inv, "UK"))
    s = mk_sales(data)
    rules = rows(basket.market_basket_rules(s, 0.5, 0.5, None))
    multi = [r for r in rules if "," in r["consequent"]]
    assert any(r["antecedent"] == "b" and r["consequent"] == "a, c" and r["confidence"] == 1.0 for r in multi)
    # all invoices (5) in the denominator here, multi-item invoices (4) for pair rules
    ab = [r for r in rules if r["antecedent"] == "a" and r["consequent"] == "b"][0]
    assert ab["support"] == 0.6
    pairs = rows(basket.product_pairs(s, 0.5, 0.5, None))
    ab2 = [r for r in pairs if r["antecedent"] == "a" and r["consequent"] == "b"][0]
    assert ab2["support"] == 0.75


def test_mixed_date_layouts_parse(spark):
    from tallyframe.operators.clean import parse_timestamp
    df = spark.createDataFrame([("2010-01-01 10:00",), ("2010-01-02",), ("not a date",)], "d string")
    got = [r["t"] for r in df.select(parse_timestamp(F.col("d")).alias("t")).collect()]
    assert got[0].hour == 10 and got[1].day == 2 and got[2] is None


def test_aov_two_ways(mk_sales):
    s = mk_sales([(1, "A", 1, 100.0, "2020-01-01", 1, "UK"), (2, "A", -1, 40.0, "2020-01-02", 1, "UK")])
    assert rows(sales.aov_overall(s))[0]["aov"] == 50.0
    assert rows(sales.aov_positive_invoices(s))[0]["aov_positive_invoices"] == 100.0


def test_severity_grid(spark):
    cases = [
        ((-50.0, 10.0, 50.0, "flat"), "WARNING"), ((-50.01, 10.0, 50.0, "flat"), "CRISIS"),
        ((-31.0, 60.0, 50.0, "flat"), "WARNING"), ((-31.0, 60.01, 50.0, "flat"), "CRISIS"),
        ((-1.0, 10.0, 15.0, "flat"), "WARNING"), ((-0.01, 10.0, 14.99, "flat"), "CRISIS"),
        ((10.0, 40.0, 50.0, "flat"), "HEALTHY"), ((10.0, 40.01, 50.0, "flat"), "WARNING"),
        ((-14.99, 10.0, 50.0, "flat"), "HEALTHY"), ((-0.5, 10.0, 50.0, "downward"), "WARNING"),
        ((-30.5, 10.0, 50.0, "downward"), "CRISIS"), ((10.0, 10.0, 25.0, "flat"), "HEALTHY"),
    ]
    sig = spark.createDataFrame([c[0] for c in cases],
                                "latest_mom double, churn_risk_pct double, repeat_rate double, forecast_trend string")
    got = [r["mode"] for r in health.business_severity(sig).collect()]
    assert got == [c[1] for c in cases]


def test_traffic_lights_boundaries(spark):
    sig = spark.createDataFrame([(5.0, 30.0, 35.0)], "latest_mom double, churn_risk_pct double, repeat_rate double")
    r = {x["signal"]: x for x in rows(health.health_preview(sig))}
    assert r["mom_growth"]["color"] == "green" and r["mom_growth"]["display"] == "Stable"
    assert r["churn_risk"]["color"] == "green" and r["churn_risk"]["display"] == "Moderate"
    assert r["repeat_rate"]["color"] == "green" and r["repeat_rate"]["display"] == "Average"


def test_percent_phrase_nearest(spark):
    df = spark.createDataFrame([(52.9,), (33.4,), (74.8,), (11.0,)], "v double")
    got = [r["p"] for r in df.select(health.percent_phrase(F.col("v")).alias("p")).collect()]
    assert got == ["more than half", "about 1 in 3", "three-quarters", "about 1 in 10"]


def test_pareto_and_concentration_match_definition(mk_sales):
    data = [(i, f"P{i}", 1, float(v), "2020-01-01", i, "UK") for i, v in enumerate([50, 20, 10, 10, 5, 5], 1)]
    s = mk_sales(data)
    assert rows(sales.pareto_products_count(s))[0]["pareto_products_count"] == 3
    c = rows(sales.revenue_concentration(s))[0]
    assert c["top_customers"] == 1 and c["concentration_pct"] == 50.0


def test_product_trend_and_lifecycle(mk_sales):
    s = mk_sales([(1, "A", 1, 1.0, "2020-01-01", 1, "UK"), (2, "A", 2, 1.0, "2020-02-01", 1, "UK"),
                  (3, "A", 3, 1.0, "2020-03-01", 1, "UK"), (4, "B", 5, 1.0, "2020-03-01", 1, "UK"),
                  (5, "C", 4, 1.0, "2020-01-01", 1, "UK"), (6, "C", 4, 1.0, "2020-03-01", 1, "UK")])
    tr = {r["description"]: r for r in rows(products.product_sales_trend(s))}
    assert tr["A"]["trend"] == "Up" and tr["A"]["change_pct"] == 50.0
    assert tr["B"]["trend"] == "Not enough history"
    assert tr["C"]["trend"] == "Up" and tr["C"]["prev_units"] == 0     # Feb zero-filled
    lc = {r["description"]: r["lifecycle"] for r in rows(products.product_lifecycle(s))}
    assert lc == {"A": "Growing", "B": "New Product", "C": "Stable"}
    dt = {r["description"]: r for r in rows(products.product_demand_trend(s))}
    assert dt["A"]["monthly_slope_units"] == 1.0 and dt["A"]["months_of_data"] == 3
    assert dt["B"]["trend"] == "insufficient data"
