"""Property tests on small random frames (hypothesis), against brute force in Python."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions.ordered import global_running
from tallyframe.operators import basket, customers, products, sales
from tallyframe.operators.sales import _monthly_series

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

line = st.tuples(st.integers(1, 12),                 # invoice
                 st.sampled_from("abcdef"),           # product
                 st.integers(-3, 9).filter(lambda q: q != 0),
                 st.integers(1, 500),                 # price in pence
                 st.integers(0, 700),                 # day offset
                 st.integers(1, 6))                   # customer
lines = st.lists(line, min_size=3, max_size=40)


def frame(mk_sales, ls):
    t0 = datetime(2020, 1, 1, 9, 0)
    return mk_sales([(inv, p, q, pr / 100.0, (t0 + timedelta(days=d, hours=d % 7)).strftime("%Y-%m-%d %H:%M"),
                      c, "X" if c % 2 else "Y") for inv, p, q, pr, d, c in ls])


@SETTINGS
@given(lines)
def test_shares_and_counts(mk_sales, ls):
    s = frame(mk_sales, ls)
    shares = [r["revenue_share_pct"] for r in products.product_revenue_share(s, None).collect()]
    if all(x is not None for x in shares):
        assert math.isclose(sum(shares), 100.0, rel_tol=1e-9, abs_tol=1e-6)
    ch = customers.churn_risk_summary(s, 30).first()
    assert ch["at_risk_customers"] + ch["healthy_customers"] == ch["total_customers"]
    for r in customers.cohort_retention(s, 12).collect():
        assert r["month_0"] == 100.0
    months = [r["month_idx"] for r in _monthly_series(s).collect()]
    assert sorted(months) == list(range(min(months), max(months) + 1))


@SETTINGS
@given(st.lists(st.sets(st.sampled_from("abcdefg"), min_size=1, max_size=5), min_size=4, max_size=30))
def test_pair_rules_match_brute_force(mk_sales, baskets):
    rows = [(i, it, 1, 1.0, "2020-01-01", i, "X") for i, b in enumerate(baskets, 1) for it in sorted(b)]
    s = mk_sales(rows)
    multi = [b for b in baskets if len(b) >= 2]
    n = len(multi)
    item = Counter(it for b in multi for it in b)
    pair = Counter(p for b in multi for p in itertools.permutations(sorted(b), 2))
    min_count = math.ceil(0.1 * n)
    want = set()
    for (a, c), f in pair.items():
        conf = f / item[a]
        if f >= min_count and conf >= 0.2:
            want.add((a, c, f))
    got = {(r["antecedent"], r["consequent"]) for r in basket.product_pairs(s, 0.1, 0.2, None).collect()}
    assert got == {(a, c) for a, c, _ in want}


@SETTINGS
@given(st.lists(st.integers(-50, 400), min_size=1, max_size=25))
def test_pareto_and_concentration_brute_force(mk_sales, revs):
    rows = [(i, f"P{i:02d}", 1, float(v) if v != 0 else 1.0, "2020-01-01", i, "X") for i, v in enumerate(revs, 1)]
    s = mk_sales(rows)
    vals = sorted(((float(r[3]), r[1]) for r in rows), key=lambda t: (-t[0], t[1]))
    total = sum(v for v, _ in vals)
    cum, cnt = 0.0, 0
    for v, _ in vals:
        cum += v
        if total != 0 and cum / total < 0.8:
            cnt += 1
    if total != 0:
        assert sales.pareto_products_count(s).first()["pareto_products_count"] == cnt + 1
        k = max(1, int(len(vals) * 0.10))
        got = sales.revenue_concentration(s).first()
        assert got["top_customers"] == k
        assert math.isclose(got["concentration_pct"], sum(v for v, _ in vals[:k]) / total * 100, rel_tol=1e-9)


@SETTINGS
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60), st.integers(1, 7))
def test_global_running_is_a_prefix_sum(spark, values, parts):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, v long")
    out = global_running(df, [F.col("v").desc(), F.col("k")], "v", partitions=parts).collect()
    order = sorted(range(len(values)), key=lambda i: (-values[i], i))
    expect = {}
    acc = 0
    for pos, i in enumerate(order, 1):
        acc += values[i]
        expect[i] = (pos, acc)
    assert {r["k"]: (r["_pos"], r["_cum"]) for r in out} == expect


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 50)), min_size=1, max_size=60), st.integers(1, 6))
def test_global_lag_matches_sorted_previous(spark, pairs, parts):
    from tallyframe.functions.ordered import global_lag
    rows = [(i, c, t) for i, (c, t) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "k long, c long, t long")
    out = global_lag(df, [F.col("c"), F.col("t"), F.col("k")], ["c", "t"], partitions=parts).collect()
    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    expect = {order[0][0]: (None, None)}
    for prev, cur in zip(order, order[1:]):
        expect[cur[0]] = (prev[1], prev[2])
    assert {r["k"]: (r["_prev_c"], r["_prev_t"]) for r in out} == expect


raw_line = st.tuples(st.sampled_from(["1", "2", "C3"]), st.sampled_from(["A", "B", None]),
                     st.sampled_from(["1", "-2", "x", None]), st.sampled_from(["2.5", "0", "-1", "abc", None]),
                     st.sampled_from(["2020-01-01 10:00", "2020-01-02", "bad", None]),
                     st.sampled_from(["17850.0", "13047", "", None]))


@SETTINGS
@given(st.lists(raw_line, min_size=1, max_size=30))
def test_cleaning_report_balances(spark, rows):
    from tallyframe.operators import clean
    df = spark.createDataFrame(rows, "invoice string, description string, quantity string, price string, "
                                     "invoice_date string, customer_id string")
    rep = {r["rule"]: r["rows"] for r in clean.cleaning_report(df).collect()}
    removed = rep["duplicate"] + rep["missing_customer_id"] + rep["missing_description"] + rep["non_positive_price"]
    assert rep["total"] == len(rows) and rep["kept"] + removed == rep["total"]
    assert clean.clean_sales(df).count() == rep["kept"]


@SETTINGS
@given(st.lists(st.sets(st.sampled_from("abcde"), min_size=1, max_size=4), min_size=3, max_size=20))
def test_association_rules_match_enumeration(mk_sales, baskets):
    rows = [(i, it, 1, 1.0, "2020-01-01", i, "X") for i, b in enumerate(baskets, 1) for it in sorted(b)]
    s = mk_sales(rows)
    n = len(baskets)
    min_sup, min_conf = 0.2, 0.4
    min_count = math.ceil(min_sup * n)
    items = sorted({x for b in baskets for x in b})
    freq = {}
    for k in range(1, len(items) + 1):
        for combo in itertools.combinations(items, k):
            c = sum(1 for b in baskets if set(combo) <= b)
            if c >= min_count:
                freq[combo] = c
    want = {}
    for iset, f in freq.items():
        if len(iset) < 2:
            continue
        for r in range(1, len(iset)):
            for ante in itertools.combinations(iset, r):
                cons = tuple(x for x in iset if x not in ante)
                conf = f / freq[ante]
                if conf >= min_conf:
                    want[(", ".join(ante), ", ".join(cons))] = round(conf, 3)
    got = {(r["antecedent"], r["consequent"]): r["confidence"]
           for r in basket.market_basket_rules(s, min_sup, min_conf, None).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_global_running_without_exchange_reuse(spark):
    vals = [(i, (i * 37) % 101) for i in range(300)]
    df = spark.createDataFrame(vals, "k long, v long")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        out = {r["k"]: (r["_pos"], r["_cum"]) for r in
               global_running(df, [F.col("v").desc(), F.col("k")], "v", partitions=7).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    order = sorted(vals, key=lambda t: (-t[1], t[0]))
    acc, expect = 0, {}
    for pos, (k, v) in enumerate(order, 1):
        acc += v
        expect[k] = (pos, acc)
    assert out == expect
