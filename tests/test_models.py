"""Behaviour and invariants of the model operators (values are library-specific)."""

from __future__ import annotations

import pytest

from tallyframe.operators import forecast, ml, shapley
from tallyframe.sources import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sales(spark):
    return catalog.sales(spark, SF)


def test_churn_model_invariants(sales):
    cm = ml.churn_model(sales, 90, num_trees=20)
    sc = cm.scores.collect()
    assert all(0.0 <= r["churn_probability"] <= 100.0 for r in sc)
    assert len({r["customer_id"] for r in sc}) == len(sc)
    imp = [r["importance_pct"] for r in cm.importances.collect()]
    assert abs(sum(imp) - 100.0) < 1.0
    m = cm.metrics.first()
    assert 0 <= m["accuracy"] <= 100 and m["training_samples"] > 0
    again = ml.churn_model(sales, 90, num_trees=20).scores.orderBy("customer_id").collect()
    assert [r["churn_probability"] for r in again] == [r["churn_probability"] for r in
                                                      cm.scores.orderBy("customer_id").collect()]
    other = ml.churn_model(sales, 30, num_trees=20)
    assert other.metrics.first()["churn_threshold_days"] == 30


def test_segments_labels_and_sizes(sales):
    seg = ml.customer_segments(sales, k=4)
    summ = seg.summary.collect()
    assert sorted(r["label"] for r in summ) == sorted(ml.SEGMENT_LABELS[:4])
    assert sum(r["customer_count"] for r in summ) == seg.assignments.count()
    assert abs(sum(r["pct_of_total"] for r in summ) - 100.0) < 0.5
    by_seg = {r["segment"]: r["customer_count"] for r in ml.clv_by_segment(sales, 12, seg).collect()}
    assert by_seg == {r["label"]: r["customer_count"] for r in summ}


def test_attribution_adds_up_for_every_customer(sales):
    cm = ml.churn_model(sales, 90, num_trees=10)
    rows = ml.churn_attribution(cm)
    got = rows.collect()
    assert len(got) == cm.scores.count() and len({r["customer_id"] for r in got}) == len(got)
    for r in got:
        assert r["base_value"] + sum(r[f"shap_{f}"] for f in cm.features) == pytest.approx(r["score"], abs=1e-9)
    means = {r["feature"]: r["mean_abs_shap"] for r in ml.churn_feature_attribution(sales, cm).collect()}
    assert set(means) == set(ml.FEATURES)
    for f in cm.features:
        assert means[f] == pytest.approx(sum(abs(r[f"shap_{f}"]) for r in got) / len(got), abs=6e-5)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]


def test_attribution_against_all_coalitions(spark):
    """Every coalition of features, walked down the trees of a small forest node by node."""
    from itertools import combinations
    from math import factorial

    import numpy as np
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(4)
    names = ["a", "b", "c", "d"]
    x = rng.integers(0, 12, (160, 4)).astype(float)
    label = ((x[:, 0] > 5) ^ (x[:, 1] * x[:, 2] > 30)).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(y)) for r, y in zip(x, label)], ", ".join(f"{n} double" for n in names) + ", label double")
    data = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    model = RandomForestClassifier(numTrees=3, maxDepth=4, seed=5).fit(data)

    def value(node, row, known):
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return stats[1] / sum(stats)
        f, cut = node.split().featureIndex(), node.split().threshold()
        left, right = node.leftChild(), node.rightChild()
        if f in known:
            return value(left if row[f] <= cut else right, row, known)
        wl, wr = sum(left.impurityStats().stats()), sum(right.impurityStats().stats())
        return (wl * value(left, row, known) + wr * value(right, row, known)) / (wl + wr)

    roots = [t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode") for t in model.trees]
    some = df.limit(4)
    for r in shapley.explain(some, model, names).collect():
        row = [r[n] for n in names]
        v = {s: np.mean([value(t, row, s) for t in roots]) for k in range(5) for s in combinations(range(4), k)}
        assert r["base_value"] == pytest.approx(v[()])
        for j, name in enumerate(names):
            rest = [i for i in range(4) if i != j]
            want = sum(factorial(k) * factorial(3 - k) / 24 * (v[tuple(sorted((*s, j)))] - v[s]) for k in range(4) for s in combinations(rest, k))
            assert r[f"shap_{name}"] == pytest.approx(want, abs=1e-9)


def test_split_is_exact_in_each_class(spark):
    rows = spark.range(1003).selectExpr("cast(id as string) AS customer_id", "cast(id % 10 = 0 AS double) AS label", "id AS z").repartition(5)
    got = ml.stratified_split(rows, "customer_id", "label", 0.75).collect()
    assert len(got) == 1003 and len({r["customer_id"] for r in got}) == 1003
    for c in (0.0, 1.0):
        mine = [r["is_train"] for r in got if r["label"] == c]
        assert sum(mine) == int(0.75 * len(mine) + 0.5)
    again = ml.stratified_split(rows.repartition(2), "customer_id", "label", 0.75).collect()
    assert {r["customer_id"] for r in got if r["is_train"]} == {r["customer_id"] for r in again if r["is_train"]}
    one = spark.createDataFrame([("a", 1.0)], "customer_id string, label double")
    assert [r["is_train"] for r in ml.stratified_split(one, "customer_id", "label", 0.75).collect()] == [True]
    assert ml.stratified_split(rows.limit(0), "customer_id", "label", 0.75).collect() == []


def test_seasonal_forecast_shape(sales):
    fc = forecast.revenue_forecast(sales, 3).collect()
    assert len(fc) == 3
    assert all(r["lower_bound_gbp"] <= r["predicted_gbp"] <= r["upper_bound_gbp"] for r in fc)
    assert fc[0]["is_partial_month"] in (True, False)


def test_uk_holidays(spark):
    from pyspark.sql import functions as F
    days = ["2024-03-29", "2024-04-01", "2024-05-06", "2024-05-27", "2024-08-26", "2024-12-25", "2024-12-26",
            "2021-12-27", "2021-12-28", "2022-01-03", "2024-04-02", "2024-05-13"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("d"))
    got = [r["h"] for r in df.select(forecast.is_uk_bank_holiday(F.col("d")).alias("h")).collect()]
    assert got == [True] * 10 + [False, False]


def test_forecast_by_series_shape(sales):
    out = forecast.revenue_forecast_by_series(sales, "country", 2).collect()
    series = {r["series"] for r in out}
    assert len(out) == 2 * len(series) and len(series) > 1
    for r in out:
        assert r["predicted_gbp"] >= 0
        if r["model"] != "linear":
            assert r["lower_bound_gbp"] <= r["predicted_gbp"] <= r["upper_bound_gbp"]


def as_sales(spark, rows):
    """(series, days after 2021-01-01, revenue) as lines of canonical columns."""
    df = spark.createDataFrame(rows, "country string, d int, y double")
    return df.selectExpr("country", "timestamp(date_add(DATE'2021-01-01', d)) AS invoice_date",
                         "CAST(y AS DECIMAL(18,2)) AS revenue", "1L AS quantity")


def test_sparse_descent_is_optimal():
    import numpy as np
    rng = np.random.default_rng(3)
    t = np.linspace(0, 1, 200)
    x = np.maximum(t[:, None] - np.arange(1, 13) / 15, 0)
    gram, c = x.T @ x, x.T @ (3 * x[:, 4] - 5 * x[:, 9] + rng.normal(0, .01, 200))
    for weight in (1e-3, 1e-2, 1.0):
        got = forecast.sparse_descent(gram, c, weight, np.zeros(12))
        slack = c - gram @ got
        assert np.all(np.abs(slack) <= weight * (1 + 1e-4) + 1e-7)
        assert np.allclose(slack[got != 0], weight * np.sign(got[got != 0]), atol=1e-4 * weight + 1e-7)
    assert np.count_nonzero(got) < 12


def test_forecast_follows_the_last_slope(spark):
    """Growth that turns to decline, closed on Sundays: the forecast goes on declining."""
    import datetime as dt
    import math
    rows = []
    for d in range(500):
        log = 7 + d * 0.004 - max(d - 300, 0) * 0.008
        if d % 7 != 2:
            rows.append(("a", d, math.exp(log + 0.2 * math.sin(2 * math.pi * d / 7))))
    got = sorted(forecast.revenue_forecast(as_sales(spark, rows), 3).collect(), key=lambda r: r["month"])
    for r in got[1:]:       # whole months
        y, m = map(int, r["month"].split("-"))
        first = (dt.date(y, m, 1) - dt.date(2021, 1, 1)).days
        days = [d for d in range(first, first + 31) if (dt.date(2021, 1, 1) + dt.timedelta(d)).month == m and d % 7 != 2]
        want = sum(math.exp(7 + d * 0.004 - (d - 300) * 0.008 + 0.2 * math.sin(2 * math.pi * d / 7)) for d in days)
        if not (r["is_partial_month"] or r["month"] == got[-1]["month"]):
            assert r["predicted_gbp"] == pytest.approx(want, rel=0.1)
        assert r["lower_bound_gbp"] <= r["predicted_gbp"] <= r["upper_bound_gbp"]
    assert got[0]["trend"] in ("downward", "upward", "flat") and got[0]["training_days"] == len(rows)
    assert [x["month"] for x in got[0]["last_months"]] == ["2022-03", "2022-04", "2022-05"]


def test_one_series_and_many_share_the_model(spark):
    rows = [(s, d, 100.0 + 10 * (d % 7) + i * d) for i, s in enumerate(("a", "all")) for d in range(120)]
    many = forecast.revenue_forecast_by_series(as_sales(spark, rows), "country", 2).filter("series = 'all'").drop("series")
    one = forecast.revenue_forecast(as_sales(spark, [r for r in rows if r[0] == "all"]), 2)
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))


def test_short_series_get_the_straight_line(spark):
    rows = [("a", d, 50.0 + d) for d in range(0, 200, 10)]
    sales = as_sales(spark, rows)
    want = {r["month"]: (r["predicted_gbp"], r["trend"]) for r in forecast.revenue_forecast_linear(sales, 3).collect()}
    got = forecast.revenue_forecast(sales, 3).collect()
    assert {r["month"]: (pytest.approx(r["predicted_gbp"], abs=0.011), r["trend"]) for r in got} == want
    assert all(r["lower_bound_gbp"] is None and r["model"] == "linear" for r in got)
    assert forecast.revenue_forecast(as_sales(spark, rows[:3]), 3).collect() == []
    assert forecast.revenue_forecast(as_sales(spark, rows[:1]).limit(0), 3).collect() == []


def test_band_covers_what_came(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    rows = []
    for s in range(24):
        slope, level = rng.normal(0, 0.001), rng.uniform(5, 9)
        weekly = rng.normal(0, 0.2, 7)
        rows += [(f"s{s}", d, float(np.exp(level + slope * d + weekly[d % 7] + rng.normal(0, 0.3)))) for d in range(540)]
    got = forecast.forecast_backtest(as_sales(spark, rows), "country", 1, 4).collect()
    assert len(got) >= 24 * 4
    covered = sum(r["is_covered"] for r in got) / len(got)
    assert 0.85 <= covered <= 1.0
    error = sorted(abs(r["predicted_gbp"] / r["actual_gbp"] - 1) for r in got)
    assert error[len(error) // 2] < 0.15


def test_churn_adjusted_clv_uses_every_score(sales):
    cm = ml.churn_model(sales, 90, num_trees=10)
    adj = ml.churn_adjusted_clv(sales, 12, cm)
    scored = {r["customer_id"] for r in cm.scores.select("customer_id").collect()}
    rows = adj.select("customer_id", "source", "churn_probability_pct", "survival_probability_pct").collect()
    for r in rows:
        assert r["source"] == ("random_forest" if r["customer_id"] in scored else "population_average")
        assert abs(r["churn_probability_pct"] + r["survival_probability_pct"] - 100.0) < 0.11
    assert sum(r["source"] == "random_forest" for r in rows) > 50      # not only a top-50 list


def test_series_without_revenue_give_no_rows(spark):
    rows = [("a", d, 0.0) for d in range(60)] + [("b", d, 10.0) for d in range(60)] + [(None, 3, 5.0)]
    sales = as_sales(spark, rows)
    assert {r["series"] for r in forecast.revenue_forecast_by_series(sales, "country", 1).collect()} == {"b"}
    assert {r["series"] for r in forecast.forecast_backtest(sales, "country", 1, 1, 10).collect()} == {"b"}


def test_segment_fits_pass_over_few_partitions(spark, monkeypatch):
    """Also where the session's shuffles have many: each pass sends a result for every one."""
    from tallyframe.sources import catalog
    seen = []

    class Seen(ml.KMeans):
        def fit(self, data):
            seen.append(data.rdd.getNumPartitions())
            return super().fit(data)

    sold = catalog.sales(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(ml, "KMeans", Seen)
    monkeypatch.setattr(ml, "MANY_ROWS", 10)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        ml.customer_segments(sold, k=2)
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert seen == [spark.sparkContext.defaultParallelism]
    assert ml.for_passes(spark.range(10).repartition(64), 9).rdd.getNumPartitions() == 64
    assert ml.for_passes(spark.range(10).repartition(64), 10 * ml.FIT_ROWS).rdd.getNumPartitions() == 10


def test_churn_fit_passes_over_few_partitions(spark, monkeypatch):
    """The split and every level of the trees, also where the session's shuffles have many."""
    from tallyframe.sources import catalog
    split, fitted = ml.stratified_split, []

    class Seen(ml.RandomForestClassifier):
        def fit(self, data):
            fitted.append((data.rdd.getNumPartitions(), data.count()))
            return super().fit(data)

    def seen_split(rows, *args):
        fitted.append((rows.rdd.getNumPartitions(), rows.count()))
        return split(rows, *args)

    sold = catalog.sales(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(ml, "RandomForestClassifier", Seen)
    monkeypatch.setattr(ml, "stratified_split", seen_split)
    monkeypatch.setattr(ml, "MANY_ROWS", 10)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        cm = ml.churn_model(sold, 90, num_trees=5)
        customers = cm.scores.count()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    few = spark.sparkContext.defaultParallelism
    assert [parts for parts, _ in fitted] == [few, few]
    assert fitted[0][1] == customers and abs(fitted[1][1] - 0.75 * customers) <= 1
    assert cm.metrics.first()["training_samples"] == fitted[1][1]
