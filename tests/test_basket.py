"""Rule growth and pair counting against enumeration, and where a mask or a list would fail."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tallyframe.operators import basket


def test_rules_of_an_itemset_of_forty(spark):
    """One itemset of 40 products; of its parts only single products and those without one or
    two of them are known, so the rules are those with one or two products on the right."""
    items = [f"p{i:02d}" for i in range(40)]
    rows = [(items, 6)] + [([x], 10) for x in items]
    rows += [([y for y in items if y != x], 8) for x in items]
    pairs = list(combinations(items, 2))
    rows += [([y for y in items if y not in p], 9) for p in pairs] + [(list(p), 9) for p in pairs]
    fi = spark.createDataFrame(rows, "items array<string>, freq long")
    whole = basket.rules_from_itemsets(fi, F.lit(20), 0.6).filter(F.size("antecedent_items") + F.size("consequent_items") == 40).collect()
    sizes = Counter(len(r["consequent_items"]) for r in whole)
    assert sizes == {1: 40, 2: 780}
    for r in whole:
        a, c = r["antecedent_items"], r["consequent_items"]
        assert sorted(a + c) == items
        conf = 6 / (8 if len(c) == 1 else 9)
        assert (r["support"], r["confidence"]) == (6 / 20, conf)
        assert abs(r["lift"] - conf / ((10 if len(c) == 1 else 9) / 20)) < 1e-12


def test_rules_without_itemsets(spark):
    fi = spark.createDataFrame([(["a"], 3)], "items array<string>, freq long")
    assert basket.rules_from_itemsets(fi, F.lit(5), 0.1).collect() == []


def test_pairs_of_blocks_and_buckets(spark):
    """Invoices above the block size and colliding buckets give the same pairs."""
    rng = np.random.default_rng(7)
    lines = {(f"i{i}", f"p{p}") for i in range(30) for p in rng.integers(0, 60, 5 if i else 55)}
    df = spark.createDataFrame(sorted(lines), "invoice string, description string").repartition(3)
    by = {}
    for i, p in lines:
        by.setdefault(i, []).append(p)
    want = Counter(pair for ps in by.values() for pair in combinations(sorted(ps), 2))
    for least in (1, 2, 3):
        for block, buckets in ((1024, 1 << 20), (4, 1 << 20), (7, 5), (1, 1)):
            got = basket.frequent_pairs(df, F.lit(least), block, buckets).collect()
            assert {(r.a, r.c): r.f_ac for r in got} == {k: v for k, v in want.items() if v >= least}
            assert len(got) == len({(r.a, r.c) for r in got})


def test_a_large_invoice_spreads(spark):
    """No (invoice, block, block) key meets more than two blocks of lines."""
    lines = spark.range(4000).selectExpr("'one' AS invoice", "concat('p', id) AS description")
    assert basket.frequent_pairs(lines, F.lit(1), block=250).count() == 4000 * 3999 // 2
    plan = basket.frequent_pairs(lines, F.lit(1), block=250)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_itemsets_are_mined_from_invoices_of_several_frequent_items(spark, monkeypatch):
    """As numbers; invoices of one frequent product or none count in the support all the same."""
    rng = np.random.default_rng(3)
    invoices = [sorted({f"p{int(p)}" for p in rng.integers(0, 9, rng.integers(1, 6))}) for _ in range(80)]
    invoices += [[f"rare{i}", f"odd{i}"] for i in range(20)] + [[f"rare{i}", "p1"] for i in range(15)]
    lines = spark.createDataFrame([(f"i{k}", p) for k, ps in enumerate(invoices) for p in ps], "invoice string, description string")
    seen = []

    class Seen(basket.FPGrowth):
        def fit(self, data):
            seen.append((data.dtypes, sorted(len(r["items"]) for r in data.collect())))
            return super().fit(data)

    monkeypatch.setattr(basket, "FPGrowth", Seen)
    for support in (0.02, 0.05, 0.2, 1.0):
        least = -int(-support * len(invoices) // 1)
        want = Counter(c for ps in invoices for k in range(1, len(ps) + 1) for c in combinations(ps, k))
        want = {k: v for k, v in want.items() if v >= least}
        fi, n = basket.frequent_itemsets(lines, support)
        rows = fi.withColumn("n", n).collect()
        assert {tuple(r["items"]): r["freq"] for r in rows} == want and len(rows) == len(want)
        assert {r["n"] for r in rows} <= {len(invoices)}
        single = {k[0] for k in want if len(k) == 1}
        several = [len(single & set(ps)) for ps in invoices]
        assert seen.pop() == ([("items", "array<int>")], sorted(x for x in several if x >= 2))
    assert basket.frequent_itemsets(lines.limit(0), 0.1)[0].collect() == []
