"""Registered basket questions and their SQL: pair rules, and rules of itemsets of any size
(the SQL enumerates itemsets of up to four products; the test data has none above three)."""

from __future__ import annotations

from tallyframe.operators import basket as op
from tallyframe.operators import products as prod
from tallyframe.plans.q_products import WINDOW_CTES
from tallyframe.plans.registry import S, register, with_sales

# Registered thresholds: at the driver's scale factors the strongest pair is in
# about 0.4 % of invoices, so the source defaults (1 % / 30 %) would find nothing.
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.05

PAIR_CTES = [
    "b AS (SELECT DISTINCT invoice, description FROM sales WHERE quantity > 0 AND invoice IS NOT NULL "
    "AND description IS NOT NULL AND (invoice_date IS NOT NULL OR NOT EXISTS "
    "(SELECT 1 FROM sales WHERE quantity > 0 AND invoice_date IS NOT NULL)))",
    "mb AS (SELECT invoice FROM b GROUP BY invoice HAVING COUNT(*) >= 2)",
    "bb AS (SELECT b.* FROM b JOIN mb USING (invoice))",
    "nn AS (SELECT COUNT(*) AS n FROM mb)",
    "ic AS (SELECT description, COUNT(*) AS f FROM bb GROUP BY 1)",
    "pc AS (SELECT x.description AS a, y.description AS c, COUNT(*) AS f_ac FROM bb x JOIN bb y "
    "ON x.invoice = y.invoice AND x.description <> y.description GROUP BY 1, 2)",
    f"mc AS (SELECT CAST(ceil({MIN_SUPPORT} * CAST(n AS DOUBLE)) AS BIGINT) AS mc FROM nn)",
    "pr AS (SELECT a AS antecedent, c AS consequent, CAST(f_ac AS DOUBLE) / CAST(n AS DOUBLE) AS support, "
    "CAST(f_ac AS DOUBLE) / CAST(fa.f AS DOUBLE) AS confidence, "
    "(CAST(f_ac AS DOUBLE) / CAST(fa.f AS DOUBLE)) / (CAST(fc.f AS DOUBLE) / CAST(n AS DOUBLE)) AS lift "
    "FROM pc JOIN ic fa ON fa.description = a JOIN ic fc ON fc.description = c, nn, mc WHERE f_ac >= mc)",
    f"rules AS (SELECT antecedent, consequent, ROUND(support, 4) AS support, ROUND(confidence, 3) AS confidence, "
    f"ROUND(lift, 2) AS lift FROM pr WHERE confidence >= {MIN_CONFIDENCE})",
]


RULE_CTES = [
    PAIR_CTES[0],
    "nn AS (SELECT COUNT(DISTINCT invoice) AS n FROM b)",
    f"mc AS (SELECT CAST(ceil({MIN_SUPPORT} * CAST(n AS DOUBLE)) AS BIGINT) AS mc FROM nn)",
    "s1 AS (SELECT [description] AS items, COUNT(*) AS f FROM b GROUP BY 1 HAVING COUNT(*) >= (SELECT mc FROM mc))",
    "o1 AS (SELECT invoice, [description] AS items FROM b WHERE [description] IN (SELECT items FROM s1))",
    *[x for k in (2, 3, 4) for x in (
        f"c{k} AS (SELECT p.invoice, list_append(p.items, x.items[1]) AS items FROM o{k - 1} p JOIN o1 x ON p.invoice = x.invoice "
        "AND x.items[1] > p.items[-1])",
        f"s{k} AS (SELECT items, COUNT(*) AS f FROM c{k} GROUP BY 1 HAVING COUNT(*) >= (SELECT mc FROM mc))",
        f"o{k} AS (SELECT * FROM c{k} WHERE items IN (SELECT items FROM s{k}))")],
    "sets AS (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in (1, 2, 3, 4)) + ")",
    "cuts AS (SELECT items, f, unnest(range(1, (1 << len(items)) - 1)) AS mask FROM sets WHERE len(items) >= 2)",
    "parts AS (SELECT f, [items[i] for i in range(1, len(items) + 1) if (mask >> (i - 1)) & 1 = 1] AS a, "
    "[items[i] for i in range(1, len(items) + 1) if (mask >> (i - 1)) & 1 = 0] AS c FROM cuts)",
    "gr AS (SELECT p.a, p.c, CAST(p.f AS DOUBLE) / CAST(n AS DOUBLE) AS support, CAST(p.f AS DOUBLE) / CAST(sa.f AS DOUBLE) AS confidence, "
    "(CAST(p.f AS DOUBLE) / CAST(sa.f AS DOUBLE)) / (CAST(sc.f AS DOUBLE) / CAST(n AS DOUBLE)) AS lift "
    "FROM parts p JOIN sets sa ON sa.items = p.a JOIN sets sc ON sc.items = p.c, nn)",
    "grules AS (SELECT array_to_string(a, ', ') AS antecedent, array_to_string(c, ', ') AS consequent, ROUND(support, 4) AS support, "
    f"ROUND(confidence, 3) AS confidence, ROUND(lift, 2) AS lift, lift AS exact FROM gr WHERE confidence >= {MIN_CONFIDENCE})",
]


@register("product_pairs", with_sales(
    "SELECT * FROM rules ORDER BY lift DESC, antecedent, consequent LIMIT 15", *PAIR_CTES))
def _product_pairs(spark, sf):
    return op.product_pairs(S(spark, sf), MIN_SUPPORT, MIN_CONFIDENCE, 15)


@register("product_pairs_all", with_sales("SELECT * FROM rules", *PAIR_CTES))
def _product_pairs_all(spark, sf):
    return op.product_pairs(S(spark, sf), MIN_SUPPORT, MIN_CONFIDENCE, None)


@register("market_basket_rules", with_sales(
    "SELECT * EXCLUDE (exact) FROM grules ORDER BY exact DESC, antecedent, consequent LIMIT 15", *RULE_CTES))
def _market_basket_rules(spark, sf):
    return op.market_basket_rules(S(spark, sf), MIN_SUPPORT, MIN_CONFIDENCE, 15)


@register("market_basket_rules_all", with_sales("SELECT * EXCLUDE (exact) FROM grules", *RULE_CTES))
def _market_basket_rules_all(spark, sf):
    return op.market_basket_rules(S(spark, sf), MIN_SUPPORT, MIN_CONFIDENCE, None)


@register("bundle_candidates", with_sales(
    "SELECT description, partner, MAX(lift) AS lift, MAX(confidence) AS confidence, ANY_VALUE(decline_pct) AS decline_pct FROM ("
    "SELECT antecedent AS description, consequent AS partner, confidence, lift FROM rules WHERE lift >= 1.0 UNION ALL "
    "SELECT consequent, antecedent, confidence, lift FROM rules WHERE lift >= 1.0) JOIN (SELECT description, "
    "ROUND(CAST(prior_units - recent_units AS DOUBLE) / CAST(prior_units AS DOUBLE) * 100.0, 1) AS decline_pct FROM wf "
    "WHERE prior_units > recent_units) USING (description) GROUP BY description, partner",
    *PAIR_CTES, *WINDOW_CTES))
def _bundle_candidates(spark, sf):
    s = S(spark, sf)
    return op.bundle_candidates(op.product_pairs(s, MIN_SUPPORT, MIN_CONFIDENCE, None),
                                prod.declining_products(s, 3))


@register("basket_summary", with_sales(
    "SELECT (SELECT COUNT(DISTINCT invoice) FROM b) AS invoices_analysed, (SELECT COUNT(*) FROM mb) AS multi_item_invoices, "
    "(SELECT COUNT(*) FROM rules) AS pair_rules_found", *PAIR_CTES))
def _basket_summary(spark, sf):
    return op.basket_summary(S(spark, sf), MIN_SUPPORT, MIN_CONFIDENCE)
