"""Market-basket analysis (survey §2.3): FP-Growth rules, pair rules, bundle candidates.

Frequent itemsets come from Spark ML's parallel FP-Growth over the frequent items of each
invoice. Rules grow level by level: a rule's consequent can only reach the confidence if every
smaller consequent of the same itemset does, so consequents of m items extend those of m - 1
and the rows of a level are bounded by the rules found.

Pairs are counted without a list per invoice. A first pass counts pairs by hash bucket; the
second counts only pairs whose bucket reached the support. Invoices of many products are cut
into blocks of items, and two blocks meet in a task of their own.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe import schema as S
from tallyframe.functions.cols import is_sale, rnd
from tallyframe.functions.ordered import top_k
from tallyframe.llm.store import keep
from tallyframe.session import checkpoint_dir

C = F.col

BLOCK = 1024          # items of an invoice that meet in one task
BUCKETS = 1 << 20     # of pairs; at most so many rows are broadcast


def basket_lines(sales: DataFrame) -> DataFrame:
    """Distinct (invoice, product) of sales lines.

    Undated lines are left out whenever any dated line exists (as in the source).
    """
    pos = sales.filter(is_sale() & C(S.INVOICE).isNotNull() & C(S.DESCRIPTION).isNotNull())
    any_dated = pos.agg(F.max(F.when(C(S.INVOICE_DATE).isNotNull(), 1).otherwise(0))).scalar()
    pos = pos.filter(C(S.INVOICE_DATE).isNotNull() | (any_dated == 0))
    return pos.select(S.INVOICE, S.DESCRIPTION).distinct()


def least_count(min_support: float, n) -> F.Column:
    return F.ceil(F.lit(float(min_support)) * n.cast("double"))


def frequent_itemsets(lines: DataFrame, min_support: float) -> tuple[DataFrame, object]:
    """(items sorted, freq) for every itemset with support ≥ min_support among all invoices,
    and the number of invoices. Only frequent items are gathered by invoice, as numbers: their
    count is at most an average invoice's items over the support.

    An invoice with one frequent item adds to that item's count alone, which is known, so trees
    are grown from the invoices with two or more, for the same least number of invoices."""
    # Written, not cached: a cached table would keep as many partitions as its shuffle, and a tree
    # is grown for each of them, so small ones share little.
    lines = keep(lines, "lines")
    n = lines.agg(F.count_distinct(S.INVOICE)).first()[0]
    least = max(math.ceil(float(min_support) * n), 1)
    ranked = F.row_number().over(Window.orderBy(C("f").desc(), S.DESCRIPTION))
    frequent = (lines.groupBy(S.DESCRIPTION).agg(F.count(F.lit(1)).alias("f")).filter(C("f") >= least)
                .select(S.DESCRIPTION, "f", ranked.alias("id")).persist(StorageLevel.MEMORY_AND_DISK))
    b = keep(lines.join(frequent.select(S.DESCRIPTION, "id"), S.DESCRIPTION).groupBy(S.INVOICE)
             .agg(F.collect_list("id").alias("items")).filter(F.size("items") >= 2).select("items"), "baskets")
    several = b.count()
    # The rounded-up product with their number is the least count again, or all of them.
    share = min((least - 0.5) / max(several, 1), 1.0)
    found = FPGrowth(itemsCol="items", minSupport=share, minConfidence=0.0).fit(b).freqItemsets
    numbered = (found.filter((F.size("items") >= 2) & (C("freq") >= least))
                .withColumn("set", F.monotonically_increasing_id()).select("set", "freq", F.explode("items").alias("id")))
    named = (numbered.join(frequent.select("id", S.DESCRIPTION), "id").groupBy("set", "freq")
             .agg(F.array_sort(F.collect_list(S.DESCRIPTION)).alias("items")))
    # Backed by the mined RDD; persist so that the reads in rule derivation do not mine again.
    fi = (frequent.select(F.array(S.DESCRIPTION).alias("items"), C("f").cast("bigint").alias("freq"))
          .unionAll(named.select("items", C("freq").cast("bigint"))).persist(StorageLevel.MEMORY_AND_DISK))
    fi.count()
    frequent.unpersist()
    return fi, F.lit(n)


def rules_from_itemsets(fi: DataFrame, n, min_confidence: float) -> DataFrame:
    """All rules A → C with A ∪ C frequent, A, C non-empty and disjoint, by growing C."""
    checkpoint_dir(fi.sparkSession)   # names the folder that checkpoint() writes to
    known = fi.select(C("items").alias("antecedent_items"), C("freq").alias("f_a"))

    def confident(candidates: DataFrame) -> DataFrame:
        rest = F.array_except("items", "consequent_items")
        found = candidates.withColumn("antecedent_items", rest).filter(F.size("antecedent_items") > 0)
        conf = C("f_ac").cast("double") / C("f_a").cast("double")
        return (found.join(known, "antecedent_items").withColumn("confidence", conf)
                .filter(C("confidence") >= F.lit(float(min_confidence)))
                .select("items", "f_ac", "antecedent_items", "consequent_items", "confidence").checkpoint())

    multi = fi.filter(F.size("items") >= 2)
    level = confident(multi.select("items", C("freq").alias("f_ac"), F.explode("items").alias("i"))
                      .select("items", "f_ac", F.array("i").alias("consequent_items")))
    single = level.select("items", C("consequent_items")[0].alias("i"))
    rules = [level]
    while not level.isEmpty():
        grown = level.join(single, "items").filter(C("i") > F.element_at("consequent_items", -1))
        level = confident(grown.select("items", "f_ac", F.concat("consequent_items", F.array("i")).alias("consequent_items")))
        rules.append(level)
    found = rules[0]
    for more in rules[1:-1]:
        found = found.unionByName(more)
    fc = fi.select(C("items").alias("consequent_items"), C("freq").alias("f_c"))
    r = found.join(fc, "consequent_items").withColumn("n", n)
    lift = C("confidence") / (C("f_c").cast("double") / C("n").cast("double"))
    return r.select("antecedent_items", "consequent_items", (C("f_ac").cast("double") / C("n").cast("double")).alias("support"),
                    "confidence", lift.alias("lift"))


def mined(sales: DataFrame, min_support: float) -> tuple[DataFrame, object]:
    """(frequent itemsets, basket count) — the fitted part of basket analysis, which
    callers may keep and pass back in (``itemsets=``) for other thresholds or cuts."""
    return frequent_itemsets(basket_lines(sales), min_support)


def market_basket_rules(sales: DataFrame, min_support: float = 0.01, min_confidence: float = 0.3,
                        limit: int | None = 15, itemsets: tuple | None = None) -> DataFrame:
    """Association rules over all invoices (single-item baskets count in the
    denominators), any-size antecedent and consequent, by lift descending."""
    fi, n = itemsets or mined(sales, min_support)
    r = rules_from_itemsets(fi, n, min_confidence)
    out = r.select(F.array_join("antecedent_items", ", ").alias("antecedent"),
                   F.array_join("consequent_items", ", ").alias("consequent"),
                   rnd(C("support"), 4).alias("support"), rnd(C("confidence"), 3).alias("confidence"),
                   rnd(C("lift"), 2).alias("lift"), C("lift").alias("_lift"))
    return top_k(out, [C("_lift").desc(), C("antecedent"), C("consequent")], limit).drop("_lift")


def frequent_pairs(lines: DataFrame, least, block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """(a, c, f_ac) for products a < c that at least ``least`` invoices of ``lines`` (distinct
    invoice, product) have both of. Every pair of an invoice is met once a pass, in the task of
    its two blocks; only pairs in a frequent bucket are counted one by one."""
    frequent = lines.groupBy(S.DESCRIPTION).agg(F.count(F.lit(1)).alias("f")).filter(C("f") >= least)
    some = lines.join(frequent, S.DESCRIPTION, "left_semi")
    large = (some.groupBy(S.INVOICE).agg(F.count(F.lit(1)).alias("size")).filter(C("size") > block)
             .select(S.INVOICE, F.ceil(C("size") / F.lit(block)).alias("blocks")))
    cut = some.join(large, S.INVOICE, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    cut = cut.withColumn("own", F.pmod(F.xxhash64(S.DESCRIPTION), "blocks"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), C("blocks") - 1))).select(
        S.INVOICE, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", C(S.DESCRIPTION).alias("a"))
    there = met.select(C(S.INVOICE).alias("i"), C("low").alias("l"), C("high").alias("h"), C("own").alias("o"), C("a").alias("c"))
    pairs = met.join(there, (C(S.INVOICE) == C("i")) & (C("low") == C("l")) & (C("high") == C("h")) & (C("a") < C("c"))
                     & ((C("own") != C("o")) | (C("low") == C("high"))))
    pairs = pairs.select("a", "c", F.pmod(F.xxhash64("a", "c"), F.lit(buckets)).alias("bucket"))
    full = pairs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(C("n") >= least).select("bucket")
    return (pairs.join(F.broadcast(full), "bucket", "left_semi").groupBy("a", "c").agg(F.count(F.lit(1)).alias("f_ac"))
            .filter(C("f_ac") >= least))


def product_pairs(sales: DataFrame, min_support: float = 0.01, min_confidence: float = 0.3,
                  limit: int | None = 15) -> DataFrame:
    """Pair rules in both directions; denominators count multi-item invoices only."""
    lines = basket_lines(sales)
    sizes = lines.groupBy(S.INVOICE).agg(F.count(F.lit(1)).alias("k"), F.min(S.DESCRIPTION).alias("only"))
    n = sizes.agg(F.count_if(C("k") >= 2)).scalar()
    pairs = frequent_pairs(lines, F.greatest(least_count(min_support, n), F.lit(1)))
    # A product's multi-item invoices: all of its invoices without those that hold nothing else.
    counts = (lines.select(S.DESCRIPTION, F.lit(1).alias("one"))
              .unionAll(sizes.filter("k = 1").select("only", F.lit(-1))).groupBy(S.DESCRIPTION).agg(F.sum("one").alias("f")))
    both = pairs.select(C("a").alias("antecedent"), C("c").alias("consequent"), "f_ac").unionAll(pairs.select("c", "a", "f_ac"))
    r = (both.join(counts.select(C(S.DESCRIPTION).alias("antecedent"), C("f").alias("f_a")), "antecedent")
         .join(counts.select(C(S.DESCRIPTION).alias("consequent"), C("f").alias("f_c")), "consequent").withColumn("n", n))
    conf = C("f_ac").cast("double") / C("f_a").cast("double")
    lift = conf / (C("f_c").cast("double") / C("n").cast("double"))
    out = r.filter(conf >= F.lit(float(min_confidence))).select(
        "antecedent", "consequent", rnd(C("f_ac").cast("double") / C("n").cast("double"), 4).alias("support"),
        rnd(conf, 3).alias("confidence"), rnd(lift, 2).alias("lift"))
    return top_k(out, [C("lift").desc(), C("antecedent"), C("consequent")], limit)


def bundle_candidates(rules: DataFrame, slow: DataFrame, min_lift: float = 1.0) -> DataFrame:
    """Slow movers that appear in a rule with lift ≥ ``min_lift`` next to another product.

    ``rules`` has antecedent / consequent / confidence / lift (pair rules), ``slow`` the
    ``slow_movers`` frame. One row per (slow mover, partner) with the best rule.
    """
    strong = rules.filter(C("lift") >= F.lit(float(min_lift)))
    a = strong.select(C("antecedent").alias(S.DESCRIPTION), C("consequent").alias("partner"), "confidence", "lift")
    c = strong.select(C("consequent").alias(S.DESCRIPTION), C("antecedent").alias("partner"), "confidence", "lift")
    both = a.unionByName(c).join(slow.select(S.DESCRIPTION, "decline_pct"), S.DESCRIPTION)
    best = both.groupBy(S.DESCRIPTION, "partner").agg(
        F.max("lift").alias("lift"), F.max("confidence").alias("confidence"), F.first("decline_pct").alias("decline_pct"))
    return best


def basket_summary(sales: DataFrame, min_support: float = 0.01, min_confidence: float = 0.3) -> DataFrame:
    """Invoices mined, multi-item invoices, and pair rules found before any top-N cut."""
    sizes = basket_lines(sales).groupBy(S.INVOICE).agg(F.count(F.lit(1)).alias("k"))
    rules = product_pairs(sales, min_support, min_confidence, None)
    return sizes.agg(F.count(F.lit(1)).alias("invoices_analysed"),
                     F.count_if(C("k") >= 2).alias("multi_item_invoices"),
                     rules.agg(F.count(F.lit(1))).scalar().alias("pair_rules_found"))
