"""Run customer-keyed operators on a skewed copy of the data and report, per stage,
the largest task's share of the records read (from Spark's event log).

usage: python scripts/skew_check.py [sf_dir] [out.md]
A third of the invoices are reassigned to one customer (derived from the driver's
tables). AQE partition coalescing is off so that the raw task split is visible.
The event log goes to a fresh scratch folder; no UI or server is started.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

OPS = ["clean_dedupe", "avg_days_between_purchases", "customer_profiles", "rfm_features", "customer_clv", "cohort_retention",
       "repeat_customers_stats", "at_risk_customers", "customer_product_units",
       "product_sales_trend", "product_demand_trend", "product_return_rate", "best_seller_per_country",
       "product_popularity", "high_growth_products"]
PRODUCT_OPS = OPS[9:]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out = sys.argv[2] if len(sys.argv) > 2 else None
    logdir = tempfile.mkdtemp(prefix="tally-eventlog-")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F
    spark = (SparkSession.builder.master("local[8]").appName("tally-skew")
             .config("spark.sql.shuffle.partitions", "16").config("spark.ui.enabled", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", logdir)
             .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from tallyframe.operators import customers, products, sales
    from tallyframe.sources import catalog
    s = catalog.sales(spark, sf)
    hot = (F.abs(F.xxhash64("invoice")) % 3) == 0
    skewed = s.withColumn("customer_id", F.when(hot, F.lit(0)).otherwise(F.col("customer_id")))
    from tallyframe.operators.clean import audited
    fns = {"clean_dedupe": lambda d: audited(d), "avg_days_between_purchases": sales.avg_days_between_purchases, "customer_profiles": customers.customer_profiles,
           "rfm_features": customers.rfm_features, "customer_clv": customers.customer_clv,
           "cohort_retention": customers.cohort_retention, "repeat_customers_stats": sales.repeat_customers_stats,
           "at_risk_customers": lambda d: customers.at_risk_customers(d, 90, None),
           "customer_product_units": customers.customer_product_units,
           "product_sales_trend": products.product_sales_trend, "product_demand_trend": products.product_demand_trend,
           "product_return_rate": products.product_return_rate,
           "best_seller_per_country": products.best_seller_per_country,
           "product_popularity": lambda d: products.product_popularity(d, None),
           "high_growth_products": lambda d: products.high_growth_products(d, 3, None)}
    hot_product = skewed.withColumn("description", F.when(hot, F.lit("hot product")).otherwise(F.col("description")))
    for name in OPS:
        spark.sparkContext.setJobGroup(name, name)
        data = hot_product if name in PRODUCT_OPS else skewed
        fns[name](data).write.format("noop").mode("overwrite").save()
    spark.stop()
    tasks, groups = {}, {}
    for path in [p for p in glob.glob(os.path.join(logdir, "**", "*"), recursive=True) if os.path.isfile(p)]:
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    grp = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for st in ev.get("Stage IDs", []):
                        groups[st] = grp
                elif kind == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    rec = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0) + \
                          (m.get("Input Metrics") or {}).get("Records Read", 0)
                    tasks.setdefault(ev["Stage ID"], []).append(rec)
    rows = ["| Operator | stage | tasks | records read | largest task share | median task share |",
            "|---|---|---|---|---|---|"]
    worst = {}
    for st, recs in sorted(tasks.items()):
        grp = groups.get(st)
        total = sum(recs)
        if grp not in OPS or total < 10_000 or len(recs) < 2:
            continue
        share = max(recs) / total
        med = statistics.median(recs) / total
        worst[grp] = max(worst.get(grp, 0), share)
        rows.append(f"| `{grp}` | {st} | {len(recs)} | {total} | {share:.1%} | {med:.1%} |")
    rows.append("")
    rows.append("Largest single-task share per operator: " +
                ", ".join(f"`{k}` {v:.1%}" for k, v in worst.items()) +
                " (the hot customer, or for product operators the hot product, alone holds about a third of all lines).")
    text = "\n".join(rows)
    print(text)
    if out:
        with open(out, "w") as f:
            f.write(text + "\n")


if __name__ == "__main__":
    main()
