"""A mergeable rollup of sales lines that the dashboard and the health signals read.

Two tables of sums, counts and extremes:

``invoices``  one row per (customer, invoice, country, month): net and sales revenue, sales
              units, lines, return lines, first and last timestamp
``products``  one row per (product, month): net and sales revenue, sales units, lines

Every column merges by adding or by min / max, so the rollup of two batches of lines is the
merged rollup of each: appending a batch reads that batch only and gives what a rebuild gives,
also for an invoice or customer that occurs in both. Batches are named folders and a repeated
write replaces its own, so a restarted job adds no line twice. Lines are to be cleaned before;
a copy of a line in another batch counts again.

Undated lines have a null month and no timestamps. Null customers, countries and products are
groups of their own. Groups are aggregated with map-side combine, so a customer or product
with a third of all lines is reduced where its lines are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import schema as S
from tallyframe.functions.cols import is_return, is_sale, month_index, sum0

C = F.col
CID = S.CUSTOMER_ID
INVOICE_KEYS = [CID, S.INVOICE, S.COUNTRY, "month_idx"]
PRODUCT_KEYS = [S.DESCRIPTION, "month_idx"]
SUMS = ["revenue", "sale_revenue", "sale_units", "lines", "return_lines"]


@dataclass(frozen=True)
class Rollup:
    invoices: DataFrame
    products: DataFrame


def _sums() -> list[F.Column]:
    return [F.sum(S.REVENUE).alias("revenue"), sum0(F.when(is_sale(), C(S.REVENUE))).alias("sale_revenue"),
            sum0(F.when(is_sale(), C(S.QUANTITY))).alias("sale_units"), F.count(F.lit(1)).alias("lines"),
            F.count_if(is_return()).alias("return_lines")]


def rollup(sales: DataFrame) -> Rollup:
    lines = sales.withColumn("month_idx", month_index())
    invoices = lines.groupBy(*INVOICE_KEYS).agg(
        *_sums(), F.min(S.INVOICE_DATE).alias("first"), F.max(S.INVOICE_DATE).alias("last"))
    return Rollup(invoices, lines.groupBy(*PRODUCT_KEYS).agg(*_sums()))


def merge(r: Rollup) -> Rollup:
    """One row a key again, after rollups of several batches were put together. Sums keep their
    type: what a sum of sums adds to its precision is taken off again."""
    types = dict(r.invoices.dtypes)
    sums = [F.sum(c).cast(types[c]).alias(c) for c in SUMS]
    return Rollup(r.invoices.groupBy(*INVOICE_KEYS).agg(*sums, F.min("first").alias("first"), F.max("last").alias("last")),
                  r.products.groupBy(*PRODUCT_KEYS).agg(*sums))


def append(sales: DataFrame, path: str, batch: str) -> None:
    """Add the lines of ``sales`` under ``path`` as the batch of that name, or replace it."""
    r = rollup(sales)
    for name, df in (("invoices", r.invoices), ("products", r.products)):
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def read(spark: SparkSession, path: str) -> Rollup:
    """The merged rollup of all batches under ``path``."""
    return merge(Rollup(*[spark.read.parquet(f"{path}/{name}").drop("batch") for name in ("invoices", "products")]))


# ── what the composites ask of it ────────────────────────────────────────────

def months(r: Rollup) -> DataFrame:
    """(month_idx, rev, sale_rev) of the dated lines: one row a calendar month."""
    return (r.invoices.filter(C("month_idx").isNotNull()).groupBy("month_idx")
            .agg(F.sum("revenue").alias("rev"), F.sum(F.when(C("sale_units") > 0, C("sale_revenue"))).alias("sale_rev")))


def customers(r: Rollup) -> DataFrame:
    """One row per customer: first / last dated line, distinct invoices, net revenue."""
    per = (r.invoices.filter(C(CID).isNotNull()).groupBy(CID, S.INVOICE)
           .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("revenue").alias("revenue")))
    return per.groupBy(CID).agg(F.max("last").alias("last"), F.min("first").alias("first"),
                                F.count(F.lit(1)).alias("invoices"), F.sum("revenue").alias("revenue"))


def totals(r: Rollup, by: tuple = ()) -> DataFrame:
    """One row (a group of ``by``: country): distinct invoices, sales revenue and units, lines,
    return lines."""
    per = r.invoices.groupBy(*by, S.INVOICE).agg(*[F.sum(c).alias(c) for c in SUMS])
    sums = [sum0(C(c)).alias(c) for c in SUMS]
    return per.groupBy(*by).agg(F.count(S.INVOICE).alias("orders"), *sums)
