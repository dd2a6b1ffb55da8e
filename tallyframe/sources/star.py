"""Adapters from the driver's star-schema tables to the canonical ``sales`` frame.

Mapping (one row per line item):

==============  ==========================================================
invoice         ``l_orderkey`` as string
stock_code      ``l_partkey`` as string
description     ``p_name``
quantity        ``l_quantity`` as bigint, negated when ``l_returnflag = 'R'``
price           ``l_extendedprice / l_quantity`` rounded half-up to 4 places
revenue         ``l_extendedprice`` (exact to the cent), same sign as quantity
invoice_date    ``o_orderdate`` (stored as timestamp_ntz, read as UTC)
customer_id     ``o_custkey``
country         ``n_name`` of the customer's nation
==============  ==========================================================

Price and revenue are formed with integer cent arithmetic so that every engine
that evaluates the same mapping gets the same decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import schema as S
from tallyframe.functions.broadcast import bounded_broadcast

STAR_TABLES = ("lineitem", "orders", "customer", "nation", "part")
# Dimensions with at most this many rows are broadcast (≈ 100 MB for these two
# narrow projections); larger ones are joined with a shuffle. Override per session
# with ``tallyframe.dim.broadcastRows``.
DIM_BROADCAST_ROWS = 2_000_000


def dim_broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("tallyframe.dim.broadcastRows", str(DIM_BROADCAST_ROWS)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The mapping as SQL expressions; the DuckDB statements have their own. Money goes through integer cents; the unit price is rounded
# half-up to 4 places with integer division.
def _cents(x: str) -> str:
    return f"CAST(ROUND({x} * 100) AS BIGINT)"


def _price4(cents: str, qty: str) -> str:
    return (f"CAST(CAST(CASE WHEN {qty} > 0 THEN ({cents} * 100 + {qty} div 2) div {qty} END "
            f"AS DECIMAL(18,0)) * 0.0001 AS DECIMAL(18,4))")


def _money2(cents: str) -> str:
    return f"CAST(CAST({cents} AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2))"


_SIGN = "(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)"
_QTY = "CAST(l_quantity AS BIGINT)"
STAR_EXPRS = [
    f"CAST(l_orderkey AS STRING) AS {S.INVOICE}",
    f"CAST(l_partkey AS STRING) AS {S.STOCK_CODE}",
    f"p_name AS {S.DESCRIPTION}",
    f"{_QTY} * {_SIGN} AS {S.QUANTITY}",
    f"{_price4(_cents('l_extendedprice'), _QTY)} AS {S.PRICE}",
    f"{_money2(_cents('l_extendedprice') + ' * ' + _SIGN)} AS {S.REVENUE}",
    f"CAST(o_orderdate AS TIMESTAMP) AS {S.INVOICE_DATE}",
    f"CAST(o_custkey AS BIGINT) AS {S.CUSTOMER_ID}",
    f"n_name AS {S.COUNTRY}",
]
EVENT_EXPRS = [
    f"CAST(event_id AS STRING) AS {S.INVOICE}",
    f"CAST(NULL AS STRING) AS {S.STOCK_CODE}",
    f"event_type AS {S.DESCRIPTION}",
    f"CAST(1 AS BIGINT) AS {S.QUANTITY}",
    f"{_price4(_cents('value'), 'CAST(1 AS BIGINT)')} AS {S.PRICE}",
    f"{_money2(_cents('value'))} AS {S.REVENUE}",
    f"CAST(ts AS TIMESTAMP) AS {S.INVOICE_DATE}",
    f"CAST(user_id AS BIGINT) AS {S.CUSTOMER_ID}",
    f"CAST(NULL AS STRING) AS {S.COUNTRY}",
]


def star_sales_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uncleaned canonical frame over lineitem ⟕ orders ⟕ customer ⟕ nation ⟕ part: every
    line is there. One without its order has no customer and no date, one without its part no
    description, and the cleaning rules count them.

    Join strategy: lineitem ⋈ orders is the one large-large join (sort-merge on the
    order key; AQE splits a skewed order-key partition). The dimensions — customer
    with its nation name, and part — are broadcast only behind a row-count check
    (``DIM_BROADCAST_ROWS``); above it they are shuffle joins that AQE may still
    convert or skew-split at run time. Broadcasting the customer side also keeps
    the line rows from being clustered by customer, so a customer with a third of
    all lines does not end up in one task.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = bounded_broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 10_000)
    pa = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")

    limit = dim_broadcast_rows(spark)
    cust_country = bounded_broadcast(
        cu.join(na, cu.c_nationkey == na.n_nationkey, "left").select("c_custkey", "n_name"), limit)
    pa = bounded_broadcast(pa, limit)
    j = (li.join(od, li.l_orderkey == od.o_orderkey, "left")
           .join(cust_country, F.col("o_custkey") == F.col("c_custkey"), "left")
           .join(pa, F.col("l_partkey") == F.col("p_partkey"), "left"))

    return j.selectExpr(*STAR_EXPRS)


def star_sales_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct rows of ``star_sales_raw``, each with ``_copies`` (how many times it occurs).

    Copies are counted before the joins, while a line is five numbers: no text moves with it.
    A line, its order, the customer's nation and the part are each distinct there, and the row
    has all columns they are told apart by, so joined rows are distinct too, and their copies
    are the product of the parts'. As in ``clean_sales`` the lines are hashed on every column.
    Customers meet the orders, of which there are fewer than lines."""
    li = read_table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", *[e for e in STAR_EXPRS if e.endswith((f" {S.QUANTITY}", f" {S.PRICE}", f" {S.REVENUE}"))])
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = bounded_broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 10_000)
    pa = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    limit = dim_broadcast_rows(spark)

    def counted(df: DataFrame, copies: str) -> DataFrame:
        return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(copies))

    def dimension(df: DataFrame, copies: str) -> DataFrame:
        few = df.limit(limit + 1).count() <= limit
        return F.broadcast(counted(df, copies)) if few else counted(df, copies)

    nations = dimension(cu.join(na, cu.c_nationkey == na.n_nationkey, "left").select("c_custkey", "n_name"), "_c")
    orders = counted(od, "_o").join(nations, F.col("o_custkey") == F.col("c_custkey"), "left").drop("c_custkey")
    lines = counted(li.repartition(*li.columns), "_l")
    j = (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
         .join(dimension(pa, "_p"), F.col("l_partkey") == F.col("p_partkey"), "left"))
    one = F.lit(1).cast("bigint")
    copies = F.col("_l") * F.coalesce("_o", one) * F.coalesce("_c", one) * F.coalesce("_p", one)
    given = [e if not e.endswith((f" {S.QUANTITY}", f" {S.PRICE}", f" {S.REVENUE}")) else e.rsplit(" ", 1)[1] for e in STAR_EXPRS]
    return j.select(*[F.expr(e) for e in given], copies.alias("_copies"))


def events_sales_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as invoice lines (used for hour / weekday analyses).

    invoice = event_id, customer = user_id, description = event_type,
    quantity = 1, price = revenue = value, invoice_date = ts, no country.
    """
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    ev = ev.filter(F.col("event_type") == "purchase")
    return ev.selectExpr(*EVENT_EXPRS)
