"""DuckDB statements that state each registered query independently of Spark.

They run on the driver's pre-registered views (lineitem, orders, customer, nation,
part, events, conversations, ...). ``sales`` and ``event_sales`` are stated here by hand,
apart from the Spark adapter's expressions.
"""

from __future__ import annotations

# Every line, whatever it has no partner for. Prices are cents per unit, rounded half-up to
# four places in whole numbers.
RAW_SALES = (
    "SELECT CAST(l_orderkey AS VARCHAR) AS invoice, CAST(l_partkey AS VARCHAR) AS stock_code, p_name AS description, "
    "CASE WHEN l_returnflag = 'R' THEN -units ELSE units END AS quantity, "
    "CASE WHEN units > 0 THEN CAST(CAST((200 * cents + units) // (2 * units) AS DECIMAL(18,0)) * 0.0001 AS DECIMAL(18,4)) END AS price, "
    "CAST(CASE WHEN l_returnflag = 'R' THEN -paid ELSE paid END AS DECIMAL(18,2)) AS revenue, "
    "CAST(o_orderdate AS TIMESTAMP) AS invoice_date, CAST(o_custkey AS BIGINT) AS customer_id, n_name AS country "
    "FROM (SELECT *, CAST(l_quantity AS BIGINT) AS units, CAST(l_extendedprice AS DECIMAL(18,2)) AS paid, "
    "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM lineitem) "
    "LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey "
    "LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON l_partkey = p_partkey"
)
RAW_EVENTS = (
    "SELECT CAST(event_id AS VARCHAR) AS invoice, CAST(NULL AS VARCHAR) AS stock_code, event_type AS description, "
    "CAST(1 AS BIGINT) AS quantity, CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS price, "
    "CAST(value AS DECIMAL(18,2)) AS revenue, CAST(ts AS TIMESTAMP) AS invoice_date, CAST(user_id AS BIGINT) AS customer_id, "
    "CAST(NULL AS VARCHAR) AS country FROM events WHERE event_type = 'purchase'"
)
WHY = ("CASE WHEN customer_id IS NULL THEN 'missing_customer_id' WHEN description IS NULL THEN 'missing_description' "
       "WHEN price > 0 THEN NULL ELSE 'non_positive_price' END")


def _kept(name: str, raw: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT DISTINCT * FROM ({raw})) WHERE {WHY} IS NULL)"


SALES_CTE = _kept("sales", RAW_SALES)
EVENT_SALES_CTE = _kept("event_sales", RAW_EVENTS)


def with_sales(sql: str, *ctes: str) -> str:
    parts = [SALES_CTE, *ctes]
    return "WITH " + ",\n".join(parts) + "\n" + sql


def with_events(sql: str, *ctes: str) -> str:
    parts = [EVENT_SALES_CTE, *ctes]
    return "WITH " + ",\n".join(parts) + "\n" + sql
