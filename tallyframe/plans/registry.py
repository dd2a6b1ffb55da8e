"""Registered queries: name → (Spark callable, DuckDB statement or None).

Each Spark callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver's tables. Parameters are fixed here so that the Spark query and its SQL
statement ask exactly the same question.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tallyframe.plans.oracle import with_events, with_sales
from tallyframe.sources import catalog

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

# Parameters of the registered questions.
COUNTRY = "nation_3"            # matched case-insensitively
KEYWORD = "bolt"
PRODUCT = "red widget"
PERIOD = "2000-11"
RANGE = ("1998-01-01", "1998-12-31")


def double_round(sql: str) -> str:
    """Rewrite two-argument ROUND on doubles as ROUND(x * 1eN) / 1eN (see ``cols.rnd``).

    ``CAST(ROUND(x, 2) AS DOUBLE)`` is the exact decimal rounding of money and is
    left alone.
    """
    out, i = [], 0
    while True:
        j = sql.find("ROUND(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if sql[max(0, j - 5):j] == "CAST(":
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 1, j + 6, -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        if comma < 0:
            out.append(sql[i:k])
            i = k
            continue
        expr, n = sql[j + 6:comma], sql[comma + 1:k - 1].strip()
        out.append(sql[i:j] + f"(ROUND(({double_round(expr)}) * 1e{n}) / 1e{n} + 0.0)")
        i = k


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, double_round(sql) if sql else None)
        return fn
    return deco


def S(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.sales(spark, sf)


def E(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.event_sales(spark, sf)


MONEY = "CAST(ROUND({x}, 2) AS DOUBLE)"


def money(x: str) -> str:
    return MONEY.format(x=x)


MODULES = ("q_sales", "q_products", "q_customers", "q_basket", "q_models", "q_composite", "q_text", "q_lookup", "q_ingest")


def load() -> None:
    """Import the query modules; each registers its entries."""
    for name in MODULES:
        import_module(f"tallyframe.plans.{name}")


def queries() -> dict[str, QueryFn]:
    load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


__all__ = ["REGISTRY", "queries", "oracle_sql", "register", "with_sales", "with_events"]
