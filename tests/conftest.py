from __future__ import annotations

import os
import sys
import tempfile
from datetime import datetime
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    ckpt = tempfile.mkdtemp(prefix="tally-test-ckpt-")
    s = (SparkSession.builder.master("local[4]").appName("tallyframe-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", ckpt)
         .config("spark.driver.memory", "4g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _ts(v):
    if v is None or isinstance(v, datetime):
        return v
    fmt = "%Y-%m-%d %H:%M" if " " in v else "%Y-%m-%d"
    return datetime.strptime(v, fmt)


@pytest.fixture
def mk_sales(spark):
    """Rows (invoice, description, quantity, price, date, customer, country) → canonical frame."""
    from tallyframe import schema as S

    def make(rows):
        out = []
        for inv, desc, qty, price, date, cust, country in rows:
            p = Decimal(str(price)).quantize(Decimal("0.0001"))
            rev = (p * qty).quantize(Decimal("0.01"))
            out.append((str(inv), None, desc, int(qty), p, rev, _ts(date), cust, country))
        return spark.createDataFrame(out, S.SALES_SCHEMA)
    return make
