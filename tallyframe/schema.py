"""Canonical schema of the ``sales`` frame and the header aliases used to map uploads.

Internally the canonical columns are snake_case; ``DISPLAY_NAMES`` gives the
user-facing header each one corresponds to.
"""

from __future__ import annotations

from pyspark.sql import types as T

INVOICE = "invoice"
STOCK_CODE = "stock_code"
DESCRIPTION = "description"
QUANTITY = "quantity"
PRICE = "price"
REVENUE = "revenue"
INVOICE_DATE = "invoice_date"
CUSTOMER_ID = "customer_id"
COUNTRY = "country"

MONEY = T.DecimalType(18, 2)
UNIT_PRICE = T.DecimalType(18, 4)

SALES_SCHEMA = T.StructType([
    T.StructField(INVOICE, T.StringType(), True),
    T.StructField(STOCK_CODE, T.StringType(), True),
    T.StructField(DESCRIPTION, T.StringType(), True),
    T.StructField(QUANTITY, T.LongType(), True),
    T.StructField(PRICE, UNIT_PRICE, True),
    T.StructField(REVENUE, MONEY, True),
    T.StructField(INVOICE_DATE, T.TimestampType(), True),
    T.StructField(CUSTOMER_ID, T.LongType(), True),
    T.StructField(COUNTRY, T.StringType(), True),
])
SALES_COLUMNS = [f.name for f in SALES_SCHEMA.fields]

# Canonical header names as users see them.
DISPLAY_NAMES = {
    CUSTOMER_ID: "Customer ID",
    INVOICE: "Invoice",
    DESCRIPTION: "Description",
    QUANTITY: "Quantity",
    PRICE: "Price",
    INVOICE_DATE: "InvoiceDate",
    COUNTRY: "Country",
    STOCK_CODE: "StockCode",
}

# Header aliases per canonical column, in match-priority order.
# The canonical order below is also the order in which columns claim headers.
COLUMN_ALIASES: dict[str, list[str]] = {
    "Customer ID": [
        "customer id", "customerid", "customer_id", "cust_id", "custid",
        "client id", "client_id", "user id", "user_id", "buyer id", "buyer_id",
        "account id", "account_id", "member id", "member_id", "contact id",
    ],
    "Invoice": [
        "invoice", "invoice_id", "invoiceid", "invoice no", "invoice_no",
        "invoice number", "order id", "order_id", "orderid", "order no",
        "order number", "order_number", "transaction id", "transaction_id",
        "txn_id", "txid", "receipt id", "receipt_id", "sale id", "sale_id",
        "ref", "reference",
    ],
    "Description": [
        "description", "product description", "product_description",
        "item description", "item_description", "product name", "product_name",
        "productname", "item name", "item_name", "product", "item", "sku name",
        "sku_name", "article", "goods", "name", "product title", "title",
    ],
    "Quantity": [
        "quantity", "qty", "units", "count", "volume", "number of items",
        "items", "num_units", "ordered_qty", "order_qty", "pieces",
    ],
    "Price": [
        "price", "unit price", "unit_price", "unitprice", "price per unit",
        "rate", "cost", "sale price", "selling price", "item price",
        "unit cost", "unit_cost", "list price", "retail price",
    ],
    "InvoiceDate": [
        "invoicedate", "invoice date", "invoice_date", "date", "order date",
        "order_date", "orderdate", "transaction date", "transaction_date",
        "purchase date", "purchase_date", "sale date", "sale_date",
        "created at", "created_at", "timestamp", "datetime", "time",
    ],
    "Country": [
        "country", "country name", "country_name", "nation", "region",
        "territory", "market", "geography", "location", "billing country",
        "billing_country", "ship country", "ship_country",
    ],
}

# The six columns an upload must provide (Country is optional).
REQUIRED_COLUMNS = ["Customer ID", "Invoice", "Description", "Quantity", "Price", "InvoiceDate"]

CANONICAL_BY_DISPLAY = {v: k for k, v in DISPLAY_NAMES.items()}


class MissingColumnsError(ValueError):
    """Raised at plan-build time when a required canonical column has no source."""

    def __init__(self, missing: list[str]):
        self.missing = list(missing)
        super().__init__("required columns have no mapping: " + ", ".join(self.missing))
