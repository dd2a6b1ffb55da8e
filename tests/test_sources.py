"""Ingestion: header mapping, CSV encodings, cleaning report, event log."""

from __future__ import annotations

import json
import os
import re
import tempfile
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe import schema as S
from tallyframe.operators import clean, customers, sales
from tallyframe.sources import csv as csvsrc
from tallyframe.sources import eventlog
from tallyframe.sources.mapping import apply_mapping, detect_column_mapping, merge_overrides, missing_required

HEADER = ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"]


def test_mapping_exact_then_alias_each_header_once():
    m = detect_column_mapping(["order_id", " Customer ID ", "product", "qty", "date", "unit price", "region", "name"])
    assert m == {"Customer ID": " Customer ID ", "Invoice": "order_id", "Description": "product", "Quantity": "qty",
                 "Price": "unit price", "InvoiceDate": "date", "Country": "region"}
    assert not missing_required(m)


def test_mapping_override_and_missing():
    m = detect_column_mapping(["user_id", "event_id", "event_type", "value", "ts"])
    assert m["Customer ID"] == "user_id" and m["Invoice"] is None
    assert set(missing_required(m)) == {"Invoice", "Description", "Quantity", "Price", "InvoiceDate"}
    m2 = merge_overrides(m, {"Invoice": "event_id", "Description": "event_type", "Price": "value",
                             "InvoiceDate": "ts", "Quantity": "value", "Bogus": "x"})
    assert not missing_required(m2) and "Bogus" not in m2


def test_apply_mapping_raises_at_plan_time(spark):
    df = spark.createDataFrame([("1",)], "a string")
    with pytest.raises(S.MissingColumnsError):
        apply_mapping(df, detect_column_mapping(df.columns))


def _write(path, lines, encoding):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write("\n".join(lines) + "\n")


def test_csv_encoding_fallback_and_cleaning(spark):
    d = tempfile.mkdtemp(prefix="tally-csv-")
    rows_utf8 = [",".join(HEADER),
                 '536365,85123A,WHITE HANGING HEART,6,2010-12-01 08:26:00,2.55,17850.0,United Kingdom',
                 '536365,85123A,WHITE HANGING HEART,6,2010-12-01 08:26:00,2.55,17850.0,United Kingdom',
                 '536366,22633,"HAND WARMER, UNION JACK",6,2010-12-01,1.85,,United Kingdom',
                 '536367,22632,,6,2010-12-01 08:34:00,1.85,13047.0,United Kingdom',
                 'C536368,22632,RED HEART,-2,2010-12-01 08:34:00,1.85,13047.0,United Kingdom',
                 '536369,22632,RED HEART,2,not a date,0,13047.0,United Kingdom',
                 '536370,22632,CAFÉ SET,2,12/1/2010 9:00,3.00,13048.0,España']
    rows_latin = [",".join(HEADER), '536371,21000,CRÈME POT,1,2010-12-02 10:00:00,4.00,13049.0,Côte']
    _write(os.path.join(d, "a.csv"), rows_utf8, "utf-8")
    _write(os.path.join(d, "b.csv"), rows_latin, "iso-8859-1")
    raw = csvsrc.read_csv_text(spark, d)
    mapped = apply_mapping(raw, detect_column_mapping(raw.columns))
    rep = {r["rule"]: r["rows"] for r in clean.cleaning_report(mapped).collect()}
    assert rep == {"duplicate": 1, "missing_customer_id": 1, "missing_description": 1, "non_positive_price": 1,
                   "kept": 4, "total": 8, "unparseable_date": 0}
    cleaned = clean.clean_sales(mapped)
    got = {r["invoice"]: r for r in cleaned.collect()}
    assert set(got) == {"536365", "C536368", "536370", "536371"}
    assert got["536371"]["description"] == "CRÈME POT" and got["536371"]["country"] == "Côte"
    assert got["536370"]["invoice_date"].hour == 9 and got["C536368"]["quantity"] == -2
    assert got["536365"]["customer_id"] == 17850 and float(got["536365"]["revenue"]) == 15.3


def test_dataset_profile_counts(mk_sales):
    s = mk_sales([(1, "A", 1, 1.0, None, 1, None), (2, None, 1, 1.0, "2020-01-01", 2, "UK")])
    prof = {r["column_name"]: r for r in clean.dataset_profile(s).collect()}
    assert prof["invoice_date"]["null_count"] == 1 and prof["country"]["null_pct"] == 50.0
    assert prof["invoice"]["row_count"] == 2


def test_event_log_round_trip_and_summary(spark):
    d = tempfile.mkdtemp(prefix="tally-log-")
    recs = [
        {"id": "1", "event": "profile_submitted", "timestamp": "2026-01-01T10:00:00Z", "email": "a@x"},
        {"id": "2", "event": "strategy_generated", "timestamp": "2026-01-02T10:00:00Z", "email": "a@x",
         "goal_label": "grow", "business_type": "shop", "goal_questions": ["q1", "q2"]},
        {"id": "3", "event": "strategy_generated", "timestamp": "2026-01-03T10:00:00Z", "email": "",
         "goal_label": "grow", "business_type": "cafe"},
        {"id": "4", "event": "strategy_generated", "timestamp": "2026-01-04T10:00:00Z", "email": "b@x",
         "goal_label": "cut costs", "business_type": "cafe"},
    ]
    src = os.path.join(d, "src.json")
    with open(src, "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs))
    log = eventlog.read_event_log(spark, src)
    out = os.path.join(d, "log")
    eventlog.append_events(log, out)
    again = eventlog.read_event_log(spark, out)
    s = eventlog.strategy_log_summary(again).first().asDict()
    assert s == {"total_strategies": 3, "unique_emails": 2, "top_goal": "grow", "top_biz": "cafe"}
    first = eventlog.strategy_entries(again).first()
    assert first["id"] == "4" and again.filter("id = '2'").first()["goal_questions"] == ["q1", "q2"]


def test_csv_files_with_different_header_orders_and_a_space(spark, tmp_path):
    from tallyframe.sources.csv import read_csv_text
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "1.csv").write_text("invoice,quantity,price\n1,2,3.5\n")
    (tmp_path / "a b" / "2.csv").write_text("price,invoice,quantity\n4.5,2,7\n")
    (tmp_path / "a b" / "3.csv").write_bytes("invoice,quantity,price,name\n3,1,1.0,caf\xe9\n".encode("latin-1"))
    got = read_csv_text(spark, str(tmp_path / "a b"))
    rows = {r.invoice: (r.quantity, r.price, r.name) for r in got.collect()}
    assert rows == {"1": ("2", "3.5", None), "2": ("7", "4.5", None), "3": ("1", "1.0", "caf\xe9")}


def test_parquet_timestamps_keep_fractions(spark, tmp_path):
    from tallyframe.sources.csv import read_sales_parquet
    path = str(tmp_path / "s.parquet")
    spark.sql("SELECT '1' AS invoice, 'p' AS description, 2 AS quantity, 1.5 AS price, 7 AS customer_id, 'UK' AS country, "
              "TIMESTAMP '2010-01-05 10:00:00.123' AS invoice_date").write.parquet(path)
    row = read_sales_parquet(spark, path).first()
    assert str(row.invoice_date) == "2010-01-05 10:00:00.123000"


def test_text_dates_of_more_layouts(spark):
    from tallyframe.operators.clean import parse_timestamp
    from pyspark.sql import functions as F
    texts = ["13/02/2010", "13/02/2010 10:00:05", "2010-02-13T10:00:00Z", "2010-02-13 10:00:00.25"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_timestamp(F.col("t")).cast("date").alias("d"))
    assert [str(r.d) for r in got.collect()] == ["2010-02-13"] * 4


def test_event_log_keeps_whole_texts(spark, tmp_path):
    from tallyframe.sources.eventlog import append_events, read_event_log
    path = str(tmp_path / "log")
    append_events(spark.createDataFrame([("strategy_generated", "x" * 5000)], "event string, strategy_snippet string"), path)
    assert len(read_event_log(spark, path).first().strategy_snippet) == 5000


def test_query_modules_import_alone():
    import subprocess
    import sys
    subprocess.run([sys.executable, "-c", "import tallyframe.plans.q_products"], check=True)


def test_counts_are_honoured_or_refused(spark, mk_sales):
    from tallyframe.operators.customers import cohort_retention, customer_clv
    sales = mk_sales([("1", "p", 1, 2, "2010-01-05", 7, "UK")])
    year, five = (customer_clv(sales, m).first() for m in (12, 60))
    money = [c for c in year.asDict() if "clv" in c.lower() or "project" in c.lower()]
    assert money and all(abs(five[c] - 5 * year[c]) < 0.02 for c in money)
    with pytest.raises(ValueError):
        cohort_retention(sales, 0)


def test_csv_heads_of_many_files_take_few_jobs(spark, tmp_path):
    from tallyframe.sources.csv import read_csv_groups
    for i in range(120):
        (tmp_path / f"{i}.csv").write_bytes(("\n  \n" * (i % 2) + f"invoice,n\xe4me{i % 3}\n{i},\xe9\n").encode(
            "latin-1" if i % 5 == 0 else "utf-8"))
    (tmp_path / "empty.csv").write_text("")
    sc = spark.sparkContext
    sc.setJobGroup("heads", "heads")
    groups = read_csv_groups(spark, str(tmp_path))
    jobs = len(sc.statusTracker().getJobIdsForGroup("heads"))
    sc.setJobGroup("other", "other")
    assert jobs <= 16 and len(groups) == 6      # at most two for listing and one read for each header and encoding
    got = {r[0]: r[1] for g in groups for r in g.collect()}
    assert got == {str(i): "\xe9" for i in range(120)}


def test_csv_blocks_of_one_file(spark, tmp_path):
    """The header is the first line also where the file is read in many blocks."""
    from tallyframe.sources.csv import file_heads
    (tmp_path / "big.csv").write_text("b,a\n" + "a,b\n" * 20000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = file_heads(spark, [str(tmp_path)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(bytes(r["head"]), r["is_utf8"]) for r in rows] == [(b"b,a", True)]


def test_column_names_are_made_unique():
    from tallyframe.sources.csv import column_names
    assert column_names(b'\xef\xbb\xbfa,"b, c",,A', "UTF-8") == ("a0", "b, c", "_c2", "A3")
    assert column_names("n\xe4me".encode("latin-1"), "ISO-8859-1") == ("n\xe4me",)


def test_csv_files_are_mapped_each_by_its_header(spark, tmp_path):
    (tmp_path / "1.csv").write_text("Invoice,Description,Quantity,Price,InvoiceDate,Customer ID,Country\n1,p,2,3.5,2010-01-05,7,UK\n")
    (tmp_path / "2.csv").write_text("user_id,order_id,goods,qty,cost,when\n9007199254740993,2,q,1,4,13/02/2010 9:30\n8,3,q,1,4,3/2/2010\n")
    got = csvsrc.read_sales_csv(spark, str(tmp_path), overrides={"InvoiceDate": "when"}).collect()
    rows = {r["invoice"]: (r["customer_id"], r["country"], str(r["invoice_date"])) for r in got}
    assert rows == {"1": (7, "UK", "2010-01-05 00:00:00"), "2": (9007199254740993, None, "2010-02-13 09:30:00"),
                    "3": (8, None, "2010-02-03 00:00:00")}
    with pytest.raises(S.MissingColumnsError):
        csvsrc.read_sales_csv(spark, str(tmp_path), overrides={"InvoiceDate": "nowhere"})
    with pytest.raises(S.MissingColumnsError):
        csvsrc.read_sales_csv(spark, str(tmp_path))         # the second kind has no known date header


@pytest.mark.parametrize("dates,want", [
    (["3/4/2024", "25/12/2024", "2024-01-02"], ["2024-04-03", "2024-12-25", "2024-01-02"]),
    (["3/4/2024", "12/25/2024 10:00"], ["2024-03-04", "2024-12-25"]),
    (["3/4/2024", None, "junk"], ["2024-03-04", None, None]),
    (["3/4/2024", "13/1/2024", "14/1/2024", "1/15/2024"], ["2024-04-03", "2024-01-13", "2024-01-14", "2024-01-15"])])
def test_one_order_of_month_and_day(spark, dates, want):
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(dates)], "invoice string, invoice_date string")
    got = clean.coerce_types(df).selectExpr("invoice", "string(date(invoice_date)) AS d").collect()
    assert [r["d"] for r in sorted(got, key=lambda r: r["invoice"])] == want


def test_named_batches_are_kept_once(spark, tmp_path):
    log = spark.createDataFrame([("1", "strategy_generated")], "id string, event string")
    path = str(tmp_path / "log")
    for batch in ("a", "b", "a"):
        eventlog.append_events(log, path, batch)
    eventlog.append_events(log, path)
    assert eventlog.read_event_log(spark, path).count() == 3


def test_preview_and_minimum_size(spark):
    from tallyframe.sources.mapping import mapping_preview
    df = spark.range(12).selectExpr("id", "CASE WHEN id > 0 THEN 'x' END AS name").coalesce(1)
    got = mapping_preview(df, 2)
    assert got["columns"] == ["id", "name"] and got["row_count"] == 12
    assert got["preview"] == [["0", ""], ["1", "x"]] and got["dtypes"] == {"id": "bigint", "name": "string"}
    assert clean.minimum_size_ok(df) and clean.minimum_size_ok(df, 12)
    assert not clean.minimum_size_ok(df, 13) and not clean.minimum_size_ok(df.limit(0))


def test_dataset_context_in_one_pass(spark):
    df = spark.createDataFrame([("b", 1, None), ("a", None, "x, y"), ("c", 3, None), ("a", 4, ""), ("\xe9", 5, None)],
                               "name string, n int, note string").repartition(3)
    got = [tuple(r) for r in clean.dataset_context(df).orderBy("place").collect()]
    assert got == [(1, "name", "string", 5, 0, 0.0, "a, b, c"), (2, "n", "int", 5, 1, 20.0, None),
                   (3, "note", "string", 5, 3, 60.0, ", x, y")]
    none = [tuple(r) for r in clean.dataset_context(df.limit(0), 1).orderBy("place").collect()]
    assert [r[1:6] for r in none] == [(c, t, 0, 0, 0.0) for c, t in df.dtypes]
    twice = clean.dataset_context(df.select("n", "n", a_map()))
    assert [r["null_count"] for r in twice.orderBy("place").collect()] == [1, 1, 0]


def a_map():
    return F.create_map(F.lit("k"), F.lit(1)).alias("m")


def test_ids_quantities_and_prices_are_kept_as_given(spark, tmp_path):
    """Ids that are no numbers stay, 2^53 + 1 stays itself, fractions stay, revenue is exact."""
    path = str(tmp_path / "a.csv")
    lines = [",".join(HEADER),
             "1,a,TEA,2.5,2024-01-02,0.333,C-11,UK", "2,a,TEA,1,2024-01-02,0.000012,9007199254740993,UK",
             "3,a,TEA,1,2024-01-02,3,00123,UK", "4,a,TEA,1,2024-01-02,3,17850.0,UK", "5,a,TEA,1,2024-01-02,3, ,UK",
             "6,a,TEA,1,2024-01-02,3,NaN,UK", "7,a,N/A,1,2024-01-02,3,5,UK", "8,a,TEA,x,2024-01-02,3,5,UK"]
    _write(path, lines, "utf-8")
    got = {r["invoice"]: r for r in csvsrc.read_sales_csv(spark, path).collect()}
    assert {k: r["customer_id"] for k, r in got.items()} == {
        "1": "C-11", "2": "9007199254740993", "3": "00123", "4": "17850", "8": "5"}
    assert str(got["1"]["quantity"]) == "2.500000" and got["8"]["quantity"] is None
    assert got["1"]["revenue"] == Decimal("0.8325") and got["2"]["revenue"] == Decimal("0.000012")
    report = {r["rule"]: r["rows"] for r in clean.cleaning_report(csvsrc.read_sales_csv(spark, path, clean=False)).collect()}
    assert report["missing_customer_id"] == 2 and report["missing_description"] == 1 and report["kept"] == 5
    one = customers.customer_orders(csvsrc.read_sales_csv(spark, path), customer_id="C-11").collect()
    assert [(r["invoice"], r["items_bought"], r["total_revenue_gbp"]) for r in one] == [("1", 2, 0.83)]
    assert sales.total_revenue(csvsrc.read_sales_csv(spark, path)).first()[0] == 6.83


def test_whole_numbers_stay_numbers(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    _write(path, [",".join(HEADER), "1,a,TEA,2.0,2024-01-02,0.5,17850.0,UK", "2,a,TEA,3,2024-01-02,0.5,,UK"], "utf-8")
    df = csvsrc.read_sales_csv(spark, path)
    assert dict(df.dtypes)["customer_id"] == "bigint" and dict(df.dtypes)["quantity"] == "bigint"
    assert [(r["customer_id"], r["quantity"], r["revenue"]) for r in df.collect()] == [(17850, 2, 1)]
    given = {"customer_id": "string", "quantity": "decimal(18,6)", "price": "decimal(18,4)"}
    assert csvsrc.read_sales_csv(spark, path, types=given).first()["customer_id"] == "17850"


def test_each_file_has_its_own_order_of_month_and_day(spark, tmp_path):
    """One header, three files: day first, month first, and one that does not tell."""
    for name, dates in (("a", ["3/4/2024", "25/12/2024 9:30"]), ("b", ["3/4/2024", "12/25/2024"]), ("c", ["3/4/2024"])):
        _write(str(tmp_path / f"{name}.csv"), [",".join(HEADER)] + [
            f"{name}{i},x,TEA,1,{d},1.5,7,UK" for i, d in enumerate(dates)], "utf-8")
    got = {r["invoice"]: r["invoice_date"].strftime("%m-%d") for r in csvsrc.read_sales_csv(spark, str(tmp_path)).collect()}
    assert got == {"a0": "04-03", "a1": "12-25", "b0": "03-04", "b1": "12-25", "c0": "03-04"}


def test_lines_without_partners_are_counted(spark, tmp_path):
    """A line without its order or part is removed by a rule, not lost in the join."""
    from tallyframe.sources.star import STAR_TABLES, star_sales_raw
    tables = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in STAR_TABLES}
    n = tables["lineitem"].count()
    orders, parts = tables["orders"].filter("o_orderkey % 5 <> 0"), tables["part"].filter("p_partkey % 7 <> 0")
    lost = tables["lineitem"].join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").distinct()
    for t, df in {**tables, "orders": orders, "part": parts}.items():
        df.write.parquet(str(tmp_path / f"{t}.parquet"))
    rep = {r["rule"]: r["rows"] for r in clean.cleaning_report(star_sales_raw(spark, str(tmp_path))).collect()}
    assert rep["total"] == n and rep["missing_description"] > 0
    assert 0 < rep["missing_customer_id"] <= lost.count()
    assert sum(rep[r] for r in clean.RULES) + rep["kept"] == n


def test_layouts_are_tried_only_where_their_marks_fit(spark):
    """Each text is read as by trying all layouts in turn."""
    texts = ["2024-01-02 03:04:05", "2024-01-02 03:04", "2024-01-02T03:04:05", "2024-01-02 03:04:05.123456", "2024-01-02T03:04:05Z",
             "2024-01-02T03:04:05+01:00", "2024-01-02", "31.12.2024 23:59", "1.2.2024", "01.02.2024", "1/2/2024 3:04", "13/2/2024 3:04",
             "1/13/2024 3:04:05", "0001/0002/2024", "1/2/2024", "-1/2/2024", "1/2/2024 3", "1:2/3/2024", "//::", "", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    formats = clean.DATE_FORMATS + clean.MONTH_FIRST + clean.DAY_FIRST
    for some in (clean.DATE_FORMATS, clean.MONTH_FIRST, clean.DAY_FIRST, formats):
        plain = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in some])
        assert df.filter(~clean._parsed(F.col("t"), some).eqNullSafe(plain)).collect() == []
    tried = df.filter("t like '%/%'").select(clean._parsed(F.col("t"), clean.DATE_FORMATS))
    assert tried._jdf.queryExecution().analyzed().toString().lower().count("when") >= len(clean.DATE_FORMATS)


def test_upload_is_packed(spark, tmp_path):
    from tallyframe.plans.q_ingest import _write_upload
    from tallyframe.sources import catalog
    sold = catalog.sales(spark, "/root/testdata/sf0.001")
    _write_upload(sold, str(tmp_path))
    for folder in ("bought", "returned"):
        assert {f.name.rsplit(".", 1)[1] for f in (tmp_path / folder).glob("part-*")} == {"gz"}
    n = sold.count() + 5 * sold.filter("quantity < 0").count()
    assert csvsrc.read_sales_csv(spark, [f"{tmp_path}/bought", f"{tmp_path}/returned"], clean=False).count() == n


def _star(spark, path):
    """Repeated lines, orders, customers and parts, some with other values; null keys; missing partners."""
    tables = {
        "lineitem": ("l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string",
                     [(1, 1, 2.0, 10.0, "N")] * 3 + [(1, 1, 2.0, 10.0, "R"), (1, 2, 0.0, 5.0, "N"), (2, 1, 1.0, 3.5, "N"),
                      (2, 9, 1.0, 3.5, "N"), (9, 1, 1.0, 3.5, "A"), (None, 1, 1.0, 3.5, "N"), (None, 1, 1.0, 3.5, "N"),
                      (3, None, 1.0, None, "N"), (4, 3, None, 2.0, None)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
                   [(1, 7, datetime(2020, 1, 1))] * 2 + [(1, 8, datetime(2020, 1, 1)), (2, 7, None), (3, None, datetime(2020, 2, 1)),
                    (4, 99, datetime(2020, 2, 1)), (None, 7, None)]),
        "customer": ("c_custkey long, c_nationkey long", [(7, 0), (7, 0), (7, 1), (8, None), (None, 1)]),
        "nation": ("n_nationkey long, n_name string", [(0, "A"), (1, "B"), (1, "B")]),
        "part": ("p_partkey long, p_name string", [(1, "tea"), (1, "tea"), (1, "cup"), (2, None), (3, "pot")])}
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{t}.parquet")


@pytest.mark.parametrize("limit", ["2000000", "1"])
def test_copies_counted_before_the_joins(spark, tmp_path, limit):
    """The same rows and copies as counting after them, and no text in a line's first shuffle."""
    from tallyframe.sources.star import star_sales_distinct, star_sales_raw
    _star(spark, tmp_path)
    spark.conf.set("tallyframe.dim.broadcastRows", limit)
    try:
        got = clean.ruled(star_sales_distinct(spark, str(tmp_path)))
        want = clean.audited(star_sales_raw(spark, str(tmp_path)))
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("tallyframe.dim.broadcastRows")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("hashpartitioning(")[1:] if "description" in x.split("]")[0]]


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_changed_tables_have_another_fingerprint(spark, tmp_path, scheme):
    """Also where only Spark can list them, as a path with a scheme stands for here."""
    from tallyframe.sources.catalog import fingerprint
    path = f"{scheme}{tmp_path}"
    spark.range(5).write.parquet(f"{path}/a.parquet")
    first = fingerprint(spark, path, ["a", "b"])
    assert first == fingerprint(spark, path, ["a", "b"]) != fingerprint(spark, path, ["a"])
    spark.range(6).write.mode("append").parquet(f"{path}/a.parquet")
    assert fingerprint(spark, path, ["a", "b"]) != first


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"(?<!Broadcast)Exchange ", line)]


def test_votes_on_dates_move_no_rows(spark, tmp_path, monkeypatch):
    """The votes of a few files meet the rows without a shuffle, whatever size Spark takes them for."""
    for name, dates in (("d", ["13/2/2010", "3/4/2010"]), ("m", ["2/13/2010", "3/4/2010"])):
        _write(str(tmp_path / f"{name}.csv"), [",".join(HEADER)] + [
            f"{name}{i},1,p,2,{d} 9:30,3.5,7,UK" for i, d in enumerate(dates)], "utf-8")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = csvsrc.read_sales_csv(spark, str(tmp_path), clean=False)
        assert _exchanges(rows) == []
        want = sorted(map(tuple, rows.collect()))
        monkeypatch.setattr(clean, "FEW_FILES", 0)
        many = csvsrc.read_sales_csv(spark, str(tmp_path), clean=False)
        assert len(_exchanges(many)) > 0 and sorted(map(tuple, many.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r[0]: r[5][:10] for r in want if r[0][1] == "1"} == {"d1": "2010-04-03", "m1": "2010-03-04"}


ODD_ROWS = [("1", "a", "p", "2", "3.5", "2010-01-05", "7", "UK")] * 3 + [
    ("1", "a", "p", "2", "3.50", "2010-01-05", "7", "UK"),            # the same values, not the same texts
    ("1", None, "p", "2", "3.5", "2010-01-05", "7", "UK"), ("1", "", "p", "2", "3.5", "2010-01-05", "7", "UK"),
    ("1", "-", "p", "2", "3.5", "2010-01-05", "7", "UK"), ("1", "\x02n", "p", "2", "3.5", "2010-01-05", "7", "UK"),
    ("\x01", "\x02", "\x01\x02a", "2", "3.5", "no date", "7", "\x02\x01b"), ("\x01\x02", "", "\x02a", "2", "3.5", None, "7", ""),
    ("1:a", "", "p", "2", "1", "2010-01-05", "7", None), ("1", ":a", "p", "2", "1", "2010-01-05", "7", None),
    ("2", "a", "p", "2", "3.5", "2010-01-05", None, "UK"), ("2", "a", "p", "2", "3.5", "2010-01-05", None, "UK"),
    ("2", "a", "p", "2", "3.5", "2010-01-05", "x", "UK"), ("2", "a", None, "2", "3.5", "2010-01-05", "7", "UK"),
    ("2", "a", "p", "2", "0", "2010-01-05", "7", "UK"), ("2", "a", "p", "2", "much", "2010-01-05", "7", "UK"),
    (None,) * 8, (None,) * 8]


def _odd(spark):
    return spark.createDataFrame(ODD_ROWS, "invoice string, stock_code string, description string, quantity string, "
                                 "price string, invoice_date string, customer_id string, country string").repartition(3)


def test_report_of_text_rows_moves_digests_only(spark):
    """Text rows are told apart field by field, nulls, empty texts and marks included, by one small shuffle."""
    df = _odd(spark)
    report = clean.cleaning_report(df)
    want = sorted(map(tuple, clean.report_from_audited(clean.audited(df)).collect()))
    assert sorted(map(tuple, report.collect())) == want
    n = dict(want)
    assert n["total"] == len(ODD_ROWS) and n["duplicate"] == len(ODD_ROWS) - len(set(ODD_ROWS))
    moved = [x for x in _exchanges(report) if "hashpartitioning" in x]
    assert moved and not any("description" in x for x in moved)


def test_text_rows_are_cleaned_packed(spark):
    """Rows move as one text and come back as they were given."""
    df = _odd(spark)
    got = clean.clean_sales(df)
    assert not any("description" in x for x in _exchanges(got) if "hashpartitioning" in x)
    typed = clean.coerce_types(df.dropDuplicates(), df)
    want = typed.filter("customer_id is not null and description is not null and price > 0")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.schema == want.schema
    assert got.count() == len({r for r in ODD_ROWS if r[6] is not None and r[2] is not None and r[4] not in ("0", "much")})
