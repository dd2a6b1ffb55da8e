"""Cleaning, cleaning report, profile and one-row dataset summary."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe import schema as S
from tallyframe.functions.cols import day_key, is_sale, money, positive, sum0

# Layouts of text dates that can be read in one way only, first match wins.
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd",
    "dd.MM.yyyy HH:mm",
    "dd.MM.yyyy",
]
# Layouts whose order of month and day the data must tell.
MONTH_FIRST = ["M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy"]
DAY_FIRST = ["d/M/yyyy H:mm", "d/M/yyyy H:mm:ss", "d/M/yyyy"]

RULES = ["duplicate", "missing_customer_id", "missing_description", "non_positive_price"]


def _parsed(c, formats: list[str]) -> F.Column:
    """First of ``formats`` that parses. One is only tried on a text with as many slashes and
    colons as it has (an offset, ``XXX``, may bring a colon or not): no field holds either, and
    a failed parse costs many times one that succeeds."""
    slashes, colons = (F.length(c) - F.length(F.replace(c, F.lit(m), F.lit(""))) for m in "/:")

    def read(f: str) -> F.Column:
        fits = slashes == f.count("/")
        return F.when(fits if "X" in f else fits & (colons == f.count(":")), F.try_to_timestamp(c, F.lit(f)))

    return F.coalesce(*map(read, formats))


def _slashed(text) -> tuple[F.Column, F.Column]:
    """A text date read month first and day first. Both orders are written with slashes; other
    texts are not parsed."""
    return tuple(F.when(text.contains("/"), _parsed(text, f)) for f in (MONTH_FIRST, DAY_FIRST))


def day_comes_first(df: DataFrame, column: str = S.INVOICE_DATE) -> F.Column:
    """Whether more text dates of ``df`` fit only a day-first layout than only a month-first one
    (a tie, or no such date: month first). One aggregate, as a scalar subquery."""
    month, day = (c.isNotNull() for c in _slashed(F.trim(F.col(column))))
    return df.agg((F.count_if(day & ~month) > F.count_if(month & ~day)).alias("day_first")).scalar()


def parse_timestamp(c, day_first: F.Column | bool = False) -> F.Column:
    """First layout that parses; null when none does (never an error). ``day_first`` decides
    dates such as 3/4/2024 that have two readings; those with one are read by it."""
    month, day = _parsed(c, MONTH_FIRST), _parsed(c, DAY_FIRST)
    given = F.lit(day_first) if isinstance(day_first, bool) else day_first
    return F.coalesce(_parsed(c, DATE_FORMATS), F.when(given, F.coalesce(day, month)).otherwise(F.coalesce(month, day)))


# Votes of so many files go through the driver, some 10 MB.
FEW_FILES = 100_000


def settle_dates(df: DataFrame, by: str, column: str = S.INVOICE_DATE, files: int | None = None) -> DataFrame:
    """Text dates with two readings, written as ISO dates in the order of month and day that
    the other dates with the same ``by`` (a file's name) speak for; ``by`` is dropped. Where
    those are even or there are none, the texts stay as they are. The votes are one row a file
    with a lead. ``files`` says how many there are at most: few votes are counted once for all
    passes over the result and broadcast, so that no row moves. Without it or with many, Spark
    sees to it, and splits a large file's rows."""
    if dict(df.dtypes)[column] != "string":
        return df.drop(by)
    text = F.trim(F.col(column))
    month, day = _slashed(text)
    lead = F.count_if(day.isNotNull() & month.isNull()) - F.count_if(month.isNotNull() & day.isNull())
    votes = df.groupBy(F.col(by).alias("_by")).agg(lead.alias("_lead")).filter("_lead <> 0")
    if files is not None and files <= FEW_FILES:
        votes = F.broadcast(df.sparkSession.createDataFrame(votes.collect(), votes.schema))
    iso = F.date_format(F.when(F.col("_lead") > 0, day).otherwise(month), "yyyy-MM-dd HH:mm:ss")
    two = month.isNotNull() & day.isNotNull() & F.col("_lead").isNotNull()
    return (df.join(votes, F.col(by) == F.col("_by"), "left")
            .withColumn(column, F.when(two, iso).otherwise(F.col(column))).drop(by, "_by", "_lead"))


# A whole number as a reader writes it: no leading zeros or plus sign that a number would lose.
WHOLE = r"^-?(0|[1-9][0-9]{0,17})([.]0*)?$"


def upload_types(df: DataFrame) -> dict[str, str]:
    """The types that keep every value of the text columns of ``df`` as given: ids are BIGINT if
    all of them are whole numbers, else text; quantities BIGINT if all are whole, else
    DECIMAL(18,6); prices DECIMAL(18,4), or DECIMAL(18,8) if one has more decimals. Texts that
    are no numbers decide nothing for the last two. One aggregate, one row to the driver."""
    text = {c for c, t in df.dtypes if t == "string"}

    def number(c):
        return F.expr(f"try_cast(trim({c}) AS DECIMAL(38,12))")

    checks = {
        S.CUSTOMER_ID: (("bigint", "string"), F.trim(S.CUSTOMER_ID).rlike(WHOLE) | (F.trim(S.CUSTOMER_ID) == "")),
        S.QUANTITY: (("bigint", "decimal(18,6)"), number(S.QUANTITY) == F.floor(number(S.QUANTITY))),
        S.PRICE: (("decimal(18,4)", "decimal(18,8)"), number(S.PRICE) == F.round(number(S.PRICE), 4))}
    asked = [c for c in checks if c in text]
    if not asked:
        return {}
    fits = df.agg(*[F.coalesce(F.bool_and(checks[c][1]), F.lit(True)).alias(c) for c in asked]).first()
    return {c: checks[c][0][0 if fits[c] else 1] for c in asked}


def _typed(c: str, kind: str) -> F.Column:
    """A text column as ``kind``; null where it cannot be read so."""
    if kind == "string":
        plain = F.regexp_replace(F.trim(c), r"^([0-9]+)[.]0*$", "$1")
        return F.when(plain != "", plain)
    if kind == "bigint":
        return F.expr(f"try_cast(try_cast(trim({c}) AS DECIMAL(38,6)) AS BIGINT)")
    return F.expr(f"try_cast(trim({c}) AS {kind})")


def coerce_types(df: DataFrame, source: DataFrame | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """Cast text columns of a mapped frame to the canonical types; failures become null. All
    text dates are read in one order of month and day, the one that ``source`` (all rows as
    given; ``df`` itself by default) speaks for. ``types`` (by default ``upload_types`` of
    ``source``, one pass over it) says how ids, quantities and prices are kept. Revenue, where
    it is not given, is the exact product of quantity and price."""
    out = df
    source = df if source is None else source
    given = dict(df.dtypes)
    types = upload_types(source) if types is None else types
    for c in (S.QUANTITY, S.PRICE, S.CUSTOMER_ID):
        if given.get(c) == "string":
            out = out.withColumn(c, _typed(c, types[c]))
    if given.get(S.INVOICE_DATE) == "string":
        out = out.withColumn(S.INVOICE_DATE, parse_timestamp(F.trim(F.col(S.INVOICE_DATE)), day_comes_first(source)))
    if S.REVENUE not in given and S.QUANTITY in out.columns and S.PRICE in out.columns:
        quantity = F.col(S.QUANTITY)
        quantity = quantity.cast("decimal(20,0)") if dict(out.dtypes)[S.QUANTITY] == "bigint" else quantity
        out = out.withColumn(S.REVENUE, (quantity * F.col(S.PRICE)).cast("decimal(28,10)"))
    return out


def _failing_rule(customer_id: F.Column | None = None, price: F.Column | None = None) -> F.Column:
    customer_id = F.col(S.CUSTOMER_ID) if customer_id is None else customer_id
    price = F.col(S.PRICE) if price is None else price
    return (F.when(customer_id.isNull(), F.lit("missing_customer_id"))
             .when(F.col(S.DESCRIPTION).isNull(), F.lit("missing_description"))
             .when(~(F.coalesce(price > 0, F.lit(False))), F.lit("non_positive_price")))


def _all_text(df: DataFrame) -> bool:
    return bool(df.columns) and all(t == "string" for _, t in df.dtypes)


# Between the fields of a packed row, and before a letter for a mark within a field or a null.
_NEXT, _MARK = "\x01", "\x02"


def _packed(df: DataFrame) -> DataFrame:
    """Rows of text columns as one text each, ``_row``: a third fewer bytes to shuffle, and equal
    where the rows are, null for null."""
    def field(c: F.Column) -> F.Column:
        plain = F.replace(F.replace(c, F.lit(_MARK), F.lit(_MARK + "b")), F.lit(_NEXT), F.lit(_MARK + "a"))
        return F.coalesce(plain, F.lit(_MARK + "n"))

    return df.select(F.concat_ws(_NEXT, *[field(F.col(f"`{c}`")) for c in df.columns]).alias("_row"))


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    def field(i: int) -> F.Column:
        c = F.get("_fields", F.lit(i))
        plain = F.replace(F.replace(c, F.lit(_MARK + "a"), F.lit(_NEXT)), F.lit(_MARK + "b"), F.lit(_MARK))
        return F.when(c != _MARK + "n", plain)

    return rows.select(F.split("_row", _NEXT).alias("_fields")).select(*[field(i).alias(c) for i, c in enumerate(columns)])


def clean_sales(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Drop exact duplicates (null equals null) → coerce → drop null customer →
    drop null description → keep price > 0. Dates that fail to parse stay as null.

    Deduplication runs before coercion, on the columns as given, like the source.
    """
    # Hash on every column: exact copies meet in one task, and no key — a customer or
    # an invoice holding a third of all rows — can pile its lines into one task.
    # Copies fail the same rules, so rows of text are ruled first and what stays moves packed.
    if _all_text(df):
        types = upload_types(df) if types is None else types
        good = df.filter(_failing_rule(*[_typed(c, types[c]) for c in (S.CUSTOMER_ID, S.PRICE)]).isNull())
        return coerce_types(_unpacked(_packed(good).repartition("_row").dropDuplicates(), df.columns), df, types)
    deduped = df.repartition(*[F.col(f"`{c}`") for c in df.columns]).dropDuplicates()
    typed = coerce_types(deduped, df, types)
    return typed.filter(_failing_rule().isNull())


def audited(df: DataFrame) -> DataFrame:
    """Every distinct row once, with ``_copies`` (how many times it occurred) and
    ``_rule`` (its first failing cleaning rule, null when kept).

    ``clean_sales`` is this frame filtered to ``_rule IS NULL``; ``cleaning_report``
    is an aggregate over it. Materializing it once serves both.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    grouped = df.repartition(*cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
    return ruled(coerce_types(grouped, df))


def ruled(df: DataFrame) -> DataFrame:
    """Typed rows plus ``_rule``, the first cleaning rule that each fails (null when kept)."""
    return df.withColumn("_rule", _failing_rule())


def report_from_audited(a: DataFrame) -> DataFrame:
    rule = F.col("_rule")
    agg = a.agg(
        sum0(F.col("_copies")).alias("total"),
        sum0(F.col("_copies") - 1).alias("duplicate"),
        F.count_if(rule == "missing_customer_id").alias("missing_customer_id"),
        F.count_if(rule == "missing_description").alias("missing_description"),
        F.count_if(rule == "non_positive_price").alias("non_positive_price"),
        F.count_if(rule.isNull()).alias("kept"),
        F.count_if(rule.isNull() & F.col(S.INVOICE_DATE).isNull()).alias("unparseable_date"),
    )
    names = RULES + ["kept", "total", "unparseable_date"]
    stack = "stack({n}, {pairs}) AS (rule, rows)".format(
        n=len(names), pairs=", ".join(f"'{r}', CAST({r} AS BIGINT)" for r in names))
    return agg.selectExpr(stack)


def _digest(df: DataFrame) -> F.Column:
    """16 bytes that tell rows of text columns apart: the MD5 of all fields, each with its length
    in front or as a mark if null. Two different rows of 10^9 agree with a chance of 10^-20."""
    fields = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
              for c in (F.col(f"`{n}`") for n in df.columns)]
    return F.unhex(F.md5(F.concat(*fields)))


def cleaning_report(df: DataFrame) -> DataFrame:
    """Rows removed per rule (first failing rule wins), plus kept / total / bad dates.

    One shuffle: duplicates are counted while grouping on all columns. Rows of text stay where
    they are: each is typed and ruled there, and only its digest, the place of its rule and
    whether it has a date are moved.
    """
    if not _all_text(df):
        return report_from_audited(audited(df))
    place = F.coalesce(*[F.when(F.col("_rule") == r, F.lit(i)) for i, r in enumerate(RULES)]).cast("tinyint")
    rule = F.coalesce(*[F.when(F.col("_place") == i, F.lit(r)) for i, r in enumerate(RULES)])
    told = ruled(coerce_types(df.withColumn("_row", _digest(df)), df)).select(
        "_row", place.alias("_place"), F.when(F.col(S.INVOICE_DATE).isNotNull(), F.lit(True)).alias(S.INVOICE_DATE))
    groups = told.repartition("_row").groupBy(*told.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return report_from_audited(groups.withColumn("_rule", rule))


def minimum_size_ok(df: DataFrame, n: int = 10) -> bool:
    """At least ``n`` rows after cleaning (reads at most n rows)."""
    return df.limit(n).count() >= n


def dataset_profile(df: DataFrame) -> DataFrame:
    """Per column: type, non-null count, null count, null % — one pass, then stacked."""
    exprs = [F.count(F.lit(1)).alias("_rows")]
    for c in df.columns:
        exprs.append(F.count_if(F.col(c).isNull()).alias(f"n__{c}"))
    one = df.agg(*exprs)
    dtypes = dict(df.dtypes)
    pairs = ", ".join(f"'{c}', '{dtypes[c]}', `n__{c}`" for c in df.columns)
    long = one.selectExpr("_rows", f"stack({len(df.columns)}, {pairs}) AS (column_name, data_type, null_count)")
    return long.select(
        "column_name", "data_type",
        F.col("_rows").alias("row_count"),
        F.col("null_count").cast("bigint").alias("null_count"),
        F.when(F.col("_rows") > 0, F.col("null_count") * 100 / F.col("_rows")).otherwise(F.lit(0.0)).alias("null_pct"),
    )


def dataset_summary(sales: DataFrame) -> DataFrame:
    """One row: customers, orders, revenue (sales), items (sales), products, date span,
    top country by sales revenue (ties: smallest name)."""
    base = sales.agg(
        money(sum0(F.when(is_sale(), F.col(S.REVENUE)))).alias("total_revenue_gbp"),
        sum0(F.when(is_sale(), F.col(S.QUANTITY))).cast("bigint").alias("total_items_sold"),
        day_key(F.min(S.INVOICE_DATE)).alias("date_from"),
        day_key(F.max(S.INVOICE_DATE)).alias("date_to"),
    )
    per_country = (sales.filter(is_sale() & F.col(S.COUNTRY).isNotNull())
                   .groupBy(S.COUNTRY).agg(F.sum(S.REVENUE).alias("rev")))
    top = per_country.agg(F.min_by(S.COUNTRY, F.struct(-F.col("rev"), F.col(S.COUNTRY)))).scalar()
    return base.select(
        n_distinct(sales, S.CUSTOMER_ID).alias("total_customers"),
        n_distinct(sales, S.INVOICE).alias("total_orders"),
        "total_revenue_gbp", "total_items_sold",
        n_distinct(sales, S.DESCRIPTION).alias("total_products"),
        "date_from", "date_to", top.alias("top_country"))


def n_distinct(df: DataFrame, c: str) -> F.Column:
    """Count of distinct non-null values of ``c`` as a scalar subquery.

    Planned as its own aggregate (partial distinct per task, then a count) instead of
    one of several ``count_distinct`` in a shared ``agg``, which would make Spark
    expand every input row once per distinct column before the shuffle.
    """
    return df.select(c).where(F.col(c).isNotNull()).distinct().agg(F.count(F.lit(1))).scalar()


def require_columns(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise S.MissingColumnsError(missing)


def empty_sales(spark) -> DataFrame:
    return spark.createDataFrame([], S.SALES_SCHEMA)



def dataset_samples(df: DataFrame, n: int = 3) -> DataFrame:
    """For every text column, its ``n`` smallest distinct non-null values joined with
    ', '. Each column is its own ``distinct → orderBy → limit`` plan (a bounded
    top-n per task), never a ``collect_set`` of a whole column."""
    spark = df.sparkSession
    parts = []
    for c, t in df.dtypes:
        if t != "string":
            continue
        top = df.select(F.col(f"`{c}`").alias("v")).where(F.col("v").isNotNull()).distinct().orderBy("v").limit(n)
        parts.append(spark.range(1).select(
            F.lit(c).alias("column_name"),
            top.agg(F.array_join(F.array_sort(F.collect_list("v")), ", ")).scalar().alias("sample_values")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dataset_context(df: DataFrame, n: int = 3) -> DataFrame:
    """Per column, in their order: type, rows, nulls, null % and, for text, the ``n`` smallest
    distinct values. One scan: each task reduces its rows to one row a column (counts and at
    most ``n`` values), and those are merged. An empty table gives its columns with 0 rows."""
    n = positive(n, "n")
    names = df.columns
    text = [t == "string" for _, t in df.dtypes]

    def reduce_rows(batches):
        rows, nulls = 0, [0] * len(names)
        least = [pa.array([], pa.string()) for _ in names]
        for b in batches:
            rows += b.num_rows
            for i, column in enumerate(b.columns):
                nulls[i] += column.null_count
                if not text[i]:
                    continue
                new = column.drop_null().cast(pa.string())
                if len(least[i]) == n:
                    new = new.filter(pc.less(new, least[i][n - 1]))
                if len(new):
                    both = pa.concat_arrays([least[i], new]).unique()
                    least[i] = both.take(pc.sort_indices(both)[:n])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(names)), pa.int64()), pa.array([rows] * len(names), pa.int64()), pa.array(nulls, pa.int64()),
             pa.array([v.to_pylist() for v in least], pa.list_(pa.string()))], ["id", "rows", "nulls", "least"])

    parts = df.mapInArrow(reduce_rows, "id long, rows long, nulls long, least array<string>")
    merged = parts.groupBy("id").agg(
        F.sum("rows").alias("row_count"), F.sum("nulls").alias("null_count"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("least")))), 1, n).alias("least"))
    at = (F.col("id") + 1).cast("int")
    count = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("row_count", "null_count")}
    return df.sparkSession.range(len(names)).join(merged, "id", "left").select(
        at.alias("place"), F.element_at(F.array(*map(F.lit, names)), at).alias("column_name"),
        F.element_at(F.array(*[F.lit(t) for _, t in df.dtypes]), at).alias("data_type"),
        count["row_count"].alias("row_count"), count["null_count"].alias("null_count"),
        F.when(F.col("row_count") > 0, F.col("null_count") * 100 / F.col("row_count")).otherwise(F.lit(0.0)).alias("null_pct"),
        F.when(F.element_at(F.array(*map(F.lit, text)), at), F.array_join("least", ", ")).alias("sample_values"))


def dataset_sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """``n`` example rows, the first by invoice and stock code, then by the columns in their
    order (a bounded top-n)."""
    keys = [c for c in ("invoice", "stock_code") if c in df.columns]
    keys += [c for c, t in df.dtypes if c not in keys and "map<" not in t and t != "variant"]
    return df.orderBy(*[F.col(f"`{c}`") for c in keys]).limit(n)
