"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe import schema as S

MICROS_PER_DAY = 86_400_000_000


def col(name: str) -> Column:
    return F.col(name)


def is_sale() -> Column:
    """Positive base: lines with Quantity > 0."""
    return F.col(S.QUANTITY) > 0


def is_return() -> Column:
    return F.col(S.QUANTITY) < 0


def month_key(ts: Column | str = S.INVOICE_DATE) -> Column:
    """Calendar month as 'yyyy-MM' (null for null timestamps)."""
    return F.date_format(_c(ts), "yyyy-MM")


def day_key(ts: Column | str = S.INVOICE_DATE) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd")


def month_index(ts: Column | str = S.INVOICE_DATE) -> Column:
    """Months since year 0: year*12 + month-1. Differences count calendar months."""
    t = _c(ts)
    return (F.year(t) * F.lit(12) + F.month(t) - F.lit(1)).cast("int")


def month_key_from_index(idx: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(idx / 12).cast("int"), (idx % 12 + 1).cast("int"))


def elapsed_days(start: Column | str, end: Column | str) -> Column:
    """Complete days from ``start`` to ``end`` (floored elapsed time, 23 h -> 0)."""
    diff = F.unix_micros(_c(end)) - F.unix_micros(_c(start))
    return F.floor(diff / F.lit(MICROS_PER_DAY)).cast("bigint")


def weekday_mon0(ts: Column | str = S.INVOICE_DATE) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ts))


def day_name(ts: Column | str = S.INVOICE_DATE) -> Column:
    return F.date_format(_c(ts), "EEEE")


def months_before(ts: Column | str, n: int) -> Column:
    """``ts`` minus n calendar months, keeping the time of day (month-end clamped)."""
    return _c(ts) - F.make_ym_interval(F.lit(0), F.lit(int(n)))


def money(dec: Column) -> Column:
    """Round an exact decimal amount to pence and hand it out as DOUBLE."""
    return F.round(dec, 2).cast("double")


def rnd(c: Column, n: int) -> Column:
    """Round a DOUBLE half away from zero at ``n`` places, as round(x·10ⁿ)/10ⁿ.

    Stated as plain IEEE operations so that every engine gets the same bits; exact
    decimal amounts use ``money`` instead.
    """
    k = float(10 ** n)
    return F.round(c * F.lit(k), 0) / F.lit(k) + F.lit(0.0)   # + 0.0 turns -0.0 into 0.0


def dbl(c: Column) -> Column:
    return c.cast("double")


def div(a: Column, b: Column) -> Column:
    """a / b as DOUBLE, null when b is 0 (ANSI mode would raise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def sum0(c: Column) -> Column:
    """Sum that is 0 (not null) over no rows."""
    return F.coalesce(F.sum(c), F.lit(0))


def contains_ci(c: Column | str, needle: str) -> Column:
    """Literal, case-insensitive substring test (no regex, no LIKE wildcards)."""
    return F.lower(_c(c)).contains(needle.lower())


def eq_ci(c: Column | str, value: str) -> Column:
    return F.lower(_c(c)) == F.lit(value.lower())


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def positive(value: int, name: str, least: int = 1) -> int:
    """A caller's count as given; an error, not another value, if it is too small."""
    if int(value) < least:
        raise ValueError(f"{name} must be at least {least}, not {value}")
    return int(value)
