"""Revenue forecasts (survey §2.5).

``revenue_forecast_linear`` — least squares over monthly sales revenue (months with
revenue > 0, indexed 0..n−1), from exact decimal sums.

``revenue_forecast`` / ``revenue_forecast_by_series`` — one seasonal model for one series or
for many, in place of a Bayesian curve fitter. Log daily revenue is a straight line with
sparse changes of slope, Fourier terms for weekly / 30.5-day / yearly cycles and a UK
bank-holiday flag; multiplicative seasonality becomes additive in logs. Spark reduces the
lines to one row per series and day and brings a series' days together: a group is bounded by
the calendar, never by the number of lines. There the most likely coefficients are found
from the moments (Gram matrix) of the columns: the smooth ones have normal priors and are
eliminated, the changes of slope have Laplace priors and are found by coordinate descent. The
band comes from simulated futures: changes of slope as frequent and as large as the past ones,
coefficients drawn from their posterior, residuals drawn anew, days without revenue as
frequent as on that weekday. ``forecast_backtest`` measures what the band covers.
It is a different model from the source's and is labelled so.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe import schema as S
from tallyframe.functions.cols import div, is_sale, money, month_index, month_key_from_index, positive, rnd
from tallyframe.functions.spine import fill_months
from tallyframe.functions.stats import index_sums, ols_intercept, ols_slope

C = F.col


def _monthly_pos(sales: DataFrame) -> DataFrame:
    per = (sales.filter(is_sale() & C(S.INVOICE_DATE).isNotNull())
           .groupBy(month_index().alias("month_idx")).agg(F.sum(S.REVENUE).alias("rev")))
    return fill_months(per, ["rev"])


def revenue_forecast_linear(sales: DataFrame, horizon: int = 3) -> DataFrame:
    """One row per future month: predicted revenue (clipped at 0) and the fit's
    slope, intercept, last actual month, trend and count of >5×median months.
    Empty when fewer than three months have revenue."""
    horizon = positive(horizon, "horizon")
    m = _monthly_pos(sales).filter(C("rev") > 0)
    m = m.withColumn("x", (F.row_number().over(Window.orderBy("month_idx")) - 1).cast("bigint"))
    med = m.agg(F.median("rev")).scalar()
    outl = m.agg(F.count_if(C("rev").cast("double") > F.lit(5.0) * med.cast("double"))).scalar()
    st = m.agg(F.count(F.lit(1)).alias("n"), F.sum("rev").alias("sy"), F.sum(C("x") * C("rev")).alias("sxy"),
               F.max("month_idx").alias("last_idx"), F.max_by("rev", "month_idx").alias("last_rev"))
    st = st.filter(C("n") >= 3).withColumn("outlier_months", outl)
    sx, sxx = index_sums(C("n"))
    slope = ols_slope(C("n"), sx, C("sy"), sxx, C("sxy"))
    st = st.withColumn("slope", slope).withColumn("intercept", ols_intercept(C("n"), sx, C("sy"), C("slope")))
    h = st.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    pred = C("intercept") + C("slope") * (C("n") - 1 + C("step")).cast("double")
    trend = F.when(C("slope") > 0, "upward").when(C("slope") < 0, "downward").otherwise("flat")
    return h.select(
        month_key_from_index(C("last_idx") + C("step")).alias("month"),
        rnd(F.greatest(pred, F.lit(0.0)), 2).alias("predicted_gbp"),
        rnd(C("slope"), 2).alias("monthly_slope_gbp"), rnd(C("intercept"), 2).alias("intercept_gbp"),
        month_key_from_index(C("last_idx")).alias("last_actual_month"),
        money(C("last_rev")).alias("last_actual_revenue_gbp"),
        rnd(div(C("sy"), C("n")), 2).alias("historical_avg_monthly_gbp"),
        trend.alias("trend"), C("outlier_months"))


def linear_trend(sales: DataFrame) -> DataFrame:
    """One row: the linear forecast's trend word ('upward'/'downward'/'flat'), or
    'insufficient data' with fewer than three revenue months.

    Only the slope's sign is needed, so this is the least-squares sums alone (one
    aggregate over the month series), without the forecast's median and outliers.
    """
    return linear_trend_of(_monthly_pos(sales))


def linear_trend_of(per_month: DataFrame) -> DataFrame:
    """``linear_trend`` from monthly sales revenue (month_idx, rev)."""
    m = per_month.filter(C("rev") > 0)
    m = m.withColumn("x", (F.row_number().over(Window.orderBy("month_idx")) - 1).cast("bigint"))
    st = m.agg(F.count(F.lit(1)).alias("n"), F.sum("rev").alias("sy"), F.sum(C("x") * C("rev")).alias("sxy"))
    sx, sxx = index_sums(C("n"))
    slope = ols_slope(C("n"), sx, C("sy"), sxx, C("sxy"))
    word = (F.when(C("n") < 3, "insufficient data").when(slope > 0, "upward").when(slope < 0, "downward")
            .otherwise("flat"))
    return st.select(word.alias("forecast_trend"))


# ── calendar ─────────────────────────────────────────────────────────────────

def easter_sunday(year: Column) -> Column:
    """Gregorian Easter Sunday (anonymous Gregorian algorithm) as a DATE."""
    y = year
    a, b, c = y % 19, F.floor(y / 100), y % 100
    d, e = F.floor(b / 4), b % 4
    f = F.floor((b + 8) / 25)
    g = F.floor((b - f + 1) / 3)
    h = (a * 19 + b - d - g + 15) % 30
    i, k = F.floor(c / 4), c % 4
    l_ = (F.lit(32) + e * 2 + i * 2 - h - k) % 7
    m = F.floor((a + h * 11 + l_ * 22) / 451)
    t = h + l_ - m * 7 + 114
    return F.make_date(y.cast("int"), F.floor(t / 31).cast("int"), (t % 31 + 1).cast("int"))


def is_uk_bank_holiday(d: Column) -> Column:
    """England & Wales bank holidays by rule, with weekend substitute days."""
    y, mo, dm, wd = F.year(d), F.month(d), F.dayofmonth(d), F.weekday(d)  # weekday: Monday = 0
    easter = easter_sunday(y)
    mon = wd == 0
    new_year = ((mo == 1) & (dm == 1) & (wd < 5)) | ((mo == 1) & mon & ((dm == 2) | (dm == 3)))
    good_fri = d == F.date_sub(easter, 2)
    easter_mon = d == F.date_add(easter, 1)
    early_may = (mo == 5) & mon & (dm <= 7)
    spring = (mo == 5) & mon & (dm >= 25)
    summer = (mo == 8) & mon & (dm >= 25)
    xmas = (mo == 12) & (((dm == 25) & (wd < 5)) | ((dm == 26) & (wd < 5)) |
                         ((dm == 27) & ((wd == 0) | (wd == 1))) | ((dm == 28) & ((wd == 0) | (wd == 1))))
    return new_year | good_fri | easter_mon | early_may | spring | summer | xmas


# ── seasonal model ───────────────────────────────────────────────────────────

CYCLES = ((7.0, 3), (30.5, 5), (365.25, 10))    # period in days, Fourier order
SEASONAL, SLOPE, CHANGE = 0.3, 5.0, 0.15        # prior scales: cycles and holidays, slope, its changes
PATHS = 1000                                    # simulated futures
MODEL = "log-linear seasonal, sparse trend changes"

_FORECAST = ("month string, predicted_gbp double, lower_bound_gbp double, upper_bound_gbp double, "
             "is_partial_month boolean, trend string, training_start date, training_end date, training_days int, "
             "last_months array<struct<month: string, fitted_gbp: double>>, model string")
_BACKTEST = ("series string, training_end date, month string, days int, actual_gbp double, predicted_gbp double, "
             "lower_bound_gbp double, upper_bound_gbp double, is_covered boolean")


def sparse_descent(gram: np.ndarray, c: np.ndarray, weight: float, start: np.ndarray) -> np.ndarray:
    """The x with the least x'Gx / 2 - c'x + weight * sum |x|, by coordinate descent. Neighbouring
    changes of slope look alike, which makes it slow alone: now and then all that are not 0 go
    towards their joint optimum, as far as none changes its sign."""
    x, scale = start.copy(), np.diag(gram)
    usable = np.flatnonzero(scale > 1e-12)
    for turn in range(1, 2001):
        rest = c - gram @ x
        moved = 0.0
        for j in usable:
            r = rest[j] + scale[j] * x[j]
            new = np.sign(r) * max(abs(r) - weight, 0.0) / scale[j]
            if new != x[j]:
                rest -= gram[:, j] * (new - x[j])
                moved = max(moved, scale[j] * abs(new - x[j]))
                x[j] = new
        if moved <= 1e-9 * weight:
            break
        if turn % 5 == 0:
            on = np.flatnonzero(x)
            step = np.linalg.lstsq(gram[np.ix_(on, on)], c[on] - weight * np.sign(x[on]), rcond=None)[0] - x[on]
            against = np.flatnonzero(step * np.sign(x[on]) < 0)
            reach = -x[on][against] / step[against]
            far = min(1.0, reach.min(initial=1.0))
            x[on] += far * step
            if far < 1.0:
                x[on[against[reach.argmin()]]] = 0.0
    return x


class Seasonal:
    """The model of one series, from its days with revenue (days since 1970, sorted)."""

    def __init__(self, day: np.ndarray, y: np.ndarray, holidays: np.ndarray, changepoints: int):
        self.first, self.last, self.holidays = int(day[0]), int(day[-1]), holidays
        self.span = max(self.last - self.first, 1)
        self.at = 0.8 * np.arange(1, changepoints + 1) / (changepoints + 1)
        smooth, hinges = self.columns(day)
        ly = np.log(y)
        x = np.hstack([smooth, hinges])
        gram, c, n, k = x.T @ x, x.T @ ly, len(ly), smooth.shape[1]
        prior = np.full(k, SEASONAL)
        prior[:2] = np.inf, SLOPE
        self.changes, variance = np.zeros(changepoints), max(float(ly.var()), 1e-6)
        for _ in range(10):      # the residual variance and the coefficients in turn
            inner = gram[:k, :k] + np.diag(variance / prior ** 2)
            solved = np.linalg.solve(inner, np.column_stack([gram[:k, k:], c[:k]]))
            left = gram[k:, k:] - gram[k:, :k] @ solved[:, :-1]
            self.changes = sparse_descent(left, c[k:] - gram[k:, :k] @ solved[:, -1], variance / CHANGE, self.changes)
            self.smooth = solved[:, -1] - solved[:, :-1] @ self.changes
            self.residuals = ly - smooth @ self.smooth - hinges @ self.changes
            before, variance = variance, max(float(np.mean(self.residuals ** 2)), 1e-6)
            if abs(variance - before) <= 1e-6 * before:
                break
        values, axes = np.linalg.eigh(inner)
        self.spread = axes * np.sqrt(variance / np.maximum(values, 1e-12 * values[-1]))     # of the coefficients
        self.mean_noise = float(np.mean(np.exp(self.residuals)))
        every = np.bincount((np.arange(self.first, self.last + 1) + 3) % 7, minlength=7)
        self.open = np.bincount((day + 3) % 7, minlength=7) / np.maximum(every, 1)      # by weekday

    def columns(self, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        passed = (day - self.first).astype(float)
        t = passed / self.span
        smooth = [np.ones(len(day)), t]
        for period, order in CYCLES:
            for k in range(1, order + 1):
                smooth += [np.sin(2 * np.pi * k * passed / period), np.cos(2 * np.pi * k * passed / period)]
        smooth.append(np.isin(day, self.holidays).astype(float))
        return np.column_stack(smooth), np.maximum(t[:, None] - self.at, 0.0)

    def expected(self, day: np.ndarray) -> np.ndarray:
        smooth, hinges = self.columns(day)
        return np.exp(smooth @ self.smooth + hinges @ self.changes) * self.mean_noise * self.open[(day + 3) % 7]

    def futures(self, day: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Simulated revenue, a row for each path, of days that follow the last one."""
        smooth, hinges = self.columns(day)
        size = (PATHS, len(day))
        coefficients = self.smooth + rng.standard_normal((PATHS, len(self.smooth))) @ self.spread.T
        turn = rng.random(size) < len(self.at) / self.span
        slope = np.cumsum(turn * rng.laplace(0.0, np.mean(np.abs(self.changes)) + 1e-12, size), axis=1) / self.span
        drift = np.cumsum(slope, axis=1) - slope       # a change acts from the day after
        log = coefficients @ smooth.T + hinges @ self.changes + drift + rng.choice(self.residuals, size)
        return np.exp(np.minimum(log, 700.0)) * (rng.random(size) < self.open[(day + 3) % 7])


def _months(day: np.ndarray) -> np.ndarray:
    return day.astype("datetime64[D]").astype("datetime64[M]")


def _dates(*days: int) -> list:
    return [np.datetime64(int(d), "D").item() for d in days]


def _trend(first: float, last: float, least: float) -> str:
    return "upward" if last - first > least else "downward" if last - first < -least else "flat"


def _next_months(name: str, day, y, holidays, horizon: int, changepoints: int) -> pd.DataFrame:
    """Month, its first day and number of days, prediction and band, from the day after the last."""
    model = Seasonal(day, y, holidays, changepoints)
    ahead = np.arange(model.last + 1, model.last + 1 + horizon * 31)
    month, at = np.unique(_months(ahead), return_inverse=True)
    in_month = (at[:, None] == np.arange(len(month))).astype(float)
    sums = model.futures(ahead, np.random.default_rng(zlib.crc32(name.encode()))) @ in_month
    mean = model.expected(ahead) @ in_month
    low, high = np.quantile(sums, [0.025, 0.975], axis=0)
    out = pd.DataFrame({"month": month.astype(str), "first": [int(ahead[at == i][0]) for i in range(len(month))],
                        "days": np.bincount(at), "predicted": mean, "low": np.minimum(low, mean),
                        "high": np.maximum(high, mean)}).head(horizon)
    past = np.arange(model.first, model.last + 1)
    fitted = pd.Series(model.expected(past)).groupby(_months(past).astype(str)).sum().tail(3)
    out.attrs["fitted"] = fitted
    return out


def _straight_months(day, y, horizon: int) -> pd.DataFrame | None:
    """The linear model: least squares over months with revenue; None below three months."""
    rev = pd.Series(y).groupby(_months(day).astype("int64")).sum()
    if len(rev) < 3:      # no day with revenue included
        return None
    slope, level = np.polyfit(np.arange(len(rev)), rev.to_numpy(), 1)
    after = np.arange(1, horizon + 1)
    month = (int(rev.index[-1]) + after).astype("datetime64[M]")
    out = pd.DataFrame({"month": month.astype(str), "first": month.astype("datetime64[D]").astype("int64"),
                        "predicted": np.maximum(level + slope * (len(rev) - 1 + after), 0.0),
                        "low": np.nan, "high": np.nan})
    out.attrs["slope"] = slope
    fitted = pd.Series(level + slope * np.arange(len(rev)), index=rev.index.to_numpy().astype("datetime64[M]").astype(str))
    out.attrs["fitted"] = fitted.tail(3)
    return out


def _series_days(sales: DataFrame, key: Column, beyond: int) -> DataFrame:
    """(series, day, y): a row for each day with revenue, day as days since 1970, and one with
    y null for each bank holiday from a series' first day to ``beyond`` days after its last."""
    lines = (sales.filter(is_sale() & C(S.INVOICE_DATE).isNotNull() & key.isNotNull())
             .select(key.cast("string").alias("series"), F.to_date(S.INVOICE_DATE).alias("day"), S.REVENUE))
    daily = lines.groupBy("series", "day").agg(F.sum(S.REVENUE).cast("double").alias("y")).filter(C("y") > 0)
    span = lines.groupBy("series").agg(F.min("day").alias("first"), F.date_add(F.max("day"), beyond).alias("end"))
    off = F.filter(F.sequence("first", "end"), is_uk_bank_holiday)
    holidays = span.select("series", F.explode(off).alias("day"), F.lit(None).cast("double").alias("y"))
    return daily.unionByName(holidays).select("series", F.unix_date("day").alias("day"), "y")


def _split(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    day, y = pdf["day"].to_numpy("int64"), pdf["y"].to_numpy("float64")
    sold = np.flatnonzero(~np.isnan(y))
    sold = sold[np.argsort(day[sold])]
    return day[sold], y[sold], day[np.isnan(y)]


def _forecast(sales: DataFrame, key: Column, horizon: int, min_days: int, changepoints: int) -> DataFrame:
    horizon = positive(horizon, "horizon")

    def fit(pdf):
        name = pdf["series"].iloc[0]
        day, y, holidays = _split(pdf)
        seasonal = len(day) >= max(min_days, 1)
        got = (_next_months(name, day, y, holidays, horizon, changepoints) if seasonal
               else _straight_months(day, y, horizon))
        if got is None:
            return pd.DataFrame()
        if seasonal:
            p = got["predicted"].to_numpy()
            trend = _trend(p[0], p[-1], 500.0) if len(p) > 1 else "insufficient data"
        else:
            trend = _trend(0.0, got.attrs["slope"], 0.0)
        start, end = _dates(day[0], day[-1])
        last = [{"month": m, "fitted_gbp": round(float(v), 2)} for m, v in got.attrs["fitted"].items()]
        return pd.DataFrame({
            "series": name, "month": got["month"], "predicted_gbp": got["predicted"].round(2),
            "lower_bound_gbp": got["low"].round(2), "upper_bound_gbp": got["high"].round(2),
            "is_partial_month": [d.day != 1 for d in _dates(*got["first"])], "trend": trend,
            "training_start": start, "training_end": end, "training_days": len(day),
            "last_months": [last] * len(got), "model": MODEL if seasonal else "linear"})

    rows = _series_days(sales, key, horizon * 31)
    out = rows.groupBy("series").applyInPandas(fit, "series string, " + _FORECAST)
    return out.withColumns({c: F.nullif(C(c), F.lit(float("nan"))) for c in ("lower_bound_gbp", "upper_bound_gbp")})


def revenue_forecast(sales: DataFrame, horizon: int = 3, min_days: int = 30, changepoints: int = 25) -> DataFrame:
    """Monthly forecast with a 95 % band, the trend over it (last month against first, ± £500),
    the training span and the fitted revenue of the last three months.

    The first month starts the day after the last observed day and may be partial
    (``is_partial_month``). With fewer than ``min_days`` days of revenue it is the straight line
    over months of ``revenue_forecast_linear`` (bounds null), as in the source; none below three
    months. An empty table gives no row."""
    return _forecast(sales, F.lit("all"), horizon, min_days, changepoints).drop("series")


def revenue_forecast_by_series(sales: DataFrame, key: str, horizon: int = 3, min_days: int = 30,
                               changepoints: int = 25) -> DataFrame:
    """``revenue_forecast`` for every non-null value of ``key`` (e.g. country or product), in one job."""
    return _forecast(sales, C(key), horizon, min_days, changepoints)


def forecast_backtest(sales: DataFrame, key: str | None = None, horizon: int = 1, folds: int = 6, min_days: int = 30,
                      changepoints: int = 25) -> DataFrame:
    """What the forecast would have said ``1 .. folds`` times ``horizon`` months (of 31 days)
    before each series' last day, against what came: a row for each series, training end and
    month, the revenue of the month's forecast days and whether the band covers it. Training
    spans with fewer than ``min_days`` days of revenue give no rows."""
    horizon, folds = positive(horizon, "horizon"), positive(folds, "folds")

    def test(pdf):
        name = pdf["series"].iloc[0]
        day, y, holidays = _split(pdf)
        out = []
        for fold in range(folds, 0, -1):
            known = day <= day.max(initial=0) - fold * horizon * 31
            if known.sum() < max(min_days, 1):
                continue
            got = _next_months(name, day[known], y[known], holidays, horizon, changepoints)
            for m, first, days, p, lo, hi in got[["month", "first", "days", "predicted", "low", "high"]].itertuples(index=False):
                actual = float(y[(day >= first) & (day < first + days)].sum())
                out.append((name, *_dates(day[known][-1]), m, days, round(actual, 2), round(p, 2), round(lo, 2),
                            round(hi, 2), bool(lo <= actual <= hi)))
        return pd.DataFrame(out, columns=[f.split(" ")[0] for f in _BACKTEST.split(", ")])

    rows = _series_days(sales, F.lit("all") if key is None else C(key), 0)
    return rows.groupBy("series").applyInPandas(test, _BACKTEST)
