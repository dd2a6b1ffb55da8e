"""Business-health signals and the rule tables applied to them (survey §2.6).

Every signal is a scalar subquery over the rollup (``operators.rollup``): its month series
(growth, trend) or its customers (churn share, repeat rate, new customers,
concentration). The rules are ``when`` chains over the one-row signals
frame. Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe import schema as S
from tallyframe.functions.cols import div, is_sale, money, months_before, rnd, sum0
from tallyframe.operators import customers as cu
from tallyframe.operators import forecast as fc
from tallyframe.operators import products as pr
from tallyframe.operators import rollup as ro
from tallyframe.operators import sales as sa

C = F.col


# Thresholds of the traffic lights and severity rules.
MOM_GREEN, MOM_YELLOW = 5.0, -5.0
CHURN_GREEN, CHURN_YELLOW = 30.0, 55.0
REPEAT_GREEN, REPEAT_YELLOW = 35.0, 20.0

# Percentage → plain-English phrase.
PERCENT_PHRASES = [
    (2, "roughly 2 in every 100"), (5, "about 1 in 20"), (10, "about 1 in 10"), (12, "about 1 in 8"),
    (15, "about 1 in 7"), (20, "1 in 5"), (25, "1 in 4"), (33, "about 1 in 3"), (40, "about 2 in 5"),
    (50, "about half"), (53, "more than half"), (60, "about 3 in 5"), (64, "nearly 2 out of every 3"),
    (69, "roughly 7 in 10"), (70, "7 in 10"), (72, "nearly three-quarters"), (75, "three-quarters"),
    (80, "4 in 5"), (90, "9 in 10"),
]


def repeat_rate(sales: DataFrame) -> Column:
    """% of customers with more than one distinct invoice, rounded to 2 (scalar)."""
    per = (sales.filter(C(S.CUSTOMER_ID).isNotNull()).select(S.CUSTOMER_ID, S.INVOICE).distinct()
           .groupBy(S.CUSTOMER_ID).agg(F.count(F.lit(1)).alias("n")))
    return per.agg(rnd(F.coalesce(div(F.count_if(C("n") > 1) * 100, F.count(F.lit(1))), F.lit(0.0)), 2)).scalar()


def new_customer_counts(sales: DataFrame, months: int = 3) -> tuple[Column, Column]:
    """Customers first seen in the last ``months`` months vs the ``months`` before."""
    dated = sales.filter(C(S.CUSTOMER_ID).isNotNull() & C(S.INVOICE_DATE).isNotNull())
    ref = dated.agg(F.max(S.INVOICE_DATE)).scalar()
    first = dated.groupBy(S.CUSTOMER_ID).agg(F.min(S.INVOICE_DATE).alias("f"))
    cut = months_before(ref, months)
    pcut = months_before(cut, months)
    recent = first.agg(F.count_if(C("f") >= cut)).scalar()
    prior = first.agg(F.count_if((C("f") >= pcut) & (C("f") < cut))).scalar()
    return recent, prior


def signals(sales: DataFrame, days: int = 90, new_months: int = 3) -> DataFrame:
    """``signals_of`` the rollup of ``sales``, made for this question alone."""
    return signals_of(ro.rollup(sales), days, new_months)


def signals_of(r: ro.Rollup, days: int = 90, new_months: int = 3) -> DataFrame:
    """One row: latest_mom, churn_risk_pct, repeat_rate, forecast_trend,
    concentration_pct, new_customers_recent, new_customers_prior.

    Growth and trend come from the rollup's month series, the customer signals from its
    customers: one conditional aggregate, and the concentration from net revenues.
    """
    spark = r.invoices.sparkSession
    per_month = ro.months(r)
    mom = sa.latest_mom_of(per_month.select("month_idx", "rev")).select("latest_mom").scalar()
    trend = fc.linear_trend_of(per_month.select("month_idx", C("sale_rev").alias("rev"))).select("forecast_trend").scalar()
    people = ro.customers(r)
    conc = sa.concentration_of(people.select(S.CUSTOMER_ID, C("revenue").alias("rev"))).select("concentration_pct").scalar()
    ref = r.invoices.agg(F.max("last")).scalar()
    ref_c = r.invoices.filter(C(S.CUSTOMER_ID).isNotNull()).agg(F.max("last")).scalar()
    cut = months_before(ref_c, new_months)
    pcut = months_before(cut, new_months)
    idle = F.floor((F.unix_micros(ref) - F.unix_micros(C("last"))) / F.lit(86_400_000_000))
    st = people.agg(F.struct(
        F.count_if(C("last").isNotNull()).alias("dated"), F.count_if(idle >= days).alias("at_risk"),
        F.count(F.lit(1)).alias("customers"), F.count_if(C("invoices") > 1).alias("repeaters"),
        F.count_if(C("first") >= cut).alias("new_recent"),
        F.count_if((C("first") >= pcut) & (C("first") < cut)).alias("new_prior"))).scalar()
    return spark.range(1).select(
        mom.alias("latest_mom"),
        F.coalesce(rnd(div(st["at_risk"] * 100, st["dated"]), 1), F.lit(0.0)).alias("churn_risk_pct"),
        rnd(F.coalesce(div(st["repeaters"] * 100, st["customers"]), F.lit(0.0)), 2).alias("repeat_rate"),
        trend.alias("forecast_trend"), F.coalesce(conc, F.lit(0.0)).alias("concentration_pct"),
        st["new_recent"].alias("new_customers_recent"), st["new_prior"].alias("new_customers_prior"))


def _light(v: Column, green: float, yellow: float, higher_is_better: bool = True) -> Column:
    if higher_is_better:
        return F.when(v >= green, "green").when(v >= yellow, "yellow").otherwise("red")
    return F.when(v <= green, "green").when(v <= yellow, "yellow").otherwise("red")


def health_preview(sig: DataFrame) -> DataFrame:
    """Three traffic lights (signal, value, display, color). Colours use the
    thresholds inclusively, the display words strictly (as in the source)."""
    mom, churn, rep = C("latest_mom"), C("churn_risk_pct"), C("repeat_rate")
    rows = F.array(
        F.struct(F.lit("mom_growth").alias("signal"), rnd(mom, 1).alias("value"),
                 F.when(mom > 5, "Growing").when(mom > -5, "Stable").otherwise("Declining").alias("display"),
                 _light(mom, MOM_GREEN, MOM_YELLOW).alias("color")),
        F.struct(F.lit("churn_risk").alias("signal"), rnd(churn, 1).alias("value"),
                 F.when(churn < 30, "Low risk").when(churn < 55, "Moderate").otherwise("High risk").alias("display"),
                 _light(churn, CHURN_GREEN, CHURN_YELLOW, False).alias("color")),
        F.struct(F.lit("repeat_rate").alias("signal"), rnd(rep, 1).alias("value"),
                 F.when(rep > 35, "Strong").when(rep > 20, "Average").otherwise("Needs work").alias("display"),
                 _light(rep, REPEAT_GREEN, REPEAT_YELLOW).alias("color")))
    return sig.select(F.inline(rows))


def business_severity(sig: DataFrame) -> DataFrame:
    """CRISIS / WARNING / HEALTHY with the first condition that fired."""
    mom, churn, rep = C("latest_mom"), C("churn_risk_pct"), C("repeat_rate")
    down = C("forecast_trend") == "downward"
    conds = [
        ("CRISIS", mom < -50, "latest_mom < -50"),
        ("CRISIS", (mom < -30) & (churn > 60), "latest_mom < -30 and churn_risk_pct > 60"),
        ("CRISIS", down & (mom < -30), "forecast downward and latest_mom < -30"),
        ("CRISIS", (rep < 15) & (mom < 0), "repeat_rate < 15 and latest_mom < 0"),
        ("WARNING", (mom >= -50) & (mom <= -15), "-50 <= latest_mom <= -15"),
        ("WARNING", churn > 40, "churn_risk_pct > 40"),
        ("WARNING", down & (mom < 0), "forecast downward and latest_mom < 0"),
        ("WARNING", rep < 25, "repeat_rate < 25"),
    ]
    mode, trig = F.lit("HEALTHY"), F.lit(None).cast("string")
    for m, c, t in reversed(conds):
        mode = F.when(c, F.lit(m)).otherwise(mode)
        trig = F.when(c, F.lit(t)).otherwise(trig)
    return sig.select("latest_mom", "churn_risk_pct", "repeat_rate", "forecast_trend",
                      mode.alias("mode"), trig.alias("trigger"))


def revenue_at_stake(sales: DataFrame, days: int = 90, top: int = 15, win_back: float = 0.30) -> DataFrame:
    """Lifetime sales spend of all at-risk customers, of the ``top`` of them, and the share of
    each that is recoverable. With no at-risk customers, falls back to average order value ×
    at-risk count."""
    spark = sales.sparkSession

    def stake(limit: int | None):
        spend = F.sum(C("total_spend_gbp").cast("decimal(38,2)")).cast("double")
        return cu.at_risk_customers(sales, days, limit, "pos").agg(F.count(F.lit(1)).alias("n"), spend.alias("s"))

    every, first = stake(None), stake(top)
    n, s = every.select("n").scalar(), every.select("s").scalar()
    top_n, top_s = first.select("n").scalar(), first.select("s").scalar()
    at_risk = cu.churn_risk_summary(sales, days).select("at_risk_customers").scalar()
    aov = sa.aov_overall(sales).select("aov").scalar()
    value = F.when(n > 0, s).otherwise(aov * at_risk)
    return spark.range(1).select(
        n.alias("customers_considered"), rnd(value, 2).alias("at_risk_revenue_gbp"),
        rnd(value * F.lit(win_back), 2).alias("recoverable_gbp"),
        top_n.alias("top_customers"), rnd(F.coalesce(top_s, F.lit(0.0)), 2).alias("top_at_risk_revenue_gbp"),
        rnd(F.coalesce(top_s, F.lit(0.0)) * F.lit(win_back), 2).alias("top_recoverable_gbp"),
        F.when(n > 0, "at_risk_spend").otherwise("aov_times_at_risk").alias("method"))


def diagnostic_triggers(sig: DataFrame, near_zero_share: float = 0.10) -> DataFrame:
    """T1..T5 booleans; T3 = new customers in the last 3 months at most 10 % of the
    3 months before (or none at all)."""
    return sig.select(
        (C("latest_mom") < -50).alias("t1_sales_collapse"),
        (C("churn_risk_pct") > 60).alias("t2_high_churn"),
        ((C("new_customers_recent") == 0) |
         (C("new_customers_recent") <= C("new_customers_prior") * F.lit(near_zero_share))).alias("t3_no_new_customers"),
        (C("repeat_rate") < 15).alias("t4_low_repeat"),
        (C("concentration_pct") > 70).alias("t5_concentration"),
        (C("concentration_pct") > 50).alias("concentration_flag"))


def promotion_gate(sales: DataFrame, months: int = 3, min_impact: float = 500.0,
                   refund_limit: float = 15.0) -> DataFrame:
    """Per product: revenue at stake (sales revenue lost from the prior to the
    recent window), line refund rate and direction → a decision:
    deprioritise (impact < £500) → ask_first (declining) → promote_with_risk_warning
    (refund rate > 15 %) → promote."""
    dated = sales.filter(C(S.INVOICE_DATE).isNotNull() & C(S.DESCRIPTION).isNotNull())
    ref = dated.agg(F.max(S.INVOICE_DATE)).scalar()
    cut = months_before(ref, months)
    pcut = months_before(cut, months)
    pos = dated.filter(is_sale())
    recent = C(S.INVOICE_DATE) >= cut
    prior = (C(S.INVOICE_DATE) >= pcut) & (C(S.INVOICE_DATE) < cut)
    win = pos.groupBy(S.DESCRIPTION).agg(
        sum0(F.when(recent, C(S.REVENUE))).alias("rr"), sum0(F.when(prior, C(S.REVENUE))).alias("pr"),
        sum0(F.when(recent, C(S.QUANTITY))).alias("ru"), sum0(F.when(prior, C(S.QUANTITY))).alias("pu"))
    refunds = pr.product_line_refund_rate(sales).select(S.DESCRIPTION, "refund_rate_pct")
    j = win.join(refunds, S.DESCRIPTION, "left")
    impact = F.greatest(C("pr") - C("rr"), F.lit(0))
    declining = C("ru") < C("pu")
    decision = (F.when(impact < F.lit(min_impact), "deprioritise").when(declining, "ask_first")
                .when(C("refund_rate_pct") > refund_limit, "promote_with_risk_warning").otherwise("promote"))
    return j.select(S.DESCRIPTION, money(impact).alias("impact_gbp"), "refund_rate_pct",
                    declining.alias("declining"), decision.alias("decision"))


def percent_phrase(v: Column) -> Column:
    """Nearest phrase by absolute difference (ties: the smaller percentage)."""
    table = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(t).alias("t")) for p, t in PERCENT_PHRASES])
    best = F.array_min(F.transform(table, lambda e: F.struct(F.abs(e["p"] - v).alias("d"), e["p"].alias("p"),
                                                            e["t"].alias("t"))))
    return F.when(v.isNotNull(), best["t"])


def signal_phrases(sig: DataFrame) -> DataFrame:
    """Each percentage signal with its plain-English phrase."""
    rows = F.array(*[F.struct(F.lit(n).alias("signal"), e.cast("double").alias("value"))
                     for n, e in (("churn_risk_pct", C("churn_risk_pct")), ("repeat_rate", C("repeat_rate")),
                                  ("latest_mom_abs", F.abs(C("latest_mom"))),
                                  ("concentration_pct", C("concentration_pct")))])
    long = sig.select(F.inline(rows))
    return long.select("signal", "value", percent_phrase(C("value")).alias("phrase"))


def model_uncertainty_flags(forecast: DataFrame, clv: DataFrame, metrics: DataFrame, cohorts: DataFrame,
                            demand: DataFrame) -> DataFrame:
    """One row of caution flags over model outputs."""
    spark = forecast.sparkSession
    wide = forecast.agg(F.max(F.coalesce(C("upper_bound_gbp") > C("lower_bound_gbp") * 2, F.lit(False)))).scalar()
    one = clv.agg(F.coalesce(div(F.count_if("insufficient_history") * 100, F.count(F.lit(1))), F.lit(0.0))).scalar()
    acc = metrics.select("accuracy").scalar()
    nco = cohorts.agg(F.count(F.lit(1))).scalar()
    ins = demand.agg(F.count_if(C("trend") == "insufficient data")).scalar()
    return spark.range(1).select(
        F.coalesce(wide, F.lit(False)).alias("wide_forecast_band"), rnd(one, 1).alias("one_order_clv_pct"),
        (acc < 70).alias("low_model_accuracy"), (nco < 3).alias("few_cohorts"),
        ins.alias("products_with_insufficient_trend"))
