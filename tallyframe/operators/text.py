"""Checks over advisory texts and chat messages (survey §2.7), as column expressions.

All checks are literal ``contains`` tests, a few regexes (``rlike``) and a word
count; they run per row inside whole-stage codegen, no Python in the hot path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.cols import rnd

C = F.col

# Terms an answer must not use (matched as given, case-sensitive).
BANNED_TERMS = [
    "MoM", "RFM", "AOV", "CLV", "SKU", "Silhouette", "Pareto", "cohort",
    "segmentation", "clustering", "churn rate %", "FP-Growth",
    "p-value", "percentile", "median", "standard deviation", "regression",
]
# Short terms matched with the surrounding spaces.
BANNED_TERMS_BOUNDARY = [" support ", " confidence ", " lift "]

# Named strategic levers (case-sensitive).
STRATEGIC_LEVERS = [
    "Cash Flow Triage", "Break-Even Analysis", "Inventory Liquidation",
    "Win-Back Campaign", "Dormant Customer Reactivation",
    "High-Value Customer Retention Sequence",
    "Price Elasticity Test", "Bundle Pricing Strategy",
    "Cross-Sell Activation", "Average Order Value Lift",
    "Star Product Doubling", "Slow Mover Clearance",
    "High-Refund Product Audit", "Revenue Concentration Reduction",
    "Customer Base Diversification", "Repeat Buyer Conversion",
    "First-Time Buyer Onboarding Sequence",
]

# References to a team the owner does not have (case-insensitive).
TEAM_REFS = [
    "your marketing team", "your sales rep", "your operations team",
    "your finance team", "your sales team", "your support team",
    "your staff", "your employees",
]

# Patterns for a time component and for "n in m" style figures.
TIME_PATTERN = (r"(by \w+day|this week|within \d+ (days?|weeks?)|by Friday|next week|"
                r"over the next|in the next \d+|this month|today)")
HUMAN_PCT_PATTERN = r"\d+ in \d+|about \d+ in|out of every \d+|1 in \d+"
BARE_PERCENT_PATTERN = r"\d+(\.\d+)?\s?%"

# The characters Python's str.split() treats as whitespace.
WHITESPACE = (r"[ \t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
              r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")

# Headings that identify the answer mode, and required per mode.
CRISIS_MARKERS = ["## Your business is facing a serious problem", "Before I can advise you"]
WARNING_MARKER = "One question before you start"
HEALTHY_MARKER = "## What's happening in your business right now"
REQUIRED_HEADINGS = {
    "CRISIS": ["## Your business is facing a serious problem",
               "## Before I can advise you, I need to understand what happened"],
    "WARNING": ["## What's happening in your business right now", "## Your Action Plan",
                "## One question before you start", "## What to do this week"],
    "HEALTHY": ["## What's happening in your business right now", "## Your Action Plan",
                "## What to do this week"],
}
WORD_LIMITS = {"WARNING": 900, "HEALTHY": 600}
# Tactics a crisis answer must not propose before the owner has answered.
CRISIS_PROHIBITED = ["discount code", "loyalty programme", "thank you email", "promotional campaign",
                     "run a campaign"]
CRISIS_ACTION_HEADING = "## Your Immediate Actions"

# Message-type signals (matched on lower-cased text).
QUESTION_OPENERS = ["what is", "how much", "can you show", "tell me", "what does", "how many", "which"]
GOAL_PHRASES = ["i want to", "i need to", "my sales have", "help me", "i'm worried about"]
VAGUE_PHRASES = ["help", "just help me", "what should i do", "i don't know", "not sure"]
CONSTRAINT_PHRASES = ["that won't work", "i can't", "i don't have", "no money", "no budget", "no time",
                      "too expensive", "not possible", "i have no staff", "i can't send emails",
                      "i don't have a mailing list"]
CONSTRAINT_PATTERN = r"i work \d+ hours"


def word_count(text: Column) -> Column:
    """Whitespace-separated tokens, as Python's ``len(text.split())``."""
    return F.coalesce(F.size(F.filter(F.split(text, WHITESPACE), lambda x: x != "")), F.lit(0)).cast("bigint")


def _found(text: Column, terms: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.instr(text, t) > 0)


def detect_mode(text: Column) -> Column:
    crisis = F.lit(False)
    for m in CRISIS_MARKERS:
        crisis = crisis | text.contains(m)
    return (F.when(crisis, "CRISIS").when(text.contains(WARNING_MARKER), "WARNING")
            .when(text.contains(HEALTHY_MARKER), "HEALTHY").otherwise("UNKNOWN"))


def response_quality(df: DataFrame, text: str = "text", keys: tuple = ("conv_id", "turn")) -> DataFrame:
    """Per response: jargon found, lever, team references, £, time component,
    'n in m' figure, word count, mode, and whether the word limit holds."""
    t = C(text)
    jargon = F.concat(_found(t, BANNED_TERMS), F.transform(_found(t, BANNED_TERMS_BOUNDARY), lambda x: F.trim(x)))
    lever = F.exists(F.array(*[F.lit(x) for x in STRATEGIC_LEVERS]), lambda x: F.instr(t, x) > 0)
    team = _found(F.lower(t), [x.lower() for x in TEAM_REFS])
    wc = word_count(t)
    mode = detect_mode(t)
    limit = F.when(mode == "WARNING", 900).when(mode == "HEALTHY", 600)
    out = df.select(
        *keys, F.array_join(jargon, ", ").alias("jargon"), (F.size(jargon) > 0).alias("jargon_found"),
        lever.alias("lever_present"), F.array_join(team, ", ").alias("team_refs"),
        t.contains("£").alias("has_pound"), t.rlike("(?i)" + TIME_PATTERN).alias("has_time_component"),
        t.rlike(HUMAN_PCT_PATTERN).alias("has_human_pct"), wc.alias("word_count"), mode.alias("mode"),
        F.coalesce(wc <= limit, F.lit(True)).alias("word_ok"))
    return out


SCORE_CHECKS = ["lever_present", "no_team_refs", "has_pound", "has_time_component", "has_human_pct", "word_ok"]


def response_score(quality: DataFrame, keys: tuple = ("conv_id", "turn")) -> DataFrame:
    """0–5: 1 on any jargon, else bands of the share of passed checks (.90/.75/.50/.25).

    ``jargon_found = False`` is not counted as a passed check (it can never be one),
    so a perfect answer scores 5.
    """
    q = quality.withColumn("no_team_refs", C("team_refs") == "")
    passed = sum((C(c).cast("int") for c in SCORE_CHECKS), F.lit(0))
    ratio = passed.cast("double") / F.lit(float(len(SCORE_CHECKS)))
    score = (F.when(C("jargon_found"), 1).when(ratio >= 0.90, 5).when(ratio >= 0.75, 4)
             .when(ratio >= 0.50, 3).when(ratio >= 0.25, 2).otherwise(1))
    return q.select(*keys, "mode", passed.alias("checks_passed"), F.lit(len(SCORE_CHECKS)).alias("checks_total"),
                    score.alias("score"))


def response_format(df: DataFrame, text: str = "text", keys: tuple = ("conv_id", "turn")) -> DataFrame:
    """Word limit by mode, bare % figures, required headings, and the crisis rules
    (no action plan and no promotional tactics before the owner has answered)."""
    t = C(text)
    mode = detect_mode(t)
    wc = word_count(t)
    limit = F.when(mode == "WARNING", 900).when(mode == "HEALTHY", 600)
    heads = F.lit(True)
    for m, hs in REQUIRED_HEADINGS.items():
        ok = F.lit(True)
        for h in hs:
            ok = ok & t.contains(h)
        heads = F.when(mode == m, ok).otherwise(heads)
    prohibited = F.lit(False)
    for p in CRISIS_PROHIBITED:
        prohibited = prohibited | F.lower(t).contains(p)
    return df.select(
        *keys, mode.alias("mode"), wc.alias("word_count"), limit.alias("word_limit"),
        F.coalesce(wc <= limit, F.lit(True)).alias("within_limit"),
        t.rlike(BARE_PERCENT_PATTERN).alias("has_bare_percent"),
        F.when(mode == "UNKNOWN", F.lit(False)).otherwise(heads).alias("has_required_headings"),
        F.when(mode == "CRISIS", ~t.contains(CRISIS_ACTION_HEADING)).alias("crisis_no_action_plan"),
        F.when(mode == "CRISIS", ~prohibited).alias("crisis_no_marketing"))


def message_type(conversations: DataFrame) -> DataFrame:
    """User messages → constraint / question / goal / vague / other.

    A constraint needs an earlier assistant turn in the same conversation; that is
    found with an aggregate (first assistant turn per conversation) joined back,
    not a window, so a very long conversation still aggregates partially.
    """
    first_asst = (conversations.filter(C("role") == "assistant").groupBy("conv_id")
                  .agg(F.min("turn").alias("_first_asst")))
    users = conversations.filter(C("role") == "user").join(first_asst, "conv_id", "left")
    low = F.lower(C("text"))
    stripped = F.trim(low)
    wc = word_count(C("text"))
    constraint = F.lit(False)
    for p in CONSTRAINT_PHRASES:
        constraint = constraint | low.contains(p)
    constraint = (constraint | low.rlike(CONSTRAINT_PATTERN)) & F.coalesce(C("turn") > C("_first_asst"), F.lit(False))
    question = C("text").contains("?")
    for o in QUESTION_OPENERS:
        question = question | stripped.startswith(o)
    goal = F.lit(False)
    for g in GOAL_PHRASES:
        goal = goal | low.contains(g)
    vague = (wc < 6) | stripped.isin(*VAGUE_PHRASES)
    for v in VAGUE_PHRASES[1:]:
        vague = vague | low.contains(v)
    kind = (F.when(constraint, "constraint").when(question, "question").when(goal, "goal")
            .when(vague, "vague").otherwise("other"))
    return users.select("conv_id", "turn", wc.alias("word_count"), kind.alias("message_type"))


def evaluation_summary(scores: DataFrame, pass_pct: float = 75.0) -> DataFrame:
    """Σ scores / (5 · n) as %, pass at ≥ 75 %, and blocker counts (0 scores)."""
    n = F.count("score")
    pct = F.coalesce(F.sum("score").cast("double") * F.lit(100.0) / (n * 5).cast("double"), F.lit(0.0))
    return scores.agg(
        n.alias("scored"), F.coalesce(F.sum("score"), F.lit(0)).cast("bigint").alias("total"),
        (n * 5).alias("max_total"), rnd(pct, 1).alias("pct"), (pct >= pass_pct).alias("passed"),
        F.count_if(C("score") == 0).alias("zero_scores"), F.count_if(C("score") <= 2).alias("low_scores"))


def question_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """The score of the answer to each user turn: 0 where the turn after it is no answer (none,
    not the assistant's, or blank), else ``response_score``. The join is on conversation and
    turn, so a long conversation spreads over the tasks."""
    answers = df.filter((C("role") == "assistant") & (F.trim(text) != ""))
    scored = response_score(response_quality(answers)).select("conv_id", (C("turn") - 1).alias("turn"), "score")
    asked = df.filter(C("role") == "user").select("conv_id", "turn")
    return asked.join(scored, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("score", F.lit(0)).alias("score"), C("score").isNull().alias("server_error"))
