"""Text checks on hand-written answers and messages."""

from __future__ import annotations

from tallyframe.operators import text as tx

CRISIS = ("## Your business is facing a serious problem\nSales fell by nearly three-quarters. About £4,000 is at stake.\n"
          "## Before I can advise you, I need to understand what happened\nDid your website go down this week?")
HEALTHY = ("## What's happening in your business right now\nAbout 1 in 3 customers came back, worth £2,000.\n"
           "## Your Action Plan\n### 1. Win-Back Campaign\nCall them by Friday.\n## What to do this week\nToday: email.")
JARGON = "Your MoM growth shows strong support for the product. Use a Bundle Pricing Strategy and 20% off."


def test_response_quality_and_score(spark):
    df = spark.createDataFrame([(1, 1, CRISIS), (2, 1, HEALTHY), (3, 1, JARGON)], "conv_id long, turn long, text string")
    q = {r["conv_id"]: r for r in tx.response_quality(df).collect()}
    assert q[1]["mode"] == "CRISIS" and q[2]["mode"] == "HEALTHY" and q[3]["mode"] == "UNKNOWN"
    assert q[3]["jargon"] == "MoM, support" and q[3]["jargon_found"]
    assert q[2]["lever_present"] and q[2]["has_pound"] and q[2]["has_time_component"] and q[2]["has_human_pct"]
    assert q[2]["word_count"] == len(HEALTHY.split())
    sc = {r["conv_id"]: r["score"] for r in tx.response_score(tx.response_quality(df)).collect()}
    assert sc[3] == 1 and sc[2] == 5
    fmt = {r["conv_id"]: r for r in tx.response_format(df).collect()}
    assert fmt[1]["has_required_headings"] and fmt[1]["crisis_no_action_plan"] and fmt[1]["crisis_no_marketing"]
    assert fmt[2]["has_required_headings"] and fmt[3]["has_bare_percent"]
    ev = tx.evaluation_summary(tx.response_score(tx.response_quality(df))).first()
    assert ev["scored"] == 3 and ev["total"] == sum(sc.values()) and ev["low_scores"] == 1


def test_word_count_unicode_whitespace(spark):
    t = "un deux  trois\nquatre cinq "
    df = spark.createDataFrame([(t,)], "text string")
    assert df.select(tx.word_count(df.text).alias("n")).first()["n"] == len(t.split()) == 5


def test_message_type_precedence(spark):
    rows = [(1, 0, "user", "What is my revenue?"), (1, 1, "assistant", "..."),
            (1, 2, "user", "That won't work, I have no budget for ads at all"),
            (2, 0, "user", "I can't send emails to anyone because I lack a list"),
            (3, 0, "user", "I want to grow my sales by a fifth this year"), (4, 0, "user", "help"),
            (5, 0, "user", "The shop opened in March and we sell handmade candles online mostly")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["message_type"] for r in tx.message_type(df).collect()}
    assert got == {(1, 0): "question", (1, 2): "constraint", (2, 0): "other", (3, 0): "goal", (4, 0): "vague",
                   (5, 0): "other"}


def test_questions_without_an_answer_score_zero(spark):
    from tallyframe.operators import text as tx
    talk = spark.createDataFrame(
        [(1, 0, "user", "how are sales?"), (1, 1, "assistant", "You earned \u00a3500 this week."), (1, 2, "user", "and now?"),
         (2, 0, "user", "hello"), (2, 1, "assistant", "  "), (3, 0, "user", "x"), (3, 1, "user", "y"), (3, 2, "assistant", "z"),
         (4, 0, "user", "u"), (4, 1, "assistant", None)], "conv_id int, turn int, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["score"], r["server_error"]) for r in tx.question_scores(talk).collect()}
    assert {k for k, v in got.items() if v == (0, True)} == {(1, 2), (2, 0), (3, 0), (4, 0)}
    assert got[1, 0][0] > 0 and got[3, 1][0] > 0 and len(got) == 6
    assert tx.evaluation_summary(tx.question_scores(talk)).first()["zero_scores"] == 4
    assert tx.question_scores(talk.limit(0)).count() == 0
