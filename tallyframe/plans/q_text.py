"""Registered text / log checks over the ``conversations`` table, with their SQL."""

from __future__ import annotations

from tallyframe.operators import text as tx
from tallyframe.plans.registry import register
from tallyframe.sources import catalog


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(xs) -> str:
    return "[" + ", ".join(lit(x) for x in xs) + "]"


WC = f"len(list_filter(regexp_split_to_array(text, {lit(tx.WHITESPACE)}), lambda x: x <> ''))"
MODE = (f"CASE WHEN " + " OR ".join(f"contains(text, {lit(m)})" for m in tx.CRISIS_MARKERS) + " THEN 'CRISIS' "
        f"WHEN contains(text, {lit(tx.WARNING_MARKER)}) THEN 'WARNING' "
        f"WHEN contains(text, {lit(tx.HEALTHY_MARKER)}) THEN 'HEALTHY' ELSE 'UNKNOWN' END")
JARGON = (f"list_concat(list_filter({arr(tx.BANNED_TERMS)}, lambda t: instr(text, t) > 0), "
          f"list_transform(list_filter({arr(tx.BANNED_TERMS_BOUNDARY)}, lambda t: instr(text, t) > 0), lambda t: trim(t)))")
TEAM = f"list_filter({arr([x.lower() for x in tx.TEAM_REFS])}, lambda x: instr(lower(text), x) > 0)"
LEVER = f"len(list_filter({arr(tx.STRATEGIC_LEVERS)}, lambda x: instr(text, x) > 0)) > 0"

QUALITY_CTE = (
    "q AS (SELECT conv_id, turn, array_to_string(j, ', ') AS jargon, len(j) > 0 AS jargon_found, lever_present, "
    "array_to_string(tm, ', ') AS team_refs, has_pound, has_time_component, has_human_pct, word_count, mode, "
    "COALESCE(word_count <= CASE WHEN mode = 'WARNING' THEN 900 WHEN mode = 'HEALTHY' THEN 600 END, true) AS word_ok "
    f"FROM (SELECT conv_id, turn, {JARGON} AS j, {LEVER} AS lever_present, {TEAM} AS tm, contains(text, '£') AS has_pound, "
    f"regexp_matches(text, {lit(tx.TIME_PATTERN)}, 'i') AS has_time_component, "
    f"regexp_matches(text, {lit(tx.HUMAN_PCT_PATTERN)}) AS has_human_pct, {WC} AS word_count, {MODE} AS mode "
    "FROM conversations WHERE role = 'assistant'))")
PASSED = " + ".join(f"CAST({c} AS INTEGER)" for c in
                    ["lever_present", "team_refs = ''", "has_pound", "has_time_component", "has_human_pct", "word_ok"])
SCORE_CTE = (
    f"sc AS (SELECT conv_id, turn, mode, {PASSED} AS checks_passed, 6 AS checks_total, CASE WHEN jargon_found THEN 1 "
    f"WHEN CAST({PASSED} AS DOUBLE) / 6.0 >= 0.90 THEN 5 WHEN CAST({PASSED} AS DOUBLE) / 6.0 >= 0.75 THEN 4 "
    f"WHEN CAST({PASSED} AS DOUBLE) / 6.0 >= 0.50 THEN 3 WHEN CAST({PASSED} AS DOUBLE) / 6.0 >= 0.25 THEN 2 ELSE 1 END AS score FROM q)")


def _assistant(spark, sf):
    return catalog.table(spark, sf, "conversations").filter("role = 'assistant'")


@register("response_quality", "WITH " + QUALITY_CTE + " SELECT * FROM q")
def _response_quality(spark, sf):
    return tx.response_quality(_assistant(spark, sf))


@register("response_score", "WITH " + QUALITY_CTE + ", " + SCORE_CTE + " SELECT * FROM sc")
def _response_score(spark, sf):
    return tx.response_score(tx.response_quality(_assistant(spark, sf)))


def _headings_sql() -> str:
    parts = []
    for m, hs in tx.REQUIRED_HEADINGS.items():
        parts.append(f"WHEN mode = '{m}' THEN " + " AND ".join(f"contains(text, {lit(h)})" for h in hs))
    return "CASE WHEN mode = 'UNKNOWN' THEN false " + " ".join(parts) + " ELSE true END"


@register("response_format", (
    "SELECT conv_id, turn, mode, word_count, word_limit, COALESCE(word_count <= word_limit, true) AS within_limit, "
    f"regexp_matches(text, {lit(tx.BARE_PERCENT_PATTERN)}) AS has_bare_percent, {_headings_sql()} AS has_required_headings, "
    f"CASE WHEN mode = 'CRISIS' THEN NOT contains(text, {lit(tx.CRISIS_ACTION_HEADING)}) END AS crisis_no_action_plan, "
    "CASE WHEN mode = 'CRISIS' THEN NOT (" + " OR ".join(f"contains(lower(text), {lit(p)})" for p in tx.CRISIS_PROHIBITED)
    + ") END AS crisis_no_marketing FROM (SELECT conv_id, turn, text, "
    f"{MODE} AS mode, {WC} AS word_count, CASE WHEN {MODE} = 'WARNING' THEN 900 WHEN {MODE} = 'HEALTHY' THEN 600 END "
    "AS word_limit FROM conversations WHERE role = 'assistant')"))
def _response_format(spark, sf):
    return tx.response_format(_assistant(spark, sf))


def _msg_sql() -> str:
    low = "lower(c.text)"
    stripped = f"trim({low})"
    cons = " OR ".join(f"contains({low}, {lit(p)})" for p in tx.CONSTRAINT_PHRASES)
    cons = f"(({cons}) OR regexp_matches({low}, {lit(tx.CONSTRAINT_PATTERN)})) AND COALESCE(c.turn > fa.fa, false)"
    ques = "contains(c.text, '?') OR " + " OR ".join(f"starts_with({stripped}, {lit(o)})" for o in tx.QUESTION_OPENERS)
    goal = " OR ".join(f"contains({low}, {lit(g)})" for g in tx.GOAL_PHRASES)
    wc = WC.replace("(text,", "(c.text,")
    vague = (f"{wc} < 6 OR {stripped} IN ({', '.join(lit(v) for v in tx.VAGUE_PHRASES)}) OR "
             + " OR ".join(f"contains({low}, {lit(v)})" for v in tx.VAGUE_PHRASES[1:]))
    return (f"WITH fa AS (SELECT conv_id, MIN(turn) AS fa FROM conversations WHERE role = 'assistant' GROUP BY 1) "
            f"SELECT c.conv_id, c.turn, {wc} AS word_count, CASE WHEN {cons} THEN 'constraint' WHEN {ques} THEN 'question' "
            f"WHEN {goal} THEN 'goal' WHEN {vague} THEN 'vague' ELSE 'other' END AS message_type "
            "FROM conversations c LEFT JOIN fa USING (conv_id) WHERE c.role = 'user'")


@register("message_type", _msg_sql())
def _message_type(spark, sf):
    return tx.message_type(catalog.table(spark, sf, "conversations"))


@register("evaluation_summary", (
    "WITH " + QUALITY_CTE + ", " + SCORE_CTE + " SELECT COUNT(score) AS scored, CAST(COALESCE(SUM(score), 0) AS BIGINT) AS total, "
    "COUNT(score) * 5 AS max_total, ROUND(COALESCE(CAST(SUM(score) AS DOUBLE) * 100.0 / CAST(COUNT(score) * 5 AS DOUBLE), 0.0), 1) AS pct, "
    "COALESCE(CAST(SUM(score) AS DOUBLE) * 100.0 / CAST(COUNT(score) * 5 AS DOUBLE), 0.0) >= 75.0 AS passed, "
    "COUNT(*) FILTER (WHERE score = 0) AS zero_scores, COUNT(*) FILTER (WHERE score <= 2) AS low_scores FROM sc"))
def _evaluation_summary(spark, sf):
    return tx.evaluation_summary(tx.response_score(tx.response_quality(_assistant(spark, sf))))


# Every user turn; one whose next turn holds no answer scores 0.
QUESTION_CTE = (
    "qs AS (SELECT u.conv_id, u.turn, COALESCE(a.score, 0) AS score, a.score IS NULL AS server_error FROM "
    "(SELECT conv_id, turn FROM conversations WHERE role = 'user') u LEFT JOIN (SELECT sc.conv_id, sc.turn, sc.score FROM sc "
    "JOIN conversations c ON c.conv_id = sc.conv_id AND c.turn = sc.turn WHERE c.role = 'assistant' AND trim(c.text) <> '') a "
    "ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)")


@register("question_scores", "WITH " + ", ".join([QUALITY_CTE, SCORE_CTE, QUESTION_CTE]) + " SELECT * FROM qs")
def _question_scores(spark, sf):
    return tx.question_scores(catalog.table(spark, sf, "conversations"))


@register("evaluation_by_question", (
    "WITH " + ", ".join([QUALITY_CTE, SCORE_CTE, QUESTION_CTE]) + " SELECT COUNT(score) AS scored, "
    "CAST(COALESCE(SUM(score), 0) AS BIGINT) AS total, COUNT(score) * 5 AS max_total, "
    "ROUND(COALESCE(CAST(SUM(score) AS DOUBLE) * 100.0 / CAST(COUNT(score) * 5 AS DOUBLE), 0.0), 1) AS pct, "
    "COALESCE(CAST(SUM(score) AS DOUBLE) * 100.0 / CAST(COUNT(score) * 5 AS DOUBLE), 0.0) >= 75.0 AS passed, "
    "COUNT(*) FILTER (WHERE score = 0) AS zero_scores, COUNT(*) FILTER (WHERE score <= 2) AS low_scores FROM qs"))
def _evaluation_by_question(spark, sf):
    return tx.evaluation_summary(tx.question_scores(catalog.table(spark, sf, "conversations")))
