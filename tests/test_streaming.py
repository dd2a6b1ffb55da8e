"""The event-log stream keeps a running summary across newly arriving files."""

from __future__ import annotations

import json
import os
import tempfile

from tallyframe.streaming import eventlog as st


def _drop(folder, name, recs):
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs))


def test_running_strategy_counts(spark):
    d = tempfile.mkdtemp(prefix="tally-stream-")
    _drop(d, "1.json", [{"id": "1", "event": "strategy_generated", "timestamp": "2026-01-01T00:00:00Z",
                         "email": "a@x", "goal_label": "grow", "business_type": "shop"}])
    q = st.start_summary(spark, d, query_name="strategy_counts_test")
    try:
        q.processAllAvailable()
        _drop(d, "2.json", [{"id": "2", "event": "strategy_generated", "timestamp": "2026-01-02T00:00:00Z",
                             "email": "b@x", "goal_label": "grow", "business_type": "shop"},
                            {"id": "3", "event": "profile_submitted", "timestamp": "2026-01-02T00:00:00Z"}])
        q.processAllAvailable()
        rows = spark.sql("SELECT * FROM strategy_counts_test").collect()
        assert [(r["goal_label"], r["business_type"], r["strategies"]) for r in rows] == [("grow", "shop", 2)]
    finally:
        q.stop()


def test_daily_events_with_watermark(spark):
    d = tempfile.mkdtemp(prefix="tally-stream-wm-")
    _drop(d, "1.json", [{"id": str(i), "event": "strategy_generated", "timestamp": f"2026-01-0{1 + i % 3}T10:00:00Z"}
                        for i in range(6)])
    q = (st.daily_events_stream(st.event_stream(spark, d)).writeStream.outputMode("update").format("memory")
         .queryName("daily_events_test").start())
    try:
        q.processAllAvailable()
        rows = spark.sql("SELECT window.start AS s, events FROM daily_events_test").collect()
        assert sum(r["events"] for r in rows) == 6 and len({r["s"] for r in rows}) == 3
    finally:
        q.stop()


def test_appended_stream_holds_each_record_once(spark):
    from tallyframe.sources.eventlog import append_events, read_event_log
    d, out = tempfile.mkdtemp(prefix="tally-stream-in-"), tempfile.mkdtemp(prefix="tally-stream-out-")
    _drop(d, "1.json", [{"id": str(i), "event": "strategy_generated"} for i in range(5)])
    for _ in range(2):      # started twice: the second start takes the new file only
        st.start_append(st.event_stream(spark, d), out, "append_test", trigger_once=True).awaitTermination()
        _drop(d, "2.json", [{"id": "5", "event": "profile_submitted"}])
    append_events(read_event_log(spark, d).filter("id < '5'"), out, "append_test-0")     # the first batch, repeated
    assert sorted(r["id"] for r in read_event_log(spark, out).collect()) == [str(i) for i in range(6)]


def test_running_summary_counts_emails_exactly(spark):
    """Emails that come again in later files or under other goals count once; the totals are
    those of the batch summary over all files."""
    from tallyframe.sources.eventlog import read_event_log, strategy_log_summary
    d = tempfile.mkdtemp(prefix="tally-stream-emails-")

    def file(name, ids):
        _drop(d, name, [{"id": str(i), "event": "strategy_generated", "email": f"u{i % 50}@x" if i % 7 else "",
                         "goal_label": "grow" if i % 3 else "save", "business_type": f"b{i % 2}" if i % 5 else None} for i in ids])

    file("1.json", range(120))
    q = st.start_summary(spark, d, query_name="strategy_exact_test", counts=st.strategy_state_stream)
    try:
        q.processAllAvailable()
        file("2.json", range(100, 230))
        q.processAllAvailable()
        state = spark.table("strategy_exact_test")
        want = strategy_log_summary(read_event_log(spark, d)).first()
        assert tuple(st.strategy_totals(state).first()) == tuple(want) and want["total_strategies"] == 250
        assert want["unique_emails"] == 50
        counts = {(r[0], r[1]): (r[2], r[3]) for r in st.strategy_counts(state).collect()}
        ids = [i for i in [*range(120), *range(100, 230)] if i % 3 and not i % 5]
        assert counts["grow", ""] == (len(ids), len({i % 50 for i in ids if i % 7}))
    finally:
        q.stop()
    assert tuple(st.strategy_totals(state.limit(0)).first()) == (0, 0, "\u2014", "\u2014")
