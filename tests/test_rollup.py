"""The rollup: appended batches give what a rebuild gives, and what the lines themselves give."""

from __future__ import annotations

import pytest

from tallyframe.operators import health, rollup
from tallyframe.plans import dashboard as db

LINES = [(1, "A", 2, 10.0, "2020-01-05 10:00", 1, "UK"), (1, "A", 3, 10.0, "2020-02-01", 1, "UK"),
         (1, "B", 1, 5.5, "2020-01-05 10:00", 1, "UK"), (2, "A", -1, 10.0, "2020-02-10", 1, "UK"),
         (3, "C", 4, 2.25, "2020-05-02 23:59", 2, "FR"), (4, None, 1, 7.0, None, 2, "FR"), (5, "B", 6, 5.5, "2020-05-03", 3, None),
         (6, "B", 1, 5.5, "2020-05-03", None, None), (7, "D", -2, 1.0, "2020-04-03", 4, "DE"), (1, "A", 1, 9.0, "2020-03-01", 5, "FR")]


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def answers(r, hours):
    return [rows(db.dashboard_kpis_of(r)), rows(db.dashboard_charts_of(r, hours)), rows(db.prediction_metrics_of(r)),
            rows(health.signals_of(r))]


def test_appended_batches_equal_a_rebuild(spark, mk_sales, tmp_path):
    """Invoice 1 and products A and B are in several batches; the second batch is written twice."""
    whole, path = mk_sales(LINES), str(tmp_path / "r")
    for batch, part in (("a", LINES[:1]), ("b", LINES[1:6]), ("b", LINES[1:6]), ("c", LINES[6:]), ("d", [])):
        rollup.append(mk_sales(part), path, batch)
    got, want = rollup.read(spark, path), rollup.rollup(whole)
    assert rows(got.invoices) == rows(want.invoices)
    assert rows(got.products) == rows(want.products)
    assert got.invoices.dtypes == want.invoices.dtypes and got.products.dtypes == want.products.dtypes
    assert answers(got, whole) == answers(want, whole)


@pytest.mark.parametrize("lines", [LINES, LINES[:1], LINES[5:6], []])
def test_rollup_answers_equal_the_lines(mk_sales, lines):
    s = mk_sales(lines)
    r = rollup.rollup(s)
    assert rows(db.dashboard_kpis_of(r)) == rows(db.dashboard_kpis(s))
    assert rows(db.dashboard_charts_of(r, s)) == rows(db.dashboard_charts(s))
    assert rows(db.prediction_metrics_of(r)) == rows(db.prediction_metrics(s))
