"""The driver's entry points with and without the text operators."""

from __future__ import annotations

import sys

import __spark_entry__ as entry


def test_queries_without_the_text_operators(monkeypatch):
    every = set(entry.queries())
    assert "pipeline" in every and set(entry.oracle_sql()) <= every
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)      # importing None raises ImportError
    assert set(entry.queries()) == every - {"pipeline"}
    monkeypatch.setitem(sys.modules, "tallyframe.llm", None)
    monkeypatch.setitem(sys.modules, "tallyframe.llm.queries", None)
    left = set(entry.queries())
    assert "total_revenue" in left and not [q for q in left if q.startswith("op") and q[2].isdigit()]
    assert set(entry.oracle_sql()) <= left
