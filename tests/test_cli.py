"""The command line lists and runs registered questions."""

from __future__ import annotations

from tallyframe.__main__ import main


def test_list(capsys):
    assert main(["list"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert any(line.startswith("dashboard_kpis\tsql") for line in out)
    assert any(line.startswith("churn_scores\trows") for line in out)


def test_run_and_sql(spark, capsys):
    assert main(["run", "total_orders", "--sf", "/root/testdata/sf0.001", "--limit", "1"]) == 0
    assert "total_orders" in capsys.readouterr().out
    assert main(["sql", "SELECT COUNT(*) AS n FROM sales", "--sf", "/root/testdata/sf0.001"]) == 0
    assert "| n" in capsys.readouterr().out.replace("|n", "| n")
