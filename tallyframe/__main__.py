"""Command line: list, run or explain registered questions, or run SQL on the views.

  python -m tallyframe list
  python -m tallyframe run <query> [--sf DIR] [--limit N] [--out PATH --format parquet|csv|json]
  python -m tallyframe explain <query> [--sf DIR]
  python -m tallyframe sql "SELECT country, SUM(revenue) FROM sales GROUP BY 1" [--sf DIR]
"""

from __future__ import annotations

import argparse
import os
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tallyframe")
    ap.add_argument("command", choices=["list", "run", "explain", "sql"])
    ap.add_argument("target", nargs="?")
    ap.add_argument("--sf", default=os.environ.get("TALLY_SF_DIR", "/root/testdata/sf0.01"))
    ap.add_argument("--master", default=None)
    ap.add_argument("--limit", type=int, default=20)
    ap.add_argument("--out", default=None)
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    a = ap.parse_args(argv)

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from tallyframe.plans import registry
    if a.command == "list":
        registry.load()
        for name, (_, sql) in sorted(registry.REGISTRY.items()):
            print(f"{name}\t{'sql' if sql else 'rows'}")
        return 0
    from tallyframe.session import build_session
    from tallyframe.sources import catalog
    spark = build_session(a.master)
    if a.command == "sql":
        catalog.register_views(spark, a.sf)
        df = spark.sql(a.target)
    else:
        df = registry.queries()[a.target](spark, a.sf)
    if a.command == "explain":
        df.explain("formatted")
    elif a.out:
        df.write.mode("overwrite").format(a.format).option("header", True).save(a.out)
    else:
        df.show(a.limit, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
