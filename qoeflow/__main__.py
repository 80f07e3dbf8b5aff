"""Command line: list or run the registered queries.

  python -m qoeflow list
  python -m qoeflow run <query> [sf_dir] [--show N] [--explain] [--out PATH]
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="qoeflow")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="registered query names")
    run = sub.add_parser("run", help="run one query")
    run.add_argument("query")
    run.add_argument("sf_dir", nargs="?", default="/root/testdata/sf0.01")
    run.add_argument("--show", type=int, default=20, help="rows to print")
    run.add_argument("--explain", action="store_true", help="print the formatted physical plan")
    run.add_argument("--out", help="write the full result as parquet here instead of printing")
    run.add_argument("--master", default="local[*]")
    a = ap.parse_args(argv)

    from qoeflow.plans.catalog import REGISTRY
    if a.cmd == "list":
        print("\n".join(sorted(REGISTRY)))
        return 0
    if a.query not in REGISTRY:
        print(f"unknown query {a.query!r}; see `python -m qoeflow list`", file=sys.stderr)
        return 2
    from qoeflow.session import build_session
    spark = build_session(a.master)
    df = REGISTRY[a.query](spark, a.sf_dir)
    if a.explain:
        df.explain("formatted")
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(a.show, truncate=False)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
