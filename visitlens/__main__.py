"""``python -m visitlens QUERY FOLDER [--out PATH]`` runs a registered query over a folder of tables."""

from __future__ import annotations

import argparse

from visitlens.plans.queries import QUERIES
from visitlens.session import build_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="visitlens", description=__doc__)
    parser.add_argument("query", choices=sorted(QUERIES))
    parser.add_argument("folder")
    parser.add_argument("--out", help="Parquet folder for the result; without it, the first rows are shown")
    parser.add_argument("--master")
    args = parser.parse_args()
    result = QUERIES[args.query](build_session(master=args.master), args.folder)
    if args.out:
        result.write.mode("overwrite").parquet(args.out)
    else:
        result.show(20, truncate=False)


if __name__ == "__main__":
    main()
