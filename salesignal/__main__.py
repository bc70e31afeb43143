"""python -m salesignal QUERY --data DIR [--limit N] [--out PATH] | --list"""

from __future__ import annotations

import argparse

from salesignal import plans
from salesignal.session import build_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="salesignal")
    p.add_argument("query", nargs="?")
    p.add_argument("--data")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--out")
    p.add_argument("--list", action="store_true")
    a = p.parse_args(argv)
    if a.list or not a.query:
        print("\n".join(sorted(plans.QUERIES)))
        return 0
    if a.query not in plans.QUERIES or not a.data:
        p.error("an unknown query, or no --data")
    df = plans.QUERIES[a.query](build_session(), a.data)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(a.limit, truncate=60)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
