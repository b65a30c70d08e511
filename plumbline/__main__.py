"""python -m plumbline QUERY [--data DIR] [--out PATH] [--format parquet|csv|json] [--sql]: run a named query, or list them.

DIR is --data, else $PLUMBLINE_DATA, else ./data; ~ and relative paths are resolved, paths with a scheme are left as they are (O7).
"""

from __future__ import annotations

import argparse
import os
import sys

from . import queries


def resolve(given: str | None, variable: str, default: str) -> str:
    """A path as given, else from the environment, else the default, without trailing slash."""
    path = given or os.environ.get(variable) or default
    return path.rstrip("/") if "://" in path else os.path.abspath(os.path.expanduser(path))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plumbline")
    p.add_argument("query", nargs="?")
    p.add_argument("--data")
    p.add_argument("--out")
    p.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
    p.add_argument("--sql", action="store_true", help="print the query's SQL for another engine")
    a = p.parse_args(args)
    known = queries.queries()
    if not a.query:
        print("\n".join(sorted(known)))
        return 0
    if a.query not in known:
        print(f"no query {a.query}", file=sys.stderr)
        return 2
    if a.sql:
        print(queries.oracle_sql().get(a.query, "no SQL"))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"plumbline {a.query}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = known[a.query](spark, resolve(a.data, "PLUMBLINE_DATA", "data"))
    if a.out:
        df.write.mode("overwrite").option("header", True).format(a.format).save(resolve(a.out, "PLUMBLINE_OUT", "out"))
    else:
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
