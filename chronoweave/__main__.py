"""Command line: the version, and conversion of a file of names over a stored graph."""

from __future__ import annotations

import argparse
import sys

VERSION = "0.2.0"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("chronoweave", description="Traces identifiers across releases and naming systems.")
    p.add_argument("-v", "--version", action="version", version=f"chronoweave {VERSION}")
    sub = p.add_subparsers(dest="command")
    c = sub.add_parser("convert", help="convert the names in a text file, one a line")
    c.add_argument("graph", help="folder of a stored graph")
    c.add_argument("names")
    c.add_argument("--out", help="folder for the result as CSV; printed, if it is not given")
    c.add_argument("--from-release", type=int)
    c.add_argument("--to-release", type=int)
    c.add_argument("--database")
    c.add_argument("--all", action="store_true", help="all targets, not only the best")
    a = p.parse_args(argv)
    if a.command is None:
        p.print_help()
        return 0
    from .api import Engine
    from .session import build

    spark = build("convert")
    names = spark.read.text(a.names).toDF("query_id").filter("query_id <> ''")
    got = Engine.stored(spark, a.graph).convert_many(names, a.from_release, a.to_release, a.database, one=not a.all)
    if a.out:
        got.write.option("header", True).csv(a.out)
    else:
        got.show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
