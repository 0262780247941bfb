"""Command line: prepare-data, query, parse, explain and serve. Exit codes: 0 done, 1 not answered, 2 wrong usage."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from askframe.engine import Engine, property_engine
from askframe.sources.catalog import Catalog
from askframe.sources.csv_ingest import read_csv, write_table
from askframe.sources.examples import BUSINESS
from askframe.sources.tables import star_catalog
from askframe.surfaces.http import server

ROWS = 20


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="askframe", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    prepare = commands.add_parser("prepare-data", help="clean a property-sales CSV file into a Parquet table")
    prepare.add_argument("csv")
    prepare.add_argument("out")
    for name in ("query", "parse", "explain", "serve"):
        command = commands.add_parser(name)
        if name != "serve":
            command.add_argument("question")
        source = command.add_mutually_exclusive_group()
        source.add_argument("--schema", help="a JSON schema file, without data")
        source.add_argument("--tables", help="a folder of Parquet tables of the star schema")
        source.add_argument("--csv", help="a property-sales CSV file")
        command.add_argument("--rows", type=int, default=ROWS)
        command.add_argument("--dialect", default="plain", choices=("plain", "spark", "postgres"))
        command.add_argument("--port", type=int, default=8000)
    return parser


def _engine(args: argparse.Namespace) -> Engine:
    if args.schema:
        return Engine(Catalog.from_json(args.schema), dialect=args.dialect)
    if not args.tables and not args.csv:
        return Engine(Catalog.from_dict(BUSINESS), dialect=args.dialect)
    spark = SparkSession.builder.appName("askframe").getOrCreate()
    if args.csv:
        return property_engine(spark, args.csv, dialect=args.dialect)
    return Engine(star_catalog(spark, args.tables), dialect=args.dialect, timeout=60.0)


def main(argv: Sequence[str] | None = None) -> int:
    try:
        args = _arguments().parse_args(argv)
    except SystemExit as stop:
        return int(stop.code or 0)
    if args.command == "prepare-data":
        spark = SparkSession.builder.appName("askframe").getOrCreate()
        print(write_table(read_csv(spark, args.csv), args.out))
        return 0
    try:
        engine = _engine(args)
    except (OSError, ValueError) as wrong:
        print(f"askframe: {wrong}", file=sys.stderr)
        return 2
    if args.command == "serve":
        server(engine, port=args.port).serve_forever()
        return 0
    ask = {"query": lambda: engine.execute(args.question, args.rows), "parse": lambda: engine.parse(args.question), "explain": lambda: engine.explain(args.question)}
    answer = ask[args.command]()
    print(json.dumps(answer.to_dict(), default=str, ensure_ascii=False, indent=2))
    return 0 if answer.success else 1


if __name__ == "__main__":
    sys.exit(main())
