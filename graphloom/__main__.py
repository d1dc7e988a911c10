"""Command line: python -m graphloom COMMAND [ROOT] ..."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from graphloom import tools
from graphloom.graph import CodeGraph, OpenGraphs

ASKING = {"query": ("search", "query"), "callers": ("callers", "symbol"), "callees": ("callees", "symbol"), "impact": ("impact", "symbol"), "context": ("context", "task"), "explore": ("explore", "query"), "node": ("node", "symbol"), "signature": ("signature_search", "query")}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="graphloom", description="A code graph on Spark.")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("init", "index", "sync", "status", "dead-code", "cycles", "serve", "watch"):
        one = commands.add_parser(name)
        one.add_argument("root", nargs="?", default=".")
        if name == "watch":
            one.add_argument("--every", type=float, default=2.0, help="seconds between looks at the tree")
    for name in ASKING:
        one = commands.add_parser(name)
        one.add_argument("text")
        one.add_argument("--root", default=".")
        one.add_argument("--limit", type=int)
        one.add_argument("--depth", type=int, default=3)
        one.add_argument("--budget", default="medium")
    one = commands.add_parser("path")
    one.add_argument("start")
    one.add_argument("end")
    one.add_argument("--root", default=".")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    root = CodeGraph.nearest_root(args.root) or args.root
    if args.command == "init":
        CodeGraph.init(spark, args.root)
        return 0
    graph = CodeGraph.open(spark, root)
    if args.command == "index":
        print(graph.index_all())
    elif args.command == "sync":
        print(json.dumps(graph.sync()))
    elif args.command == "serve":
        tools.serve(OpenGraphs(spark), root)
    elif args.command == "watch":
        while True:
            if counts := graph.sync_if_dirty():
                print(json.dumps(counts), flush=True)
            time.sleep(args.every)
    elif args.command in ("status", "dead-code", "cycles"):
        print(tools.call(graph, args.command.replace("-", "_"), {}))
    elif args.command == "path":
        print(tools.call(graph, "path", {"from": args.start, "to": args.end}))
    else:
        tool, key = ASKING[args.command]
        print(tools.call(graph, tool, {key: args.text, "limit": args.limit, "depth": args.depth, "budget": args.budget, "includeCode": True}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
