"""Command line: ``python -m lattica.cli COMMAND ROOT ...``, JSON or tables on stdout, progress on stderr.

Exit codes: 1 where something asked for isn't there, 2 for wrong arguments.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from .plans import queries as q
from .sources import commits, scan, store, typescript

#: What a result makes worth asking next.
NEXT = {
    "overview": ["hotspots", "modules", "forces"], "file": ["dependents", "symbol"], "dependents": ["file", "impact"], "hotspots": ["file", "forces"], "modules": ["forces", "groups"],
    "forces": ["hotspots", "modules"], "dead-exports": ["file", "rename"], "groups": ["modules"], "symbol": ["impact", "rename"], "search": ["file", "symbol"], "changes": ["dependents", "impact"],
    "impact": ["symbol", "rename"], "rename": ["impact"], "processes": ["symbol", "impact"], "clusters": ["modules", "groups"],
}


def positive(text: str) -> int:
    n = int(text)
    if n <= 0:
        raise argparse.ArgumentTypeError("must be a positive integer")
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lattica", description=__doc__.splitlines()[0])
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple, **options: dict) -> None:
        p = sub.add_parser(name)
        p.add_argument("root")
        for a in args:
            p.add_argument(a)
        for k, v in options.items():
            p.add_argument(f"--{k.replace('_', '-')}", **v)
        p.add_argument("--json", action="store_true")
        p.add_argument("--force", action="store_true", help="build anew even if the saved graph is of this commit")

    n = {"type": positive}
    command("overview")
    command("file", "path")
    command("dependents", "path", depth=n | {"default": 2})
    command("hotspots", metric={"choices": q.HOTSPOTS, "default": "coupling"}, limit=n | {"default": 10})
    command("modules")
    command("forces", cohesion={"type": float, "default": 0.6}, tension={"type": float, "default": 0.3}, escape={"type": float, "default": 0.5})
    command("dead-exports", module={}, limit=n | {"default": 20})
    command("groups")
    command("symbol", "name")
    command("search", "query", limit=n | {"default": 20})
    command("changes", scope={"default": "all"})
    command("impact", "name")
    command("rename", "name", "new_name", no_dry_run={"action": "store_true"})
    command("processes", entry={}, limit=n)
    command("clusters", min_files=n)
    command("status")
    command("clean")
    return top


def open_graph(spark: SparkSession, root: str, force: bool = False) -> q.Analysis:
    folder, head = os.path.join(root, store.FOLDER), commits.head(root)
    graph = store.usable(spark, folder, head, force)
    if graph is None:
        print(f"reading {root}", file=sys.stderr)
        built = typescript.source_graph(scan.read_sources(spark, root), commits.touched(spark, root), scan.path_aliases(root))
        store.save(built, folder, head)
        graph = store.load(spark, folder)[0]
    return q.Analysis(graph)


def hotspots(a: q.Analysis, metric: str, limit: int) -> dict[str, DataFrame]:
    top = q.hotspots(a, metric, limit)
    return {"hotspots": top, "summary": q.hotspot_summary(top, metric)}


def answer(a: q.Analysis, spark: SparkSession, args: argparse.Namespace) -> DataFrame | dict[str, DataFrame]:
    run = {
        "overview": lambda: q.overview(a), "file": lambda: q.file_context(a, args.path), "dependents": lambda: q.dependents(a, args.path, args.depth), "hotspots": lambda: hotspots(a, args.metric, args.limit),
        "modules": lambda: q.module_structure(a), "forces": lambda: q.forces(a, args.cohesion, args.tension, args.escape), "dead-exports": lambda: q.dead_exports(a, args.module, args.limit), "groups": lambda: q.groups(a),
        "symbol": lambda: q.symbol_context(a, args.name), "search": lambda: q.search_files(a, args.query, args.limit), "changes": lambda: q.changes(a, commits.changed(spark, args.root, args.scope)),
        "impact": lambda: q.impact(a, args.name), "rename": lambda: q.rename(a, args.name, args.new_name, not args.no_dry_run), "processes": lambda: q.processes(a, args.entry, args.limit), "clusters": lambda: q.clusters(a, args.min_files),
    }
    return run[args.command]()


def show(result: DataFrame | dict[str, DataFrame], command: str, as_json: bool) -> None:
    parts = result if isinstance(result, dict) else {command: result}
    if as_json:
        print(json.dumps({k: [json.loads(x) for x in v.toJSON().collect()] for k, v in parts.items()} | {"next_steps": NEXT[command]}, indent=2))
        return
    for name, df in parts.items():
        print(name)
        df.show(max(1, df.count()), truncate=60)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    folder = os.path.join(args.root, store.FOLDER)
    spark = spark or SparkSession.builder.appName("lattica").getOrCreate()
    if args.command == "clean":
        print("removed" if store.clean(spark, folder) else "nothing to remove")
        return 0
    if args.command == "status":
        found = store.status(spark, folder)
        print(json.dumps(found) if found else "no saved graph")
        return 0 if found else 1
    try:
        show(answer(open_graph(spark, args.root, args.force), spark, args), args.command, args.json)
    except (q.NotFound, FileNotFoundError, ValueError, RuntimeError) as e:
        print(e, file=sys.stderr)
        for s in getattr(e, "suggestions", []):
            print(f"  did you mean {s}?", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
