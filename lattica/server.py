"""The queries as tools of a Model Context Protocol server: JSON-RPC lines on stdin and stdout.

``python -m lattica.server ROOT`` reads the tree once and answers until stdin ends.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from . import cli
from .plans import queries as q
from .sources import commits

_TEXT, _NUMBER, _INTEGER = {"type": "string"}, {"type": "number"}, {"type": "integer", "minimum": 1}
#: tool: (command line's name, what it tells, arguments, those required)
TOOLS: dict[str, tuple[str, str, dict, list[str]]] = {
    "codebase_overview": ("overview", "Totals, modules and the most depended-on files", {"depth": _INTEGER}, []),
    "file_context": ("file", "Exports, imports, dependents and metrics of a file", {"filePath": _TEXT}, ["filePath"]),
    "get_dependents": ("dependents", "Files that depend on a file", {"filePath": _TEXT, "depth": _INTEGER}, ["filePath"]),
    "find_hotspots": ("hotspots", "Files ranked by a metric", {"metric": {"type": "string", "enum": list(q.HOTSPOTS)}, "limit": _INTEGER}, ["metric"]),
    "get_module_structure": ("modules", "Modules, their dependencies and cycles", {"depth": _INTEGER}, []),
    "analyze_forces": ("forces", "Cohesion, tension, bridges and extraction candidates", {"cohesionThreshold": _NUMBER, "tensionThreshold": _NUMBER, "escapeThreshold": _NUMBER}, []),
    "find_dead_exports": ("dead-exports", "Exports that nothing uses", {"module": _TEXT, "limit": _INTEGER}, []),
    "get_groups": ("groups", "Groups of modules by importance", {}, []),
    "symbol_context": ("symbol", "Callers, callees and metrics of a symbol", {"name": _TEXT}, ["name"]),
    "search": ("search", "Files and symbols by keywords", {"query": _TEXT, "limit": _INTEGER}, ["query"]),
    "detect_changes": ("changes", "What a git diff touches and who depends on it", {"scope": _TEXT}, []),
    "impact_analysis": ("impact", "Callers that a change of a symbol reaches, by depth", {"symbol": _TEXT}, ["symbol"]),
    "rename_symbol": ("rename", "References that a rename has to change", {"oldName": _TEXT, "newName": _TEXT, "dryRun": {"type": "boolean"}}, ["oldName", "newName"]),
    "get_processes": ("processes", "Call chains from entry points", {"entryPoint": _TEXT, "limit": _INTEGER}, []),
    "get_clusters": ("clusters", "Communities of files", {"minFiles": _INTEGER}, []),
}
PROMPTS = {
    "detect_impact": "Call detect_changes, then get_dependents and impact_analysis for what changed, and sum up the risk.",
    "generate_map": "Call codebase_overview, get_module_structure, get_groups and get_processes, and draw the architecture from them.",
}
RESOURCES = {"codebase://clusters": "get_clusters", "codebase://processes": "get_processes", "codebase://overview": "codebase_overview"}


def _run(a: q.Analysis, spark: SparkSession, root: str, tool: str, x: dict) -> DataFrame | dict[str, DataFrame]:
    run: dict[str, Callable] = {
        "codebase_overview": lambda: q.overview(a), "file_context": lambda: q.file_context(a, x["filePath"]), "get_dependents": lambda: q.dependents(a, x["filePath"], x.get("depth", 2)),
        "find_hotspots": lambda: cli.hotspots(a, x["metric"], x.get("limit", 10)), "get_module_structure": lambda: q.module_structure(a),
        "analyze_forces": lambda: q.forces(a, x.get("cohesionThreshold", 0.6), x.get("tensionThreshold", 0.3), x.get("escapeThreshold", 0.5)),
        "find_dead_exports": lambda: q.dead_exports(a, x.get("module"), x.get("limit", 20)), "get_groups": lambda: q.groups(a), "symbol_context": lambda: q.symbol_context(a, x["name"]),
        "search": lambda: q.search_files(a, x["query"], x.get("limit", 20)), "detect_changes": lambda: q.changes(a, commits.changed(spark, root, x.get("scope", "all"))),
        "impact_analysis": lambda: q.impact(a, x["symbol"]), "rename_symbol": lambda: q.rename(a, x["oldName"], x["newName"], x.get("dryRun", True)),
        "get_processes": lambda: q.processes(a, x.get("entryPoint"), x.get("limit")), "get_clusters": lambda: q.clusters(a, x.get("minFiles")),
    }
    return run[tool]()


def call(a: q.Analysis, spark: SparkSession, root: str, tool: str, arguments: dict) -> dict:
    """A tool's result as JSON text, with what to ask next."""
    try:
        result = _run(a, spark, root, tool, arguments)
        parts = result if isinstance(result, dict) else {cli_name(tool): result}
        body = {k: [json.loads(r) for r in v.toJSON().collect()] for k, v in parts.items()} | {"nextSteps": cli.NEXT[cli_name(tool)]}
        return {"content": [{"type": "text", "text": json.dumps(body)}]}
    except (q.NotFound, KeyError, RuntimeError) as e:
        return {"content": [{"type": "text", "text": json.dumps({"error": str(e), "suggestions": getattr(e, "suggestions", [])})}], "isError": True}


def cli_name(tool: str) -> str:
    return TOOLS[tool][0]


def handle(a: q.Analysis, spark: SparkSession, root: str, message: dict) -> dict | None:
    """The answer to one message; notifications have none."""
    if "id" not in message:
        return None
    method, x = message.get("method"), message.get("params") or {}
    if method == "initialize":
        result: dict | None = {"protocolVersion": x.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "prompts": {}, "resources": {}}, "serverInfo": {"name": "lattica", "version": "1"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (_, d, p, r) in TOOLS.items()]}
    elif method == "tools/call" and x.get("name") in TOOLS:
        result = call(a, spark, root, x["name"], x.get("arguments") or {})
    elif method == "prompts/list":
        result = {"prompts": [{"name": n} for n in PROMPTS]}
    elif method == "prompts/get" and x.get("name") in PROMPTS:
        result = {"messages": [{"role": "user", "content": {"type": "text", "text": PROMPTS[x["name"]]}}]}
    elif method == "resources/list":
        result = {"resources": [{"uri": u, "name": u.split("//")[1], "mimeType": "application/json"} for u in RESOURCES]}
    elif method == "resources/read" and x.get("uri") in RESOURCES:
        result = {"contents": [{"uri": x["uri"], "mimeType": "application/json", "text": call(a, spark, root, RESOURCES[x["uri"]], {})["content"][0]["text"]}]}
    else:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"unknown: {method}"}}
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def serve(a: q.Analysis, spark: SparkSession, root: str, lines: Iterable[str], write: Callable[[str], object]) -> None:
    for line in lines:
        if line.strip():
            try:
                reply = handle(a, spark, root, json.loads(line))
            except ValueError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if reply is not None:
                write(json.dumps(reply) + "\n")


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="lattica-server")
    args.add_argument("root")
    root = args.parse_args(argv).root
    spark = SparkSession.builder.appName("lattica").getOrCreate()

    def write(text: str) -> None:
        sys.stdout.write(text)
        sys.stdout.flush()

    serve(cli.open_graph(spark, root), spark, root, sys.stdin, write)


if __name__ == "__main__":
    main()
