"""The operators as named tools with plain parameters and text answers, for programs that ask over a pipe."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO

from pyspark.sql import functions as F

from graphloom.graph import CodeGraph, OpenGraphs
from graphloom.operators.context import truncated
from graphloom.schemas import BUDGETS

SHOWN = {"type_alias": "type"}


def clamp(value, default: int, most: int = 100) -> int:
    return max(1, min(most, round(default if value is None else float(value))))


def _line(r) -> str:
    score = f" [{r['score']:.2f}]" if "score" in r.__fields__ else ""
    signature = f" {r['signature']}" if r["signature"] else ""
    return f"{SHOWN.get(r['kind'], r['kind'])} {r['name']}{signature} ({r['file_path']}:{r['start_line']}){score}"


def _lines(df, none: str) -> str:
    rows = df.collect()  # limited by the caller
    return "\n".join(map(_line, rows)) or none


def _symbol(graph: CodeGraph, args: dict, key: str = "symbol") -> str:
    found = graph.symbol(args[key], args.get("kind"))
    if found is None:
        raise LookupError(f"no symbol is called {args[key]}")
    return found


def _status(graph: CodeGraph, args: dict) -> str:
    s = graph.stats()
    languages = sorted(s["by_language"].items(), key=lambda x: (-x[1], x[0]))
    return "\n".join([f"files {s['files']}, nodes {s['nodes']}, edges {s['edges']}, bytes {s['bytes']}", "kinds: " + ", ".join(f"{k} {n}" for k, n in sorted(s["by_kind"].items())), "languages: " + ", ".join(f"{k} {n}" for k, n in languages)])


def _node(graph: CodeGraph, args: dict) -> str:
    i = _symbol(graph, args)
    out = _lines(graph.node(i), "")
    doc = graph.node(i).select("docstring").first()["docstring"]
    code = graph.node_source(i) if args.get("includeCode") else None
    return "\n".join(x for x in (out, doc, code) if x)


def _context(graph: CodeGraph, args: dict) -> str:
    found = graph.build_context(args["task"], int(args.get("maxNodes", 20)), args.get("includeCode", True))
    parts = [found.summary()]
    if found.code is not None:
        parts += [f"\n#### {r['name']} ({r['file_path']})\n{r['code']}" for r in found.code.where("code is not null").select("name", "file_path", "code").collect()]
    return "\n".join(parts)


#: Rows of a list that may be long.
SHOWN_ROWS = 100


def _path(graph: CodeGraph, args: dict) -> str:
    """The path, and the edges that touch its nodes beside it."""
    rows = graph.find_path(_symbol(graph, args, "from"), _symbol(graph, args, "to")).collect()
    if not rows:
        return "no path"
    ids = [r["id"] for r in rows]
    on_path = F.lit(False)
    for x, y in zip(ids, ids[1:]):
        on_path = on_path | ((F.col("source") == x) & (F.col("target") == y))
    around = graph.edges.where((F.col("source").isin(*ids) | F.col("target").isin(*ids)) & ~on_path).select("source", "kind", "target").distinct()
    total = around.count()
    beside = [f"{r['source']} -[{r['kind']}]-> {r['target']}" for r in around.orderBy("source", "target", "kind").limit(SHOWN_ROWS).collect()]
    path = "\n".join(("" if r["via"] is None else f"-[{r['via']}]-> ") + _line(r) for r in rows) + f"\n{len(rows) - 1} edges"
    return "\n".join([path, *([f"\nbeside it: {total}", *beside] if beside else []), *([f"... and {total - SHOWN_ROWS} more"] if total > SHOWN_ROWS else [])])


def _cycles(graph: CodeGraph, args: dict) -> str:
    rows = graph.circular_dependencies().orderBy("length", "path").limit(SHOWN_ROWS + 1).collect()
    lines = [" -> ".join([*r["path"], r["path"][0]]) for r in rows[:SHOWN_ROWS]]
    return "\n".join([*lines, *(["... and more"] if len(rows) > SHOWN_ROWS else [])]) or "no cycles"


def _impact(graph: CodeGraph, args: dict) -> str:
    found = graph.impact_radius(_symbol(graph, args), int(args.get("depth", 2)))
    total = found.count()
    more = f"\n... and {total - 100} more" if total > 100 else ""
    return f"{total} affected\n" + _lines(found.orderBy("id").limit(100), "") + more


TOOLS: dict[str, Callable[[CodeGraph, dict], str]] = {
    "search": lambda g, a: _lines(g.search_nodes(a["query"], clamp(a.get("limit"), 10), (a["kind"],) if a.get("kind") else ()), "no results"),
    "signature_search": lambda g, a: _lines(g.search_by_signature(a["query"], clamp(a.get("limit"), 10)), "no results"),
    "context": _context,
    "callers": lambda g, a: _lines(g.callers(_symbol(g, a), clamp(a.get("limit"), 20)), "no callers"),
    "callees": lambda g, a: _lines(g.callees(_symbol(g, a), clamp(a.get("limit"), 20)), "no callees"),
    "impact": _impact,
    "node": _node,
    "status": _status,
    "dead_code": lambda g, a: _lines(g.dead_code(clamp(a.get("limit"), 20)), "no dead code"),
    "cycles": _cycles,
    "path": _path,
    "explore": lambda g, a: g.explore(a["query"], a.get("budget", "medium") if a.get("budget", "medium") in BUDGETS else "medium"),
}


_ROOT = {"projectPath": {"type": "string", "description": "root of another indexed tree"}}
_FIELDS = {
    "query": {"type": "string", "description": "what to look for"},
    "task": {"type": "string", "description": "what is to be done, in words"},
    "symbol": {"type": "string", "description": "name of a definition"},
    "from": {"type": "string", "description": "name of the definition where the path starts"},
    "to": {"type": "string", "description": "name of the definition where the path ends"},
    "kind": {"type": "string", "description": "only this kind of node"},
    "limit": {"type": "number", "description": "most rows, 1 to 100"},
    "depth": {"type": "number", "description": "most edges away", "default": 2},
    "maxNodes": {"type": "number", "description": "most nodes", "default": 20},
    "includeCode": {"type": "boolean", "description": "with source code"},
    "budget": {"type": "string", "description": "how much to tell", "enum": list(BUDGETS), "default": "medium"},
}
#: What each tool needs, and what it may be given; every tool takes projectPath.
PARAMETERS: dict[str, tuple[str, str]] = {
    "search": ("query", "kind limit"),
    "signature_search": ("query", "limit"),
    "context": ("task", "maxNodes includeCode"),
    "callers": ("symbol", "kind limit"),
    "callees": ("symbol", "kind limit"),
    "impact": ("symbol", "kind depth"),
    "node": ("symbol", "kind includeCode"),
    "status": ("", ""),
    "dead_code": ("", "limit"),
    "cycles": ("", ""),
    "path": ("from to", "kind"),
    "explore": ("query", "budget"),
}


def input_schema(tool: str) -> dict:
    """The parameters of a tool as a JSON schema."""
    needed, optional = (x.split() for x in PARAMETERS[tool])
    return {"type": "object", "properties": {k: _FIELDS[k] for k in (*needed, *optional)} | _ROOT, "required": needed}


def call(graph: CodeGraph, tool: str, args: dict, fresh: bool = False) -> str:
    """The answer of a tool; failures are answers too.  With ``fresh`` the graph is brought up to the tree first."""
    if tool not in TOOLS:
        return f"Error: no tool is called {tool}"
    try:
        if fresh:
            graph.sync_if_dirty()
        return truncated(TOOLS[tool](graph, args))
    except (LookupError, ValueError, FileNotFoundError) as e:
        return f"Error: {e}"


def serve(graphs: OpenGraphs, root: str, lines: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
    """JSON-RPC, one message a line, until the input ends."""
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            print(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}), file=out, flush=True)
            continue
        method, params, reply = message.get("method"), message.get("params") or {}, None
        if method == "initialize":
            reply = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "0.1"}}
        elif method == "tools/list":
            reply = {"tools": [{"name": n, "inputSchema": input_schema(n)} for n in TOOLS]}
        elif method == "tools/call":
            args = params.get("arguments") or {}
            text = call(graphs.get(args.get("projectPath") or root), params.get("name", ""), args, fresh=True)
            reply = {"content": [{"type": "text", "text": text}], "isError": text.startswith("Error:")}
        elif method == "ping":
            reply = {}
        if "id" in message:
            body = {"result": reply} if reply is not None else {"error": {"code": -32601, "message": f"no method {method}"}}
            print(json.dumps({"jsonrpc": "2.0", "id": message["id"]} | body), file=out, flush=True)
