"""JSON-RPC tools over one engine: a line per request, a line per reply."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import __version__
from quern.functions import vectors as V
from quern.operators import retrieval, symbols
from quern.operators.embedding import hash_vectors, onnx_vectors
from quern.operators.scope import ScopeError, Session


class Engine:
    """Searches over tables of all versions, within the session's scope."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], active: list[str], model: str | None = None, listing: Callable[[], list[dict]] | None = None):
        self.spark, self.tables, self.session, self.model, self.listing = spark, tables, Session(active), model, listing

    def _vector(self, text: str) -> list[float]:
        return (onnx_vectors(self.model, [text]) if self.model else hash_vectors([text]))[0].tolist()

    def _scope(self) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(self.session.versions())), "pos int, version string")

    def _search(self, table: str, query: str, keys: list[str], ident: str, text: str, width: int, k: int) -> dict:
        rows = self.tables[table].join(F.broadcast(self._scope()), "version")
        hits = retrieval.fanout(rows, self._vector(query), k, tie=ident).withColumn("score", V.similarity(F.col("cosine")))
        out = retrieval.merge(hits, keys, [F.asc("pos"), F.desc("cosine"), F.asc(ident)], k)
        out = out.withColumn("snippet", F.substring(F.coalesce(F.col(text), F.lit("")), 1, width)).drop(text, "cosine", "rank", "pos")
        return {"results": [json.loads(x) for x in out.toJSON().collect()]} | self.session.meta()  # at most k rows

    def search_code(self, query: str, k: int = 10) -> dict:
        return self._search("code_chunks", query, ["file_path", "line_start"], "id", "code_text", 300, k)

    def search_docs(self, query: str, k: int = 10) -> dict:
        return self._search("doc_sections", query, ["source_path", "page_range"], "section_id", "content", 400, k)

    def get_symbol_definition(self, symbol: str) -> dict:
        s = symbols.first_version(symbols.lookup(self.tables["symbols"], symbol), self._scope()).withColumnRenamed("id", "symbol_id")
        c = self.tables["code_chunks"].select(F.col("version").alias("_v"), F.col("id").alias("_id"), "code_text", "line_start", "line_end")
        rows = s.join(c, (s["version"] == c["_v"]) & (s["chunk_id"] == c["_id"])).drop("_v", "_id", "language").limit(1)
        found = [json.loads(x) for x in rows.toJSON().collect()]
        return (found[0] if found else {"error": f"symbol not found: {symbol}"}) | self.session.meta()

    def list_symbols(self, pattern: str = "", limit: int = 200) -> dict:
        rows = symbols.listing(self.tables["symbols"], self._scope(), pattern, limit).select("name", "type", "file_path")
        return {"symbols": [json.loads(x) for x in rows.toJSON().collect()]} | self.session.meta()

    def list_databases(self) -> dict:
        """The active versions, with size and date where the engine knows them."""
        known = {r["version"]: r for r in self.listing()} if self.listing else {}
        return {"databases": [{"version": v, "selected": v in self.session.versions()} | ({"exists": v in known} | {k: x for k, x in known.get(v, {}).items() if k != "active"} if self.listing else {}) for v in self.session.active]}

    def set_active_databases(self, versions: list[str]) -> dict:
        return {"active": self.session.choose(versions)}

    def reset_active_databases(self) -> dict:
        self.session.reset()
        return {"active": self.session.versions()}


_TEXT, _NONE = {"type": "string"}, {}
TOOLS = {
    "search_code": ({"query": _TEXT}, ["query"]), "search_docs": ({"query": _TEXT}, ["query"]), "get_symbol_definition": ({"symbol": _TEXT}, ["symbol"]),
    "list_symbols": ({"pattern": _TEXT, "limit": {"type": "integer"}}, []), "list_databases": (_NONE, []), "set_active_databases": ({"versions": {"type": "array", "items": _TEXT}}, ["versions"]), "reset_active_databases": (_NONE, []),
}


def handle(engine: Engine, request: dict) -> dict | None:
    """The reply to a request; None for a notification."""
    if "id" not in request:
        return None
    error = lambda code, text: {"jsonrpc": "2.0", "id": request["id"], "error": {"code": code, "message": text}}
    method, p = request.get("method"), request.get("params") or {}
    if method == "initialize":
        result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "quern", "version": __version__}}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": props, "required": need}} for n, (props, need) in TOOLS.items()]}
    elif method == "tools/call":
        if p.get("name") not in TOOLS:
            return error(-32601, f"unknown tool: {p.get('name')}")
        try:
            result = {"content": [{"type": "text", "text": json.dumps(getattr(engine, p["name"])(**(p.get("arguments") or {})))}]}
        except Exception as e:  # noqa: BLE001  (whatever a tool meets, the server goes on)
            if not isinstance(e, (ScopeError, TypeError, ValueError)):
                print(f"{p['name']}: {type(e).__name__}: {e}", file=sys.stderr)
            return error(-32603, str(e).split("\n", 1)[0])
    else:
        return error(-32601, f"unknown method: {method}")
    return {"jsonrpc": "2.0", "id": request["id"], "result": result}


def serve(engine: Engine, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    for line in lines:
        if line.strip():
            try:
                request = json.loads(line)
                reply = handle(engine, request) if isinstance(request, dict) else None
            except json.JSONDecodeError as e:
                print(f"parse error: {e}", file=sys.stderr)
                continue
            if reply is not None:
                print(json.dumps(reply), file=out, flush=True)
