"""POST /parse, /explain and /execute with JSON bodies."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from askframe.engine import Engine, RegistryEngine
from askframe.plans.guard import ROW_CAP


def _wrong(status: int, code: str, message: str) -> tuple[int, dict[str, Any]]:
    return status, {"success": False, "error": {"code": code, "message": message}}


def handle(engine: Engine | RegistryEngine, path: str, body: bytes) -> tuple[int, dict[str, Any]]:
    """Status and payload of one request."""
    if path not in ("/parse", "/explain", "/execute"):
        return _wrong(404, "NOT_FOUND", f"there is no {path}")
    try:
        request = json.loads(body or b"{}")
    except ValueError:
        return _wrong(400, "INVALID_JSON", "the body is not JSON")
    if not isinstance(request, dict) or not isinstance(request.get("query"), str) or not request["query"].strip():
        return _wrong(400, "INVALID_REQUEST", "a query is needed")
    rows = request.get("max_rows", ROW_CAP)
    if isinstance(rows, bool) or not isinstance(rows, int) or rows < 1:
        return _wrong(400, "INVALID_REQUEST", "max_rows must be a positive integer")
    more = {} if isinstance(engine, RegistryEngine) else {"conversation": request.get("history") or request.get("conversation")}
    if path == "/execute":
        return 200, engine.execute(request["query"], rows, **more).to_dict()
    return 200, (engine.parse if path == "/parse" else engine.explain)(request["query"], **more).to_dict()


def server(engine: Engine | RegistryEngine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is not started yet."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802
            status, payload = handle(engine, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            out = json.dumps(payload, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
