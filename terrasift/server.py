"""GET /search and /prf over HTTP."""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import urlsplit

from .engine import Engine
from .sources.readers import parse_request
from .sources.sinks import result_lines


def respond(engine: Engine, target: str) -> tuple[str, str]:
    """Content type and body for a request target."""
    parts = urlsplit(target)
    r = parse_request(parts.query)
    if parts.path == "/prf":
        return "text/plain", "\n".join(f"{t.token}\t{t.prob}" for t in engine.prf(r["query"], r["numdocs"], r["numterms"]).collect())
    if parts.path != "/search":
        return "text/plain", "Only /search is handled!"
    if not r["query"] and not r["place"]:
        return "text/plain", "No query is given!"
    answer = engine.search(r["query"], r["numdocs"], r["ranker"], r["place"], r["best"], r["uname"])
    if r["format"] == "html":
        return "text/html", engine.html(answer)
    if r["format"] == "tsv":
        return "text/plain", "\n".join(f"{r['query']}\t{d.doc_id}\t{d.score}" for d in answer.results.collect())
    return "text/plain", "\n".join(line for (line,) in result_lines(answer.results).collect())


def make_server(engine: Engine, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            try:
                kind, body = respond(engine, self.path)
                status = 200
            except ValueError as e:
                kind, body, status = "text/plain", str(e), 400
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
