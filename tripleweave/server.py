"""Queries over HTTP.

    GET or POST /sparql?query=…[&format=w3c]     JSON result; 400 and a message if the query is wrong
    GET /disconnect                               stops the server
"""

from __future__ import annotations

import json
import logging
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from tripleweave.engine import Engine
from tripleweave.errors import ParseError, QueryError
from tripleweave.sinks import json_chunks

log = logging.getLogger(__name__)


class _Handler(BaseHTTPRequestHandler):
    engine: Engine
    protocol_version = "HTTP/1.1"

    def _head(self, status: int, kind: str = "application/json", length: int | None = None) -> None:
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Access-Control-Allow-Origin", "*")
        self.send_header("Access-Control-Allow-Methods", "GET, POST, OPTIONS")
        self.send_header("Access-Control-Allow-Headers", "Content-Type, Accept")
        self.send_header(*(("Transfer-Encoding", "chunked") if length is None else ("Content-Length", str(length))))
        self.end_headers()

    def _error(self, status: int, what: str) -> None:
        body = json.dumps({"error": what}).encode()
        self._head(status, length=len(body))
        self.wfile.write(body)

    def _answer(self, given: dict[str, list[str]]) -> None:
        if "query" not in given:
            return self._error(400, "no query")
        began = time.perf_counter()
        try:
            df = self.engine.sparql(given["query"][0])
            chunks = json_chunks(df, given.get("format", [""])[0] == "w3c")
            head = next(chunks) + next(chunks)  # the job runs before the status is sent
        except (ParseError, QueryError) as e:
            return self._error(400, str(e))
        except Exception:
            log.exception("a query failed")
            return self._error(500, "the query failed")
        self._head(200, "application/sparql-results+json")
        self._chunk(head)
        for part in chunks:
            self._chunk(part)
        self._chunk("")
        log.info("answered in %.0f ms", 1000 * (time.perf_counter() - began))
        return None

    def _chunk(self, text: str) -> None:
        data = text.encode()
        self.wfile.write(b"%x\r\n%s\r\n" % (len(data), data))

    def do_OPTIONS(self) -> None:
        self._head(204, length=0)

    def do_GET(self) -> None:
        url = urlsplit(self.path)
        if url.path == "/disconnect":
            self._head(200, length=0)
            threading.Thread(target=self.server.shutdown, daemon=True).start()
        elif url.path == "/sparql":
            self._answer(parse_qs(url.query))
        else:
            self._error(404, "no such path")

    def do_POST(self) -> None:
        url = urlsplit(self.path)
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
        if url.path != "/sparql":
            return self._error(404, "no such path")
        given = parse_qs(url.query)
        if self.headers.get("Content-Type", "").startswith("application/sparql-query"):
            given["query"] = [body]
        else:
            given |= parse_qs(body)
        return self._answer(given)

    def log_message(self, *args: object) -> None:
        log.debug(*args)


def server(engine: Engine, ip: str = "0.0.0.0", port: int = 8080) -> ThreadingHTTPServer:
    """Bound to its address; ``serve_forever`` runs it."""
    return ThreadingHTTPServer((ip, port), type("Handler", (_Handler,), {"engine": engine}))
