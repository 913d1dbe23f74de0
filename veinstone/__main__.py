"""python -m veinstone search INDEX CORPUS [QUERY] [--filters k=v ...] [--top-k N] [--json], or serve INDEX CORPUS [--port N].

search ends with 0 for results, 2 for a bad request and 3 for no match. serve answers GET /v1/health, /v1/categories
and POST /v1/search, with a bearer token if VEINSTONE_TOKEN is set.
"""

from __future__ import annotations

import argparse
import hmac
import json
import os
import sys
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import SparkSession

from .service import Request, Retriever, tool_text


def parsed_filters(pairs: list[str]) -> dict:
    out: dict = {}
    for pair in pairs:
        key, mark, value = pair.partition("=")
        if not mark:
            raise ValueError(f"a filter is key=value: {pair}")
        if key == "exclude_source_prefix":
            out.setdefault(key, []).append(value)
        else:
            out[key] = value
    return out


def answer(retriever: Retriever, method: str, path: str, body: bytes, token: str, given: str) -> tuple[int, dict]:
    """Status and body for a request to the service."""
    if token and not hmac.compare_digest(f"Bearer {token}".encode(), given.encode()):
        return 401, {"error": "a bearer token is needed"}
    if (method, path) == ("GET", "/v1/health"):
        return 200, retriever.status()
    if (method, path) == ("GET", "/v1/categories"):
        return 200, {"categories": retriever.categories()}
    if (method, path) != ("POST", "/v1/search"):
        return 404, {"error": "unknown path"}
    try:
        asked = json.loads(body or b"{}")
    except ValueError:
        return 400, {"error": "the body isn't JSON"}
    try:
        return 200, retriever.search(Request(**asked))
    except (ValueError, TypeError) as e:
        return 422, {"error": str(e)}


def serve(retriever: Retriever, port: int, token: str) -> None:
    class Handler(BaseHTTPRequestHandler):
        def reply(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, found = answer(retriever, self.command, self.path, body, token, self.headers.get("Authorization", ""))
            data = json.dumps(found, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = reply  # noqa: N815

    HTTPServer(("127.0.0.1", port), Handler).serve_forever()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veinstone", description=__doc__)
    parser.add_argument("what", choices=("search", "serve"))
    parser.add_argument("index")
    parser.add_argument("corpus")
    parser.add_argument("query", nargs="?", default="")
    parser.add_argument("--filters", nargs="*", default=[])
    parser.add_argument("--top-k", type=int, default=5)
    parser.add_argument("--port", type=int, default=8765)
    parser.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    retriever = Retriever(SparkSession.builder.getOrCreate(), args.index, args.corpus)
    if args.what == "serve":
        serve(retriever, args.port, os.environ.get("VEINSTONE_TOKEN", ""))
        return 0
    try:
        found = retriever.search(Request(query=args.query, top_k=args.top_k, filters=parsed_filters(args.filters)))
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(json.dumps(found, default=str) if args.json else tool_text(found))
    return 3 if found["no_match"] else 0


if __name__ == "__main__":
    sys.exit(main())
