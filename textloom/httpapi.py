"""The library over HTTP: chunk, index, search and list or delete sources, on one session and one index."""

from __future__ import annotations

import argparse
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from pyspark.sql import SparkSession

from textloom.operators.chunkers import make_kernel
from textloom.operators.index import ParquetIndex
from textloom.operators.resident import ResidentIndex

BODY_LIMIT = 10 << 20
CHUNK_FIELDS = {"text": str, "chunker": str, "tokenizer": str, "size": int, "overlap": int, "rules": list, "lang": str}
INDEX_FIELDS = CHUNK_FIELDS | {"source": str, "replace": bool}
SEARCH_FIELDS = {"query": str, "k": int, "scoring": str, "hybrid_weight": float, "source": str}


class Refused(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class Service:
    """The routes, as functions of a decoded body."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.index, self.lock = spark, ParquetIndex(spark, path), threading.Lock()
        self.resident: ResidentIndex | None = None
        self.too_large = -1  # the version that did not fit

    def handle(self, method: str, path: str, raw: bytes) -> tuple[int, object]:
        if (method, path) == ("GET", "/health"):
            return 200, {"status": "ok"}
        if (method, path) == ("GET", "/v1/sources"):
            return 200, {"sources": [r.asDict() for r in self.index.sources().collect()]}
        if method == "DELETE" and path.startswith("/v1/sources/"):
            with self.lock:
                return 200, {"deleted": self.index.delete_source(unquote(path.removeprefix("/v1/sources/")))}
        routes = {"/v1/chunk": (self.chunk, CHUNK_FIELDS), "/v1/index": (self.add, INDEX_FIELDS), "/v1/search": (self.search, SEARCH_FIELDS)}
        if path not in routes:
            raise Refused(404, "no such route")
        if method != "POST":
            raise Refused(405, "method not allowed")
        run, fields = routes[path]
        return 200, run(decoded(raw, fields))

    def _chunks(self, body: dict) -> list[dict]:
        options = {"size": body.get("size", 512), "overlap": body.get("overlap", 0), "lang": body.get("lang", ""), "rules": json.dumps(body["rules"]) if body.get("rules") else ""}
        if body.get("chunker", "recursive") != "fast":
            options["tokenizer"] = body.get("tokenizer", "character")
        text = body.get("text", "")
        kernel = make_kernel(body.get("chunker", "recursive"), **options)
        return [{"text": text[s.start : s.end], "start": s.start, "end": s.end, "token_count": s.tokens} | ({"context": s.context} if s.context else {}) for s in (kernel(text) if text else ())]

    def chunk(self, body: dict) -> dict:
        return {"chunks": self._chunks(body)}

    def add(self, body: dict) -> dict:
        chunks = self._chunks(body)
        if chunks:
            rows = [(c["text"], c["start"], c["end"], c["token_count"], c.get("context", "")) for c in chunks]
            with self.lock:
                self.index.index(self.spark.createDataFrame(rows, "text string, start int, end int, token_count int, context string"), source=body.get("source", ""), replace=body.get("replace", False))
        return {"indexed": len(chunks), "chunks": chunks}

    def _resident(self) -> ResidentIndex | None:
        """The index in memory, as of its newest version; none if it is too large for that."""
        with self.lock:
            version = self.index.version()
            if version == self.too_large:
                return None
            if self.resident is None or self.resident.version != version:
                try:
                    self.resident = ResidentIndex(self.index)
                except ValueError:
                    self.resident, self.too_large = None, version
            return self.resident

    def search(self, body: dict) -> dict:
        if not body.get("query"):
            raise Refused(400, "query is missing")
        options = {"k": body.get("k", 5), "mode": body.get("scoring", "dense"), "weight": body.get("hybrid_weight", 0.5), "source": body.get("source"), "stats_scope": "corpus"}
        resident = self._resident()
        hits = resident.search(body["query"], **options) if resident else self.index.search(body["query"], **options).orderBy("rank").collect()
        out = []
        for r in hits:
            chunk = {c: r[c] for c in ("text", "start", "end", "token_count")} | ({"context": r["context"]} if r["context"] else {})
            out.append({"record": {"chunk": chunk} | ({"source": r["source"]} if r["source"] else {}), "score": r["score"]})
        return {"hits": out}


def decoded(raw: bytes, fields: dict[str, type]) -> dict:
    """The body as an object of the known fields; anything else is refused."""
    try:
        body = json.loads(raw or b"{}")
    except ValueError:
        raise Refused(400, "the body is not JSON") from None
    if not isinstance(body, dict):
        raise Refused(400, "the body is not an object")
    for name, value in body.items():
        if name not in fields:
            raise Refused(400, f"unknown field {name!r}")
        kinds = (int, float) if fields[name] is float else (fields[name],)
        if not isinstance(value, kinds) or (isinstance(value, bool) and bool not in kinds):
            raise Refused(400, f"field {name!r} has the wrong type")
    return body


def make_server(spark: SparkSession, path: str, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    service = Service(spark, path)

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            try:
                size = int(self.headers.get("Content-Length") or 0)
                if size > BODY_LIMIT:
                    raise Refused(413, "the body is too large")
                status, body = service.handle(self.command, self.path, self.rfile.read(size))
            except Refused as e:
                status, body = e.status, {"error": str(e)}
            except ValueError as e:
                status, body = 400, {"error": str(e)}
            except Exception as e:
                status, body = 500, {"error": str(e)}
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


class Client:
    """The routes as methods; an answer other than 2xx is a ClientError."""

    def __init__(self, base: str, timeout: float = 60):
        self.base, self.timeout = base.rstrip("/"), timeout

    def _call(self, method: str, path: str, body: dict | None = None) -> dict:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        request = Request(self.base + path, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"}, method=method)
        try:
            with urlopen(request, timeout=self.timeout) as r:
                return json.loads(r.read())
        except HTTPError as e:
            raise ClientError(e.code, e.read().decode("utf-8", "replace")) from None

    def health(self) -> dict:
        return self._call("GET", "/health")

    def chunk(self, text: str, **options) -> list[dict]:
        return self._call("POST", "/v1/chunk", {"text": text, **options})["chunks"]

    def index(self, text: str, **options) -> dict:
        return self._call("POST", "/v1/index", {"text": text, **options})

    def search(self, query: str, **options) -> list[dict]:
        return self._call("POST", "/v1/search", {"query": query, **options})["hits"]

    def sources(self) -> list[dict]:
        return self._call("GET", "/v1/sources")["sources"]

    def delete_source(self, name: str) -> int:
        from urllib.parse import quote

        return self._call("DELETE", f"/v1/sources/{quote(name, safe='')}")["deleted"]


class ClientError(Exception):
    def __init__(self, status: int, body: str):
        super().__init__(f"status {status}: {body}")
        self.status, self.body = status, body


def main() -> None:
    p = argparse.ArgumentParser(prog="textloom-api")
    p.add_argument("-addr", "--addr", default="127.0.0.1:8080")
    p.add_argument("-index", "--index", required=True)
    a = p.parse_args()
    host, _, port = a.addr.rpartition(":")
    make_server(SparkSession.builder.appName("textloom-api").getOrCreate(), a.index, host or "127.0.0.1", int(port)).serve_forever()


if __name__ == "__main__":
    main()
