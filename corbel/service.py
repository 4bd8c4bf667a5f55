"""An HTTP service over one index.

GET /health /ready /stats /collections /metrics /openapi.json /ws, POST /query
/prompt /ask /index, DELETE /documents/<id>. /ask answers with server-sent
events, /ws is a web socket that takes {"type": "search" | "prompt" | "ping"}.
"""

import base64
import hashlib
import hmac
import json
import struct
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from pyspark.sql import SparkSession

from . import __version__
from .config import Config, clamp, load
from .functions.generation import Generator
from .operators.search import prompt
from .plans.index import add_documents, find, generator
from .schema import DOCUMENT, ConfigError, EngineError
from .sources.store import Store

MOST_BODY = 10 << 20
ROUTES = {
    "/health": "get", "/ready": "get", "/stats": "get", "/collections": "get", "/metrics": "get", "/openapi.json": "get", "/ws": "get",
    "/query": "post", "/prompt": "post", "/ask": "post", "/index": "post", "/documents/{doc_id}": "delete",
}
#: Requests that need no token, whatever the settings say.
OPEN = ("/health", "/ready", "/openapi.json")
_SOCKET = b"258EAFA5-E914-47DA-95CA-C5AB0DC85B11"


class Engine:
    """What the service, the web socket and the tools of a language model have in common."""

    def __init__(self, spark: SparkSession, config: Config, own: Generator | None = None):
        self.spark, self.config, self.store, self.generator = spark, config, Store(spark, config.db), own or generator(config)

    def hits(self, said: dict, most: int = 1000) -> list:
        if not isinstance(said.get("query"), str):
            raise ConfigError("query is missing")
        k = clamp(int(said.get("top_k") or self.config.top_k), most)
        conf = Config(**vars(self.config) | ({"alpha": float(said["alpha"])} if "alpha" in said else {})).check()
        return find(self.spark, self.store, said["query"], conf, bool(said.get("hybrid")), said.get("filter"), k).orderBy("rank").collect()  # k rows

    def prompt(self, said: dict, most: int = 1000) -> tuple[str, list]:
        rows = self.hits(said, most)
        if not rows:
            return "", []
        held = self.spark.createDataFrame([(r.query_id, r.query, r["rank"], r.source, r.text) for r in rows], "query_id int, query string, rank int, source string, text string")
        return prompt(held, said.get("template")).first().prompt, rows

    def add(self, documents: list) -> int:
        if not isinstance(documents, list) or not all(isinstance(d, dict) and isinstance(d.get("text"), str) and d["text"] for d in documents):
            raise ConfigError("documents must be a list of objects with a text")
        rows = [(str(d.get("id") or uuid.uuid4()), d["text"], {str(k): str(v) for k, v in (d.get("metadata") or {}).items()}) for d in documents]
        if rows:
            add_documents(self.store, self.spark.createDataFrame(rows, DOCUMENT), self.config)
        return len(rows)


def item(r) -> dict:
    return {"text": r.text, "score": r.score, "distance": 1 - r.score, "doc_id": r.doc_id, "source": r.source, "metadata": r.metadata or {}}


class Bucket:
    """`rate` requests a second, up to as many at once; 0 lets all pass."""

    def __init__(self, rate: int, now=time.monotonic):
        self.rate, self.now, self.lock = rate, now, threading.Lock()
        self.left, self.at = float(rate), now()

    def take(self) -> bool:
        with self.lock:
            now = self.now()
            self.left, self.at = min(float(self.rate), self.left + (now - self.at) * self.rate), now
            if self.rate and self.left < 1:
                return False
            self.left -= 1
            return True


class Counters:
    """Requests and seconds by route, in the text format of common collectors."""

    def __init__(self):
        self.lock, self.held = threading.Lock(), {}

    def add(self, route: str, status: int, seconds: float) -> None:
        with self.lock:
            n, total = self.held.get((route, status), (0, 0.0))
            self.held[route, status] = n + 1, total + seconds

    def text(self, chunks: int) -> str:
        with self.lock:
            rows = sorted(self.held.items())
        lines = ["# TYPE corbel_requests_total counter", *[f'corbel_requests_total{{route="{r}",status="{s}"}} {n}' for (r, s), (n, _) in rows]]
        lines += ["# TYPE corbel_request_seconds_total counter", *[f'corbel_request_seconds_total{{route="{r}",status="{s}"}} {t:.6f}' for (r, s), (_, t) in rows]]
        return "\n".join([*lines, "# TYPE corbel_chunks gauge", f"corbel_chunks {chunks}", ""])


def server(spark: SparkSession, config: Config, host: str | None = None, port: int | None = None, own: Generator | None = None) -> ThreadingHTTPServer:
    """A server that isn't started yet, by default at the configured address. With config.api_key all but OPEN, and
    /stats with public_stats, need it as bearer token."""
    engine, counters = Engine(spark, config, own), Counters()

    class Handler(BaseHTTPRequestHandler):
        timeout = config.request_timeout
        bucket = Bucket(config.rate_limit)

        def head(self, status: int, kind: str, length: int | None = None) -> None:
            self.status = status
            self.send_response(status)
            self.send_header("Content-Type", kind)
            origin, allowed = self.headers.get("Origin"), [x.strip() for x in config.cors_origins.split(",") if x.strip()]
            if origin and ("*" in allowed or origin in allowed):
                self.send_header("Access-Control-Allow-Origin", "*" if "*" in allowed else origin)
                self.send_header("Access-Control-Allow-Headers", "Authorization, Content-Type")
                self.send_header("Access-Control-Allow-Methods", "GET, POST, DELETE, OPTIONS")
            if length is None:
                self.send_header("Connection", "close")
            else:
                self.send_header("Content-Length", str(length))
            self.end_headers()

        def answer(self, status: int, value, kind: str = "application/json") -> None:
            body = value.encode() if isinstance(value, str) else json.dumps(value, ensure_ascii=False).encode()
            self.head(status, kind, len(body))
            self.wfile.write(body)

        def handle_route(self, method: str) -> None:
            begin, path, self.status = time.perf_counter(), self.path.split("?")[0], 0
            route = "/documents/{doc_id}" if path.startswith("/documents/") else path
            try:
                if ROUTES.get(route) != method:
                    return self.answer(404, {"error": "not found"})
                if not self.bucket.take():
                    return self.answer(429, {"error": "too many requests"})
                given = self.headers.get("Authorization", "").removeprefix("Bearer ")
                free = route in OPEN or (route == "/stats" and config.public_stats)
                if config.api_key and not free and not hmac.compare_digest(given.encode(), config.api_key.encode()):
                    return self.answer(401, {"error": "unauthorized"})
                try:
                    getattr(self, "on_" + route.split("/")[1].split(".")[0])()
                except (ConfigError, ValueError, TypeError) as e:
                    self.answer(400, {"error": str(e)})
                except EngineError as e:
                    self.answer(500, {"error": str(e)})
            finally:
                counters.add(route if route in ROUTES else "other", self.status, time.perf_counter() - begin)

        def do_GET(self) -> None:
            self.handle_route("get")

        def do_POST(self) -> None:
            self.handle_route("post")

        def do_DELETE(self) -> None:
            self.handle_route("delete")

        def do_OPTIONS(self) -> None:
            self.head(204, "text/plain", 0)

        def body(self) -> dict:
            n = int(self.headers.get("Content-Length", 0))
            if n > MOST_BODY:
                raise ConfigError("the body is too large")
            said = json.loads(self.rfile.read(n) or b"{}")
            if not isinstance(said, dict):
                raise ConfigError("the body is no object")
            return said

        def on_health(self) -> None:
            self.answer(200, {"status": "ok", "version": __version__})

        def on_ready(self) -> None:
            try:
                engine.store.metadata()
            except Exception:  # whatever the file system raises
                return self.answer(503, {"status": "unavailable", "checks": {"database": False}})
            self.answer(200, {"status": "ok", "checks": {"database": True}})

        def on_stats(self) -> None:
            self.answer(200, engine.store.metadata() | {"chunks": engine.store.count()})

        def on_collections(self) -> None:
            rows = engine.store.counts().orderBy("collection").toLocalIterator()
            self.answer(200, {"collections": [{"name": r.collection or "default", "chunks": r.chunks} for r in rows]})

        def on_metrics(self) -> None:
            self.answer(200, counters.text(engine.store.count()), "text/plain; version=0.0.4")

        def on_openapi(self) -> None:
            paths = {p: {m: {"summary": p.strip("/"), "responses": {"200": {"description": "ok"}}}} for p, m in ROUTES.items()}
            self.answer(200, {"openapi": "3.0.3", "info": {"title": "corbel", "version": __version__}, "paths": paths})

        def on_query(self) -> None:
            rows = engine.hits(self.body())
            self.answer(200, {"results": [item(r) for r in rows], "count": len(rows)})

        def on_prompt(self) -> None:
            text, rows = engine.prompt(self.body())
            self.answer(200, {"prompt": text, "sources": [r.source for r in rows]})

        def on_ask(self) -> None:
            said = self.body()
            text, rows = engine.prompt(said, 100)
            self.head(200, "text/event-stream")

            def event(kind: str, data: str) -> None:
                self.wfile.write("".join([f"event: {kind}\n", *[f"data: {x}\n" for x in data.split("\n")], "\n"]).encode())
                self.wfile.flush()

            for i, r in enumerate(rows):
                event("source", json.dumps({"index": i + 1, "source": r.source, "score": r.score, "text": r.text[:200]}, ensure_ascii=False))
            try:
                for part in engine.generator.generate([text])[0].splitlines(True):
                    event("token", part)
            except Exception as e:  # the answer has begun, so what fails is told in it
                event("error", f"generation failed: {e}")
            event("done", "{}")

        def on_index(self) -> None:
            n = engine.add(self.body().get("documents"))
            self.answer(200, {"indexed": n, "message": f"{n} documents"})

        def on_documents(self) -> None:
            engine.store.delete_document(unquote(self.path.removeprefix("/documents/")))
            self.answer(200, {"chunks": engine.store.count()})

        # The web socket

        def on_ws(self) -> None:
            key = self.headers.get("Sec-WebSocket-Key")
            if not key or self.headers.get("Upgrade", "").lower() != "websocket":
                return self.answer(426, {"error": "a web socket is asked for"})
            self.status = 101
            self.send_response(101)
            for name, value in (("Upgrade", "websocket"), ("Connection", "Upgrade"), ("Sec-WebSocket-Accept", base64.b64encode(hashlib.sha1(key.encode() + _SOCKET).digest()).decode())):
                self.send_header(name, value)
            self.end_headers()
            self.close_connection = True
            while (text := self.receive()) is not None:
                for said in self.socket_answers(text):
                    self.send_frame(1, json.dumps(said, ensure_ascii=False).encode())

        def socket_answers(self, text: str):
            try:
                said = json.loads(text)
                match said.get("type") if isinstance(said, dict) else None:
                    case "ping":
                        yield {"type": "pong"}
                    case "search":
                        rows = engine.hits(said, 100)
                        yield from ({"type": "result", "data": item(r)} for r in rows)
                        yield {"type": "done", "count": len(rows)}
                    case "prompt":
                        text, rows = engine.prompt(said, 100)
                        yield {"type": "prompt", "text": text, "sources": len(rows)}
                    case _:
                        raise ConfigError("type must be search, prompt or ping")
            except (EngineError, ValueError, TypeError) as e:
                yield {"type": "error", "message": str(e)}

        def send_frame(self, kind: int, data: bytes) -> None:
            n = len(data)
            size = bytes([n]) if n < 126 else struct.pack(">BH", 126, n) if n < 1 << 16 else struct.pack(">BQ", 127, n)
            self.wfile.write(bytes([0x80 | kind]) + size + data)
            self.wfile.flush()

        def receive(self) -> str | None:
            """The next text, of one frame or several; None at the end. Pings are answered."""
            held = b""
            while len(head := self.rfile.read(2)) == 2:
                n, kind = head[1] & 127, head[0] & 15
                if n > 125:
                    n = int.from_bytes(self.rfile.read(2 if n == 126 else 8), "big")
                if not head[1] & 128 or len(held) + n > MOST_BODY:  # clients must mask
                    return None
                mask, data = self.rfile.read(4), self.rfile.read(n)
                data = bytes(c ^ mask[i % 4] for i, c in enumerate(data))
                if kind == 8:
                    self.send_frame(8, data[:2])
                    return None
                if kind == 9:
                    self.send_frame(10, data)
                elif kind in (0, 1):
                    held += data
                    if head[0] & 128:
                        return held.decode(errors="replace")
            return None

        def log_message(self, *_) -> None:
            pass

    made = ThreadingHTTPServer((config.host if host is None else host, config.port if port is None else port), Handler)
    made.handler = Handler
    return made


def reload(made: ThreadingHTTPServer, path: str | None = None) -> Config:
    """Reads the settings again; the rate limit of a running server follows them."""
    config = load(path)
    made.handler.bucket = Bucket(config.rate_limit)
    return config
