"""The index as tools for language models: JSON-RPC 2.0, one message a line, by the Model Context Protocol."""

import json
import sys

from . import __version__
from .config import query_text
from .schema import ConfigError, EngineError
from .service import Engine

PROTOCOL = "2024-11-05"
STATS = "corbel://index/stats"
MOST_K, MOST_DOCUMENTS = 100, 100
METHOD, PARAMS, INTERNAL = -32601, -32602, -32603


def _schema(required: list[str] = (), **properties) -> dict:
    return {"type": "object", "additionalProperties": False, "properties": properties} | ({"required": list(required)} if required else {})


_QUERY = {"type": "string", "minLength": 1, "maxLength": 10_000}
_K = {"type": "integer", "minimum": 1, "maximum": MOST_K}
TOOLS = [
    {"name": "search", "description": "Chunks of the index that are nearest to a query", "inputSchema": _schema(["query"], query=_QUERY, top_k=_K | {"default": 5})},
    {"name": "get_prompt", "description": "A prompt with the chunks nearest to a question as its context", "inputSchema": _schema(["query"], query=_QUERY, top_k=_K | {"default": 3})},
    {"name": "collection_info", "description": "How many chunks the index has, and of which model", "inputSchema": _schema()},
    {
        "name": "index_documents", "description": "Adds documents to the index",
        "inputSchema": _schema(["documents"], documents={"type": "array", "minItems": 1, "maxItems": MOST_DOCUMENTS, "items": _schema(["text"], text={"type": "string", "minLength": 1}, metadata={"type": "object", "additionalProperties": {"type": "string"}})}),
    },
]
PROMPTS = [
    {"name": "answer", "description": "Answer a question from the index", "arguments": [{"name": "question", "required": True}]},
    {"name": "summarize", "description": "Summarise what the index has on a topic", "arguments": [{"name": "topic", "required": True}]},
]


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Tools:
    """Answers requests; `allowed` names the tools that are offered, all by default."""

    def __init__(self, engine: Engine, allowed: list[str] | None = None):
        self.engine = engine
        self.tools = [t for t in TOOLS if allowed is None or t["name"] in allowed]

    def handle(self, request: dict) -> dict | None:
        """The response to a request; None for a notification."""
        name, params = request.get("method"), request.get("params") or {}
        if not isinstance(name, str) or name.startswith("notifications/") or "id" not in request:
            return None
        try:
            work = {
                "initialize": lambda p: {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}, "prompts": {}}, "serverInfo": {"name": "corbel", "version": __version__}},
                "tools/list": lambda p: {"tools": self.tools}, "tools/call": self.call, "resources/list": self.resources, "resources/read": self.read, "prompts/list": lambda p: {"prompts": PROMPTS}, "prompts/get": self.prompt,
            }.get(name)
            if work is None:
                raise RpcError(METHOD, f"method not found: {name}")
            return {"jsonrpc": "2.0", "id": request["id"], "result": work(params)}
        except RpcError as e:
            code, message = e.code, str(e)
        except (ConfigError, ValueError, TypeError, KeyError, AttributeError) as e:
            code, message = PARAMS, str(e)
        except EngineError as e:
            code, message = INTERNAL, str(e)
        return {"jsonrpc": "2.0", "id": request["id"], "error": {"code": code, "message": message}}

    def asked(self, given: dict, otherwise: int) -> dict:
        k = given.get("top_k", otherwise)
        if not isinstance(k, int) or not 1 <= k <= MOST_K:
            raise RpcError(PARAMS, f"top_k must be from 1 to {MOST_K}")
        return {"query": query_text(given.get("query", ""), self.engine.config), "top_k": k}

    def call(self, params: dict) -> dict:
        name, given = params.get("name"), params.get("arguments") or {}
        if name not in {t["name"] for t in self.tools}:
            raise RpcError(PARAMS, f"unknown tool: {name}")
        if name == "search":
            text = json.dumps([{"text": r.text, "score": r.score, "source": r.source} for r in self.engine.hits(self.asked(given, 5))], ensure_ascii=False, indent=2)
        elif name == "get_prompt":
            text = self.engine.prompt(self.asked(given, 3))[0]
        elif name == "collection_info":
            text = f"Index contains {self.engine.store.count()} chunks"
        else:
            documents = given.get("documents")
            if not isinstance(documents, list) or not 1 <= len(documents) <= MOST_DOCUMENTS:
                raise RpcError(PARAMS, f"documents must be 1 to {MOST_DOCUMENTS}")
            text = f"Indexed {self.engine.add(documents)} documents"
        return {"content": [{"type": "text", "text": text}]}

    def resources(self, params: dict) -> dict:
        return {"resources": [{"uri": STATS, "name": "Index statistics", "mimeType": "application/json"}]}

    def read(self, params: dict) -> dict:
        if params.get("uri") != STATS:
            raise RpcError(PARAMS, f"unknown resource: {params.get('uri')}")
        stats = self.engine.store.metadata() | {"chunks": self.engine.store.count()}
        return {"contents": [{"uri": STATS, "mimeType": "application/json", "text": json.dumps(stats)}]}

    def prompt(self, params: dict) -> dict:
        given = params.get("arguments") or {}
        match params.get("name"):
            case "answer":
                text = self.engine.prompt(self.asked({"query": given.get("question", "")}, 5))[0]
            case "summarize":
                text = "Summarize the following.\n\n" + self.engine.prompt(self.asked({"query": given.get("topic", "")}, 10))[0]
            case name:
                raise RpcError(PARAMS, f"unknown prompt: {name}")
        return {"messages": [{"role": "user", "content": {"type": "text", "text": text}}]}


def serve(tools: Tools, lines=None, say=None) -> None:
    """Answers requests, one a line, until the input ends."""
    say = say or (lambda x: print(x, flush=True))
    for line in lines or sys.stdin:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError as e:
            say(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}))
            continue
        answer = tools.handle(request) if isinstance(request, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "invalid request"}}
        if answer is not None:
            say(json.dumps(answer, ensure_ascii=False))
