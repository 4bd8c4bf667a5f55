import base64
import json
import os
import socket
import struct
import threading
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pytest

from corbel import cli, service
from corbel.config import Config
from corbel.plans.index import add_documents
from corbel.sources.store import Store
from corbel.tools import Tools, serve


@pytest.fixture(scope="module")
def conf(spark, tmp_path_factory):
    conf = Config(db=str(tmp_path_factory.mktemp("ix") / "ix"), dimension=16, api_key="k", port=0, cors_origins="http://a.example")
    docs = spark.createDataFrame([("1", "Rust is fast", {"lang": "en", "collection": "langs"}), ("2", "Python is slow", {"lang": "en"})], "id string, text string, metadata map<string,string>")
    add_documents(Store(spark, conf.db), docs, conf)
    return conf


@pytest.fixture(scope="module")
def running(spark, conf):
    s = service.server(spark, conf)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def ask(s, path, body=None, method=None, key="k", **head):
    data = None if body is None else json.dumps(body).encode()
    return urlopen(Request(f"http://127.0.0.1:{s.server_port}{path}", data, {"Authorization": f"Bearer {key}"} | head, method=method))


def call(*args, **more):
    with ask(*args, **more) as r:
        return json.load(r)


def test_service(running):
    s = running
    assert call(s, "/health", key="")["status"] == "ok" and call(s, "/ready", key="")["checks"] == {"database": True} and call(s, "/stats")["chunks"] == 2
    got = call(s, "/query", {"query": "Rust is fast", "top_k": 1})
    assert [r["doc_id"] for r in got["results"]] == ["1"] and got["results"][0]["score"] > 0.999 and got["count"] == 1
    said = call(s, "/prompt", {"query": "Rust", "hybrid": True, "alpha": 0.2})
    assert "Rust is fast" in said["prompt"] and len(said["sources"]) == 2
    for args, code in ((("/query", {"query": " "}), 400), (("/query", {}), 400), (("/index", {"documents": [{}]}), 400), (("/nothing",), 404), (("/query",), 404), (("/ws",), 426)):
        with pytest.raises(HTTPError) as e:
            call(s, *args)
        assert e.value.code == code
    with pytest.raises(HTTPError) as e:
        call(s, "/stats", key="bad")
    assert e.value.code == 401
    assert call(s, "/collections")["collections"] == [{"name": "default", "chunks": 1}, {"name": "langs", "chunks": 1}]
    assert set(call(s, "/openapi.json", key="")["paths"]) == set(service.ROUTES)
    with ask(s, "/health", Origin="http://a.example") as r:
        assert r.headers["Access-Control-Allow-Origin"] == "http://a.example"
    with ask(s, "/health", Origin="http://b.example") as r:
        assert r.headers["Access-Control-Allow-Origin"] is None
    with ask(s, "/ask", {"query": "Rust is fast", "top_k": 1}) as r:
        events = [x.split("\n") for x in r.read().decode().strip().split("\n\n")]
    assert [e[0] for e in events] == ["event: source", "event: token", "event: done"] and json.loads(events[0][1][6:])["source"] == "1"
    with ask(s, "/metrics") as r:
        text = r.read().decode()
    assert 'corbel_requests_total{route="/query",status="200"} 1' in text and "corbel_chunks 2" in text
    assert call(s, "/index", {"documents": [{"id": "3", "text": "Go is simple", "metadata": {"lang": "en"}}]})["indexed"] == 1
    assert call(s, "/documents/3", method="DELETE") == {"chunks": 2}


def test_web_socket(running):
    with socket.create_connection(("127.0.0.1", running.server_port), timeout=60) as c:
        c.sendall(f"GET /ws HTTP/1.1\r\nHost: x\r\nAuthorization: Bearer k\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {base64.b64encode(os.urandom(16)).decode()}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
        f = c.makefile("rb")
        assert b"101" in f.readline()
        while f.readline().strip():
            pass

        def send(said):
            data, mask = json.dumps(said).encode(), b"abcd"
            c.sendall(bytes([0x81, 0x80 | len(data)]) + mask + bytes(x ^ mask[i % 4] for i, x in enumerate(data)))

        def receive():
            head = f.read(2)
            n = head[1] if head[1] < 126 else struct.unpack(">H", f.read(2))[0]
            return json.loads(f.read(n))

        send({"type": "ping"})
        assert receive() == {"type": "pong"}
        send({"type": "search", "query": "Rust is fast", "top_k": 1})
        assert receive()["data"]["doc_id"] == "1" and receive() == {"type": "done", "count": 1}
        send({"type": "prompt", "query": "Rust is fast", "top_k": 1})
        assert receive()["sources"] == 1
        send({"type": "other"})
        assert receive()["type"] == "error"


def test_rate_limit():
    now = [0.0]
    b = service.Bucket(2, lambda: now[0])
    assert [b.take() for _ in range(3)] == [True, True, False]
    now[0] = 0.5
    assert b.take() and not b.take() and all(service.Bucket(0).take() for _ in range(9))


def test_tools(spark, conf):
    engine, said = service.Engine(spark, conf), []
    lines = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "Rust is fast", "top_k": 1}}},
        {"id": 4, "method": "tools/call", "params": {"name": "get_prompt", "arguments": {"query": "Rust"}}}, {"id": 5, "method": "tools/call", "params": {"name": "collection_info"}}, {"id": 6, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "x", "top_k": 0}}},
        {"id": 7, "method": "resources/list"}, {"id": 8, "method": "resources/read", "params": {"uri": "corbel://index/stats"}}, {"id": 9, "method": "prompts/list"}, {"id": 10, "method": "prompts/get", "params": {"name": "answer", "arguments": {"question": "Rust?"}}}, {"id": 11, "method": "nothing"},
        {"id": 12, "method": "tools/call", "params": {"name": "index_documents", "arguments": {"documents": []}}},
    ]
    serve(Tools(engine), [json.dumps(x) for x in lines] + ["not json", ""], lambda x: said.append(json.loads(x)))
    by = {r["id"]: r for r in said}
    assert set(by) == {*range(1, 13), None} and len(by[2]["result"]["tools"]) == 4 and by[1]["result"]["serverInfo"]["name"] == "corbel"
    assert json.loads(by[3]["result"]["content"][0]["text"])[0]["text"] == "Rust is fast" and "Context:" in by[4]["result"]["content"][0]["text"]
    assert by[5]["result"]["content"][0]["text"] == "Index contains 2 chunks" and by[6]["error"]["code"] == -32602 and by[11]["error"]["code"] == -32601 and by[12]["error"]["code"] == -32602
    assert json.loads(by[8]["result"]["contents"][0]["text"])["chunks"] == 2 and len(by[9]["result"]["prompts"]) == 2 and "Rust?" in by[10]["result"]["messages"][0]["content"]["text"]
    assert Tools(engine, ["search"]).handle({"id": 1, "method": "tools/call", "params": {"name": "collection_info"}})["error"]["code"] == -32602


def test_commands(spark, conf, tmp_path):
    said = []
    run = lambda *a: cli.run(spark, cli.parser().parse_args(list(a)), conf, said.append)
    run("status"), run("doctor"), run("collections"), run("query", "Rust is fast", "--explain", "--hybrid", "--k", "1"), run("ask", "Rust", "--k", "1"), run("completions", "bash")
    run("graph-build", str(tmp_path / "g")), run("graph-query", str(tmp_path / "g"), "about rust"), run("init", str(tmp_path / "c.toml")), run("compact")
    assert json.loads(said[0])["database"]["chunks"] == 2 and said[1].startswith("index: ok, 2 chunks") and "langs 1" in said
    assert any('"v_rank": 1' in x for x in said) and any("complete -W" in x for x in said) and any(x.startswith("1.000000 ") for x in said)
    with pytest.raises(Exception, match="there already"):
        run("init", str(tmp_path / "c.toml"))
    from corbel.config import load

    assert load(str(tmp_path / "c.toml"), {}) == Config()
