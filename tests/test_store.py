import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corbel.config import Config
from corbel.functions.embedding import DummyEmbedder, EmbeddingCache, HttpEmbedder, embed_column
from corbel.functions.generation import EchoGenerator, HttpGenerator, answers
from corbel.functions.vectors import cosine, decode, encode
from corbel.operators import ann, bm25, graph, search
from corbel.plans import index
from corbel.schema import CHUNK, StoreError
from corbel.sources import store
from corbel.sources.store import MemoryStore, Store

SMALL = "/root/testdata/sf0.001"


def chunks(spark, *rows):
    return spark.createDataFrame([(c, d, d, 0, t, {"lang": x, "collection": x}, v) for c, d, t, x, v in rows], CHUNK)


def counting(dimension, path):
    """An embedder that writes a line for each text that it embeds."""

    class Counting(DummyEmbedder):
        def __init__(self):
            DummyEmbedder.__init__(self, dimension)
            self.path = path

        def embed(self, texts):
            with open(self.path, "a") as f:
                f.writelines("x\n" for _ in texts)
            return DummyEmbedder.embed(self, texts)

    return Counting()


def seen(path):
    return len(Path(path).read_text().splitlines()) if Path(path).exists() else 0


def test_each_text_is_embedded_once(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"text {i % 8}", {}) for i in range(10)], "id string, text string, metadata map<string,string>")
    own, conf = counting(8, str(tmp_path / "n")), Config(dimension=8)
    s = Store(spark, str(tmp_path / "ix"))
    s.add(index.chunk(docs, conf, own), own.model)
    assert s.count() == 10 and seen(own.path) == 10
    cached = Config(dimension=8, embed_cache=str(tmp_path / "cache"))
    own.path = str(tmp_path / "m")
    for _ in range(2):
        assert index.chunk(docs, cached, own).count() == 10 and seen(own.path) == 8
    rows = EmbeddingCache(spark, cached.embed_cache).embed(docs, own)
    assert rows.filter("embedding is null").count() == 0 and seen(own.path) == 8


def files_of(root):
    return {str(p.relative_to(root)) for p in Path(root).rglob("*.parquet")}


def test_a_write_adds_files_and_rewrites_none(spark, tmp_path):
    s = Store(spark, str(tmp_path / "ix"))
    s.add(chunks(spark, *[(f"c{i}", f"d{i}", f"word{i} other", "en", [1.0, float(i)]) for i in range(50)]))
    before = files_of(s.root)
    s.add(chunks(spark, ("c7", "d7", "changed", "fr", [1.0, 7.0])))
    assert before < files_of(s.root)
    new = s._entry()["chunks"][-1]
    assert new["rows"] == 1 and new["gone"] and spark.read.parquet(f"{s.root}/data/{new['at']}/chunks").count() == 1
    assert s.count() == 50 and s.get("d7").first().text == "changed" and {r.term for r in s.table("postings").filter("chunk_id = 'c7'").collect()} == {"changed"}
    assert {(r.collection, r.chunks) for r in s.counts().collect()} == {("en", 49), ("fr", 1)}


def test_many_writes_equal_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_SEGMENTS", 4)
    monkeypatch.setattr(store, "FEW", 2)  # both ways of looking keys up
    rng, s, want = np.random.default_rng(3), Store(spark, str(tmp_path / "ix")), {}
    for n in range(9):
        if n % 3 == 2:
            gone = {f"d{i}" for i in rng.integers(0, 12, 3)}
            s.delete(spark.createDataFrame([(x,) for x in gone], "doc_id string"))
            want = {k: v for k, v in want.items() if k.replace("c", "d") not in gone}
        else:
            new = {f"c{i}": f"text{n} c{i}" for i in rng.integers(0, 12, 4)}
            s.add(chunks(spark, *[(k, k.replace("c", "d"), t, "en", [1.0, 2.0]) for k, t in new.items()]))
            want |= new
        assert {r.chunk_id: r.text for r in s.all().collect()} == want
    assert len(s._entry()["chunks"]) <= 5 and {r.chunk_id for r in s.table("postings").collect()} == set(want)
    s.compact()
    assert len(s._entry()["chunks"]) == 1 and {r.chunk_id: r.text for r in s.all().collect()} == want and s.table("postings").count() == 2 * len(want)


def test_one_of_two_writers_wins(spark, tmp_path):
    s = Store(spark, str(tmp_path / "ix"))
    s.add(chunks(spark, ("c1", "d1", "a b", "en", [1.0, 0.0])))
    entry = s._entry()
    s.add(chunks(spark, ("c2", "d2", "c d", "en", [1.0, 0.0])))
    with pytest.raises(StoreError, match="another writer"):
        s._commit(entry)
    assert s.count() == 2


def test_clear_leaves_other_files(spark, tmp_path):
    s = Store(spark, str(tmp_path / "ix"))
    s.add(chunks(spark, ("c1", "d1", "a", "en", [1.0, 0.0]), ("c1", "d1", "a", "en", [1.0, 0.0])))
    (tmp_path / "ix" / "mine.txt").write_text("x")
    assert s.count() == 1
    s.clear()
    assert s.count() == 0 and (tmp_path / "ix" / "mine.txt").exists()
    s.add(chunks(spark, ("c1", "d1", "a", "en", [1.0, 0.0, 2.0])))
    assert s.count() == 1 and s.metadata()["dimension"] == 3


def test_memory_store(spark):
    s = MemoryStore(spark)
    s.add(chunks(spark, ("c1", "d1", "a", "en", [1.0, 0.0]), ("c1", "d1", "a", "en", [1.0, 0.0])))
    assert s.count() == 2 and s.find({"lang": "en"}).count() == 2 and s.table("postings").count() == 0
    s.delete_document("d1")
    assert s.count() == 0 and s.table("fingerprints").count() == 0


def test_knn_of_any_ids_and_dimensions(spark):
    rows = [("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("long", [1.0, 0.0, 5.0]), ("none", None)]
    base = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("b", [1.0, 0.0])], "query_id string, embedding array<float>")
    got = {(r.query_id, r.chunk_id): r.score for r in search.knn_join(asked, base, 9).collect()}
    want = asked.crossJoin(base.filter("embedding is not null").withColumnRenamed("embedding", "e")).select("query_id", "chunk_id", cosine(F.col("embedding"), F.col("e")).alias("s")).collect()
    assert got == pytest.approx({(r.query_id, r.chunk_id): r.s for r in want})
    near = search.knn_join(asked, base, 2, others=True).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in near] == [("b", "a"), ("b", "long"), ("q", "a"), ("q", "b")]


def test_failing_collection_is_left_out(spark, tmp_path):
    good = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.7)], "query_id int, chunk_id string, score double")
    bad = good.withColumn("chunk_id", F.when(F.col("score") > 0, F.raise_error(F.lit("unreadable"))).cast("string"))
    rows, failed = search.route({"good": good, "bad": bad, "none": lambda: spark.read.parquet(str(tmp_path / "none"))}, 5)
    assert [(r.chunk_id, r.collection) for r in rows.orderBy("rank").collect()] == [("b", "good"), ("a", "good")] and len(failed) == 2


def test_bm25_ways_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    asked = spark.read.parquet(f"{SMALL}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    rows = lambda df: sorted((r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in df.collect())
    want = rows(bm25.search(docs, asked, 5))
    post = bm25.postings(docs).cache()
    assert rows(bm25.search(docs, asked, 5, index=post)) == want
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 3)
    monkeypatch.setattr(bm25, "CELLS", 500)
    assert rows(bm25.search(docs, asked, 5)) == want
    monkeypatch.setattr(bm25, "MOST_SENT", 10)
    assert rows(bm25.search(docs, asked, 5)) == want and rows(bm25.search(docs, asked, 5, index=post)) == want
    none = spark.createDataFrame([(0, ""), (1, None)], "query_id int, text string")
    assert bm25.search(docs, none, 5).count() == 0 and bm25.search(docs.limit(0), asked, 5).count() == 0


def test_inverted_file_recall(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    centroids = ann.fit(rows)
    held = ann.assign(rows, centroids)
    asked = rows.withColumnRenamed("chunk_id", "query_id")
    want = {(r.query_id, r.chunk_id) for r in search.knn_join(asked, rows, 10, others=True).collect()}
    got = {(r.query_id, r.chunk_id) for r in ann.search(asked, held, centroids, 10, others=True).collect()}
    assert held.count() == rows.count() and len(got & want) >= 0.9 * len(want)
    every = {(r.query_id, r.chunk_id) for r in ann.search(asked, held, centroids, 10, 64, others=True).collect()}
    assert every == want
    ann.save(rows, str(tmp_path / "v"))
    again = ann.search(asked, *ann.load(spark, str(tmp_path / "v")), 10, others=True).collect()
    assert {(r.query_id, r.chunk_id) for r in again} == got


def test_graph_is_saved_and_asked(spark, tmp_path):
    docs = spark.createDataFrame([("1", "We use Rust with SQLite support."), ("2", "All rapid work on SQLite"), ("3", None)], "chunk_id string, text string")
    graph.save(graph.entities(docs), str(tmp_path / "g"))
    assert graph.counts(spark, str(tmp_path / "g")) == {"entities": 3, "edges": 2, "mentions": 4}
    _, edges, found = graph.load(spark, str(tmp_path / "g"))
    hits = graph.search(edges, found, spark.createDataFrame([(5, "who uses Rust?"), (6, "nothing")], "query_id int, text string")).collect()
    assert [(r.query_id, r.chunk_id, r.score) for r in hits] == [(5, "1", 1.0), (5, "2", 0.5)]


def test_rerank_by_a_model(spark):
    hits = spark.createDataFrame([(0, "a", "q", "xx", 0.9, 1), (0, "b", "q", "xxxx", 0.8, 2)], "query_id int, chunk_id string, query string, text string, score double, rank int")
    got = search.rerank_model(hits, lambda q, t: [[0.0, float(len(x))] for x in t]).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a"] and got[0].score == pytest.approx(1 / (1 + np.exp(-4.0)))


@pytest.fixture
def service():
    """Answers embedding and chat requests; the first request of each kind fails."""
    told = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            told.append((said, self.headers.get("Authorization")))
            if len(told) == 1:
                self.send_response(503)
                self.end_headers()
                return
            body = {"data": [{"embedding": [float(len(t)), 1.0]} for t in said["input"]]} if "input" in said else {"choices": [{"message": {"content": said["messages"][0]["content"].upper()}}]}
            data = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", told
    s.shutdown()


def test_model_services(spark, service):
    url, told = service
    rows = embed_column(spark.createDataFrame([("ab",), (None,), ("abc",)], "text string").coalesce(1), HttpEmbedder(url, "m", 2, "k", 1))
    assert [r.embedding for r in rows.collect()] == [[2.0, 1.0], None, [3.0, 1.0]]
    assert told[0] == ({"model": "m", "input": ["ab"]}, "Bearer k") and len(told) == 3
    prompts = spark.createDataFrame([(0, "line\nend")], "query_id int, prompt string")
    assert answers(prompts, HttpGenerator(url, "m")).first().answer == "LINE\nEND" and answers(prompts, EchoGenerator()).first().answer == "end"


def test_ask(spark, tmp_path):
    s, conf = Store(spark, str(tmp_path / "ix")), Config(dimension=16)
    docs = spark.createDataFrame([("1", "Rust is fast", {"lang": "en"}), ("2", "Go is simple", {})], "id string, text string, metadata map<string,string>")
    index.add_documents(s, docs, conf)
    r = index.ask(spark, s, "Rust is fast", conf, hybrid=True, k=1).first()
    assert "Rust is fast" in r.prompt and r.answer == "Answer the query using the provided context."
    got = index.find(spark, s, "go simple", conf, k=1, reranker=search.rerank_keyword).collect()
    assert [(x.doc_id, x.score) for x in got] == [("2", 1.0)]


def test_half_precision_cuts_the_mantissa():
    v = np.array([0.25, -0.7, 1.9997559, 65504, 7e4, -7e4, 3e-5, 0, 1 / 3], dtype=np.float32)
    got = decode(encode(v, "f16"), "f16")
    bits = v.view(np.uint32)
    cut = (bits & 0xFFFFE000).view(np.float32)  # 10 bits of the mantissa, without rounding
    inside = (np.abs(v) >= 2.0**-14) & (np.abs(v) < 65536)
    assert np.array_equal(got[inside], cut[inside]) and np.isinf(got[4:6]).all() and got[5] < 0 and got[6] == 0
