import datetime
import json
import math
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from corbel import cli
from corbel.config import Config
from corbel.operators import bm25, evaluation, graph, search
from corbel.plans.index import add_documents, find, indexer
from corbel.schema import CHUNK, StoreError
from corbel.sources import loaders
from corbel.sources.store import Store, diff, export_documents
from corbel.streaming.watch import event_windows, sync_folder, watch


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.md": "---\ntitle: 'My Doc'\nformat: own\nempty:\n---\n\n# Hello\n\nContent here.", "b.csv": "name, age\nAlice,30\nBob,25,extra\n", "c.json": '{"key": "é", "b": [1]}', "d.jsonl": '{"b":1,"a":2}\n\nnot json\n',
        "e.html": "<html><head><style>p {}</style></head><body><h2>Head</h2>\n<p>Some <b>words</b></p><script>f(1)</script></body></html>", "f.txt": "plain\n", "sub/g.TXT": "deep", "h.csv": "only\n", "i.own": "x",
    }
    for name, text in files.items():
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "in/bad.txt").write_bytes(b"\xff\xfe\xfa")
    with zipfile.ZipFile(tmp_path / "in/j.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{loaders._W[1:-1]}"><w:body><w:p><w:r><w:t>Grüße</w:t></w:r><w:r><w:tab/><w:t> dort</w:t></w:r></w:p></w:body></w:document>')
    return tmp_path / "in"


def test_loaders(spark, folder):
    loaders.register_loader("own", lambda content, path: content.decode().upper() * 2)
    files = loaders.scan(spark, str(folder))
    got = {r.metadata["filename"]: r for r in loaders.load(files).collect()}
    text = {k: r.text for k, r in got.items()}
    assert text["a.md"].startswith("# Hello") and got["a.md"].metadata["title"] == "My Doc" and got["a.md"].metadata["format"] == "own" and "empty" not in got["a.md"].metadata
    assert text["b.csv"] == "name: Alice, age: 30\nname: Bob, age: 25" and got["b.csv"].metadata["rows"] == "2" and text["h.csv"] == "only\n"
    assert text["c.json"] == '{\n  "b": [\n    1\n  ],\n  "key": "é"\n}' and text["d.jsonl"] == '{\n  "a": 2,\n  "b": 1\n}\n---\nnot json' and got["d.jsonl"].metadata["records"] == "2"
    assert text["e.html"] == "Head Some words" and text["g.TXT"] == "deep" and text["i.own"] == "XX" and text["j.docx"] == "Grüße dort"
    assert [r.path.rsplit("/")[-1] for r in loaders.failures(files).collect()] == ["bad.txt"]
    assert loaders.scan(spark, str(folder), ["txt", ".MD"]).count() == 4


def test_jsonl(spark, tmp_path):
    lines = ['{"id":"1","text":"a","metadata":{"s":"t"}}', "not json", '{"id":"2","text":"","metadata":{}}', '{"id":"3","text":"b"}', ""]
    docs = loaders.parse_jsonl(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [tuple(r) for r in docs.collect()] == [("1", "a", {"s": "t"})]
    loaders.write_jsonl(docs, str(tmp_path / "out"))
    assert loaders.read_jsonl(spark, str(tmp_path / "out")).collect() == docs.collect()


def chunks(spark, *rows):
    return spark.createDataFrame([(c, d, d, 0, t, {"lang": x}, v) for c, d, t, x, v in rows], CHUNK)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "ix"))
    s.add(chunks(spark, ("c1", "d1", "rust is fast", "en", [1.0, 0.0]), ("c2", "d2", "python", "fr", [0.0, 1.0])), "m")
    s.add(chunks(spark, ("c2", "d2", "python two", "fr", [0.0, 1.0]), ("c3", "d3", "go", "en", [0.5, 0.5])))
    assert s.count() == 3 and s.get("d2").first().text == "python two" and s.find({"lang": "en"}).count() == 2
    assert s.table("postings").filter("chunk_id = 'c2'").count() == 2
    for bad in (("c9", "d9", "x", "en", [1.0]), ("c9", "d9", "x", "en", None)):
        with pytest.raises(StoreError):
            s.add(chunks(spark, bad))
    with pytest.raises(StoreError):
        s.add(chunks(spark, ("c9", "d9", "x", "en", [1.0, 1.0])), "other")
    s.backup(str(tmp_path / "copy"))
    s.delete_document("d1")
    assert s.count() == 2 and s.table("postings").filter("chunk_id = 'c1'").count() == 0 and Store(spark, str(tmp_path / "copy")).count() == 3
    assert export_documents(s).filter("id = 'd2'").first().metadata == {"lang": "fr", "chunk_id": "c2"}
    s.clear()
    assert s.count() == 0 and s.metadata() == {"schema_version": 1} and s.migrate() == 1 and s.metadata()["schema_version"] == 2


def test_folder_sync(spark, folder, tmp_path):
    s, conf = Store(spark, str(tmp_path / "ix")), Config(dimension=8)
    assert sync_folder(s, str(folder), indexer(conf), ["txt"], 0) == {"new": 3}
    assert sync_folder(s, str(folder), indexer(conf), ["txt"], 0) == {}
    (folder / "f.txt").write_text("changed")
    os.remove(folder / "sub/g.TXT")
    assert sync_folder(s, str(folder), indexer(conf), ["txt"], 60) == {"deleted": 1}  # the change hasn't settled
    assert sync_folder(s, str(folder), indexer(conf), ["txt"], 0) == {"modified": 1}
    assert [r.text for r in s.all().collect()] == ["changed"]


def test_watched_folder(spark, folder, tmp_path):
    s, conf = Store(spark, str(tmp_path / "ix")), Config(dimension=8)
    q = watch(spark, s, str(folder), indexer(conf), ["txt"], 0, "1 second", str(tmp_path / "state"), "dummy-8")

    def until(ready):
        for _ in range(120):
            if q.exception():
                raise q.exception()
            if ready():
                return True
            time.sleep(0.5)
        return False

    try:
        assert until(lambda: s.count() == 2)
        (folder / "f.txt").write_text("changed")
        os.remove(folder / "sub/g.TXT")
        assert until(lambda: [r.text for r in s.all().collect()] == ["changed"])
    finally:
        q.stop()


def test_diff(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    b = spark.createDataFrame([("b", "2"), ("c", "4"), ("d", "5")], "path string, content_hash string")
    assert {tuple(r) for r in diff(a, b).collect()} == {("a", "new"), ("c", "modified"), ("d", "deleted")}


def test_search_of_documents(spark, tmp_path):
    s, conf = Store(spark, str(tmp_path / "ix")), Config(db=str(tmp_path / "ix"), dimension=16)
    docs = spark.createDataFrame([("1", "Rust programming is fast and memory safe", {"lang": "en"}), ("2", "Python is great for machine learning", {"lang": "en"}), ("3", "JavaScript runs in the browser", {"lang": "fr"})], "id string, text string, metadata map<string,string>")
    add_documents(s, docs, conf)
    hits = find(spark, s, "Rust programming", conf, hybrid=True, k=3).orderBy("rank").collect()
    assert len(hits) == 3 and find(spark, s, "Rust", conf, filters={"lang": "fr"}).count() == 1
    best = bm25.search(s.all(), spark.createDataFrame([(0, "Rust programming")], "query_id int, text string"), 3, "chunk_id").join(s.all(), "chunk_id").collect()
    assert [r.doc_id for r in best] == ["1"]
    exact = find(spark, s, "JavaScript runs in the browser", conf, k=1).first()
    assert exact.doc_id == "3" and exact.score > 0.999
    said = []
    run = lambda *a: cli.run(spark, cli.parser().parse_args(list(a)), conf, said.append)
    run("info"), run("query", "Rust", "--hybrid"), run("prompt", "Rust", "--filter", "lang=en", "--template", "{query}|{sources}"), run("graph", "rust", "--hops", "1"), run("export", str(tmp_path / "j")), run("clear"), run("import", str(tmp_path / "j")), run("benchmark", "x", "--times", "1")
    assert json.loads(said[0])["chunks"] == 3 and any(x.startswith("Rust|") for x in said) and "0 rust" in said and s.count() == 3


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id string, score double, rank int")


def test_fusion(spark):
    v, b = ranked(spark, [(0, "d1", 0.9, 1), (0, "d2", 0.8, 2)]), ranked(spark, [(0, "d2", 5.0, 1), (0, "d3", 4.0, 2)])
    got = search.rrf(v, b, 10, 0.5).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["d2", "d1", "d3"] and abs(got[0].score - (0.5 / 62 + 0.5 / 61)) < 1e-12
    assert [r.chunk_id for r in search.rrf(v, b, 1, 1.0).collect()] == ["d1"] and [r.chunk_id for r in search.rrf(v, b, 1, 0.0).collect()] == ["d2"]


def test_merge_of_variants(spark):
    hits = spark.createDataFrame([(0, 0, "a", 0.9, 1), (0, 0, "b", 0.5, 2), (0, 1, "b", 0.95, 1), (0, 1, "c", 0.2, 2)], "query_id int, variant int, chunk_id string, score double, rank int")
    got = {r.chunk_id: r.score for r in search.merge_variants(hits, spark.createDataFrame([(0, 2)], "query_id int, n_variants int")).collect()}
    assert got == pytest.approx({"a": 0.91, "b": 0.95, "c": 0.205})


@pytest.mark.parametrize(
    "results,relevant,k,want",
    [("abc", "a", 3, (1, 1, 1 / 3, 1)), ("xac", "a", 2, (0.5, 1, 0.5, 1 / math.log2(3))), ("xy", "a", 2, (0, 0, 0, 0)), ("abc", "ac", 3, (1, 1, 2 / 3, (1 + 0.5) / (1 + 1 / math.log2(3)))), ("", "a", 3, (0, 0, 0, 0)), ("ab", "", 2, (0, 0, 0, 0)), ("aab", "a", 3, (1, 2, 2 / 3, 1 + 1 / math.log2(3)))],
)
def test_metrics(spark, results, relevant, k, want):
    hits = spark.createDataFrame([(0, i + 1, x, x in relevant) for i, x in enumerate(results)], "query_id int, rank int, doc_id string, relevant boolean")
    totals = spark.createDataFrame([(0, len(relevant))], "query_id int, n_relevant long")
    r = evaluation.metrics(hits, totals, k).first()
    assert (r.mrr, r.recall, r.precision, r.ndcg) == pytest.approx(want)
    assert evaluation.metrics(hits, totals, k, dedup=True).first().recall <= 1


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("a", "c", 1)][:3], "source string, target string, weight long")
    starts = spark.createDataFrame([("A",)], "start string")
    assert [graph.traverse(edges, starts, h).count() for h in (0, 1, 2, 3)] == [1, 2, 3, 4]
    docs = spark.createDataFrame([("1", "We use Rust with SQLite support."), ("2", "All rapid work on SQLite"), ("3", None)], "chunk_id string, text string")
    held = graph.entities(docs)
    assert {r.chunk_id: [e.name for e in r.entities] for r in held.collect()} == {"1": ["rust", "sqlite"], "2": ["api", "sqlite"], "3": []}
    assert {(r.source, r.target, r.weight) for r in graph.cooccurrence(held).collect()} == {("rust", "sqlite", 1), ("api", "sqlite", 1)}
    hits = graph.retrieve(graph.cooccurrence(held), graph.mentions(held), spark.createDataFrame([(0, "rust")], "query_id int, name string")).collect()
    assert [(r.chunk_id, r.score) for r in hits] == [("1", 1.0), ("2", 0.5)]


def test_event_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    events = spark.createDataFrame([(i, at + datetime.timedelta(minutes=7 * i), "view", 1.0) for i in range(60)], "event_id long, ts timestamp, event_type string, value double")
    events.write.parquet(str(tmp_path / "e"))
    stream = event_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, event_windows(events).collect()))
