"""Memory and work of single tasks, on tables that are large in one direction."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corbel.functions import vectors as vector_functions
from corbel.operators import ann, bm25, graph, nearest, search
from corbel.operators.blocks import Best, slices


def test_bm25_scores_in_pieces():
    """Many questions, terms and chunks at once: the arrays are pieces, and the scores those of a loop."""
    rng = np.random.default_rng(3)
    terms, size = 50_000, 20_000
    q = np.sort(rng.integers(0, 600, 20_000))
    t, w = rng.integers(0, terms, len(q)), rng.random(len(q))
    key = np.unique(q * terms + t)
    q, t, w = key // terms, key % terms, w[: len(key)]
    row = np.sort(rng.integers(0, size, 60_000))
    term, part = rng.integers(0, terms, len(row)), rng.random(len(row))
    got = {}
    tracemalloc.start()
    for at, first, s in bm25._block_scores(row, term, part, (q, t, w), size):
        a, c = np.nonzero(s)
        for x, y, z in zip(a + at, c + first, s[a, c]):
            assert (x, y) not in got
            got[x, y] = z
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want, of = {}, {}
    for x, y, z in zip(q, t, w):
        of.setdefault(y, []).append((x, z))
    for r, y, p in zip(row, term, part):
        for x, z in of.get(y, ()):
            want[x, r] = want.get((x, r), 0) + z * p
    assert want.keys() == got.keys() and max(abs(want[x] - got[x]) for x in want) < 1e-12
    assert peak < 70e6, peak


def test_slices_and_best():
    lists = pa.array([[1, 2, 3], [], None, list(range(9)), [4], [5]])
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), lists], ["i", "l"])
    parts = list(slices([batch, batch.slice(0, 0)], 1, 4))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5]]
    rng = np.random.default_rng(4)
    kept, rows = Best(3), []
    for _ in range(40):
        q, i, s = rng.integers(0, 5, 10_000), rng.integers(0, 1 << 40, 10_000), rng.integers(0, 50, 10_000) / 50
        kept.add(q, pa.array(i), s)
        rows += zip(q.tolist(), (-s).tolist(), i.tolist())
        assert sum(len(p[0]) for p in kept.parts) < 200_000
    want = sorted((q, s, i) for q in range(5) for _, s, i in sorted(r for r in rows if r[0] == q)[:3])
    got = [r for b in kept.rows(pa.array(["a", "b", "c", "d", "e"])) for r in b.to_pylist()]
    assert sorted(("abcde".index(r["query_id"]), -r["score"], r["chunk_id"]) for r in got) == want


def brute(ids, v, k, allowed=None):
    """(query, neighbour): score over all pairs in doubles, ties by the lesser id."""
    with np.errstate(invalid="ignore", divide="ignore"):
        u = np.nan_to_num(v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True))
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -np.inf)
    if allowed is not None:
        s[~allowed] = -np.inf
    out = {}
    for i in range(len(v)):
        near = sorted((c for c in range(len(v)) if np.isfinite(s[i, c])), key=lambda c: (-round(s[i, c], 9), ids[c]))
        out |= {(ids[i], ids[c]): s[i, c] for c in near[:k]}
    return out


def vectors(n=700):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((n, 16)).astype(np.float32)
    v[50:110], v[300:305] = v[49], 0  # many copies and zeros
    return rng.permutation(10 * n)[:n].tolist(), v


def test_nearest_in_cells(spark, monkeypatch):
    """Small groups, blocks and parts give the same as brute force, and a task hands on k rows of a question."""
    for name, value in (("BLOCK", 64), ("QUESTIONS", 16 * 150), ("VECTORS", 16 * 250), ("ROWS", 50), ("COLUMNS", 80), ("FIRST", 30), ("EXACT", 16 * 100)):
        monkeypatch.setattr(nearest, name, value)
    ids, v = vectors()
    rows = spark.createDataFrame(list(zip(ids, v.tolist())), "chunk_id long, embedding array<float>").repartition(3)
    asked = rows.withColumnRenamed("chunk_id", "query_id")
    assert nearest.nearest(asked, rows, 5, True).count() == len(ids) * 5 * 3  # each of three groups' best, not each block's
    got = {(r.query_id, r.chunk_id): r.score for r in search.knn_join(asked, rows, 5, others=True).collect()}
    want = brute(ids, v, 5)
    assert got.keys() == want.keys() and max(abs(got[x] - want[x]) for x in got) < 1e-11


def test_lists_in_cells(spark, monkeypatch):
    """The inverted file gives what brute force gives among the probed lists, and sends a query once to a group."""
    for name, value in (("BLOCK", 64), ("VECTORS", 16 * 250), ("FIRST", 30)):
        monkeypatch.setattr(nearest, name, value)
    ids, v = vectors()
    rows = spark.createDataFrame(list(zip(ids, v.tolist())), "chunk_id long, embedding array<float>").repartition(3)
    centroids = ann.fit(rows, 12)
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    s = u @ centroids.T
    probed, own = np.argsort(-s, axis=1, kind="stable")[:, :4], s.argmax(axis=1)
    want = brute(ids, v, 5, (probed[:, None, :] == own[None, :, None]).any(axis=2))
    found = ann.search(rows.withColumnRenamed("chunk_id", "query_id"), ann.assign(rows, centroids), centroids, 5, 4, others=True)
    got = {(r.query_id, r.chunk_id): r.score for r in found.collect()}
    same = got.keys() & want.keys()
    assert len(got) == len(want) and len(same) > 0.99 * len(want)  # copies of one score in doubles may differ in floats
    assert max(abs(got[x] - want[x]) for x in same) < 1e-6


class Captured:
    """Takes the place of a DataFrame, to have the function that its tasks would run."""

    def mapInArrow(self, run, schema):
        return run


def test_postings_by_slices(spark, monkeypatch):
    """A batch of many tokens is counted in parts."""
    monkeypatch.setattr(bm25, "_terms", lambda chunks, id_col: Captured())
    run = bm25.postings(spark.createDataFrame([], "doc_id long"))
    n, each = 4000, 500
    words = pa.array([f"w{i}" for i in range(1000)])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * each, pa.int32()), words.take(pa.array(np.arange(n * each) % 1000)))
    batch, rows, total = pa.RecordBatch.from_arrays([pa.array(range(n)), lists], ["chunk_id", "terms"]), 0, 0
    tracemalloc.start()
    for part in run([batch]):
        rows, total = rows + part.num_rows, total + int(np.sum(part.column("tf").to_numpy()))
        assert set(part.column("dl").to_pylist()) == {each}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == total == n * each and peak < 30e6, peak


def test_nouns_by_slices():
    """Names are turned to Arrow as they are found: no object for each of a batch's names."""
    texts = ["see " + " ".join(f"Aa{i}x{j} and" for j in range(40)) for i in range(3000)] + [None, "", "the Big City. Then"]
    held, want = pa.array(texts), [graph.proper_nouns(t or "") for t in texts]
    tracemalloc.start()
    got = graph.nouns_of(held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [[(e["name"], e["type"]) for e in x] for x in got.to_pylist()] == want
    assert peak < 8e6, peak


def test_embedding_hashes_once(spark):
    """One digest of a text, not one for each dimension."""
    text = spark.range(1).select(F.repeat(F.lit("a long text "), 1_000_000).alias("text"))
    began = time.time()
    assert text.select(F.size(vector_functions.dummy_embedding(F.col("text"), 4096)).alias("n"), F.array_max(vector_functions.dummy_embedding(F.col("text"), 4096)).alias("m")).first().n == 4096
    assert time.time() - began < 15  # 4,096 digests of 12 MB take far longer
