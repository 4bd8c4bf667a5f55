import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corbel import config
from corbel.functions import text as T
from corbel.functions import vectors as V
from corbel.functions.embedding import pool
from corbel.operators import graph, search, split
from corbel.schema import ConfigError, SplitError


@pytest.mark.parametrize(
    "text,n",
    [
        ("Mrs. Gray came home. She asked Prof. Hill about fruit, e.g. ripe pears.", 2),
        ("Who is it? Nobody! Then all was quiet.", 3),
        ("A. B. Marsh wrote it. Few have read it.", 2),
        ("", 0), ("no stop", 1), ("  . ", 1),
    ],
)
def test_sentences(text, n):
    assert len(T.split_sentences(text)) == n


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_splitters(text, size, overlap):
    for parts in (split.byte_windows(text, size, overlap), split.token_chunks(text, size, overlap), split.sentence_chunks(text, size)):
        assert all(parts) or parts == [""]
        if len(text.encode()) <= size:
            assert parts == [text]
    windows = split.byte_windows(text, size, 0)
    if len(text.encode()) > size and text.strip(T.SPACE):
        assert all(len(w.encode()) <= size + 3 for w in windows) and all(w in text for w in windows)


def test_splitter_limits(spark):
    with pytest.raises(SplitError):
        split.split_bytes(spark.createDataFrame([], "doc_id long, text string"), 5, 5)
    assert split.byte_windows("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert split.token_chunks("aaaa bbbb cccc", 2, 1) == ["aaaa bbbb", "bbbb cccc"]


def test_semantic_breaks():
    vec = {"A a.": [1, 0], "B b.": [1, 0.1], "C c.": [0, 1]}
    assert split.semantic_chunks("A a. B b. C c.", lambda s: [vec[x] for x in s], 0.5) == ["A a. B b.", "C c."]
    assert split.semantic_chunks("A a. B b.", lambda s: [vec[x] for x in s], 0.5, 4) == ["A a.", "B b."]


def test_cosine_cases(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([], [1.0], 0.0), ([0.0], [0.0], 0.0), ([1.0, 5.0], [2.0], 1.0)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want double")
    assert all(abs(r.c - r.want) < 1e-9 for r in df.withColumn("c", V.cosine(F.col("a"), F.col("b"))).collect())


def test_codecs():
    v = np.array([0.21, -0.64, 0.97, -0.05, 0.33], dtype=np.float32)
    assert np.array_equal(V.decode(V.encode(v, "f32"), "f32"), v)
    assert np.abs(V.decode(V.encode(v, "f16"), "f16") - v).max() < 1e-3
    assert np.abs(V.decode(V.encode(v, "uint8"), "uint8") - v).max() < 1e-2
    assert [len(V.encode(np.zeros(384), k)) for k in ("f32", "f16", "uint8")] == [1536, 768, 392]


def test_pooling():
    v = np.array([[[3.0, 0], [0, 4], [9, 9]], [[0, 0], [0, 0], [1, 1]]], dtype=np.float32)
    assert np.allclose(pool(v, np.array([[1, 1, 0], [1, 0, 0]])), [[0.6, 0.8], [0, 0]])


def test_expansion():
    assert search.expand_query("  ") == []
    assert search.expand_query("rust memory safety") == ["rust memory safety", "What is rust memory safety?", "rust memory safety", "rust explained"]
    assert search.expand_query("how does it work")[1] == "how does it work?"
    assert search.expand_query("explain borrow?")[0] == "explain borrow?"


def test_proper_nouns():
    got = dict(graph.proper_nouns("It was written by John Smith, at Microsoft. the end was near Paris"))
    assert got == {"john smith": "PROPER_NOUN", "microsoft": "NOUN", "paris": "NOUN"}


def test_config(tmp_path):
    f = tmp_path / "corbel.toml"
    f.write_text('db = "x"\n[splitter]\nchunk_size = 100\nchunk_overlap = 5\n')
    c = config.load(str(f), {"CORBEL_TOP_K": "3"})
    assert (c.db, c.chunk_size, c.top_k) == ("x", 100, 3)
    for bad in ("chunk_size = 10", 'nonsense = 1', "alpha = 2"):
        f.write_text(bad)
        with pytest.raises(ConfigError):
            config.load(str(f), {})
    with pytest.raises(ConfigError):
        config.query_text(" \x00 ", c)
    assert config.query_text("a\x00b", c) == "ab" and config.clamp(0) == 1 and config.clamp(5000) == 1000
