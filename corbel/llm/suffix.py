"""Passages that repeat across documents, by interval expansion on a Burrows-Wheeler transform.

A passage is repeated if MIN_WORDS consecutive words of it occur in another
document too. Every window of that many words has a least 8-word hash, and
consecutive windows with the same one are a segment; equal windows have equal
least hashes, so a bucket by that hash holds all occurrences of its windows.
Segments of equal content are one class, and a bucket of one class needs no
search. The words of the other buckets' classes, once each, are concatenated
and sorted to a Burrows-Wheeler transform. Starting from the intervals of
single words, each round extends all intervals backwards by one word, breadth
first, which yields the common prefixes in order of increasing length;
intervals of one row are given up, and the search stops at MIN_WORDS.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import checkpoint, texts

MIN_WORDS = 50
ANCHOR = 8
#: Words that are sorted together; a bucket of more is still sorted whole.
SORTED = 1 << 21
R = np.uint64(0x5851F42D4C957F2D)
R_INVERSE = np.uint64(pow(int(R), -1, 2**64))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive numbers."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def segments(h: np.ndarray, rows: np.ndarray, least: int):
    """(row, first word, windows, bucket, content hash) of the segments of all rows."""
    anchor = min(ANCHOR, least)
    n = len(h)
    none = (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),) * 2
    if n < least:
        return none
    g = np.zeros(n - anchor + 1, dtype=np.uint64)
    for j in range(anchor):
        g = (g ^ h[j : j + len(g)]) * K.M1
        g ^= g >> np.uint64(29)
    m = sliding_least(K.mix(g), least - anchor + 1)  # one for each window of `least` words
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    inside = row[: len(m)] == row[least - 1 : least - 1 + len(m)]
    change = np.ones(len(m), dtype=bool)
    change[1:] = (m[1:] != m[:-1]) | (row[1 : len(m)] != row[: len(m) - 1]) | ~inside[:-1]
    start = np.flatnonzero(change & inside)
    if not len(start):
        return none
    edge = np.concatenate([np.flatnonzero(change | ~inside), [len(m)]])
    count = edge[np.searchsorted(edge, start, side="right")] - start
    power = np.ones(n + 1, dtype=np.uint64)
    np.cumprod(np.full(n, R, dtype=np.uint64), out=power[1:])
    back = np.ones(n + 1, dtype=np.uint64)
    np.cumprod(np.full(n, R_INVERSE, dtype=np.uint64), out=back[1:])
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(K.mix(h + K.M3) * power[:-1], out=sums[1:])
    content = K.mix((sums[start + count + least - 1] - sums[start]) * back[start] + count.astype(np.uint64))
    return row[start], start - rows[row[start]], count, m[start], content


def content_hash(words: np.ndarray, windows: int) -> int:
    """The content hash that segments() gives a segment of these words, as a signed number."""
    power = np.ones(len(words), dtype=np.uint64)
    np.cumprod(np.full(len(words) - 1, R, dtype=np.uint64), out=power[1:])
    total = (K.mix(words + K.M3) * power).sum(dtype=np.uint64)
    return int(K.mix(np.array([total + np.uint64(windows)], dtype=np.uint64)).view(np.int64)[0])


def transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array by at least the first `depth` symbols, Burrows-Wheeler transform) of a text of ranks."""
    n = len(text)
    rank, h = text.astype(np.int64), 1
    while True:
        if h == 1:
            key = rank
        else:
            key = rank * (n + 1)
            key[: n - h // 2] += rank[h // 2 :] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if h >= depth or new[-1] == n - 1:
            return order, text[order - 1]
        h *= 2


def repeated_intervals(bwt: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, first row of each one's interval) of the suffixes that share their first `least` symbols with another.

    From the intervals of single symbols on, all intervals of common prefixes
    of length l are extended backwards to those of length l + 1: a row belongs
    to the extension of the interval in which its successor lies.
    """
    n = len(bwt)
    successor = np.argsort(bwt, kind="stable")  # row of the suffix without its first symbol; the inverse of last-to-first
    first = bwt[successor]
    same = np.concatenate([[False], first[1:] == first[:-1]])
    rows = np.arange(n)
    home = rows.copy()
    length = 1
    while True:
        begin = np.maximum.accumulate(np.where(same, 0, rows))
        home[rows] = begin
        live = same.copy()
        live[:-1] |= same[1:]
        rows, begin, same = rows[live], begin[live], same[live]
        if length == least or not len(rows):
            return rows, begin
        inner = np.flatnonzero(same)
        at = rows[inner]
        same[inner] = home[successor[at]] == home[successor[at - 1]]
        length += 1


def repeated_windows(words: list[np.ndarray], low: np.ndarray, high: np.ndarray, least: int):
    """(class, first window, windows, first document) of the runs of windows that occur in several documents.

    words has each class's word hashes; low and high are the least and the
    greatest document of the class.
    """
    size = np.array([len(w) for w in words])
    start = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.empty(start[-1], dtype=np.int64)
    _, ranks = np.unique(np.concatenate(words), return_inverse=True)
    owner = np.repeat(np.arange(len(words)), size + 1)
    last = start[1:] - 1
    body = np.ones(len(text), dtype=bool)
    body[last] = False
    text[body] = ranks + len(words)
    text[last] = np.arange(len(words))  # each class ends with a symbol of its own
    order, bwt = transform(text, least)
    rows, begin = repeated_intervals(bwt, least)
    if not len(rows):
        return (np.zeros(0, dtype=np.int64),) * 4
    at = order[rows]
    own = owner[at]
    cut = np.flatnonzero(np.concatenate([[True], begin[1:] != begin[:-1]]))
    lo, hi = np.minimum.reduceat(low[own], cut), np.maximum.reduceat(high[own], cut)
    length = np.diff(np.concatenate([cut, [len(rows)]]))
    lo, several = np.repeat(lo, length), np.repeat(lo < hi, length)
    at, own, lo = at[several], own[several], lo[several]
    if not len(at):
        return (np.zeros(0, dtype=np.int64),) * 4
    by = np.argsort(at)
    at, own, lo = at[by], own[by], lo[by]
    run = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1]) | (lo[1:] != lo[:-1])]))
    return own[run], at[run] - start[own[run]], np.diff(np.concatenate([run, [len(at)]])), lo[run]


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc): the words of each document that lie in a repeated window,
    as maximal ranges; first_doc is the least doc_id that has any of the range's windows.

    Words are compared without case and punctuation. Repeats inside one
    document don't count, nor do rows without doc_id; rows that repeat a doc_id
    with different texts are one document whose texts are each searched. Null
    and empty texts and those of fewer words give no rows.
    """
    rows = texts(docs)

    def cut(batches):
        for batch in batches:
            for part in K.slices(batch):
                h, at, *_ = K.words(part.column(1))
                row, first, count, bucket, content = segments(h, at, min_words)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(content.view(np.int64)), part.column(0).take(pa.array(row)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], ["m", "c", "id", "s", "n"])

    # A bucket may hold a passage of a third of the documents: its rows are never brought together, only what is
    # aggregated from them, and joins may split them.
    cuts = rows.mapInArrow(cut, "m long, c long, id long, s int, n int")
    several = cuts.groupBy("m").agg(F.min("id").alias("least"), F.max("id").alias("most"), (F.min("c") != F.max("c")).alias("mixed")).filter("least < most").select("m", "mixed")
    shared = checkpoint(cuts.join(several, "m"))
    kinds = shared.groupBy("m", "c").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min(F.struct("id", "s")).alias("first"))
    shared = shared.join(kinds, ["m", "c"]).filter("mixed or lo < hi")
    shared = checkpoint(shared.select("m", "c", "id", "s", "n", "lo", "hi", "mixed", (F.struct("id", "s") == F.col("first")).alias("one")))
    whole = shared.filter("lo < hi").select("id", "s", (F.col("s") + F.col("n") + F.lit(min_words - 1)).alias("e"), F.col("lo").alias("first"))

    need = shared.filter("mixed and one").groupBy("id").agg(F.collect_list(F.struct("m", "c", "s", "n", "lo", "hi")).alias("need"))
    fetch = need.join(rows, "id").select("id", "text", "need")

    def take(batches):
        for batch in batches:
            for part in K.slices(batch):
                h, at, *_ = K.words(part.column(1))
                out = {k: [] for k in ("m", "c", "lo", "hi", "words")}
                for i, wanted in enumerate(part.column(2).to_pylist()):
                    own = h[at[i] : at[i + 1]]
                    for x in wanted:
                        words = own[x["s"] : x["s"] + x["n"] + min_words - 1]
                        # Of several texts with one doc_id only that which has the class may stand for it.
                        if len(words) == x["n"] + min_words - 1 and content_hash(words, x["n"]) == x["c"]:
                            for k in ("m", "c", "lo", "hi"):
                                out[k].append(x[k])
                            out["words"].append(words.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[k], pa.binary() if k == "words" else pa.int64()) for k in out], list(out))

    def search(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        m, c, lo, hi = (t.column(k).to_numpy() for k in ("m", "c", "lo", "hi"))
        order = np.lexsort((c, m))
        keep = np.ones(len(order), dtype=bool)  # a class may come from several rows with the same doc_id
        keep[1:] = (m[order][1:] != m[order][:-1]) | (c[order][1:] != c[order][:-1])
        order = order[keep]
        blobs = t.column("words")
        edges = np.flatnonzero(np.concatenate([[True], m[order][1:] != m[order][:-1], [True]]))
        begin, size = 0, 0
        for x, y in zip(edges[:-1], edges[1:]):
            size += sum(len(blobs[int(i)].as_buffer()) // 8 for i in order[x:y])
            if size >= SORTED or y == len(order):
                own = order[begin:y]
                words = [np.frombuffer(blobs[int(i)].as_buffer(), dtype=np.uint64) for i in own]
                k, first, count, doc = repeated_windows(words, lo[own], hi[own], min_words)
                yield pa.RecordBatch.from_arrays([pa.array(m[own][k]), pa.array(c[own][k]), pa.array(first), pa.array(count), pa.array(doc)], ["m", "c", "at", "w", "first"])
                begin, size = y, 0

    found = fetch.mapInArrow(take, "m long, c long, lo long, hi long, words binary").repartition("m").mapInArrow(search, "m long, c long, at long, w long, first long")
    parts = shared.filter("mixed").join(found, ["m", "c"]).select("id", (F.col("s") + F.col("at")).alias("s"), (F.col("s") + F.col("at") + F.col("w") + F.lit(min_words - 1)).alias("e"), "first")
    by = Window.partitionBy("id").orderBy("s", "e")
    ranges = whole.select("id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), "first").unionByName(parts).withColumn("far", F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    ranges = ranges.withColumn("part", F.sum(F.when(F.col("s") <= F.col("far"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return ranges.groupBy("id", "part").agg(F.min("s").alias("start_word"), F.max("e").alias("end"), F.min("first").alias("first_doc")).select(F.col("id").alias("doc_id"), "start_word", (F.col("end") - F.col("start_word")).alias("n_words"), "first_doc")
