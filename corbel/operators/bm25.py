"""BM25 over postings tables, for many questions at once."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .blocks import Best, best, joined_batches, ranks, slices

K1, B = 1.5, 0.75
#: (query, term) rows up to which the weights are sent to all tasks; more are joined by shuffles.
MOST_SENT = 200_000
#: Questions and cells of one numpy pass of the scoring.
QUERY_BLOCK, CELLS = 256, 1 << 20


def _terms(chunks: DataFrame, id_col: str) -> DataFrame:
    return chunks.select(F.col(id_col).alias("chunk_id"), tokens(F.coalesce(F.col("text"), F.lit(""))).alias("terms"))


def postings(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(chunk_id, term, tf, dl): one row for each term of each chunk. Null texts have no terms.

    The terms of a chunk are counted in its own array, so that nothing is shuffled. A batch is worked on in slices.
    """
    id_type = dict(chunks.select(F.col(id_col).alias("i")).dtypes)["i"]

    def run(batches):
        for batch in slices(batches):
            lists = batch.column(1)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(batch.num_rows), size)
            key, tf = np.unique(row * max(len(words.dictionary), 1) + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row, word = np.divmod(key, max(len(words.dictionary), 1))
            for at in range(0, len(row), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[part])), words.dictionary.take(pa.array(word[part])), pa.array(tf[part].astype(np.int64)), pa.array(size[row[part]])], ["chunk_id", "term", "tf", "dl"])

    return _terms(chunks, id_col).mapInArrow(run, f"chunk_id {id_type}, term string, tf long, dl long")


def corpus_stats(chunks: DataFrame, index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row (n, avgdl); chunks without terms count."""
    total = index.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    return chunks.agg(F.count(F.col(id_col)).alias("n")).crossJoin(total).select("n", (F.col("total") / F.greatest("n", F.lit(1))).cast("double").alias("avgdl"))  # two single rows


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qn) of queries (query_id, text)."""
    return queries.select("query_id", F.explode(tokens(F.coalesce(F.col("text"), F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))


def scores(used: DataFrame, stats: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of all chunks that have a term of the query, by joins; a repeated query term counts again.

    used: postings of at least the asked terms; asked: asked_terms().
    """
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    one = F.broadcast(stats)  # one row
    weight = asked.join(df, "term").crossJoin(one).select("query_id", "term", "avgdl", (F.col("qn") * F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("w"))
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return used.join(weight, "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def top(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best of each query by score, then by chunk_id, with `rank` from 1. Scores equal to 9 places are ties,
    so that the order of a sum doesn't decide."""
    order = Window.partitionBy(*(keys or ("query_id",))).orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block_scores(row, term, part, weights, size: int):
    """Yields (first query, first chunk, (queries, chunks) scores) over blocks of questions and chunks, each array of
    at most CELLS cells or one row. row, term, part: postings of `size` chunks in order of row; weights: (query
    numbers in order, terms, weights)."""
    q, t, w = weights
    here, term = np.unique(term, return_inverse=True)
    if not len(here):
        return
    at = np.searchsorted(here, t)
    own = here[np.minimum(at, len(here) - 1)] == t
    q, t, w = q[own], at[own], w[own]
    edge = np.searchsorted(row, np.arange(size + 1))
    last = int(q[-1]) + 1 if len(q) else 0
    n = max(1, min(QUERY_BLOCK, CELLS // len(here)))
    for at in range(0, last, n):
        a, b = np.searchsorted(q, (at, at + n))
        if a == b:
            continue
        m = min(n, last - at)
        table, first = np.zeros((len(here), m)), 0
        table[t[a:b], q[a:b] - at] = w[a:b]
        while first < size:
            # so many chunks, and no more postings but for one chunk
            to = min(first + max(1, CELLS // m), max(first + 1, int(np.searchsorted(edge, edge[first] + CELLS // m, side="right")) - 1), size)
            x, y = edge[first], edge[to]
            if y > x:
                out, full = np.zeros((to - first, m)), np.flatnonzero(np.diff(edge[first : to + 1]))
                out[full] = np.add.reduceat(table[term[x:y]] * part[x:y, None], edge[first + full] - x, axis=0)
                yield at, first, out.T
            first = to


def search(chunks: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", index: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks of each query (query_id, text).

    With `index`, postings of the chunks, no text is read. The asked terms,
    their document frequencies and weights go over the driver as long as there
    are at most MOST_SENT of them; each task scores blocks of chunks against
    blocks of questions by sparse products and hands on its k best. Beyond
    that number postings, frequencies and weights are joined by shuffles, with
    the same result.
    """
    asked = asked_terms(queries)
    held = asked.limit(MOST_SENT + 1).toArrow()
    if held.num_rows > MOST_SENT:
        rows = index if index is not None else postings(chunks, id_col)
        return top(scores(rows.join(asked.select("term").distinct(), "term", "left_semi"), corpus_stats(chunks, rows, id_col), asked), k)
    names, ids = pc.unique(held.column("term")), pc.unique(held.column("query_id"))
    id_type, q_type = chunks.select(F.col(id_col).alias("i")).dtypes[0][1], queries.select("query_id").dtypes[0][1]

    def from_texts(batches):
        """The postings of asked terms, by number, and a row -1 with chunks and tokens for each batch."""
        for batch in slices(batches):
            lists = batch.column(1)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.index_in(lists.flatten(), names)
            known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            key, tf = np.unique(np.repeat(np.arange(batch.num_rows), size)[known] * max(len(names), 1) + at.drop_null().to_numpy(), return_counts=True)
            row, term = np.divmod(key, max(len(names), 1))
            here = batch.column(0).is_valid().sum().as_py() if batch.num_rows else 0
            yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.column(0).type), pa.array([-1], pa.int32()), pa.array([here], pa.int64()), pa.array([size.sum()], pa.int64())], ["chunk_id", "term", "tf", "dl"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(term.astype(np.int32)), pa.array(tf.astype(np.int64)), pa.array(size[row])], ["chunk_id", "term", "tf", "dl"])

    def numbered(batches):
        for batch in batches:
            at = pc.index_in(batch.column(1), names)
            keep = at.is_valid()
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), at.filter(keep), batch.column(2).filter(keep), batch.column(3).filter(keep)], ["chunk_id", "term", "tf", "dl"])

    kind = f"chunk_id {id_type}, term int, tf long, dl long"
    if index is None:
        used = _terms(chunks, id_col).mapInArrow(from_texts, kind)
    else:
        # A scan prunes by the terms; the rows of a chunk are brought together, as scores are summed by chunk.
        few = index.filter(F.col("term").isin(names.to_pylist())) if len(names) <= 1000 else index
        used = few.select("chunk_id", "term", "tf", "dl").mapInArrow(numbered, kind).repartition("chunk_id")
    counted = used.groupBy("term").agg(F.sum(F.when(F.col("term") < 0, F.col("tf")).otherwise(1)).alias("df"), F.sum("dl").alias("dl")).toArrow()  # a row for each asked term
    df = np.zeros(len(names))
    n = total = 0
    for term, count, dl in zip(*(counted.column(i).to_pylist() for i in range(3))):
        if term < 0:
            n, total = count, dl
        else:
            df[term] = count
    if index is not None:
        n, avgdl = corpus_stats(chunks, index, id_col).first()
    else:
        avgdl = total / max(n, 1)
    number = pc.index_in(held.column("term"), names).to_numpy().astype(np.int64)
    weight = held.column("qn").to_numpy() * np.log((n - df[number] + 0.5) / (df[number] + 0.5) + 1)
    asker = pc.index_in(held.column("query_id"), ids).to_numpy().astype(np.int64)
    by_asker = np.argsort(asker, kind="stable")
    weights = asker[by_asker], number[by_asker], weight[by_asker]

    def run(batches):
        kept = Best(k)
        for t in joined_batches(batches, "chunk_id"):
            t = t.filter(pc.greater_equal(t.column("term"), 0))
            if not t.num_rows:
                continue
            own = t.column("chunk_id").combine_chunks().dictionary_encode()
            row, names_of = ranks(own.dictionary)[own.indices.to_numpy(zero_copy_only=False)], own.dictionary.take(pc.sort_indices(own.dictionary))
            by = np.argsort(row, kind="stable")
            term, tf, dl = (t.column(c).to_numpy()[by] for c in ("term", "tf", "dl"))
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
            for at, first, s in _block_scores(row[by], term, part, weights, len(names_of)):
                s[s == 0] = -np.inf
                a, c = best(s, k)
                kept.add(a + at, names_of.take(pa.array(c + first)), s[a, c])
        yield from kept.rows(ids)

    kind = f"query_id {q_type}, chunk_id {id_type}, score double"
    # Texts are counted and scored by one Python worker of a task.
    found = used.mapInArrow(run, kind) if index is not None else _terms(chunks, id_col).mapInArrow(lambda batches: run(from_texts(batches)), kind)
    return top(found, k)
