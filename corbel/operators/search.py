"""Vector search, fusion and the composite retrieval operators."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, split_words, words
from ..functions.vectors import cosine
from ..shared import checkpoint
from . import bm25
from .nearest import nearest

RRF = 60


def metadata_filter(rows: DataFrame, conditions: dict[str, str], metadata: str = "metadata") -> DataFrame:
    """Rows that have all the values; a missing key is no match. A column of the key's name is used before the map, so that it reaches the scan."""
    for key, value in conditions.items():
        at = F.col(key) if key in rows.columns else F.element_at(F.col(metadata), key)
        rows = rows.filter(at == value)
    return rows


def vector_scores(chunks: DataFrame, query: list[float]) -> DataFrame:
    """chunks' chunk_id with score and distance; chunks without embedding give no row."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return chunks.filter("embedding is not null").select("chunk_id", cosine(F.col("embedding"), q).alias("score")).withColumn("distance", 1 - F.col("score"))


def vector_search(chunks: DataFrame, query: list[float], k: int = 10, filters: dict | None = None, mode: str = "pre") -> DataFrame:
    """The k nearest by cosine, exactly. Filters come before scoring; mode="post" takes the 3k nearest and filters those."""
    if filters and mode == "pre":
        chunks = metadata_filter(chunks, filters)
    best = vector_scores(chunks, query).orderBy(F.desc(F.round("score", 9)), "chunk_id").limit(3 * k if filters and mode == "post" else k)
    if filters and mode == "post":
        best = metadata_filter(best.join(chunks.drop("embedding"), "chunk_id"), filters).select("chunk_id", "score", "distance").orderBy(F.desc(F.round("score", 9)), "chunk_id").limit(k)
    return best


def knn_join(queries: DataFrame, base: DataFrame, k: int = 5, others: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): each query's k nearest of base, exactly.

    queries (query_id, embedding) and base (chunk_id, embedding) are compared
    by cells of bounded size, each a task of its own; see nearest(). Work
    grows with the product of both sides. Ids may be of any type that sorts;
    of unequal dimensions the lesser one counts; a null embedding gives no
    row. With others=True a query isn't its own neighbour.
    """
    return bm25.top(nearest(queries, base, k, others), k)


def rrf(vector: DataFrame, keyword: DataFrame, k: int = 10, alpha: float = 0.5) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, chunk_id, score, rank), with both ranks and scores."""
    v = vector.select("query_id", "chunk_id", F.col("rank").alias("v_rank"), F.col("score").alias("v_score"))
    b = keyword.select("query_id", "chunk_id", F.col("rank").alias("b_rank"), F.col("score").alias("b_score"))
    part = lambda w, r: F.coalesce(F.lit(w) / (RRF + F.col(r)), F.lit(0.0))
    both = v.join(b, ["query_id", "chunk_id"], "full_outer").withColumn("score", part(float(alpha), "v_rank") + part(1.0 - alpha, "b_rank"))
    return bm25.top(both, k)


def hybrid(chunks: DataFrame, queries: DataFrame, k: int = 10, alpha: float = 0.5, filters: dict | None = None, index: DataFrame | None = None) -> DataFrame:
    """Both searches' 3k best, fused. chunks: chunk_id, text, embedding; queries: query_id, text, embedding; index: postings
    of the chunks, if there are any. Filters hold for both sides."""
    if filters:
        chunks = metadata_filter(chunks, filters)
        index = index.join(chunks.select("chunk_id"), "chunk_id", "left_semi") if index is not None else None
    v = knn_join(queries.select("query_id", "embedding"), chunks.select("chunk_id", "embedding"), 3 * k)
    return rrf(v, bm25.search(chunks, queries.select("query_id", "text"), 3 * k, "chunk_id", index), k, alpha)


def graph_fusion(graph: DataFrame, vector: DataFrame, k: int = 10, weight: float = 0.5, keep_graph_only: bool = False) -> DataFrame:
    """Fusion of graph hits into vector hits; graph hits that the vector side lacks are dropped unless kept."""
    v = vector.select("query_id", "chunk_id", F.col("rank").alias("v_rank"))
    g = graph.select("query_id", "chunk_id", F.col("rank").alias("g_rank"))
    both = v.join(g, ["query_id", "chunk_id"], "full_outer" if keep_graph_only else "left")
    score = F.coalesce(F.lit(float(weight)) / (RRF + F.col("g_rank")), F.lit(0.0)) + F.coalesce(F.lit(1.0 - weight) / (RRF + F.col("v_rank")), F.lit(0.0))
    return bm25.top(both.withColumn("score", score), k)


def keyword_overlap(query: Column, text: Column) -> Column:
    """Part of the query's distinct words, by white space and without case, that the text has."""
    q = F.array_distinct(words(F.lower(query)))
    return F.size(F.array_intersect(q, words(F.lower(text)))) / F.greatest(F.size(q), F.lit(1)).cast("double")


def rerank(hits: DataFrame, score: Column, k: int = 10) -> DataFrame:
    """hits in order of a new score, ties in their former order; distance is 1 - score."""
    order = Window.partitionBy("query_id").orderBy(F.desc("new_score"), "rank", "chunk_id")
    rows = hits.withColumn("new_score", score).withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= k)
    return rows.drop("score", "rank", "distance").withColumnsRenamed({"new_score": "score", "new_rank": "rank"}).withColumn("distance", 1 - F.col("score"))


def rerank_keyword(hits: DataFrame, k: int = 10) -> DataFrame:
    """hits need query and text."""
    return rerank(hits, keyword_overlap(F.col("query"), F.col("text")), k)


def rerank_model(hits: DataFrame, predict, k: int = 10) -> DataFrame:
    """rerank() by a cross-encoder: predict maps (queries, texts) to logits, one or two columns."""

    @F.pandas_udf("double")
    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        z = np.asarray(predict(query.tolist(), text.tolist()), dtype=np.float64).reshape(len(query), -1)
        return pd.Series(1 / (1 + np.exp(-z[:, 1 if z.shape[1] > 1 else 0])))

    return rerank(hits, run("query", "text"), k)


def expand_query(text: str) -> list[str]:
    """The query, its question form, its keywords and its explanation form; neighbours that are equal are one."""
    text = text.strip()
    if not text:
        return []
    low, out = text.lower(), [text]
    if not text.endswith("?"):
        out.append(f"{text}?" if low.startswith(("what", "how", "why", "when", "where", "who")) else f"What is {text}?")
    stop, keys = set(STOP_WORDS), []
    for w in split_words(text):
        chars = list(w.lower())
        while chars and not chars[0].isalnum():
            chars.pop(0)
        while chars and not chars[-1].isalnum():
            chars.pop()
        w = "".join(chars)
        if len(w.encode()) > 2 and w not in stop:
            keys.append(w)
    if len(keys) >= 2:
        out.append(" ".join(keys))
    if "definition" not in low and "explain" not in low:
        out.append(f"{keys[0] if keys else text} explained")
    return [x for i, x in enumerate(out) if not i or x != out[i - 1]]


def variants(queries: DataFrame) -> DataFrame:
    """(query_id, variant, text): the expansions of questions (query_id, text), numbered from 0; see expand_query()."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: expand_query(t or ""))

    return queries.select("query_id", F.posexplode(run("text")).alias("variant", "text"))


def merge_variants(hits: DataFrame, variants: DataFrame, k: int = 10) -> DataFrame:
    """One ranking of the variants' rankings. hits: query_id, variant from 0, chunk_id, score, rank from 1; variants: (query_id, n_variants).

    A chunk's first hit is raised by 0.01 (n - 1) / rank; a later one can only raise it to its own score.
    """
    rows = hits.join(variants, "query_id")
    first = F.min_by(F.struct("score", "rank", "n_variants"), F.struct("variant", "rank"))
    best = rows.groupBy("query_id", "chunk_id").agg(first.alias("f"), F.max("score").alias("raw"))
    return bm25.top(best.select("query_id", "chunk_id", F.greatest(F.col("f.score") + 0.01 * (F.col("f.n_variants") - 1) / F.col("f.rank"), F.col("raw")).alias("score")), k)


def parents(hits: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, source_id, rank, score, text, child_chunks, metadata): the first k parents of ranked hits, whole.

    hits: query_id, chunk_id, score, rank. chunks: chunk_id, source_id, chunk_index (a number or its text), text.
    Siblings are joined by line feeds in order of chunk_index, what isn't a number being 0.
    """
    seen = hits.join(chunks.select("chunk_id", "source_id"), "chunk_id").groupBy("query_id", "source_id").agg(F.min("rank").alias("first"), F.min_by("score", "rank").alias("score"))
    order = Window.partitionBy("query_id").orderBy("first")
    seen = seen.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    index = F.coalesce(F.expr("try_cast(cast(chunk_index as string) as int)"), F.lit(0))
    whole = chunks.join(seen.select("source_id").distinct(), "source_id", "left_semi").groupBy("source_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(index.alias("i"), "chunk_id", "text"))), lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("child_chunks")
    )
    mode = F.create_map(F.lit("retrieval_mode"), F.lit("parent"), F.lit("child_chunks"), F.col("child_chunks").cast("string"))
    return seen.join(whole, "source_id").select("query_id", "source_id", "rank", "score", "text", "child_chunks", mode.alias("metadata"))


def route(collections: dict, k: int = 10) -> tuple[DataFrame, list[str]]:
    """(one ranking of the collections' rankings with their names, names that failed).

    Each value is a ranking (query_id, chunk_id, score), or a function that
    makes it. A collection's k best of each query are brought to the shared
    checkpoint folder first, so that one which fails while it runs is left out
    like one that can't be read.
    """
    parts, failed = [], []
    for name, hits in collections.items():
        try:
            rows = (hits() if callable(hits) else hits).select("query_id", "chunk_id", "score")
            parts.append(checkpoint(bm25.top(rows, k).drop("rank")).withColumn("collection", F.lit(name)))
        except Exception as e:  # a collection that can't be read doesn't stop the others
            failed.append(f"{name}: {type(e).__name__}")
    if not parts:
        raise ValueError("no collection could be read")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return bm25.top(rows, k), failed


def prompt(hits: DataFrame, template: str | None = None) -> DataFrame:
    """(query_id, prompt) of hits with query, rank, source and text."""
    block = lambda x: F.concat(F.lit("\n["), x["rank"].cast("string"), F.lit("] Source: "), x["source"], F.lit("\n"), x["text"], F.lit("\n"))
    rows = hits.select("query_id", "query", F.struct("rank", F.coalesce("source", F.lit("unknown")).alias("source"), "text").alias("h"))
    held = rows.groupBy("query_id", "query").agg(F.array_sort(F.collect_list("h")).alias("h"))
    held = held.select("query_id", "query", F.array_join(F.transform("h", block), "").alias("context"), F.array_join(F.transform("h", lambda x: x["source"]), ", ").alias("sources"))
    if template is None:
        text = F.concat(F.lit("Query: "), F.col("query"), F.lit("\n\nContext:\n"), F.col("context"), F.lit("\n---\nAnswer the query using the provided context."))
    else:
        text = F.lit(template)
        for name in ("context", "query", "sources"):
            text = F.replace(text, F.lit("{" + name + "}"), F.col(name))
    return held.select("query_id", text.alias("prompt"))
