"""From files to the index and from questions to hits, as the configuration says."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, clamp, query_text
from ..functions.embedding import DummyEmbedder, Embedder, EmbeddingCache, HttpEmbedder, OnnxEmbedder, embed_column
from ..functions.generation import EchoGenerator, Generator, HttpGenerator, answers
from ..operators import bm25, search, split
from ..schema import CHUNK, ConfigError
from ..sources.loaders import load
from ..sources.store import VectorStore


def embedder(config: Config) -> Embedder:
    match config.embed_backend:
        case "dummy":
            return DummyEmbedder(config.dimension)
        case "http" | "openai" | "ollama":
            return HttpEmbedder(config.embed_url, config.model, config.dimension, config.api_key or None, config.embed_batch_size)
        case "onnx":
            return OnnxEmbedder(config.model, config.tokenizer, config.dimension)
    raise ConfigError(f"embed_backend {config.embed_backend}")


def generator(config: Config) -> Generator:
    return HttpGenerator(config.generate_url, config.generate_model, config.api_key or None) if config.generate_url else EchoGenerator()


def chunk(docs: DataFrame, config: Config, own: Embedder | None = None) -> DataFrame:
    """Embedded chunks of documents (id, text, metadata); source_id is metadata's source, or the id. With
    config.embed_cache, a folder, each text is embedded once."""
    docs, own = docs.select(F.col("id").alias("doc_id"), "text", "metadata"), own or embedder(config)
    size, overlap = config.chunk_size, config.chunk_overlap
    ways = {
        "bytes": lambda: split.split_bytes(docs, size, overlap), "tokens": lambda: split.split_tokens(docs, size, overlap),
        "sentences": lambda: split.split_sentence_groups(docs, size, 1), "semantic": lambda: split.split_semantic(docs, own.embed, 0.5, size),
    }
    if config.splitter not in ways:
        raise ConfigError(f"splitter {config.splitter}")
    rows = ways[config.splitter]().withColumn("source_id", F.coalesce(F.element_at("metadata", "source"), F.col("doc_id")))
    rows = EmbeddingCache(docs.sparkSession, config.embed_cache).embed(rows, own) if config.embed_cache else embed_column(rows, own)
    return rows.select(*CHUNK.fieldNames())


def indexer(config: Config):
    """scan() rows to chunks, for Store.sync() and watch()."""
    return lambda files: chunk(load(files), config)


def add_documents(store: VectorStore, docs: DataFrame, config: Config) -> None:
    own = embedder(config)
    store.add(chunk(docs, config, own), own.model)


def questions(spark: SparkSession, texts: list[str], config: Config) -> DataFrame:
    """(query_id, text) of checked questions."""
    return spark.createDataFrame([(i, query_text(t, config)) for i, t in enumerate(texts)], "query_id int, text string")


def rank(store: VectorStore, asked: DataFrame, config: Config, k: int, hybrid: bool = False, filters: dict | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank, ...) of questions (query_id, text) over the index; the hybrid one with the
    ranks and scores of both its sides. Filters come before scoring."""
    chunks, index = store.all(), store.table("postings") if hybrid else None
    asked = embed_column(asked, embedder(config))
    if hybrid:
        return search.hybrid(chunks, asked, k, config.alpha, filters, index)
    if filters:
        chunks = search.metadata_filter(chunks, filters)
    return search.knn_join(asked.select("query_id", "embedding"), chunks.select("chunk_id", "embedding"), k)


def described(store: VectorStore, hits: DataFrame, asked: DataFrame) -> DataFrame:
    """hits with query, doc_id, source and text."""
    rows = hits.join(store.all().select("chunk_id", "doc_id", F.col("source_id").alias("source"), "text", "metadata"), "chunk_id")
    return rows.join(asked.select("query_id", F.col("text").alias("query")), "query_id")


def find(spark: SparkSession, store: VectorStore, text: str, config: Config, hybrid: bool = False, filters: dict | None = None, k: int | None = None, reranker=None) -> DataFrame:
    """Hits (query_id, query, rank, score, chunk_id, doc_id, source, text, metadata) of one question.

    A reranker maps (hits, k) to hits, like search.rerank_keyword; it gets 3k of them.
    """
    asked, k = questions(spark, [text], config), clamp(k or config.top_k)
    rows = described(store, rank(store, asked, config, 3 * k if reranker else k, hybrid, filters), asked)
    return reranker(rows, k) if reranker else rows


def query_parent(store: VectorStore, asked: DataFrame, config: Config, k: int | None = None) -> DataFrame:
    """(query_id, source_id, rank, score, text, child_chunks, metadata): the first k sources of the 3k nearest chunks
    of questions (query_id, text), each source whole."""
    k = clamp(k or config.top_k)
    return search.parents(rank(store, asked, config, 3 * k), store.all(), k)


def query_expanded(store: VectorStore, asked: DataFrame, config: Config, k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the nearest chunks of all variants of questions (query_id, text), merged."""
    k = clamp(k or config.top_k)
    variants = search.variants(asked)
    hits = rank(store, variants.select(F.struct("query_id", "variant").alias("query_id"), "text"), config, k)
    hits = hits.select("query_id.query_id", "query_id.variant", "chunk_id", "score", "rank")
    return search.merge_variants(hits, variants.groupBy("query_id").agg(F.count("*").cast("int").alias("n_variants")), k)


def query_collections(stores: dict[str, VectorStore], asked: DataFrame, config: Config, k: int | None = None, hybrid: bool = False) -> tuple[DataFrame, list[str]]:
    """search.route() over several indexes."""
    k = clamp(k or config.top_k)
    return search.route({name: lambda s=s: rank(s, asked, config, k, hybrid) for name, s in stores.items()}, k)


def ask(spark: SparkSession, store: VectorStore, text: str, config: Config, hybrid: bool = False, k: int | None = None, own: Generator | None = None) -> DataFrame:
    """(query_id, prompt, answer) of a question, answered from the hits by a generator."""
    hits = find(spark, store, text, config, hybrid, None, clamp(k or config.top_k, 100))
    return answers(search.prompt(hits), own or generator(config))
