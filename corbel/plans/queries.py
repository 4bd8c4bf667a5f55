"""Queries over the test tables, with the same in DuckDB's SQL. Scores are rounded to 6 places in the results."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..functions import vectors as V
from ..functions.embedding import DummyEmbedder, embed_cached
from ..operators import ann, bm25, evaluation, graph, search, split
from ..schema import CHUNK
from ..shared import checkpoint, place
from ..sources import loaders, store
from ..streaming.watch import event_windows
from . import index

K = 10
DIM = 64
LANGS = ("de", "en", "es", "fr")
GRAPH_TERMS = graph.TERMS | {"TERM": ["eation", "einber", "eroning", "erreen", "ieroi", "ouque", "pathetic", "thater", "thesea", "tionsh", "unglich", "élement"]}
FROM, TO = "eroning", 3
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).withColumn("embedding", V.dummy_embedding(F.col("text"), DIM))


def embedded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def embedded_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return embedded(spark, d).join(docs, F.col("chunk_id") == F.col("doc_id"))


TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}'']'), lambda x: octet_length(encode(x)) > 1)"
DUMMY = f"[((ascii(substr(sha256(text), (i % 64)::INT + 1, 1)) - 96) / 26.0::DOUBLE)::FLOAT FOR i IN range(0, {DIM})]"


def bm25_sql(chunks: str, queries: str, k: int, name: str = "") -> str:
    """CTEs that end with ranked{name} (query_id, chunk_id, score, rank). chunks: (chunk_id, text); queries: (query_id, text)."""
    p = name
    return rf"""
  c{p} AS ({chunks}), q{p} AS ({queries}),
  terms{p} AS (SELECT chunk_id, unnest({TOKENS}) AS term FROM c{p}),
  post{p} AS (SELECT chunk_id, term, count(*)::DOUBLE AS tf FROM terms{p} GROUP BY ALL),
  len{p} AS (SELECT chunk_id, count(*)::DOUBLE AS dl FROM terms{p} GROUP BY ALL),
  stats{p} AS (SELECT (SELECT count(*) FROM c{p})::DOUBLE AS n, coalesce((SELECT sum(dl) FROM len{p}), 0) / (SELECT greatest(count(*), 1) FROM c{p}) AS avgdl),
  df{p} AS (SELECT term, count(*)::DOUBLE AS df FROM post{p} GROUP BY ALL),
  want{p} AS (SELECT query_id, term, count(*)::DOUBLE AS qn FROM (SELECT query_id, unnest({TOKENS}) AS term FROM q{p}) GROUP BY ALL),
  scored{p} AS (
    SELECT query_id, chunk_id, sum(qn * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
    FROM want{p} JOIN post{p} USING (term) JOIN df{p} USING (term) JOIN len{p} USING (chunk_id), stats{p} GROUP BY ALL),
  ranked{p} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored{p}) WHERE rank <= {k})"""


def knn_sql(chunks: str, queries: str, k: int, name: str = "", also: str = "true") -> str:
    """CTEs that end with near{name}, as ranked in bm25_sql; both tables have an embedding."""
    p = name
    return f"""
  vc{p} AS ({chunks}), vq{p} AS ({queries}),
  pairs{p} AS (SELECT query_id, chunk_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM vq{p} q, vc{p} c WHERE {also}),
  near{p} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM pairs{p}) WHERE rank <= {k})"""


DOCS_SQL = "SELECT doc_id AS chunk_id, text FROM documents"
ASKED_SQL = "SELECT item_id AS query_id, text FROM benchmark"
ASKED_VECTORS_SQL = f"SELECT item_id AS query_id, text, {DUMMY} AS embedding FROM benchmark"
EMBEDDED_SQL = "SELECT vec_id AS chunk_id, embedding, label FROM embeddings"
EMBEDDED_DOCS_SQL = "SELECT vec_id AS chunk_id, embedding, d.* FROM embeddings JOIN documents d ON vec_id = doc_id"


# Scalar functions


@query(f"WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term")
def term_stats(spark, d):
    return bm25.postings(table(spark, d, "documents")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"SELECT count(*) AS n, round(sum(len({TOKENS})) / count(*), 6)::DOUBLE AS avgdl FROM documents")
def corpus_stats(spark, d):
    docs = table(spark, d, "documents")
    return rounded(bm25.corpus_stats(docs, bm25.postings(docs)), "avgdl")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def fingerprints(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("content_hash"))


@query(rf"""
WITH w AS (SELECT doc_id, [regexp_replace(lower(x), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') FOR x IN regexp_split_to_array(text, '[\s\x0b\x85\p{{Z}}]+') IF x <> ''] AS words FROM documents)
SELECT doc_id, array_to_string(list_filter(words, lambda x: octet_length(encode(x)) > 2 AND x NOT IN ({", ".join(f"'{x}'" for x in T.STOP_WORDS)})), ' ') AS keywords FROM w""")
def keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


@query(r"SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f-\x{9f}]', '', 'g') AS clean FROM documents")
def sanitized(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sanitize(F.col("text")).alias("clean"))


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script[^>]*>', '', 'g'), '(?is)<style[^>]*>.*?</style[^>]*>', '', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')) AS text FROM a""")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query(f"SELECT doc_id, array_to_string([round(x::DOUBLE, 6) FOR x IN {DUMMY}], ' ') AS embedding FROM (SELECT doc_id, text FROM documents)")
def dummy_embed(spark, d):
    return table(spark, d, "documents").select("doc_id", _spelled(V.dummy_embedding(F.col("text"), DIM)).alias("embedding"))


def _spelled(v):
    return F.array_join(F.transform(v, lambda x: F.round(x.cast("double"), 6).cast("string")), " ")


@query("""
WITH r AS (SELECT vec_id, embedding, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high FROM embeddings)
SELECT vec_id, array_to_string([CASE WHEN high > low THEN round((x::DOUBLE - low) / (high - low) * 255)::INT ELSE 128 END FOR x IN embedding], ' ') AS codes, round(low, 6) AS low, round(high, 6) AS high FROM r""")
def quantize_uint8(spark, d):
    q = V.quantize_uint8(F.col("embedding"))
    return rounded(table(spark, d, "embeddings").select("vec_id", q.alias("q")).select("vec_id", F.array_join(F.transform("q.codes", lambda x: x.cast("string")), " ").alias("codes"), "q.low", "q.high"), "low", "high")


@query("""
WITH r AS (SELECT vec_id, embedding, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high FROM embeddings)
SELECT vec_id, round(list_max([abs(x - (low + round((x::DOUBLE - low) / (high - low) * 255) / 255 * (high - low))) FOR x IN embedding]), 6) AS error FROM r""")
def dequantize_uint8(spark, d):
    q = V.quantize_uint8(F.col("embedding"))
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", q.alias("q"))
    back = V.dequantize_uint8(F.col("q.codes"), F.col("q.low"), F.col("q.high"))
    return rounded(rows.select("vec_id", F.array_max(F.zip_with("embedding", back, lambda x, y: F.abs(x.cast("double") - y))).alias("error")), "error")


@query("SELECT vec_id, 256 AS f32, 128 AS f16, 72 AS uint8, true AS exact FROM embeddings")
def embedding_codecs(spark, d):
    """Sizes of the stored formats, and whether 32 bits give the vector back."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", *[V.encoded(F.col("embedding"), k).alias(k) for k in ("f32", "f16", "uint8")])
    return rows.select("vec_id", *[F.octet_length(k).alias(k) for k in ("f32", "f16", "uint8")], (V.decoded(F.col("f32"), "f32") == F.col("embedding")).alias("exact"))


# Splitters


@query(rf"""
WITH w AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, CASE WHEN length(text) <= 512 THEN 1 ELSE ceil((length(text) - 512) / 462.0)::BIGINT + 1 END)) AS i FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, n, i, substring(text, i * 462 + 1, 512) AS text FROM w)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, text FROM p WHERE n <= 512 OR regexp_matches(text, '[^\s\x0b\x{{85}}\p{{Z}}]')""")
def split_text_chars(spark, d):
    return split.split_chars(table(spark, d, "documents"))


SENTENCES = r"regexp_split_to_array(regexp_replace(text, '([.!?])[\s\x0b\x{85}\p{Z}]+([\p{Lu}\x{2160}-\x{216f}\x{24b6}-\x{24cf}\x22''])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@query(rf"""
WITH s AS (SELECT doc_id, [regexp_replace(x, '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g') FOR x IN {SENTENCES}] AS s FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, list_filter(s, lambda x: x <> '') AS s FROM s)
SELECT doc_id, unnest(range(0, len(s)))::INT AS pos, unnest(s) AS sentence FROM k""")
def split_sentences(spark, d):
    return split.sentence_rows(table(spark, d, "documents"))


def _chunks(rows):
    return rows.select("doc_id", "chunk_index", "text")


def border_sql(p: str) -> str:
    """The first byte from p on that begins a character, or the end; h is the text in hex, n its bytes."""
    cont = lambda x: f"({x} < n AND substr(h, ({2} * ({x}) + 1)::INT, 1) IN ('8', '9', 'a', 'b'))"
    return f"(CASE WHEN NOT {cont(p)} THEN {p} WHEN NOT {cont(f'{p} + 1')} THEN {p} + 1 WHEN NOT {cont(f'{p} + 2')} THEN {p} + 2 ELSE {p} + 3 END)"


@query(rf"""
WITH RECURSIVE t AS (SELECT doc_id, lower(hex(encode(text))) AS h, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) > 512),
w(doc_id, h, n, r, a, e) AS (
  SELECT doc_id, h, n, 0::BIGINT, 0::BIGINT, {border_sql("512")} FROM t
  UNION ALL
  SELECT doc_id, h, n, r, {border_sql("r")}, {border_sql("least(r + 512, n)")} FROM (SELECT doc_id, h, n, a + 462 AS r FROM w WHERE e < n AND a + 462 < n)),
p AS (SELECT doc_id, a, decode(unhex(substr(h, (2 * a + 1)::INT, (2 * (e - a))::INT))) AS text FROM w WHERE a < e)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS chunk_index, text FROM p WHERE regexp_matches(text, '[^\s\x0b\x{{85}}\p{{Z}}]')
UNION ALL SELECT doc_id, 0, text FROM documents WHERE octet_length(encode(text)) <= 512""".replace("\\\\", "\\"))
def split_text_bytes(spark, d):
    return _chunks(split.split_bytes(table(spark, d, "documents")))


@query(r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s\x0b\x{85}\p{Z}]+'), lambda x: x <> '') AS words FROM documents WHERE ceil(octet_length(encode(text)) / 4.0) > 256),
u AS (SELECT doc_id, words, [ceil(octet_length(encode(x)) / 4.0)::BIGINT FOR x IN words] AS k, [octet_length(encode(x)) FOR x IN words] AS b FROM t WHERE len(words) > 0),
-- sums of the tokens and bytes of the first words, from none on
s AS (SELECT doc_id, words, list_transform(range(0, len(words) + 1), lambda i: coalesce(list_sum(k[1:i]), 0)::BIGINT) AS k, list_transform(range(0, len(words) + 1), lambda i: coalesce(list_sum(b[1:i]), 0)::BIGINT) AS b FROM u WHERE len(words) <= 400),
long AS (SELECT doc_id, unnest(range(0, len(words) + 1)) AS i, unnest(list_prepend(0, k)) AS k, unnest(list_prepend(0, b)) AS b FROM u WHERE len(words) > 400),
sums AS (SELECT doc_id, i, sum(k) OVER o AS k, sum(b) OVER o AS b FROM long WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
every AS (
  SELECT doc_id, words, k, b FROM s
  UNION ALL SELECT doc_id, words, x.k, x.b FROM (SELECT doc_id, list(k::BIGINT ORDER BY i) AS k, list(b::BIGINT ORDER BY i) AS b FROM sums GROUP BY doc_id) x JOIN (SELECT doc_id, words FROM u) USING (doc_id)),
-- words first to last - 1 are a chunk; those from `fresh` on are new in it
c(doc_id, first, fresh, last) AS (
  SELECT doc_id, 0::BIGINT, 0::BIGINT, greatest(1, len(list_filter(k, lambda x: x <= 256)) - 1)::BIGINT FROM every
  UNION ALL
  SELECT doc_id, f, l, greatest(l + 1, len(list_filter(k, lambda x: x - k[l + 1] + base <= 256)) - 1)
  FROM (SELECT doc_id, k, f, l, CASE WHEN l > f THEN ceil((b[l + 1] - b[f + 1] + l - f - 1) / 4.0)::BIGINT ELSE 0 END AS base
    FROM (SELECT doc_id, k, b, last AS l, greatest(first, len(list_filter(k, lambda x: x < k[last + 1] - 20))) AS f FROM c JOIN every USING (doc_id) WHERE last < len(words))))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY last) - 1)::INT AS chunk_index, array_to_string(words[first + 1:last], ' ') AS text FROM c JOIN every USING (doc_id)
UNION ALL SELECT doc_id, 0, text FROM documents WHERE ceil(octet_length(encode(text)) / 4.0) <= 256""")
def split_tokens(spark, d):
    return _chunks(split.split_tokens(table(spark, d, "documents")))


@query()
def split_sentence_pack(spark, d):
    return _chunks(split.split_sentence_groups(table(spark, d, "documents")))


@query()
def split_semantic(spark, d):
    return _chunks(split.split_semantic(table(spark, d, "documents")))


# Search


@query(f"WITH {bm25_sql(DOCS_SQL, ASKED_SQL, K)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ranked")
def bm25_topk(spark, d):
    return rounded(bm25.search(table(spark, d, "documents"), asked(spark, d), K), "score")


def _first_vector(spark, d):
    return table(spark, d, "embeddings").agg(F.min_by("embedding", "vec_id")).first()[0]


FIRST_SQL = "SELECT 0 AS query_id, embedding FROM embeddings ORDER BY vec_id LIMIT 1"


@query(f"WITH {knn_sql(EMBEDDED_SQL, FIRST_SQL, K)} SELECT chunk_id, round(score, 6) AS score, round(1 - score, 6) AS distance FROM near")
def vector_topk(spark, d):
    return rounded(search.vector_search(embedded(spark, d), _first_vector(spark, d), K), "score", "distance")


@query(f"WITH {knn_sql(EMBEDDED_DOCS_SQL + " WHERE lang = 'fr' AND source = 'src1'", FIRST_SQL, K)} SELECT chunk_id, round(score, 6) AS score, round(1 - score, 6) AS distance FROM near")
def vector_topk_filtered(spark, d):
    return rounded(search.vector_search(embedded_documents(spark, d), _first_vector(spark, d), K, {"lang": "fr", "source": "src1"}), "score", "distance")


@query(f"WITH {knn_sql(EMBEDDED_DOCS_SQL, FIRST_SQL, 3 * K)} SELECT chunk_id, round(score, 6) AS score, round(1 - score, 6) AS distance FROM near JOIN documents ON chunk_id = doc_id WHERE lang = 'fr' ORDER BY round(score, 9) DESC, chunk_id LIMIT {K}")
def vector_topk_postfiltered(spark, d):
    return rounded(search.vector_search(embedded_documents(spark, d), _first_vector(spark, d), K, {"lang": "fr"}, "post"), "score", "distance")


SELF_SQL = "SELECT vec_id AS query_id, embedding, label FROM embeddings"


@query(f"WITH {knn_sql(EMBEDDED_SQL, SELF_SQL, 5, also='query_id <> chunk_id')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM near")
def knn_join(spark, d):
    rows = embedded(spark, d)
    return rounded(search.knn_join(rows.select(F.col("chunk_id").alias("query_id"), "embedding"), rows, 5, others=True), "score")


@query()
def ann_knn(spark, d):
    """Approximate neighbours of all vectors by the inverted file."""
    rows = embedded(spark, d).select("chunk_id", "embedding")
    at = place(spark, "vectors")
    ann.save(rows, at)
    return rounded(ann.search(rows.withColumnRenamed("chunk_id", "query_id"), *ann.load(spark, at), K, others=True), "score")


HYBRID_SQL = f"""WITH {bm25_sql("SELECT chunk_id, text FROM (" + EMBEDDED_DOCS_SQL + ")", ASKED_SQL, 3 * K)}, {knn_sql(EMBEDDED_DOCS_SQL, ASKED_VECTORS_SQL, 3 * K)},
fused AS (SELECT query_id, chunk_id, n.rank AS v_rank, n.score AS v_score, r.rank AS b_rank, r.score AS b_score, coalesce(0.5::DOUBLE / (60 + n.rank), 0) + coalesce(0.5::DOUBLE / (60 + r.rank), 0) AS score
  FROM near n FULL OUTER JOIN ranked r USING (query_id, chunk_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM fused) WHERE rank <= {K})"""


@query(f"{HYBRID_SQL} SELECT query_id, chunk_id, v_rank, round(v_score, 6) AS v_score, b_rank, round(b_score, 6) AS b_score, round(score, 6) AS score, rank FROM best")
def hybrid_rrf(spark, d):
    return rounded(search.hybrid(embedded_documents(spark, d), asked_vectors(spark, d), K), "v_score", "b_score", "score")


WORDS = r"list_filter(regexp_split_to_array(lower({}), '[\s\x0b\x{{85}}\p{{Z}}]+'), lambda x: x <> '')"


@query(f"""WITH {bm25_sql(DOCS_SQL, ASKED_SQL, 3 * K)},
o AS (SELECT r.query_id, r.chunk_id, r.rank AS old, list_distinct({WORDS.format("q.text")}) AS a, list_distinct({WORDS.format("c.text")}) AS b FROM ranked r JOIN q USING (query_id) JOIN c USING (chunk_id)),
s AS (SELECT query_id, chunk_id, old, len(list_intersect(a, b))::DOUBLE / greatest(len(a), 1) AS score FROM o)
SELECT query_id, chunk_id, round(score, 6) AS score, rank, round(1 - score, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old, chunk_id) AS rank FROM s) WHERE rank <= {K}""")
def rerank_keyword(spark, d):
    docs, q = table(spark, d, "documents"), asked(spark, d)
    hits = bm25.search(docs, q, 3 * K).join(docs.select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id").join(q.withColumnRenamed("text", "query"), "query_id")
    return rounded(search.rerank_keyword(hits, K).select("query_id", "chunk_id", "score", "rank", "distance"), "score", "distance")


TURNS_SQL = "SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS source_id, turn AS chunk_index, text FROM conversations"


@query(f"""WITH {bm25_sql(TURNS_SQL, ASKED_SQL, 15)},
seen AS (SELECT query_id, source_id, min(rank) AS first, arg_min(score, rank) AS score FROM ranked JOIN c USING (chunk_id) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM seen) WHERE rank <= 5),
whole AS (SELECT source_id, string_agg(text, chr(10) ORDER BY chunk_index, chunk_id) AS text, count(*) AS child_chunks FROM c GROUP BY ALL)
SELECT query_id, source_id, rank, round(score, 6) AS score, text, child_chunks FROM best JOIN whole USING (source_id)""")
def parent_child(spark, d):
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("source_id"), F.col("turn").alias("chunk_index"), "text")
    hits = bm25.search(turns, asked(spark, d), 15, "chunk_id")
    return rounded(search.parents(hits, turns, 5).drop("metadata"), "score")


@query(
    "WITH "
    + ", ".join(knn_sql(EMBEDDED_DOCS_SQL + f" WHERE lang = '{x}'", ASKED_VECTORS_SQL, K, x) for x in LANGS)
    + ", every AS ("
    + " UNION ALL ".join(f"SELECT query_id, chunk_id, score, '{x}' AS collection FROM near{x}" for x in LANGS)
    + f"), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM every) SELECT query_id, chunk_id, round(score, 6) AS score, collection, rank FROM best WHERE rank <= {K}"
)
def multi_collection(spark, d):
    rows, q = embedded_documents(spark, d), asked_vectors(spark, d)
    hits, failed = search.route({x: lambda x=x: search.knn_join(q, rows.filter(F.col("lang") == x), K) for x in LANGS}, K)
    assert not failed, failed
    return rounded(hits, "score")


EXPANDED_SQL = rf"""base AS (SELECT item_id AS query_id, regexp_replace(text, '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g') AS t FROM benchmark),
keyed AS (SELECT query_id, t, lower(t) AS low, list_filter([regexp_replace(lower(x), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') FOR x IN regexp_split_to_array(t, '[\s\x0b\x{{85}}\p{{Z}}]+') IF x <> ''],
  lambda x: octet_length(encode(x)) > 2 AND x NOT IN ({", ".join(f"'{x}'" for x in T.STOP_WORDS)})) AS keys FROM base),
forms AS (SELECT query_id, list_filter([t,
  CASE WHEN suffix(t, '?') THEN NULL WHEN regexp_matches(low, '^(what|how|why|when|where|who)') THEN t || '?' ELSE 'What is ' || t || '?' END,
  CASE WHEN len(keys) >= 2 THEN array_to_string(keys, ' ') END,
  CASE WHEN NOT contains(low, 'definition') AND NOT contains(low, 'explain') THEN coalesce(keys[1], t) || ' explained' END], lambda x: x IS NOT NULL) AS l FROM keyed WHERE t <> ''),
told AS (SELECT query_id, list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]) AS l FROM forms),
variants AS (SELECT query_id, unnest(range(0, len(l))) AS variant, unnest(l) AS text, len(l) AS n_variants FROM told)"""
MERGED_SQL = """m AS (SELECT query_id, chunk_id, max(score) AS raw, arg_min(score + 0.01::DOUBLE * (n_variants - 1) / rank, variant * 1000 + rank) AS raised FROM h GROUP BY ALL),
s AS (SELECT query_id, chunk_id, greatest(raw, raised) AS score FROM m)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= {k}"""


@query(f"WITH {EXPANDED_SQL} SELECT query_id, variant::INT AS variant, text FROM variants")
def expansions(spark, d):
    return search.variants(asked(spark, d))


@query(f"""WITH {EXPANDED_SQL}, {bm25_sql(DOCS_SQL, "SELECT query_id * 100 + variant AS query_id, text FROM variants", K)},
h AS (SELECT v.query_id, variant, n_variants, chunk_id, score, rank FROM ranked r JOIN variants v ON r.query_id = v.query_id * 100 + variant), {MERGED_SQL.format(k=K)}""")
def expanded_query(spark, d):
    variants = search.variants(asked(spark, d))
    hits = bm25.search(table(spark, d, "documents"), variants.select((F.col("query_id") * 100 + F.col("variant")).alias("query_id"), "text"), K)
    hits = hits.select(F.floor(F.col("query_id") / 100).alias("query_id"), (F.col("query_id") % 100).alias("variant"), "chunk_id", "score", "rank")
    return rounded(search.merge_variants(hits, variants.groupBy("query_id").agg(F.count("*").alias("n_variants")), K), "score")


@query(f"""WITH {bm25_sql(DOCS_SQL, ASKED_SQL, 3)},
h AS (SELECT r.query_id, q.text AS query, r.rank, coalesce(d.source, 'unknown') AS source, d.text FROM ranked r JOIN q USING (query_id) JOIN documents d ON r.chunk_id = d.doc_id)
SELECT query_id, 'Query: ' || query || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg(chr(10) || '[' || rank || '] Source: ' || source || chr(10) || text || chr(10), '' ORDER BY rank)
  || chr(10) || '---' || chr(10) || 'Answer the query using the provided context.' AS prompt FROM h GROUP BY query_id, query""")
def prompt_context(spark, d):
    docs, q = table(spark, d, "documents"), asked(spark, d)
    hits = bm25.search(docs, q, 3).join(docs.select(F.col("doc_id").alias("chunk_id"), "text", "source"), "chunk_id").join(q.withColumnRenamed("text", "query"), "query_id")
    return search.prompt(hits)


# Index, files, streams


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def dedup_exact(spark, d):
    return store.exact_duplicates(table(spark, d, "documents"))


@query("""
WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE source <> 'src2'), b AS (SELECT doc_id, sha256(CASE WHEN source = 'src1' THEN upper(text) ELSE text END) AS h FROM documents WHERE source <> 'src0')
SELECT doc_id, CASE WHEN b.h IS NULL THEN 'new' WHEN a.h IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM a FULL OUTER JOIN b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h""")
def incremental_diff(spark, d):
    """The table without one source, against an earlier state without another and with a third one changed."""
    docs = table(spark, d, "documents")
    now = docs.filter("source <> 'src2'").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    before = docs.filter("source <> 'src0'").select("doc_id", F.sha2(F.when(F.col("source") == "src1", F.upper("text")).otherwise(F.col("text")), 256).alias("content_hash"))
    return store.diff(now, before, "doc_id")


@query("SELECT doc_id::VARCHAR AS id, text, lang, source FROM documents WHERE text <> ''")
def jsonl_roundtrip(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))
    lines = docs.select(F.to_json(F.struct("id", "text", "metadata")).alias("value"))
    return loaders.parse_jsonl(lines).select("id", "text", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"))


@query("SELECT doc_id::VARCHAR AS doc_id, lang, 64 AS dimension FROM documents WHERE lang <> 'de'")
def store_lifecycle(spark, d):
    """Every document stored as a chunk, some again, and one language deleted."""
    docs = table(spark, d, "documents")
    text, own = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    chunks = docs.select(
        split.chunk_id(F.col("doc_id"), F.lit(0), text).alias("chunk_id"), own.alias("doc_id"), own.alias("source_id"), F.lit(0).alias("chunk_index"), text.alias("text"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"), V.dummy_embedding(text, DIM).alias("embedding"),
    )
    s = store.Store(spark, place(spark, "store"))
    s.add(chunks.select(*CHUNK.fieldNames()), "dummy-64")
    s.add(chunks.filter("metadata['lang'] = 'en'").select(*CHUNK.fieldNames()), "dummy-64")
    s.delete(s.find({"lang": "de"}).select("doc_id"))
    return s.all().select("doc_id", F.col("metadata")["lang"].alias("lang"), F.size("embedding").alias("dimension"))


CONF = Config(dimension=DIM, top_k=K)


def _indexed(spark, rows):
    """A stored index of rows (chunk_id string, source_id, chunk_index, text, metadata, embedding)."""
    s = store.Store(spark, place(spark, "store"))
    s.add(rows.withColumn("doc_id", F.col("source_id")).select(*[F.col(f.name).cast(f.dataType) for f in CHUNK.fields]), "dummy-64")
    return s


def _indexed_documents(spark, d):
    rows = embedded_documents(spark, d).withColumn("chunk_id", F.format_string("d%07d", "doc_id"))
    return _indexed(spark, rows.select("chunk_id", F.col("doc_id").cast("string").alias("source_id"), F.lit(0).alias("chunk_index"), F.coalesce("text", F.lit("")).alias("text"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"), "embedding"))


def _indexed_turns(spark, d):
    turns = table(spark, d, "conversations").select(F.format_string("c%07d-%03d", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").cast("string").alias("source_id"), F.col("turn").alias("chunk_index"), "text")
    return _indexed(spark, turns.select("*", F.create_map(F.lit("role"), F.lit("x")).alias("metadata"), V.dummy_embedding(F.col("text"), DIM).alias("embedding")))


STORED_SQL = "SELECT format('d{:07d}', vec_id) AS chunk_id, coalesce(text, '') AS text, lang, embedding FROM embeddings JOIN documents ON vec_id = doc_id"
STORED_TURNS_SQL = f"SELECT format('c{{:07d}}-{{:03d}}', conv_id, turn) AS chunk_id, conv_id::VARCHAR AS source_id, turn, text, {DUMMY} AS embedding FROM conversations"


@query(f"WITH {knn_sql(STORED_SQL, ASKED_VECTORS_SQL, K)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM near")
def store_knn(spark, d):
    """All questions against the vectors of a stored index, whose ids are strings."""
    return rounded(index.rank(_indexed_documents(spark, d), asked(spark, d), CONF, K), "score")


@query(f"""WITH {bm25_sql(STORED_SQL + " WHERE lang = 'en'", ASKED_SQL, 3 * K)}, {knn_sql(STORED_SQL + " WHERE lang = 'en'", ASKED_VECTORS_SQL, 3 * K)},
fused AS (SELECT query_id, chunk_id, n.rank AS v_rank, r.rank AS b_rank, coalesce(0.5::DOUBLE / (60 + n.rank), 0) + coalesce(0.5::DOUBLE / (60 + r.rank), 0) AS score FROM near n FULL OUTER JOIN ranked r USING (query_id, chunk_id))
SELECT query_id, chunk_id, v_rank, b_rank, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM fused) WHERE rank <= {K}""")
def store_hybrid(spark, d):
    """All questions against vectors and postings of a stored index, over one language."""
    hits = index.rank(_indexed_documents(spark, d), asked(spark, d), CONF, K, True, {"lang": "en"})
    return rounded(hits.select("query_id", "chunk_id", "v_rank", "b_rank", "score", "rank"), "score")


@query(f"""WITH {knn_sql(STORED_TURNS_SQL, ASKED_VECTORS_SQL, 3 * K)},
seen AS (SELECT query_id, source_id, min(rank) AS first, arg_min(score, rank) AS score FROM near JOIN vc USING (chunk_id) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM seen) WHERE rank <= {K}),
whole AS (SELECT source_id, string_agg(text, chr(10) ORDER BY turn, chunk_id) AS text, count(*) AS child_chunks FROM vc GROUP BY ALL)
SELECT query_id, source_id, rank, round(score, 6) AS score, text, child_chunks FROM best JOIN whole USING (source_id)""")
def store_parent(spark, d):
    """Whole conversations by the turns that are nearest to all questions, over a stored index."""
    return rounded(index.query_parent(_indexed_turns(spark, d), asked(spark, d), CONF).drop("metadata"), "score")


@query(f"""WITH {EXPANDED_SQL}, {knn_sql(STORED_SQL, f"SELECT query_id * 100 + variant AS query_id, text, {DUMMY} AS embedding FROM variants", K)},
h AS (SELECT v.query_id, variant, n_variants, chunk_id, score, rank FROM near r JOIN variants v ON r.query_id = v.query_id * 100 + variant), {MERGED_SQL.format(k=K)}""")
def store_expanded(spark, d):
    """The variants of all questions over a stored index, merged."""
    return rounded(index.query_expanded(_indexed_documents(spark, d), asked(spark, d), CONF), "score")


@query(f"""WITH {knn_sql(STORED_SQL, ASKED_VECTORS_SQL, K, "a")}, {knn_sql(STORED_TURNS_SQL, ASKED_VECTORS_SQL, K, "b")},
every AS (SELECT query_id, chunk_id, score, 'documents' AS collection FROM neara UNION ALL SELECT query_id, chunk_id, score, 'turns' FROM nearb)
SELECT query_id, chunk_id, round(score, 6) AS score, collection, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM every) WHERE rank <= {K}""")
def store_collections(spark, d):
    """Two stored indexes and one that can't be read."""
    broken = store.MemoryStore(spark)
    broken._chunks = spark.range(1).select(F.raise_error(F.lit("broken")).cast("string").alias("chunk_id"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"))
    hits, failed = index.query_collections({"documents": _indexed_documents(spark, d), "turns": _indexed_turns(spark, d), "broken": broken}, asked(spark, d), CONF)
    assert len(failed) == 1, failed
    return rounded(hits, "score")


@query("SELECT lang, count(*) AS chunks FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY lang")
def store_counts(spark, d):
    return _indexed_documents(spark, d).counts("lang")


@query(ORACLE["dummy_embed"])
def embed_cache(spark, d):
    """Embeddings of all documents, those of one language from a cache."""
    docs = table(spark, d, "documents")
    held = docs.filter("lang = 'en'").select(F.lit("dummy-64").alias("model"), F.sha2("text", 256).alias("text_hash"), V.dummy_embedding(F.col("text"), DIM).alias("embedding")).dropDuplicates(["text_hash"])
    rows, _ = embed_cached(docs.select("doc_id", "text"), held, DummyEmbedder(DIM))
    return rows.select("doc_id", _spelled(F.col("embedding")).alias("embedding"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_counts(spark, d):
    return rounded(event_windows(table(spark, d, "events")), "total")


# Graph


def _entities(spark, d):
    return graph.entities(table(spark, d, "documents"), GRAPH_TERMS, nouns=False, id_col="doc_id")


TERMS_SQL = f"terms(name, type) AS (VALUES {', '.join(f"('{t}', '{kind}')" for kind in GRAPH_TERMS for t in GRAPH_TERMS[kind])}), m AS (SELECT doc_id AS chunk_id, name, type FROM documents, terms WHERE contains(lower(text), name)), e AS (SELECT a.name AS source, b.name AS target, count(*) AS weight FROM m a JOIN m b USING (chunk_id) WHERE a.name < b.name GROUP BY ALL)"
WALK_SQL = "both_ways AS (SELECT source, target FROM e UNION SELECT target, source FROM e), walk(start, name, depth) AS (SELECT start, start, 0 FROM starts UNION SELECT start, target, depth + 1 FROM walk JOIN both_ways ON name = source WHERE depth < {hops}), reached AS (SELECT start, name, min(depth) AS depth FROM walk GROUP BY ALL)"


@query(f"WITH {TERMS_SQL} SELECT name, type, count(*) AS chunks FROM m GROUP BY ALL")
def graph_nodes(spark, d):
    return graph.nodes(_entities(spark, d))


@query(f"WITH {TERMS_SQL} SELECT * FROM e")
def graph_cooccurrence(spark, d):
    return graph.cooccurrence(_entities(spark, d))


@query(f"WITH RECURSIVE {TERMS_SQL}, starts(start) AS (VALUES ('{FROM}'), ('nowhere')), {WALK_SQL.format(hops=TO)} SELECT start, name, depth FROM reached")
def graph_bfs(spark, d):
    return graph.traverse(graph.cooccurrence(_entities(spark, d)), spark.createDataFrame([(FROM,), ("nowhere",)], "start string"), TO)


@query(f"WITH {TERMS_SQL} SELECT target AS name, weight FROM e WHERE source = 'eation' UNION ALL SELECT source, weight FROM e WHERE target = 'eation'")
def graph_neighbours(spark, d):
    return graph.neighbours(graph.cooccurrence(_entities(spark, d)), "eation", both=True)


def _graph_hits(spark, d, k):
    held = checkpoint(_entities(spark, d))
    q = spark.createDataFrame([(0, FROM), (1, "einber"), (1, "ieroi")], "query_id int, name string")
    return graph.retrieve(graph.cooccurrence(held), graph.mentions(held), q, k, 1)


GRAPH_HITS_SQL = f"""{TERMS_SQL}, ask(query_id, start) AS (VALUES (0, '{FROM}'), (1, 'einber'), (1, 'ieroi')), starts AS (SELECT DISTINCT start FROM ask), {WALK_SQL.format(hops=1)},
g AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (min(depth) + 1) AS score FROM ask JOIN reached USING (start) JOIN m USING (name) GROUP BY ALL),
gr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM g) WHERE rank <= {{k}})"""


@query(f"WITH RECURSIVE {GRAPH_HITS_SQL.format(k=K)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM gr")
def graph_retrieve(spark, d):
    return rounded(_graph_hits(spark, d, K), "score")


@query(f"""WITH RECURSIVE {GRAPH_HITS_SQL.format(k=3 * K)}, {knn_sql(EMBEDDED_SQL, ASKED_VECTORS_SQL, 3 * K)},
f AS (SELECT n.query_id, n.chunk_id, n.rank AS v_rank, gr.rank AS g_rank, coalesce(0.5::DOUBLE / (60 + gr.rank), 0) + 0.5::DOUBLE / (60 + n.rank) AS score FROM near n LEFT JOIN gr USING (query_id, chunk_id))
SELECT query_id, chunk_id, v_rank, g_rank, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM f) WHERE rank <= {K}""")
def graph_vector_fusion(spark, d):
    near = search.knn_join(asked_vectors(spark, d).select("query_id", "embedding"), embedded(spark, d).select("chunk_id", "embedding"), 3 * K)
    return rounded(search.graph_fusion(_graph_hits(spark, d, 3 * K), near, K), "score")


COMMON_SQL = ", ".join(f"'{w}'" for w in sorted(graph.COMMON))


@query(rf"""
WITH w AS (SELECT doc_id, unnest(l) AS raw, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s\x0b\x{{85}}\p{{Z}}]+'), lambda x: x <> '') AS l FROM documents)),
c AS (SELECT doc_id, i, raw, regexp_replace(raw, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS word FROM w),
b AS (SELECT *, octet_length(encode(word)) > 1 AND regexp_matches(word, '^\p{{Lu}}') AS big, lag(raw) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c),
-- runs of words with capitals; a name begins at the first of a run that begins no sentence
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run, i > 0 AND NOT regexp_matches(before, '[.!?]$') AS may FROM b WHERE big),
f AS (SELECT *, min(CASE WHEN may THEN i END) OVER (PARTITION BY doc_id, run) AS first FROM r),
n AS (SELECT doc_id, lower(string_agg(word, ' ' ORDER BY i)) AS name, count(*) AS k FROM f WHERE i >= first GROUP BY doc_id, run),
d AS (SELECT DISTINCT doc_id, name, CASE WHEN k > 1 THEN 'PROPER_NOUN' ELSE 'NOUN' END AS type FROM n WHERE name NOT IN ({COMMON_SQL})),
one AS (SELECT doc_id, name, max(type) AS type FROM d GROUP BY ALL)
SELECT name, max(type) AS type, count(*) AS chunks FROM one GROUP BY name""")
def graph_proper_nouns(spark, d):
    return graph.nodes(graph.entities(table(spark, d, "documents"), {}, id_col="doc_id"))


# Evaluation


EVAL_SQL = f"""WITH {knn_sql(EMBEDDED_SQL, SELF_SQL, K, also='query_id <> chunk_id')},
hits AS (SELECT n.query_id, n.rank, q.label = c.label AS good FROM near n JOIN vq q USING (query_id) JOIN vc c USING (chunk_id)),
totals AS (SELECT vec_id AS query_id, count(*) OVER (PARTITION BY label) - 1 AS n_relevant FROM embeddings),
ideal AS (SELECT n, sum(1 / log2(n2 + 1)) AS best FROM (SELECT unnest(range(1, 6)) AS n) JOIN (SELECT unnest(range(1, 6)) AS n2) ON n2 <= n GROUP BY n),
agg AS (SELECT query_id, min(rank) FILTER (good) AS first, count(*) FILTER (good AND rank <= 5) AS hit, count(*) FILTER (rank <= 5) AS n_all, sum(1 / log2(rank + 1)) FILTER (good AND rank <= 5) AS dcg FROM hits GROUP BY ALL),
m AS (SELECT query_id, coalesce(1.0::DOUBLE / first, 0) AS mrr, CASE WHEN n_relevant > 0 THEN coalesce(hit, 0)::DOUBLE / n_relevant ELSE 0 END AS recall, coalesce(hit::DOUBLE / n_all, 0) AS "precision", CASE WHEN n_relevant > 0 THEN coalesce(dcg / best, 0) ELSE 0 END AS ndcg
  FROM totals LEFT JOIN agg USING (query_id) LEFT JOIN ideal ON n = least(n_relevant, 5))"""


def _metrics(spark, d):
    rows = embedded(spark, d)
    q = rows.select(F.col("chunk_id").alias("query_id"), "embedding", "label")
    near = search.knn_join(q, rows, K, others=True)
    hits = near.join(q.select("query_id", F.col("label").alias("own")), "query_id").join(rows.select("chunk_id", "label"), "chunk_id")
    totals = q.select("query_id", (F.count("*").over(Window.partitionBy("label")) - 1).alias("n_relevant"))
    return evaluation.metrics(hits.select("query_id", "rank", F.col("chunk_id").alias("doc_id"), (F.col("own") == F.col("label")).alias("relevant")), totals, 5)


@query(EVAL_SQL + ' SELECT query_id, round(mrr, 6) AS mrr, round(recall, 6) AS recall, round("precision", 6) AS "precision", round(ndcg, 6) AS ndcg FROM m')
def eval_metrics(spark, d):
    return rounded(_metrics(spark, d), "mrr", "recall", "precision", "ndcg")


@query(EVAL_SQL + ' SELECT count(*) AS queries, round(avg(mrr), 6) AS mrr, round(avg(recall), 6) AS recall, round(avg("precision"), 6) AS "precision", round(avg(ndcg), 6) AS ndcg FROM m')
def eval_summary(spark, d):
    return rounded(evaluation.summary(_metrics(spark, d)), "mrr", "recall", "precision", "ndcg")
