"""Approximate nearest neighbours by an inverted file: a stored table of vectors by their nearest of many centroids."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25
from .nearest import nearest

#: Vectors at most that the centroids are fitted to; every vector is indexed.
SAMPLE = 100_000
ROUNDS = 8
#: Lists, and those that a search reads. Vectors without any structure need these many for a recall of 0.9.
LISTS, PROBES = 64, 40


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    v = col.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(col), dim)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def fit(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE) -> np.ndarray:
    """(lists, dimension) centroids of unit length, by k-means over the `sample` vectors that come first by a hash of
    their id (chunk_id, embedding), the same for the same rows."""
    some = vectors.filter("embedding is not null").orderBy(F.xxhash64("chunk_id"), "chunk_id").select("embedding").limit(sample).toArrow()
    if not some.num_rows:
        raise ValueError("no vector to fit to")
    col = some.column(0).combine_chunks()
    x = _matrix(col, len(col[0]))
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(n > 0, total / np.where(n > 0, n, 1), c)
    return c


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(chunk_id, embedding, list) of all vectors that aren't null; to be written partitioned by list, so that a
    search reads the lists that it probes."""
    id_type = vectors.select("chunk_id").dtypes[0][1]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own = np.argmax(_matrix(batch.column(1), centroids.shape[1]) @ centroids.T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], ["chunk_id", "embedding", "list"])

    rows = vectors.filter("embedding is not null").select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.mapInArrow(run, f"chunk_id {id_type}, embedding array<float>, list int")


def save(vectors: DataFrame, path: str, lists: int = LISTS, sample: int = SAMPLE) -> None:
    """Fits centroids to vectors (chunk_id, embedding) and writes both, the vectors partitioned by list."""
    c = fit(vectors, lists, sample)
    vectors.sparkSession.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "list int, centroid array<float>").write.mode("overwrite").parquet(f"{path}/centroids")
    assign(vectors, c).write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """(index, centroids) for search()."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # as many as lists
    return spark.read.parquet(f"{path}/vectors"), np.array([r.centroid for r in rows], dtype=np.float32)


def search(queries: DataFrame, index: DataFrame, centroids: np.ndarray, k: int = 10, probes: int = PROBES, others: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest by cosine among the vectors of the `probes` lists nearest to
    each query (query_id, embedding). index as from assign().

    Groups of queries and of vectors meet in tasks of bounded size, in which each list is compared with the queries
    that probe it; see nearest(). A query is sent once to each group, not to each list.
    """

    def probe(x):
        near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes]
        out = np.zeros((len(x), len(centroids)), dtype=bool)
        out[np.arange(len(x))[:, None], near] = True
        return out

    return bm25.top(nearest(queries, index.withColumnRenamed("list", "part"), k, others, probe), k)
