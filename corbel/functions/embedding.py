"""Embedders: anything with `dimension`, `model` and embed(list of texts) -> array (texts, dimension)."""

import json
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EmbedError
from .http import post
from .vectors import embed_dummy


class Embedder(Protocol):
    dimension: int
    model: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class DummyEmbedder:
    """Vectors from the text's digest, for tests."""

    def __init__(self, dimension: int = 3):
        self.dimension, self.model = dimension, f"dummy-{dimension}"

    def embed(self, texts: list[str]) -> np.ndarray:
        return embed_dummy(texts, self.dimension)


class HttpEmbedder:
    """A service that takes {"model", "input": [texts]} and answers {"data": [{"embedding"}]} or {"embeddings"}."""

    def __init__(self, url: str, model: str, dimension: int, key: str | None = None, batch: int = 64, timeout: float = 60):
        self.url, self.model, self.dimension, self.key, self.batch, self.timeout = url, model, dimension, key, batch, timeout

    def _ask(self, texts: list[str]) -> list:
        said = json.loads(post(self.url, {"model": self.model, "input": texts}, self.key, self.timeout))
        got = said.get("embeddings") or [x["embedding"] for x in said.get("data", [])]
        if len(got) != len(texts):
            raise EmbedError(f"{len(texts)} texts, {len(got)} embeddings")
        return got

    def embed(self, texts: list[str]) -> np.ndarray:
        out = [v for at in range(0, len(texts), self.batch) for v in self._ask(texts[at : at + self.batch])]
        v = np.asarray(out, dtype=np.float32).reshape(len(texts), -1)
        if len(texts) and v.shape[1] != self.dimension:
            raise EmbedError(f"dimension {v.shape[1]} instead of {self.dimension}")
        return v


class OnnxEmbedder:
    """A sentence encoder in ONNX: mean of the token vectors under the mask, scaled to length 1."""

    def __init__(self, model_path: str, tokenizer_path: str, dimension: int, most_tokens: int = 512):
        self.model_path, self.tokenizer_path, self.dimension, self.most, self.model = model_path, tokenizer_path, dimension, most_tokens, model_path
        self._session = None

    def __getstate__(self):
        return self.__dict__ | {"_session": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._session is None:
            import onnxruntime
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(self.tokenizer_path)
            t.enable_truncation(self.most)
            t.enable_padding()
            self._session = onnxruntime.InferenceSession(self.model_path), t
        model, tokenizer = self._session
        coded = tokenizer.encode_batch(texts)
        given = {"input_ids": np.array([e.ids for e in coded]), "attention_mask": np.array([e.attention_mask for e in coded]), "token_type_ids": np.array([e.type_ids for e in coded])}
        vectors = model.run(None, {i.name: given[i.name] for i in model.get_inputs()})[0]
        return pool(vectors, given["attention_mask"])


def pool(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the masked positions of (texts, tokens, dimension), scaled to length 1; a zero vector stays."""
    m = mask[:, :, None].astype(np.float32)
    mean = (vectors * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)
    n = np.linalg.norm(mean, axis=1, keepdims=True)
    return np.divide(mean, n, out=np.zeros_like(mean), where=n > 0)


def embed_column(rows: DataFrame, embedder: Embedder, text: str = "text", to: str = "embedding") -> DataFrame:
    """rows with an embedding, made in Arrow batches; a null text has none."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        out, at = [None] * len(s), [i for i, t in enumerate(s) if t is not None]
        if at:
            for i, v in zip(at, np.asarray(embedder.embed([s.iloc[i] for i in at]), dtype=np.float32)):
                out[i] = v
        return pd.Series(out, dtype=object)

    return rows.withColumn(to, run(text))


def embed_cached(rows: DataFrame, cache: DataFrame, embedder: Embedder, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with embedding, the cache's new rows). cache: (model, text_hash, embedding).

    Only texts that the cache lacks are embedded, each once. The new rows should
    be written before use, so that they aren't embedded again.
    """
    own = cache.filter(F.col("model") == embedder.model).select("text_hash", "embedding")
    asked = rows.withColumn("text_hash", F.sha2(text, 256))
    missing = asked.select("text_hash", F.col(text).alias("text")).filter("text is not null").dropDuplicates(["text_hash"]).join(own, "text_hash", "left_anti")
    new = embed_column(missing, embedder).select(F.lit(embedder.model).alias("model"), "text_hash", "embedding")
    return asked.join(own.unionByName(new.drop("model")), "text_hash", "left").drop("text_hash"), new


class EmbeddingCache:
    """A table (model, text_hash, embedding) at a path: each text is embedded once for each model."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        """The cache's rows; a vector that two runs have made at once is there once."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "model string, text_hash string, embedding array<float>")
        return self.spark.read.parquet(self.path).groupBy("model", "text_hash").agg(F.min("embedding").alias("embedding"))

    def embed(self, rows: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
        """rows with embedding; what the cache lacks is embedded and written to it before the rows are made."""
        _, new = embed_cached(rows, self.table(), embedder, text)
        new.write.mode("append").parquet(self.path)
        held = self.table().filter(F.col("model") == embedder.model).select("text_hash", "embedding")
        return rows.withColumn("text_hash", F.sha2(text, 256)).join(held, "text_hash", "left").drop("text_hash")
