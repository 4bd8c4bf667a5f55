"""Tables of the retrieval engine."""

from pyspark.sql import types as T

METADATA = T.MapType(T.StringType(), T.StringType())

DOCUMENT = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("text", T.StringType(), False), T.StructField("metadata", METADATA)])

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("source_id", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("text", T.StringType(), False),
        T.StructField("metadata", METADATA),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

FINGERPRINT = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("content_hash", T.StringType(), False), T.StructField("modified", T.TimestampType())])


class EngineError(Exception):
    """Base of the engine's errors."""


class StoreError(EngineError):
    pass


class EmbedError(EngineError):
    pass


class SplitError(EngineError):
    pass


class LoadError(EngineError):
    pass


class ConfigError(EngineError):
    pass


class NotFoundError(EngineError):
    pass
