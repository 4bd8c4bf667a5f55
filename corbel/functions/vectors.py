"""Vector functions: similarity, stored formats and the deterministic test embedding."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y, F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 where a vector is empty or all zeros. The longer one is cut to the shorter."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(b, 1, F.greatest(n, F.lit(0)))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def quantize_uint8(v: Column) -> Column:
    """struct(codes array<int>, low, high): 256 equal steps from least to greatest; 128 for a constant vector."""
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    codes = F.transform(v, lambda x: F.when(high > low, F.round((x.cast("double") - low) / (high - low) * 255)).otherwise(128).cast("int"))
    return F.struct(codes.alias("codes"), low.alias("low"), high.alias("high"))


def dequantize_uint8(codes: Column, low: Column, high: Column) -> Column:
    return F.transform(codes, lambda c: (low + c / F.lit(255.0) * (high - low)).cast("float"))


def dummy_embedding(text: Column, dim: int) -> Column:
    """e[i] = (code of hex digit i mod 64 of the text's SHA-256 - 96) / 26."""
    # The digest is an element of an array, since what a lambda takes from outside is worked out again for each of its elements.
    code = lambda h, i: F.ascii(F.substr(h, F.pmod(i, F.lit(64)) + 1, F.lit(1)))
    values = lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: ((code(h, i) - 96) / F.lit(26.0)).cast("float"))
    return F.get(F.transform(F.array(F.sha2(text, 256)), values), F.lit(0))


def embed_dummy(texts: list[str], dim: int) -> np.ndarray:
    out = np.empty((len(texts), dim), dtype=np.float32)
    for i, t in enumerate(texts):
        digest = np.frombuffer(hashlib.sha256(t.encode()).hexdigest().encode(), dtype=np.uint8)
        out[i] = (np.resize(digest, dim).astype(np.float64) - 96) / 26
    return out


def to_half(v: np.ndarray) -> np.ndarray:
    """float32 to half bits with the mantissa cut off; too small is 0, too large infinite."""
    bits = np.ascontiguousarray(v, dtype=np.float32).view(np.uint32)
    sign, power, rest = bits >> 16 & 0x8000, (bits >> 23 & 0xFF).astype(np.int64), bits & 0x7FFFFF
    normal = sign | (np.clip(power - 112, 0, 31).astype(np.uint32) << 10) | rest >> 13
    out = np.where(power - 112 >= 31, sign | 0x7C00, np.where(power - 112 <= 0, sign, normal))
    return np.where(power == 255, sign | 0x7C00 | np.where(rest > 0, 0x200, 0), out).astype("<u2")


def encode(v: np.ndarray, kind: str) -> bytes:
    v = np.asarray(v, dtype="<f4")
    if kind == "f32":
        return v.tobytes()
    if kind == "f16":
        return to_half(v).tobytes()
    low, high = (v.min(), v.max()) if len(v) else (np.float32(0), np.float32(0))
    scaled = (v - low) / (high - low) * np.float32(255) if high > low else np.full(len(v), 128, dtype=np.float32)
    return np.array([low, high], dtype="<f4").tobytes() + np.floor(scaled + np.float32(0.5)).clip(0, 255).astype(np.uint8).tobytes()


def decode(data: bytes, kind: str) -> np.ndarray:
    if kind == "f32":
        return np.frombuffer(data[: len(data) // 4 * 4], dtype="<f4")
    if kind == "f16":
        return np.frombuffer(data[: len(data) // 2 * 2], dtype="<f2").astype(np.float32)
    if len(data) < 8:
        return np.zeros(0, dtype=np.float32)
    low, high = np.frombuffer(data[:8], dtype="<f4")
    return (low + np.frombuffer(data[8:], dtype=np.uint8).astype(np.float32) / np.float32(255) * (high - low)).astype(np.float32)


def encoded(v: Column, kind: str) -> Column:
    """Binary of an embedding as f32, f16 or uint8 with its range in front."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else encode(x, kind))

    return run(v)


def decoded(data: Column, kind: str) -> Column:
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else decode(bytes(x), kind))

    return run(data)
