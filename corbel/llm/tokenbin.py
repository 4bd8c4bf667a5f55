"""Binary token shards with Elias-Fano document boundaries.

A shard holds the token ids of consecutive documents in one array and the
documents' end offsets as an Elias-Fano sequence: the low bits of each offset
packed, the high bits in unary, so n boundaries over u tokens take about
n * (2 + log2(u / n)) bits. Every SAMPLE-th one of the unary part has its
position in a table of 32-bit numbers, from which select counts on by words.
"""

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import textkernel as K
from .common import texts, worker_cache

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_TOKENS = 1 << 21
SAMPLE = 256
#: Texts are passed to the tokenizer in parts of about so many characters, cut where no token can cross.
PART = 1 << 18
#: Runs of white space from this length on are encoded without the pattern, whose engine fails on very long ones.
LONG_SPACE = re.compile(r"[^\S\x1c-\x1f]{1000,}")


class EliasFano:
    """A non-decreasing sequence of n numbers below `universe`."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, select: bytes):
        self.n, self.low_bits = n, low_bits
        self.low = np.frombuffer(low, dtype=np.uint8)
        self.high = np.frombuffer(high, dtype="<u8")
        self.samples = np.frombuffer(select, dtype="<u4")

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> "EliasFano":
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        planes = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = ((int(ones[-1]) + 1 if n else 0) + 63) // 64
        flags = np.zeros(64 * size, dtype=np.uint8)
        flags[ones] = 1
        return cls(n, bits, np.packbits(planes.ravel(), bitorder="little").tobytes(), np.packbits(flags, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def parts(self) -> tuple[int, bytes, bytes, bytes]:
        return self.low_bits, self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()

    def select(self, i: int) -> int:
        """The i-th number."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        word, bit = divmod(at, 64)
        w = int(self.high[word]) >> bit << bit
        while left >= (c := w.bit_count()):
            left, word = left - c, word + 1
            w = int(self.high[word])
        for _ in range(left):
            w &= w - 1
        high = 64 * word + (w & -w).bit_length() - 1 - i
        low, first = 0, i * self.low_bits
        if self.low_bits:
            a, b = first // 8, (first + self.low_bits + 7) // 8
            low = int.from_bytes(self.low[a:b].tobytes(), "little") >> first % 8 & (1 << self.low_bits) - 1
        return high << self.low_bits | low

    def span(self, i: int) -> tuple[int, int]:
        """Begin and end of document i, if the numbers are ends of documents."""
        return (self.select(i - 1) if i else 0), self.select(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        planes = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (planes.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return (ones - np.arange(self.n) << self.low_bits) | low


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _space(c: str) -> bool:
    """White space of the pattern, to which the separators U+001C to U+001F don't belong."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


def parts(text: str):
    """text in parts, cut only between a character and white space after it: no token crosses there."""
    at = 0
    while len(text) - at > PART:
        to = at + PART
        while to < len(text) and not (_space(text[to]) and not _space(text[to - 1])):
            to += 1
        yield text[at:to]
        at = to
    yield text[at:]


def encode(encoding, text: str) -> list[int]:
    """The ids of a whole text."""
    out = []
    for part in parts(text):
        at = 0
        for m in LONG_SPACE.finditer(part):
            out += encoding.encode_ordinary(part[at : m.start()])
            at = m.end() if m.end() == len(part) else m.end() - 1  # the last space belongs to what follows
            out += encoding._encode_single_piece(part[m.start() : at].encode())
        out += encoding.encode_ordinary(part[at:])
    return out


def _encoder(shared, key: str):
    import tiktoken

    return worker_cache(key, lambda: tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={}))


def token_shards(docs: DataFrame, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(shard_id, n_docs, n_tokens, doc_ids, ids, low_bits, ef_low, ef_high, ef_select).

    ids are little-endian, of 2 bytes where the vocabulary allows it and else
    of 4. A shard ends with the document that brings it to shard_tokens, or
    with its input split; shard_id is the split's number and, in the low 32
    bits, the shard's. A null or empty text has no tokens but a boundary. Rows
    without doc_id are left out; rows that repeat one are each written. An
    empty table gives no shards. One pass, no shuffle; a lost task makes the
    same shards again.
    """
    ranks = read_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary: it doesn't grow with the data
    kind = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"
    schema = pa.schema([("shard_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ids", pa.binary()), ("low_bits", pa.int32()), ("ef_low", pa.binary()), ("ef_high", pa.binary()), ("ef_select", pa.binary())])

    def run(batches):
        encoding = _encoder(shared, "bpe:" + vocabulary)
        base, shards = TaskContext.get().partitionId() << 32, 0
        held, ids, ends, n = [], [], [], 0

        def flush():
            ef = EliasFano.encode(np.array(ends), n + 1)
            bits, low, high, select = ef.parts()
            row = [[base | shards], [len(ids)], [n], [ids], [b"".join(held)], [bits], [low], [high], [select]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, schema.types)], schema=schema)

        for batch in (part for whole in batches for part in K.slices(whole)):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = np.array(encode(encoding, text), dtype=kind)
                held.append(a.tobytes())
                n += len(a)
                ids.append(doc)
                ends.append(n)
                if n >= shard_tokens:
                    yield flush()
                    shards += 1
                    held, ids, ends, n = [], [], [], 0
        if ids:
            yield flush()

    return texts(docs).mapInArrow(run, "shard_id long, n_docs long, n_tokens long, doc_ids array<long>, ids binary, low_bits int, ef_low binary, ef_high binary, ef_select binary")


def read_shards(shards: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, text) of every document in shards of token_shards()."""
    ranks = read_ranks(vocabulary)
    shared = shards.sparkSession.sparkContext.broadcast(ranks)
    kind = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"

    def run(batches):
        decode = _encoder(shared, "bpe:" + vocabulary).decode
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], dtype=kind)
                ends = EliasFano(r["n_docs"], r["low_bits"], r["ef_low"], r["ef_high"], r["ef_select"]).all()
                begins = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(ends - begins), pa.array([decode(ids[a:b].tolist()) for a, b in zip(begins, ends)], pa.string())], ["doc_id", "n_tokens", "text"])

    return shards.mapInArrow(run, "doc_id long, n_tokens long, text string")
