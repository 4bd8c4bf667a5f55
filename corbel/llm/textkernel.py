"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of ASCII letters and digits and of non-ASCII
characters, with case folded for ASCII and the Latin-1 letters. All functions
work on the UTF-8 buffer of the column, without a Python object per word.
"""

import numpy as np
import pyarrow as pa
import xxhash

from .common import CHUNK_BYTES

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)
LONG_WORD = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_TAIL = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= M2
    h ^= h >> np.uint64(27)
    h *= M3
    h ^= h >> np.uint64(31)
    return h


def slices(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES):
    """Parts of a batch whose texts have about `most` bytes; a longer text is a part."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(text))
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, row offsets) of a string column without nulls."""
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def words(col: pa.Array, prefix: int = 0):
    """(hashes, row offsets into them, byte starts, byte ends[, prefix hashes]).

    With prefix > 0 also the hash of each word's first `prefix` bytes.
    """
    data, off = raw(col)
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.uint64)
        at = np.zeros(0, dtype=np.int64)
        return (none, np.zeros(len(col) + 1, dtype=np.int64), at, at) + ((none,) if prefix else ())
    low = np.zeros(n + 8, dtype=np.uint8)
    np.take(_LOWER, data, out=low[:n])
    two = np.flatnonzero(data[:-1] == 0xC3) + 1  # É is C3 89, é is C3 A9
    two = two[(data[two] >= 0x80) & (data[two] <= 0x9E) & (data[two] != 0x97)]
    low[two] |= 0x20
    m = np.take(_WORD, data)
    before = np.zeros(n, dtype=bool)
    before[1:] = m[:-1]
    bounds = off[:-1][off[:-1] < n]
    before[bounds] = False
    start = np.flatnonzero(m & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = m[1:]
    ends = off[1:]
    after[ends[ends > 0] - 1] = False
    end = np.flatnonzero(m & ~after) + 1
    size = end - start
    lanes = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=low, strides=(1,))

    def hashed(left: np.ndarray) -> np.ndarray:
        h = left.astype(np.uint64) * M1
        i, live, s = 0, None, start
        while True:
            take = np.minimum(left if live is None else left[live], 8 * i + 8) - 8 * i
            lane = lanes[s + 8 * i] & _TAIL[take]
            part = mix((h if live is None else h[live]) + lane * M3 + M1)
            if live is None:
                h = part
            else:
                h[live] = part
            i += 1
            more = np.flatnonzero(left > 8 * i)
            if not len(more) or 8 * i >= LONG_WORD:
                break
            live, s = more, start[more]
        return h

    h = hashed(size)
    for w in np.flatnonzero(size > LONG_WORD):
        h[w] = xxhash.xxh64_intdigest(low[start[w] : end[w]].tobytes())
    rows = np.searchsorted(start, off, side="left")
    if prefix:
        return h, rows, start, end, hashed(np.minimum(size, prefix))
    return h, rows, start, end


def shingles(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of k consecutive words, row offsets into them).

    A row of 1 to k-1 words has one shingle of all its words; a row without
    words has none.
    """
    count = np.diff(rows)
    number = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out = np.zeros(len(rows), dtype=np.int64)
    np.cumsum(number, out=out[1:])
    if not out[-1]:
        return np.zeros(0, dtype=np.uint64), out
    padded = np.concatenate([h, np.zeros(k, dtype=np.uint64)])
    at = np.arange(out[-1]) + np.repeat(rows[:-1] - out[:-1], number)
    short = np.flatnonzero((count > 0) & (count < k))
    s = np.zeros(out[-1], dtype=np.uint64)
    for j in range(k):
        word = padded[at + j]
        if len(short):
            over = short[count[short] <= j]
            word[out[over]] = 0
        s = (s ^ word) * M1
        s ^= s >> np.uint64(29)
    return mix(s), out
