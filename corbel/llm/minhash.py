"""One-permutation MinHash fingerprints with optimal densification.

Each shingle is hashed once; the top bits choose one of BINS bins, which keeps
its least value. An empty bin takes the value of a bin chosen by a hash of the
empty bin's number and the attempt, the same for every document, until a full
one is found; this is the densification of least variance. The low-order
`bits` of each bin are packed into a binary signature.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import texts

BINS = 128
BITS = 8
SHINGLE = 3


def probe_order(bins: int, tries: int) -> np.ndarray:
    """(tries, bins): the bin that empty bin j looks at in try i."""
    i, j = np.meshgrid(np.arange(1, tries + 1, dtype=np.uint64), np.arange(bins, dtype=np.uint64), indexing="ij")
    return (K.mix(i * K.M1 + j * K.M3) % np.uint64(bins)).astype(np.int64)


def signatures(h: np.ndarray, rows: np.ndarray, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(packed signatures of the rows that have hashes, their row numbers)."""
    full = np.flatnonzero(np.diff(rows))
    n = len(full)
    if not n:
        return np.zeros((0, bins * bits // 8), dtype=np.uint8), full
    none = np.uint64(2**64 - 1)
    least = np.full(n * bins, none)
    row = np.repeat(np.arange(n), np.diff(rows)[full])
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    np.minimum.at(least, row * bins + (h >> shift).astype(np.int64), h << np.uint64(int(bins).bit_length() - 1) >> np.uint64(1))
    least = least.reshape(n, bins)
    empty_r, empty_b = np.nonzero(least == none)
    value, todo, at = least.copy(), np.arange(len(empty_r)), 0
    order = probe_order(bins, 64)
    while len(todo):
        if at == len(order):
            order = probe_order(bins, 2 * len(order))
        look = least[empty_r[todo], order[at, empty_b[todo]]]
        hit = look != none
        value[empty_r[todo[hit]], empty_b[todo[hit]]] = look[hit]
        todo, at = todo[~hit], at + 1
    low = K.mix(value) & np.uint64((1 << bits) - 1)
    if bits == 8:
        return low.astype(np.uint8), full
    planes = ((low[:, :, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(n, -1)
    return np.packbits(planes, axis=1, bitorder="little"), full


def fingerprint(docs: DataFrame, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, signature) of every document; bins is a power of two, bins * bits a multiple of 8.

    A text that is null or without words has 0 shingles and a null signature;
    one of fewer than `shingle` words is one shingle. Rows without doc_id give
    no row; rows that repeat one give equal rows. No shuffle is made.
    """

    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                h, rows, *_ = K.words(part.column(1))
                h, rows = K.shingles(h, rows, shingle)
                sig, full = signatures(h, rows, bins, bits)
                out = [None] * part.num_rows
                for i, s in zip(full.tolist(), sig):
                    out[i] = s.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(rows)), pa.array(out, pa.binary())], ["doc_id", "n_shingles", "signature"])

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, signature binary")


def jaccard(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two signatures' shingle sets.

    Of the bins a share of 2**-bits agrees by chance; the estimate corrects
    for that and is cut at 0. Null if either signature is.
    """
    if bits % 4:
        raise ValueError("bits must be a multiple of 4 to compare by columns")
    if bits % 8 == 0:
        step, x, y = bits // 8, a, b
    else:
        step, x, y = bits // 4, F.hex(a), F.hex(b)
    part = lambda c, i: F.substring(c, i * step + 1, F.lit(step))
    same = F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0), lambda n, i: n + F.when(part(x, i) == part(y, i), 1).otherwise(0))
    chance = 2.0**-bits
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), (same / bins - chance) / (1 - chance)))
