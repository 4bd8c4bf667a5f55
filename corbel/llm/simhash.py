"""SimHash near-duplicate removal with pivot distance tables.

A document's fingerprint has 256 bits, voted by the hashes of its distinct
words. Two documents are near copies if their fingerprints differ in at most
`max_bits` bits; groups are the connected components of that relation.

Pairs are found in three steps. Banding by sampled bits proposes pairs; the
number of bits in a band follows from the number of fingerprints, so that a
bucket has some 16 unrelated ones at every size, and the number of bands from
the recall asked for at `max_bits`, which is the same at every size.
Then the pivot table discards: for each of PIVOTS reference fingerprints it
has the Hamming distance over each of 32 bytes. By complementing any set of
bytes each reference stands for 2**32 others, and the maximum coordinate
difference over all of those is the sum of the absolute differences of the 32
entries; by the triangle inequality a pair above max_bits there can't be near.
Survivors are verified by the exact distance.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import checkpoint, row_keys, texts
from .graphs import components, forest

LANES = 4
BITS = 64 * LANES
MAX_BITS = 40
PIVOTS = 8
RECALL = 0.95
SMALL_GROUP = 128
#: Near pairs of a task that are kept before they are thinned to a forest.
MOST_PAIRS = 1 << 20
SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], dtype=np.uint64)
_FP = [f"f{i}" for i in range(LANES)]


def distinct_in_rows(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, and row offsets into them."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.searchsorted(row[keep], np.arange(len(rows)))


def fingerprints(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(rows, LANES) of uint64: bit b is set if more than half of a row's distinct hashes have it."""
    h, rows = distinct_in_rows(h, rows)
    n = len(rows) - 1
    out = np.zeros((n, LANES), dtype=np.uint64)
    count = np.diff(rows)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    # Votes are counted in byte lanes: 8 counters to a word, over runs of at most 255 hashes.
    runs = -(-count[full] // 255)
    first = np.concatenate([[0], np.cumsum(runs)])
    at = np.repeat(rows[:-1][full], runs) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], runs))
    ones = np.uint64(0x0101010101010101)
    for lane in range(LANES):
        x = K.mix(h ^ SEEDS[lane])
        votes = np.zeros((len(full), 64), dtype=np.int64)
        for s in range(8):
            part = np.add.reduceat((x >> np.uint64(s)) & ones, at).view(np.uint8).reshape(-1, 8)
            votes[:, s::8] = np.add.reduceat(part, first[:-1], axis=0, dtype=np.int64)
        out[full, lane] = np.packbits(2 * votes > count[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint_table(docs: DataFrame, *more: str) -> DataFrame:
    """(id, more..., f0..f3) of each document that has a word; more are columns of longs."""

    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                h, rows, *_ = K.words(part.column(1))
                fp = fingerprints(h, rows).view(np.int64)
                keep = np.flatnonzero(np.diff(rows))
                yield pa.RecordBatch.from_arrays([part.column(i).take(pa.array(keep)) for i in range(part.num_columns) if i != 1] + [pa.array(fp[keep, i]) for i in range(LANES)], ["id", *more, *_FP])

    return texts(docs, "doc_id", "text", *more).mapInArrow(run, ", ".join(f"{c} long" for c in ("id", *more, *_FP)))


def bands_for(n: int, max_bits: int, recall: float = RECALL) -> tuple[int, int]:
    """(bits in a band, bands) for n fingerprints: a pair that differs in max_bits shares a band with probability `recall`."""
    bits = max(12, math.ceil(math.log2(max(n, 2))) - 4)
    same = math.prod((BITS - max_bits - i) / (BITS - i) for i in range(bits))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def band_positions(bits: int, bands: int) -> np.ndarray:
    """Sampled bit positions, (bands, bits); by whole permutations, so that bands overlap least."""
    rng = np.random.default_rng(20250101)
    stream = np.concatenate([rng.permutation(BITS) for _ in range(bands * bits // (BITS // bits * bits) + 2)])
    per = BITS // bits
    return np.stack([stream[(b // per) * BITS + (b % per) * bits :][:bits] for b in range(bands)])


def pivots(count: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 256, (count, BITS // 8), dtype=np.uint8)


def near(fp: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of row numbers within max_bits: pivot table first, then the distance itself."""
    for p in range(table.shape[1]):
        if not len(a):
            return a, b
        bound = np.abs(table[a, p] - table[b, p]).sum(axis=1, dtype=np.int16)
        keep = np.flatnonzero(bound <= max_bits)
        a, b = a[keep], b[keep]
    d = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1)
    keep = d <= max_bits
    return a[keep], b[keep]


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """(rows, PIVOTS, 32) of int8: Hamming distance to each reference over each byte."""
    by = fp.view(np.uint8).reshape(len(fp), 1, BITS // 8)
    return np.bitwise_count(by ^ pivots()[None]).astype(np.int8)


def group_edges(key: np.ndarray, fp: np.ndarray, max_bits: int):
    """Yields (a, b) arrays of row numbers: near pairs among rows of the same key.

    Groups up to SMALL_GROUP rows give all their near pairs. A larger one gives
    a spanning forest of its near pairs, found by breadth-first search over
    rows not yet reached, so that thousands of copies don't cost their square.
    """
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([edge, [len(key)]]))
    many = size > 1
    edge, size = edge[many], size[many]
    small = size <= SMALL_GROUP
    at, left = edge[small], size[small]
    if len(at):
        rows = order[np.repeat(at - np.concatenate([[0], np.cumsum(left)[:-1]]), left) + np.arange(left.sum())]
        start = np.concatenate([[0], np.cumsum(left)[:-1]])
        until = np.repeat(start + left, left)
        own = fp[rows]
        table = pivot_table(own)
        for d in range(1, int(left.max())):
            x = np.flatnonzero(np.arange(len(rows)) + d < until)
            for i in range(0, len(x), 1 << 16):
                a, b = near(own, table, x[i : i + (1 << 16)], x[i : i + (1 << 16)] + d, max_bits)
                if len(a):
                    yield rows[a], rows[b]
    for s, n in zip(edge[~small], size[~small]):
        rows = order[s : s + n]
        own = fp[rows]
        table = pivot_table(own)
        rest, frontier = np.arange(1, n), [0]
        while len(rest):
            if not frontier:
                frontier, rest = [int(rest[0])], rest[1:]
                continue
            x = frontier.pop()
            _, hit = near(own, table, np.full(len(rest), x), rest, max_bits)
            if len(hit):
                yield np.full(len(hit), rows[x]), rows[hit]
                frontier.extend(hit.tolist())
                rest = np.setdiff1d(rest, hit, assume_unique=True)


def near_edges(reps: DataFrame, max_bits: int, bits: int, bands: int) -> DataFrame:
    """(a, b): edges that join all near fingerprints which share a band. reps: (id, f0..f3), distinct fingerprints."""
    where = band_positions(bits, bands)

    def emit(batches):
        lane, shift = where // 64, (where % 64).astype(np.uint64)
        for batch in batches:
            fp = np.stack([batch.column(i + 1).to_numpy() for i in range(LANES)], axis=1).view(np.uint64)
            for b in range(bands):
                key = np.zeros(len(fp), dtype=np.uint64)
                for j in range(bits):
                    key = (key << np.uint64(1)) | ((fp[:, lane[b, j]] >> shift[b, j]) & np.uint64(1))
                key = K.mix(key * np.uint64(2 * bands + 1) + np.uint64(b + 1))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], ["k", "id", *_FP])

    def match(batches):
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        if not t.num_rows:
            return
        ids = t.column("id").to_numpy()
        fp = np.stack([t.column(c).to_numpy() for c in _FP], axis=1).view(np.uint64)
        a, b, held = [], [], 0
        for x, y in group_edges(t.column("k").to_numpy(), fp, max_bits):
            a.append(ids[x])
            b.append(ids[y])
            held += len(x)
            if held > MOST_PAIRS:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(np.concatenate(a), np.concatenate(b))], ["a", "b"])

    kind = "id long, " + ", ".join(f"{c} long" for c in _FP)
    return reps.select("id", *_FP).mapInArrow(emit, "k long, " + kind).repartition("k").mapInArrow(match, "a long, b long")


def grouped(fps: DataFrame, max_bits: int, *key: str) -> DataFrame:
    """fps (id, key..., f0..f3) and `first`, the struct of id and key that is least in each row's group."""
    fps = checkpoint(fps)
    # The numbers of a checkpointed table's rows are the same in every run over it.
    reps = checkpoint(fps.groupBy(*_FP).agg(F.min(F.struct("id", *key)).alias("own"))).withColumn("node", F.monotonically_increasing_id())
    bits, bands = bands_for(reps.count(), max_bits)
    links = near_edges(reps.select(F.col("node").alias("id"), *_FP), max_bits, bits, bands)
    reps = reps.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = reps.groupBy("component").agg(F.min("own").alias("first"))
    return fps.join(reps.join(first, "component").select(*_FP, "first"), _FP)


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, duplicate_of): each document that is not the least doc_id of its group, and that least doc_id.

    Rows without doc_id and texts that are null or have no word belong to no
    group. Rows that repeat a doc_id each belong to the group of their text;
    equal results are one row. Texts of any length are read whole. An empty
    table gives no rows; columns besides doc_id and text are not read.
    """
    return grouped(fingerprint_table(docs), max_bits).filter("id <> first.id").select(F.col("id").alias("doc_id"), F.col("first.id").alias("duplicate_of")).distinct()


def drop_near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one row of each group: that of least doc_id, and of several with this doc_id one.

    Rows without doc_id stay, as do those without words. Rows that repeat a
    doc_id with different texts are documents of their own. Texts of any length
    are read whole. An empty table gives no rows. Columns besides doc_id and
    text may have any names.
    """
    rows, file, row = row_keys(docs)
    drop = grouped(fingerprint_table(rows, file, row), max_bits, file, row)
    drop = drop.filter((F.col(file) != F.col("first")[file]) | (F.col(row) != F.col("first")[row])).select(file, row)
    return rows.join(drop, [file, row], "left_anti").drop(file, row)
