"""Pairs of vectors in cells: a group of questions and a group of vectors, compared by one task with bounded memory."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import checkpoint
from .blocks import ranks

#: Vectors of a packed row; values of a cell's questions and vectors at most, but for one packed row each.
BLOCK, QUESTIONS, VECTORS = 1024, 1 << 21, 1 << 23
#: Multiplications for which a cell of its own pays, where cores would idle.
WORK = 1 << 31
#: Questions and vectors of one matrix product, vectors of the first one, and values that are compared exactly at once.
ROWS, COLUMNS, FIRST, EXACT = 1024, 4096, 512, 1 << 21


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _unit(v: np.ndarray) -> np.ndarray:
    """unit() worked out in doubles, as floats, by parts."""
    out = np.empty(v.shape, dtype=np.float32)
    for at in range(0, len(v), ROWS):
        out[at : at + ROWS] = unit(v[at : at + ROWS].astype(np.float64))
    return out


class Nearest:
    """The k nearest of many vectors for rows x, by cosine in doubles rounded to 12 places, equal to 9 places by the
    lesser rank. Products of floats leave out what can't be among them; the rest is compared exactly. Rows that
    aren't finite have no neighbours. own: for each row the rank that doesn't count."""

    def __init__(self, x: np.ndarray, k: int, own: np.ndarray, scale: bool = True):
        self.x, self.k, self.own, self.scale = x, k, own, scale
        self.floats = _unit(x) if scale else x
        self.fine = np.isfinite(self.floats).all(axis=1)
        self.score, self.rank = np.full((len(x), k), -np.inf), np.full((len(x), k), -1)

    def add(self, y: np.ndarray, floats: np.ndarray, rank: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Compares x, or some rows of it, with y; floats: y as _unit() has it, all finite."""
        rows = np.flatnonzero(self.fine) if rows is None else rows[self.fine[rows]]
        slack = (y.shape[1] + 8) * 2.0**-24 + 1e-9
        for at in range(0, len(rows), ROWS):
            r, b = rows[at : at + ROWS], 0
            x, width = self.floats[r], COLUMNS if np.isfinite(self.score[r, -1]).all() else FIRST
            while b < len(y):
                s = x @ floats[b : b + width].T
                low = np.round(self.score[r, -1], 9) - slack
                none = np.flatnonzero(np.isneginf(low))
                if len(none) and s.shape[1] > self.k + 1:  # one more, as one may be its own
                    low[none] = np.partition(s[none], s.shape[1] - self.k - 1, axis=1)[:, s.shape[1] - self.k - 1] - 2 * slack
                near = np.flatnonzero(s >= np.nextafter(low.astype(np.float32), np.float32(-np.inf))[:, None])
                step = max(1, EXACT // y.shape[1])
                for c in range(0, len(near), step):
                    i, j = np.divmod(near[c : c + step], s.shape[1])
                    self._take(r, i, y, b + j, rank)
                b, width = b + width, min(2 * width, COLUMNS)

    def _take(self, r: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, rank: np.ndarray) -> None:
        p, q = self.x[r[i]].astype(np.float64), y[j].astype(np.float64)
        s, place = np.round(np.einsum("ij,ij->i", *((unit(p), unit(q)) if self.scale else (p, q))), 12), rank[j]
        keep = (np.round(s, 9) >= np.round(self.score[r[i], -1], 9)) & (place != self.own[r[i]])
        i, s, place = i[keep], s[keep], place[keep]
        some, of = np.unique(i, return_inverse=True)
        at = r[some]
        row = np.concatenate([np.repeat(np.arange(len(some)), self.k), of])
        s, place = np.concatenate([self.score[at].ravel(), s]), np.concatenate([self.rank[at].ravel(), place])
        order = np.lexsort((place, -np.round(s, 9), row))
        own = row[order]
        order = order[np.arange(len(own)) - np.searchsorted(own, own) < self.k]
        self.score[at], self.rank[at] = s[order].reshape(-1, self.k), place[order].reshape(-1, self.k)

    def batch(self, queries: pa.Array, ids: pa.Array) -> pa.RecordBatch:
        """(query_id, chunk_id, score); ids: in order of rank."""
        a, c = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays([queries.take(pa.array(a)), ids.take(pa.array(self.rank[a, c])), pa.array(self.score[a, c])], ["query_id", "chunk_id", "score"])


def _packed(vectors: DataFrame) -> DataFrame:
    """Vectors (id, embedding, part) as rows (ids, matrix, dim, part, n) of up to BLOCK vectors of one dimension and part."""
    id_type = vectors.dtypes[0][1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dims, part = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            order = np.lexsort((part, dims))
            edge = np.flatnonzero(np.r_[True, (np.diff(dims[order]) != 0) | (np.diff(part[order]) != 0), True])
            for a, b in zip(edge[:-1], edge[1:]):
                d = dims[order[a]]
                for at in range(a, b, size := max(1, min(BLOCK, (1 << 18) // max(d, 1)))):
                    own = batch.take(pa.array(order[at : min(at + size, b)]))
                    v = own.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32) if d else np.zeros(own.num_rows, dtype=np.float32)
                    values = [pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(0)), pa.array([v.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*values, *(pa.array([n], pa.int32()) for n in (max(d, 1), part[order[at]], own.num_rows))], ["ids", "matrix", "dim", "part", "n"])

    return vectors.mapInArrow(run, f"ids array<{id_type}>, matrix binary, dim int, part int, n int")


def _held(batches, keys: tuple[str, ...]) -> dict:
    """The ids and vectors of packed rows by `keys`."""
    parts = {}
    for batch in batches:
        for i in range(batch.num_rows):
            dim = batch.column("dim")[i].as_py()
            v = np.frombuffer(batch.column("matrix")[i].as_buffer(), dtype=np.float32).reshape(-1, dim)
            parts.setdefault(tuple(batch.column(c)[i].as_py() for c in keys), []).append((v, batch.column("ids")[i].values))
    return {key: (np.concatenate([v for v, _ in p]), pa.concat_arrays([ids for _, ids in p])) for key, p in parts.items()}


def nearest(queries: DataFrame, base: DataFrame, k: int, others: bool = False, probe=None) -> DataFrame:
    """(query_id, chunk_id, score): of each query (query_id, embedding) the k nearest of each group of base (chunk_id,
    embedding, and `part` with probe). A null embedding gives no row.

    Both sides are packed and kept in the shared checkpoint folder. They are divided into groups of a bounded size,
    and each pair of groups is a task of its own: it holds two groups, and gives k rows for a question. Of unequal
    dimensions the lesser one counts. probe maps unit vectors to a table of booleans, the parts that each is
    compared with; then all vectors are taken as they are.
    """
    spark = queries.sparkSession
    q_type, id_type = queries.select("query_id").dtypes[0][1], base.select("chunk_id").dtypes[0][1]
    part = F.col("part") if probe else F.lit(0)
    q = checkpoint(_packed(queries.filter("embedding is not null").select("query_id", "embedding", F.lit(0).alias("part"))))
    b = checkpoint(_packed(base.filter("embedding is not null").select("chunk_id", "embedding", part.alias("part"))))
    total = lambda rows: rows.agg(F.count("*"), F.coalesce(F.sum(F.col("n").cast("long") * F.col("dim")), F.lit(0)), F.coalesce(F.max("dim"), F.lit(1))).first()
    (q_rows, q_values, dim), (b_rows, b_values, _) = total(q), total(b)
    groups, q_groups = max(1, -(-b_values // VECTORS)), max(1, -(-q_values // QUESTIONS))
    cells = min(4 * spark.sparkContext.defaultParallelism, q_values * b_values // max(dim, 1) // WORK)
    q_groups = max(q_groups, min(-(-cells // groups), q_rows))
    groups = max(groups, min(-(-cells // q_groups), b_rows))
    # Rows are dealt out in turn; of parts, whole ones as far as there are enough.
    deal = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = q.withColumn("g", deal(q_groups)).withColumn("h", every(groups)).select((F.col("g") * groups + F.col("h")).alias("cell"), "ids", F.lit(None).cast(f"array<{id_type}>").alias("ids2"), "matrix", "dim", "part")
    held = b.withColumn("h", deal(groups)).withColumn("g", every(q_groups)).select((F.col("g") * groups + F.col("h")).alias("cell"), F.lit(None).cast(f"array<{q_type}>").alias("ids"), F.col("ids").alias("ids2"), "matrix", "dim", "part")

    def run(batches):
        asked, held = [], []
        for batch in batches:
            mine = pc.is_valid(batch.column("ids"))
            asked.append(batch.filter(mine).select(["ids", "matrix", "dim", "part"]))
            held.append(batch.filter(pc.invert(mine)).select(["ids2", "matrix", "dim", "part"]).rename_columns(["ids", "matrix", "dim", "part"]))
        asked, held = _held(asked, ("dim",)), _held(held, ("dim", "part"))
        for dim2 in sorted({key[0] for key in held}):
            parts = sorted(key[1] for key in held if key[0] == dim2)
            ids = pa.concat_arrays([held[dim2, p][1] for p in parts])
            rank, names = ranks(ids), ids.take(pc.sort_indices(ids))
            for (dim1,), (x, own_ids) in asked.items():
                d = min(dim1, dim2)
                own = np.full(len(x), -2)
                if others:
                    same = pc.index_in(own_ids, names)
                    own[same.is_valid().to_numpy(zero_copy_only=False)] = same.drop_null().to_numpy()
                tables, first = [], 0
                for p in parts:
                    y = np.ascontiguousarray(held[dim2, p][0][:, :d])
                    y = _unit32(y) if probe else y
                    place, floats = rank[first : first + len(y)], y if probe else _unit(y)
                    fine = np.isfinite(floats).all(axis=1)
                    tables.append((p, y, floats, place) if fine.all() else (p, y[fine], floats[fine], place[fine]))
                    first += len(held[dim2, p][0])
                step = ROWS * (4 if probe else 1)
                for at in range(0, len(x), step):
                    some = np.ascontiguousarray(x[at : at + step, :d])
                    some = _unit32(some) if probe else some
                    near, reads = Nearest(some, k, own[at : at + step], not probe), probe(some) if probe else None
                    for p, y, floats, place in tables:
                        near.add(y, floats, place, np.flatnonzero(reads[:, p]) if probe else None)
                    yield near.batch(own_ids.slice(at, step), names)

    both = asked.unionByName(held).repartitionById(q_groups * groups, F.col("cell"))
    return both.mapInArrow(run, f"query_id {q_type}, chunk_id {id_type}, score double")


def _unit32(v: np.ndarray) -> np.ndarray:
    """unit() worked out in floats, in which the inverted file is fitted and searched."""
    return unit(v.astype(np.float32))
