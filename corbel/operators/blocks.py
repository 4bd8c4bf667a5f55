"""Blocks of rows for numpy, and their best cells."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are worked on together, list elements of a slice, and rows that Best holds beside those it keeps.
ROWS, ELEMENTS, HELD = 1 << 17, 1 << 18, 1 << 17


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of each row's k highest finite scores, equal to 9 places by the lesser column."""
    if k < scores.shape[1]:
        kth = np.round(-np.partition(-scores, k - 1, axis=1)[:, k - 1], 9)
        a, c = np.nonzero((np.round(scores, 9) >= kth[:, None]) & np.isfinite(scores))
    else:
        a, c = np.nonzero(np.isfinite(scores))
    order = np.lexsort((c, -np.round(scores[a, c], 9), a))
    a, c = a[order], c[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < k], c[place < k]


def ranks(ids: pa.Array) -> np.ndarray:
    """Each id's place in their order."""
    out = np.empty(len(ids), dtype=np.int64)
    out[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return out


class Best:
    """Each query's k best of all rows that are added, equal to 9 places by the lesser id. Rows are cut to those as they
    come, so that a task hands on k rows of a query and holds no more than a few times that."""

    def __init__(self, k: int):
        self.k, self.parts, self.n, self.kept = k, [], 0, 0

    def add(self, query: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        self.parts.append((query, ids, score))
        self.n += len(query)
        if self.n > 2 * self.kept + HELD:
            self.cut()

    def cut(self) -> None:
        query, score = (np.concatenate([p[i] for p in self.parts]) for i in (0, 2))
        ids = pa.concat_arrays([p[1] for p in self.parts])
        order = np.lexsort((ranks(ids), -np.round(score, 9), query))
        own = query[order]
        keep = order[np.arange(len(own)) - np.searchsorted(own, own) < self.k]
        self.parts, self.n = [(query[keep], ids.take(pa.array(keep)), score[keep])], len(keep)
        self.kept = self.n

    def rows(self, queries: pa.Array):
        """Batches (query_id, chunk_id, score); queries: ids by number."""
        if self.parts:
            self.cut()
            query, ids, score = self.parts[0]
            for at in range(0, len(query), HELD):
                part = slice(at, at + HELD)
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(query[part])), ids[part], pa.array(score[part])], ["query_id", "chunk_id", "score"])


def slices(batches, column: int = 1, elements: int = ELEMENTS):
    """Parts of the batches with some `elements` elements of a list column, one row at least. Nothing is copied."""
    for batch in batches:
        end = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + elements, side="right")))
            yield batch.slice(at, to - at)
            at = to


def joined_batches(batches, key: str | None = None, rows: int = ROWS):
    """Tables of some `rows` rows of a partition; where the partition has a key's rows together, no key is in two of them."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held)
            if key is None:
                yield t
                held, n = [], 0
                continue
            own = t.column(key)
            last, cut = own[-1], t.num_rows
            while cut and own[cut - 1] == last:
                cut -= 1
            if cut:
                yield t.slice(0, cut)
            rest = t.slice(cut)
            held, n = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)
