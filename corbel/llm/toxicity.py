"""Convolutional toxicity classifier, trained and run in numpy.

A word's vector is the sum of three hashed embeddings: of the word, of its
first 4 and of its first 6 bytes. Filters of widths 1, 2 and 3 pass over the
vectors of a whole text; each filter's maximum feeds a logistic output.
Training sees every labelled document EPOCHS times; a fifth of them sets the
thresholds, one for each language that has enough and one for the rest. Of
thresholds that do equally well on those the middle of the widest gap is taken.
Documents are divided into shards by id; in every epoch each shard's task goes
on from the same weights, and their changes are averaged.
Scoring is one pass over the table without a shuffle; the
broadcast model has a fixed size. Texts of any length are read whole, BLOCK
words at a time; an empty table gives no rows.
"""

import math
import os
import pickle
import tempfile
import uuid
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import checkpoint, map_rows

#: Documents of a shard, as long as there are no more than SHARDS; beyond that shards are larger.
SHARD_DOCS = 8192
SHARDS = 64
#: Most labels that are sent to all tasks.
BROADCAST_LABELS = 1_000_000
#: Bytes of a row of weights.
PIECE = 1 << 18
#: Documents and words that a task holds to put them in another order.
POOL_DOCS, POOL_WORDS = 4096, 4 << 20
WORD_BUCKETS, PREFIXES, PREFIX_BUCKETS = 1 << 17, (4, 6), 1 << 15
DIM, FILTERS, WIDTHS = 12, 12, (1, 2, 3)
EPOCHS, BATCH, RATE, WORD_DROP = 8, 64, 0.1, 0.5
LEAST_FOR_LANGUAGE = 20
BLOCK = 1 << 16


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket numbers (words, 3), row offsets into them)."""
    h, rows, _, _, p0 = K.words(col, PREFIXES[0])
    p1 = K.words(col, PREFIXES[1])[4]
    out = np.empty((len(h), 3), dtype=np.int32)
    out[:, 0] = h % np.uint64(WORD_BUCKETS)
    for i, p in enumerate((p0, p1)):
        out[:, i + 1] = WORD_BUCKETS + i * PREFIX_BUCKETS + (p % np.uint64(PREFIX_BUCKETS)).astype(np.int32)
    return out, rows


class Model:
    """Weights, thresholds by language, and `default` for languages without one."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        n = WORD_BUCKETS + len(PREFIXES) * PREFIX_BUCKETS
        self.embed = rng.normal(0, 0.05, (n, DIM)).astype(np.float32)
        self.conv = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.full(FILTERS, -0.1, dtype=np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.float32(-1)
        self.thresholds: dict[str, float] = {}
        self.default = 0.5
        self.trained = False

    def maxima(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Each row's filter maxima before the nonlinearity; -inf where a row is shorter than a filter."""
        n = len(rows) - 1
        out = np.full((n, len(WIDTHS) * FILTERS), -np.inf, dtype=np.float32)
        row_of = np.repeat(np.arange(n), np.diff(rows))
        wide = max(WIDTHS)
        for at in range(0, len(row_of), BLOCK):
            part, owner = x[at : at + BLOCK + wide - 1], row_of[at : at + BLOCK + wide - 1]
            v = self.embed[part[:, 0]]
            for i in range(1, part.shape[1]):
                v += self.embed[part[:, i]]
            for i, w in enumerate(WIDTHS):
                m = min(BLOCK, len(part) - w + 1)
                if m <= 0:
                    continue
                c = v[:m] @ self.conv[i][0]
                for j in range(1, w):
                    c += v[j : j + m] @ self.conv[i][j]
                inside = owner[:m] == owner[w - 1 : w - 1 + m]
                c[~inside] = -np.inf
                starts = np.flatnonzero(np.concatenate([[True], owner[1:m] != owner[: m - 1]]))
                best = np.maximum.reduceat(c, starts, axis=0)
                to = owner[starts]
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                out[to, cols] = np.maximum(out[to, cols], best)
        return out

    def scores(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Probability of each row; 0 for rows without words."""
        if not len(x):
            return np.zeros(len(rows) - 1)
        h = np.maximum(self.maxima(x, rows) + np.concatenate(self.bias), 0)
        z = h @ self.out + self.out_bias
        return np.where(np.diff(rows) > 0, 1 / (1 + np.exp(-z.astype(np.float64))), 0.0)

    def threshold(self, langs: list) -> np.ndarray:
        return np.array([self.thresholds.get(x, self.default) for x in langs])

    def start(self) -> dict[str, np.ndarray]:
        """Sums of squared gradients before any step."""
        return {k: np.full(v.shape, 1e-3, dtype=np.float32) for k, v in self._weights()}

    def fit(self, docs, sums: dict, seed) -> None:
        """Adagrad over minibatches of (words, class) pairs, once; gradients go through each filter's best position."""
        rng, pool, words = np.random.default_rng(seed), [], 0
        for d, v in docs:
            if not len(d):
                continue
            pool.append((d, v))
            words += len(d)
            if len(pool) >= POOL_DOCS or words >= POOL_WORDS:
                self._steps(pool, sums, rng)
                pool, words = [], 0
        self._steps(pool, sums, rng)

    def _steps(self, docs, sums, rng) -> None:
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            self._step([docs[i] for i in order[at : at + BATCH]], sums, rng)

    def state(self, sums: dict) -> dict[str, np.ndarray]:
        """Weights and sums by name."""
        return dict(self._weights()) | {"out_bias": np.array([self.out_bias])} | {f"sum {k}": v for k, v in sums.items()}

    def take(self, state: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Takes the weights of a state() and returns its sums."""
        self.embed, self.out, self.out_bias = state["embed"].copy(), state["out"].copy(), np.float32(state["out_bias"][0])
        self.conv, self.bias = ([state[f"{x}{i}"].copy() for i in range(len(WIDTHS))] for x in ("conv", "bias"))
        return {k: state[f"sum {k}"].copy() for k, _ in self._weights()}

    def _weights(self):
        yield "embed", self.embed
        for i in range(len(WIDTHS)):
            yield f"conv{i}", self.conv[i]
            yield f"bias{i}", self.bias[i]
        yield "out", self.out

    def _vectors(self, x: np.ndarray, keep: np.ndarray) -> np.ndarray:
        return self.embed[x[:, 0]] * keep[:, None] + self.embed[x[:, 1]] + self.embed[x[:, 2]]

    def _best(self, x: np.ndarray, keep: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Each document's filter maxima and the first positions that have them, over BLOCK words at a time."""
        top = np.full((n, len(WIDTHS) * FILTERS), -np.inf, dtype=np.float32)
        best = np.zeros(top.shape, dtype=np.int64)
        for at in range(0, len(x), BLOCK):
            part, own = (y[at : at + BLOCK + max(WIDTHS) - 1] for y in (x, owner))
            v = self._vectors(part, keep[at : at + len(part)])
            for i, w in enumerate(WIDTHS):
                m = min(BLOCK, len(part) - w + 1)
                if m <= 0:
                    continue
                c = v[:m] @ self.conv[i][0] + self.bias[i]
                for j in range(1, w):
                    c += v[j : j + m] @ self.conv[i][j]
                c[own[:m] != own[w - 1 : w - 1 + m]] = -np.inf
                starts = np.flatnonzero(np.concatenate([[True], own[1:m] != own[: m - 1]]))
                high = np.maximum.reduceat(c, starts, axis=0)
                size = np.diff(np.concatenate([starts, [m]]))
                first = np.where(c == np.repeat(high, size, axis=0), np.arange(m, dtype=np.int32)[:, None], np.int32(m))
                first = np.minimum.reduceat(first, starts, axis=0) + at
                to, cols = own[starts], slice(i * FILTERS, (i + 1) * FILTERS)
                more = high > top[to, cols]
                best[to, cols] = np.where(more, first, best[to, cols])
                top[to, cols] = np.where(more, high, top[to, cols])
        return top, best

    def _step(self, batch, sums, rng) -> None:
        size = np.array([len(d) for d, _ in batch])
        x = np.concatenate([d for d, _ in batch])
        y = np.array([v for _, v in batch], dtype=np.float32)
        keep = (rng.random(len(x)) >= WORD_DROP).astype(np.float32)
        n = len(batch)
        top, best = self._best(x, keep, np.repeat(np.arange(n, dtype=np.int32), size), n)
        h = np.maximum(top, 0)
        z = h @ self.out + self.out_bias
        g = (1 / (1 + np.exp(-z)) - y) / n
        gh = g[:, None] * self.out * (h > 0)
        self._adagrad("out", self.out, h.T @ g, sums)
        self.out_bias -= np.float32(RATE) * g.sum()
        gv_at, gv = [], []
        for i, w in enumerate(WIDTHS):
            part = gh[:, i * FILTERS : (i + 1) * FILTERS]
            d, f = np.nonzero(part)
            pos, gain = best[d, i * FILTERS + f], part[d, f][:, None]
            gw = np.zeros_like(self.conv[i])
            for j in range(w):
                np.add.at(gw[j].T, f, gain * self._vectors(x[pos + j], keep[pos + j]))
                gv_at.append(pos + j)
                gv.append(gain * self.conv[i][j][:, f].T)
            self._adagrad(f"conv{i}", self.conv[i], gw, sums)
            self._adagrad(f"bias{i}", self.bias[i], part.sum(axis=0), sums)
        if sum(map(len, gv_at)):
            where, gain = np.concatenate(gv_at), np.concatenate(gv)
            ids = np.concatenate([x[where, 0], x[where, 1], x[where, 2]])
            gain = np.concatenate([gain * keep[where][:, None], gain, gain])
            own, back = np.unique(ids, return_inverse=True)
            total = np.zeros((len(own), DIM), dtype=np.float32)
            np.add.at(total, back, gain)
            s = sums["embed"]
            s[own] += total**2
            self.embed[own] -= RATE * total / np.sqrt(s[own])

    def _adagrad(self, name, weights, g, sums) -> None:
        sums[name] += g**2
        weights -= RATE * g / np.sqrt(sums[name])

    def calibrate(self, score: np.ndarray, y: np.ndarray, langs: list) -> None:
        """Thresholds of the best F1 on held-out rows; of equals, the middle of the widest gap."""
        self.default = best_threshold(score, y, 0.5)
        langs = np.array([x if x is not None else "" for x in langs], dtype=object)
        for lang in sorted(set(langs) - {""}):
            own = langs == lang
            if min(y[own].sum(), (1 - y[own]).sum()) >= LEAST_FOR_LANGUAGE:
                self.thresholds[lang] = best_threshold(score[own], y[own], self.default)


def best_threshold(score: np.ndarray, y: np.ndarray, otherwise: float) -> float:
    if not len(y) or not 0 < y.sum() < len(y):
        return otherwise
    edge = np.unique(np.concatenate([[0.0], score, [1.0]]))
    cut, gap = (edge[1:] + edge[:-1]) / 2, np.diff(edge)
    order = np.argsort(score)
    at = np.searchsorted(score[order], cut)
    hit = np.stack([y.sum() - np.concatenate([[0], np.cumsum(y[order])])[at], len(y) - at], axis=1)
    f1 = 2 * hit[:, 0] / np.maximum(hit[:, 1] + y.sum(), 1)
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(cut[top[np.argmax(gap[top])]])


def changed(start: dict, state: dict) -> dict:
    """(rows, their values) of each array that differ from those at the start."""
    out = {}
    for k, v in state.items():
        at = np.flatnonzero((v != start[k]).reshape(len(v), -1).any(axis=1)).astype(np.int32)
        out[k] = at, v[at]
    return out


def averaged(start: dict, shards) -> dict:
    """start with the mean change of each row over those of the shards' changed() that have it. Changes are added up
    as whole numbers, so their order is of no account."""
    unit = 2.0**40
    total, count = ({k: np.zeros(shape(v), dtype=np.int64) for k, v in start.items()} for shape in (np.shape, len))
    for shard in shards:
        for k, (at, v) in shard.items():
            total[k][at] += np.rint((v.astype(np.float64) - start[k][at]) * unit).astype(np.int64)
            count[k][at] += 1
    out = {k: v.copy() for k, v in start.items()}
    for k, n in count.items():
        at = np.flatnonzero(n)
        by = n[at].reshape(-1, *[1] * (total[k].ndim - 1))
        out[k][at] = (start[k][at] + total[k][at] / unit / by).astype(np.float32)
    return out


def pieces(x) -> list[bytes]:
    """x pickled, in pieces that the JVM can handle as small objects."""
    data = pickle.dumps(x)
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def packed(x: np.ndarray) -> np.ndarray:
    """Bucket numbers of words in 6 bytes each."""
    n = x.astype(np.int64) - [0, WORD_BUCKETS, WORD_BUCKETS + PREFIX_BUCKETS]
    n = n[:, 0] | n[:, 1] << 17 | n[:, 2] << 32
    return n.view(np.uint8).reshape(-1, 8)[:, :6]


def unpacked(data: bytes) -> np.ndarray:
    n = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    n[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    n = n.view(np.int64)[:, 0]
    return np.stack([n & (1 << 17) - 1, (n >> 17 & (1 << 15) - 1) + WORD_BUCKETS, (n >> 32) + WORD_BUCKETS + PREFIX_BUCKETS], axis=1).astype(np.int32)


def labelled(docs: DataFrame, labels: DataFrame, few: int = BROADCAST_LABELS) -> DataFrame:
    """(id, lang, toxic, text) of every row of docs that has a class. Up to `few` labels go to all tasks, so that texts
    without one are not shuffled; more are joined by a shuffle, with the same result."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if labels.limit(few + 1).count() <= few:
        known = F.broadcast(known)
    return rows.join(known, "id").select("id", "lang", "toxic", "text")


def train(docs: DataFrame, labels: DataFrame, shard_docs: int = SHARD_DOCS) -> Model:
    """A model from all labelled documents, the same for the same rows.

    Each shard's rows are read one after the other, so a task holds a pool of
    documents and the weights, and the driver the weights alone. Documents of
    labels without doc_id or toxic are left out. Of rows that repeat a doc_id
    one is used. Unless both classes are there, the model is untrained and
    rejects nothing.
    """
    spark, model = docs.sparkSession, Model()
    rows = labelled(docs, labels)
    size = {r.toxic: r.n for r in rows.select("id", "toxic").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return model
    shards = min(SHARDS, math.ceil(sum(size.values()) / shard_docs))

    def words(batches):
        for batch in batches:
            for part in K.slices(batch):
                x, at = features(part.column(3))
                data = packed(x)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([data[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["id", "lang", "toxic", "x"])

    # In the order of a hash, and of rows that repeat an id the least first.
    rows = rows.mapInArrow(words, "id long, lang string, toxic int, x binary")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("order", F.xxhash64("id", F.lit(1)))
    rows = checkpoint(rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "order", "id", "x", "lang").select("shard", "id", "lang", "toxic", "x"))

    def documents(batches, held: bool):
        """(shard, lang, toxic, words) of the fifth of a shard's documents that is held out, or of the others."""
        last, n = None, 0
        for batch in batches:
            for i, (shard, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1)))):
                if (shard, own) == last:
                    continue
                n = n + 1 if last and last[0] == shard else 0
                last = shard, own
                if (n % 5 == 0) == held:
                    yield shard, batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), unpacked(batch.column(4)[i].as_py())

    base = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "corbel-checkpoint")
    folder = f"{base}/toxicity-{uuid.uuid4().hex}"
    state = model.state(model.start())
    for epoch in range(EPOCHS):
        shared = spark.sparkContext.broadcast(state)

        def run(batches):
            for shard, group in groupby(documents(batches, False), key=lambda d: d[0]):
                own = Model()
                sums = own.take(shared.value)
                own.fit(((x, toxic) for _, _, toxic, x in group), sums, (1, epoch, shard))
                blobs = pieces(changed(shared.value, own.state(sums)))
                for blob in blobs:
                    yield pa.RecordBatch.from_arrays([pa.array([len(blobs)], pa.int32()), pa.array([blob], pa.binary())], ["n", "state"])

        def merge(rows):
            """A shard's pieces follow each other in its file."""
            states = (pickle.loads(b"".join([row.state, *(r.state for r in islice(rows, row.n - 1))])) for row in rows)
            yield from pieces(averaged(shared.value, states))

        # A table of its own that goes after the round, since shuffled weights would stay.
        rows.mapInArrow(run, "n int, state binary").write.option("compression", "none").parquet(f"{folder}/{epoch}")
        # One task averages them, by rows and not by Arrow, whose batches would hold all shards at once.
        got = spark.read.schema("n int, state binary").parquet(f"{folder}/{epoch}").rdd.coalesce(1).mapPartitions(merge).collect()
        state = pickle.loads(b"".join(got)) if got else state  # of a fixed size
        del got
        shared.destroy()
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    model.take(state)
    model.trained = True
    shared = spark.sparkContext.broadcast(model)

    def judge(batches):
        m = shared.value
        for _, lang, toxic, x in documents(batches, True):
            yield lang, toxic, float(m.scores(x, np.array([0, len(x)]))[0])

    def held(batches):
        for some in iter(lambda it=judge(batches): list(islice(it, 4096)), []):
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*some), (pa.string(), pa.int32(), pa.float64()))], ["lang", "toxic", "score"])

    def calibrate(batches):
        t = pa.Table.from_batches([b for b in batches if b.num_rows] or [], pa.schema([("lang", pa.string()), ("toxic", pa.int32()), ("score", pa.float64())]))
        lang = t.column("lang").combine_chunks().dictionary_encode()
        m = Model.__new__(Model)
        m.thresholds = {}
        names = np.array([x or None for x in lang.dictionary.to_pylist()], dtype=object)
        m.calibrate(t.column("score").to_numpy(), t.column("toxic").to_numpy(), names[lang.indices.to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(m))], pa.binary())], ["thresholds"])

    # One task finds the thresholds, from 20 bytes of a held-out document.
    got = rows.mapInArrow(held, "lang string, toxic int, score double").repartition(1).mapInArrow(calibrate, "thresholds binary").collect()
    if got:
        vars(model).update(pickle.loads(got[0].thresholds))
    shared.destroy()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, score, threshold, toxic) of every row; a null text or one without words scores 0.

    A language that is null or has no threshold of its own gets the general
    one. Rows without doc_id are scored like others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in K.slices(batch):
                s = m.scores(*features(part.column(1)))
                cut = m.threshold(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s), pa.array(cut), pa.array((s >= cut) & (s > 0) & m.trained)], ["doc_id", "lang", "score", "threshold", "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, "doc_id long, lang string, score double, threshold double, toxic boolean")


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, score, threshold) of the documents that the model rejects.

    Null and empty texts and those without words are never rejected; rows that
    repeat a doc_id or have none are each judged. An empty table, or labels
    without both classes, give no rows. Other columns aren't read.
    """
    return score(docs, train(docs, labels)).filter("toxic").drop("toxic")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns, in one pass without a shuffle.

    A null text or one without words stays, as do all rows where labels lack a
    class; rows that repeat a doc_id or have none are each judged, and texts of
    any length are read whole. An empty table gives no rows. Columns besides
    doc_id, text and lang may have any names.
    """
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in K.slices(batch, "m0"):
                at = part.num_columns - 2
                s = m.scores(*features(part.column(at)))
                cut = m.threshold(part.column(at + 1).to_pylist())
                keep = pa.array(~((s >= cut) & (s > 0) & m.trained))
                yield part.select(list(range(at))).filter(keep)

    return map_rows(docs, run, F.coalesce(F.col("text"), F.lit("")), F.col("lang").cast("string"))
