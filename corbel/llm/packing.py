"""Packing of related documents into training windows.

Documents with the same least shingle hash in each of SLOTS slots are a node.
Two nodes are related if a slot agrees and their signatures of BINS bins give
a Jaccard similarity of at least LEAST; each node's NEIGHBOURS most similar
are its edges. All nodes of a slot's value are compared; where more than FULL
share it, by blocks of BLOCK nodes, each two in a group of their own.
Edges are taken from the most similar on where they join the ends of two
paths, so that all nodes lie on paths; windows of `window` words are filled
along them, through one connected part after the other.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import checkpoint, texts, unused
from .graphs import components

SLOTS = 16
#: Bins of the signature that similarity is estimated by, 6 bits each; a slot is BINS // SLOTS of them.
BINS = 256
SHINGLE = 3
#: Least estimated similarity of an edge: two standard errors below 0.1.
LEAST = 0.06
NEIGHBOURS = 4
WINDOW = 2048
#: Nodes that one task walks. The paths of larger parts are made by rounds over all tasks, with the same result.
MOST_NODES = 200_000
#: Largest bucket that one task compares; larger ones are compared by pairs of blocks.
FULL = 256
#: Nodes of a block.
BLOCK = 1 << 14
BUCKETS = 4096
#: Parts of a bucket without in_order, so that a connected part of any size is spread over as many tasks.
PARTS = 64
#: Low bits of a row's place, which number the rows of a partition or file.
PART_BITS = 33
NONE = np.uint64(2**64 - 1)
SCALE = 1_000_000


def sketches(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, SLOTS) of uint64, the least shingle hash of each slot, all ones where it has none; and (rows, BINS)
    of uint8, 1 to 63 by the least hash of each bin, 0 where it has none."""
    n = len(rows) - 1
    least = np.full(n * BINS, NONE)
    np.minimum.at(least, np.repeat(np.arange(n), np.diff(rows)) * BINS + (h >> np.uint64(56)).astype(np.int64), h)
    least = least.reshape(n, BINS)
    codes = np.where(least == NONE, 0, K.mix(least) % np.uint64(63) + np.uint64(1)).astype(np.uint8)
    return least.reshape(n, SLOTS, -1).min(axis=2), codes


def packed(codes: np.ndarray) -> np.ndarray:
    """Four codes in three bytes."""
    a, b, c, d = (codes[:, i::4] for i in range(4))
    return np.stack([a | b << 6, b >> 2 | c << 4, c >> 4 | d << 2], axis=2).reshape(len(codes), -1)


def unpacked(data: np.ndarray) -> np.ndarray:
    x, y, z = (data[:, i::3] for i in range(3))
    return np.stack([x & 63, x >> 6 | (y & 15) << 2, y >> 4 | (z & 3) << 4, z >> 2], axis=2).reshape(len(data), -1)


def sketch_table(docs: DataFrame, *more: str) -> DataFrame:
    """(id, tokens, node, slots, signature, more...) of each document that has a word; tokens counts words, node
    numbers the slots, and more are columns of longs."""

    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                h, rows, *_ = K.words(part.column(1))
                s, codes = sketches(*K.shingles(h, rows, SHINGLE))
                keep = np.flatnonzero(np.diff(rows))
                node = K.mix(np.bitwise_xor.reduce(K.mix(s[keep] + np.arange(SLOTS, dtype=np.uint64) * K.M1), axis=1))
                blobs = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (s[keep], packed(codes[keep]))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array(np.diff(rows)[keep]), pa.array(node.view(np.int64)), *blobs, *[part.column(i + 2).take(pa.array(keep)) for i in range(len(more))]], ["id", "tokens", "node", "slots", "signature", *more])

    return texts(docs, "doc_id", "text", *more).mapInArrow(run, ", ".join(["id long, tokens long, node long, slots binary, signature binary", *[f"{c} long" for c in more]]))


def matrix(col: pa.Array, kind) -> np.ndarray:
    """(rows, width) of the binary values of one width of a column without nulls, not copied."""
    wide = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], dtype=wide)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[int(off[0]) : int(off[-1])].view(kind).reshape(len(col), -1)


def similarity(same: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity times SCALE, from the bins that agree and those that either has. Of the latter
    one in 63 agrees by chance, for which it is corrected."""
    raw = same / np.maximum(both, 1)
    return np.rint(np.maximum(raw - 1 / 63, 0) / (1 - 1 / 63) * SCALE).astype(np.int32)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of each row of codes a to that of b."""
    return similarity(((a == b) & (a > 0)).sum(axis=1), ((a | b) > 0).sum(axis=1))


def all_alike(codes: np.ndarray) -> np.ndarray:
    """Similarity of all rows to each other."""
    n, other = len(codes), np.where(codes == 0, 255, codes)
    same = np.empty((n, n), dtype=np.int32)
    for at in range(0, n, 16):
        np.sum(codes[at : at + 16, None, :] == other[None], axis=2, out=same[at : at + 16])
    none = (codes == 0).astype(np.float32)
    return similarity(same, BINS - (none @ none.T).astype(np.int32))


def nearest_in_buckets(key: np.ndarray, node: np.ndarray, codes: np.ndarray, k: int):
    """Yields (node, other, like) arrays: for each bucket, which is the rows of one key, each node's k nearest at
    least, by most similarity, then by least node."""
    order = np.lexsort((node, key))
    edge = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    size = np.diff(np.concatenate([edge, [len(key)]]))
    small = size <= 16
    for n in np.unique(size[small & (size > 1)]):
        at = edge[size == n]
        for i in range(n):
            for j in range(i + 1, n):
                for part in range(0, len(at), 1 << 14):
                    a, b = order[at[part : part + (1 << 14)] + i], order[at[part : part + (1 << 14)] + j]
                    like = alike(codes[a], codes[b])
                    yield node[a], node[b], like
                    yield node[b], node[a], like
    for e, n in zip(edge[~small], size[~small]):
        rows = order[e : e + n]
        like = all_alike(codes[rows])
        np.fill_diagonal(like, -1)
        rank = like.astype(np.int64) * n + (n - 1 - np.arange(n))
        best = np.argpartition(-rank, min(k, n - 1) - 1, axis=1)[:, :k] if k < n - 1 else np.broadcast_to(np.arange(n), (n, n))
        a, b = np.repeat(np.arange(n), best.shape[1]), best.ravel()
        a, b = a[a != b], b[a != b]
        yield node[rows[a]], node[rows[b]], like[a, b]


def nearest_among(node: np.ndarray, codes: np.ndarray, base: np.ndarray, held: np.ndarray, k: int):
    """Yields (node, other, like) arrays: each node's k nearest of at least LEAST among `base`, whose codes are `held`,
    by most similarity, then by least node. base has no node twice.

    Bins that agree are counted along lists of the rows that have a code in a bin, about four a pair of rows.
    """
    order = np.argsort(base)
    base, held = base[order], held[order]
    m = len(base)
    lists = np.argsort(held, axis=0, kind="stable").T.ravel()
    cut = np.zeros((BINS, 65), dtype=np.int64)
    for i in range(BINS):
        np.cumsum(np.bincount(held[:, i], minlength=64), out=cut[i, 1:])
    cut += np.arange(BINS)[:, None] * m
    has, own = (np.packbits(x > 0, axis=1).view(np.uint64) for x in (held, codes))
    need = np.bitwise_count(own).sum(axis=1) * (LEAST * (1 - 1 / 63) + 1 / 63) - 1e-3  # of at least as many bins that either has
    out, n = [], 0
    for row in range(len(node)):
        bins = np.flatnonzero(codes[row])
        if not len(bins):
            continue
        code = codes[row, bins]
        same = np.bincount(np.concatenate([lists[x:y] for x, y in zip(cut[bins, code].tolist(), cut[bins, code + 1].tolist())]), minlength=m)
        at = np.flatnonzero(same >= need[row])
        like = similarity(same[at], np.bitwise_count(has[at] | own[row]).sum(axis=1))
        keep = (like >= LEAST * SCALE) & (base[at] != node[row])
        at, like = at[keep], like[keep]
        if len(at) > k:
            best = np.argpartition(at - like.astype(np.int64) * m, k - 1)[:k]
            at, like = at[best], like[best]
        out.append((np.full(len(at), node[row]), base[at], like))
        n += len(at)
        if n >= 1 << 16:
            yield tuple(map(np.concatenate, zip(*out)))
            out, n = [], 0
    if out:
        yield tuple(map(np.concatenate, zip(*out)))


def buckets(nodes: DataFrame, full: int = FULL) -> tuple[DataFrame, DataFrame | None]:
    """((k, node) of the buckets of 2 to `full` nodes, (k, node, n) of the larger ones with their sizes, None without any).
    nodes: (node, slots).

    Rows are counted by key before any are brought together, so no task holds
    a bucket of more than `full` nodes. The larger ones are compared by blocks.
    """

    def emit(batches):
        for batch in batches:
            s = matrix(batch.column(1), np.uint64) if batch.num_rows else np.zeros((0, SLOTS), dtype=np.uint64)
            for i in range(SLOTS):
                at = np.flatnonzero(s[:, i] != NONE)
                keys = K.mix(s[at, i] ^ np.uint64(i)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(pa.array(at))], ["k", "node"])

    level = nodes.select("node", "slots").mapInArrow(emit, "k long, node long")
    count = level.groupBy("k").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("members")).filter("n > 1")
    # Buckets of the same nodes, as near copies have them by most of their slots, are one.
    count = checkpoint(count.groupBy("n", "least", "members").agg(F.min("k").alias("k")).select("k", "n"))
    large = count.filter(F.col("n") > full)
    return level.join(count.filter(F.col("n") <= full).select("k"), "k").select("k", "node"), None if large.isEmpty() else level.join(large, "k")


def together(df: DataFrame, key: str) -> DataFrame:
    """df with all rows of a key in one task.

    It is divided by a hash of the key. A repartition by the key itself is left
    out where a join below it is by that key, and if this join then becomes a
    broadcast join or has its large parts split, several tasks get rows of a key.
    """
    return df.repartition(F.xxhash64(key))


def neighbours(nodes: DataFrame, k: int = NEIGHBOURS, full: int = FULL, block: int = BLOCK) -> DataFrame:
    """(node, other, like): each node's k nearest of at least LEAST among all that share a slot's value with it.
    nodes: (node, slots, signature), distinct.

    A bucket of more than `full` nodes is compared in full too: it is cut into
    blocks of about `block` nodes, and each two blocks meet in a group of
    their own, so a task holds two blocks at a time.
    """

    def batch_of(a, b, like):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(like)], ["node", "other", "like"])

    def match(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        codes = unpacked(np.concatenate([matrix(b.column(2), np.uint8) for b in held]))
        t = pa.Table.from_batches(held).select([0, 1])
        key, node = (t.column(c).to_numpy() for c in ("k", "node"))
        del held, t
        for a, b, like in nearest_in_buckets(key, node, codes, k):
            keep = like >= LEAST * SCALE
            yield batch_of(a[keep], b[keep], like[keep])

    def compare(parts):
        """Of one group: (block, node, codes) arrays."""
        own, node, codes = (np.concatenate(x) for x in zip(*parts))
        first = own == own.min()
        sides = [(node[x], unpacked(codes[x])) for x in (first, ~first) if x.any()]
        for x, y in ((0, 1), (1, 0)) if len(sides) == 2 else ((0, 0),):
            for found in nearest_among(*sides[x], *sides[y], k):
                yield batch_of(*found)

    def meet(batches):
        held, now = [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for x, y in zip(cut[:-1], cut[1:]):
                if x == y:
                    continue
                if held and tuple(key[x]) != now:
                    yield from compare(held)
                    held = []
                now = tuple(key[x])
                held.append((batch.column(3).to_numpy()[x:y].copy(), batch.column(4).to_numpy()[x:y].copy(), matrix(batch.column(5).slice(x, y - x), np.uint8).copy()))
        if held:
            yield from compare(held)

    kind = "node long, other long, like int"
    signed = nodes.select("node", "signature")
    small, large = buckets(nodes, full)
    pairs = together(small.join(signed, "node").select("k", "node", "signature"), "k").mapInArrow(match, kind)
    if large is not None:
        last = F.ceil(F.col("n") / block).cast("int") - 1
        own = large.withColumn("last", last).withColumn("own", F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int"))
        groups = own.join(signed, "node").select("k", "own", "node", "signature", F.explode(F.sequence(F.lit(0), "last")).alias("x"))
        groups = groups.select("k", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "own", "node", "signature")
        tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, since few bytes are much work here
        pairs = pairs.unionByName(groups.repartition(tasks, "k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(meet, kind))
    best = Window.partitionBy("node").orderBy(F.desc("like"), "other")
    return pairs.distinct().withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r")


def chains(node: list, edges: list) -> list[list]:
    """Paths over undirected edges (a, b, like, tie...) that have every node once. From the most similar edge on,
    then by tie and nodes, each is taken that joins the ends of two paths. A path starts at its end of less degree,
    then the lesser node, and the paths are in order of their starts."""
    degree, link, root = dict.fromkeys(node, 0), {n: [] for n in node}, {n: n for n in node}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b, *_ in sorted(edges, key=lambda e: (-e[2], e[3:], min(e[:2]), max(e[:2]))):
        degree[a] += 1
        degree[b] += 1
        x, y = find(a), find(b)
        if len(link[a]) < 2 and len(link[b]) < 2 and x != y:
            root[x] = y
            link[a].append(b)
            link[b].append(a)
    seen, out = set(), []
    for start in sorted((n for n in node if len(link[n]) < 2), key=lambda n: (degree[n], n)):
        path, here = [], None if start in seen else start
        while here is not None:
            seen.add(here)
            path.append(here)
            here = next((o for o in link[here] if o not in seen), None)
        if path:
            out.append(path)
    return out


def walk(node: list, edges: list) -> list:
    """Nodes in the order of chains()."""
    return [n for path in chains(node, edges) for n in path]


def plain(df: DataFrame) -> DataFrame:
    """df checkpointed, without the constraints of its plan: over many rounds they take ever longer to infer."""
    df = checkpoint(df)
    jvm = df.sparkSession._jsparkSession
    return DataFrame(jvm.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), df.sparkSession)


def joined(edges: DataFrame) -> DataFrame:
    """(node, path, seq) as from chains(), for a graph of any size: edges (a, b, like, tie) with a < b, each once.

    In every round the edges that come first among all open ones of both their
    paths are taken. No edge before such a one can touch its paths, so those
    are just the edges that would be taken one by one.
    """
    both = edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node")))
    degree = checkpoint(both.groupBy("node").agg(F.count("*").alias("degree")))
    nodes = degree.select("node", F.col("node").alias("path"), F.lit(0).cast("long").alias("at"), F.lit(1).cast("long").alias("size"))
    left = edges
    while True:
        ends = nodes.filter("at = 0 or at = size - 1")
        for x in "ab":
            left = left.join(ends.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("path", "at", "size")]), x)
        left = plain(left.filter("path_a <> path_b"))
        if left.isEmpty():
            break
        rank = F.struct((-F.col("like")).alias("s"), "tie", "a", "b")
        first = left.select(F.explode(F.array("path_a", "path_b")).alias("path"), rank.alias("e")).groupBy("path").agg(F.min("e").alias("e"))
        first = first.groupBy("e.a", "e.b").agg(F.count("*").alias("n")).filter("n = 2").select("a", "b")
        new = left.join(first, ["a", "b"])
        size = F.col("size_a") + F.col("size_b")
        head = new.select(F.col("path_a").alias("path"), F.col("path_a").alias("into"), ((F.col("at_a") == 0) & (F.col("size_a") > 1)).alias("turn"), F.lit(0).cast("long").alias("add"), size.alias("all"))
        tail = new.select(F.col("path_b").alias("path"), F.col("path_a").alias("into"), (F.col("at_b") > 0).alias("turn"), F.col("size_a").alias("add"), size.alias("all"))
        at = F.when(F.col("turn"), F.col("size") - 1 - F.col("at")).otherwise(F.col("at")) + F.coalesce("add", F.lit(0))
        moved = nodes.join(head.unionAll(tail), "path", "left")
        nodes = plain(moved.select("node", F.coalesce("into", "path").alias("path"), at.alias("at"), F.coalesce("all", "size").alias("size")))
        left = left.select("a", "b", "like", "tie")
    ranked = nodes.join(degree, "node").withColumn("end", F.struct("degree", "node"))
    ends = ranked.groupBy("path").agg(F.min(F.when(F.col("at") == 0, F.col("end"))).alias("x"), F.min(F.when(F.col("at") == F.col("size") - 1, F.col("end"))).alias("y"))
    ends = ends.select("path", (F.col("y") < F.col("x")).alias("turn"), F.least("x", "y").alias("start"))
    return nodes.join(ends, "path").select("node", F.col("start").alias("path"), F.when(F.col("turn"), F.col("size") - 1 - F.col("at")).otherwise(F.col("at")).alias("seq"))


def path_order(nodes: DataFrame, k: int = NEIGHBOURS, most: int = MOST_NODES) -> DataFrame:
    """(node, component, path, seq) for every node that has an edge; path is (degree, node) of the path's start.

    Components of up to `most` nodes are walked by one task each, larger ones
    by joined(); the result is the same.
    """
    near = neighbours(nodes, k).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "like")
    edges = checkpoint(near.distinct().withColumn("tie", F.xxhash64("a", "b")))
    own = checkpoint(components(edges))
    large = own.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("component")
    inside = edges.join(own.withColumnRenamed("node", "a"), "a")

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by("component")
        c, *edge = (t.column(x).to_numpy() for x in ("component", "a", "b", "like", "tie"))
        cut = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]]))
        for x, y in zip(cut[:-1], cut[1:]):
            own = [e[x:y].tolist() for e in edge]
            degree = Counter(own[0]) + Counter(own[1])
            paths = chains(list(degree), list(zip(*own)))
            size = [len(p) for p in paths]
            start = np.repeat([p[0] for p in paths], size)
            first = pa.StructArray.from_arrays([pa.array(np.repeat([degree[p[0]] for p in paths], size)), pa.array(start)], ["degree", "node"])
            yield pa.RecordBatch.from_arrays([pa.array([n for p in paths for n in p], pa.int64()), pa.array(np.full(sum(size), c[x])), first, pa.array(np.concatenate([np.arange(n) for n in size]))], ["node", "component", "path", "seq"])

    def walked(part: DataFrame) -> DataFrame:
        return together(part.select("component", "a", "b", "like", "tie"), "component").mapInArrow(run, "node long, component long, path struct<degree: long, node: long>, seq long")

    if large.isEmpty():
        return walked(inside)
    large = checkpoint(large)
    rounds = joined(checkpoint(inside.join(large, "component", "left_semi").select("a", "b", "like", "tie")))
    return walked(inside.join(large, "component", "left_anti")).unionByName(rounds.join(own, "node").select("node", "component", "path", "seq"))


def placed_rows(docs: DataFrame, name: str) -> DataFrame:
    """docs and, as column `name`, a long that grows along its rows: a table of one written folder has the
    order of its files' numbers and their rows, any other the order of its partitions."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return docs.withColumn(name, F.monotonically_increasing_id())
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"part-([0-9]+)", 1).try_cast("long"), F.lit(0))
    return docs.withColumn(name, F.shiftleft(part, PART_BITS) + F.col("_metadata.row_index"))


def pack(docs: DataFrame, window: int = WINDOW, k: int = NEIGHBOURS, most: int = MOST_NODES, in_order: bool = False) -> DataFrame:
    """(window_id, n_tokens, segments): windows of `window` words, segments being an array of
    (doc_id, start, tokens) in order; every word of every document is in exactly one segment.

    Only the last window may be short. A document that doesn't fit goes on in
    the next window. Rows without doc_id and texts that are null or without
    words take no place; rows that repeat a doc_id are each packed. An empty
    table gives no rows. Columns besides doc_id and text aren't read. With
    in_order paths keep the order that their first documents have in docs, and
    components don't count; a path is walked once for the first rows of its
    documents, once for the second rows of those that have one, and so on, so
    that the passes of a mixing schedule stay apart.
    """
    place = unused(docs, "__place")
    rows = checkpoint(sketch_table(placed_rows(docs, place), place).withColumnRenamed(place, "place") if in_order else sketch_table(docs))
    nodes = rows.groupBy("node").agg(F.min(F.struct("slots", "signature")).alias("s")).select("node", "s.slots", "s.signature")
    paths = checkpoint(path_order(checkpoint(nodes), k, most))
    first = ["place"] if in_order else []
    rows = rows.drop("slots", "signature").join(paths, "node", "left").select("id", "tokens", "node", F.coalesce("component", "node").alias("component"), "path", F.coalesce("seq", F.lit(0)).alias("seq"), *first)
    if in_order:
        again = Window.partitionBy("id").orderBy("place")
        rows = checkpoint(rows.withColumn("walk", F.xxhash64("component", "path", F.row_number().over(again))))
        begin = rows.groupBy("walk").agg(F.min_by("place", F.struct("seq", "node", "id", "tokens", "place")).alias("begin"))
        rows = rows.join(begin, "walk").withColumn("place", F.col("begin")).withColumn("part", F.shiftright("place", PART_BITS)).drop("begin")
        size = rows.groupBy("part").agg((F.max("place") - F.shiftleft("part", PART_BITS) + 1).alias("n"))  # a row for each file
        upto = size.select("part", (F.sum("n").over(Window.orderBy("part")) - F.shiftleft("part", PART_BITS) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
        bucket = F.floor((F.col("place") + F.col("base")) * BUCKETS / F.col("all"))
        rows = rows.join(F.broadcast(upto), "part").withColumn("bucket", bucket.cast("int")).drop("part", "base", "all")
        first = ["place", "walk"]
    else:
        rows = rows.withColumn("bucket", (F.pmod(F.xxhash64("component"), F.lit(BUCKETS)) * PARTS + F.pmod(F.xxhash64("path"), F.lit(PARTS))).cast("int"))
    rows = checkpoint(rows)
    base = rows.groupBy("bucket").agg(F.sum("tokens").alias("t"))  # BUCKETS * PARTS rows at most, so one task may add them up
    base = base.select("bucket", F.coalesce(F.sum("t").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("bucket").orderBy(*first, "component", "path", "seq", "node", "id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum("tokens").over(order)).join(base, "bucket").select("id", "tokens", (F.col("end") + F.col("before")).alias("end"))
    placed = placed.withColumn("begin", F.col("end") - F.col("tokens"))
    size = F.lit(window).cast("long")
    split = placed.select("*", F.explode(F.sequence(F.expr(f"begin div {window}"), F.expr(f"(end - 1) div {window}"))).alias("window_id"))
    lo, hi = F.greatest(F.col("begin"), F.col("window_id") * size), F.least(F.col("end"), (F.col("window_id") + 1) * size)
    pieces = split.select("window_id", F.struct(lo.alias("at"), F.col("id").alias("doc_id"), (lo - F.col("begin")).alias("start"), (hi - lo).alias("tokens")).alias("p"))
    full = pieces.groupBy("window_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return full.select("window_id", F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["tokens"]).alias("n_tokens"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["tokens"].alias("tokens"))).alias("segments"))
