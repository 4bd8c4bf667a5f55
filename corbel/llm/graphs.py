"""Connected components of an edge table."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Edges that one task may hold; more are worked on by rounds over all tasks, with the same result.
MOST_EDGES = 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges (a, b) connect, one for each node but the least of its part, which it leads to."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for to in (x, y, label[x], label[y]):
            np.minimum.at(new, to, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(ids)))
    return ids[own], ids[label[own]]


def components(edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is its least node.

    Alternates large-star and small-star steps, so the number of rounds grows
    with the logarithm of the graph's diameter and a hub's edges are never
    paired with each other. Rounds go on until the edges stay the same; every
    round is checkpointed. Self-loops and repeated edges change nothing; no
    edges give no rows.
    """
    e = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if e.limit(most + 1).count() <= most:
        return e.repartition(1).mapInArrow(_by_one_task, "node long, component long")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(down, "u")
        e = checkpoint(star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _by_one_task(batches):
    held = [b for b in batches if b.num_rows]
    if held:
        node, least = forest(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
        roots = np.unique(least)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, roots])), pa.array(np.concatenate([least, roots]))], ["node", "component"])
