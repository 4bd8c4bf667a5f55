"""The entity graph: entities of chunks, co-occurrence, bounded traversal and retrieval by it."""

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_words
from ..shared import checkpoint
from .bm25 import top

#: Dictionary terms by type; a term counts wherever its letters are, also inside a word.
TERMS = {
    "CONCEPT": sorted(["http", "tcp", "websocket", "api", "embedding", "transformer"] + [f"{a} {b}" for a, b in (("vector", "database"), ("knowledge", "graph"), ("neural", "network"), ("attention", "mechanism"), ("machine", "learning"), ("deep", "learning"))] + ["natural language processing", "retrieval augmented generation"]),
    "TECH": sorted("windows linux macos sqlite redis mongodb postgresql elasticsearch rust golang java javascript typescript python kubernetes docker".split()),
}
#: Words that are often written with a capital without being names.
COMMON = frozenset(
    """a after again all already also always and because before between big both but different during each every few
    first further great high here how however important just large last little long more most never new next old once
    only other own right same since small some still such than that the then there these this those through too very
    what when where which while who why without about""".split()
)
#: Texts whose names are sought before the next ones are read.
SLICE = 256
PRECEDENCE = ("TECH", "CONCEPT", "PROPER_NOUN", "NOUN")


def proper_nouns(text: str) -> list[tuple[str, str]]:
    """(name, type) of runs of words with capitals that don't begin a sentence; each once."""
    raw = split_words(text)
    clean = []
    for w in raw:
        a, b = 0, len(w)
        while a < b and not w[a].isalnum():
            a += 1
        while b > a and not w[b - 1].isalnum():
            b -= 1
        clean.append(w[a:b])
    big = [len(w.encode()) > 1 and w[0].isupper() for w in clean]
    out, i = {}, 1
    while i < len(raw):
        if big[i] and not raw[i - 1].endswith((".", "!", "?")):
            j = i
            while j < len(raw) and big[j]:
                j += 1
            name = " ".join(clean[i:j]).lower()
            if name not in COMMON:
                out[name, "PROPER_NOUN" if j - i > 1 else "NOUN"] = None
            i = j
        else:
            i += 1
    return list(out)


def nouns_of(texts: pa.Array) -> pa.Array:
    """proper_nouns() of each text, by SLICE texts at a time, so that few strings and tuples are held at once."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))
    parts = [pa.array([], kind)]
    for at in range(0, len(texts), SLICE):
        found = [proper_nouns(t or "") for t in texts.slice(at, SLICE).to_pylist()]
        ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
        names, types = (pa.array([e[i] for f in found for e in f], pa.string()) for i in (0, 1))
        parts.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([names, types], fields=list(kind.value_type))))
    return pa.concat_arrays([p.cast(kind) for p in parts])


def dictionary_terms(low: Column, terms: dict[str, list[str]] | None = None) -> Column:
    """array<struct(name, type)> of the terms that the lower-case text `low` contains."""
    own = TERMS if terms is None else terms
    found = [F.when(F.contains(low, F.lit(t)), F.struct(F.lit(t).alias("name"), F.lit(kind).alias("type"))) for kind in sorted(own) for t in own[kind]]
    return F.array_compact(F.array(*found)).cast("array<struct<name:string,type:string>>")


def entities(chunks: DataFrame, terms: dict[str, list[str]] | None = None, nouns: bool = True, id_col: str = "chunk_id") -> DataFrame:
    """(chunk_id, entities array<struct(name, type)>): one entry for each name, by PRECEDENCE of its types; sorted by name. No shuffle."""
    chunks = chunks.select(F.col(id_col).alias("chunk_id"), "text", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("low"))
    found = dictionary_terms(F.col("low"), terms)
    if nouns:

        @F.arrow_udf("array<struct<name:string,type:string>>")
        def run(texts: pa.Array) -> pa.Array:
            return nouns_of(texts)

        found = F.concat(found, run("text"))
    order = F.create_map(*[x for i, k in enumerate(PRECEDENCE) for x in (F.lit(k), F.lit(i))])
    ranked = F.array_sort(F.transform("found", lambda e: F.struct(e["name"].alias("name"), F.coalesce(order[e["type"]], F.lit(9)).alias("p"), e["type"].alias("type"))))
    first = F.filter("ranked", lambda e, i: (i == 0) | (F.get("ranked", i - 1)["name"] != e["name"]))
    rows = chunks.select("chunk_id", found.alias("found")).select("chunk_id", ranked.alias("ranked"))
    return rows.select("chunk_id", F.transform(first, lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type"))).alias("entities"))


def _exploded(rows: DataFrame, column: str, to: str) -> DataFrame:
    """rows with an element of `column` each. An inner explode would infer a filter on the array, which Catalyst
    pushes to where the array is made, so that it is worked out once more for it."""
    return rows.select("*", F.explode_outer(column).alias(to)).filter(F.col(to).isNotNull())


def mentions(held: DataFrame) -> DataFrame:
    """(name, type, chunk_id); a name's type is the same in all chunks, the first by PRECEDENCE that it has anywhere."""
    return _exploded(held.select("chunk_id", "entities"), "entities", "e").select("e.name", "e.type", "chunk_id")


def nodes(held: DataFrame) -> DataFrame:
    """(name, type, chunks)"""
    order = F.create_map(*[x for i, k in enumerate(PRECEDENCE) for x in (F.lit(k), F.lit(i))])
    return mentions(held).groupBy("name").agg(F.min_by("type", F.coalesce(order[F.col("type")], F.lit(9))).alias("type"), F.count("*").alias("chunks"))


def cooccurrence(held: DataFrame) -> DataFrame:
    """(source, target, weight): pairs of names in one chunk, source < target, and the number of such chunks.

    Pairs are made inside each chunk's array, so the only shuffle is that of
    the partial counts.
    """
    names = F.transform("entities", lambda e: e["name"])
    pairs = F.flatten(F.transform("names", lambda a, i: F.transform(F.slice("names", i + 2, F.size("names")), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    rows = held.select(names.alias("names")).select(pairs.alias("pairs"))
    return _exploded(rows, "pairs", "p").groupBy("p.source", "p.target").agg(F.count("*").alias("weight"))


def neighbours(edges: DataFrame, name: str, both: bool = False) -> DataFrame:
    """(name, weight) of the targets of a node's edges; of both ends with both=True."""
    out = edges.filter(F.col("source") == name).select(F.col("target").alias("name"), "weight")
    return out.unionByName(edges.filter(F.col("target") == name).select(F.col("source").alias("name"), "weight")) if both else out


def traverse(edges: DataFrame, starts: DataFrame, max_hops: int = 2) -> DataFrame:
    """(start, name, depth) of all nodes within max_hops of each start, edges taken both ways; a start that
    isn't in the graph is reached too. starts: (start). The edges are read once and kept in the shared checkpoint
    folder for the hops, and so is each hop's frontier."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    both = checkpoint(both)
    seen = starts.select(F.lower("start").alias("start")).distinct().select("start", F.col("start").alias("name"), F.lit(0).alias("depth"))
    frontier = seen
    for hop in range(1, max_hops + 1):
        step = frontier.join(both, frontier["name"] == both["source"]).select("start", F.col("target").alias("name")).distinct()
        frontier = checkpoint(step.join(seen, ["start", "name"], "left_anti").select("start", "name", F.lit(hop).alias("depth")))
        seen = seen.unionByName(frontier)
    return seen


def retrieve(edges: DataFrame, found: DataFrame, asked: DataFrame, k: int = 10, max_hops: int = 2) -> DataFrame:
    """(query_id, chunk_id, score, rank): chunks that mention a node near the query's entities, by 1 / (depth + 1).
    found: mentions(); asked: (query_id, name)."""
    near = traverse(edges, asked.select(F.col("name").alias("start")), max_hops)
    hops = asked.join(near.withColumnRenamed("name", "other"), F.lower(asked["name"]) == near["start"]).groupBy("query_id", "other").agg(F.min("depth").alias("depth"))
    hits = hops.join(found.select(F.col("name").alias("other"), "chunk_id"), "other").groupBy("query_id", "chunk_id").agg((1 / (F.min("depth") + 1)).alias("score"))
    return top(hits, k)


def asked_names(queries: DataFrame, terms: dict[str, list[str]] | None = None, nouns: bool = True) -> DataFrame:
    """(query_id, name): the entities of questions (query_id, text)."""
    return entities(queries, terms, nouns, "query_id").select(F.col("chunk_id").alias("query_id"), F.explode("entities").alias("e")).select("query_id", "e.name")


def search(edges: DataFrame, found: DataFrame, queries: DataFrame, k: int = 10, max_hops: int = 2, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """retrieve() by the entities of questions (query_id, text)."""
    return retrieve(edges, found, asked_names(queries, terms), k, max_hops)


def save(held: DataFrame, path: str) -> None:
    """The graph of entities() as Parquet: nodes, edges and mentions."""
    for name, rows in (("nodes", nodes(held)), ("edges", cooccurrence(held)), ("mentions", mentions(held))):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, mentions)"""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "mentions"))


def counts(spark, path: str) -> dict[str, int]:
    n, e, m = load(spark, path)
    return {"entities": n.count(), "edges": e.count(), "mentions": m.count()}
