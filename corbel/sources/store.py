"""The index: tables below one root, as segments that a numbered log lists.

A write adds a segment, a folder of its own with the new rows and the keys of
the rows that they replace or delete; nothing that is there is rewritten, so
the cost of a write follows the rows written. Then it adds an entry to the
log, by a rename that fails if another writer's entry came first. Readers see
the state of one entry, and a job that dies leaves the state before. Segments
are merged by size, so that their number stays small. All files go through
Hadoop's file system of the root's address.
"""

import json
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bm25 import postings
from ..operators.search import metadata_filter
from ..schema import CHUNK, FINGERPRINT, NotFoundError, StoreError

SCHEMA_VERSION = 2
KEYS = {"chunks": "chunk_id", "postings": "chunk_id", "fingerprints": "path"}
KINDS = {"chunks": CHUNK, "fingerprints": FINGERPRINT, "postings": "chunk_id string, term string, tf long, dl long"}
#: Columns with Bloom filters in their files, which answer lookups of a few keys.
BLOOM = {"chunks": ("chunk_id", "doc_id", "source_id"), "postings": ("chunk_id", "term"), "fingerprints": ("path",)}
#: Keys up to which a lookup is a filter on the scan; more are joined.
FEW = 1000
#: Segments of a table beyond which a write merges the smaller ones.
MOST_SEGMENTS = 24
SEQ = "_seq"


class VectorStore(Protocol):
    """What the plans need of an index."""

    spark: SparkSession

    def add(self, chunks: DataFrame, model: str | None = None) -> None: ...

    def all(self) -> DataFrame: ...

    def table(self, name: str) -> DataFrame: ...

    def delete(self, docs: DataFrame, column: str = "doc_id") -> None: ...

    def clear(self) -> None: ...


class MemoryStore:
    """An index of the session alone: rows are appended, also those with a chunk_id that is there, and nothing is written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.clear()

    def all(self) -> DataFrame:
        return self._chunks

    def table(self, name: str) -> DataFrame:
        if name == "postings":
            return postings(self._chunks, "chunk_id")
        if name not in KEYS:
            raise NotFoundError(name)
        return self._chunks if name == "chunks" else self.spark.createDataFrame([], KINDS[name])

    def add(self, chunks: DataFrame, model: str | None = None) -> None:
        self._chunks = self._chunks.unionByName(chunks.select(*CHUNK.fieldNames()))

    def delete(self, docs: DataFrame, column: str = "doc_id") -> None:
        self._chunks = self._chunks.join(docs.toDF(column).distinct(), column, "left_anti").select(*CHUNK.fieldNames())

    def delete_document(self, doc_id: str) -> None:
        self.delete(self.spark.createDataFrame([(doc_id,)], "doc_id string"))

    def find(self, conditions: dict[str, str]) -> DataFrame:
        return metadata_filter(self._chunks, conditions)

    def count(self) -> int:
        return self._chunks.count()

    def clear(self) -> None:
        self._chunks = self.spark.createDataFrame([], CHUNK)


class Store:
    """chunks keyed by chunk_id, the files' fingerprints keyed by path, and the BM25 postings of the chunks."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # The log

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        fs, at = self._fs(), self._path("_log")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def _entry(self, number: int | None = None) -> dict:
        """An entry, by default the last one: its number, the next segment's number, the index's metadata, and the
        segments of chunks and fingerprints, each with its folder, its rows and whether it replaces some."""
        if number is None:
            numbers = self._numbers()
            if not numbers:
                return {"number": 0, "next": 1, "metadata": {}, "chunks": [], "fingerprints": []}
            number = numbers[-1]
        f = self._fs().open(self._path("_log", f"{number:012d}.json"))
        try:
            return json.loads(bytes(f.readAllBytes()).decode())
        finally:
            f.close()

    def _commit(self, entry: dict) -> None:
        """Adds the entry after the one that it was made from; raises if there is one already."""
        number, hadoop = entry["number"] + 1, self.spark._jvm.org.apache.hadoop.fs
        fs, tmp, to = self._fs(), self._path("_log", f".{uuid.uuid4().hex}"), self._path("_log", f"{number:012d}.json")
        f = fs.create(tmp, True)
        try:
            f.write(bytearray(json.dumps(entry | {"number": number}).encode()))
        finally:
            f.close()
        try:
            context = hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(fs.makeQualified(tmp), fs.makeQualified(to), self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Exception as e:
            fs.delete(tmp, False)
            raise StoreError(f"another writer has made version {number} of {self.root}") from e
        for old in self._numbers()[:-2]:  # the entry before stays for readers that have begun
            self._forget(old)

    def _forget(self, number: int) -> None:
        """Deletes an entry, and the segments that no later one has."""
        folders = lambda n: {s["at"] for table in ("chunks", "fingerprints") for s in self._entry(n)[table]}
        gone = folders(number)
        for later in self._numbers():
            if later > number:
                gone -= folders(later)
        for at in gone:
            self._fs().delete(self._path("data", at), True)
        self._fs().delete(self._path("_log", f"{number:012d}.json"), False)

    # Reading

    def _live(self, entry: dict, name: str, segments: list | None = None) -> DataFrame:
        """The rows of a table that no later segment replaces, with their segment's number in SEQ."""
        segments = entry["fingerprints" if name == "fingerprints" else "chunks"] if segments is None else segments
        held = [f"{self.root}/data/{s['at']}/{name}" for s in segments if s["rows"]]
        if not held:
            return self.spark.createDataFrame([], KINDS[name]).withColumn(SEQ, F.lit(0).cast("long"))
        rows = self.spark.read.parquet(*held)
        gone = [f"{self.root}/data/{s['at']}/gone" for s in segments if s["gone"]]
        if not gone:
            return rows
        late = self.spark.read.parquet(*gone).groupBy(F.col("key").alias(KEYS[name])).agg(F.max(SEQ).alias("_gone"))
        return rows.join(late, KEYS[name], "left").filter(F.col("_gone").isNull() | (F.col(SEQ) >= F.col("_gone"))).drop("_gone")

    def table(self, name: str) -> DataFrame:
        if name not in KEYS:
            raise NotFoundError(name)
        return self._live(self._entry(), name).drop(SEQ)

    def all(self) -> DataFrame:
        return self.table("chunks").select(*CHUNK.fieldNames())

    def metadata(self) -> dict:
        """{schema_version, dimension, model} of the index; an index without a version has version 1."""
        return {"schema_version": 1, **self._entry()["metadata"]}

    def get(self, doc_id: str) -> DataFrame:
        """Chunks of a document, by its id or that of its source."""
        return self.all().filter((F.col("doc_id") == doc_id) | (F.col("source_id") == doc_id))

    def find(self, conditions: dict[str, str]) -> DataFrame:
        return metadata_filter(self.all(), conditions)

    def count(self) -> int:
        return self.all().count()

    def counts(self, key: str = "collection") -> DataFrame:
        """(key, chunks): chunks for each value that their metadata has under `key`; null for those without."""
        return self.all().groupBy(F.element_at("metadata", F.lit(key)).alias(key)).agg(F.count("*").alias("chunks"))

    # Writing

    def _write(self, df: DataFrame, at: str, name: str) -> DataFrame:
        """df as a segment's table, read again, so that nothing is worked out twice."""
        to = f"{self.root}/data/{at}/{name}"
        df.write.options(**{f"parquet.bloom.filter.enabled#{c}": "true" for c in BLOOM.get(name, ())}).parquet(to)
        return self.spark.read.parquet(to)

    def _holding(self, rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
        """rows whose `column` is in keys (one column)."""
        few = keys.limit(FEW + 1).toArrow().column(0).to_pylist()
        return rows.filter(F.col(column).isin(few)) if len(few) <= FEW else rows.join(keys.toDF(column), column, "left_semi")

    def _gone(self, rows: DataFrame, key: str, at: str, number: int) -> bool:
        """Writes the keys of rows as replaced by segment `number`; False if there are none."""
        return not self._write(rows.select(F.col(key).alias("key"), F.lit(number).cast("long").alias(SEQ)), at, "gone").isEmpty()

    def _added(self, entry: dict, chunks: DataFrame, model: str | None) -> dict:
        """entry with a segment of the chunks."""
        said, at, number = entry["metadata"], uuid.uuid4().hex, entry["next"]
        try:
            new = self._write(chunks.select(*CHUNK.fieldNames()).withColumn(SEQ, F.lit(number).cast("long")), at, "chunks")
            seen = new.agg(
                F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"), F.count_if(F.col("embedding").isNull()).alias("none"),
                F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"),
            ).first()
            if not seen.n:
                self._fs().delete(self._path("data", at), True)
                return entry
            if seen.none:
                raise StoreError(f"{seen.none} chunks have no embedding")
            if seen.low != seen.high or said.get("dimension", seen.low) != seen.low:
                raise StoreError(f"dimension {seen.low} to {seen.high}; the index has {said.get('dimension', 'none')}")
            if model and said.get("model", model) != model:
                raise StoreError(f"model {model}; the index has {said['model']}")
            if seen.ids < seen.n:
                before, at = at, uuid.uuid4().hex
                new = self._write(new.dropDuplicates(["chunk_id"]), at, "chunks")
                self._fs().delete(self._path("data", before), True)
            self._write(postings(new, "chunk_id").withColumn(SEQ, F.lit(number).cast("long")), at, "postings")
            old = self._holding(self._live(entry, "chunks").select("chunk_id"), "chunk_id", new.select("chunk_id")) if entry["chunks"] else None
            gone = old is not None and self._gone(old, "chunk_id", at, number)
        except BaseException:
            self._fs().delete(self._path("data", at), True)
            raise
        said = said | {"dimension": seen.low, "schema_version": SCHEMA_VERSION} | ({"model": model} if model else {})
        return entry | {"chunks": [*entry["chunks"], {"at": at, "rows": seen.ids, "gone": gone}], "metadata": said, "next": number + 1}

    def _deleted(self, entry: dict, table: str, docs: DataFrame, column: str) -> dict:
        """entry with a segment that deletes the rows of `table` whose `column` is in docs (one column)."""
        if not entry[table]:
            return entry
        at, number, key = uuid.uuid4().hex, entry["next"], KEYS[table]
        rows = self._live(entry, table).select(*{key: 0, column: 0})
        if not self._gone(self._holding(rows, column, docs.toDF(column).distinct()), key, at, number):
            self._fs().delete(self._path("data", at), True)
            return entry
        return entry | {table: [*entry[table], {"at": at, "rows": 0, "gone": True}], "next": number + 1}

    def _marked(self, entry: dict, files: DataFrame) -> dict:
        """entry with a segment of fingerprints, which replace those of the same paths."""
        at, number = uuid.uuid4().hex, entry["next"]
        new = self._write(files.select(*FINGERPRINT.fieldNames()).dropDuplicates(["path"]).withColumn(SEQ, F.lit(number).cast("long")), at, "fingerprints")
        n = new.count()
        if not n:
            return entry
        old = self._holding(self._live(entry, "fingerprints").select("path"), "path", new.select("path")) if entry["fingerprints"] else None
        gone = old is not None and self._gone(old, "path", at, number)
        return entry | {"fingerprints": [*entry["fingerprints"], {"at": at, "rows": n, "gone": gone}], "next": number + 1}

    def _merged(self, entry: dict, table: str, whole: bool = False) -> dict:
        """entry with the last segments of a table merged to one: all, or those before the last that have at most
        twice the rows of what comes after, so that a row is rewritten as often as the logarithm of the table's size."""
        segments = entry[table]
        first = len(segments) - 1
        total = segments[first]["rows"]
        while first and (whole or first == len(segments) - 1 or segments[first - 1]["rows"] <= 2 * total):
            first -= 1
            total += segments[first]["rows"]
        part, at, rows = segments[first:], uuid.uuid4().hex, 0
        for name in ("postings", "chunks") if table == "chunks" else ("fingerprints",):
            if any(s["rows"] for s in part):
                rows = self._write(self._live(entry, name, part), at, name).count()
        keys = [f"{self.root}/data/{s['at']}/gone" for s in part if s["gone"]]
        gone = bool(first and keys)  # without older segments there is nothing left to replace
        if gone:
            self._write(self.spark.read.parquet(*keys).groupBy("key").agg(F.max(SEQ).alias(SEQ)), at, "gone")
        return entry | {table: [*segments[:first], *([{"at": at, "rows": rows, "gone": gone}] if rows or gone else [])]}

    def _change(self, make) -> None:
        """Commits what make() gives for the present entry, with merged segments where there are too many."""
        begun = self._entry()
        entry = make(begun)
        if entry is begun:
            return
        for table in ("chunks", "fingerprints"):
            if len(entry[table]) > MOST_SEGMENTS:
                entry = self._merged(entry, table)
        self._commit(entry)

    def add(self, chunks: DataFrame, model: str | None = None) -> None:
        """Inserts chunks, or replaces those with the same chunk_id, and their postings with them. Each chunk is
        worked out once. Chunks without embedding or with another dimension than the index are refused, and the
        index stays as it was. Of rows with one chunk_id one is taken."""
        self._change(lambda entry: self._added(entry, chunks, model))

    def delete(self, docs: DataFrame, column: str = "doc_id") -> None:
        """Removes the chunks whose `column` is in docs (one column)."""
        self._change(lambda entry: self._deleted(entry, "chunks", docs, column))

    def delete_document(self, doc_id: str) -> None:
        self.delete(self.spark.createDataFrame([(doc_id,)], "doc_id string"))

    def set_fingerprints(self, files: DataFrame) -> None:
        """Records (path, content_hash, modified), replacing those of the same paths."""
        self._change(lambda entry: self._marked(entry, files))

    def clear(self) -> None:
        """Empties every table, fingerprints and the index's dimension with them."""
        if self._numbers():
            self._commit(self._entry() | {"chunks": [], "fingerprints": [], "metadata": {}})

    def compact(self) -> None:
        """Merges the segments of each table to one."""

        def make(entry):
            for table in ("chunks", "fingerprints"):
                if entry[table]:
                    entry = self._merged(entry, table, True)
            return entry

        self._change(make)

    def migrate(self) -> int:
        """Brings the index to SCHEMA_VERSION and returns the version it had."""
        had = self.metadata()["schema_version"]
        if had > SCHEMA_VERSION:
            raise StoreError(f"the index has version {had}, this program knows {SCHEMA_VERSION}")
        if had < SCHEMA_VERSION:
            self._change(lambda entry: entry | {"metadata": entry["metadata"] | {"schema_version": SCHEMA_VERSION}})
        return had

    def backup(self, to: str) -> None:
        """A copy of the index's present state at another root, each table as one segment."""
        other, entry = Store(self.spark, to), self._entry()
        made = other._entry() | {"metadata": entry["metadata"], "chunks": [], "fingerprints": [], "next": entry["next"]}
        for table, names in (("chunks", ("postings", "chunks")), ("fingerprints", ("fingerprints",))):
            if any(s["rows"] for s in entry[table]):
                at = uuid.uuid4().hex
                rows = [other._write(self._live(entry, name), at, name).count() for name in names][-1]
                made[table] = [{"at": at, "rows": rows, "gone": False}] if rows else []
        other._commit(made)

    def sync(self, files: DataFrame, index, model: str | None = None) -> dict[str, int]:
        """Brings the index up to files (path, content_hash, modified, ...): index maps the new and changed ones
        to chunks whose source_id is the path. Chunks and fingerprints change by one entry of the log; running it
        again with the same files changes nothing."""
        change = diff(files, self.table("fingerprints")).cache()
        try:
            count = {r.status: r.n for r in change.groupBy("status").agg(F.count("*").alias("n")).collect()}  # three rows

            def make(entry):
                if count.get("deleted") or count.get("modified"):
                    entry = self._deleted(entry, "chunks", change.filter("status <> 'new'").select("path"), "source_id")
                    entry = self._deleted(entry, "fingerprints", change.filter("status = 'deleted'").select("path"), "path")
                if count.get("new") or count.get("modified"):
                    fresh = files.join(change.filter("status in ('new', 'modified')").select("path"), "path", "left_semi")
                    entry = self._marked(self._added(entry, index(fresh), model), fresh)
                return entry

            self._change(make)
        finally:
            change.unpersist()
        return count


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, content_hash, modified) of binaryFile rows, over their bytes."""
    return files.select("path", F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("modified"))


def diff(now: DataFrame, before: DataFrame, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """(key, status): new, modified and deleted rows between two tables of digests; one full outer join."""
    a, b = now.select(key, F.col(digest).alias("h1")), before.select(key, F.col(digest).alias("h2"))
    status = F.when(F.col("h2").isNull(), "new").when(F.col("h1").isNull(), "deleted").when(F.col("h1") != F.col("h2"), "modified")
    return a.join(b, key, "full_outer").select(key, status.alias("status")).filter("status is not null")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(content_hash, first_doc, copies) of the texts that several documents have; only digests are shuffled."""
    held = docs.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return held.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).filter("copies > 1 and content_hash is not null")


def export_documents(store: Store) -> DataFrame:
    """Documents (id, text, metadata) of the chunks, with chunk_id among the metadata and without embeddings."""
    mark = F.create_map(F.lit("chunk_id"), F.col("chunk_id"))
    rest = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != "chunk_id")
    return store.all().select(F.col("doc_id").alias("id"), "text", F.map_concat(rest, mark).alias("metadata"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's row that is last by `order`."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
