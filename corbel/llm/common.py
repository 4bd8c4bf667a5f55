"""Helpers shared by the training-data operators."""

import builtins
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one numpy pass works on; keeps temporaries near the cache.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialises df in the shared checkpoint folder and cuts its lineage.

    The folder is the session's spark.checkpoint.dir. Where that is unset, as
    in tests on one machine, a folder under the temporary directory is used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(place or os.path.join(tempfile.gettempdir(), "corbel-checkpoint"))
    return df.checkpoint(eager=True)


def worker_cache(key, make):
    """make() once per Python worker. Module globals are shipped by value, so
    they can't hold it."""
    store = builtins.__dict__.setdefault("_corbel_worker_cache", {})
    if key not in store:
        store[key] = make()
    return store[key]


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores added as long as df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_keys(df: DataFrame) -> tuple[DataFrame, str, str]:
    """(df with two columns of longs that tell its rows apart, the columns' names), the same in every run over it.

    The rows of written files have their file and number; any other table is
    checkpointed with numbers.
    """
    file, row = unused(df, "__file"), unused(df, "__row")
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        return df.withColumns({file: F.xxhash64("_metadata.file_path"), row: F.col("_metadata.row_index")}), file, row
    return checkpoint(df.withColumns({file: F.lit(0).cast("long"), row: F.monotonically_increasing_id()})), file, row


def named(name: str) -> Column:
    """The column of that very name, also with dots in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_rows(df: DataFrame, run, *more: Column) -> DataFrame:
    """df.mapInArrow(run) over df's columns and `more`, giving df's columns; batches have them by place.

    The columns are renamed for it, since mapInArrow takes no names with dots.
    """
    plain = [f"c{i}" for i in range(len(df.columns))]
    kind = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(plain, df.schema)])
    rows = df.select(*[named(c).alias(n) for c, n in zip(df.columns, plain)], *[c.alias(f"m{i}") for i, c in enumerate(more)])
    return rows.mapInArrow(run, kind).toDF(*df.columns)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(id, text, more...) without rows that have no id; a null text is ''."""
    return df.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(c).alias(c) for c in more]
    ).filter(F.col("id").isNotNull())
