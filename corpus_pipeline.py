"""Corpus preparation: five stages over `documents`, each written and read again by the next."""

import os
import tempfile
import uuid

from corbel.llm.mixing import curriculum
from corbel.llm.packing import pack
from corbel.llm.pii import pseudonymise_documents, session_key
from corbel.llm.simhash import drop_near_duplicates
from corbel.llm.toxicity import drop_toxic


def toxicity(spark, docs, sf_dir):
    """docs without those that the classifier rejects; see drop_toxic() for nulls, ties, long texts and empty tables."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark, docs, sf_dir):
    """docs with one document of each group of near copies; awkward rows as in drop_near_duplicates()."""
    return drop_near_duplicates(docs)


def pii(spark, docs, sf_dir):
    """docs with pseudonyms for personal data, every row kept; awkward rows as in pseudonymise_documents()."""
    return pseudonymise_documents(docs, session_key(spark))


def mixing(spark, docs, sf_dir):
    """docs in training order, rows of sources below their target weight repeated; awkward rows as in curriculum()."""
    return curriculum(docs)


def packing(spark, docs, sf_dir):
    """Windows of related documents along that order; awkward rows as in pack()."""
    return pack(docs, in_order=True)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the classifier, fingerprints and graph; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir, folder=None):
    """The packed windows of documents after all stages, along the order that mixing gives them.

    Each stage's table is written to `folder`/<stage> and stays there; the
    windows' places refer to the pseudonymised texts of `folder`/mixing.
    Without `folder` a new one below spark.checkpoint.dir is used, a folder
    that all executors share, and a table goes once the next one is written;
    where that setting is unset, as in tests, it is below the temporary
    directory.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = folder or f"{base or os.path.join(tempfile.gettempdir(), 'corbel-checkpoint')}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before and not folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{at}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
