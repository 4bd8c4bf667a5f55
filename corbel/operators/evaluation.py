"""Retrieval metrics with binary relevance."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(hits: DataFrame, totals: DataFrame, k: int = 10, dedup: bool = False) -> DataFrame:
    """(query_id, mrr, recall, precision, ndcg) of every query of totals.

    hits: (query_id, rank from 1, doc_id, relevant boolean); totals: (query_id,
    n_relevant). Recall, precision and ndcg are over ranks up to k, mrr over
    all; precision divides by the hits that there are. Several hits of one
    document each count, so that recall and ndcg can pass 1; with dedup=True
    only its first one does, and later ranks close up.
    """
    if dedup:
        hits = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"), F.max("relevant").alias("relevant"))
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    good, inside = F.col("relevant"), F.col("rank") <= k
    discount = 1 / F.log2(F.col("rank") + 1.0)
    rows = hits.groupBy("query_id").agg(
        F.min(F.when(good, F.col("rank"))).alias("first"), F.count(F.when(good & inside, 1)).alias("n_hit"), F.count(F.when(inside, 1)).alias("n_all"), F.sum(F.when(good & inside, discount)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    has = F.col("n_relevant") > 0
    zero = F.lit(0.0)
    return totals.join(rows, "query_id", "left").select(
        "query_id",
        F.coalesce(1 / F.col("first"), zero).alias("mrr"),
        F.when(has, F.coalesce(F.col("n_hit") / F.col("n_relevant"), zero)).otherwise(0.0).alias("recall"),
        F.when(F.col("n_all") > 0, F.col("n_hit") / F.col("n_all")).otherwise(0.0).alias("precision"),
        F.when(has, F.coalesce(F.col("dcg") / ideal, zero)).otherwise(0.0).alias("ndcg"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """(queries, mrr, recall, precision, ndcg): means over all queries."""
    return rows.agg(F.count("*").alias("queries"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("mrr", "recall", "precision", "ndcg")])
