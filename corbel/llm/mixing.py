"""Time-varying mixing of sources by cumulative token demand.

A schedule gives each source's share of the tokens at moments of the run from
0 to 1, linear in between. The integral of the share up to t, times the run's
length in tokens, is the source's demand up to t. A document whose middle
token is the source's x-th is trained on when demand reaches x, so its
position is the inverse of the demand; ordering all documents by position
gives the shares asked for at every moment.

The running sum inside a source is made over hashed buckets, and the buckets'
sums are added up afterwards: a source of any size is spread over BUCKETS
tasks, and texts are never shuffled to be placed.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, named, unused

#: Leading hex digits of a document's hash that make its bucket: 4096 buckets.
BUCKET_DIGITS = 3
ALPHAS = ((0.0, 1.0), (0.5, 0.75), (1.0, 0.5))
SEED = "mix-1"


def lengths(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, tokens, key): a token is 4 characters, a document has at least 1; key orders its source."""
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.length(F.coalesce(F.col("text"), F.lit(""))).alias("n"))
        .filter("doc_id is not null")
        .select("doc_id", "source", F.greatest(F.lit(1), F.ceil(F.col("n") / 4)).cast("long").alias("tokens"), F.md5(F.concat(F.lit(seed + ":"), F.col("doc_id").cast("string"))).alias("key"))
    )


def running(rows: DataFrame) -> DataFrame:
    """rows and `upto`: the tokens of the source up to and with the row, in order of key."""
    rows = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("t")).select("source", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("before"))
    return rows.withColumn("upto", F.sum("tokens").over(order)).join(base, ["source", "bucket"]).withColumn("upto", F.col("upto") + F.col("before")).drop("bucket", "before")


def annealed(totals: DataFrame, alphas=ALPHAS) -> DataFrame:
    """(source, t, w): at moment t shares in proportion to size ** alpha, for each (t, alpha)."""
    rows = totals.select("source", "size", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(a)).alias("a")) for t, a in alphas])).alias("k"))
    return rows.select("source", F.col("k.t").alias("t"), F.pow(F.col("size").cast("double"), F.col("k.a")).alias("w"))


def segments(schedule: DataFrame) -> DataFrame:
    """(source, t0, t1, w0, w1, d0, d1): the schedule's linear pieces, shares summing to 1 at every moment,
    with the demand d (as a part of the run's tokens) at their ends."""
    total = schedule.groupBy("t").agg(F.sum("w").alias("all"))
    shares = schedule.join(total, "t").select("source", "t", (F.col("w") / F.col("all")).alias("w"))
    w = Window.partitionBy("source").orderBy("t")
    pieces = shares.select("source", F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"), F.col("w").alias("w0"), F.lead("w").over(w).alias("w1")).filter("t1 is not null")
    area = (F.col("w0") + F.col("w1")) / 2 * (F.col("t1") - F.col("t0"))
    upto = F.sum(area).over(Window.partitionBy("source").orderBy("t0").rowsBetween(Window.unboundedPreceding, 0))
    return pieces.withColumn("d1", upto).withColumn("d0", F.col("d1") - area)


def positions(rows: DataFrame, schedule=annealed) -> DataFrame:
    """(doc_id, source, epoch, tokens, position), ordered by position.

    rows as from lengths(); schedule makes (source, t, w) from (source, size).
    The run is as long as uses every document at least once; a source that is
    asked for more than it has is passed through again, in epochs from 0.
    """
    rows = checkpoint(rows)
    totals = checkpoint(rows.groupBy("source").agg(F.sum("tokens").alias("size")))
    pieces = segments(schedule(totals))
    pieces = checkpoint(pieces.withColumn("last", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("t0"))) == 1))
    demand = pieces.groupBy("source").agg(F.max("d1").alias("demand"))
    need = totals.join(demand, "source")
    run = need.agg(F.max(F.col("size") / F.col("demand")).alias("run"))
    need = need.crossJoin(F.broadcast(run))  # one row
    # The longest source's last token may lie beyond its demand by rounding alone.
    epochs = F.greatest(F.lit(1), F.ceil(F.col("demand") * F.col("run") / F.col("size") - 1e-9)).cast("int")
    need = need.select("source", "size", "run", "demand", F.explode(F.sequence(F.lit(0), epochs - 1)).alias("epoch"))
    need = checkpoint(need)
    x = (F.col("epoch") * F.col("size") + F.col("upto") - F.col("tokens") / 2) / F.col("run")
    placed = running(rows).join(need, "source").withColumn("x", x).filter("epoch = 0 or x < demand")
    placed = placed.join(pieces, "source").filter("x >= d0 and (x < d1 or last)")
    slope = (F.col("w1") - F.col("w0")) / (F.col("t1") - F.col("t0"))
    left = F.col("x") - F.col("d0")
    root = F.sqrt(F.greatest(F.lit(0.0), F.col("w0") * F.col("w0") + 2 * slope * left))
    step = F.when(left <= 0, F.lit(0.0)).otherwise(2 * left / (F.col("w0") + root))
    position = F.round(F.least(F.lit(1.0), F.col("t0") + step), 9)
    return placed.select("doc_id", "source", "epoch", "tokens", position.alias("position")).orderBy("position", "doc_id", "epoch")


def mix(docs: DataFrame, alphas=ALPHAS, seed: str = SEED) -> DataFrame:
    """Training positions of all documents under the annealed schedule; see positions().

    A null source counts as ''. A null or empty text has 1 token. Rows without
    doc_id get no position; rows that repeat one are each placed. An empty
    table gives no rows. Texts of any length are weighed whole. Columns besides
    doc_id, source and text aren't read.
    """
    return positions(lengths(docs, seed), lambda totals: annealed(totals, alphas))


def curriculum(docs: DataFrame, alphas=ALPHAS, seed: str = SEED) -> DataFrame:
    """docs mixed to the annealed schedule's target weights: range-sorted by position, a row once for each epoch in
    which it is trained on, so that every row comes at least once and rows of sources that are asked for more than
    they have come again.

    Rows without doc_id come once, last. Rows that repeat a doc_id are placed
    as one document, that of the least source, then the fewest tokens, and
    each comes at its positions. A null source counts as ''; null and empty
    texts have 1 token; texts of any length are weighed whole. An empty table
    gives no rows. Columns besides doc_id, source and text may have any names.
    """
    own, place, epoch = (unused(docs, c) for c in ("__id", "__position", "__epoch"))
    rows = lengths(docs, seed).groupBy("doc_id", "key").agg(F.min(F.struct("source", "tokens")).alias("d")).select("doc_id", "d.source", "d.tokens", "key")
    placed = positions(rows, lambda totals: annealed(totals, alphas)).select(F.col("doc_id").alias(own), F.col("position").alias(place), F.col("epoch").alias(epoch))
    rows = docs.join(placed, F.col("doc_id").cast("long") == F.col(own), "left")
    return rows.orderBy(F.asc_nulls_last(place), "doc_id", epoch).select(*[named(c) for c in docs.columns])


SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS source, greatest(1, ceil(length(coalesce(text, '')) / 4.0))::BIGINT AS tokens,
    md5('{SEED}:' || doc_id::VARCHAR) AS key
  FROM documents WHERE doc_id IS NOT NULL
), run_sum AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id, tokens ROWS UNBOUNDED PRECEDING)::DOUBLE AS upto FROM base
), totals AS (
  SELECT source, sum(tokens)::DOUBLE AS size FROM base GROUP BY source
), knots(t, a) AS (VALUES {", ".join(f"({t}::DOUBLE, {a}::DOUBLE)" for t, a in ALPHAS)}
), shares AS (
  SELECT source, t, pow(size, a) / sum(pow(size, a)) OVER (PARTITION BY t) AS w FROM totals, knots
), pieces AS (
  SELECT source, t AS t0, lead(t) OVER s AS t1, w AS w0, lead(w) OVER s AS w1 FROM shares WINDOW s AS (PARTITION BY source ORDER BY t)
), areas AS (
  SELECT *, (w0 + w1) / 2 * (t1 - t0) AS area FROM pieces WHERE t1 IS NOT NULL
), demands AS (
  SELECT *, sum(area) OVER (PARTITION BY source ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS d1,
    row_number() OVER (PARTITION BY source ORDER BY t0 DESC) = 1 AS is_last
  FROM areas
), need AS (
  SELECT source, size, max(d1) AS demand FROM totals JOIN demands USING (source) GROUP BY source, size
), horizon AS (
  SELECT max(size / demand) AS run FROM need
), epochs AS (
  SELECT source, size, demand, run, unnest(range(0, greatest(1, ceil(demand * run / size - 1e-9))::BIGINT)) AS epoch FROM need, horizon
), placed AS (
  SELECT doc_id, source, epoch, tokens, demand, (epoch * size + upto - tokens / 2.0) / run AS x FROM run_sum JOIN epochs USING (source)
), solved AS (
  SELECT p.*, t0, w0, x - (d1 - area) AS part, (w1 - w0) / (t1 - t0) AS slope
  FROM placed p JOIN demands d USING (source)
  WHERE (epoch = 0 OR x < demand) AND x >= d1 - area AND (x < d1 OR is_last)
)
SELECT doc_id, source, epoch::INTEGER AS epoch, tokens,
  round(least(1.0, t0 + CASE WHEN part <= 0 THEN 0.0 ELSE 2 * part / (w0 + sqrt(greatest(0.0, w0 * w0 + 2 * slope * part))) END), 9) AS position
FROM solved
"""
