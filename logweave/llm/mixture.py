"""Mixing sources to target weights by repeating documents.

Sizes are words.  The sources, in code point order with null last, weigh ``weights``
in turn, and together they shall give as many words as there are.  A source gives at
most ``most`` times its words; what it cannot give is shared by weight among
the rest, again and again until none is above its limit.  That fixed point is a level of
words a unit of weight: a source gives ``least(most * its words, level * its weight)``.  The
level is kept as a fraction of whole numbers, so no rounding decides who is limited.

A source's rate is its target over its words.  Each document comes ``floor(rate)``
times, and once more when a number in [0, 1) drawn from a digest of the seed and its id is below
the rest of the rate.  So reruns, other partitions and lost executors draw the same.

Odd rows: a null or empty text has size 0 and is repeated like others; null ids draw as the
word ``null``; rows of one id draw alike; a source of no words has target 0 and takes no copy.  An empty table gives
no rows.  Columns with the names used here are kept as they are: the caller's row travels as one struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.llm.common import written
from logweave.llm.totals import attach, group_key

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mixture"


def sized(docs: DataFrame, text_col: str = "text", source_col: str = "source", keep: Sequence[str] | None = None) -> DataFrame:
    """(doc, source, skey, size): the caller's row (or its columns ``keep``) as a struct, its source and its words."""
    kept = F.struct(*[F.col(f"`{c}`") for c in (keep if keep is not None else docs.columns)])
    return docs.select(kept.alias("doc"), F.col(source_col).cast("string").alias("source"), group_key(source_col).alias("skey"),
                       F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def sources(rows: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(skey, documents, source_size, weight) of every source; written once, as the rounds below read it again.

    Places in the order come from a range partitioning and the counts of its parts, so no task sorts all sources.
    """
    found = rows.groupBy("skey").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("documents"), F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    dealt = written(found.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mixture-sources")
    # One row a partition of the shuffle.
    before = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    return written(dealt.withColumn("in_part", place).join(F.broadcast(before), "part").withColumn("place", F.col("in_part") + F.col("before"))
                   .select("skey", "documents", "source_size", weight.alias("weight")), "mixture-weights")


def level(table: DataFrame, most: int = MOST) -> tuple[int, int]:
    """Words a unit of weight, as (words, weight): each round takes out the sources that the last level would put
    above their limit.  The level only rises and each round but the last limits a further source, so the rounds end."""
    row = table.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weight = row[0] or 0, row[1] or 1
    now = (total, weight)
    while True:
        limited = table.where(_above(now, most)).agg(F.sum("source_size"), F.sum("weight")).first()
        then = (total - most * (limited[0] or 0), weight - (limited[1] or 0))
        if then == now:
            return now
        now = then


def _above(at: tuple[int, int], most: int):
    words, weight = at
    exact = "decimal(38,0)"
    return F.expr(f"cast(source_size as decimal(20,0)) * cast({most * weight} as decimal(17,0)) < cast(cast({words} as decimal(20,0)) * weight as {exact})")


def targets(table: DataFrame, at: tuple[int, int], most: int = MOST) -> DataFrame:
    """``table`` with ``target``, the words that its source gives."""
    words, weight = at
    share = F.expr(f"cast({words}L * weight as double) / {weight}D")
    return table.withColumn("target", F.when(_above(at, most), (F.col("source_size") * most).cast("double")).otherwise(share))


def copies(rows: DataFrame, id_col: str = "doc_id", weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``sized`` rows with source_size, target and ``copies``, the number of times that the mix holds the document."""
    table = sources(rows, weights)
    dealt = attach(rows, targets(table, level(table, most), most), "skey", "documents")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"doc.`{id_col}`").cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return dealt.withColumn("rate", rate) \
        .withColumn("copies", (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    dealt = copies(sized(docs, text_col, source_col), id_col, weights, most, seed)
    return dealt.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, size, source_size, target (of its source), taken (its words in the mix) and copies.
    Texts are read once; ids, sources and sizes are written for the two passes over them."""
    rows = written(sized(docs, keep=["doc_id"]), "mixture-sizes")
    return copies(rows).select(F.col("doc.doc_id").cast("long").alias("doc_id"), "size", "source_size", "target",
                               (F.col("size") * F.col("copies")).alias("taken"), "copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::HUGEINT AS words, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
-- Sources by words a unit of weight: those in front of the first that stays within three times its words are limited.
r AS (
  SELECT *, row_number() OVER o AS k, sum(words) OVER () - 3 * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM s WINDOW o AS (ORDER BY words / weight::DOUBLE, weight, source IS NULL, source)),
free AS (SELECT words_left, weight_left FROM r WHERE 3 * words * weight_left >= words_left * weight ORDER BY k LIMIT 1),
t AS (
  SELECT source, words::BIGINT AS source_size,
    CASE WHEN 3 * words * free.weight_left < free.words_left * weight THEN (3 * words)::DOUBLE
      ELSE (free.words_left * weight)::DOUBLE / free.weight_left::DOUBLE END AS target
  FROM r, free),
c AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mixture:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (draw < rate - floor(rate))::INT))::BIGINT AS taken,
  (floor(rate) + (draw < rate - floor(rate))::INT)::BIGINT AS copies
FROM c
"""
