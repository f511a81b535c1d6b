"""Mixing sources to target weights by exponential keys (Efraimidis-Spirakis), DataFrame only.

Every document draws the key ``-ln(u) / w`` with ``u`` from a hash of its id and ``w`` its
quality weight; in the order of the keys a prefix of a source is a sample without replacement
with those weights. A source's target in words is met by as many complete epochs as fit, then
by the documents first in key order up to the rest; the last of them is cut at the budget.

The running sums do not need a source in one task: keys are dealt to ranges of a few thousand
documents by a monotone map of the key, ranges are summed first, and only a range is sorted.

Defined cases: null text has no words; a null source is a source of its own, last in order; a
source without words has target 0; repeated rows count as often as they appear; an empty table
gives an empty result. Columns other than id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, letters, store, text_of, unit_hash

#: Documents in a range of keys, about.
RANGE_ROWS = 4096


def quality_weight(text: Column) -> Column:
    """Sampling weight of a text: its share of letters and blanks, 0.1 at least."""
    return F.lit(0.1) + F.lit(0.9) * letters(text)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Targets of the sources in ``sizes`` (source, source_size): the common level ``v`` for
    which the sum of ``min(cap * size, v * weight)`` is the words asked for.

    This is where resharing the excess by weight ends. Sorted by ``cap * size / weight`` the
    capped sources come first, so ``v`` is the first level that does not exceed its own ratio.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = (sizes
         .withColumn("nr", F.row_number().over(by_name))
         .withColumn("weight", F.element_at(w, ((F.col("nr") - 1) % len(weights) + 1).cast("int")))
         .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
         .withColumn("ratio", F.col("most") / F.col("weight"))
         .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything)))
    before = Window.orderBy("ratio", "nr").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "nr").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = (t.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                      / F.sum("weight").over(after)))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nr", "level"))).over(everything)["level"]
    return t.withColumn("target", F.least(F.col("most"), F.coalesce(level, F.col("ratio")) * F.col("weight"))).select(
        "source", "source_size", "n_docs", "mean_weight", "target")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, cap: float = 3.0,
        seed: str = "mix", weight: Column | None = None) -> DataFrame:
    """Words each document gives to the mix.

    ``weights`` go to the sources in code point order, repeating; ``share`` of all words is
    dealt out; a source gives at most ``cap`` times its words. ``weight`` is the sampling
    weight of a document (positive), by default :func:`quality_weight`.

    Returns doc_id, source, size, source_size, target, epochs (complete ones) and taken.
    """
    weight = quality_weight(text_of()) if weight is None else weight
    base = store(docs.select(
        "doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        (-F.log(unit_hash(F.col("doc_id"), seed)) / weight).alias("key"), weight.alias("weight")), "mix-base")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"),
                                       F.avg("weight").alias("mean_weight"))
    targets = store(source_targets(sizes, weights, share, cap), "mix-targets")

    ranges = F.ceil(F.col("n_docs") / RANGE_ROWS)
    keyed = (base.drop("weight").withColumnRenamed("source", "of").join(targets, F.col("of").eqNullSafe(F.col("source")))
             .drop("of")
             .withColumn("range", F.floor((1 - F.exp(-F.col("key") * F.col("mean_weight"))) * ranges))
             .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
             .withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
             .drop("n_docs", "mean_weight"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = (keyed.groupBy("source", "range").agg(F.sum("size").alias("words"))
            .select(F.col("source").alias("of"), F.col("range").alias("at"),
                    F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words_before")))
    here = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (keyed.withColumn("upto", F.sum("size").over(here))
            .join(sums, F.col("of").eqNullSafe(F.col("source")) & (F.col("at") == F.col("range")))
            .withColumn("start", F.col("words_before") + F.col("upto") - F.col("size"))
            .select("doc_id", "source", "size", "source_size", "target", F.col("epochs").cast("int").alias("epochs"),
                    (F.col("epochs") * F.col("size")
                     + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))).cast("long").alias("taken")))


#: The same in DuckDB's SQL, with the query's parameters: one running sum over each source.
SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    0.1 + 0.9 * (CASE WHEN length(coalesce(text, '')) > 0
      THEN length(regexp_replace(text, '[^\p{L} \n]+', '', 'g')) / length(text) ELSE 0.0 END) AS weight,
    (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS weight,
    row_number() OVER (ORDER BY source ASC NULLS LAST) AS nr
  FROM base GROUP BY source),
lvl AS (
  SELECT *, 3.0 * source_size AS most, 3.0 * source_size / weight AS ratio, sum(source_size) OVER ()::DOUBLE AS total FROM src),
lvl2 AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY ratio, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY ratio, nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM lvl),
tgt AS (
  SELECT *, least(most, weight * (SELECT level FROM lvl2 WHERE level <= ratio ORDER BY ratio, nr LIMIT 1)) AS target FROM lvl2),
run AS (
  SELECT b.doc_id, b.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    sum(b.size) OVER (PARTITION BY b.source ORDER BY -ln(b.u) / b.weight, b.doc_id, b.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - b.size AS start
  FROM base b JOIN tgt t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, epochs::INTEGER AS epochs,
  (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - start)))::BIGINT AS taken
FROM run
"""
