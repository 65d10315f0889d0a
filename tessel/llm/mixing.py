"""Mixing sources to target weights: hash-random keys, ranges sorted within each source, distributed prefix sums, and a cut at each source's budget.

A source's documents are put in the order of a seeded hash. The order is cut in ranges of the hash, as many as the source's rows
ask for (their square root), so that a source with a third of all rows is many ranges. Prefix sums run within a range; the
ranges' totals give their offsets. A budget above the source's size repeats whole epochs first. Every source ends with the
whole document that comes nearest to its budget: the document across the cut is taken if at least half of it lies before the cut.

Defined results: a null text has size 0; rows without an id are taken alike, as one id is; a null source is a source of its own and comes last; ties of the hash fall to the id;
repeated rows count each; an empty table gives an empty one; if all sizes are 0, targets are 0. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.common import Saved, n_words_of, table, text_of

SEED = 7
KEY_BITS = 60


def random_key(id_col: str, seed: int) -> Column:
    """A seeded hash of the id as a number of KEY_BITS bits, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, cap: int = 2) -> DataFrame:
    """(source, source_size, n_rows, target) from (source, size): shares of percent % of all sizes by weight, none above cap times its source's size.

    What a capped source leaves goes to the others by weight until none is above: the sources with the least size for their weight
    are capped first, so a running sum in that order finds the level. It reads one row for each source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    place = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weighed = by.withColumn("_weight", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1))
    every = Window.partitionBy()
    level = Window.partitionBy().orderBy((F.col("source_size") / F.col("_weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    # all sums are whole numbers, in hundredths of a word where percent enters
    sums = weighed.withColumn("_left", percent * F.sum("source_size").over(every) - 100 * cap * F.coalesce(F.sum("source_size").over(level), zero)).withColumn(
        "_weights", F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(level), zero))
    # a source is capped if, with all before it capped, its share is above its cap
    held = sums.withColumn("_capped", F.col("_left") * F.col("_weight") >= 100 * cap * F.col("source_size") * F.col("_weights"))
    rest = F.struct((percent * F.sum("source_size").over(every) - 100 * cap * F.sum(F.when(F.col("_capped"), F.col("source_size")).otherwise(zero)).over(every)).alias("left"),
                    F.sum(F.when(F.col("_capped"), zero).otherwise(F.col("_weight"))).over(every).alias("weights"))
    return held.withColumn("_rest", rest).select(
        "source", "source_size", "n_rows",
        F.when(F.col("_capped"), (cap * F.col("source_size")).cast("double")).otherwise((F.col("_rest.left") * F.col("_weight")).cast("double") / (100 * F.col("_rest.weights")).cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, cap: int = 2, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken): how often each document is taken, and the words that makes."""
    sized = Saved(docs.select("doc_id", "source", n_words_of(text_of()).alias("size"), random_key("doc_id", seed).alias("_key")), "sizes").df
    goal = targets(sized, weights, percent, cap)
    # a range is the key's top bits: about as many ranges as rows in each, so that neither a range nor the list of ranges is long
    bits = F.ceil(F.log2("n_rows") / 2).cast("int")
    aimed = sized.join(goal.withColumn("_bits", bits).withColumnRenamed("source", "_s"), F.equal_null("source", "_s"), "inner").select(
        "doc_id", "source", "size", "_key", "source_size", "target",
        F.when(F.col("_bits") > 0, F.expr(f"shiftright(_key, {KEY_BITS} - _bits)")).otherwise(F.lit(0).cast("long")).alias("_range"))
    ranged = aimed.repartitionByRange("source", "_range").sortWithinPartitions("source", "_range", "_key", "doc_id")
    within = Window.partitionBy("source", "_range").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long")))
    totals = aimed.groupBy("source", "_range").agg(F.sum("size").alias("_total"))
    offsets = totals.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_total").over(
        Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("_offset"))
    placed = local.join(offsets, F.equal_null("source", "_s") & (F.col("_range") == F.col("_r")))
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    left = F.col("target") - F.col("_whole") * F.col("source_size")
    # half of the document or more lies before the cut; where nothing is left, nothing is taken
    extra = ((F.col("_left") > 0) & (F.col("_offset") + F.col("_before") + F.col("size") / 2 <= F.col("_left"))).cast("long")
    return placed.withColumn("_whole", whole).withColumn("_left", left).withColumn("epochs", F.col("_whole") + extra).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it, 0 to 2 times. Rows that share a doc_id are taken alike, as often as the one taken most."""
    epochs = mix(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.max("epochs").alias("_epochs"))
    return docs.join(epochs.filter("_epochs > 0").hint("shuffle_hash"), F.equal_null(docs["doc_id"], F.col("_id"))).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_epochs")))).select(*[docs[c] for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('7:' || doc_id), 1, 15) AS BIGINT) AS key FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source
), w AS (SELECT source, n, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s
), lv AS (
  SELECT *, 150 * sum(n) OVER () - 200 * coalesce(sum(n) OVER o, 0) AS lft, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS ws FROM w
  WINDOW o AS (ORDER BY CAST(n AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, lft * w >= 200 * n * ws AS capped FROM lv
), t AS (
  SELECT source, n, CASE WHEN capped THEN CAST(2 * n AS DOUBLE) ELSE
    CAST((150 * sum(n) OVER () - 200 * coalesce(sum(n) FILTER (WHERE capped) OVER (), 0)) * w AS DOUBLE) / CAST(100 * sum(w) FILTER (WHERE NOT capped) OVER () AS DOUBLE) END AS target FROM c
), p AS (
  SELECT doc_id, size, n AS source_size, target, floor(target / greatest(n, 1)) AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN target - whole * source_size > 0 AND before + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM p
"""
