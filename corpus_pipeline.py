"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, and tokens. Each stage reads all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import bpe, line_dedup, mixing, near_dedup, quality_rules
from tessel.llm.common import Saved, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold go from all of them but the last."""
    return line_dedup.drop_repeated_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, a similarity of 0.8 or more."""
    return near_dedup.keep_one_of_each(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip."""
    return bpe.digests(docs, bpe.default_vocabulary(spark))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near), ("mixing", mix), ("byte_bpe", tokens)]

#: Near-dedup by shingles is no SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written as Parquet and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = Saved(docs, f"stage-{name}").df
    return docs
