"""Line dedup: range-partitioned line hashes, sorted by document and place, whose first occurrences decide; the outcome is a keep bitmap for each document.

Only 128 bits of a line's key, the document's id and the lines' places are moved, never text. A document's repeats of a key are one
row (its places), so a key held by a third of all documents is spread over SALTS groups: each group of (key, salt) is ranged
and sorted with the largest document first, its first row stands for it, and the few rows that stand for a key's groups are
summed to the key's number of documents and its keeper. The bitmaps are run-length coded: keep_runs holds (start, length) of
the lines that stay.

Defined results: a null or empty text is one empty line; lines shorter than min_chars stay; a key's lines all stay in the
document with the largest id, repeats included; documents with the same id count as one holder and are each cut alike; an
empty table gives an empty one; a document without an id counts as a holder and keeps all its lines; other columns of the input are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.common import SPACES, Saved, let, table, text_of

SALTS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), _UPPER, _LOWER)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2, places): a row for each document and each of its distinct keys of at least min_chars code points."""
    hashed = lambda x: let(line_key(x), lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")))
    long_enough = F.filter(
        F.transform(lines_of(text_of()), lambda x, i: F.when(F.char_length(F.btrim(x, F.lit(SPACES))) >= min_chars, F.struct(hashed(x).alias("h"), i.alias("place")))),
        lambda x: x.isNotNull())
    # sorted by hash and place, so that a key's places are a run; a run's first row takes the places of the run
    runs = let(F.array_sort(long_enough), lambda s: F.filter(
        F.transform(s, lambda x, k: F.struct(x["h"].alias("h"), x["place"].alias("place"), k.alias("k"), (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))).alias("again"))),
        lambda x: ~x["again"]).cast("array<struct<h:struct<h1:bigint,h2:bigint>,place:int,k:int,again:boolean>>"))
    both = let(F.array_sort(long_enough), lambda s: let(runs, lambda r: F.transform(r, lambda x, j: F.struct(
        x["h"]["h1"].alias("h1"), x["h"]["h2"].alias("h2"),
        F.transform(F.slice(s, x["k"] + 1, F.coalesce(F.get(r, j + 1)["k"], F.size(s)) - x["k"]), lambda y: y["place"]).alias("places")))))
    return docs.select("doc_id", F.explode(both).alias("e")).select("doc_id", "e.h1", "e.h2", "e.places")


def drops(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, dropped): the places of the lines to drop, for the documents that lose any."""
    # written first: finding the ranges' bounds reads the rows once more
    rows = Saved(line_hashes(docs, min_chars).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "hashes")
    ranged = rows.df.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", F.desc("doc_id"))
    group = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc("doc_id"))
    first = F.row_number().over(group) == 1
    before = F.lag("doc_id").over(group)
    streamed = ranged.select("doc_id", "h1", "h2", "places", "salt", F.when(first, F.col("doc_id")).alias("_first"), (before.isNull() | (before != F.col("doc_id"))).cast("long").alias("_new"))
    kept = Saved(streamed, "lines")
    rows.drop()
    local = kept.df.groupBy("h1", "h2", "salt").agg(F.max("_first").alias("doc_id"), F.sum("_new").alias("n"))
    keys = local.groupBy("h1", "h2").agg(F.max("doc_id").alias("keeper"), F.sum("n").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    # the keys meet the groups, of which a key has SALTS at most; the rows meet their groups, so that no task has all rows of a key
    groups = local.select("h1", "h2", "salt").join(keys, ["h1", "h2"])
    return kept.df.join(groups, ["h1", "h2", "salt"]).filter("doc_id <> keeper").groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("dropped"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, dropped, keep_runs) of the documents that lose lines; keep_runs covers the lines up to the last one dropped, all later ones stay."""
    d = drops(docs, min_chars, min_docs)
    runs = F.filter(F.transform("dropped", lambda p, i: let(F.coalesce(F.get("dropped", i - 1), F.lit(-1)) + 1, lambda s: F.struct(s.alias("start"), (p - s).alias("length")))), lambda r: r["length"] > 0)
    return d.select("doc_id", F.size("dropped").cast("long").alias("n_dropped"), runs.alias("keep_runs"), F.array_max("dropped").alias("last"))


def cut(lines: Column, runs: Column, last: Column) -> Column:
    """The lines that a bitmap keeps, in time linear in them."""
    rest = F.slice(lines, last + 2, F.greatest(F.size(lines) - last - 1, F.lit(0)))
    return F.concat(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"] + 1, r["length"]))), rest)


def with_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with _dropped (long) and _lines, those that stay, after the joined bitmaps; a null text becomes one empty line."""
    maps = keep_bitmaps(docs, min_chars, min_docs).withColumnRenamed("doc_id", "_holder").withColumnRenamed("n_dropped", "_dropped")
    joined = docs.join(maps.hint("shuffle_hash"), docs["doc_id"] == F.col("_holder"), "left")
    lines = lines_of(text_of())
    return joined.withColumn("_lines", F.when(F.col("_dropped").isNull(), lines).otherwise(let(lines, lambda x: cut(x, F.col("keep_runs"), F.col("last"))))).withColumn("_n_lines", F.size(lines).cast("long"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with their texts cut; n_chars, where there is one, follows. A null text stays null; a document that loses all its lines keeps an empty text."""
    out = with_bitmaps(docs, min_chars, min_docs)
    text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(F.array_join("_lines", "\n"))
    return out.select(*[
        text.alias(c) if c == "text" else F.when(F.col("_dropped").isNull(), docs[c]).otherwise(F.char_length(text)).cast(t).alias(c) if c == "n_chars" else docs[c]
        for c, t in docs.dtypes])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_bitmaps(docs).select(
        docs["doc_id"], F.col("_n_lines").alias("n_lines"), F.coalesce("_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("_lines", "\n"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), hot AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT k.doc_id, i, line, hot.key IS NOT NULL AND hot.keeper <> k.doc_id AS gone FROM k LEFT JOIN hot ON hot.key = k.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
