"""Quality rules as a ledger: each rule is evaluated once, its failure is a bit and its figure a column; policies and ablations read the bits.

The main path is made of built-in functions only and moves no row: one projection over the table. A policy is a mask over the
ledger, so a new policy or an ablation costs an aggregation over the bits and no second look at a text.

Defined results: a null text counts as one without words; ties and repeated rows are judged alike, each by itself; an empty table
gives an empty ledger; columns of the input that clash with the ledger's names are not read (only the id and the text are).
Windows of words are told apart by 64-bit hashes within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import WORD, let, table, text_of, words_of

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """failed: a SQL condition on the ledger's measurements, false for a text that passes."""

    name: str
    failed: str


#: The place of a rule is its bit: append rules, never move them.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("upper_case", "n_upper * 2 > n_letters"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("few_letters", "n_letters * 2 < word_chars"),
    Rule("loud_marks", "5 * n_loud > n_words"),
)
BITS = {rule.name: 1 << k for k, rule in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a text. Add versions, never change one.
POLICIES = {
    "base/1": ("few_words", "repeated_windows"),
    "web/1": tuple(BITS),
}


def mask(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def _repeat_words(windows: Column, n_words: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, from the hashes in order of place."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    twice = let(pairs, lambda s: F.array_sort(F.filter(
        F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())))
    covered = let(twice, lambda p: F.aggregate(
        F.transform(p, lambda i, k: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get(p, k + 1), F.lit(1 << 60)) - i)), F.lit(0).cast("long"), lambda a, x: a + x))
    return F.when((n_words < WINDOW) | (F.size(F.array_distinct(windows)) == F.size(windows)), F.lit(0).cast("long")).otherwise(covered)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: its id, the columns named in carry, the measurements, and failure_bits, in which bit k says that RULES[k] failed."""
    text = text_of(text_col)
    words = docs.select(id_col, *carry, text.alias("_text"), words_of(text).alias("_words"))
    size = F.size("_words")
    windows = F.when(size >= WINDOW, F.transform(F.sequence(F.lit(1), size - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD))
    parts = words.select(
        id_col, *carry, size.cast("long").alias("n_words"), F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("_lines"), windows.alias("_windows"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"), F.regexp_count("_text", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count("_text", F.lit(r"!!(?![^\x20\x09-\x0D])|\?\?(?![^\x20\x09-\x0D])")).cast("long").alias("n_loud"))
    measured = parts.select(
        id_col, *carry, "n_words", "word_chars", "n_symbols", F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_windows"), F.col("n_words")).alias("n_repeat_words"), "n_upper", "n_letters", "n_loud")
    bits = [F.when(F.expr(rule.failed), F.lit(BITS[rule.name]).cast("long")).otherwise(F.lit(0).cast("long")) for rule in RULES]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return measured.withColumn("failure_bits", out)


def kept_by(policy: str, bits: str = "failure_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: texts that fail it, texts that only it rejects (kept without the rule), and all rejected texts.

    The ledger is first summed by its bits, of which there are 2**len(RULES) patterns at most; the rest reads these few rows.
    """
    patterns = entries.groupBy("failure_bits").count()
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).cast("long").alias("bit")) for name in POLICIES[policy]])
    rows = patterns.select("failure_bits", "count", F.col("failure_bits").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("hit"), F.explode(rules).alias("r"))
    n = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0)).cast("long")
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        n(F.col("hit").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"), n(F.col("hit") == F.col("r.bit")).alias("n_rejected_by_it_alone"), n(F.col("hit") != 0).alias("n_rejected"))


def keep_clean(docs: DataFrame, policy: str = "web/1") -> DataFrame:
    """The rows of docs that the policy keeps, with their own columns."""
    whole = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_body"))
    # not filter(): the optimizer would move it below the measurements and evaluate them once for each place that names them
    kept = F.explode(F.when(kept_by(policy), F.array("_row")))
    return ledger(whole, "_id", "_body", ("_row",)).select(kept.alias("_row")).select("_row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ledger(table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~kept_by("base/1")).alias("base_failed"), kept_by("web/1").alias("kept"), "failure_bits")


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), places AS (
  SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM places) WHERE c > 1
), gaps AS (
  SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), 1000000000000) - i) AS g FROM twice
), rep AS (SELECT doc_id, sum(g) AS n FROM gaps GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(regexp_extract_all(t, '\p{Lu}')) AS BIGINT) AS n_upper, CAST(len(regexp_extract_all(t, '\p{L}')) AS BIGINT) AS n_letters,
    CAST(len(list_filter(words, lambda x: x LIKE '%!!' OR x LIKE '%??')) AS BIGINT) AS n_loud
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id
), f AS (
  SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines, n_upper, n_letters, n_loud FROM m
), b AS (
  SELECT *, CAST(
    (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN n_upper * 2 > n_letters THEN 16 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN n_letters * 2 < word_chars THEN 64 ELSE 0 END) + (CASE WHEN 5 * n_loud > n_words THEN 128 ELSE 0 END) AS BIGINT) AS failure_bits FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_bits % 4 <> 0 AS base_failed, failure_bits = 0 AS kept, failure_bits FROM b
"""
