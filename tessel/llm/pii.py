"""PII by bootstrapped contextual extraction: seed entities induce lexical patterns, patterns and instances score each other over a graph, and patterns of high confidence discover identifiers that no expression knows.

Seeds are the matches of fixed expressions. A candidate is a word with a digit or an @, or a run of groups of digits. The patterns of either
are the words around it, in lower case and without punctuation at their ends: the word on the left, the two on the left, the word on the
right, those on both sides, and the word on the left with the value's shape (runs of letters and of digits, and what parts them).
Patterns and values (the instances) make a bipartite graph. An instance is known for a kind if it holds a
seed of it, or if its form fits the kind and a sure pattern has it. A pattern's confidence is the number of its distinct instances that are
known over that of all plus PRIOR, so that a pattern with few instances is never sure; an instance scores as its surest pattern. A pattern is
sure with MIN_SEEDS known instances, seeds or discovered, and a confidence of MIN_CONFIDENCE. Rounds score the whole graph anew until none makes
another instance known, so discovered identifiers make further patterns sure. What is not known yet lends a pattern nothing: patterns
around the same words would lift each other. Sure patterns discover: a candidate of theirs that no seed covers and whose form fits the
kind becomes a span.

One scan of the texts gives seeds and candidates; all that follows reads rows of documents that hold a digit or an @.

Defined results: a null text is an empty one and has no spans; ends are code points; a failing match is dropped and not retried;
documents that share an id share what patterns discover in one of them; an empty table gives an empty one; only the id and
the text are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import EDGES, Saved, bare, dealt_join, joined_spans, let, prefix_scan, regex_spans, table, text_of

PRIOR = 2
MIN_SEEDS = 8
MIN_CONFIDENCE = 0.8


@dataclass(frozen=True)
class Kind:
    """pattern, keep: the seeds; test: what a text with a seed holds; form: what a discovered value must look like."""

    name: str
    pattern: str
    keep: Callable[[Column], Column] | None
    test: Callable[[Column], Column]
    form: str


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """14 to 19 digits whose Luhn sum is a multiple of ten."""
    def valid(d: Column) -> Column:
        one = lambda i: F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        parts = F.transform(F.sequence(F.lit(0), F.length(d) - 1), lambda i: F.when(i % 2 == 1, twice(one(i))).otherwise(one(i)))
        return F.when(F.length(d).between(14, 19), F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(F.lit(False))

    return let(_digits(value), valid)


_LOCAL, _PART = "A-Za-z0-9._%+-", r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# A match starts at the begin of a run of its first class or where the last match ended; possessive repeats find the same
# matches as greedy ones here, since no class holds what follows it, and cannot backtrack.
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, lambda t: F.contains(t, F.lit("@")), r"^[^@]+@[^@]+$"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), lambda t: t.rlike(r"[0-9]\.[0-9]"), r"^[0-9A-Fa-f]{1,4}(?:[:.][0-9A-Fa-f]{0,4}){3,7}$"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _luhn, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), r"^[0-9](?:[ -]?[0-9]){13,18}$"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.length(_digits(v)).between(10, 15), lambda t: F.contains(t, F.lit("+")), r"^\+?\(?[0-9][0-9(). -]{5,18}[0-9]$"),
)
_SPACE, _GROUP = r"\x20\x09-\x0D", r"[(+]?+[0-9][0-9().-]*+"
_CANDIDATE = rf"(?<![^{_SPACE}])(?:{_GROUP}(?:\x20{_GROUP})++[,;:!?]*+(?![^{_SPACE}])|[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+)"


def patterns(left: Column, right: Column, value: Column) -> Column:
    """The patterns of an occurrence as an array of strings; none for a side without a word."""
    near = F.substring_index(left, " ", -1)
    shape = F.regexp_replace(F.regexp_replace(F.lower(value), "[a-z]+", "a"), "[0-9]+", "9")
    has_left, has_right = near != "", right != ""
    return F.array_compact(F.array(
        F.when(has_left, F.concat(F.lit("left "), near)),
        F.when(has_left & left.rlike("^[^ ]+ "), F.concat(F.lit("two left "), left)),
        F.when(has_right, F.concat(F.lit("right "), right)),
        F.when(has_left & has_right, F.concat(F.lit("both "), near, F.lit(" "), right)),
        F.when(has_left, F.concat(F.lit("shape "), near, F.lit(" "), shape))))


def seeds_and_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, seen): base holds the seeds as (start, rank, end, kind); seen holds (start, end, value, left, right, rank) of the seeds and, with a null rank, of the candidates that no seed touches."""
    texts = docs.select("doc_id", text_of().alias("_text"))
    text = F.col("_text")
    spans = [F.transform(regex_spans(text, k.pattern, k.keep, k.test(text), context=True), _ranked(rank)) for rank, k in enumerate(KINDS)]
    found = texts.select("doc_id", F.concat(*spans).alias("_seeds"), regex_spans(text, _CANDIDATE, None, text.rlike("[0-9@]"), context=True).alias("_candidates"))
    free = F.when(F.size("_seeds") == 0, F.col("_candidates")).otherwise(_untouched(F.col("_candidates"), F.col("_seeds")))
    # a span leaves out the punctuation at a word's ends
    lead = lambda c: (F.char_length(c["value"]) - F.char_length(F.ltrim(c["value"], F.lit(EDGES)))).cast("long")
    trail = lambda c: (F.char_length(c["value"]) - F.char_length(F.rtrim(c["value"], F.lit(EDGES)))).cast("long")
    unknown = F.transform(free, lambda c: F.struct((c["start"] + lead(c)).alias("start"), (c["end"] - trail(c)).alias("end"), bare(c["value"]).alias("value"), c["left"].alias("left"), c["right"].alias("right"), F.lit(None).cast("int").alias("rank")))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    base = F.transform("_seeds", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.element_at(names, s["rank"] + 1).alias("kind")))
    return found.select("doc_id", base.alias("base"), F.concat("_seeds", unknown).alias("seen"))


def _untouched(candidates: Column, seeds: Column) -> Column:
    """The candidates that overlap no seed. Candidates are disjoint, so only seeds that start before one and the next start after it matter."""
    event = lambda x, i: F.struct(x["start"].alias("start"), (i >= 0).alias("later"), i.alias("i"), x["end"].alias("end"))
    events = F.array_sort(F.concat(F.transform(seeds, lambda s: event(s, F.lit(-1))), F.transform(candidates, lambda c, i: event(c, i))))
    reach = lambda ev: prefix_scan(F.transform(ev, lambda e: F.when(e["i"] < 0, e["end"]).otherwise(F.lit(0).cast("long"))), lambda a, x: F.greatest(a, x))
    clear = lambda ev, e, k, r: (e["i"] >= 0) & (F.get(r, k) <= e["start"]) & ~F.coalesce((F.get(ev, k + 1)["i"] < 0) & (F.get(ev, k + 1)["start"] < e["end"]), F.lit(False))
    return let(events, lambda ev: let(reach(ev), lambda r: F.transform(F.filter(ev, lambda e, k: clear(ev, e, k, r)), lambda e: F.get(candidates, e["i"]))))


def _ranked(rank: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["left"].alias("left"), s["right"].alias("right"), F.lit(rank).alias("rank"))


def score_patterns(occurrences: DataFrame) -> DataFrame:
    """(pattern, rank, confidence, n_known, n_instances) of the sure patterns, from occurrences (pattern, value, rank or null).

    Each round joins the graph's distinct edges with what is known and sums by pattern, which combines before the shuffle; a frequent
    pattern's edges are dealt. Known instances only become more, so the rounds end at the least fixed point.
    """
    edges = occurrences.groupBy("pattern", "value").agg(F.max("rank").alias("seed"))
    graph = Saved(edges, "pii-graph").df
    size = Saved(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_instances")), "pii-sizes").df
    known = Saved(graph.filter("seed is not null").select("value", F.col("seed").alias("rank")).distinct(), "pii-known")
    # a value that is a seed somewhere has its kind
    free = graph.join(known.df.select("value").distinct(), "value", "left_anti").select("pattern", "value")
    forms = F.filter(F.array(*[F.when(F.col("value").rlike(k.form), F.lit(r)) for r, k in enumerate(KINDS)]), lambda r: r.isNotNull())
    unknown = Saved(free.select("pattern", "value", F.explode(forms).alias("rank")), "pii-unknown").df
    while True:
        held = graph.join(known.df, "value").groupBy("pattern", "rank").agg(F.count(F.lit(1)).alias("n_known")).filter(F.col("n_known") >= MIN_SEEDS)
        scored = held.join(size, "pattern").withColumn("confidence", F.col("n_known") / (F.col("n_instances") + PRIOR))
        sure = Saved(scored.filter(F.col("confidence") >= MIN_CONFIDENCE).select("pattern", "rank", "confidence", "n_known", "n_instances"), "pii-patterns")
        fresh = Saved(dealt_join(unknown, ["pattern", "rank"], sure.df.select("pattern", "rank"), "value").select("value", "rank").distinct().join(known.df, ["value", "rank"], "left_anti"), "pii-fresh")
        if not fresh.df.head(1):
            return sure.df
        more = Saved(known.df.unionByName(fresh.df), "pii-known")
        for x in (known, sure, fresh):
            x.drop()
        known = more


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): spans as (start, rank, end, kind); added ones are what patterns discover, beside the base."""
    scanned = Saved(seeds_and_candidates(docs), "pii-spans").df
    seen = scanned.filter(F.size("seen") > 0).select("doc_id", F.explode("seen").alias("c")).select("doc_id", "c.*")
    rows = Saved(seen.select("doc_id", "start", "end", "value", "rank", F.explode(patterns(F.col("left"), F.col("right"), F.col("value"))).alias("pattern")), "pii-rows").df
    sure = score_patterns(rows.select("pattern", "value", "rank"))
    fits = F.coalesce(*[F.when(F.col("_rank") == r, F.col("value").rlike(k.form)) for r, k in enumerate(KINDS)])
    names = F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("_rank") + 1)
    hits = dealt_join(rows.filter("rank is null").drop("rank"), ["pattern"], sure.select("pattern", F.col("rank").alias("_rank"), "confidence"), "doc_id").filter(fits)
    best = hits.groupBy("doc_id", "start", "end").agg(F.max_by(F.struct(F.col("_rank").alias("rank"), names.alias("kind")), F.struct("confidence", -F.col("_rank"))).alias("k"))
    added = best.groupBy("doc_id").agg(F.collect_list(F.struct("start", F.col("k.rank").alias("rank"), "end", F.col("k.kind").alias("kind"))).alias("added"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return scanned.select("doc_id", "base").join(added.withColumnRenamed("doc_id", "_id"), F.equal_null("doc_id", "_id"), "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[_count(r).alias(f"n_{k.name}") for r, k in enumerate(KINDS)],
                        F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.concat("base", "added")).alias("spans"))


def _count(rank: int) -> Column:
    return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")


