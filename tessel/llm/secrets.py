"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams of the folded text (see trigrams.py). One scan writes postings,
(trigram, doc_id), for the trigrams that the rules ask for. Postings are intersected within each conjunction by counting, which
leaves the documents that can match a rule; a second scan verifies the rule there with its expression. Rules without a mandatory
trigram scan all texts. Candidates are broadcast only up to BROADCAST_IDS of them, joined by shuffle beyond.

Defined results: a null text is an empty one and has no spans; a span's ends are code points; documents that share an id are
candidates together and verified each; an empty table gives an empty one; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import Saved, joined_spans, regex_spans, table, text_of
from tessel.llm.trigrams import ALL, query

BROADCAST_IDS = 500_000


@dataclass(frozen=True)
class Rule:
    """java: the expression that finds matches; plain: the expression for the analysis, without what looks around it."""

    kind: str
    java: str
    plain: str
    keep: Callable[[Column], Column] | None = None


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _same(kind: str, pattern: str) -> Rule:
    return Rule(kind, pattern, pattern)


#: The base rules in the order of their kinds.
BASE = (
    Rule("assign", _ASSIGN, _ASSIGN, lambda v: F.char_length(F.regexp_extract(v, _ASSIGN, 1)) >= 8),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]+", lambda v: F.char_length(v) >= 16),
    # runs under 32 characters would be dropped: the expression says so itself
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+", r"[0-9a-f]+"),
)
_JWT = r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"
#: Published formats of keys that the base does not know.
ADDED = (
    _same("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    _same("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    _same("google", r"AIza[0-9A-Za-z_-]{35}"),
    _same("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    # begins a run of its characters, so that a long run is not tried from each of its places
    Rule("jwt", rf"(?<![A-Za-z0-9_-]){_JWT}", _JWT),
    _same("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + ADDED


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(trigram, doc_id) for the wanted trigrams that a folded text holds; a trigram and a document make one row."""
    folded = docs.select("doc_id", F.lower(text_of()).alias("_folded"))
    held = F.array(*[F.when(F.contains("_folded", F.lit(t)), F.lit(t)) for t in wanted])
    return folded.select("doc_id", F.explode(F.array_compact(held)).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): the rules whose query the postings of a document satisfy. The clauses come from the rules, so their broadcast is as small as they are."""
    clauses = [(r.kind, f"{r.kind}/{k}", t, len(clause)) for r in rules for k, clause in enumerate(sorted(map(sorted, query(r.plain)))) for t in clause]
    asked = F.broadcast(index.sparkSession.createDataFrame(clauses, "kind string, clause string, trigram string, needed int"))
    met = index.join(asked, "trigram").groupBy("doc_id", "kind", "clause").agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed")).filter("n >= needed")
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found): all spans of a document as an array of (start, rank, end, kind, value); rank is the rule's place."""
    indexed = tuple(r for r in rules if query(r.plain) != ALL)
    docs = docs.select("doc_id", "text")
    wanted = sorted({t for r in indexed for clause in query(r.plain) for t in clause})
    index = Saved(postings(docs, wanted), "postings")
    held = Saved(candidates(index.df, indexed).withColumnRenamed("doc_id", "_id"), "candidates").df
    small = held.count() <= BROADCAST_IDS
    marked = docs.join(F.broadcast(held) if small else held.hint("shuffle_hash"), F.equal_null("doc_id", "_id"), "left").select("doc_id", text_of().alias("_text"), "kinds")

    def spans(rank: int, rule: Rule) -> Column:
        test = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) if rule in indexed else None
        found = regex_spans(F.col("_text"), rule.java, rule.keep, test)
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(rule.kind).alias("kind"), s["value"].alias("value")))

    index.drop()
    return marked.select("doc_id", F.concat(*[spans(k, r) for k, r in enumerate(rules)]).alias("found"))


def _count(rank: int) -> Column:
    return F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id", *[_count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("found")).alias("spans"))


def _sql() -> str:
    """The same spans by splitting and extracting in SQL; its engine has neither lookbehind nor possessive repeats. A jwt that continues a run is dropped by what stands before it."""
    parts, keep = [], {"assign": "length(regexp_extract(m, '{p}', 1)) >= 8", "access": "length(m) >= 16", "jwt": "NOT regexp_matches(b, '[A-Za-z0-9_-]$')"}
    for rank, rule in enumerate(RULES):
        pattern = {"hex": "[0-9a-f]{32,}", "jwt": _JWT.replace("}+", "}")}.get(rule.kind, rule.plain).replace("'", "''")
        parts.append(f"SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, i, b, m, {keep.get(rule.kind, 'true').format(p=pattern) if rule.kind != 'assign' else keep['assign'].replace('{p}', pattern)} AS ok FROM "
                     f"(SELECT doc_id, unnest(f) AS m, unnest(s[1:len(f)]) AS b, generate_subscripts(f, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS f, string_split_regex(t, '{pattern}') AS s FROM d))")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS ({' UNION ALL '.join(parts)}),
x AS (SELECT doc_id, rank, kind, ok, sum(length(b) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop, length(m) AS n FROM p),
s AS (SELECT doc_id, rank, kind, CAST(stop - n AS BIGINT) AS start, kind || ':' || CAST(stop - n AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM x WHERE ok)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


SQL = _sql()
