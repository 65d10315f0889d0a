"""MinHash near-dedup by a chosen-path set similarity join.

A text's set is its distinct word shingles, as 64-bit hashes. Texts with equal sets become one representative before anything else.
A representative's sketch is its minimum under each of COORDINATES hash functions.

Each of TREES independent trees sends a representative down the path of its sketch at one chosen coordinate. Nodes of up to
NODE representatives are compared exhaustively, by sketch. A larger one is cut in blocks of NODE, each of which is compared within
itself and with the node's LEADERS, so that a cluster of near copies is connected in rows linear in its size. What is then connected
needs no further comparison; a node stays open while it holds several parts. If up to REST rows are outside of its largest part,
they meet all its rows, in blocks; otherwise it branches on two more coordinates that its name chooses. Branching goes on as deep as
the logarithm of the largest node asks for; in what is still open there, all rows outside of the largest part meet all rows, in blocks, so that no
depth drops a pair.

Two sets of similarity s part ways in one tree with a probability of 1 - s at the first level and (1 - s)**2 at each later one: TREES
trees miss a pair at 0.8 about once in 10**5 in small nodes, once in 10**4 three levels down.

What these links connect are candidates. Each candidate's whole set is then built once, from its whole text, and links are confirmed on
full sets: a group of more than BLOCK candidates is cut in blocks that each meet LEADERS of those outside of its largest part, round after round while
these rounds connect more; then all that are left outside meet all members, again in blocks. No group is ever whole in one
task, and no link between different parts is left out.

Defined results: a text without words, or null, has an empty set and links with nothing; a text with fewer words than a
shingle has one shingle, all its words; repeated rows and ties are copies of the least id; rows that share an id are judged each by its own text; a null id is a document that no copy
can stand for; an empty table gives an empty one; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.common import Saved, dealt_join, table
from tessel.llm.graph import Stars
from tessel.llm.groups import Union, grouped

COORDINATES, TREES = 64, 8
NODE, REST = 256, 1024
BLOCK, LEADERS = 512, 8
#: A sketch of 64 agrees on fewer than 36 places for one in 10**6 pairs at a similarity of 0.8.
MARGIN = 0.24
BROADCAST_IDS = 500_000
_WORDS = 300_000
#: Tells apart texts of rows that share an id.
_BODY = "xxhash64(text)"

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= _WORDS:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of k words of a text. bytes.lower() and bytes.split() know ASCII only, as wanted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)] if words else [], np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(w) - k + 1
    h = w[:n].copy()
    for j in range(1, k):
        h *= _P1
        h ^= h >> np.uint64(29)
        h += w[j : j + n]
    h *= _P2
    h ^= h >> np.uint64(32)
    return np.unique(h)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """COORDINATES minima."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[k : k + 4096, None] * _A + _B).min(axis=0), out=least)
    return least


def features(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, body, n_shingles, c1, c2, sketch, roots): body is a hash of the text, c1 and c2 are 128 bits of the whole set, null for an empty one; sketch holds 16 bits of each minimum, roots all of those that trees start from."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, c1, c2, sketches, roots = [], [], [], [], []
            for x in batch.column("text"):
                s = shingle_set(x.as_py(), k)
                sizes.append(len(s))
                if len(s):
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    c1.append(int.from_bytes(d[:8], "little", signed=True))
                    c2.append(int.from_bytes(d[8:], "little", signed=True))
                    least = sketch(s)
                    sketches.append((least >> np.uint64(48)).astype(np.uint16).tobytes())
                    roots.append(least[:: COORDINATES // TREES].astype(np.int64))
                else:
                    c1.append(None)
                    c2.append(None)
                    sketches.append(None)
                    roots.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("body"), pa.array(sizes, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(sketches, pa.binary()), pa.array(roots, pa.list_(pa.int64()))],
                ["doc_id", "body", "n_shingles", "c1", "c2", "sketch", "roots"])

    named = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text", f"{_BODY} as body")
    return named.mapInArrow(run, "doc_id bigint, body bigint, n_shingles bigint, c1 bigint, c2 bigint, sketch binary, roots array<bigint>")


def _sketches(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(t.num_rows, COORDINATES)


def _near(i: int, rest: np.ndarray, sk: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Of the rows in rest, those that may be as similar to row i as percent says, by size and sketch."""
    a, b = sizes[i], sizes[rest]
    rest = rest[100 * np.minimum(a, b) >= percent * np.maximum(a, b)]
    return rest[(sk[rest] == sk[i]).sum(axis=1) >= (percent / 100 - MARGIN) * COORDINATES]


class _Sets:
    """The shingle sets of a group's rows, built when asked for."""

    def __init__(self, texts: pa.Array, k: int):
        self.texts, self.k, self.held = texts, k, {}
        self.rows = None

    def of(self, i: int) -> np.ndarray:
        if i not in self.held:
            self.held[i] = shingle_set(self.texts[i].as_py(), self.k)
        return self.held[i]

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many shingles row i has in common with each of others; many at once by the rows of each shingle."""
        if len(others) < 8:
            return np.array([len(np.intersect1d(self.of(i), self.of(j), assume_unique=True)) for j in others.tolist()], np.int64)
        if self.rows is None:
            sets = [self.of(j) for j in range(len(self.texts))]
            _, codes = np.unique(np.concatenate(sets), return_inverse=True)
            self.rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[np.argsort(codes, kind="stable")]
            self.start = np.r_[0, np.cumsum(np.bincount(codes))]
            self.codes = np.split(codes, np.cumsum([len(x) for x in sets])[:-1])
        first, n = self.start[self.codes[i]], np.diff(self.start)[self.codes[i]]
        at = np.arange(n.sum()) + np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n)
        return np.bincount(self.rows[at], minlength=len(self.texts))[others]


def _connect(percent: int, k: int | None = None):
    """Links that connect the parts of a group's rows, each with the least that it is connected with, by sketches, or with k on full sets. Rows of one part are connected already; only rows that ask meet the others."""
    def fn(t: pa.Table) -> list[pa.Array]:
        sizes, sk = t.column("n").to_numpy(), _sketches(t)
        parts, first, start = np.unique(t.column("part").to_numpy(), return_index=True, return_inverse=True)
        known = Union(start.astype(np.int64))
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        sets = _Sets(t.column("text").combine_chunks(), k) if k is not None else None
        waiting = np.ones(len(sizes), bool)
        for i in np.flatnonzero(asks).tolist():
            waiting[i] = False
            rest = np.flatnonzero((known.label != known.label[i]) & waiting)
            near = _near(i, rest, sk, sizes, percent) if len(rest) else rest
            if sets and len(near):
                both = sets.shared(i, near)
                near = near[100 * both >= percent * (sizes[i] + sizes[near] - both)]
            for j in near.tolist():
                known.join(i, j)
        # a label is the least of its parts' places
        to = known.label[first]
        moved = np.flatnonzero(to != np.arange(len(parts)))
        return [pa.array(parts[moved], pa.int64()), pa.array(parts[to[moved]], pa.int64())]

    return fn


def _at(coordinate: Column) -> Column:
    return F.substring("sketch", 2 * coordinate + 1, F.lit(2))


_LINK = "a bigint, b bigint"


def _n_blocks(rows: Column, block: int) -> Column:
    return F.ceil(rows / F.lit(block)).cast("int")


def _in_blocks(rows: DataFrame, group: str, block: int, seed: int, led: Column) -> DataFrame:
    """rows (rep, group, size, ...) with key and asks: a block of its group for each row, all blocks for LEADERS or so of those that led allows, whose number is the column n_led."""
    blocks = _n_blocks(F.col("size"), block)
    own = F.pmod(F.xxhash64(F.lit(seed), "rep"), blocks).cast("int")
    lead = (F.col("size") > block) & led & (F.pmod(F.xxhash64(F.lit(seed + 100), group, "rep"), F.col("n_led")) < LEADERS)
    return rows.withColumn("_block", F.explode(F.when(lead, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own)))).withColumn("key", F.xxhash64(group, "_block")).withColumn("asks", F.lit(True)).drop("_block")


def _against_all(rows: DataFrame, group: str, block: int, seed: int) -> DataFrame:
    """rows (rep, group, size, part, largest, n_out, ...) with key and asks: those outside of the largest part ask, in blocks of their own, every block of the group."""
    blocks, asked = _n_blocks(F.col("size"), block), _n_blocks(F.col("n_out"), block)
    out = F.col("part") != F.col("largest")
    roles = rows.withColumn("asks", F.explode(F.when(out, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    own = F.pmod(F.xxhash64(F.lit(seed), "rep"), blocks).cast("int")
    column = F.pmod(F.xxhash64(F.lit(seed + 100), "rep"), asked).cast("int")
    keys = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.xxhash64(group, column, b))).otherwise(
        F.transform(F.sequence(F.lit(0), asked - 1), lambda c: F.xxhash64(group, c, own)))
    return roles.withColumn("key", F.explode(keys))


def _with(rows: DataFrame, key: str, values: Saved) -> DataFrame:
    """rows with the columns of values, which has a row for some of the keys; null for others. Up to BROADCAST_IDS values are broadcast; more meet rows that are dealt over salts."""
    if values.df.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(values.df), key, "left")
    return Saved(dealt_join(rows, [key], values.df, "rep", "left"), "met").df


def _open(parted: DataFrame, group: str) -> Saved:
    """(group, largest, size, n_out) of the groups of parted (rep, group, part, ...) that hold several parts; n_out is the rows outside of the largest part."""
    sizes = parted.groupBy(group, "part").agg(F.count(F.lit(1)).alias("m"))
    most = sizes.groupBy(group).agg(F.max_by("part", F.struct("m", "part")).alias("largest"), F.sum("m").alias("size"), F.max("m").alias("top"))
    return Saved(most.filter("top < size").select(group, "largest", "size", (F.col("size") - F.col("top")).alias("n_out")), "open")


def _parted(rows: DataFrame, stars: Stars) -> DataFrame:
    return Saved(_joined(rows, stars).withColumn("part", F.coalesce("component", "rep")).drop("component"), "parted").df


def _joined(rows: DataFrame, stars: Stars) -> DataFrame:
    """rows (rep, ...) with component, null for what is its component's least node or in none."""
    held = stars.df.select(F.col("node").alias("rep"), "component")
    return rows.join(F.broadcast(held) if held.count() <= BROADCAST_IDS else held, "rep", "left")


def candidate_stars(reps: DataFrame, percent: int) -> Stars:
    """Of the representatives (rep, n, sketch, roots), the components of those that the trees bring together and sketches hold for similar.

    The first level's links part the large nodes; what meets at all later levels is compared in one pass at the end, as keys differ by level.
    Sizes are looked up for large nodes alone; the rows of a small one meet in one task, which sees whether it is alone. The rows of the first level, TREES for each
    representative, are written, since sizes, small nodes, large ones and their parts each read them.
    """
    payload = reps.select("rep", "n", "sketch")
    met = lambda dealt: dealt.select("rep", "part", "key", "asks")
    linked = lambda rows: grouped(rows.join(payload, "rep"), "key", _connect(percent), ["a", "b"], _LINK)
    rows = Saved(reps.select("rep", F.explode(F.transform("roots", lambda x, t: F.xxhash64(t, x))).alias("tree")), "roots").df.withColumn("part", F.col("rep"))
    nodes = Saved(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > NODE), "nodes")
    most = nodes.df.agg(F.max("size")).first()[0] or 0
    sized = _with(rows, "tree", nodes)
    small = sized.filter("size is null").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("tree"))).filter("size > 1")
    large = sized.filter("size is not null")
    blocks = lambda rows, depth: met(_in_blocks(rows.withColumn("n_led", F.col("size")), "tree", NODE, depth, F.lit(True)))
    stars = Stars(linked(blocks(small.unionByName(large), 0)))
    if most <= NODE:
        return stars
    deepest = 2 + int(np.ceil(np.log2(most / NODE)))
    more, depth, here = [], 0, _parted(large.drop("part", "size"), stars)
    while True:
        nodes = _open(here, "tree")
        size, n_out = nodes.df.agg(F.max("size"), F.max(F.when(F.col("size") > NODE, F.col("n_out")))).first()
        if not size:
            break
        sized = _with(here, "tree", nodes).filter("size is not null")
        if depth:
            more.append(blocks(sized, depth))
        if size <= NODE:
            break
        still = sized.filter(F.col("size") > NODE)
        ends = F.lit(depth >= deepest) | (F.col("n_out") <= REST)
        more.append(met(_against_all(still.filter(ends), "tree", NODE, depth)))
        if depth >= deepest or n_out <= REST:
            break
        branch = F.array(*[F.pmod(F.xxhash64(F.lit(depth), F.lit(s), "tree"), F.lit(COORDINATES)).cast("int") for s in range(2)])
        wide = still.filter(~ends).select("rep", "tree", "part", F.explode(branch).alias("c")).join(reps.select("rep", "sketch"), "rep")
        depth += 1
        here = Saved(wide.select("rep", F.xxhash64("tree", "c", _at(F.col("c"))).alias("tree"), "part"), f"level{depth}").df
    if more:
        stars.add(linked(reduce(DataFrame.unionByName, more)))
    return stars


def representatives(every: DataFrame) -> DataFrame:
    """(rep, doc_id, body, c1, c2, n, sketch, roots): a row for each set of every, with a number, rep, of its own; doc_id and body name its row with the least id."""
    least = every.filter("c1 is not null and doc_id is not null").groupBy("c1", "c2").agg(
        F.min(F.struct("doc_id", "body")).alias("least"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("roots").alias("roots"))
    return Saved(least.select(F.monotonically_increasing_id().alias("rep"), "least.doc_id", "least.body", "c1", "c2", "n", "sketch", "roots"), "reps").df


def classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, body, n_shingles, component_id, class_body) of every row; component_id and class_body name the row of the class with the least id."""
    every = Saved(features(docs, k), "features").df
    reps = representatives(every)
    found = _confirmed(docs, reps, candidate_stars(reps, percent), k, percent)
    own = Saved(_joined(reps.select("rep", "doc_id", "body", "c1", "c2"), found).withColumn("class", F.coalesce("component", "rep")).drop("component"), "classes").df
    heads = Saved(own.groupBy("class").agg(F.min(F.struct("doc_id", "body")).alias("head"), F.count(F.lit(1)).alias("_size")).filter("_size > 1").drop("_size"), "heads")
    named = _with(own, "class", heads).select("c1", "c2", F.coalesce("head", F.struct("doc_id", "body")).alias("head"))
    # copies of one text may be a third of all rows; rows without words or id are of no class
    sets = dealt_join(every.filter("c1 is not null and doc_id is not null").drop("sketch", "roots"), ["c1", "c2"], named, "doc_id").select("doc_id", "body", "n_shingles", F.col("head.doc_id").alias("component_id"), F.col("head.body").alias("class_body"))
    rest = every.filter("c1 is null or doc_id is null").select("doc_id", "body", "n_shingles", F.col("doc_id").alias("component_id"), F.col("body").alias("class_body"))
    return sets.unionByName(rest)


def near_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id that links reach; documents link at 100 * intersection >= percent * union."""
    return classes(docs, k, percent).select("doc_id", "n_shingles", "component_id")


def _confirmed(docs: DataFrame, reps: DataFrame, candidates: Stars, k: int, percent: int) -> Stars:
    """The components of the candidates that full sets connect within their groups."""
    columns = ["rep", "n", "sketch", "text", "part", "key", "asks"]
    linked = lambda rows: grouped(rows.select(*columns), "key", _connect(percent, k), ["a", "b"], _LINK)
    sizes = Saved(candidates.df.groupBy(F.col("component").alias("group")).agg((F.count(F.lit(1)) + 1).alias("size")), "groups")
    few = (sizes.df.agg(F.sum("size")).first()[0] or 0) <= BROADCAST_IDS
    some = lambda rows, hint=None: F.broadcast(rows) if few else rows.hint(hint) if hint else rows
    groups = candidates.df.select(F.col("node").alias("rep"), F.col("component").alias("group")).unionByName(sizes.df.select(F.col("group").alias("rep"), "group"))
    wanted = reps.select("rep", "doc_id", "body", "n", "sketch").join(some(groups), "rep")
    asked = wanted.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"))
    bodies = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.expr(_BODY).alias("body"), "text").join(
        some(asked, "shuffle_hash"), (F.col("doc_id") == F.col("_id")) & (F.col("body") == F.col("_body")), "left_semi").groupBy("doc_id", "body").agg(F.first("text").alias("text"))
    # the size of a group that fits into a block is not asked for
    over = Saved(sizes.df.filter(F.col("size") > BLOCK), "large-groups")
    sized = _with(wanted.join(bodies, ["doc_id", "body"]).drop("doc_id", "body"), "group", over)
    members = Saved(sized.withColumn("size", F.coalesce("size", F.lit(1))), "members").df
    first = _in_blocks(members.withColumn("part", F.col("rep")).withColumn("n_led", F.col("size")), "group", BLOCK, 0, F.lit(True))
    stars = Stars(linked(first), "classes")
    large = members.filter(F.col("size") > BLOCK).drop("size")
    left = None
    for seed in range(1, 1 << 16):
        if not over.df.head(1):
            break
        parted = _parted(large, stars)
        nodes = _open(parted, "group")
        before, (left, most) = left, nodes.df.agg(F.sum("n_out"), F.max("n_out")).first()
        if not left:
            break
        still = _with(parted, "group", nodes).filter("size is not null")
        # leaders of those outside go on while they connect more; rounds are linear, what follows is linear in those left outside and in the group
        if (before is None or 4 * left < 3 * before) and most > REST:
            stars.add(linked(_in_blocks(still.withColumn("n_led", F.col("n_out")), "group", BLOCK, seed, F.col("part") != F.col("largest"))))
            continue
        stars.add(linked(_against_all(still, "group", BLOCK, seed)))
        break
    return stars


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each class, the one with the least id; columns as they are. Of rows with that id and the same text one stays, the same in reruns. Rows without an id all stay."""
    kept = classes(docs, k, percent).filter("doc_id = component_id and body = class_body").select(F.col("doc_id").alias("_id"), F.col("body").alias("_body")).distinct()
    body, columns = F.expr(_BODY), docs.columns
    named = docs.filter("doc_id is not null").join(kept.hint("shuffle_hash"), (F.col("doc_id").cast("bigint") == F.col("_id")) & (body == F.col("_body")), "left_semi")
    one = named.groupBy(F.col("doc_id").alias("_id"), body.alias("_body")).agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*[c for c in columns if c != "text"]))).alias("_row")).select("_row.*")
    return one.unionByName(docs.filter("doc_id is null"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), k=2).withColumn("kept", F.col("doc_id") == F.col("component_id"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s AS a JOIN n AS na ON na.doc_id = a.doc_id JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n) GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))
), reach AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT reach.u, l.v FROM reach JOIN l ON l.u = reach.v),
c AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = w.doc_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.u = w.doc_id
"""
