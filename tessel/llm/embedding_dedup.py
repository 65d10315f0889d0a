"""Embedding near-dedup by NN-descent.

Vectors that may be compared (same label, same length) form a cell. Equal vectors become one representative with a multiplicity.
Every representative keeps a list of its NEIGHBOURS nearest ones among those it is not connected with yet.

A round refines all lists: vectors in the orders of fresh random projections meet the next ones, and around each centre the members of its
list and of the lists that hold it meet, which are neighbours of neighbours. Every pair so compared at the threshold or above is a
link, whatever the lists hold. Links connect components; a list whose places are links is saturated, since what it lacks is hidden behind
what it has. It is enlarged by what its vector's component holds already: places of vectors in the own component are given to the next ones
outside. So a group of thousands of near copies fills no list, and lists go on growing towards other components until none of them is a link.

The descent ends when a round connects nothing, LEAST_ROUNDS at least, and an audit holds: AUDIT * sqrt(rows) vectors or so, half of them
sought where links are likely (in parts of several, or with a neighbour close to the threshold), meet all rows of their cells in blocks. A vector is missed if
it has a link to another component. Where a share of TARGET or more of the linked vectors asked is complete, or none of those asked has a link, the descent is done. Else what the audit found is
added, the missed vectors take the ends of their missing links into their lists, so that both neighbourhoods meet, and the descent goes on, with other vectors asked each time. There is no last round
of another kind: each audit that fails connects components, so audits end. An audit costs rows ** 1.5 comparisons; nothing compares all rows with all. linked() returns the audits' figures.

Members of a component then count their links, in double precision over all members. In a component of more than BLOCK members, those
within half the threshold's angle of a pivot are all linked with each other, by the triangle inequality, and are counted by a sum; the others
meet all members in pairs of blocks, which count links and emit none.

Defined results: a vector that is null, zero, or holds a null or non-finite component, or whose label is null, links with
nothing; repeated rows and ties count as other vectors each; rows that share a vec_id share the outcome; an empty table gives an
empty one; other columns of the input are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.common import Saved, dealt_join, table
from tessel.llm.graph import components
from tessel.llm.groups import Union, grouped

NEIGHBOURS, MEET = 10, 48
ORDERS, BITS, AHEAD = 4, 40, 8
LEAST_ROUNDS = 3
#: TARGET is the share of the linked vectors asked that have to be complete.
AUDIT, TARGET, CLOSE = 10, 0.99, 0.1
#: Bytes of vectors that a block of an audit's queries holds, on the driver and in every task; rows that meet them at a time.
QUERY_BYTES, TILE = 32 << 20, 256
BLOCK, PIVOT = 512, 256
_EDGE, _LINK = "u bigint, v bigint, sim double", "a bigint, b bigint"


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64)
    return x.reshape(len(rows), -1)


def units(vectors: DataFrame) -> DataFrame:
    """(vec_id, cell, vec) of the vectors that can link: cell tells apart labels and lengths, vec holds the unit vector as doubles."""
    usable = vectors.filter("vec_id is not null and label is not null and embedding is not null").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.xxhash64(F.col("label").cast("string"), F.size("embedding")).alias("cell"), F.col("embedding").cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, vecs = [], []
            for i, x in enumerate(batch.column("x")):
                if x.values.null_count == 0 and len(x.values):
                    a = x.values.to_numpy()
                    if np.isfinite(a).all() and (top := np.abs(a).max()) > 0:
                        a = a / top  # no overflow or underflow in the norm
                        keep.append(i)
                        vecs.append((a / np.sqrt(a @ a)).tobytes())
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("cell"), pa.array(vecs, pa.binary())], ["vec_id", "cell", "vec"])

    return usable.mapInArrow(run, "vec_id bigint, cell bigint, vec binary")


def _best(u: np.ndarray, v: np.ndarray, sim: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each u the most similar edges."""
    order = np.lexsort((v, -sim, u))
    u, v, sim = u[order], v[order], sim[order]
    first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.array([], np.int64)
    keep = np.arange(len(u)) - np.repeat(first, np.diff(np.r_[first, len(u)])) < most
    return u[keep], v[keep], sim[keep]


def _edges(names: np.ndarray, part: np.ndarray, i: np.ndarray, j: np.ndarray, sim: np.ndarray, threshold: float, most: int) -> list[pa.Array]:
    """Of compared pairs (i, j) of rows: links that connect what the pairs at the threshold connect, and each row's best edges to what is below it. Rows of one part are connected already."""
    apart = part[i] != part[j]
    i, j, sim = i[apart], j[apart], sim[apart]
    near = sim >= threshold
    known, links = Union(np.unique(part, return_inverse=True)[1].astype(np.int64)), []
    for k in np.flatnonzero(near).tolist():
        if known.label[i[k]] != known.label[j[k]]:
            known.join(i[k], j[k])
            links.append(k)
    i, j, sim, li, lj, ls = i[~near], j[~near], sim[~near], i[links], j[links], sim[links]
    u, v, s = _best(np.r_[i, j], np.r_[j, i], np.r_[sim, sim], most)
    u, v, s = np.r_[u, li], np.r_[v, lj], np.r_[s, ls]
    return [pa.array(names[u], pa.int64()), pa.array(names[v], pa.int64()), pa.array(s, pa.float64())]


def _ordered(nodes: DataFrame, seed: int, threshold: float) -> DataFrame:
    """Edges of each row of nodes (rep, cell, vec, part) with those around it in ORDERS orders of projection signs."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(BITS, dtype=np.int64)[::-1]
        for batch in batches:
            vecs, out = batch.column("vec").to_pylist(), np.zeros((batch.num_rows, ORDERS), np.int64)
            dims = np.array([len(v) for v in vecs])
            for d in np.unique(dims).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d // 8, ORDERS * BITS))
                at = np.flatnonzero(dims == d)
                signs = (_unit([vecs[i] for i in at]) @ planes[d] > 0).reshape(len(at), ORDERS, BITS)
                out[at] = signs @ weights
            for o in range(ORDERS):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "cell", "vec", "part")), pa.array(np.full(batch.num_rows, o)), pa.array(out[:, o])], ["rep", "cell", "vec", "part", "o", "key"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([tail, batch] if tail is not None else [batch]).combine_chunks()
            ids, cells, orders, part = (t.column(c).to_numpy() for c in ("rep", "cell", "o", "part"))
            vecs = t.column("vec").to_pylist()
            i, j, sims = [np.array([], np.int64)], [np.array([], np.int64)], [np.array([])]
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (orders[1:] != orders[:-1])) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                x, n = _unit(vecs[a:b]), b - a
                for h in range(1, min(AHEAD, n - 1) + 1):
                    i.append(np.arange(a, b - h))
                    j.append(np.arange(a + h, b))
                    sims.append(np.einsum("ij,ij->i", x[: n - h], x[h:]))
            yield pa.RecordBatch.from_arrays(_edges(ids, part, np.concatenate(i), np.concatenate(j), np.concatenate(sims), threshold, 3), ["u", "v", "sim"])
            tail = t.slice(max(0, t.num_rows - AHEAD)).to_batches()[0]

    dealt = nodes.select("rep", "cell", "vec", "part").mapInArrow(keys, "rep bigint, cell bigint, vec binary, part bigint, o bigint, key bigint")
    return dealt.repartitionByRange("cell", "o", "key", "rep").sortWithinPartitions("cell", "o", "key", "rep").mapInArrow(meet, _EDGE)


def _around_centres(lists: DataFrame, nodes: DataFrame, seed: int, threshold: float) -> DataFrame:
    """Edges between the members of a centre's list, the vectors whose lists hold it, and itself."""
    both = lists.select(F.col("u").alias("centre"), F.col("v").alias("rep")).unionByName(lists.select(F.col("v").alias("centre"), F.col("u").alias("rep"))).unionByName(
        lists.select(F.col("u").alias("centre"), F.col("u").alias("rep"))).distinct()
    degree = both.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / F.lit(MEET)).cast("int").alias("blocks"))
    # a centre that many lists hold is cut in groups, other ones each round
    dealt = dealt_join(both, ["centre"], degree, "rep").select("rep", F.xxhash64("centre", F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col("blocks"))).alias("group"))

    def fn(t: pa.Table) -> list[pa.Array]:
        x = _unit(t.column("vec").to_pylist())
        i, j = np.triu_indices(len(x), 1)
        return _edges(t.column("rep").to_numpy(), t.column("part").to_numpy(), i, j, (x @ x.T)[i, j], threshold, NEIGHBOURS // 2)

    return grouped(dealt.join(nodes.select("rep", "vec", "part"), "rep"), "group", fn, ["u", "v", "sim"], _EDGE)


def _refined(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Lists (u, v, sim): of each u the NEIGHBOURS best outside of its component. A place that was a link is in the own component by now and makes room."""
    part = nodes.select("rep", "part")
    at = lambda c: part.select(F.col("rep").alias(c), F.col("part").alias(f"_{c}"))
    each = edges.filter(F.col("sim") < threshold).groupBy("u", "v").agg(F.max("sim").alias("sim"))
    outside = each.join(at("u"), "u").join(at("v"), "v").filter("_u <> _v").drop("_u", "_v")
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return outside.withColumn("_place", place).filter(F.col("_place") <= NEIGHBOURS).drop("_place")


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which cosines of rows of x and y reach the threshold in double precision; those that single precision tells for sure are not computed again."""
    s = x.astype(np.float32) @ y.astype(np.float32).T
    margin = 2.0**-22 * (x.shape[1] + 8)
    near = s >= threshold + margin
    i, j = np.nonzero((s >= threshold - margin) & ~near)
    for at in range(0, len(i), 1 << 14):
        k = slice(at, at + (1 << 14))
        near[i[k], j[k]] = np.einsum("ij,ij->i", x[i[k]], y[j[k]]) >= threshold
    return near


@dataclass(frozen=True)
class Audit:
    """What an audit saw: the vectors asked, those of them that have a link, and those that have one the descent missed. recall is None if none has a link."""

    asked: int
    linked: int
    missed: int

    @property
    def recall(self) -> float | None:
        return 1 - self.missed / self.linked if self.linked else None


def _meets_all(held, threshold: float):
    """Rows against the queries that held, a broadcast by cell. Gives (q, null, false) for a query with a link, (q, null, true) for one with a link to another part, and (a, b, null) for links that connect these parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linked, missed, links = set(), set(), []
        joined = {c: Union(np.unique(part, return_inverse=True)[1].astype(np.int64)) for c, (_, _, part) in held.value.items()}
        for batch in batches:
            ids, cells, parts = (batch.column(c).to_numpy() for c in ("rep", "cell", "part"))
            vecs = batch.column("vec").to_pylist()
            for cell in np.unique(cells).tolist():
                if cell not in held.value:
                    continue
                names, y, own = held.value[cell]
                at = np.flatnonzero(cells == cell)
                for rows in np.array_split(at, range(TILE, len(at), TILE)):
                    x = _unit([vecs[i] for i in rows])
                    for c in range(0, len(names), 16 * TILE):
                        cut = slice(c, c + 16 * TILE)
                        near = _near(x, y[cut], threshold) & (ids[rows][:, None] != names[cut])
                        linked.update(names[cut][near.any(axis=0)].tolist())
                        new = near & (parts[rows][:, None] != own[cut])
                        missed.update(names[cut][new.any(axis=0)].tolist())
                        for i in np.flatnonzero(new.any(axis=1)).tolist():
                            to = np.flatnonzero(new[i]) + c
                            links.append((ids[rows[i]], names[to[0]]))
                            for j in to[1:].tolist():
                                if joined[cell].label[j] != joined[cell].label[to[0]]:
                                    joined[cell].join(to[0], j)
                                    links.append((names[to[0]], names[j]))
        a = [*linked, *missed, *(x for x, _ in links)]
        b = [None] * (len(linked) + len(missed)) + [y for _, y in links]
        what = [False] * len(linked) + [True] * len(missed) + [None] * len(links)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(what, pa.bool_())], ["a", "b", "missed"])

    return run


def audit(nodes: DataFrame, asked: DataFrame, threshold: float) -> tuple[Audit, DataFrame]:
    """The rows asked, of nodes (rep, cell, vec, part), against all of them: figures, and links (a, b) that connect the parts which the asked ones connect.

    Blocks of asked rows, of QUERY_BYTES or so, are held by every task while a scan reads the rows of the same cells.
    """
    spark, schema = nodes.sparkSession, "a bigint, b bigint, missed boolean"
    asked = Saved(asked.select("rep", "cell", "vec", "part"), "asked").df
    n, size = asked.agg(F.count(F.lit(1)), F.sum(F.length("vec"))).first()
    blocks = max(1, -(-(size or 0) // QUERY_BYTES))
    out = Saved(spark.createDataFrame([], schema), "audit")
    for k in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(blocks)) == k).toArrow()
        of, names, part, vecs = rows.column("cell").to_numpy(), rows.column("rep").to_numpy(), rows.column("part").to_numpy(), rows.column("vec").to_pylist()
        held = spark.sparkContext.broadcast({c: (names[at], _unit([vecs[i] for i in at]), part[at]) for c in np.unique(of).tolist() for at in [np.flatnonzero(of == c)]})
        nodes.select("rep", "cell", "vec", "part").mapInArrow(_meets_all(held, threshold), schema).write.mode("append").parquet(out.path)
        held.destroy()
    seen = spark.read.schema(schema).parquet(out.path)
    linked, missed = seen.filter("missed is not null").agg(F.countDistinct("a"), F.countDistinct(F.when(F.col("missed"), F.col("a")))).first()
    return Audit(n, linked, missed), seen.filter("missed is null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _audited(nodes: DataFrame, lists: DataFrame, threshold: float, seed: int) -> tuple[Audit, DataFrame]:
    """An audit of AUDIT * sqrt(rows) vectors. Each seed picks other ones, so that no audit passes by what an earlier one added."""
    n = nodes.count()
    best = lists.groupBy("u").agg(F.max("sim").alias("best"))
    size = nodes.groupBy("part").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    flagged = nodes.join(best, F.col("rep") == F.col("u"), "left").join(size, "part", "left").withColumn("likely", F.col("_size").isNotNull() | (F.coalesce("best", F.lit(-1.0)) >= threshold - CLOSE))
    marked = Saved(flagged.select("rep", "likely"), "likely")
    likely, asked = marked.df.filter("likely").count(), math.ceil(AUDIT * math.sqrt(n))
    share = lambda of: min(1.0, asked / 2 / of) if of else 1.0
    chance = F.when(F.col("likely"), F.lit(share(likely))).otherwise(F.lit(share(n - likely)))
    picked = marked.df.filter(F.pmod(F.xxhash64(F.lit(7 + seed), "rep"), F.lit(1 << 30)) < chance * (1 << 30)).select("rep")
    found = audit(nodes, nodes.join(picked, "rep"), threshold)
    marked.drop()
    return found


def descend(reps: DataFrame, threshold: float, target: float = TARGET) -> tuple[DataFrame, list[Audit]]:
    """(rep, part) of every row of reps (rep, cell, vec), part being the least rep that links connect it with; and the figures of the audits."""
    bare = reps.select("rep", "cell", "vec")
    nodes, lists, links, hints = Saved(bare.withColumn("part", F.col("rep")), "nodes"), None, None, None
    audits: list[Audit] = []
    for r in itertools.count():
        edges = _ordered(nodes.df, r, threshold)
        if lists is not None:
            around = lists.df if hints is None else lists.df.unionByName(hints)
            edges = edges.unionByName(_around_centres(around, nodes.df, r, threshold))
        edges, hints = Saved(edges, "edges"), None
        fresh = edges.df.filter(F.col("sim") >= threshold).select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        linked = bool(fresh.head(1))
        if linked:
            nodes, links = _joined(bare, nodes, links, fresh)
        after = Saved(_refined(edges.df if lists is None else edges.df.unionByName(lists.df), nodes.df, threshold), "lists")
        edges.drop()
        if lists is not None:
            lists.drop()
        lists = after
        if r + 1 < LEAST_ROUNDS or linked:
            continue
        found, missing = _audited(nodes.df, lists.df, threshold, r)
        audits.append(found)
        if found.missed:
            nodes, links = _joined(bare, nodes, links, missing)
        if found.recall is None or found.recall >= target:
            lists.drop()
            break
        # the ends of a missing link meet each other's neighbours in the next round
        hints = missing.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))).withColumn("sim", F.lit(threshold))
    return nodes.df.select("rep", "part"), audits


def _joined(bare: DataFrame, nodes: Saved, links: DataFrame | None, fresh: DataFrame) -> tuple[Saved, DataFrame]:
    """Nodes and stars after further links."""
    stars = Saved(components(fresh if links is None else fresh.unionByName(links)), "stars").df
    after = Saved(bare.join(stars, F.col("rep") == F.col("node"), "left").select("rep", "cell", "vec", F.coalesce("component", "rep").alias("part")), "nodes")
    nodes.drop()
    return after, stars.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _counts(threshold: float):
    def fn(t: pa.Table) -> list[pa.Array]:
        ids, side, copies = t.column("rep").to_numpy(), t.column("side").to_numpy(), t.column("copies").to_numpy()
        x = _unit(t.column("vec").to_pylist())
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        n = np.zeros(len(ids), np.int64)
        if len(b) == 0:
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            n = near @ copies
        elif len(a):
            near = x[a] @ x[b].T >= threshold
            n[a], n[b] = near @ copies[b], near.T @ copies[a]
        return [pa.array(ids, pa.int64()), pa.array(n, pa.int64())]

    return fn


def _in_core(members: DataFrame, threshold: float) -> DataFrame:
    """members (rep, part, vec, ...) with core: surely linked with all others of the core. The pivot is the mean of PIVOT members or so; any would do."""
    def pivots(t: pa.Table) -> list[pa.Array]:
        return [pa.array(t.column("part").to_numpy()[:1]), pa.array([_unit(t.column("vec").to_pylist()).sum(axis=0).tobytes()], pa.binary())]

    some = members.filter((F.col("size") > BLOCK) & (F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("size")) < PIVOT)).select("part", "vec")
    pivot = grouped(some, "part", pivots, ["part", "pivot"], "part bigint, pivot binary")
    columns = [*members.columns, "core"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = math.acos(min(1.0, threshold)) / 2 - 1e-6
        for batch in batches:
            core = np.zeros(batch.num_rows, bool)
            for i, (v, p) in enumerate(zip(batch.column("vec").to_pylist(), batch.column("pivot").to_pylist())):
                x, m = np.frombuffer(v), np.frombuffer(p)
                norm = math.sqrt(m @ m)
                core[i] = norm > 0 and math.acos(max(-1.0, min(1.0, x @ m / norm))) <= half
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns[:-1]), pa.array(core)], columns)

    kinds = ", ".join(f"{c} {t}" for c, t in members.dtypes)
    large = dealt_join(members.filter(F.col("size") > BLOCK), ["part"], pivot, "rep").mapInArrow(mark, f"{kinds}, core boolean")
    return members.filter(F.col("size") <= BLOCK).withColumn("core", F.lit(False)).unionByName(large)


def link_counts(reps: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """(rep, n): the vectors, copies counted each, that a rep of reps (rep, copies, vec) is linked with beside its own copies; parts (rep, part) are the components. Only reps of larger components have a row."""
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = dealt_join(parts, ["part"], sizes, "rep").join(reps.select("rep", "copies", "vec"), "rep")
    marked = Saved(_in_core(members, threshold), "members").df
    inner = marked.groupBy("part").agg(F.sum(F.when(F.col("core"), F.col("copies"))).alias("in_core"), F.count(F.when(~F.col("core"), 1)).alias("n_out"))
    known = dealt_join(marked, ["part"], inner, "rep")
    core = known.filter("core").select("rep", (F.col("in_core") - F.col("copies")).alias("n"))
    # those outside of the core meet each other, in pairs of blocks, and all of the core
    n_out, n_core = F.ceil(F.col("n_out") / F.lit(BLOCK)).cast("int"), F.ceil((F.col("size") - F.col("n_out")) / F.lit(BLOCK)).cast("int")
    block = lambda n: F.pmod(F.xxhash64(F.lit(9), "rep"), n).cast("int")
    each = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<struct<key:bigint,side:int>>"))
    meeting = lambda x, y, inside, side: F.struct(F.xxhash64("part", x, y, F.lit(inside)).alias("key"), side.cast("int").alias("side"))
    own = block(n_out)
    outer = F.concat(each(n_out, lambda o: meeting(F.least(own, o), F.greatest(own, o), "out", own > o)), each(n_core, lambda c: meeting(own, c, "core", F.lit(0))))
    pair = F.when(F.col("core"), each(n_out, lambda o: meeting(o, block(n_core), "core", F.lit(1)))).otherwise(outer)
    met = known.filter("n_out > 0").select("rep", "copies", "vec", F.explode(pair).alias("p")).select("rep", "copies", "vec", "p.key", "p.side")
    return core.unionByName(grouped(met, "key", _counts(threshold), ["rep", "n"], "rep bigint, n bigint")).groupBy("rep").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Linked:
    """rows: (vec_id, n_links, component_id) of every row; audits: the figures of the descent's audits, the last of which held."""

    rows: DataFrame
    audits: list[Audit]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """The rows of linked()."""
    return linked(vectors, threshold).rows


def linked(vectors: DataFrame, threshold: float = 0.93, target: float = TARGET) -> Linked:
    """Counts and components of all rows of vectors (vec_id, label, embedding), with a recall of target or more among the linked vectors that an audit asks."""
    every = Saved(units(vectors).withColumn("c1", F.xxhash64("vec")).withColumn("c2", F.xxhash64(F.lit(1), "vec")), "units").df
    same = ["cell", "c1", "c2"]
    reps = Saved(every.groupBy(*same).agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")).withColumn("rep", F.monotonically_increasing_id()), "vector-reps").df
    parts, audits = descend(reps, threshold, target)
    parts = Saved(parts, "parts").df
    least = parts.join(reps.select("rep", "first"), "rep").groupBy("part").agg(F.min("first").alias("component_id"))
    named = dealt_join(parts, ["part"], least, "rep").select("rep", "component_id")
    outcome = reps.select(*same, "rep", "copies").join(named, "rep").join(link_counts(reps, parts, threshold), "rep", "left").select(
        *same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    # copies of one vector may be a third of all rows
    per_id = dealt_join(every.select("vec_id", *same), same, outcome, "vec_id").groupBy(F.col("vec_id").alias("_id")).agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id")).join(per_id, F.col("vec_id") == F.col("_id"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return Linked(rows, audits)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


SQL = """
WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * v))) AS n FROM embeddings),
l AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM e AS a JOIN e AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.93
), reach AS (SELECT vec_id AS u, vec_id AS v FROM e UNION SELECT reach.u, l.v FROM reach JOIN l ON l.u = reach.v),
c AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.u = e.vec_id) AS n_links, component_id, component_id = e.vec_id AS kept FROM e JOIN c ON c.u = e.vec_id
"""
