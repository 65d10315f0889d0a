"""Exact nearest neighbours, classification by them, a ball tree as tables, and search by its leaves."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.plans.stats import against_all, chunks, matrix, query_columns, sqdist_rows
from tessel.plans.tables import written


class _Best:
    """The k best rows (d2, id) of each query among those offered; a place not taken yet holds nan and the largest id, which come last.

    Products in single precision, of vectors shifted and scaled to the queries', exclude rows by a margin that is above what rounding does to them. The distances of the others are summed
    as sqdist_rows() has them, so that what is found is exact, ties included. Of equal rows offered at once only the k of the least ids are looked at. What is beyond a query's limit, a squared distance, is not kept.
    """

    def __init__(self, x: np.ndarray, k: int, limit: np.ndarray | None = None) -> None:
        self.x, self.k, width = x, k, x.shape[1]
        self.limit = np.full(len(x), np.inf) if limit is None else limit
        self.d, self.i = np.full((len(x), k), np.nan), np.full((len(x), k), np.iinfo(np.int64).max)
        self.margin = (2 * width + 20) * 2.0**-24
        self.left, self.norm = np.ones((len(x), width + 1), np.float32), np.zeros(len(x))
        with np.errstate(all="ignore"):
            some = x[:4096]
            some = some[np.isfinite(some).all(axis=1)]
            self.centre = some.mean(axis=0) if len(some) else np.zeros(width)
            self.scale = 1.0
            for q in chunks(len(x), width):
                self.norm[q] = ((x[q] - self.centre) ** 2).sum(axis=1)
            most = self.norm[np.isfinite(self.norm)].max(initial=0.0)
            if 1e-200 < most < 1e200:
                self.scale = 2.0 ** -math.ceil(math.log2(most) / 2)
            for q in chunks(len(x), width):
                self.left[q, :width] = (x[q] - self.centre) * (-2 * self.scale)
            self.norm *= self.scale**2
            self.left[~(self.norm < 1e30)] = np.nan

    def _bound(self, q: slice | np.ndarray) -> np.ndarray:
        worst = np.fmin(self.d[q, -1], self.limit[q])
        return (worst * (self.scale**2 * (1 + 2.0**-20)) - self.norm[q] * (1 - 2 * self.margin) + 1e-30).astype(np.float32)[:, None]

    def _right(self, rows: np.ndarray) -> np.ndarray:
        right = np.empty((len(rows), rows.shape[1] + 1), np.float32)
        shifted = (rows - self.centre) * self.scale
        norm = (shifted**2).sum(axis=1)
        right[:, :-1], right[:, -1] = shifted, norm * (1 - 2 * self.margin)
        right[~(norm < 1e30)] = np.nan
        return right

    def reached(self, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """For each query and ball, whether the ball may come as near as the worst place held; balls and distances are taken a little larger than they are."""
        out = np.empty((len(self.x), len(centres)), bool)
        with np.errstate(all="ignore"):
            right = self._right(centres).T
            for q in chunks(len(self.x), len(centres), 1_000_000):
                least = (self.left[q] @ right).astype(float) + (self.norm[q] * (1 - 2 * self.margin) - 1e-30)[:, None]
                reach = np.sqrt(np.fmin(self.d[q, -1], self.limit[q]))[:, None] + radii
                out[q] = ~(np.sqrt(np.maximum(least, 0.0)) * ((1 - 1e-6) / self.scale) > reach * (1 + 1e-6))
        return out

    def offer(self, rows: np.ndarray, ids: np.ndarray, asks: np.ndarray | None = None) -> None:
        """Rows for all queries, or for those at asks."""
        if len(rows) > self.k:
            same = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, 8 * rows.shape[1]))).ravel(), return_inverse=True)[1].ravel()
            order = np.lexsort((ids, same))
            ahead = np.arange(len(rows)) - np.maximum.accumulate(np.where(np.diff(same[order], prepend=-1) != 0, np.arange(len(rows)), 0))
            rows, ids = rows[order[ahead < self.k]], ids[order[ahead < self.k]]
        with np.errstate(all="ignore"):
            right = self._right(rows)
            for part in chunks(len(self.x) if asks is None else len(asks), len(rows), 1_000_000):
                q = part if asks is None else asks[part]
                near, who = self.left[q] @ right.T, np.arange(part.start, part.stop) if asks is None else q
                some = np.flatnonzero(~(near.min(axis=1) > self._bound(q)[:, 0]))
                if len(some) < len(who):
                    near, who = near[some], who[some]
                beyond, seen = near > self._bound(who), None
                for width in (max(1024, 4 * self.k), len(rows)):
                    if beyond.size - np.count_nonzero(beyond) <= 16 * self.k * len(who):
                        break
                    # nothing is known yet, or little: the best of some of these rows first, then of all
                    first = np.argpartition(near[:, :width], self.k - 1, axis=1)[:, : self.k]
                    seen = np.zeros(beyond.shape, bool) if seen is None else seen
                    new = ~np.take_along_axis(seen, first, 1).ravel()
                    self._take(np.repeat(who, self.k)[new], first.ravel()[new], rows, ids)
                    np.put_along_axis(seen, first, True, 1)
                    beyond = (near > self._bound(who)) | seen
                at = np.flatnonzero(~beyond)
                self._take(who[at // len(rows)], at % len(rows), rows, ids)

    def _take(self, q: np.ndarray, r: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        """Pairs of a query and a row: what is better than the worst place held takes its place."""
        for part in chunks(len(q), rows.shape[1]):
            who, i = q[part], ids[r[part]]
            gap = self.x[who] - rows[r[part]]
            gap *= gap
            d = np.zeros(len(who))
            for axis in range(rows.shape[1]):
                d += gap[:, axis]
            worst = self.d[who, -1]
            keep = (np.isnan(worst) | (d < worst) | ((d == worst) & (i < self.i[who, -1]))) & ~(d > self.limit[who])
            if not keep.any():
                continue
            who, d, i = who[keep], d[keep], i[keep]
            old = np.unique(who)
            who, d, i = np.r_[np.repeat(old, self.k), who], np.r_[self.d[old].ravel(), d], np.r_[self.i[old].ravel(), i]
            order = np.lexsort((i, d, who))
            starts = np.flatnonzero(np.diff(who[order], prepend=-1))
            best = order[starts[:, None] + np.arange(self.k)]
            self.d[old], self.i[old] = d[best], i[best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries' indices, ids and squared distances."""
        taken = np.flatnonzero((~np.isnan(self.d) | (self.i < np.iinfo(np.int64).max)).ravel())
        return taken // self.k, self.i.ravel()[taken], self.d.ravel()[taken]


def nearest(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, d2): of each query (qid, features) the k rows of data (id, features) at the least squared distance, ties by id.

    A grid of queries and rows; a cell keeps its own k best for each query, and k rows a query and line are shuffled.
    """
    def update(state: dict, x: np.ndarray, batch: dict) -> None:
        if "best" not in state:
            state["best"] = _Best(x, k)
        state["best"].offer(matrix(batch["features"]), batch["id"].to_numpy())

    def finish(state: dict, x: np.ndarray) -> tuple:
        return state["best"].found()

    found = against_all(queries, data.select(F.col("id").cast("bigint").alias("id"), "features"), update, finish, ["id", "d2"], "id bigint, d2 double")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("d2", "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("qid", "rank", "id", "d2")


def classify(queries: DataFrame, data: DataFrame, k: int, label: str = "label") -> DataFrame:
    """(qid, predicted): the label most of the k nearest rows have; the smallest label wins ties."""
    near = nearest(queries, data, k).join(data.select(F.col("id").alias("_id"), F.col(label).alias("_label")), F.col("id") == F.col("_id"))
    votes = near.groupBy("qid", "_label").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "_label"))
    return votes.withColumn("_p", place).filter("_p = 1").select("qid", F.col("_label").alias("predicted"))


#: Rows of a subtree that one task finishes, about; rows that the driver takes at most to settle the halves of a level.
SUBTREE, SAMPLE = 100_000, 65_536
#: Queries that meet the rows of a leaf in one task.
LEAF_QUERIES = 4_096


def _split(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The direction along which rows split, and their order by it, ids at ties: from the row of the least id the farthest row, from that one the farthest in turn, and the line between the two."""
    far = lambda origin: x[np.lexsort((ids, -sqdist_rows(x, origin[None])[:, 0]))[0]]
    one = far(x[np.argmin(ids)])
    line = one - far(one)
    return line, np.lexsort((ids, _along(x, line)))


def _along(x: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Projections of rows on a line, or of each row on its own, summed coordinate by coordinate."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * line[..., d]
    return out


def _subtree(x: np.ndarray, ids: np.ndarray, root: int, least: int) -> tuple[list[tuple], np.ndarray]:
    """Nodes (node, n, center, radius2, leaf) below and with root, and the leaf of each row."""
    nodes, leaf, todo = [], np.zeros(len(x), np.int64), [(root, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        rows = x[at]
        centre = rows.mean(axis=0)
        small = len(at) < least
        nodes.append((node, len(at), centre, float(sqdist_rows(rows, centre[None]).max()), small))
        if small:
            leaf[at] = node
            continue
        order = at[_split(rows, ids[at])[1]]
        todo += [(2 * node, order[: len(at) // 2]), (2 * node + 1, order[len(at) // 2 :])]
    return nodes, leaf


#: Of each level its nodes' lines and first rows to the right, as words of place and id: a row goes right if its words are not below these.
Routes = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _words(place: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and ids as unsigned integers of the same order; nan comes last."""
    bits = (place + 0.0).view(np.int64)
    bits = np.where(np.isnan(place), np.iinfo(np.int64).max, np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits))
    top = np.uint64(1 << 63)
    return bits.view(np.uint64) ^ top, ids.astype(np.int64).view(np.uint64) ^ top


def _descend(x: np.ndarray, ids: np.ndarray, routes: Routes) -> np.ndarray:
    """The node that each row comes to."""
    node = np.ones(len(x), np.int64)
    for lines, places, cuts in routes:
        at = node - len(lines)
        place, key = _words(_along(x, lines[at]), ids)
        node = 2 * node + ((place > places[at]) | ((place == places[at]) & (key >= cuts[at])))
    return node


def _farthest(data: DataFrame, routes: Routes, origins: np.ndarray | None) -> np.ndarray:
    """Of each node of the level below routes the row farthest from its origin, the least id at ties; without origins the row of the least id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            if batch.num_rows:
                x, ids = matrix(batch.column("features")), batch.column("id").to_numpy()
                node = _descend(x, ids, routes)
                score = np.zeros(len(x))
                if origins is not None:
                    for d in range(x.shape[1]):
                        score -= (x[:, d] - origins[node - len(origins), d]) ** 2
                order = np.lexsort((ids, score, node))
                for i in order[np.flatnonzero(np.diff(node[order], prepend=0))]:
                    found = (bool(np.isnan(score[i])), float(score[i]), int(ids[i]))
                    if node[i] not in best or found < best[node[i]][0]:
                        best[node[i]] = found, x[i].tolist()
        found = [(int(n), *at, x) for n, (at, x) in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found) if found else [[]] * 5, (pa.int64(), pa.bool_(), pa.float64(), pa.int64(), pa.list_(pa.float64())))], ["node", "nan", "score", "id", "features"])

    rows = data.mapInArrow(run, "node bigint, nan boolean, score double, id bigint, features array<double>").groupBy("node").agg(F.min_by("features", F.struct("nan", "score", "id")).alias("x")).collect()
    out = np.zeros((1 << len(routes), len(rows[0]["x"])))
    for r in rows:
        out[r["node"] - len(out)] = r["x"]
    return out


def _middles(data: DataFrame, routes: Routes, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each node of the level below routes the words of its middle row by place on its line, ids at ties: as many rows are below it as half the node's, rounded down.

    Rows are counted by 16 bits of their words at a time, the highest first, among those that agree with the middle row in the bits before. Once no more than SAMPLE rows are left
    in all nodes, the driver takes their words. A node's counts, 65,536 at most, are added up in a window; one of them reaches the driver.
    """
    spark, nodes = data.sparkSession, len(lines)
    words, left = np.zeros((2, nodes), np.uint64), None

    def agreeing(batch: pa.RecordBatch, digits: int) -> tuple[np.ndarray, list[np.ndarray]]:
        x, ids = matrix(batch.column("features")), batch.column("id").to_numpy()
        at = _descend(x, ids, routes) - nodes
        own = np.stack(_words(_along(x, lines[at]), ids))
        for word in range(2):
            if known := min(4, max(0, digits - 4 * word)):
                same = (own[word] ^ words[word, at]) >> np.uint64(64 - 16 * known) == 0
                at, own = at[same], own[:, same]
        return at, list(own)

    def count(digits: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    at, own = agreeing(batch, digits)
                    digit = (own[digits // 4] >> np.uint64(48 - 16 * (digits % 4)) & np.uint64(0xFFFF)).astype(np.int64)
                    key, n = np.unique(at << 16 | digit, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key >> 16), pa.array(key & 0xFFFF), pa.array(n.astype(np.int64))], ["node", "digit", "n"])

        return data.mapInArrow(run, "node bigint, digit bigint, n bigint").groupBy("node", "digit").agg(F.sum("n").alias("n"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, own = agreeing(batch, digits)
                yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(w.view(np.int64)) for w in own]], ["node", "place", "id"])

    for digits in range(8):
        if left is not None and sum(n for n, _ in left.values()) <= SAMPLE:
            found: dict[int, list] = {}
            for r in data.mapInArrow(take, "node bigint, place bigint, id bigint").collect():
                found.setdefault(r["node"], []).append((r["place"] % (1 << 64), r["id"] % (1 << 64)))
            for node, (_, rank) in left.items():
                words[:, node] = sorted(found[node])[rank]
            return words[0], words[1]
        counts = count(digits).withColumn("to", F.sum("n").over(Window.partitionBy("node").orderBy("digit")))
        if left is None:
            counts = counts.withColumn("rank", F.floor(F.sum("n").over(Window.partitionBy("node")) / 2))
        else:
            counts = counts.join(F.broadcast(spark.createDataFrame([(node, rank) for node, (_, rank) in left.items()], "node bigint, rank bigint")), "node")
        left = {}
        for r in counts.filter("to > rank and to - n <= rank").collect():
            words[digits // 4, r["node"]] |= np.uint64(r["digit"] << 48 - 16 * (digits % 4))
            left[r["node"]] = r["n"], r["rank"] - (r["to"] - r["n"])
    return words[0], words[1]


def _halves(data: DataFrame, depth: int) -> Routes:
    """The splits of all nodes above depth, exactly as _split() has them, over all rows."""
    routes: Routes = []
    for _ in range(depth):
        one = _farthest(data, routes, _farthest(data, routes, None))
        lines = one - _farthest(data, routes, one)
        routes = [*routes, (lines, *_middles(data, routes, lines))]
    return routes


@dataclass(frozen=True)
class Tree:
    """nodes: (node, parent, depth, n, center, radius2, leaf), the root being node 1, the children of a node 2n and 2n + 1; rows: (id, features, leaf), leaf being the node that holds the row."""

    nodes: DataFrame
    rows: DataFrame


def grow(data: DataFrame, min_split: int | None = None) -> Tree:
    """A ball tree over data (id, features). A node of fewer than min_split rows (by default the root of all rows' number, rounded up) is a leaf; ids tell rows apart.

    Otherwise the row of the least id gives the farthest row from it, that one its farthest row in turn, and rows split at the middle place of their projection on the
    line between the two, ids at ties, the odd row to the right. A subtree of SUBTREE rows or so is finished by one task. What is above is split level by level by aggregations over all rows,
    six passes or so a level; the driver holds two rows and one place of each of these nodes. All rows are written once, shuffled once and written once more, whatever
    the depth; the upper nodes' centres are sums of their subtrees', and one more pass has their radii.
    """
    data = data.select(F.col("id").cast("bigint").alias("id"), "features")
    n = data.count()
    least = min_split or max(2, math.ceil(math.sqrt(n)))
    depth = max(0, math.ceil(math.log2(max(1, n) / max(SUBTREE, least))))
    if depth:
        tasks = 2 * data.sparkSession.sparkContext.defaultParallelism
        data = written(data if data.rdd.getNumPartitions() >= tasks else data.repartition(tasks, "id"), "points")
    routes = _halves(data, depth)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = _descend(matrix(batch.column("features")), batch.column("id").to_numpy(), routes)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("features"), pa.array(node)], ["id", "features", "node"])

    names, schema = ["id", "features", "leaf", "n", "radius2", "small"], "id bigint, features array<double>, leaf bigint, n bigint, radius2 double, small boolean"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, features, leaf), and nodes with the node in leaf, no id, and the centre in features."""
        def out(root: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            x, ids = matrix(t.column("features")), t.column("id").to_numpy()
            nodes, leaf = _subtree(x, ids, root, least)
            none = pa.nulls(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids), t.column("features").combine_chunks(), pa.array(leaf), none.cast(pa.int64()), none.cast(pa.float64()), none.cast(pa.bool_())], names)
            node, count, centre, radius2, small = zip(*nodes)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(node)).cast(pa.int64()), pa.array([c.tolist() for c in centre], pa.list_(pa.float64())), pa.array(node, pa.int64()), pa.array(count, pa.int64()), pa.array(radius2), pa.array(small)], names)

        held, at = [], None
        for batch in batches:
            node = batch.column("node").to_numpy()
            cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and node[a] != at:
                    yield from out(at, held)
                    held = []
                at = int(node[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from out(at, held)

    tasks = min(1 << depth, 20_000)
    routed = data.mapInArrow(route, "id bigint, features array<double>, node bigint").repartitionById(tasks, F.pmod("node", F.lit(tasks)).cast("int")).sortWithinPartitions("node")
    both = written(routed.mapInArrow(finish, schema), "tree")
    rows = both.filter("id is not null").select("id", "features", "leaf")
    lower = both.filter("id is null").select(F.col("leaf").alias("node"), "n", F.col("features").alias("center"), "radius2", F.col("small").alias("leaf"))
    nodes = lower.unionByName(_upper(lower, rows, depth)) if depth else lower
    level = F.length(F.bin("node")) - 1
    return Tree(nodes.select("node", F.when(F.col("node") > 1, F.shiftright("node", 1)).alias("parent"), level.alias("depth"), "n", "center", "radius2", "leaf"), rows)


def _upper(lower: DataFrame, rows: DataFrame, depth: int) -> DataFrame:
    """The nodes above the subtrees: exact numbers, centres and radii over all their rows."""
    roots = lower.filter((F.col("node") >= 1 << depth) & (F.col("node") < 2 << depth))
    above = roots.select(F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("up"), "node", "n", F.posexplode("center").alias("d", "m")).select(F.expr("shiftright(node, up)").alias("node"), "n", "d", "m")
    by_axis = above.groupBy("node", "d").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"))
    centres = written(by_axis.groupBy("node").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("center")), "tree-upper")
    held = {r["node"]: np.array(r["center"]) for r in centres.collect()}  # a node for each pair of subtrees

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, float] = {}
        for batch in batches:
            if batch.num_rows:
                x, leaf = matrix(batch.column("features")), batch.column("leaf").to_numpy()
                above = leaf >> (np.floor(np.log2(leaf)).astype(np.int64) - depth)
                for up in range(1, depth + 1):
                    for node in np.unique(above >> up).tolist():
                        gap = float(sqdist_rows(x[above >> up == node], held[node][None]).max())
                        most[node] = max(most.get(node, 0.0), gap)
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int64()), pa.array(list(most.values()), pa.float64())], ["node", "r"])

    radius = rows.select("features", "leaf").mapInArrow(far, "node bigint, r double").groupBy("node").agg(F.max("r").alias("radius2"))
    return centres.join(radius, "node").select("node", "n", "center", "radius2", F.lit(False).alias("leaf"))


def ball_tree(data: DataFrame, min_split: int | None = None) -> DataFrame:
    """The nodes of grow()."""
    return grow(data, min_split).nodes


@dataclass(frozen=True)
class Search:
    """found: (qid, rank, id, d2), as nearest() has it; pairs: how many pairs of a query and a row balls did not exclude, of how many there are."""

    found: DataFrame
    pairs: int
    of: int


def search(queries: DataFrame, tree: Tree, k: int) -> Search:
    """The k nearest rows of each query (qid, features), exactly, by the leaves of a tree.

    A first pass over (query, leaf) has of each query the leaf nearest to it, and a distance within which leaves are sure to hold k rows. That leaf's rows give the distance of the kth best so far.
    Queries of neighbouring leaves then share a column of a grid. A second pass has the leaves whose ball comes as near as that to one of a column's queries; these leaves' rows go to the column, where
    the balls of a leaf's rows choose the queries that meet them. So rows are dealt out once for each column at most, however few leaves are excluded, and no pair of a query and a leaf is written.
    """
    leaves = written(tree.nodes.filter("leaf").select(F.col("node").alias("id"), F.col("center").alias("features"), F.sqrt("radius2").alias("radius"), "n"), "leaves")
    asked = written(queries.select(F.col("qid").cast("bigint").alias("qid"), "features"), "asked")
    first = written(_nearest_leaves(asked, leaves, k), "first")
    columns, total = query_columns(asked), asked.count()
    along = Window.partitionBy().orderBy(F.expr("shiftleft(leaf, 63 - length(bin(leaf)))"), "leaf").rowsBetween(Window.unboundedPreceding, -1)  # a row for each leaf
    starts = first.groupBy("leaf").agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.coalesce(F.sum("m").over(along), F.lit(0)))
    column = F.floor((F.col("before") + F.pmod(F.xxhash64("qid"), F.col("m"))) * columns / max(1, total)).cast("int").alias("column")
    limit = F.least("kth", F.col("sure") * F.col("sure") * (1 + 1e-9)).alias("limit")
    limits = first.join(_kth(asked, tree.rows, first.select("qid", "leaf"), k), "qid", "left").join(starts, "leaf").select("qid", limit, column)
    dealt = written(asked.join(limits, "qid").select("qid", F.concat("features", F.array("limit", F.col("column").cast("double"))).alias("features"), "column"), "dealt")
    met = written(_leaves_met(dealt, leaves, columns), "met")
    rows = tree.rows.join(met.groupBy("leaf").agg(F.collect_list("column").alias("columns")), "leaf")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("d2", "id"))
    found = _read(dealt, rows, columns, k).withColumn("rank", place).filter(F.col("rank") <= k).select("qid", "rank", "id", "d2")
    size = leaves.select(F.col("id").alias("leaf"), "n")
    pairs = met.select("leaf", "asks").unionByName(first.select("leaf", F.lit(1).cast("bigint").alias("asks"))).join(size, "leaf").agg(F.sum(F.col("n") * F.col("asks"))).first()[0] or 0
    count = leaves.agg(F.sum("n")).first()[0] or 0
    return Search(found, pairs, count * total)


def _gaps(x: np.ndarray, batch: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distances of queries from centres, and radii, with a margin for rounding."""
    d, r = np.sqrt(sqdist_rows(x, matrix(batch["features"]))), batch["radius"].to_numpy()
    return d, r + 1e-9 * (1 + r + d)


def _nearest_leaves(asked: DataFrame, leaves: DataFrame, k: int) -> DataFrame:
    """(qid, leaf, sure): the leaf of the nearest centre, and the least distance within which the leaves seen at once hold k rows for sure; infinite if they never do."""
    def update(state: dict, x: np.ndarray, batch: dict) -> None:
        best = state.setdefault("best", [np.full(len(x), np.inf), np.zeros(len(x), np.int64), np.full(len(x), np.inf)])
        ids, n = batch["id"].to_numpy(), batch["n"].to_numpy()
        by_id = np.argsort(ids)
        for q in chunks(len(x), len(ids)):
            d, r = _gaps(x[q], batch)
            at = by_id[np.where(np.isnan(d), np.inf, d)[:, by_id].argmin(axis=1)]
            near = d[np.arange(len(d)), at]
            closer = (near < best[0][q]) | ((near == best[0][q]) & (ids[at] < best[1][q]))
            best[0][q], best[1][q] = np.where(closer, near, best[0][q]), np.where(closer, ids[at], best[1][q])
            far = np.where(np.isnan(d + r), np.inf, d + r)
            if (n >= k).all():
                sure = far.min(axis=1)
            else:
                order = np.argsort(far, axis=1, kind="stable")
                enough = np.cumsum(n[order], axis=1) >= k
                sure = np.where(enough.any(axis=1), np.take_along_axis(far, order, 1)[np.arange(len(d)), enough.argmax(axis=1)], np.inf)
            best[2][q] = np.minimum(best[2][q], sure)

    def finish(state: dict, x: np.ndarray) -> tuple:
        d, leaf, sure = state["best"]
        return np.arange(len(x)), leaf, d, sure

    each = against_all(asked, leaves, update, finish, ["leaf", "d", "sure"], "leaf bigint, d double, sure double")
    return each.groupBy("qid").agg(F.min_by("leaf", F.struct("d", "leaf")).alias("leaf"), F.min("sure").alias("sure"))


def _leaves_met(dealt: DataFrame, leaves: DataFrame, columns: int) -> DataFrame:
    """(column, leaf, asks): of each column of queries (qid, features with limit and column, column) the leaves whose balls come as near as the limit to some of them, and to how many."""
    def update(state: dict, x: np.ndarray, batch: dict) -> None:
        if "best" not in state:
            state |= {"best": _Best(x[:, :-2], 1, x[:, -2]), "asks": []}
        state["asks"].append((batch["id"].to_numpy(), state["best"].reached(matrix(batch["features"]), batch["radius"].to_numpy()).sum(axis=0)))

    def finish(state: dict, x: np.ndarray) -> tuple:
        leaf, asks = (np.concatenate(c) for c in zip(*state["asks"]))
        met = asks > 0
        return np.zeros(met.sum(), np.int64), np.full(met.sum(), int(x[0, -1]), np.int32), leaf[met], asks[met].astype(np.int64)

    return against_all(dealt, leaves, update, finish, ["column", "leaf", "asks"], "column int, leaf bigint, asks bigint", columns).select("column", "leaf", "asks")


def _read(dealt: DataFrame, rows: DataFrame, columns: int, k: int) -> DataFrame:
    """(qid, id, d2): of each query the k best rows within its limit that each cell has; rows (id, features, leaf, columns) go to the columns that meet their leaf."""
    def update(state: dict, x: np.ndarray, batch: dict) -> None:
        if "best" not in state:
            state["best"] = _Best(x[:, :-2], k, x[:, -2])
        best, ids, leaf, data = state["best"], batch["id"].to_numpy(), batch["leaf"].to_numpy(), matrix(batch["features"])
        cuts = [0, *(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1).tolist(), len(leaf)]
        with np.errstate(all="ignore"):
            centres = np.stack([data[a:b].mean(axis=0) for a, b in zip(cuts, cuts[1:])])
            radii = np.array([np.sqrt(sqdist_rows(data[a:b], c[None]).max()) for a, b, c in zip(cuts, cuts[1:], centres)]) * (1 + 1e-9)
        reached = best.reached(centres, radii)
        if reached.mean() > 0.5:  # balls exclude little
            best.offer(data, ids)
            return
        for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if len(asks := np.flatnonzero(reached[:, j])):
                best.offer(data[a:b], ids[a:b], asks)

    def finish(state: dict, x: np.ndarray) -> tuple:
        return state["best"].found()

    return against_all(dealt, rows.select("id", "features", "leaf", "columns"), update, finish, ["id", "d2"], "id bigint, d2 double", columns, "leaf")


def _kth(asked: DataFrame, rows: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(qid, kth): the squared distance of the kth best row of the leaf that pairs (qid, leaf) have of each query, nan if it has fewer. A leaf that many queries ask meets them in parts of LEAF_QUERIES or so."""
    parts = written(pairs.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(LEAF_QUERIES)).alias("parts")), "parts")
    cell = F.xxhash64("leaf", "part").alias("cell")
    left = pairs.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts"))).join(asked, "qid").select(cell, F.lit(0).alias("side"), F.col("qid").alias("id"), "features")
    right = rows.join(parts, "leaf").select("leaf", "id", "features", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")).select(cell, F.lit(1).alias("side"), "id", "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def worst(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            side, ids, x = t.column("side").to_numpy(), t.column("id").to_numpy(), matrix(t.column("features"))
            asks, has = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            best = _Best(x[asks], k)
            if len(has):
                best.offer(x[has], ids[has])
            yield pa.RecordBatch.from_arrays([pa.array(ids[asks]), pa.array(best.d[:, -1])], ["qid", "kth"])

        held, at = [], None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and cells[a] != at:
                    yield from worst(held)
                    held = []
                at = cells[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from worst(held)

    return left.unionByName(right).repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(run, "qid bigint, kth double")
