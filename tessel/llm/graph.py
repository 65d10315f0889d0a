"""Connected components of a table of links, by alternating large and small stars, in DataFrame operations alone.

A component ends as a star around its least node; the joins deal that node's links over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import Saved, dealt_join


#: Links of a node that one task may have; where a node has more, joins deal them.
HOT = 50_000


def _least(links: DataFrame, hot: bool) -> DataFrame:
    """links (a, b, open), each pair once, with m, the least of each a, its b's included. open is whether any of a pair's rows is."""
    if hot:
        once = links.groupBy("a", "b").agg(F.max("open").alias("open"))
        return dealt_join(once, ["a"], once.groupBy("a").agg(F.min("b").alias("m")), "b")
    around = Window.partitionBy("a").orderBy("b", F.desc("open"))
    met = links.withColumn("m", F.first("b").over(around.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_before", F.lag("b").over(around))
    return met.filter("_before is null or _before <> b").drop("_before")


def _large(edges: DataFrame, hot: bool) -> DataFrame:
    """Every neighbour above a node is linked to the least node around it. A link is open if the node has neighbours on either side."""
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).withColumn("open", F.lit(False))
    return _least(both, hot).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"), (F.col("m") < F.col("a")).alias("open"))


def _small(edges: DataFrame, hot: bool) -> DataFrame:
    """Every neighbour below a node, and the node, is linked to the least of them: one link for each of edges, which run from the larger to the smaller node. A link is open if it was, or if the node has several neighbours below."""
    return _least(edges, hot).select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"), (F.col("open") | (F.col("b") > F.col("m"))).alias("open"))


def _hot(edges: DataFrame) -> bool:
    """Whether a node has more than HOT links."""
    if edges.count() <= HOT:
        return False
    ends = edges.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    return ends.agg(F.max("n")).first()[0] > HOT


def stars(links: DataFrame, name: str = "components") -> Saved:
    """(node, component) of every node of links (a, b), both longs, but the components' own; component is the smallest node that links reach.

    Links of a node to itself and null ends count for nothing. Each round shrinks the links to stars around smaller nodes and says by open whether
    it met anything but stars; one that met none has left them as they are.
    """
    now = Saved(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), name)
    more = True
    while more:
        hot = _hot(now.df)
        after = Saved(_small(_large(now.df, hot), hot), name)
        now.drop()
        now, more = after, after.df.agg(F.max("open")).first()[0]
    now.df = now.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return now


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of links (a, b); see stars()."""
    ends = stars(links, name).df
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())


class Stars:
    """Components that grow: (node, component) in df, after the links added so far, of all nodes but the components' own."""

    def __init__(self, links: DataFrame, name: str = "stars"):
        self.name = name
        self.saved = stars(links, name)

    @property
    def df(self) -> DataFrame:
        return self.saved.df

    def add(self, links: DataFrame) -> None:
        """links (a, b) join components."""
        after = stars(self.df.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links), self.name)
        self.saved.drop()
        self.saved = after
