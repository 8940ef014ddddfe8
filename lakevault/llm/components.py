"""Connected components of a graph given as edges, by alternating star operations on DataFrames.

An edge (u, v) points from a node to a smaller one. Before the first round each task contracts its own edges to a forest.
Each round first lets every node point its larger neighbours to its smallest one (large star), then its smaller
neighbours and itself (small star), and contracts what a task holds again. Rounds end once stars are left; their number
grows with the logarithm of a component's size. A star is one window over one shuffle; no step makes more edges than it got.

Nodes with a large share of all edges are never in one window. One sum before each round finds them, with their smallest
neighbours. In the large star their edges take that from a broadcast; in the small star they are dealt out to SALTS windows,
which leave them SALTS edges at most. There are 2 / SHARE such nodes at most, as the sum of all neighbours is twice the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakevault.llm.common import SALTS, SHARE, dropped, saved

#: Edges a task contracts at a time.
BLOCK = 1 << 18
#: A node with fewer neighbours is never dealt out; above SALTS, so that a node that was isn't for ever.
LEAST = 1024


class Forest:
    """Disjoint sets; the smallest member is the root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        r = x
        while (y := up.get(r, r)) != r:
            r = y
        while (y := up.get(x, x)) != r:
            up[x], x = r, y
        return r

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        a, b = (a, b) if a < b else (b, a)
        self.up[b] = a
        self.up.setdefault(a, a)
        return True

    def stars(self) -> list[tuple]:
        return [(x, r) for x in list(self.up) if (r := self.root(x)) != x]


def contracted(kind: str):
    arrow = pa.string() if kind == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, n = Forest(), 0

        def out():
            stars = forest.stars()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in stars], arrow), pa.array([y for _, y in stars], arrow)], names=["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
            n += batch.num_rows
            if n > BLOCK:
                yield out()
                forest, n = Forest(), 0
        yield out()

    return run


def both_ways(edges: DataFrame) -> DataFrame:
    """k, x: each edge from both of its ends."""
    return edges.select(F.col("u").alias("k"), F.col("v").alias("x")).unionByName(edges.select(F.col("v").alias("k"), F.col("u").alias("x")))


def surveyed(edges: DataFrame) -> tuple[bool, DataFrame]:
    """Whether the edges are stars (each u has one v, and no v is a u), and hot, m, above of the nodes to deal out.

    m is the smallest neighbour, or the node itself; above says whether so many of its neighbours are smaller ones.
    """
    limit = max(edges.count() * SHARE, LEAST)
    up = F.when(F.col("x") < F.col("k"), F.col("x"))
    per = both_ways(edges).groupBy("k").agg(F.min(up).alias("lo"), F.max(up).alias("hi"), F.count(up).alias("n_up"), F.count("*").alias("n"))
    done = F.col("lo").isNull() | ((F.col("lo") == F.col("hi")) & (F.col("n_up") == F.col("n")))
    hot = F.struct(F.col("k").alias("hot"), F.least("lo", "k").alias("m"), (F.col("n_up") > limit).alias("above"))
    found = per.agg(F.coalesce(F.bool_and(done), F.lit(True)).alias("done"), F.collect_list(F.when(F.col("n") > limit, hot)).alias("hot")).first()
    kind = edges.schema["u"].dataType.simpleString()
    return found["done"], edges.sparkSession.createDataFrame(found["hot"], f"hot {kind}, m {kind}, above boolean")


def large_star(edges: DataFrame, hot: DataFrame) -> DataFrame:
    met = both_ways(edges).join(F.broadcast(hot.select("hot", F.col("m").alias("known"))), F.col("k") == F.col("hot"), "left")
    larger, least = F.col("x") > F.col("k"), F.least("k", F.min("x").over(Window.partitionBy("k")))
    rest = met.where("hot IS NULL").select("k", "x").withColumn("m", least).where(larger)
    return rest.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(met.where(F.col("hot").isNotNull() & larger).select(F.col("x").alias("u"), F.col("known").alias("v")))


def small_star(edges: DataFrame, hot: DataFrame) -> DataFrame:
    """Each edge gives one: that to the smallest neighbour stays, and other neighbours point to it."""
    dealt = edges.join(F.broadcast(hot.where("above").select("hot")), F.col("u") == F.col("hot"), "left")
    salt = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0)
    least = F.min("v").over(Window.partitionBy("u", "salt"))
    return dealt.select("u", "v", salt.alias("salt")).withColumn("m", least).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, kind: str = "bigint") -> DataFrame:
    """node, root for every node that has an edge to another node; edges: two columns of type kind, nulls and loops are left out. root is the smallest node."""
    a, b = edges.columns
    forest = contracted(kind)
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = saved(edges.mapInArrow(forest, f"u {kind}, v {kind}"), "edges")
    while True:
        done, hot = surveyed(edges)
        if done:
            break
        stars = small_star(large_star(edges, hot), hot)
        before, edges = edges, saved(stars.mapInArrow(forest, f"u {kind}, v {kind}"), "edges")
        dropped(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
