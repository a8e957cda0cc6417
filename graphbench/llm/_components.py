"""Connected components over an edge DataFrame: alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize, ready, spread_join


class UnionFind:
    """Disjoint sets whose root is the smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.up.setdefault(min(x, y), min(x, y))
        return True


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch of edges as stars around its local roots; the batch bounds memory."""
    for pdf in batches:
        uf = UnionFind()
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            uf.union(a, b)
        rows = [(v, uf.find(v)) for v in list(uf.up)]
        yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"], dtype="int64")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the edges (a, b): component is the smallest id reachable.

    Nulls and self-loops are ignored; ids without a link to another id have no row. Each round is two
    pre-aggregated minima and two joins, whose hot ids are dealt to parts; edges are reduced within each batch first and
    written between rounds, so a lost executor costs one round at most. Rounds go on until nothing changes.
    """
    ready(edges.sparkSession)
    clean = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    e = materialize(clean.mapInPandas(_forest, "a long, b long"), "edges")

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen, now = None, state(e)
    while now[0] and now != seen:
        sym = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = spread_join(sym, low, ["a"], "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        done = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(e)
        e, seen, now = done, now, state(done)
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
