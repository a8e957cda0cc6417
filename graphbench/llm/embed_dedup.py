"""Exact near-duplicate vectors: a metric range join over pivot cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, materialize, ready, require, spread_join
from ._components import connected_components

#: Rounding room when the triangle inequality decides that a vector can be left out of a cell.
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cells_of(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, reach): the nearest pivot of each unit vector; reach[i, j] is true if a vector of home cell j may be within radius.

    If y's nearest pivot is p_j and d(x, y) <= r then d(x, p_j) <= d(y, p_j) + r <= d(y, p_i) + r <= d(x, p_i) + 2 r; and x lies
    within r of the half-space nearer to p_j than to its own pivot, which is the tighter test between two pivots.
    """
    d2 = np.maximum(0, 2 - 2 * x @ pivots.T)
    home = d2.argmin(axis=1)
    near = d2[np.arange(len(x)), home]
    gap = np.sqrt(np.maximum(0, 2 - 2 * pivots[home] @ pivots.T))
    reach = (np.sqrt(d2) <= np.sqrt(near)[:, None] + 2 * radius + SLACK) & (d2 - near[:, None] <= 2 * radius * gap + SLACK)
    reach[np.arange(len(x)), home] = True
    return home, reach


def _assign(pivots_b, radius: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for label, g in pdf.groupby("label", sort=False):
                pivots = pivots_b.value.get(label)
                x = unit(np.stack(g["embedding"].to_numpy()).astype(np.float64))
                home, reach = (np.zeros(len(g), int), np.ones((len(g), 1), bool)) if pivots is None else cells_of(x, pivots, radius)
                row, cell = np.nonzero(reach)
                yield pd.DataFrame({"label": label, "cell": cell, "vec_id": g["vec_id"].to_numpy()[row], "home": cell == home[row]})

    return run


def _join(threshold: float, chunk: int = 512):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Counts of home vectors against all of the cell block, and a spanning forest of the links."""
        own, all_ = pdf[pdf["own"]], pdf[pdf["against"]]
        if own.empty or all_.empty:
            return pd.DataFrame({"vec_id": [], "links": [], "root": []}, dtype="int64")
        x, y = (np.stack(d["embedding"].to_numpy()).astype(np.float64) for d in (own, all_))
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        ids, other, copies = own["vec_id"].to_numpy(), all_["vec_id"].to_numpy(), all_["copies"].to_numpy()
        nodes = np.unique(np.concatenate((ids, other)))
        mine, theirs, comp, links = np.searchsorted(nodes, ids), np.searchsorted(nodes, other), np.arange(len(nodes)), np.zeros(len(x), np.int64)
        for at in range(0, len(x), chunk):
            hit = (x[at : at + chunk] @ y.T) / nx[at : at + chunk, None] / ny >= threshold
            hit &= ids[at : at + chunk, None] != other
            links[at : at + chunk] = hit @ copies
            for i in np.flatnonzero(hit.any(axis=1)):
                met = np.unique(np.append(comp[theirs[hit[i]]], comp[mine[at + i]]))
                if len(met) > 1:  # node numbers follow the ids, so the least number is the least id
                    comp[np.isin(comp, met)] = met[0]
        n = np.zeros(len(nodes), np.int64)
        n[mine] = links
        shown = (comp != np.arange(len(nodes))) | (n > 0)
        return pd.DataFrame({"vec_id": nodes[shown], "links": n[shown], "root": nodes[comp[shown]]})

    return run


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.93, cell_rows: int = 2048, max_pivots: int = 20_000, block_rows: int = 2048, part_rows: int = 200_000, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Vectors of equal non-null labels and equal length link when their cosine, in double precision, is at least the threshold. Vectors that
    are null, empty, zero, or hold null or non-finite components link with nothing, as do those of a null
    label. component_id is the smallest vec_id reachable. Rows of a null id are left out; rows that repeat an id
    count once (by the smallest label, then vector). Empty tables give no rows; other columns are ignored.

    Equal vectors of a label collapse first, a group in parts of about part_rows, told by 128 bits of hash, and are counted, not compared. Pivots are a hash sample of about one
    for cell_rows distinct vectors of each label, max_pivots and 256 MB in all, where larger tables have larger cells; unit vectors join the cell of their nearest
    pivot, and by the triangle inequality also every cell that may hold a partner. Each cell, in blocks of block_rows, counts the
    links of its home vectors, so no pair is counted twice, none is missed and no pairs are emitted.
    """
    spark = ready(vectors.sparkSession)
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    base = require(vectors, id_col, vec_col, label_col).toDF("vec_id", "embedding", "label").where("vec_id is not null")
    v = base.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), "label")
    v = v.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("s")).select("vec_id", "s.*")
    fit = F.col("label").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = materialize(v.withColumn("ok", F.coalesce(fit, F.lit(False))).withColumn("dim", F.size("embedding")), "vectors")
    good = v.where("ok").withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    equal, parts = ["label", "dim", "h1", "h2"], max(64, -(-v.count() // part_rows))
    dealt = good.select("vec_id", "label", "dim", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding").alias("h2"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(parts)))
    least = dealt.groupBy(*equal, "part").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    group = Window.partitionBy(*equal)
    least = least.withColumn("rep", F.min("rep").over(group)).withColumn("copies", F.sum("copies").over(group))
    member = materialize(dealt.join(least, [*equal, "part"]).select("vec_id", "rep", "copies"), "members")
    heads = materialize(good.join(member.where("vec_id = rep").drop("rep"), "vec_id").select("label", "dim", "embedding", F.col("vec_id").alias("rep"), "copies"), "distinct")
    total, dim = heads.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()

    most = max(1, min(max_pivots, (256 << 20) // (8 * dim)))
    chance = F.pmod(F.xxhash64("rep", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    got = heads.where(chance < 1.0 / max(cell_rows, total / most)).select("label", "dim", "embedding", "rep").orderBy("rep").limit(2 * most).collect()
    table: dict = {}
    for r in got:
        table.setdefault(f"{r['label']}|{r['dim']}", []).append(r["embedding"])
    table = {k: unit(np.asarray(p, np.float64)) for k, p in table.items()}
    pivots = spark.sparkContext.broadcast(table)

    group = F.concat_ws("|", F.col("label").cast("string"), F.col("dim").cast("string"))
    reps = heads.select(F.col("rep").alias("vec_id"), "embedding", "copies", group.alias("label"))
    cells = reps.select("vec_id", "embedding", "label").mapInPandas(_assign(pivots, radius), "label string, cell int, vec_id long, home boolean")
    cells = materialize(cells, "cells")
    count = cells.groupBy("label", "cell").agg(F.count_if("home").alias("h"), F.count("*").alias("a")).where("h > 0")
    count = count.select("label", "cell", F.ceil(F.col("h") / block_rows).cast("int").alias("nh"), F.ceil(F.col("a") / block_rows).cast("int").alias("na"))
    dealt = cells.join(count, ["label", "cell"])
    mark = F.xxhash64("vec_id", F.lit(3))
    bi, bj = F.pmod(mark, F.col("nh")).cast("int"), F.pmod(mark, F.col("na")).cast("int")
    grid = F.array_union(
        F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda j: F.struct(bi.alias("bi"), j.cast("int").alias("bj")))).otherwise(F.array().cast("array<struct<bi:int,bj:int>>")),
        F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda i: F.struct(i.cast("int").alias("bi"), bj.alias("bj"))),
    )
    dealt = dealt.withColumn("g", F.explode(grid)).select("label", "cell", "vec_id", "g.bi", "g.bj", (F.col("home") & (bi == F.col("g.bi"))).alias("own"), (bj == F.col("g.bj")).alias("against"))
    joined = dealt.join(reps.drop("label"), "vec_id").groupBy("label", "cell", "bi", "bj").applyInPandas(_join(threshold), "vec_id long, links long, root long")
    joined = materialize(joined, "joined")
    links = joined.groupBy("vec_id").agg(F.sum("links").alias("links"))
    comps = connected_components(joined.where("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    found = heads.select("rep").join(links.withColumnRenamed("vec_id", "rep"), "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    found = materialize(found.select("rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component")), "found")
    alone = v.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for done in (heads, cells, joined):
        discard(done)

    out = spread_join(member, found, ["rep"], "vec_id")
    out = out.select("vec_id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("component").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
