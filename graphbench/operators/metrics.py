"""Degrees, anchors, incident types, set cover and deterministic samples."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def degree(edges: DataFrame, mode: str = "both") -> DataFrame:
    """element_id, degree of nodes that have edges; only id columns are read. A self-loop counts once ('both'), 'out' counts starts."""
    ends = edges.select(F.col("src").alias("element_id"))
    if mode == "both":
        ends = ends.unionByName(edges.where("src <> dst").select(F.col("dst").alias("element_id")))
    return ends.groupBy("element_id").agg(F.count("*").alias("degree"))


def supernodes(edges: DataFrame, n: int = 20, mode: str = "both") -> DataFrame:
    """The n nodes of the highest degree, ties by id."""
    return degree(edges, mode).where("degree > 0").orderBy(F.desc("degree"), "element_id").limit(n)


def anchor_rank(sym: DataFrame, nodes: DataFrame) -> DataFrame:
    """element_id, degree, variety of every node, zero for isolated ones. Edges are counted by node and type first, so no row is expanded."""
    by = sym.groupBy("a", "type").agg(F.count("eid").alias("n"))
    d = by.groupBy(F.col("a").alias("element_id")).agg(F.sum("n").alias("degree"), F.count("*").alias("variety"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select("element_id").join(d, "element_id", "left").select("element_id", zero("degree"), zero("variety"))


def top_anchors(sym: DataFrame, nodes: DataFrame, n: int = 3) -> DataFrame:
    return anchor_rank(sym, nodes).orderBy(F.desc("degree"), F.desc("variety"), "element_id").limit(n)


def incident_types(sym: DataFrame) -> DataFrame:
    """element_id, types: the sorted set of types at each node."""
    return sym.groupBy("a").agg(F.array_sort(F.collect_set("type")).alias("types")).where(F.exists("types", lambda t: t.isNotNull())).withColumnRenamed("a", "element_id")


def anchor_labels(schema_rels: DataFrame, least: int = 2) -> DataFrame:
    """Labels with at least `least` relationship types."""
    return schema_rels.groupBy("label").agg(F.count_distinct("rel_type").alias("n_types")).where(F.col("n_types") >= least)


def greedy_cover(rows: Iterable[tuple[str, list[str]]], target: set[str]) -> tuple[list[str], list[str]]:
    """(chosen ids, uncovered types): most uncovered types first, ties by the smallest id."""
    rows, left, chosen = list(rows), set(target), []
    while left:
        gain, eid = min(((-len(left & set(types)), eid) for eid, types in rows), default=(0, ""))
        if not gain:
            break
        chosen.append(eid)
        left -= next(set(t) for e, t in rows if e == eid)
    return chosen, sorted(left)


def type_cover(sym: DataFrame, nodes: DataFrame, schema_rels: DataFrame) -> DataFrame:
    """Cover report of each label: required, present, target and missing types, chosen ids, uncovered, candidates.

    Nodes collapse to distinct type sets with their smallest id first; there are as many as combinations
    of types in the schema, however many nodes, and only they reach the driver."""
    spark = nodes.sparkSession
    own = nodes.select("element_id", F.explode("labels").alias("label")).join(incident_types(sym), "element_id")
    sets = own.groupBy("label", "types").agg(F.min("element_id").alias("element_id"), F.count("*").alias("n")).collect()
    need: dict[str, set[str]] = {}
    for r in schema_rels.select("label", "rel_type").distinct().collect():
        need.setdefault(r.label, set()).add(r.rel_type)
    rows = []
    for label, required in sorted(need.items()):
        mine = [(r.element_id, r.types, r.n) for r in sets if r.label == label]
        present = {t for _, ts, _ in mine for t in ts}
        chosen, uncovered = greedy_cover([(e, t) for e, t, _ in mine], required & present)
        rows.append((label, sorted(required), sorted(present), sorted(required & present), chosen, sorted(required - present), uncovered, sum(n for *_, n in mine)))
    return spark.createDataFrame(rows, "label string, required array<string>, present array<string>, target array<string>, selected array<string>, missing array<string>, uncovered array<string>, candidates long")


def seeded(eid: str | Column, seed: int = 42) -> Column:
    """A sort key that stands for randomness and is the same everywhere."""
    return F.md5(F.concat(F.col(eid) if isinstance(eid, str) else eid, F.lit(f"|{seed}")))


def sample_nodes(nodes: DataFrame, k: int, seed: int = 42, exclude: DataFrame | None = None) -> DataFrame:
    if exclude is not None:
        nodes = nodes.join(exclude.select("element_id"), "element_id", "left_anti")
    return nodes.orderBy(seeded("element_id", seed), "element_id").limit(k)


def sample_per_label(nodes: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """label, rank, element_id and other columns: k of each label, 5 to 10, equal property sets once."""
    k = min(10, max(5, k))
    by = nodes.select("*", F.explode("labels").alias("label"))
    if "props_key" in nodes.columns:
        by = by.groupBy("label", "props_key").agg(F.min("element_id").alias("element_id"))
    w = Window.partitionBy("label").orderBy(seeded("element_id", seed), "element_id")
    return by.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("labels")


def in_order(ids: list[str], nodes: DataFrame) -> DataFrame:
    """Nodes of the given ids with their place in the list."""
    spark = nodes.sparkSession
    return spark.createDataFrame([(i, e) for i, e in enumerate(ids)], "pos int, element_id string").join(nodes, "element_id")


def subgraph(edges: DataFrame, nodes: DataFrame, node_ids: DataFrame, edge_ids: DataFrame, few: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Full rows of the ids that paths named; ids travel first, properties join last. Up to `few` ids are broadcast, so that the tables stay where they lie."""

    def rows(table: DataFrame, ids: DataFrame) -> DataFrame:
        ids = written(ids.select("element_id").distinct(), "ids")
        ids = F.broadcast(ids) if ids.limit(few + 1).count() <= few else ids
        return table.join(ids, "element_id", "left_semi").dropDuplicates(["element_id"])

    return rows(nodes, node_ids), rows(edges, edge_ids)
