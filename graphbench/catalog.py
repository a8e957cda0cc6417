"""A property graph over typed tables: labels, relationship types and their generic views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def element(label: str, key: str) -> Column:
    """Ids are '<Label>:<key>' and compare as strings."""
    return F.concat(F.lit(label + ":"), F.col(key).cast("string"))


@dataclass
class Graph:
    """label -> (table, id column); type -> edge table with eid, src, dst and its properties. Tables stay typed and lazy."""

    labels: dict[str, tuple[DataFrame, Column]] = field(default_factory=dict)
    types: dict[str, DataFrame] = field(default_factory=dict)
    keys: dict[str, str] = field(default_factory=dict)

    def add_label(self, label: str, table: DataFrame, key: str) -> Graph:
        self.labels[label], self.keys[label] = (table, element(label, key)), key
        return self

    def add_type(self, name: str, edges: DataFrame) -> Graph:
        self.types[name] = self.types[name].unionByName(edges, allowMissingColumns=True) if name in self.types else edges
        return self

    def label(self, label: str) -> DataFrame:
        """The typed table of a label, with element_id."""
        table, eid = self.labels[label]
        return table.withColumn("element_id", eid)

    def lookup(self, element_id: str) -> DataFrame:
        """The typed row of one id: a filter on the label's key column, which reaches the scan. An unknown label is an error, an unknown key no row."""
        label, _, key = element_id.partition(":")
        table, eid = self.labels[label]
        kind = table.schema[self.keys[label]].dataType
        return table.where(F.col(self.keys[label]) == F.lit(key).try_cast(kind)).withColumn("element_id", eid)

    def nodes(self, *labels: str, props: bool = False) -> DataFrame:
        """element_id, labels and, if asked, props_key: the properties as JSON with sorted keys."""
        parts = []
        for name in labels or self.labels:
            table, eid = self.labels[name]
            cols = [eid.alias("element_id"), F.array(F.lit(name)).alias("labels")]
            if props:
                cols.append(F.to_json(F.struct(*sorted(table.columns))).alias("props_key"))
            parts.append(table.select(*cols))
        return reduce(DataFrame.unionByName, parts)

    def edges(self, *types: str, props: bool = False) -> DataFrame:
        """element_id, type, src, dst and, if asked, props_key."""
        parts = []
        for name in types or self.types:
            e = self.types[name]
            cols = [F.col("eid").alias("element_id"), F.lit(name).alias("type"), "src", "dst"]
            own = sorted(set(e.columns) - {"eid", "src", "dst"})
            if props:
                cols.append((F.to_json(F.struct(*own)) if own else F.lit("{}")).alias("props_key"))
            parts.append(e.select(*cols))
        return reduce(DataFrame.unionByName, parts)


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge from both ends, a self-loop once: a, b, eid, type."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("element_id").alias("eid"), "type")
    back = edges.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("element_id").alias("eid"), "type")
    return out.unionByName(back)


def directed(edges: DataFrame, arms: list[tuple[str | None, str]]) -> DataFrame:
    """The arms (type or None for any, '>' '<' or '-') of a relationship filter, as a, b, eid, type."""
    parts = []
    for name, way in arms:
        e = edges if name is None else edges.where(F.col("type") == name)
        both = symmetric(e)
        fore = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("element_id").alias("eid"), "type")
        parts.append({"-": both, ">": fore, "<": fore.select(F.col("b").alias("a"), F.col("a").alias("b"), "eid", "type")}[way])
    return reduce(DataFrame.unionByName, parts).distinct() if len(parts) > 1 else parts[0]


def parse_filter(text: str | None) -> list[tuple[str | None, str]]:
    """'KNOWS>|<LIKES|OWNS' as arms; blank is any type both ways."""
    arms: list[tuple[str | None, str]] = []
    for part in (text or "").split("|"):
        part = part.strip()
        way = ">" if part.endswith(">") else "<" if part.startswith("<") else "-"
        arms.append((part.strip("<>") or None, "-" if part in ("", "<>") else way))
    return arms


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The trading tables as a graph: six labels and five relationship types."""
    t: Callable[[str], DataFrame] = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    g = Graph()
    for label, name, key in (("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Order", "orders", "o_orderkey")):
        g.add_label(label, t(name), key)

    def links(table: DataFrame, name: str, key: str, src: Column, dst: Column, *props: str) -> None:
        g.add_type(name, table.select(F.concat(F.lit(f"{name}:{key[0].upper() if name == 'LOCATED_IN' else ''}"), F.col(key).cast("string")).alias("eid"), src.alias("src"), dst.alias("dst"), *props))

    links(t("nation"), "PART_OF", "n_nationkey", element("Nation", "n_nationkey"), element("Region", "n_regionkey"))
    links(t("customer"), "LOCATED_IN", "c_custkey", element("Customer", "c_custkey"), element("Nation", "c_nationkey"))
    links(t("supplier"), "LOCATED_IN", "s_suppkey", element("Supplier", "s_suppkey"), element("Nation", "s_nationkey"))
    links(t("orders"), "PLACED", "o_orderkey", element("Customer", "o_custkey"), element("Order", "o_orderkey"))
    li = t("lineitem")
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    row = F.concat_ws(":", F.lit("CONTAINS"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents("l_quantity"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"), "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyyMMdd"))
    g.add_type("CONTAINS", li.select(row.alias("eid"), element("Order", "l_orderkey").alias("src"), element("Part", "l_partkey").alias("dst"), "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"))
    pair = li.select("l_suppkey", "l_partkey").distinct()
    g.add_type("SUPPLIES", pair.select(F.concat_ws(":", F.lit("SUPPLIES"), "l_suppkey", "l_partkey").alias("eid"), element("Supplier", "l_suppkey").alias("src"), element("Part", "l_partkey").alias("dst")))
    return g


# Which column names a node of each label of the trading graph.
NAMES = {"Region": "r_name", "Nation": "n_name", "Customer": "c_name", "Supplier": "s_name", "Part": "p_name", "Order": "o_orderpriority"}


def named_nodes(g: Graph, names: dict[str, str] | None = None) -> DataFrame:
    """element_id, labels, props with the one key name: what texts about a node show of it."""
    parts = [g.label(label).select("element_id", F.array(F.lit(label)).alias("labels"), F.create_map(F.lit("name"), F.col(c)).alias("props")) for label, c in (names or NAMES).items()]
    return reduce(DataFrame.unionByName, parts)


def schema_relationships(g_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """label, rel_type, other_label, direction, cnt: exact, by two joins on id."""
    n = g_nodes.select("element_id", F.explode("labels").alias("label"))
    e = edges.join(n.withColumnRenamed("element_id", "src").withColumnRenamed("label", "src_label"), "src").join(n.withColumnRenamed("element_id", "dst").withColumnRenamed("label", "dst_label"), "dst")
    by = e.groupBy("src_label", "type", "dst_label").agg(F.count("*").alias("cnt"))
    out = by.select(F.col("src_label").alias("label"), F.col("type").alias("rel_type"), F.col("dst_label").alias("other_label"), F.lit("out").alias("direction"), "cnt")
    into = by.select(F.col("dst_label").alias("label"), F.col("type").alias("rel_type"), F.col("src_label").alias("other_label"), F.lit("in").alias("direction"), "cnt")
    return out.unionByName(into)


def schema_properties(g: Graph) -> DataFrame:
    """kind, name, prop, type from the tables' schemas."""
    spark = next(iter(g.labels.values()))[0].sparkSession
    rows = [("node", n, f.name, f.dataType.simpleString()) for n, (t, _) in g.labels.items() for f in t.schema]
    rows += [("relationship", n, f.name, f.dataType.simpleString()) for n, t in g.types.items() for f in t.schema if f.name not in ("eid", "src", "dst")]
    return spark.createDataFrame(rows, "kind string, name string, prop string, type string")
