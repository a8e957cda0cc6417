"""GraphML in and out, and upserts of nodes and edges."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import entity_label, keyword_type, number_text

# The edge properties that an import keeps.
EDGE_KEYS = ["weight", "description", "keywords", "source_id", "file_path", "created_at", "truncate"]

_DATA = "array<struct<_key:string,_VALUE:string>>"


def resolve(path: str, folder: str = ".") -> Path:
    """An existing file: as given if absolute, else under folder."""
    p = Path(path) if Path(path).is_absolute() else Path(folder) / path
    if not p.is_file():
        raise FileNotFoundError(str(p))
    return p


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, props), (edges: src, dst, props) with property maps named by the file's <key> elements.

    path may be a folder of parts. Only the first part opens the document's root, which the newer XML parser asks of every file: it gives up
    behind the first element of the others. The older one looks for the elements alone."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("useLegacyXMLParser", True).schema(schema).load(path)
    keys = read("key", "_id string, `_attr.name` string")
    keys = keys.select(F.col("_id").alias("k"), F.col("`_attr.name`").alias("name"))
    nodes = read("node", f"_id string, data {_DATA}").withColumn("row", F.monotonically_increasing_id())
    edges = read("edge", f"_source string, _target string, data {_DATA}").withColumn("row", F.monotonically_increasing_id())

    def props(df: DataFrame, *ids: str) -> DataFrame:
        named = df.select("row", *ids, F.explode_outer("data").alias("d")).select("row", *ids, F.col("d._key").alias("k"), F.col("d._VALUE").alias("v")).join(keys, "k", "left")
        entry = F.when(F.col("k").isNotNull(), F.struct(F.coalesce("name", "k").alias("key"), number_text(F.col("v")).alias("value")))
        return named.groupBy("row", *ids).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("props"))

    return props(nodes, "_id").select(F.col("_id").alias("id"), "props"), props(edges, "_source", "_target").select(F.col("_source").alias("src"), F.col("_target").alias("dst"), "props")


def xml_text(c: Column) -> Column:
    """Text as XML content or in quotes; null is empty. Control characters that XML can't hold become spaces."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#9;")):
        x = F.replace(x, F.lit(raw), F.lit(name))
    return x


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """section, k, line: a GraphML document as rows, keys declared first; nodes: element_id, labels, props (map); edges: element_id, src, dst, type, props."""
    spark = nodes.sparkSession
    attr = lambda name, c: F.concat(F.lit(f' {name}="'), xml_text(c), F.lit('"'))
    data = lambda kind, props: F.array_join(F.transform(F.array_sort(F.map_entries(props)), lambda e: F.concat(F.lit("<data"), attr("key", F.concat(F.lit(f"{kind}_"), e["key"])), F.lit(">"), xml_text(e["value"]), F.lit("</data>"))), "")
    none = F.create_map().cast("map<string,string>")
    n = nodes.select("element_id", F.map_concat(F.create_map(F.lit("labels"), F.array_join("labels", ",")), F.map_filter(F.coalesce("props", none), lambda k, _: k != "labels")).alias("p"))
    e = edges.select("element_id", "src", "dst", F.map_concat(F.create_map(F.lit("type"), F.col("type")), F.map_filter(F.coalesce("props", none), lambda k, _: k != "type")).alias("p"))

    def keys(df: DataFrame, kind: str) -> DataFrame:
        names = df.select(F.explode(F.map_keys("p")).alias("name")).distinct()
        line = F.concat(F.lit("<key"), attr("id", F.concat(F.lit(f"{kind[0]}_"), "name")), F.lit(f' for="{kind}"'), attr("attr.name", F.col("name")), F.lit(' attr.type="string"/>'))
        return names.select(F.lit(1).alias("section"), F.concat(F.lit(kind), "name").alias("k"), line.alias("line"))

    frame = [(0, "", '<?xml version="1.0" encoding="UTF-8"?>'), (0, "a", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), (2, "", '<graph edgedefault="directed">'), (5, "", "</graph>"), (6, "", "</graphml>")]
    out = spark.createDataFrame(frame, "section int, k string, line string").unionByName(keys(n, "node")).unionByName(keys(e, "edge"))
    node = F.concat(F.lit("<node"), attr("id", F.col("element_id")), F.lit(">"), data("n", F.col("p")), F.lit("</node>"))
    edge = F.concat(F.lit("<edge"), attr("id", F.col("element_id")), attr("source", F.col("src")), attr("target", F.col("dst")), F.lit(">"), data("e", F.col("p")), F.lit("</edge>"))
    out = out.unionByName(n.select(F.lit(3).alias("section"), F.col("element_id").alias("k"), node.alias("line")))
    return out.unionByName(e.select(F.lit(4).alias("section"), F.col("element_id").alias("k"), edge.alias("line")))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder of text files, written by all tasks: in order of their names they are one GraphML document."""
    graphml_rows(nodes, edges).orderBy("section", "k").select("line").write.mode("overwrite").text(path)


def join_parts(folder: str, path: str) -> None:
    """The parts of a local folder as one file."""
    with open(path, "wb") as out:
        for part in sorted(Path(folder).glob("part-*")):
            out.write(part.read_bytes())


def node_rows(nodes: DataFrame, workspace: str = "base", type_label: bool = True) -> DataFrame:
    """entity_id, labels, props of read nodes: entity_id falls back to the node's id, the type label comes from entity_type."""
    eid = F.coalesce(F.col("props")["entity_id"], "id")
    own = F.map_filter("props", lambda k, _: k != "entity_id")
    labels = F.array(F.lit(workspace), entity_label(F.col("props")["entity_type"])) if type_label else F.array(F.lit(workspace))
    return nodes.select(eid.alias("entity_id"), labels.alias("labels"), own.alias("props"))


def edge_rows(edges: DataFrame, mode: str = "keywords_primary") -> DataFrame:
    """src, dst, type, props of read edges: whitelisted properties that aren't empty; the type is the first keyword's, or DIRECTED."""
    own = F.map_filter("props", lambda k, v: k.isin(EDGE_KEYS) & v.isNotNull() & (v != ""))
    kind = keyword_type(F.col("props")["keywords"]) if mode == "keywords_primary" else F.lit("DIRECTED")
    return edges.select("src", "dst", kind.alias("type"), own.alias("props"))


def overlay(old: Column, new: Column) -> Column:
    """Old properties under new ones; a new null removes the key."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, F.map_filter(new, lambda _, v: v.isNotNull()))


def _last(df: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    if order is None:
        return df.dropDuplicates(keys)
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", order)


def upsert_nodes(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """entity_id, labels, props: rows match on id and labels, so a changed type is another node. Of new rows of a key the last by `order` counts."""
    keys = ["entity_id", "labels"]
    n = _last(new, keys, order).withColumnRenamed("props", "new")
    return old.join(n, keys, "full").select(*keys, overlay(F.col("props"), F.col("new")).alias("props"))


def upsert_edges(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """src, dst, type, props: at most one edge for two ends, in whichever direction, and a type."""
    keys = ["src", "dst", "type"]
    low = lambda df: df.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    n = _last(low(new), keys, order).withColumnRenamed("props", "new")
    return _last(low(old), keys, None).join(n, keys, "full").select(*keys, overlay(F.col("props"), F.col("new")).alias("props"))


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose both ends exist, a count of the others)."""
    ids = nodes.select("entity_id").distinct()
    ok = edges.join(ids.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")
    return ok, edges.agg(F.count("*").alias("n")).crossJoin(ok.agg(F.count("*").alias("k"))).select((F.col("n") - F.col("k")).alias("dropped"))


def wipe(nodes: DataFrame, edges: DataFrame, workspace: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a workspace label go, then the edges at them."""
    gone = nodes.where(F.array_contains("labels", workspace)).select("entity_id").distinct()
    left = edges.join(gone.withColumnRenamed("entity_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("entity_id", "dst"), "dst", "left_anti")
    return nodes.where(~F.array_contains("labels", workspace)), left
