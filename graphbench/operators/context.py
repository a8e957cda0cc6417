"""Neighbourhood snapshots, their pruning and their text; cross-branch items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import written

# The keys that carry useful signals, and the tokens that mark others.
FOCUS_KEYS = [
    "name", "title", "headline", "description", "summary", "text", "content", "body", "article_text", "snippet", "ticker", "sector", "industry",
    "country", "region", "date", "year", "amount", "value", "revenue", "profit", "risk", "sentiment", "score", "impact", "category", "status",
]
FOCUS_TOKENS = ["headline", "title", "description", "summary", "text", "content"]
# The keys of entities kept for prompts.
USEFUL_KEYS = [
    "name", "title", "description", "summary", "headline", "sector", "industry", "country", "region", "category", "status",
    "date", "year", "amount", "value", "revenue", "profit", "risk", "sentiment", "score", "impact", "ticker",
]
# Legal suffixes of company names, tried in this order.
LEGAL_SUFFIXES = [" incorporated", " corporation", " corp.", " corp", " plc", " ltd.", " ltd", ", inc.", " inc.", " inc", ", inc"]

HOP1_KEPT, HOP2_KEPT, LINES = 20, 30, 16


def embedding_key(k: Column) -> Column:
    return F.lower(k).contains("embedding") | F.lower(k).isin("vector", "vectors")


def without_embeddings(props: Column) -> Column:
    """A property map without embedding-like keys."""
    return F.map_filter(props, lambda k, _: ~embedding_key(k))


def drop_embeddings(df: DataFrame) -> DataFrame:
    """df without embedding-like fields, at any depth of structs, arrays and maps: a walk over the schema, no code by row."""

    def clean(c: Column, kind) -> Column:
        if isinstance(kind, T.StructType):
            kept = [f for f in kind if not embedding_name(f.name)]
            built = F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kept]) if kept else F.lit(None)
            return F.when(c.isNotNull(), built)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            named = F.map_filter(c, lambda k, _: ~embedding_key(k)) if isinstance(kind.keyType, T.StringType) else c
            return F.transform_values(named, lambda _, v: clean(v, kind.valueType))
        return c

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema if not embedding_name(f.name)])


def embedding_name(name: str) -> bool:
    return "embedding" in name.lower() or name.lower() in ("vector", "vectors")


def useful_properties(props: Column, fold_case: bool = False) -> Column:
    """Whitelisted, scalar, non-empty properties; keys match exactly, or lower-cased."""
    key = (lambda k: F.lower(k)) if fold_case else (lambda k: k)
    return F.map_filter(props, lambda k, v: key(k).isin(USEFUL_KEYS) & ~embedding_key(k) & v.isNotNull() & (v != ""))


def sample_properties(props: Column) -> Column:
    """Keys of samples: whitelisted, ending in id, or uuid or symbol."""
    return F.map_filter(props, lambda k, _: F.lower(k).isin(USEFUL_KEYS) | F.lower(k).endswith("id") | F.lower(k).isin("id", "uuid", "symbol"))


def ordered_entries(props: Column) -> Column:
    """Entries by key: the order that 'first n properties' refers to here."""
    return F.array_sort(F.map_entries(F.coalesce(props, F.create_map().cast("map<string,string>"))))


def focus_properties(props: Column) -> Column:
    """Entries (key, value) in key order that carry a signal; where there are none, the first three that aren't empty."""
    entries = F.filter(ordered_entries(props), lambda e: ~embedding_key(e["key"]) & e["value"].isNotNull() & (e["value"] != ""))
    low = lambda e: F.lower(e["key"])
    focus = F.filter(entries, lambda e: low(e).isin(FOCUS_KEYS) | low(e).rlike("|".join(FOCUS_TOKENS)))
    return F.when(F.size(focus) > 0, focus).otherwise(F.slice(entries, 1, 3))


def entries_text(entries: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit("'"), e["key"], F.lit("': '"), e["value"], F.lit("'"))), ", "), F.lit("}"))


def preview(props: Column, n: int = 4) -> Column:
    """The first n properties as key='value'."""
    e = F.slice(ordered_entries(props), 1, n)
    return F.when(F.size(e) == 0, F.lit("{}")).otherwise(F.concat(F.lit("{ "), F.array_join(F.transform(e, lambda x: F.concat(x["key"], F.lit("="), F.coalesce(F.concat(F.lit("'"), x["value"], F.lit("'")), F.lit("None")))), ", "), F.lit(" }")))


def needles(name: Column, ticker: Column) -> Column:
    """Lower-case texts that name an anchor: its name, the part before a comma, the name without a legal suffix, its ticker."""
    n = F.trim(name)
    low = F.lower(n)
    first = F.lower(F.trim(F.split_part(n, F.lit(","), F.lit(1))))
    suffix = F.get(F.filter(F.array(*map(F.lit, LEGAL_SUFFIXES)), lambda x: F.endswith(low, x)), F.lit(0))
    bare = F.when(suffix.isNull(), low).otherwise(F.trim(F.left(low, F.length(low) - F.length(suffix))))
    long_name = F.length(n) >= 4
    t = F.lower(F.regexp_replace(F.trim(ticker), "^[$]+", ""))
    some = F.array(
        F.when(long_name, low), F.when(long_name & (F.length(first) >= 4), first), F.when(long_name & (F.length(bare) >= 4), bare),
        F.when(F.length(t) >= 2, t), F.when(F.length(t) >= 2, F.concat(F.lit("$"), t)),
    )
    return F.array_distinct(F.filter(some, lambda x: x.isNotNull() & (x != "")))


def blob(props: Column) -> Column:
    """All values of a property map, lower-cased, in key order."""
    return F.lower(F.array_join(F.transform(ordered_entries(props), lambda e: e["value"]), " "))


def mentions(text: Column, needed: Column) -> Column:
    return (text != "") & F.exists(needed, lambda n: F.contains(text, n))


def news_like(labels: Column, rel_type: Column) -> Column:
    return F.lower(F.array_join(labels, " ")).rlike("news|article|press") | F.lower(rel_type).contains("news")


def prune_hop1(hop: DataFrame, anchor_needles: str = "needles", keep: int = HOP1_KEPT) -> DataFrame:
    """Rows without a type go, news-like rows must mention the anchor; the first `keep` of each anchor by (type, headline or title) stay.

    hop: anchor, needles, rel_type, labels, props."""
    ok = F.col("rel_type").isNotNull() & (~news_like(F.col("labels"), F.col("rel_type")) | mentions(blob(F.col("props")), F.col(anchor_needles)))
    title = F.coalesce(F.nullif(F.col("props")["headline"], F.lit("")), F.nullif(F.col("props")["title"], F.lit("")), F.lit(""))
    w = Window.partitionBy("anchor").orderBy("rel_type", title, F.to_json("props"), F.array_join("labels", ","))
    return hop.where(ok).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def prune_hop2(hop: DataFrame, anchor_needles: str = "needles", keep: int = HOP2_KEPT) -> DataFrame:
    """As prune_hop1 for chains: anchor, needles, rel_type_1, mid_labels, mid_props, rel_type_2, labels, props."""
    need = F.col(anchor_needles)
    mid = ~news_like(F.col("mid_labels"), F.col("rel_type_1")) | mentions(blob(F.col("mid_props")), need)
    end = ~news_like(F.col("labels"), F.col("rel_type_2")) | mentions(blob(F.col("props")), need)
    title = F.coalesce(F.nullif(F.col("props")["headline"], F.lit("")), F.nullif(F.col("props")["title"], F.lit("")), F.lit(""))
    w = Window.partitionBy("anchor").orderBy("rel_type_1", "rel_type_2", title, F.to_json("props"), F.to_json("mid_props"))
    return hop.where(F.col("rel_type_1").isNotNull() & F.col("rel_type_2").isNotNull() & mid & end).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def snapshot_text(labels: Column, props: Column, hop1: Column, hop2: Column) -> Column:
    """ANCHOR, HOP1 and HOP2 lines; hop1: array of (rel_type, labels, props), hop2: of (rel_type_1, mid_labels, rel_type_2, labels)."""
    own = F.concat(F.lit("["), F.array_join(labels, ", "), F.lit("]"))
    show = lambda ls: F.concat(F.lit("(["), F.array_join(ls, ", "), F.lit("])"))
    lines1 = F.transform(F.slice(hop1, 1, HOP1_KEPT), lambda x: F.concat(F.lit("- ("), own, F.lit(") -[:"), x["rel_type"], F.lit("]- "), show(x["labels"]), F.lit(" "), preview(x["props"])))
    lines2 = F.transform(F.slice(hop2, 1, HOP2_KEPT), lambda x: F.concat(F.lit("- ("), own, F.lit(") -[:"), x["rel_type_1"], F.lit("]- "), show(x["mid_labels"]), F.lit(" -[:"), x["rel_type_2"], F.lit("]- "), show(x["labels"])))
    head = F.array(F.lit("ANCHOR:"), F.concat(F.lit("- labels: "), own), F.concat(F.lit("- props: "), preview(props)), F.lit(""), F.lit("HOP1 RELATIONS:"))
    return F.rtrim(F.array_join(F.concat(head, lines1, F.array(F.lit(""), F.lit("HOP2 RELATIONS:")), lines2), "\n"))


def useful_context(props: Column, hop1: Column, hop2: Column, lines: int = LINES) -> Column:
    """Signal lines: a header, the anchor, then distinct signals of hop 1 and chains of hop 2, `lines` in all."""
    anchor = focus_properties(props)
    one = F.transform(F.filter(hop1, lambda x: x["rel_type"].isNotNull() & (F.size(focus_properties(x["props"])) > 0)), lambda x: F.concat(F.lit("- signal: "), x["rel_type"], F.lit(" -> "), entries_text(focus_properties(x["props"]))))
    two = F.transform(F.filter(hop2, lambda x: x["rel_type_1"].isNotNull() & x["rel_type_2"].isNotNull() & (F.size(focus_properties(x["props"])) > 0)), lambda x: F.concat(F.lit("- chain: "), x["rel_type_1"], F.lit(" -> "), x["rel_type_2"], F.lit(" -> "), entries_text(focus_properties(x["props"]))))
    head = F.when(F.size(anchor) > 0, F.array(F.lit("KEY CONTEXT SIGNALS:"), F.concat(F.lit("- anchor: "), entries_text(anchor)))).otherwise(F.array(F.lit("KEY CONTEXT SIGNALS:")))
    return F.array_join(F.slice(F.concat(head, F.array_distinct(one), F.array_distinct(two)), 1, lines), "\n")


def company_label(schema_rels: DataFrame) -> DataFrame:
    """One row: the first label that contains 'company', else the first label."""
    by = F.struct((~F.lower("label").contains("company")).alias("other"), F.col("label").alias("l"))
    return schema_rels.agg(F.min(by).alias("x")).select(F.col("x.l").alias("label"))


def identifier(*candidates: str) -> tuple[Column, Column]:
    """(key, value) of the first column that is neither null nor empty."""
    key = F.coalesce(*[F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), F.lit(c)) for c in candidates])
    return key, F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in candidates])


def mask(label: Column, rel_type: Column) -> Column:
    return F.concat(F.lit("[MASK::"), label, F.lit(" via "), rel_type, F.lit("]"))


def branch_pairs(schema_rels: DataFrame, ends: DataFrame) -> DataFrame:
    """The first pair of branches of each label, by (type, end label), that differ in type and in end label; ends: label, rel_type, end_label."""
    b = schema_rels.select("label", "rel_type").distinct().join(ends, ["label", "rel_type"]).where("end_label <> label").distinct()
    b = b.withColumn("pos", F.row_number().over(Window.partitionBy("label").orderBy("rel_type", "end_label")))
    x, y = b.toDF("label", "type_a", "end_a", "i"), b.toDF("label", "type_b", "end_b", "j")
    pairs = x.join(y, "label").where("i < j and type_a <> type_b and end_a <> end_b")
    return pairs.groupBy("label").agg(F.min(F.struct("i", "j", "type_a", "end_a", "type_b", "end_b")).alias("p")).select("label", "p.type_a", "p.end_a", "p.type_b", "p.end_b")


def end_labels(edges: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """label, rel_type, end_label: the labels at the far ends of each label's relationship types, the first `most` by name."""
    n = nodes.select("element_id", F.explode("labels").alias("l"))
    e = edges.join(n.select(F.col("element_id").alias("src"), F.col("l").alias("ls")), "src").join(n.select(F.col("element_id").alias("dst"), F.col("l").alias("ld")), "dst")
    by = e.select("type", "ls", "ld").distinct()
    both = by.select(F.col("ls").alias("label"), F.col("type").alias("rel_type"), F.col("ld").alias("end_label")).unionByName(by.select(F.col("ld").alias("label"), F.col("type").alias("rel_type"), F.col("ls").alias("end_label"))).distinct()
    w = Window.partitionBy("label", "rel_type").orderBy("end_label")
    return both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


# The keys that name an entity, tried in this order.
IDENTIFIER_KEYS = ["name", "title", "ticker", "id", "uuid"]


def identifier_entry(props: Column) -> Column:
    """struct(key, value): the first identifying key that is neither null nor empty, else the first property by key that is."""
    some = F.filter(ordered_entries(props), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    one = lambda key: F.get(F.filter(some, lambda e: e["key"] == key), F.lit(0))
    return F.coalesce(*[one(k) for k in IDENTIFIER_KEYS], F.get(some, F.lit(0)))


def masked_question(label: Column, mask_a: Column, mask_b: Column) -> Column:
    return F.concat(F.lit("For one "), label, F.lit(": how do "), mask_a, F.lit(" and "), mask_b, F.lit(" together shape the picture? Use both branches and name what they share."))


def cross_branch_items(edges: DataFrame, nodes: DataFrame, info: DataFrame, schema_rels: DataFrame, most: int = 5, ends: int = 5, seed: int = 42) -> DataFrame:
    """Items of a question that hides two branches of an anchor: seq, label, question, cypher, params and metadata.

    Labels with two relationship types or more, in the order of a seeded hash, the first `most` that have an anchor with an identifier and two branches of differing type and end.
    The anchor of a label is its smallest id (any would do). info: element_id, labels, props."""
    anchors = info.select(F.explode("labels").alias("label"), "element_id", identifier_entry(F.col("props")).alias("i")).groupBy("label").agg(F.min_by("i", "element_id").alias("i")).where("i is not null")
    pairs = branch_pairs(schema_rels, end_labels(edges, nodes, ends)).join(anchors, "label")
    order = F.md5(F.concat(F.col("label"), F.lit(f"|{seed}")))
    tick = lambda c: F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))
    arm = lambda x, rel, end: F.concat(F.lit("MATCH (n)-[:"), tick(F.col(rel)), F.lit(f"]-({x}:"), tick(F.col(end)), F.lit(") "))
    cypher = F.concat(F.lit("MATCH (n:"), tick(F.col("label")), F.lit(" {"), F.col("i.key"), F.lit(": $anchor_value}) "), arm("x", "type_a", "end_a"), arm("y", "type_b", "end_b"), F.lit("RETURN count(DISTINCT x) AS branch_a, count(DISTINCT y) AS branch_b"))
    first = pairs.orderBy(order, "label").limit(most).withColumn("seq", F.row_number().over(Window.orderBy(order, "label")))  # `most` rows
    masks = mask(F.col("end_a"), F.col("type_a")), mask(F.col("end_b"), F.col("type_b"))
    return first.select(
        "seq", F.col("label").alias("anchor_label"), F.lit("cross-branch").alias("complexity"), masked_question(F.col("label"), *masks).alias("question"), cypher.alias("cypher"),
        F.create_map(F.lit("anchor_value"), F.col("i.value")).alias("params"), F.col("i.key").alias("anchor_identifier_key"),
        F.col("type_a").alias("branch_a_rel_type"), F.col("end_a").alias("branch_a_end_label"), F.col("type_b").alias("branch_b_rel_type"), F.col("end_b").alias("branch_b_end_label"),
    )


def hop1_lines(hop: DataFrame, info: DataFrame) -> DataFrame:
    """anchor, lines: one line a neighbour with its labels and useful properties, by rank; a note where there are none."""
    x = hop.join(info.select(F.col("element_id").alias("neighbour"), "labels", "useful"), "neighbour", "left")
    line = F.when(F.col("rel_type").isNotNull() & ((F.size("labels") > 0) | (F.size("useful") > 0)), F.concat(F.lit("  - by "), "rel_type", F.lit(": ["), F.array_join("labels", ", "), F.lit("] "), entries_text(ordered_entries(F.col("useful")))))
    got = x.groupBy("anchor").agg(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("rank", line.alias("t"))))).alias("l"))
    return got.select("anchor", F.when(F.size("l") == 0, F.lit("  (no neighbours)")).otherwise(F.array_join(F.transform("l", lambda r: r["t"]), "\n")).alias("lines"))


HOP1_COLLECTED, HOP2_COLLECTED = 64, 96


def snapshot_query(anchor_id: str) -> str:
    """The pattern query of a neighbourhood, kept with an item so that its context can be looked up again."""
    return f"MATCH (c) WHERE id(c) = '{anchor_id}' OPTIONAL MATCH (c)-[r]-(n) OPTIONAL MATCH (c)-[p]-(m)-[q]-(e) RETURN c, r, n, p, m, q, e"


def subgraph_contexts(sym: DataFrame, info: DataFrame, label: str, anchors: int = 3, hop1_limit: int = HOP1_COLLECTED, hop2_limit: int = HOP2_COLLECTED) -> DataFrame:
    """One row a top anchor of the label: company_label, anchor_id, anchor_props, subgraph_context, useful_context, debug_query, debug_params.

    For all anchors in one plan: distinct neighbours and chains, the first of each by type, labels and properties, pruned to what concerns the anchor, then as text.
    info: element_id, labels, props; embedding-like properties are dropped first."""
    from .expand import hop1, hop2
    from .metrics import top_anchors

    clean = info.select("element_id", "labels", without_embeddings(F.col("props")).alias("props")).withColumn("key", F.to_json("props"))
    mine = clean.where(F.array_contains("labels", label))
    own = written(mine.join(F.broadcast(top_anchors(sym, mine, anchors)), "element_id").select("element_id", "labels", "props"), "anchors")  # `anchors` rows
    value = lambda k: F.col("props")[k]
    need = own.select(F.col("element_id").alias("anchor"), needles(value("name"), value("ticker")).alias("needles"))
    named = lambda id_, **as_: clean.select(F.col("element_id").alias(id_), *[F.col(k).alias(v) for k, v in as_.items()])

    def first(df: DataFrame, limit: int, *order: str) -> DataFrame:
        w = Window.partitionBy("anchor").orderBy(*order)
        distinct = df.groupBy("anchor", *order).agg(*[F.first(c).alias(c) for c in df.columns if c not in order and c != "anchor"])
        return distinct.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("n").join(need, "anchor")

    one = hop1(sym, own).where("rel_type is not null").join(named("neighbour", labels="labels", props="props", key="key"), "neighbour").select("anchor", "rel_type", "labels", "props", "key")
    one = prune_hop1(first(one, hop1_limit, "rel_type", "labels", "key"))
    one = one.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "rel_type", "labels", "key"))).alias("h"))
    two = hop2(sym, own).where("rel_type_1 is not null").join(named("mid", labels="mid_labels", props="mid_props", key="mid_key"), "mid").join(named("end", labels="labels", props="props", key="key"), "end")
    two = two.select("anchor", "rel_type_1", "mid_labels", "mid_key", "mid_props", "rel_type_2", "labels", "key", "props")
    two = prune_hop2(first(two, hop2_limit, "rel_type_1", "mid_labels", "mid_key", "rel_type_2", "labels", "key"))
    two = two.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "rel_type_1", "mid_labels", "rel_type_2", "labels", "key"))).alias("h"))
    back = lambda x: F.from_json(x["key"], "map<string,string>").alias("props")
    one = one.select("anchor", F.transform("h", lambda x: F.struct(x["rel_type"].alias("rel_type"), x["labels"].alias("labels"), back(x))).alias("hop1"))
    two = two.select("anchor", F.transform("h", lambda x: F.struct(x["rel_type_1"].alias("rel_type_1"), x["mid_labels"].alias("mid_labels"), x["rel_type_2"].alias("rel_type_2"), x["labels"].alias("labels"), back(x))).alias("hop2"))
    all_ = own.withColumnRenamed("element_id", "anchor").join(one, "anchor", "left").join(two, "anchor", "left")
    h1 = F.coalesce("hop1", F.expr("cast(array() as array<struct<rel_type:string,labels:array<string>,props:map<string,string>>>)"))
    h2 = F.coalesce("hop2", F.expr("cast(array() as array<struct<rel_type_1:string,mid_labels:array<string>,rel_type_2:string,labels:array<string>,props:map<string,string>>>)"))
    query = F.concat(F.lit(snapshot_query("").split("''")[0] + "'"), "anchor", F.lit("'" + snapshot_query("").split("''")[1]))
    return all_.select(
        F.lit(label).alias("company_label"), F.col("anchor").alias("anchor_id"), F.col("props").alias("anchor_props"), snapshot_text(F.col("labels"), F.col("props"), h1, h2).alias("subgraph_context"),
        useful_context(F.col("props"), h1, h2).alias("useful_context"), query.alias("debug_query"), F.create_map(F.lit("anchor_id"), F.col("anchor")).alias("debug_params"),
    )
