"""Graph operators on small graphs, the pattern language on a finance graph, and files."""

import datetime
import json
import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from graphbench.catalog import Graph, directed, parse_filter, schema_relationships, symmetric, trade_graph
from graphbench.functions.retrieval import hash_embedding, vector_topk
from graphbench.functions.validate import ground_truth
from graphbench.operators import context, expand, levels, metrics, products
from graphbench.plans.pattern import PatternError, match
from graphbench.queries import ORACLE, QUERIES
from graphbench.sources import files, generate, graphml
from graphbench.streaming.degree import windowed_degree


def edges(spark, rows):
    return spark.createDataFrame([(f"e{i}", t, a, b) for i, (a, t, b) in enumerate(rows)], "element_id string, type string, src string, dst string")


def nodes(spark, *ids):
    return spark.createDataFrame([(i, ["L"]) for i in ids], "element_id string, labels array<string>")


def test_degree_loops_and_empty(spark):
    e = edges(spark, [("a", "T", "a"), ("a", "T", "b"), ("a", "U", "b")])
    assert {r.element_id: r.degree for r in metrics.degree(e).collect()} == {"a": 3, "b": 2}
    assert {r.element_id: r.degree for r in metrics.degree(e, "out").collect()} == {"a": 3}
    assert metrics.supernodes(e.limit(0)).collect() == []
    got = metrics.anchor_rank(symmetric(e), nodes(spark, "a", "b", "c")).orderBy("element_id").collect()
    assert [(r.degree, r.variety) for r in got] == [(3, 2), (2, 2), (0, 0)]


def test_parallel_edges_and_trails(spark):
    sym = symmetric(edges(spark, [("a", "T", "b"), ("a", "T", "b"), ("b", "T", "c")]))
    assert {(r.mid, r.end) for r in expand.hop2(sym, nodes(spark, "a")).collect()} == {("b", "a"), ("b", "c")}
    t = expand.trails(sym, 1, 3, nodes(spark, "a"))
    assert sorted((r.hops, r.b) for r in t.collect()) == [(1, "b"), (1, "b"), (2, "a"), (2, "a"), (2, "c"), (2, "c")]
    assert [r.neighbour for r in expand.hop1(sym, nodes(spark, "z")).collect()] == [None]


def test_subgraph_leaves_edges_where_they_lie(spark):
    """Few ids are broadcast even where no table may be; many are joined; the rows are the same."""
    e, n = edges(spark, [(f"a{i}", "T", f"b{i}") for i in range(9)]), nodes(spark, *(f"a{i}" for i in range(9)))
    ids, eids = (spark.createDataFrame([(x,) for x in xs], "element_id string") for xs in (["a1", "a3", "a3", "z"], ["e2", "e2", "e7"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few, kind in ((100_000, "BroadcastHashJoin"), (1, "SortMergeJoin")):
            got = metrics.subgraph(e, n, ids, eids, few=few)
            assert all(kind in d._jdf.queryExecution().executedPlan().toString() for d in got)
            assert [sorted(r.element_id for r in d.collect()) for d in got] == [["a1", "a3"], ["e2", "e7"]]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shortest_paths_break_ties_by_id(spark):
    sym = symmetric(edges(spark, [("a", "T", "m2"), ("m2", "T", "c"), ("a", "T", "m1"), ("m1", "T", "c")]))
    got = {r.node: (r.hops, r.path) for r in expand.shortest_paths(sym, nodes(spark, "a"), 5).collect()}
    assert got["c"][0] == 2 and got["c"][1] == min([["a", "e0", "m2", "e1", "c"], ["a", "e2", "m1", "e3", "c"]])
    both = expand.simple_paths(sym, nodes(spark, "a"), nodes(spark, "c"), 1, 4)
    assert both.count() == 2 and expand.simple_paths(sym, nodes(spark, "a"), nodes(spark, "c"), 1, 4, 1).count() == 1
    n, e = expand.path_elements(both)
    assert n.count() == 4 and e.count() == 4


def test_levels_of_bits_equal_paths(spark, monkeypatch):
    """Distances, paths of pairs and common counts by levels, in several groups of starts and slices of buckets, with ids of both kinds."""
    monkeypatch.setattr(levels, "BITS", 3)
    monkeypatch.setattr(levels, "SLICE", 2)
    rows = lambda df, *cols: sorted(tuple(r) for r in df.select(*cols).collect())
    for name in ("N:{}", "x{}"):
        ends = [(name.format(i * 7 % 23), "T" if i % 3 else "U", name.format((i * i + 3) % 23)) for i in range(40)] + [(name.format(50), "T", name.format(51)), (name.format(1), "T", name.format(1))]
        sym = symmetric(edges(spark, ends))
        some, far = nodes(spark, *(name.format(i) for i in (0, 1, 2, 5, 99))), nodes(spark, *(name.format(i) for i in (0, 4, 8, 50, 77)))
        want = expand.shortest_paths(sym, some, 4, far)
        assert rows(expand.shortest_hops(sym, some, 4, far), "src", "node", "hops") == rows(want, "src", "node", "hops")
        pairs = some.select(F.col("element_id").alias("a")).crossJoin(far.select(F.col("element_id").alias("b")))
        cols = ["src", "node", "hops", "path", "types"]
        assert rows(expand.pair_paths(sym, pairs, 4), *cols) == rows(want, *cols)
        assert not {"path", "types"} & set(expand.shortest_hops(sym, some, 4, far).columns)
        one = sym.where("a < b")  # arcs keep their direction
        assert rows(expand.pair_paths(one, pairs, 4), *cols) == rows(expand.shortest_paths(one, some, 4, far), *cols)


def test_types_of_paths_without_the_paths(spark, monkeypatch):
    """Types along the smallest shortest paths: from levels alone if all shortest paths of a pair have the same, else from the paths of such pairs."""
    monkeypatch.setattr(levels, "SLICE", 2)
    rows = lambda df: sorted(tuple(r) for r in df.select("src", "node", "hops", "types").collect())
    unsure, sought = [], expand.pair_paths
    monkeypatch.setattr(expand, "pair_paths", lambda sym, pairs, most: unsure.append(pairs.count()) or sought(sym, pairs, most))
    for name in ("N:{}", "x{}"):
        ends = [(name.format(i * 7 % 23), "TUV"[i % 3], name.format((i * i + 3) % 23)) for i in range(40)] + [(name.format(50), "T", name.format(51)), (name.format(1), "T", name.format(1))]
        some, far = nodes(spark, *(name.format(i) for i in (0, 1, 2, 5, 51, 99))), nodes(spark, *(name.format(i) for i in (0, 3, 4, 8, 9, 14, 50, 77)))
        sym = symmetric(edges(spark, ends)).withColumn("type", F.when(F.col("type") != "V", F.col("type")))
        got = rows(expand.shortest_types(sym, some, 4, far))
        assert 0 < unsure.pop() < len(got) and got == rows(expand.shortest_paths(sym, some, 4, far))
    monkeypatch.setattr(expand, "shortest_paths", None)  # the query carries no path
    assert {(len(r.types.split()), r.hint[0]) for r in QUERIES["path_hints"](spark, "/root/testdata/sf0.001").collect()} >= {(2, "2"), (4, "4")} and not unsure


def test_same_type_counts_by_blocks(spark, monkeypatch):
    """Many nodes of several labels, in small blocks and chunks, with direct edges, loops and parallel edges, against plain loops."""
    monkeypatch.setattr(levels, "BITS", 5)
    monkeypatch.setattr(products, "SIZE", 4)
    monkeypatch.setattr(products, "WIDE", 7)
    r = random.Random(11)
    ids = [f"{'ABC'[k % 3]}:{k}" for k in range(30)]
    ends = [(r.choice(ids), r.choice(ids)) for _ in range(38)]
    ends.append((ends[0][0], ends[0][0]))
    ends.append(ends[0])
    near = {i: {i: 0} for i in ids}
    for i in ids:
        for h in (1, 2, 3):
            for a, b in ends + [(b, a) for a, b in ends]:
                if near[i].get(a, 9) == h - 1:
                    near[i].setdefault(b, h)
    want = {}
    for a in ids:
        for b in ids:
            if a < b and a[0] == b[0] and (a, b) not in ends and (b, a) not in ends:
                for c in (near[a].keys() & near[b].keys()) - {a, b}:
                    k = (a, b, a[0], near[a][c], near[b][c])
                    want[k] = want.get(k, 0) + 1
    sym = symmetric(edges(spark, [(a, "T", b) for a, b in ends]))
    some = spark.createDataFrame([(i, [i[0]]) for i in ids] + [("A:x", ["A"]), (ids[0] + "x", ["A", "B"]), (None, ["A"])], "element_id string, labels array<string>")
    got = expand.same_type_counts(sym, some)
    assert len(want) > 100 and sorted(tuple(x) for x in got.select("a", "b", "label", "dist_a", "dist_b", "commons").collect()) == sorted((*k, n) for k, n in want.items())
    assert {p for p in ("Nation", "Region") if f"'{p}:" in ORACLE["same_type_common"].split("r1 as")[1]} == set()  # every label


def test_chosen_pairs_of_many_nodes(spark, monkeypatch):
    """Pairs sought in hash order, some at a time, are the first of all pairs; a second pass is needed where few have a useful common node."""
    ids = [f"A:{k}" for k in range(12)]
    sym = symmetric(edges(spark, [(f"A:{k}", "T", f"X:{x}") for k in range(12) for x in {k // 3, (k * 5) % 7 + 10}]))
    some = spark.createDataFrame([(i, ["A"]) for i in ids], "element_id string, labels array<string>")
    useful = sym.select(F.col("a").alias("common")).distinct().withColumn("common_props", F.lit("p"))
    cols = ["hash", "a", "b", "common", "dist_a", "dist_b"]
    run = lambda u, most: sorted(tuple(r) for r in expand._chosen_pairs(sym, some, u, 3, most, 42).select(*cols).collect())
    whole = run(useful, 1000)  # few nodes: all pairs at once
    at = {}
    for k, r in enumerate(whole):
        at.setdefault(r[3], k)
    rare = max(at, key=at.get)
    assert at[rare] >= 10
    monkeypatch.setattr(levels, "BITS", 11)
    assert run(useful, 3) == whole[:3]
    assert run(useful.where(F.col("common") == rare), 1) == [r for r in whole if r[3] == rare][:1]


def test_path_queries_cover_all_edges(spark, tmp_path):
    """Against plain loops on a graph with customers, orders, line items and part keys of 10 and more."""
    li = [(o, k, p, s, 1.0, 2.0, 0.0, 0.0, "R", "F", datetime.date(2024, 1, 1)) for k, (o, p, s) in enumerate([(1, 3, 1), (1, 12, 1), (2, 12, 2), (3, 40, 2), (3, 3, 2)])]
    small = {
        "region": ("r_regionkey long", [(0,)]), "nation": ("n_nationkey long, n_regionkey long", [(0, 0), (1, 0)]), "customer": ("c_custkey long, c_nationkey long", [(1, 0), (2, 1)]),
        "supplier": ("s_suppkey long, s_nationkey long", [(1, 0), (2, 1)]), "part": ("p_partkey long", [(3,), (12,), (40,)]), "orders": ("o_orderkey long, o_custkey long", [(1, 1), (2, 2), (3, 2)]),
        "lineitem": ("l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date", li),
    }
    for name, (shape, rows) in small.items():
        spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda name, *cols: sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*cols).collect())
    es = [tuple(r) for r in trade_graph(spark, str(tmp_path)).edges().collect()]
    sym = [(a, b, e) for e, _, a, b in es] + [(b, a, e) for e, _, a, b in es]
    level, trails = [(a, b, (e,)) for a, b, e in sym], {}
    for h in (1, 2, 3):
        for a, b, _ in level:
            by = trails.setdefault((a, b), {})
            by[h] = by.get(h, 0) + 1
        level = [(a, c, (*used, e)) for a, b, used in level for x, c, e in sym if x == b and e not in used]
    count = {}
    for (a, _), by in trails.items():
        for h, n in by.items():
            count[a, h] = count.get((a, h), 0) + n
    assert run("trails_1_3", "a", "trails_1", "trails_2", "trails_3") == sorted((a, *(count.get((a, h), 0) for h in (1, 2, 3))) for a in {a for a, *_ in sym})
    near = {k: min(v) for k, v in trails.items() if k[0] != k[1]}
    g = trade_graph(spark, str(tmp_path))
    links = symmetric(g.edges())
    rows = lambda df, *cols: sorted(tuple(r) for r in df.select(*cols).collect())
    assert rows(expand.reach(links, 3), "a", "b", "dist") == sorted((*k, v) for k, v in near.items())
    direct = {(a, b) for a, b, _ in sym}
    label = lambda x: x.split(":")[0]
    pairs = [(a, b, label(a), c, d, near[b, c]) for (a, c), d in near.items() for b in {k[0] for k in near} if a < b and (b, c) in near and (a, b) not in direct and label(a) == label(b) and label(a) in ("Part", "Nation", "Region")]
    common = expand.same_type_common(links, g.nodes("Part", "Nation", "Region"), 3)
    assert rows(common, "a", "b", "label", "common", "dist_a", "dist_b") == sorted(pairs)
    tally = {}
    for a, b, lab, c, x, y in pairs:
        n, last = tally.get((a, b, lab, x, y), (0, ""))
        tally[a, b, lab, x, y] = n + 1, max(last, c)
    counts = expand.common_counts(links, g.nodes("Part", "Nation", "Region"), 3)
    assert rows(counts, *counts.columns) == sorted((*k, *v) for k, v in tally.items())
    best = {}
    for a, b, _, c, x, y in pairs:
        best[a, b] = max(best.get((a, b), ((False, -99, ""),)), ((min(x, y) >= 2, -(x + y), c), x, y))
    assert rows(expand.best_common(common), "a", "b", "common", "dist_a", "dist_b") == rows(expand.best_common(counts.withColumnRenamed("last", "common")), "a", "b", "common", "dist_a", "dist_b") == sorted((*k, v[0][2], *v[1:]) for k, v in best.items())

    def paths(src, most):
        found, front = {src: [src]}, {src: [src]}
        for _ in range(most):
            step = {}
            for n, path in front.items():
                for a, b, e in sym:
                    if a == n and b not in found:
                        step[b] = min(step.get(b, [*path, e, b]), [*path, e, b])
            found, front = found | step, step
        return {n: p for n, p in found.items() if n != src}

    ids = {a for a, *_ in sym}
    parts = [i for i in ids if label(i) == "Part"]
    own = g.nodes("Part")
    assert rows(expand.shortest_paths(links, own, 8, own), "src", "node", "hops") == sorted((p, n, len(w) // 2) for p in parts for n, w in paths(p, 8).items() if n in parts)
    tops = sorted(ids, key=lambda i: (-sum(a == i for a, *_ in sym), i))[:20]
    both = spark.createDataFrame([(a, b) for a in tops for b in tops if a < b], "a string, b string")
    ways = [(a, n, w) for a in tops for n, w in paths(a, 5).items() if n in tops and a < n]
    found = expand.expand_pairs(links, both, 5)
    assert len(tops) > 6 and rows(found, "src", "node", "hops", "path") == sorted((a, n, len(w) // 2, w) for a, n, w in ways)
    node_ids, edge_ids = expand.path_elements(found)
    ns, used = metrics.subgraph(g.edges(), g.nodes(), node_ids, edge_ids)
    assert rows(ns, "element_id") == sorted({(x,) for *_, w in ways for x in w[::2]})
    assert rows(used, "element_id", "type", "src", "dst") == sorted(e for e in es if e[0] in {x for *_, w in ways for x in w[1::2]})

    def simple(path, most):
        for a, b, e in sym:
            if a == path[-1] and b not in path[::2] and most:
                yield [*path, e, b]
                yield from simple([*path, e, b], most - 1)

    each = {}
    for a in tops:
        for w in simple([a], 3):
            if w[-1] in tops and a < w[-1]:
                each.setdefault((a, w[-1]), []).append(w)
    want = sorted((*k, len(w) // 2, w) for k, ws in each.items() for w in sorted(ws, key=lambda w: (len(w), w))[:2])
    assert rows(expand.expand_pairs(links, both, 3, 2, "NODE_PATH"), "src", "node", "hops", "path") == want
    with pytest.raises(ValueError, match="uniqueness"):
        expand.expand_pairs(links, both, 3, 2, "ANY")


def test_counts_without_the_paths(spark):
    """Trails and chains of a multigraph with loops and parallel edges, counted and enumerated."""
    r = random.Random(4)
    e = edges(spark, [(r.choice("abcdef"), r.choice("TU"), r.choice("abcdef")) for _ in range(22)])
    sym = symmetric(e)
    by = expand.trails(sym, 1, 3).groupBy("a").pivot("hops", [1, 2, 3]).count().fillna(0)
    assert sorted(map(tuple, by.collect())) == sorted(map(tuple, expand.trail_counts(sym).collect()))
    chains = expand.hop2(sym, nodes(spark, "a", "b", "z")).groupBy("anchor", "rel_type_1", "rel_type_2").agg(F.count("eid_2").alias("chains"))
    assert sorted(map(tuple, chains.collect()), key=str) == sorted(map(tuple, expand.chain_counts(sym, nodes(spark, "a", "b", "z")).collect()), key=str)


def test_lookup_reaches_the_scan(spark):
    g = trade_graph(spark, "/root/testdata/sf0.001")
    found = g.lookup("Supplier:3")
    assert [r.s_suppkey for r in found.collect()] == [3]
    assert "EqualTo(s_suppkey,3)" in found._jdf.queryExecution().toString()
    assert g.lookup("Supplier:x").count() == 0 and g.lookup("Supplier:99999").count() == 0


def test_far_common_is_preferred(spark):
    sym = symmetric(edges(spark, [("a", "T", "x"), ("x", "T", "c"), ("c", "T", "y"), ("y", "T", "b")]))
    info = spark.createDataFrame([("a", ["L"]), ("b", ["L"])], "element_id string, labels array<string>")
    got = expand.best_common(expand.same_type_common(sym, info, 3)).first()
    assert (got.a, got.b, got.common, got.dist_a, got.dist_b) == ("a", "b", "c", 2, 2)


def test_filters_and_pairs(spark):
    assert parse_filter("KNOWS>|<LIKES|OWNS") == [("KNOWS", ">"), ("LIKES", "<"), ("OWNS", "-")] and parse_filter("") == [(None, "-")]
    e = edges(spark, [("a", "K", "b"), ("a", "L", "c")])
    assert {(r.a, r.b) for r in directed(e, parse_filter("K>|<L")).collect()} == {("a", "b"), ("c", "a")}
    ranked = spark.createDataFrame([("z", 0), ("y", 1), ("x", 2)], "element_id string, pos int")
    assert [(r.a, r.b) for r in expand.node_pairs(ranked, 2).collect()] == [("z", "y"), ("z", "x")]
    assert all(r.a < r.b for r in expand.node_pairs(ranked, 3, "sample").collect())


def test_cover(spark):
    assert metrics.greedy_cover([("n2", ["B", "C"]), ("n1", ["A", "B"]), ("n3", ["C"])], {"A", "B", "C", "D"}) == (["n1", "n2"], ["D"])
    assert metrics.greedy_cover([], set()) == ([], [])


def finance(spark) -> Graph:
    g = Graph()
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    g.add_label("Company", t([(1, "Microsoft Corp.", "MSFT", 3100.0), (2, "Apple Inc.", "AAPL", 2900.0), (3, "NVIDIA Corp.", "NVDA", 2200.0), (4, "Tesla Inc.", "TSLA", 600.0), (5, "JPMorgan Chase", "JPM", 500.0), (6, "Pfizer Inc.", "PFE", 160.0)], "id int, name string, ticker string, market_cap_bln double"), "id")
    for label, names in (("Person", ["Satya Nadella", "Tim Cook"]), ("Sector", ["Technology", "Financials", "Healthcare"]), ("InstitutionalInvestor", ["BlackRock Inc.", "Vanguard Group"]), ("Product", ["Comirnaty"])):
        g.add_label(label, t(list(enumerate(names, 1)), "id int, name string"), "id")
    g.add_label("Technology", t([(1, "Generative AI", "Emerging"), (2, "Electric Vehicles", "Mainstream")], "id int, name string, maturity string"), "id")
    g.add_label("NewsArticle", t([(1, "Apple faces supply chain delays for next-generation devices", "negative"), (2, "BlackRock increases stake in AI-driven companies", "positive")], "id int, title string, sentiment string"), "id")
    links = {
        "CEO_OF": ("Person", "Company", [(1, 1), (2, 2)]), "BELONGS_TO": ("Company", "Sector", [(1, 1), (2, 1), (3, 1), (5, 2), (6, 3)]), "DEVELOPES": ("Company", "Technology", [(1, 1), (3, 1), (4, 2)]),
        "PRODUCES": ("Company", "Product", [(6, 1)]),
    }
    for name, (a, b, pairs) in links.items():
        g.add_type(name, t([(f"{name}:{i}", f"{a}:{x}", f"{b}:{y}") for i, (x, y) in enumerate(pairs)], "eid string, src string, dst string"))
    g.add_type("INVESTED_IN", t([("i0", "InstitutionalInvestor:1", "Company:1", 7.7), ("i1", "InstitutionalInvestor:2", "Company:2", 8.1)], "eid string, src string, dst string, percentage double"))
    g.add_type("MENTIONED_IN", t([("m0", "Company:2", "NewsArticle:1"), ("m1", "InstitutionalInvestor:1", "NewsArticle:2")], "eid string, src string, dst string"))
    return g


ART = "{title: 'Apple faces supply chain delays for next-generation devices'}"
GOLD = [
    ("MATCH (c:Company {ticker: 'MSFT'}) RETURN c.name", "Microsoft Corp."),
    (f"MATCH (a:NewsArticle {ART})<-[:MENTIONED_IN]-(c:Company)-[:BELONGS_TO]->(s:Sector) RETURN s.name", "Technology"),
    (f"MATCH (a:NewsArticle {ART})<-[:MENTIONED_IN]-(c:Company)<-[:CEO_OF]-(p:Person) RETURN p.name", "Tim Cook"),
    ("MATCH (co:Company {name: 'Microsoft Corp.'})-[:DEVELOPES]->(t:Technology) RETURN t.name", "Generative AI"),
    ("MATCH (c:Company {name: 'Microsoft Corp.'})<-[:INVESTED_IN]-(ii:InstitutionalInvestor)-[:MENTIONED_IN]->(a:NewsArticle) RETURN a.title", "BlackRock increases stake in AI-driven companies"),
    (f"MATCH (a:NewsArticle {ART})<-[:MENTIONED_IN]-(c:Company) RETURN count(c) AS company_count", "1"),
    ("MATCH (ii:InstitutionalInvestor)-[r:INVESTED_IN]->(c:Company {name: 'Microsoft Corp.'}) RETURN avg(r.percentage) AS average_investment", "7.7"),
    ("MATCH (c:Company) RETURN c.name ORDER BY c.market_cap_bln DESC LIMIT 3", "Microsoft Corp.; Apple Inc.; NVIDIA Corp."),
    ("MATCH (t:Technology {maturity: 'Mainstream'}) RETURN count(t) AS technology_count", "1"),
    ("MATCH (ii:InstitutionalInvestor)-[:MENTIONED_IN]->(a:NewsArticle) RETURN ii.name, count(a) AS mention_count ORDER BY mention_count DESC LIMIT 1", "BlackRock Inc., 1"),
    ("MATCH (c:Company {name: 'Microsoft Corp.'})-[:BELONGS_TO]->(s:Sector) RETURN s.name", "Technology"),
    ("MATCH (p:Person {name: 'Satya Nadella'})-[:CEO_OF]->(c:Company)<-[:INVESTED_IN]-(ii:InstitutionalInvestor)-[:MENTIONED_IN]->(na:NewsArticle) RETURN na.title", "BlackRock increases stake in AI-driven companies"),
    ("MATCH (s:Sector {name: 'Financials'})<-[:BELONGS_TO]-(c:Company) RETURN avg(c.market_cap_bln)", "500.0"),
    ("MATCH (t:Technology)<-[:DEVELOPES]-(c:Company) RETURN t.name, count(c) AS company_count ORDER BY company_count DESC LIMIT 3", "Generative AI, 2; Electric Vehicles, 1"),
    ("MATCH (ii:InstitutionalInvestor)-[r:INVESTED_IN]->(c:Company) RETURN ii.name, max(r.percentage) AS max_percentage ORDER BY max_percentage DESC LIMIT 1", "Vanguard Group, 8.1"),
    ("MATCH (p:Product {name: 'Comirnaty'})<-[:PRODUCES]-(co:Company)-[:MENTIONED_IN]->(na:NewsArticle {sentiment: 'negative'}) RETURN count(na)", "0"),
]


def test_golden_queries(spark):
    g = finance(spark)
    for text, want in GOLD:
        rows = match(g, text, auto_limit=10).collect()
        flat = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos int, " + ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(match(g, text).schema)))
        assert ground_truth(flat, "q", "pos").first()[0] == want, text


def test_pattern_language(spark):
    g = finance(spark)
    vals = lambda q, **p: [tuple(r) for r in match(g, q, p).collect()]
    assert vals("MATCH (s:Sector) OPTIONAL MATCH (c:Company)-[:BELONGS_TO]->(s) WHERE c.market_cap_bln > 2500 RETURN s.name AS s, count(c) AS n ORDER BY n DESC, s") == [("Technology", 2), ("Financials", 0), ("Healthcare", 0)]
    assert vals("MATCH (c:Company)-[:BELONGS_TO]->(s:Sector) WITH s, count(c) AS n WHERE n > 1 RETURN s.name AS s, n") == [("Technology", 3)]
    assert vals("MATCH (c:Company) WHERE c.ticker IN ['JPM', 'PFE'] AND NOT c.name CONTAINS 'Chase' RETURN c.ticker AS t") == [("PFE",)]
    assert vals("MATCH (a:Company)-[:BELONGS_TO]->(s:Sector)<-[:BELONGS_TO]-(b:Company) WHERE a.name < b.name RETURN count(*) AS n") == [(3,)]
    assert vals("MATCH (p:Person)-[*1..2]-(x:Sector) RETURN DISTINCT x.name AS x") == [("Technology",)]
    assert vals("MATCH (c:Company) RETURN c.ticker AS t ORDER BY t SKIP 1 LIMIT 2") == [("JPM",), ("MSFT",)]
    assert vals("MATCH (c:Company {ticker: $t}) RETURN 7 / 2 AS i, 7.0 / 2 AS f", t="JPM") == [(3, 3.5)]
    assert vals("MATCH (c:Company {ticker: 'none'}) RETURN sum(c.market_cap_bln) AS s, count(c) AS n, avg(c.market_cap_bln) AS a") == [(0, 0, None)]
    assert len(vals("MATCH (a:Sector) RETURN a.name AS n UNION MATCH (b:Sector) RETURN b.name AS n")) == 3
    assert len(vals("MATCH (a:Sector) RETURN a.name AS n UNION ALL MATCH (b:Sector) RETURN b.name AS n")) == 6
    assert vals("MATCH (c:Company)-[:CEO_OF|PRODUCES]-(x) RETURN count(x) AS n") == [(3,)]
    for bad in ("MATCH (a RETURN a", "RETURN", "MATCH (a:None) RETURN a.x", "MATCH (a) RETURN a.x extra", "MATCH (a) ~ RETURN a"):
        with pytest.raises(PatternError):
            match(g, bad)


def test_generation(spark):
    g = finance(spark)
    items = generate.generate(spark, g, generate.templates(g, 2)).collect()
    assert {"simple", "aggregation", "multi-hop"} <= {r.complexity for r in items} and all(r.ground_truth for r in items)
    assert generate.targets(7, ["a", "b", "c"]) == {"a": 3, "b": 2, "c": 2}


def test_context(spark):
    df = spark.createDataFrame([("Acme Holdings, Inc.", "$ACME"), ("Abc", "X"), (None, None), ("Data Corp.", "DC")], "name string, ticker string")
    got = [r[0] for r in df.select(context.needles(F.col("name"), F.col("ticker"))).collect()]
    assert got == [["acme holdings, inc.", "acme holdings", "acme", "$acme"], [], [], ["data corp.", "data", "dc", "$dc"]]
    hop = spark.createDataFrame([("x", ["acme"], "NEWS", ["Article"], {"title": "ACME wins"}), ("x", ["acme"], "NEWS", ["Article"], {"title": "Other"}), ("x", ["acme"], "OWNS", ["Firm"], {"name": "y", "embedding": "1"}), ("x", ["acme"], None, ["Firm"], {})], "anchor string, needles array<string>, rel_type string, labels array<string>, props map<string,string>")
    assert [r.rel_type for r in context.prune_hop1(hop).orderBy("rank").collect()] == ["NEWS", "OWNS"]
    p = hop.where("rel_type = 'OWNS'").select(context.without_embeddings(F.col("props")), context.preview(context.without_embeddings(F.col("props"))), context.useful_properties(F.col("props"))).first()
    assert p[0] == {"name": "y"} and p[1] == "{ name='y' }" and p[2] == {"name": "y"}


def test_graphml(spark, tmp_path):
    ns = spark.createDataFrame([("n1", ["A", "B"], {"entity_type": "data-base", "x": "1.0 <&>"}), ("n2", ["A"], {"entity_id": "two"}), ("n3", ["A"], None)], "element_id string, labels array<string>, props map<string,string>")
    es = spark.createDataFrame([("e1", "n1", "n2", "T", {"keywords": "works at, z", "weight": "2.0", "other": "q"})], "element_id string, src string, dst string, type string, props map<string,string>")
    path = str(tmp_path / "g.graphml")
    graphml.write_graphml(ns, es, str(tmp_path / "parts"))
    graphml.join_parts(str(tmp_path / "parts"), path)
    root = ElementTree.parse(path).getroot()
    assert [x.tag.split("}")[1] for x in root] == ["key"] * (len(root) - 1) + ["graph"] and len(root[-1]) == 4
    assert graphml.read_graphml(spark, str(tmp_path / "parts"))[0].count() == 3
    n, e = graphml.read_graphml(spark, path)
    rows = {r.entity_id: r for r in graphml.node_rows(n).collect()}
    assert set(rows) == {"n1", "two", "n3"} and rows["n1"].labels == ["base", "DataBase"] and rows["n1"].props["x"] == "1.0 <&>" and rows["n3"].labels == ["base", "Entity"]
    edge = graphml.edge_rows(e).first()
    assert (edge.src, edge.dst, edge.type) == ("n1", "n2", "WORKS_AT") and edge.props == {"keywords": "works at, z", "weight": "2"}
    assert graphml.resolve(path).name == "g.graphml"
    with pytest.raises(FileNotFoundError):
        graphml.resolve("none", str(tmp_path))


def test_graphml_of_several_parts(spark, tmp_path):
    ns = spark.range(40).selectExpr("concat('n', id) as element_id", "array('A') as labels", "map('name', concat('<', id, '>')) as props")
    es = spark.range(39).selectExpr("concat('e', id) as element_id", "concat('n', id) as src", "concat('n', id + 1) as dst", "'T' as type", "map('weight', '2.0') as props")
    graphml.write_graphml(ns, es, str(tmp_path / "whole"))
    graphml.join_parts(str(tmp_path / "whole"), str(tmp_path / "g.graphml"))
    lines = (tmp_path / "g.graphml").read_text().splitlines()
    (tmp_path / "parts").mkdir()
    for k in range(0, len(lines), 9):  # as many tasks write a larger graph
        (tmp_path / "parts" / f"part-{k:05}.txt").write_text("\n".join(lines[k : k + 9]) + "\n")
    n, e = graphml.read_graphml(spark, str(tmp_path / "parts"))
    assert sorted((r.id, r.props["name"]) for r in n.collect()) == sorted((f"n{i}", f"<{i}>") for i in range(40))
    assert sorted((r.src, r.dst, r.props["weight"]) for r in e.collect()) == sorted((f"n{i}", f"n{i + 1}", "2") for i in range(39))


def test_upserts(spark):
    schema = "entity_id string, labels array<string>, props map<string,string>"
    old = spark.createDataFrame([("a", ["w"], {"x": "1", "y": "1"}), ("b", ["w"], {"x": "1"})], schema)
    new = spark.createDataFrame([("a", ["w"], {"x": "2", "y": None}), ("a", ["w", "T"], {"z": "3"})], schema)
    got = {(r.entity_id, tuple(r.labels)): r.props for r in graphml.upsert_nodes(old, new).collect()}
    assert got == {("a", ("w",)): {"x": "2"}, ("b", ("w",)): {"x": "1"}, ("a", ("w", "T")): {"z": "3"}}
    e = "src string, dst string, type string, props map<string,string>, seq int"
    es = spark.createDataFrame([("b", "a", "T", {"k": "1"}, 1), ("a", "b", "T", {"k": "2"}, 2), ("a", "z", "T", {}, 3)], e)
    up = graphml.upsert_edges(es.drop("seq").limit(0), es, "seq")
    assert {(r.src, r.dst): r.props for r in up.collect()} == {("a", "b"): {"k": "2"}, ("a", "z"): {}}
    ok, dropped = graphml.with_endpoints(up, old)
    assert ok.count() == 1 and dropped.first()[0] == 1
    left = graphml.wipe(old, up, "w")
    assert left[0].count() == 0 and left[1].count() == 0


def test_files(spark, tmp_path):
    items = [{"question": "q", "answer": "a", "index": 1, "ideal_context": "t", "complexity": "simple"}, {"kind": "summary", "n": 1}, {"question": "only"}]
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(x) for x in items) + "\n\n")
    got = files.read_results(spark, str(tmp_path / "r.jsonl")).collect()
    assert len(got) == 1 and got[0].ground_truth == "t"
    (tmp_path / "i.json").write_text(json.dumps(items[:1] * 3))
    assert files.read_items(spark, str(tmp_path / "i.json"), 2).count() == 2
    df = spark.createDataFrame([(1, "x")], "index int, question string")
    files.write_results(df, spark.createDataFrame([(1,)], "n int"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).groupBy("kind").count().count() == 2
    files.report(df, spark.createDataFrame([(1,)], "n int"), str(tmp_path / "rep.json"))
    assert json.loads((tmp_path / "rep.json").read_text())["summary"] == {"n": 1}
    (tmp_path / "c.txt").write_text("one\ntwo")
    assert files.read_corpus(spark, str(tmp_path / "c.txt")).first().text == "one\ntwo"
    files.write_subgraph(df, df, {"a": 1}, str(tmp_path / "sub"))
    assert json.loads(spark.read.text(str(tmp_path / "sub/meta")).first()[0]) == {"a": 1}


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)] + [(99, None)], "vec_id long, embedding array<float>").repartition(4)
    got = vector_topk(v, spark.createDataFrame([(1, [5.4, 0.0])], "query_id long, embedding array<float>"), 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [5, 6, 4]
    e = hash_embedding(spark.createDataFrame([("a b",), ("a b",), (None,)], "chunk string")).collect()
    assert e[0].embedding == e[1].embedding and sum(e[2].embedding) == 0


def test_streaming_degree(spark, tmp_path):
    src = spark.createDataFrame([("2024-01-01 01:00:00", 1), ("2024-01-01 02:00:00", 1), ("2024-01-09 00:00:00", 2)], "ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "s"))
    q = windowed_degree(spark.readStream.schema(src.schema).parquet(str(tmp_path / "s"))).writeStream.format("memory").queryName("deg").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.element_id, r.degree) for r in spark.table("deg").collect()) == [("User:1", 2), ("User:2", 1)]


def test_schema(spark):
    g = finance(spark)
    rels = schema_relationships(g.nodes(), g.edges())
    assert {(r.label, r.rel_type) for r in rels.where("direction = 'in' and label = 'Sector'").collect()} == {("Sector", "BELONGS_TO")}
    assert "Company" in {r.label for r in metrics.anchor_labels(rels).collect()}
    assert context.company_label(rels).first().label == "Company"
    cover = {r.label: r for r in metrics.type_cover(symmetric(g.edges()), g.nodes(), rels).collect()}
    assert set(cover["Company"].uncovered) == set() and set(cover["Company"].missing) == set()
