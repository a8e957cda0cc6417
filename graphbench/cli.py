"""Command line: extract a subgraph, import GraphML, generate items, run and judge them. Exit codes: 0 done, 1 a missing file, 2 nothing to work on."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runner
from .catalog import Graph, directed, parse_filter, symmetric, trade_graph
from .config import EngineConfig, resolve_path
from .functions import retrieval, text
from .operators import expand, metrics
from .sources import client, files, generate, graphml
from .tables import written


def extract(g: Graph, config: EngineConfig, rel_filter: str = "", uniqueness: str = "NODE_GLOBAL", mode: str = "both") -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(nodes, edges, counters) of the paths between the graph's supernodes, with the supernodes; None if there are none."""
    tops = written(metrics.supernodes(g.edges(), config.supernodes, mode), "tops")
    if tops.isEmpty():
        return None
    ranked = tops.withColumn("pos", F.row_number().over(expand.Window.orderBy(F.desc("degree"), "element_id")))  # as many rows as supernodes
    pairs = written(expand.node_pairs(ranked, config.max_pairs, config.pair_strategy, config.seed), "pairs")
    sym = directed(g.edges(), parse_filter(rel_filter)) if rel_filter else symmetric(g.edges())
    paths = written(expand.expand_pairs(sym, pairs, config.max_level, config.path_limit, uniqueness), "paths")
    ids, edge_ids = expand.path_elements(paths)
    nodes, edges = metrics.subgraph(g.edges(props=True), g.nodes(props=True), ids.unionByName(tops.select("element_id")).distinct(), edge_ids)
    return nodes, edges, files.subgraph_counts(tops, pairs, paths, nodes, edges)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphbench", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {
        "extract": ["tables", "out", "--filter=", "--uniqueness=NODE_GLOBAL", "--degree=both", "--format=json"], "import": ["graphml", "out", "--workspace=base"],
        "generate": ["tables", "out"], "run": ["items", "corpus", "out", "--store=", "--truth-only"], "judge": ["results", "out"],
    }.items():
        cmd = sub.add_parser(name)
        for a in args:
            flag, _, default = a.partition("=")
            cmd.add_argument(flag, action="store_true") if a.startswith("--") and "=" not in a else cmd.add_argument(flag, **({"default": default} if flag.startswith("--") else {}))
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, config: EngineConfig | None = None, make=client.OfflineClient) -> int:
    a = parser().parse_args(argv)
    spark, config = spark or SparkSession.builder.appName("graphbench").getOrCreate(), config or EngineConfig.from_env()
    if a.command in ("extract", "generate"):
        g = trade_graph(spark, a.tables)
        if a.command == "generate":
            generate.generate(spark, g, generate.templates(g), config.ground_truth_rows).write.mode("overwrite").json(a.out)
            return 0
        got = extract(g, config, a.filter, a.uniqueness, a.degree)
        if got is None:
            print("no supernodes", file=sys.stderr)
            return 2
        nodes, edges, counters = got
        if a.format == "graphml":
            as_map = lambda df: df.withColumn("props", F.from_json("props_key", "map<string,string>")).drop("props_key")
            graphml.write_graphml(as_map(nodes), as_map(edges), a.out)
        else:
            files.write_subgraph(nodes, edges, counters.first().asDict(), a.out)
        return 0
    source = a.graphml if a.command == "import" else a.items if a.command == "run" else a.results
    if "://" not in source and not resolve_path(source).exists():
        print(f"not found: {source}", file=sys.stderr)
        return 1
    if a.command == "import":
        nodes, edges = graphml.read_graphml(spark, source)
        rows = graphml.node_rows(nodes, a.workspace, config.type_label)
        ok, dropped = graphml.with_endpoints(graphml.edge_rows(edges, config.rel_mode), rows)
        graphml.upsert_nodes(rows.limit(0), rows).write.mode("overwrite").parquet(f"{a.out}/nodes")
        graphml.upsert_edges(ok.limit(0), ok).write.mode("overwrite").parquet(f"{a.out}/edges")
        print(f"edges without both ends: {dropped.first().dropped}")
        return 0
    if a.command == "judge":
        rows = files.read_results(spark, source)
        rows = rows.withColumn("ideal_for_scoring", F.coalesce("ideal_for_scoring", "ground_truth"))
        if rows.isEmpty():
            return 2
        files.write_quality_report(written(runner.judged_quality(rows, make), "judged"), source, config.judge_model, a.out)
        return 0
    items = files.read_items(spark, source, config.limit_questions)
    items = items.withColumn("index", F.coalesce("index", (F.col("seq") + 1).cast("int")))
    store = retrieval.VectorStore(spark, a.store or f"{a.out}/store", retrieval.hash_embedding)
    try:
        store.build(text.chunk_recursive(files.read_corpus(spark, a.corpus), config.chunk_size, config.chunk_overlap), config.rebuild_index)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    results, total = runner.run(items, store, make, config, a.truth_only)
    files.write_results(results, total, f"{a.out}/results")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
