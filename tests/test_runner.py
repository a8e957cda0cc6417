"""Runs, judges, stores, settings and generators, also with models that fail."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from graphbench import runner
from graphbench.config import EngineConfig, resolve_path
from graphbench.functions import retrieval, score, text
from graphbench.sources import files, generate
from graphbench.sources.client import IndexingPolicy, OfflineClient, indexing_gate

ITEM = "index int, complexity string, question string, ground_truth string, answer string"


def failing():
    class Failing:
        def complete(self, system, user, temperature=0.2):
            if "judge" in system:
                return "no json"
            raise ConnectionError("down")

    return Failing


def chatty():
    class Chatty:
        """Wraps its JSON in a fence, or says nothing."""

        def complete(self, system, user, temperature=0.2):
            last = user.strip().splitlines()[-1]
            return f"```json\n{last}\n```" if len(last) % 2 else ""

    return Chatty


def store(spark, path):
    docs = spark.createDataFrame([(1, "red apples and pears"), (2, "blue whales swim"), (3, "apples apples apples"), (4, None), (5, " ")], "doc_id long, text string")
    return retrieval.VectorStore(spark, str(path), lambda df: retrieval.hash_embedding(df, unit=False)).build(text.chunk_fixed(docs))


def test_store_is_kept_and_rebuilt(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    assert sorted(r.doc_id for r in s.load().collect()) == [1, 2, 3]
    none = spark.createDataFrame([], "doc_id long, chunk_no int, chunk string")
    assert s.build(none).load().count() == 3
    with pytest.raises(ValueError, match="no chunks"):
        s.build(none, rebuild=True)
    s = store(spark, tmp_path / "t")
    asked = spark.createDataFrame([(7, "whales"), (8, None), (9, "apples")], "query_id long, question string")
    got = {r.query_id: [] for r in asked.collect()}
    for r in s.retrieve(asked, 2).orderBy("rank").collect():
        got[r.query_id].append(r.doc_id)
    assert got[7][0] == 2 and all(len(v) == 2 for v in got.values())
    assert sorted(map(tuple, retrieval.vector_topk(s.load(), asked.limit(0).withColumn("embedding", F.array(F.lit(1.0))), 2).collect())) == []
    rows = s.load().select("vec_id", "embedding")
    many = rows.withColumnRenamed("vec_id", "query_id")
    assert sorted(map(tuple, retrieval.vector_topk(rows, many, 2, block=1).collect())) == sorted(map(tuple, retrieval.vector_topk(rows, many, 2).collect()))
    named = retrieval.VectorStore(spark, str(tmp_path / "u"), retrieval.hash_embedding).build(spark.createDataFrame([("a.txt", 0, "x")], "doc_id string, chunk_no int, chunk string"))
    assert named.retrieve(asked.where("query_id = 7")).first().doc_id == "a.txt"


def test_run(spark, tmp_path):
    items = spark.createDataFrame([(1, "simple", "whales swim", "blue", None), (2, score.ANALYTIC, "apples apples apples", "wrong", "apples apples apples"), (3, None, "pears", None, None), (4, "simple", None, " ", None)], ITEM)
    s = store(spark, tmp_path / "s")
    results, total = runner.run(items, s, OfflineClient, EngineConfig(retrieval_k=1))
    by = {r["index"]: r for r in results.collect()}
    assert [(by[i].answer, by[i].recall_on_ground_truth_tokens, by[i].llm_accuracy_correct) for i in (1, 2, 3)] == [("blue whales swim", 1.0, True), ("apples apples apples", 1.0, True), ("red apples and pears", 1.0, None)]
    assert [by[i].scoring_reference for i in (1, 2, 3)] == ["ground_truth", "answer", "ground_truth"] and by[2].ideal_for_scoring == "apples apples apples" and by[3].complexity == ""
    t = total.first()
    assert (t.n, t.n_judged, t.n_correct, t.n_skipped, t.mean_accuracy, t.mean_recall_on_ground_truth_tokens, t.retrieval_k) == (4, 2, 2, 2, 1.0, 1.0, 1)
    plain = {r["index"]: r.ideal_for_scoring for r in runner.run(items, s, OfflineClient, always_truth=True)[0].collect()}
    assert plain[2] == "wrong"
    results, total = runner.run(items, s, failing())
    assert {r.answer for r in results.collect()} == {"[error] down"}
    assert {(r.llm_accuracy_correct, r.llm_accuracy_error) for r in results.where("index < 3").collect()} == {(None, "no boolean verdict")}
    assert total.first().n_judged == 0 and total.first().mean_accuracy is None
    q = runner.judged_quality(results, failing())
    assert {r.error for r in q.collect()} == {"invalid scores"}
    files.write_quality_report(q, "src", "judge", str(tmp_path / "r"))
    report = json.loads(spark.read.text(str(tmp_path / "r/report")).first().value)
    assert report == {"source_file": "src", "judge_model": "judge", "n_scored": 0, "n_errors": 4}
    assert runner.run(items.limit(0), s, OfflineClient)[1].first().n == 0
    with pytest.raises(NotImplementedError):
        runner.answered(items, s, OfflineClient, mode="other")
    assert [runner.query_mode(m) for m in ("NAIVE", "x", None)] == ["naive", "hybrid", "hybrid"]


def test_config(tmp_path):
    c = EngineConfig.from_env({"GRAPHBENCH_SCHEMA_CHARS": "5", "GRAPHBENCH_SAMPLES_PER_LABEL": "50", "GRAPHBENCH_REBUILD_INDEX": "Yes", "GRAPHBENCH_MODEL": "m", "GRAPHBENCH_SEED": " "}, max_level=0)
    assert (c.schema_chars, c.samples_per_label, c.rebuild_index, c.judge_model, c.seed, c.max_level) == (2000, 10, True, "m", 42, 1)
    with pytest.raises(ValueError):
        EngineConfig.from_env({"GRAPHBENCH_SEED": "x"})
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "f").write_text("")
    assert resolve_path("f", tmp_path / "a", tmp_path / "b") == (tmp_path / "b" / "f").resolve()
    assert resolve_path("g", tmp_path / "a") == (tmp_path / "a" / "g").resolve() and resolve_path(str(tmp_path / "b/f")).is_file()


def test_indexing_policy_and_gate(spark):
    now, waits, tried = [0.0], [], []

    def sleep(s):
        waits.append(round(s, 3))
        now[0] += s

    def call(seconds):
        tried.append(seconds)
        now[0] += 10
        if len(tried) < 3:
            raise TimeoutError
        return "ok"

    p = IndexingPolicy(timeout=60)
    assert p.budget == 110 and p.run(call, sleep, lambda: now[0]) == "ok" and waits == [2.0, 3.0] and tried[0] == 110
    with pytest.raises(TimeoutError):
        IndexingPolicy(timeout=20, most_attempts=2).run(lambda s: (_ for _ in ()).throw(TimeoutError()), lambda s: None, lambda: 0.0)
    with pytest.raises(KeyError):
        p.run(lambda s: {}["x"], sleep, lambda: 0.0)
    status = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, status string, error string")
    assert indexing_gate(status(("a", "processed", None))) is None
    assert "failed" in indexing_gate(status(("a", "FAILED", "late"), ("b", "PENDING", None))) and "unfinished" in indexing_gate(status(("b", "pending", None)))


def test_generators_with_odd_replies(spark, tmp_path):
    ctx = spark.createDataFrame([("A", "KEY CONTEXT SIGNALS:\n- signal: x", "s", "q", {"anchor_id": "A"}), ("B", "KEY CONTEXT SIGNALS:", "s", "q", {"anchor_id": "B"})], "anchor_id string, useful_context string, subgraph_context string, debug_query string, debug_params map<string,string>")
    got = generate.subgraph_items(ctx, OfflineClient, 3).orderBy("seq").collect()
    assert [(r.question, r.answer) for r in got] == [("What do the signals tell of A?", "- signal: x")] * 3
    assert generate.subgraph_items(ctx.limit(0), OfflineClient, 3).count() == 0
    assert generate.subgraph_items(ctx, failing(), 3).count() == 0
    assert generate.subgraph_items(ctx, chatty(), 2).count() in (0, 2)
    items = spark.createDataFrame([("q", "truth\nmore", "f"), ("q", " ", "f"), ("q", None, None)], "question string, ground_truth string, spare string")
    assert [r.reference_answer for r in generate.reference_answers(items, OfflineClient, "spare").collect()] == ["truth", "f", ""]
    assert generate.reference_answers(items, failing(), "spare").first().reference_answer == "f" and generate.reference_answers(items, failing()).first().reference_answer == "truth\nmore"


def test_near_pairs_lose_none(spark):
    """Blocks and bands against the matcher on all pairs, with repeats, edits at all places and texts of 200 characters or more."""
    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh ") for _ in range(n)).strip() for n in (12, 30, 31, 90, 260)]
    rows = []
    for b in base:
        for _ in range(6):
            t = list(b)
            for _ in range(r.choice([0, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice("xyz")
            rows.append((len(rows), "".join(t)))
    rows += [(100, None), (101, " "), (102, "?!")]
    norm = {s: t for s, t in spark.createDataFrame(rows, "s long, q string").select("s", text.normalize_question(F.col("q"))).collect()}
    want = {(a, b) for a, x in norm.items() for b, y in norm.items() if b < a and x and y and difflib.SequenceMatcher(None, x, y).ratio() >= 0.92}
    df = spark.createDataFrame(rows, "seq long, question string")
    for block in (512, 4):
        assert {(p.a, p.b) for p in text.near_pairs(df, block=block).collect()} == want
    assert len(want) > 10 and text.near_pairs(df.limit(0)).count() == 0


def test_near_links_keep_copies_apart(spark):
    """Copies are a row each; links between texts equal the matcher's on all pairs of rows, in both directions where rows alternate."""
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in (40, 41, 210, 215)]
    kinds = [b[:k] + z + b[k + 1 :] for b in base for k, z in ((3, "x"), (9, "y"), (20, "z"))]
    rows = [(i, kinds[(i * 5 + i // 7) % len(kinds)]) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, question string")
    norm = {s: t for s, t in df.select("seq", text.normalize_question(F.col("question"))).collect()}
    rep = {t: min(s for s, u in norm.items() if u == t) for t in norm.values()}
    want = {(rep[x], rep[y]) for a, x in norm.items() for b, y in norm.items() if b < a and x != y and difflib.SequenceMatcher(None, x, y).ratio() >= 0.92}
    want |= {(s, rep[t]) for s, t in norm.items() if s != rep[t]}
    got = text.near_links(df).collect()
    assert sorted((g.a, g.b) for g in got) == sorted(want) and len(got) < len(rows) * 3
    assert {(g.a, g.b) for g in got if g.ratio == 1.0} == {(s, rep[t]) for s, t in norm.items() if s != rep[t]}


def test_near_candidates_lose_none():
    """Random edits of texts over few letters, short and long: every pair that the matcher accepts is a candidate, and unrelated prose is not."""
    r = random.Random(8)
    xs = ["".join(r.choice("ab cdé") for _ in range(r.choice((1, 2, 3, 8, 25, 60, 190, 420)))) for _ in range(60)]
    ys = list(xs)
    for t in xs:
        for _ in range(2):
            u = list(t)
            for _ in range(r.randrange(max(1, len(t) // 9) + 1)):
                k = r.randrange(len(u) + 1)
                u[k : k + r.randrange(2)] = r.choice(["", "a", "x", "bc"])
            ys.append("".join(u) or "a")
    got = set(text.near_candidates(xs, ys, 0.92))
    near = {(i, j) for i, x in enumerate(xs) for j, y in enumerate(ys) if difflib.SequenceMatcher(None, x, y).ratio() >= 0.92}
    assert near <= got and len(near) > 100
    words = ["th", "ha", "ou", "er", "ed", "re", "in", "ing", "tion", "and", "es", "ble", "st", "nt"]
    prose = [" ".join("".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(35)) for _ in range(80)]
    assert len(prose) <= len(list(text.near_candidates(prose, prose, 0.92))) < 2 * len(prose)


def test_compact_forms(spark):
    long = "x" * 300
    df = spark.createDataFrame([(long, ["a", long, "c", "d", "e", "f"], {f"k{i:02d}": "v" for i in range(20)})], "s string, l array<string>, m map<string,string>")
    s, items, m = df.select(text.trim_value(F.col("s")), text.trim_value(F.col("l"), "array<string>"), text.trim_value(F.col("m"), "map<string,string>")).first()
    assert s.startswith("x" * 90 + "\n...[TRUNCATED 120 chars]") and len(items) == 5 and items[1] == s and sorted(m) == [f"k{i:02d}" for i in range(12)]
    asked = spark.createDataFrame([(i, f" q{i} " if i % 2 else " ") for i in range(10)], "seq int, question string")
    assert text.existing_questions(asked, 2).first().block.splitlines()[1:] == ["- q7", "- q9"] and text.existing_questions(asked.limit(0)).first().block == ""


def test_command_line(spark, tmp_path):
    """Each command on small files, and its exit codes."""
    from graphbench.cli import main

    at = lambda name: str(tmp_path / name)
    small = EngineConfig(supernodes=3, max_pairs=2, max_level=2, retrieval_k=1)
    assert main(["extract", "/root/testdata/sf0.001", at("g"), "--format", "graphml", "--filter", "SUPPLIES"], spark, small) == 0
    assert main(["import", at("g"), at("db")], spark, small) == 0
    nodes, edges = (spark.read.parquet(f"{at('db')}/{x}") for x in ("nodes", "edges"))
    assert nodes.count() >= 3 and {r.type for r in edges.select("type").distinct().collect()} <= {"DIRECTED"}
    (tmp_path / "corpus.txt").write_text("red apples\n\nblue whales swim")
    (tmp_path / "items.json").write_text(json.dumps([{"complexity": "simple", "question": "whales", "ideal_context": "blue"}, {"question": "apples", "ground_truth": "green"}]))
    assert main(["run", at("items.json"), at("corpus.txt"), at("out")], spark, small) == 0
    got = sorted((r["index"], r.recall_on_ground_truth_tokens) for r in files.read_results(spark, at("out/results")).collect())
    assert [i for i, _ in got] == [1, 2] and got[1][1] == 0.0
    assert main(["judge", at("out/results"), at("report")], spark, small) == 0
    assert json.loads(spark.read.text(at("report/report")).first().value)["n_scored"] == 2
    assert main(["run", at("none.json"), at("corpus.txt"), at("x")], spark, small) == 1
    (tmp_path / "blank.txt").write_text(" \n")
    assert main(["run", at("items.json"), at("blank.txt"), at("y")], spark, small) == 2
