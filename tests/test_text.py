"""Text functions against values worked out by hand."""

import difflib
import re

import pytest
from pyspark.sql import functions as F

from graphbench.functions import score, text, validate
from graphbench.sources.client import ContextTooLong, OfflineClient, ask, complete_rows, shorter, with_retry


def run(spark, rows, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("c"))).collect()]


def test_normalize(spark):
    rows = ["  Где - МСФТ ? ", "a - b", "hi ?", "\ta  b\n", "", None, "x_y. Z!"]
    assert run(spark, rows, text.normalize_question) == ["где  мсфт ", "a  b", "hi ", "a b", "", "", "x_y z"]


def test_recall(spark):
    df = spark.createDataFrame([("1", "see [1]"), ("7.7", "it is 7.7"), ("Microsoft Corp.", "microsoft corp. yes"), ("", "x"), (None, "x"), ("!!!", "x"), ("a b", ""), ("a b", None), ("a b", "b c")], "g string, a string")
    assert [r[0] for r in df.select(text.token_recall(F.col("g"), F.col("a"))).collect()] == [1, 1, 1, 1, 1, 0, 0, 0, 0.5]


def test_labels_and_types(spark):
    assert run(spark, ["person", "data-base", "3d model", "!", None, "", "BIG_corp"], text.entity_label) == ["Person", "DataBase", "T_3dModel", "Entity", "Entity", "Entity", "BigCorp"]
    assert run(spark, ["works at, x", "3d", "", None, " , a", "a--b"], text.keyword_type) == ["WORKS_AT", "R_3D", "DIRECTED", "DIRECTED", "DIRECTED", "A_B"]


def test_values(spark):
    assert run(spark, ["5.0", "5.5", "x", "1e3", "-2.0", None, "9e99"], text.number_text) == ["5", "5.5", "x", "1000", "-2", None, "9e99"]
    df = spark.createDataFrame([(1e7, True, None, [1.5, None], {"a": 2})], "d double, b boolean, n string, l array<double>, m map<string,int>")
    got = df.select(*[text.value_text(F.col(f.name), f.dataType.simpleString()) for f in df.schema]).first()
    assert list(got) == ["10000000.0", "True", "None", "1.5, None", "a: 2"]
    nums = [7.7, 500.0, 0.1, 123456789.25, 0.0, 0.0005]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(nums)], "i int, d double").orderBy("i")
    assert [r[0] for r in df.select(text.double_text(F.col("d"))).collect()] == [str(x) for x in nums]


def test_json(spark):
    got = run(spark, ['```json\n[{"a": 1}]\n```', '[{"a":1}]', "[broken", "", None], lambda c: F.to_json(text.parse_answer_json(c)))
    assert got == ['[{"a":1}]', '[{"a":1}]', "[]", "[]", "[]"]
    assert run(spark, ['x {"a": {"b": 1}} y', '```\n{"a":1}\n```', "none"], text.json_object) == ['{"a": {"b": 1}}', '{"a":1}', ""]


def test_verdicts(spark):
    got = run(spark, ['{"correct": true}', '{"correct": "yes"}', "no", '```json\n{"correct": false}\n```'], score.accuracy_verdict)
    assert [(r.correct, r.error is None) for r in got] == [(True, True), (None, False), (None, False), (False, True)]
    got = run(spark, ['{"comprehensiveness": 1, "diversity": 5, "empowerment": 3}', '{"comprehensiveness": 0, "diversity": 5, "empowerment": 3}', "{}"], score.quality_verdict)
    assert [(r.comprehensiveness, r.error is None) for r in got] == [(1.0, True), (None, False), (None, False)]


def test_truncation(spark):
    assert run(spark, ["abcdef", "abc", None], lambda c: text.truncate_middle(c, 4)) == ["ab\n...[TRUNCATED 2 chars]...\nef", "abc", ""]
    long = "x" * 3000 + "y" * 3000
    assert run(spark, [long, "short", None], text.shrink_prompt) == [shorter(long), "short", ""]
    df = spark.createDataFrame([(list(range(5)),)], "l array<int>")
    assert df.select(text.last_items(F.col("l"), 3), text.last_items(F.col("l"), 9)).first()[:] == ([2, 3, 4], [0, 1, 2, 3, 4])


def test_checks(spark):
    q = ["MATCH (c) WHERE c.name = 'x' RETURN c.name", "MATCH (c) WHERE c.name = 'x' RETURN c.ticker", "MATCH (c) RETURN c.a", "match (C) where C.Name='x' return c.NAME"]
    assert run(spark, q, validate.trivial_self_return) == [True, False, False, True]
    assert [validate.with_limit(x, 7) for x in ("MATCH (n) RETURN n.x;", "RETURN 1 LIMIT 5;", "A UNION B", "")] == ["MATCH (n) RETURN n.x LIMIT 7", "RETURN 1 LIMIT 5;", "A UNION B", ""]
    frame = lambda rows: spark.createDataFrame(rows, "a string, n int, b boolean")
    assert validate.low_signal(frame([]), "RETURN x")
    assert validate.low_signal(frame([(None, 0, False)]), "RETURN count(x)")
    assert not validate.low_signal(frame([(None, 0, False)]), "RETURN x")
    assert not validate.low_signal(frame([(None, 0, False), ("x", 0, None)]), "RETURN max(x)")


def test_ground_truth(spark):
    df = spark.createDataFrame([(2, "B", 1.0), (1, "A", None), (3, "", None)], "pos int, n string, v double")
    assert validate.ground_truth(df, "which", "pos").first()[0] == "A, None; B, 1.0; , None"
    for value, kind, want in ((True, "boolean", "Да"), (0, "int", "Нет"), (3, "int", "Да"), ("x", "string", "Да"), (False, "boolean", "Нет")):
        one = spark.createDataFrame([(value,)], f"v {kind}")
        assert validate.ground_truth(one, " Есть ли x?").first()[0].startswith(want)
    assert validate.ground_truth(one.limit(0), "Есть ли x").first()[0].startswith("Да")
    assert validate.ground_truth(one.limit(0), "x").first()[0] == ""


def norm(t):
    return re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", (t or "").strip().lower()))


def test_dedup(spark):
    base = ["Сколько всего компаний упоминается в статье 'Apple faces delays'?", "Сколько всего компаний упоминается в статье с заголовком 'Apple faces delays'?", "Which sector is it?", "which sector is it", "", "Which sector is in it?", "Totally different question here", None, "Which sectors is it?"]
    df = spark.createDataFrame(list(enumerate(base)), "seq int, question string")
    accepted = []
    for i, t in enumerate(base):
        n = norm(t)
        if n and not any(difflib.SequenceMatcher(None, n, s).ratio() >= 0.92 for _, s in accepted):
            accepted.append((i, n))
    assert sorted(r.seq for r in text.greedy_dedup(df).collect()) == [i for i, _ in accepted]
    assert sorted(r.seq for r in text.exact_dedup(df).collect()) == [0, 1, 2, 5, 6, 8]
    want = {(a, b) for a in range(len(base)) for b in range(a) if norm(base[a]) and norm(base[b]) and difflib.SequenceMatcher(None, norm(base[a]), norm(base[b])).ratio() >= 0.92}
    assert {(r.a, r.b) for r in text.near_pairs(df).collect()} == want


def test_dedup_looks_at_no_pair_of_copies(spark, monkeypatch):
    """Many copies and unrelated texts: accepted are the first rows, and links come from classes alone."""
    monkeypatch.setattr(text, "near_pairs", None)
    rows = [(i, f"question number {i % 7 * 1111111} about {'abcdefg'[i % 7] * 9}") for i in range(70)]
    assert sorted(r.seq for r in text.greedy_dedup(spark.createDataFrame(rows, "seq long, question string")).collect()) == list(range(7))


def test_dedup_decides_every_question(spark):
    """In a chain of edits every other question is accepted; none is dropped undecided."""
    base = "abcdefghijklmnopqrstuvwxy" * 2
    far = [(k, "".join(chr(0x4E00 + j) for j in range(3 * k)) + base[3 * k :]) for k in range(5)]
    df = spark.createDataFrame(far, "seq long, question string")
    assert sorted(r.seq for r in text.greedy_dedup(df).collect()) == [0, 2, 4]
    with pytest.raises(RuntimeError, match="undecided"):
        text.greedy_dedup(df, rounds=2)



def test_chunks(spark):
    t = "para one.\n\n" + "word " * 300 + "\n\nlast\nline " + "z" * 1500
    chunks = text.split_text(t, 600, 100)
    assert all(0 < len(c) <= 600 for c in chunks)
    assert "".join(chunks).replace(" ", "").count("z") >= 1500
    assert text.split_text("  \n\n ") == [] and text.split_text("abc") == ["abc"]
    df = spark.createDataFrame([(1, "x" * 1100), (2, ""), (3, None), (4, "short")], "doc_id long, text string")
    assert sorted((r.doc_id, r.chunk_no, len(r.chunk)) for r in text.chunk_fixed(df).collect()) == [(1, 0, 600), (1, 1, 600), (4, 0, 5)]
    assert {r.doc_id for r in text.chunk_recursive(df).collect()} == {1, 4}


def test_summaries(spark):
    df = spark.createDataFrame([(True, None, 1.0, 2.0, 3.0), (False, None, 2.0, 2.0, 3.0), (None, "bad", None, None, None)], "correct boolean, error string, comprehensiveness double, diversity double, empowerment double")
    assert score.accuracy_summary(df).first()[:] == (2, 1, 1, 0.5)
    assert score.quality_summary(df).first()[:] == (2, 1, 1.5, 2.0, 3.0)
    assert score.recall_summary(df.limit(0).withColumn("recall", F.lit(1.0))).first()[:] == (0, 0.0)


def test_client(spark):
    class Long:
        def complete(self, system, user, temperature=0.2):
            if len(user) > 3000:
                raise ContextTooLong
            return "ok"

    assert ask(Long(), "", "x" * 4000) == "ok" and ask(OfflineClient(), "", "a\nb") == "b" and ask(None, "", "x") is None
    waits: list = []
    with pytest.raises(ValueError):
        with_retry(lambda: int("x"), sleep=waits.append)
    assert waits == [4, 8]
    df = spark.createDataFrame([(1, "q\n5"), (2, None)], "i int, p string")
    assert [(r.i, r.reply) for r in complete_rows(df, OfflineClient, "", "p").orderBy("i").collect()] == [(1, "5"), (2, None)]
