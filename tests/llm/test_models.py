"""Language model, language ID and quality: exact parts by brute force, learned parts by held-out accuracy."""

import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from graphbench.llm import attention_lm as lm
from graphbench.llm._common import sampled_ids
from graphbench.llm import langid, quality
from graphbench.llm._common import tokenizer_path

SF = "/root/testdata/sf0.01"
PATH = tokenizer_path("byte_bpe_50k.tiktoken")


def held(i, modulus, value):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == value


@pytest.fixture(scope="module")
def small():
    texts = [b"the cat sat on the mat and the dog ran", b"a cat and a dog sat", "über  straße\n÷ x".encode(), b"", b"end"]
    return lm.fit(texts * 30, PATH, size=300, steps=60)


def test_probabilities_sum_to_one(small):
    _, model = small
    ids = np.asarray([3, 260, 5, 257, 9, 2], np.int32)
    for n in (0, 1, 3, 5):
        total = sum(math.exp(model.log_probs(np.append(ids[:n], y).astype(np.int32), np.asarray([n + 1]))[n]) for y in range(model.size))
        assert total == pytest.approx(1, abs=1e-4)


def test_windows_score_like_one_by_one(small):
    """Batched windows give what a plain loop over positions gives, whatever lies around a text."""
    _, model = small
    p, r = model.p, np.random.default_rng(0)
    seqs = [r.integers(0, model.size, n).astype(np.int32) for n in (1, 15, 16, 17, 40, 90)]
    got = model.log_probs(np.concatenate(seqs), np.asarray([len(s) for s in seqs]), blocks_at_once=2)
    at = 0
    for s in seqs:
        x = np.concatenate(([lm.Vocabulary.TEXT_END], s[:-1]))
        for i in range(len(s)):
            low = max(0, i // lm.BLOCK * lm.BLOCK - lm.CONTEXT)
            e = p["E"][x[low : i + 1]]
            w = np.exp((e[-1] @ p["q"]) @ (e @ p["k"]).T / math.sqrt(model.key) + p["rel"][i - np.arange(low, i + 1)])
            h = e[-1] + w @ (e @ p["v"]) / w.sum()
            h = h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"]
            c, m = model.cls[s[i]], model.mem[s[i]]
            zc, zm = h @ p["wc"] + p["bc"], h @ p["wm"][c] + p["bm"][c]
            want = zc[c] - np.logaddexp.reduce(zc) + zm[m] - np.logaddexp.reduce(zm)
            assert got[at + i] == pytest.approx(want, abs=2e-3)
        at += len(s)


def test_gradients():
    r = np.random.default_rng(1)
    size, shape = 40, (7, 7)
    m = lm.Model(size, np.arange(size) // 7, np.arange(size) % 7, shape, dim=5, key=4, hidden=6)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    xw, y = r.integers(0, size + 1, (3, lm.WINDOW)), r.integers(0, size, (3, lm.BLOCK))
    xw[:, lm.CONTEXT :] %= size
    ok = np.ones_like(y, bool)
    ok[2, 9:] = False
    _, g = m._grads(xw, y, ok)
    for k in m.p:
        for _ in range(3):
            i = tuple(r.integers(0, n) for n in m.p[k].shape)
            if k == "E" and i[0] == size or k == "bm" and m.p[k][i] < -100:
                continue
            old = m.p[k][i]
            m.p[k][i] = old + 1e-4
            up = m._grads(xw, y, ok)[0]
            m.p[k][i] = old - 1e-4
            down = m._grads(xw, y, ok)[0]
            m.p[k][i] = old
            assert g[k][i] == pytest.approx((up - down) / 2e-4, abs=2e-4), k


def test_a_step_is_adams(small):
    """Weights kept as one vector take the steps that a loop over them by name takes; a text's ids are the same from a table of words."""
    vocab, model = small
    r, p = np.random.default_rng(4), {k: v.astype(np.float64) for k, v in model.p.items()}
    want, m1, m2 = {k: v.copy() for k, v in p.items()}, dict.fromkeys(p, 0.0), dict.fromkeys(p, 0.0)
    adam = lm.Adam(p)
    for t in range(1, 4):
        g = {k: r.normal(size=v.shape) for k, v in p.items()}
        adam.step({k: v.copy() for k, v in g.items()}, 0.01)
        for k, v in g.items():
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * v, 0.99 * m2[k] + 0.01 * v * v
            want[k] -= 0.01 * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-6)
    assert all(np.allclose(p[k], want[k], atol=1e-9) for k in p)
    docs = [t.split() for t in (b"the cat sat", b"", b"unmet w0rds and the cat")]
    tok, _ = lm.Vocabulary.tokenizer(PATH)
    for _ in range(2):
        got, want = lm.spell(lm.word_table(vocab), docs), lm.encode_docs(vocab, tok, docs, list({w for d in docs for w in d}))
        assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_meeting_texts_costs_a_few_times_their_scoring():
    """The whole training fits beside the scoring only if a step does little more than its products of matrices (it cost over ten times the scoring, now about three)."""
    r, size = np.random.default_rng(0), 2500
    model = lm.Model(size, np.arange(size) // 50, np.arange(size) % 50, (50, 50))
    ids, lengths = (r.zipf(1.3, 120_000) % size).astype(np.int32), np.full(120, 1000)

    def least(f):
        took = []
        for _ in range(5):
            at = time.process_time()
            f()
            took.append(time.process_time() - at)
        return min(took)

    model.log_probs(ids, lengths)
    scoring = least(lambda: model.log_probs(ids, lengths))
    assert least(lambda: model.train(ids.astype(np.int64), lengths, rate=1e-4, once=True)) < 7 * scoring


def test_words_are_prefix_free(small):
    vocab, _ = small
    tok, _ = lm.Vocabulary.tokenizer(PATH)
    words = [w.encode() for w in ["the", "then", "t", "th", "cat", "über", "ü", "x", "xx", "<|endoftext|>", "日本", "日"]]
    codes = [tuple(c) for c in vocab.encode_words(tok, words)]
    assert len(set(codes)) == len(codes)
    assert not any(a != b and b[: len(a)] == a for a in codes for b in codes)
    assert all(lm.Vocabulary.TEXT_END not in c and max(c) < vocab.size for c in codes)


def test_neighbours_met_often_are_one_id(spark):
    """A pair of ids met a thousand times within the training words has an id of its own; words stay prefix-free, and rarer pairs stay two ids."""
    words = {"thnd": 900, "thndor": 600, "ndor": 400, "thndthnd": 300, "xyqthor": 5}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate((w, n) for w, n in words.items() for _ in range(3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    k = lm.learn(df, PATH, sample_docs=20, sample_bytes=100_000, size=300, steps=5, train_share=1.0, frequent=10)
    tok, _ = lm.Vocabulary.tokenizer(PATH)
    plain, codes = (v.encode_words(tok, [w.encode() for w in words]) for v in (lm.Vocabulary.learn(PATH, Counter({w.encode(): 3 * n for w, n in words.items()}), 300), k.vocab))
    assert sum(n * len(c) for n, c in zip(words.values(), codes)) < 0.75 * sum(n * len(c) for n, c in zip(words.values(), plain))
    made = {j: divmod(int(x), k.vocab.base) for j, x in enumerate(k.vocab.joints, k.vocab.base)}
    assert [[y for x in c for y in made.get(x, (x,))] for c in codes] == plain
    met = Counter(p for n, c in zip(words.values(), plain) for p in zip(c, c[1:]) for _ in range(3 * n))
    assert set(made.values()) == {p for p, n in met.items() if n >= 1000}
    assert len(made) > 1 and k.model.size >= k.vocab.size
    assert not any(a != b and b[: len(a)] == a for a in codes for b in codes)


def test_classes_are_small_where_ids_are_common():
    """The output of an id takes its classes and the members of its own; these are few for common ids, and gradients and sums hold for classes of any size."""
    share = 1 / np.arange(1, 2501) ** 1.05
    widths = np.asarray(lm.class_widths(share))
    assert widths.sum() == 2500
    assert len(widths) + np.repeat(widths, widths) @ share / share.sum() < 90  # 100 for 50 classes of 50
    r, counts = np.random.default_rng(2), np.arange(40.0)[::-1]
    cls, mem, shape = lm.word_classes(counts, np.asarray([41, 85, 7]), np.asarray([3.0, 2.0, 9.0]))
    assert len(set(zip(cls.tolist(), mem.tolist()))) == 40
    cls, mem = np.repeat([0, 1, 2], [3, 12, 285]), np.concatenate([np.arange(n) for n in (3, 12, 285)])
    m = lm.Model(300, cls, mem, (3, 285), dim=5, key=4, hidden=6)
    assert [w for _, _, w in m.runs] == [8, 16, 285]
    ids = np.asarray([3, 30, 5], np.int32)
    assert sum(math.exp(m.log_probs(np.append(ids, y).astype(np.int32), np.asarray([4]))[3]) for y in range(300)) == pytest.approx(1, abs=1e-3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    xw, y, ok = r.integers(0, 300, (3, lm.WINDOW)), r.integers(0, 40, (3, lm.BLOCK)), np.ones((3, lm.BLOCK), bool)
    ok[2, 3:] = ok[1, 1:] = False
    for ok in (ok, np.ones_like(ok)):
        _, g = m._grads(xw, y, ok)
        for k, i in (("wm", (0, 2, 1)), ("wm", (2, 1, 24)), ("bm", (1, 11)), ("wc", (2, 2)), ("E", (7, 2)), ("v", (1, 1)), ("w1", (0, 4))):
            old = m.p[k][i]
            m.p[k][i] = old + 1e-4
            up = m._grads(xw, y, ok)[0]
            m.p[k][i] = old - 1e-4
            down = m._grads(xw, y, ok)[0]
            m.p[k][i] = old
            assert g[k][i] == pytest.approx((up - down) / 2e-4, abs=2e-4), k


@pytest.mark.parametrize("frequent", [200_000, 4])
def test_score_documents(spark, frequent):
    base = ["The cat sat on the mat", "the dog  ran\tand\nran", "", None, "Über straße 日本 <|endoftext|>", "a " * 5000, "once only words here", "x\x0by\x85z", "THE THE the"]
    rows = [(i, base[i % len(base)], "c", i) for i in range(60)] + [(7, "again", "c", 1), (None, "no id", "c", 1)]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string, word string, row long").repartition(3), sample_docs=40, size=300, steps=30, frequent=frequent).collect()
    words = lambda t: (t or "").encode().lower().split()
    train = [words(t) for i, t, *_ in rows if not held(i, 5, 1)]
    count = Counter(w for d in train for w in d)
    count[None] = len(train)
    n, v = sum(count.values()), len(count)
    want = {}
    for i, t, *_ in rows:
        toks = [*words(t), None]
        want.setdefault((i, len(toks)), []).append((held(i, 5, 1), sum(count[w] > 0 for w in toks), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks)))
    assert len(got) == len(rows)
    for r in got:
        h, known, total, b = want[r.doc_id, r.n_tokens].pop()
        assert (r.held_out, r.n_known, r.train_tokens) == (h, known, total)
        assert r.base_score == pytest.approx(b, rel=1e-9)
        assert b + r.n_tokens * math.log10(0.4) - 1e-6 <= r.score < 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(empty, steps=5).collect() == []


def test_scores_by_a_plain_loop(spark):
    """Each word's probability as the product of its ids', mixed with the word's share; words, ends, rare and unknown words alike."""
    base = ["the cat sat on the mat", "a dog ran and ran", "Über straße", "", "rare words x1 x2", "the the the"]
    rows = [(i, base[i % len(base)]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    how = dict(sample_docs=60, sample_bytes=10_000, size=300, steps=25, train_share=0.5, frequent=3)
    train = df.where(~lm.remainder_is("doc_id", 5, 1))
    k = lm.learn(train, PATH, **how)
    got = {r.doc_id: r.score for r in lm.score_documents(df, **how).collect()}
    words = lambda t: t.encode().lower().split()
    count = Counter(w for i, t in rows if not held(i, 5, 1) for w in words(t))
    n_end = sum(not held(i, 5, 1) for i, _ in rows)
    total = sum(count.values()) + n_end + 0.5 * (len(count) + 2)
    tok, _ = lm.Vocabulary.tokenizer(PATH)
    for i, t in rows:
        spelled = [*k.vocab.encode_words(tok, words(t)), [lm.Vocabulary.TEXT_END]]
        logs = k.model.log_probs(np.asarray([x for w in spelled for x in w], np.int32), np.asarray([sum(map(len, spelled))]))
        want, at = 0.0, 0
        for w, ids in zip([*words(t), None], spelled):
            share = ((n_end if w is None else count[w]) + 0.5) / total
            want += math.log10(0.6 * math.exp(logs[at : at + len(ids)].sum()) + 0.4 * share)
            at += len(ids)
        assert got[i] == pytest.approx(want, abs=0.02)


def test_the_model_meets_every_training_text(spark, monkeypatch):
    """By default the network meets each training text once, however small its first sample; pairs of ids come from all of them."""
    rows = [(i, f"word{i} is there and w{i % 7}") for i in range(120)]
    df, met, go_on = spark.createDataFrame(rows, "doc_id long, text string"), [], lm.train_on_share
    monkeypatch.setattr(lm, "train_on_share", lambda *a, **b: met.append(go_on(*a, **b)))
    lm.score_documents(df, sample_docs=5, size=300, steps=5)
    docs = [t.encode().split() for i, t in rows if not held(i, 5, 1)]
    words = Counter(w for d in docs for w in d)
    counts = spark.createDataFrame(list(words.items()), "word binary, c long")
    tok, ranks = lm.Vocabulary.tokenizer(PATH)
    pairs = counts.mapInArrow(lm._pair_counts(PATH), "key long, n double").groupBy("key").sum("n").collect()
    vocab = lm.Vocabulary(PATH, lm.commonest({r[0]: r[1] for r in pairs}, 300), ranks)
    flat, n = lm.encode_docs(vocab, tok, docs, list(words))
    assert sum(met) == len(flat) == n.sum()
    follow, own = lm.id_counts(counts, vocab, 300, len(docs))
    want = np.zeros((300, 300))
    for w, ids in zip(words, vocab.encode_words(tok, list(words))):
        for a, b in zip(ids, ids[1:]):
            want[b, a] += words[w]
    assert (follow == want).all() and (own == np.bincount(flat, minlength=300)).all()


def test_training_goes_on_where_the_texts_lie(spark, small):
    """The mean of the tasks' weights is nearer to the texts than the weights they began with; an empty share changes nothing."""
    vocab, model = small
    texts = ["the dog and the cat ran on"] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tok, _ = lm.Vocabulary.tokenizer(PATH)
    flat, n = lm.encode_docs(vocab, tok, [t.encode().split() for t in texts[:1]], texts[0].encode().split())
    before, old = model.log_probs(flat.astype(np.int32), n).sum(), {k: v.copy() for k, v in model.p.items()}
    assert lm.train_on_share(df, vocab, model, 0.0) == 0 and all((model.p[k] == v).all() for k, v in old.items())
    assert lm.train_on_share(df, vocab, model, 1.0) == len(flat) * 60
    assert model.log_probs(flat.astype(np.int32), n).sum() > before
    model.p, model.tables = old, None


def test_model_beats_the_base_on_held_out_texts(spark):
    got = lm.score_documents(spark.read.parquet(f"{SF}/documents.parquet"), steps=250).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in langid.identify(docs).collect() if r.held_out]
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) > 0.98
    odd = [(1, None, "en"), (2, "", "en"), (3, " 123 !? ٣", None), (4, "the house of the", None), (5, "x" * 200_000, "en"), (None, "the", "en"), (4, "the house of the", None), (7, "Ж", None)]
    rows = langid.identify(docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10_000 + (i or 0), t, v) for i, t, v in odd], "doc_id long, text string, lang string")).withColumn("score", langid.F.lit("x"))).where("doc_id >= 10000").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id - 10_000, []).append(r)
    assert [by[i][0].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1][0].score == 0
    assert len(by[4]) == 2 and by[4][0].lang_pred == by[4][1].lang_pred and abs(by[4][0].score - by[4][1].score) < 1e-5
    assert by[7][0].lang_pred != "und"
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(none).collect()] == [("und", 0.0)]
    assert langid.identify(none.limit(0)).collect() == []
    one = spark.createDataFrame([(i, "abc def", "xx") for i in range(8)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(one).collect()} == {"xx"}


def test_sampled_ids_are_the_least_hashes(spark):
    """As a plain ranking chooses, with a group that holds most rows, repeated rows and a null group left to the caller."""
    F = langid.F
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("lang"))
    rows = rows.unionByName(rows.where("doc_id < 50")).withColumn("h", F.xxhash64("doc_id", F.lit(31)))
    want = {v: {r.doc_id for r in rows.where(F.col("lang") == v).distinct().orderBy("h").limit(40).collect()} for v in "ab"}
    got = sampled_ids(rows.drop("h"), "doc_id", "lang", 40, 31).collect()
    assert len(got) == 80 and {v: {r.doc_id for r in got if r.lang == v} for v in "ab"} == want
    assert sorted(sampled_ids(rows.drop("h"), "doc_id", "lang", 40, 31, max_broadcast=1).collect()) == sorted(got)
    assert sampled_ids(rows.limit(0), "doc_id", "lang", 40, 31).collect() == []


def test_languages_of_repeated_ids_are_learned(spark):
    """A group's size is that of its ids, not of its rows; many small languages are all learned."""
    rows = [(i, "abc def abd", "en") for i in range(400)] + [(1000 + i, "uvw xyz uvx", "de") for i in range(6) for _ in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang for r in sampled_ids(docs, "doc_id", "lang", 50, 31).select("lang").distinct().collect()} == {"en", "de"}
    got = {r.lang_pred for r in langid.identify(docs).where("doc_id >= 1000").collect()}
    assert got == {"de"}


def test_predictions_by_a_plain_loop():
    """Families, machines and score as a loop over one dense row after the other gives them; the sparse machine equals the dense one."""
    r = np.random.default_rng(0)
    names = ["aa", "ab", "ba", "bb", "c"]
    texts = [(v, " ".join("".join(r.choice(list(v + "xyz"[: 1 + k]), 5)) for _ in range(20)).encode()) for k, v in enumerate(names) for _ in range(12)]
    x = langid.Rows([langid.features(t) for _, t in texts])
    m = langid.Identifier(x, [v for v, _ in texts])
    dense = x.dense()
    assert np.allclose(np.linalg.norm(dense, axis=1), 1, atol=1e-5)
    got, score = m.predict(dense)
    for i, row in enumerate(dense):
        z = row @ m.w[:-1] + m.w[-1]
        share = lambda v: 1 / (1 + math.exp(-4 * v))
        fam = [share(z[k]) for k in m.family_rows] or [1.0]
        k = max(range(len(fam)), key=lambda j: (fam[j], -j))
        wins = {a: 0.0 for a in m.families[k]}
        for f, a, b, at in m.pairs:
            if f == k:
                wins[a] += share(z[at])
                wins[b] += 1 - share(z[at])
        best = max(wins, key=lambda a: (wins[a], -a))
        want = fam[k] * (wins[best] / (len(wins) - 1) if len(wins) > 1 else 1)
        if sum(row[j] ** 2 * m.likely[j, best] for j in np.flatnonzero(row)) < m.floor[best]:
            want = 0
        assert got[i] == m.langs[best] and score[i] == pytest.approx(want, abs=1e-4)
    assert np.mean([g == v for g, (v, _) in zip(got, texts)]) > 0.9
    y = np.where(np.arange(len(x)) % 12 < 6, 1, -1)
    full = langid.train_svm(x, y, rounds=20)
    old, langid.DENSE_ROWS = langid.DENSE_ROWS, 0
    try:
        assert np.allclose(full, langid.train_svm(x, y, rounds=20), atol=1e-4)
    finally:
        langid.DENSE_ROWS = old


def test_a_giant_text_does_not_use_up_the_sample(spark):
    rows = [(0, "z" * 5000, "xx")] + [(i, "abc def ghi", "xx") for i in range(1, 12)] + [(i, "uvw rst opq", "yy") for i in range(20, 32)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, sample_bytes=2000).collect()}
    assert all(got[i] == v for i, _, v in rows[1:])
    labels = spark.createDataFrame([(i, int(v == "xx")) for i, _, v in rows], "doc_id long, quality int")
    got = {r.doc_id: r.predicted for r in quality.quality_scores(docs, labels, sample_bytes=2000).collect()}
    assert all(got[i] == (v == "xx") for i, _, v in rows[1:])


def test_families_group_likes():
    m = np.asarray([[1, 0.9, 0], [0.9, 1, 0.1], [0, 0, 1], [0, 0.1, 1]], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert langid.families(m, 2) == [[0, 1], [2, 3]]


def test_quality_by_a_plain_loop():
    """The mean of learned bucket vectors, then softmax, text by text; ties of two equal classes stay at one half."""
    texts, y = [b"good text here", b"bad bad bad bad", b"fine words now", b"spam spam spam", b""] * 6, np.asarray([1, 0, 1, 0, 0] * 6)
    m = quality.Classifier(texts, y, np.ones(len(y)))
    for t in [*texts[:5], None, b"unseen thing"]:
        z = sum(float(m.share[b]) for b in quality.buckets(t)) / len(quality.buckets(t)) + m.bias
        assert m.score(t) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)
    assert all((m.score(t) >= 0.5) == v for t, v in zip(texts, y))
    even = quality.Classifier([], np.zeros(0, int), np.zeros(0))
    assert even.score(b"x") == even.score(None) == 0.5


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in quality.quality_scores(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in got) / len(got) > 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "w " * 100_000, 0), (4, "w " * 100_000, 0), (None, "x", 0)], "doc_id long, text string, quality int")
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == 6 and len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    messy = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    assert quality.quality_scores(odd, messy).count() == 6
    assert quality.quality_scores(odd.limit(0), labels).collect() == []
