"""Operators on pairs, held against brute force."""

import random

import numpy as np
import pytest

from graphbench.llm.embed_dedup import cells_of, embedding_duplicates, unit
from graphbench.llm._common import spread_join
from graphbench.llm._components import connected_components
from graphbench.llm.minmax import MinMax, _digest, near_duplicates, shingles


def classes(ids, links):
    low = {i: i for i in ids}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def word_sets(rows, size):
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        n = min(size, len(w)) or 1
        out[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    return out


def texts():
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(400)] + ["Ä", "tab\x0bx", "ÉCOLE"]
    base = [[rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 12, 60, 200]))] for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(rnd.choice([1, 2, 9])):
            w = list(b)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append(" ".join(w))
    rows += ["", " \n ", None, "A b c", "a B c", "x" * 5000, "long " * 30000]
    rnd.shuffle(rows)
    return list(enumerate(rows, 3))


@pytest.mark.parametrize(("size", "num", "block"), [(3, 85, 1024), (5, 80, 2)])
def test_near_duplicates(spark, size, num, block):
    rows = texts()
    docs = spark.createDataFrame([(d, t, d, "x") for d, t in rows] + [(rows[0][0], rows[0][1], 1, "again"), (None, "a", 1, "y")], "doc_id long, text string, n long, key string").repartition(3)
    sets = word_sets(rows, size)
    ids = sorted(sets)
    want = classes(ids, [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])])
    got = near_duplicates(docs, size, num, 100, block=block, broadcast_ids=10 if block == 2 else 10**6).collect()
    assert sorted(r.doc_id for r in got) == ids
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (want[r.doc_id] == r.doc_id) for r in got)
    assert near_duplicates(docs.limit(0)).collect() == []


def test_chain_and_hidden_pairs(spark):
    """A bucket whose smallest member links with few: the others must still find each other."""
    words = [f"v{i}" for i in range(300)]
    rows = [(0, " ".join(words))]
    for i in range(1, 40):
        w = list(words)
        for k in range(5):
            w[(i // 4) * 29 % 250 + k * 10] = f"z{i // 4}"
        w[(i * 7) % 300] = f"y{i}"
        rows.append((i, " ".join(w)))
    sets = word_sets(rows, 3)
    want = classes(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100, block=8)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_repeated_ids_link_by_the_set_that_counts(spark):
    """Two texts of one length under one id: the one with the smaller digest stands for it, and no link of it is lost."""
    rnd = random.Random(9)
    vocab = [f"u{i}" for i in range(5000)]
    rows, chosen = [], {}
    for i in range(30):
        two = [" ".join(rnd.choice(vocab) for _ in range(40)) for _ in range(2)]
        least = min(two, key=lambda t: _digest(shingles(t.encode(), 3)))
        chosen[i] = least
        rows += [(i, t) for t in two]
        other = least.split()
        other[0] = "new"
        rows.append((100 + i, " ".join(other)))
    rnd.shuffle(rows)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()}
    assert all(got[100 + i] == i == got[i] for i in range(30))


def test_large_groups_and_hot_pivots(spark):
    """Equal copies in many parts, near copies of one text, and strangers that share a passage."""
    rnd = random.Random(2)
    words = [f"v{i}" for i in range(120)]
    rows = [(i, " ".join(words)) for i in range(150)]
    for i in range(150, 260):
        w = list(words)
        w[rnd.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(words[:60] + [f"s{i}_{k}" for k in range(rnd.choice([8, 40]))])) for i in range(260, 330)]
    sets = word_sets(rows, 3)
    ids = sorted(sets)
    want = classes(ids, [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    got = near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"), 3, 85, 100, block=16, part_rows=3)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    with pytest.raises(ValueError, match="integer"):
        near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_bands_use_four_permutations():
    m = MinMax(10)
    h = shingles(b"a b c d e f g h i j", 3)
    low_high = m.signature(h)
    half = len(low_high) // 2
    source = {int(v): k % half for k, v in enumerate(low_high)}
    v = low_high.reshape(4, 10).copy()
    v[2:] = np.roll(v[2:], -1, axis=1)
    assert all(len({source[int(x)] for x in v[:, j]}) == 4 for j in range(10))


def test_spread_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", i % 2) for i in range(300)], "i long, k string, z int")
    table = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 200, 3)]], "k string, v int")
    for how in ("inner", "left"):
        want = sorted(rows.join(table, "k", how).select("i", "k", "z", "v").collect(), key=str)
        assert sorted(spread_join(rows, table, ["k"], "i", how, least=10).select("i", "k", "z", "v").collect(), key=str) == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(1000, 1000), (None, 4), (2000, 1999)], "a long, b long").repartition(7)
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(401)}, 1999: 1999, 2000: 1999}


def test_shingle_edges():
    assert len(shingles(None, 3)) == len(shingles(b" \t", 3)) == 0
    assert len(shingles(b"a b", 3)) == 1
    assert (shingles(b"A b C d", 3) == shingles(b"a B c\x0bD", 3)).all()
    assert len(shingles(b"a " * 1000, 3)) == 1


def vectors():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(260):
        x = rng.normal(size=8)
        if i % 3 and rows:
            x = np.asarray(rows[rng.integers(len(rows))][1]) + 0.12 * rng.normal(size=8)
        rows.append((i, x.astype(np.float32).tolist(), int(i % 2)))
    rows += [(300 + k, rows[5][1], rows[5][2]) for k in range(30)] + [(340, [2 * v for v in rows[5][1]], rows[5][2])]
    bad = [(400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] * 8, 0), (403, [float("inf")] + [1.0] * 7, 0), (404, [None] + [1.0] * 7, 0), (405, rows[5][1], None), (406, [1.0, 2.0], 0), (407, [], 0)]
    return rows, bad


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings(spark, block):
    rows, bad = vectors()
    df = spark.createDataFrame([(*r, r[0]) for r in rows + bad] + [(0, rows[0][1], 0, 9), (None, rows[0][1], 0, 9)], "vec_id long, embedding array<float>, label int, copies long")
    links = []
    for i, (a, x, la) in enumerate(rows):
        for b, y, lb in rows[:i]:
            x64, y64 = np.asarray(x, np.float64), np.asarray(y, np.float64)
            if la == lb and x64 @ y64 / np.linalg.norm(x64) / np.linalg.norm(y64) >= 0.93:
                links.append((a, b))
    ids = [r[0] for r in rows + bad]
    want = classes(ids, links)
    n = {i: sum(i in p for p in links) for i in ids}
    got = {r.vec_id: r for r in embedding_duplicates(df, cell_rows=30 if block == 16 else 2048, block_rows=block).collect()}
    assert sorted(got) == sorted(ids)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_links for i, r in got.items()} == n
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert embedding_duplicates(df.limit(0)).collect() == []


def test_cells_lose_no_pair():
    rng = np.random.default_rng(3)
    x = unit(np.repeat(rng.normal(size=(60, 5)), 5, axis=0) + 0.15 * rng.normal(size=(300, 5)))
    home, reach = cells_of(x, x[::37], 0.374)
    close = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T)) <= 0.374
    for i, j in zip(*np.nonzero(close)):
        assert reach[i, home[j]]
    assert reach.mean() < 0.9
