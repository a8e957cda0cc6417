"""Token counts, packing, matrices and decontamination."""

import hashlib
import itertools
import json
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphbench.llm import _units, decontam
from graphbench.llm._common import tokenizer_path
from graphbench.llm.packing import Bins, pack, pack_documents
from graphbench.llm.token_count import counter, prove_whole_tokens, token_counts
from graphbench.llm.token_matrix import RoomTree, best_fit_decreasing, pack_matrix, unpack

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ODD = ["", None, "a  b", "a \nb\n\n c", "  x ", "x<|endoftext|>y  z", "A<|ENDOFTEXT|>B", "<|startoftext|> q", "tab\t\tb   c\x1c d\x85e", "'s it's  'S", "１２ ñ́ é  　a", "word " * 5000, "ABC" * 3000, "\x00 \x1f", "😀  👍🏽"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 1\n\t'se.é́  \x1c　İΣ<|>ñ")), max_size=40))
def test_units_equal_library(text):
    for path, kind in ((BYTE, "spaced"), (WORD, "words")):
        want = _units.library(path).encode(text, add_special_tokens=False).ids
        assert _units.text_encoder(path, kind).encode([text.encode()])[0].tolist() == want
        if path == BYTE:
            assert counter(BYTE, lambda: prove_whole_tokens(BYTE)).counts([text.encode()]) == [len(want)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(st.characters(min_codepoint=32, max_codepoint=0x260), max_size=30), st.sampled_from(sorted(_units.library(BYTE).get_vocab())).map(lambda t: _units.library(BYTE).decoder.decode([t]))), max_size=12))
def test_pieces_equal_library(parts):
    """Alone and run together, whatever pairs of tokens meet; lists of units give flat ids in order."""
    units = [u for u in [*parts, "".join(parts), " " + "".join(parts)] if u]
    flat, n = _units.text_encoder(BYTE, "spaced").merger.encode(units)
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == _units.encode_ids(_units.library(BYTE), units) or not units


def test_only_odd_units_go_to_the_library(monkeypatch, tmp_path):
    """Merging new units was most of a task's time; a tokenizer that does more than merge still has its library for all."""
    asked, ask = [], _units.encode_ids
    monkeypatch.setattr(_units, "encode_ids", lambda tok, texts: asked.extend(texts) or ask(tok, texts))
    text = "Plain words, über 12 o'clock xqzvwk\u3000\u65e5\u672c \x1c  end"
    want = _units.library(BYTE).encode(text, add_special_tokens=False).ids
    assert _units.TextEncoder(BYTE, "spaced").encode([text.encode()])[0].tolist() == want
    assert asked == ["\u3000", "\u65e5\u672c", " \x1c"]
    other = json.loads(open(BYTE, encoding="utf-8").read())
    other["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "lower.json").write_text(json.dumps(other), encoding="utf-8")
    assert _units.TextEncoder(str(tmp_path / "lower.json"), "spaced").merger is None


def test_unit_table_forgets():
    t = _units.UnitTable(lambda us: [[int(u)] * int(u) for u in us], limit=3)
    assert t.ids(t.rows(["1", "2", "2"])).tolist() == [1, 2, 2, 2, 2]
    t.settle()
    assert t.ids(t.rows(["3", "1", "4"])).tolist() == [3, 3, 3, 1, 4, 4, 4, 4]
    t.settle()
    assert list(t.index) == ["1"]
    assert t.ids(t.rows(["5", "2", "1"])).tolist() == [5] * 5 + [2, 2, 1]


def test_unit_table_bounds_bytes():
    t = _units.UnitTable(lambda us: [[len(u)] for u in us], limit_bytes=100)
    assert t.ids(t.rows(["a", "a", "b" * 500, "c"])).tolist() == [1, 1, 500, 1]
    t.settle()
    assert list(t.index) == ["a"] and t.held == 5  # what follows a unit beyond the bound goes with it
    assert t.ids(t.rows(["c", "b" * 500, "a"])).tolist() == [1, 500, 1]


def test_token_counts(spark):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(0, "a b", 0), (None, "a", 0)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")).collect()
    lib = _units.library(BYTE)
    want = sorted((d is None, d or 0, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def check_bins(lengths, number, offset, cap):
    for b in set(number.tolist()):
        at = 0
        for i in sorted(np.flatnonzero(number == b), key=lambda i: offset[i]):
            assert offset[i] == at
            at += lengths[i]
        assert at <= cap
    assert sorted(set(number.tolist())) == list(range(max(number.tolist(), default=-1) + 1))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120))
def test_packers(lengths):
    for fn in (pack, lambda x, c: best_fit_decreasing(np.sort(x)[::-1], c)):
        number, offset = fn(np.asarray(lengths, np.int64), 100)
        check_bins(lengths if fn is pack else sorted(lengths)[::-1], number, offset, 100)


def squares(bins):
    return sum(n * n for n in bins.load)


def test_local_search_steps():
    """Moves, one for one, one for two and two for one; each step raises the squares, whose items stay the same."""
    for lengths, groups in (([50, 30, 20, 10], [[0, 1], [2, 3]]), ([60, 30, 40, 20], [[0, 1], [2, 3]]), ([70, 20, 12, 13], [[0, 1], [2, 3]]), ([10, 15, 60, 40, 5], [[0, 1, 2], [3, 4]])):
        b = Bins(np.asarray(lengths), 100)
        for k, g in enumerate(groups):
            b.by_size.append({})
            b.load.append(0)
            for i in g:
                b._put(i, k)
        before = squares(b)
        assert b.improve() == b.steps > 0 and squares(b) == b.squares > before
        assert sorted(i for sizes in b.by_size for held in sizes.values() for i in held) == list(range(len(lengths)))
        assert b.improve() == 0


def left_steps(bins):
    """Steps by which the fuller of two underfull bins gains, found by trying all."""
    open_ = [(n, [x for x, held in s.items() for _ in held]) for s, n in zip(bins.by_size, bins.load) if 0 < n < bins.cap]
    found = 0
    for i, (n, mine) in enumerate(open_):
        for j, (m, theirs) in enumerate(open_):
            if i == j or n < m or (n == m and i > j):
                continue
            out = [(), *[(x,) for x in mine], *itertools.combinations(mine, 2)]
            come = [*[(x,) for x in theirs], *itertools.combinations(theirs, 2)]
            found += sum(0 < sum(c) - sum(o) <= bins.cap - n for o in out for c in come if len(o) + len(c) <= 3 and (len(c) == 1 or len(o) == 1))
    return found


def fewest(lengths, cap):
    """The least number of bins, by trying all."""
    best = len(lengths)

    def place(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(lengths):
            best = len(loads)
            return
        for k in sorted({loads[k]: k for k in range(len(loads)) if loads[k] + lengths[i] <= cap}.values()):
            place(i + 1, [*loads[:k], loads[k] + lengths[i], *loads[k + 1 :]])
        place(i + 1, [*loads, lengths[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=9))
def test_packing_against_all_packings(lengths):
    """No step is left, and of small sets the search needs one bin more than the best packing at most."""
    b = Bins(np.asarray(lengths), 60).next_fit()
    start, before = b.count, squares(b)
    b.improve()
    assert left_steps(b) == 0 and squares(b) >= before and b.count <= start
    assert fewest(sorted(lengths, reverse=True), 60) <= b.count <= fewest(sorted(lengths, reverse=True), 60) + 1


def test_search_packs_as_well_as_best_fit_decreasing():
    r = np.random.default_rng(5)
    for x in (r.integers(1, 2000, 3000), r.integers(800, 1500, 2000), np.minimum(4096, r.lognormal(6, 1.3, 3000).astype(int) + 1)):
        b = Bins(x, 4096).next_fit()
        start = b.count
        assert b.improve() > 0 and b.count < start
        assert b.count <= best_fit_decreasing(np.sort(x)[::-1], 4096)[0].max() + 1


def test_room_tree():
    t = RoomTree(9)
    assert t.least(1) == -1
    for r in (3, 7):
        t.add(r, 1)
    assert [t.least(n) for n in (1, 3, 4, 7, 8)] == [3, 3, 7, 7, -1]


def test_pack_documents(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(5, "again", 2), (5, "again", 2)]
    cap, lib = 64, _units.library(WORD)
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, piece int").repartition(3), cap, shard_rows=20).collect()
    want = []
    for d, t, _ in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), cap)):
            part = ids[s : s + cap]
            want.append((d, p, s, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= cap
    assert len(seqs) <= -(-sum(w[3] for w in want) // cap) + 1
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    odd = spark.createDataFrame([(None, "no id"), (None, None), (3, "x")], "doc_id smallint, text string")
    assert sorted((r.doc_id or 0, r.length, r.offset) for r in pack_documents(odd).collect())[-1][0] == 3
    assert len({(r.sequence_id, r.offset) for r in pack_documents(odd).collect()}) == 3


@pytest.mark.parametrize(("path", "kind", "end"), [(WORD, "words", 49407), (BYTE, "spaced", 50256)])
def test_matrix_round_trip(spark, path, kind, end):
    rows = [(i, t, i) for i, t in enumerate(ODD)]
    got = pack_matrix(spark.createDataFrame(rows, "doc_id long, text string, ids long").repartition(2), width=128, path=path, kind=kind, end_id=end, pad_id=end, buffer_tokens=700).collect()
    lib = _units.library(path)
    back = unpack(got, 128)
    assert sorted(back) == list(range(len(ODD)))
    for i, t in enumerate(ODD):
        assert back[i].tolist() == [*lib.encode(t or "", add_special_tokens=False).ids, end]
    for r in got:
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128 and len(r.ids) == len(r.positions) == 256
        pos = np.frombuffer(r.positions, "<u2")
        for a, b in zip([*r.cu_seqlens], [*r.cu_seqlens[1:], 128]):
            assert pos[a:b].tolist() == list(range(b - a))


def test_matrix_holds_the_text_by_default(spark):
    """Capitals, line breaks and runs of white space come back from the ids."""
    texts = ["Def F(x):\n\treturn  X\n", "ÄÖ Two  Words\r\n", ""]
    back = unpack(pack_matrix(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), 2048)
    lib = _units.library(BYTE)
    assert [lib.decode(back[i].tolist()[:-1], skip_special_tokens=False) for i in range(3)] == texts
    assert all(back[i][-1] == 50256 for i in range(3))


def test_matrix_edges(spark):
    """Null, repeated and small ids, an empty table, and a packing no worse than one of all segments at once."""
    rows = [(None, "a b"), (None, None), (7, "c"), (7, "c")]
    got = pack_matrix(spark.createDataFrame(rows, "doc_id smallint, text string").coalesce(1), width=16).collect()
    assert sorted((x is None, x or 0) for r in got for x in r.doc_ids) == [(False, 7), (False, 7), (True, 0), (True, 0)]
    assert pack_matrix(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError, match="65,536"):
        pack_matrix(spark.createDataFrame(rows, "doc_id smallint, text string"), end_id=70_000)
    texts = [(i, "w " * (i * 7 % 40)) for i in range(60)]
    got = pack_matrix(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), width=64).collect()
    lib = _units.library(BYTE)
    sizes = sorted((min(64, n - k) for _, t in texts for n in [len(lib.encode(t, add_special_tokens=False).ids) + 1] for k in range(0, n, 64)), reverse=True)
    number, offset = best_fit_decreasing(np.asarray(sizes), 64)
    check_bins(sizes, number, offset, 64)
    assert len(got) == number.max() + 1 and sum(r.n_tokens for r in got) == sum(sizes)


def brute(doc, items, size=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, found = words(doc), set(), set()
    for i, t in items:
        iw = words(t)
        n = min(size, len(iw))
        wins = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in wins:
                found.add(i)
                hit |= set(range(k, k + n))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark):
    a = "Über den Fluss, the Quick-brown fox; jumps over 12 lazy dogs and runs away again"
    items = [(1, a), (10, "short one"), (2, ""), (3, None), (4, a + " x"), (4, "short one"), (5, "ab"), (6, "ab ab ab")]
    docs = [None, "", "nothing", f"é {a.upper()} tail", f"ü {a} {a}", "the SHORT... one", "xab ab", "ab ab ab ab", a[:60], "b " * 30000 + a, "short one" * 3, " ... ", "10 ab-ab AB"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(docs)] * 2, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    low = [(i, t) for i, t in items]
    for r in decontam.decontaminate(df, bench).collect():
        t = docs[r.doc_id]
        want = brute(t.replace("Ü", "Ü") if t else t, low)
        assert (r.n_words, r.n_hit, r.items) == want, (t, r)
        for s in r.spans:
            assert brute(t[s.start : s.end], low)[0] == brute(t[s.start : s.end], low)[1]
        assert sum(brute(t[s.start : s.end], low)[0] for s in r.spans) == r.n_hit
    assert decontam.decontaminate(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(df.limit(0), bench).count() == 0
    assert decontam.items_digest([2, 10]) == hashlib.sha256(b"10,2").hexdigest()


def test_decontamination_in_shards(spark):
    """A benchmark beyond the bound is scanned in shards, with long items cut, and gives the same rows."""
    rnd = __import__("random").Random(3)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 2, 9, 10, 15, 400])))) for i in range(20)] + [(None, "w1 w2"), (30, None)]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(40)) + " - " + (rnd.choice(items)[1] or "")[:200], "k") for i in range(60)] + [(60, None, "k"), (60, "", "k"), (None, items[5][1], "k")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, n_hit string"), spark.createDataFrame(items, "item_id smallint, text string")
    rows = lambda **how: sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r.items, [(s.start, s.end) for s in r.spans]) for r in decontam.decontaminate(df, bench, **how).collect())
    whole = rows()
    known = [(i, t) for i, t in items if i is not None]
    assert sorted((n, h, i) for _, n, h, i, _ in whole) == sorted(brute(t, known) for _, t, _ in docs)
    assert rows(shard_bytes=300) == whole == rows(shard_bytes=1000)
    lists = list(decontam.shards(bench.selectExpr("item_id as i", "text as t").where("i is not null and t is not null"), 300, 10))
    assert len(lists) > 3
    cut = {(i, w) for part in lists for i, t in part for w in zip(*(t.split()[k:] for k in range(10)))}
    assert cut == {(i, w) for i, t in known if t for w in zip(*(t.encode().split()[k:] for k in range(10)))}


def test_scanner_words():
    """Over 65,536 distinct words, and words that only differ at their borders."""
    words = [f"q{i}" for i in range(70_000)]
    s = decontam.Scanner([(1, " ".join(words)), (2, "ab c")], 10)
    assert s.scan(" ".join(words[65_530:65_545]).encode())[1].tolist() == [[0, 15]]
    assert s.scan(b"a bc abc ab ab c")[1:][0].tolist() == [[4, 6]] and s.scan(b"a bc")[2] == []
    assert decontam.Scanner([], 10).scan(b"a b")[2] == []
