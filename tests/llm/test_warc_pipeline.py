"""Archives, and the pipeline stage by stage."""

import random

import corpus_pipeline
from graphbench.llm import langid, quality, warc

RECORDS = "record_id long, url string, time long, kind string, headers map<string,string>, body string, state int"


def test_canonical_url(spark):
    urls = ["HTTP://WWW.Example.com:80/a/?utm_source=x#top", "https://m.example.com/a?ref=x&b=1", "example.com/a?b=1&utm_x=2&c=3&&", None, " https://example.com ", "https://example.com/A/", "http://a.b:443/x", "https://a.b:443/x", "https://a.b:80", "ftp://a.b:80/", "a.b:80/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(warc.canonical_url(warc.F.col("url"))).collect()]
    assert got == ["example.com/a", "m.example.com/a?b=1", "example.com/a?b=1&c=3", None, "example.com", "example.com/A", "a.b:443/x", "a.b/x", "a.b:80", "a.b:80", "a.b"]


def brute(rows):
    out = []
    for rid, u, t, kind, h, *_ in rows:
        if kind != "revisit" or t is None:
            continue
        if u is None:
            out.append((rid, None, "no_url", None))
            continue
        base = max(((x[2], x[0], x) for x in rows if x[3] == "response" and x[1] == u and x[2] is not None and x[2] < t), default=None, key=lambda x: x[:2])
        low = {k.lower(): v for k, v in sorted((h or {}).items())}
        state = "no_base"
        if base:
            b = {k.lower(): v for k, v in (base[2][4] or {}).items()}
            strip = lambda v: v.removeprefix("W/") if v else v
            if low.get("etag") and b.get("etag"):
                state = "resolved" if strip(low["etag"]) == strip(b["etag"]) else "mismatch"
            elif low.get("last-modified") and b.get("last-modified"):
                state = "resolved" if low["last-modified"] == b["last-modified"] else "mismatch"
            else:
                state = "no_validator"
        merged = None
        if state == "resolved":
            merged = b | {k: v for k, v in low.items() if k not in warc.KEPT_FROM_STORED}
        out.append((rid, base[1] if base else None, state, merged))
    return out


def test_resolution(spark):
    rnd, rows = random.Random(2), []
    for i in range(300):
        kind = rnd.choice(["response", "revisit"])
        h = rnd.choice([None, {}, {"ETag": rnd.choice(["a", "W/a", "b"]), "Content-Length": str(i), "X": str(i)}, {"Last-Modified": rnd.choice("mn"), "Date": str(i)}, {"etag": "a", "last-modified": "m", "Content-Type": kind}])
        rows.append((i, rnd.choice(["hot.com/x"] * 4 + ["b.com/", "b.com", None]), rnd.choice([None, *range(40)]), kind, h, f"body{i}" if kind == "response" else None, 0))
    rows.append((999, "b.com", 5, "request", None, None, 0))
    flat = [(r[0], r[1].rstrip("/") if r[1] else None, *r[2:]) for r in rows]
    df = spark.createDataFrame(rows, RECORDS)
    for buckets in (1, 7, 64):
        got = warc.resolve_revisits(df, buckets).collect()
        assert sorted((r.record_id, r.base_id, r.state, r.headers) for r in got) == sorted(brute(flat), key=lambda x: x[0])
        assert all(r.body == (f"body{r.base_id}" if r.state == "resolved" else None) for r in got)
    assert warc.resolve_revisits(df.limit(0)).collect() == []


def test_repeated_record_ids_and_rows(spark):
    """A record id that stands for several records doesn't mix up their payloads; repeated rows are resolved each; a long body comes through."""
    long = "y" * 3_000_000
    rows = [(1, "a.com", 1, "response", {"ETag": "a"}, "A", 0), (1, "b.com", 1, "response", {"ETag": "b"}, long, 0), (1, "b.com", 1, "response", {"ETag": "b"}, long, 0)]
    rows += [(2, "b.com", 5, "revisit", {"ETag": "b"}, None, 0)] * 2 + [(2, "a.com", 6, "revisit", {"ETag": "a", "X": "1"}, None, 0), (None, "a.com", 7, "revisit", {"ETag": "a"}, None, 0)]
    got = warc.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()
    assert sorted((r.record_id or 0, r.canonical_url, r.state, r.base_id, r.body) for r in got) == [(0, "a.com", "resolved", 1, "A"), (2, "a.com", "resolved", 1, "A"), *[(2, "b.com", "resolved", 1, long)] * 2]
    twins = [(1, "c.com", 1, "response", {"ETag": "c"}, x, 0) for x in "zy"] + [(9, "c.com", 2, "revisit", {"ETag": "c"}, None, 0)]
    assert [r.body for r in warc.resolve_revisits(spark.createDataFrame(twins, RECORDS)).collect()] == ["y"]


def test_from_archive_to_resolution(spark, tmp_path):
    """ISO times, and later partial or failed captures that are no base."""
    at = "2024-01-01T00:00:0{}Z".format
    records = [("r1", "response", "http://a/x", at(1), 200, {"ETag": '"1"'}, b"whole"), ("r2", "response", "http://a/x", at(2), 206, {"ETag": '"1"'}, b"part"), ("r3", "response", "http://a/x", at(3), 503, {}, b"no"), ("v", "revisit", "http://a/x", at(4), 304, {"ETag": 'W/"1"'}, b""), ("w", "revisit", "http://a/x", "no time", 304, {}, b"")]
    (tmp_path / "a.warc.gz").write_bytes(warc.warc_bytes(records))
    got = warc.resolve_revisits(warc.read_warc(spark, str(tmp_path))).collect()
    assert [(r.record_id, r.base_id, r.state, bytes(r.body), r.time) for r in got] == [("v", "r1", "resolved", b"whole", 1704067204)]


def test_warc_round_trip(spark, tmp_path):
    records = [(f"<urn:{i}>", k, f"http://a/{i}", "2024-01-01T00:00:00Z", s, {"etag": str(i)}, b) for i, (k, s, b) in enumerate([("response", 200, b"x\r\n\r\ny"), ("revisit", 304, b""), ("response", 200, bytes(range(256)) * 2000)])]
    data = warc.warc_bytes(records)
    assert list(warc.iter_records(data)) == records
    assert list(warc.iter_records(data[:-20]))[:2] == records[:2]
    assert list(warc.iter_records(b"")) == list(warc.iter_records(b"junk\n")) == []
    (tmp_path / "a.warc.gz").write_bytes(data)
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.record_id, r.kind, r.url, r.time, r.status, r.headers, bytes(r.body)) for r in got) == sorted(records)


SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    """Each stage against what its operator or a plain loop says about its own input."""
    from test_pairs import classes, word_sets
    from test_tokens import brute as hits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(rows)
            break
        assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        assert all(rows[d] == r for d, r in got.items())
        if name == "language_id":
            want = {r.doc_id for r in langid.identify(docs).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LANG_SCORE}
        elif name == "quality":
            want = {r.doc_id for r in quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
        elif name == "near_dedup":
            sets = word_sets([(d, r.text) for d, r in rows.items()], 5)
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            want = {d for d, c in classes(sorted(sets), links).items() if d == c}
        else:
            want = {d for d, r in rows.items() if not hits(r.text, bench)[1]}
        assert set(got) == want, name
        docs = spark.createDataFrame(list(got.values()), docs.schema)
    assert corpus_pipeline.run(spark, SF).count() == out.count()


def test_stage_edges(spark):
    """What each stage says of nulls, empty and long texts, ties, repeated rows and empty tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = lambda rows: spark.createDataFrame(rows, docs.schema)
    good = docs.where("lang = 'en'").orderBy(warc.F.desc("n_chars")).first().text
    odd = [(900_001, None, None, None, None), (900_002, "", "en", "s", 0), (None, good, None, "s", 1), (900_004, good, "en", "s", 1), (900_004, good, "en", "s", 1), (900_005, good * 40, "en", "s", 1)]
    stages = dict(corpus_pipeline.STAGES)
    out = lambda name, rows: sorted((r.doc_id or 0) for r in stages[name](spark, cols(rows), SF).collect())
    both = docs.unionByName(cols(odd))
    assert sorted((r.doc_id or 0) for r in stages["language_id"](spark, both, SF).where("doc_id is null or doc_id > 900000").collect()) == [0, 900_004, 900_004, 900_005]
    kept = [r.doc_id for r in stages["quality"](spark, both, SF).where("doc_id > 900000").collect()]
    assert kept.count(900_004) in (0, 2) and (900_001 in kept) == (900_002 in kept)
    assert [x for x in out("near_dedup", odd) if x in (900_001, 900_002)] == [900_001, 900_002] and len(out("near_dedup", odd)) == 3
    assert out("decontamination", odd + [(900_009, spark.read.parquet(f"{SF}/benchmark.parquet").first().text, None, None, None)]) == sorted((r[0] or 0) for r in odd)
    assert set(out("packing", odd)) == {0, 900_001, 900_002, 900_004, 900_005}
    for stage in stages.values():
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_unclear_languages_go(spark):
    """Gibberish and languages that were not learned are rejected; nearly all documents of the corpus stay."""
    r = random.Random(1)
    junk = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)) for n in (10, 50, 300)]
    unseen = ["mieszkam w dużym mieście i codziennie chodzę do pracy przez park", "мы живем в большом городе и каждый день ходим на работу"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(1_000_000 + i, t, None, None, len(t)) for i, t in enumerate(junk + unseen)], docs.schema)
    out = dict(corpus_pipeline.STAGES)["language_id"](spark, docs.unionByName(odd), SF)
    kept = {x.doc_id for x in out.collect()}
    assert not [i for i in kept if i >= 1_000_000]
    clean = {x.doc_id for x in docs.collect() if langid.letters((x.text or "").encode())}
    assert len(kept) >= 0.97 * len(clean)


def test_near_dedup_works_on_rows(spark):
    """Rows that repeat an id go only if their texts are near-duplicates; rows of a null id are compared like others."""
    text, other = "one two three four five six seven eight nine ten", "a quite different text that has nothing to do with it"
    rows = [(5, text, "en", "s", 1)] * 3 + [(5, other, "en", "s", 1), (7, text + " " + text, None, None, 2), (8, text, "en", "s", 1), (9, None, None, None, None), (9, None, None, None, None), (None, "x", "en", "s", 1), (None, other, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(r.text or "" for r in out.collect()) == ["", "", other, text, text + " " + text, "x"]
