"""Text functions as Spark columns. Word characters follow Unicode letters and digits, as Java's plain classes are ASCII only."""

from __future__ import annotations

import difflib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import importable, written


def normalize_question(c: Column) -> Column:
    """Strip, lower, collapse white space to one space, then drop what is neither word character nor space (in that order)."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)\s+", " "), r"(?U)[^\p{L}\p{N}_\s]", "")


def tokens(c: Column) -> Column:
    """Distinct lower-case tokens of word characters, points and hyphens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_.\-]+"), 0))


def token_recall(truth: Column, answer: Column) -> Column:
    """Share of the truth's tokens in the answer; 1 for a blank or null truth, 0 if the truth has no token."""
    t, a = tokens(truth), tokens(F.coalesce(answer, F.lit("")))
    blank = truth.isNull() | (F.trim(F.regexp_replace(truth, r"(?U)\s+", " ")) == "")
    return F.when(blank, F.lit(1.0)).when(F.size(t) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(t, a)) / F.size(t))


def truncate_middle(c: Column, limit: int) -> Column:
    """Head and tail of a longer text around a note of how much was cut."""
    head, tail = limit // 2, limit - limit // 2
    cut = F.concat(F.left(c, F.lit(head)), F.lit("\n...[TRUNCATED "), (F.length(c) - limit).cast("string"), F.lit(" chars]...\n"), F.right(c, F.lit(tail)))
    return F.when(F.coalesce(F.length(c), F.lit(0)) <= limit, F.coalesce(c, F.lit(""))).otherwise(cut)


def shrink_prompt(c: Column, ratio: float = 0.6, least: int = 2000) -> Column:
    """70 % head and 30 % tail of what is kept: ratio of the length, `least` at least."""
    new = F.greatest(F.lit(least), F.floor(F.length(c) * ratio).cast("int"))
    head = F.floor(new * 0.7).cast("int")
    cut = F.concat(F.left(c, head), F.lit("\n...[PROMPT COMPRESSED FROM "), F.length(c).cast("string"), F.lit(" TO "), new.cast("string"), F.lit(" CHARS]...\n"), F.right(c, new - head))
    return F.when(c.isNull(), F.lit("")).when(new >= F.length(c), c).otherwise(cut)


def trim_value(c: Column, kind: str = "string", chars: int = 180, items: int = 5, keys: int = 12) -> Column:
    """A value cut for a prompt, by its type: long texts lose their middle, lists keep `items`, maps the first `keys` by key; inner values alike."""
    if kind == "string":
        return F.when(c.isNotNull(), truncate_middle(c, chars))
    if kind.startswith("array<"):
        return F.transform(F.slice(c, 1, items), lambda x: trim_value(x, kind[6:-1], chars, items, keys))
    if kind.startswith("map<string,"):
        return F.map_from_entries(F.transform(F.slice(F.array_sort(F.map_entries(c)), 1, keys), lambda e: F.struct(e["key"], trim_value(e["value"], kind[11:-1], chars, items, keys).alias("value"))))
    return c


def last_items(c: Column, n: int = 200) -> Column:
    return F.slice(c, F.greatest(F.lit(1), F.size(c) - (n - 1)), n)


def existing_questions(questions: DataFrame, most: int = 200, text: str = "question", seq: str = "seq") -> DataFrame:
    """One row, block: the last `most` questions that aren't blank, a line each under a heading; empty without questions."""
    last = questions.where(F.trim(text) != "").orderBy(F.desc(seq), F.desc(text)).limit(most).select(seq, F.trim(text).alias("t"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, "t"))), lambda x: F.concat(F.lit("- "), x["t"])), "\n")
    return last.agg(F.when(F.count("*") > 0, F.concat(F.lit("ALREADY ASKED (do not repeat or paraphrase):\n"), lines)).otherwise(F.lit("")).alias("block"))


def compact_schema(schema_props: DataFrame, most_props: int = 40, most_chars: int = 12_000) -> DataFrame:
    """One row, schema: JSON of labels and relationship types in order, each with its first `most_props` properties; kind, name, prop come from catalog.schema_properties."""
    by = schema_props.groupBy("kind", "name").agg(F.slice(F.array_sort(F.collect_set("prop")), 1, most_props).alias("p"))
    part = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col("name").alias("key"), F.struct(F.col("p").alias("properties")).alias("value"))))))
    return by.agg(truncate_middle(F.to_json(F.struct(part("node").alias("node_labels"), part("relationship").alias("relationship_types"))), most_chars).alias("schema"))


def compact_samples(samples: DataFrame, useful, labels: int = 30, rows: int = 3, keys: int = 12, chars: int = 24_000) -> DataFrame:
    """One row, samples: JSON of each label's first rows with the properties that `useful` keeps, or the first by key where it keeps none; samples: label, rank, props."""
    first = samples.where(F.col("rank") <= rows)
    kept = useful(F.col("props"))
    first = first.select("label", "rank", F.to_json(trim_value(F.when(F.size(kept) > 0, kept).otherwise(F.col("props")), "map<string,string>", keys=keys)).alias("j"))
    by = first.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "j"))), lambda x: x["j"]), ",").alias("j")).orderBy("label").limit(labels)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "j"))), lambda x: F.concat(F.lit('"'), x["label"], F.lit('":['), x["j"], F.lit("]"))), ",")
    return by.agg(truncate_middle(F.concat(F.lit("{"), whole, F.lit("}")), chars).alias("samples"))


def generation_prompt(schema: Column, samples: Column, asked: Column, task: str, complexity: str) -> Column:
    """The user prompt of a generator: data first, then the task and the form of the reply."""
    form = f'Reply with a JSON array of objects with the keys complexity ("{complexity}"), question and cypher.'
    return F.concat_ws("\n\n", F.concat(F.lit("GRAPH SCHEMA:\n"), schema), F.concat(F.lit("SAMPLES:\n"), samples), F.nullif(asked, F.lit("")), F.lit(f"TASK: {task}"), F.lit(form))


def parse_answer_json(c: Column) -> Column:
    """The JSON text of an answer, without a code fence, as VARIANT; an empty array where it can't be parsed."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    inner = F.regexp_extract(t, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    return F.coalesce(F.try_parse_json(F.when(t.startswith("```") & (inner != ""), inner).otherwise(t)), F.parse_json(F.lit("[]")))


def json_object(c: Column) -> Column:
    """The outermost {...} of a judge's text, fenced or not."""
    t = F.trim(c)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    t = F.when(fenced != "", fenced).otherwise(t)
    return F.when(t.startswith("{"), t).otherwise(F.regexp_extract(t, r"(?s)\{.*\}", 0))


def entity_label(c: Column) -> Column:
    """A safe PascalCase label of an entity type: first letter upper, the rest of each part lower; T_ before a digit; Entity where nothing is left."""
    slug = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9_]+", "_")
    parts = F.filter(F.split(slug, "_"), lambda p: p != "")
    name = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")
    return F.when(name == "", F.lit("Entity")).when(name.rlike("^[0-9]"), F.concat(F.lit("T_"), name)).otherwise(name)


def keyword_type(c: Column) -> Column:
    """A relationship type of the first keyword; R_ before a digit; DIRECTED where nothing is left."""
    slug = F.regexp_replace(F.trim(F.split_part(F.coalesce(c, F.lit("")), F.lit(","), F.lit(1))), "[^A-Za-z0-9]+", "_")
    slug = F.upper(F.regexp_replace(slug, "^_+|_+$", ""))
    return F.when(slug == "", F.lit("DIRECTED")).when(slug.rlike("^[0-9]"), F.concat(F.lit("R_"), slug)).otherwise(slug)


def number_text(c: Column) -> Column:
    """A numeric text whose value is whole as an integer; other texts as they are."""
    v = c.try_cast("double")
    return F.when(c.rlike(r"^\s*[-+]?[0-9]+(\.[0-9]*)?([eE][-+]?[0-9]+)?\s*$") & (v == F.floor(v)) & (F.abs(v) < 2**53), v.cast("bigint").cast("string")).otherwise(c)


def double_text(c: Column) -> Column:
    """A double as Python prints it: 10000000.0 and 7.7, not 1.0E7."""
    plain = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,10)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when((F.abs(c) >= 1e-3) & (F.abs(c) < 1e7), c.cast("string")).when((F.abs(c) < 1e16) & ((c == 0) | (F.abs(c) >= 1e-4)), plain).otherwise(c.cast("string"))


def value_text(c: Column, kind: str) -> Column:
    """A value as text: None for null, True and False, doubles as Python prints them, lists joined by a comma."""
    if kind == "boolean":
        x = F.when(c, F.lit("True")).otherwise(F.lit("False"))
    elif kind in ("double", "float"):
        x = double_text(c.cast("double"))
    elif kind.startswith("array<"):
        x = F.array_join(F.transform(c, lambda v: value_text(v, kind[6:-1])), ", ")
    elif kind.startswith("map<string,"):
        x = F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(": "), value_text(e["value"], kind[11:-1]))), ", ")
    else:
        x = c.cast("string")
    return F.when(c.isNull(), F.lit("None")).otherwise(x)


def exact_dedup(questions: DataFrame, text: str = "question", seq: str = "seq") -> DataFrame:
    """The first row, by seq, of each normalised text that isn't empty."""
    q = questions.withColumn("normalized", normalize_question(F.col(text))).where("normalized <> ''")
    first = q.groupBy("normalized").agg(F.min(seq).alias(seq))
    return q.join(first, ["normalized", seq], "left_semi")


#: Grams behind the second bound on a pair: their length, and the buckets that they are hashed to.
GRAM, GRAM_BUCKETS = 3, 2048


def _counts(texts: list[str], size: int, buckets: int) -> np.ndarray:
    """How often each text has the grams of `size` characters of each bucket, a row a text."""
    rows = []
    for t in texts:
        c = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = max(0, len(c) - size + 1)
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = h * np.uint64(1_000_003) + c[k : k + n]
        if size > 1:
            h = h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        x = np.bincount((h % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        rows.append(x.astype(np.uint8 if x.max() < 256 else np.uint32))
    kind = np.result_type(np.uint8, *{x.dtype for x in rows})
    return np.stack([x.astype(kind) for x in rows]) if rows else np.zeros((0, buckets), np.uint8)


def near_candidates(xs: list[str], ys: list[str], threshold: float) -> Iterator[tuple[int, int]]:
    """(i, j) of the pairs of texts that the matcher could give the threshold, and few others.

    Of a ratio r the matcher has found M = r * (n + m) / 2 characters in common, in order. So the texts share M letters, and M - (q - 1) * (n + m - 2 * M + 1)
    grams of q characters, as a letter left out breaks q - 1 of them. Letters in buckets and grams in buckets can only seem to share more."""
    if not xs or not ys:
        return
    order = sorted(range(len(ys)), key=lambda j: len(ys[j]))
    n_y = np.asarray([len(ys[j]) for j in order], np.int64)
    least = threshold / (2 - threshold)
    kind = np.uint16 if max(int(n_y[-1]), max(map(len, xs))) < 1 << 16 else np.uint32  # no sum is longer than a text
    letters_x, letters_y = _counts(xs, 1, 64).astype(kind), np.ascontiguousarray(_counts([ys[j] for j in order], 1, 64).astype(kind).T)
    grams_x, grams_y = _counts(xs, GRAM, GRAM_BUCKETS), _counts([ys[j] for j in order], GRAM, GRAM_BUCKETS)
    for i, x in enumerate(xs):
        lo, hi = np.searchsorted(n_y, [int(len(x) * least) - 1, int(len(x) / least) + 2])
        if lo == hi:
            continue
        both = len(x) + n_y[lo:hi]
        matched = np.ceil(threshold * both / 2 - 1e-6).astype(np.int64)
        shared, part = np.zeros(hi - lo, kind), np.empty(hi - lo, kind)
        for k in np.flatnonzero(letters_x[i]).tolist():
            shared += np.minimum(letters_y[k, lo:hi], letters_x[i, k], out=part)
        maybe = np.flatnonzero(shared >= matched)
        if len(maybe):
            grams = np.concatenate([np.minimum(grams_y[lo + maybe[a : a + 4096]], grams_x[i]).sum(axis=1, dtype=np.int64) for a in range(0, len(maybe), 4096)])
            m = matched[maybe]
            for j in maybe[grams >= m - (GRAM - 1) * (both[maybe] - 2 * m + 1)].tolist():
                yield i, order[lo + j]


def near_classes(questions: DataFrame, threshold: float = 0.92, text: str = "question", seq: str = "seq", block: int = 16_384) -> tuple[DataFrame, DataFrame]:
    """(s, rep) of every row with normalised text: the least seq of that text; and a, b, ratio of the links between such representatives.

    A link has ratio >= threshold by the sequence matcher, of a's text as the later and b's as the earlier one; it stands if any row of a's text is later than
    one of b's. Two texts are linked both ways only if their rows alternate. Copies meet nothing of their own.
    A ratio r needs a length ratio of r / (2 - r), so texts meet in bands of log length only; a band is dealt to blocks of about `block` texts or 16 million
    characters, and blocks meet, not pairs. Within two blocks bounds on common letters and grams leave few pairs to the matcher. None is lost.
    The bounds are cheap, but the pairs within a band that they look at grow with its square."""
    importable(questions.sparkSession)
    step = -math.log(threshold / (2 - threshold)) * (1 + 1e-9)
    q = written(questions.select(F.col(seq).cast("long").alias("s"), normalize_question(F.col(text)).alias("x")).where("x <> '' and s is not null"), "normalized")
    texts = q.groupBy("x").agg(F.min("s").alias("rep"), F.max("s").alias("last"))
    texts = written(texts.withColumn("band", F.floor(F.log(F.length("x").cast("double")) / step).cast("int")), "texts")
    members = q.join(texts.select("x", "rep"), "x").select("s", "rep")
    size = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.length("x")) / 16_000_000)).cast("int")
    blocks = {r.band: r.n for r in texts.groupBy("band").agg(size.alias("n")).collect()}  # a row a band, so few
    table = F.broadcast(questions.sparkSession.createDataFrame([(k, n, blocks.get(k - 1, 0), blocks.get(k + 1, 0)) for k, n in blocks.items()], "band int, n int, below int, above int"))
    t = texts.join(table, "band").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    side = lambda low, high, i, j, left, over: t.select("rep", "last", "x", low.alias("ba"), high.alias("bb"), F.explode(over).alias("o"), "own", F.lit(left).alias("left")).select("rep", "last", "x", "ba", "bb", i.alias("i"), j.alias("j"), "left")
    band, o, own = F.col("band"), F.col("o"), F.col("own")
    parts = [  # blocks of a band meet those not before them; those of the next band, all
        side(band, band, own, o, True, F.filter(to(F.col("n")), lambda k: k >= F.col("own"))),
        side(band, band, o, own, False, F.filter(to(F.col("n")), lambda k: k <= F.col("own"))),
        side(band, band + 1, own, o, True, to(F.col("above"))),
        side(band - 1, band, o, own, False, to(F.col("below"))),
    ]

    def ratios(pdf: pd.DataFrame) -> pd.DataFrame:
        own_block = len(pdf) > 0 and pdf["ba"].iat[0] == pdf["bb"].iat[0] and pdf["i"].iat[0] == pdf["j"].iat[0]
        (x, rx, lx), (y, ry, ly) = ((p["x"].tolist(), p["rep"].tolist(), p["last"].tolist()) for p in (pdf[pdf["left"]], pdf[~pdf["left"]]))
        got = []
        for i, j in near_candidates(x, y, threshold):
            if rx[i] == ry[j] or own_block and rx[i] < ry[j]:
                continue
            for new, a, last, old, b in ((x[i], rx[i], lx[i], y[j], ry[j]), (y[j], ry[j], ly[j], x[i], rx[i])):
                if last > b:
                    m = difflib.SequenceMatcher(None, new, old)
                    if m.quick_ratio() >= threshold and (r := m.ratio()) >= threshold:
                        got.append((a, b, r))
        return pd.DataFrame(got, columns=["a", "b", "ratio"]).astype({"a": "int64", "b": "int64", "ratio": "float64"})

    links = reduce(DataFrame.unionByName, parts).groupBy("ba", "bb", "i", "j").applyInPandas(ratios, "a long, b long, ratio double")
    return members, links


def near_pairs(questions: DataFrame, threshold: float = 0.92, text: str = "question", seq: str = "seq", block: int = 16_384) -> DataFrame:
    """a (later), b (earlier), ratio >= threshold by the sequence matcher, of rows with normalised text: near_classes with all copies as pairs."""
    members, links = near_classes(questions, threshold, text, seq, block)
    a, b = members.select(F.col("s").alias("sa"), F.col("rep").alias("a")), members.select(F.col("s").alias("sb"), F.col("rep").alias("b"))
    same = a.join(b, F.col("a") == F.col("b")).withColumn("ratio", F.lit(1.0))
    every = links.join(a, "a").join(b, "b").select("sa", "sb", "ratio").unionByName(same.select("sa", "sb", "ratio"))
    return every.where("sa > sb").select(F.col("sa").alias("a"), F.col("sb").alias("b"), "ratio")


def near_links(questions: DataFrame, threshold: float = 0.92, text: str = "question", seq: str = "seq") -> DataFrame:
    """a, b, ratio: near_classes as one table. Of ratio 1 are the copies, a row each, with their representative; of less the links between representatives."""
    members, links = near_classes(questions, threshold, text, seq)
    return links.unionByName(members.where("s <> rep").select(F.col("s").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("ratio")))


def greedy_dedup(questions: DataFrame, threshold: float = 0.92, text: str = "question", seq: str = "seq", rounds: int | None = None) -> DataFrame:
    """Rows accepted in order of seq: not equal and not near to an accepted earlier one; empty texts go.

    Each round accepts rows whose earlier near neighbours are all decided against, and rejects those near an accepted one.
    The first undecided row is always decided, so the rounds end; if a bound on them is given and met, that is an error."""
    left = written(exact_dedup(questions, text, seq), "questions")
    edges = written(near_classes(left, threshold, text, seq)[1], "near")  # no copies are left
    state = written(left.select(F.col(seq).alias("s"), F.lit(0).alias("state")), "state")
    done = 0
    while not state.where("state = 0").isEmpty():
        if done == rounds:
            raise RuntimeError(f"undecided questions after {rounds} rounds")
        done += 1
        view = edges.join(state.select(F.col("s").alias("b"), F.col("state").alias("before")), "b").groupBy("a").agg(F.max(F.col("before") == 1).alias("near"), F.max(F.col("before") == 0).alias("open"))
        out = state.join(view, state.s == view.a, "left")
        new = F.when(F.col("state") != 0, F.col("state")).when(F.coalesce("near", F.lit(False)), F.lit(2)).when(~F.coalesce("open", F.lit(False)), F.lit(1)).otherwise(F.lit(0))
        state = written(out.select("s", new.alias("state")), "state")
    return left.join(state.where("state = 1").select(F.col("s").alias(seq)), seq, "left_semi")


def split_text(text: str, size: int = 600, overlap: int = 100, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Chunks of at most `size` characters: cut at the coarsest separator that occurs, pieces joined up to the size, `overlap` carried on."""
    sep, finer = next(((s, separators[i + 1 :]) for i, s in enumerate(separators) if s == "" or s in text), ("", ()))
    pieces = [p for p in (re.split(f"(?={re.escape(sep)})", text) if sep else list(text)) if p]
    out: list[str] = []
    held: list[str] = []

    def emit() -> None:
        if chunk := "".join(held).strip():
            out.append(chunk)

    def flush() -> None:
        total = sum(map(len, held))
        emit()
        while held and (total > overlap):
            total -= len(held.pop(0))

    for p in pieces:
        if len(p) > size and finer:
            if held:
                emit()
                held.clear()
            out += split_text(p, size, overlap, finer)
            continue
        if held and sum(map(len, held)) + len(p) > size:
            flush()
            while held and sum(map(len, held)) + len(p) > size:
                held.pop(0)
        held.append(p)
    emit()
    return out


def chunk_recursive(docs: DataFrame, size: int = 600, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk_no, chunk; blank chunks are dropped, null texts have none."""
    importable(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, c) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) if t for i, c in enumerate(split_text(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "chunk"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(cut, f"doc_id {kind}, chunk_no int, chunk string")


def chunk_fixed(docs: DataFrame, size: int = 600, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk_no, chunk: windows of `size` characters every size - overlap, all in SQL."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text_col) - overlap) / step).cast("int") - 1)
    d = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return d.select("doc_id", "chunk_no", F.substring("t", F.col("chunk_no") * step + 1, F.lit(size)).alias("chunk"))


def join_context(chunks: Column) -> Column:
    return F.array_join(chunks, "\n\n---\n\n")
