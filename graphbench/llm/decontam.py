"""Benchmark decontamination with one Aho-Corasick automaton over normalised test texts."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import arrow_kind, byte_texts, discard, judged, materialize, ready

#: Lower-cases A-Z and turns every byte that is no word byte (0-9, a-z, 0x80 on) into a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold_words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def word_sign(k: int) -> str:
    """Two characters for word k, of different alphabets, so that no node has thousands of children and windows match at whole words only."""
    return chr(0x400 + (k >> 8)) + chr(1 + (k & 255))


#: Stands for words that no item has.
UNKNOWN = "\0\0"


class Scanner:
    """One automaton over all windows. Two characters stand for a word, so a window of ten words is twenty nodes, whatever its letters."""

    def __init__(self, items: list[tuple], size: int) -> None:
        import ahocorasick

        self.ids, self.machine, self.signs = [i for i, _ in items], ahocorasick.Automaton(ahocorasick.STORE_INTS), {}
        sizes, first = array("I"), array("I")
        self.more: dict[int, list[int]] = {}  # windows of several items
        for at, (_, text) in enumerate(items):
            words = fold_words(text.encode() if isinstance(text, str) else text)
            for w in words:
                if w not in self.signs:
                    self.signs[w] = word_sign(len(self.signs))
            line, n = "".join(map(self.signs.__getitem__, words)), min(size, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                window = line[2 * i : 2 * (i + n)]
                k = self.machine.get(window, -1)
                if k < 0:
                    self.machine.add_word(window, len(sizes))
                    sizes.append(n)
                    first.append(at)
                elif first[k] != at and self.more.get(k, [-1])[-1] != at:
                    self.more.setdefault(k, []).append(at)
        self.sizes, self.first = np.asarray(sizes, np.int64), np.asarray(first, np.int64)
        if len(sizes):
            self.machine.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, np.ndarray, list]:
        """Number of words, the ranges (start, end) of words that are hit, and the sorted ids of items that occur."""
        words = fold_words(text)
        hits = list(self.machine.iter("".join(map(self.signs.get, words, repeat(UNKNOWN))))) if len(self.sizes) and words else []
        if not hits:
            return len(words), NO_RANGE, []
        last, k = np.asarray(hits, np.int64).T
        last >>= 1
        k_once = np.unique(k)
        found = {int(i) for i in self.first[k_once]}.union(*(self.more.get(int(x), ()) for x in k_once if int(x) in self.more))
        return len(words), merged(np.stack((last - self.sizes[k] + 1, last + 1), axis=1)), sorted({self.ids[i] for i in found})


NO_RANGE = np.zeros((0, 2), np.int64)


def merged(ranges: np.ndarray) -> np.ndarray:
    """Ranges (start, end) in order, overlapping and touching ones as one."""
    if len(ranges) < 2:
        return ranges
    r = ranges[np.argsort(ranges[:, 0], kind="stable")]
    far = np.maximum.accumulate(r[:, 1])
    new = np.flatnonzero(np.concatenate(([True], r[1:, 0] > far[:-1])))
    return np.stack((r[new, 0], far[np.append(new[1:], len(r)) - 1]), axis=1)


_LATEST: list = []


def _scanner(items, size: int) -> Scanner:
    """Built once a worker process for a broadcast benchmark; the latest is kept, with its items, so that no other list can pass for them."""
    if not (_LATEST and _LATEST[0] is items.value and _LATEST[1] == size):
        _LATEST[:] = []  # the former one goes before the next is built
        _LATEST[:] = [items.value, size, Scanner(items.value, size)]
    return _LATEST[2]


def spans(text: bytes | None, ranges: np.ndarray) -> list[dict]:
    """Character spans of the original text that cover each range of hit words."""
    if not len(ranges):
        return []
    out, at, chars = [], 0, 0
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    for a, b in ranges.tolist():
        got = []
        for byte in (places[a][0], places[b - 1][1]):
            chars += len(text[at:byte].decode("utf-8", "replace"))
            at = byte
            got.append(chars)
        out.append({"start": got[0], "end": got[1]})
    return out


def shards(tests: DataFrame, shard_bytes: int, size: int) -> Iterator[list[tuple]]:
    """The benchmark in lists of about shard_bytes, streamed through the driver. A longer item is cut into stretches that share size - 1 words, so that each window lies in one."""
    held, used = [], 0
    for i, text in tests.toLocalIterator():
        words = fold_words(text.encode())
        step = max(1, shard_bytes // 16)
        for at in range(0, max(1, len(words) - size + 1), step) if len(text) > shard_bytes else [0]:
            part = b" ".join(words[at : at + step + size - 1] if len(text) > shard_bytes else words)
            if held and used + len(part) > shard_bytes:
                yield held
                held, used = [], 0
            held.append((i, part))
            used += len(part)
    yield held


def with_hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], size: int = 10, shard_bytes: int = 1_500_000, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", with_spans: bool = True, prefix: str = "") -> DataFrame:
    """The columns `keep` of every row with n_words, n_hit, items and spans, each behind the prefix; see decontaminate."""
    spark = ready(docs.sparkSession)
    tests = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    item_type, item_kind = benchmark.schema[item_id].dataType.simpleString(), arrow_kind(benchmark, item_id)
    many = tests.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first().n > shard_bytes
    p, place = prefix, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    extra = f"`{p}n_words` long, `{p}n_hit` long, `{p}items` array<{item_type}>, `{p}spans` array<struct<start:long,end:long>>"

    def columns(texts: list, found: list[tuple]) -> list[pa.Array]:
        n, ranges, ids = zip(*found, strict=True) if found else ((), (), ())
        at = [spans(t, r) if with_spans else [] for t, r in zip(texts, ranges, strict=True)]
        return [pa.array(n, pa.int64()), pa.array([int((r[:, 1] - r[:, 0]).sum()) for r in ranges], pa.int64()), pa.array(ids, pa.list_(item_kind)), pa.array(at, place)]

    if not many:
        whole = spark.sparkContext.broadcast([(r.i, r.t) for r in tests.collect()])

        def make():
            scanner = _scanner(whole, size)
            return lambda texts: columns(texts, [scanner.scan(t) for t in texts])

        return judged(docs, text_col, make, extra, keep)

    # One pass a shard: what it hits depends on the text alone, so hits are told apart by the text's digest.
    digest = F.md5(text_col)
    parts = []
    for items in shards(tests, shard_bytes, size):
        shared = spark.sparkContext.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(shared, size)
            for b in batches:
                got = [(k, r, ids) for k, (_, r, ids) in zip(b.column(0).to_pylist(), map(scanner.scan, byte_texts(b.column(1))), strict=True) if ids]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1].ravel().tolist() for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(item_kind))], names=["__k", "ranges", "ids"])

        part = docs.select(digest.alias("__k"), text_col).where(F.col(text_col).isNotNull()).mapInArrow(scan, f"__k string, ranges array<long>, ids array<{item_type}>")
        parts.append(materialize(part.dropDuplicates(["__k"]), "hits"))
        shared.unpersist()
    hits = reduce(DataFrame.unionByName, parts).groupBy("__k").agg(F.flatten(F.collect_list("ranges")).alias("__ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("__ids"))
    hits = materialize(hits, "hits")
    for part in parts:
        discard(part)
    found = docs.select(*[docs[c] for c in keep], docs[text_col].alias("__text"), digest.alias("__k")).join(hits, "__k", "left").select(*keep, "__text", "__ranges", "__ids")
    shape = StructType([docs.schema[c] for c in keep] + StructType.fromDDL(extra).fields)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = byte_texts(b.column(len(keep)))
            ranges = [merged(np.asarray(r or [], np.int64).reshape(-1, 2)) for r in b.column(len(keep) + 1).to_pylist()]
            rows = [(len(fold_words(t)), r, ids or []) for t, r, ids in zip(texts, ranges, b.column(len(keep) + 2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *columns(texts, rows)], names=shape.names)

    return found.mapInArrow(finish, shape)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, shard_bytes: int = 1_500_000, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", with_spans: bool = True) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, items (sorted ids of occurring items), spans (start, end: characters).

    Normalising lower-cases A-Z and keeps word bytes; a window is `size` consecutive words of an item, or a whole item
    of fewer. Documents and items that are null or have no words hit nothing, items of a null id are left out; repeated rows and items are
    each counted as they stand; ids may be of any type; empty tables give no hits or no rows; other columns are ignored.
    Documents are scanned where they are read, without a shuffle, by one automaton for a benchmark of up to shard_bytes. Of a larger one the driver holds one shard at a time: there is
    one pass and one automaton a shard, so that workers' memory is bounded, and the hits of all shards meet by the digest of the text.
    """
    return with_hits(docs, benchmark, [id_col], size, shard_bytes, text_col, item_id, item_text, with_spans).withColumnRenamed(id_col, "doc_id")


def items_digest(ids: list) -> str:
    """Hex SHA-256 of the ids as strings, sorted as strings, joined by commas."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
