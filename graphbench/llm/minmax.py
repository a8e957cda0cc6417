"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import byte_texts, discard, lists, materialize, ragged, ready, require, spread_join
from ._components import UnionFind, connected_components

BAND_ROWS = 4
#: Rows of a group of equal sets that one task holds at most, about.
PART_ROWS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; all words as one run where there are fewer."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * _MIX + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def band_count(threshold: float, miss: float = 2e-6) -> int:
    """Bands of BAND_ROWS values so that a pair at the threshold is missed with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**BAND_ROWS)))


class MinMax:
    """Keeps the minimum and the maximum of a set under each permutation: two values for one evaluation."""

    def __init__(self, bands: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        half = bands * BAND_ROWS // 2
        self.bands = bands
        self.mul = rng.integers(0, 2**63, half, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, half, dtype=np.uint64)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * _MIX)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        low = high = None
        for at in range(0, len(hashes), 8192):
            v = np.multiply.outer(self.mul, hashes[at : at + 8192])
            v += self.add[:, None]
            v ^= v >> np.uint64(29)
            a, b = v.min(axis=1), v.max(axis=1)
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        return np.concatenate((low, high))

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """One 64-bit key a band: two minima, and the two maxima of the next band, so that all four come from different permutations."""
        v = self.signature(hashes).reshape(BAND_ROWS, self.bands)
        v[BAND_ROWS // 2 :] = np.roll(v[BAND_ROWS // 2 :], -1, axis=1)
        key = self.salt.copy()
        for row in v:
            key = mix(key * _MIX + row)
        return key.view(np.int64)


def _digest(s: np.ndarray) -> tuple[int | None, int | None]:
    """128 bits of a set, whatever its order."""
    if not len(s):
        return None, None
    m = mix(s ^ _MIX)
    return int(np.bitwise_xor.reduce(m).view(np.int64)), int((s * _MIX + m).sum(dtype=np.uint64).view(np.int64))


def _signatures(size: int, bands: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minmax = MinMax(bands)
        for b in batches:
            n, digests, keys = [], [], []
            for t in byte_texts(b.column(1)):
                s = shingles(t, size)
                n.append(len(s))
                digests.append(_digest(s))
                keys.append(minmax.keys(s) if len(s) else np.zeros(0, np.int64))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), *(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)), lists(flat, np.asarray([len(k) for k in keys]), pa.int64())],
                names=["doc_id", "n", "set_a", "set_b", "keys"],
            )

    return run


def _sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shingles(t, size) for t in byte_texts(b.column(1))]
            digests = [_digest(s) for s in got]
            flat = np.concatenate(got) if got else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)), lists(flat.view(np.int64), np.asarray([len(g) for g in got]), pa.int64())],
                names=["doc_id", "set_a", "set_b", "hashes"],
            )

    return run


def _verify(num: int, den: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between side 0 and side 1 (or within side 0) that join components; others are passed over."""
        uf, out = UnionFind(), []
        for d, c in zip(pdf["doc_id"].tolist(), pdf["component"].tolist(), strict=True):
            uf.union(d, c)
        own = pdf[pdf["side"] == 0]
        other = pdf[pdf["side"] == 1] if (pdf["side"] == 1).any() else own
        ids, sizes = other["doc_id"].to_numpy(), other["hashes"].map(len).to_numpy()
        flat = np.concatenate(other["hashes"].to_list())
        order = np.argsort(flat, kind="stable")
        flat, holder = flat[order], np.repeat(np.arange(len(ids)), sizes)[order]
        comps = np.asarray([uf.find(i) for i in ids.tolist()])
        for d, s in zip(own["doc_id"].tolist(), own["hashes"], strict=True):
            mine = uf.find(d)
            if (comps == mine).all():
                continue
            s = np.asarray(s)
            a, b = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            common = np.bincount(holder[ragged(a, b - a)], minlength=len(ids))
            link = (den * common >= num * (len(s) + sizes - common)) & (comps != mine)
            for other_id in ids[link].tolist():
                if uf.union(d, other_id):
                    out.append((d, other_id))
            if link.any():
                comps = np.asarray([uf.find(i) for i in ids.tolist()])
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = 512, block_hashes: int = 1_500_000, broadcast_ids: int = 500_000, part_rows: int = PART_ROWS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Documents link when den * |A and B| >= num * |A or B| over their sets of `size`-word shingles (A-Z lower-cased, split at
    ASCII white space). component_id is the smallest doc_id reachable, kept means doc_id = component_id. Ids must be
    integers, other types raise an error; rows of a null id are left out, rows that repeat an id count once (by the smallest set digest). A null,
    empty or wordless text has an empty set and stays alone. Empty tables give no rows; other columns are ignored.

    Equal sets collapse to their smallest id first, a group in parts of about part_rows. Each distinct set is banded; buckets with the same members
    are one. Every bucket's members are checked against its smallest member (as many pairs as members; a hot one is dealt to parts), which joins
    large groups at once. Only buckets whose members are still in different components go on: there the members outside the bucket's largest
    component meet each other and that component, in blocks of bounded size, where pairs within a component are passed over.
    Every link is confirmed on full sets.
    """
    ready(docs.sparkSession)
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be an integer")
    bands = band_count(num / den)
    texts = require(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    sigs = texts.mapInArrow(_signatures(size, bands), "doc_id long, n long, set_a long, set_b long, keys array<long>")
    sigs = materialize(sigs, "signatures")
    one = sigs.groupBy("doc_id").agg(F.min(F.struct("n", "set_a", "set_b")).alias("s")).select("doc_id", "s.*")
    equal, parts = ["n", "set_a", "set_b"], max(64, -(-sigs.count() // part_rows))
    dealt = one.where("n > 0").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(parts)))
    least = dealt.groupBy(*equal, "part").agg(F.min("doc_id").alias("rep")).withColumn("rep", F.min("rep").over(Window.partitionBy(*equal)))
    alone = one.where("n = 0").select("doc_id", *equal, F.col("doc_id").alias("rep"))
    member = materialize(dealt.join(least, [*equal, "part"]).select("doc_id", *equal, "rep").unionByName(alone), "members")
    heads = member.where("doc_id = rep and n > 0").select("doc_id", *equal)
    banded = sigs.join(heads, ["doc_id", *equal], "left_semi").dropDuplicates(["doc_id", *equal]).select("doc_id", "n", F.explode("keys").alias("key"))
    stats = banded.groupBy("key").agg(F.count("*").alias("k"), F.min("doc_id").alias("pivot"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64("doc_id", F.lit(1)).cast("decimal(38,0)")).alias("s2")).where("k > 1")
    buckets = stats.groupBy("k", "pivot", "s1", "s2").agg(F.min("key").alias("key"))
    inside = materialize(banded.join(buckets.select("key", "pivot"), "key"), "buckets")
    discard(sigs)

    ids = inside.select("doc_id").distinct()
    wanted = F.broadcast(ids) if ids.limit(broadcast_ids + 1).count() <= broadcast_ids else ids
    sets = texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(size), "doc_id long, set_a long, set_b long, hashes array<long>")
    sets = materialize(sets.join(heads, ["doc_id", "set_a", "set_b"]).dropDuplicates(["doc_id"]).select("doc_id", "hashes"), "sets")

    pairs = inside.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb"))
    pairs = materialize(pairs, "pairs")
    common = F.size(F.array_intersect("ha", "hb"))
    tested = spread_join(pairs, left, ["a"], "b", least=20_000).join(right, "b").where(den * common >= num * (F.size("ha") + F.size("hb") - common))
    stars = materialize(tested.select("a", "b"), "links")
    comps = materialize(connected_components(stars), "components")

    more = materialize(_rest(inside, comps, sets, num, den, block, block_hashes), "links")
    links = stars.unionByName(more)
    comps = materialize(connected_components(links), "components") if more.limit(1).count() else comps
    for done in (inside, sets, pairs, stars, more):
        discard(done)
    out = spread_join(member, comps.withColumnRenamed("id", "rep"), ["rep"], "doc_id", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _rest(inside: DataFrame, comps: DataFrame, sets: DataFrame, num: int, den: int, block: int, block_hashes: int) -> DataFrame:
    """Links (a, b) between components of one bucket.

    Members of the bucket's largest component are dealt to nb blocks, the others to mb blocks. Each of the mb meets each of the nb and each
    of the mb; two members of the largest component need not meet.
    """
    placed = inside.join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    placed = materialize(placed, "placed")
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("h"))
    top = sizes.groupBy("key").agg(F.max(F.struct("c", "h", "component")).alias("top"), F.sum("c").alias("k"), F.sum("h").alias("hashes"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda rows, hashes: F.greatest(F.ceil(rows / block), F.ceil(hashes / block_hashes)).cast("int")
    top = top.select("key", F.col("top.component").alias("main"), blocks(F.col("top.c"), F.col("top.h")).alias("nb"), blocks(F.col("k") - F.col("top.c"), F.col("hashes") - F.col("top.h")).alias("mb"))
    rest = spread_join(placed, top, ["key"], "doc_id", least=2_000).withColumn("big", F.col("component") == F.col("main"))
    own = F.pmod(F.xxhash64("doc_id", "key"), F.when(F.col("big"), F.col("nb")).otherwise(F.col("mb"))).cast("int")
    rest = rest.withColumn("own", own)
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("bi"), j.alias("bj"), side.cast("int").alias("side"))
    row = F.col("own")
    across = F.when(F.col("big"), F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda i: place("x", i, row, F.lit(1)))).otherwise(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: place("x", row, j, F.lit(0))))
    within = F.when(~F.col("big"), F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda i: place("s", F.least(row, i), F.greatest(row, i), row > i)))
    rest = rest.withColumn("g", F.explode(F.concat(across, F.coalesce(within, F.array().cast("array<struct<kind:string,bi:int,bj:int,side:int>>")))))
    rest = rest.select("key", "doc_id", "component", "g.*")
    return rest.join(sets, "doc_id").groupBy("key", "kind", "bi", "bj").applyInPandas(_verify(num, den), "a long, b long")
