"""Best-fit packing of token pieces with a swap-based local search."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_texts, chunks, materialize, ready, require, tokenizer_path
from ._units import text_encoder


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole capacities, then the rest."""
    return [capacity] * (total // capacity) + ([total % capacity] if total % capacity else [])


class Index:
    """Values 1..most that some open bin offers, with the bins that offer them; a bin's offers end when its version moves on."""

    def __init__(self, most: int) -> None:
        self.mask, self.offers = 0, [[] for _ in range(most + 1)]

    def add(self, value: int, offer: tuple[int, int, int]) -> None:
        self.offers[value].append(offer)
        self.mask |= 1 << value

    def largest(self, most: int, version: list[int]) -> int:
        """The largest value on offer that is at most `most`, or 0."""
        while left := self.mask & ((2 << most) - 1):
            value = left.bit_length() - 1
            offers = self.offers[value]
            while offers and version[offers[-1][0]] != offers[-1][1]:
                offers.pop()
            if offers:
                return value
            self.mask ^= 1 << value
        return 0


class Bins:
    """Bins of item lengths, packed in order of arrival and improved by local search."""

    def __init__(self, lengths: np.ndarray, capacity: int) -> None:
        self.len, self.cap = np.asarray(lengths, np.int64).tolist(), capacity
        self.by_size: list[dict[int, list[int]]] = []  # of each bin: length -> items
        self.load: list[int] = []
        self.steps = 0

    def next_fit(self) -> Bins:
        """Items in order of arrival; a bin closes when the next one has no room."""
        for i, n in enumerate(self.len):
            if not self.load or self.load[-1] + n > self.cap:
                self.by_size.append({})
                self.load.append(0)
            self._put(i, len(self.load) - 1)
        return self

    @property
    def squares(self) -> int:
        """The sum of squared loads: what every step of the search raises."""
        return sum(n * n for n in self.load)

    @property
    def count(self) -> int:
        return sum(n > 0 for n in self.load)

    def _put(self, i: int, b: int) -> None:
        self.by_size[b].setdefault(self.len[i], []).append(i)
        self.load[b] += self.len[i]

    def _take(self, size: int, b: int) -> int:
        held = self.by_size[b][size]
        i = held.pop()
        if not held:
            del self.by_size[b][size]
        self.load[b] -= size
        return i

    def improve(self) -> int:
        """Local search between underfull bins until no step is left; returns the number of steps.

        A step gives the fuller of two bins a net gain and so raises the sum of squared loads: an item moves, one is exchanged for a
        longer one, one for two longer ones, or two for a longer one. A pass takes the bins from the fullest down, each with the
        steps that fill it most, out of all bins that are emptier; bins that run empty vanish. Passes go on until one has no step.
        All lengths and all sums of two that emptier bins offer stand in an index, so a step is found without a look at every bin.
        """
        before = self.steps
        while self._pass():
            pass
        return self.steps - before

    def _pass(self) -> bool:
        start = self.steps
        self.version, self.single, self.double = [0] * len(self.load), Index(self.cap), Index(self.cap)
        heap = [(-n, b) for b, n in enumerate(self.load) if 0 < n < self.cap]
        heapq.heapify(heap)
        for _, b in heap:
            self._offer(b)
        while heap:
            n, a = heapq.heappop(heap)
            if -n != self.load[a]:  # it gave something since
                if self.load[a]:
                    heapq.heappush(heap, (-self.load[a], a))
                continue
            self.version[a] += 1  # its own offers end
            while self.load[a] < self.cap and self._step(a):
                self.steps += 1
        return self.steps > start

    def _offer(self, b: int) -> None:
        sizes, v = self.by_size[b], self.version[b]
        mine = list(sizes)
        for k, x in enumerate(mine):
            self.single.add(x, (b, v, 0))
            if len(sizes[x]) > 1:
                self.double.add(2 * x, (b, v, x))
            for y in mine[:k]:
                self.double.add(x + y, (b, v, x))

    def _step(self, a: int) -> bool:
        """The step that fills a most; false where none raises its load."""
        room, mine = self.cap - self.load[a], list(self.by_size[a])
        best = (0, (), None, 0)  # gain, lengths that leave a, index, value that comes

        def look(leave: tuple, index: Index) -> bool:
            nonlocal best
            less = sum(leave)
            value = index.largest(min(less + room, self.cap), self.version)
            if value - less > best[0]:
                best = (value - less, leave, index, value)
            return best[0] == room

        for leave, index in self._exchanges(a, mine):
            if look(leave, index):
                break
        gain, leave, index, value = best
        if not gain:
            return False
        b, _, part = index.offers[value][-1]
        come = [part, value - part] if index is self.double else [value]
        coming, leaving = [self._take(n, b) for n in come], [self._take(n, a) for n in leave]
        for i in coming:
            self._put(i, a)
        for i in leaving:
            self._put(i, b)
        self.version[b] += 1
        if self.load[b]:
            self._offer(b)
        return True

    def _exchanges(self, a: int, mine: list[int]) -> Iterator[tuple[tuple, Index]]:
        """(lengths that leave, index of what may come): moves, one for one, one for two, two for one."""
        yield (), self.single
        for x in mine:
            yield (x,), self.single
        for x in mine:
            yield (x,), self.double
        for k, x in enumerate(mine):
            if len(self.by_size[a][x]) > 1:
                yield (x, x), self.single
            for y in mine[:k]:
                yield (x, y), self.single

    def placed(self) -> tuple[np.ndarray, np.ndarray]:
        """Bin number and offset of each item."""
        bin_of, offset = np.zeros(len(self.len), np.int64), np.zeros(len(self.len), np.int64)
        number = 0
        for sizes in self.by_size:
            at = 0
            for items in sizes.values():
                for i in items:
                    bin_of[i], offset[i] = number, at
                    at += self.len[i]
            number += bool(sizes)
        return bin_of, offset


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length: packed as they arrive, then improved by the local search alone."""
    bins = Bins(lengths, capacity).next_fit()
    bins.improve()
    return bins.placed()


def token_pieces(docs: DataFrame, path: str, kind: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, copy, piece, start, length, ids_crc32 and, if asked, ids (binary, uint32).

    copy numbers equal rows of one partition, so that repeated rows stay apart.
    """
    ready(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = text_encoder(path, kind)
        for batch in batches:
            texts = byte_texts(batch.column(1))
            for a, b in chunks(texts):
                rows: list[tuple] = []
                for i, ids in enumerate(enc.encode(texts[a:b]), a):
                    ids = np.append(ids, end_id).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity].tobytes()
                        rows.append((i, piece, start, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                at, piece, start, length, crc, part = zip(*rows, strict=True)
                cols = [batch.column(0).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "row_key", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(part, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    shape = f"doc_id {id_type}, row_key long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return require(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row_key")).mapInArrow(cut, shape)


def _pack_shard(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_key", "piece"]).reset_index(drop=True)
        number, offset = pack(pdf["length"].to_numpy(), capacity)
        fill = np.bincount(number, weights=pdf["length"].to_numpy(), minlength=1).astype(np.int64)
        pdf["number"], pdf["offset"], pdf["fill"] = number, offset, fill[number]
        return pdf

    return run


def pack_pieces(pieces: DataFrame, capacity: int = 4096, shard_rows: int = 24_000, repack_below: float = 0.985) -> DataFrame:
    """Give each piece a sequence_id and an offset; pieces must be a written table (it is read more than once).

    Pieces are dealt by hash to shards of about shard_rows, each packed on its own; then the pieces of bins
    filled less than repack_below, from all shards, are dealt and packed once more. So no task holds more than a
    shard, and what shards waste at their edges is won back.
    """
    shape = "row_key long, piece int, length long, number long, offset long, fill long"

    def deal(df: DataFrame, rows: int, salt: int) -> DataFrame:
        shards = max(1, -(-rows // shard_rows))
        dealt = df.select("row_key", "piece", "length").withColumn("shard", F.pmod(F.xxhash64("row_key", "piece", F.lit(salt)), F.lit(shards)))
        packed = dealt.groupBy("shard").applyInPandas(lambda key, pdf: _pack_shard(capacity)(pdf).assign(shard=key[0]), "shard long, " + shape)
        return packed.withColumn("sequence_id", (F.col("shard") * F.lit(1 << 32) + F.col("number")) * 2 + F.lit(salt)).drop("shard", "number")

    first = materialize(deal(pieces, pieces.count(), 0), "packed")
    open_ = first.where(F.col("fill") < F.lit(repack_below * capacity))
    again = deal(open_, open_.count(), 1)
    return first.where(F.col("fill") >= F.lit(repack_below * capacity)).unionByName(again).select("row_key", "piece", "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = 4096, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 24_000) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document ends with end_id, so a null or empty text is one piece of one token. Only documents of over
    capacity tokens are cut. Repeated rows are packed each; an empty table gives an empty result; other
    columns are ignored. Pieces are written once, without their ids; the packing shuffles lengths only.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    pieces = materialize(token_pieces(docs, path, "words", end_id, capacity, id_col, text_col), "pieces")
    return pieces.join(pack_pieces(pieces, capacity, shard_rows), ["row_key", "piece"]).drop("row_key")


def packed_lists(df: DataFrame) -> DataFrame:
    """Sequences as rows: sequence_id, n_tokens, doc_ids and pieces in order of offset."""
    g = df.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece"))).alias("s"))
    return g.select("sequence_id", "n_tokens", F.col("s.doc_id").alias("doc_ids"), F.col("s.piece").alias("pieces"))


__all__ = ["Bins", "Index", "cut_lengths", "pack", "pack_documents", "pack_pieces", "packed_lists", "token_pieces"]
