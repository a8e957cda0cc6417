"""Token ids packed into fixed-width matrices, as binary rows a training job can map."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_kind, byte_texts, chunks, ready, require, tokenizer_path
from ._units import library, text_encoder


class RoomTree:
    """Segment tree over room sizes 0..capacity: which rooms have an open bin; finds the least room >= n."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, n: int) -> int:
        """The least room of at least n with an open bin, or -1."""
        i, count = n + self.size, self.count
        if count[i]:
            return n
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length (given in falling order), by segment-tree search for room."""
    tree, open_bins, load = RoomTree(capacity), [[] for _ in range(capacity + 1)], []
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        room = tree.least(n)
        if room < 0:
            b = len(load)
            load.append(0)
        else:
            b = open_bins[room].pop()
            tree.add(room, -1)
        number[k], offset[k] = b, load[b]
        load[b] += n
        if left := capacity - load[b]:
            open_bins[left].append(b)
            tree.add(left, 1)
    return number, offset


class Packer:
    """Packs segments as they come: buffers some, plans them together, gives out the full rows and holds the pieces of the others back."""

    def __init__(self, width: int, pad_id: int, buffer_tokens: int, full: float = 0.985) -> None:
        self.width, self.pad, self.most, self.full = width, pad_id, buffer_tokens, full
        self.held: list[tuple] = []  # (doc index, piece, start, ids)
        self.tokens = 0

    def add(self, segment: tuple) -> list[list[tuple]]:
        self.held.append(segment)
        self.tokens += len(segment[3])
        return self.flush() if self.tokens >= self.most else []

    def flush(self, last: bool = False) -> list[list[tuple]]:
        """Rows as lists of segments. Unless it is the last time, rows that aren't full are planned again, if they hold less than half of the buffer."""
        if not self.held:
            return []
        order = sorted(range(len(self.held)), key=lambda i: -len(self.held[i][3]))
        number, _ = best_fit_decreasing(np.asarray([len(self.held[i][3]) for i in order]), self.width)
        rows: list[list[tuple]] = [[] for _ in range(int(number.max()) + 1)]
        for i, n in zip(order, number.tolist(), strict=True):
            rows[n].append(self.held[i])
        loads = [sum(len(s[3]) for s in r) for r in rows]
        open_rows = [r for r, n in zip(rows, loads, strict=True) if n < self.full * self.width]
        left = sum(len(s[3]) for r in open_rows for s in r)
        if last or 2 * left > self.most:
            self.held, self.tokens = [], 0
            return rows
        self.held, self.tokens = [s for r in open_rows for s in r], left
        return [r for r, n in zip(rows, loads, strict=True) if n >= self.full * self.width]

    def matrix_row(self, row: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """ids, positions and cumulative lengths of one row."""
        ids, positions, edges = np.full(self.width, self.pad, "<u2"), np.zeros(self.width, "<u2"), [0]
        for *_, got in row:
            at = edges[-1]
            ids[at : at + len(got)], positions[at : at + len(got)] = got, np.arange(len(got))
            edges.append(at + len(got))
        positions[edges[-1] :] = np.arange(self.width - edges[-1])
        return ids, positions, edges


def pack_matrix(docs: DataFrame, width: int = 2048, path: str | None = None, kind: str = "spaced", end_id: int = 50256, pad_id: int = 50256, id_col: str = "doc_id", text_col: str = "text", buffer_tokens: int = 4_000_000) -> DataFrame:
    """One row a sequence: sequence_id, n_tokens, doc_ids, pieces, starts (token offset inside the document),
    cu_seqlens (int array from 0 to n_tokens), ids (width uint16, little-endian, padded) and positions (width uint16, from 0 in each segment and in the padding).

    A vocabulary of over 65,536 ids and a width beyond that raise an error. doc_ids may be of any type and null. Documents end with end_id; those of over width tokens are cut
    without loss, so joining a document's segments by piece gives its ids back. Null and empty texts are one
    end_id. Repeated rows are kept; an empty table gives an empty result; other columns are ignored.
    Segments are packed where their texts are read, without a shuffle: each task plans about buffer_tokens at a time and holds back what doesn't fill
    a row, so a partition wastes the last rows of its last plan only.
    """
    ready(docs.sparkSession)
    path = path or tokenizer_path("byte_bpe_50k.json")
    if max(library(path).get_vocab_size() - 1, end_id, pad_id, width - 1) > 65_535:
        raise ValueError("ids and positions must be under 65,536")
    id_type, id_kind = docs.schema[id_col].dataType.simpleString(), arrow_kind(docs, id_col)
    kinds = [pa.int64(), pa.int32(), pa.list_(id_kind), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    names = ["sequence_id", "n_tokens", "doc_ids", "pieces", "starts", "cu_seqlens", "ids", "positions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = text_encoder(path, kind), Packer(width, pad_id, buffer_tokens)
        numbers = count((TaskContext.get().partitionId() << 33) if TaskContext.get() else 0)

        def out(rows: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(rows), 512):
                cols: list[list] = [[] for _ in names]
                for row in rows[at : at + 512]:
                    ids, positions, edges = packer.matrix_row(row)
                    for c, v in zip(cols, (next(numbers), edges[-1], [s[0] for s in row], [s[1] for s in row], [s[2] for s in row], edges, ids.tobytes(), positions.tobytes()), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), byte_texts(b.column(1))
            for i, j in chunks(texts):
                for doc, ids in zip(doc_ids[i:j], enc.encode(texts[i:j]), strict=True):
                    ids = np.append(ids, end_id).astype("<u2")
                    for piece, start in enumerate(range(0, len(ids), width)):
                        if rows := packer.add((doc, piece, start, ids[start : start + width])):
                            yield from out(rows)
        yield from out(packer.flush(last=True))

    shape = f"sequence_id long, n_tokens int, doc_ids array<{id_type}>, pieces array<int>, starts array<long>, cu_seqlens array<int>, ids binary, positions binary"
    return require(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, shape)


def unpack(rows: list, width: int) -> dict:
    """(doc_id) -> ids, from collected rows of pack_matrix; for tests and readers (ids of repeated doc_ids must be unique)."""
    parts: dict = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2")
        for k, (d, p) in enumerate(zip(r["doc_ids"], r["pieces"], strict=True)):
            parts.setdefault(d, {})[p] = ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]]
    return {d: np.concatenate([ps[p] for p in sorted(ps)]) for d, ps in parts.items()}


def write_matrices(matrix: DataFrame, path: str) -> None:
    """Save packed rows as Parquet (ids and positions stay binary columns, one fixed width a table)."""
    matrix.write.parquet(path)

