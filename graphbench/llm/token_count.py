"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_texts, chunks, ready, require, tokenizer_path
from ._units import UnitTable, byte_letters, encode_ids, library, spaced_units, special_strings

#: How a byte-level pre-tokenizer cuts text; a fixed value of the public tokenizer.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache
def prove_whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as their own single token; proved once, by the driver."""
    import regex

    tok, letters, cut = library(path), byte_letters(), regex.compile(PRETOKEN)
    special, found = set(special_strings(tok)), []
    for s, i in tok.get_vocab(with_added_tokens=False).items():
        if s in special or any(c not in letters for c in s):
            continue
        try:
            text = bytes(letters[c] for c in s).decode()
        except UnicodeDecodeError:
            continue
        if cut.fullmatch(text) and cut.match(text).end() == len(text):
            found.append((text, i))
    ids = encode_ids(tok, [t for t, _ in found])
    return frozenset(t for (t, i), got in zip(found, ids, strict=True) if got == [i])


class Counter:
    """Counts tokens: proved pre-tokens count one, only the rest is merged. Counts are kept by unit."""

    def __init__(self, path: str, whole: frozenset[str]) -> None:
        import regex

        self.tok, self.cut, self.whole = library(path), regex.compile(PRETOKEN), whole
        self.special = [s.encode() for s in special_strings(self.tok)]
        self.table = UnitTable(self._count)
        self.merged = self.direct = 0

    def _count(self, units: list[str]) -> list[list[int]]:
        whole, findall = self.whole, self.cut.findall
        parts = [[u] if u in whole else findall(u) for u in units]
        rest = list({p for ps in parts for p in ps} - whole)
        sizes = dict(zip(rest, map(len, encode_ids(self.tok, rest)), strict=True))
        self.merged += len(rest)
        self.direct += sum(p in whole for ps in parts for p in ps)
        return [[sum(sizes.get(p, 1) for p in ps)] for ps in parts]

    def counts(self, texts: list[bytes | None]) -> list[int]:
        out = [0] * len(texts)
        for a, b in chunks(texts):
            units, sizes, odd = [], [], {}
            for i in range(a, b):
                t = texts[i]
                got: list[str] = []
                if t and any(s in t for s in self.special):
                    odd[i] = len(encode_ids(self.tok, [t.decode("utf-8", "replace")])[0])
                elif t:
                    got = spaced_units(t.decode("utf-8", "replace"))
                units += got
                sizes.append(len(got))
            rows = self.table.rows(units)
            each = np.concatenate(([0], np.cumsum(self.table.flat[self.table.starts[rows]], dtype=np.int64)))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            for k, i in enumerate(range(a, b)):
                out[i] = odd.get(i, int(each[ends[k + 1]] - each[ends[k]]))
            self.table.settle()
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str, proved: Callable[[], frozenset[str]]) -> Counter:
    """One a process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, proved())
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows give repeated rows; a null id stays null;
    an empty table gives an empty result; other columns are ignored. No shuffle.
    """
    spark = ready(docs.sparkSession)
    path = path or tokenizer_path("byte_bpe_50k.json")
    whole = spark.sparkContext.broadcast(prove_whole_tokens(path))  # as many strings as the vocabulary has at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, lambda: whole.value)
        for b in batches:
            texts = byte_texts(b.column(1))
            n = c.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return require(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
