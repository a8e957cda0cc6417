"""Exact tokenization of whole texts through a table of distinct units.

A unit is a stretch of text whose tokens don't depend on what stands around it. Frequent
units are encoded by the public library once; a text's ids are then gathered by numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain
from pathlib import Path

import numpy as np

from ._common import quiet_threads, ragged

#: White space as Unicode defines it; fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPACED = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")


def spaced_units(text: str) -> list[str]:
    """Units of a byte-level pre-tokenizer: a word with the one space before it, or a run of white space."""
    return _SPACED.findall(text)


class _Numbered(dict):
    """Numbers keys in order of first sight; `new` lists those not yet encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class UnitTable:
    """Distinct units and their ids. After a chunk that leaves over `limit` units or `limit_bytes` of units and ids, those met most often stay, up to half of both."""

    def __init__(self, encode_many: Callable[[list], list[list[int]] | tuple[np.ndarray, np.ndarray]], limit: int = 400_000, limit_bytes: int = 64_000_000) -> None:
        self.encode_many, self.limit, self.limit_bytes, self.held = encode_many, limit, limit_bytes, 0
        self.index = _Numbered()
        self.lengths, self.starts, self.hits = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.int32), 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate((a, np.zeros(max(n - len(a), len(a) // 2), a.dtype)))

    def rows(self, units: list) -> np.ndarray:
        """The table row of each unit; new units are encoded and entered."""
        index = self.index
        out = np.fromiter(map(index.__getitem__, units), np.int64, len(units))
        n = len(index)
        if new := index.new:
            ids = self.encode_many(new)
            if isinstance(ids, tuple):  # already flat, with the lengths
                flat, lens = ids
                total = len(flat)
            else:
                lens = np.fromiter(map(len, ids), np.int64, len(ids))
                total = int(lens.sum())
                flat = np.fromiter(chain.from_iterable(ids), np.int32, total)
            a = n - len(new)
            self.lengths, self.starts, self.hits = self._room(self.lengths, n), self._room(self.starts, n), self._room(self.hits, n)
            self.flat = self._room(self.flat, self.used + total)
            self.lengths[a:n] = lens
            self.starts[a:n] = self.used + np.cumsum(lens) - lens
            self.hits[a:n] = 0
            self.flat[self.used : self.used + total] = flat
            self.used += total
            self.held += sum(map(len, new)) + 4 * total
            index.new = []
        if len(out):
            self.hits[:n] += np.bincount(out, minlength=n)
        return out

    def ids(self, rows: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.starts[rows], self.lengths[rows])]

    def settle(self) -> None:
        """After a chunk: when over a limit, forget the units met least; rows given before no longer hold."""
        n = len(self.index)
        if n <= self.limit and self.held <= self.limit_bytes:
            return
        sizes = np.fromiter(map(len, self.index), np.int64, n) + 4 * self.lengths[:n]
        order = np.argsort(-self.hits[:n], kind="stable")[: self.limit // 2]
        kept = np.sort(order[np.cumsum(sizes[order]) <= self.limit_bytes // 2])
        stays = np.zeros(n, bool)
        stays[kept] = True
        index = _Numbered()
        index.update(zip((u for u, s in zip(self.index, stays.tolist(), strict=True) if s), range(len(kept)), strict=True))
        self.flat, self.held = self.ids(kept), int(sizes[kept].sum())
        self.lengths, self.hits, self.used, self.index = self.lengths[kept], self.hits[kept] // 2, len(self.flat), index
        self.starts = np.cumsum(self.lengths) - self.lengths


_LOADED: dict = {}


def library(path: str):
    """A tokenizer of the `tokenizers` library, loaded once a process."""
    if path not in _LOADED:
        quiet_threads()
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def encode_ids(tok, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def special_strings(tok) -> list[str]:
    return [t.content for t in tok.get_added_tokens_decoder().values()]


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: How the tokenizer with word ends cuts text; a fixed value of the public tokenizer.
WORD_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = b"\xff"


def merge_alone(symbols: list[bytes], order: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Merge symbols pair by pair: the earliest merge first, the leftmost of equals."""
    while len(symbols) > 1:
        best, at = min((order.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
        if best == 1 << 60:
            break
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


class WordMerger:
    """Merges single words as the library with word ends does, by a rank for each token instead of for each pair.

    The word end is byte 0xFF, which no UTF-8 text has, and joining it to the last byte ranks before all merges. Ranks hold only
    tokens that merge from their own bytes alone. For these both ways agree: up to when two neighbours could join into a
    token, nothing has merged across their outer edges, so they went through the steps of the token alone,
    whose only state of two symbols is its own last pair. And a token that doesn't merge alone is made by no text.
    """

    def __init__(self, path: str) -> None:
        import json

        import regex
        import tiktoken

        model, letters = json.loads(Path(path).read_text(encoding="utf-8"))["model"], byte_letters()

        def raw(token: str) -> bytes:
            end = token.endswith("</w>")
            return bytes(letters[c] for c in (token[:-4] if end else token)) + WORD_END * end

        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        ranks, self.ids = {bytes([b]): b for b in range(256)}, {}
        for c, b in letters.items():
            ranks[bytes([b]) + WORD_END] = 256 + b
            self.ids[b], self.ids[256 + b] = model["vocab"][c], model["vocab"][c + "</w>"]
        for i, (a, b) in enumerate(pairs):
            token = raw(a) + raw(b)
            end = token.endswith(WORD_END)
            alone = [bytes([x]) for x in (token[:-2] if end else token)] + [token[-2:]] * end
            if token not in ranks and merge_alone(alone, order) == [token]:
                ranks[token] = 512 + i
                self.ids[512 + i] = model["vocab"][a + b]
        self.merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.cut, self.tok = regex.compile(WORD_PRETOKEN), library(path)

    def encode(self, units: list[bytes]) -> list[list[int]]:
        """ids of units (no ASCII white space, A-Z lower-cased). What the library's normalizer might change goes to the library."""
        merge, ids, out, odd = self.merge, self.ids, [], []
        for u in units:
            if u.isalpha():
                out.append([ids[r] for r in merge(u + WORD_END)])
                continue
            s = u.decode("utf-8", "replace")
            if s.isprintable() and max(s) < "\u0250" and "\u0130" not in s:
                out.append([ids[r] for p in self.cut.findall(s.lower()) for r in merge(p.encode() + WORD_END)])
            else:
                odd.append(len(out))
                out.append(s)
        for i, got in zip(odd, encode_ids(self.tok, [out[i] for i in odd]), strict=True):
            out[i] = got
        return out


#: How a byte-level pre-tokenizer cuts text; a fixed value of the public tokenizer.
BYTE_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PieceMerger:
    """Merges units of a plain byte-level tokenizer as its library does, by a rank for each token (why this is the same: see WordMerger).

    Units of printable Latin characters, whose classes no Unicode version changes, are cut and merged here; all others go to the library.
    """

    def __init__(self, path: str, model: dict) -> None:
        import tiktoken

        self.tok, letters, vocab = library(path), byte_letters(), model["vocab"]
        made, merge = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], self.tok.model.tokenize
        ranks = {bytes([b]): b for b in range(256)}
        ids = np.zeros(256 + len(made), np.int32)
        for c, b in letters.items():
            ids[b] = vocab[c]
        for i, t in enumerate(made, 256):
            ids[i] = vocab[t]
            if len(merge(t)) == 1:  # what doesn't merge from its own letters is made by no text
                ranks[bytes([letters[c] for c in t])] = i
        self.top, self.ids = len(ids), np.concatenate((ids, np.arange(max(vocab.values()) + 1, dtype=np.int32)))
        self.cut = tiktoken.Encoding("pieces", pat_str=BYTE_PRETOKEN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    @classmethod
    def of(cls, path: str) -> PieceMerger | None:
        """None for a tokenizer that does more than to cut as above and to merge, or that makes a token by two merges."""
        import json

        d = json.loads(Path(path).read_text(encoding="utf-8"))
        model, first = d["model"], d["pre_tokenizer"] or {}
        more = [d.get("normalizer"), d.get("truncation"), d.get("padding"), *(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))]
        if model.get("type") != "BPE" or any(more) or first.get("type") != "ByteLevel" or first.get("add_prefix_space", True) or not first.get("use_regex", True):
            return None
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if len(set(made)) < len(made) or not all(c in model["vocab"] for c in byte_letters()):
            return None
        return cls(path, model)

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one behind the other, how many each has)."""
        cut, out, odd = self.cut, [], []
        for u in units:
            if u.isprintable() and len(u) < 1000 and (u.isascii() or max(u) < "\u0250"):
                out.append(cut(u))
            else:
                odd.append(len(out))
                out.append(u)
        for i, got in zip(odd, encode_ids(self.tok, [out[i] for i in odd]), strict=True):
            out[i] = [self.top + x for x in got]
        n = np.fromiter(map(len, out), np.int64, len(out))
        return self.ids[np.fromiter(chain.from_iterable(out), np.int64, int(n.sum()))], n


class TextEncoder:
    """ids of whole texts, equal to the library's `encode(text, add_special_tokens=False)`.

    kind 'spaced' is for byte-level pre-tokenizers; 'words' for those that lower-case and drop white space, whose units
    are cut and lower-cased as bytes. A text that holds the string of an added token goes to the library whole.
    """

    def __init__(self, path: str, kind: str) -> None:
        self.tok, self.words = library(path), kind == "words"
        self.special = [s.encode() for s in special_strings(self.tok)]
        self.merger = WordMerger(path) if self.words else PieceMerger.of(path)
        self.table = UnitTable(self._encode_units)

    def _encode_units(self, units: list) -> list[list[int]] | tuple[np.ndarray, np.ndarray]:
        return self.merger.encode(units) if self.merger else encode_ids(self.tok, units)

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        flat, counts, odd = [], np.zeros(len(texts), np.int64), []
        for i, t in enumerate(texts):
            if not t:
                continue
            t = t.lower() if self.words else t
            if any(s in t for s in self.special):
                odd.append(i)
                continue
            units = t.split() if self.words else spaced_units(t.decode("utf-8", "replace"))
            counts[i] = len(units)
            flat += units
        rows = self.table.rows(flat)
        ids, held = self.table.ids(rows), self.table.lengths[rows]
        ends = np.concatenate(([0], np.cumsum(held)))[np.concatenate(([0], np.cumsum(counts)))]
        out = [ids[ends[i] : ends[i + 1]] for i in range(len(texts))]
        for i in odd:
            out[i] = np.asarray(encode_ids(self.tok, [texts[i].decode("utf-8", "replace")])[0], np.int32)
        self.table.settle()
        return out


_ENCODERS: dict = {}


def text_encoder(path: str, kind: str) -> TextEncoder:
    """One a process."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = TextEncoder(path, kind)
    return _ENCODERS[path, kind]
