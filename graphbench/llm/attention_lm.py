"""Language-model scoring: a causal self-attention model over subword ids, mixed with corpus word counts."""

from __future__ import annotations

import base64
import math
import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_texts, chunks, lists, materialize, ragged, ready, remainder_is, require, tokenizer_path
from ._units import UnitTable
from .token_count import PRETOKEN

BLOCK, CONTEXT = 16, 16
WINDOW = BLOCK + CONTEXT
FAR = -1e4
#: The training texts are dealt to so many rounds; the tasks' weights meet after each.
ROUNDS = 4


class Vocabulary:
    """Model ids: 256 bytes, end of word, end of text, then the frequent (token, last in its word) pairs, then joints of two ids.

    A pair that isn't among them is spelled in bytes, with the end-of-word id if it closes a word. Then two neighbours within a word
    that have a joint become one id, from the left on. So every word is a sequence that no other word's sequence begins with (its last id
    closes words, no other of its ids does), and word probabilities add up to one at most.
    """

    WORD_END, TEXT_END, FIRST = 256, 257, 258

    def __init__(self, path: str, pairs: list[tuple[int, bool]], ranks: dict[bytes, int], joints: np.ndarray | None = None) -> None:
        self.path, self.mark, number = path, uuid.uuid4().hex, {p: i for i, p in enumerate(pairs, self.FIRST)}
        top = max(ranks.values()) + 1
        spelled: list[list[int]] = [[]] * (2 * top)  # of token i: inside a word at 2 i, at its end at 2 i + 1
        for b, i in ranks.items():
            spelled[2 * i] = [number[i, False]] if (i, False) in number else list(b)
            spelled[2 * i + 1] = [number[i, True]] if (i, True) in number else [*b, self.WORD_END]
        self.lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.fromiter(chain.from_iterable(spelled), np.int32, int(self.lengths.sum()))
        self.base = self.FIRST + len(pairs)
        self.joints = np.sort(np.asarray([] if joints is None else joints, np.int64))  # first id * base + second
        self.size = self.base + len(self.joints)

    @staticmethod
    def tokenizer(path: str):
        """The public byte-level merges as ranks; special strings are ordinary text to it."""
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        return tiktoken.Encoding("ranks", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={}), ranks

    @classmethod
    def learn(cls, path: str, words: Counter, size: int) -> Vocabulary:
        """From words and their counts: the pairs that are met most often."""
        tok, ranks = cls.tokenizer(path)
        keys, _ = token_keys(tok, list(words))
        seen = np.bincount(keys[0], weights=np.repeat(np.fromiter(words.values(), np.float64, len(words)), keys[1])) if words else np.zeros(0)
        return cls(path, commonest(dict(zip(np.flatnonzero(seen).tolist(), seen[seen > 0].tolist(), strict=True)), size), ranks)

    def encode_flat(self, tok, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one behind the other, how many each word has)."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        (keys, n), first = token_keys(tok, words)
        each = self.lengths[keys]
        return self._joined(self.flat[ragged(self.starts[keys], each)], np.add.reduceat(each, first))

    def _joined(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours with a joint as one id; of a row of such neighbours the first and second, the third and fourth, and so on."""
        if not len(self.joints) or len(ids) < 2:
            return ids, n
        word, key = np.repeat(np.arange(len(n)), n), ids[:-1] * np.int64(self.base) + ids[1:]
        at = np.minimum(np.searchsorted(self.joints, key), len(self.joints) - 1)
        can = (self.joints[at] == key) & (word[1:] == word[:-1])
        i, start = np.arange(len(can)), can.copy()
        start[1:] &= ~can[:-1]
        take = can & ((i - np.maximum.accumulate(np.where(start, i, 0))) % 2 == 0)
        out, keep = ids.copy(), np.ones(len(ids), bool)
        out[:-1][take] = self.base + at[take]
        keep[1:][take] = False
        return out[keep], n - np.bincount(word[:-1][take], minlength=len(n))

    def encode_words(self, tok, words: list[bytes]) -> list[list[int]]:
        flat, n = self.encode_flat(tok, words)
        return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] if words else []


def token_keys(tok, words: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """((2 * token + whether it ends its word, for all words; tokens of each word), where each word starts)."""
    encode = tok._core_bpe.encode_ordinary
    tokens = [encode(" " + w.decode("utf-8", "replace")) for w in words]
    n = np.fromiter(map(len, tokens), np.int64, len(tokens))
    keys = 2 * np.fromiter(chain.from_iterable(tokens), np.int64, int(n.sum()))
    ends = np.cumsum(n)
    keys[ends - 1] += 1
    return (keys, n), ends - n


def commonest(seen: dict[int, float], size: int) -> list[tuple[int, bool]]:
    """The (token, ends its word) pairs of the greatest counts by key, as many as fit beside the bytes; ties by key."""
    best = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: size - Vocabulary.FIRST]
    return [(k >> 1, bool(k & 1)) for k, _ in best]


def commonest_joints(key: np.ndarray, n: np.ndarray, size: int, base: int, most: int, least: float) -> np.ndarray:
    """From counts n by id * size + the id before it in the word: the pairs of the greatest counts, `most` of them, each met `least` times, as first * base + second; ties by that key."""
    enough = n >= least
    joint, n = key[enough] % size * base + key[enough] // size, n[enough]
    return np.sort(joint[np.lexsort((joint, -n))[:most]])


def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(place of each text's first id, block starts, total): CONTEXT pads before each text, then whole blocks."""
    blocks = -(-lengths // BLOCK)
    room = CONTEXT + blocks * BLOCK
    first = np.cumsum(room) - room + CONTEXT
    starts = np.repeat(first, blocks) + BLOCK * (np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    return first, starts, int(room.sum())


class Model:
    """One attention layer and one feed-forward layer; the output is a class, then a member of the class.

    Queries see the CONTEXT ids before their block and those of the block up to themselves, with a bias
    for each distance. As one layer's queries, keys and values depend on the id alone, scoring looks them up.
    """

    def __init__(self, size: int, classes: np.ndarray, members: np.ndarray, shape: tuple[int, int], dim: int = 24, key: int = 8, hidden: int = 32, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.size, self.cls, self.mem, self.shape, self.key = size, classes, members, shape, key
        g = lambda *s, scale: (r.normal(size=s) * scale).astype(np.float32)
        self.p = {
            "E": g(size + 1, dim, scale=0.3), "q": g(dim, key, scale=dim**-0.5), "k": g(dim, key, scale=dim**-0.5), "v": g(dim, dim, scale=0.5 * dim**-0.5),
            "rel": np.zeros(WINDOW, np.float32), "w1": g(dim, hidden, scale=dim**-0.5), "b1": np.zeros(hidden, np.float32), "w2": g(hidden, dim, scale=0.3 * hidden**-0.5),
            "wc": g(dim, shape[0], scale=0.1), "bc": np.zeros(shape[0], np.float32), "wm": g(shape[0], dim, shape[1], scale=0.1), "bm": np.full((shape[0], shape[1]), FAR, np.float32),
        }
        self.p["bm"][classes, members] = 0
        used = np.zeros(shape[0], np.int64)
        np.maximum.at(used, classes, members + 1)
        width = [min(shape[1], max(8, 1 << (int(u) - 1).bit_length())) if u else 0 for u in used]
        edges = [k for k in range(shape[0] + 1) if k in (0, shape[0]) or width[k] != width[k - 1]]
        #: (first class, end, columns) of neighbouring classes whose members need as many columns.
        self.runs = [(a, b, width[a]) for a, b in zip(edges, edges[1:], strict=False) if width[a]]
        i, j = np.arange(BLOCK)[:, None], np.arange(WINDOW)[None]
        self.dist = CONTEXT + i - j
        self.tables: np.ndarray | None = None

    def prior(self, counts: np.ndarray) -> None:
        """Start the output biases from counts of ids."""
        c = counts + 0.5
        per = np.bincount(self.cls, weights=c, minlength=self.shape[0])
        self.p["bc"][:] = np.log(per / per.sum())
        self.p["bm"][self.cls, self.mem] = np.log(c / per[self.cls])

    def _bias(self) -> np.ndarray:
        return np.where(self.dist >= 0, self.p["rel"][np.clip(self.dist, 0, WINDOW - 1)], FAR).astype(np.float32)

    def _maps(self) -> np.ndarray:
        """What makes an id's query, key and value of its embedding."""
        return np.hstack((self.p["q"] / math.sqrt(self.key), self.p["k"], self.p["v"]))

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By id: (query, one), (key, FAR for a pad), (value, one) and embedding. So scores hold the shut pads, and weighted values their weights' sum."""
        e, key = self.p["E"], self.key
        got = e @ self._maps()
        one, shut = np.ones((self.size + 1, 1), got.dtype), np.zeros((self.size + 1, 1), got.dtype)
        shut[self.size] = FAR
        got[self.size, key : 2 * key] = 0
        return np.hstack((got[:, :key], one)), np.hstack((got[:, key : 2 * key], shut)), np.hstack((got[:, 2 * key :], one)), e

    def ready(self) -> None:
        parts = self._tables()
        self.edges = tuple(np.cumsum([t.shape[1] for t in parts[:3]]).tolist())
        self.tables = np.ascontiguousarray(np.hstack(parts), np.float32)
        self.bias = self._bias()
        self.bounded = self._bounded(*parts[:2], self.bias)
        self.out_c = np.vstack((self.p["wc"], self.p["bc"])).astype(np.float32)
        self.out_m = {k: np.vstack((self.p["wm"][k, :, :n], self.p["bm"][k, :n])).astype(np.float32) for a, b, n in self.runs for k in range(a, b)}

    def _bounded(self, q: np.ndarray, k: np.ndarray, bias: np.ndarray) -> bool:
        """Whether no attention score can pass 60, by the longest query and key."""
        most = [math.sqrt(float(np.einsum("ij,ij->i", t[:, : self.key], t[:, : self.key]).max())) for t in (q, k)]
        return most[0] * most[1] + float(bias.max()) < 60

    def log_probs(self, texts: np.ndarray, lengths: np.ndarray, blocks_at_once: int = 192, rows_at_once: int = 65_536) -> np.ndarray:
        """Natural log probability of every id of `texts` (flat, `lengths` ids each), given those before it in its text.

        Texts lie one behind the other, each after CONTEXT pads and in whole blocks, so that the windows of
        successive blocks are overlapping views of one table lookup; only a block's own ids are scored. Attention works on
        few blocks at once, which stay in a core's cache; the output on rows_at_once, as its classes share them out.
        """
        if self.tables is None:
            self.ready()
        lengths = np.asarray(lengths, np.int64)
        if not len(texts):
            return np.zeros(0)
        first, _, total = layout(lengths)
        place = ragged(first, lengths)
        x = np.full(total + CONTEXT, self.size, np.int32)
        x[place[1:]] = texts[:-1]
        x[first[lengths > 0]] = Vocabulary.TEXT_END
        y = np.full(total, -1, np.int32)
        y[place] = texts
        q_at, k_at, v_at = self.edges
        out = np.zeros(total, np.float32)
        held, at, rows = [], [], 0
        for a in range(CONTEXT, total, blocks_at_once * BLOCK):
            b = min(total, a + blocks_at_once * BLOCK)
            got = np.take(self.tables, x[a - CONTEXT : b], axis=0)
            n, row = (b - a) // BLOCK, got.strides[0]
            view = lambda c, d, size, skip, g=got, n=n, row=row: np.lib.stride_tricks.as_strided(g[skip:, c:d], (n, size, d - c), (row * BLOCK, row, 4))
            score = view(0, q_at, BLOCK, CONTEXT) @ view(q_at, k_at, WINDOW, 0).transpose(0, 2, 1)
            score += self.bias
            if not self.bounded:
                np.minimum(score, 60, out=score)
            np.exp(score, out=score)
            att = (score @ view(k_at, v_at, WINDOW, 0)).reshape(b - a, -1)  # the last column is the sum of the weights
            h = att[:, :-1] / np.maximum(att[:, -1:], 1e-30)
            h += got[CONTEXT:, v_at:]
            keep = np.flatnonzero(y[a:b] >= 0)
            held.append(self._feed(np.take(h, keep, axis=0)))
            at.append(a + keep)
            rows += len(keep)
            if rows >= rows_at_once or b == total:
                where = np.concatenate(at)
                out[where] = self._output(np.concatenate(held), y[where])
                held, at, rows = [], [], 0
        return out[place].astype(np.float64)

    def _feed(self, h: np.ndarray) -> np.ndarray:
        p = self.p
        act = h @ p["w1"]
        act += p["b1"]
        act *= act > 0
        h += act @ p["w2"]
        return h

    def _output(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        c = self.cls[y]
        order = np.argsort(c.astype(np.uint16), kind="stable")
        c, m, lp = c[order], self.mem[y[order]], np.empty(len(y), np.float32)
        hs = np.ones((len(y), h.shape[1] + 1), np.float32)
        hs[:, :-1] = np.take(h, order, axis=0)
        rows, got = np.arange(2048), np.empty(len(y), np.float32)
        for a in range(0, len(y), 2048):
            z = hs[a : a + 2048] @ self.out_c
            got[a : a + 2048] = z[rows[: len(z)], c[a : a + 2048]] - _log_sum(z)
        edges = np.searchsorted(c, np.arange(self.shape[0] + 1)).tolist()
        for k0, k1, width in self.runs:
            first, end = edges[k0], edges[k1]
            z, k = np.empty((min(2048, end - first), width), np.float32), k0
            for a in range(first, end, 2048):
                b = min(end, a + 2048)
                while k < k1 and edges[k] < b:
                    i, j = max(a, edges[k]), min(b, edges[k + 1])
                    if i < j:
                        np.matmul(hs[i:j], self.out_m[k], out=z[i - a : j - a])
                    if edges[k + 1] > b:
                        break
                    k += 1
                got[a:b] += z[rows[: b - a], m[a:b]] - _log_sum(z[: b - a])
        lp[order] = got
        return lp

    def train(self, texts: np.ndarray, lengths: np.ndarray, steps: int = 700, batch: int = 192, rate: float = 8e-3, seed: int = 3, once: bool = False) -> list[float]:
        """Adam on random blocks or, if once, on every block one time; returns the mean loss of every 50 steps."""
        lengths = np.asarray(lengths, np.int64)
        first, starts, total = layout(lengths)
        place = ragged(first, lengths)
        x, y, valid = np.full(total, self.size, np.int64), np.zeros(total, np.int64), np.zeros(total, bool)
        y[place], valid[place] = texts, True
        x[place[1:]] = texts[:-1]
        x[first[lengths > 0]] = Vocabulary.TEXT_END
        r, grid, losses = np.random.default_rng(seed), np.arange(-CONTEXT, BLOCK), []
        if once:
            starts = r.permutation(starts)
            steps = -(-len(starts) // batch)
        adam = Adam(self.p)
        for step in range(1, steps + 1):
            s = starts[(step - 1) * batch : step * batch] if once else starts[r.integers(len(starts), size=batch)]
            at = s[:, None] + grid
            loss, grads = self._grads(x[at], y[at[:, CONTEXT:]], valid[at[:, CONTEXT:]])
            losses.append(loss)
            adam.step(grads, rate * min(1, step / 40) * (0.5 + 0.5 * math.cos(math.pi * step / (steps + 1))))
        self.tables = None
        return [float(np.mean(losses[i : i + 50])) for i in range(0, len(losses), 50)]

    def _grads(self, xw: np.ndarray, y: np.ndarray, ok: np.ndarray) -> tuple[float, dict]:
        """Mean loss of the ids y where ok, and its gradients; a row of xw is a window.

        Queries, keys and values are looked up by id, and their gradients are summed by id before they go through the weights. Attention's
        weights stay without their sum's division: what divides is put on the queries' side, the smaller one.
        """
        p, key, n = self.p, self.key, len(xw)
        tq, tk, tv, te = self._tables()
        own, bias = xw[:, CONTEXT:], self._bias()
        q, kv = np.take(tq, own, axis=0), np.take(np.hstack((tk, tv)), xw, axis=0)
        k, v = kv[:, :, : key + 1], kv[:, :, key + 1 :]
        a = q @ k.transpose(0, 2, 1)
        a += bias
        if not self._bounded(tq, tk, bias):
            np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        att = (a @ v).reshape(own.size, -1)
        total, ok = np.maximum(att[:, -1:], 1e-30), ok.ravel()
        counted = np.count_nonzero(ok)
        keep = slice(None) if counted > 0.8 * ok.size else np.flatnonzero(ok)  # few rows that don't count cost less than to leave them out
        mixed, at = att[keep, :-1] / total[keep], own.ravel()[keep]
        h0 = mixed + np.take(te, at, axis=0)
        act = h0 @ p["w1"]
        act += p["b1"]
        on = act > 0
        act *= on
        loss, dh, g = self._output_grads(h0 + act @ p["w2"], y.ravel()[keep], (ok[keep] / max(1, counted)).astype(h0.dtype))
        da = dh @ p["w2"].T
        da *= on
        g |= {"w2": act.T @ dh, "w1": h0.T @ da, "b1": da.sum(0)}
        dh += da @ p["w1"].T
        back = np.zeros((own.size, att.shape[1]), dh.dtype)  # gradient by the value, and what the sum of weights takes off
        back[keep, :-1], back[keep, -1] = dh, -np.einsum("ij,ij->i", dh, mixed)
        back /= total
        back = back.reshape(n, BLOCK, -1)
        ds = back @ v.transpose(0, 2, 1)
        ds *= a
        seen = self.dist >= 0
        g["rel"] = np.bincount(self.dist[seen], weights=ds.sum(0)[seen], minlength=WINDOW).astype(np.float32)
        by_key = _sum_by(xw.ravel(), [ds.transpose(0, 2, 1) @ q[:, :, :-1], a.transpose(0, 2, 1) @ back[:, :, :-1]], self.size + 1)
        by_query = _sum_by(at, [(ds @ k[:, :, :-1]).reshape(own.size, key)[keep], dh], self.size + 1)
        through = np.hstack((by_query[:, :key], by_key))
        through[self.size] = 0
        maps = te.T @ through
        g |= {"q": maps[:, :key] / math.sqrt(key), "k": maps[:, key : 2 * key], "v": maps[:, 2 * key :]}
        g["E"] = through @ self._maps().T
        g["E"] += by_query[:, key:]
        g["E"][self.size] = 0
        return loss, g

    def _output_grads(self, h: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, dict]:
        """Loss of y with the weights w, the gradient of h, and those of the output's weights; rows are taken in the order of their classes."""
        p = self.p
        order = np.argsort(self.cls[y].astype(np.uint16), kind="stable")
        y, w = y[order], w[order]
        c, m, rows = self.cls[y], self.mem[y], np.arange(len(y))
        hs = np.ones((len(y), h.shape[1] + 1), h.dtype)
        hs[:, :-1] = np.take(h, order, axis=0)
        wc, wm = np.vstack((p["wc"], p["bc"])), np.concatenate((p["wm"], p["bm"][:, None]), axis=1)
        pc, loss = _softmax_loss(hs @ wc, c, rows, w)
        gc, dh = hs.T @ pc, pc @ p["wc"].T
        edges, gm, turned = np.searchsorted(c, np.arange(self.shape[0] + 1)).tolist(), np.zeros_like(wm), p["wm"].transpose(0, 2, 1)
        for k0, k1, width in self.runs:
            first, end = edges[k0], edges[k1]
            met = [(k, edges[k] - first, edges[k + 1] - first) for k in range(k0, k1) if edges[k] < edges[k + 1]]
            z, hr, dr = np.empty((end - first, width), h.dtype), hs[first:end], dh[first:end]
            for k, a, b in met:
                np.matmul(hr[a:b], wm[k, :, :width], out=z[a:b])
            pm, lost = _softmax_loss(z, m[first:end], rows[: end - first], w[first:end])
            loss += lost
            for k, a, b in met:
                gm[k, :, :width] = hr[a:b].T @ pm[a:b]
                dr[a:b] += pm[a:b] @ turned[k, :width]
        out = np.empty_like(dh)
        out[order] = dh
        return loss, out, {"wc": gc[:-1], "bc": gc[-1], "wm": gm[:, :-1], "bm": gm[:, -1]}


class Adam:
    """Adam over all of a model's weights at once: they become parts of one vector."""

    def __init__(self, p: dict) -> None:
        self.p, self.t = p, 0
        self.flat = np.concatenate([v.ravel() for v in p.values()])
        self.m1, self.m2, self.room = np.zeros_like(self.flat), np.zeros_like(self.flat), np.empty_like(self.flat)
        at = 0
        for k, v in p.items():
            p[k] = self.flat[at : at + v.size].reshape(v.shape)
            at += v.size

    def step(self, grads: dict, rate: float) -> None:
        self.t += 1
        g, m1, m2, room = np.concatenate([grads[k].ravel() for k in self.p]).astype(self.flat.dtype, copy=False), self.m1, self.m2, self.room
        m1 *= 0.9
        g *= 0.1
        m1 += g
        g *= g  # a hundredth of the gradient's square
        m2 *= 0.99
        m2 += g
        np.sqrt(m2, out=room)
        left = math.sqrt(1 - 0.99**self.t)
        room += 1e-6 * left
        np.divide(m1, room, out=room)
        room *= rate * left / (1 - 0.9**self.t)
        self.flat -= room


def _sum_by(index: np.ndarray, parts: list[np.ndarray], size: int) -> np.ndarray:
    """Sums of the rows of each index, over columns of all parts."""
    rows = np.concatenate([x.reshape(len(index), -1) for x in parts], axis=1)
    out, n = np.zeros(size * rows.shape[1], rows.dtype), rows.shape[1]
    np.add.at(out, ((index * n)[:, None] + np.arange(n)).ravel(), rows.ravel())
    return out.reshape(size, n)


def _softmax_loss(z: np.ndarray, at: np.ndarray, rows: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """(softmax of each row, less one at its `at`, times the row's w; the sum of w * -log of the softmax there)."""
    held = z[rows, at]
    with np.errstate(over="ignore"):
        e = np.exp(z)
    total = np.einsum("ij->i", e)
    if total.min(initial=1) > 1e-30 and total.max(initial=1) < 1e30:
        log_sum = np.log(total)
        e *= (w / total)[:, None]
    else:
        log_sum = _log_sum(z)
        e = w[:, None] * np.exp(z - log_sum[:, None])
    e[rows, at] -= w
    return e, float(w @ (log_sum - held))


def _log_sum(z: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each row; only rows out of single precision's range pay for their maximum."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        e = np.exp(z)
        total = np.einsum("ij->i", e)
        out = np.log(total)
    if not (total.min(initial=1) > 1e-30 and total.max(initial=1) < 1e30):
        odd = np.flatnonzero(~((total > 1e-30) & (total < 1e30)))
        top = z[odd].max(axis=1)
        out[odd] = np.log(np.exp(z[odd] - top[:, None]).sum(axis=1)) + top
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def class_widths(counts: np.ndarray) -> list[int]:
    """How many ids each class takes, the commonest ids first: few a class among these, many among the rare ones.

    Of three sizes of class and their shares of the ids, those for which a class more and the members of a class, by how often they are met, cost least.
    """
    size, share = len(counts), np.concatenate(([0.0], np.cumsum(np.sort(counts)[::-1]))) / max(1, counts.sum())
    best = (math.inf, [])
    for few, w1 in ((a, b) for a in (0, 32, 64, 128, 256) for b in (8, 16)):
        for more, w2 in ((a, b) for a in (256, 512, 1024, 2048) for b in (16, 32, 64)):
            for w3 in (64, 128, 256):
                ends = [min(few, size), min(more, size), size]
                n = [-(-max(0, b - a) // w) for a, b, w in zip([0, *ends], ends, (w1, w2, w3), strict=False)]
                cost = 1.3 * sum(n) + sum(w * (share[b] - share[a]) for a, b, w in zip([0, *ends], ends, (w1, w2, w3), strict=False))
                if cost < best[0]:
                    tiers = zip([0, *ends], ends, (w1, w2, w3), strict=False)
                    best = (cost, [min(w, b - i) for a, b, w in tiers for i in range(a, b, w)])
    return best[1]


def word_classes(counts: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """(class, member, shape) of ids: those about as common are neighbours by what precedes them (first singular vectors of the logs of n, the counts by id * size + the id before)."""
    size, (row, col), x = len(counts), np.divmod(key, len(counts)), np.log1p(n)
    summed = lambda to, at, b: np.stack([np.bincount(to, weights=x * b[at, j], minlength=size) for j in range(b.shape[1])], axis=1)
    basis = np.linalg.qr(summed(col, row, summed(row, col, np.random.default_rng(0).normal(size=(size, 8)))))[0]
    u = summed(row, col, basis) / (np.sqrt(np.bincount(row, weights=x * x, minlength=size)) + 1e-6)[:, None]
    u -= u.mean(0)
    near = u @ np.linalg.svd(u, full_matrices=False)[2][0]
    widths = np.asarray(class_widths(counts))
    tier = np.empty(size, np.int64)  # by the size of the classes that the id's count comes to
    tier[np.argsort(-counts, kind="stable")] = np.repeat(np.concatenate(([0], np.cumsum(np.abs(np.diff(widths)) > 0))), widths)
    order = np.lexsort((near, np.bincount(row, weights=n, minlength=size) == 0, tier))
    cls, mem = np.empty(size, np.int64), np.empty(size, np.int64)
    cls[order] = np.repeat(np.arange(len(widths)), widths)
    mem[order] = np.arange(size) - np.repeat(np.cumsum(widths) - widths, widths)
    return cls, mem, (len(widths), int(widths.max()))


def fit(texts: list[bytes], path: str, size: int = 2500, steps: int = 700, vocab: Vocabulary | None = None, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[Vocabulary, Model]:
    """Learn the ids and the counts of pairs and of ids behind the classes (unless they are given), and the weights, from texts."""
    docs = [t.lower().split() for t in texts]
    words = Counter(w for d in docs for w in d)
    vocab = vocab or Vocabulary.learn(path, words, size)
    flat, lengths = encode_docs(vocab, Vocabulary.tokenizer(path)[0], docs, list(words))
    size = max(size, vocab.size)
    if known is None:
        known = np.bincount(flat, minlength=size).astype(float), *np.unique(flat[1:] * size + flat[:-1], return_counts=True)
    cls, mem, shape = word_classes(*known)
    model = Model(size, cls, mem, shape)
    model.prior(known[0])
    if len(flat):
        model.train(flat, lengths, steps)
    return vocab, model


def encode_docs(vocab: Vocabulary, tok, docs: list[list[bytes]], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each with its end, one behind the other; how many each has); words: the distinct words."""
    ids, n = vocab.encode_flat(tok, words)
    number = {w: i for i, w in enumerate(words)}
    starts = np.cumsum(n) - n
    out = []
    for d in docs:
        at = np.fromiter(map(number.__getitem__, d), np.int64, len(d))
        out.append(np.append(ids[ragged(starts[at], n[at])], Vocabulary.TEXT_END))
    return (np.concatenate(out) if out else np.zeros(0, np.int64)).astype(np.int64), np.asarray([len(x) for x in out], np.int64)


_TABLES: dict = {}


def word_table(vocab: Vocabulary) -> UnitTable:
    """The ids of the words that a worker has met; one a process, kept from round to round."""
    if vocab.mark not in _TABLES:
        _TABLES.clear()
        tok = Vocabulary.tokenizer(vocab.path)[0]
        _TABLES[vocab.mark] = UnitTable(lambda words: vocab.encode_flat(tok, words), 400_000)
    return _TABLES[vocab.mark]


def spell(table: UnitTable, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """What encode_docs gives, from a table of words."""
    n = np.fromiter(map(len, docs), np.int64, len(docs))
    rows = table.rows([w for d in docs for w in d])
    per_doc = np.bincount(np.repeat(np.arange(len(docs)), n), weights=table.lengths[rows], minlength=len(docs)).astype(np.int64)
    ids = np.full(int(per_doc.sum()) + len(docs), Vocabulary.TEXT_END, np.int64)
    ids[ragged(np.cumsum(per_doc + 1) - per_doc - 1, per_doc)] = table.ids(rows)
    table.settle()
    return ids, per_doc + 1


def _pair_counts(path: str):
    """(key, n): how often each (token, ends its word) pair occurs, from a table of words and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, ranks = Vocabulary.tokenizer(path)
        total = np.zeros(2 * (max(ranks.values()) + 1))
        for b in batches:
            words = b.column(0).to_pylist()
            for at in range(0, len(words), 20_000):
                (keys, n), _ = token_keys(tok, words[at : at + 20_000])
                total += np.bincount(keys, weights=np.repeat(b.column(1).slice(at, 20_000).to_numpy().astype(float), n), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["key", "n"])

    return run


def _id_pairs(shared, size: int):
    """(key, n) from a table of words and counts: id * size + the id before it in the word; -1 - id for the ids alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        tok, held = Vocabulary.tokenizer(vocab.path)[0], [(np.zeros(0, np.int64), np.zeros(0))]

        def summed() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return key, np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(key))

        for b in batches:
            words = b.column(0).to_pylist()
            for at in range(0, len(words), 20_000):
                ids, n = vocab.encode_flat(tok, words[at : at + 20_000])
                ids, c = ids.astype(np.int64), np.repeat(b.column(1).slice(at, 20_000).to_numpy().astype(float), n)
                inner = np.ones(len(ids), bool)
                inner[(np.cumsum(n) - n)[n > 0]] = False
                held.append((np.concatenate(((ids * size + np.roll(ids, 1))[inner], -1 - ids)), np.concatenate((c[inner], c))))
                held[:] = [summed()]
        key, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n)], names=["key", "n"])

    return run


def id_keys(counts: DataFrame, vocab: Vocabulary, size: int, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how often each id stands, key, n), in all training texts, `ends` of them; n counts the pairs of an id and the one before it within a word, by id * size + the one before."""
    got = counts.mapInArrow(_id_pairs(counts.sparkSession.sparkContext.broadcast(vocab), size), "key long, n double").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = got.column("key").to_numpy(), got.column("n").to_numpy()
    own, order = np.zeros(size), np.argsort(key[key >= 0], kind="stable")
    own[-1 - key[key < 0]] = n[key < 0]
    own[Vocabulary.TEXT_END] += ends
    return own, key[key >= 0][order], n[key >= 0][order]


def id_counts(counts: DataFrame, vocab: Vocabulary, size: int, ends: int) -> tuple[np.ndarray, np.ndarray]:
    """What id_keys counts, the pairs as a matrix (row: the id, column: the one before) and each id's number."""
    own, key, n = id_keys(counts, vocab, size, ends)
    pairs = np.zeros(size * size, np.float32)
    pairs[key] = n
    return pairs.reshape(size, size), own


def _train_here(shared, rate: float, most_bytes: int):
    """(part, ids, weights): a task's own weights after every block of its texts was met once, from common ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, start = shared.value
        table, model, held, used, seen = word_table(vocab), pickle.loads(pickle.dumps(start)), [], 0, 0

        def learn() -> int:
            flat, lengths = spell(table, [t.lower().split() for t in held])
            model.train(flat, lengths, rate=rate, once=True, batch=384)
            held.clear()
            return len(flat)

        for b in batches:
            for t in byte_texts(b.column(0)):
                if t:
                    held.append(t)
                    used += len(t)
                if used >= most_bytes:
                    seen, used = seen + learn(), 0
        if held:
            seen += learn()
        if seen:
            part = TaskContext.get().partitionId() if TaskContext.get() else 0
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([float(seen)]), pa.array([pickle.dumps(model.p)], pa.binary())], names=["part", "ids", "weights"])

    return run


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row: the mean of the weights, by the number of ids each has met."""
    total, mean = float(pdf["ids"].sum()), None
    for n, blob in zip(pdf["ids"], pdf["weights"], strict=True):
        p = pickle.loads(blob)
        mean = {k: v * (n / total) + (mean[k] if mean else 0) for k, v in p.items()}
    return pd.DataFrame({"part": [0], "ids": [total], "weights": [pickle.dumps({k: np.asarray(v, np.float32) for k, v in mean.items()})]})


def train_on_share(train: DataFrame, vocab: Vocabulary, model: Model, share: float, rate: float = 2e-3, most_bytes: int = 4_000_000, above: float = 0.0) -> float:
    """Train on a share of all training texts, by hash of the id (from `above` to `share`; all of them at 0 and 1), where they lie.

    Every task goes on from the same weights over its own texts; their mean, by ids met, is the model's. Means are taken in groups of tasks first,
    so that the driver reads as many weights as the square root of the tasks. Returns the number of ids met."""
    spark, shape = train.sparkSession, "part long, ids double, weights binary"
    chance = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    some = train.where((chance >= above) & (chance < share)).select("text")
    groups = math.isqrt(some.rdd.getNumPartitions()) + 1
    parts = some.mapInArrow(_train_here(spark.sparkContext.broadcast((vocab, model)), rate, most_bytes), shape)
    means = parts.withColumn("g", F.pmod("part", F.lit(groups))).groupBy("g").applyInPandas(lambda pdf: _average(pdf), shape).toPandas()
    if len(means):
        whole = _average(means)
        model.p, model.tables = pickle.loads(whole["weights"][0]), None
        return float(whole["ids"][0])
    return 0.0


def _count_words(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        _SCORERS.clear()
        _TABLES.clear()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "c"])
            held.clear()
            return b

        for b in batches:
            for t in byte_texts(b.column(0)):
                held.update(t.lower().split() if t else ())
                if len(held) > most:
                    yield out()
        yield out()

    return run


class Scorer:
    """Scores texts in one worker; words among the frequent ones are finished here, the others keep their log probability."""

    def __init__(self, vocab: Vocabulary, model: Model, frequent: list[bytes], counts: np.ndarray, end_count: int, total: float, weight: float) -> None:
        self.vocab, self.model, self.tok = vocab, model, Vocabulary.tokenizer(vocab.path)[0]
        self.number, self.counts = {w: i for i, w in enumerate(frequent)}, np.append(counts, 0.0)
        self.end_p, self.total, self.weight = (end_count + 0.5) / total, total, weight
        self.end_known = end_count > 0
        self.table = UnitTable(self._encode, 400_000)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number among the frequent words (or -1), then the model ids."""
        ids, n = self.vocab.encode_flat(self.tok, words)
        ends = np.cumsum(n + 1)
        out = np.empty(len(ids) + len(words), np.int32)
        first = ends - n - 1
        out[first] = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))
        out[ragged(first + 1, n)] = ids
        return out, n + 1

    def score(self, texts: list[bytes | None]) -> tuple:
        """n_words, n_known, base, score of each text from frequent words and the end; tail words, their logs (natural) and their numbers by text."""
        docs = [t.lower().split() if t else [] for t in texts]
        n = np.fromiter(map(len, docs), np.int64, len(docs))
        flat = [w for d in docs for w in d]
        rows = self.table.rows(flat)
        sizes, starts = self.table.lengths[rows] - 1, self.table.starts[rows]
        mark = self.table.flat[starts]
        doc = np.repeat(np.arange(len(docs)), n)
        per_doc = np.bincount(doc, weights=sizes, minlength=len(docs)).astype(np.int64)
        ids = np.full(int(per_doc.sum()) + len(docs), Vocabulary.TEXT_END, np.int32)
        inner = ragged(np.cumsum(per_doc + 1) - per_doc - 1, per_doc)
        ids[inner] = self.table.flat[ragged(starts + 1, sizes)]
        logs = self.model.log_probs(ids, per_doc + 1)
        ends = np.cumsum(per_doc + 1) - 1
        word = np.add.reduceat(logs[inner], np.cumsum(sizes) - sizes) if len(rows) else np.zeros(0)
        known = mark >= 0
        uni = (self.counts[mark[known]] + 0.5) / self.total
        score = np.log10(self.weight * np.exp(logs[ends]) + (1 - self.weight) * self.end_p)
        score += np.bincount(doc[known], weights=np.log10(self.weight * np.exp(word[known]) + (1 - self.weight) * uni), minlength=len(docs))
        base = np.bincount(doc[known], weights=np.log10(uni), minlength=len(docs)) + np.log10(self.end_p)
        self.table.settle()
        tail = np.flatnonzero(~known)
        n_known = np.bincount(doc[known], minlength=len(docs)) + self.end_known
        return n, n_known, base, score, [flat[i] for i in tail], word[tail], np.bincount(doc[tail], minlength=len(docs))


_SCORERS: dict = {}


class Learned(NamedTuple):
    """Word counts (a table), ids and network; the commonest words (a table on the driver) and their least count; training texts, tokens and distinct tokens."""

    counts: DataFrame
    vocab: Vocabulary
    model: Model
    top: pa.Table
    cut: int
    n_train: int
    n: int
    v: int


def learn(train: DataFrame, path: str, sample_docs: int, sample_bytes: int, size: int, steps: int, train_share: float, frequent: int, joints: int = 2500, joint_least: float = 1000) -> Learned:
    """All that scoring needs, from the training rows (doc_id, text)."""
    counts = train.select("text").mapInArrow(_count_words(200_000), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = materialize(counts, "words")
    size_of = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int").alias("g")
    groups = sorted(((r.g, r.words, r.tokens, r.low) for r in counts.groupBy(size_of).agg(F.count("*").alias("words"), F.sum("c").alias("tokens"), F.min("c").alias("low")).collect()), reverse=True)
    n_train = train.count()
    n, v, cut, got = n_train + sum(g[2] for g in groups), (n_train > 0) + sum(g[1] for g in groups), 1 << 62, 0
    for _, words, _, low in groups:
        if (got := got + words) > frequent:
            break
        cut = low
    top = counts.where(F.col("c") >= cut).toArrow()
    pairs = counts.mapInArrow(_pair_counts(path), "key long, n double").groupBy("key").agg(F.sum("n").alias("n"))  # two a token of the public vocabulary at most
    common, ranks = commonest({r.key: r.n for r in pairs.collect()}, size), Vocabulary.tokenizer(path)[1]
    vocab = Vocabulary(path, common, ranks)
    known = id_keys(counts, vocab, size, n_train)
    joined = commonest_joints(*known[1:], size, vocab.base, joints, joint_least)
    if len(joined):
        vocab = Vocabulary(path, common, ranks, joined)
        known = id_keys(counts, vocab, max(size, vocab.size), n_train)
    size_of_text = F.coalesce(F.octet_length("text"), F.lit(0))
    n_bytes = train.agg(F.sum(size_of_text)).first()[0] or 0
    chance = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(1 << 30)) / float(1 << 30)
    start = min(sample_docs / max(1, n_train), sample_bytes / max(1, n_bytes))
    sample, held_bytes = [], 0
    for r in train.where((chance < start) & (size_of_text <= sample_bytes) & (size_of_text > 0)).select("text").toLocalIterator():
        if (held_bytes := held_bytes + len(r.text)) > 4 * sample_bytes:
            break
        sample.append(r.text.encode())
    vocab, model = fit(sample, path, size, steps, vocab, known)
    for k in range(ROUNDS if train_share else 0):
        train_on_share(train, vocab, model, train_share * (k + 1) / ROUNDS, above=train_share * k / ROUNDS)
    return Learned(counts, vocab, model, top, cut, n_train, n, v)


def score_documents(docs: DataFrame, modulus: int = 5, held: int = 1, path: str | None = None, sample_docs: int = 1500, sample_bytes: int = 6_000_000, size: int = 2500, steps: int = 700, train_share: float = 1.0, weight: float = 0.6, frequent: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are split at ASCII white space with A-Z lower-cased; each text ends with one end token. base_score is the unigram
    log10 probability from the word counts of all training documents (crc32 of the id modulo `modulus` is not `held`).
    score mixes, word by word, the attention model's probability (`weight`) with that unigram, both proper over words.
    Word counts, the model's ids, the joints of neighbouring ids (2,500, each met a thousand times at least) and its classes come from all training documents. The network's first weights come from a sample (expected sample_docs documents or
    sample_bytes, whichever is less, by hash of the id, each of at most sample_bytes; the driver holds four times that at most); from there it meets train_share of all
    training documents (by default every one), whole and once, in the tasks that read them.

    A null or empty text is the end token alone. Rows of a null id are training rows; repeated rows count as often as they stand; an empty
    table gives no rows; other columns are ignored. Counts of the `frequent` commonest words are broadcast; the others meet their counts in a join.
    """
    spark = ready(docs.sparkSession)
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    id_type = docs.schema[id_col].dataType.simpleString()
    d = require(docs, id_col, text_col).toDF("doc_id", "text").withColumn("held_out", remainder_is("doc_id", modulus, held))
    train = d.where(~F.col("held_out"))
    k = learn(train, path, sample_docs, sample_bytes, size, steps, train_share, frequent)
    counts, vocab, model, top, cut, n_train, n, v = k.counts, k.vocab, k.model, k.top, k.cut, k.n_train, k.n, k.v
    total = n + 0.5 * (v + 1)
    key = f"{docs.sparkSession.sparkContext.applicationId}-{id(model)}-{n}-{v}"
    shared = spark.sparkContext.broadcast((vocab, model, top.column("word").to_pylist(), top.column("c").to_numpy().astype(float), n_train, total, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _TABLES.clear()
            _SCORERS[key] = Scorer(*shared.value)
        scorer = _SCORERS[key]
        for b in batches:
            texts = byte_texts(b.column(2))
            for i, j in chunks(texts, 600_000):
                words, known, base, score, tail, logs, per = scorer.score(texts[i:j])
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).slice(i, j - i) for k in (0, 1, 3)), pa.array(words + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score), lists(tail, per, pa.binary()), lists(logs, per, pa.float64())],
                    names=["doc_id", "held_out", "row", "n_tokens", "known", "base", "part", "tail", "logs"],
                )

    scored = d.select("doc_id", "held_out", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(run, f"doc_id {id_type}, held_out boolean, row long, n_tokens long, known long, base double, part double, tail array<binary>, logs array<double>")
    scored = materialize(scored, "scored")
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "logs")).alias("w")).select("row", F.col("w.tail").alias("word"), F.col("w.logs").alias("lp"))
    c = F.coalesce("c", F.lit(0))
    uni = (c + 0.5) / F.lit(total)
    joined = tail.join(counts.where(F.col("c") < cut), "word", "left").select("row", (c > 0).cast("long").alias("k"), F.log10(uni).alias("b"), F.log10(F.lit(weight) * F.exp("lp") + F.lit(1 - weight) * uni).alias("s"))
    sums = joined.groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    out = scored.drop("tail", "logs").join(sums, "row", "left")
    add = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", add("known", "k").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), add("base", "b").alias("base_score"), add("part", "s").alias("score"))
