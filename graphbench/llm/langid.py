"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import judged, ragged, ready, remainder_is, require, sampled_ids
from ._ngrams import hashed, windows

BITS = 13
#: Texts that the driver learns from at most, shared out evenly among the languages, and the least a language has.
SAMPLE_TEXTS, LEAST_TEXTS = 20_000, 20
#: Training sets of at most this many texts are spread out as a matrix (128 MB).
DENSE_ROWS = 4096
#: A text is unlike its language if its windows' mean log gain is under this part of the usual one, less SHORT / sqrt(bytes of letters).
CLEAR, SHORT = 0.25, 4.0
#: A-Z lowered, other ASCII letters and all bytes of other scripts kept, the rest of ASCII a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII = re.compile(rb"[a-z]")


def letters(text: bytes | None) -> bytes | None:
    """Words of letters between single spaces, lower case; None if the text has no letter."""
    if not text:
        return None
    flat = text.translate(_LETTERS)
    if not flat.isascii():
        if not _ASCII.search(flat) and not any(c.isalpha() for c in text.decode("utf-8", "replace")):
            return None
        if any(b >= 0xC3 for b in set(flat)):
            flat = flat.decode("utf-8", "replace").lower().encode()
    elif not _ASCII.search(flat):
        return None
    return b" " + b" ".join(flat.split()) + b" "


def features(flat: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): square roots of the shares of hashed 2- to 4-byte windows, of length one; only buckets that occur."""
    a = np.frombuffer(flat, np.uint8)
    f = np.zeros(1 << BITS, np.int64)
    for n in (2, 3, 4):
        c = windows(a, n)
        if len(c):
            f += np.bincount(hashed(c + np.uint32(n), BITS), minlength=1 << BITS)
    at = np.flatnonzero(f)
    return at.astype(np.uint16), np.sqrt(f[at] / max(1, f.sum())).astype(np.float32)


class Rows:
    """Sparse rows: the buckets and values of each text, one behind the other."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.sizes = np.fromiter((len(i) for i, _ in rows), np.int64, len(rows))
        self.at = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.uint16)
        self.values = np.concatenate([v for _, v in rows]) if rows else np.zeros(0, np.float32)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __len__(self) -> int:
        return len(self.sizes)

    def take(self, rows: np.ndarray) -> Rows:
        out, at = Rows([]), ragged(self.starts[rows], self.sizes[rows])
        out.sizes, out.at, out.values = self.sizes[rows], self.at[at], self.values[at]
        out.starts = np.cumsum(out.sizes) - out.sizes
        return out

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self), 1 << BITS), np.float32)
        out[np.repeat(np.arange(len(self)), self.sizes), self.at] = self.values
        return out

    def mean(self, power: int = 1) -> np.ndarray:
        return np.bincount(self.at, weights=self.values**power, minlength=1 << BITS) / max(1, len(self))

    def times(self, w: np.ndarray) -> np.ndarray:
        """The product with one weight vector."""
        return np.add.reduceat(np.append(self.values * w[self.at], 0), self.starts) * (self.sizes > 0) if len(self) else np.zeros(0)

    def back(self, g: np.ndarray) -> np.ndarray:
        """The product of the transpose with one number a row."""
        return np.bincount(self.at, weights=self.values * np.repeat(g, self.sizes), minlength=1 << BITS)


def train_svm(x: Rows, y: np.ndarray, rounds: int = 300, cost: float = 30.0) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, y in {-1, 1}, classes weighed alike; accelerated gradient steps."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    full = x.dense() if len(x) <= DENSE_ROWS else None  # small sets train faster as a matrix
    times = (lambda w: full @ w[:-1].astype(np.float32) + w[-1]) if full is not None else (lambda w: x.times(w[:-1]) + w[-1])
    back = (lambda g: np.append(full.T @ g.astype(np.float32), g.sum())) if full is not None else (lambda g: np.append(x.back(g), g.sum()))
    v = np.ones((1 << BITS) + 1)
    for _ in range(12):  # power steps: the largest curvature
        v = back(share * times(v))
        top = np.linalg.norm(v)
        v /= top
    rate = 1 / (1 + 2 * cost * top * 1.1)
    w = look = np.zeros((1 << BITS) + 1)
    for k in range(rounds):
        gap = np.maximum(0, 1 - y * times(look))
        new = look - rate * (look - 2 * cost * back(share * gap * y))
        w, look = new, new + k / (k + 3) * (new - w)
    return w.astype(np.float32)


def families(means: np.ndarray, count: int) -> list[list[int]]:
    """Languages in `count` groups: the two most alike groups merge first (average cosine); ties by the least numbers."""
    groups, sizes = [[i] for i in range(len(means))], np.ones(len(means))
    sim = means @ means.T
    np.fill_diagonal(sim, -np.inf)
    for _ in range(len(means) - count):
        i, j = divmod(int(np.argmax(sim)), len(means))
        sim[i] = (sizes[i] * sim[i] + sizes[j] * sim[j]) / (sizes[i] + sizes[j])
        sim[i, i] = -np.inf
        sim[:, i] = sim[i]
        sim[j], sim[:, j] = -np.inf, -np.inf
        groups[i], groups[j], sizes[i] = groups[i] + groups[j], [], sizes[i] + sizes[j]
    return sorted(sorted(g) for g in groups if g)


def log_gain(texts: Rows) -> np.ndarray:
    """Log of how much commoner each hashed window is in these texts than if all were equally common."""
    mean = texts.mean(2)
    return np.log(0.999 * mean * len(mean) / max(float(mean.sum()), 1e-9) + 0.001).astype(np.float32)


class Identifier:
    """The learned machines, as one weight matrix."""

    def __init__(self, x: Rows, langs: list[str], n_families: int | None = None) -> None:
        self.langs = sorted(set(langs))
        number = {v: i for i, v in enumerate(self.langs)}
        at = np.asarray([number[v] for v in langs], int)
        own = [x.take(np.flatnonzero(at == i)) for i in range(len(self.langs))]
        means = np.stack([r.mean() for r in own]) if own else np.zeros((0, 1 << BITS))
        means = means - means.mean(0) if own else means
        means /= np.linalg.norm(means, axis=1, keepdims=True) + 1e-9
        self.families = families(means, n_families or max(1, round(len(self.langs) ** 0.5))) if self.langs else []
        family_of = np.zeros(max(1, len(self.langs)), int)
        for k, g in enumerate(self.families):
            family_of[g] = k
        rows, self.family_rows, self.pairs = [], [], []
        for k in range(len(self.families) if len(self.families) > 1 else 0):
            self.family_rows.append(len(rows))
            rows.append(train_svm(x, np.where(family_of[at] == k, 1, -1)))
        for k, g in enumerate(self.families):
            for i, a in enumerate(g):
                for b in g[i + 1 :]:
                    use = np.flatnonzero((at == a) | (at == b))
                    self.pairs.append((k, a, b, len(rows)))
                    rows.append(train_svm(x.take(use), np.where(at[use] == a, 1, -1)))
        self.w = np.stack(rows).T if rows else np.zeros(((1 << BITS) + 1, 0), np.float32)
        self.likely = np.zeros((1 << BITS, len(self.langs)), np.float32)
        self.floor = np.full(len(self.langs), -np.inf)
        for i, r in enumerate(own):
            if len(r) > 1:
                half = r.take(np.arange(1, len(r), 2))
                half.values = half.values**2
                if (middle := float(np.median(half.times(log_gain(r.take(np.arange(0, len(r), 2))))))) > 0:
                    self.floor[i] = CLEAR * middle
            self.likely[:, i] = log_gain(r)

    def predict(self, x: np.ndarray, slack: np.ndarray | float = 0.0) -> tuple[list[str], np.ndarray]:
        """The language of each row and a score: the family's share times the mean share over its pairs.

        The machines only compare languages, so one always wins. The score is 0 where the text's windows are less common in
        the language found than its floor, a part of what is usual for texts of its sample that were left out of the counts.
        """
        if not self.langs:
            return ["und"] * len(x), np.zeros(len(x))
        squash = lambda m: 1 / (1 + np.exp(-4.0 * np.clip(m, -15, 15)))
        m = x @ self.w[:-1] + self.w[-1]
        fam = squash(m[:, self.family_rows]) if self.family_rows else np.ones((len(x), 1))
        chosen, wins = fam.argmax(axis=1), np.zeros((len(x), len(self.langs)))
        for _, a, b, r in self.pairs:
            p = squash(m[:, r])
            wins[:, a] += p
            wins[:, b] += 1 - p
        best, score = np.zeros(len(x), int), np.zeros(len(x))
        for k, g in enumerate(self.families):
            rows = np.flatnonzero(chosen == k)
            share = wins[np.ix_(rows, g)] / max(1, len(g) - 1) if len(g) > 1 else np.ones((len(rows), 1))
            best[rows] = np.asarray(g)[share.argmax(axis=1)]
            score[rows] = fam[rows, k] * share.max(axis=1)
        gain = np.einsum("ij,ij->i", x * x, self.likely.T[best])
        score[gain < self.floor[best] - slack] = 0
        return [self.langs[i] for i in best], np.round(np.clip(score, 0, 1), 6)


def learn(docs: DataFrame, per_lang: int, sample_bytes: int, n_families: int | None) -> Identifier:
    """Fit on at most per_lang ids of each language, by hash of the id; ids are chosen first, texts fetched after. A text that doesn't fit in what is left of sample_bytes is passed over.

    With more languages than SAMPLE_TEXTS / per_lang each has an even share of SAMPLE_TEXTS, LEAST_TEXTS at least; none is left out. Each text is kept
    as its sparse features, some 10 KB at most, so that the driver holds about 200 MB however many texts and languages there are.
    """
    known = docs.where("lang is not null and doc_id is not null")
    n_langs = known.select("lang").distinct().count()
    per_lang = min(per_lang, max(LEAST_TEXTS, SAMPLE_TEXTS // max(1, n_langs)))
    ids = sampled_ids(known, "doc_id", "lang", per_lang, 31).select(F.col("doc_id").alias("i"), F.col("lang").alias("l"))
    docs = docs.where(F.octet_length("text") <= sample_bytes)
    x, langs, held = [], [], {}
    for r in docs.join(F.broadcast(ids), (F.col("doc_id") == F.col("i")) & (F.col("lang") == F.col("l"))).orderBy("doc_id", "lang", "text").select("text", "lang").toLocalIterator():
        t = (r.text or "").encode()
        if held.get(r.lang, 0) + len(t) <= sample_bytes and (flat := letters(t)):
            held[r.lang] = held.get(r.lang, 0) + len(t)
            x.append(features(flat))
            langs.append(r.lang)
    return Identifier(Rows(x), langs, n_families)


def with_language(docs: DataFrame, keep: list[str], pred: str = "lang_pred", score: str = "score", modulus: int = 4, held: int = 2, per_lang: int = 500, sample_bytes: int = 8_000_000, n_families: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The columns `keep` of every row with its language and score under the names given; see identify."""
    spark = ready(docs.sparkSession)
    train = require(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang").where(~remainder_is("doc_id", modulus, held))
    model = spark.sparkContext.broadcast(learn(train, per_lang, sample_bytes, n_families))

    def make():
        m = model.value

        def judge(texts: list) -> list[pa.Array]:
            found, scores = ["und"] * len(texts), np.zeros(len(texts))
            for at in range(0, len(texts), 256):
                rows, x, sizes = [], [], []
                for i in range(at, min(at + 256, len(texts))):
                    if flat := letters(texts[i]):
                        rows.append(i)
                        x.append(features(flat))
                        sizes.append(len(flat))
                if rows:
                    langs, s = m.predict(Rows(x).dense(), SHORT / np.sqrt(sizes))
                    scores[rows] = s
                    for i, v in zip(rows, langs, strict=True):
                        found[i] = v
            return [pa.array(found, pa.string()), pa.array(scores)]

        return judge

    return judged(docs, text_col, make, f"`{pred}` string, `{score}` double", keep)


def identify(docs: DataFrame, modulus: int = 4, held: int = 2, per_lang: int = 500, sample_bytes: int = 8_000_000, n_families: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score (0 to 1).

    Learns from rows with a language whose crc32 of the id modulo `modulus` is not `held`, at most per_lang ids (fewer where there are many languages, see learn)
    and sample_bytes a language. Every language with a text is learned.
    Only the text is used for a prediction. A null, empty or letterless text is `und` with score 0, as is every text where nothing could be learned.
    A text unlike all that was learned (gibberish, another language) keeps the nearest language with score 0.
    Ties go to the language that sorts first. Repeated rows are judged each; an empty table gives no rows; other columns are ignored. No shuffle of texts.
    """
    out = with_language(docs, [id_col], "lang_pred", "score", modulus, held, per_lang, sample_bytes, n_families, id_col, text_col, lang_col)
    return out.select(F.col(id_col).alias("doc_id"), remainder_is(id_col, modulus, held).alias("held_out"), "lang_pred", "score")
