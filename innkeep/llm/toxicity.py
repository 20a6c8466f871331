"""Toxicity: bidirectional gated recurrent network with attention pooling, in numpy.

**Inputs.** A text's words (lower-cased letter and digit runs) are seen twice:
as an entry of a vocabulary learned from the sample (others share one entry),
and through the characters: the element-wise maximum over the vectors of the
word's hashed character 3- and 4-grams, word ends marked.

**Network.** Per window of ``WINDOW`` words a GRU reads forward and another one
backward; attention pools their states; a linear unit gives the window's logit.
Windows overlap (``STRIDE`` < ``WINDOW``) and cover the whole text; the
document's score is the logistic of its largest window.

**Training.** Only document labels exist, so each step trains the windows of a
document with the largest logits (multiple-instance learning) with a
class-weighted logistic loss, by Adam, on at most ``max_rows`` labelled
documents (smallest by a hash of the id) outside the held-out fold.  The model
is small (under 1 MB) and is broadcast; scoring has no shuffle.

Defined results: null or empty text is one window without words; rows without
label or id are not learned from; without labels of both classes every score is
0.5; repeated rows are scored each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.llm.common import texts
from innkeep.llm.quality import PARTS, remainder

WINDOW, STRIDE = 48, 36
LEAST_SHOWN, MOST_EPOCHS = 12_000, 60
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 12, 8, 12, 12
CHAR_SLOTS = 1 << 14
VOCABULARY = 4096
MIN_DOCS = 4
MAX_ROWS = 6000
EPOCHS = 12
REFRESH = 3                        # epochs between choices of the training windows
THRESHOLD = 0.5
CHUNK = 2048                       # windows in one pass through the network
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def char_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character 3- and 4-grams of the words: (slots, start of each word)."""
    coded = [b"^" + w.encode("utf-8") + b"$" for w in words]
    sizes = np.array([max(3, len(c)) for c in coded])
    a = np.frombuffer(b"".join([c.ljust(3, b"$") for c in coded]) + b"\0\0\0", np.uint8).astype(np.uint32)
    n = int(sizes.sum())
    three = a[:n] | a[1:n + 1] << np.uint32(8) | a[2:n + 2] << np.uint32(16)
    four = three | a[3:n + 3] << np.uint32(24)
    ends = sizes.cumsum()
    left = np.repeat(ends, sizes) - np.arange(n)           # bytes up to the word's end
    slot3 = (three * np.uint32(2654435761)) >> np.uint32(18)
    slot4 = (four * np.uint32(2246822519) + np.uint32(97)) >> np.uint32(18)
    both = np.stack([slot3, slot4], axis=1)
    keep = np.stack([left >= 3, left >= 4], axis=1)
    counts = np.add.reduceat(keep.sum(axis=1), ends - sizes)
    return both[keep].astype(np.int64), np.concatenate([[0], counts.cumsum()[:-1]]).astype(np.int64)


def windows(n: int, size: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """Starts of the windows that cover ``n`` words."""
    if n <= size:
        return [0]
    return list(range(0, n - size, stride)) + [n - size]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, forward and backward pass."""

    def __init__(self, vocabulary: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.index = {w: i + 1 for i, w in enumerate(vocabulary)}
        d = WORD_DIM + CHAR_DIM

        def normal(*shape, scale=None):
            return (rng.standard_normal(shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)
        self.p = {"word": normal(len(vocabulary) + 1, WORD_DIM, scale=0.3), "char": normal(CHAR_SLOTS, CHAR_DIM, scale=0.3),
                  "att": normal(2 * HIDDEN, ATTENTION), "attv": normal(ATTENTION), "out": normal(2 * HIDDEN),
                  "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": normal(d, 3 * HIDDEN), f"u{side}": normal(HIDDEN, 3 * HIDDEN),
                       f"b{side}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, words: list[str]) -> tuple:
        """Ids, character slots and input vectors of distinct words."""
        ids = np.array([self.index.get(w, 0) for w in words])
        slots, starts = char_slots(words)
        char = np.maximum.reduceat(self.p["char"][slots], starts, axis=0)
        return ids, slots, starts, np.concatenate([self.p["word"][ids], char], axis=1)

    def _gru(self, side: str, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: bool):
        h_size, steps = HIDDEN, idx.shape[1]
        gx, u = x @ self.p[f"w{side}"] + self.p[f"b{side}"], self.p[f"u{side}"]
        h = np.zeros((len(idx), h_size), np.float32)
        states = np.zeros((steps, len(idx), h_size), np.float32)
        trace = []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            g, gh = gx[idx[:, t]], h @ u
            zr = _sigmoid(g[:, :2 * h_size] + gh[:, :2 * h_size])
            z, r = zr[:, :h_size], zr[:, h_size:]
            n = np.tanh(g[:, 2 * h_size:] + r * gh[:, 2 * h_size:])
            m = mask[:, t:t + 1]
            new = h + m * (1 - z) * (n - h)
            if keep:
                trace.append((t, h, z, r, n, gh[:, 2 * h_size:]))
            h = new
            states[t] = h
        return states, trace

    def forward(self, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logit of each window; ``idx`` (windows x steps) points into ``x``."""
        fs, ft = self._gru("f", x, idx, mask, keep)
        bs, bt = self._gru("b", x, idx, mask, keep)
        h = np.concatenate([fs, bs], axis=2)                       # steps x windows x 2H
        e = np.tanh(h @ self.p["att"])
        s = np.where(mask.T > 0, e @ self.p["attv"], -1e9)
        a = np.exp(s - s.max(axis=0))
        a /= a.sum(axis=0)
        c = np.einsum("tb,tbh->bh", a, h)
        return c @ self.p["out"] + self.p["bias"][0], (h, e, a, c, ft, bt)

    def backward(self, d_logit: np.ndarray, words: tuple, idx: np.ndarray, mask: np.ndarray, saved) -> dict:
        h, e, a, c, ft, bt = saved
        ids, slots, starts, x = words
        g = {"out": c.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        dc = d_logit[:, None] * self.p["out"]
        da = np.einsum("bh,tbh->tb", dc, h)
        ds = a * (da - (a * da).sum(axis=0))
        de = ds[:, :, None] * self.p["attv"] * (1 - e * e)
        g["attv"] = np.einsum("tb,tba->a", ds, e)
        g["att"] = np.einsum("tbh,tba->ha", h, de)
        dh = a[:, :, None] * dc + de @ self.p["att"].T
        dx = np.zeros_like(x)
        for side, trace, part in (("f", ft, slice(0, HIDDEN)), ("b", bt, slice(HIDDEN, 2 * HIDDEN))):
            u, w = self.p[f"u{side}"], self.p[f"w{side}"]
            du, dgx = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), np.float32)
            carry = np.zeros((len(idx), HIDDEN), np.float32)
            for t, before, z, r, n, ghn in reversed(trace):
                d = dh[t][:, part] + carry
                m = mask[:, t:t + 1]
                dn = d * m * (1 - z) * (1 - n * n)
                dz = -d * m * (n - before) * z * (1 - z)
                dr = dn * ghn * r * (1 - r)
                dgh = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(dgx, idx[:, t], np.concatenate([dz, dr, dn], axis=1))
                du += before.T @ dgh
                carry = d * (1 - m * (1 - z)) + dgh @ u.T
            g[f"u{side}"], g[f"b{side}"], g[f"w{side}"] = du, dgx.sum(axis=0), x.T @ dgx
            dx += dgx @ w.T
        word = np.zeros_like(self.p["word"])
        np.add.at(word, ids, dx[:, :WORD_DIM])
        char = np.zeros_like(self.p["char"])
        values = self.p["char"][slots]
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(slots))))
        best = (values == x[owner, WORD_DIM:]).astype(np.float32)
        best /= np.add.reduceat(best, starts, axis=0)[owner]       # equal maxima share the gradient
        np.add.at(char, slots, best * dx[owner, WORD_DIM:])
        return g | {"word": word, "char": char}

    def logits(self, docs: list[list[str]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Logits of all windows of the documents, with (document, start) of each."""
        places = [(d, s) for d, words in enumerate(docs) for s in windows(len(words))]
        out = np.zeros(len(places), np.float32)
        for at in range(0, len(places), CHUNK):
            part = places[at:at + CHUNK]
            words, idx, mask = self.batch(docs, part)
            out[at:at + CHUNK], _ = self.forward(words[3], idx, mask)
        return out, places

    def batch(self, docs: list[list[str]], places: list[tuple[int, int]]):
        """Distinct words, indices and mask of some windows (padded to one length)."""
        cut = [docs[d][s:s + WINDOW] for d, s in places]
        steps = max(1, max(map(len, cut)))
        number: dict[str, int] = {"": 0}
        sizes = np.array([len(c) for c in cut])
        flat = np.array([number.setdefault(w, len(number)) for c in cut for w in c], np.int64)
        mask = np.arange(steps)[None, :] < sizes[:, None]
        idx = np.zeros((len(cut), steps), np.int64)
        idx[mask] = flat
        return self.inputs(list(number)), idx, mask.astype(np.float32)

    def score(self, raw: list[str | None]) -> np.ndarray:
        """Scores of whole texts."""
        docs = [words_of(t) for t in raw]
        logit, places = self.logits(docs)
        best = np.full(len(docs), -np.inf)
        np.maximum.at(best, np.array([d for d, _ in places], np.int64), logit)
        return 1.0 / (1.0 + np.exp(-np.clip(best.astype(float), -40, 40)))


class Constant:
    """The model without labels of both classes."""

    def score(self, raw: list) -> np.ndarray:
        return np.full(len(raw), 0.5)


def fit(raw: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5, docs_per_step: int = 64,
        top: int = 2, rate: float = 0.01, least_shown: int = LEAST_SHOWN, most_epochs: int = MOST_EPOCHS
        ) -> Network | Constant:
    """Train on texts with 0/1 labels: ``epochs`` rounds, more on a small sample until
    ``least_shown`` documents were shown in all, at most ``most_epochs``."""
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Constant()
    empty = 1 + len(y) // 50                                       # a text without words is clean
    y = np.concatenate([y, np.zeros(empty, np.float32)])
    docs = [words_of(t) for t in raw] + [[]] * empty
    seen = Counter(w for d in docs for w in set(d))
    common = sorted((w for w, n in seen.items() if n >= MIN_DOCS), key=lambda w: (-seen[w], w))[:VOCABULARY]
    net = Network(common, seed)
    rng = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    var = {k: np.zeros_like(v) for k, v in net.p.items()}
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) ** 0.5
    step, picked = 0, {}
    epochs = max(epochs, min(most_epochs, least_shown // len(y)))
    total = epochs * -(-len(y) // docs_per_step)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), docs_per_step):
            some = order[at:at + docs_per_step]
            part = [docs[i] for i in some]
            if epoch < REFRESH or epoch % REFRESH == 0:
                logit, places = net.logits(part)
                logit = logit + rng.standard_normal(len(logit)) * (2.0 if epoch < 2 else 0.0)   # explore at first
                owner = np.array([d for d, _ in places])
                rank = np.lexsort((-logit, owner))
                first = np.searchsorted(owner[rank], np.arange(len(part)))
                nth = np.arange(len(rank)) - first[owner[rank]]
                for i in some:
                    picked[i] = []
                for i in rank[nth < top]:
                    picked[some[places[i][0]]].append(places[i][1])
            chosen = [(d, start) for d, i in enumerate(some) for start in picked[i]]
            words, idx, mask = net.batch(part, chosen)
            z, saved = net.forward(words[3], idx, mask, keep=True)
            d_of = np.array([d for d, _ in chosen])
            e = np.exp(2 * (z - z.max()))
            share = e / np.bincount(d_of, e, len(part))[d_of]      # smooth maximum over the picked windows
            value = np.bincount(d_of, share * z, len(part))
            err = (_sigmoid(value) - y[some]) * weight[some] / len(some)
            grads = net.backward((err[d_of] * share).astype(np.float32), words, idx, mask, saved)
            step += 1
            lr = rate * min(1.0, step / 20) * (1 - 0.9 * step / total)
            norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
            for k, v in grads.items():
                v = v * min(1.0, 5.0 / (norm + 1e-9))
                mean[k] += 0.1 * (v - mean[k])
                var[k] += 0.01 * (v * v - var[k])
                net.p[k] -= (lr * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(var[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 5, held_out: int = 0,
          max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text"):
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold."""
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("_y"))
             .where(F.col("doc_id").isNotNull() & F.col("_y").isNotNull()
                    & (remainder(F.col("doc_id"), folds) != held_out))
             .distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(max_rows))
    sample = (texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id").select("doc_id", "_y", "text")
              .dropDuplicates(["doc_id", "_y", "text"])
              .orderBy(F.xxhash64("doc_id"), "doc_id", "_y", F.md5("text")).limit(max_rows)
              .repartition(PARTS, "doc_id", "text").toLocalIterator())    # fetched in parts: small in the driver
    rows = sorted((zlib.crc32(str(r.doc_id).encode()), r.doc_id, r._y, r.text) for r in sample)
    return fit([r[3] for r in rows], np.array([r[2] for r in rows]))


def scorer(model, docs: DataFrame):
    """Column function: text -> score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        def parts() -> Iterator[list[str]]:
            held, size = [], 0
            for t in column:
                held.append(t)
                size += len(t or "")
                if size > 500_000:
                    yield held
                    held, size = [], 0
            if held:
                yield held
        found = [shared.value.score(p) for p in parts()]
        return pd.Series(np.concatenate(found) if found else np.zeros(0))
    return score


def score_documents(docs: DataFrame, model, folds: int = 5, held_out: int = 0,
                    threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; without an id it is in no fold
    (``held_out`` false) and is not learned from either."""
    t = texts(docs).withColumn("score", scorer(model, docs)(F.col("text")))
    aside = F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False))
    return t.select("doc_id", aside.alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"))
