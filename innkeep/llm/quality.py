"""Quality classifier: naive Bayes support vectors over byte n-grams.

**Features.** Indicators of the byte 1- to 4-grams of the whole lower- and
upper-case text, hashed into ``2 ** BITS`` slots, plus indicators of how often
a word directly repeats the one before it (a repeated-word bigram, counted in
powers of two).  Nothing but the text is read for a score.

**Model.** Each indicator is scaled by its log-count ratio between the classes
(naive Bayes); a linear model with hinge loss is fitted to the scaled, length-
normalised vectors by dual coordinate descent, and averaged with the plain
ratios.  A logistic curve fitted on a part of the sample that the linear model
did not see turns the margin into the score.

**Sample.** Fitting uses at most ``max_rows`` labelled documents (the smallest
by a hash of the id, so the choice does not depend on partitions; the bound holds
for rows, also where many texts share an id); their
hashed features, not their texts, come to the driver.  Scoring reads every
whole text in place, without a shuffle.

Defined results: null or empty text has no n-gram and scores by the intercept;
rows without a label or an id are not learned from; a label given twice counts
once per distinct (id, label); without labels of both classes every score is 0.5; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.llm.common import texts

BITS = 18
ORDERS = (1, 2, 3, 4)
MAX_ROWS = 4000
PARTS = 32
THRESHOLD = 0.7
_scratch: dict = {}


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Distinct feature slots of one text, in no particular order."""
    data = text.encode("utf-8")
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    codes = []
    h = a + np.uint32(1)
    for n in ORDERS:
        if len(a) < n:
            break
        if n > 1:
            h = h[:-1] * np.uint32(257) + a[n - 1:] + np.uint32(1)
        codes.append((h * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - bits))
    words = data.split()
    repeats = sum(x == y for x, y in zip(words, words[1:]))
    codes.append((np.arange(repeats.bit_length(), dtype=np.uint32) * np.uint32(7919)
                  + np.uint32(104729)) & np.uint32((1 << bits) - 1))
    all_codes = np.concatenate(codes)
    stamp = _scratch.setdefault(bits, np.zeros(1 << bits, np.int64))
    at = np.arange(len(all_codes))
    stamp[all_codes] = at                       # the last writer of a slot stands for it
    return all_codes[stamp[all_codes] == at]


@dataclass
class Model:
    """``score = 1 / (1 + exp(-(slope * margin + shift)))``."""
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, slots: np.ndarray) -> float:
        return float(self.weights[slots].sum()) / math.sqrt(max(1, len(slots))) + self.bias

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(features(text or "")) + self.shift
        return 1.0 / (1.0 + math.exp(-min(40.0, max(-40.0, z))))


def _dual_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: float,
                  rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss: min ½|w|² + C Σ max(0, 1 - y w·x), bias as a constant feature."""
    w, bias = np.zeros(len(ratio)), 0.0
    values = [ratio[r] / math.sqrt(max(1, len(r))) for r in rows]
    diag = np.array([float(v @ v) + 1.0 for v in values])
    per_class = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1.0
            new = min(max(alpha[i] - g / diag[i], 0.0), per_class[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps (smoothed targets)."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, cost: float = 1.0, beta: float = 0.75,
        rounds: int = 30, seed: int = 7) -> Model:
    """Model from feature slots and 0/1 labels (order of the rows matters only through the seed)."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    size = 1 << bits
    if not len(rows) or abs(y.sum()) == len(y):
        return Model(np.zeros(size), 0.0, 1.0, 0.0)

    def linear(index: np.ndarray) -> tuple[np.ndarray, float]:
        counts = {}
        for sign in (1.0, -1.0):
            own = [rows[i] for i in index if y[i] == sign]
            c = np.bincount(np.concatenate(own), minlength=size) if own else np.zeros(size)
            counts[sign] = (c + 1.0) / (len(own) + 2.0)
        ratio = np.log(counts[1.0] / counts[-1.0])
        w, bias = _dual_descent([rows[i] for i in index], ratio, y[index], cost, rounds, seed)
        mean = np.abs(w).mean()
        return ratio * ((1 - beta) * mean + beta * w), bias * beta

    every = np.arange(len(rows))
    aside = every % 4 == 3
    if abs(y[~aside].sum()) == (~aside).sum() or abs(y[aside].sum()) == aside.sum():
        aside = np.zeros(len(rows), bool)
    half = Model(*linear(every[~aside]), 1.0, 0.0)
    test = every[aside] if aside.any() else every
    slope, shift = _logistic(np.array([half.margin(rows[i]) for i in test]), y[test])
    return Model(*linear(every), slope, shift)


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (the contract's folds)."""
    return F.crc32(id_col.cast("string")) % modulus


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 4, held_out: int = 2,
          max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold."""
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("_y"))
             .where(F.col("doc_id").isNotNull() & F.col("_y").isNotNull()
                    & (remainder(F.col("doc_id"), folds) != held_out))
             .distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(max_rows))

    @F.pandas_udf("binary")
    def slots(text: pd.Series) -> pd.Series:
        return text.map(lambda t: np.sort(features(t)).astype("<u4").tobytes())

    sample = (texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id")
              .select("doc_id", "_y", slots("text").alias("f")).dropDuplicates(["doc_id", "_y", "f"])
              .orderBy(F.xxhash64("doc_id"), "doc_id", "_y", F.md5("f")).limit(max_rows)
              .repartition(PARTS, "doc_id", "f").toLocalIterator())       # fetched in parts: small in the driver
    rows = sorted(((r.doc_id, r._y, bytes(r.f)) for r in sample))
    rng = np.random.default_rng(11)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    return fit([np.frombuffer(f, "<u4") for _, _, f in rows], np.array([y for _, y, _ in rows]))


def scorer(model: Model, docs: DataFrame):
    """Column function: text -> score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        m = shared.value
        return text.map(m.score).astype("float64")
    return score


def score_documents(docs: DataFrame, model: Model, folds: int = 4, held_out: int = 2,
                    threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; without an id it is in no fold
    (``held_out`` false) and is not learned from either."""
    t = texts(docs).withColumn("score", scorer(model, docs)(F.col("text")))
    aside = F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False))
    return t.select("doc_id", aside.alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the model does not reject, with all their columns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.where(scorer(model, docs)(text) >= threshold)
