"""Quality by positive-unlabelled learning.

Trusted positives and unlabelled text train a small network that minimises the
non-negative unbiased risk: where the estimated risk on negatives goes below
zero the step goes the other way. The class prior is estimated from the data,
as the least ratio of unlabelled to positive mass over regions that a
positive-against-unlabelled classifier ranks highest.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import small_batches, text_of

#: Training rows at most, the first by hash of their id: trusted positives and unlabelled documents.
MAX_POSITIVE, MAX_UNLABELLED = 5_000, 10_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 16, 40, 256, 5e-3, 1e-4, 11
#: How far under zero the estimated risk on negatives may go before the step turns back.
SLACK = 0.05
#: Held-out remainder: crc32 of the id as text, modulo 5.
FOLDS = 5
THRESHOLD = 0.3

FEATURES = (
    "log_chars", "log_words", "mean_word", "sd_word", "upper", "digits", "punctuation", "symbols", "spaces", "distinct_words", "top_word", "same_next",
    "distinct_pairs", "log_lines", "repeated_lines", "line_words", "word_ends", "one_letter", "entropy", "compression", "shouting", "bars",
)

_KIND = np.zeros(256, np.int64)
for _c in range(256):
    _KIND[_c] = 0 if _c >= 128 or chr(_c).isalpha() and chr(_c).islower() else 1 if chr(_c).isupper() else 2 if chr(_c).isdigit() else 3 if chr(_c) in ".,;:!?'\"()-" else 4 if chr(_c).isspace() else 5


def features(text: str) -> np.ndarray:
    """Numbers that describe the whole text; all zero for the empty one."""
    out = np.zeros(len(FEATURES))
    words = text.split()
    if not words:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=6) / len(raw)
    n = len(words)
    sizes = np.fromiter(map(len, words), np.float64, n)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    same = sum(map(str.__eq__, words, words[1:]))
    share = counts[counts > 0] / len(raw)
    ends = sum(1 for w in words if not w[-1].isalnum())
    out[:] = (
        np.log1p(len(text)), np.log1p(n), min(sizes.mean(), 40), min(sizes.std(), 40), kinds[1], kinds[2], kinds[3], kinds[5], kinds[4], len(seen) / n, seen.most_common(1)[0][1] / n, same / n,
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), ends / n, sum(1 for w in words if len(w) == 1) / n,
        -(share * np.log2(share)).sum(), len(zlib.compress(raw, 1)) / len(raw), counts[33] / n, counts[124] / n,
    )
    return out


@dataclass(frozen=True)
class Network:
    """Standardised features, one hidden layer, a log-odds output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return 1 / (1 + np.exp(-np.clip(np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2, -30, 30)))


def _train(p: np.ndarray, u: np.ndarray, prior: float | None, epochs: int, seed: int) -> list[np.ndarray]:
    """Adam on the non-negative risk with logistic loss; without a prior, on the plain positive-against-unlabelled loss."""
    rng = np.random.default_rng(seed)
    d = p.shape[1]
    weights = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    steps = max(1, -(-len(u) // (2 * BATCH)))
    for _ in range(epochs * steps):
        xp, xu = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), 2 * BATCH)]
        x = np.concatenate([xp, xu])
        h = np.tanh(x @ weights[0] + weights[1])
        g = np.clip(h @ weights[2] + weights[3][0], -30, 30)
        s = 1 / (1 + np.exp(-g))
        gp, sp, su = g[:BATCH], s[:BATCH], s[BATCH:]
        if prior is None:
            dg = np.concatenate([(sp - 1) / BATCH, su / len(su)])
        else:
            negative = np.logaddexp(0, g[BATCH:]).mean() - prior * np.logaddexp(0, gp).mean()
            back = np.concatenate([-prior * sp / BATCH, su / len(su)])
            forward = np.concatenate([prior * (sp - 1) / BATCH, np.zeros(len(su))])
            dg = forward + back if negative >= -SLACK else -back
        dh = np.outer(dg, weights[2]) * (1 - h * h)
        grads = [x.T @ dh + DECAY * weights[0], dh.sum(0), h.T @ dg + DECAY * weights[2], np.array([dg.sum()])]
        t += 1
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad**2
            weights[i] = weights[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return weights


def _log_odds(x: np.ndarray, w: list[np.ndarray]) -> np.ndarray:
    return np.tanh(x @ w[0] + w[1]) @ w[2] + w[3][0]


def estimate_prior(p: np.ndarray, u: np.ndarray, seed: int = SEED) -> float:
    """Share of positives among the unlabelled: the least U(A)/P(A) over regions A = {rank at least t} that hold 30 to 95 % of positives, on the half not trained on."""
    if len(p) < 4 or len(u) < 4:
        return 0.5
    w = _train(p[::2], u[::2], None, max(4, EPOCHS // 4), seed)
    sp, su = np.sort(_log_odds(p[1::2], w)), _log_odds(u[1::2], w)
    ratios = []
    for q in np.linspace(0.05, 0.7, 40):
        t = np.quantile(sp, q)
        a, b = (su >= t).mean(), max((sp >= t).mean(), 1e-9)
        error = np.hypot(np.sqrt(a * (1 - a) / len(su)) / b, a / b**2 * np.sqrt(b * (1 - b) / len(sp)))
        ratios.append(a / b + error)  # the least of noisy ratios would be too low
    return float(np.clip(min(ratios), 0.05, 0.98))


def fit_network(p: np.ndarray, u: np.ndarray, prior: float | None = None, seed: int = SEED) -> Network:
    both = np.concatenate([p, u])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (p, u))
    prior = estimate_prior(p, u, seed) if prior is None else prior
    w = _train(p, u, prior, EPOCHS, seed)
    return Network(mean, scale, w[0], w[1], w[2], float(w[3][0]), prior)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py()).tolist() for t in batch.column(1)], pa.list_(pa.float64()))], names=["id", "x"])


def _sample(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).join(F.broadcast(ids), "id")
    found = rows.mapInArrow(_measure, "id long, x array<double>").collect()  # bounded by the sample
    found.sort(key=lambda r: (r["id"], r["x"]))
    return np.array([r["x"] for r in found], np.float64).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Network:
    """A network from rows whose remainder is not 0: positives that ``labels`` marks 1, and documents without regard to labels. Other labels are not read."""
    order = [F.xxhash64("id"), F.col("id")]
    trusted = labels.filter(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("id")).filter(remainder(F.col("id")) != 0).distinct()
    web = docs.select(F.col(id_col).cast("long").alias("id")).filter(remainder(F.col("id")) != 0).distinct()
    p = _sample(docs, trusted.orderBy(*order).limit(max_positive), id_col, text_col)
    u = _sample(docs, web.orderBy(*order).limit(max_unlabelled), id_col, text_col)
    if len(p) == 0 or len(u) == 0:  # nothing to learn from: every document is as likely as not
        d = len(FEATURES)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 0.5)
    return fit_network(p, u)


def _score(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.score(x))], names=["id", "score"])

    return run


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: id, ``held_out`` (its remainder is 0), ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    A null text is empty and gets the empty text's score; a null id is not held out. Only id and text are read. An empty table gives no rows.
    """
    out = small_batches(docs).select(F.col(id_col).alias("id"), text_of(text_col)).mapInArrow(_score(network), T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())]))
    held = F.coalesce(remainder(F.col("id")) == 0, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
