"""Toxicity by a classifier chain.

Categories come in a fixed order. Each has a logistic model over the words and
word beginnings of a document and the probabilities of the categories before
it; in training those probabilities are out of fold, so a later model sees
earlier ones as uncertain as they will be on new documents. The last category
decides. Where labels know one category only, the ones before it are kinds of
its positives: clusters of the training rows by the features that they share.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import small_batches, text_of, written

#: Training rows at most: of each value of the last category, the first by hash of their id.
MAX_POSITIVE, MAX_NEGATIVE = 3_000, 6_000
#: Features in the models at most, the least likelihood-ratio statistic and documents of one.
VOCABULARY, MIN_STATISTIC, MIN_DOCS = 512, 20.0, 3
#: Lengths of word beginnings, so that inflected and compounded forms of a word share features.
BEGINNINGS = (4, 5, 6)
FOLDS, RIDGE, STEPS = 5, 0.03, 25
THRESHOLD = 0.5
#: Rounds of clustering, and words whose features a worker remembers.
ROUNDS, MEMO = 25, 200_000


def words(text: str) -> set[str]:
    """Distinct words in lower case: runs of letters, digits and underscores."""
    return set(re.findall(r"\w+", text.lower()))


def parts(word: str) -> list[str]:
    """The features of a word: itself (after "="), and its beginnings (before "*") where it is longer than they are."""
    return ["=" + word, *[word[:n] + "*" for n in BEGINNINGS if len(word) > n]]


class Hits(dict):
    """Numbers of a word's features that are in the vocabulary, remembered."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = tuple(self.vocabulary[f] for f in parts(word) if f in self.vocabulary)
        return found

    def of(self, text: str) -> set[int]:
        return {n for w in words(text) for n in self[w]}


@dataclass(frozen=True)
class Chain:
    """Fitted models: ``weights[k]`` has a row for each word, one for each earlier category, and the intercept."""

    categories: tuple[str, ...]
    vocabulary: dict[str, int]
    weights: tuple[np.ndarray, ...]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        found = np.empty((len(x), 0))
        for w in self.weights:
            found = np.column_stack([found, _sigmoid(np.column_stack([x, found, np.ones(len(x))]) @ w)])
        return found

    def score(self, text: str) -> np.ndarray:
        x = np.zeros((1, len(self.vocabulary)))
        x[0, sorted(Hits(self.vocabulary).of(text))] = 1
        return self.probabilities(x)[0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each row counted ``times``; the last column is the intercept."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-3
    for _ in range(STEPS):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (times * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(ridge), x.T @ (times * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_chain(x: np.ndarray, y: np.ndarray, folds: np.ndarray, categories: Sequence[str], vocabulary: dict[str, int]) -> Chain:
    """Models of the categories (columns of ``y``), each with out-of-fold probabilities of those before it.

    Rows that agree in features, categories and fold are one row that counts as often: most clean rows hold no feature at all.
    """
    _, first, times = np.unique(np.column_stack([np.packbits(x > 0, axis=1) if x.shape[1] else np.zeros((len(x), 1)), y, folds]), axis=0, return_index=True, return_counts=True)
    x, y, folds, times = x[first], y[first], folds[first], times.astype(np.float64)
    earlier, weights = np.empty((len(x), 0)), []
    for k in range(y.shape[1]):
        full = np.column_stack([x, earlier, np.ones(len(x))])
        weights.append(_logistic(full, y[:, k], times))
        if k + 1 == y.shape[1]:
            break
        out = np.empty(len(x))
        for f in range(FOLDS):
            inside = folds == f
            if inside.any():
                out[inside] = _sigmoid(full[inside] @ _logistic(full[~inside], y[~inside, k], times[~inside])) if (~inside).any() else np.average(y[:, k], weights=times)
        earlier = np.column_stack([earlier, out])
    return Chain(tuple(categories), vocabulary, tuple(weights))


def kinds_of(x: np.ndarray, wanted: int) -> np.ndarray:
    """For each row its kind, 0 to ``wanted`` - 1 by descending size: spherical k-means on features weighted by rarity, from rows chosen farthest apart; ties go to the first.

    Rows without a feature are of no kind (-1).
    """
    weight = np.log((len(x) + 1) / (x.sum(0) + 1)) if x.size else np.zeros(x.shape[1])
    z = x * np.maximum(weight, 0.05)
    length = np.sqrt((z**2).sum(1))
    used = length > 0
    z = z[used] / length[used, None]
    kind = np.full(len(x), -1)
    if not len(z):
        return kind
    centres = z[[int(np.argmax(z @ z.mean(0)))]]
    while len(centres) < min(wanted, len(z)):
        near = (z @ centres.T).max(1)
        centres = np.vstack([centres, z[int(np.argmin(near))]])
    own = np.full(len(z), -1)
    for _ in range(ROUNDS):
        now = (z @ centres.T).argmax(1)
        if (now == own).all():
            break
        own = now
        for k in range(len(centres)):
            if (own == k).any():
                mean = z[own == k].mean(0)
                centres[k] = mean / max(np.sqrt((mean**2).sum()), 1e-12)
    sizes = np.bincount(own, minlength=wanted)
    place = np.empty(wanted, np.int64)
    place[np.lexsort((np.arange(wanted), -sizes))] = np.arange(wanted)
    kind[used] = place[own]
    return kind


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task's texts: in how many positive and other ones each feature stands. A task holds a part of the bounded sample."""
    tally: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tally[y].update({f for w in words(text.as_py()) for f in parts(w)})
    found = list(tally[0].keys() | tally[1].keys())
    for at in range(0, len(found), 50_000):
        some = found[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *[pa.array([tally[y][f] for f in some], pa.int64()) for y in (1, 0)]], names=["feature", "a", "b"])


def _present(vocabulary: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(vocabulary)
        for batch in batches:
            found = [sorted(hits.of(t.as_py())) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "at"])

    return run


def fit(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str], kinds: int = 0, id_col: str = "doc_id", text_col: str = "text",
    max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE,
) -> Chain:
    """A chain for the 0/1 columns ``categories`` of ``labels``, in that order, fitted on a bounded sample of labelled rows.

    ``kinds`` more categories, kind_1 and so on, come before the last one: clusters of its positive
    training rows, largest first. The sample's texts are written once; all else reads only them. Rows with a null
    id or label are left out, copies of a text count once; with no labelled rows, or one value only, nothing is ever rejected.
    """
    known = labels.select(F.col(id_col).cast("long").alias("__id"), *[F.col(c).cast("int").alias(f"__y{i}") for i, c in enumerate(categories)]).na.drop()
    n_read, names = len(categories), [*categories[:-1], *[f"kind_{i + 1}" for i in range(kinds)], categories[-1]]
    y_last = F.col(f"__y{n_read - 1}")
    order = [F.xxhash64("__id"), F.col("__id")]
    sample = known.filter(y_last == 1).orderBy(*order).limit(max_positive).union(known.filter(y_last == 0).orderBy(*order).limit(max_negative))
    found = small_batches(docs).select(F.col(id_col).cast("long").alias("__id"), text_of(text_col).alias("__text")).join(F.broadcast(sample), "__id")  # at most max_positive + max_negative rows
    ys = [f"__y{i}" for i in range(n_read)]
    # copies would make a text's rare words look telling: of equal texts the least id counts
    texts = written(found, "toxicity-sample").groupBy("__text").agg(F.min(F.struct("__id", *ys)).alias("__row")).select("__row.*", "__text")
    shape = ", ".join(["__id long", *[f"{y} int" for y in ys]])
    n = {r["y"]: r["count"] for r in texts.groupBy(y_last.alias("y")).count().collect()}
    if not n.get(0) or not n.get(1):
        return Chain(tuple(names), {}, tuple(np.append(np.zeros(k), -40.0) for k in range(len(names))))
    counts = texts.select(y_last, "__text").mapInArrow(_counted, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b, p, q = F.col("a"), F.col("b"), F.lit(n[1] / (n[0] + n[1])), F.lit(n[0] / (n[0] + n[1]))

    def part(o, e):
        return F.when(o > 0, o * F.ln(o / (e * (a + b)))).otherwise(0.0)

    counts = counts.withColumn("g", 2 * (part(a, p) + part(b, q))).filter((a + b >= MIN_DOCS) & (F.col("g") >= MIN_STATISTIC))
    chosen = counts.orderBy(F.desc("g"), "feature").limit(VOCABULARY).collect()
    vocabulary = {r["feature"]: i for i, r in enumerate(chosen)}
    rows = texts.mapInArrow(_present(vocabulary), f"{shape}, at array<int>").collect()  # bounded by the sample
    rows.sort(key=lambda r: (r["__id"], r["at"]))
    x = np.zeros((len(rows), len(vocabulary)))
    for i, r in enumerate(rows):
        x[i, r["at"]] = 1
    y = np.array([[r[f"__y{k}"] for k in range(n_read)] for r in rows], np.float64)
    if kinds:
        positive = y[:, -1] == 1
        towards = np.array([r["a"] / n[1] > r["b"] / n[0] for r in chosen], bool)  # features that speak for the category
        of = np.full(len(rows), -1)
        of[positive] = kinds_of(x[positive][:, towards], kinds)
        y = np.column_stack([y[:, :-1], *[(of == k).astype(np.float64) for k in range(kinds)], y[:, -1]])
    folds = np.array([r["__id"] * 2654435761 % 2**32 * FOLDS // 2**32 for r in rows])
    return fit_chain(x, y, folds, names, vocabulary)


def _matrix(hits: Hits, texts: Sequence) -> np.ndarray:
    x = np.zeros((len(texts), len(hits.vocabulary)))
    for i, t in enumerate(texts):
        if t.is_valid and (found := hits.of(t.as_py())):
            x[i, list(found)] = 1
    return x


def _score(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(chain.vocabulary)
        for batch in batches:
            found = chain.probabilities(_matrix(hits, batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, k]) for k in range(found.shape[1])]], names=["__row", *[f"__p{k}" for k in range(found.shape[1])]])

    return run


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: id, ``p_<category>`` for each category, and ``toxic`` (the last probability is at least ``threshold``).

    A null text is empty; whole texts count, however long; null and repeated ids stay as they are; an empty table gives no rows. Other columns are ignored.
    """
    n = len(chain.categories)
    out = small_batches(docs).select(F.col(id_col), text_of(text_col)).mapInArrow(_score(chain), T.StructType([T.StructField("__row", docs.schema[id_col].dataType), *[T.StructField(f"__p{k}", T.DoubleType()) for k in range(n)]]))
    return out.select(F.col("__row").alias(id_col), *[F.col(f"__p{k}").alias(f"p_{c}") for k, c in enumerate(chain.categories)], (F.col(f"__p{n - 1}") >= threshold).alias("toxic"))


def keep_clean(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, with all their columns as they were, whatever their names.

    A null text is empty and judged as such; a probability right at ``threshold`` rejects; repeated rows share
    their fate; other columns may be null; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hits = None, Hits(chain.vocabulary)
        for batch in batches:
            at = batch.schema.get_field_index(text_col) if at is None else at
            keep = chain.probabilities(_matrix(hits, batch.column(at)))[:, -1] < threshold
            if keep.any():
                yield batch.filter(pa.array(keep))

    return small_batches(docs).mapInArrow(run, docs.schema)
