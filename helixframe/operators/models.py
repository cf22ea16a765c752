"""Small models fitted per group, marker scans and sketches."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def marker_scan(df: DataFrame, marker: str, genotype: str, phenotype: str) -> DataFrame:
    """LOD score of each marker by regression on genotype classes: n / 2 log10(RSS0 / RSS1), from sums alone."""
    cells = df.filter(F.col(genotype).isNotNull() & F.col(phenotype).isNotNull()).groupBy(marker, genotype).agg(F.count("*").alias("n"), F.sum(phenotype).alias("s"), F.sum(F.col(phenotype) * F.col(phenotype)).alias("q"))
    sums = cells.groupBy(marker).agg(F.sum("n").alias("n"), F.count("*").alias("classes"), (F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")).alias("rss0"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("rss1"))
    return sums.select(marker, "n", "classes", F.when((F.col("rss1") > 0) & (F.col("rss0") > 0), F.col("n") / 2.0 * F.log10(F.col("rss0") / F.col("rss1"))).alias("lod"))


def hooke_jeeves(f: Callable[[np.ndarray], float], start, step: float = 0.5, tolerance: float = 1e-8, rounds: int = 10_000) -> np.ndarray:
    """Minimum of a function of several variables by pattern moves."""
    base = np.asarray(start, float)
    value = f(base)

    def explore(x: np.ndarray, best: float) -> tuple[np.ndarray, float]:
        x = x.copy()
        for i in range(len(x)):
            for d in (step, -step):
                x[i] += d
                if (v := f(x)) < best:
                    best = v
                    break
                x[i] -= d
        return x, best

    for _ in range(rounds):
        if step < tolerance:
            break
        new, best = explore(base, value)
        if best >= value:
            step /= 2
            continue
        while best < value:
            leap = new + (new - base)
            base, value = new, best
            new, best = explore(leap, f(leap))
    return base


def golden_section(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-10) -> float:
    """Minimum of a function of one variable that falls and then rises."""
    g = (5**0.5 - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = f(a), f(b)
    while high - low > tolerance:
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = f(b)
    return (low + high) / 2


def fitted(df: DataFrame, keys: list[str], names: list[str], loss: Callable[[pd.DataFrame, np.ndarray], float], start: list[float]) -> DataFrame:
    """Parameters that minimise a loss in each group; a group is one task's, so groups must be of a bounded size."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        best = hooke_jeeves(lambda x: loss(pdf, x), start)
        return pd.DataFrame([[*pdf[keys].iloc[0], *best]], columns=[*keys, *names])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.groupBy(*keys).applyInPandas(solve, ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{n} double" for n in names)]))


def support_vector_fit(x: np.ndarray, y: np.ndarray, c: float = 1.0, epsilon: float = 0.1, gamma: float | None = None, rounds: int = 300) -> Callable[[np.ndarray], np.ndarray]:
    """Support vector regression with a radial kernel: coordinate ascent on the dual, each coefficient soft-thresholded and clipped to [-c, c]."""
    gamma = 1 / x.shape[1] if gamma is None else gamma
    mean, scale = x.mean(0), x.std(0) + 1e-12
    z, level = (x - mean) / scale, y.mean()
    kernel = lambda a, b: np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(2)) + 1.0  # noqa: E731  the constant is the intercept
    k, beta = kernel(z, z), np.zeros(len(y))
    out = np.zeros(len(y))
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(y)):
            rest = y[i] - level - (out[i] - k[i, i] * beta[i])
            new = np.clip(np.sign(rest) * max(abs(rest) - epsilon, 0) / k[i, i], -c, c)
            if new != beta[i]:
                out += k[:, i] * (new - beta[i])
                moved, beta[i] = max(moved, abs(new - beta[i])), new
        if moved < 1e-6:
            break
    return lambda q: kernel((q - mean) / scale, z) @ beta + level


def support_vector_regression(df: DataFrame, keys: list[str], features: list[str], target: str, c: float = 1.0, epsilon: float = 0.1) -> DataFrame:
    """Fitted values of a support vector regression in each group of a bounded size."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[features].to_numpy(float)
        return pdf.assign(fitted=support_vector_fit(x, pdf[target].to_numpy(float), c, epsilon)(x))

    schema = T.StructType([*df.schema.fields, T.StructField("fitted", T.DoubleType())])
    return df.groupBy(*keys).applyInPandas(solve, schema)


def improved_pairs(df: DataFrame, keys: list[str], item: str, value: str, rounds: int = 50, seed: int = 1, block: int = 512) -> DataFrame:
    """Items of each group paired so that sums come near each other: a seeded random pairing whose partners are swapped while that lowers the spread.

    A group is dealt by hash to blocks of about ``block`` items, each paired on its own, so work grows with the
    items and no group is one task. In a round each pair is held against all others of its block at once and swaps with
    the one that gains most. The last item of a block of odd size has no partner.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item)
        order = np.random.default_rng(seed).permutation(len(pdf))[: len(pdf) // 2 * 2].reshape(-1, 2)
        v = pdf[value].to_numpy(float)
        for _ in range(rounds):
            changed = False
            for i in range(len(order)):
                a, b, c, d = v[order[i, 0]], v[order[i, 1]], v[order[:, 0]], v[order[:, 1]]
                gain = np.abs(a + b - c - d) - np.abs(a + d - b - c)
                j = int(np.argmax(gain)) if len(gain) else i
                if j != i and gain[j] > 1e-12:
                    order[i, 1], order[j, 1] = order[j, 1], order[i, 1]
                    changed = True
            if not changed:
                break
        names = pdf[item].to_numpy()
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "a": names[order[:, 0]], "b": names[order[:, 1]], "total": v[order].sum(1)})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    sizes = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.ceil(F.count("*") / F.lit(block)).alias("__blocks"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    dealt = df.join(sizes, functools.reduce(lambda x, y: x & y, same)).withColumn("__block", F.pmod(F.xxhash64(F.lit(seed), F.col(item)), F.col("__blocks"))).select(*df.columns, "__block")
    return dealt.groupBy(*keys, "__block").applyInPandas(solve, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"a {kinds[item]}", f"b {kinds[item]}", "total double"]))


def count_min(df: DataFrame, key: str, width: int = 1 << 12, depth: int = 4) -> DataFrame:
    """A count-min sketch as a table of at most ``width`` times ``depth`` cells; it adds up over tables by summing cells."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), F.col(key)), F.lit(width)).alias("cell")) for i in range(depth)])).alias("x"))
    return cells.groupBy("x.row", "x.cell").agg(F.count("*").alias("n"))


def count_min_query(keys: DataFrame, key: str, sketch: DataFrame, width: int = 1 << 12, depth: int = 4) -> DataFrame:
    """Counts that are never too low; the sketch, of a fixed size, is broadcast."""
    probes = keys.select(key).distinct().withColumn("x", F.explode(F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), F.col(key)), F.lit(width)).alias("cell")) for i in range(depth)])))
    found = probes.select(key, "x.row", "x.cell").join(F.broadcast(sketch), ["row", "cell"], "left")
    return found.groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))


def empirical_p(df: DataFrame, keys: list[str], score: str, null: DataFrame, null_score: str) -> DataFrame:
    """Share of a key's null scores at or above each score, plus one on both sides, by ranks in one sorted pass; 1 where a key has none."""
    marks = null.groupBy(*keys, F.col(null_score).alias("__s")).agg(F.count("*").alias("__n"))
    asked = df.select(*keys, F.col(score).alias("__s")).distinct().withColumn("__n", F.lit(None).cast("long"))
    window = Window.partitionBy(*keys).orderBy(F.desc("__s"))
    counted = asked.unionByName(marks).select("*", F.coalesce(F.sum("__n").over(window), F.lit(0)).alias("__a"), F.coalesce(F.sum("__n").over(Window.partitionBy(*keys)), F.lit(0)).alias("__all"))
    both = counted.filter("__n is null").select(*keys, F.col("__s").alias(score), ((F.col("__a") + 1) / (F.col("__all") + 1)).alias("p"))
    return df.join(both, [*keys, score])
