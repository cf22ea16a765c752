"""Statistics over grouped tables: tests, resampling, diversity and distances."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions.text import draw
from helixframe.operators.windows import running_sums


def hardy_weinberg(df: DataFrame, aa: str, ab: str, bb: str) -> DataFrame:
    """Allele frequency, expected genotype counts, chi-squared, and whether heterozygotes exceed 2pqN by over 1.001."""
    n = (F.col(aa) + F.col(ab) + F.col(bb)).cast("double")
    p = F.try_divide(2.0 * F.col(aa) + F.col(ab), 2.0 * n)
    e = (p * p * n, 2 * p * (1 - p) * n, (1 - p) * (1 - p) * n)
    chi = sum((F.coalesce(F.try_divide((F.col(o) - x) * (F.col(o) - x), x), F.lit(0.0)) for o, x in zip((aa, ab, bb), e, strict=True)), F.lit(0.0))
    return df.select("*", p.alias("p"), e[0].alias("expected_aa"), e[1].alias("expected_ab"), e[2].alias("expected_bb"), chi.alias("chi2"), (F.col(ab) - e[1] > 1.001).alias("excess"))


def t_statistic(df: DataFrame, keys: list[str], group: str, sides: tuple, value: str) -> DataFrame:
    """Welch's t and degrees of freedom of two groups in each key; null unless both have two values."""
    a, b = sides
    pick = lambda s: F.when(F.col(group) == s, F.col(value))
    g = df.groupBy(*keys).agg(*[f(pick(s)).alias(f"{n}{i}") for i, s in enumerate((a, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    va, vb = F.try_divide(F.col("v0"), F.col("n0").cast("double")), F.try_divide(F.col("v1"), F.col("n1").cast("double"))
    enough = (F.col("n0") > 1) & (F.col("n1") > 1)
    t = F.when(enough, F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(va + vb)))
    freedom = F.when(enough, F.try_divide((va + vb) * (va + vb), va * va / F.nullif(F.col("n0") - 1, F.lit(0)) + vb * vb / F.nullif(F.col("n1") - 1, F.lit(0))))
    return g.select(*keys, F.col("n0").alias("n_a"), F.col("n1").alias("n_b"), F.col("m0").alias("mean_a"), F.col("m1").alias("mean_b"), t.alias("t"), freedom.alias("df"))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def _gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 500):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b or 1e-300)
        c = b + num / c or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * out


@F.pandas_udf(T.DoubleType())
def _t_p(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(k) else _beta(k / 2, 0.5, k / (k + x * x)) for x, k in zip(t, n, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _chi_p(x: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or pd.isna(k) else 1 - _gamma(k / 2, v / 2) for v, k in zip(x, n, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _lgamma(x: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else math.lgamma(v) for v in x], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else math.erfc(v) for v in x], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _ibeta(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(i) or pd.isna(j) or pd.isna(v) else _beta(i, j, v) for i, j, v in zip(a, b, x, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _igamma(a: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(i) or pd.isna(v) else _gamma(i, v) for i, v in zip(a, x, strict=True)], dtype="float64")


def t_p_value(t: Column, freedom: Column) -> Column:
    """Two-sided."""
    return _t_p(t, freedom)


def chi2_p_value(x: Column, freedom) -> Column:
    return _chi_p(x, F.lit(freedom).cast("double") if not isinstance(freedom, Column) else freedom.cast("double"))


def log_gamma(x: Column) -> Column:
    return _lgamma(x)


def erfc(x: Column) -> Column:
    return _erfc(x)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    return _ibeta(a, b, x)


def incomplete_gamma(a: Column, x: Column) -> Column:
    return _igamma(a, x)


def chi2_table(df: DataFrame, row: str, column: str, n: str) -> DataFrame:
    """Chi-squared of a contingency table given as counts, with its degrees of freedom; sums come before any join."""
    cells = df.groupBy(row, column).agg(F.sum(n).alias("o"))
    rows, cols = cells.groupBy(row).agg(F.sum("o").alias("r")), cells.groupBy(column).agg(F.sum("o").alias("c"))
    total = cells.agg(F.sum("o").alias("t"), F.count_distinct(row).alias("nr"), F.count_distinct(column).alias("nc"))
    # sum of o*o/e - t, in which absent cells count nothing
    part = cells.join(rows, row).join(cols, column).agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c")).cast("double")).alias("s"))
    return part.crossJoin(total).select((F.col("t") * (F.col("s") - 1)).alias("chi2"), ((F.col("nr") - 1) * (F.col("nc") - 1)).alias("df"))


def rank_sum(df: DataFrame, group: str, sides: tuple, value: str) -> DataFrame:
    """Mann-Whitney U of two groups with the tie-corrected normal z; equal values are summed first, so no value is ranked twice."""
    a, b = sides
    counts = df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(value).agg(F.sum(F.when(F.col(group) == a, 1).otherwise(0)).alias("na"), F.count("*").alias("n"))
    ranked = running_sums(counts, [], value, F.col("n"), out="upto").withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2.0)
    s = ranked.agg(F.sum(F.col("rank") * F.col("na")).alias("ra"), F.sum("na").alias("na"), F.sum("n").alias("n"), F.sum(F.pow("n", F.lit(3.0)) - F.col("n")).alias("ties"))
    nb = F.col("n") - F.col("na")
    u = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2.0
    sd = F.sqrt(F.col("na") * nb / 12.0 * ((F.col("n") + 1) - F.col("ties") / (F.col("n") * (F.col("n") - 1.0))))
    return s.select(u.alias("u"), F.try_divide(u - F.col("na") * nb / 2.0, sd).alias("z"), F.col("na").alias("n_a"), nb.alias("n_b"))


def ks_statistic(df: DataFrame, group: str, sides: tuple, value: str) -> DataFrame:
    """Largest distance of two empirical distributions."""
    a, b = sides
    counts = df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(value).agg(*[F.sum(F.when(F.col(group) == s, 1).otherwise(0)).alias(n) for n, s in (("a", a), ("b", b))])
    whole = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    both = running_sums(running_sums(counts, [], value, F.col("a"), out="ua"), [], value, F.col("b"), out="ub")
    return both.join(F.broadcast(whole)).agg(F.max(F.abs(F.col("ua") / F.col("ta") - F.col("ub") / F.col("tb"))).alias("d"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, from one pass."""
    pairs = [(x, y) for x in columns for y in columns]
    row = df.agg(*[F.corr(x, y).alias(f"c{i}") for i, (x, y) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"c{i}").alias("r")) for i, (x, y) in enumerate(pairs)])).alias("p")).select("p.*")


def ratio_jackknife(df: DataFrame, keys: list[str], block: str, x: str, y: str) -> DataFrame:
    """Ratio of sums with the unequal-group jackknife over blocks: each block's value comes from totals less its own sums."""
    sums = df.groupBy(*keys, block).agg(F.sum(x).cast("double").alias("x"), F.sum(y).cast("double").alias("y"))
    whole = Window.partitionBy(*keys)
    tx, ty, g = F.sum("x").over(whole), F.sum("y").over(whole), F.count("*").over(whole)
    theta, out = F.try_divide(ty, tx), F.try_divide(ty - F.col("y"), tx - F.col("x"))
    h = F.try_divide(tx, F.col("x"))
    parts = sums.select(*keys, theta.alias("t"), out.alias("o"), h.alias("h"), g.alias("g"), (F.col("x") / tx).alias("w"))
    est = parts.groupBy(*keys).agg(F.first("t").alias("theta"), F.first("g").alias("blocks"), (F.first("g") * F.first("t") - F.sum((1 - F.col("w")) * F.col("o"))).alias("jackknife"))
    joined = parts.join(est.select(*keys, "jackknife"), keys) if keys else parts.crossJoin(F.broadcast(est.select("jackknife")))
    pseudo = F.col("h") * F.col("t") - (F.col("h") - 1) * F.col("o")
    var = joined.groupBy(*keys).agg((F.sum((pseudo - F.col("jackknife")) ** 2 / (F.col("h") - 1)) / F.first("g")).alias("variance"))
    return est.join(var, keys) if keys else est.crossJoin(F.broadcast(var))


def bootstrap(df: DataFrame, block: str, x: str, y: str, rounds: int = 100, seed: int = 1) -> DataFrame:
    """Ratio of sums in ``rounds`` resamplings of blocks: each block gets a Poisson weight, so a round needs no pass of its own."""
    sums = df.groupBy(block).agg(F.sum(x).cast("double").alias("x"), F.sum(y).cast("double").alias("y"))
    rolled = sums.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    u = draw(seed, block, "round") / float(1 << 48)
    weight, upto, p = F.lit(0), math.exp(-1), math.exp(-1)
    for k in range(1, 9):
        weight = weight + F.when(u >= upto, 1).otherwise(0)
        p /= k
        upto += p
    return rolled.withColumn("w", weight).groupBy("round").agg(F.try_divide(F.sum(F.col("w") * F.col("y")), F.sum(F.col("w") * F.col("x"))).alias("theta"))


def pairwise_mismatch(df: DataFrame, locus: list[str], sample: str, value: str) -> DataFrame:
    """Loci that two samples share, how many differ, and the share; called values only."""
    a = df.filter(F.col(value).isNotNull()).select(*locus, F.col(sample).alias("a"), F.col(value).alias("__a"))
    b = df.filter(F.col(value).isNotNull()).select(*locus, F.col(sample).alias("b"), F.col(value).alias("__b"))
    both = a.join(b, locus).filter("a < b")
    out = both.groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum((F.col("__a") != F.col("__b")).cast("long")).alias("different"))
    return out.withColumn("rate", F.try_divide(F.col("different").cast("double"), F.col("shared").cast("double")))


def p_distance(df: DataFrame, locus: list[str], sample: str, code: str) -> DataFrame:
    """(loci with no common allele + half of those with one) over loci called in both samples, for ambiguity codes."""
    from helixframe.functions.seq import shared_alleles

    a, b = df.select(*locus, F.col(sample).alias("a"), F.col(code).alias("__a")), df.select(*locus, F.col(sample).alias("b"), F.col(code).alias("__b"))
    both = a.join(b, locus).filter("a < b").withColumn("__s", shared_alleles(F.col("__a"), F.col("__b")))
    return both.groupBy("a", "b").agg(F.count("*").alias("loci"), (F.sum(F.when(F.col("__s") == 0, 1.0).when(F.col("__s") == 1, 0.5).otherwise(0.0)) / F.count("*")).alias("distance"))


def diversity(df: DataFrame, keys: list[str], site: str, allele: str) -> DataFrame:
    """Nucleotide diversity and Watterson's estimate in each key, from allele counts by site."""
    sites = df.filter(F.col(allele).isNotNull()).groupBy(*keys, site, allele).agg(F.count("*").cast("double").alias("c"))
    by_site = sites.groupBy(*keys, site).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("ss"), F.count("*").alias("__alleles"))
    pi = F.try_divide(F.col("n") * F.col("n") - F.col("ss"), F.col("n") * (F.col("n") - 1))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n").cast("int") - 1, F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / i)
    return by_site.groupBy(*keys).agg(F.count("*").alias("sites"), F.sum((F.col("__alleles") > 1).cast("long")).alias("segregating"), F.coalesce(F.sum(pi), F.lit(0.0)).alias("theta_pi"), F.sum(F.when(F.col("__alleles") > 1, 1.0 / harmonic).otherwise(0.0)).alias("theta_w"))


def posterior(df: DataFrame, priors: DataFrame, keys: list[str], hypothesis: str, likelihood: str, prior: str = "prior") -> DataFrame:
    """Posterior of each hypothesis in a key from likelihoods and a table of priors, which is broadcast where it has at most 10,000 rows."""
    small = priors.limit(10_001).count() <= 10_000
    joined = df.join(F.broadcast(priors) if small else priors, hypothesis)
    mass = F.col(likelihood) * F.col(prior)
    return joined.withColumn("posterior", F.try_divide(mass, F.sum(mass).over(Window.partitionBy(*keys))))


def degeneracy(spark) -> DataFrame:
    """Of the standard code's sense codons, for each position the changes that keep the amino acid and those that alter it."""
    from helixframe.functions.seq import CODONS, lookup

    codons = spark.createDataFrame(sorted(CODONS.items()), "codon string, amino string").filter("amino <> '*'")
    made = codons.withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("base", F.explode(F.array(*[F.lit(b) for b in "ACGT"])))
    changed = made.withColumn("mutant", F.overlay("codon", "base", F.col("position") + 1)).filter("mutant <> codon").withColumn("new", F.try_element_at(lookup(CODONS), F.col("mutant"))).filter("new <> '*'")
    same = F.sum((F.col("new") == F.col("amino")).cast("long"))
    return changed.groupBy("position").agg(same.alias("synonymous"), (F.count("*") - same).alias("altering"), (same / F.count("*")).alias("share"))


def ka_ks(df: DataFrame, a: str, b: str) -> DataFrame:
    """Non-synonymous and synonymous substitution rates of two aligned coding sequences by the counting method with Jukes-Cantor correction; null where undefined."""
    from helixframe.functions.seq import CODONS

    def sites(codon: str) -> float:
        """Synonymous sites of a codon."""
        out = 0.0
        for i in range(3):
            same = sum(CODONS[codon[:i] + x + codon[i + 1 :]] == CODONS[codon] for x in "ACGT" if x != codon[i])
            out += same / 3
        return out

    def steps(x: str, y: str) -> tuple[float, float]:
        """Mean synonymous and other changes over the shortest paths that avoid stops."""
        import itertools

        at = [i for i in range(3) if x[i] != y[i]]
        total, paths = [0.0, 0.0], 0
        for order in itertools.permutations(at):
            now, syn, non, ok = x, 0, 0, True
            for i in order:
                then = now[:i] + y[i] + now[i + 1 :]
                if CODONS[then] == "*":
                    ok = False
                    break
                syn, non = (syn + 1, non) if CODONS[then] == CODONS[now] else (syn, non + 1)
                now = then
            if ok:
                total, paths = [total[0] + syn, total[1] + non], paths + 1
        return (total[0] / paths, total[1] / paths) if paths else (0.0, float(len(at)))

    def corrected(p: float) -> float | None:
        return -0.75 * math.log(1 - 4 * p / 3) if p < 0.75 else None

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("ka", "ks", "ratio")]))
    def solve(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for s, t in zip(x, y, strict=True):
            syn = changed_s = changed_n = 0.0
            n = 0
            for i in range(0, min(len(s or ""), len(t or "")) // 3 * 3, 3):
                c, d = s[i : i + 3].upper(), t[i : i + 3].upper()
                if CODONS.get(c, "*") == "*" or CODONS.get(d, "*") == "*":
                    continue
                n += 1
                syn += (sites(c) + sites(d)) / 2
                u, v = steps(c, d)
                changed_s, changed_n = changed_s + u, changed_n + v
            ks = corrected(changed_s / syn) if syn else None
            ka = corrected(changed_n / (3 * n - syn)) if 3 * n > syn else None
            out.append((ka, ks, ka / ks if ka is not None and ks else None))
        return pd.DataFrame(out, columns=["ka", "ks", "ratio"]).astype("float64")

    return df.withColumn("__k", solve(a, b)).select(*df.columns, "__k.ka", "__k.ks", "__k.ratio")


def confusion(truth: DataFrame, calls: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Calls held against a truth set: TP, wrong value, FP (call without truth), FN (truth neither right nor wrong)."""
    t, c = truth.select(*keys, F.col(value).alias("__t")), calls.select(*keys, F.col(value).alias("__c"))
    both = t.withColumn("__it", F.lit(1)).join(c.withColumn("__ic", F.lit(1)), keys, "full_outer")
    n = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    it, ic = F.col("__it").isNotNull(), F.col("__ic").isNotNull()
    return both.agg(n(it & ic & F.col("__t").eqNullSafe(F.col("__c"))).alias("tp"), n(it & ic & ~F.col("__t").eqNullSafe(F.col("__c"))).alias("error"), n(~it & ic).alias("fp"), n(it & ~ic).alias("fn"))


def genotype_priors(spark, het: float = 0.001, hom: float = 0.0005, transition: float = 4.0) -> DataFrame:
    """Prior of each unordered genotype given the reference base: 1 for the reference itself, ``het`` or ``hom`` for new ones, their product for two new alleles, and ``transition`` times that if an allele is a transition."""
    bases = F.array(*[F.lit(b) for b in "ACGT"])
    t = spark.range(1).select(F.explode(bases).alias("ref")).withColumn("a", F.explode(bases)).withColumn("b", F.explode(bases)).filter("a <= b")
    ref, a, b = F.col("ref"), F.col("a"), F.col("b")
    base = F.when((a == ref) & (b == ref), 1.0).when((a == ref) | (b == ref), het).when(a == b, hom).otherwise(het * hom)
    other = F.translate(ref, "ACGT", "GTAC")
    return t.select("ref", F.concat("a", "b").alias("genotype"), (base * F.when((a == other) | (b == other), transition).otherwise(1.0)).alias("prior"))


def differential_regions(df: DataFrame, keys: list[str], group: str, sides: tuple, value: str, least_n: int = 5, least_difference: float = 0.1, cutoff: float = 2.0) -> DataFrame:
    """Regions with enough sites on both sides, a mean difference of at least ``least_difference`` and |t| of at least ``cutoff``."""
    x = t_statistic(df, keys, group, sides, value)
    difference = F.col("mean_a") - F.col("mean_b")
    return x.filter((F.col("n_a") >= least_n) & (F.col("n_b") >= least_n) & (F.abs(difference) >= least_difference) & (F.abs(F.col("t")) >= cutoff)).withColumn("difference", difference)


def overlap_significance(overlap: Column, score: Column, match: float = 0.25) -> Column:
    """Chance that an overlap of that length scores at least as well by luck: the binomial tail of matches at rate ``match``."""
    from helixframe.functions.calc import comb

    n, k = overlap.cast("long"), score.cast("long")
    terms = F.when(k <= n, F.sequence(k, n)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, F.lit(0.0), lambda a, i: a + comb(n, i).cast("double") * F.pow(F.lit(match), i.cast("double")) * F.pow(F.lit(1 - match), (n - i).cast("double")))
