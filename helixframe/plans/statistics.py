"""Statistical tests, resampling, diversity, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.catalog import register
from helixframe.operators import stats
from helixframe.plans.common import r, sql_draw, t

GENO = "SELECT l_suppkey AS k, count(*) FILTER (l_returnflag = 'A') AS aa, count(*) FILTER (l_returnflag = 'N') AS ab, count(*) FILTER (l_returnflag = 'R') AS bb FROM lineitem GROUP BY 1"


def geno(spark, d):
    n = lambda f: F.count_if(F.col("l_returnflag") == f)
    return t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(n("A").alias("aa"), n("N").alias("ab"), n("R").alias("bb"))


@register("hwe_chi2", f"""
WITH g AS ({GENO}), p AS (SELECT *, (aa + ab + bb)::DOUBLE AS n, (2 * aa + ab) / (2.0 * (aa + ab + bb)) AS p FROM g)
SELECT k, round(p, 6) AS p, round(coalesce((aa - p * p * n) ** 2 / nullif(p * p * n, 0), 0) + coalesce((ab - 2 * p * (1 - p) * n) ** 2 / nullif(2 * p * (1 - p) * n, 0), 0) + coalesce((bb - (1 - p) * (1 - p) * n) ** 2 / nullif((1 - p) * (1 - p) * n, 0), 0), 6) AS chi2, ab - 2 * p * (1 - p) * n > 1.001 AS excess FROM p""")
def hwe_chi2(spark, d):
    x = stats.hardy_weinberg(geno(spark, d), "aa", "ab", "bb")
    return x.select("k", r(F.col("p")).alias("p"), r(F.col("chi2")).alias("chi2"), "excess")


@register("t_stat_groups", """
WITH g AS (SELECT l_suppkey AS k, count(*) FILTER (l_linestatus = 'F') AS na, count(*) FILTER (l_linestatus = 'O') AS nb, avg(l_quantity) FILTER (l_linestatus = 'F') AS ma, avg(l_quantity) FILTER (l_linestatus = 'O') AS mb, var_samp(l_quantity) FILTER (l_linestatus = 'F') AS va, var_samp(l_quantity) FILTER (l_linestatus = 'O') AS vb FROM lineitem GROUP BY 1)
SELECT k, na AS n_a, nb AS n_b, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, CASE WHEN na > 1 AND nb > 1 THEN round((ma - mb) / nullif(sqrt(va / na + vb / nb), 0), 5) END AS t FROM g""")
def t_stat_groups(spark, d):
    x = stats.t_statistic(t(spark, d, "lineitem").withColumnRenamed("l_suppkey", "k"), ["k"], "l_linestatus", ("F", "O"), "l_quantity")
    return x.select("k", "n_a", "n_b", r(F.col("mean_a")).alias("mean_a"), r(F.col("mean_b")).alias("mean_b"), r(F.col("t"), 5).alias("t"))


@register("t_p_values")
def t_p_values(spark, d):
    x = stats.t_statistic(t(spark, d, "lineitem").withColumnRenamed("l_suppkey", "k"), ["k"], "l_linestatus", ("F", "O"), "l_quantity")
    return x.select("k", r(stats.t_p_value(F.col("t"), F.col("df"))).alias("p"))


@register("chi2_table", """
WITH o AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY ALL), x AS (SELECT *, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS c, sum(o) OVER () AS t FROM o)
SELECT round(max(t) * (sum(o * o / (r * c)) - 1), 5) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df FROM x""")
def chi2_table(spark, d):
    x = stats.chi2_table(t(spark, d, "lineitem").withColumn("one", F.lit(1)), "l_returnflag", "l_linestatus", "one")
    return x.select(r(F.col("chi2"), 5).alias("chi2"), "df")


@register("rank_sum", """
WITH v AS (SELECT value, event_type = 'view' AS a FROM events WHERE event_type IN ('view', 'click')), k AS (SELECT a, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM v)
SELECT round(sum(r) FILTER (a) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2.0, 4) AS u, count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b FROM k""")
def rank_sum(spark, d):
    x = stats.rank_sum(t(spark, d, "events"), "event_type", ("view", "click"), "value")
    return x.select(r(F.col("u"), 4).alias("u"), "n_a", "n_b")


@register("ks_statistic", """
WITH v AS (SELECT value, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)
SELECT round(max(d), 6) AS d FROM (SELECT abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()) AS d FROM v WINDOW w AS (ORDER BY value))""")
def ks_statistic(spark, d):
    return stats.ks_statistic(t(spark, d, "events"), "event_type", ("view", "click"), "value").select(r(F.col("d")).alias("d"))


@register("pearson_corr", """
SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_quantity', round(corr(l_quantity, l_extendedprice), 6) FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0 UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0""")
def pearson_corr(spark, d):
    return stats.correlation_matrix(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).select("x", "y", r(F.col("r")).alias("r"))


@register("ratio_jackknife", """
WITH b AS (SELECT l_suppkey AS blk, sum(l_quantity) AS x, sum(l_quantity * l_discount) AS y FROM lineitem GROUP BY 1), w AS (SELECT sum(x) AS tx, sum(y) AS ty, count(*) AS g FROM b),
p AS (SELECT b.*, tx, ty, g, ty / tx AS t, (ty - y) / (tx - x) AS o, tx / x AS h FROM b, w), e AS (SELECT any_value(g) * any_value(t) - sum((1 - x / tx) * o) AS j FROM p)
SELECT round(any_value(t), 8) AS theta, any_value(g) AS blocks, round(any_value(j), 8) AS jackknife, round(sum((h * t - (h - 1) * o - j) ** 2 / (h - 1)) / any_value(g), 12) AS variance FROM p, e""")
def ratio_jackknife(spark, d):
    li = t(spark, d, "lineitem").withColumn("y", F.col("l_quantity") * F.col("l_discount"))
    x = stats.ratio_jackknife(li, [], "l_suppkey", "l_quantity", "y")
    return x.select(r(F.col("theta"), 8).alias("theta"), "blocks", r(F.col("jackknife"), 8).alias("jackknife"), r(F.col("variance"), 12).alias("variance"))


@register("bootstrap_ratio", f"""
WITH RECURSIVE p AS (SELECT 0 AS k, exp(-1.0) AS p UNION ALL SELECT k + 1, p / (k + 1) FROM p WHERE k < 7), c AS (SELECT k + 1 AS k, sum(p) OVER (ORDER BY k) AS upto FROM p),
g AS (SELECT l_suppkey, sum(l_quantity) AS x, sum(l_quantity * l_discount) AS y FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, x, y, CAST(i AS INTEGER) AS round, {sql_draw(1, 'l_suppkey', 'i')} / pow(2, 48) AS u FROM g, generate_series(1, 50) r(i)),
w AS (SELECT round, x, y, (SELECT count(*) FROM c WHERE u >= upto) AS w FROM b) SELECT round, round(sum(w * y) / sum(w * x), 6) AS theta FROM w GROUP BY 1""")
def bootstrap_ratio(spark, d):
    li = t(spark, d, "lineitem").withColumn("y", F.col("l_quantity") * F.col("l_discount"))
    return stats.bootstrap(li, "l_suppkey", "l_quantity", "y", 50).withColumn("theta", r(F.col("theta")))


@register("theta_pi", """
WITH a AS (SELECT l_suppkey % 10 AS k, l_partkey AS site, l_returnflag AS al, count(*)::DOUBLE AS c FROM lineitem GROUP BY ALL), s AS (SELECT k, site, sum(c) AS n, sum(c * c) AS ss, count(*) AS al FROM a GROUP BY 1, 2)
SELECT k, count(*) AS sites, CAST(sum((al > 1)::INT) AS BIGINT) AS segregating, round(coalesce(sum((n * n - ss) / nullif(n * (n - 1), 0)), 0), 5) AS theta_pi, round(sum(CASE WHEN al > 1 THEN 1 / list_sum(list_transform(generate_series(1, greatest(n::BIGINT - 1, 1)), lambda i: 1.0::DOUBLE / i)) ELSE 0 END), 5) AS theta_w FROM s GROUP BY k""")
def theta_pi(spark, d):
    x = stats.diversity(t(spark, d, "lineitem").withColumn("k", F.col("l_suppkey") % 10), ["k"], "l_partkey", "l_returnflag")
    return x.select("k", "sites", "segregating", r(F.col("theta_pi"), 5).alias("theta_pi"), r(F.col("theta_w"), 5).alias("theta_w"))


@register("posterior", """
WITH l AS (SELECT l_suppkey AS k, l_returnflag AS h, avg(l_discount) + 0.01 AS lk FROM lineitem GROUP BY 1, 2), j AS (SELECT k, h, lk * prior AS m FROM l JOIN (VALUES ('A', 0.2::DOUBLE), ('N', 0.5::DOUBLE), ('R', 0.3::DOUBLE)) p(h, prior) USING (h)) SELECT k, h, round(m / sum(m) OVER (PARTITION BY k), 6) AS posterior FROM j""")
def posterior(spark, d):
    like = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("h")).agg((F.avg("l_discount") + 0.01).alias("like"))
    priors = spark.createDataFrame([("A", 0.2), ("N", 0.5), ("R", 0.3)], "h string, prior double")
    return stats.posterior(like, priors, ["k"], "h", "like").select("k", "h", r(F.col("posterior")).alias("posterior"))


@register("codon_degeneracy", "SELECT * FROM (VALUES (0, 8::BIGINT, 166::BIGINT, 0.045977::DOUBLE), (1, 0, 176, 0.0), (2, 126, 50, 0.715909)) x(position, synonymous, altering, share)")
def codon_degeneracy(spark, d):
    return stats.degeneracy(spark).withColumn("share", r(F.col("share")))


@register("ka_ks")
def ka_ks(spark, d):
    from helixframe.plans.scalars import dna

    x = dna(spark, d)
    pairs = x.select(F.col("p_partkey").alias("k"), F.col("s").alias("a")).join(x.select((F.col("p_partkey") - 1).alias("k"), F.col("s").alias("b")), "k")
    return stats.ka_ks(pairs, "a", "b").select("k", r(F.col("ka")).alias("ka"), r(F.col("ks")).alias("ks"))
