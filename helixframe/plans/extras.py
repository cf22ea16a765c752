"""Record-shaped transformations, per-file aggregates and functions in SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.catalog import register
from helixframe.functions import registry, seq
from helixframe.operators import intervals, models, stats
from helixframe.plans.common import day, r, sql_day, t
from helixframe.plans.scalars import DNA, dna


@register("n_read_filter", "SELECT p_partkey, p_name FROM part WHERE NOT contains(p_name, 'n') AND NOT contains(p_brand, '9')")
def n_read_filter(spark, d):
    """Pairs are dropped if either read has the character."""
    return t(spark, d, "part").filter(~F.contains("p_name", F.lit("n")) & ~F.contains("p_brand", F.lit("9"))).select("p_partkey", "p_name")


@register("swap_blocks", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN l_tax ELSE l_discount END AS a, CASE WHEN l_returnflag = 'R' THEN l_discount ELSE l_tax END AS b FROM lineitem")
def swap_blocks(spark, d):
    swap = F.col("l_returnflag") == "R"
    blocks = F.when(swap, F.struct(F.col("l_tax").alias("a"), F.col("l_discount").alias("b"))).otherwise(F.struct(F.col("l_discount").alias("a"), F.col("l_tax").alias("b")))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", blocks.alias("x")).select("l_orderkey", "l_linenumber", "l_partkey", "x.*")


@register("explode_substitutions", f"""
WITH x AS (SELECT p_partkey, {DNA} AS s FROM part), y AS (SELECT a.p_partkey, a.s AS a, b.s AS b FROM x a JOIN x b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, CAST(i AS INTEGER) AS pos, substring(a, i::BIGINT, 1) AS ref, substring(b, i::BIGINT, 1) AS alt FROM y, generate_series(1, 100) g(i) WHERE i <= least(length(a), length(b)) AND substring(a, i::BIGINT, 1) <> substring(b, i::BIGINT, 1)""")
def explode_substitutions(spark, d):
    x = dna(spark, d)
    y = x.select("p_partkey", F.col("s").alias("a")).join(x.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("s").alias("b")), "p_partkey")
    return y.select("p_partkey", F.explode(seq.difference_positions(F.col("a"), F.col("b"))).alias("x")).select("p_partkey", "x.pos", F.col("x.a").alias("ref"), F.col("x.b").alias("alt"))


@register("cigar_op_totals", "SELECT op, CAST(sum(n) AS BIGINT) AS total FROM (SELECT p_size AS n, 'M' AS op FROM part UNION ALL SELECT p_size % 3 + 1, 'I' FROM part UNION ALL SELECT p_size % 5 + 1, 'D' FROM part) GROUP BY op")
def cigar_op_totals(spark, d):
    c = t(spark, d, "part").select(F.format_string("%dM%dI%dD", "p_size", F.col("p_size") % 3 + 1, F.col("p_size") % 5 + 1).alias("cigar"))
    return c.select(F.explode(seq.cigar(F.col("cigar"))).alias("x")).groupBy("x.op").agg(F.sum("x.n").alias("total"))


@register("base_composition", f"""
WITH x AS (SELECT {DNA} AS s FROM part), c AS (SELECT sum(length(s) - length(replace(s, 'A', ''))) AS a, sum(length(s) - length(replace(s, 'C', ''))) AS c, sum(length(s) - length(replace(s, 'G', ''))) AS g, sum(length(s) - length(replace(s, 'T', ''))) AS t FROM x)
SELECT a::BIGINT AS a, c::BIGINT AS c, g::BIGINT AS g, t::BIGINT AS t, round(100.0 * (g + c) / (a + c + g + t), 6) AS gc_percent FROM c""")
def base_composition(spark, d):
    x = dna(spark, d).select(seq.base_counts(F.col("s")).alias("n"))
    s = x.agg(*[F.sum(f"n.{b}").alias(b.lower()) for b in "ACGT"])
    return s.select("*", r(100.0 * (F.col("g") + F.col("c")) / (F.col("a") + F.col("c") + F.col("g") + F.col("t"))).alias("gc_percent"))


@register("transition_ratio", f"""
WITH x AS (SELECT p_partkey, {DNA} AS s FROM part), y AS (SELECT a.s AS a, b.s AS b FROM x a JOIN x b ON b.p_partkey = a.p_partkey + 1), p AS (SELECT substring(a, i::BIGINT, 1) || substring(b, i::BIGINT, 1) AS p FROM y, generate_series(1, 100) g(i) WHERE i <= least(length(a), length(b)))
SELECT count(*) FILTER (p IN ('AG', 'GA', 'CT', 'TC')) AS ti, count(*) FILTER (p[1] <> p[2] AND p NOT IN ('AG', 'GA', 'CT', 'TC')) AS tv FROM p""")
def transition_ratio(spark, d):
    p = F.concat("ref", "alt").isin("AG", "GA", "CT", "TC")
    return explode_substitutions(spark, d).agg(F.count_if(p).alias("ti"), F.count_if(~p).alias("tv"))


@register("differential_regions", """
WITH g AS (SELECT l_suppkey AS k, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'R') AS nb, avg(l_quantity) FILTER (l_returnflag = 'A') AS ma, avg(l_quantity) FILTER (l_returnflag = 'R') AS mb, var_samp(l_quantity) FILTER (l_returnflag = 'A') AS va, var_samp(l_quantity) FILTER (l_returnflag = 'R') AS vb FROM lineitem GROUP BY 1)
SELECT k, na AS n_a, nb AS n_b, round(ma - mb, 6) AS difference FROM g WHERE na >= 5 AND nb >= 5 AND abs(ma - mb) >= 0.1 AND abs((ma - mb) / nullif(sqrt(va / na + vb / nb), 0)) >= 0.5""")
def differential_regions(spark, d):
    x = stats.differential_regions(t(spark, d, "lineitem").withColumnRenamed("l_suppkey", "k"), ["k"], "l_returnflag", ("A", "R"), "l_quantity", cutoff=0.5)
    return x.select("k", "n_a", "n_b", r(F.col("difference")).alias("difference"))


@register("genotype_priors", """
WITH b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x), g AS (SELECT r.x AS ref, a.x AS a, c.x AS b FROM b r, b a, b c WHERE a.x <= c.x)
SELECT ref, a || b AS genotype, round((CASE WHEN a = ref AND b = ref THEN 1.0::DOUBLE WHEN a = ref OR b = ref THEN 0.001::DOUBLE WHEN a = b THEN 0.0005::DOUBLE ELSE 0.001::DOUBLE * 0.0005 END) * CASE WHEN translate(ref, 'ACGT', 'GTAC') IN (a, b) THEN 4 ELSE 1 END, 9) AS prior FROM g""")
def genotype_priors(spark, d):
    return stats.genotype_priors(spark).withColumn("prior", F.round("prior", 9))


@register("sql_functions", f"""
SELECT p_partkey, reverse(translate({DNA}, 'ACGT', 'TGCA')) AS rc, p_partkey & 6 AS a, xor(p_partkey, 5)::BIGINT AS x, ~p_partkey AS c, round(list_avg(list_transform(string_split(p_brand, ''), lambda c: ascii(c) - 33)), 6) AS q FROM part""")
def sql_functions(spark, d):
    registry.register(spark)
    dna(spark, d).join(t(spark, d, "part", "p_partkey", "p_brand"), "p_partkey").createOrReplaceTempView("reads")
    return spark.sql("SELECT p_partkey, hx_revcomp(s) AS rc, hx_and(p_partkey, 6) AS a, hx_xor(p_partkey, 5) AS x, hx_compl(p_partkey) AS c, round(hx_meanqual(p_brand), 6) AS q FROM reads")


@register("murmur_hash")
def murmur_hash(spark, d):
    registry.register(spark)
    t(spark, d, "part", "p_partkey", "p_name").createOrReplaceTempView("named")
    return spark.sql("SELECT p_partkey, hx_murmur128(p_name) AS h FROM named")


@register("run_length_fold", "WITH x AS (SELECT event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS k, user_id FROM events), g AS (SELECT *, sum(k) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM x) SELECT user_id, any_value(event_type) AS event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM g GROUP BY user_id, g")
def run_length_fold(spark, d):
    return intervals.value_islands(t(spark, d, "events", "user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@register("per_file_counts", "SELECT 'nation' AS series, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def per_file_counts(spark, d):
    """One grouped query over several files instead of a thread for each."""
    parts = [t(spark, d, n).select(F.lit(n).alias("series")) for n in ("nation", "region")]
    return parts[0].unionByName(parts[1]).groupBy("series").agg(F.count("*").alias("n"))


@register("mask_complement_union", f"""
WITH x AS (SELECT l_suppkey AS c, l_orderkey AS o, {sql_day('min(l_shipdate)')} AS s, {sql_day('max(l_shipdate)')} + 20 AS e FROM lineitem GROUP BY 1, 2), p AS (SELECT DISTINCT c, unnest(generate_series(s, e - 1)) AS p FROM x),
u AS (SELECT c, min(s) AS a, max(e) AS z FROM x GROUP BY 1) SELECT u.c, z - a - (SELECT count(*) FROM p WHERE p.c = u.c) AS uncovered FROM u""")
def mask_complement_union(spark, d):
    """Positions of each span's hull that no interval covers, by sums over gaps and never by position."""
    from helixframe.plans.ordered import spans

    x = spans(spark, d)
    hull = x.groupBy("c").agg(F.min("s").alias("a"), F.max("e").alias("z"))
    held = intervals.merge(x, ["c"], "s", "e").groupBy("c").agg(F.sum(F.col("e") - F.col("s")).alias("n"))
    return hull.join(held, "c").select("c", (F.col("z") - F.col("a") - F.col("n")).alias("uncovered"))


@register("depth_sentinel", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity = 50 THEN 0 ELSE l_quantity END AS depth FROM lineitem")
def depth_sentinel(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_quantity") == 50, 0.0).otherwise(F.col("l_quantity")).alias("depth"))


@register("daily_first_last", f"SELECT o_custkey, {sql_day('min(o_orderdate)')} AS first, {sql_day('max(o_orderdate)')} AS last FROM orders GROUP BY 1")
def daily_first_last(spark, d):
    g = t(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return g.select("o_custkey", day("a").alias("first"), day("b").alias("last"))


@register("marker_scan", """
WITH c AS (SELECT p_brand, p_size % 3 AS g, p_retailprice AS y FROM part), a AS (SELECT p_brand, g, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM c GROUP BY 1, 2), b AS (SELECT p_brand, CAST(sum(n) AS BIGINT) AS n, count(*) AS classes, sum(q) - sum(s) * sum(s) / sum(n) AS r0, sum(q - s * s / n) AS r1 FROM a GROUP BY 1)
SELECT p_brand, n, classes, CASE WHEN r0 > 0.001 AND r1 > 0.001 THEN round(n / 2.0 * log10(r0 / r1), 3) END AS lod FROM b""")
def marker_scan(spark, d):
    x = models.marker_scan(t(spark, d, "part").withColumn("g", F.col("p_size") % 3), "p_brand", "g", "p_retailprice")
    return x.select("p_brand", "n", "classes", r(F.col("lod"), 3).alias("lod"))


@register("count_min_sketch")
def count_min_sketch(spark, d):
    """Approximate counts of part keys from a sketch of fixed size; never below the exact ones (tested)."""
    li = t(spark, d, "lineitem", "l_partkey")
    return models.count_min_query(li, "l_partkey", models.count_min(li, "l_partkey"))


@register("improved_pairs")
def improved_pairs(spark, d):
    s = t(spark, d, "supplier").withColumn("third", F.col("s_nationkey") % 3)
    return models.improved_pairs(s, ["third"], "s_suppkey", "s_acctbal").withColumn("total", r(F.col("total")))


@register("empirical_p", "WITH n AS (SELECT o_orderkey % 25 AS k, o_totalprice / 100 AS s FROM orders), p AS (SELECT p_partkey, p_size % 25 AS k, p_retailprice AS s FROM part) SELECT p_partkey, round(((SELECT count(*) FROM n WHERE n.k = p.k AND n.s >= p.s) + 1) / (SELECT count(*) + 1 FROM n WHERE n.k = p.k), 6) AS p FROM p")
def empirical_p(spark, d):
    """Prices of parts against the prices of orders of one remainder."""
    null = t(spark, d, "orders").select((F.col("o_orderkey") % 25).alias("k"), (F.col("o_totalprice") / 100).alias("n"))
    x = models.empirical_p(t(spark, d, "part").select("p_partkey", (F.col("p_size") % 25).cast("long").alias("k"), F.col("p_retailprice").alias("s")), ["k"], "s", null, "n")
    return x.select("p_partkey", r(F.col("p")).alias("p"))
