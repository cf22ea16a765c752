"""Grouped counts, histograms, distributions, pivots and totals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.catalog import register
from helixframe.functions import text
from helixframe.operators import relational, windows
from helixframe.plans.common import day, r, sql_day, sql_draw, t


@register("cube_margins", """
SELECT CASE WHEN GROUPING(l_returnflag) = 1 THEN '_All_' ELSE l_returnflag END AS returnflag,
       CASE WHEN GROUPING(l_linestatus) = 1 THEN '_All_' ELSE l_linestatus END AS linestatus, count(*) AS n
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_margins(spark, d):
    g = t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_returnflag").alias("a"), F.grouping("l_linestatus").alias("b"))
    return g.select(F.when(F.col("a") == 1, "_All_").otherwise(F.col("l_returnflag")).alias("returnflag"), F.when(F.col("b") == 1, "_All_").otherwise(F.col("l_linestatus")).alias("linestatus"), "n")


@register("rollup_all", """
SELECT CASE WHEN GROUPING(event_type) = 1 THEN '_All_' ELSE event_type END AS event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY ROLLUP (event_type)""")
def rollup_all(spark, d):
    g = t(spark, d, "events").rollup("event_type").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"), F.grouping("event_type").alias("g"))
    return g.select(F.when(F.col("g") == 1, "_All_").otherwise(F.col("event_type")).alias("event_type"), "n", "total")


@register("grouping_sets", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))""")
def grouping_sets(spark, d):
    return t(spark, d, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@register("count_rows", "SELECT count(*) AS n FROM lineitem")
def count_rows(spark, d):
    return t(spark, d, "lineitem").agg(F.count("*").alias("n"))


@register("count_by_keys", "SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL")
def count_by_keys(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(F.count("*").alias("n"))


@register("group_by_count_ordered", "SELECT o_orderpriority, o_orderstatus, count(1) AS n FROM orders GROUP BY 1, 2 ORDER BY 2")
def group_by_count_ordered(spark, d):
    return t(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).orderBy("o_orderstatus")


@register("conditional_count", """
SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, CAST(sum(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END) AS BIGINT) AS large
FROM lineitem GROUP BY l_suppkey""")
def conditional_count(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.sum(F.when(F.col("l_quantity") >= 25, 1).otherwise(0)).alias("large"))


@register("sum_avg_bundle", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def sum_avg_bundle(spark, d):
    li = t(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), r(F.sum("l_quantity"), 4).alias("sum_qty"), r(F.sum("l_extendedprice"), 2).alias("sum_price"), r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        r(F.avg("l_quantity")).alias("avg_qty"), r(F.avg("l_discount")).alias("avg_disc"), F.min("l_quantity").alias("min_qty"), F.max("l_quantity").alias("max_qty"))


@register("mode_by_group", """
WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_quantity AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) = 1""")
def mode_by_group(spark, d):
    c = t(spark, d, "lineitem").groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("n"))
    return relational.one_per_key(c, ["l_suppkey"], [F.desc("n"), F.asc("l_quantity")]).select("l_suppkey", F.col("l_quantity").alias("mode"), "n")


@register("moments", """
SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sd_pop, round(stddev_pop(l_quantity) / avg(l_quantity), 6) AS cv,
  round(var_samp(l_quantity), 5) AS variance FROM lineitem GROUP BY l_returnflag""")
def moments(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(r(F.avg("l_quantity")).alias("mean"), r(F.stddev_samp("l_quantity")).alias("sd"), r(F.stddev_pop("l_quantity")).alias("sd_pop"), r(F.stddev_pop("l_quantity") / F.avg("l_quantity")).alias("cv"), r(F.var_samp("l_quantity"), 5).alias("variance"))


@register("weighted_avg", "SELECT l_suppkey, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 6) AS wavg FROM lineitem GROUP BY l_suppkey")
def weighted_avg(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(r(F.try_divide(F.sum(F.col("l_discount") * F.col("l_quantity")), F.sum("l_quantity"))).alias("wavg"))


@register("overlap_sums", """
SELECT l_returnflag, round(sum(least(l_quantity, l_discount * 100)), 4) AS shared, sum(CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE WHEN l_quantity > 10 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS weight
FROM lineitem GROUP BY l_returnflag""")
def overlap_sums(spark, d):
    w = F.when(F.col("l_quantity") > 25, 1.0).when(F.col("l_quantity") > 10, 0.5).otherwise(0.0)
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(r(F.sum(F.least("l_quantity", F.col("l_discount") * 100)), 4).alias("shared"), F.sum(w).alias("weight"))


@register("distinct_in_group", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_returnflag, l_linestatus)) AS states FROM lineitem GROUP BY l_suppkey")
def distinct_in_group(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_returnflag", "l_linestatus").alias("states"))


@register("collect_set_joined", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ';') AS priorities FROM orders GROUP BY o_custkey")
def collect_set_joined(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ";").alias("priorities"))


@register("collect_list_joined", "SELECT l_orderkey, string_agg(l_returnflag, '^' ORDER BY l_linenumber, l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey")
def collect_list_joined(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda x: x["l_returnflag"]), "^").alias("flags"))


@register("bit_or_mask", """
SELECT user_id, bit_or(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 4 WHEN 'click' THEN 8 ELSE 16 END)::BIGINT AS mask,
  lpad(to_binary(bit_or(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 4 WHEN 'click' THEN 8 ELSE 16 END)::BIGINT), 18, '0') AS bits
FROM events WHERE value > 95 GROUP BY user_id""")
def bit_or_mask(spark, d):
    e = F.col("event_type")
    bit = F.when(e == "signup", 1).when(e == "purchase", 2).when(e == "view", 4).when(e == "click", 8).otherwise(16).cast("long")
    return t(spark, d, "events").filter("value > 95").groupBy("user_id").agg(F.bit_or(bit).alias("mask")).withColumn("bits", F.lpad(F.bin("mask"), 18, "0"))


@register("histogram_fixed", "SELECT CAST(floor(l_extendedprice / 1000) * 1000 AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_fixed(spark, d):
    return t(spark, d, "lineitem").groupBy((F.floor(F.col("l_extendedprice") / 1000) * 1000).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@register("histogram_clamped", """
WITH b AS (SELECT greatest(-1, least(10, CAST(floor((value - 10) / 8) AS BIGINT))) AS bin, count(*) AS n FROM events GROUP BY 1)
SELECT x.bin::BIGINT AS bin, coalesce(n, 0) AS n FROM generate_series(-1, 10) x(bin) LEFT JOIN b ON b.bin = x.bin""")
def histogram_clamped(spark, d):
    """Bins of 8 from 10 to 90; what is under or over goes to the ends, empty bins are shown."""
    bins = t(spark, d, "events").groupBy(F.greatest(F.lit(-1), F.least(F.lit(10), F.floor((F.col("value") - 10) / 8))).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    every = spark.range(-1, 11).select(F.col("id").alias("bin"))
    return every.join(bins, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@register("histogram_variable", """
SELECT CAST(CASE WHEN x <= 150 THEN floor(x) WHEN x <= 1500 THEN floor(x / 10) * 10 ELSE 1510 END AS BIGINT) AS bin, count(*) AS n
FROM (SELECT l_extendedprice / 20 AS x FROM lineitem) GROUP BY 1""")
def histogram_variable(spark, d):
    x = F.col("l_extendedprice") / 20
    bin_ = F.when(x <= 150, F.floor(x)).when(x <= 1500, F.floor(x / 10) * 10).otherwise(1510).cast("long")
    return t(spark, d, "lineitem").groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


@register("histogram_rounded", "SELECT CAST(round_even(l_quantity / 10, 0) * 10 AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_rounded(spark, d):
    return t(spark, d, "lineitem").groupBy((F.bround(F.col("l_quantity") / 10, 0) * 10).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@register("heatmap_2d", "SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS qbin, CAST(floor(l_extendedprice / 10000) AS BIGINT) AS pbin, count(*) AS n FROM lineitem GROUP BY 1, 2")
def heatmap_2d(spark, d):
    return t(spark, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 10).cast("long").alias("qbin"), F.floor(F.col("l_extendedprice") / 10000).cast("long").alias("pbin")).agg(F.count("*").alias("n"))


@register("cumulative_ratio", """
WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_quantity, n, round(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) / sum(n) OVER (PARTITION BY l_returnflag), 6) AS cumulative FROM c""")
def cumulative_ratio(spark, d):
    c = t(spark, d, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    return windows.cumulative(c, ["l_returnflag"], ["l_quantity"], "n").select("l_returnflag", "l_quantity", "n", r(F.col("cumulative")).alias("cumulative"))


@register("reverse_cumulative", """
WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_quantity, n, CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS BIGINT) AS at_least FROM c""")
def reverse_cumulative(spark, d):
    c = t(spark, d, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    return windows.cumulative(c, ["l_returnflag"], ["l_quantity"], "n").select("l_returnflag", "l_quantity", "n", "at_least")


@register("roc_points", """
WITH c AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS q, count(*) FILTER (user_id % 2 = 0) AS a, count(*) FILTER (user_id % 2 = 1) AS b FROM events GROUP BY ALL)
SELECT event_type, q, round(sum(a) OVER w / sum(a + b) OVER (PARTITION BY event_type), 6) AS on_rate, round(sum(b) OVER w / sum(a + b) OVER (PARTITION BY event_type), 6) AS off_rate
FROM c WINDOW w AS (PARTITION BY event_type ORDER BY q DESC)""")
def roc_points(spark, d):
    """Share of each method's rows on and off target at or above each threshold; the denominator is the method's own."""
    c = t(spark, d, "events").groupBy("event_type", F.floor("value").cast("long").alias("q")).agg(F.count_if(F.col("user_id") % 2 == 0).alias("a"), F.count_if(F.col("user_id") % 2 == 1).alias("b"))
    w, whole = Window.partitionBy("event_type").orderBy(F.desc("q")), Window.partitionBy("event_type")
    total = F.sum(F.col("a") + F.col("b")).over(whole)
    return c.select("event_type", "q", r(F.sum("a").over(w) / total).alias("on_rate"), r(F.sum("b").over(w) / total).alias("off_rate"))


@register("pivot_default0", """
SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS "A", count(*) FILTER (l_returnflag = 'N') AS "N", count(*) FILTER (l_returnflag = 'R') AS "R" FROM lineitem GROUP BY l_suppkey""")
def pivot_default0(spark, d):
    return relational.dense_pivot(t(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", ["A", "N", "R"], F.count(F.lit(1)))


@register("rate_by_length", """
SELECT n.n_name, count(*) AS customers, round(count(*) / any_value(length(n.n_name)), 6) AS rate FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name""")
def rate_by_length(spark, d):
    c = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    j = c.join(t(spark, d, "nation"), "n_nationkey")
    return j.select("n_name", "customers", r(F.col("customers") / F.length("n_name")).alias("rate"))


@register("relative_ratio", """
WITH g AS (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, round((n / sum(n) OVER ()) / (q / sum(q) OVER ()), 6) AS ratio FROM g""")
def relative_ratio(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    whole = g.agg(F.sum("n").alias("tn"), F.sum("q").alias("tq"))
    return g.join(F.broadcast(whole)).select("l_suppkey", r((F.col("n") / F.col("tn")) / (F.col("q") / F.col("tq"))).alias("ratio"))


N50 = """
WITH x AS (SELECT p_brand, length(p_name) AS l FROM part), s AS (SELECT {key} l, CAST(sum(l) AS BIGINT) AS s FROM x GROUP BY {key} l),
c AS (SELECT *, sum(s) OVER (PARTITION BY {part} ORDER BY l DESC) AS c, sum(s) OVER (PARTITION BY {part}) AS t FROM s)
SELECT {key} CAST(max(CASE WHEN c >= 0.5 * t THEN l END) AS INTEGER) AS n50, CAST(max(t) AS BIGINT) AS total{n90} FROM c {group}"""


@register("n50", N50.format(key="", part="1", n90="", group=""))
def n50(spark, d):
    return windows.nx(t(spark, d, "part").select(F.length("p_name").alias("l")), [], "l")


@register("n50_n90_by_group", N50.format(key="p_brand,", part="p_brand", n90=", CAST(max(CASE WHEN c >= 0.9 * t THEN l END) AS INTEGER) AS n90", group="GROUP BY p_brand"))
def n50_n90_by_group(spark, d):
    p = t(spark, d, "part").select("p_brand", F.length("p_name").alias("l"))
    return windows.nx(p, ["p_brand"], "l").join(windows.nx(p, ["p_brand"], "l", 0.9, "n90").drop("total"), "p_brand")


@register("weighted_quantiles", """
WITH s AS (SELECT l_quantity AS q, sum(l_extendedprice) AS m FROM lineitem GROUP BY 1), c AS (SELECT q, sum(m) OVER (ORDER BY q) / sum(m) OVER () AS share FROM s)
SELECT CAST(k AS INTEGER) AS k, min(q) AS threshold FROM c, generate_series(10, 90, 10) x(k) WHERE share >= k / 100.0 GROUP BY k""")
def weighted_quantiles(spark, d):
    s = t(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("q")).agg(F.sum("l_extendedprice").alias("m"))
    c = windows.cumulative(s, [], ["q"], "m")
    wide = c.agg(*[F.min(F.when(F.col("cumulative") >= k / 100, F.col("q"))).alias(str(k)) for k in range(10, 100, 10)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("threshold")) for k in range(10, 100, 10)])).alias("x")).select("x.k", "x.threshold")


@register("quantiles_linear", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 4) AS p01, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 1.0), 4) AS p100 FROM lineitem GROUP BY 1""")
def quantiles_linear(spark, d):
    p = F.percentile("l_extendedprice", F.array(F.lit(0.01), F.lit(0.5), F.lit(1.0)))
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(p.alias("p")).select("l_returnflag", *[r(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p01", "p50", "p100"))])


@register("boxplot_summary", """
SELECT event_type, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS high FROM events GROUP BY 1""")
def boxplot_summary(spark, d):
    p = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = t(spark, d, "events").groupBy("event_type").agg(r(F.min("value")).alias("low"), p.alias("p"), r(F.max("value")).alias("high"))
    return g.select("event_type", "low", r(F.col("p")[0]).alias("q1"), r(F.col("p")[1]).alias("median"), r(F.col("p")[2]).alias("q3"), "high")


@register("marginal_counts", """
SELECT 'row' AS side, CAST(user_id AS VARCHAR) AS key, count(DISTINCT event_type) AS n FROM events GROUP BY user_id
UNION ALL SELECT 'column', event_type, count(DISTINCT user_id) FROM events GROUP BY event_type""")
def marginal_counts(spark, d):
    cells = t(spark, d, "events").select("user_id", "event_type").distinct()
    rows = cells.groupBy(F.col("user_id").cast("string").alias("key")).agg(F.count("*").alias("n")).withColumn("side", F.lit("row"))
    return rows.unionByName(cells.groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n")).withColumn("side", F.lit("column"))).select("side", "key", "n")


@register("count_of_counts", "WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS multiplicity FROM lineitem GROUP BY ALL) SELECT multiplicity, count(*) AS n FROM c GROUP BY 1")
def count_of_counts(spark, d):
    return t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("multiplicity")).groupBy("multiplicity").agg(F.count("*").alias("n"))


@register("distinct_with_floor", "SELECT l_suppkey, count(DISTINCT l_partkey) FILTER (l_quantity >= 40) AS n FROM lineitem GROUP BY 1")
def distinct_with_floor(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct(F.when(F.col("l_quantity") >= 40, F.col("l_partkey"))).alias("n"))


@register("identical_profiles", """
WITH p AS (SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, '' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS profile FROM lineitem GROUP BY 1)
SELECT profile, count(*) AS n, min(l_orderkey) AS first, list_sort(list(l_orderkey))[2] AS second FROM p GROUP BY profile""")
def identical_profiles(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("s"))))
    p = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda x: x["s"]), "").alias("profile"))
    # the two least keys of a profile, without gathering a profile's rows: the least, then the least but that
    first = p.groupBy("profile").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first"))
    second = p.join(first.select("profile", "first"), "profile").filter("l_orderkey > first").groupBy("profile").agg(F.min("l_orderkey").alias("second"))
    return first.join(second, "profile", "left").select("profile", "n", "first", "second")


@register("conditional_rate_rollup", """
SELECT CASE WHEN GROUPING(l_linestatus) = 1 THEN '_All_' ELSE l_linestatus END AS base, CAST(floor(l_quantity) AS BIGINT) AS quality,
  round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS rate, count(*) FILTER (l_returnflag <> 'R') AS matches
FROM lineitem GROUP BY GROUPING SETS ((l_linestatus, CAST(floor(l_quantity) AS BIGINT)), (CAST(floor(l_quantity) AS BIGINT))) HAVING count(*) FILTER (l_returnflag <> 'R') > 0""")
def conditional_rate_rollup(spark, d):
    li = t(spark, d, "lineitem").select("l_linestatus", F.floor("l_quantity").cast("long").alias("quality"), "l_returnflag")
    bad = F.count_if(F.col("l_returnflag") == "R")
    agg = lambda g: g.agg(r(bad / F.count("*")).alias("rate"), F.count_if(F.col("l_returnflag") != "R").alias("matches"))
    both = agg(li.groupBy(F.col("l_linestatus").alias("base"), "quality")).unionByName(agg(li.groupBy(F.lit("_All_").alias("base"), "quality")))
    return both.filter("matches > 0").select("base", "quality", "rate", "matches")


@register("prefix_averages", """
WITH a AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS v FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(list_avg(v[1:1]), 6) AS a1, round(list_avg(v[1:3]), 6) AS a3, round(list_avg(v[1:5]), 6) AS a5, round(list_avg(v), 6) AS a_all FROM a""")
def prefix_averages(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity")))
    a = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(rows, lambda x: x["l_quantity"]).alias("v"))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return a.select("l_orderkey", r(mean(F.slice("v", 1, 1))).alias("a1"), r(mean(F.slice("v", 1, 3))).alias("a3"), r(mean(F.slice("v", 1, 5))).alias("a5"), r(mean(F.col("v"))).alias("a_all"))


@register("allele_counts_biallelic", f"""
WITH g AS (SELECT l_suppkey AS pop, l_partkey AS site, l_returnflag AS allele, count(*) AS n FROM lineitem GROUP BY ALL),
k AS (SELECT site FROM g GROUP BY site HAVING count(DISTINCT allele) = 2)
SELECT pop, site, CAST(coalesce(sum(n) FILTER (allele = 'A'), 0) AS BIGINT) AS "A", CAST(coalesce(sum(n) FILTER (allele = 'N'), 0) AS BIGINT) AS "N", CAST(coalesce(sum(n) FILTER (allele = 'R'), 0) AS BIGINT) AS "R"
FROM g WHERE site IN (SELECT site FROM k) GROUP BY pop, site""")
def allele_counts_biallelic(spark, d):
    g = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("pop"), F.col("l_partkey").alias("site"), F.col("l_returnflag").alias("allele"))
    two = g.groupBy("site").agg(F.count_distinct("allele").alias("k")).filter("k = 2").select("site")
    return relational.dense_pivot(g.join(two, "site", "left_semi"), ["pop", "site"], "allele", ["A", "N", "R"], F.count(F.lit(1)))


@register("polymorphic_sites", """
WITH g AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS samples, count(DISTINCT l_returnflag) AS alleles FROM lineitem GROUP BY 1) SELECT count(*) AS sites FROM g WHERE samples >= 2 AND alleles > 1""")
def polymorphic_sites(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("samples"), F.count_distinct("l_returnflag").alias("alleles"))
    return g.filter("samples >= 2 and alleles > 1").agg(F.count("*").alias("sites"))


@register("zone_stats_zero_fill", """
WITH z AS (SELECT user_id, CAST(floor(day(ts) / 5) AS BIGINT) AS zone, sum(value) AS total, count(DISTINCT day(ts)) AS covered FROM events WHERE event_type = 'purchase' GROUP BY ALL),
u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, x.zone::BIGINT AS zone, round(coalesce(total, 0), 4) AS total, coalesce(covered, 0) AS covered, 5 - coalesce(covered, 0) AS uncovered, round(coalesce(total, 0) / 5, 6) AS mean, round(coalesce(covered, 0) / 5, 6) AS ratio
FROM u CROSS JOIN generate_series(0, 6) x(zone) LEFT JOIN z ON z.user_id = u.user_id AND z.zone = x.zone""")
def zone_stats_zero_fill(spark, d):
    e = t(spark, d, "events")
    z = e.filter("event_type = 'purchase'").groupBy("user_id", F.floor(F.dayofmonth("ts") / 5).cast("long").alias("zone")).agg(F.sum("value").alias("total"), F.count_distinct(F.dayofmonth("ts")).alias("covered"))
    users = e.select("user_id").distinct().withColumn("zones", F.lit(7))
    full = windows.with_zero_bins(z.drop("covered"), ["user_id"], users, "zones", "zone", "total").join(z.select("user_id", "zone", "covered"), ["user_id", "zone"], "left")
    c = F.coalesce("covered", F.lit(0))
    return full.select("user_id", "zone", r(F.col("total"), 4).alias("total"), c.alias("covered"), (5 - c).alias("uncovered"), r(F.col("total") / 5).alias("mean"), r(c / 5).alias("ratio"))


@register("normalised_density_2d", """
WITH g AS (SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS x, CAST(floor(l_discount * 50) AS BIGINT) AS y, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT x, y, round(n * (sum(n) OVER (PARTITION BY x)) / nullif((sum(n) OVER (PARTITION BY y)) * (sum(n) OVER ()), 0), 6) AS density FROM g""")
def normalised_density_2d(spark, d):
    g = t(spark, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 10).cast("long").alias("x"), F.floor(F.col("l_discount") * 50).cast("long").alias("y")).agg(F.count("*").alias("n"))
    by = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    return g.select("x", "y", r(F.try_divide((F.col("n") * by("x")).cast("double"), (by("y") * by()).cast("double"))).alias("density"))


@register("dense_alignment", """
WITH s AS (SELECT DISTINCT user_id FROM events), k AS (SELECT DISTINCT event_type FROM events), c AS (SELECT user_id, event_type, CASE WHEN count(*) % 2 = 0 THEN 'E' ELSE 'O' END AS code FROM events WHERE value > 50 GROUP BY ALL)
SELECT s.user_id, string_agg(coalesce(code, '-'), '' ORDER BY k.event_type) AS row, count(code) AS called FROM s CROSS JOIN k LEFT JOIN c ON c.user_id = s.user_id AND c.event_type = k.event_type GROUP BY s.user_id""")
def dense_alignment(spark, d):
    """Samples by sites in one string, absent calls as '-'; a sample's calls are a bounded map, so sites are looked up and never crossed."""
    e = t(spark, d, "events")
    sites = [x[0] for x in e.select("event_type").distinct().orderBy("event_type").collect()]  # the columns of the alignment
    calls = e.groupBy("user_id", "event_type").agg(F.count_if(F.col("value") > 50).alias("n")).withColumn("code", F.when(F.col("n") == 0, None).when(F.col("n") % 2 == 0, "E").otherwise("O"))
    wide = calls.groupBy("user_id").pivot("event_type", sites).agg(F.first("code"))
    return wide.select("user_id", F.concat(*[F.coalesce(F.col(s), F.lit("-")) for s in sites]).alias("row"), sum(F.col(s).isNotNull().cast("long") for s in sites).alias("called"))


@register("token_frequency_topk", """
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) SELECT token, count(*) AS n FROM w GROUP BY token ORDER BY n DESC, token LIMIT 50""")
def token_frequency_topk(spark, d):
    w = t(spark, d, "documents", "text").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("token"))
    return w.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(50)


@register("pattern_occurrences", """
SELECT doc_id, len(regexp_extract_all(text, 'the')) AS n, CASE WHEN len(regexp_extract_all(text, 'the')) > 0 THEN round(length(text) / len(regexp_extract_all(text, 'the')), 4) END AS spacing, strpos(text, 'the')::INTEGER AS first
FROM documents""")
def pattern_occurrences(spark, d):
    n = F.regexp_count("text", F.lit("the"))
    return t(spark, d, "documents").select("doc_id", n.cast("long").alias("n"), F.when(n > 0, r(F.length("text") / n, 4)).alias("spacing"), F.instr("text", "the").alias("first"))


@register("union_of_masks", f"""
WITH g AS (SELECT l_suppkey, {sql_day("l_shipdate")} AS p FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_suppkey, {sql_day("l_shipdate")} FROM lineitem WHERE l_quantity > 45)
SELECT l_suppkey, count(*) AS masked FROM g GROUP BY 1""")
def union_of_masks(spark, d):
    li = t(spark, d, "lineitem")
    parts = [li.filter(c).select("l_suppkey", day("l_shipdate").alias("p")) for c in (F.col("l_returnflag") == "R", F.col("l_quantity") > 45)]
    return parts[0].unionByName(parts[1]).distinct().groupBy("l_suppkey").agg(F.count("*").alias("masked"))


@register("approximate_counter")
def approximate_counter(spark, d):
    """Distinct tokens by a sketch, for streams of keys too many to count exactly; within 5 % of the exact count (tested)."""
    w = t(spark, d, "documents", "text").select(F.explode(F.split("text", r"\s+")).alias("token"))
    return w.agg(F.approx_count_distinct("token", 0.02).alias("tokens"))


@register("composite_topk", "SELECT l_partkey, count(*) AS n, min(l_returnflag) AS flag FROM lineitem GROUP BY 1 ORDER BY n DESC, flag, l_partkey LIMIT 25")
def composite_topk(spark, d):
    return t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.min("l_returnflag").alias("flag")).orderBy(F.desc("n"), "flag", "l_partkey").limit(25)


@register("karyotype_order", """
WITH k AS (SELECT * FROM (VALUES ('view', 0), ('click', 1), ('purchase', 2)) x(event_type, rank)), c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT c.event_type, n, CAST(row_number() OVER (ORDER BY coalesce(rank, 99), c.event_type) AS INTEGER) AS place FROM c LEFT JOIN k ON k.event_type = c.event_type""")
def karyotype_order(spark, d):
    """Order by an external rank; unknown keys last, in lexical order."""
    rank = spark.createDataFrame([("view", 0), ("click", 1), ("purchase", 2)], "event_type string, rank int")
    c = t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).join(F.broadcast(rank), "event_type", "left")
    return c.select("event_type", "n", F.row_number().over(Window.orderBy(F.coalesce("rank", F.lit(99)), "event_type")).alias("place"))


@register("length_then_lexical", """
SELECT n_name, CAST(row_number() OVER (ORDER BY (n_name = 'NATION_0')::INT, length(n_name), n_name) AS INTEGER) AS place FROM nation""")
def length_then_lexical(spark, d):
    return t(spark, d, "nation").select("n_name", F.row_number().over(Window.orderBy(F.col("n_name") == "NATION_0", F.length("n_name"), "n_name")).alias("place"))


@register("sampled_loci", f"SELECT p_partkey FROM part ORDER BY {sql_draw(7, 'p_partkey')}, p_partkey LIMIT 100")
def sampled_loci(spark, d):
    """A hundred parts in a seeded random order of their keys; the limit is the feature."""
    return t(spark, d, "part").select("p_partkey").orderBy(text.draw(7, "p_partkey"), "p_partkey").limit(100)


@register("shuffled_rows", f"SELECT o_orderkey, {sql_draw(11, 'o_orderkey')} AS place FROM orders")
def shuffled_rows(spark, d):
    """All rows in a seeded random order, as a place key that sorts them on any number of executors."""
    return t(spark, d, "orders").select("o_orderkey", text.draw(11, "o_orderkey").alias("place")).orderBy("place", "o_orderkey")
