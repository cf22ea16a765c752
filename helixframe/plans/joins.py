"""Equi, outer, semi, anti, theta and fuzzy joins, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.catalog import register
from helixframe.operators import relational, stats
from helixframe.plans.common import day, r, sql_day, t


def flag(spark, d, f):
    return t(spark, d, "lineitem").filter(F.col("l_returnflag") == f).select("l_partkey", "l_suppkey").distinct()


@register("join_last_wins", """
WITH b AS (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1)
SELECT o_orderkey, o_custkey, l_partkey, l_linenumber FROM orders JOIN b ON l_orderkey = o_orderkey""")
def join_last_wins(spark, d):
    """Of several build rows the last by line stands; the rest of both sides are outputs of their own."""
    o = t(spark, d, "orders", "o_orderkey", "o_custkey").withColumnRenamed("o_orderkey", "l_orderkey")
    parts = relational.matched_and_rest(o, t(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey"], [F.asc("l_linenumber"), F.asc("l_partkey")])
    return parts["matched"].withColumnRenamed("l_orderkey", "o_orderkey")


@register("join_left_only", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_left_only(spark, d):
    c = t(spark, d, "customer", "c_custkey", "c_name")
    return relational.matched_and_rest(c, t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), ["c_custkey"])["left_only"]


@register("left_fill_default", """
WITH o AS (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS p FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(CAST(n AS VARCHAR), '.') AS n, coalesce(p, '.') AS priority FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def left_fill_default(spark, d):
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("p"))
    j = t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.coalesce(F.col("n").cast("string"), F.lit(".")).alias("n"), F.coalesce("p", F.lit(".")).alias("priority"))


@register("outer_merge_n_way", """
WITH x AS (SELECT user_id AS u, CAST(floor(value) AS BIGINT) AS p, event_type AS e, max(value) AS v FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL)
SELECT u, p, coalesce(CAST(round(max(v) FILTER (e = 'view'), 2) AS VARCHAR), '.') AS view, coalesce(CAST(round(max(v) FILTER (e = 'click'), 2) AS VARCHAR), '.') AS click,
  coalesce(CAST(round(max(v) FILTER (e = 'purchase'), 2) AS VARCHAR), '.') AS purchase, CAST(sum(CASE e WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 4 END) AS BIGINT) AS mask FROM x GROUP BY u, p""")
def outer_merge_n_way(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("u"), F.floor("value").cast("long").alias("p"), "event_type", F.round("value", 2).alias("v"))
    return relational.outer_merge({k: e.filter(F.col("event_type") == k) for k in ("view", "click", "purchase")}, ["u", "p"], "v", ".")


@register("intersect_merge", """
WITH x AS (SELECT l_partkey, l_returnflag, min(l_linestatus) AS a, max(l_linestatus) AS b FROM lineitem GROUP BY ALL),
j AS (SELECT l_partkey, count(*) AS k, count(DISTINCT a || b) AS d FROM x GROUP BY 1)
SELECT CASE WHEN d = 1 THEN 'AAA' WHEN d = 2 THEN 'AAB' ELSE 'ABC' END AS pattern, count(*) AS n FROM j WHERE k = 3 GROUP BY 1""")
def intersect_merge(spark, d):
    """Keys that all three sets have, by how many of their values agree."""
    x = t(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.concat(F.min("l_linestatus"), F.max("l_linestatus")).alias("v"))
    j = x.groupBy("l_partkey").agg(F.count("*").alias("k"), F.count_distinct("v").alias("d")).filter("k = 3")
    return j.groupBy(F.when(F.col("d") == 1, "AAA").when(F.col("d") == 2, "AAB").otherwise("ABC").alias("pattern")).agg(F.count("*").alias("n"))


@register("full_outer_classify", """
WITH a AS (SELECT l_partkey, max(l_linestatus) AS s FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY 1), b AS (SELECT l_partkey, max(l_linestatus) AS s FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 40 GROUP BY 1)
SELECT CASE WHEN b.l_partkey IS NULL THEN 'left_only' WHEN a.l_partkey IS NULL THEN 'right_only' WHEN a.s = b.s THEN 'same' ELSE 'different' END AS class, count(*) AS n FROM a FULL JOIN b ON a.l_partkey = b.l_partkey GROUP BY 1""")
def full_outer_classify(spark, d):
    pick = lambda f, n: t(spark, d, "lineitem").filter((F.col("l_returnflag") == f) & (F.col("l_quantity") > 40)).groupBy("l_partkey").agg(F.max("l_linestatus").alias(n))
    j = pick("R", "a").join(pick("N", "b"), "l_partkey", "full_outer")
    return j.groupBy(F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").when(F.col("a") == F.col("b"), "same").otherwise("different").alias("class")).agg(F.count("*").alias("n"))


@register("semi_positions", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity = 50)")
def semi_positions(spark, d):
    li = t(spark, d, "lineitem")
    return li.join(li.filter("l_quantity = 50").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@register("anti_positions", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_quantity >= 25 AND k.l_partkey = l.l_partkey AND k.l_suppkey = l.l_suppkey)")
def anti_positions(spark, d):
    li = t(spark, d, "lineitem")
    return li.join(li.filter("l_quantity >= 25").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@register("semi_many_files", "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_many_files(spark, d):
    o = t(spark, d, "orders")
    keys = o.filter("o_orderstatus = 'F'").unionByName(o.filter("o_totalprice > 300000")).select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").join(keys, "c_custkey", "left_semi").agg(F.count("*").alias("n"))


@register("dictionary_join_both_ends", """
SELECT a.n_name AS customer_nation, b.n_name AS supplier_nation, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE a.n_regionkey = b.n_regionkey GROUP BY 1, 2""")
def dictionary_join_both_ends(spark, d):
    """Sums come before the dictionaries: the pair of nation keys is the group, and names join 625 rows at most."""
    li, o = t(spark, d, "lineitem", "l_orderkey", "l_suppkey"), t(spark, d, "orders", "o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(t(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    g = j.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    n = t(spark, d, "nation")
    a, b = (F.broadcast(n.select(F.col("n_nationkey").alias(f"{p}_nationkey"), F.col("n_name").alias(name), F.col("n_regionkey").alias(f"r{p}"))) for p, name in (("c", "customer_nation"), ("s", "supplier_nation")))
    return g.join(a, "c_nationkey").join(b, "s_nationkey").filter("rc = rs").select("customer_nation", "supplier_nation", "n")


@register("completeness_check", """
WITH w AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0), f AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT k, 'lacking' AS status FROM w WHERE k NOT IN (SELECT k FROM f) UNION ALL SELECT k, 'more' FROM f WHERE k NOT IN (SELECT k FROM w)""")
def completeness_check(spark, d):
    return relational.completeness(t(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), t(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@register("positional_zip", """
WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, o_orderkey AS other, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal FROM orders WHERE o_orderstatus <> 'F')
SELECT o_custkey, CAST(ordinal AS INTEGER) AS ordinal, o_orderkey, other FROM a FULL JOIN b USING (o_custkey, ordinal)""")
def positional_zip(spark, d):
    o = t(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus")
    a, b = o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), o.filter("o_orderstatus <> 'F'").select("o_custkey", F.col("o_orderkey").alias("other"))
    return relational.zip_rows(a, b, ["o_orderkey"], ["other"], ["o_custkey"])


@register("positional_base_lookup", "SELECT e.event_id, substring(n.n_name, 1 + CAST(e.event_id % 7 AS INTEGER), 1) AS base FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 25")
def positional_base_lookup(spark, d):
    e = t(spark, d, "events").withColumn("n_nationkey", (F.col("user_id") % 25).cast("int"))
    return e.join(F.broadcast(t(spark, d, "nation")), "n_nationkey").select("event_id", F.substr("n_name", (F.col("event_id") % 7 + 1).cast("int"), F.lit(1)).alias("base"))


@register("theta_self_join", """
SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def theta_self_join(spark, d):
    n = t(spark, d, "nation")
    a, b = n.select("n_regionkey", F.col("n_name").alias("a"), F.col("n_nationkey").alias("ka")), n.select("n_regionkey", F.col("n_name").alias("b"), F.col("n_nationkey").alias("kb"))
    return a.join(b, "n_regionkey").filter("ka < kb").select("a", "b")


CELLS = "WITH g AS (SELECT l_suppkey % 10 AS s, l_partkey AS site, min(l_returnflag) AS v FROM lineitem GROUP BY ALL) "


def cells(spark, d):
    return t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("s"), F.col("l_partkey").alias("site")).agg(F.min("l_returnflag").alias("v"))


@register("all_pairs_mismatch", CELLS + """SELECT x.s AS a, y.s AS b, count(*) AS shared, count(*) FILTER (x.v <> y.v) AS different, round(count(*) FILTER (x.v <> y.v) / count(*), 6) AS rate FROM g x JOIN g y ON x.site = y.site AND x.s < y.s GROUP BY ALL""")
def all_pairs_mismatch(spark, d):
    return stats.pairwise_mismatch(cells(spark, d), ["site"], "s", "v").withColumn("rate", r(F.col("rate")))


@register("concordance_matrix", CELLS + "SELECT x.s AS a, y.s AS b, count(*) FILTER (x.v = y.v) AS same, count(*) AS n FROM g x JOIN g y ON x.site = y.site GROUP BY ALL")
def concordance_matrix(spark, d):
    g = cells(spark, d)
    j = g.select("site", F.col("s").alias("a"), F.col("v").alias("va")).join(g.select("site", F.col("s").alias("b"), F.col("v").alias("vb")), "site")
    return j.groupBy("a", "b").agg(F.count_if(F.col("va") == F.col("vb")).alias("same"), F.count("*").alias("n"))


@register("pdistance", CELLS.replace("min(l_returnflag)", "CASE min(l_returnflag) WHEN 'A' THEN 'A' WHEN 'N' THEN 'R' ELSE 'G' END") + """
SELECT x.s AS a, y.s AS b, count(*) AS loci, round(sum(CASE WHEN x.v = y.v THEN 0.0::DOUBLE WHEN x.v = 'R' OR y.v = 'R' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) / count(*), 6) AS distance FROM g x JOIN g y ON x.site = y.site AND x.s < y.s GROUP BY ALL""")
def pdistance(spark, d):
    code = F.when(F.col("v") == "A", "A").when(F.col("v") == "N", "R").otherwise("G")
    return stats.p_distance(cells(spark, d).withColumn("v", code), ["site"], "s", "v").withColumn("distance", r(F.col("distance")))


@register("trio_join", CELLS + """
SELECT f.c, count(*) AS loci, count(*) FILTER (c.v <> m.v AND c.v <> p.v) AS conflicts FROM (VALUES (0, 1, 2), (3, 4, 5), (6, 7, 8)) f(m, p, c)
JOIN g c ON c.s = f.c JOIN g m ON m.s = f.m AND m.site = c.site JOIN g p ON p.s = f.p AND p.site = c.site GROUP BY f.c""")
def trio_join(spark, d):
    """Loci called in mother, father and child, and those where the child's value is in neither."""
    g = cells(spark, d)
    family = F.broadcast(spark.createDataFrame([(0, 1, 2), (3, 4, 5), (6, 7, 8)], "m int, p int, c int"))
    who = lambda k: g.join(family, g.s == F.col(k)).select("c", "site", F.col("v").alias(f"v{k}")) if k != "c" else g.join(family, g.s == F.col("c")).select("c", "site", F.col("v").alias("vc"))
    j = who("c").join(who("m"), ["c", "site"]).join(who("p"), ["c", "site"])
    return j.groupBy("c").agg(F.count("*").alias("loci"), F.count_if((F.col("vc") != F.col("vm")) & (F.col("vc") != F.col("vp"))).alias("conflicts"))


@register("best_of_small_set", """
WITH c AS (SELECT p_partkey, n_name, levenshtein(lower(p_brand), lower(n_name)) AS score FROM part CROSS JOIN nation) SELECT p_partkey, n_name, CAST(score AS INTEGER) AS score FROM c QUALIFY rank() OVER (PARTITION BY p_partkey ORDER BY score) = 1""")
def best_of_small_set(spark, d):
    """Every row against a fixed list of names, kept in an array so that no product of rows is made; ties stay."""
    names = [x[0] for x in t(spark, d, "nation").select("n_name").orderBy("n_name").collect()]  # the fixed list: 25 nations
    scored = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.struct(F.levenshtein(F.lower("p_brand"), F.lower(n)).alias("score"), n.alias("n_name")))
    p = t(spark, d, "part").select("p_partkey", scored.alias("all")).withColumn("least", F.array_min("all")["score"])
    return p.select("p_partkey", F.explode(F.filter("all", lambda x: x["score"] == F.col("least"))).alias("x")).select("p_partkey", "x.n_name", "x.score")


@register("hamming1_join", """
WITH q AS (SELECT DISTINCT upper(substring(p_name, 1, 4)) AS seen FROM part WHERE length(p_name) >= 4), c AS (SELECT DISTINCT upper(substring(p_name, 1, 4)) AS code FROM part WHERE length(p_name) >= 4 AND p_partkey % 7 = 0),
m AS (SELECT seen, code, hamming(seen, code) AS h FROM q JOIN c ON hamming(seen, code) <= 1)
SELECT q.seen, b.code AS matched_code, CAST(b.h AS INTEGER) AS distance FROM q LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY seen ORDER BY h, code) = 1) b USING (seen)""")
def hamming1_join(spark, d):
    p = t(spark, d, "part").filter("length(p_name) >= 4").select("p_partkey", F.upper(F.substring("p_name", 1, 4)).alias("seen"))
    codes = p.filter("p_partkey % 7 = 0").select(F.col("seen").alias("code")).distinct()
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 _-#"
    return relational.hamming_join(p.select("seen").distinct(), codes, "seen", "code", alphabet).drop("n_codes")


@register("truth_confusion", """
WITH a AS (SELECT l_partkey AS k, min(l_returnflag) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_partkey AS k, min(l_returnflag) AS v FROM lineitem WHERE l_quantity > 30 GROUP BY 1)
SELECT count(*) FILTER (a.v = b.v) AS tp, count(*) FILTER (a.v <> b.v) AS error, count(*) FILTER (a.k IS NULL) AS fp, count(*) FILTER (b.k IS NULL) AS fn FROM a FULL JOIN b ON a.k = b.k""")
def truth_confusion(spark, d):
    li = t(spark, d, "lineitem").withColumnRenamed("l_partkey", "k")
    v = F.min("l_returnflag").alias("v")
    return stats.confusion(li.filter("l_linestatus = 'F'").groupBy("k").agg(v), li.filter("l_quantity > 30").groupBy("k").agg(v), ["k"], "v")


@register("group_anti_flag", """
WITH m AS (SELECT *, CASE WHEN l_suppkey % 10 = 3 THEN 1 ELSE 0 END AS missing FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, CAST(missing AS INTEGER) AS missing FROM m QUALIFY max(missing) OVER (PARTITION BY l_orderkey) = 1""")
def group_anti_flag(spark, d):
    """Groups kept whole if any member is missing from the other table, by a semi-join on the group and not a window over it."""
    li = t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey")
    known = t(spark, d, "lineitem").filter("l_suppkey % 10 <> 3").select("l_suppkey").distinct().withColumn("known", F.lit(1))
    marked = li.join(known, "l_suppkey", "left").withColumn("missing", F.col("known").isNull().cast("int"))
    return marked.join(marked.filter("missing = 1").select("l_orderkey").distinct(), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_suppkey", "missing")


@register("join_with_ordinal", "SELECT o_custkey, c_name, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS n FROM orders JOIN customer ON c_custkey = o_custkey")
def join_with_ordinal(spark, d):
    j = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select("o_custkey", "c_name", "o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("n"))


@register("disagreement_report", """
WITH a AS (SELECT l_orderkey AS k, sum(l_quantity) AS s FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_orderkey AS k, sum(l_quantity) AS s FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
SELECT CASE WHEN b.k IS NULL THEN 'left' WHEN a.k IS NULL THEN 'right' WHEN a.s = b.s THEN 'same' ELSE 'differ' END AS side, count(*) AS n, count(*) FILTER (greatest(coalesce(a.s, 0), coalesce(b.s, 0)) >= 80) AS large FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def disagreement_report(spark, d):
    li = t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k")
    j = li.filter("l_linestatus = 'F'").groupBy("k").agg(F.sum("l_quantity").alias("a")).join(li.filter("l_returnflag <> 'A'").groupBy("k").agg(F.sum("l_quantity").alias("b")), "k", "full_outer")
    side = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").when(F.col("a") == F.col("b"), "same").otherwise("differ")
    return j.groupBy(side.alias("side")).agg(F.count("*").alias("n"), F.count_if(F.greatest("a", "b") >= 80).alias("large"))


@register("membership_flags", """
WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT coalesce(a.k, b.k) AS k, CAST((a.k IS NOT NULL)::INT + 100 * (b.k IS NOT NULL)::INT AS INTEGER) AS flag FROM a FULL JOIN b ON a.k = b.k""")
def membership_flags(spark, d):
    side = lambda f, n, v: t(spark, d, "lineitem").filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"), F.lit(v).alias(n)).distinct()
    j = side("A", "a", 1).join(side("R", "b", 100), "k", "full_outer")
    return j.select("k", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("flag"))


@register("result_diff", """
WITH a AS (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')
SELECT 'left' AS side, l_suppkey, l_partkey FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'right', l_suppkey, l_partkey FROM (FROM b EXCEPT ALL FROM a)""")
def result_diff(spark, d):
    li = t(spark, d, "lineitem")
    a, b = (li.filter(F.col("l_returnflag") == f).select("l_suppkey", "l_partkey") for f in "AR")
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right"))).select("side", "l_suppkey", "l_partkey")


@register("allele_sharing", """
WITH g AS (SELECT l_suppkey AS s, list(DISTINCT l_returnflag || l_linestatus) AS a FROM lineitem WHERE l_quantity > 49 GROUP BY 1)
SELECT x.s AS child, count(*) FILTER (list_has_any(x.a, y.a)) AS shares, count(*) FILTER (NOT list_has_any(x.a, y.a)) AS shares_none FROM g x JOIN g y ON x.s <> y.s GROUP BY 1""")
def allele_sharing(spark, d):
    """Every sample against all others by any common allele, over sites read more than 49 deep: profiles are grouped first, so a sample meets each distinct profile once."""
    g = t(spark, d, "lineitem").filter("l_quantity > 49").groupBy(F.col("l_suppkey").alias("s")).agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("a"))
    profiles = F.broadcast(g.groupBy("a").agg(F.count("*").alias("n")))  # subsets of six values: 63 rows at most
    j = g.select(F.col("s").alias("child"), F.col("a").alias("own")).join(profiles)
    hit = F.arrays_overlap("own", "a")
    return j.groupBy("child").agg((F.sum(F.when(hit, F.col("n")).otherwise(0)) - 1).alias("shares"), F.sum(F.when(hit, 0).otherwise(F.col("n"))).cast("long").alias("shares_none"))


@register("attribute_assembly", """
SELECT c_custkey, c_name, coalesce(n, 0) AS orders, coalesce(open, 0) AS open, round(coalesce(spent, 0), 2) AS spent FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS spent FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS open FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON b.o_custkey = c_custkey""")
def attribute_assembly(spark, d):
    a = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.sum("o_totalprice").alias("spent"))
    j = t(spark, d, "customer").join(a, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", "c_name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("orders", "open")], r(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))


@register("explode_lookup_recollect", """
WITH p AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1), e AS (SELECT l_orderkey, unnest(s) AS k FROM p)
SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS nations FROM e JOIN supplier ON s_suppkey = k JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def explode_lookup_recollect(spark, d):
    p = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s")).select("l_orderkey", F.explode("s").alias("s_suppkey"))
    j = p.join(t(spark, d, "supplier"), "s_suppkey").join(F.broadcast(t(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("nations"))


@register("ordinal_matrix_merge", """
WITH x AS (SELECT l_suppkey, l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_quantity) AS k FROM lineitem)
SELECT l_suppkey, CAST(k AS INTEGER) AS k, max(l_quantity) FILTER (l_returnflag = 'A') AS "A", max(l_quantity) FILTER (l_returnflag = 'N') AS "N", max(l_quantity) FILTER (l_returnflag = 'R') AS "R" FROM x GROUP BY ALL""")
def ordinal_matrix_merge(spark, d):
    w = Window.partitionBy("l_suppkey", "l_returnflag").orderBy("l_orderkey", "l_linenumber", "l_quantity")
    return t(spark, d, "lineitem").withColumn("k", F.row_number().over(w)).groupBy("l_suppkey", "k").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_quantity"))


@register("row_diff_bitmask", """
WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, round(o_totalprice, 0) AS p FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, round(o_totalprice, 0) AS p FROM orders)
SELECT o_orderkey, CAST((a.o_custkey IS DISTINCT FROM b.o_custkey)::INT + 2 * (a.o_orderstatus IS DISTINCT FROM b.o_orderstatus)::INT + 4 * (a.o_orderpriority IS DISTINCT FROM b.o_orderpriority)::INT AS BIGINT) AS mask FROM a JOIN b USING (o_orderkey)""")
def row_diff_bitmask(spark, d):
    a = t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    b = a.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey"))).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return relational.row_difference(a, b, ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"])


@register("sorted_merge", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_totalprice, o_orderkey")
def sorted_merge(spark, d):
    o = t(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    f, p, n = (o.filter(F.col("o_orderstatus") == s) for s in ("F", "P", "O"))
    rest = o.filter(~F.col("o_orderstatus").isin("F", "P", "O"))
    return f.unionByName(p).unionByName(n).unionByName(rest).orderBy("o_totalprice", "o_orderkey")


@register("order_violations", "WITH x AS (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) SELECT count(*) AS violations FROM x WHERE before > o_orderdate")
def order_violations(spark, d):
    x = t(spark, d, "orders").withColumn("before", F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return x.filter("before > o_orderdate").agg(F.count("*").alias("violations"))


@register("self_join_chain", """
SELECT a.n_name AS species, b.n_name AS other, count(*) AS links FROM customer c JOIN nation a ON a.n_nationkey = c.c_nationkey JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation b ON b.n_nationkey = s.s_nationkey JOIN region x ON x.r_regionkey = a.n_regionkey JOIN region y ON y.r_regionkey = b.n_regionkey WHERE x.r_regionkey <> y.r_regionkey GROUP BY 1, 2""")
def self_join_chain(spark, d):
    """Eight tables with the same dimension twice and an inequality between the two uses."""
    n = t(spark, d, "nation").join(F.broadcast(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    a = F.broadcast(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("species"), F.col("r_regionkey").alias("ra")))
    b = F.broadcast(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("other"), F.col("r_regionkey").alias("rb")))
    j = t(spark, d, "customer", "c_custkey", "c_nationkey").join(t(spark, d, "orders", "o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey")).join(t(spark, d, "lineitem", "l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    j = j.join(t(spark, d, "supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("links"))
    return j.join(a, "c_nationkey").join(b, "s_nationkey").filter("ra <> rb").select("species", "other", "links")


@register("three_way_using", "SELECT DISTINCT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def three_way_using(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    return s.join(F.broadcast(t(spark, d, "nation")), "n_nationkey").join(F.broadcast(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").distinct()


@register("small_cross_product", "SELECT r_name, x.i::INTEGER AS i, r_name || '-' || x.i AS label FROM region, generate_series(0, 2) x(i)")
def small_cross_product(spark, d):
    return t(spark, d, "region").select("r_name", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).withColumn("label", F.concat_ws("-", "r_name", F.col("i").cast("string")))


# ---- sets ----


VENN = "WITH s AS (SELECT l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END AS b FROM lineitem), m AS (SELECT {keys}, CAST(bit_or(b) AS BIGINT) AS mask FROM s GROUP BY ALL) "


@register("venn_mask", VENN.format(keys="l_partkey") + "SELECT mask, lpad(to_binary(mask), 3, '0') AS bits, array_to_string(list_filter([CASE WHEN mask & 1 > 0 THEN 'A' END, CASE WHEN mask & 2 > 0 THEN 'N' END, CASE WHEN mask & 4 > 0 THEN 'R' END], lambda x: x IS NOT NULL), '&') AS names, CAST(bit_count(mask) AS INTEGER) AS cardinality, count(*) AS n FROM m GROUP BY mask")
def venn_mask(spark, d):
    return relational.venn_counts({f: flag(spark, d, f) for f in "ANR"}, ["l_partkey"])


@register("venn_mask_value_aware", VENN.format(keys="l_partkey, l_suppkey") + "SELECT mask, count(*) AS n FROM m GROUP BY mask")
def venn_mask_value_aware(spark, d):
    return relational.venn_counts({f: flag(spark, d, f) for f in "ANR"}, ["l_partkey", "l_suppkey"]).select("mask", "n")


@register("set_difference_distinct", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set_difference_distinct(spark, d):
    return flag(spark, d, "A").select("l_partkey").subtract(flag(spark, d, "R").select("l_partkey"))


@register("set_intersection", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set_intersection(spark, d):
    return flag(spark, d, "A").select("l_partkey").intersect(flag(spark, d, "R").select("l_partkey"))


@register("union_all_files", "SELECT 'customer' AS origin, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier")
def union_all_files(spark, d):
    return t(spark, d, "customer").select(F.lit("customer").alias("origin"), F.col("c_name").alias("name")).unionByName(t(spark, d, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_name").alias("name")))


@register("one_row_frames", "SELECT a.n AS orders, b.n AS parts FROM (SELECT count(*) AS n FROM orders) a, (SELECT count(*) AS n FROM part) b")
def one_row_frames(spark, d):
    return t(spark, d, "orders").agg(F.count("*").alias("orders")).join(F.broadcast(t(spark, d, "part").agg(F.count("*").alias("parts"))))


@register("upsert_later_wins", """
WITH u AS (SELECT o_orderkey, o_orderstatus, o_totalprice, 0 AS v FROM orders UNION ALL SELECT o_orderkey, 'U', o_totalprice * 2, 1 FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, 'V', 0.0, 2 FROM orders WHERE o_orderkey % 6 = 0)
SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM u QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY v DESC) = 1""")
def upsert_later_wins(spark, d):
    o = t(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    b = o.filter("o_orderkey % 4 = 0").select("o_orderkey", F.lit("U").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    c = o.filter("o_orderkey % 6 = 0").select("o_orderkey", F.lit("V").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice"))
    return relational.upsert([o, b, c], ["o_orderkey"]).withColumn("o_totalprice", r(F.col("o_totalprice"), 2))


@register("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, d):
    return t(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@register("dedup_first", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) = 1")
def dedup_first(spark, d):
    """The first row of a key by a stated order, as a minimum of structs: partial results shuffle, rows do not."""
    best = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("x"))
    return best.select("l_suppkey", "x.*")


@register("duplicate_reads", "SELECT l_partkey, l_suppkey, min(l_orderkey) AS kept, count(*) - 1 AS removed FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_reads(spark, d):
    return t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("kept"), (F.count("*") - 1).alias("removed")).filter("removed > 0")


@register("exact_dup_groups", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    return t(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@register("near_dup_lsh")
def near_dup_lsh(spark, d):
    """One row a part with its class of near copies by name: MinHash bands, verified pairs, connected components."""
    return relational.near_classes(t(spark, d, "part"), "p_partkey", "p_name")


# ---- shape ----


@register("unpivot_long", """
SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR name IN (l_quantity, l_discount, l_tax))""")
def unpivot_long(spark, d):
    return t(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "name", "value")


@register("transpose", """
WITH g AS (SELECT l_returnflag AS f, count(*)::DOUBLE AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT 'n' AS "column", max(n) FILTER (f = 'A') AS "A", max(n) FILTER (f = 'N') AS "N", max(n) FILTER (f = 'R') AS "R" FROM g UNION ALL SELECT 'q', max(q) FILTER (f = 'A'), max(q) FILTER (f = 'N'), max(q) FILTER (f = 'R') FROM g""")
def transpose(spark, d):
    g = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(F.count("*").cast("double").alias("n"), F.sum("l_quantity").alias("q"))
    return relational.transpose(g, "f", ["n", "q"], ["A", "N", "R"])


@register("co_occurrence", f"""
WITH x AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL""")
def co_occurrence(spark, d):
    return relational.pairs(t(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey")


@register("day_numbers", f"SELECT l_orderkey, l_linenumber, {sql_day('l_shipdate')} AS day FROM lineitem")
def day_numbers(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", day("l_shipdate").alias("day"))
