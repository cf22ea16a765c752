"""The declarative queries as Spark SQL text over registered views: lookups, stabs, containment, updates as new tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.catalog import register
from helixframe.operators import intervals, relational
from helixframe.plans.common import day, sql_day, t
from helixframe.plans.ordered import ORD, SPAN, order_days, spans


def views(spark, d, *names):
    """Registers the tables as views, which stand for created tables and indexes."""
    for n in names:
        t(spark, d, n).createOrReplaceTempView(n)


SCAN = "SELECT p_name, p_brand FROM part WHERE p_type LIKE '%O' ORDER BY p_brand, p_size, p_partkey"


@register("sql_ordered_scan", SCAN)
def sql_ordered_scan(spark, d):
    views(spark, d, "part")
    return spark.sql(SCAN)


FULL = "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderkey ASC"


@register("sql_full_scan_two_keys", FULL)
def sql_full_scan_two_keys(spark, d):
    views(spark, d, "orders")
    return spark.sql(FULL)


LIKE = "SELECT ALL o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '%H%'"


@register("sql_select_all_like", LIKE)
def sql_select_all_like(spark, d):
    views(spark, d, "orders")
    return spark.sql(LIKE)


COUNT = "SELECT l_returnflag, l_linestatus, COUNT(1) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY l_linestatus"


@register("sql_group_count", COUNT)
def sql_group_count(spark, d):
    views(spark, d, "lineitem")
    return spark.sql(COUNT)


@register("sql_update_by_key", "SELECT o_orderkey, CASE WHEN m.l_orderkey IS NULL THEN o_orderstatus ELSE 'frame' || m.k END AS o_orderstatus FROM orders LEFT JOIN (SELECT l_orderkey, count(*) % 3 AS k FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) m ON m.l_orderkey = o_orderkey")
def sql_update_by_key(spark, d):
    """An update is a new table: unchanged rows and the changed values of matched ones."""
    m = t(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count("*") % 3).alias("k"))
    o = t(spark, d, "orders", "o_orderkey", "o_orderstatus").join(m, "o_orderkey", "left")
    return o.select("o_orderkey", F.coalesce(F.concat(F.lit("frame"), F.col("k").cast("string")), "o_orderstatus").alias("o_orderstatus"))


@register("sql_check_only", "WITH x AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem) SELECT CASE WHEN k = l_linenumber THEN 'right' WHEN k < l_linenumber THEN 'ahead' ELSE 'behind' END AS class, count(*) AS n FROM x GROUP BY 1")
def sql_check_only(spark, d):
    views(spark, d, "lineitem")
    return spark.sql("WITH x AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem) SELECT CASE WHEN k = l_linenumber THEN 'right' WHEN k < l_linenumber THEN 'ahead' ELSE 'behind' END AS class, count(*) AS n FROM x GROUP BY 1")


@register("sql_point_stab_distinct", f"WITH o AS ({ORD}), x AS ({SPAN}) SELECT DISTINCT o.o AS point, x.o AS name FROM o JOIN x ON x.c = o.c AND x.s <= o.p AND x.e >= o.p")
def sql_point_stab_distinct(spark, d):
    x = spans(spark, d).withColumnRenamed("o", "name")
    return intervals.range_join(order_days(spark, d), x, ["c"], ("p", "p"), ("s", "e"), 30).select(F.col("o").alias("point"), "name").distinct()


@register("sql_between_lookup", f"WITH o AS ({ORD}), x AS ({SPAN}) SELECT DISTINCT x.o AS scaffold, x.s, x.e FROM x JOIN o ON o.c = x.c AND o.p BETWEEN x.s AND x.e")
def sql_between_lookup(spark, d):
    points = order_days(spark, d).select("c", "p")
    return intervals.range_join(spans(spark, d), points, ["c"], ("s", "e"), ("p", "p"), 30, "left_semi").select(F.col("o").alias("scaffold"), "s", "e").distinct()


@register("sql_reverse_lookup", f"WITH x AS ({SPAN}) SELECT DISTINCT c, s, e FROM x WHERE o IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def sql_reverse_lookup(spark, d):
    f = t(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("o"))
    return spans(spark, d).join(f, "o", "left_semi").select("c", "s", "e").distinct()


@register("sql_containment", f"WITH x AS ({SPAN}) SELECT a.o AS outer_o, b.o AS inner_o FROM x a JOIN x b ON a.c = b.c AND a.o <> b.o AND b.s BETWEEN a.s AND a.e AND b.e BETWEEN a.s AND a.e")
def sql_containment(spark, d):
    x = spans(spark, d)
    b = x.select("c", F.col("o").alias("inner_o"), F.col("s").alias("bs"), F.col("e").alias("be"))
    return intervals.range_join(x, b, ["c"], ("s", "e"), ("bs", "be"), 30).filter("o <> inner_o and bs >= s and be <= e").select(F.col("o").alias("outer_o"), "inner_o")


@register("sql_insert_batches", f"SELECT l_orderkey, l_linenumber, l_partkey, {sql_day('l_shipdate')} AS day FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, {sql_day('l_shipdate')} FROM lineitem WHERE l_returnflag = 'R'")
def sql_insert_batches(spark, d):
    """Inserts are appended batches."""
    li = t(spark, d, "lineitem")
    made = [li.filter(F.col("l_returnflag") == f).select("l_orderkey", "l_linenumber", "l_partkey", day("l_shipdate").alias("day")) for f in "AR"]
    return made[0].unionByName(made[1])


@register("sql_copy_then_modify", "SELECT p_partkey, p_brand, CASE WHEN p_size > 40 THEN 0 ELSE p_size END AS p_size FROM part")
def sql_copy_then_modify(spark, d):
    p = t(spark, d, "part", "p_partkey", "p_brand", "p_size")
    changed = p.filter("p_size > 40").withColumn("p_size", F.lit(0))
    return relational.upsert([p, changed], ["p_partkey"])
