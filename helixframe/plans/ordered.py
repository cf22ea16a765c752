"""Windows, islands, intervals, range and as-of joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.catalog import register
from helixframe.operators import intervals, relational, windows
from helixframe.plans.common import day, r, sql_day, t

#: Ship days of each supplier as positions, and each order's span of ship days as an interval of its customer's.
POS = f"SELECT DISTINCT l_suppkey AS c, {sql_day('l_shipdate')} AS p FROM lineitem"
SPAN = f"SELECT l_suppkey AS c, l_orderkey AS o, {sql_day('min(l_shipdate)')} AS s, {sql_day('max(l_shipdate)')} + 20 AS e FROM lineitem GROUP BY 1, 2"
ORD = f"SELECT o_custkey AS c, o_orderkey AS o, {sql_day('o_orderdate')} AS p FROM orders"


def positions(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_suppkey").alias("c"), day("l_shipdate").alias("p")).distinct()


def spans(spark, d):
    g = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("c"), F.col("l_orderkey").alias("o")).agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    return g.select("c", "o", day("a").alias("s"), (day("b") + 20).alias("e"))


def order_days(spark, d):
    return t(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), day("o_orderdate").alias("p"))


@register("lag_previous", "SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders")
def lag_previous(spark, d):
    return t(spark, d, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("previous"))


@register("adjacent_overlap", f"WITH x AS ({SPAN}), y AS (SELECT *, lag(e) OVER w AS before, lag(o) OVER w AS other FROM x WINDOW w AS (PARTITION BY c ORDER BY s, e, o)) SELECT c, o, other, before - s + 1 AS shared FROM y WHERE before >= s AND other <> o")
def adjacent_overlap(spark, d):
    w = Window.partitionBy("c").orderBy("s", "e", "o")
    y = spans(spark, d).withColumn("before", F.lag("e").over(w)).withColumn("other", F.lag("o").over(w))
    return y.filter("before >= s and other <> o").select("c", "o", "other", (F.col("before") - F.col("s") + 1).alias("shared"))


@register("lag_cumulative_map", """
WITH x AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_discount, least(0.3, l_discount * 2) AS rec, row_number() OVER w AS k FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_discount)),
m AS (SELECT *, CASE WHEN k = 1 THEN 0 ELSE 25 * ln((1 + rec / (1 - rec)) / (1 - rec / (1 - rec))) END AS cm FROM x)
SELECT l_suppkey, CAST(k AS INTEGER) AS k, round(sum(cm) OVER (PARTITION BY l_suppkey ORDER BY k), 4) AS position FROM m""")
def lag_cumulative_map(spark, d):
    """Map distance of adjacent markers by Kosambi's function and their running sum."""
    from helixframe.functions.text import kosambi

    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_discount")
    x = t(spark, d, "lineitem").select("l_suppkey", F.row_number().over(w).alias("k"), F.least(F.lit(0.3), F.col("l_discount") * 2).alias("rec"))
    m = x.withColumn("cm", F.when(F.col("k") == 1, F.lit(0.0)).otherwise(kosambi(F.col("rec"))))
    return m.select("l_suppkey", "k", r(F.sum("cm").over(Window.partitionBy("l_suppkey").orderBy("k")), 4).alias("position"))


@register("phase_recurrence", """
WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS len, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS k FROM lineitem),
y AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM x)
SELECT l_orderkey, CAST(k AS INTEGER) AS k, CAST((3 - b % 3) % 3 AS INTEGER) AS phase FROM y""")
def phase_recurrence(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("len"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity")).alias("k"))
    return windows.phases(x, ["l_orderkey"], ["k"], "len").select("l_orderkey", "k", "phase")


@register("prefix_offsets", "SELECT p_partkey, p_brand, CAST(coalesce(sum(length(p_name) + 20) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM part")
def prefix_offsets(spark, d):
    return windows.prefix_offsets(t(spark, d, "part").withColumn("len", F.length("p_name")), ["p_brand"], ["p_partkey"], "len", 20).select("p_partkey", "p_brand", "offset")


@register("running_sum_between", f"WITH x AS ({POS}), y AS (SELECT c, p, p - lag(p) OVER (PARTITION BY c ORDER BY p) - 1 AS skipped FROM x) SELECT c, p, skipped, CAST(sum(skipped) OVER (PARTITION BY c ORDER BY p) AS BIGINT) AS total FROM y")
def running_sum_between(spark, d):
    w = Window.partitionBy("c").orderBy("p")
    return positions(spark, d).withColumn("skipped", F.col("p") - F.lag("p").over(w) - 1).withColumn("total", F.sum("skipped").over(w))


@register("gaps_islands", f"WITH x AS ({POS}), y AS (SELECT c, p, p - row_number() OVER (PARTITION BY c ORDER BY p) AS g FROM x) SELECT c, min(p) AS first, max(p) AS last, count(*) AS length FROM y GROUP BY c, g")
def gaps_islands(spark, d):
    return intervals.islands(positions(spark, d), ["c"], "p")


@register("char_runs", "WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, 'e+')) AS run FROM documents) SELECT length(run)::INTEGER AS length, count(*) AS n FROM m GROUP BY 1")
def char_runs(spark, d):
    m = t(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("(e+)"), F.lit(1))).alias("run"))
    return m.groupBy(F.length("run").alias("length")).agg(F.count("*").alias("n"))


@register("low_coverage_islands", f"""
WITH x AS (SELECT l_suppkey AS c, {sql_day('l_shipdate')} AS p, count(*) AS n FROM lineitem GROUP BY 1, 2), y AS (SELECT c, p, p - row_number() OVER (PARTITION BY c ORDER BY p) AS g FROM x WHERE n < 2) SELECT c, min(p) AS first, max(p) AS last, count(*) AS length FROM y GROUP BY c, g""")
def low_coverage_islands(spark, d):
    x = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("c"), day("l_shipdate").alias("p")).agg(F.count("*").alias("n"))
    return intervals.islands(x.filter("n < 2"), ["c"], "p")


@register("interval_merge", f"""
WITH x AS ({SPAN}), y AS (SELECT *, max(e) OVER (PARTITION BY c ORDER BY s, e, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x), z AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY s, e, o) AS g FROM y)
SELECT c, min(s) AS s, max(e) AS e, count(*) AS n_merged FROM z GROUP BY c, g""")
def interval_merge(spark, d):
    return intervals.merge(spans(spark, d), ["c"], "s", "e")


STEPS = f"x AS ({SPAN}), v AS (SELECT c, s AS p, 1 AS d FROM x UNION ALL SELECT c, e, -1 FROM x), w AS (SELECT c, p, sum(d) AS d FROM v GROUP BY ALL), k AS (SELECT c, p AS s, sum(d) OVER (PARTITION BY c ORDER BY p) AS depth, lead(p) OVER (PARTITION BY c ORDER BY p) AS e FROM w) "


@register("coverage_depth_hist", "WITH " + STEPS + "SELECT c, CAST(depth AS BIGINT) AS depth, CAST(sum(e - s) AS BIGINT) AS positions FROM k WHERE depth > 0 GROUP BY c, depth")
def coverage_depth_hist(spark, d):
    return intervals.depth_histogram(spans(spark, d), ["c"], "s", "e")


@register("coverage_ge2", "WITH " + STEPS + """, q AS (SELECT *, lag(e) OVER (PARTITION BY c ORDER BY s) AS b FROM k WHERE depth >= 2), z AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY s) AS g FROM q)
SELECT c, min(s) AS s, max(e) AS e FROM z GROUP BY c, g""")
def coverage_ge2(spark, d):
    return intervals.covered(spans(spark, d), ["c"], "s", "e", 2)


@register("interval_complement", f"""
WITH x AS ({SPAN}), y AS (SELECT c, e AS a, lead(s) OVER (PARTITION BY c ORDER BY s) AS b FROM (SELECT c, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY s, e, o) AS g
  FROM (SELECT *, max(e) OVER (PARTITION BY c ORDER BY s, e, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x)) GROUP BY c, g))
SELECT c, a AS s, coalesce(b, 20000) AS e FROM y WHERE coalesce(b, 20000) - a >= 3 UNION ALL SELECT c, 7000, min(s) FROM x GROUP BY c HAVING min(s) - 7000 >= 3""")
def interval_complement(spark, d):
    return intervals.complement(spans(spark, d), ["c"], "s", "e", F.lit(7000).cast("long"), F.lit(20000).cast("long"), 3)


@register("distinct_feature_coverage", "WITH " + STEPS + "SELECT CASE WHEN depth = 1 THEN 'once' ELSE 'more' END AS class, CAST(sum(e - s) AS BIGINT) AS positions FROM k WHERE depth > 0 GROUP BY 1")
def distinct_feature_coverage(spark, d):
    k = intervals.depth_segments(spans(spark, d), ["c"], "s", "e").filter("depth > 0")
    return k.groupBy(F.when(F.col("depth") == 1, "once").otherwise("more").alias("class")).agg(F.sum(F.col("e") - F.col("s")).alias("positions"))


EV = "SELECT user_id AS c, event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS p, CAST(floor(value) AS BIGINT) AS w FROM events"


def ev(spark, d):
    return t(spark, d, "events").select(F.col("user_id").alias("c"), "event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("p"), F.floor("value").cast("long").alias("w"))


@register("range_join_stab", f"""
WITH x AS ({EV}), f AS (SELECT c, event_id AS feature, p - w * 60 AS s, p + w * 60 AS e FROM x WHERE event_type = 'purchase')
SELECT x.event_id, f.feature FROM x JOIN f ON f.c = x.c AND x.p BETWEEN f.s AND f.e WHERE x.event_type = 'click'""")
def range_join_stab(spark, d):
    x = ev(spark, d)
    f = x.filter("event_type = 'purchase'").select("c", F.col("event_id").alias("feature"), (F.col("p") - F.col("w") * 60).alias("s"), (F.col("p") + F.col("w") * 60).alias("e"))
    return intervals.range_join(x.filter("event_type = 'click'"), f, ["c"], ("p", "p"), ("s", "e"), 7200).select("event_id", "feature")


@register("range_join_annotate", f"""
WITH x AS ({EV}), f AS (SELECT DISTINCT c, event_type AS feature, p - w * 30 AS s, p + w * 30 AS e FROM x WHERE event_type IN ('purchase', 'signup'))
SELECT DISTINCT x.event_id, coalesce(f.feature, 'none') AS feature FROM x LEFT JOIN f ON f.c = x.c AND x.p BETWEEN f.s AND f.e WHERE x.event_type = 'view'""")
def range_join_annotate(spark, d):
    """All features over each position, each once; none is a feature of its own."""
    x = ev(spark, d)
    f = x.filter("event_type in ('purchase', 'signup')").select("c", F.col("event_type").alias("feature"), (F.col("p") - F.col("w") * 30).alias("s"), (F.col("p") + F.col("w") * 30).alias("e")).distinct()
    j = intervals.range_join(x.filter("event_type = 'view'"), f, ["c"], ("p", "p"), ("s", "e"), 3600, "left")
    return j.select("event_id", F.coalesce("feature", F.lit("none")).alias("feature")).distinct()


@register("range_join_translate", f"""
WITH o AS ({ORD}), x AS ({SPAN}), b AS (SELECT c % 10 AS c, o AS target, s, e FROM x), m AS (SELECT o.o, o.p, b.target, b.s, b.e FROM (SELECT o, p, c % 10 AS c FROM o) o JOIN b ON b.c = o.c AND o.p BETWEEN b.s AND b.e)
SELECT o, target, 1 + p - s AS target_pos FROM m QUALIFY row_number() OVER (PARTITION BY o ORDER BY s, e, target) = 1""")
def range_join_translate(spark, d):
    o = order_days(spark, d).select("o", "p", (F.col("c") % 10).alias("c"))
    b = spans(spark, d).select((F.col("c") % 10).alias("c"), F.col("o").alias("target"), "s", "e")
    return intervals.translate(o, b, ["c"], "p", "s", "e", "target", 30).select("o", "target", "target_pos")


@register("range_join_aggregate", f"""
WITH x AS ({EV}), f AS (SELECT c, event_id AS feature, p AS s, p + 86400 AS e FROM x WHERE event_type = 'signup')
SELECT feature, count(*) AS n, CAST(sum(x.w) AS BIGINT) AS total FROM x JOIN f ON f.c = x.c AND x.p BETWEEN f.s AND f.e GROUP BY 1""")
def range_join_aggregate(spark, d):
    x = ev(spark, d)
    f = x.filter("event_type = 'signup'").select("c", F.col("event_id").alias("feature"), F.col("p").alias("s"), (F.col("p") + 86400).alias("e"))
    j = intervals.range_join(x.select("c", "p", "w"), f, ["c"], ("p", "p"), ("s", "e"), 86400)
    return j.groupBy("feature").agg(F.count("*").alias("n"), F.sum("w").alias("total"))


@register("range_semi_on_target", f"""
WITH x AS ({EV}), f AS (SELECT c, p FROM x WHERE event_type = 'error') SELECT event_id, EXISTS (SELECT 1 FROM f WHERE f.c = x.c AND abs(f.p - x.p) <= 3600) AS on_target FROM x WHERE event_type = 'view'""")
def range_semi_on_target(spark, d):
    x = ev(spark, d)
    f = x.filter("event_type = 'error'").select("c", F.col("p").alias("q"))
    views = x.filter("event_type = 'view'")
    on = intervals.range_join(views, f, ["c"], ("p", "p"), ("q", "q"), 7200, "left_semi", 3600).select("event_id", F.lit(True).alias("on_target"))
    off = intervals.range_join(views, f, ["c"], ("p", "p"), ("q", "q"), 7200, "left_anti", 3600).select("event_id", F.lit(False).alias("on_target"))
    return on.unionByName(off)


def padded_overlaps(x):
    b = x.select("c", F.col("o").alias("b"), F.col("s").alias("bs"), F.col("e").alias("be"))
    return intervals.range_join(x, b, ["c"], ("s", "e"), ("bs", "be"), 30, "inner", 2).filter("o < b").select(F.col("o").alias("a"), "b")


@register("overlap_padded", f"""
WITH x AS ({SPAN}) SELECT a.o AS a, b.o AS b FROM x a JOIN x b ON a.c = b.c AND a.o < b.o AND a.s - 2 <= b.e AND b.s <= a.e + 2""")
def overlap_padded(spark, d):
    """Overlapping spans of every supplier."""
    return padded_overlaps(spans(spark, d))


def flags_2d(lines):
    """Bit 1 for a neighbour in the first dimension, bit 2 in the second: two one-dimensional semi-joins, never all pairs. A half is rounded to the even neighbour, as SQL's cast does."""
    near = lambda x: F.rint(x).cast("long")
    g = lines.select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("c"), near(F.col("l_quantity")).alias("h"), near(F.col("l_extendedprice") / 1000).alias("v"))
    f = g.filter("o % 5 = 0").select("c", F.col("h").alias("fh"), F.col("v").alias("fv"))
    base = g.join(f.select("c").distinct(), "c", "left_semi").select("o", "c", F.lit(0).alias("bit"))
    hit = lambda a, b, bit: intervals.range_join(g, f.select("c", b).distinct(), ["c"], (a, a), (b, b), 3, "left_semi", 1).select("o", "c", F.lit(bit).alias("bit"))
    return base.unionByName(hit("h", "fh", 1)).unionByName(hit("v", "fv", 2)).groupBy("o", "c").agg(F.bit_or("bit").alias("flag"))


@register("overlap_2d_flags", """
WITH g AS (SELECT l_orderkey AS o, l_suppkey AS c, CAST(l_quantity AS BIGINT) AS h, CAST(l_extendedprice / 1000 AS BIGINT) AS v FROM lineitem), f AS (SELECT c, h, v FROM g WHERE o % 5 = 0)
SELECT g.o, g.c, CAST(max(CASE WHEN abs(g.h - f.h) <= 1 THEN 1 ELSE 0 END) + 2 * max(CASE WHEN abs(g.v - f.v) <= 1 THEN 1 ELSE 0 END) AS INTEGER) AS flag FROM g JOIN f ON f.c = g.c GROUP BY g.o, g.c""")
def overlap_2d_flags(spark, d):
    """Flags of every supplier's lines; o % 5 = 0 makes the second table."""
    return flags_2d(t(spark, d, "lineitem"))


@register("band_anti_join", f"""
WITH o AS ({ORD}), x AS (SELECT l_suppkey % 150 AS c, {sql_day('l_shipdate')} AS p FROM lineitem WHERE l_returnflag = 'R') SELECT o, c, p FROM o WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.c = o.c AND abs(x.p - o.p) <= 4)""")
def band_anti_join(spark, d):
    x = t(spark, d, "lineitem").filter("l_returnflag = 'R'").select((F.col("l_suppkey") % 150).alias("c"), day("l_shipdate").alias("q"))
    return intervals.band_anti_join(order_days(spark, d), x, ["c"], "p", "q", 4).select("o", "c", "p")


@register("band_join_both_outputs", f"""
WITH o AS ({ORD}), x AS (SELECT c, p AS q, o AS other FROM o WHERE o % 7 = 0) SELECT o.o, x.other FROM o LEFT JOIN x ON x.c = o.c AND abs(x.q - o.p) <= 10""")
def band_join_both_outputs(spark, d):
    o = order_days(spark, d)
    x = o.filter("o % 7 = 0").select("c", F.col("p").alias("q"), F.col("o").alias("other"))
    return intervals.range_join(o, x, ["c"], ("p", "p"), ("q", "q"), 21, "left", 10).select("o", "other")


@register("range_frame_count", f"WITH x AS (SELECT l_suppkey AS c, {sql_day('l_shipdate')} AS p, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT c, p, CAST(sum(n) OVER (PARTITION BY c ORDER BY p RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS BIGINT) AS near FROM x")
def range_frame_count(spark, d):
    x = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("c"), day("l_shipdate").alias("p")).agg(F.count("*").alias("n"))
    return x.select("c", "p", F.sum("n").over(Window.partitionBy("c").orderBy("p").rangeBetween(-4, 4)).alias("near"))


@register("range_min_query", f"WITH x AS (SELECT l_suppkey AS c, {sql_day('l_shipdate')} AS p, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT c, p, min(q) OVER (PARTITION BY c ORDER BY p RANGE BETWEEN 30 PRECEDING AND CURRENT ROW) AS least FROM x")
def range_min_query(spark, d):
    x = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("c"), day("l_shipdate").alias("p")).agg(F.min("l_quantity").alias("q"))
    return x.select("c", "p", F.min("q").over(Window.partitionBy("c").orderBy("p").rangeBetween(-30, 0)).alias("least"))


@register("asof_backward", f"""
WITH o AS ({ORD}), x AS (SELECT l_suppkey AS c, {sql_day('l_shipdate')} AS q, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT o.o, o.c, max(x.q) AS backward_q, arg_max(x.v, x.q) AS backward_v FROM o LEFT JOIN x ON x.c = o.c AND x.q <= o.p GROUP BY 1, 2""")
def asof_backward(spark, d):
    x = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("c"), day("l_shipdate").alias("q")).agg(F.max("l_quantity").alias("v"))
    return intervals.asof(order_days(spark, d), x, ["c"], "p", "q", ["v"]).select("o", "c", "backward_q", "backward_v")


@register("nearest_both_sides", f"""
WITH o AS ({ORD}), x AS ({POS}) SELECT o.o, o.c, max(x.p) FILTER (x.p <= o.p) AS backward_q, min(x.p) FILTER (x.p >= o.p) AS forward_q FROM o LEFT JOIN x ON x.c = o.c GROUP BY 1, 2""")
def nearest_both_sides(spark, d):
    x = positions(spark, d).select("c", F.col("p").alias("q"), F.lit(1).alias("v"))
    both = intervals.asof(intervals.asof(order_days(spark, d), x, ["c"], "p", "q", ["v"]), x, ["c"], "p", "q", ["v"], "forward")
    return both.select("o", "c", "backward_q", "forward_q")


@register("next_zone_lookup", f"WITH o AS ({ORD}), x AS ({POS}) SELECT o.o, min(x.p) FILTER (x.p > o.p AND x.p <= o.p + 90) AS next FROM o LEFT JOIN x ON x.c = o.c GROUP BY 1")
def next_zone_lookup(spark, d):
    x = positions(spark, d).select("c", F.col("p").alias("q"), F.lit(1).alias("v"))
    j = intervals.asof(order_days(spark, d), x, ["c"], "p", "q", ["v"], "forward", strict=True)
    return j.select("o", F.when(F.col("forward_q") <= F.col("p") + 90, F.col("forward_q")).alias("next"))


@register("linear_interpolate", f"""
WITH o AS ({ORD}), x AS (SELECT c, p, row_number() OVER (PARTITION BY c ORDER BY p) AS y FROM ({POS})),
b AS (SELECT o.o, o.p, max(x.p) FILTER (x.p <= o.p) AS x0, max(x.y) FILTER (x.p <= o.p) AS y0, min(x.p) FILTER (x.p >= o.p) AS x1, min(x.y) FILTER (x.p >= o.p) AS y1 FROM o JOIN x ON x.c = o.c GROUP BY 1, 2)
SELECT o, round(CASE WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (p - x0) / (x1 - x0) END, 6) AS y FROM b WHERE x0 IS NOT NULL AND x1 IS NOT NULL""")
def linear_interpolate(spark, d):
    from helixframe.functions.text import interpolate

    x = positions(spark, d).select("c", F.col("p").alias("q"), F.row_number().over(Window.partitionBy("c").orderBy("p")).alias("y"))
    both = intervals.asof(intervals.asof(order_days(spark, d), x, ["c"], "p", "q", ["y"]), x, ["c"], "p", "q", ["y"], "forward").filter("backward_q is not null and forward_q is not null")
    return both.select("o", r(interpolate(F.col("p"), F.col("backward_q"), F.col("backward_y").cast("double"), F.col("forward_q"), F.col("forward_y").cast("double"))).alias("y"))


@register("forward_fill_asof", """
WITH x AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN event_id END AS s FROM events) SELECT user_id, event_id, last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS filled FROM x""")
def forward_fill_asof(spark, d):
    x = t(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("s"))
    return windows.forward_fill(x, ["user_id"], ["event_id"], "s").drop("s")


# ---- first, best, budgets, ranks ----

TIES = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@register("top1_composite", "SELECT l_orderkey, l_quantity, l_extendedprice, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice, l_partkey, l_suppkey) = 1")
def top1_composite(spark, d):
    best = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct((-F.col("l_quantity")).alias("q"), "l_extendedprice", "l_partkey", "l_suppkey")).alias("x"))
    return best.select("l_orderkey", (-F.col("x.q")).alias("l_quantity"), "x.l_extendedprice", "x.l_partkey")


@register("unique_best", """
WITH a AS (SELECT * FROM lineitem QUALIFY rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_discount) = 1) SELECT l_suppkey, l_orderkey, l_partkey FROM a QUALIFY count(*) OVER (PARTITION BY l_suppkey) = 1""")
def unique_best(spark, d):
    return relational.one_per_key(t(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_quantity"), F.asc("l_discount")], "unique").select("l_suppkey", "l_orderkey", "l_partkey")


@register("argmax_ties_kept", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) = 1")
def argmax_ties_kept(spark, d):
    return relational.one_per_key(t(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_quantity")], "all").select("l_suppkey", "l_orderkey", "l_linenumber")


@register("group_conditional_keep", f"""
WITH m AS (SELECT *, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS has, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag <> 'R')::INT, l_linenumber, l_partkey) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey FROM m WHERE has = 0 OR k = 1""")
def group_conditional_keep(spark, d):
    """If any row of a group is returned only the first such one stays, else all stay."""
    whole = Window.partitionBy("l_orderkey")
    m = t(spark, d, "lineitem").withColumn("has", F.max((F.col("l_returnflag") == "R").cast("int")).over(whole)).withColumn("k", F.row_number().over(whole.orderBy(F.col("l_returnflag") != "R", "l_linenumber", "l_partkey")))
    return m.filter("has = 0 or k = 1").select("l_orderkey", "l_linenumber", "l_partkey")


@register("group_predicate_keep", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY max(l_quantity) OVER (PARTITION BY l_orderkey) >= 45 AND max(l_discount) OVER (PARTITION BY l_orderkey) >= 0.09")
def group_predicate_keep(spark, d):
    li = t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    good = li.groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("x")).filter("q >= 45 and x >= 0.09").select("l_orderkey")
    return li.join(good, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@register("take_until_budget", """
WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM orders) SELECT o_custkey, o_orderkey FROM x WHERE b < 400000""")
def take_until_budget(spark, d):
    return windows.take_until(t(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"], "o_totalprice", 400000).select("o_custkey", "o_orderkey")


@register("first_n_valid", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 30 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) <= 5")
def first_n_valid(spark, d):
    li = t(spark, d, "lineitem").filter("l_quantity > 30")
    return li.withColumn("k", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey"))).filter("k <= 5").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@register("avg_tie_rank", """
WITH x AS (SELECT n_regionkey, c_custkey, round(c_acctbal / 1000, 0) AS b FROM customer JOIN nation ON n_nationkey = c_nationkey), y AS (SELECT *, rank() OVER (PARTITION BY n_regionkey ORDER BY b) AS r, count(*) OVER (PARTITION BY n_regionkey, b) AS n FROM x)
SELECT n_regionkey, c_custkey, r + (n - 1) / 2.0::DOUBLE AS rank FROM y""")
def avg_tie_rank(spark, d):
    x = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "c_custkey", F.round(F.col("c_acctbal") / 1000, 0).alias("b"))
    return windows.average_rank(x, ["n_regionkey"], "b").select("n_regionkey", "c_custkey", "rank")


@register("qq_transform", "SELECT event_type, event_id, round(-log10(row_number() OVER w / count(*) OVER (PARTITION BY event_type)), 6) AS expected FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)")
def qq_transform(spark, d):
    e = t(spark, d, "events", "event_type", "event_id", "value")
    ranked = windows.running_sums(e, ["event_type"], "value", F.lit(1), ties=["event_id"], out="k")
    n = F.broadcast(e.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n")))  # the five kinds of event
    return ranked.join(n, F.col("event_type") == F.col("kind")).select("event_type", "event_id", r(-F.log10(F.col("k") / F.col("n"))).alias("expected"))


@register("equal_count_zones", """
WITH x AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events), z AS (SELECT *, least((k - 1) // greatest(1, n // 10), 9) AS zone FROM x)
SELECT event_type, CAST(zone AS INTEGER) AS zone, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM z GROUP BY 1, 2""")
def equal_count_zones(spark, d):
    z = windows.equal_zones(t(spark, d, "events", "event_type", "event_id"), ["event_type"], "event_id", 10)
    return z.groupBy("event_type", "zone").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count("*").alias("n"))


@register("moving_avg_last10", "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS moving FROM events WHERE event_type <> 'error'")
def moving_avg_last10(spark, d):
    x = t(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return windows.moving_average(x, ["user_id"], ["event_id"], "v").select("user_id", "event_id", r(F.col("moving")).alias("moving"))


@register("exclusive_prefix_share", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(coalesce(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(l_quantity) OVER (PARTITION BY l_suppkey), 6) AS share FROM lineitem")
def exclusive_prefix_share(spark, d):
    x = windows.exclusive_share(t(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey"], "l_quantity")
    return x.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", r(F.col("share")).alias("share"))


@register("tumbling_position", "SELECT user_id, CAST(floor((event_id - 1) / 100) AS BIGINT) AS bin, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_position(spark, d):
    return windows.tumbling(t(spark, d, "events"), ["user_id"], "event_id", 100, [r(F.avg("value")).alias("mean"), F.count("*").alias("n")])


@register("tumbling_with_zero_bins", """
WITH c AS (SELECT user_id, day(ts) - 1 AS bin, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL), u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, x.bin::BIGINT AS bin, coalesce(n, 0) AS n FROM u CROSS JOIN generate_series(0, 29) x(bin) LEFT JOIN c ON c.user_id = u.user_id AND c.bin = x.bin""")
def tumbling_with_zero_bins(spark, d):
    e = t(spark, d, "events")
    c = e.filter("event_type = 'error'").groupBy("user_id", (F.dayofmonth("ts") - 1).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return windows.with_zero_bins(c, ["user_id"], e.select("user_id").distinct().withColumn("bins", F.lit(30)), "bins", "bin", "n")


@register("sliding_distance", f"WITH x AS (SELECT l_suppkey AS c, {sql_day('l_shipdate')} AS p, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT c, p, round(sum(q) OVER (PARTITION BY c ORDER BY p RANGE BETWEEN 29 PRECEDING AND CURRENT ROW), 4) AS total FROM x")
def sliding_distance(spark, d):
    x = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("c"), day("l_shipdate").alias("p")).agg(F.sum("l_quantity").alias("q"))
    return windows.sliding(x, ["c"], "p", 30, {"total": F.sum("q")}).select("c", "p", r(F.col("total"), 4).alias("total"))


@register("sliding_ratio_class", """
WITH x AS (SELECT user_id, event_id, avg((value >= 50)::INT::DOUBLE) OVER w AS g, avg((value BETWEEN 25 AND 75)::INT::DOUBLE) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, CAST((g >= 0.5)::INT + 2 * (m >= 0.5)::INT AS INTEGER) AS klass FROM x""")
def sliding_ratio_class(spark, d):
    return windows.sliding_class(t(spark, d, "events"), ["user_id"], "event_id", F.col("value") >= 50, F.col("value").between(25, 75), 7).select("user_id", "event_id", "klass")


@register("zone_means_50", f"""
WITH x AS (SELECT l_suppkey AS c, {sql_day('l_shipdate')} AS p, l_quantity AS q FROM lineitem), b AS (SELECT c, min(p) AS a, max(p) AS z FROM x GROUP BY 1)
SELECT x.c, CAST(floor((p - a) / greatest(1, ceil((z - a + 1) / 50))) AS BIGINT) AS zone, round(avg(q), 6) AS mean, count(*) AS n FROM x JOIN b ON b.c = x.c GROUP BY 1, 2""")
def zone_means_50(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("c"), day("l_shipdate").alias("p"), F.col("l_quantity").alias("q"))
    b = x.groupBy("c").agg(F.min("p").alias("a"), F.max("p").alias("z"))
    return windows.zones(x.join(b, "c"), ["c"], "p", "a", "z", "q").withColumn("mean", r(F.col("mean")))


@register("regime_changes", f"""
WITH x AS (SELECT user_id, event_id, (value >= 50)::INT AS s FROM events), n AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS k FROM x), g AS (SELECT *, sum(k) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM n),
u AS (SELECT user_id, any_value(s) AS s, min(event_id) AS a, max(event_id) AS z, count(*) AS len FROM g GROUP BY user_id, g), l AS (SELECT *, lag(s) OVER w AS previous, lag(z) OVER w AS left_end FROM u WHERE len >= 3 WINDOW w AS (PARTITION BY user_id ORDER BY a))
SELECT user_id, CAST(previous AS INTEGER) AS previous, CAST(s AS INTEGER) AS now, left_end AS "left", a AS "right", (left_end + a) / 2.0::DOUBLE AS middle, a - left_end AS gap FROM l WHERE previous IS NOT NULL AND previous <> s""")
def regime_changes(spark, d):
    x = t(spark, d, "events").select("user_id", "event_id", (F.col("value") >= 50).cast("int").alias("s"))
    return windows.regimes(x, ["user_id"], "event_id", "s", 3)


@register("ordered_lookup_asc_desc", """
SELECT o_orderkey, o_orderpriority, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN -l_linenumber ELSE l_linenumber END, l_partkey) AS INTEGER) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def ordered_lookup_asc_desc(spark, d):
    """Rows of each outer row, ascending or descending by its strand."""
    j = t(spark, d, "orders", "o_orderkey", "o_orderpriority").join(t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    sign = F.when(F.col("o_orderpriority").like("1%"), -1).otherwise(1)
    return j.select("o_orderkey", "o_orderpriority", "l_linenumber", "l_partkey", F.row_number().over(Window.partitionBy("o_orderkey").orderBy(F.col("l_linenumber") * sign, "l_partkey")).alias("k"))


@register("fewest_switches")
def fewest_switches(spark, d):
    """Path of fewest changes through each order's allowed states; brute force in tests."""
    lines = t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").repartition("l_orderkey")  # one shuffle serves the sets and the series
    x = lines.groupBy("l_orderkey", "l_linenumber").agg(F.sort_array(F.collect_set("l_returnflag")).alias("options"))
    return windows.fewest_switches(x, ["l_orderkey"], "l_linenumber", "options")


@register("hmm_decode")
def hmm_decode(spark, d):
    x = t(spark, d, "events").select("user_id", "event_id", "event_type")
    emit = [{"view": 0.5, "click": 0.3, "signup": 0.1, "purchase": 0.05, "error": 0.05}, {"view": 0.2, "click": 0.2, "signup": 0.1, "purchase": 0.4, "error": 0.1}]
    return windows.hmm(x, ["user_id"], "event_id", "event_type", [0.6, 0.4], [[0.9, 0.1], [0.2, 0.8]], emit).withColumn("posterior", r(F.col("posterior")))


@register("neighbourhood_fill")
def neighbourhood_fill(spark, d):
    x = t(spark, d, "lineitem").groupBy((F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 40).alias("y")).agg(F.sum(F.when(F.col("l_quantity") > 49, F.col("l_quantity")).otherwise(0.0)).alias("v"))
    return windows.neighbourhood_fill(x, "x", "y", "v").withColumn("v", r(F.col("v")))
