"""Join, set and reshaping operators that are more than one DataFrame call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: list[str], order: list[Column], mode: str = "first") -> DataFrame:
    """Rows of each key by a stated order: ``first``, ``last``, ``all`` that tie for first, or the first only if it is ``unique``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    if mode == "first":
        return df.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")
    if mode == "last":
        whole = Window.partitionBy(*keys)
        return df.withColumn("__n", F.row_number().over(window)).withColumn("__m", F.count("*").over(whole)).filter("__n = __m").drop("__n", "__m")
    ranked = df.withColumn("__n", F.rank().over(window)).filter("__n = 1").drop("__n")
    if mode == "all":
        return ranked
    return ranked.withColumn("__m", F.count("*").over(Window.partitionBy(*keys))).filter("__m = 1").drop("__m")


def matched_and_rest(left: DataFrame, right: DataFrame, keys: list[str], build_order: list[Column] | None = None) -> dict[str, DataFrame]:
    """``matched``, ``left_only`` and ``right_only`` of an equi-join; with ``build_order`` the last right row of a key stands for it."""
    build = right if build_order is None else one_per_key(right, keys, build_order, "last")
    return {"matched": left.join(build, keys), "left_only": left.join(build, keys, "left_anti"), "right_only": build.join(left, keys, "left_anti")}


def venn(sets: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Each key once with ``mask``: bit i is set if the i-th set has it. One shuffle of all sets together, summed by key first."""
    tagged = [df.select(*keys, F.lit(1 << i).cast("long").alias("mask")) for i, df in enumerate(sets.values())]
    return reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(F.bit_or("mask").alias("mask"))


def venn_counts(sets: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Keys by mask, with the mask in binary, the names in it, and how many."""
    names = list(sets)
    listed = F.array_join(F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull()), "&")
    return venn(sets, keys).groupBy("mask").agg(F.count("*").alias("n")).select("mask", F.lpad(F.bin("mask"), len(names), "0").alias("bits"), listed.alias("names"), F.bit_count("mask").alias("cardinality"), "n")


def outer_merge(sets: dict[str, DataFrame], keys: list[str], value: str, default: str | None = None) -> DataFrame:
    """One row a key with a column for each set, and the mask; the largest value stands for repeats, absent sides get ``default``."""
    tagged = [df.select(*keys, F.lit(n).alias("__s"), F.col(value).alias("__v"), F.lit(1 << i).cast("long").alias("__m")) for i, (n, df) in enumerate(sets.items())]
    wide = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(*[F.max(F.when(F.col("__s") == n, F.col("__v"))).alias(n) for n in sets], F.bit_or("__m").alias("mask"))
    return wide if default is None else wide.select(*keys, *[F.coalesce(F.col(n).cast("string"), F.lit(default)).alias(n) for n in sets], "mask")


def upsert(versions: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in which a later table's row replaces an earlier one's."""
    tagged = reduce(DataFrame.unionByName, [df.withColumn("__v", F.lit(i)) for i, df in enumerate(versions)])
    rest = [c for c in tagged.columns if c not in keys and c != "__v"]
    best = tagged.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__v").alias("__row"))
    return best.select(*[F.col(k) if k in keys else F.col(f"__row.{k}").alias(k) for k in versions[0].columns])


def completeness(wanted: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are ``lacking`` or ``more``."""
    w, f = wanted.select(*keys).distinct(), found.select(*keys).distinct()
    return w.join(f, keys, "left_anti").withColumn("status", F.lit("lacking")).unionByName(f.join(w, keys, "left_anti").withColumn("status", F.lit("more")))


def hamming_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, alphabet: str = "ACGTN") -> DataFrame:
    """Left rows with the right code at a Hamming distance of at most 1: an exact match first, else the least code; null if none.

    Every neighbour of a right code is a row of a table that is as large as the codes times their length, met by an equi-join.
    """
    code = F.col(right_on)
    at = F.explode(F.sequence(F.lit(1), F.length(code)))
    moved = right.select(code.alias("__code"), at.alias("__i")).withColumn("__c", F.explode(F.array(*[F.lit(c) for c in alphabet])))
    near = moved.select("__code", F.overlay("__code", "__c", "__i").alias("__near"), (F.substr(F.col("__code"), F.col("__i"), F.lit(1)) != F.col("__c")).cast("int").alias("__d"))
    best = near.groupBy("__near").agg(F.min(F.struct("__d", "__code")).alias("__b"), F.count_distinct("__code").alias("__n"))
    table = best.select("__near", F.col("__b.__code").alias("matched_code"), F.col("__b.__d").alias("distance"), F.col("__n").alias("n_codes"))
    return left.join(table, F.col(left_on) == F.col("__near"), "left").drop("__near")


def row_difference(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys of both sides with a mask of the columns that differ, null-safe."""
    l, r = left.select(*keys, *[F.col(c).alias(f"__l_{c}") for c in columns]), right.select(*keys, *[F.col(c).alias(f"__r_{c}") for c in columns])
    mask = reduce(lambda a, b: a + b, [F.when(F.col(f"__l_{c}").eqNullSafe(F.col(f"__r_{c}")), 0).otherwise(1 << i) for i, c in enumerate(columns)])
    return l.join(r, keys).select(*keys, mask.cast("long").alias("mask"))


def transpose(df: DataFrame, name: str, columns: list[str], names: list[str]) -> DataFrame:
    """Columns as rows and the rows named ``names`` as columns."""
    long = df.unpivot([name], columns, "column", "value")
    return long.groupBy("column").pivot(name, names).agg(F.first("value"))


def dense_pivot(df: DataFrame, rows: list[str], column: str, values: list, aggregate: Column, default: object = 0) -> DataFrame:
    """Pivot over stated values with absent cells filled."""
    wide = df.groupBy(*rows).pivot(column, values).agg(aggregate)
    return wide.na.fill(default, [str(v) for v in values])


def zip_rows(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], keys: list[str] | None = None) -> DataFrame:
    """The k-th row of each side together, within ``keys``, leftovers kept: an ordinal in a stated order, then a full outer join."""
    keys = keys or []
    number = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return left.withColumn("ordinal", number(left_order)).join(right.withColumn("ordinal", number(right_order)), [*keys, "ordinal"], "full_outer")


def pairs(df: DataFrame, within: list[str], item: str) -> DataFrame:
    """Unordered pairs of different items that occur in the same group, with how often: the group is the join key, pairs are summed as they come."""
    rows = df.select(*within, item).distinct()
    other = rows.withColumnRenamed(item, "__b")
    return rows.join(other, within).filter(F.col(item) < F.col("__b")).groupBy(F.col(item).alias("a"), F.col("__b").alias("b")).agg(F.count("*").alias("n"))


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder (``spark.checkpoint.dir``) where that is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of every node of the edges u, v that is not a root itself.

    A round gives each node's larger neighbours to its least one, then joins its smaller neighbours to the least
    of them; rounds grow with the logarithm of the longest path.
    """
    ordered = lambda df: df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    now = kept(ordered(edges))
    seen = state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ordered(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        now = kept(ordered(small))
        if (new := state(now)) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = new
    raise RuntimeError("components did not settle")


#: 50 bands of 4 MinHash rows: a pair at similarity 0.7 shares no band with probability (1 - 0.7^4)^50 = 1.1e-6.
BANDS, BAND_ROWS = 50, 4


def near_classes(df: DataFrame, key: str, text: str, above: tuple[int, int] = (7, 10)) -> DataFrame:
    """``key`` and ``class`` of every row: rows whose texts are linked by pairs of 3-gram sets with a Jaccard similarity over ``above`` are one class, named by its least key.

    Equal gram sets are one set before any pair is made. Distinct sets meet by bands of MinHash rows, with recall
    0.99999 a pair at 0.7, and every pair that meets is verified on its sets; work is quadratic in the distinct sets
    of one band value. A text of under three characters is its own gram; a null text is a class of its own. ``key``, a long, is unique.
    """
    value = F.col(text)
    grams = F.when(F.length(value) < 3, F.array(value)).otherwise(F.transform(F.sequence(F.lit(1), F.length(value) - 2), lambda i: F.substr(value, i, F.lit(3))))
    rows = df.select(F.col(key).cast("long").alias("__k"), F.array_sort(F.array_distinct(grams)).alias("__g"))
    sets = kept(rows.filter("__g is not null").groupBy("__g").agg(F.min("__k").alias("__s")))
    signature = F.transform(F.sequence(F.lit(0), F.lit(BANDS * BAND_ROWS - 1)), lambda i: F.array_min(F.transform("__g", lambda g: F.xxhash64(g, i))))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("__h", b * BAND_ROWS + 1, F.lit(BAND_ROWS))))
    met = kept(sets.select("__s", signature.alias("__h")).select("__s", F.explode(bands).alias("__b")))
    pairs_met = met.withColumnRenamed("__s", "u").join(met.withColumnRenamed("__s", "v"), "__b").filter("u < v").select("u", "v").distinct()
    sided = lambda n: sets.select(F.col("__s").alias(n), F.col("__g").alias(f"__{n}"))
    both = pairs_met.join(sided("u"), "u").join(sided("v"), "v").withColumn("__i", F.size(F.array_intersect("__u", "__v")))
    near = both.filter(F.col("__i") * above[1] > (F.size("__u") + F.size("__v") - F.col("__i")) * above[0]).select("u", "v")
    named = sets.join(components(near), F.col("__s") == F.col("node"), "left").select(F.col("__g").alias("__o"), F.coalesce("root", "__s").alias("__c"))
    return rows.join(named, F.col("__g") == F.col("__o"), "left").select(F.col("__k").alias(key), F.coalesce("__c", "__k").alias("class"))
