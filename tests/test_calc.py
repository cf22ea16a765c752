"""Each builtin against the value its definition gives."""

import math

import pytest
from pyspark.sql import functions as F

from helixframe.functions.calc import BUILTINS

def A(*x):
    return F.array(*map(F.lit, x))


def cases():
    M = F.array(A(1.0, 2.0), A(3.0, 4.0))
    I2 = F.array(A(1.0, 0.0), A(0.0, 1.0))
    return [
        ("abs", (-3,), 3), ("acos", (0.5,), math.acos(0.5)), ("acosh", (2,), math.acosh(2)), ("acot", (2,), math.atan(0.5)), ("acoth", (2,), math.atanh(0.5)), ("acsc", (2,), math.asin(0.5)), ("acsch", (2,), math.asinh(0.5)),
        ("agd", (0.5,), 2 * math.atanh(math.tan(0.25))), ("append", (A(1, 2), 3, 4), [1, 2, 3, 4]), ("asec", (2,), math.acos(0.5)), ("asech", (0.5,), math.acosh(2)), ("asin", (0.5,), math.asin(0.5)), ("asinh", (2,), math.asinh(2)),
        ("assoc", ("a", 1), {"a": 1}), ("atan", (2,), math.atan(2)), ("atan2", (1, 2), math.atan2(1, 2)), ("atanh", (0.5,), math.atanh(0.5)), ("avg", (A(1, 2, 3, 4, 5),), 3.0), ("base", (255, 16), "FF"), ("base2", (5, 2), "101"),
        ("bernoulli", (4,), -1 / 30), ("bernoulli", (1,), -0.5), ("bit", (5, 2), 1), ("btrunc", (1.2345, 2), 1.0), ("catalan", (10,), 16796), ("ceil", (1.2,), 2), ("cfappr", (math.pi, 1e-2), "22/7"), ("char", (65,), "A"), ("comb", (52, 5), 2598960), ("comb", (5, 7), 0), ("comb", (60, 30), math.comb(60, 30)),
        ("cos", (1,), math.cos(1)), ("cosh", (1,), math.cosh(1)), ("cot", (1,), 1 / math.tan(1)), ("coth", (1,), 1 / math.tanh(1)), ("count", (A(1, 5, 7), lambda x: x > 2), 2), ("cp", (A(1, 0, 0), A(0, 1, 0)), [0, 0, 1]), ("csc", (1,), 1 / math.sin(1)), ("csch", (1,), 1 / math.sinh(1)),
        ("custom", ("upper", "x"), "X"), ("delete", (A(1, 2, 3), 1), [1, 3]), ("den", (0.75,), 4), ("digits", (-12345.6,), 5), ("digits", (255, 2), 8), ("dp", (A(1, 2, 3), A(4, 5, 6)), 32.0), ("euler", (4,), 5), ("euler", (6,), -61), ("euler", (3,), 0), ("eval", ("1 + 2",), 3),
        ("exp", (1,), math.e), ("fact", (10,), 3628800), ("factor", (91,), 7), ("factor", (97,), 97), ("fcnt", (72, 2), 3), ("fib", (50,), 12586269025), ("fib", (-4,), -3), ("floor", (1.8,), 1), ("forall", (A(1, 2), lambda x: x * 2), [2, 4]), ("frac", (-2.25,), -0.25), ("frem", (72, 2), 9),
        ("gcd", (12, 18, 27), 3), ("gcd", (0, 5), 5), ("gcdrem", (72, 6), 1), ("gd", (0.5,), 2 * math.atan(math.tanh(0.25))), ("head", (A(1, 2, 3), 2), [1, 2]), ("head", (A(1, 2, 3), -1), [1, 2]), ("highbit", (37,), 5), ("hmean", (A(1.0, 2.0, 4.0),), 3 / 1.75), ("hypot", (3, 4), 5.0),
        ("ilog", (1000, 10), 3), ("ilog", (999, 10), 2), ("ilog10", (1000000,), 6), ("ilog2", (1023,), 9), ("ilog2", (1024,), 10), ("indices", (F.create_map(F.lit("k"), F.lit(1)),), ["k"]), ("insert", (A(1, 2, 3), 1, 9), [1, 9, 2, 3]), ("int", (-2.7,), -2.0), ("inverse", (4,), 0.25), ("inverse", (0,), None),
        ("iroot", (1000, 3), 10), ("iroot", (999, 3), 9), ("isassoc", (F.create_map(F.lit("k"), F.lit(1)),), True), ("iseven", (-4,), True), ("isident", (I2,), True), ("isident", (M,), False), ("isint", (2.0,), True), ("islist", (A(1),), True), ("ismult", (12, 4), True), ("isnull", (None,), True),
        ("isnum", ("1e-3",), True), ("isnum", ("abc",), False), ("isodd", (-3,), True), ("isprime", (2**31 - 1,), True), ("isprime", (2047,), False), ("isqrt", (99,), 9), ("isreal", (F.lit(1.5),), True), ("isrel", (8, 9), True), ("issq", (144,), True), ("issq", (145,), False), ("issq", (-4,), False), ("isstr", (F.lit("a"),), True),
        ("istype", (F.lit(1), F.lit(2)), True), ("jacobi", (2, 15), 1), ("jacobi", (5, 21), 1), ("join", (A(1), A(2)), [1, 2]), ("lcm", (4, 6, 10), 60), ("lcmfact", (10,), 2520), ("lfactor", (91, 4), 7), ("list", (1, 2), [1, 2]), ("ln", (math.e,), 1.0), ("log", (100,), 2.0), ("lowbit", (40,), 3), ("ltol", (0.6,), 0.8),
        ("makelist", (2,), [None, None]), ("matmax", (M,), 4.0), ("matmin", (M,), 1.0), ("matsum", (M,), 10.0), ("mattrace", (M,), 5.0), ("mattrans", (M,), [[1.0, 3.0], [2.0, 4.0]]), ("max", (1, 5, 3), 5), ("meq", (17, 5, 4), True), ("min", (4, 2, 9), 2), ("minv", (3, 7), 5), ("minv", (2, 4), None), ("mmin", (7, 10), -3), ("mmin", (5, 10), 5),
        ("mne", (17, 6, 4), True), ("modify", (A(1, 2), lambda x: x + 1), [2, 3]), ("near", (1.0, 1.0000001), -1), ("nextprime", (24,), 29), ("norm", (3,), 9), ("null", (), None), ("num", (0.75,), 3), ("ord", (F.lit("A"),), 65), ("perm", (7, 3), 210), ("perm", (7, 0), 1), ("pfact", (10,), 210), ("pi", (), math.pi), ("pix", (100,), 25), ("places", (1.250,), 2),
        ("places", (3,), 0), ("pmod", (3, 200, 13), pow(3, 200, 13)), ("popcnt", (255,), 8), ("power", (2, 10), 1024.0), ("prevprime", (24,), 23), ("prevprime", (2,), None), ("push", (A(3), 2, 1), [1, 2, 3]), ("quo", (7, 2), 3), ("reverse", (A(1, 2),), [2, 1]), ("root", (27, 3), 3.0), ("scale", (3, 4), 48.0), ("sec", (1,), 1 / math.cos(1)),
        ("sech", (1,), 1 / math.cosh(1)), ("segment", (A(1, 2, 3, 4), 1, 2), [2, 3]), ("segment", (A(1, 2, 3, 4), 2, 0), [3, 2, 1]), ("select", (A(1, 2, 3), lambda x: x > 1), [2, 3]), ("sgn", (-2,), -1), ("sha1", ("abc",), "a9993e364706816aba3e25717850c26c9cd0d89d"), ("sin", (1,), math.sin(1)), ("sinh", (1,), math.sinh(1)),
        ("size", (A(1, 2),), 2), ("sizeof", ("é",), 2), ("ssq", (A(1, 2, 3),), 14.0), ("str", (12,), "12"), ("strcat", ("a", "b"), "ab"), ("strcmp", ("a", "b"), -1), ("strcpy", (F.lit("abcdef"), F.lit("XY")), "XYcdef"), ("strlen", (F.lit("abc"),), 3), ("strncmp", (F.lit("abx"), F.lit("aby"), 2), 0), ("strncpy", (F.lit("abcdef"), F.lit("XYZ"), 2), "XYcdef"),
        ("strpos", (F.lit("hello"), "l"), 3), ("strprintf", ("%d-%s", F.lit(1), F.lit("x")), "1-x"), ("strscan", (F.lit("a=12"), r"a=(\d+)"), "12"), ("substr", (F.lit("hello"), 2, 3), "ell"), ("sum", (A(1, 2, 3),), 6.0), ("tail", (A(1, 2, 3), 2), [2, 3]), ("tail", (A(1, 2, 3), -1), [2, 3]), ("tan", (1,), math.tan(1)),
        ("tanh", (1,), math.tanh(1)), ("test", (3,), True), ("trunc", (-1.239, 2), -1.23), ("xor", (5, 3, 1), 7),
    ]



@pytest.fixture(scope="module")
def values(spark):
    return spark.range(1).select(*[BUILTINS[name](*args).alias(f"c{i}") for i, (name, args, _) in enumerate(cases())]).first()


def test_values(values):
    wrong = []
    for i, (name, args, want) in enumerate(cases()):
        got = values[f"c{i}"]
        same = got == pytest.approx(want, rel=1e-12) if isinstance(want, float) and got is not None else got == want
        if not same:
            wrong.append((name, got, want))
    assert not wrong


def test_stateful_and_random_builtins(spark):
    row = spark.range(1).select(
        BUILTINS["pop"](A(1, 2, 3)).alias("pop"), BUILTINS["remove"](A(1, 2, 3)).alias("remove"), BUILTINS["swap"](1, 2).alias("swap"), F.sort_array(BUILTINS["randperm"](A(1, 2, 3), 5)).alias("perm"),
        BUILTINS["randbit"](3).alias("bit"), BUILTINS["randombit"](3).alias("bit2"), BUILTINS["hash"](1, "a").alias("hash"), BUILTINS["time"]().alias("time"), BUILTINS["ctime"]().alias("ctime"), BUILTINS["seed"]().alias("seed"),
    ).first()
    assert tuple(row["pop"]) == (1, [2, 3]) and tuple(row["remove"]) == (3, [1, 2]) and tuple(row["swap"]) == (2, 1)
    assert row["perm"] == [1, 2, 3] and row["bit"] in (0, 1) and row["bit2"] in (0, 1) and row["time"] > 1.6e9


def test_every_mapped_builtin_is_covered(spark):
    tried = {name for name, _, _ in cases()} | {"pop", "remove", "swap", "randperm", "randbit", "randombit", "hash", "time", "ctime", "seed"}
    assert set(BUILTINS) == tried
    assert len(BUILTINS) == 165
