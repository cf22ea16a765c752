"""Calculator builtins as column functions.

``BUILTINS`` maps each name to a function from columns to a column. Values are
doubles or 64-bit integers; results that would need more are null. Number
theory that no expression covers runs in pandas UDFs over whole batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 2**63 - 1


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _d(x) -> Column:
    return col(x).cast("double")


def _l(x) -> Column:
    return col(x).cast("long")


def _inv(x) -> Column:
    return F.try_divide(F.lit(1.0), _d(x))


def _whole(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x))


# ---- numbers -------------------------------------------------------------------------------------------------------


def int_part(x) -> Column:
    """Towards zero."""
    return _whole(_d(x))


def trunc(x, places=0) -> Column:
    unit = F.pow(F.lit(10.0), _d(places))
    return _whole(_d(x) * unit) / unit


def btrunc(x, places=0) -> Column:
    unit = F.pow(F.lit(2.0), _d(places))
    return _whole(_d(x) * unit) / unit


def gcd(*xs) -> Column:
    """Euclid's steps as a fold; 92 of them reach the end for any two 64-bit integers."""

    def two(a: Column, b: Column) -> Column:
        start = F.struct(F.abs(_l(a)).alias("a"), F.abs(_l(b)).alias("b"))
        step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, F.lit(1).cast("long")).otherwise(s["b"])).alias("b")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"]

    out = F.abs(_l(xs[0]))
    for x in xs[1:]:
        out = two(out, x)
    return out


def lcm(*xs) -> Column:
    out = F.abs(_l(xs[0]))
    for x in xs[1:]:
        g = gcd(out, x)
        out = F.when(g == 0, F.lit(0).cast("long")).otherwise(F.floor(out / F.when(g == 0, F.lit(1)).otherwise(g)).cast("long") * F.abs(_l(x)))
    return out


def fact(n) -> Column:
    return F.factorial(_l(n).cast("int"))


def comb(n, k) -> Column:
    """Binomial coefficient as a fold over the shorter side, exact in decimals."""
    n, k = _l(n), _l(k)
    short = F.least(k, n - k)
    steps = F.when(short >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(short, F.lit(1).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    value = F.aggregate(steps, F.lit(1).cast("decimal(38,0)"), lambda a, i: F.floor((a * (n - short + i)).cast("decimal(38,0)") / i).cast("decimal(38,0)"))
    return F.when((k < 0) | (k > n), F.lit(0).cast("decimal(38,0)")).otherwise(value)


def perm(n, k) -> Column:
    n, k = _l(n), _l(k)
    steps = F.when(k >= 1, F.sequence(n - k + 1, F.greatest(n, n - k + 1))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.lit(1).cast("long"), lambda a, i: a * i)


def iroot(x, n) -> Column:
    """The largest whole r with r ** n at most x; the float's guess is put right by one."""
    x, n = _l(x), _l(n)
    guess = F.floor(F.pow(x.cast("double"), F.lit(1.0) / n)).cast("long")

    def powered(r: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1).cast("long"), n), F.lit(1).cast("decimal(38,0)"), lambda a, _: (a * r).cast("decimal(38,0)"))

    up, down = guess + 1, guess - 1
    return F.when(powered(up) <= x, up).when(powered(guess) <= x, guess).otherwise(down)


def isqrt(x) -> Column:
    return iroot(x, 2)


def highbit(x) -> Column:
    return F.length(F.bin(F.abs(_l(x)))) - 1


def lowbit(x) -> Column:
    digits = F.bin(_l(x))
    return F.length(digits) - F.length(F.regexp_replace(digits, "0+$", ""))


def ilog(x, b) -> Column:
    """Floor of the logarithm to a whole base, put right by one where the float rounds over a power."""
    x, b = _l(x), _l(b)
    guess = F.floor(F.ln(x.cast("double")) / F.ln(b.cast("double"))).cast("long")
    power = lambda e: F.aggregate(F.when(e > 0, F.sequence(F.lit(1).cast("long"), e)).otherwise(F.array().cast("array<bigint>")), F.lit(1).cast("decimal(38,0)"), lambda a, _: (a * b).cast("decimal(38,0)"))
    return F.when(power(guess + 1) <= x, guess + 1).when(power(guess) <= x, guess).otherwise(guess - 1)


def digits(x, b=10) -> Column:
    whole = F.abs(_whole(_d(x))).cast("long")
    return F.length(F.conv(whole.cast("string"), 10, b)) if not isinstance(b, Column) else F.length(whole.cast("string"))


def places(x) -> Column:
    """Decimal places of a number in its shortest form."""
    text = F.regexp_replace(_d(x).cast("decimal(38,12)").cast("string"), "0+$", "")
    return F.greatest(F.lit(0), F.length(text) - F.instr(text, "."))


def hmean(values) -> Column:
    """Of an array: its size over the sum of reciprocals."""
    return F.try_divide(F.size(values).cast("double"), F.aggregate(values, F.lit(0.0), lambda a, x: a + F.try_divide(F.lit(1.0), x.cast("double"))))


def _fold(values, start, step) -> Column:
    return F.aggregate(col(values), start, step)


def avg(values) -> Column:
    return F.try_divide(_fold(values, F.lit(0.0), lambda a, x: a + x.cast("double")), F.size(values).cast("double"))


def mmin(x, m) -> Column:
    """Residue of least absolute value; half goes to the positive one."""
    r = F.pmod(_l(x), _l(m))
    return F.when(r * 2 > _l(m), r - _l(m)).otherwise(r)


# ---- number theory in batches --------------------------------------------------------------------------------------


def _batched(f: Callable, kind: T.DataType) -> Callable[..., Column]:
    """A pandas UDF of a function of whole numbers; nulls and results beyond 64 bits are null."""

    @F.pandas_udf(kind)
    def one(x: pd.Series) -> pd.Series:
        return pd.Series([safe(a) for a in x], dtype="object")

    @F.pandas_udf(kind)
    def two(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([safe(a, b) for a, b in zip(x, y, strict=True)], dtype="object")

    @F.pandas_udf(kind)
    def three(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([safe(a, b, c) for a, b, c in zip(x, y, z, strict=True)], dtype="object")

    def safe(*args):
        if any(a is None or a != a for a in args):
            return None
        out = f(*map(int, args))
        return None if out is None or (not isinstance(out, (float, str)) and abs(out) > LIMIT) else out

    by_count = {1: one, 2: two, 3: three}
    return lambda *xs: by_count[len(xs)](*[_l(x) for x in xs])


def prime(n: int) -> bool:
    """Deterministic Miller-Rabin for 64 bits."""
    if n < 2:
        return False
    bases = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    if n in bases or any(n % p == 0 for p in bases):
        return n in bases
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in bases:
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def _primes(n: int) -> list[int]:
    sieve = bytearray([1]) * (n + 1)
    sieve[:2] = b"\0" * min(2, n + 1)
    for i in range(2, math.isqrt(n) + 1):
        if sieve[i]:
            sieve[i * i :: i] = bytes(len(range(i * i, n + 1, i)))
    return [i for i in range(n + 1) if sieve[i]]


def _factor(n: int, limit: int = 1 << 20) -> int:
    n = abs(n)
    for d in range(2, min(limit, math.isqrt(n)) + 1):
        if n % d == 0:
            return d
    return n if 1 < n <= limit else 1


def _jacobi(a: int, n: int) -> int | None:
    if n <= 0 or n % 2 == 0:
        return None
    a, out = a % n, 1
    while a:
        while a % 2 == 0:
            a //= 2
            out = -out if n % 8 in (3, 5) else out
        a, n = n, a
        out = -out if a % 4 == 3 and n % 4 == 3 else out
        a %= n
    return out if n == 1 else 0


def _frem(x: int, y: int) -> int:
    while y not in (0, 1, -1) and x and x % y == 0:
        x //= y
    return abs(x)


def _fcnt(x: int, y: int) -> int:
    n = 0
    while y not in (0, 1, -1) and x and x % y == 0:
        x, n = x // y, n + 1
    return n


def _gcdrem(x: int, y: int) -> int:
    x = abs(x)
    while (g := math.gcd(x, y)) > 1:
        x //= g
    return x


def _bernoulli(n: int) -> float:
    row = []
    for m in range(n + 1):
        row.append(Fraction(1, m + 1))
        for j in range(m, 0, -1):
            row[j - 1] = j * (row[j - 1] - row[j])
    return float(-row[0] if n == 1 else row[0])


def _euler(n: int) -> int:
    """Zig-zag numbers with alternating signs at even places, zero at odd ones."""
    if n % 2:
        return 0
    row = [1]
    for _ in range(n):
        total, new = 0, [0]
        for x in reversed(row):
            total += x
            new.append(total)
        row = new
    return row[-1] * (-1) ** (n // 2)


def _fib(n: int) -> int:
    a, b = 0, 1
    for _ in range(abs(n)):
        a, b = b, a + b
    return a if n >= 0 or n % 2 else -a


def _minv(x: int, m: int) -> int | None:
    return pow(x, -1, m) if m > 1 and math.gcd(x, m) == 1 else None


def _next(n: int) -> int:
    n += 1
    while not prime(n):
        n += 1
    return n


def _previous(n: int) -> int | None:
    n -= 1
    while n > 1 and not prime(n):
        n -= 1
    return n if n > 1 else None


bernoulli = _batched(_bernoulli, T.DoubleType())
euler = _batched(_euler, T.LongType())
fib = _batched(_fib, T.LongType())
factor = _batched(_factor, T.LongType())
fcnt = _batched(_fcnt, T.LongType())
frem = _batched(_frem, T.LongType())
gcdrem = _batched(_gcdrem, T.LongType())
isprime = _batched(prime, T.BooleanType())
jacobi = _batched(_jacobi, T.LongType())
minv = _batched(_minv, T.LongType())
modpow = _batched(lambda x, n, m: pow(x, n, m) if m > 0 and n >= 0 else None, T.LongType())
nextprime = _batched(_next, T.LongType())
prevprime = _batched(_previous, T.LongType())
pix = _batched(lambda n: len(_primes(max(n, 0))), T.LongType())
pfact = _batched(lambda n: math.prod(_primes(max(n, 0))), T.LongType())
lcmfact = _batched(lambda n: math.lcm(*range(1, max(n, 1) + 1)), T.LongType())
lfactor = _batched(lambda n, m: next((p for p in _primes(8 * max(m, 2) + 32)[:m] if n % p == 0), 1), T.LongType())


@F.pandas_udf(T.StringType())
def _cfappr(x: pd.Series, eps: pd.Series) -> pd.Series:
    """The fraction of least denominator within eps of x."""
    out = []
    for a, e in zip(x, eps, strict=True):
        if pd.isna(a) or pd.isna(e):
            out.append(None)
            continue
        target, f = Fraction(a), Fraction(a).limit_denominator(1)
        n = 1
        while abs(f - target) > Fraction(abs(e)) and n < 1 << 40:
            n *= 2
            f = target.limit_denominator(n)
        low, high = n // 2, n
        while high - low > 1:
            mid = (low + high) // 2
            g = target.limit_denominator(max(mid, 1))
            low, high, f = (low, mid, g) if abs(g - target) <= Fraction(abs(e)) else (mid, high, f)
        out.append(f"{f.numerator}/{f.denominator}" if f.denominator > 1 else str(f.numerator))
    return pd.Series(out)


def cfappr(x, eps=1e-6) -> Column:
    return _cfappr(_d(x), _d(eps))


def _ratio(part: str) -> Callable[[Column], Column]:
    """Numerator or denominator of a decimal with up to six places, in lowest terms."""

    def f(x) -> Column:
        top, unit = F.round(_d(x) * 1_000_000).cast("long"), F.lit(1_000_000).cast("long")
        g = gcd(top, unit)
        return F.floor((top if part == "num" else unit) / g).cast("long")

    return f


# ---- lists, matrices, strings --------------------------------------------------------------------------------------


def delete(values, index) -> Column:
    """Without the element at a position from 0."""
    return F.filter(values, lambda x, i: i != col(index))


def insert(values, index, *new) -> Column:
    """With new elements before the position, from 0."""
    i = col(index)
    return F.concat(F.slice(values, F.lit(1), i), F.array(*map(col, new)), F.slice(values, i + 1, F.size(values)))


def head(values, n) -> Column:
    """The first n, or all but the last -n."""
    n = col(n)
    return F.slice(values, F.lit(1), F.greatest(F.lit(0), F.when(n >= 0, n).otherwise(F.size(values) + n)))


def tail(values, n) -> Column:
    """The last n, or all but the first -n."""
    n = col(n)
    take = F.least(F.size(values), F.greatest(F.lit(0), F.when(n >= 0, n).otherwise(F.size(values) + n)))
    return F.slice(values, F.size(values) - take + 1, take)


def segment(values, a, b) -> Column:
    """From position a to b, both counted from 0 and included; backwards if a is larger."""
    a, b = col(a), col(b)
    part = F.slice(values, F.least(a, b) + 1, F.abs(a - b) + 1)
    return F.when(a <= b, part).otherwise(F.reverse(part))


def cross_product(x, y) -> Column:
    term = lambda i, j: x[i] * y[j] - x[j] * y[i]
    return F.array(term(1, 2), term(2, 0), term(0, 1))


def dot(x, y) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def trace(m) -> Column:
    return F.aggregate(F.transform(m, lambda row, i: row[i].cast("double")), F.lit(0.0), lambda s, v: s + v)


def transpose(m) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(m[0]) - 1), lambda j: F.transform(m, lambda row: row[j]))


def is_identity(m) -> Column:
    return F.forall(F.transform(m, lambda row, i: F.forall(F.transform(row, lambda v, j: v.cast("double") == F.when(i == j, 1.0).otherwise(0.0)), lambda b: b) & (F.size(row) == F.size(m))), lambda b: b)


def _kind(*names: str) -> Callable[[Column], Column]:
    return lambda x: F.typeof(x).rlike("^(" + "|".join(names) + ")")


def _compare(a, b) -> Column:
    return F.when(col(a) < col(b), -1).when(col(a) > col(b), 1).otherwise(0)


#: Name -> function. Functions of a list take an array column.
BUILTINS: dict[str, Callable[..., Column]] = {
    "abs": lambda x: F.abs(col(x)), "acos": lambda x: F.acos(_d(x)), "acosh": lambda x: F.acosh(_d(x)), "acot": lambda x: F.atan(_inv(x)), "acoth": lambda x: F.atanh(_inv(x)),
    "acsc": lambda x: F.asin(_inv(x)), "acsch": lambda x: F.asinh(_inv(x)), "agd": lambda x: 2 * F.atanh(F.tan(_d(x) / 2)), "append": lambda v, *x: F.concat(v, F.array(*map(col, x))), "asec": lambda x: F.acos(_inv(x)),
    "asech": lambda x: F.acosh(_inv(x)), "asin": lambda x: F.asin(_d(x)), "asinh": lambda x: F.asinh(_d(x)), "assoc": lambda *kv: F.create_map(*map(col, kv)), "atan": lambda x: F.atan(_d(x)),
    "atan2": lambda y, x: F.atan2(_d(y), _d(x)), "atanh": lambda x: F.atanh(_d(x)), "avg": avg, "base": lambda x, b: F.conv(col(x).cast("string"), 10, b), "base2": lambda x, b: F.conv(col(x).cast("string"), 10, b),
    "bernoulli": bernoulli, "bit": lambda x, y: F.getbit(_l(x), col(y)), "btrunc": btrunc, "catalan": lambda n: F.floor(comb(2 * _l(n), n) / (_l(n) + 1)).cast("long"), "ceil": lambda x: F.ceil(col(x)),
    "cfappr": cfappr, "char": lambda x: F.chr(_l(x)), "comb": lambda n, k: comb(n, k).cast("long"), "cos": lambda x: F.cos(_d(x)), "cosh": lambda x: F.cosh(_d(x)), "cot": lambda x: F.cot(_d(x)),
    "coth": lambda x: F.try_divide(F.lit(1.0), F.tanh(_d(x))), "count": lambda v, f: F.size(F.filter(v, f)), "cp": cross_product, "csc": lambda x: F.csc(_d(x)), "csch": lambda x: F.try_divide(F.lit(1.0), F.sinh(_d(x))),
    "ctime": lambda: F.date_format(F.current_timestamp(), "EEE MMM d HH:mm:ss yyyy"), "custom": lambda name, *x: F.call_function(name, *map(col, x)), "delete": delete, "den": _ratio("den"), "digits": digits,
    "dp": dot, "euler": euler, "eval": lambda text: F.expr(text), "exp": lambda x: F.exp(_d(x)), "fact": fact, "factor": factor, "fcnt": fcnt, "fib": fib, "floor": lambda x: F.floor(col(x)),
    "forall": lambda v, f: F.transform(v, f), "frac": lambda x: _d(x) - int_part(x), "frem": frem, "gcd": gcd, "gcdrem": gcdrem, "gd": lambda x: 2 * F.atan(F.tanh(_d(x) / 2)), "hash": lambda *x: F.xxhash64(*map(col, x)),
    "head": head, "highbit": highbit, "hmean": hmean, "hypot": lambda x, y: F.hypot(_d(x), _d(y)), "ilog": ilog, "ilog10": lambda x: ilog(x, 10), "ilog2": lambda x: ilog(x, 2), "indices": lambda m: F.map_keys(m),
    "insert": insert, "int": int_part, "inverse": _inv, "iroot": iroot, "isassoc": _kind("map"), "iseven": lambda x: F.pmod(_l(x), F.lit(2).cast("long")) == 0, "isident": is_identity,
    "isint": lambda x: _d(x) == F.floor(_d(x)), "islist": _kind("array"), "ismult": lambda x, y: F.pmod(_l(x), _l(y)) == 0, "isnull": lambda x: col(x).isNull(), "isnum": lambda x: col(x).cast("string").rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"),
    "isodd": lambda x: F.pmod(_l(x), F.lit(2).cast("long")) == 1, "isprime": isprime, "isqrt": isqrt, "isreal": _kind("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"), "isrel": lambda x, y: gcd(x, y) == 1,
    "issq": lambda x: F.when(_l(x) < 0, False).otherwise(isqrt(F.greatest(_l(x), F.lit(0).cast("long"))) * isqrt(F.greatest(_l(x), F.lit(0).cast("long"))) == _l(x)), "isstr": _kind("string"), "istype": lambda x, y: F.typeof(x) == F.typeof(y), "jacobi": jacobi,
    "join": lambda *v: F.concat(*v), "lcm": lcm, "lcmfact": lcmfact, "lfactor": lfactor, "list": lambda *x: F.array(*map(col, x)), "ln": lambda x: F.ln(_d(x)), "log": lambda x: F.log10(_d(x)), "lowbit": lowbit,
    "ltol": lambda x: F.sqrt(1 - _d(x) * _d(x)), "makelist": lambda n: F.array_repeat(F.lit(None).cast("double"), n), "matmax": lambda m: F.array_max(F.flatten(m)), "matmin": lambda m: F.array_min(F.flatten(m)),
    "matsum": lambda m: F.aggregate(F.flatten(m), F.lit(0.0), lambda a, x: a + x.cast("double")), "mattrace": trace, "mattrans": transpose, "max": lambda *x: F.greatest(*map(col, x)), "meq": lambda x, y, m: F.pmod(_l(x) - _l(y), _l(m)) == 0,
    "min": lambda *x: F.least(*map(col, x)), "minv": minv, "mmin": mmin, "mne": lambda x, y, m: F.pmod(_l(x) - _l(y), _l(m)) != 0, "modify": lambda v, f: F.transform(v, f), "near": lambda x, y, eps=1e-6: F.signum(F.abs(_d(x) - _d(y)) - _d(eps)).cast("int"),
    "nextprime": nextprime, "norm": lambda x: col(x) * col(x), "null": lambda: F.lit(None), "num": _ratio("num"), "ord": lambda x: F.ascii(x), "perm": perm, "pfact": pfact, "pi": lambda: F.pi(), "pix": pix, "places": places,
    "pmod": modpow, "pop": lambda v: F.struct(F.get(v, F.lit(0)).alias("value"), F.slice(v, F.lit(2), F.greatest(F.size(v), F.lit(1))).alias("rest")), "popcnt": lambda x: F.bit_count(_l(x)), "power": lambda x, y: F.pow(_d(x), _d(y)),
    "prevprime": prevprime, "push": lambda v, *x: F.concat(F.array(*map(col, reversed(x))), v), "quo": lambda x, y: F.floor(F.try_divide(_d(x), _d(y))).cast("long"), "randbit": lambda seed=0: (F.rand(seed) < 0.5).cast("int"), "randombit": lambda seed=0: (F.rand(seed) < 0.5).cast("int"),
    "randperm": lambda v, seed=0: F.shuffle(v, seed), "remove": lambda v: F.struct(F.try_element_at(v, F.lit(-1)).alias("value"), F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))).alias("rest")), "reverse": lambda v: F.reverse(v),
    "root": lambda x, n: F.pow(_d(x), F.lit(1.0) / _d(n)), "scale": lambda x, n: _d(x) * F.pow(F.lit(2.0), _d(n)), "sec": lambda x: F.sec(_d(x)), "sech": lambda x: F.try_divide(F.lit(1.0), F.cosh(_d(x))), "seed": lambda: F.unix_micros(F.current_timestamp()),
    "segment": segment, "select": lambda v, f: F.filter(v, f), "sgn": lambda x: F.signum(_d(x)).cast("int"), "sha1": lambda x: F.sha1(col(x).cast("string").cast("binary")), "sin": lambda x: F.sin(_d(x)), "sinh": lambda x: F.sinh(_d(x)), "size": lambda v: F.size(v),
    "sizeof": lambda x: F.octet_length(col(x).cast("string")), "ssq": lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x), "str": lambda x: col(x).cast("string"), "strcat": lambda *x: F.concat(*map(col, x)), "strcmp": _compare,
    "strcpy": lambda a, b: F.when(F.length(b) >= F.length(a), F.substr(b, F.lit(1), F.length(a))).otherwise(F.concat(b, F.substr(a, F.length(b) + 1, F.length(a)))), "strlen": lambda x: F.length(x), "strncmp": lambda a, b, n: _compare(F.left(a, col(n)), F.left(b, col(n))),
    "strncpy": lambda a, b, n: F.concat(F.left(b, F.least(col(n), F.length(a))), F.substr(a, F.least(col(n), F.length(a), F.length(b)) + 1, F.length(a))), "strpos": lambda s, t: F.instr(s, t), "strprintf": lambda fmt, *x: F.format_string(fmt, *x),
    "strscan": lambda s, pattern, i=1: F.regexp_extract(s, pattern, i), "substr": lambda s, p, n: F.substring(s, p, n), "sum": lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), "swap": lambda x, y: F.struct(col(y).alias("x"), col(x).alias("y")),
    "tail": tail, "tan": lambda x: F.tan(_d(x)), "tanh": lambda x: F.tanh(_d(x)), "test": lambda x: col(x) != 0, "time": lambda: F.unix_timestamp(), "trunc": trunc, "xor": lambda a, *b: _xor(a, *b),
}


def _xor(first, *rest) -> Column:
    out = _l(first)
    for x in rest:
        out = out.bitwiseXOR(_l(x))
    return out


#: Builtins that have no column form, and why.
NOT_MAPPED = {
    "files": "file handles and interpreter state are the session's",
    "control": "conditions and loops are when() and higher-order functions",
    "complex": "complex and arbitrary-precision arithmetic has no Spark type",
}


def call(name: str, *args) -> Column:
    """A builtin by its name."""
    return BUILTINS[name](*args)
