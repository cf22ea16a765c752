"""Text and number functions: natural keys, sizes with units, cleanups, map distances, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit symbols by family, smallest first.
UNITS = {
    "customary": ("B", "K", "M", "G", "T", "P", "E", "Z", "Y"),
    "customary_ext": ("byte", "kilo", "mega", "giga", "tera", "peta", "exa", "zetta", "iotta"),
    "iec": ("Bi", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi", "Yi"),
    "iec_ext": ("byte", "kibi", "mebi", "gibi", "tebi", "pebi", "exbi", "zebi", "yobi"),
}


def natural_key(s, width: int = 20, fold: bool = False) -> Column:
    """A key whose order is the natural one for whole numbers: leading spaces go, runs of digits are padded to ``width``.

    A run that begins with zero compares as a fraction, left-aligned, so it is marked and kept as it is.
    """
    text = F.regexp_replace(s, r"^\s+", "")
    text = F.lower(text) if fold else text
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^[1-9]\d*$"), F.concat(F.lit("1"), F.lpad(r, width, "0"))).when(r.rlike(r"^0"), F.concat(F.lit("0"), r)).otherwise(r)), "")


def bytes2human(n, symbols: str = "customary", decimals: int = 1, largest: int = 6) -> Column:
    """9856 is 9.6 K; powers of 1,024, up to ``1024 ** largest``. Halves are rounded up; null stays null."""
    names = UNITS[symbols]
    value, shift = n.cast("double"), 10.0**decimals
    shown = lambda x, name: F.format_string(f"%.{decimals}f {name}", F.floor(x * shift + 0.5) / shift)
    out = F.format_string(f"%.{decimals}f {names[0]}", value)
    for i, name in enumerate(names[1 : largest + 1], 1):
        out = F.when(value >= 1024.0**i, shown(value / 1024.0**i, name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def human2bytes(s) -> Column:
    """The inverse, for any family; a small k counts as K; null if the unit is unknown."""
    number = F.regexp_extract(s, r"^\s*([0-9.]+)", 1)
    unit = F.trim(F.regexp_replace(s, r"^\s*[0-9.]+", ""))
    unit = F.when(unit == "k", "K").otherwise(unit)
    power = F.lit(None).cast("int")
    for names in UNITS.values():
        for i, name in enumerate(names):
            power = F.when(unit == name, i).otherwise(power)
    return F.when(number != "", F.floor(number.try_cast("double") * F.pow(F.lit(1024.0), power)).cast("long"))


def humanized(n, base: int = 1024, decimals: int = 1, suffix: str = "B") -> Column:
    """A size in the largest unit that leaves at least 1, by 1,000 (K, M, ...) or 1,024 (Ki, Mi, ...). A half in the decimal form of the quotient is rounded up."""
    names = [x + ("i" if base == 1024 else "") for x in "KMGTPEZ"]
    value = n.cast("double")
    out = F.format_string(f"%.{decimals}f {suffix}", value)
    for i, name in enumerate(names, 1):
        out = F.when(F.abs(value) >= float(base) ** i, F.format_string(f"%.{decimals}f {name}{suffix}", value / float(base) ** i)).otherwise(out)
    return out


def percent(s) -> Column:
    """23.5% as 23.5."""
    return F.regexp_replace(s, "%", "").try_cast("double")


def missing(s, *values: str) -> Column:
    """Null for the usual marks of a missing value."""
    return F.when(~s.isin(*(values or (".", "NA", "-", ""))) & s.isNotNull(), s)


def strip_chromosome(s) -> Column:
    return F.regexp_replace(s, r"(?i)^chr(o(m(o(s(o(m(e)?)?)?)?)?)?)?_?", "")


def clean_accession(s) -> Column:
    """gb|X.1| as X."""
    return F.regexp_replace(F.regexp_replace(s, r"^[a-z]+\|", ""), r"(\.\d+)?\|?$", "")


def url_decode(s) -> Column:
    return F.try_url_decode(s)


def round_half_up(x, places: int = 2) -> Column:
    unit = 10.0**places
    return F.floor(x * unit + 0.5) / unit


def minus_log10(p, least: float = 1e-20) -> Column:
    return -F.log10(F.greatest(p.cast("double"), F.lit(least)))


def kosambi(recombination) -> Column:
    """Centimorgans of a recombination rate R: 25 ln((1 + 2r) / (1 - 2r)) with r = .5 R / (1 - R); null from r = .5 on."""
    r = F.try_divide(0.5 * recombination, 1 - recombination)
    return F.when(r < 0.5, 25 * F.ln((1 + 2 * r) / (1 - 2 * r)))


def logistic(x, a, b) -> Column:
    return 1 / (1 + a * F.exp(-b * x))


def interpolate(x, x0, y0, x1, y1) -> Column:
    return F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * F.try_divide((x - x0).cast("double"), (x1 - x0).cast("double")))


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def grid_transform(x, y, a: float, b: float, c: float, d: float, e: float, f: float, cell: float = 1.0) -> Column:
    """Affine map of a point, snapped down to a grid."""
    return F.struct((F.floor((a * x + b * y + c) / cell) * cell).alias("x"), (F.floor((d * x + e * y + f) / cell) * cell).alias("y"))


def saturating_add(a, b, most: int) -> Column:
    return F.least(a.cast("long") + b.cast("long"), F.lit(most).cast("long"))


def flag_bits(*conditions: Column) -> Column:
    """The i-th condition sets bit i."""
    out = F.lit(0)
    for i, c in enumerate(conditions):
        out = out + F.when(c, 1 << i).otherwise(0)
    return out


def html_text(s) -> Column:
    """Text of an HTML page: scripts, styles, comments and tags go, the commonest entities are decoded, spaces collapse."""
    out = F.regexp_replace(s, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_links(s) -> Column:
    return F.regexp_extract_all(s, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))


def markdown(s) -> Column:
    """Headings, emphasis, links and list items of HTML as Markdown; other tags go."""
    out = s
    for n in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}>", "\n" + "#" * n + " $1\n")
    for tag, mark in (("b|strong", r"\*\*"), ("i|em", r"\*"), ("code", "`")):
        out = F.regexp_replace(out, rf"(?is)<(?:{tag})\b[^>]*>(.*?)</(?:{tag})>", f"{mark}$1{mark}")
    out = F.regexp_replace(out, r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>""", "[$2]($1)")
    out = F.regexp_replace(out, r"(?is)<li\b[^>]*>(.*?)</li>", "- $1\n")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</p>", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", ""), r"^\s+|\s+$", "")


def spatial_name(name) -> Column:
    """Row, column, x and y of a spatial read name: fields 6 to 9 between colons."""
    part = F.split(name, ":")
    return F.struct(F.substring(part[5], 2, 9).cast("int").alias("row"), F.substring(part[6], 2, 9).cast("int").alias("col"), part[7].cast("double").alias("x"), part[8].cast("double").alias("y"))


def draw(seed: int, *columns) -> Column:
    """A seeded 48-bit number of the columns' texts, from the first twelve hex digits of an MD5: a rerun task, or another engine, draws the same."""
    return F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])), F.lit(12)), 16, 10).cast("long")
