"""Sequence functions: complements, codons, ambiguity codes, qualities, alignment strings, genotypes and k-mers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nucleotide codes and their complements, position by position; brackets swap so that motifs stay readable.
CODES = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn[](){}<>"
COMPLEMENTS = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn][)(}{><"

#: The bases that each ambiguity code stands for.
AMBIGUITY = {"A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT"}

#: Fixed value: amino acids of the standard code, codons in the order of the bases T, C, A, G.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
BASES = "TCAG"
CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}

#: Bits of the four-bit code.
BASE_BITS = {"A": 1, "T": 2, "C": 4, "G": 8}


def lookup(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def chars(s) -> Column:
    """The characters of a string; none of the empty one."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def complement(s) -> Column:
    return F.translate(s, CODES, COMPLEMENTS)


def revcomp(s) -> Column:
    return F.reverse(complement(s))


def revcomp_strict(s) -> Column:
    """Null if the sequence has anything but A, C, G and T."""
    return F.when(~F.col(s).rlike("[^ACGTacgt]") if isinstance(s, str) else ~s.rlike("[^ACGTacgt]"), revcomp(s))


def gc(s) -> Column:
    """Share of G and C among A, C, G and T."""
    upper = F.upper(s)
    both = F.length(upper) - F.length(F.translate(upper, "GC", ""))
    return F.try_divide(both.cast("double"), (F.length(upper) - F.length(F.translate(upper, "ACGT", ""))).cast("double"))


def gc_count(s) -> Column:
    return F.regexp_count(s, F.lit("[GCgc]"))


def base_counts(s) -> Column:
    """A, C, G, T and other counts."""
    u = F.upper(s)
    n = lambda c: F.length(u) - F.length(F.replace(u, F.lit(c), F.lit("")))
    return F.struct(*[n(c).alias(c) for c in "ACGT"], F.length(F.translate(u, "ACGT", "")).alias("other"))


def codons(s) -> Column:
    """Full codons; a partial one at the end is dropped."""
    col = F.col(s) if isinstance(s, str) else s
    return F.when(F.length(col) >= 3, F.transform(F.sequence(F.lit(0), F.floor(F.length(col) / 3).cast("int") - 1), lambda i: F.substr(col, i * 3 + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def translate(s) -> Column:
    """Amino acids; an unknown codon gives x."""
    table = lookup(CODONS)
    return F.array_join(F.transform(codons(F.translate(F.upper(s), "U", "T")), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("x"))), "")


def ambiguity_bases(code) -> Column:
    return F.try_element_at(lookup(AMBIGUITY), F.translate(F.upper(code), "U", "T"))


def ambiguity_code(bases) -> Column:
    """The code of a set of bases, given as an array in any order."""
    table = lookup({v: k for k, v in AMBIGUITY.items()})
    return F.try_element_at(table, F.array_join(F.array_sort(F.array_distinct(bases)), ""))


def shared_alleles(a, b) -> Column:
    """Alleles that two codes share as genotypes: 2 for the same code, else the number of common bases up to 1."""
    common = F.size(F.array_intersect(chars(ambiguity_bases(a)), chars(ambiguity_bases(b))))
    return F.when(F.upper(a) == F.upper(b), 2).otherwise(F.least(common, F.lit(1)))


def bits(code) -> Column:
    """Four-bit code: the union of its bases' bits."""
    table = lookup(BASE_BITS)
    return F.aggregate(chars(ambiguity_bases(code)), F.lit(0), lambda a, c: a.bitwiseOR(table[c]))


def from_bits(value) -> Column:
    bases = F.filter(F.array(*[F.when(value.bitwiseAND(b) != 0, F.lit(c)) for c, b in BASE_BITS.items()]), lambda c: c.isNotNull())
    return ambiguity_code(bases)


def phred(q, offset: int = 33) -> Column:
    return F.transform(chars(q), lambda c: F.ascii(c) - offset)


def phred_string(values, offset: int = 33) -> Column:
    return F.array_join(F.transform(values, lambda v: F.chr(v + offset)), "")


def error_probability(q) -> Column:
    return F.pow(F.lit(10.0), -q.cast("double") / 10)


def mean_quality(q, offset: int = 33) -> Column:
    v = phred(q, offset)
    return F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), F.size(v).cast("double"))


def mean_quality_rounded(q, offset: int = 33) -> Column:
    return F.floor(mean_quality(q, offset) + 0.499)


def quality_count(q, least: int, offset: int = 33) -> Column:
    return F.size(F.filter(phred(q, offset), lambda v: v >= least))


def effective_coverage(q, a, offset: int = 33) -> Column:
    """Sum over positions of the chance that both base and alignment are right."""
    right = lambda v: 1 - error_probability(v)
    return F.aggregate(F.zip_with(phred(q, offset), phred(a, offset), lambda x, y: right(x) * right(y)), F.lit(0.0), lambda s, v: s + v)


@F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
def _trim(q: pd.Series, error: pd.Series) -> pd.DataFrame:
    """The stretch that most exceeds an error limit: largest sum of limit minus error, first of equals; empty is (0, 0)."""
    out = []
    for text, limit in zip(q, error, strict=True):
        best, bounds, total, start = 0.0, (0, 0), 0.0, 0
        for i, c in enumerate(text or ""):
            total += limit - 10 ** (-(ord(c) - 33) / 10)
            if total <= 0:
                total, start = 0.0, i + 1
            elif total > best:
                best, bounds = total, (start, i + 1)
        out.append(bounds)
    return pd.DataFrame(out, columns=["start", "end"])


def trim_quality(q, error: float = 0.05) -> Column:
    return _trim(q, F.lit(error))


CIGAR = r"(\d+)([MIDNSHP=X])"


def cigar(s) -> Column:
    """Operations as (length, op)."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, CIGAR, 1).cast("int").alias("n"), F.regexp_extract(x, CIGAR, 2).alias("op")))


def cigar_length(s, ops: str) -> Column:
    return F.aggregate(F.filter(cigar(s), lambda x: F.lit(ops).contains(x["op"])), F.lit(0), lambda a, x: a + x["n"])


def reference_length(s) -> Column:
    return cigar_length(s, "MDN=X")


def query_length(s) -> Column:
    return cigar_length(s, "MIS=X")


def longest_match(s) -> Column:
    return F.coalesce(F.array_max(F.transform(F.filter(cigar(s), lambda x: x["op"] == "M"), lambda x: x["n"])), F.lit(0))


def end_position(pos, s) -> Column:
    return pos + reference_length(s) - 1


def clips(s, reverse) -> Column:
    """Clipped lengths at the start and end of the read, which swap on the reverse strand."""
    left = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(s, r"^(\d+)[SH]", 1), F.lit("")), F.lit("999999")).cast("int"), F.lit(0))
    right = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(s, r"(\d+)[SH]$", 1), F.lit("")), F.lit("999999")).cast("int"), F.lit(0))
    return F.struct(F.when(reverse, right).otherwise(left).alias("start"), F.when(reverse, left).otherwise(right).alias("end"))


def genotype_alleles(gt, ref, alt) -> Column:
    """Alleles of a genotype such as 0/1, from the reference and comma-separated alternatives; null for a missing call."""
    alleles = F.concat(F.array(ref), F.split(alt, ","))
    index = F.split(gt, r"[/|]")
    return F.when(~gt.contains("."), F.transform(index, lambda i: F.try_element_at(alleles, i.cast("int") + 1)))


def genotype_class(gt) -> Column:
    parts = F.split(gt, r"[/|]")
    return F.when(gt.contains("."), F.lit(None)).when(F.size(F.array_distinct(parts)) == 1, "Hom").otherwise("Het")


def sample_fields(fmt, sample) -> Column:
    """FORMAT keys mapped to a sample's values; missing values at the end are null."""
    keys, values = F.split(fmt, ":"), F.split(sample, ":")
    return F.map_from_arrays(keys, F.transform(keys, lambda k, i: F.get(values, i)))


def indel(ref, alt) -> Column:
    """Sign and size of a length change, and the bases gained or lost after the common first one."""
    change = F.length(alt) - F.length(ref)
    piece = F.when(change > 0, F.substr(alt, F.length(ref) + 1, change)).when(change < 0, F.substr(ref, F.length(alt) + 1, -change)).otherwise("")
    return F.struct(F.signum(change.cast("double")).cast("int").alias("sign"), F.abs(change).alias("size"), piece.alias("bases"))


def indel_code(code) -> Column:
    """I3 is 3, D2 is -2."""
    n = F.try_to_number(F.substring(code, 2, 9), F.lit("999999999")).cast("int")
    return F.when(F.left(code, F.lit(1)) == "I", n).when(F.left(code, F.lit(1)) == "D", -n)


def call_from_depths(depths, het: float = 0.10, hom: float = 0.01) -> Column:
    """From a map of base to depth: two bases if the second has at least ``het`` of all, one if at most ``hom``, else null."""
    ranked = F.reverse(F.array_sort(F.transform(F.map_entries(depths), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("b")))))
    total = F.aggregate(F.map_values(depths), F.lit(0).cast("long"), lambda a, v: a + v)
    second = F.coalesce(F.get(ranked, F.lit(1))["n"], F.lit(0)) / F.nullif(total, F.lit(0).cast("long"))
    pair = F.array_join(F.array_sort(F.array(F.get(ranked, F.lit(0))["b"], F.get(ranked, F.lit(1))["b"])), "")
    return F.when(second >= het, pair).when(second <= hom, F.concat(F.get(ranked, F.lit(0))["b"], F.get(ranked, F.lit(0))["b"]))


def kmers(s, k: int) -> Column:
    """All substrings of length k, in order."""
    col = F.col(s) if isinstance(s, str) else s
    return F.when(F.length(col) >= k, F.transform(F.sequence(F.lit(1), F.length(col) - k + 1), lambda i: F.substr(col, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def canonical(kmer) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, revcomp(kmer))


def entropy(s, k: int = 1) -> Column:
    """Shannon entropy in bits of the k-mers of a string."""
    parts = kmers(s, k)
    n = F.size(parts).cast("double")
    share = lambda x: F.size(F.filter(parts, lambda y: y == x)) / n
    return F.aggregate(F.transform(F.array_distinct(parts), lambda x: -share(x) * F.log2(share(x))), F.lit(0.0), lambda a, v: a + v)


def low_information(s, k: int) -> Column:
    """Whether a k-mer has under four bases, a run of three, or too little entropy over lengths 1 to 3."""
    col = F.col(s) if isinstance(s, str) else s
    return (F.size(F.array_distinct(chars(col))) < 4) | col.rlike(r"(.)\1\1") | (entropy(col, 1) + entropy(col, 2) + entropy(col, 3) < 0.3 * k)


def homopolymer(s, n: int = 3) -> Column:
    return (F.col(s) if isinstance(s, str) else s).rlike(r"(\w)\1{%d,}" % (n - 1))


def difference_positions(a, b) -> Column:
    """(position from 1, character of a, character of b) wherever the two differ, over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    all_ = F.transform(at, lambda i: F.struct(i.alias("pos"), F.substr(a, i, F.lit(1)).alias("a"), F.substr(b, i, F.lit(1)).alias("b")))
    return F.filter(all_, lambda x: x["a"] != x["b"])


def consensus(a, b) -> Column:
    """Per position: the other sequence's base at a gap, the common base, else the code of both."""
    merged = F.zip_with(chars(a), chars(b), lambda x, y: F.when((x == "-") | x.isNull(), y).when((y == "-") | y.isNull(), x).when(x == y, x).otherwise(ambiguity_code(F.concat(chars(ambiguity_bases(x)), chars(ambiguity_bases(y))))))
    return F.array_join(merged, "")


def flanks(s, pos, size: int = 200) -> Column:
    """Up to ``size`` characters before and after a position from 1."""
    left = F.greatest(pos - size, F.lit(1))
    return F.struct(F.substr(s, left, pos - left).alias("up"), F.substr(s, pos + 1, F.lit(size)).alias("down"))


def umi(s, name, n: int = 9) -> Column:
    """The first n bases moved from the sequence to the name."""
    return F.struct(F.concat(name, F.lit("_"), F.left(s, F.lit(n))).alias("name"), F.substr(s, F.lit(n + 1), F.length(s)).alias("seq"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("unit", T.StringType()), T.StructField("copies", T.IntegerType())])))
def _tandem(s: pd.Series, unit: pd.Series, copies: pd.Series) -> pd.Series:
    import re

    out = []
    for text, longest, least in zip(s, unit, copies, strict=True):
        found, at = [], 0
        pattern = re.compile(r"([ACGT]{1,%d}?)\1{%d,}" % (longest, least - 1))
        while m := pattern.search(text or "", at):
            found.append({"start": m.start() + 1, "unit": m[1], "copies": len(m[0]) // len(m[1])})
            at = m.end()
        out.append(found)
    return pd.Series(out)


def tandem_repeats(s, unit: int = 6, copies: int = 3) -> Column:
    """Stretches of a unit up to ``unit`` long that repeat at least ``copies`` times: start from 1, unit, copies."""
    return _tandem(s, F.lit(unit), F.lit(copies))


def _align(xs: list[str], ys: list[str]):
    """(best, second) of each pair, a row of all matrices at a time; gaps along a row are a running maximum, since each costs the same."""
    import numpy as np

    n, wide = len(xs), max(map(len, ys))
    x = np.full((max(map(len, xs)), n), -1, np.int64)
    y = np.full((n, wide), -2, np.int64)
    for i, (p, q) in enumerate(zip(xs, ys, strict=True)):
        x[: len(p), i], y[i, : len(q)] = list(map(ord, p)), list(map(ord, q))
    outside, slope = y == -2, 3 * np.arange(wide + 1)
    best, ends = np.zeros((n, wide + 1), np.int64), np.zeros((len(x) + 1, n), np.int64)
    for i, c in enumerate(x, 1):
        row = np.zeros_like(best)
        row[:, 1:] = np.where(outside, 0, np.maximum(best[:, :-1] + np.where(y == c[:, None], 2, -2), best[:, 1:] - 3))
        best = np.maximum.accumulate(np.maximum(row, 0) + slope, 1) - slope
        ends[i] = best.max(1)
    for i, (p, q) in enumerate(zip(xs, ys, strict=True)):
        own = ends[: len(p) + 1, i]
        top = int(np.argmax(own))
        far = np.abs(np.arange(len(own)) - top) > len(q) // 2
        yield int(own[top]), int(own[far].max(initial=0))


@F.pandas_udf(T.StructType([T.StructField("score", T.IntegerType()), T.StructField("second", T.IntegerType())]))
def _smith_waterman(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    xs, ys = [v or "" for v in a], [v or "" for v in b]
    order = sorted(range(len(xs)), key=lambda i: (len(xs[i]), len(ys[i])))  # pairs of like lengths are padded together
    out: list = [None] * len(xs)
    for at in range(0, len(order), 128):
        some = order[at : at + 128]
        for i, found in zip(some, _align([xs[i] for i in some], [ys[i] for i in some]), strict=True):
            out[i] = found
    return pd.DataFrame(out, columns=["score", "second"])


def local_alignment(a, b) -> Column:
    """Best local score of b in a (match 2, mismatch -2, gap -3) and the best that ends half of b's length away."""
    return _smith_waterman(a, b)


def exclusion_probability(freqs) -> Column:
    """Paternity exclusion over allele frequencies when both parents are tested."""
    s = lambda k: F.aggregate(freqs, F.lit(0.0), lambda a, p: a + F.pow(p, F.lit(float(k))))
    return 1 - 2 * s(2) + s(3) + 2 * s(4) - 3 * s(5) - 2 * s(2) * s(2) + 3 * s(2) * s(3)


def exclusion_duo(freqs) -> Column:
    """When one parent is not tested."""
    s = lambda k: F.aggregate(freqs, F.lit(0.0), lambda a, p: a + F.pow(p, F.lit(float(k))))
    return 1 - 4 * s(2) + 2 * s(2) * s(2) + 4 * s(3) - 3 * s(4)


def exclusion_pair(freqs) -> Column:
    """When both putative parents are to be excluded."""
    s = lambda k: F.aggregate(freqs, F.lit(0.0), lambda a, p: a + F.pow(p, F.lit(float(k))))
    return 1 + 4 * s(4) - 4 * s(5) - 3 * s(6) - 8 * s(2) * s(2) + 8 * s(2) * s(3) + 2 * s(3) * s(3)
