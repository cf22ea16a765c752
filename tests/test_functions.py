"""Sequence and text functions on literal values."""

import math

import pytest
from pyspark.sql import functions as F

from helixframe.functions import seq as Q
from helixframe.functions import text as X

L = F.lit


def values(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_sequences(spark):
    r = values(
        spark, rc=Q.revcomp(L("ACGTN")), iupac=Q.revcomp(L("[RYa]")), comp=Q.complement(L("ACgt")), strict=Q.revcomp_strict(L("ACGX")), strict2=Q.revcomp_strict(L("AACG")), gc=Q.gc(L("GGCATN")), gcn=Q.gc_count(L("GgCAT")), counts=Q.base_counts(L("AACGTN")),
        aa=Q.translate(L("ATGGCCTAANN")), bad=Q.translate(L("ATGNNNA")), rna=Q.translate(L("AUG")), r=Q.ambiguity_code(F.array(L("G"), L("A"))), y=Q.ambiguity_code(F.array(L("T"), L("C"), L("T"))), n=Q.ambiguity_code(F.array(*map(L, "TGCA"))), bases=Q.ambiguity_bases(L("k")),
        s2=Q.shared_alleles(L("R"), L("R")), s1=Q.shared_alleles(L("R"), L("K")), s0=Q.shared_alleles(L("A"), L("Y")), bits=Q.bits(L("R")), frm=Q.from_bits(L(9)),
    )
    assert (r["rc"], r["iupac"], r["comp"], r["strict"], r["strict2"], r["gc"], r["gcn"]) == ("NACGT", "[tRY]", "TGca", None, "CGTT", 0.6, 3)
    assert tuple(r["counts"]) == (2, 1, 1, 1, 1)
    assert (r["aa"], r["bad"], r["rna"], r["r"], r["y"], r["n"], r["bases"]) == ("MA*", "Mx", "M", "R", "Y", "N", "GT")
    assert (r["s2"], r["s1"], r["s0"], r["bits"], r["frm"]) == (2, 1, 0, 9, "R")


def test_every_code_and_its_complement_agree(spark):
    for code, bases in Q.AMBIGUITY.items():
        r = values(spark, c=Q.ambiguity_code(F.array(*map(L, bases))), d=Q.complement(L(code)), b=Q.ambiguity_bases(Q.complement(L(code))))
        assert r["c"] == code
        assert sorted(r["b"]) == sorted(bases.translate(str.maketrans("ACGT", "TGCA")))


def test_qualities(spark):
    r = values(spark, q=Q.phred(L("!I")), back=Q.phred_string(F.array(L(0), L(40))), m=Q.mean_quality(L("!I")), mr=Q.mean_quality_rounded(L("!J")), c=Q.quality_count(L("!5I"), 20), e=Q.effective_coverage(L("55"), L("55")), t=Q.trim_quality(L("!!IIII!!")), none=Q.trim_quality(L("!!")), p=Q.error_probability(L(20)))
    assert (r["q"], r["back"], r["m"], r["mr"], r["c"], r["p"]) == ([0, 40], "!I", 20.0, 20, 2, 0.01)
    assert r["e"] == pytest.approx(2 * 0.99**2)
    assert tuple(r["t"]) == (2, 6) and tuple(r["none"]) == (0, 0)


def test_alignment_strings(spark):
    c = L("5S10M2I3D20M4H")
    r = values(spark, ref=Q.reference_length(c), q=Q.query_length(c), m=Q.longest_match(c), end=Q.end_position(L(1), L("10M")), f=Q.clips(c, L(False)), b=Q.clips(c, L(True)), none=Q.clips(L("3M"), L(False)))
    assert (r["ref"], r["q"], r["m"], r["end"]) == (33, 37, 20, 10)
    assert (tuple(r["f"]), tuple(r["b"]), tuple(r["none"])) == ((5, 4), (4, 5), (0, 0))


def test_genotypes(spark):
    r = values(
        spark, g=Q.genotype_alleles(L("0/2"), L("A"), L("C,G")), missing=Q.genotype_alleles(L("./."), L("A"), L("C")), hom=Q.genotype_class(L("1|1")), het=Q.genotype_class(L("0/1")), f=Q.sample_fields(L("GT:AD:DP"), L("0/1:3,4")), ins=Q.indel(L("A"), L("ACG")), dele=Q.indel(L("ACG"), L("A")),
        i3=Q.indel_code(L("I3")), d2=Q.indel_code(L("D2")), call=Q.call_from_depths(F.create_map(L("A"), L(60), L("G"), L(40))), homo=Q.call_from_depths(F.create_map(L("A"), L(1000), L("G"), L(1))), none=Q.call_from_depths(F.create_map(L("A"), L(95), L("G"), L(5))),
    )
    assert (r["g"], r["missing"], r["hom"], r["het"]) == (["A", "G"], None, "Hom", "Het")
    assert r["f"] == {"GT": "0/1", "AD": "3,4", "DP": None}
    assert (tuple(r["ins"]), tuple(r["dele"])) == ((1, 2, "CG"), (-1, 2, "CG"))
    assert (r["i3"], r["d2"], r["call"], r["homo"], r["none"]) == (3, -2, "AG", "AA", None)


def test_kmers_and_alignment(spark):
    r = values(
        spark, k=Q.kmers(L("ACGTA"), 3), short=Q.kmers(L("AC"), 3), can=Q.canonical(L("TTT")), h=Q.entropy(L("ACGT")), h0=Q.entropy(L("AAAA")), low=Q.low_information(L("AAACGT"), 6), ok=Q.low_information(L("ACGTTGCAGT"), 10), homo=Q.homopolymer(L("ACCCG")), no=Q.homopolymer(L("ACCG")),
        diff=Q.difference_positions(L("ACGT"), L("AGGA")), cons=Q.consensus(L("A-GT"), L("ACRA")), fl=Q.flanks(L("ACGTACGT"), L(3), 2), umi=Q.umi(L("ACGTACGTACGT"), L("r1")), tr=Q.tandem_repeats(L("GGACACACACTT"), 3, 3), sw=Q.local_alignment(L("TTACGTTT"), L("ACGT")),
    )
    assert (r["k"], r["short"], r["can"], r["h"], r["h0"], r["low"], r["ok"], r["homo"], r["no"]) == (["ACG", "CGT", "GTA"], [], "AAA", 2.0, 0.0, True, False, True, False)
    assert [tuple(x) for x in r["diff"]] == [(2, "C", "G"), (4, "T", "A")]
    assert r["cons"] == "ACRW"
    assert (tuple(r["fl"]), tuple(r["umi"])) == (("AC", "TA"), ("r1_ACGTACGTA", "CGT"))
    assert [tuple(x) for x in r["tr"]] == [(3, "AC", 4)]
    assert r["sw"]["score"] == 8


def test_exclusion_probabilities(spark):
    p = [0.2, 0.3, 0.5]
    r = values(spark, a=Q.exclusion_probability(F.array(*map(L, p))), b=Q.exclusion_duo(F.array(*map(L, p))), c=Q.exclusion_pair(F.array(*map(L, p))))
    pair = 0.0
    genotypes = [(i, j, p[i] * p[j]) for i in range(3) for j in range(3)]
    for a, b, w in genotypes:  # a child with one untested parent: excluded if the man shares no allele
        pair += w * sum(v for c, d, v in genotypes if not {a, b} & {c, d})
    assert r["b"] == pytest.approx(pair)
    trio = 0.0
    for i, j, w in genotypes:  # mother's genotype, which allele she gave, the father's allele, and a random man
        for gave in (i, j):
            for f in range(3):
                child = tuple(sorted((gave, f)))
                paternal = {child[0], child[1]} if tuple(sorted((i, j))) == child else {f}
                trio += w * 0.5 * p[f] * sum(v for c, d, v in genotypes if not paternal & {c, d})
    assert r["a"] == pytest.approx(trio)
    assert 0 < r["b"] < r["a"] < r["c"] < 1


def test_sizes_and_cleanups(spark):
    r = values(spark, **{f"h{i}": X.bytes2human(L(n)) for i, n in enumerate((0, 1024, 1048576))}, iec=X.bytes2human(L(9856), "iec"), hu=X.humanized(L(1500), 1000), hi=X.humanized(L(1536), decimals=2), **{f"b{i}": X.human2bytes(L(s)) for i, s in enumerate(("1 K", "1 Gi", "1 tera", "0.5kilo", "0.1  byte", "1 k", "12 foo"))})
    assert [r[f"h{i}"] for i in range(3)] == ["0.0 B", "1.0 K", "1.0 M"]
    assert (r["iec"], r["hu"], r["hi"]) == ("9.6 Ki", "1.5 KB", "1.50 KiB")
    assert [r[f"b{i}"] for i in range(7)] == [1024, 1073741824, 1099511627776, 512, 0, 1024, None]
    r = values(spark, p=X.percent(L("23.5%")), m=X.missing(L("NA")), k=X.missing(L("x")), c=X.strip_chromosome(L("Chromosome_7")), c2=X.strip_chromosome(L("chr1")), a=X.clean_accession(L("gb|AB123.1|")), u=X.url_decode(L("a%20b+c")), bad=X.url_decode(L("100%")), half=X.round_half_up(L(2.675)), log=X.minus_log10(L(0.0)))
    assert (r["p"], r["m"], r["k"], r["c"], r["c2"], r["a"], r["u"], r["bad"], r["log"]) == (23.5, None, "x", "7", "1", "AB123", "a b c", None, 20.0)
    assert r["half"] == pytest.approx(2.68)


def test_numeric_functions(spark):
    r = values(
        spark, k=X.kosambi(L(0.1)), none=X.kosambi(L(0.6)), lg=X.logistic(L(0.0), L(1.0), L(2.0)), ip=X.interpolate(L(5), L(0), L(10.0), L(10), L(20.0)), same=X.interpolate(L(5), L(5), L(3.0), L(5), L(9.0)), e=X.euclidean(F.array(L(0.0), L(3.0)), F.array(L(4.0), L(0.0))), sat=X.saturating_add(L(200), L(100), 255),
        flags=X.flag_bits(L(True), L(False), L(True)), grid=X.grid_transform(L(1.5), L(2.5), 2, 0, 1, 0, 2, 0, 2), sp=X.spatial_name(L("Pro019:S:123:2:000000:R001:C001:1385.3:335.1")),
    )
    assert r["k"] == pytest.approx(5.578589, abs=1e-6) and r["none"] is None
    assert (r["lg"], r["ip"], r["same"], r["e"], r["sat"], r["flags"]) == (0.5, 15.0, 3.0, 5.0, 255, 5)
    assert tuple(r["grid"]) == (4.0, 4.0) and tuple(r["sp"]) == (1, 1, 1385.3, 335.1)


def test_natural_order(spark):
    words = ["1-02", "1-2", "1-20", "10-20", "fred", "jane", "pic2", "pic3", "pic4", "pic100", "pic100a", "pic120", "pic121", "tom", "x2-g8", "x2-y7", "x8-y8"]
    df = spark.createDataFrame([(w,) for w in reversed(words)], "w string")
    assert [r["w"] for r in df.orderBy(X.natural_key(F.col("w"))).collect()] == words
    dates = ["1999-3-3", "1999-12-25", "2000-1-2", "2000-1-10", "2000-3-23"]
    df = spark.createDataFrame([(w,) for w in reversed(dates)], "w string")
    assert [r["w"] for r in df.orderBy(X.natural_key(F.col("w"))).collect()] == dates


def test_html(spark):
    page = '<html><script>x<y</script><h1>A &amp; B</h1><p>t <b>bold</b> <a href="u">l</a></p><ul><li>i</li></ul></html>'
    r = values(spark, t=X.html_text(L(page)), l=X.html_links(L(page)), m=X.markdown(L("<h2>T</h2><p><b>b</b> <a href='u'>l</a></p><li>i</li>")))
    assert r["t"] == "A & B t bold l i" and r["l"] == ["u"]
    assert r["m"] == "## T\n**b** [l](u)\n- i"
    assert math.isfinite(len(r["m"]))


def test_registered_functions(spark):
    from pyspark.sql import types as T

    from helixframe.functions import calc, registry

    registry.register(spark)
    r = spark.sql("SELECT hx_gc('GGCAT') AS gc, hx_qualcount('!5I', 20) AS n, hx_lshift(1, 4) AS l, hx_murmur128('') AS e, hx_murmur128('hello') AS h").first()
    assert (r["gc"], r["n"], r["l"], r["e"], r["h"]) == (0.6, 2, 16, "0" * 32, "cbd8a7b341bd9b025b1e906a48ae1d19")
    registry.add(spark, "hx_plus", lambda x, y: x + y, T.LongType())
    assert spark.range(1).select(calc.call("custom", "hx_plus", 2, 3).alias("v")).first()["v"] == 5


def test_overlap_significance(spark):
    from helixframe.operators.stats import overlap_significance

    got = spark.range(1).select(overlap_significance(L(10), L(8)).alias("p")).first()["p"]
    assert got == pytest.approx(sum(math.comb(10, i) * 0.25**i * 0.75 ** (10 - i) for i in range(8, 11)))


def test_local_alignment_equals_cell_by_cell():
    import random

    from helixframe.functions.seq import _align

    def plain(x, y):
        best, ends = [0] * (len(y) + 1), [0]
        for c in x:
            row = [0] * (len(y) + 1)
            for j, d in enumerate(y, 1):
                row[j] = max(0, best[j - 1] + (2 if c == d else -2), best[j] - 3, row[j - 1] - 3)
            ends.append(max(row))
            best = row
        top = ends.index(max(ends))
        return ends[top], max((v for i, v in enumerate(ends) if abs(i - top) > len(y) // 2), default=0)

    rnd = random.Random(3)
    xs, ys = (["".join(rnd.choice("ACGT") for _ in range(rnd.randrange(0, n))) for _ in range(150)] for n in (60, 25))
    assert list(_align(xs, ys)) == [plain(x, y) for x, y in zip(xs, ys, strict=True)]


def test_sizes_stop_at_the_largest_unit_and_keep_nulls(spark, tmp_path):
    import duckdb

    from helixframe import catalog

    r = values(spark, t=X.bytes2human(L(1 << 43)), g=X.bytes2human(L(1 << 43), largest=3), none=X.bytes2human(F.lit(None).cast("long")))
    assert (r["t"], r["g"], r["none"]) == ("8.0 T", "8192.0 G", None)
    # from bytes to petabytes, both sides of 1 T, then a null
    keys = [0, 1, 5, 6, 5000, 172384, 172385, 488671, 1199999, 400_000_000, None]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["bytes2human"]).fetchall()
    got = [tuple(r) for r in catalog.queries()["bytes2human"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
