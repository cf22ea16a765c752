"""Column functions over the driver's tables, against the same formulas in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.catalog import register
from helixframe.functions import calc, registry, seq, text
from helixframe.operators import stats
from helixframe.plans.common import r, t
from helixframe.plans.scalars import DNA, dna

#: The bases of each ambiguity code as a table of SQL.
CODES = "(VALUES ('A', 'A'), ('C', 'C'), ('G', 'G'), ('T', 'T'), ('M', 'AC'), ('R', 'AG'), ('W', 'AT'), ('S', 'CG'), ('Y', 'CT'), ('K', 'GT'), ('V', 'ACG'), ('H', 'ACT'), ('D', 'AGT'), ('B', 'CGT'), ('N', 'ACGT')) m(code, bases)"


def strands(spark, d):
    return dna(spark, d).join(t(spark, d, "part"), "p_partkey")


@register("ambiguity_codes", f"""
WITH x AS (SELECT p_partkey, list_aggregate(list_sort(list_distinct(string_split(substring({DNA}, 1, CAST(p_size % 4 + 1 AS BIGINT)), ''))), 'string_agg', '') AS b FROM part)
SELECT p_partkey, code, bases FROM x JOIN {CODES} ON bases = b""")
def ambiguity_codes(spark, d):
    """The code of each sequence's first bases, and the bases of the code."""
    x = strands(spark, d).select("p_partkey", seq.ambiguity_code(seq.chars(F.expr("left(s, p_size % 4 + 1)"))).alias("code"))
    return x.select("p_partkey", "code", seq.ambiguity_bases(F.col("code")).alias("bases"))


@register("reverse_complement", f"SELECT p_partkey, reverse(translate({DNA}, 'ACGT', 'TGCA')) AS rc, CAST(length(regexp_replace({DNA}, '[^GC]', '', 'g')) AS INTEGER) AS gc FROM part")
def reverse_complement(spark, d):
    return dna(spark, d).select("p_partkey", seq.revcomp(F.col("s")).alias("rc"), seq.gc_count(F.col("s")).alias("gc"))


@register("four_bit_codes", f"""
WITH x AS (SELECT p_partkey, {DNA} AS s FROM part), c AS (SELECT DISTINCT p_partkey, unnest(string_split(s[1:3], '')) AS c FROM x),
n AS (SELECT p_partkey, CAST(sum(CASE c WHEN 'A' THEN 1 WHEN 'T' THEN 2 WHEN 'C' THEN 4 ELSE 8 END) AS INTEGER) AS bits, string_agg(c, '' ORDER BY c) AS b FROM c GROUP BY 1)
SELECT p_partkey, bits, code FROM n JOIN {CODES} ON bases = b""")
def four_bit_codes(spark, d):
    code = seq.ambiguity_code(seq.chars(F.left("s", F.lit(3))))
    return dna(spark, d).select("p_partkey", seq.bits(code).alias("bits"), seq.from_bits(seq.bits(code)).alias("code"))


QUALITIES = "list_transform(string_split(p_brand || p_type, ''), lambda c: ascii(c) - 33)"


@register("quality_scores", f"""
SELECT p_partkey, CAST(floor(list_avg({QUALITIES}) + 0.499) AS BIGINT) AS mean, CAST(len(list_filter({QUALITIES}, lambda v: v >= 40)) AS INTEGER) AS good,
round(list_sum(list_transform({QUALITIES}, lambda v: (1 - pow(10, -v / 10.0)) * (1 - pow(10, -v / 10.0)))), 6) AS effective, round(pow(10, -p_size / 10.0), 9) AS error FROM part""")
def quality_scores(spark, d):
    """Rounded mean quality, bases of at least 40, effective coverage, and the error chance of a Phred score."""
    q = F.concat("p_brand", "p_type")
    return t(spark, d, "part").select("p_partkey", seq.mean_quality_rounded(q).alias("mean"), seq.quality_count(q, 40).alias("good"), r(seq.effective_coverage(q, q)).alias("effective"), r(seq.error_probability(F.col("p_size")), 9).alias("error"))


@register("clip_bounds", "SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size % 3 END AS INTEGER) AS start, CAST(CASE WHEN p_size % 2 = 0 THEN p_size % 3 ELSE p_size END AS INTEGER) AS \"end\", CAST(9 + p_size AS INTEGER) AS reference FROM part")
def clip_bounds(spark, d):
    """Clips at both ends of a read, which swap on the reverse strand; an end without one has none."""
    tail = F.when(F.col("p_size") % 3 > 0, F.concat((F.col("p_size") % 3).cast("string"), F.lit("H"))).otherwise("")
    c = F.concat(F.col("p_size"), F.lit("S9M2I"), F.col("p_size"), F.lit("D"), tail)
    p = t(spark, d, "part").select("p_partkey", seq.clips(c, F.col("p_size") % 2 != 0).alias("c"), seq.reference_length(c).alias("reference"))
    return p.select("p_partkey", "c.*", "reference")


@register("genotype_fields", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'A,A' WHEN 2 THEN 'A,G' ELSE 'C,G' END AS alleles, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Hom' ELSE 'Het' END AS class,
CAST(p_size AS VARCHAR) AS dp, CAST(NULL AS VARCHAR) AS gq FROM part""")
def genotype_fields(spark, d):
    """Alleles and class of a call, and its sample fields by name."""
    gt = F.element_at(F.array(*map(F.lit, ("./.", "0/0", "0|2", "1/2"))), (F.col("p_size") % 4 + 1).cast("int"))
    p = t(spark, d, "part").select("p_partkey", gt.alias("gt"), F.concat(gt, F.lit(":"), F.col("p_size")).alias("sample"))
    f = seq.sample_fields(F.lit("GT:DP:GQ"), F.col("sample"))
    return p.select("p_partkey", F.array_join(seq.genotype_alleles(F.col("gt"), F.lit("A"), F.lit("C,G")), ",").alias("alleles"), seq.genotype_class(F.col("gt")).alias("class"), f["DP"].alias("dp"), f["GQ"].alias("gq"))


@register("calls_from_depths", """
WITH x AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS c, count(*) FILTER (l_returnflag = 'R' AND l_linenumber = 1) AS g FROM lineitem GROUP BY 1),
l AS (SELECT l_suppkey, a + c + g AS n, unnest([{'n': a, 'b': 'A'}, {'n': c, 'b': 'C'}, {'n': g, 'b': 'G'}]) AS e FROM x), k AS (SELECT l_suppkey, n, e.n AS m, e.b AS b, row_number() OVER (PARTITION BY l_suppkey ORDER BY e.n DESC, e.b DESC) AS i FROM l),
w AS (SELECT l_suppkey, any_value(n) AS n, max(CASE WHEN i = 1 THEN b END) AS b1, max(CASE WHEN i = 2 THEN b END) AS b2, max(CASE WHEN i = 2 THEN m END) AS m2 FROM k GROUP BY 1)
SELECT l_suppkey, CASE WHEN m2 / n >= 0.4 THEN least(b1, b2) || greatest(b1, b2) WHEN m2 / n <= 0.35 THEN b1 || b1 END AS call FROM w""")
def calls_from_depths(spark, d):
    """The two deepest bases of three decide a call."""
    n = lambda c: F.count_if(c)
    x = t(spark, d, "lineitem").groupBy("l_suppkey").agg(n(F.col("l_returnflag") == "A").alias("a"), n(F.col("l_returnflag") == "N").alias("c"), n((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).alias("g"))
    depths = F.create_map(F.lit("A"), F.col("a"), F.lit("C"), F.col("c"), F.lit("G"), F.col("g"))
    return x.select("l_suppkey", seq.call_from_depths(depths, het=0.4, hom=0.35).alias("call"))


@register("indel_changes", f"""
WITH x AS (SELECT p_partkey, p_size, {DNA} AS s FROM part), y AS (SELECT p_partkey, p_size, s[1:p_size % 3 + 1] AS a, s[1:p_size % 5 + 1] AS b FROM x)
SELECT p_partkey, CAST(sign(length(b) - length(a)) AS INTEGER) AS sign, CAST(abs(length(b) - length(a)) AS INTEGER) AS size, CASE WHEN length(b) > length(a) THEN b[length(a) + 1:] WHEN length(b) < length(a) THEN a[length(b) + 1:] ELSE '' END AS bases, CAST(CASE p_size % 3 WHEN 0 THEN p_size WHEN 1 THEN -p_size END AS INTEGER) AS code FROM y""")
def indel_changes(spark, d):
    """Sign, size and bases of a change of length, and the number of a code such as D2."""
    code = F.concat(F.element_at(F.array(F.lit("I"), F.lit("D"), F.lit("S")), (F.col("p_size") % 3 + 1).cast("int")), F.col("p_size"))
    x = strands(spark, d).select("p_partkey", seq.indel(F.expr("left(s, p_size % 3 + 1)"), F.expr("left(s, p_size % 5 + 1)")).alias("i"), seq.indel_code(code).alias("code"))
    return x.select("p_partkey", "i.*", "code")


@register("cleaned_names", "SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS chrom, 'X' || s_suppkey AS accession, s_nationkey + 0.5::DOUBLE AS share, CASE WHEN s_nationkey % 3 <> 0 THEN s_name END AS known FROM supplier")
def cleaned_names(spark, d):
    k = F.col("s_nationkey")
    chrom = F.concat(F.when(k % 3 == 0, "chr").when(k % 3 == 1, "Chromosome_").otherwise(""), k)
    known = F.when(k % 3 == 0, F.when(k % 2 == 0, "NA").otherwise(".")).otherwise(F.col("s_name"))
    s = t(spark, d, "supplier")
    return s.select("s_suppkey", text.strip_chromosome(chrom).alias("chrom"), text.clean_accession(F.concat(F.lit("gb|X"), F.col("s_suppkey"), F.lit(".1|"))).alias("accession"), text.percent(F.concat(k, F.lit(".5%"))).alias("share"), text.missing(known).alias("known"))


@register("sequence_cuts", f"""
WITH x AS (SELECT p_partkey, p_name, {DNA} AS s FROM part)
SELECT p_partkey, s[greatest(1, 5 - 3):4] AS up, s[6:8] AS down, p_name || '_' || s[1:4] AS name, s[5:] AS rest, regexp_matches(s, 'AAA|CCC|GGG|TTT') AS run FROM x""")
def sequence_cuts(spark, d):
    """Three bases around the fifth, a tag of four bases moved to the name, and whether a base comes three times running."""
    s = F.col("s")
    x = strands(spark, d).select("p_partkey", seq.flanks(s, F.lit(5), 3).alias("f"), seq.umi(s, F.col("p_name"), 4).alias("u"), seq.homopolymer(s, 3).alias("run"))
    return x.select("p_partkey", "f.up", "f.down", "u.name", F.col("u.seq").alias("rest"), "run")


@register("consensus_pairs", f"""
WITH x AS (SELECT p_partkey, {DNA} AS s FROM part), p AS (SELECT a.p_partkey, a.s AS a, b.s AS b FROM x a JOIN x b ON b.p_partkey = a.p_partkey + 1 AND length(a.s) = length(b.s)),
c AS (SELECT p_partkey, i, CASE WHEN i = 2 THEN b[i] ELSE least(a[i], b[i]) || CASE WHEN a[i] <> b[i] THEN greatest(a[i], b[i]) ELSE '' END END AS w FROM p, generate_series(1, 40) g(i) WHERE i <= length(a))
SELECT p_partkey, string_agg(code, '' ORDER BY i) AS consensus FROM c JOIN {CODES} ON bases = w GROUP BY 1""")
def consensus_pairs(spark, d):
    """Neighbouring sequences of one length; the first has a gap at its second base."""
    x = dna(spark, d)
    y = x.select("p_partkey", F.expr("overlay(s PLACING '-' FROM 2 FOR 1)").alias("a")).join(x.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("s").alias("b")), "p_partkey")
    return y.filter(F.length("a") == F.length("b")).select("p_partkey", seq.consensus(F.col("a"), F.col("b")).alias("consensus"))


@register("kmer_windows", f"WITH x AS (SELECT p_partkey, {DNA} AS s FROM part) SELECT p_partkey, CAST(i - 1 AS INTEGER) AS at, s[i:i + 4] AS kmer FROM x, generate_series(1, 100) g(i) WHERE i + 4 <= length(s)")
def kmer_windows(spark, d):
    return dna(spark, d).select("p_partkey", F.posexplode(seq.kmers("s", 5)).alias("at", "kmer"))


@register("kmer_entropies", f"""
WITH x AS (SELECT p_partkey, {DNA} AS s FROM part), w AS (SELECT p_partkey, k, s[i:i + k - 1] AS w FROM x, (SELECT unnest([1, 2, 3]) AS k), generate_series(1, 100) g(i) WHERE i + k - 1 <= length(s)),
c AS (SELECT p_partkey, k, w, count(*) AS n FROM w GROUP BY ALL), e AS (SELECT p_partkey, k, n / sum(n) OVER (PARTITION BY p_partkey, k) AS p FROM c)
SELECT p_partkey, CAST(k AS INTEGER) AS k, round(abs(sum(-p * log2(p))), 6) AS entropy FROM e GROUP BY 1, 2""")
def kmer_entropies(spark, d):
    x = dna(spark, d)
    return x.select("p_partkey", F.posexplode(F.array(*[seq.entropy("s", k) for k in (1, 2, 3)])).alias("k", "e")).select("p_partkey", (F.col("k") + 1).alias("k"), r(F.abs("e")).alias("entropy"))


@register("map_and_curve", """
WITH x AS (SELECT p_partkey, p_size / 100.0::DOUBLE AS c, p_retailprice / 1000 AS v FROM part), y AS (SELECT *, 0.5::DOUBLE * c / (1 - c) AS q FROM x)
SELECT p_partkey, CASE WHEN q < 0.5 THEN round(25 * ln((1 + 2 * q) / (1 - 2 * q)), 6) END AS centimorgans, round(1 / (1 + 2 * exp(-3 * v)), 6) AS logistic, round(-log10(greatest(c, 0.05::DOUBLE)), 6) AS minus_log, floor(v * 100 + 0.5) / 100 AS half_up, round(sqrt((c - v) * (c - v) + (v - 1) * (v - 1)), 6) AS distance FROM y""")
def map_and_curve(spark, d):
    x = t(spark, d, "part").select("p_partkey", (F.col("p_size").cast("double") / 100).alias("c"), (F.col("p_retailprice") / 1000).alias("v"))
    return x.select("p_partkey", r(text.kosambi(F.col("c"))).alias("centimorgans"), r(text.logistic(F.col("v"), 2.0, 3.0)).alias("logistic"), r(text.minus_log10(F.col("c"), 0.05)).alias("minus_log"), text.round_half_up(F.col("v")).alias("half_up"), r(text.euclidean(F.array("c", "v"), F.array(F.col("v"), F.lit(1.0)))).alias("distance"))


@register("exclusion_chances", """
WITH f AS (SELECT p_size, count(*) FILTER (p_partkey % 3 = 0) AS a, count(*) FILTER (p_partkey % 3 = 1) AS b, count(*) FILTER (p_partkey % 3 = 2) AS c FROM part GROUP BY 1), p AS (SELECT p_size, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM f),
s AS (SELECT p_size, a*a+b*b+c*c AS s2, pow(a,3)+pow(b,3)+pow(c,3) AS s3, pow(a,4)+pow(b,4)+pow(c,4) AS s4, pow(a,5)+pow(b,5)+pow(c,5) AS s5, pow(a,6)+pow(b,6)+pow(c,6) AS s6 FROM p)
SELECT p_size, round(1 - 2*s2 + s3 + 2*s4 - 3*s5 - 2*s2*s2 + 3*s2*s3, 6) AS trio, round(1 - 4*s2 + 2*s2*s2 + 4*s3 - 3*s4, 6) AS duo, round(1 + 4*s4 - 4*s5 - 3*s6 - 8*s2*s2 + 8*s2*s3 + 2*s3*s3, 6) AS pair FROM s""")
def exclusion_chances(spark, d):
    """Allele shares of each size's parts, and the three chances of exclusion."""
    n = [F.count_if(F.col("p_partkey") % 3 == i) for i in range(3)]
    g = t(spark, d, "part").groupBy("p_size").agg(F.array(*n).alias("n"), F.count("*").alias("all"))
    p = g.select("p_size", F.transform("n", lambda v: v / F.col("all")).alias("p"))
    return p.select("p_size", r(seq.exclusion_probability(F.col("p"))).alias("trio"), r(seq.exclusion_duo(F.col("p"))).alias("duo"), r(seq.exclusion_pair(F.col("p"))).alias("pair"))


@register("sizes_with_units", """
WITH x AS (SELECT o_orderkey, o_orderkey * o_orderkey AS n FROM orders)
SELECT o_orderkey, CASE WHEN n >= 1000000000000 THEN printf('%.1f TB', (n + 50000000000) // 100000000000 / 10) WHEN n >= 1000000000 THEN printf('%.1f GB', (n + 50000000) // 100000000 / 10) WHEN n >= 1000000 THEN printf('%.1f MB', (n + 50000) // 100000 / 10) WHEN n >= 1000 THEN printf('%.1f KB', (n + 50) // 100 / 10) ELSE printf('%.1f B', n::DOUBLE) END AS si,
CAST(o_orderkey * 1024 * 1024 AS BIGINT) AS bytes FROM x""")
def sizes_with_units(spark, d):
    """Squares of keys with a unit, and keys with one as bytes."""
    n = F.col("o_orderkey") * F.col("o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", text.humanized(n, 1000).alias("si"), text.human2bytes(F.concat("o_orderkey", F.lit(" Mi"))).alias("bytes"))


@register("packed_flags", "SELECT p_partkey, CAST((p_size % 2 = 0)::INT + 2 * regexp_matches(p_name, 'widget')::INT + 4 * (p_brand = 'Brand#13')::INT AS INTEGER) AS flags FROM part")
def packed_flags(spark, d):
    return t(spark, d, "part").select("p_partkey", text.flag_bits(F.col("p_size") % 2 == 0, F.col("p_name").rlike("widget"), F.col("p_brand") == "Brand#13").alias("flags"))


@register("html_to_markdown", "SELECT p_partkey, '## ' || p_name || chr(10) || '**' || p_brand || '** [' || p_size || '](u' || p_partkey || ')' || chr(10) || '- *' || p_type || '*' AS md, p_name || ' ' || p_brand || ' ' || p_size || ' ' || p_type || ' & <' AS plain FROM part")
def html_to_markdown(spark, d):
    page = F.concat(F.lit("<h2 class='x'>"), "p_name", F.lit("</h2><p><b>"), "p_brand", F.lit("</b> <a href='u"), "p_partkey", F.lit("'>"), "p_size", F.lit("</a></p><li><em>"), "p_type", F.lit("</em></li>"))
    return t(spark, d, "part").select("p_partkey", text.markdown(page).alias("md"), text.html_text(F.concat(page, F.lit("<script>x<y</script> &amp; &lt;"))).alias("plain"))


@register("special_functions", """
SELECT p_partkey, round(lgamma(p_size + 0.5), 6) AS lg, round(1 - pow(1 - p_size / 100.0, 3), 6) AS beta, round(1 - exp(-p_size / 10.0), 6) AS gamma FROM part WHERE p_size > 0""")
def special_functions(spark, d):
    """Log-gamma, and the incomplete beta and gamma functions where they are a power and an exponential."""
    x = F.col("p_size").cast("double")
    return t(spark, d, "part").filter("p_size > 0").select("p_partkey", r(stats.log_gamma(x + 0.5)).alias("lg"), r(stats.incomplete_beta(F.lit(1.0), F.lit(3.0), x / 100)).alias("beta"), r(stats.incomplete_gamma(F.lit(1.0), x / 10)).alias("gamma"))


@register("user_functions", "SELECT p_partkey, p_size + p_retailprice AS total, sqrt(p_retailprice) AS root, CAST(p_size AS BIGINT) & 12 AS anded FROM part")
def user_functions(spark, d):
    """A user's functions of two columns and of one, by name in SQL and through the calculator, beside the built-in ones."""
    registry.register(spark)
    registry.add(spark, "hx_user_total", lambda a, b: a + b, T.DoubleType())
    registry.add(spark, "hx_user_root", lambda a: a**0.5, T.DoubleType())
    t(spark, d, "part").createOrReplaceTempView("parts_for_functions")
    p = spark.sql("SELECT p_partkey, p_retailprice, hx_user_total(p_size, p_retailprice) AS total, hx_and(p_size, 12) AS anded FROM parts_for_functions")
    return p.select("p_partkey", "total", calc.call("custom", "hx_user_root", F.col("p_retailprice")).alias("root"), "anded")
