"""Record formats over the driver's tables: a table is written in a format and read back, and SQL over the table itself says what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.catalog import register
from helixframe.plans.common import t
from helixframe.plans.scalars import DNA, dna
from helixframe.session import shared_folder
from helixframe.sources import records, sinks
from helixframe.streaming import operators as streaming

QUALITY = f"translate({DNA}, 'ACGT', 'I5@#')"


def put(df: DataFrame, line: Column, header: Column | str | None = None, **options: str) -> list[str]:
    """Paths of ``line`` of every row as text and, in a folder of its own, of the header that the format has once."""
    path = shared_folder(df.sparkSession, "records")
    df.select(line.alias("value")).write.options(**options).text(f"{path}/body")
    if header is None:
        return [f"{path}/body"]
    df.sparkSession.range(1).select(F.lit(header).alias("value")).write.text(f"{path}/header")
    return [f"{path}/header", f"{path}/body"]


def fields(*columns) -> Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts with their names as sequences ``s`` and a quality ``q`` for each base."""
    return dna(spark, d).withColumn("q", F.translate("s", "ACGT", "I5@#")).join(t(spark, d, "part"), "p_partkey")


PART = "SELECT p_partkey, p_name, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS BIGINT) END AS p_size FROM part"


@register("scan_positional", PART)
def scan_positional(spark, d):
    """Comment lines before some rows, carriage returns, a mark for missing values and a field too many."""
    row = fields("p_partkey", "p_name", F.when(F.col("p_size") % 7 == 0, ".").otherwise(F.col("p_size").cast("string")), F.lit("more"))
    path = put(t(spark, d, "part"), F.concat(F.when(F.col("p_size") % 5 == 0, "#no\n;no\n").otherwise(""), row, F.lit("\r")))
    return records.positional(spark, path, "p_partkey long, p_name string, p_size long", missing=(".",), width=3)


@register("scan_whitespace", "SELECT p_partkey, replace(p_name, ' ', '_') AS name, p_retailprice FROM part")
def scan_whitespace(spark, d):
    path = put(t(spark, d, "part"), F.concat(F.lit("  "), F.col("p_partkey"), F.lit(" \t "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("   "), F.col("p_retailprice"), F.lit(" ")))
    return records.whitespace(spark, path, "p_partkey long, name string, p_retailprice double")


@register("scan_quirky_csv", "SELECT replace(p_name, ' ', '_') AS name, p_partkey FROM part")
def scan_quirky_csv(spark, d):
    path = put(t(spark, d, "part"), F.concat(F.lit(";no\n"), F.col("p_name"), F.lit(", "), F.col("p_partkey"), F.lit(",\r")))
    return records.quirky_csv(spark, path, "name string, p_partkey long")


@register("scan_ragged", "SELECT s_name AS chrom, s_suppkey AS pos, 'A' AS ref, CAST(s_nationkey % 4 + 1 AS INTEGER) AS n, CASE WHEN s_nationkey % 4 > 0 THEN 'C' ELSE 'A' END AS last FROM supplier")
def scan_ragged(spark, d):
    calls = F.concat(F.lit("A"), F.expr("repeat(' C', CAST(s_nationkey % 4 AS INT))"))
    g = records.ragged(spark, put(t(spark, d, "supplier"), fields("s_name", "s_suppkey", F.lit("A"), calls)))
    return g.select("chrom", "pos", "ref", F.size("genotypes").alias("n"), F.element_at("genotypes", -1).alias("last"))


HEADED = "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus, o_orderpriority AS priority FROM orders"


@register("scan_headed_tsv", HEADED)
def scan_headed_tsv(spark, d):
    """Columns by name from what the compressing writer wrote, a pattern over their names, and a mark for missing values."""
    path = shared_folder(spark, "records")
    o = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"), F.col("o_orderpriority").alias("pr priority"))
    sinks.tsv(o, path, compression="gzip", missing="NA")
    return records.headed(spark, path, rename=("^pr_", ""), missing="NA")


@register("scan_headed_csv", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || ', \"x\"' AS name, c_mktsegment AS segment FROM customer")
def scan_headed_csv(spark, d):
    """Quoted fields that hold the separator and quotes."""
    path = shared_folder(spark, "records")
    t(spark, d, "customer").select(F.col("c_custkey").alias("#id"), F.concat("c_name", F.lit(', "x"')).alias("name"), F.col("c_mktsegment").alias("segment")).write.option("header", True).option("escape", '"').csv(path)
    return records.headed(spark, path, sep=",", escape='"')


@register("scan_compressed", "SELECT codec, CAST(o_orderkey AS VARCHAR) AS value FROM orders, (SELECT unnest(['gzip', 'bzip2', 'deflate']) AS codec)")
def scan_compressed(spark, d):
    """Each codec by the suffix of its files."""
    out = None
    for codec in ("gzip", "bzip2", "deflate"):
        path = put(t(spark, d, "orders"), F.col("o_orderkey").cast("string"), compression=codec)
        read = records.lines(spark, path).select(F.lit(codec).alias("codec"), "value")
        out = read if out is None else out.unionByName(read)
    return out


SEQUENCES = f"SELECT 'p' || p_partkey AS name, p_name AS comment, {DNA} AS seq FROM part"


@register("scan_fasta", SEQUENCES)
def scan_fasta(spark, d):
    """Sequences wrapped at 7 by the writer and joined again."""
    path = shared_folder(spark, "records")
    sinks.fasta(parts(spark, d).withColumn("name", F.concat(F.lit("p"), "p_partkey", F.lit(" "), "p_name")), path, seq="s", width=7)
    return records.fasta(spark, path)


@register("scan_fastq", f"SELECT 'p' || p_partkey AS name, p_name AS comment, {DNA} AS seq, {QUALITY} AS qual FROM part")
def scan_fastq(spark, d):
    """Qualities that begin with the character of a header among them."""
    path = shared_folder(spark, "records")
    sinks.fastq(parts(spark, d).select(F.concat(F.lit("p"), "p_partkey", F.lit(" "), "p_name").alias("name"), F.col("s").alias("seq"), F.col("q").alias("qual")), path)
    return records.fastq(spark, path)


@register("scan_fastx", f"SELECT 'p' || p_partkey AS name, {DNA} AS seq, CASE WHEN p_size % 2 = 0 THEN {QUALITY} END AS qual FROM part")
def scan_fastx(spark, d):
    """Records with and without qualities in one file, the sequences on two lines."""
    p = parts(spark, d)
    two = F.concat(F.left("s", F.lit(3)), F.lit("\n"), F.expr("substr(s, 4)"))
    plain, quality = F.concat(F.lit(">p"), F.col("p_partkey"), F.lit("\n"), two), F.concat(F.lit("@p"), F.col("p_partkey"), F.lit("\n"), two, F.lit("\n+\n"), F.col("q"))
    return records.fastx(spark, put(p, F.when(F.col("p_size") % 2 == 0, quality).otherwise(plain))).select("name", "seq", "qual")


@register("scan_paired", f"SELECT 'p' || p_partkey AS name, {DNA} AS seq1, {QUALITY} AS qual1, reverse({DNA}) AS seq2, reverse({QUALITY}) AS qual2 FROM part")
def scan_paired(spark, d):
    p = parts(spark, d)
    read = lambda n, s, q: records.fastq(spark, put(p, F.concat(F.lit("@p"), F.col("p_partkey"), F.lit(f"/{n}\n"), s, F.lit("\n+\n"), q)))
    return records.paired(read(1, F.col("s"), F.col("q")), read(2, F.reverse("s"), F.reverse("q")))


def alignments(spark: SparkSession, d: str) -> list[str]:
    li = t(spark, d, "lineitem")
    name = F.concat(F.lit("r"), F.col("l_orderkey"), F.lit("."), F.col("l_linenumber"))
    q = F.col("l_quantity").cast("int")
    hits = F.concat(F.lit("XA:Z:c"), F.col("l_linenumber"), F.when(F.col("l_returnflag") == "R", ",-").otherwise(",+"), q, F.lit(","), q, F.lit("M,1;c0,+7,9M,0;"))
    row = fields(name, (F.col("l_linenumber") * 16), F.when(F.col("l_returnflag") == "N", "*").otherwise(F.col("l_returnflag")), "l_suppkey", q, F.concat(q, F.lit("M")), F.lit("*"), F.lit(0), F.lit(0), F.lit("A"), F.lit("I"), F.concat(F.lit("NM:i:"), q), hits)
    return put(li, row, "@HD\tVN:1.6\n@SQ\tSN:A\tLN:100\n@SQ\tSN:R\tLN:200")


@register("scan_alignments", "SELECT 'r' || l_orderkey || '.' || l_linenumber AS qname, CAST(l_linenumber * 16 AS INTEGER) AS flag, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS rname, CAST(l_suppkey AS BIGINT) AS pos, CAST(l_quantity AS INTEGER) || 'M' AS cigar, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS nm FROM lineitem WHERE (l_linenumber * 16) & 64 = 0")
def scan_alignments(spark, d):
    """Alignment lines whose flag lacks a bit, with one of their tags."""
    a = records.sam(spark, alignments(spark, d))
    return a.filter(F.col("flag").bitwiseAND(F.lit(64)) == 0).select("qname", "flag", "rname", "pos", "cigar", F.try_element_at("tags", F.lit("NM"))["value"].alias("nm"))


@register("scan_alternative_hits", """
WITH x AS (SELECT 'r' || l_orderkey || '.' || l_linenumber AS qname, 'c' || l_linenumber AS c, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS s, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
SELECT qname, c AS contig, s AS strand, CAST(q AS BIGINT) AS pos, q || 'M' AS cigar, 1 AS nm FROM x UNION ALL SELECT qname, 'c0', '+', 7, '9M', 0 FROM x""")
def scan_alternative_hits(spark, d):
    a = records.sam(spark, alignments(spark, d))
    return a.select("qname", F.explode(records.alternative_hits(F.col("tags"))).alias("h")).select("qname", "h.*")


@register("scan_contigs", "SELECT n_name AS contig, CAST(n_nationkey * 10 AS BIGINT) AS length FROM nation")
def scan_contigs(spark, d):
    n = t(spark, d, "nation")
    return records.sam_contigs(spark, put(n, F.concat(F.lit("@SQ\tSN:"), F.col("n_name"), F.lit("\tLN:"), F.col("n_nationkey") * 10), "@HD\tVN:1.6"))


def variants(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    id_ = F.when(F.col("p_size") % 3 == 0, ".").otherwise(F.concat(F.lit("rs"), F.col("p_partkey")))
    one, two = F.concat(F.lit("0/1:"), F.col("p_size"), F.lit(",4")), F.when(F.col("p_size") % 2 == 0, "./.").otherwise(F.lit("1/1:0,9"))
    row = fields("p_brand", "p_partkey", id_, F.lit("A"), F.when(F.col("p_size") % 4 == 0, "C,G").otherwise("T"), "p_retailprice", F.lit("PASS"), F.concat(F.lit("DP="), F.col("p_size"), F.lit(";DB")), F.lit("GT:AD"), one, two)
    return records.vcf(spark, put(p, row, "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2"))


@register("scan_variants", """
SELECT p_brand AS chrom, p_partkey AS pos, CASE WHEN p_size % 3 <> 0 THEN 'rs' || p_partkey END AS id, CASE WHEN p_size % 4 = 0 THEN 'G' ELSE 'T' END AS last_alt, p_retailprice AS qual, CAST(p_size AS VARCHAR) AS dp, '' AS db, p_size || ',4' AS ad1, CASE WHEN p_size % 2 = 0 THEN './.' ELSE '1/1' END AS gt2, CASE WHEN p_size % 2 <> 0 THEN '0,9' END AS ad2 FROM part""")
def scan_variants(spark, d):
    """INFO and sample fields by name; values that a sample leaves out at the end are null."""
    s = lambda n, k: F.col("samples")[n][k]
    return variants(spark, d).select("chrom", "pos", "id", F.element_at("alt", -1).alias("last_alt"), "qual", F.col("info")["DP"].alias("dp"), F.col("info")["DB"].alias("db"), s("S1", "AD").alias("ad1"), s("S2", "GT").alias("gt2"), s("S2", "AD").alias("ad2"))


@register("variants_by_expression", "SELECT p_brand AS chrom, p_partkey AS pos FROM part WHERE p_retailprice >= 950 AND p_size > 10 AND p_size % 2 <> 0")
def variants_by_expression(spark, d):
    """A filter over quality, INFO and a sample's field."""
    return variants(spark, d).filter("qual >= 950 AND CAST(info['DP'] AS INT) > 10 AND samples['S2']['GT'] = '1/1'").select("chrom", "pos")


@register("region_fetch", "SELECT p_brand AS chrom, p_partkey AS pos, p_name FROM part WHERE p_brand = 'Brand#13' AND p_partkey BETWEEN 50 AND 900")
def region_fetch(spark, d):
    """One folder and, by the statistics of its sorted files, some row groups are read."""
    path = shared_folder(spark, "records")
    sinks.partitioned(t(spark, d, "part").select(F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("pos"), "p_name"), path, "chrom", sort=("pos",))
    return records.region(spark.read.parquet(path), "Brand#13", 50, 900).select("chrom", "pos", "p_name")


@register("scan_gff", "SELECT CAST(s_nationkey AS VARCHAR) AS seqname, s_suppkey AS start, s_suppkey + 9 AS \"end\", CASE WHEN s_suppkey % 2 = 0 THEN '+' END AS strand, s_name AS id, 'a b' AS second_note FROM supplier")
def scan_gff(spark, d):
    """Prefixes of chromosomes go, attributes are decoded, and one of several values is taken."""
    strand = F.when(F.col("s_suppkey") % 2 == 0, "+").otherwise(".")
    row = fields(F.concat(F.lit("chr"), F.col("s_nationkey")), F.lit("src"), F.lit("mRNA"), "s_suppkey", F.col("s_suppkey") + 9, F.lit("."), strand, F.lit("."), F.concat(F.lit("ID="), F.replace("s_name", F.lit("#"), F.lit("%23")), F.lit(";Note=x,a%20b")))
    g = records.gff(spark, put(t(spark, d, "supplier"), row, "##gff-version 3"))
    return g.select("seqname", "start", "end", "strand", F.col("groups")["ID"][0].alias("id"), F.col("groups")["Note"][1].alias("second_note"))


@register("scan_gtf", "SELECT s_name AS seqname, s_suppkey AS start, 'G ' || s_suppkey AS gene, CAST(s_nationkey AS VARCHAR) AS level FROM supplier")
def scan_gtf(spark, d):
    row = fields("s_name", F.lit("src"), F.lit("exon"), "s_suppkey", F.col("s_suppkey") + 5, F.lit("."), F.lit("-"), F.lit("."), F.concat(F.lit('gene_id "G '), F.col("s_suppkey"), F.lit('"; level '), F.col("s_nationkey"), F.lit(";")))
    g = records.gtf(spark, put(t(spark, d, "supplier"), F.concat(F.regexp_replace(row, "#", "~"))))
    return g.select(F.replace("seqname", F.lit("~"), F.lit("#")).alias("seqname"), "start", F.col("groups")["gene_id"].alias("gene"), F.col("groups")["level"].alias("level"))


@register("scan_bed", "SELECT p_brand AS chrom, p_partkey AS start, p_partkey + p_size AS \"end\", p_name AS name FROM part")
def scan_bed(spark, d):
    return records.bed(spark, put(t(spark, d, "part"), fields("p_brand", "p_partkey", F.col("p_partkey") + F.col("p_size"), "p_name"), "#chrom\tstart\tend")).select("chrom", "start", "end", "name")


@register("scan_positions", "SELECT p_brand AS chrom, p_partkey AS pos FROM part")
def scan_positions(spark, d):
    return records.positions(spark, put(t(spark, d, "part"), F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string"))))


@register("scan_tabular_hits", "SELECT l_orderkey || '.' || l_linenumber AS qid, CAST(l_partkey AS VARCHAR) AS sid, l_discount AS identity, l_tax AS e, CAST(l_suppkey AS BIGINT) AS length FROM lineitem")
def scan_tabular_hits(spark, d):
    row = fields(F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), "l_partkey", "l_discount", "l_suppkey", *[F.lit(i) for i in range(6)], "l_tax", F.lit(40.5))
    return records.blast(spark, put(t(spark, d, "lineitem"), row), 12).select("qid", "sid", "identity", "e", "length")


@register("scan_pairwise_report", "SELECT 'q' || p_partkey AS query, 's' || i AS subject, CAST(p_size + i AS DOUBLE) AS score, 1e-3::DOUBLE * i AS e FROM part, (SELECT unnest([1, 2]) AS i)")
def scan_pairwise_report(spark, d):
    """Two hits a query."""
    hit = lambda i: F.concat(F.lit(f">s{i} words\n Score = "), F.col("p_size") + i, F.lit(f" bits (9), Expect = {i}e-3\n"))
    return records.blast_report(spark, put(t(spark, d, "part"), F.concat(F.lit("Query= q"), F.col("p_partkey"), F.lit(" length\n"), hit(1), hit(2))))


@register("scan_psl", "SELECT CAST(p_size AS BIGINT) AS match, p_name AS qname, p_brand AS tname, p_partkey AS tstart, p_partkey + p_size AS tend FROM part")
def scan_psl(spark, d):
    zero = [F.lit(0)] * 6
    row = fields("p_size", F.lit(1), *zero, F.lit("+"), "p_name", F.lit(10), F.lit(0), F.lit(10), "p_brand", F.lit(99), "p_partkey", F.col("p_partkey") + F.col("p_size"), F.lit(1), F.lit("10,"), F.lit("0,"), F.lit("5,"))
    return records.psl(spark, put(t(spark, d, "part"), row, "match\tmis-\tof\n---------")).select("match", "qname", "tname", "tstart", "tend")


@register("scan_kmers", f"SELECT {DNA} AS kmer, p_partkey AS count FROM part")
def scan_kmers(spark, d):
    return records.kmers(spark, put(parts(spark, d), F.concat_ws(" ", "s", F.col("p_partkey").cast("string"))))


@register("scan_depth_track", "SELECT s_name AS chrom, CAST(i AS BIGINT) AS pos, CAST(s_nationkey + i AS INTEGER) AS depth FROM supplier, (SELECT unnest([1, 2, 3]) AS i)")
def scan_depth_track(spark, d):
    n = [(F.col("s_nationkey") + i).cast("string") for i in (1, 2, 3)]
    return records.depth_track(spark, put(t(spark, d, "supplier"), F.concat(F.lit(">"), F.col("s_name"), F.lit("\n"), n[0], F.lit(" "), n[1], F.lit("\n"), n[2])))


@register("scan_groups", "SELECT CAST(s_nationkey AS VARCHAR) AS id, 'N' || s_nationkey AS name, s_name AS member FROM supplier")
def scan_groups(spark, d):
    g = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), "\n").alias("m"))
    return records.groups(spark, put(g, F.concat(F.lit(">"), F.col("s_nationkey"), F.lit("=N"), F.col("s_nationkey"), F.lit("\n"), F.col("m"))))


@register("scan_alignment_blocks", f"SELECT 'p' || p_partkey AS species, '1' AS chrom, CAST(1 AS BIGINT) AS start, CAST(length({DNA}) AS BIGINT) AS \"end\", {DNA} AS seq FROM part UNION ALL SELECT 'm' || p_partkey, '2', 5, 9, reverse({DNA}) FROM part")
def scan_alignment_blocks(spark, d):
    """Two sequences a block, a column of both on each line."""
    column = F.array_join(F.zip_with(F.split("s", ""), F.split(F.reverse("s"), ""), lambda a, b: F.concat(a, b, F.lit("\n"))), "")
    block = F.concat(F.lit("SEQ p"), F.col("p_partkey"), F.lit(" 1 1 "), F.length("s"), F.lit(" 1\nSEQ m"), F.col("p_partkey"), F.lit(" 2 5 9 -1\nDATA\n"), column, F.lit("//"))
    return records.alignment_blocks(spark, put(parts(spark, d), block)).select("species", "chrom", "start", "end", "seq")


@register("scan_repeat_results", "SELECT s_name AS sample, 'D' || i AS locus, CASE i WHEN 1 THEN s_nationkey || '/14' ELSE '' END AS alleles FROM supplier, (SELECT unnest([1, 2]) AS i)")
def scan_repeat_results(spark, d):
    """Two loci a sample, one of them without alleles."""
    sample = F.concat(F.lit("DNA Analysis Result\n1.0\nPCR\n"), F.col("s_name"), F.lit("\n3\n4\n5\n6\n7\n2\nD1\n1\nx\nx\nx\n2\n"), F.col("s_nationkey"), F.lit("\n14\nD2\n1\nx\nx\nx\n0"))
    return records.str_results(spark, put(t(spark, d, "supplier"), sample)).select("sample", "locus", F.array_join("alleles", "/").alias("alleles"))


@register("scan_many", "SELECT p_brand AS series, count(*) AS n FROM part GROUP BY 1")
def scan_many(spark, d):
    """Files of a glob, their folders' names as a column."""
    path = shared_folder(spark, "records")
    t(spark, d, "part").select(F.replace("p_brand", F.lit("#"), F.lit("-")).alias("series"), F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string")).alias("value")).write.partitionBy("series").text(path)
    read = records.many(spark, f"{path}/*/*", records.positions, match=r"series=([^/]+)/")
    return read.groupBy(F.replace("series", F.lit("-"), F.lit("#")).alias("series")).agg(F.count("*").alias("n"))


@register("scan_manifest", "SELECT 'parts' AS id, count(*) AS n FROM part UNION ALL SELECT 'suppliers', count(*) FROM supplier")
def scan_manifest(spark, d):
    listed = [("parts", put(t(spark, d, "part"), F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string")))[0]), ("suppliers", put(t(spark, d, "supplier"), F.concat_ws(" ", "s_name", F.col("s_suppkey").cast("string")))[0])]
    names = put(spark.createDataFrame(listed, "id string, path string"), fields("id", "path"))
    return records.manifest(spark, names, records.positions).groupBy("id").agg(F.count("*").alias("n"))


@register("write_by_key", "SELECT p_brand, count(*) AS n, min(p_partkey) AS first, 1 AS folders FROM part GROUP BY 1")
def write_by_key(spark, d):
    """A folder a key, read back by folder."""
    path = shared_folder(spark, "records")
    sinks.partitioned(t(spark, d, "part", "p_brand", "p_partkey"), path, "p_brand", sort=("p_partkey",))
    back = spark.read.parquet(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"p_brand=([^/]+)/", 1))
    return back.groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"), F.count_distinct("file").cast("int").alias("folders"))


@register("write_several", "SELECT 'high' AS output, count(*) AS n FROM part WHERE p_size > 25 UNION ALL SELECT 'low', count(*) FROM part WHERE p_size <= 25")
def write_several(spark, d):
    path, p = shared_folder(spark, "records"), t(spark, d, "part")
    sinks.several({"high": p.filter("p_size > 25"), "low": p.filter("p_size <= 25")}, path)
    read = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("output")) for name in ("high", "low")]
    return read[0].unionByName(read[1]).groupBy("output").agg(F.count("*").alias("n"))


@register("edge_table", "SELECT c_custkey AS src, c_nationkey AS dst, CAST(1 AS INTEGER) AS weight FROM customer")
def edge_table(spark, d):
    path = shared_folder(spark, "records")
    sinks.tsv(sinks.edges(t(spark, d, "customer").withColumn("one", F.lit(1)), "c_custkey", "c_nationkey", "one"), path, header=False)
    return records.positional(spark, path, "src long, dst int, weight int")


@register("configured_sections", "SELECT 'R' || n_regionkey AS section, n_name AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation")
def configured_sections(spark, d):
    """The 25 nations as a sectioned file, read on the driver."""
    rows = t(spark, d, "nation").orderBy("n_regionkey", "n_nationkey").collect()
    lines: list[str] = []
    for n in rows:
        head = f"[R{n['n_regionkey']}]"
        lines += [*([] if head in lines else ["# a region", head]), f"{n['n_name']} = {n['n_nationkey']}"]
    found = records.sections("\n".join(lines))
    return spark.createDataFrame([(s, k, v) for s, pairs in found.items() for k, v in pairs.items()], "section string, key string, value string")


@register("configured_nested", "SELECT 'R' || n_regionkey AS region, n_name AS nation FROM nation")
def configured_nested(spark, d):
    """The 25 nations as lists under their regions, read on the driver."""
    rows = t(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names")).collect()
    found = records.nested("regions:\n" + "\n".join(f"  R{g['n_regionkey']}:\n" + "\n".join(f"    - {n}" for n in g["names"]) for g in rows))
    return spark.createDataFrame([(k, n) for k, names in found["regions"].items() for n in names], "region string, nation string")


@register("waited_files", "SELECT TRUE AS marked, count(*) AS n FROM orders")
def waited_files(spark, d):
    """A folder is read once its done-mark is there."""
    path = shared_folder(spark, "records")
    t(spark, d, "orders").write.parquet(path)
    return spark.read.parquet(path).agg(F.lit(streaming.wait_for(spark, path)).alias("marked"), F.count("*").alias("n"))


@register("distance_matrix", "SELECT n.n_nationkey AS a, m.n_nationkey AS b, round(abs(n.n_regionkey - m.n_regionkey) / 7.0, 6) AS distance FROM nation n JOIN nation m ON m.n_nationkey < n.n_nationkey")
def distance_matrix(spark, d):
    """The triangle of the 25 nations written as a matrix and read from its text."""
    n = t(spark, d, "nation").selectExpr("format_string('%02d', n_nationkey) AS k", "n_regionkey AS v")
    pairs = n.alias("x").join(n.alias("y"), F.col("x.k") < F.col("y.k")).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), (F.abs(F.col("x.v") - F.col("y.v")) / 7).alias("d"))
    rows = sinks.nexus(pairs, "a", "b", "d").split("MATRIX\n")[1].split("\n;")[0].splitlines()
    names = [x.split()[0] for x in rows]
    return spark.createDataFrame([(int(names[i]), int(names[j]), float(v)) for i, x in enumerate(rows) for j, v in enumerate(x.split()[1:-1])], "a int, b int, distance double")
