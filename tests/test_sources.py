"""Readers on literal records, and round trips through the writers."""

import gzip

import pytest
from pyspark.sql import functions as F

from helixframe.sources import records as R
from helixframe.sources import sinks as S


@pytest.fixture
def put(tmp_path):
    def f(name, text):
        path = tmp_path / name
        if name.endswith(".gz"):
            path.write_bytes(gzip.compress(text.encode()))
        else:
            path.write_text(text)
        return str(path)

    return f


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_positional_tables(spark, put):
    path = put("a.tsv", "#c\n;x\nchr1\t5\t.\r\nchr2\tbad\tv\textra\nshort\n")
    assert rows(R.positional(spark, path, "chrom string, pos long, v string", missing=(".",), width=3)) == [("chr1", 5, None), ("chr2", None, "v")]
    assert rows(R.whitespace(spark, put("b", "  a   1\nb\t2 \n"), "k string, n long")) == [("a", 1), ("b", 2)]
    assert rows(R.quirky_csv(spark, put("c.csv", ";no\nan id,1,\r\nb,2\r\n"), "id string, n int")) == [("an_id", 1), ("b", 2)]
    df = R.headed(spark, put("d.tsv", "#CHROM\tx read1\tn\n1\t2\t\n"), rename=(r"_read(\d)$", r"_reads\1"))
    assert df.columns == ["CHROM", "x_reads1", "n"] and rows(df) == [("1", "2", None)]
    assert rows(R.ragged(spark, put("e", "c\t7\tA\tA C - T\n"))) == [("c", 7, "A", ["A", "C", "-", "T"])]
    assert rows(R.lines(spark, put("z.txt.gz", "one\ntwo\n"))) == [("one",), ("two",)]


def test_fasta_and_fastq(spark, put):
    assert rows(R.fasta(spark, put("a.fa", ">s1 a comment\nACGT\nAC\n>s2\nNNNNNNNN\n"))) == [("s1", "a comment", "ACGTAC"), ("s2", "", "NNNNNNNN")]
    mixed = put("m.fx", ">1\nacgtacgtacgtagc\n>2 test\nacgatcgatc\n@3 test2\nacgt\nac\n+\n@@@@\n>>\n@4\na\n+\n!\n")
    got = sorted(rows(R.fastx(spark, mixed).select("ordinal", "name", "comment", "seq", "qual")))
    assert got == [(0, "1", "", "acgtacgtacgtagc", None), (1, "2", "test", "acgatcgatc", None), (2, "3", "test2", "acgtac", "@@@@>>"), (3, "4", "", "a", "!")]
    a = put("r1.fq", "@x/1 c\nAC\n+\nII\n@y/1\nGG\n+\n##\n")
    b = put("r2.fq", "@x/2\nTT\n+\nII\n@y/2\nCC\n+\n!!\n")
    assert sorted(rows(R.fastq(spark, a))) == [("x/1", "c", "AC", "II"), ("y/1", "", "GG", "##")]
    assert sorted(rows(R.paired(R.fastq(spark, a), R.fastq(spark, b)))) == [("x", "AC", "II", "TT", "II"), ("y", "GG", "##", "CC", "!!")]


def test_alignments(spark, put):
    path = put("a.sam", "@HD\tVN:1.6\n@SQ\tSN:c1\tLN:10\n@SQ\tSN:c2\tLN:7\ns0\t64\tc1\t1\t0\t10M\t*\t0\t0\tAACCGCGGTT\t**********\tNM:i:0\tXA:Z:c2,-5,4M,1;c1,+9,3M,0;\ns1\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n")
    df = R.sam(spark, path)
    assert rows(df.select("qname", "flag", "rname", "pos", "cigar", "rnext", "seq", "qual")) == [("s0", 64, "c1", 1, "10M", None, "AACCGCGGTT", "**********"), ("s1", 4, None, 0, None, None, "A", None)]
    hits = df.select(R.alternative_hits(F.col("tags")).alias("x")).collect()
    assert [tuple(h) for h in hits[0]["x"]] == [("c2", "-", 5, "4M", 1), ("c1", "+", 9, "3M", 0)] and hits[1]["x"] is None
    assert rows(df.filter((F.col("flag").bitwiseAND(F.lit(64)) == 64) & (F.col("flag").bitwiseAND(F.lit(1796)) == 0)).select("qname")) == [("s0",)]
    assert rows(R.sam_contigs(spark, path)) == [("c1", 10), ("c2", 7)]


def test_variants(spark, put):
    path = put("a.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\nc1\t9\t.\tA\tC,G\t50.5\tPASS\tDP=7;DB\tGT:AD\t0/1:3,4,0\t./.\nc2\t3\trs\tT\t.\t.\t.\t.\tGT\t0/0\t0/0\n")
    a, b = R.vcf(spark, path).orderBy("chrom").collect()
    assert (a["chrom"], a["pos"], a["id"], a["alt"], a["qual"], a["info"]) == ("c1", 9, None, ["C", "G"], 50.5, {"DP": "7", "DB": ""})
    assert a["samples"] == {"S1": {"GT": "0/1", "AD": "3,4,0"}, "S2": {"GT": "./.", "AD": None}}
    assert (b["id"], b["alt"], b["qual"], b["info"]) == ("rs", None, None, {})


def test_annotations(spark, put):
    g = R.gff(spark, put("a.gff", "##gff\nchr1\tsrc\tmRNA\t1\t9\t.\t+\t.\tID=m1;Parent=g1,g2;Note=a%20b\nshort\tline\n")).first()
    assert (g["seqname"], g["start"], g["end"], g["score"], g["strand"]) == ("1", 1, 9, None, "+")
    assert g["groups"] == {"ID": ["m1"], "Parent": ["g1", "g2"], "Note": ["a b"]}
    t = R.gtf(spark, put("a.gtf", 'c\ts\ttranscript\t1\t5\t.\t-\t.\tgene_id "G 1"; level 2;\n')).first()
    assert t["groups"] == {"gene_id": "G 1", "level": "2"} and t["strand"] == "-"
    assert rows(R.bed(spark, put("a.bed", "#x\nchrX\t11296915\t11296916\tAMELX\n")).select("chrom", "start", "end", "name")) == [("chrX", 11296915, 11296916, "AMELX")]
    assert rows(R.positions(spark, put("p", "c 5\nd\t6\n"))) == [("c", 5), ("d", 6)]


def test_reports(spark, put):
    line = "q\ts\t99.5\t10\t9\t1\t0\t1\t10\t5\t14\t3e-11\t40.1\t10\n"
    assert rows(R.blast(spark, put("b", line)).select("qid", "identity", "e", "btop")) == [("q", 99.5, 3e-11, "10")]
    report = "BLASTN\nQuery= q1 len\n>s1 desc\n Score = 40.1 bits (20), Expect = 3e-11\n>s2\n Score = 30 bits, Expect(2) = 0.5\nQuery= q2\n no hits\n"
    assert sorted(rows(R.blast_report(spark, put("r", report)))) == [("q1", "s1", 40.1, 3e-11), ("q1", "s2", 30.0, 0.5)]
    psl = "match\tmis\n" + "\t".join(["9", "1", "0", "0", "0", "0", "0", "0", "+", "q", "10", "0", "10", "t", "99", "5", "15", "1", "10,", "0,", "5,"]) + "\n"
    assert rows(R.psl(spark, put("p.psl", psl)).select("match", "qname", "tend")) == [(9, "q", 15)]
    assert rows(R.kmers(spark, put("k", "ACGT 5\nTTTT 1\n"))) == [("ACGT", 5), ("TTTT", 1)]
    assert sorted(rows(R.depth_track(spark, put("d", ">c1\n1 2\n3\n>c2\n7\n")))) == [("c1", 1, 1), ("c1", 2, 2), ("c1", 3, 3), ("c2", 1, 7)]
    assert sorted(rows(R.groups(spark, put("g", ">1=one\na\nb\n>2=two\nc\n")))) == [("1", "one", "a"), ("1", "one", "b"), ("2", "two", "c")]
    emf = "SEQ human 1 5 7 1\nSEQ mouse 2 9 11 -1\nDATA\nAC\nGT\nA-\n//\n"
    assert sorted(rows(R.alignment_blocks(spark, put("e", emf)).drop("block"))) == [("human", "1", 5, 7, "1", "AGA"), ("mouse", "2", 9, 11, "-1", "CT-")]


def test_configuration():
    assert R.sections("a=1\n# no\n[files]\nx\ny = 2\n") == {"": {"a": "1"}, "files": {"": ["x"], "y": "2"}}
    assert R.nested("a:\n  b: 1\n  c:\n    - x\n    - y\nd: 'e' # no\n") == {"a": {"b": "1", "c": ["x", "y"]}, "d": "e"}


def test_many_files(spark, put, tmp_path):
    one, two = put("s1.k", "A 1\n"), put("s2.k", "C 2\n")
    got = R.many(spark, str(tmp_path / "*.k"), R.kmers)
    assert sorted(rows(got)) == [("A", 1, "s1"), ("C", 2, "s2")]
    assert sorted(rows(R.manifest(spark, put("list", f"x\t{one}\ny\t{two}\n"), R.kmers))) == [("A", 1, "x"), ("C", 2, "y")]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c1", 5, "a"), ("c2", 6, None), ("c1", 90, "b")], "chrom string, pos long, v string")
    S.tsv(df, str(tmp_path / "t"), compression="gzip", missing=".")
    assert sorted(rows(R.headed(spark, str(tmp_path / "t"), missing=".").select("chrom", "pos", "v")), key=str) == [("c1", "5", "a"), ("c1", "90", "b"), ("c2", "6", None)]
    S.partitioned(df, str(tmp_path / "p"), "chrom", sort=("pos",))
    back = spark.read.parquet(str(tmp_path / "p"))
    picked = R.region(back, "c1", 1, 50)
    assert rows(picked.select("pos")) == [(5,)]
    assert "PartitionFilters: [isnotnull(chrom" in picked._jdf.queryExecution().executedPlan().toString()
    S.several({"matched": df.limit(1), "left": df.limit(0)}, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m/matched")).count() == 1
    reads = spark.createDataFrame([("r1", "ACGTACGTAC", "IIIIIIIIII"), ("r2", "A", "#")], "name string, seq string, qual string")
    S.fasta(reads, str(tmp_path / "f"), width=4)
    assert sorted(rows(R.fasta(spark, str(tmp_path / "f")).select("name", "seq"))) == [("r1", "ACGTACGTAC"), ("r2", "A")]
    S.fastq(reads, str(tmp_path / "q"))
    assert sorted(rows(R.fastq(spark, str(tmp_path / "q")).select("name", "seq", "qual"))) == [("r1", "ACGTACGTAC", "IIIIIIIIII"), ("r2", "A", "#")]
    assert spark.range(1).select(S.wrapped(F.lit("ACGTAC"), 3).alias("w")).first()["w"] == "ACG\nTAC"
    matrix = S.nexus(spark.createDataFrame([("a", "b", 0.5)], "a string, b string, d double"), "a", "b", "d")
    assert "b 0.500000 0" in matrix
    assert rows(df.select(S.json_column("chrom", "pos").alias("j")).limit(1)) == [('{"chrom":"c1","pos":5}',)]


def test_bucketed_table_joins_without_a_shuffle_of_its_side(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    S.table(df, "bucketed_a", "id", 8, "id")
    S.table(df, "bucketed_b", "id", 8, "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.table("bucketed_a").join(spark.table("bucketed_b"), "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table bucketed_a")
        spark.sql("drop table bucketed_b")
    assert "Exchange" not in plan


def test_tandem_repeat_results(spark, put):
    sample = "1.0\nPCR\n{}\n3\n4\n5\n6\n7\n2\nD3\n1\nx\nx\nx\n2\n14\n15\nTH01\n1\nx\nx\nx\n0\n"
    text = "DNA Analysis Result\n" + sample.format("S1") + "DNA Analysis Result\n" + sample.format("S2") + "DNA Analysis Result\n"
    got = sorted((r["sample"], r["locus"], r["alleles"]) for r in R.str_results(spark, put("s.dat", text)).collect())
    assert got == [("S1", "D3", ["14", "15"]), ("S1", "TH01", []), ("S2", "D3", ["14", "15"]), ("S2", "TH01", [])]


def test_fastq_qualities_that_begin_with_the_separator(spark, put):
    import random

    rnd = random.Random(1)
    reads = [(f"r{i}", "c d" if i % 3 == 0 else "", "".join(rnd.choice("ACGT") for _ in range(n)), "".join(rnd.choice("@+I#!>") for _ in range(n))) for i, n in enumerate(rnd.randrange(1, 60) for _ in range(800))]
    path = put("at.fq", "".join(f"@{name}{' ' + comment if comment else ''}\n{s}\n+\n{q}\n" for name, comment, s, q in reads))
    for size in ("128MB", "1000", "333"):  # blocks end anywhere, between the halves of a record too
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            assert sorted(rows(R.fastq(spark, path))) == sorted(reads)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
