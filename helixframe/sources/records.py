"""Readers of delimited and sequence-oriented record formats.

Formats whose records are lines are read with Spark's own splittable text and
CSV readers; multi-line records use a record separator where the format has
one. Only formats that need a state machine over a whole file run in Python,
one file a row. Missing values become null on the way in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.text import strip_chromosome


def lines(spark: SparkSession, path, comments: str = "", skip_empty: bool = True) -> DataFrame:
    """Lines without carriage returns and without those that begin with one of the ``comments`` characters. Compressed files are read by their suffix."""
    df = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))
    if comments:
        df = df.filter(~F.col("value").rlike("^[" + re.escape(comments) + "]"))
    return df.filter("value <> ''") if skip_empty else df


def _typed(part: Column, schema: str, missing: tuple[str, ...]) -> list[Column]:
    out = []
    for i, field in enumerate(x.strip().rsplit(" ", 1) for x in schema.split(",")):
        value = F.get(part, F.lit(i))
        value = F.when(~value.isin(*missing), value) if missing else value
        out.append(value.alias(field[0]) if field[1] == "string" else value.try_cast(field[1]).alias(field[0]))
    return out


def positional(spark: SparkSession, path, schema: str, comments: str = "#;", sep: str = "\t", missing: tuple[str, ...] = (), width: int = 0) -> DataFrame:
    """A headerless table by position: ``schema`` as "name type, ...". Rows of fewer than ``width`` fields are dropped; further fields are ignored."""
    df = lines(spark, path, comments).select(F.split("value", sep).alias("f"))
    if width:
        df = df.filter(F.size("f") >= width)
    return df.select(*_typed(F.col("f"), schema, missing))


def whitespace(spark: SparkSession, path, schema: str, comments: str = "#") -> DataFrame:
    """Fields between runs of white space."""
    return lines(spark, path, comments).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f")).select(*_typed(F.col("f"), schema, ()))


def headed(spark: SparkSession, path, sep: str = "\t", rename: tuple[str, str] | None = None, missing: str | None = None, **options: str) -> DataFrame:
    """A table whose first line names its columns; characters that are not of a name become "_", and ``rename`` (pattern, replacement) applies to names. All strings. ``options`` are those of Spark's CSV reader."""
    df = spark.read.options(**options).option("header", True).option("sep", sep).option("nullValue", missing or "").csv(path)
    names = []
    for name in df.columns:
        clean = re.sub(r"\W", "_", name.strip().lstrip("#"))
        names.append(re.sub(*rename, clean) if rename else clean)
    return df.toDF(*names)


def quirky_csv(spark: SparkSession, path, schema: str) -> DataFrame:
    """CSV with ";" comments, carriage returns, a trailing comma, and spaces in the first field that become "_"."""
    df = lines(spark, path, ";").select(F.split(F.regexp_replace("value", ",$", ""), ",").alias("f"))
    cleaned = df.select(F.transform("f", lambda x, i: F.when(i == 0, F.replace(F.trim(x), F.lit(" "), F.lit("_"))).otherwise(F.trim(x))).alias("f"))
    return cleaned.select(*_typed(F.col("f"), schema, ()))


def ragged(spark: SparkSession, path) -> DataFrame:
    """chr, pos, ref and a list of genotypes parted by spaces."""
    f = F.split("value", "\t")
    return lines(spark, path, "#").select(f[0].alias("chrom"), f[1].cast("long").alias("pos"), f[2].alias("ref"), F.split(F.trim(F.get(f, F.lit(3))), r"[ ,]+").alias("genotypes"))


def fasta(spark: SparkSession, path) -> DataFrame:
    """name, comment and sequence; records are parted at ">", so a file splits between them. A ">" inside a header is not supported."""
    raw = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head = F.regexp_replace(F.split("value", "\n", 2)[0], "\r$", "")
    body = F.get(F.split("value", "\n", 2), F.lit(1))
    return raw.select(F.split(F.trim(head), r"\s+", 2)[0].alias("name"), F.coalesce(F.get(F.split(F.trim(head), r"\s+", 2), F.lit(1)), F.lit("")).alias("comment"), F.regexp_replace(F.coalesce(body, F.lit("")), r"\s", "").alias("seq"))


def _fastx_records(content: str) -> Iterator[tuple[str, str, str, str | None]]:
    """FASTA and FASTQ records in any mixture; a quality is read until it is as long as its sequence."""
    rows = content.splitlines()
    i = 0
    while i < len(rows):
        if not rows[i] or rows[i][0] not in ">@":
            i += 1
            continue
        name, _, comment = rows[i][1:].strip().partition(" ")
        seq, quality, i = [], None, i + 1
        while i < len(rows) and (not rows[i] or rows[i][0] not in ">@+"):
            seq.append(rows[i].strip())
            i += 1
        sequence = "".join(seq)
        if i < len(rows) and rows[i][:1] == "+":
            i, got = i + 1, ""
            while i < len(rows) and len(got) < len(sequence):
                got += rows[i].strip()
                i += 1
            quality = got
        yield name, comment, sequence, quality


def fastx(spark: SparkSession, path) -> DataFrame:
    """name, comment, seq and qual (null for FASTA) of files that mix both or wrap lines; whole files are the unit, so keep them of a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows = list(_fastx_records(content or ""))
                columns = [pa.array([where] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), *[pa.array([r[i] for r in rows], pa.string()) for i in range(4)]]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "ordinal", "name", "comment", "seq", "qual"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInArrow(run, "path string, ordinal long, name string, comment string, seq string, qual string")


def fastq(spark: SparkSession, path) -> DataFrame:
    """Four-line FASTQ from splittable files: records are parted at "\\n@", so lines need no numbers.

    A quality that begins with "@" is parted from its record too. Such halves are met again by their places in the file, so
    only they are shuffled; halves that lie in different blocks of a file are the last and the first of theirs.
    """
    raw = spark.read.option("lineSep", "\n@").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    f = F.split(F.regexp_replace("value", "\r", ""), "\n")
    parts = raw.select("file", "block", "value", f.alias("f"))
    marked = F.startswith(F.get("f", F.lit(2)), F.lit("+"))
    whole = parts.filter((F.size("f") >= 4) & marked).select(F.regexp_replace(F.col("f")[0], "^@", "").alias("head"), F.col("f")[1].alias("seq"), F.col("f")[3].alias("qual"))
    numbered = parts.withColumn("at", F.monotonically_increasing_id()).filter(F.size("f") < 4)
    opens = (F.size("f") == 3) & marked
    halves = numbered.select("file", "block", "at", F.when(opens, F.struct(F.regexp_replace(F.col("f")[0], "^@", "").alias("head"), F.col("f")[1].alias("seq"))).alias("a"), F.when(~opens, F.concat(F.lit("@"), F.col("f")[0])).alias("b"))
    met = halves.groupBy("file", "block", (F.col("at") + F.when(F.col("a").isNotNull(), 1).otherwise(0)).alias("at")).agg(F.first("a", True).alias("a"), F.first("b", True).alias("b"))
    within = met.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    follows = F.lead("b").over(Window.partitionBy("file").orderBy("block", "at"))  # one open half a block at most
    across = met.filter(F.col("a").isNull() | F.col("b").isNull()).select("a", follows.alias("b")).filter("a is not null and b is not null")
    mended = within.select("a", "b").unionByName(across).select("a.head", "a.seq", F.col("b").alias("qual"))
    head = F.split("head", r"\s+", 2)
    return whole.unionByName(mended).select(head[0].alias("name"), F.coalesce(F.get(head, F.lit(1)), F.lit("")).alias("comment"), "seq", "qual")


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two reads of a pair by name, without the /1 and /2."""
    strip = lambda df, n: df.select(F.regexp_replace("name", r"/[12]$", "").alias("name"), F.col("seq").alias(f"seq{n}"), F.col("qual").alias(f"qual{n}"))
    return strip(first, 1).join(strip(second, 2), "name")


SAM = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string"


def sam(spark: SparkSession, path) -> DataFrame:
    """Alignment lines of text SAM, with the optional fields as a map of tag to (kind, value)."""
    f = F.split("value", "\t")
    rest = F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0)))
    tags = F.map_from_entries(F.transform(rest, lambda x: F.struct(F.left(x, F.lit(2)).alias("k"), F.struct(F.substring(x, 4, 1).alias("kind"), F.substr(x, F.lit(6), F.length(x)).alias("value")).alias("v"))))
    return lines(spark, path, "@").select(*_typed(f, SAM, ("*",)), tags.alias("tags"))


def sam_contigs(spark: SparkSession, path) -> DataFrame:
    """Contigs and lengths of the header."""
    return lines(spark, path).filter(F.startswith("value", F.lit("@SQ"))).select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))


def alternative_hits(tags: Column) -> Column:
    """The XA tag as a list of (contig, strand, position, cigar, mismatches)."""
    hits = F.filter(F.split(F.try_element_at(tags, F.lit("XA"))["value"], ";"), lambda x: x != "")
    return F.transform(hits, lambda x: F.struct(F.split(x, ",")[0].alias("contig"), F.left(F.split(x, ",")[1], F.lit(1)).alias("strand"), F.abs(F.split(x, ",")[1].cast("long")).alias("pos"), F.split(x, ",")[2].alias("cigar"), F.split(x, ",")[3].cast("int").alias("nm")))


def vcf(spark: SparkSession, path) -> DataFrame:
    """Variants with INFO as a map and samples as a map of name to a map of FORMAT key to value. The header line, one a file, is read first."""
    head = spark.read.text(path).filter(F.startswith("value", F.lit("#CHROM"))).first()
    names = head[0].rstrip("\r").split("\t")[9:] if head else []
    f = F.split("value", "\t")
    keys = F.split(F.get(f, F.lit(8)), ":")
    info = F.map_from_entries(F.transform(F.filter(F.split(f[7], ";"), lambda x: ~x.isin(".", "")), lambda x: F.struct(F.split(x, "=", 2)[0].alias("k"), F.coalesce(F.get(F.split(x, "=", 2), F.lit(1)), F.lit("")).alias("v"))))

    def sample(n: int) -> Column:
        values = F.split(F.get(f, F.lit(9 + n)), ":")
        return F.map_from_arrays(keys, F.transform(keys, lambda k, i: F.get(values, i)))

    fields = [sample(n) for n in range(len(names))]
    samples = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*fields)) if names else F.lit(None).cast("map<string,map<string,string>>")
    miss = lambda c: F.when(c != ".", c)
    return lines(spark, path, "#").select(f[0].alias("chrom"), f[1].cast("long").alias("pos"), miss(f[2]).alias("id"), f[3].alias("ref"), F.split(miss(f[4]), ",").alias("alt"), miss(f[5]).try_cast("double").alias("qual"), miss(f[6]).alias("filter"), info.alias("info"), F.get(f, F.lit(8)).alias("format"), samples.alias("samples"))


def gff(spark: SparkSession, path) -> DataFrame:
    """GFF3 with decoded attributes as a map of tag to values, chromosome prefixes stripped."""
    f = F.split("value", "\t")
    entries = F.filter(F.split(f[8], ";"), lambda x: F.contains(x, F.lit("=")))
    groups = F.map_from_entries(F.transform(entries, lambda x: F.struct(F.trim(F.split(x, "=", 2)[0]).alias("k"), F.transform(F.split(F.split(x, "=", 2)[1], ","), lambda v: F.coalesce(F.try_url_decode(v), v)).alias("v"))))
    miss = lambda c: F.when(c != ".", c)
    return lines(spark, path, "#").filter(F.size(f) >= 9).select(strip_chromosome(f[0]).alias("seqname"), f[1].alias("source"), f[2].alias("primary_inf"), f[3].cast("long").alias("start"), f[4].cast("long").alias("end"), miss(f[5]).alias("score"), miss(f[6]).alias("strand"), miss(f[7]).alias("frame"), groups.alias("groups"))


def gtf(spark: SparkSession, path) -> DataFrame:
    """GTF with quoted attributes as a map."""
    f = F.split("value", "\t")
    pairs = F.regexp_extract_all(f[8], F.lit(r'(\w+ +"[^"]*"|\w+ +[^";\s]+)'), F.lit(1))
    groups = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(F.split(x, " +", 2)[0].alias("k"), F.regexp_replace(F.split(x, " +", 2)[1], '"', "").alias("v")))))
    return lines(spark, path, "#").select(f[0].alias("seqname"), f[1].alias("source"), f[2].alias("feature"), f[3].cast("long").alias("start"), f[4].cast("long").alias("end"), f[6].alias("strand"), groups.alias("groups"))


def bed(spark: SparkSession, path) -> DataFrame:
    """Three columns and more; start from 0, end exclusive."""
    return positional(spark, path, "chrom string, start long, end long, name string, score string, strand string", comments="#", width=3)


def positions(spark: SparkSession, path) -> DataFrame:
    return whitespace(spark, path, "chrom string, pos long")


#: Columns of tabular alignment reports with 12 and with 14 fields, and of PSL.
BLAST12 = "qid string, sid string, identity double, length long, mismatches long, gaps long, qs long, qe long, ss long, se long, e double, bits double"
BLAST14 = "qid string, sid string, identity double, length long, identical long, mismatches long, gap long, qs long, qe long, ss long, se long, e double, bits double, btop string"
PSL = "match long, mismatch long, repmatch long, n long, qgaps long, qgapbases long, tgaps long, tgapbases long, strand string, qname string, qsize long, qstart long, qend long, tname string, tsize long, tstart long, tend long, blocks long, blocksizes string, qstarts string, tstarts string"


def blast(spark: SparkSession, path, fields: int = 14) -> DataFrame:
    return positional(spark, path, BLAST14 if fields == 14 else BLAST12, comments="#", width=12)


def psl(spark: SparkSession, path) -> DataFrame:
    return positional(spark, path, PSL, comments="", width=21).filter("match is not null")


def blast_report(spark: SparkSession, path) -> DataFrame:
    """Hits of a pairwise text report: query, subject, score and e-value; one query is one record between "Query=" marks."""
    raw = spark.read.option("lineSep", "Query=").text(path)
    query = F.trim(F.regexp_extract("value", r"^\s*(\S+)", 1))
    hits = F.regexp_extract_all("value", F.lit(r"(?s)(>.*?Expect[^=]*=\s*[0-9.e+-]+)"), F.lit(1))
    rows = raw.select(query.alias("query"), F.explode(hits).alias("h"))
    return rows.select("query", F.regexp_extract("h", r"^>\s*(\S+)", 1).alias("subject"), F.regexp_extract("h", r"Score\s*=\s*([0-9.]+)", 1).cast("double").alias("score"), F.regexp_extract("h", r"Expect[^=]*=\s*([0-9.e+-]+)", 1).cast("double").alias("e"))


def kmers(spark: SparkSession, path) -> DataFrame:
    return whitespace(spark, path, "kmer string, count long")


def depth_track(spark: SparkSession, path) -> DataFrame:
    """Integers after a ">chrom" line, numbered from 1."""
    raw = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return raw.select(f[0].alias("chrom"), F.posexplode(F.slice(f, F.lit(2), F.greatest(F.size(f) - 1, F.lit(0)))).alias("i", "d")).select("chrom", (F.col("i") + 1).cast("long").alias("pos"), F.col("d").cast("int").alias("depth"))


def groups(spark: SparkSession, path) -> DataFrame:
    """Blocks of ">id=name" with a member on each line."""
    raw = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    f = F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: x != "")
    head = F.split(f[0], "=", 2)
    return raw.select(head[0].alias("id"), F.get(head, F.lit(1)).alias("name"), F.explode(F.slice(f, F.lit(2), F.greatest(F.size(f) - 1, F.lit(0)))).alias("member"))


def alignment_blocks(spark: SparkSession, path) -> DataFrame:
    """Blocks of SEQ lines and DATA rows of one character a sequence, up to "//": block, species, chromosome, bounds, strand and the column as a string."""
    raw = spark.read.option("lineSep", "//").text(path).filter(F.contains("value", F.lit("DATA"))).withColumn("block", F.xxhash64("value"))
    heads = F.regexp_extract_all("value", F.lit(r"(?m)^SEQ (.+)$"), F.lit(1))
    data = F.filter(F.split(F.regexp_replace("value", r"(?s)^.*?DATA\s*\n", ""), "\n"), lambda x: x != "")
    rows = raw.select("block", data.alias("data"), F.posexplode(heads).alias("i", "head"))
    h = F.split("head", r"\s+")
    return rows.select("block", h[0].alias("species"), h[1].alias("chrom"), h[2].cast("long").alias("start"), h[3].cast("long").alias("end"), F.get(h, F.lit(4)).alias("strand"), F.array_join(F.transform("data", lambda x: F.substr(x, F.col("i") + 1, F.lit(1))), "").alias("seq"))


def sections(text: str) -> dict[str, dict[str, str] | list[str]]:
    """An INI-like configuration on the driver: key=value pairs and plain lines by [section]; "" before the first."""
    out: dict = {"": {}}
    now = ""
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#;":
            continue
        if line[0] == "[" and line[-1] == "]":
            now = line[1:-1]
            out[now] = {}
            continue
        key, eq, value = line.partition("=")
        if eq:
            out[now][key.strip()] = value.strip()
        else:
            out[now].setdefault("", []).append(line)
    return out


def nested(text: str) -> dict:
    """A YAML-like configuration on the driver: nested keys by indentation, lists of "- item", scalars as text."""
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    last: tuple[dict, str] | None = None
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        depth = len(body) - len(body.lstrip())
        body = body.strip()
        if body.startswith("- ") and last:
            if not isinstance(last[0][last[1]], list):
                last[0][last[1]] = []
            last[0][last[1]].append(body[2:].strip().strip("\"'"))
            continue
        while stack[-1][0] >= depth:
            stack.pop()
        key, _, value = body.partition(":")
        owner = stack[-1][1]
        owner[key.strip()] = value.strip().strip("\"'") if value.strip() else {}
        if not value.strip():
            last = (owner, key.strip())
            stack.append((depth, owner[key.strip()]))
    return root


def many(spark: SparkSession, pattern: str, reader, name: str = "series", match: str = r"([^/]+?)(\.[^/.]+)*$") -> DataFrame:
    """All files of a glob as one table, with a part of each file's name as a column."""
    return reader(spark, pattern).withColumn(name, F.regexp_extract(F.input_file_name(), match, 1))


def manifest(spark: SparkSession, path, reader) -> DataFrame:
    """The files of a list of "id<TAB>path" lines as one table with the id; the list is read on the driver, the files are not."""
    listed = [r["value"].split("\t") for r in lines(spark, path, "#").collect()]
    frames = [reader(spark, p).withColumn("id", F.lit(i)) for i, p in listed]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def database(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table over JDBC, in ``parts`` ranges of a numeric column; the driver's jar must be on the classpath."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def region(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Rows of one region; on a table written by ``sinks.partitioned`` only that partition is read, and its statistics prune row groups."""
    return df.filter((F.col("chrom") == chrom) & F.col("pos").between(start, end))


def depth_or_zero(column: str, sentinel: int = 65535) -> Column:
    return F.when(F.col(column) == sentinel, 0).otherwise(F.col(column))


def str_results(spark: SparkSession, path) -> DataFrame:
    """Short-tandem-repeat results: sample, locus and alleles. A sample is the text between "DNA Analysis Result" lines.

    Its third line is the sample's name and from the tenth on loci follow: a name, four fields, the number of alleles, and that many alleles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for record in batch.column(0).to_pylist():
                rows = [x.strip() for x in record.strip().splitlines()]
                at = 9
                while at + 5 < len(rows):
                    n = int(rows[at + 5])
                    for column, value in zip(out, (rows[2], rows[at], rows[at + 6 : at + 6 + n]), strict=True):
                        column.append(value)
                    at += 6 + n
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.string()))], names=["sample", "locus", "alleles"])

    raw = spark.read.option("lineSep", "DNA Analysis Result").text(path).filter(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    return raw.mapInArrow(run, "sample string, locus string, alleles array<string>")


def xz_lines(spark: SparkSession, path) -> DataFrame:
    """Lines of xz files, which Spark has no codec for: a file is decompressed in one task as a stream, so many files are read in parallel and one is not held whole as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import lzma

        for batch in batches:
            for content in batch.column(0):
                with lzma.open(io.BytesIO(content.as_py()), "rt", encoding="utf-8", newline="\n") as f:
                    while rows := f.readlines(1 << 20):
                        yield pa.RecordBatch.from_arrays([pa.array([r.rstrip("\r\n") for r in rows], pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")
