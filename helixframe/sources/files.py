"""Readers of the file formats: FASTQ, FASTA, GTF, tables of targets, whitelists, assignments, truth, matrices, counters.

All of them are Spark text scans with built-in expressions, so gzip comes with the suffix and any store that Spark
reaches will do. A broken file raises when its rows are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S

ASSIGNMENT_COLUMNS = "read_id long, cell_barcode string, umi string, assignment_type string, gene_id long, transcript_id long, candidate_count long, score int, flags int"


def _check(ok: Column, message: Column | str, value: Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(text).cast("string"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), value. Lines are numbered by the counts of the splits before; nothing is sorted or moved.

    Only a row a split takes part in the running sum."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    by = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0)))
    return rows.join(F.broadcast(splits), ["file", "block"]).select("file", (F.col("id") - F.col("first") + F.col("before")).alias("line"), F.regexp_replace("value", "\r+$", "").alias("value"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """read_id, id (first token), seq (upper case), qual. Four lines a record, checked. read_id is the place in the file;
    files after the first, in the order of their names, go on from multiples of 2 ** 40, so lanes of mates pair by order."""
    lines = numbered_lines(spark, path)
    names = sorted(r[0] for r in spark.read.text(path).select(F.col("_metadata.file_path")).distinct().collect())  # a row a file
    if len(names) > 1:
        lane = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])[F.col("file")]
        lines = lines.withColumn("lane", lane.cast("long") * (1 << 40))
    else:
        lines = lines.withColumn("lane", F.lit(0).cast("long"))
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    g = lines.groupBy("file", (F.col("lane") + F.floor(F.col("line") / 4)).alias("read_id")).agg(part(0).alias("h"), part(1).alias("s"), part(2).alias("p"), part(3).alias("q"), F.count(F.lit(1)).alias("n"))
    where = F.concat(F.lit("FASTQ record "), F.col("read_id").cast("string"), F.lit(": "))
    ok = lambda c, m, v: _check(c, F.concat(where, F.lit(m)), v)
    seq = ok(F.col("n") == 4, "lines are missing", ok(F.col("h").startswith("@"), "no @", ok(F.col("p").startswith("+"), "no +", ok(F.length("s") == F.length("q"), "lengths differ", F.upper("s")))))
    return g.select("read_id", F.get(F.split(F.substr("h", F.lit(2)), r"\s+"), F.lit(0)).alias("id"), seq.alias("seq"), F.col("q").alias("qual"))


def pair_reads(first: DataFrame, second: DataFrame) -> DataFrame:
    """read_id, r1, seq, qual of pairs by place; unequal files raise. The first mate's qualities are not read on."""
    j = first.select("read_id", F.col("seq").alias("r1")).join(second.select("read_id", "seq", "qual"), "read_id", "full_outer")
    both = F.col("r1").isNotNull() & F.col("seq").isNotNull()
    return j.select("read_id", _check(both, "mates are of unequal number", F.col("r1")).alias("r1"), "seq", "qual")


def read_fasta(spark: SparkSession, path: str, must_have_records: bool = False) -> DataFrame:
    """ord, name (first token), header, seq (upper case). Records are read whole, cut at lines that begin with >."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "").alias("v"), F.monotonically_increasing_id().alias("ord")).where(F.trim("v") != "")
    if must_have_records and rows.limit(1).count() == 0:
        raise ValueError(f"no sequence in {path}")
    header = F.trim(F.substring_index("v", "\n", 1))
    body = F.when(F.col("v").contains("\n"), F.regexp_replace("v", "^[^\n]*\n", "")).otherwise(F.lit(""))
    return rows.select("ord", F.get(F.split(header, r"\s+"), F.lit(0)).alias("name"), header.alias("header"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"))


def annotate_targets(fasta: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """ord, target_id, gene, class_bits, seq: from the table where it names the target, else from the header."""
    own = fasta.select("ord", F.col("name").alias("target_id"), "header", "seq")
    gene, kind = S.gene_from_header(F.col("header")), S.class_from_header(F.col("header"))
    if table is None:
        return own.select("ord", "target_id", gene.alias("gene"), kind.alias("class_bits"), "seq")
    j = own.join(table.select("target_id", F.col("gene").alias("_g"), F.col("class_bits").alias("_c")), "target_id", "left")
    return j.select("ord", "target_id", F.coalesce("_g", gene).alias("gene"), F.coalesce("_c", F.when(F.col("_g").isNull(), kind), F.lit(0)).alias("class_bits"), "seq")


def read_target_table(spark: SparkSession, path: str) -> DataFrame:
    """target_id, gene, class_bits (null without a class column); of a repeated target the last line counts."""
    lines = numbered_lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    rows = lines.select("file", "line", F.get(f, F.lit(0)).alias("target_id"), F.get(f, F.lit(1)).alias("gene"), F.get(f, F.lit(2)).alias("class"))
    last = rows.groupBy("target_id").agg(F.max_by(F.struct("gene", "class"), F.struct("file", "line")).alias("x"))
    return last.select("target_id", "x.gene", F.when(F.col("x.class").isNotNull(), S.class_from_token(F.col("x.class"))).alias("class_bits"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """line, contig, feature, start, end, strand, gene_id, transcript_id (with its version), attributes."""
    lines = numbered_lines(spark, path).where(~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    rows = lines.where(F.size(f) >= 9).select("line", at(0).alias("contig"), at(2).alias("feature"), at(3).cast("long").alias("start"), at(4).cast("long").alias("end"), at(6).alias("strand"), S.gtf_attributes(at(8)).alias("attributes"))
    a = F.col("attributes")
    name, version = a["transcript_id"], a["transcript_version"]
    whole = F.when(version.isNotNull() & ~F.coalesce(name.contains("."), F.lit(False)), F.concat(name, F.lit("."), version)).otherwise(name)
    return rows.withColumns({"gene_id": a["gene_id"], "transcript_id": whole})


def transcript_genes(gtf: DataFrame) -> DataFrame:
    """transcript_id, gene_id: the first gene that a transcript is seen with."""
    named = gtf.where(F.col("attributes")["transcript_id"].isNotNull() & F.col("gene_id").isNotNull())
    return named.groupBy(F.col("attributes")["transcript_id"].alias("transcript_id")).agg(F.min_by("gene_id", "line").alias("gene_id"))


def gene_models(gtf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Genes and exons; strands must be + or -, and a gene lies on one contig and strand."""
    rows = gtf.where(F.col("feature").isin("gene", "exon") & F.col("gene_id").isNotNull()).withColumn("strand", _check(F.col("strand").isin("+", "-"), "a strand is neither + nor -", F.col("strand")))
    one = rows.groupBy("gene_id").agg(F.count_distinct("contig", "strand").alias("n"))
    sound = rows.join(one, "gene_id").withColumn("contig", _check(F.col("n") == 1, F.concat(F.lit("several contigs or strands of "), F.col("gene_id")), F.col("contig")))
    columns = ["gene_id", "contig", "strand", "start", "end"]
    return sound.where("feature = 'gene'").select(*columns), sound.where("feature = 'exon' AND transcript_id IS NOT NULL").select("transcript_id", *columns)


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """cb: what stands before a dash, of A, C, G and T only, upper case; none at all is an error, as is a length other than 16."""
    value = F.upper(F.trim(F.substring_index("value", "-", 1)))
    rows = spark.read.text(path).select(value.alias("cb")).where(F.col("cb").rlike("^[ACGT]+$")).distinct()
    if rows.limit(1).count() == 0:
        raise ValueError(f"no barcode in {path}")
    return rows.select(_check(F.length("cb") == 16, "a barcode of a length other than 16", F.col("cb")).alias("cb"))


def read_features(spark: SparkSession, path: str, genes: DataFrame) -> DataFrame:
    """gene: genes (gene) that the first two columns of a feature list name; none is an error."""
    f = F.split("value", "\t")
    names = spark.read.text(path).select(F.explode(F.slice(f, 1, 2)).alias("gene")).where("gene <> ''").distinct()
    found = genes.select("gene").distinct().join(names, "gene", "left_semi")
    if found.limit(1).count() == 0:
        raise ValueError("no feature matches a gene")
    return found


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """The nine columns of an assignment table, and gene_states where there are ten."""
    head = spark.read.text(path).first()
    names = [x.split()[0] for x in ASSIGNMENT_COLUMNS.split(", ")]
    own = head[0].rstrip("\r").split("\t") if head else []
    if own[:9] != names:
        raise ValueError(f"not the header of an assignment table: {own}")
    schema = ASSIGNMENT_COLUMNS + "".join(f", `{x}` string" for x in own[9:])
    return spark.read.csv(path, schema=schema, sep="\t", header=True, nullValue=".")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="read_id long, transcript string, gene string, pos long", sep="\t", header=True)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, cell_id (from 0), count of a MatrixMarket file."""
    lines = numbered_lines(spark, path).where(~F.col("value").startswith("%"))
    shape = lines.groupBy("file").agg(F.min("line").alias("shape"))
    f = F.split(F.trim("value"), r"\s+")
    return lines.join(F.broadcast(shape), "file").where(F.col("line") > F.col("shape")).select((F.get(f, F.lit(0)).cast("long") - 1).alias("gene_id"), (F.get(f, F.lit(1)).cast("long") - 1).alias("cell_id"), F.get(f, F.lit(2)).cast("long").alias("count"))


def read_perf_counters(spark: SparkSession, path: str) -> DataFrame:
    """counter, value of `perf stat` output, comma-separated or free text."""
    v = F.trim("value")
    comma = F.split(v, ",")
    is_csv = (F.size(comma) >= 3) & F.get(comma, F.lit(0)).rlike(r"^[0-9.]+$")
    number = F.when(is_csv, F.get(comma, F.lit(0))).otherwise(F.regexp_replace(F.regexp_extract(v, r"^([0-9][0-9,.]*)\s+\S+", 1), ",", ""))
    name = F.when(is_csv, F.get(comma, F.lit(2))).otherwise(F.regexp_extract(v, r"^[0-9][0-9,.]*\s+(\S+)", 1))
    return spark.read.text(path).select(name.alias("counter"), number.cast("double").alias("value")).where("counter <> '' AND value IS NOT NULL")


def first_targets(fasta: DataFrame, n: int) -> DataFrame:
    """The first n records of a FASTA file, by their order."""
    from ..plans.ordinals import with_ordinal

    return with_ordinal(fasta, ["ord"], "_place").where(F.col("_place") < n).drop("_place")


def first_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """The first n read pairs of a file."""
    return pairs.where(F.col("read_id") < n)
