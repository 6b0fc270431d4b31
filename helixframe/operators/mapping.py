"""The equivalence-class index and read mapping against it.

The index is one row a k-mer: code, gene_df and targets, the (gene, class_bits) pairs sorted by gene. Reads meet it in an
equi-join on the code; the frequency cap is a filter on the index side, before targets are expanded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.seeds import distinct_seeds, seeds

MOST = 65535


def postings(targets: DataFrame, k: int, s: int | None = None) -> DataFrame:
    """code, gene, class_bits: the classes of a gene's targets that hold a k-mer, or-ed. Rows are dealt by code, so what
    groups them by code next needs no second shuffle."""
    rows = distinct_seeds(targets.select("gene", "class_bits", "seq"), "seq", k, s).select("code", "gene", "class_bits").repartition("code")
    return rows.groupBy("code", "gene").agg(F.bit_or("class_bits").alias("class_bits"))


def build_index(targets: DataFrame, k: int, s: int | None = None) -> DataFrame:
    """code, gene_df, targets."""
    pairs = F.array_sort(F.collect_list(F.struct("gene", "class_bits")))
    return postings(targets, k, s).groupBy("code").agg(pairs.alias("targets")).select("code", F.size("targets").alias("gene_df"), "targets")


def equivalence_classes(index: DataFrame) -> DataFrame:
    """targets, kmers, first_code: an equivalence class is a list of targets; its order is that of its first code."""
    return index.groupBy("targets").agg(F.count(F.lit(1)).alias("kmers"), F.min("code").alias("first_code"))


def hits(reads: DataFrame, index: DataFrame, k: int, stride: int = 1, cap: int = 256, s: int | None = None, both_strands: bool = False) -> DataFrame:
    """read_id, code, gene_df, targets of the seeds that the index holds under the cap; seeds repeat as they occur."""
    return looked_up(seeds(reads.select("read_id", "seq"), "seq", k, stride, s, both_strands).select("read_id", "code"), index, cap)


def distinct_hits(reads: DataFrame, index: DataFrame, k: int, stride: int = 1, cap: int = 256, s: int | None = None, both_strands: bool = False) -> DataFrame:
    """The same with each seed of a read once. Seeds are dealt by code, as the join needs them, and lose their repeats there,
    before they carry targets."""
    found = seeds(reads.select("read_id", "seq"), "seq", k, stride, s, both_strands).select("read_id", "code")
    return looked_up(found.repartition("code").dropDuplicates(["read_id", "code"]), index, cap)


def looked_up(found: DataFrame, index: DataFrame, cap: int) -> DataFrame:
    """Seeds (read_id, code) with what the index holds of them. Spark takes seeds for as small as the reads' files and would
    send them through the driver to broadcast them; a merge join never does."""
    return found.join(index.where(F.col("gene_df") <= max(1, cap)).hint("merge"), "code").select("read_id", "code", "gene_df", "targets")


def gene_scores(found: DataFrame, genes: int) -> DataFrame:
    """Saturating sums of seed weights by (read, gene): total, exon, intron, antisense, unknown."""
    rows = found.select("read_id", S.idf_weight(F.lit(genes), F.col("gene_df")).alias("w"), F.explode("targets").alias("t")).select("read_id", "w", "t.gene", "t.class_bits")

    def part(condition: Column, name: str) -> Column:
        return F.least(F.sum(F.when(condition, F.col("w")).otherwise(0)), F.lit(MOST)).alias(name)

    bits = F.col("class_bits")
    return rows.groupBy("read_id", "gene").agg(
        part(F.lit(True), "total"), part(bits.bitwiseAND(F.lit(1)) != 0, "exon"), part(bits.bitwiseAND(F.lit(2)) != 0, "intron"), part(bits.bitwiseAND(F.lit(4)) != 0, "antisense"), part(bits == 0, "unknown")
    )


def resolve(scores: DataFrame) -> DataFrame:
    """read_id, assignment_type, gene, score, flags, candidate_count, top_genes.

    Among the genes with the best total, the only one with the best exon score wins; else by intron, unknown and total
    score alike; else the read is ambiguous, and its flags are those of all genes that it touches."""
    fields = ["total", "exon", "intron", "antisense", "unknown"]
    # A read's genes: at most seeds x cap.
    g = scores.groupBy("read_id").agg(F.collect_list(F.struct("gene", *fields)).alias("g"))
    best = F.array_max(F.transform("g", lambda x: x["total"]))
    g = g.withColumn("best", best).withColumn("ties", F.filter("g", lambda x: x["total"] == F.col("best")))

    def only(name: str) -> Column:
        most = F.array_max(F.transform("ties", lambda x: x[name]))
        top = F.filter("ties", lambda x: x[name] == most)
        return F.when((most > 0) & (F.size(top) == 1), F.get(top, F.lit(0)))

    g = g.select("read_id", "g", "best", "ties", *[only(x).alias(f"by_{x}") for x in ("exon", "intron", "unknown", "total")])
    winner = F.coalesce("by_exon", "by_intron", "by_unknown", "by_total")
    some = lambda name: F.exists("g", lambda x: x[name] > 0).cast("int")
    flags = (
        F.when(F.col("by_exon").isNotNull(), S.FLAG_EXON)
        .when(F.col("by_intron").isNotNull(), S.FLAG_INTRON)
        .when(F.col("by_unknown").isNotNull(), 0)
        .when(F.col("by_total").isNotNull(), F.when(F.col("by_total.exon") > 0, S.FLAG_EXON).otherwise(0) + F.when(F.col("by_total.intron") > 0, S.FLAG_INTRON).otherwise(0))
        .otherwise(some("exon") * S.FLAG_EXON + some("intron") * S.FLAG_INTRON + some("antisense") * S.FLAG_ANTISENSE)
    )
    score = F.coalesce("by_exon.exon", "by_intron.intron", "by_unknown.unknown", "best")
    order = F.array_sort(F.transform("ties", lambda x: F.struct((-x["exon"]).alias("e"), (-x["intron"]).alias("i"), x["gene"].alias("gene"))))
    kind = F.when(winner.isNotNull(), "unique_gene").otherwise("ambiguous_gene")
    return g.select(
        "read_id", kind.alias("assignment_type"), winner["gene"].alias("gene"), score.cast("long").alias("score"), flags.cast("int").alias("flags"),
        F.size("g").cast("long").alias("candidate_count"), F.transform(order, lambda x: x["gene"]).alias("top_genes"),
    )


def consensus(found: DataFrame, unique: bool = False) -> DataFrame:
    """read_id, assignment_type, gene, score, flags, candidate_count, top: genes that all of a read's distinct seeds agree on.

    top: (gene, state) by gene, the state being the meet over the seeds. At least two distinct seeds are needed. Reads
    without a seed in the index are left out. unique: found has each seed of a read once, as `distinct_hits` makes it.
    One shuffle by read serves all: a seed's row without a target counts the seeds beside those of its genes."""
    if not unique:
        found = found.dropDuplicates(["read_id", "code"])
    own = found.select("read_id", F.transform("targets", lambda t: t["gene"]).alias("genes"), F.transform("targets", lambda t: t["class_bits"].cast("tinyint")).alias("classes")).repartition("read_id")
    each = F.explode(F.concat(F.array(F.lit(-1)), F.sequence(F.lit(0), F.size("genes") - 1)))
    rows = own.where(F.size("genes") > 0).select("read_id", "genes", "classes", each.alias("i"))
    rows = rows.select("read_id", (F.col("i") < 0).alias("seed"), F.get("genes", F.col("i")).alias("gene"), F.get("classes", F.col("i")).cast("int").alias("class_bits"))
    by_gene = rows.groupBy("read_id", "seed", "gene").agg(F.count(F.lit(1)).alias("c"), F.bit_or("class_bits").alias("bits"), S.meet(S.state_of_class(F.col("class_bits"))).alias("state"))
    n = F.max(F.when(F.col("seed"), F.col("c")))
    g = by_gene.groupBy("read_id").agg(n.alias("n"), F.collect_list(F.when(~F.col("seed"), F.struct("gene", "state", "c", "bits"))).alias("g"))
    agreed = F.filter("g", lambda x: (x["c"] == F.col("n")) & (F.col("n") >= 2))
    bits = F.aggregate("agreed", F.lit(0), lambda a, x: a.bitwiseOR(x["bits"]))
    g = g.select("read_id", "n", F.size("g").cast("long").alias("candidate_count"), agreed.alias("agreed"))
    g = g.withColumns({"bits": bits, "top": F.array_sort(F.transform("agreed", lambda x: F.struct(x["gene"].alias("gene"), x["state"].alias("state"))))})
    size = F.size("top")
    kind = F.when(size == 0, "unmapped").when(size == 1, "unique_gene").otherwise("ambiguous_gene")
    bit = lambda b, f: F.when(F.col("bits").bitwiseAND(F.lit(b)) != 0, f).otherwise(0)
    flags = F.coalesce(bit(1, S.FLAG_EXON) + bit(2, S.FLAG_INTRON) + bit(4, S.FLAG_ANTISENSE), F.lit(0))
    score = F.when(size > 0, F.least("n", F.lit(MOST))).otherwise(0).cast("long")
    return g.select("read_id", kind.alias("assignment_type"), F.when(size == 1, F.get("top", F.lit(0))["gene"]).alias("gene"), score.alias("score"), flags.cast("int").alias("flags"), "candidate_count", "top")


def prefilter(reads: DataFrame, k: int, least_quality: float = 10.0, trim: bool = False) -> DataFrame:
    """reads (r1, seq, qual) with seq and qual trimmed, and filter: invalid_barcode, low_quality, low_complexity or pass; in that order."""
    if trim:
        cut = S.tso_trim_length(F.col("seq"))
        reads = reads.withColumn("_cut", cut).withColumns({"seq": F.substr("seq", F.col("_cut") + 1, F.length("seq")), "qual": F.substr("qual", F.col("_cut") + 1, F.length("qual"))}).drop("_cut")
    kind = (
        F.when(~S.valid_barcode(F.col("r1")), "invalid_barcode")
        .when(S.mean_phred(F.col("qual")) < least_quality, "low_quality")
        .when(S.low_complexity(F.col("seq"), k), "low_complexity")
        .otherwise("pass")
    )
    return reads.withColumn("filter", kind)


def map_reads(reads: DataFrame, index: DataFrame, k: int, policy: str = "consensus", genes: int = 0, stride: int = 1, cap: int = 256, s: int | None = None, both_strands: bool = False, trim: bool = False) -> DataFrame:
    """One assignment a read, filtered and unmapped ones included: read_id, cb, umi, assignment_type, gene, candidate_count,
    score, flags, top. policy: consensus (forward strand only) or weighted."""
    if policy == "consensus" and both_strands:
        raise ValueError("consensus looks at the forward strand only")
    checked = prefilter(reads, k, trim=trim)
    some = checked.where(F.col("filter") == "pass")
    if policy == "consensus":
        mapped = consensus(distinct_hits(some, index, k, stride, cap, s), unique=True)
    else:
        mapped = resolve(gene_scores(hits(some, index, k, stride, cap, s, both_strands), genes)).withColumn("top", F.transform("top_genes", lambda x: F.struct(x.alias("gene"), F.lit(S.UNKNOWN).alias("state")))).drop("top_genes")
    out = checked.select("read_id", "r1", "filter").join(mapped, "read_id", "left")
    return out.select(*assigned(), "top")


def assigned(*more: str) -> list[Column]:
    """The columns of an assignment from r1, filter and what mapping found of the read, if anything."""
    lossy, kind = S.lossy_barcode(F.col("r1")), F.col("filter")
    return [
        F.col("read_id"), F.substring(lossy, 1, 16).alias("cb"), F.substring(lossy, 17, 12).alias("umi"),
        F.when(kind.isin("invalid_barcode", "low_quality"), "low_quality").when(kind == "low_complexity", "low_complexity").otherwise(F.coalesce("assignment_type", F.lit("unmapped"))).alias("assignment_type"),
        F.col("gene"), *[F.col(x) for x in more], F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), F.coalesce("score", F.lit(0)).alias("score"),
        F.when(kind == "invalid_barcode", 4).when(kind == "low_quality", 2).when(kind == "low_complexity", 1).otherwise(F.coalesce("flags", F.lit(0))).alias("flags"),
    ]


COUNTABLE = ("unique_gene", "ambiguous_transcript_same_gene")


def rescue(reads: DataFrame, first: DataFrame, again, kinds=("unmapped",), countable: bool = False) -> DataFrame:
    """first, with its reads of these kinds replaced by what `again`, a function of reads, maps of them; those get the rescued flag.

    `again` may search in full and on both strands. countable: only a result that can be counted replaces one; else
    any that is not unmapped does."""
    lost = reads.join(first.where(F.col("assignment_type").isin(*kinds)).select("read_id"), "read_id", "left_semi")
    fits = F.col("assignment_type").isin(*COUNTABLE) if countable else F.col("assignment_type") != "unmapped"
    found = again(lost).where(fits).withColumn("flags", F.col("flags").bitwiseOR(F.lit(S.FLAG_RESCUED)))
    return first.join(found.select("read_id"), "read_id", "left_anti").unionByName(found.select(*first.columns))


def score_failed(assignments: DataFrame) -> DataFrame:
    """The unmapped reads that had places but none that scored."""
    return assignments.where((F.col("assignment_type") == "unmapped") & (F.col("candidate_count") == 0) & (F.col("candidate_hits") > 0))


def two_tier_genes(hot: DataFrame, cold: DataFrame, hot_k: int, cold_k: int) -> DataFrame:
    """gene, gene_id, cold_id: the genes (gene, gene_id) of a cold index by their numbers in the hot one; an error if the
    indexes differ in k or a cold gene is not in the hot index."""
    if hot_k != cold_k:
        raise ValueError(f"hot and cold indexes must have the same k: {hot_k}, {cold_k}")
    own = cold.select("gene", F.col("gene_id").alias("cold_id")).join(hot.select("gene", "gene_id"), "gene", "left")
    known = F.col("gene_id").isNotNull()
    checked = F.when(known, F.col("gene_id")).otherwise(F.raise_error(F.concat(F.lit("a gene of the cold index is not in the hot one: "), F.col("gene"))).cast("long"))
    return own.select("gene", checked.alias("gene_id"), "cold_id")


def with_fallback(reads: DataFrame, first: DataFrame, again, kinds=("unmapped", "ambiguous_gene", "antisense_gene")) -> DataFrame:
    """A second index for reads of these kinds: its result stands where it is a single gene."""
    lost = reads.join(first.where(F.col("assignment_type").isin(*kinds)).select("read_id"), "read_id", "left_semi")
    found = again(lost).where(F.col("assignment_type") == "unique_gene")
    return first.join(found.select("read_id"), "read_id", "left_anti").unionByName(found.select(*first.columns))


def map_metrics(assignments: DataFrame) -> DataFrame:
    """One row: reads, reads by type, and rates."""
    n = F.count(F.lit(1))
    kinds = [F.count_if(F.col("assignment_type") == x).alias(x) for x in S.ASSIGNMENT_TYPES]
    bits = [F.count_if(F.col("flags").bitwiseAND(F.lit(b)) != 0).alias(name) for name, b in (("exon_reads", S.FLAG_EXON), ("intron_reads", S.FLAG_INTRON), ("antisense_reads", S.FLAG_ANTISENSE), ("rescued_reads", S.FLAG_RESCUED))]
    rates = [F.round(F.count_if(F.col("assignment_type") == x) / n, 6).alias(f"{x}_rate") for x in ("unique_gene", "ambiguous_gene", "unmapped")]
    return assignments.agg(n.alias("num_reads"), F.coalesce(F.sum("candidate_count"), F.lit(0)).alias("gene_candidates"), *kinds, *bits, *rates)
