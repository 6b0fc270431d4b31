"""Intervals: merged exons, introns and their flanks, and the target sequences built from them. Ends are inclusive, from 1."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S

#: Bases at an intron's ends, and of a window of a contig.
FLANK, WINDOW = 86, 1 << 16


def merge(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end: rows that overlap or touch, joined."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("start") > reach + 1)).cast("int")
    island = rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(by))
    return island.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def introns(bodies: DataFrame, exons: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end: what merged exons, cut to the body, leave of it."""
    body = bodies.select(*keys, F.col("start").alias("_a"), F.col("end").alias("_b"))
    inside = exons.join(body, keys).select(*keys, F.greatest("start", "_a").alias("start"), F.least("end", "_b").alias("end")).where("start <= end")
    merged = merge(inside, keys)
    gaps = merged.withColumn("_next", F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))).join(body, keys)
    after = gaps.select(*keys, (F.col("end") + 1).alias("start"), F.coalesce(F.col("_next") - 1, F.col("_b")).alias("end"))
    first = merged.groupBy(*keys).agg(F.min("start").alias("_first"))
    before = body.join(first, keys, "left").select(*keys, F.col("_a").alias("start"), F.coalesce(F.col("_first") - 1, F.col("_b")).alias("end"))
    return before.unionByName(after).where("start <= end")


def intron_flanks(gaps: DataFrame, keys: list[str], size: int = FLANK) -> DataFrame:
    """The first and last `size` bases of each intron, merged where they meet."""
    if size == 0:
        return gaps.where(F.lit(False))
    left = F.struct(F.col("start").alias("start"), F.least("end", F.col("start") + size - 1).alias("end"))
    right = F.struct(F.greatest("start", F.col("end") - size + 1).alias("start"), F.col("end").alias("end"))
    ends = gaps.select(*keys, F.explode(F.array(left, right)).alias("x")).select(*keys, "x.start", "x.end")
    return merge(ends, keys)


def bodies_of(genes: DataFrame, exons: DataFrame, keys: list[str]) -> DataFrame:
    """The given gene intervals; for genes without one, the hull of the exons."""
    hull = exons.groupBy(*keys).agg(F.min("start").alias("_s"), F.max("end").alias("_e"))
    own = genes.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return hull.join(own, keys, "full_outer").select(*keys, F.coalesce("start", "_s").alias("start"), F.coalesce("end", "_e").alias("end"))


def windows(genome: DataFrame, size: int = WINDOW) -> DataFrame:
    """contig, w, part: contigs (contig, seq) cut to windows; a slice of each is one pass over the contig."""

    def run(batches):
        for batch in batches:
            for contig, seq in zip(batch.column("contig").to_pylist(), batch.column("seq").to_pylist()):
                seq = seq or ""
                for lo in range(0, len(seq), size * 256):
                    at = range(lo, min(len(seq), lo + size * 256), size)
                    yield pa.RecordBatch.from_arrays([pa.array([contig] * len(at), pa.string()), pa.array([x // size for x in at], pa.int64()), pa.array([seq[x : x + size] for x in at], pa.string())], ["contig", "w", "part"])

    return genome.select("contig", "seq").mapInArrow(run, "contig string, w long, part string")


def sequences(pieces: DataFrame, genome: DataFrame, keys: list[str], size: int = WINDOW) -> DataFrame:
    """keys, contig, strand, seq, start, end, pieces: the pieces' bases joined in the order of transcription. pieces: keys, contig,
    strand, start, end; genome: contig, seq. A piece meets only the windows that it reaches into."""
    long = genome.select("contig", F.length("seq").alias("_length"))
    at = lambda c: F.floor((c - 1) / size)
    each = F.explode(F.sequence(at(F.col("start")), at(F.col("end")))).alias("w")
    met = pieces.join(long, "contig", "left").select(*keys, "contig", "strand", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "_length", each)
    cut = met.join(windows(genome, size), ["contig", "w"], "left")
    lo, hi = F.greatest(F.col("start") - 1, F.col("w") * size), F.least(F.col("end"), (F.col("w") + 1) * size)
    fails = lambda text: F.raise_error(text).cast("string")
    part = F.when(F.col("_length").isNull(), fails(F.concat(F.lit("missing contig "), F.col("contig")))).when(F.col("end") > F.col("_length"), fails(F.lit("an interval is out of bounds")))
    part = part.otherwise(F.substr("part", (lo - F.col("w") * size + 1).cast("int"), (hi - lo).cast("int")))
    first = (F.col("w") == at(F.col("start"))).cast("long")
    g = cut.groupBy(*keys, "contig", "strand").agg(F.array_sort(F.collect_list(F.struct("start", "end", "w", part.alias("_s")))).alias("_p"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum(first).alias("pieces"))
    forward = F.array_join(F.transform("_p", lambda x: x["_s"]), "")
    return g.withColumn("seq", F.when(F.col("strand") == "-", S.reverse_complement(forward)).otherwise(forward)).drop("_p")


def build_targets(genes: DataFrame, exons: DataFrame, genome: DataFrame, kind: str, flank: int = FLANK) -> DataFrame:
    """target_id, gene_id, target, contig, strand, start, end, pieces, seq for a kind of target.

    kinds: exon_transcript, gene_body, intron, intron_flanks, exon_and_body, exon_and_introns. exons: gene_id,
    transcript_id, contig, strand, start, end; genes: gene_id, contig, strand, start, end."""
    both = {"exon_and_body": ("exon_transcript", "gene_body"), "exon_and_introns": ("exon_transcript", "intron")}
    if kind in both:
        a, b = (build_targets(genes, exons, genome, x, flank) for x in both[kind])
        return a.unionByName(b)
    if kind == "exon_transcript":
        out = sequences(exons, genome, ["gene_id", "transcript_id"])
        return out.select(F.col("transcript_id").alias("target_id"), "gene_id", F.lit(kind).alias("target"), "contig", "strand", "start", "end", "pieces", "seq")
    keys = ["gene_id", "contig", "strand"]
    body = bodies_of(genes, exons, keys)
    pieces = body
    if kind in ("intron", "intron_flanks"):
        pieces = introns(body, exons, keys)
        if kind == "intron_flanks":
            pieces = intron_flanks(pieces, keys, flank)
    elif kind != "gene_body":
        raise ValueError(f"no such kind of target: {kind}")
    out = sequences(pieces, genome, ["gene_id"]).where(F.length("seq") > 0).drop("start", "end").join(body.select("gene_id", "start", "end"), "gene_id")
    name = "gene_body" if kind == "gene_body" else "intron"
    return out.select(F.col("gene_id").alias("target_id"), "gene_id", F.lit(name).alias("target"), "contig", "strand", "start", "end", "pieces", "seq")


def build_statistics(built: DataFrame, exons: DataFrame) -> DataFrame:
    """One row on built targets: targets, genes, pieces and bases; an error if there is no transcript to build from."""
    none = exons.limit(1).count() == 0
    if none:
        raise ValueError("no transcript has an exon")
    return built.agg(F.count(F.lit(1)).alias("targets"), F.count_distinct("gene_id").alias("genes"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"))
