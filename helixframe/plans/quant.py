"""From reads to state matrices in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import counting as C
from ..operators import mapping as M
from ..sources import files, sinks
from .ordinals import with_ordinal
from .staging import staged


def state_records(assignments: DataFrame) -> DataFrame:
    """read_id, cb, umi, gene, state: a row a candidate gene of the reads with valid barcodes."""
    sound = assignments.where(F.coalesce(F.size("top"), F.lit(0)) > 0).where(S.strict_barcode(F.concat("cb", "umi")))
    return sound.select("read_id", "cb", "umi", F.explode("top").alias("t")).select("read_id", "cb", "umi", "t.gene", "t.state")


def count_states(records: DataFrame, whitelist: DataFrame | None, policy: str = "intersection", correct: bool = True) -> DataFrame:
    """gene, cell and the state layers. policy: intersection, or usa, which takes UMIs as they are."""
    if policy not in ("intersection", "usa"):
        raise ValueError(f"no such policy: {policy}")
    if policy == "usa" and correct:
        raise ValueError("usa takes exact UMIs")
    own = C.to_cells(records, C.correct_barcodes(records, whitelist))
    resolved = C.resolve_by_intersection(own) if policy == "intersection" else C.resolve_by_votes(own)
    return C.state_counts(resolved, correct)


def quantify(targets: DataFrame, reads: DataFrame, whitelist: DataFrame | None, k: int = 31, s: int | None = 20, policy: str = "intersection", correct: bool = True, cap: int = 256, trim: bool = False) -> DataFrame:
    """State counts of reads (read_id, r1, seq, qual) against targets (gene, class_bits, seq). Reads are mapped once and the
    records written, as barcodes, cells and both groupings of molecules read them."""
    return quantify_indexed(M.build_index(targets, k, s), reads, whitelist, k, s, policy, correct, cap, trim)


def quantify_indexed(index: DataFrame, reads: DataFrame, whitelist: DataFrame | None, k: int = 31, s: int | None = 20, policy: str = "intersection", correct: bool = True, cap: int = 256, trim: bool = False) -> DataFrame:
    """The same against an index that is there already."""
    records = staged(state_records(M.map_reads(reads, index, k, cap=cap, s=s, trim=trim)), "records")
    return count_states(records, whitelist, policy, correct)


def quant(spark: SparkSession, reference: str, annotation: str | None, r1: str, r2: str, whitelist: str, out: str, policy: str = "intersection", k: int = 31, s: int | None = 20, keep_assignments: bool = False, chemistry: str = "10xv3") -> dict:
    """Files to matrices in a new folder: state layers as Parquet and MatrixMarket, axes, and a manifest, also of a run that fails.

    The number of assignments must equal that of the pairs."""
    if chemistry != "10xv3":
        raise ValueError(f"no such chemistry: {chemistry}")
    conf = spark._jsc.hadoopConfiguration()
    where = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = where.getFileSystem(conf)
    if fs.exists(where):
        raise FileExistsError(out)
    cells = files.read_whitelist(spark, whitelist)
    fs.mkdirs(where)
    manifest = {"reference": reference, "r1": r1, "r2": r2, "whitelist": whitelist, "policy": policy, "k": k, "s": s, "ok": False}
    try:
        table = files.read_target_table(spark, annotation) if annotation else None
        targets = files.annotate_targets(files.read_fasta(spark, reference), table)
        pairs = files.pair_reads(files.read_fastq(spark, r1), files.read_fastq(spark, r2))
        M.map_reads(pairs, M.build_index(targets, k, s), k, s=s).write.parquet(f"{out}/assignments")
        assignments = spark.read.parquet(f"{out}/assignments")
        manifest["reads"], manifest["rows"] = pairs.count(), assignments.count()
        if manifest["reads"] != manifest["rows"]:
            raise RuntimeError("mapping and counting disagree on the number of reads")
        records = state_records(assignments)
        counts = count_states(records, cells, policy, correct=policy == "intersection")
        genes = with_ordinal(targets.groupBy("gene").agg(F.min("ord").alias("o")), ["o"], "gene_id").select("gene", "gene_id")
        axis = C.cell_ordinals(C.to_cells(records, C.correct_barcodes(records, cells)))
        counts.join(genes, "gene").join(axis, "cell").write.parquet(f"{out}/counts")
        done = spark.read.parquet(f"{out}/counts")
        manifest["molecules"] = done.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
        n_genes, n_cells = genes.count(), axis.count()
        for layer in ("total", "spliced", "unspliced", "ambiguous", "both", "conflicting", "unknown"):
            sinks.write_matrix(done, n_genes, n_cells, f"{out}/{layer}.mtx", layer)
        sinks.write_axes(genes, axis, out)
        if not keep_assignments:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/assignments"), True)
        manifest["ok"] = True
    except Exception as e:
        manifest["error"] = str(e)[:2000]
        raise
    finally:
        import json

        spark.range(1).select(F.lit(json.dumps(manifest)).alias("value")).coalesce(1).write.text(f"{out}/run.json")
    return manifest
