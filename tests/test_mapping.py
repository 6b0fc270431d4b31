"""Mapping against plain restatements; assignment types; end-to-end runs over files; streaming."""

import gzip
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import seeds as D
from helixframe.functions import sequence as S
from helixframe.operators import mapping as M
from helixframe.operators import pathsets as P
from helixframe.operators import positional as L
from helixframe.operators import simulate as sim
from helixframe.plans import quant as Q
from helixframe.plans.ordinals import with_ordinal
from helixframe.sources import bucketed, files, sinks
from helixframe.streaming import mapping as streaming

TARGETS = "gene string, class_bits int, seq string"
CB, UMI = "ACGTACGTACGTACGT", "AACCGGTTAACC"


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def reads_of(spark, seqs, r1=CB + UMI):
    return spark.createDataFrame([(i, r1, s, "I" * len(s)) for i, s in enumerate(seqs)], "read_id long, r1 string, seq string, qual string")


def test_consensus_equals_set_intersection(spark):
    rng = random.Random(2)
    pool = [bases(rng, 30) for _ in range(6)]
    targets = [(f"g{i % 4}", rng.choice([0, 1, 2, 4]), "".join(rng.sample(pool, 3))) for i in range(10)]
    reads = ["".join(rng.sample(pool, 2))[rng.randint(0, 20) :] for _ in range(60)] + [bases(rng, 40)]
    k = 7
    holds = defaultdict(dict)
    for gene, bits, seq in targets:
        for i in range(len(seq) - k + 1):
            holds[seq[i : i + k]][gene] = holds[seq[i : i + k]].get(gene, 0) | bits
    index = M.build_index(spark.createDataFrame(targets, TARGETS), k)
    got = {r.read_id: r for r in M.consensus(M.hits(reads_of(spark, reads), index, k)).collect()}
    for n, read in enumerate(reads):
        seeds = {read[i : i + k] for i in range(len(read) - k + 1)} & holds.keys()
        genes = set.intersection(*[set(holds[s]) for s in seeds]) if len(seeds) >= 2 else set()
        if not seeds:
            assert n not in got
            continue
        r = got[n]
        assert [t.gene for t in r.top] == sorted(genes)
        assert r.score == (len(seeds) if genes else 0)
        assert r.candidate_count == len(set().union(*[holds[s] for s in seeds]))
        assert r.assignment_type == ("unmapped" if not genes else "unique_gene" if len(genes) == 1 else "ambiguous_gene")


def test_five_assignment_types(spark):
    rng = random.Random(4)
    shared, own = bases(rng, 16), bases(rng, 16)
    index = M.build_index(spark.createDataFrame([("a", 1, shared), ("b", 1, shared), ("c", 1, own)], TARGETS), 5)
    reads = reads_of(spark, [shared, own, "N" * 6 + "ACACACGT"[:2] + "GTGTGTGTGACC", "A" * 16, own]).withColumn("qual", F.when(F.col("read_id") == 4, F.lit("!" * 16)).otherwise(F.col("qual")))
    got = {r.read_id: r.assignment_type for r in M.map_reads(reads, index, 5, genes=3, policy="weighted").collect()}
    assert [got[i] for i in (0, 1, 3, 4)] == ["ambiguous_gene", "unique_gene", "low_complexity", "low_quality"]
    with pytest.raises(ValueError, match="forward"):
        M.map_reads(reads, index, 5, both_strands=True)


def test_barcode_comes_before_quality_and_every_read_has_a_row(spark):
    index = M.build_index(spark.createDataFrame([("a", 1, "ACGTTGCAAC")], TARGETS), 5)
    rows = [(0, "ACG", "ACGTTGCAAC", "!" * 10), (1, None, "ACGTTGCAAC", "I" * 10), (2, CB + UMI, "", ""), (3, CB + UMI, "ACGTTGCAAC", "I" * 10)]
    got = {r.read_id: r for r in M.map_reads(spark.createDataFrame(rows, "read_id long, r1 string, seq string, qual string"), index, 5).collect()}
    assert len(got) == 4
    assert (got[0].flags, got[0].cb, got[0].umi) == (4, "ACG" + "N" * 13, "N" * 12)
    assert (got[1].flags, got[2].flags) == (4, 2)
    assert got[3].gene == "a"


def test_u_passes_mapping_but_not_counting(spark):
    index = M.build_index(spark.createDataFrame([("a", 1, "ACGTTGCAAC")], TARGETS), 5)
    mapped = M.map_reads(reads_of(spark, ["ACGTTGCAAC"], "U" + (CB + UMI)[1:]), index, 5)
    assert mapped.first().assignment_type == "unique_gene"
    assert Q.state_records(mapped).count() == 0


def test_syncmer_index_maps_what_a_dense_one_maps(spark):
    rng = random.Random(8)
    seqs = [bases(rng, 300) for _ in range(4)]
    targets = spark.createDataFrame([(f"g{i}", 1, s) for i, s in enumerate(seqs)], TARGETS)
    reads = reads_of(spark, [s[50:200] for s in seqs])
    for s in (None, 10):
        got = {r.read_id: r.gene for r in M.map_reads(reads, M.build_index(targets, 15, s), 15, s=s).collect()}
        assert got == {i: f"g{i}" for i in range(4)}


def test_rescue_flags_only_the_lost(spark):
    seq = bases(random.Random(1), 60)
    index = M.build_index(spark.createDataFrame([("a", 1, seq)], TARGETS), 15)
    reads = reads_of(spark, [seq, seq[1:20]])
    first = M.map_reads(reads, index, 15, "weighted", 1, stride=40)
    first = first.withColumn("assignment_type", F.when(F.col("read_id") == 1, "unmapped").otherwise(F.col("assignment_type")))
    got = {r.read_id: r.flags & S.FLAG_RESCUED for r in M.rescue(reads, first, lambda lost: M.map_reads(lost, index, 15, "weighted", 1)).collect()}
    assert got == {0: 0, 1: S.FLAG_RESCUED}


def test_path_sets(spark):
    a, b, c = "ACGTTGCAACGG", "TTGACCATGGCA", "CATCATGGTTAA"
    targets = spark.createDataFrame([(0, "g", a + b + c), (1, "g", a + c)], "target_id long, gene string, seq string")
    index = P.build(targets, 5)
    got = {r.read_id: r.pathset for r in P.map_paths(reads_of(spark, [a, b, a[4:] + c[:8]]), index, 5).collect()}
    assert got == {0: 0b11, 1: 0b01, 2: 0b10}


def test_scores_and_clips(spark):
    seq = bases(random.Random(6), 100)
    targets = spark.createDataFrame([("t", "g", seq)], "target_id string, gene string, seq string")
    bad = "".join("ACGT"[("ACGT".index(x) + 1) % 4] for x in seq[10:20])
    reads = reads_of(spark, [seq[10:60], bad + seq[20:60], S.TSO + seq[0:40]])
    hits = spark.createDataFrame([(0, "t", "g", 10, 0), (1, "t", "g", 10, 0), (0, "t", "g", 80, 0), (2, "t", "g", 0, 0)], "read_id long, transcript_id string, gene string, start int, strand int")
    got = {(r.read_id, r.start): r for r in L.score(hits, reads, targets, left=12, least=20, trim_tso=True).collect()}
    assert (got[0, 10].score, got[0, 10].flags) == (50, S.FLAG_FULL_LENGTH)
    assert got[1, 10].flags & S.FLAG_LEFT_CLIP and got[1, 10].score > 0
    assert got[0, 80].reason == "out_of_bounds"
    assert (got[2, 0].score, got[2, 0].flags) == (10, S.FLAG_TSO)


def test_best_alignment_prefers_sense_then_class(spark):
    rows = [(1, "t1", "g", 50, S.FLAG_EXON), (1, "t2", "g", 50, S.FLAG_INTRON), (1, "t3", "h", 50, S.FLAG_EXON | S.FLAG_ANTISENSE), (2, "t1", "g", 9, S.FLAG_EXON), (2, "t3", "h", 9, S.FLAG_INTRON), (3, "t3", "h", 9, S.FLAG_ANTISENSE)]
    got = {r.read_id: r for r in L.best_alignment(spark.createDataFrame(rows, "read_id long, transcript_id string, gene string, score int, flags int")).collect()}
    assert (got[1].assignment_type, got[1].transcript_id, got[1].candidate_count) == ("unique_gene", "t1", 3)
    assert got[2].assignment_type == "ambiguous_gene" and got[2].gene is None
    assert (got[3].assignment_type, got[3].gene) == ("antisense_gene", "h")


def test_ordinals_are_dense(spark):
    rows = with_ordinal(spark.range(1000).withColumn("k", F.col("id") * 7 % 1000), ["k"], "n").collect()
    assert all(r.n == r.k for r in rows)


def test_simulated_reads_come_from_their_transcripts(spark):
    seqs = [bases(random.Random(i), 120) for i in range(3)]
    t = spark.createDataFrame([(i, f"t{i}", f"g{i}", s) for i, s in enumerate(seqs)], "ord int, target_id string, gene string, seq string")
    rows = sim.simulate(spark, t, 100, 50, scenario="high-expression-skew").collect()
    assert all(seqs[int(r.transcript[1])][r.pos : r.pos + 50] == r.r2 and len(r.r1) == 28 for r in rows)
    assert Counter(r.transcript for r in rows)["t0"] >= 80
    assert rows == sim.simulate(spark, t, 100, 50, scenario="high-expression-skew").collect()


@pytest.fixture
def sample(tmp_path):
    rng = random.Random(12)
    s1, u1, s2 = bases(rng, 120), bases(rng, 120), bases(rng, 120)
    (tmp_path / "ref.fa").write_text(f">t1 gene=G1\n{s1[:60]}\n{s1[60:]}\n>t2\n{u1}\n>t3\r\n{s2.lower()}\r\n")
    (tmp_path / "t2g.tsv").write_text("# comment\nt1\tOLD\tS\nt1\tG1\tS\nt2\tG1\tU\nt3\tG2\texon\n")
    (tmp_path / "cells.txt").write_text(f"{CB}-1\nTTTTTTTTTTTTTTTT\nnot a barcode\n")
    pairs = [(CB, UMI, s1), (CB, UMI, s1), (CB, "T" * 12, u1), (CB[:-1] + "A", "G" * 12, s2), ("TTTTTTTTTTTTTTTT", UMI, s2), ("GGGGGGGGGGGGGGGG", UMI, s1)]
    with gzip.open(tmp_path / "R1.fastq.gz", "wt") as a, open(tmp_path / "R2.fastq", "w", newline="") as b:
        for i, (cb, umi, s) in enumerate(pairs):
            a.write(f"@r{i} x\n{cb}{umi}\n+\n{'I' * 28}\n")
            b.write(f"@r{i}\r\n{s[10:100]}\r\n+\r\n{'I' * 90}\r\n")
    return tmp_path


def test_quant_over_files(spark, sample):
    out = str(sample / "out")
    args = [str(sample / x) for x in ("ref.fa", "t2g.tsv", "R1.fastq.gz", "R2.fastq", "cells.txt")]
    done = Q.quant(spark, *args, out, keep_assignments=True)
    assert (done["reads"], done["rows"], done["molecules"]) == (6, 6, 4)
    got = {(r.gene, r.cell): (r.spliced, r.unspliced, r.total) for r in spark.read.parquet(f"{out}/counts").collect()}
    assert got == {("G1", CB): (1, 1, 2), ("G2", CB): (1, 0, 1), ("G2", "T" * 16): (1, 0, 1)}
    matrix = {(r.gene_id, r.cell_id): r["count"] for r in files.read_matrix(spark, f"{out}/total.mtx").collect()}
    assert matrix == {(0, 0): 2, (1, 0): 1, (1, 1): 1}
    with pytest.raises(FileExistsError):
        Q.quant(spark, *args, out)
    again = Q.quant(spark, *args, str(sample / "usa"), policy="usa")
    assert again["molecules"] == 4


def test_broken_files_raise(spark, sample, tmp_path):
    for name, text in (("short", "@a\nACG\n+\n"), ("lengths", "@a\nACG\n+\nII\n"), ("at", "a\nACG\n+\nIII\n"), ("plus", "@a\nACG\n-\nIII\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="FASTQ record 0"):
            files.read_fastq(spark, str(tmp_path / name)).collect()
    one = files.read_fastq(spark, str(sample / "R2.fastq"))
    with pytest.raises(Exception, match="unequal"):
        files.pair_reads(one, one.where("read_id < 3")).collect()
    (tmp_path / "empty").write_text("x\n")
    with pytest.raises(ValueError, match="no barcode"):
        files.read_whitelist(spark, str(tmp_path / "empty"))


def test_text_forms(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#c\nchr\ts\tgene\t1\t9\t.\t+\t.\tgene_id "g";\nchr\ts\texon\t2\t4\t.\t+\t.\tgene_id "g"; transcript_id "t"; transcript_version "2";\nshort\n')
    gtf = files.read_gtf(spark, str(tmp_path / "a.gtf"))
    assert [tuple(r) for r in files.transcript_genes(gtf).collect()] == [("t", "g")]
    genes, exons = files.gene_models(gtf)
    assert exons.first().transcript_id == "t.2" and genes.first().end == 9
    (tmp_path / "perf").write_text("  1,234 cycles  # x\n500,,instructions,1,2\nnothing\n")
    assert {r.counter: r.value for r in files.read_perf_counters(spark, str(tmp_path / "perf")).collect()} == {"cycles": 1234.0, "instructions": 500.0}
    rows = spark.createDataFrame([(0, CB, UMI, "unique_gene", 1, 2, 3, 0, [(1, 3)]), (1, CB, UMI, "unmapped", None, 0, 0, 0, None)], "read_id long, cb string, umi string, assignment_type string, gene_id long, candidate_count long, score int, flags int, top array<struct<gene:long,state:int>>")
    sinks.write_assignments(rows, str(tmp_path / "asg"), states=True)
    back = {r.read_id: r for r in files.read_assignments(spark, str(tmp_path / "asg")).collect()}
    assert back[0].gene_states == "1:A" and back[1].gene_id is None
    target = spark.createDataFrame([("t", "g", "intron", "c", "+", 1, 90, "A" * 90)], "target_id string, gene_id string, target string, contig string, strand string, start int, end int, seq string")
    assert sinks.fasta_text(target).first()[0].split("\n") == [">t|gene:g|target:intron|contig:c|strand:+|start:1|end:90", "A" * 80, "A" * 10]


def test_index_is_opened_again_and_checked(spark, tmp_path):
    path = str(tmp_path / "index")
    built = M.build_index(spark.createDataFrame([("a", 1, "ACGTTGCAACGT"), ("b", 2, "ACGTTTTTT")], TARGETS), 5)
    sinks.write_index(built, path, 4, k=5, s=None)
    spark.sql(f"DROP TABLE {bucketed.table_name(path)}")  # as in a later session
    again = sinks.open_index(spark, path, k=5)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, built.collect()))
    assert "Exchange" not in again.groupBy("code").count()._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="otherwise"):
        sinks.open_index(spark, path, k=6)
    absent = spark.createDataFrame([(-1,)], "code long")
    sinks.probe_index(again, built, absent)
    with pytest.raises(RuntimeError, match="should not"):
        sinks.probe_index(again, built, built)
    with pytest.raises(RuntimeError, match="missing"):
        sinks.probe_index(again, absent, absent)
    other = bucketed.convert(spark, path, str(tmp_path / "other"), 2)
    assert other.exceptAll(built).count() == 0 and bucketed.describe(spark, str(tmp_path / "other"))["about"]["k"] == "5"
    for part in (tmp_path / "index" / "buckets-4").glob("*.parquet"):
        part.unlink()
        break
    spark.catalog.refreshTable(bucketed.table_name(path))
    with pytest.raises(RuntimeError, match="written"):
        sinks.open_index(spark, path)


def test_lanes_pair_by_order(spark, tmp_path):
    for mate, base in (("R1", "A"), ("R2", "C")):
        (tmp_path / mate).mkdir()
        for lane, n in (("L1", 2), ("L2", 3)):
            (tmp_path / mate / lane).write_text("".join(f"@{lane}{i}\n{base * (i + 1)}\n+\n{'I' * (i + 1)}\n" for i in range(n)))
    first, second = (files.read_fastq(spark, str(tmp_path / m)) for m in ("R1", "R2"))
    pairs = files.pair_reads(first, second).orderBy("read_id").collect()
    assert [(r.r1, r.seq) for r in pairs] == [("A" * n, "C" * n) for n in (1, 2, 1, 2, 3)]
    assert [r.read_id % 2**40 for r in pairs] == [0, 1, 0, 1, 2]


def test_codes_of_reverse_complements(spark):
    rng = random.Random(4)
    for k in (1, 5, 15, 16, 31, 32):
        seqs = [bases(rng, k) for _ in range(20)]
        turned = [s.translate(str.maketrans("ACGT", "TGCA"))[::-1] for s in seqs]
        code = lambda x: D.codes(D.CODE[np.frombuffer(x.encode(), np.uint8)], k)[0]
        got = D.reverse_complement_codes(np.array([code(x) for x in seqs], np.uint64), k)
        assert got.tolist() == [int(code(x)) for x in turned]
    frame = spark.createDataFrame([(27,), (None,)], "code long")  # ACGT is its own reverse complement
    assert [r[0] for r in frame.select(D.reverse_complement_code("code", 4)).collect()] == [27, None]


def test_distinct_seeds_count_repeats(spark):
    frame = spark.createDataFrame([("g", "ACGACGACG"), ("h", None), ("i", "AC")], "gene string, seq string")
    got = {r.code: r.c for r in D.distinct_seeds(frame, "seq", 3).collect()}
    want = Counter(r.code for r in D.seeds(frame, "seq", 3).collect())
    assert got == want and sorted(want.values()) == [2, 2, 3]


def test_streamed_mapping_equals_a_batch(spark, tmp_path):
    rng = random.Random(3)
    seqs = [bases(rng, 100) for _ in range(4)]
    index = M.build_index(spark.createDataFrame([(f"g{i}", 1, s) for i, s in enumerate(seqs)], TARGETS), 15).persist()
    umi = F.element_at(F.array(*[F.lit(x * 12) for x in "ACGT"]), (F.col("read_id") % 4 + 1).cast("int"))
    reads = reads_of(spark, [s[:80] for s in seqs] * 5).withColumn("r1", F.concat(F.lit(CB), umi))
    reads.repartition(5).write.parquet(str(tmp_path / "in"))
    q = streaming.map_stream(streaming.reads_stream(spark, str(tmp_path / "in"), 2), index, 15, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert not q.exception()
    key = lambda df: sorted((r.read_id, r.gene, r.score) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(M.map_reads(reads, index, 15))
    assert streaming.count_mapped(spark, str(tmp_path / "out"), None).agg(F.sum("total")).first()[0] == 4


def test_seeds_are_never_broadcast(spark):
    """A small file of long reads has many seeds; Spark's estimate, the file's size, says that they fit a broadcast."""
    rng = random.Random(8)
    seqs = [bases(rng, 200) for _ in range(4)]
    targets = spark.createDataFrame([(i, f"g{i}", 1, s) for i, s in enumerate(seqs)], "target_id long, gene string, class_bits int, seq string")
    reads = reads_of(spark, [s[20:111] for s in seqs])
    index, paths = M.build_index(targets, 11), P.build(targets, 11)
    for found in (M.hits(reads, index, 11), M.consensus(M.distinct_hits(reads, index, 11), unique=True), P.map_paths(reads, paths, 11)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r.read_id for r in found.collect()} == {0, 1, 2, 3}


def test_consensus_shuffles_targets_once(spark):
    """Repeats of a seed go before the join, and one shuffle by read serves the seeds' number and their genes."""
    repeated = "ACGTTGCA" * 6
    targets = spark.createDataFrame([("g", 1, repeated), ("h", 2, repeated[:20])], "gene string, class_bits int, seq string")
    found = M.consensus(M.distinct_hits(reads_of(spark, [repeated, repeated[:19]]), M.build_index(targets, 8), 8), unique=True)
    assert {r.read_id: (r.score, r.candidate_count, [t.gene for t in r.top]) for r in found.collect()} == {0: (8, 2, ["g", "h"]), 1: (8, 2, ["g", "h"])}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(read_id") == 1
    assert M.build_index(targets, 8)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
