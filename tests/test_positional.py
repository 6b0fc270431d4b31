"""The positional driver, reports, binary streams, windows of contigs and planted truth."""

import gzip
import os
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import evaluation as E
from helixframe.operators import intervals as I
from helixframe.operators import mapping as M
from helixframe.operators import positional as L
from helixframe.operators import simulate as sim
from helixframe.sources import files, states

CB, UMI = "ACGTACGTACGTACGT", "AACCGGTTAACC"


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def back(seq):
    return seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def reads_of(spark, seqs, r1=CB + UMI):
    return spark.createDataFrame([(i, r1, s, "I" * len(s)) for i, s in enumerate(seqs)], "read_id long, r1 string, seq string, qual string")


def test_reads_to_assignments_and_why_not(spark, tmp_path):
    rng = random.Random(6)
    a, b = bases(rng, 200), bases(rng, 200)
    targets = spark.createDataFrame([(1, "g", 1, 1, a), (2, "h", 2, 2, b), (3, "g", 0, 0, a[:150])], "target_id long, gene string, class_bits int, class_rank int, seq string")
    L.write_postings(targets, 11, str(tmp_path / "p"), 4)
    postings, statistics, genes = L.open_postings(spark, str(tmp_path / "p"), 11)
    assert genes == 2
    wrong = list(b[20:100])
    for i in range(0, 80, 9):
        wrong[i] = "ACGT"[("ACGT".index(wrong[i]) + 1) % 4]
    seqs = [a[10:90], b[20:100], back(b[20:100]), bases(rng, 80), "".join(wrong), a[140:200] + bases(rng, 40), "A" * 80, "N" * 80]
    reads = reads_of(spark, seqs).withColumn("r1", F.when(F.col("read_id") == 0, F.col("r1")).otherwise(F.col("r1")))
    mapped = L.map_reads(reads, postings, statistics, targets, 11, genes)
    got = {r.read_id: r for r in mapped.collect()}
    assert (got[0].assignment_type, got[0].gene, got[0].flags & S.FLAG_EXON) == ("unique_gene", "g", S.FLAG_EXON)
    assert (got[1].gene, got[1].transcript_id, got[1].score) == ("h", 2, 80)
    why = {r.read_id: r.reason for r in L.diagnostics(mapped).collect()}
    assert why[2] == why[3] == "no_seed_with_postings" and why[4] in ("score_failed_full_length_mismatch", "no_seed_with_postings")
    assert why[5] == "score_failed_full_length_out_of_bounds" and why[6] == why[7] == "low_complexity"
    assert L.diagnostics(mapped).columns == L.DIAGNOSTICS
    both = {r.read_id: r for r in L.map_reads(reads, postings, statistics, targets, 11, genes, both_strands=True).collect()}
    assert both[2].assignment_type == "antisense_gene" and both[2].gene == "h"
    lost = mapped.select("read_id", "assignment_type", "gene", "flags", "candidate_count", "candidate_hits")
    again = lambda some: L.map_reads(some, postings, statistics, targets, 11, genes, both_strands=True).select(*lost.columns)
    assert {r.read_id: r.assignment_type for r in M.rescue(reads, lost, again).collect()}[2] == "antisense_gene"
    assert {r.read_id: r.assignment_type for r in M.rescue(reads, lost, again, countable=True).collect()}[2] == "unmapped"
    assert {r.read_id for r in M.score_failed(lost).collect()} <= {4, 5}
    few = L.sparse_search(reads, postings, statistics, 11, genes, fallback=False)
    whole = L.sparse_search(reads, postings, statistics, 11, genes, exons_first=True)
    assert {r.read_id for r in few.collect()} <= {r.read_id for r in whole.collect()}
    sketched = L.sketch_buckets(L.sketches(reads, 11), 3)
    assert sorted(r.bucket for r in sketched.collect()) == [0, 0, 0, 1, 1, 1, 2, 2]


def test_tiers_of_genes(spark):
    hot = spark.createDataFrame([("a", 0), ("b", 1)], "gene string, gene_id long")
    assert [tuple(r) for r in M.two_tier_genes(hot, hot.where("gene = 'b'").withColumn("gene_id", F.lit(0)), 31, 31).collect()] == [("b", 1, 0)]
    with pytest.raises(ValueError, match="same k"):
        M.two_tier_genes(hot, hot, 31, 15)
    with pytest.raises(Exception, match="not in the hot"):
        M.two_tier_genes(hot.where("gene = 'a'"), hot, 31, 31).collect()


def test_report(spark, tmp_path):
    (tmp_path / "perf").write_text("100 L1-dcache-loads\n10 L1-dcache-load-misses\n200 LLC-loads\n10 LLC-load-misses\n")
    rows = spark.createDataFrame([(0, "unique_gene", "g"), (1, "unmapped", None)], "read_id long, assignment_type string, gene string")
    truth = spark.createDataFrame([(0, "g")], "read_id long, gene string")
    got = {r.name: r.value for r in E.bench_report(rows, spark.createDataFrame([(7,)], "molecules long"), files.read_perf_counters(spark, str(tmp_path / "perf")), truth).collect()}
    assert (got["assignments"], got["molecules"], got["L1_miss_rate"], got["LLC_miss_rate"], got["truth"], got["correct"]) == ("2", "7", "0.100000", "0.050000", "1", "1")


@pytest.mark.parametrize("form", ["plain", "gzip", "zstd"])
def test_state_stream_round_trip(spark, tmp_path, form):
    rows = [(0, CB, UMI, "unique_gene", "b", 2, 5, 256, [("b", 3)]), (1, "N" + CB[1:], UMI, "ambiguous_gene", None, 2, 9, 0, [("a", 1), ("c", 8)]), (2, CB, UMI, "unmapped", None, 0, 0, 0, None), (3, CB, UMI, "low_quality", None, 0, 0, 2, None)]
    frame = spark.createDataFrame(rows, "read_id long, cb string, umi string, assignment_type string, gene string, candidate_count long, score int, flags int, top array<struct<gene:string,state:int>>")
    genes = spark.createDataFrame([(x, i) for i, x in enumerate("abc")], "gene string, gene_id long")
    path = str(tmp_path / "stream")
    states.write_state_stream(frame, genes, path)
    raw = open(path, "rb").read()
    os.unlink(path)
    if os.path.exists(crc := str(tmp_path / ".stream.crc")):
        os.unlink(crc)
    open(path, "wb").write({"plain": raw, "gzip": gzip.compress(raw), "zstd": zstandard.ZstdCompressor().compress(raw)}[form])
    got = [r.asDict(recursive=True) for r in states.read_state_stream(spark, path).orderBy("read_id").collect()]
    for r, (i, cb, umi, kind, gene, n, score, flags, top) in zip(got, rows):
        assert (r["read_id"], r["cb"], r["umi"], r["assignment_type"], r["gene"], r["candidate_count"], r["score"], r["flags"]) == (i, cb, umi, kind, gene, n, score, flags)
        assert [(t["gene"], t["state"]) for t in r["top"]] == (top or [])
    assert len(got) == 4 and got[1]["valid"] == (1 << 28) - 2
    for broken in (raw[:-1], b"x" + raw[1:], raw[:12] + b"\x07" + raw[13:], raw[:-3] + b"\x09" + raw[-2:]):
        with pytest.raises(ValueError):
            list(states.parse(broken))
    empty = str(tmp_path / "empty")
    states.write_state_stream(frame.where("false"), genes, empty, states=False)
    assert list(states.parse(open(empty, "rb").read())) == []
    plain = str(tmp_path / "numbers")
    states.write_state_stream(frame, genes, plain, states=False)
    assert [[t["gene"] for t in r[8]] for r in states.parse(open(plain, "rb").read())] == [["1"], ["0", "2"], [], []]


def test_pieces_over_windows(spark):
    rng = random.Random(8)
    contig = bases(rng, 1000)
    genome = spark.createDataFrame([("c", contig)], "contig string, seq string")
    spans = [(0, "+", [(5, 40), (90, 400)]), (1, "-", [(64, 128), (300, 301), (512, 1000)]), (2, "+", [(1, 1000)])]
    rows = [(k, "c", strand, a, b) for k, strand, own in spans for a, b in own]
    pieces = spark.createDataFrame(rows, "k long, contig string, strand string, start long, end long")
    for size in (64, 1 << 16):
        got = {r.k: r for r in I.sequences(pieces, genome, ["k"], size).collect()}
        for k, strand, own in spans:
            seq = "".join(contig[a - 1 : b] for a, b in own)
            assert (got[k].seq, got[k].pieces, got[k].start, got[k].end) == (back(seq) if strand == "-" else seq, len(own), own[0][0], own[-1][1])
    with pytest.raises(Exception, match="missing contig"):
        I.sequences(pieces.withColumn("contig", F.lit("d")), genome, ["k"]).collect()


def test_planted_truth_comes_from_where_it_says(spark):
    rng = random.Random(3)
    contig = bases(rng, 6000)
    contig = contig[:5000] + "N" * 50 + contig[5050:]
    genome = spark.createDataFrame([("1", contig)], "contig string, seq string")
    genes = spark.createDataFrame([("g", "1", "+", 101, 1500), ("h", "1", "-", 2001, 3500)], "gene_id string, contig string, strand string, start long, end long")
    exons = [("t", "g", "+", [(101, 300), (601, 800), (1301, 1500)]), ("u", "h", "-", [(2001, 2200), (3001, 3500)])]
    table = spark.createDataFrame([(t, g, "1", s, a, b) for t, g, s, own in exons for a, b in own], "transcript_id string, gene_id string, contig string, strand string, start long, end long")
    got = sim.synthetic_truth(genes, table, genome, 20).collect()
    assert len(got) == 20 * (3 * 4 + 2) and sorted(r.read_id for r in got) == list(range(len(got)))
    whole = {}
    for t, _, s, own in exons:
        seq = "".join(contig[a - 1 : b] for a, b in own)
        whole[t] = back(seq) if s == "-" else seq
    for r in got:
        assert len(r.seq) == 91 and set(r.seq) <= set("ACGT")
        if r.error == "exact" and r.source_class in ("mature", "junction"):
            assert whole[r.transcript][r.source_position : r.source_position + 91] == r.seq and r.changes == 0
        if r.source_class == "junction":
            assert r.source_position + 20 <= r.junction_position <= r.source_position + 91 - 20 + 1
        if r.error == "exact" and r.source_class in ("intronic", "intergenic"):
            own = contig[r.source_position : r.source_position + 92]
            assert r.seq == (back(own) if r.strand == "-" else own)[:91]
        if r.source_class == "intergenic":
            assert all(r.source_position + 92 <= a - 1 or r.source_position >= b for a, b in ((101, 1500), (2001, 3500)))
        if r.error == "sub02":
            assert r.changes <= 12
    assert sim.synthetic_truth(genes, table, genome, 20).exceptAll(spark.createDataFrame(got)).count() == 0


def test_first_records_and_built_statistics(spark, tmp_path):
    (tmp_path / "a.fa").write_text("".join(f">t{i}\nACGT\n" for i in range(9)))
    assert [r.name for r in files.first_targets(files.read_fasta(spark, str(tmp_path / "a.fa")), 3).orderBy("ord").collect()] == ["t0", "t1", "t2"]
    built = spark.createDataFrame([("t", "g", 2, "ACGT"), ("u", "g", 1, "AC")], "target_id string, gene_id string, pieces long, seq string")
    assert tuple(I.build_statistics(built, built).first()) == (2, 1, 3, 6)
    with pytest.raises(ValueError, match="exon"):
        I.build_statistics(built, built.where("false"))


def test_bases_and_barcodes_are_packed(spark):
    texts = ["", "ACGT", "acgun", "N-x", CB + UMI, "U" + CB[1:] + UMI]
    frame = spark.createDataFrame([(t,) for t in texts], "s string")
    got = frame.select("s", S.decode_bases(S.encode_bases(F.col("s"))).alias("d"), S.pack_barcode(F.col("s")).alias("p")).withColumn("u", S.unpack_barcode(F.col("p.code"), F.col("p.valid"))).collect()
    for r in got:
        assert r.d == "".join(c if c in "ACGT" else "N" for c in r.s.upper().replace("U", "T"))
        assert r.u == "".join(c if c in "ACGT" else "N" for c in r.s.upper().ljust(28, "N"))
        assert r.p.code == sum("ACGT".find(c) << 2 * i for i, c in enumerate(r.s.upper()) if c in "ACGT")
