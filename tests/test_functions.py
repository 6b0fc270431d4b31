"""Scalar functions and seeds against plain restatements of their rules."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import seeds as seeding
from helixframe.functions import sequence as S
from helixframe.operators import intervals as I

MASK = (1 << 64) - 1


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()[0]


def code(s):
    return sum("ACGT".index(c) << 2 * i for i, c in enumerate(reversed(s)))


def back(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def order(s):
    x = (min(code(s), code(back(s))) + 0x9E3779B97F4A7C15) & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


@pytest.mark.parametrize(("k", "s"), [(5, 2), (7, 7), (15, 4), (31, 20), (32, 9)])
def test_syncmers_equal_their_rule(k, s):
    rng = random.Random(k)
    for size in (0, k - 1, k, 200):
        seq = "".join(rng.choice("ACGT" * 8 + "N") for _ in range(size))
        kept = []
        for i in range(size - k + 1):
            window = seq[i : i + k]
            if "N" in window:
                continue
            orders = [order(window[j : j + s]) for j in range(k - s + 1)]
            if min(orders) in (orders[0], orders[-1]):
                kept.append((i, code(window)))
        at, found = seeding.syncmers(seq.encode(), k, s)
        assert list(zip(at.tolist(), found.tolist())) == kept


def test_kmers_skip_invalid_bases_and_take_u_as_t():
    at, found = seeding.kmers(b"ACGNuCGTA", 3)
    assert at.tolist() == [0, 4, 5, 6]
    assert found.tolist() == [code("ACG"), code("TCG"), code("CGT"), code("GTA")]


def test_seeds_of_both_strands(spark):
    rows = spark.createDataFrame([(1, "AACGT"), (2, None), (3, "A")], "id int, seq string")
    got = {(r.id, r.pos, r.code, r.strand) for r in seeding.seeds(rows, "seq", 4, strand=True).collect()}
    assert got == {(1, 0, code("AACG"), 0), (1, 1, code("ACGT"), 0), (1, 0, code("ACGT"), 1), (1, 1, code("CGTT"), 1)}


def test_quality_and_complexity(spark):
    assert one(spark, S.mean_phred(F.lit(""))) == 0.0
    assert one(spark, S.mean_phred(F.lit("!5I"))) == pytest.approx((0 + 20 + 40) / 3)
    assert one(spark, S.low_complexity(F.lit("ACGTACGTAC"), 5)) is False
    assert one(spark, S.low_complexity(F.lit("AAAAAAAACG"), 5)) is True
    assert one(spark, S.low_complexity(F.lit("ACGTA"), 5)) is True
    assert one(spark, S.low_complexity(F.lit(""), 5)) is True


def test_barcodes_and_neighbours(spark):
    assert one(spark, S.valid_barcode(F.lit("ACGU" * 7))) is True
    assert one(spark, S.valid_barcode(F.lit("ACGT" * 6 + "ACGN"))) is False
    assert one(spark, S.lossy_barcode(F.lit("acg"))) == "ACG" + "N" * 25
    assert one(spark, S.one_substitution_neighbours(F.lit("AC"))) == ["CC", "GC", "TC", "AA", "AG", "AT"]


def test_hamming_counts_missing_bases(spark):
    for a, b, d in (("ACGT", "ACGA", 1), ("ac", "ACGT", 2), ("", "AC", 2), ("", "", 0)):
        assert one(spark, S.hamming(F.lit(a), F.lit(b))) == d
    assert one(spark, S.hamming_packed(F.lit(code("ACGT")), F.lit(code("TCGA")))) == 2
    assert one(spark, S.reverse_complement(F.lit("AAUN"))) == "NATT"


def test_tso(spark):
    assert one(spark, S.tso_trim_length(F.lit(S.TSO + "ACG"))) == 30
    assert one(spark, S.tso_trim_length(F.lit("CCCCCCCCCCCC"))) == 0
    assert one(spark, S.tso_trim_length(F.lit(S.TSO[:12] + "CCCCCC"))) >= 12


def test_headers_and_attributes(spark):
    cases = {"t1 gene=G1 x": "G1", "t1|gene:G2|y": "G2", 't1 gene_id "G3"; z': "G3", "t1 nothing": "t1"}
    for header, gene in cases.items():
        assert one(spark, S.gene_from_header(F.lit(header))) == gene
    assert one(spark, S.class_from_header(F.lit("x-A"))) == S.ANTISENSE
    assert one(spark, S.class_from_token(F.lit(" spliced "))) == S.EXON
    assert one(spark, S.gtf_attributes(F.lit('gene_id "a"; tag "x"; tag "y";'))) == {"gene_id": "a", "tag": "y"}


def fold(a, b):
    if 4 in (a, b):
        return 4
    if a == 8:
        return b
    if b == 8:
        return a
    return a & b or 4


def test_meet_is_the_fold_of_two(spark):
    rng, rows, want = random.Random(3), [], {}
    for g in range(200):
        states = [rng.choice([1, 2, 3, 4, 8]) for _ in range(rng.randint(1, 5))]
        rows += [(g, s) for s in states]
        value = states[0]
        for s in states[1:]:
            value = fold(value, s)
        want[g] = value
    got = {r.g: r.m for r in spark.createDataFrame(rows, "g int, s int").groupBy("g").agg(S.meet(F.col("s")).alias("m")).collect()}
    assert got == want


def test_introns_and_flanks(spark):
    body = spark.createDataFrame([("g", 2, 15)], "gene_id string, start long, end long")
    exons = spark.createDataFrame([("g", 2, 4), ("g", 9, 12), ("g", 3, 4)], "gene_id string, start long, end long")
    gaps = I.introns(body, exons, ["gene_id"])
    assert sorted((r.start, r.end) for r in gaps.collect()) == [(5, 8), (13, 15)]
    assert sorted((r.start, r.end) for r in I.intron_flanks(gaps, ["gene_id"], 1).collect()) == [(5, 5), (8, 8), (13, 13), (15, 15)]
    assert I.intron_flanks(gaps, ["gene_id"], 0).count() == 0


def test_build_targets(spark):
    genome = spark.createDataFrame([("c", "ACGTACGTACGTACGT")], "contig string, seq string")
    exons = spark.createDataFrame([("t", "g", "c", "-", 2, 4), ("t", "g", "c", "-", 9, 12)], "transcript_id string, gene_id string, contig string, strand string, start long, end long")
    genes = spark.createDataFrame([("g", "c", "-", 2, 15)], "gene_id string, contig string, strand string, start long, end long")
    got = {r.target: r.seq for kind in ("exon_transcript", "gene_body", "intron") for r in I.build_targets(genes, exons, genome, kind).collect()}
    text = "ACGTACGTACGTACGT"
    assert got == {"exon_transcript": back(text[8:12]) + back(text[1:4]), "gene_body": back(text[1:15]), "intron": back(text[12:15]) + back(text[4:8])}
    with pytest.raises(Exception, match="out of bounds"):
        I.build_targets(genes, exons.withColumn("end", F.col("end") + 10), genome, "exon_transcript").collect()


def test_seeds_pass_in_small_batches(spark, monkeypatch):
    """A batch of many sequences is not held whole: what leaves the function follows what went in closely."""
    import pyarrow as pa

    taken = []

    class Frame:
        columns, schema = ["i", "seq"], spark.range(0).selectExpr("id AS i", "'' AS seq").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            taken.append(run)

    seeding.seeds(Frame(), "seq", 15, strand=True)
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(3000)) for _ in range(100)]
    whole = pa.RecordBatch.from_pydict({"i": list(range(100)), "seq": seqs})
    calls = []
    own = seeding.kmers
    monkeypatch.setattr(seeding, "kmers", lambda *a: calls.append(1) or own(*a))
    out = taken[0](iter([whole]))
    first = next(out)
    assert len(calls) <= 2 * 12 + 1 and first.num_rows <= seeding.ROWS
    rows = [first, *out]
    assert sum(x.num_rows for x in rows) == 2 * 100 * 2986
    got = pa.Table.from_batches(rows).to_pydict()
    assert got["i"] == sorted(got["i"]) and [c for c, s, i in zip(got["code"], got["strand"], got["i"]) if i == 99 and s == 0] == own(seqs[99].encode(), 15)[1].tolist()
