"""Simulated read pairs with known origin."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The generator's seed, factor and step.
SEED, FACTOR, STEP = 0xC057E11A710A, 6364136223846793005, 1442695040888963407
SCENARIOS = ("exact", "low-complexity", "high-expression-skew")
SCHEMA = "read_id long, id string, r1 string, r2 string, transcript string, gene string, pos long"
MASK = (1 << 64) - 1


def draws(state: int = SEED) -> Iterator[int]:
    while True:
        state = (state * FACTOR + STEP) & MASK
        yield state


def pairs(transcripts: list[tuple[str, str, str]], reads: int, length: int, error: float, scenario: str) -> Iterator[tuple]:
    """transcripts: name, gene, sequence. Each read takes its draws from one sequence, so reads come one after the other."""
    if scenario not in SCENARIOS:
        raise ValueError(f"no such scenario: {scenario}")
    own = [t for t in transcripts if len(t[2]) >= length]
    if not own:
        raise ValueError(f"no transcript has {length} bases")
    rng = draws()
    for i in range(reads):
        skewed = scenario == "high-expression-skew" and len(own) > 1 and i % 10 < 8
        name, gene, seq = own[0 if skewed else i % len(own)]
        room = len(seq) - length
        start = next(rng) % (room + 1) if room else 0
        bases = list("A" * length if scenario == "low-complexity" and i % 5 == 0 else seq[start : start + length])
        for k, base in enumerate(bases):
            if (next(rng) >> 11) / float(1 << 53) < error:
                other = [x for x in "ACGT" if x != base.upper()][:3]
                bases[k] = other[next(rng) % 3]
        r1 = "".join("ACGT"[next(rng) & 3] for _ in range(28))
        yield i, f"sim_read_{i}", r1, "".join(bases), name, gene, start


def simulate(spark: SparkSession, transcripts: DataFrame, reads: int, length: int = 91, error: float = 0.0, scenario: str = "exact") -> DataFrame:
    """read_id, id, r1, r2, transcript, gene, pos. transcripts: ord, target_id, gene, seq.

    The draws form one chain, so one task makes them, from a transcript set that fits a worker."""

    def run(batches):
        rows = pd.concat(list(batches)).sort_values("ord")
        made, chunk = pairs(list(zip(rows.target_id.astype(str), rows.gene, rows.seq)), reads, length, error, scenario), []
        for row in made:
            chunk.append(row)
            if len(chunk) == 10_000:
                yield pd.DataFrame(chunk, columns=["read_id", "id", "r1", "r2", "transcript", "gene", "pos"])
                chunk = []
        if chunk:
            yield pd.DataFrame(chunk, columns=["read_id", "id", "r1", "r2", "transcript", "gene", "pos"])

    return transcripts.select("ord", "target_id", "gene", "seq").coalesce(1).mapInPandas(run, SCHEMA)


ERRORS = {"exact": 0.0, "sub005": 0.005, "sub02": 0.02, "indel1": None}
#: Draws of a place until its window holds bases only.
TRIES = 16


def perturbed(window: str, length: int, error: str, source: int, seed: int) -> tuple[str, int]:
    """A window of length + 1 bases with an error, to `length` bases, and the number of changes."""
    rng = random.Random(f"{seed}:{source}:{error}")
    if error == "indel1":
        at = rng.randint(15, max(15, length - 16))
        if rng.randrange(2):
            return (window[:at] + rng.choice("ACGT") + window[at:])[:length], 1
        return (window[:at] + window[at + 1 :])[:length], 1
    out, changes = list(window[:length]), 0
    for i, base in enumerate(out):
        if rng.random() < ERRORS[error]:
            out[i] = rng.choice([b for b in "ACGT" if b != base])
            changes += 1
    return "".join(out), changes


def synthetic_truth(genes: DataFrame, exons: DataFrame, genome: DataFrame, sources: int, length: int = 91, seed: int = 1) -> DataFrame:
    """read_id, source_id, source_class, error, changes, seq, gene, chromosome, strand, transcript, source_position, junction_position.

    `sources` windows of each class: mature (of transcripts), junction (over an exon border, 20 bases at least on either side) and
    intronic, each in four errors; intergenic (outside all genes, either strand) and random, exact. A source's draws are hashes of
    its number, so every task makes its own sources. genes: gene_id, contig, strand, start, end; exons: also transcript_id."""
    from ..plans.ordinals import with_ordinal
    from ..plans.staging import staged
    from . import intervals as I

    spark, size = genome.sparkSession, length + 1
    draw = lambda kind, k, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(kind), F.col("source_id"), F.lit(k) if isinstance(k, int) else k), n)
    t = I.sequences(exons, genome, ["gene_id", "transcript_id"]).where(F.length("seq").cast("long") >= size)
    t = t.where(F.col("seq").rlike("^[ACGT]+$")).select("transcript_id", F.col("gene_id").alias("gene"), "contig", "strand", "seq", "pieces")
    ends = exons.groupBy("gene_id", "transcript_id", "strand").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("end") - F.col("start") + 1).cast("long").alias("n")))).alias("x"))
    sizes = F.transform(F.when(F.col("strand") == "-", F.reverse("x")).otherwise(F.col("x")), lambda p: p["n"])
    sums = F.transform(F.slice(sizes, 1, F.greatest(F.size(sizes) - 1, F.lit(1))), lambda n, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0).cast("long"), lambda a, b: a + b))
    borders = ends.where(F.size("x") > 1).select("transcript_id", sums.alias("borders"))
    t = staged(t, "transcripts")
    joined = t.join(borders, "transcript_id").withColumn("borders", F.filter("borders", lambda b: (b >= 20) & (b <= F.length("seq") - 21) & (F.greatest(b - (length - 20), F.lit(0).cast("long")) <= F.least(b - 20, F.length("seq") - size)))).where(F.size("borders") > 0)
    by = Window.partitionBy("transcript_id").orderBy("start")
    gaps = exons.withColumn("next", F.lead("start").over(by)).select(F.col("gene_id").alias("gene"), "contig", "strand", (F.col("end") + 1).alias("start"), (F.col("next") - 1).alias("end")).where(F.col("end") - F.col("start") + 1 >= size).distinct()
    bounds = genome.select("contig", F.lit(1).cast("long").alias("start"), F.length("seq").cast("long").alias("end"))
    between = I.introns(bounds, genes.select("contig", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")), ["contig"]).where(F.col("end") - F.col("start") + 1 >= size)

    def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
        df = staged(with_ordinal(df, order, "place"), "eligible")
        return df, df.count()

    def picked(kind: str, df: DataFrame, order: list[str]) -> DataFrame:
        df, n = numbered(df, order)
        base = spark.range(sources if n else 0).withColumnRenamed("id", "source_id")
        return base.withColumn("place", draw(kind, 0, F.lit(max(1, n)))).join(df, "place").drop("place")

    none = F.lit(-1).cast("long")
    mature = picked("mature", t, ["transcript_id"]).withColumn("at", draw("mature", 1, F.length("seq") - length)).withColumn("junction", none)
    over = picked("junction", joined, ["transcript_id"]).withColumn("junction", F.get("borders", draw("junction", 1, F.size("borders")).cast("int")))
    lo, hi = F.greatest(F.col("junction") - (length - 20), F.lit(0)), F.least(F.col("junction") - 20, F.length("seq") - size)
    over = over.withColumn("at", lo + draw("junction", 2, hi - lo + 1))
    fixed = [x.select("source_id", F.lit(k).alias("source_class"), F.substr("seq", (F.col("at") + 1).cast("int"), F.lit(size)).alias("window"), "gene", "contig", "strand", F.col("transcript_id").alias("transcript"), F.col("at").cast("long").alias("position"), F.col("junction").cast("long").alias("junction")) for k, x in (("mature", mature), ("junction", over))]

    def placed(kind: str, df: DataFrame, order: list[str], gene, strand) -> DataFrame:
        """The first of TRIES places whose window holds bases only."""
        tries = picked(kind, df, order).withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(TRIES))))
        tries = tries.withColumn("at", F.col("start") + draw(kind, F.col("try"), F.col("end") - F.col("start") + 2 - size)).withColumn("strand", strand)
        spans = tries.select("source_id", "try", gene.alias("gene"), "contig", "strand", F.col("at").alias("start"), (F.col("at") + size - 1).alias("end"))
        cut = I.sequences(spans, genome, ["source_id", "try", "gene"]).where(F.col("seq").rlike("^[ACGT]+$"))
        best = cut.groupBy("source_id").agg(F.min_by(F.struct("seq", "gene", "contig", "strand", "start"), "try").alias("b"))
        return best.select("source_id", F.lit(kind).alias("source_class"), F.col("b.seq").alias("window"), "b.gene", "b.contig", "b.strand", F.lit("").alias("transcript"), (F.col("b.start") - 1).alias("position"), none.alias("junction"))

    side = F.when(draw("intergenic", 99, F.lit(2)) == 1, "-").otherwise("+")
    letters = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.substr(F.lit("ACGT"), (F.pmod(F.xxhash64(F.lit(seed), F.lit("random"), F.col("source_id"), i), F.lit(4)) + 1).cast("int"), F.lit(1)))
    chance = spark.range(sources).select(F.col("id").alias("source_id"), F.lit("random").alias("source_class"), F.lit("").alias("window"), F.lit("").alias("gene"), F.lit("").alias("contig"), F.lit("+").alias("strand"), F.lit("").alias("transcript"), none.alias("position"), none.alias("junction")).withColumn("window", F.array_join(letters, ""))
    rows = reduce(DataFrame.unionByName, [*fixed, placed("intronic", gaps, ["gene", "contig", "start", "end"], F.col("gene"), F.col("strand")), placed("intergenic", between, ["contig", "start"], F.lit(""), side), chance])
    order = {k: i for i, k in enumerate(("mature", "junction", "intronic", "intergenic", "random"))}
    number = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("source_class")]
    kinds = F.when(number < 3, F.array(*[F.lit(x) for x in ERRORS])).otherwise(F.array(F.lit("exact")))
    rows = rows.withColumn("source_id", F.col("source_id") + number * sources).withColumn("error", F.explode(kinds))

    @F.pandas_udf("seq string, changes int")
    def change(window: pd.Series, error: pd.Series, source: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([perturbed(w, length, e, int(s), seed) for w, e, s in zip(window, error, source)], columns=["seq", "changes"])

    place = F.create_map(*[F.lit(x) for i, k in enumerate(ERRORS) for x in (k, i)])[F.col("error")]
    read_id = F.when(number < 3, F.col("source_id") * 4 + place).otherwise(12 * sources + F.col("source_id") - 3 * sources)
    return rows.withColumn("x", change("window", "error", "source_id")).select(read_id.alias("read_id"), "source_id", "source_class", "error", "x.changes", "x.seq", "gene", F.col("contig").alias("chromosome"), "strand", "transcript", F.col("position").alias("source_position"), F.col("junction").alias("junction_position"))
