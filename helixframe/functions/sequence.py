"""Column functions over sequences, qualities, headers and classes. All of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class bits, splicing states, assignment flags and types, and the template-switch oligo.
EXON, INTRON, ANTISENSE, UNKNOWN_CLASS = 1, 2, 4, 0
SPLICED, UNSPLICED, BOTH, CONFLICT, UNKNOWN = 1, 2, 3, 4, 8
STATE_LABELS = {1: "S", 2: "U", 3: "A", 4: "C", 8: "X"}
FLAG_FULL_LENGTH, FLAG_POLY_A, FLAG_POLY_T, FLAG_LOW_QUALITY_TAIL = 1, 2, 4, 8
FLAG_RIGHT_CLIP, FLAG_LEFT_CLIP, FLAG_TSO, FLAG_ANTISENSE = 16, 32, 64, 128
FLAG_EXON, FLAG_INTRON, FLAG_GENE_BODY, FLAG_RESCUED = 256, 512, 1024, 2048
ASSIGNMENT_TYPES = ("unique_gene", "ambiguous_gene", "ambiguous_transcript_same_gene", "antisense_gene", "unmapped", "low_complexity", "low_quality")
TSO = "AAGCAGTGGTATCAACGCAGAGTACATGGG"


def clean(seq: Column) -> Column:
    """Upper-cased bases, U as T, anything else as N."""
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(clean(seq), "ACGT", "TGCA"))


def kmer_code(kmer: Column) -> Column:
    """The base-4 number of a k-mer of at most 31 bases, the first base most significant; null if a base is invalid."""
    fits = F.upper(kmer).rlike("^[ACGTU]+$") & (F.length(kmer) <= 31)
    return F.when(fits, F.conv(F.translate(F.upper(kmer), "ACGTU", "01233"), 4, 10).cast("long"))


def kmer_text(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def mean_phred(quality: Column) -> Column:
    """Mean of max(byte - 33, 0); 0 for an empty string."""
    total = F.aggregate(F.split(quality, ""), F.lit(0), lambda a, c: a + F.when(c == "", 0).otherwise(F.greatest(F.ascii(c) - 33, F.lit(0))))
    return F.when(F.length(quality) > 0, total / F.length(quality)).otherwise(F.lit(0.0))


def tso_trim_length(seq: Column, least: int = 10, mismatches: int = 3) -> Column:
    """The longest prefix of at least `least` bases with at most so many differences to the oligo's start; 0: none."""
    bases = F.split(F.substring(F.upper(seq), 1, len(TSO)), "")
    size = F.least(F.length(seq), F.lit(len(TSO)))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("wrong"), F.lit(0).alias("best"))
    oligo = F.lit(TSO)

    def step(a: Column, base: Column) -> Column:
        i = a["i"] + 1
        wrong = a["wrong"] + (base != F.substr(oligo, i, F.lit(1))).cast("int")
        best = F.when((i >= F.least(F.lit(least), size)) & (wrong <= mismatches), i).otherwise(a["best"])
        return F.struct(i.alias("i"), wrong.alias("wrong"), best.alias("best"))

    return F.when(F.length(seq) > 0, F.aggregate(bases, zero, step)["best"]).otherwise(F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ, letters alike in either case; a difference in length counts a base each."""
    shared = F.least(F.length(a), F.length(b))
    near = F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda x, y: F.coalesce(x != y, F.lit(False)))
    return F.size(F.filter(F.slice(near, 1, F.greatest(shared, F.lit(1))), lambda x: x)) * (shared > 0).cast("int") + F.abs(F.length(a) - F.length(b))


def hamming_reverse_complement(a: Column, b: Column) -> Column:
    return hamming(reverse_complement(a), b)


def hamming_packed(a: Column, b: Column) -> Column:
    """Differing bases of two base-4 numbers of equal length."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def one_substitution_neighbours(seq: Column) -> Column:
    """The 3 x length sequences that differ in one base: by position, then in the order A, C, G, T."""
    places = F.sequence(F.lit(1), F.length(seq))
    bases = F.array(*[F.lit(x) for x in "ACGT"])

    def at(i: Column) -> Column:
        other = F.filter(bases, lambda b: b != F.substr(seq, i, F.lit(1)))
        return F.transform(other, lambda b: F.concat(F.substr(seq, F.lit(1), i - 1), b, F.substr(seq, i + 1, F.length(seq))))

    return F.when(F.length(seq) > 0, F.flatten(F.transform(places, at))).otherwise(F.array().cast("array<string>"))


def base_count(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def low_complexity(seq: Column, k: int) -> Column:
    """At most one valid k-mer, no A/C/G/T, or 80 % and more of one base. U counts in k-mers, not in the composition."""
    upper = F.upper(seq)
    runs = F.split(F.regexp_replace(upper, "[^ACGTU]", " "), " ")
    kmers = F.aggregate(runs, F.lit(0), lambda a, r: a + F.greatest(F.length(r) - (k - 1), F.lit(0)))
    counts = [base_count(upper, x) for x in "ACGT"]
    valid = counts[0] + counts[1] + counts[2] + counts[3]
    most = F.greatest(*counts)
    return (kmers <= 1) | (valid == 0) | (most * 5 >= valid * 4)


def minimizer(seq: Column, k: int) -> Column:
    """The least k-mer code of a sequence; null without a valid k-mer."""
    starts = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_min(F.transform(starts, lambda i: kmer_code(F.substr(seq, i, F.lit(k)))))


def barcode(r1: Column) -> Column:
    return F.substring(r1, 1, 16)


def umi(r1: Column) -> Column:
    return F.substring(r1, 17, 12)


def valid_barcode(r1: Column) -> Column:
    """At least 28 bases, all of the first 28 A, C, G, T or U."""
    return F.coalesce(F.substring(r1, 1, 28).rlike("^[ACGTUacgtu]{28}$"), F.lit(False))


def lossy_barcode(r1: Column) -> Column:
    return F.rpad(F.substring(F.upper(F.coalesce(r1, F.lit(""))), 1, 28), 28, "N")


def strict_barcode(lossy: Column) -> Column:
    """What counting by state accepts: U is no base here."""
    return lossy.rlike("^[ACGT]{28}$")


def idf_weight(genes: Column, gene_df: Column) -> Column:
    """round(1 + 64 ln((G + 1) / (df + 1))), from 1 to 65535; 0 for a k-mer of no gene."""
    raw = F.floor(1 + 64 * F.log((genes + 1) / (gene_df + 1)) + 0.5).cast("long")
    return F.when(gene_df == 0, F.lit(0).cast("long")).otherwise(F.least(F.greatest(raw, F.lit(1)), F.lit(65535)))


def gene_from_header(header: Column) -> Column:
    """A gene=, gene:, gene_id= or gene_id: token; else what follows gene_id; else the first token."""
    parts = F.split(header, "[| \t]")
    token = F.get(F.filter(parts, lambda p: p.rlike("^gene(_id)?[=:]")), F.lit(0))
    tagged = F.regexp_replace(F.regexp_replace(token, "^gene(_id)?[=:]", ""), '^"+|"+$', "")
    tagged = F.regexp_replace(F.regexp_replace(tagged, "^;+|;+$", ""), '^"+|"+$', "")
    quoted = F.regexp_extract(header, r'gene_id\s*[=:]?\s*"([^"]*)"', 1)
    bare = F.regexp_extract(header, r"gene_id\s*[=:]?\s*([^|; \t\"]+)", 1)
    first = F.get(F.split(F.trim(header), r"\s+"), F.lit(0))
    return F.coalesce(tagged, F.when(quoted != "", quoted), F.when(bare != "", bare), first)


def class_from_header(header: Column) -> Column:
    low = F.lower(header)
    return (
        F.when(low.contains("antisense") | low.endswith("-a"), ANTISENSE)
        .when(low.contains("intron") | low.contains("|u") | low.endswith("-u"), INTRON)
        .when(low.contains("exon") | low.contains("transcript") | low.endswith("-s"), EXON)
        .otherwise(UNKNOWN_CLASS)
    )


def class_from_token(token: Column) -> Column:
    word = F.upper(F.trim(token))
    return F.when(word.isin("S", "EXON", "SPLICED", "TRANSCRIPT"), EXON).when(word.isin("U", "INTRON", "UNSPLICED"), INTRON).when(word.isin("A", "ANTISENSE"), ANTISENSE).otherwise(UNKNOWN_CLASS)


def gtf_attributes(column: Column) -> Column:
    """A map of `key "value";` pairs; of a repeated key the last value."""
    parts = F.filter(F.transform(F.split(column, ";"), lambda p: F.trim(p)), lambda p: p.rlike(r"^\S+\s"))
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\S+)", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(p, r"^\S+\s+", "")), '^"+|"+$', "").alias("v")))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("key"), p["v"].alias("value"), i.alias("i"))), lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["key"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))


def base_gene(name: Column) -> Column:
    return F.regexp_replace(name, "-[ASU]$", "")


def target_class_of_name(name: Column) -> Column:
    tag = F.regexp_extract(name, r"\|target:([^|]*)", 1)
    return F.when(tag == "exon_transcript", "exon_transcript").when(tag == "intron", "intron").when(tag == "gene_body", "gene_body").otherwise("unknown")


def target_strand_of_name(name: Column) -> Column:
    tag = F.regexp_extract(name, r"\|strand:([^|]*)", 1)
    return F.when(tag == "-", "-").when(tag == "+", "+")


def state_of_class(bits: Column) -> Column:
    """Splicing state of class bits: exon S, intron U, both A, neither X."""
    own = bits.bitwiseAND(F.lit(3))
    return F.when(own == 0, UNKNOWN).otherwise(own).cast("int")


def state_label(state: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in STATE_LABELS.items() for x in kv])
    return names[state]


def meet(states: Column) -> Column:
    """Aggregate: the meet of states. Conflict absorbs, unknown is neutral, others meet bit by bit, to conflict if nothing is left."""
    known = F.bit_and(F.when(states.isin(SPLICED, UNSPLICED, BOTH), states))
    return F.when(F.bool_or(states == CONFLICT), CONFLICT).when(known.isNull(), UNKNOWN).when(known == 0, CONFLICT).otherwise(known).cast("int")


def meet_two(a: Column, b: Column) -> Column:
    both = a.bitwiseAND(b)
    return F.when((a == CONFLICT) | (b == CONFLICT), CONFLICT).when(a == UNKNOWN, b).when(b == UNKNOWN, a).when(both == 0, CONFLICT).otherwise(both)


def size_bucket(count: Column) -> Column:
    """The seven histogram buckets of index statistics."""
    return F.when(count == 0, "0").when(count == 1, "1").when(count <= 4, "2-4").when(count <= 16, "5-16").when(count <= 64, "17-64").when(count <= 256, "65-256").otherwise(">256")


def encode_bases(seq: Column) -> Column:
    """digits (0 to 3, one a base) and mask (1 where another letter stands), two strings of the sequence's length."""
    upper = F.translate(seq, "acgtuU", "ACGTTT")
    digits = F.translate(F.regexp_replace(upper, "(?s)[^ACGT]", "A"), "ACGT", "0123")
    mask = F.regexp_replace(F.regexp_replace(upper, "(?s)[^ACGT]", "1"), "[ACGT]", "0")
    return F.struct(digits.alias("digits"), mask.alias("mask"))


def decode_bases(code: Column) -> Column:
    """The sequence of `encode_bases`, with N for other letters; the length is kept."""
    plain, mask = F.split(F.translate(code["digits"], "0123", "ACGT"), ""), F.split(code["mask"], "")
    return F.array_join(F.zip_with(plain, mask, lambda b, m: F.when(m == "1", "N").otherwise(b)), "")


def pack_barcode(lossy: Column) -> Column:
    """code (two bits a base, the first base lowest) and valid (a bit a base; U is no base) of 28 bases of barcode and UMI."""
    bases = F.split(F.rpad(F.substring(F.upper(lossy), 1, 28), 28, "N"), "")
    number = lambda b: F.when(b == "C", 1).when(b == "G", 2).when(b == "T", 3).otherwise(0).cast("long")
    code = F.aggregate(F.reverse(bases), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 2).bitwiseOR(number(b)))
    valid = F.aggregate(F.reverse(bases), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.isin("A", "C", "G", "T").cast("long")))
    return F.struct(code.alias("code"), valid.alias("valid"))


def unpack_barcode(code: Column, valid: Column) -> Column:
    """28 bases, with N where no bit says that a base is valid."""
    at = F.sequence(F.lit(0), F.lit(27))
    base = lambda i: F.substr(F.lit("ACGT"), F.call_function("shiftright", code, 2 * i).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(at, lambda i: F.when(F.call_function("shiftright", valid, i).bitwiseAND(F.lit(1)) == 1, base(i)).otherwise("N")), "")
