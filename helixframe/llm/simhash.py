"""SimHash near-duplicates through pivot distance tables.

Each text gets a 64-bit fingerprint. Equal fingerprints are one node from then on, so copies never meet as
pairs. Links, pairs of fingerprints that differ in at most `BITS` bits, are found with tables of Hamming
distances to reference fingerprints (pivots): as |d(x, p) - d(y, p)| <= d(x, y), a pair whose coordinates
differ by more than BITS anywhere cannot link, and only what is left is verified.

The table is laid over the cluster like this. The 64 bits are cut into BITS + 1 blocks; a pair that links is
equal on one block at least, where its distances to any pivot inside the block differ by 0. The distances to
the block's one-bit pivots and to zero tell the block's value and are told by it, so that value stands for the
coordinates as the key of an equi-join: a cell. Within a cell the tables over all 64 bits discard pairs,
survivors are verified, and the cell returns the edges of a spanning forest, at most one a fingerprint, never
the pairs. A cell with more than `CELL` fingerprints is cut
again, exactly: the bits outside its block still differ in at most BITS places, so they are cut into BITS + 1
blocks in turn, and so on until cells are small, as those with few free bits are. Nothing is capped or dropped.

Components come from alternating large-star and small-star steps over those edges, each step written to the
shared folder.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like any
other; repeated rows and rows with equal ids keep a row each; a null id takes part with its fingerprint but
names no component (the component is null only if it holds no id at all); an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, lookup, partitions, released, rows_of, table, texts, written

WORD = re.compile("[^ \t-\r]+")
SEED, SHINGLE, BITS = 42, 3, 3
#: Pivots of the tables over all 64 bits, and the most fingerprints in a cell before it is cut again.
PIVOTS, CELL = 24, 1024
#: Shingles hashed and counted at a time, and documents taken from a batch at a time.
RUN, DOCS = 1 << 16, 512
ASCII_LOWER = str.maketrans(UPPER, UPPER.lower())


def majority(h: np.ndarray) -> int:
    """The word of the bits that are set in over half of 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), RUN):
        ones += np.unpackbits(h[at : at + RUN].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The SimHash of a whole text; a bit is set if it is in over half of the shingles' hashes."""
    words = [x.encode() for x in WORD.findall(text.translate(ASCII_LOWER) if not text.isascii() else text.lower())]
    if not words:
        return 0
    whole = b" ".join(words)
    count = max(1, len(words) - size + 1)
    if count == 1:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum([len(x) + 1 for x in words])
    starts = [0, *ends[: count - 1].tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(whole[a:b], SEED) for a, b in zip(starts, stops)], "<u8"))


def pivots(count: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed pseudo-random words."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(count)], np.uint64)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks(mask: int, parts: int = BITS + 1) -> list[int]:
    """The set bits of mask, cut into masks of nearly equal size."""
    own = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << i for i in own[len(own) * k // parts : len(own) * (k + 1) // parts]) for k in range(parts)]


def finer(fixed: int) -> list[int]:
    """The cells' masks one level below: what was fixed, and one block of the bits that were not."""
    return [fixed | x for x in blocks(~fixed & (1 << 64) - 1) if x]


def cell_forest(cell: np.ndarray, f: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root) that join the linked fingerprints of each cell.

    Rows are sorted by cell and by the distance to the first pivot. Each row meets those behind it at distance
    1, 2, ... of rows until the first coordinate differs by more than bits; pairs already joined are passed
    over, the other pivots discard, and what survives is verified."""
    n, tables = len(f), np.bitwise_count(f[None, :] ^ pivots()[:, None]).astype(np.int8)
    label, i, step = np.arange(n), np.arange(n - 1), 1
    while len(i):
        i = i[: np.searchsorted(i, n - step)]
        j = i + step
        near = (cell[i] == cell[j]) & (tables[0][j] - tables[0][i] <= bits)
        i, step = i[near], step + 1
        a, b = i, j[near]
        new = label[a] != label[b]
        a, b = a[new], b[new]
        for t in tables[1:]:
            if not len(a):
                break
            near = np.abs(t[a] - t[b]) <= bits
            a, b = a[near], b[near]
        true = np.bitwise_count(f[a] ^ f[b]) <= bits
        a, b = a[true], b[true]
        while len(a):
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], least)
            np.minimum.at(label, label[b], least)
            while (label != (up := label[label])).any():
                label = up
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
    own = np.flatnonzero(label != np.arange(n))
    return f[own], f[label[own]]


def forests(batches):
    """Arrow batches (fixed, value, d0, f), sorted, to edges (a, b); a cell that reaches over batches is held until it ends."""

    def out(x):
        change = np.ones(len(x[0]), bool)
        change[1:] = (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])
        a, b = cell_forest(np.cumsum(change), x[2].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held = None
    for batch in batches:
        new = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("fixed", "value", "f")]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])) if len(held[0]) else []
        if len(last):
            cut = last[-1] + 1
            yield out([x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield out(held)


def links(nodes: DataFrame) -> DataFrame:
    """f (distinct) -> edges (a, b) whose components are those of all links."""
    n, all_bits = nodes.count(), (1 << 64) - 1
    masks = blocks(all_bits)
    while n >> min(bin(x).count("1") for x in masks) > CELL // 4:
        masks = [y for x in masks for y in finer(x)]
    rows = nodes.select("f", F.explode(F.array(*[F.lit(signed(x)) for x in masks])).alias("fixed"))
    rows = rows.withColumn("value", F.col("f").bitwiseAND(F.col("fixed")))
    edges, key = None, ["fixed", "value"]
    while True:
        large = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).select(*key), "simhash-large")
        more = bool(large.limit(1).count())
        small = rows.join(large, key, "left_anti") if more else rows
        d0 = F.expr(f"bit_count(f ^ {signed(int(pivots(1)[0]))}L)")
        found = small.withColumn("d0", d0).repartition(partitions(nodes.sparkSession), *key).sortWithinPartitions(*key, "d0", "f").select(*key, "f").mapInArrow(forests, "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        if not more:
            return edges
        below = {x: finer(x) for x in masks}
        down = F.create_map(*[y for x, sub in below.items() for y in (F.lit(signed(x)), F.array(*[F.lit(signed(z)) for z in sub]))])
        rows = written(rows.join(large, key, "left_semi").select("f", F.explode(down[F.col("fixed")]).alias("fixed")).withColumn("value", F.col("f").bitwiseAND(F.col("fixed"))).distinct(), "simhash-cells")
        masks = sorted({y for sub in below.values() for y in sub})


def star(edges: DataFrame, name: str) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
    total = 2 * edges.count()
    large = written(lookup(both, written(least, name), "a", total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
    least = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), name)
    down = lookup(large, least, "a", large.count()).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return written(down.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> f, root: the least member of each component, for members but the root."""
    name = "simhash-star"
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), name)
    before = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("f"), F.col("b").alias("root"))
        before, edges = now, star(edges, name)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h (a hash of the text) and f (the fingerprint as a signed long) of each row."""

    def run(batches):
        for batch in rows_of(batches, DOCS):
            f = np.array([fingerprint(x) for x in texts(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(f.view(np.int64))], ["id", "h", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text")).mapInArrow(released(run), f"id {kind}, h long, f long")


def grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h, f, component_id of each row."""
    own = written(fingerprints(docs, id_col, text_col), "simhash-documents")
    nodes = written(own.groupBy("f").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    roots = components(links(nodes.select("f")))
    placed = written(nodes.join(roots, "f", "left").withColumn("root", F.coalesce("root", "f")), "simhash-roots")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    names = written(lookup(placed.select("root", "f", F.col("n").alias("rows")), written(named, "simhash-names"), "root", nodes.count()).select("f", "component_id", F.col("rows").alias("n")), "simhash-names")
    return lookup(own, names, "f", own.count())


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, fingerprint, component_id (the smallest id reachable over links)."""
    found = grouped(docs, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of near copies, with all its columns; see resemblance."""
    from . import resemblance

    return resemblance.near_dedup(docs, id_col, text_col)
