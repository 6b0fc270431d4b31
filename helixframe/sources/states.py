"""The binary stream of reads' candidate genes and splicing states, for other tools; Parquet is the form that scales.

One file holds a header with the names of the genes, and a record a read in the order of reads: barcode and UMI, two bits a
base with the first base lowest, a bit a base that says whether it is valid, what was assigned, and the candidates by gene."""

from __future__ import annotations

import gzip
import io
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S

# The format's mark, version and sizes, with states and without; its types by number, and the states that it knows.
MAGIC, VERSION, FIXED, FORWARD, ENTRY = b"CSTRAD2\0", 2, 28, 1, 5
PLAIN_MAGIC, PLAIN_VERSION, PLAIN_ENTRY = b"CSTRAD1\0", 1, 4
TYPES = ("unique_gene", "ambiguous_gene", "ambiguous_transcript_same_gene", "antisense_gene", "unmapped", "low_complexity", "low_quality")
STATES = (1, 2, 3, 4, 8)
NONE, CHUNK = (1 << 32) - 1, 1 << 20
SCHEMA = "read_id long, code long, valid long, assignment_type string, gene string, candidate_count long, score int, flags int, top array<struct<gene:string,state:int>>"


def header(genes: list[str], states: bool = True) -> bytes:
    if not states:
        return PLAIN_MAGIC + struct.pack("<4I", PLAIN_VERSION, FIXED, FORWARD, 0)
    names = [x.encode() for x in genes]
    return MAGIC + struct.pack("<5I", VERSION, FIXED, FORWARD, ENTRY, len(names)) + b"".join(struct.pack("<H", len(x)) + x for x in names)


def record(code: int, valid: int, primary: int | None, candidates: int, score: int, flags: int, kind: str, top: list[tuple[int, int]], states: bool = True) -> bytes:
    fixed = struct.pack("<QIIIHHBBH", code, valid, NONE if primary is None else primary, candidates, score, flags, TYPES.index(kind) + 1, 0, len(top))
    return fixed + b"".join(struct.pack("<IB", g, s) if states else struct.pack("<I", g) for g, s in sorted(top))


def write_state_stream(assignments: DataFrame, genes: DataFrame, path: str, states: bool = True) -> None:
    """assignments of `map_reads` (read_id, cb, umi, assignment_type, gene, candidate_count, score, flags, top) and genes (gene,
    gene_id from 0) as one file: tasks make chunks of records by ranges of read_id, and the driver passes them on, one partition at a time. Without
    states the older form, whose genes are numbers only."""
    spark = assignments.sparkSession
    names = [r.gene for r in genes.orderBy("gene_id").collect()]  # the header holds them all
    number = {x: i for i, x in enumerate(names)}
    packed = S.pack_barcode(F.concat("cb", "umi"))

    def chunks(batches):
        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                top = [(number[t["gene"]], t["state"]) for t in r["top"] or []] if r["assignment_type"] in TYPES[:3] else []
                held.append(record(r["code"], r["valid"], number.get(r["gene"]), r["candidate_count"], min(r["score"], 65535), r["flags"], r["assignment_type"], top, states))
                size += len(held[-1])
                if size > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["chunk"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["chunk"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = assignments.select("read_id", packed.alias("p"), "assignment_type", "gene", "candidate_count", "score", "flags", "top").select("read_id", "p.code", "p.valid", "assignment_type", "gene", "candidate_count", "score", "flags", "top")
    parts = rows.repartitionByRange(n, "read_id").sortWithinPartitions("read_id").mapInArrow(chunks, "chunk binary")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
    try:
        out.write(bytearray(header(names, states)))
        for r in parts.toLocalIterator():
            out.write(bytearray(r.chunk))
    finally:
        out.close()


def parse(raw: bytes):
    """The records of a stream, plain, gzip or zstd, as rows of SCHEMA; a broken one raises."""
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    elif raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    genes, entry = [], ENTRY
    if raw[:8] == PLAIN_MAGIC and len(raw) >= 24 and struct.unpack_from("<4I", raw, 8) == (PLAIN_VERSION, FIXED, FORWARD, 0):
        genes, entry, at = None, PLAIN_ENTRY, 24
    elif raw[:8] != MAGIC or len(raw) < 28 or struct.unpack_from("<4I", raw, 8) != (VERSION, FIXED, FORWARD, ENTRY):
        raise ValueError("not a stream of states of this version")
    else:
        (count,), at = struct.unpack_from("<I", raw, 24), 28
        for _ in range(count):
            (size,) = struct.unpack_from("<H", raw, at)
            genes.append(raw[at + 2 : at + 2 + size].decode())
            at += 2 + size
        if any(c in x for x in genes for c in "\t\n\r"):
            raise ValueError("a gene has an invalid name")
    number, name = 0, str if genes is None else genes.__getitem__
    while at < len(raw):
        if at + FIXED > len(raw):
            raise ValueError("a record is cut off")
        code, valid, primary, candidates, score, flags, kind, zero, n = struct.unpack_from("<QIIIHHBBH", raw, at)
        at += FIXED
        if not 1 <= kind <= len(TYPES) or zero:
            raise ValueError("a record has an invalid type")
        if genes is not None and n > len(genes) or at + entry * n > len(raw):
            raise ValueError("a record has more candidates than there are")
        top = [struct.unpack_from("<IB", raw, at + entry * i) if genes is not None else (*struct.unpack_from("<I", raw, at + entry * i), 8) for i in range(n)]
        at += entry * n
        if genes is not None and any(g >= len(genes) for g, _ in top) or any(a >= b for (a, _), (b, _) in zip(top, top[1:])) or any(s not in STATES for _, s in top):
            raise ValueError("a record's candidates are not sorted, unique and known")
        sound = {1: n == 1 and primary == top[0][0], 3: n == 1 and primary == top[0][0], 2: n > 1 and primary == NONE}.get(kind, kind >= 5 and n == 0 and primary == NONE)
        if not sound:
            raise ValueError("a record's type does not fit its candidates")
        yield number, code - (1 << 64) if code >> 63 else code, valid, TYPES[kind - 1], None if primary == NONE else name(primary), candidates, score, flags, [{"gene": name(g), "state": s} for g, s in top]
        number += 1


def read_state_stream(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA, with cb and umi: one file, read whole by one task, as its records have no fixed size (2 GB at most, a limit of Spark's binary files)."""

    def run(batches):
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                held = []
                for row in parse(raw):
                    held.append(row)
                    if len(held) == 8192:
                        yield table(held)
                        held = []
                yield table(held)

    def table(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("gene", pa.string()), ("state", pa.int32())])))
        names = ["read_id", "code", "valid", "assignment_type", "gene", "candidate_count", "score", "flags", "top"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)
    text = S.unpack_barcode(F.col("code"), F.col("valid"))
    return found.withColumns({"cb": F.substr(text, F.lit(1), F.lit(16)), "umi": F.substr(text, F.lit(17), F.lit(12))})
