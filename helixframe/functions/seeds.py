"""Seeds of sequences as rows: all k-mers at a stride, or closed syncmers.

Codes are computed in Arrow batches: unsigned 64-bit arithmetic that wraps around is not among Spark's expressions, and a
rolling code over numpy arrays is far cheaper than a substring a window. Codes of k <= 31 are non-negative longs;
k = 32 uses the sign bit, so order such codes by `code ^ Long.MIN`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODE = np.full(256, 4, np.uint8)
for _letters, _code in (("Aa", 0), ("Cc", 1), ("Gg", 2), ("TtUu", 3)):
    for _x in _letters:
        CODE[ord(_x)] = _code


#: Seeds that a worker holds before it passes them on, besides those of one sequence.
ROWS = 65536


def codes(bases: np.ndarray, k: int) -> np.ndarray:
    """The code of each window of k bases, invalid ones included."""
    n = len(bases) - k + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(k):
        out = out << np.uint64(2) | bases[i : i + n]
    return out


def kmers(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and codes of the windows without an invalid base."""
    base = CODE[np.frombuffer(seq, np.uint8)]
    if len(base) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    wrong = np.concatenate([[0], np.cumsum(base == 4)])
    at = np.flatnonzero(wrong[k:] == wrong[:-k])
    return at, codes(np.where(base == 4, 0, base).astype(np.uint64), k)[at]


def mix(x: np.ndarray) -> np.ndarray:
    """The order of s-mers. The finaliser of splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def syncmers(seq: bytes, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers whose least s-mer, in mixed canonical order, stands at either end."""
    at, code = kmers(seq, k)
    if not len(at) or not 0 < s <= k:
        return at[:0], code[:0]
    base = CODE[np.frombuffer(seq, np.uint8)].astype(np.uint64)
    forward = codes(np.where(base == 4, 0, base), s)
    backward = codes(np.where(base == 4, 0, np.uint64(3) - np.minimum(base, 3))[::-1], s)[::-1]
    with np.errstate(over="ignore"):
        order = mix(np.minimum(forward, backward))
    least = np.lib.stride_tricks.sliding_window_view(order, k - s + 1).min(axis=1)[at]
    keep = (order[at] == least) | (order[at + k - s] == least)
    return at[keep], code[keep]


def distinct_seeds(df: DataFrame, seq: str, k: int, s: int | None = None) -> DataFrame:
    """A row a sequence and code: df's columns but seq, then code and c, how often the sequence holds it. Counting here
    keeps repeats of a sequence out of every shuffle behind."""
    keep = [c for c in df.columns if c != seq]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != seq) + ", code long, c long"

    def run(batches):
        for batch in batches:
            for i, x in enumerate(batch.column(seq)):
                x = (x.as_py() or "").encode("ascii", "replace")
                code, c = np.unique((syncmers(x, k, s) if s else kmers(x, k))[1], return_counts=True)
                for lo in range(0, len(code), 65536):
                    own = code[lo : lo + 65536]
                    take = pa.array(np.full(len(own), i))
                    yield pa.RecordBatch.from_arrays([*(batch.column(n).take(take) for n in keep), pa.array(own.view(np.int64)), pa.array(c[lo : lo + 65536].astype(np.int64))], [*keep, "code", "c"])

    return df.select(*keep, F.col(seq)).mapInArrow(run, schema)


def reverse_complement_codes(code: np.ndarray, k: int) -> np.ndarray:
    """The codes of the reverse complements of k-mers, k <= 32."""
    x = ~code.astype(np.uint64)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        m, n = np.uint64(mask), np.uint64(shift)
        x = (x >> n & m) | (x & m) << n
    x = x >> np.uint64(32) | x << np.uint64(32)
    return x >> np.uint64(64 - 2 * k)


def reverse_complement_code(code: str, k: int):
    """A column of reverse complements of a column of codes."""

    @F.pandas_udf("long")
    def turn(x: pd.Series) -> pd.Series:
        known = x.notna()
        out = reverse_complement_codes(x.fillna(0).to_numpy(np.int64).view(np.uint64), k).view(np.int64)
        return pd.Series(out, index=x.index, dtype="Int64").where(known)

    return turn(code)


def seeds(df: DataFrame, seq: str, k: int, stride: int = 1, s: int | None = None, strand: bool = False) -> DataFrame:
    """A row a seed: df's columns but seq, then pos and code. s: closed syncmers, for which the stride has no meaning.

    strand: both strands, with a column strand (0, and 1 for the reverse complement)."""
    keep = [c for c in df.columns if c != seq]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != seq) + ", pos int, code long" + ", strand int" * strand
    swap = bytes.maketrans(b"ACGTUacgtu", b"TGCAATGCAA")

    def pick(x: bytes):
        if s:
            return syncmers(x, k, s)
        at, code = kmers(x, k)
        own = at % stride == 0
        return at[own], code[own]

    def run(batches):
        for batch in batches:
            held = [], [], [], []
            for i, x in enumerate(batch.column(seq)):
                x = (x.as_py() or "").encode("ascii", "replace")
                for side in (0, 1) if strand else (0,):
                    at, code = pick(x.translate(swap)[::-1] if side else x)
                    for part, v in zip(held, (np.full(len(at), i, np.int32), at.astype(np.int32), code, np.full(len(at), side, np.int8))):
                        part.append(v)
                if sum(map(len, held[0])) >= ROWS:
                    yield from rows_of(batch, held)
                    held = [], [], [], []
            if held[0]:
                yield from rows_of(batch, held)

    def rows_of(batch, held):
        rows, places, found, sides = (np.concatenate(x) for x in held)
        for lo in range(0, len(rows), ROWS):
            own = slice(lo, lo + ROWS)
            take = pa.array(rows[own])
            columns = [batch.column(c).take(take) for c in keep] + [pa.array(places[own]), pa.array(found[own].view(np.int64))]
            if strand:
                columns.append(pa.array(sides[own].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "pos", "code", *["strand"] * strand])

    return df.select(*keep, F.col(seq)).mapInArrow(run, schema)
