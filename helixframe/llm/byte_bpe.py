"""Byte-level BPE encoding and decoding from a public rank file.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over the vocabulary finds the longest token
at a place. Encoding walks left to right with longest matches and backtracks where two neighbours are not
compatible: two tokens may stand side by side if merging the bytes of both gives exactly these two. A
sequence whose neighbours are all compatible is the result of the merges, so the walk reproduces them without
a merge queue; positions from which no way leads on are marked, so each is left once at most and the
work is linear in the length. Compatibility of a pair is computed once and remembered.

Many texts at once are cut into matches of the pattern by array operations on their bytes where they are plain
(`plain_text`); their distinct pieces are encoded once per worker while they are remembered (a bounded memory). Other texts
are cut first where a space follows a character that is no white space, as no match of the pattern reaches across.

Defined cases: a null text counts as empty; an empty text has no tokens; ids repeat for repeated rows; strings
that look like special tokens are ordinary text. Only the id and text columns are read, so other columns
cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plain_text
from .common import Memo, give_back, laid_out, released, rows_of, table, with_groups

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Entries that a worker remembers, twice at most: units, matches of the pattern and pairs of tokens; the most characters of the first two.
MEMO_UNITS, MEMO_PIECES, MEMO_PAIRS, LONGEST, DOCS = 10_000, 150_000, 100_000, 64, 512
#: Bytes of text whose units are looked up together.
GROUP = 1 << 20


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        lines = (x.split() for x in open(path, "rb"))
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.longest = max(map(len, self.ranks))
        # Tokens that merging their own bytes doesn't give can only be a whole match.
        self.latin = {t.decode("latin-1"): r for t, r in self.ranks.items() if len(t) == 1 or self.merged(t) == [r]}
        self.automaton = ahocorasick.Automaton()
        # Every beginning of a usable token is a word of the automaton, with the length and id of the longest one that begins it.
        for token in self.latin:
            at = 0
            for n in range(1, len(token) + 1):
                rank = self.latin.get(token[:n])
                if rank is not None:
                    at = n << 32 | rank
                self.automaton.add_word(token[:n], at)
        #: By id: length and id of the longest usable token that begins the token; (0, -1): none.
        self.shorter = [(0, -1)] * len(self.bytes_of)
        for token, rank in self.latin.items():
            size = next((n for n in range(len(token) - 1, 0, -1) if token[:n] in self.latin), 0)
            self.shorter[rank] = (size, self.latin[token[:size]]) if size else (0, -1)
        # Python counts U+001C to U+001F as white space, the Unicode property does not.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.pairs = Memo(MEMO_PAIRS)
        self.units, self.pieces = Memo(MEMO_UNITS, LONGEST), Memo(MEMO_PIECES, LONGEST)

    def merged(self, piece: bytes) -> list[int]:
        """The merges themselves, for short pieces: the lowest rank first, the leftmost of equal ones."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank, none = self.ranks.get, len(self.bytes_of)
        order = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while order and (least := min(order)) < none:
            at = order.index(least)
            parts[at : at + 2] = [new := parts[at] + parts[at + 1]]
            del order[at]
            if at:
                order[at - 1] = rank(parts[at - 1] + new, none)
            if at < len(order):
                order[at] = rank(new + parts[at + 1], none)
        return [self.ranks[x] for x in parts]

    def compatible(self, a: int, b: int) -> bool:
        return self.pairs.keep(a << 32 | b, self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b])

    def encode_piece(self, raw: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        piece, end = raw.decode("latin-1"), len(raw)
        depth, begins, known, shorter, longest = self.automaton.longest_prefix, self.automaton.get, self.pairs, self.shorter, self.longest
        ids: list[int] = []
        dead = bytearray(end + 1)
        at, size = 0, -1
        while at < end:
            if size < 0:
                rest = piece[at : at + longest]
                found = begins(rest[: depth(rest)])
                size, token = found >> 32, found & 0xFFFFFFFF
            while size:
                if not dead[at + size]:
                    if not ids:
                        break
                    fits = known[ids[-1] << 32 | token]
                    if fits or fits is None and self.compatible(ids[-1], token):
                        break
                size, token = shorter[token]
            if size:
                ids.append(token)
                at, size = at + size, -1
            else:
                dead[at] = 1
                last = ids.pop()
                at -= len(self.bytes_of[last])
                size, token = shorter[last]
        return ids

    def pack(self, unit: str) -> bytes:
        # array("I") is in the machine's order: little-endian wherever Spark's executors run.
        return b"".join([self.piece(x.encode()) for x in self.pattern.findall(unit)])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        units, out, held = self.units, [], ""
        for i, part in enumerate(text.split(" ")):
            unit = f" {part}" if i else part
            if held:
                unit, held = held + unit, ""
            found = units[unit]
            if found is not None:
                out.append(found)
            elif not part or part[-1].isspace():
                held = unit  # white space may go on
            else:
                out.append(units.keep(unit, self.pack(unit)))
        if held:
            out.append(self.pack(held))
        return b"".join(out)

    def pieces_of(self, data: np.ndarray, kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where the matches of the pattern start in plain texts."""
        first = plain_text.runs(kind, rows)
        # The last of white space before something else is a match of its own, or if it is a space begins the next one.
        after = np.flatnonzero(first[1:] & (kind[1:] != plain_text.SPACE) & (kind[:-1] == plain_text.SPACE)) + 1
        after = after[~np.isin(after, rows)]
        first[after - 1] = True
        first[after[data[after - 1] == 0x20]] = False
        plain_text.contract(data, kind, rows, first)
        return np.flatnonzero(first)

    def encode_group(self, column: pa.Array) -> list[bytes]:
        """The same for many texts: plain ones are cut by array operations, their distinct pieces looked up once, and the ids laid
        out; others are encoded one by one."""
        column = column.cast(pa.large_string())
        rows = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[rows[0] : rows[-1]]
        rows = rows - rows[0]
        _, kind, odd = plain_text.classify(data, rows, False)
        starts = self.pieces_of(data, kind, rows) if len(data) else np.zeros(0, np.int64)
        bounds = np.searchsorted(starts, rows)
        keep = np.ones(len(starts), bool)
        for i in odd.tolist():
            keep[bounds[i] : bounds[i + 1]] = False
        cuts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])
        pieces = cuts.filter(pa.array(keep)).dictionary_encode()
        found = [self.piece(x) for x in pieces.dictionary.to_pylist()]
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        # Each text is closed by an entry of its own: nothing, or all its ids if it is not plain.
        closing = np.full(len(column), len(found))
        closing[odd] += 1 + np.arange(len(odd))
        found += [b"", *(self.encode(column[i].as_py()) for i in odd.tolist())]
        code = np.insert(pieces.indices.to_numpy(), bounds[1:], closing)
        ids, stops = laid_out(found, code, np.dtype("<u4"))
        whole, ends = memoryview(ids.tobytes()), (4 * stops[bounds[1:] + np.arange(len(column))]).tolist()
        return [bytes(whole[a:b]) for a, b in zip([0, *ends[:-1]], ends)]

    def piece(self, raw: bytes) -> bytes:
        found = self.pieces[raw]
        return self.pieces.keep(raw, array("I", self.encode_piece(raw)).tobytes()) if found is None else found

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


@cache
def codec(name: str) -> ByteBPE:
    """One a worker; the vocabulary is read where it is installed."""
    import public_tokenizers

    return ByteBPE(public_tokenizers.path(name), public_tokenizers.PATTERN)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, with_ids: bool = True) -> DataFrame:
    """A row a document: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the bytes decoded from the ids) and, if asked for,
    ids. Of equal texts that follow one another, as the copies that mixing makes do, one is encoded."""

    def digests(bpe: ByteBPE, ids: bytes) -> tuple[bytes, str, str]:
        return ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    def run(batches):
        bpe = codec(ranks)
        for batch, group in ((x, g) for b in batches for x, g in with_groups(b, "text", GROUP)):
            # The places of texts that are not those of the row before.
            new = np.flatnonzero(np.r_[True, pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False)])
            made = [digests(bpe, x) for x in bpe.encode_group(group.take(pa.array(new)))]
            out = [made[i] for i in (np.searchsorted(new, np.arange(len(group)), side="right") - 1).tolist()]
            found = [pa.array([len(x[0]) // 4 for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())]
            if with_ids:
                found.append(pa.array([x[0] for x in out], pa.binary()))
            give_back()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), SCHEMA + ", ids binary" * with_ids)


def decode_documents(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, ids -> doc_id, text; bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        bpe = codec(ranks)
        for batch in rows_of(batches, DOCS):
            out = [bpe.decode(x or b"").decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)
