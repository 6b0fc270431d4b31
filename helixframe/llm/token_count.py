"""Token counts of a BPE piece model by rank-synchronous merging of ragged arrays.

Texts are cut before runs of spaces: no piece of such a model holds a word space behind another character
(checked when it is loaded), so nothing merges across. Chunks that a worker doesn't remember are laid end to
end as one array of symbols. In each round every sequence merges its lowest-rank pair, all sequences at
once; a sequence without a pair in the vocabulary leaves. What survives is counted: one for a piece, its UTF-8
bytes for a character that the model lacks. A chunk is cut again where two characters stand side by side in
no piece, which keeps sequences short in texts without spaces; sequences that stay longer than `LONG` symbols
are merged by an agenda instead, which takes n log n steps however long they are.

Defined cases: a null text counts as empty and has 0 tokens; repeated rows are counted each; special strings
are plain text; other columns are never read.
"""

from __future__ import annotations

import heapq
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, rows_of, table, texts

MODEL, LIMIT = "piece_bpe_32k.model", 4096
MEMO_CHUNKS, LONGEST, LONG, DOCS = 700_000, 64, 1024, 512
SPACE = "▁"
CHUNK = re.compile(" +[^ ]*")
NONE = np.iinfo(np.int64).max


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(SPACE in x.lstrip(SPACE) for x in pieces):
            raise ValueError("a piece holds a word space behind another character")
        #: Symbols: the pieces, and the characters inside pieces that are none themselves.
        symbols = list(pieces) + sorted({c for x in pieces for c in x} - pieces.keys())
        number = {x: i for i, x in enumerate(symbols)}
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.base = len(symbols) + 5
        self.weight = np.array([1 if x in pieces else len(x.encode()) for x in symbols] + [0, 1, 2, 3, 4], np.int64)
        found = {}
        for x, score in pieces.items():
            for k in range(1, len(x)):
                if x[:k] in number and x[k:] in number:
                    found[number[x[:k]] * self.base + number[x[k:]]] = (order[score], number[x])
        self.keys = np.array(sorted(found), np.int64)
        self.rank = np.array([found[k][0] for k in self.keys.tolist()], np.int64)
        self.into = np.array([found[k][1] for k in self.keys.tolist()], np.int64)
        chars = sorted((ord(x), i) for x, i in number.items() if len(x) == 1)
        self.chars, self.char_ids = (np.array(x, np.int64) for x in zip(*chars))
        self.beside = np.array(sorted({ord(a) << 21 | ord(b) for x in pieces for a, b in zip(x, x[1:])}), np.int64)
        self.memo = Memo(MEMO_CHUNKS, LONGEST)

    def look(self, table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, known = self.look(self.keys, left * self.base + right)
        return np.where(known, self.rank[at], NONE), at

    def merge(self, chunks: list[str]) -> np.ndarray:
        """The number of tokens of each chunk; a chunk is what follows a word space."""
        whole = [SPACE + x.replace(" ", SPACE) for x in chunks]
        code = np.frombuffer("".join(whole).encode("utf-32-le"), "<u4").astype(np.int64)
        chunk = np.repeat(np.arange(len(whole)), [len(x) for x in whole])
        at, known = self.look(self.chars, code)
        size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        symbol = np.where(known, self.char_ids[at], self.base - 5 + size)
        first = np.ones(len(code), bool)
        first[1:] = (chunk[1:] != chunk[:-1]) | ~self.look(self.beside, code[:-1] << 21 | code[1:])[1]
        sequence = np.cumsum(first) - 1
        owner, lengths = chunk[first], np.bincount(sequence)
        counts = np.zeros(len(owner), np.int64)
        long = lengths > LONG
        for s in np.flatnonzero(long).tolist():
            counts[s] = self.agenda(symbol[sequence == s].tolist())
        keep = ~long[sequence]
        symbol, sequence = symbol[keep], sequence[keep]
        while len(symbol):
            rank, at = self.ranks(symbol[:-1], symbol[1:])
            rank[sequence[:-1] != sequence[1:]] = NONE
            rank, at = np.append(rank, NONE), np.append(at, 0)
            starts = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbol)])
            over = np.repeat(least == NONE, sizes)
            if over.any():
                counts += np.bincount(sequence[over], self.weight[symbol[over]], len(counts)).astype(np.int64)
            hit = np.flatnonzero((rank == np.repeat(least, sizes)) & ~over)
            hit = hit[np.r_[True, sequence[hit[1:]] != sequence[hit[:-1]]]] if len(hit) else hit  # the leftmost of a sequence
            symbol[hit] = self.into[at[hit]]
            keep = ~over
            keep[hit + 1] = False
            symbol, sequence = symbol[keep], sequence[keep]
        return np.bincount(owner, counts, len(chunks)).astype(np.int64)

    def agenda(self, symbols: list[int]) -> int:
        """One long sequence: a heap of its pairs by rank and place."""
        table = getattr(self, "table", None) or dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.into.tolist())))
        self.table = table
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (found := table.get(symbols[i] * self.base + symbols[j])):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return int(self.weight[[x for x in symbols if x >= 0]].sum())

    def count(self, batch: list[str]) -> list[int]:
        """Tokens of whole texts."""
        memo, totals, wanted = self.memo, [], {}
        for row, text in enumerate(batch):
            if SPACE in text:
                text = text.replace(SPACE, " ")
            if not text:
                totals.append(0)
                continue
            odd = "  " in text or text[0] == " " or text[-1] == " "
            parts = [x[1:] for x in CHUNK.findall(" " + text)] if odd else text.split(" ")
            found = [memo[x] for x in parts]
            if None in found:
                for i, c in enumerate(found):
                    if c is None:
                        wanted.setdefault(parts[i], []).append(row)
                        found[i] = 0
            totals.append(sum(found))
        if wanted:
            for (chunk, rows), c in zip(wanted.items(), self.merge(list(wanted)).tolist()):
                memo.keep(chunk, c)
                for row in rows:
                    totals[row] += c
        return totals


@cache
def counter(name: str) -> PieceCounter:
    import public_tokenizers

    return PieceCounter(public_tokenizers.path(name))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """A row a document: id_col, n_bytes, n_tokens, over_limit."""

    def run(batches):
        pieces = counter(model)
        for batch in rows_of(batches, DOCS):
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(pieces.count(texts(batch, "text")), pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    whole = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col).alias("id"), whole.alias("text"), F.octet_length(whole).cast("long").alias("n_bytes")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
