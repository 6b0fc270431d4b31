"""Token ids written as wavelet matrices and read back.

Each document is encoded whole, an end id is appended, and documents follow one another in ascending id order.
A shard holds consecutive whole documents and is a wavelet matrix: one bit plane for each bit of an id, the
most significant first, each plane sorted stably by the bits above it, with counts of ones before every block
of 64 bits. Any token, the number of a token's occurrences in a range and the place of its k-th occurrence
are read from the planes alone; no plain copy of the ids is kept. Planes are compressed in blocks, and the file holds
the ones before each block, so a look-up inflates the few blocks that it passes through and no others.

Shards are rows of Parquet files in a folder that only Spark writes and reads, so it may be in any store that
Spark reaches: bucket, seq (place in the bucket), local (ids of the bucket's shards before it), n_docs, n_tokens,
blob. Documents get to buckets by quantiles of the id, taken from the id column alone; a bucket is a partition, sorted with
spill and cut to shards as its rows pass, so memory is that of one shard, or of one document if that is longer.
Only a count for each bucket meets in one place.

Defined cases: a null text counts as empty and has the end id alone; rows with a null id come first; rows
with equal ids lie side by side, ordered by their ids of tokens; strings of special tokens inside a text are
what the tokenizers library makes of them; an empty table gives an empty folder and result.
"""

from __future__ import annotations

import struct
import zlib
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import plain_text
from .common import Memo, fresh_path, groups_of, laid_out, partitions, rows_of, table, with_groups

TOKENIZER, END = "word_bpe_49k.json", 2
#: Ids in a shard before it is closed; entries that a worker remembers.
SHARD, MEMO_UNITS, MEMO_PIECES = 1 << 20, 100_000, 400_000
#: Bytes of text whose units are looked up together, units in one call of the library, and the longest units that are remembered.
GROUP, RUN, LONGEST = 1 << 23, 512, 64
#: Buckets at most: a row each meets in one place.
MOST_BUCKETS = 1 << 15
MAGIC = b"WVM2"
#: Bits of a compressed block, and blocks that a reader holds inflated.
BLOCK, KEPT_BLOCKS = 1 << 16, 256


class Planes:
    """Bit planes of n bits in compressed blocks, and the ones before each block; blocks are inflated when asked for."""

    def __init__(self, n: int, before: np.ndarray, blocks: list[list[bytes]]):
        #: before: planes x (blocks + 1); blocks: of each plane.
        self.n, self.before, self.blocks, self.ready = n, before, blocks, {}

    def words(self, k: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit words of a block, and the ones of the plane before each."""
        found = self.ready.get((k, block))
        if found is None:
            if len(self.ready) >= KEPT_BLOCKS:
                self.ready.clear()
            own = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.blocks[k][block]), "<u8")
            counts = np.cumsum(np.bitwise_count(own), dtype=np.int64)
            found = self.ready[k, block] = own, self.before[k, block] + np.concatenate([[0], counts[:-1]])
        return found

    def bits(self, k: int) -> np.ndarray:
        """A whole plane, as booleans."""
        unpack = zstandard.ZstdDecompressor().decompress
        whole = np.frombuffer(b"".join([unpack(x) for x in self.blocks[k]]), np.uint8)
        return np.unpackbits(whole, count=self.n, bitorder="little").view(bool)

    def at(self, k: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits of plane k at places (0 beyond the end), and the ones before them."""
        bit, ones = np.zeros(len(places), bool), np.full(len(places), self.before[k, -1], np.int64)
        block = np.where(places < self.n, places // BLOCK, -1)
        for x in np.unique(block[block >= 0]).tolist():
            own = np.flatnonzero(block == x)
            words, counts = self.words(k, x)
            at = places[own] - x * BLOCK
            word, rest = words[at >> 6], (at & 63).astype(np.uint64)
            bit[own] = word >> rest & np.uint64(1)
            ones[own] = counts[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << rest) - np.uint64(1)))
        return bit, ones

    def select(self, k: int, rank: np.ndarray, one: int) -> np.ndarray:
        """The places of the rank-th (from 0) ones or zeros of plane k."""
        before = self.before[k] if one else np.minimum(np.arange(len(self.before[k]), dtype=np.int64) * BLOCK, self.n) - self.before[k]
        block = np.searchsorted(before, rank, side="right") - 1
        out = np.empty(len(rank), np.int64)
        for x in np.unique(block).tolist():
            own = np.flatnonzero(block == x)
            words, counts = self.words(k, x)
            if not one:
                words, counts = ~words, x * BLOCK + np.arange(len(words), dtype=np.int64) * 64 - counts
            word = np.searchsorted(counts, rank[own], side="right") - 1
            bits = np.unpackbits(words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            inside = np.cumsum(bits, axis=1) == (rank[own] - counts[word] + 1)[:, None]
            out[own] = x * BLOCK + word * 64 + np.argmax(inside, axis=1)
        return out


class WaveletMatrix:
    """Access, rank and select over a sequence of unsigned ids."""

    def __init__(self, planes: Planes):
        self.planes, self.n, self.count_of_planes = planes, planes.n, len(planes.blocks)
        self.zeros = (planes.n - planes.before[:, -1]).tolist() if self.count_of_planes else []

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        bits = max(1, int(ids.max()).bit_length()) if n else 1
        now = np.asarray(ids, np.uint16 if bits <= 16 else np.uint32)
        pack = zstandard.ZstdCompressor(level=1).compress
        before, blocks = [], []
        for k in range(bits - 1, -1, -1):
            bit = (now & now.dtype.type(1 << k)) != 0
            packed = np.zeros((n + 63) // 64 * 8, np.uint8)
            packed[: (n + 7) // 8] = np.packbits(bit, bitorder="little")
            cut = range(0, len(packed), BLOCK // 8)
            before.append(np.concatenate([[0], np.cumsum([int(np.bitwise_count(packed[x : x + BLOCK // 8]).sum()) for x in cut], dtype=np.int64)]).astype(np.int64))
            blocks.append([pack(packed[x : x + BLOCK // 8]) for x in cut])
            up = np.empty_like(now)
            np.compress(~bit, now, out=up[: n - before[-1][-1]])
            np.compress(bit, now, out=up[n - before[-1][-1] :])
            now = up
        return cls(Planes(n, np.array(before), blocks))

    def access(self, at) -> np.ndarray:
        """The ids at given places."""
        at = np.asarray(at, np.int64)
        out = np.zeros(at.shape, np.uint32)
        for k in range(self.count_of_planes):
            bit, one = self.planes.at(k, at)
            at = np.where(bit, self.zeros[k] + one, at - one)
            out = out << np.uint32(1) | bit
        return out

    def all(self) -> np.ndarray:
        """The whole sequence, plane by plane from the last."""
        now = np.zeros(self.n, np.uint16 if self.count_of_planes <= 16 else np.uint32)
        for k in range(self.count_of_planes - 1, -1, -1):
            bit, up = self.planes.bits(k), np.empty_like(now)
            up[np.flatnonzero(~bit)] = now[: self.zeros[k]]
            up[np.flatnonzero(bit)] = now[self.zeros[k] :] | now.dtype.type(1 << (self.count_of_planes - 1 - k))
            now = up
        return now

    def span(self, token: int, start: int, stop: int) -> tuple[int, int]:
        """Where the token's occurrences in [start, stop) lie below the last plane."""
        if token >> self.count_of_planes or start >= stop:
            return 0, 0
        for k in range(self.count_of_planes):
            one = self.planes.at(k, np.array([start, stop]))[1]
            if token >> (self.count_of_planes - 1 - k) & 1:
                start, stop = (self.zeros[k] + one).tolist()
            else:
                start, stop = start - int(one[0]), stop - int(one[1])
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        a, b = self.span(token, start, self.n if stop is None else stop)
        return b - a

    def locate(self, token: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The places of all occurrences of the token in [start, stop), in ascending order."""
        a, b = self.span(token, start, self.n if stop is None else stop)
        at = np.arange(a, b, dtype=np.int64)
        for k in range(self.count_of_planes - 1, -1, -1):
            if not len(at):
                break
            one = token >> (self.count_of_planes - 1 - k) & 1
            at = self.planes.select(k, at - self.zeros[k] if one else at, one)
        return at

    def to_bytes(self) -> bytes:
        """magic, n, planes, blocks of a plane; ones before each block of each plane; sizes of the blocks; the blocks."""
        own = self.planes
        count = len(own.blocks[0])
        sizes = np.array([len(x) for plane in own.blocks for x in plane], "<u4")
        return b"".join([MAGIC, struct.pack("<QII", self.n, len(own.blocks), count), own.before.astype("<u8").tobytes(), sizes.tobytes(), *(x for plane in own.blocks for x in plane)])

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        """Reads the counts; blocks stay compressed until a look-up passes through them."""
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        (n, planes, count), at = struct.unpack_from("<QII", blob, 4), 20
        before = np.frombuffer(blob, "<u8", planes * (count + 1), at).astype(np.int64).reshape(planes, count + 1)
        at += 8 * planes * (count + 1)
        sizes = np.frombuffer(blob, "<u4", planes * count, at)
        ends = at + 4 * planes * count + np.cumsum(sizes, dtype=np.int64)
        blocks = [blob[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
        return cls(Planes(n, before, [blocks[k * count : (k + 1) * count] for k in range(planes)]))


class Encoder:
    """Whole texts to ids by the tokenizers library, asked once for each piece while it is remembered.

    The file's normalizer lower-cases, composes and makes every white space a space, and its pattern drops white space
    and cuts the rest to runs. Texts of plain characters are lower-cased and cut here, many at once, by array
    operations on their bytes; their distinct pieces are looked up, those that are new are asked for together, and the ids
    are laid out. In other texts neither the normalizer nor the pattern reaches over a space, so the library is
    asked for what stands between spaces. A text that holds a special token goes to the library whole."""

    WORD_END = "</w>"

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.cutting = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # The same without what is done here: pieces are normal already, and are parted by spaces.
        self.cutting.normalizer = None
        self.cutting.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.units, self.pieces = Memo(MEMO_UNITS, LONGEST), Memo(MEMO_PIECES, LONGEST)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for x, i in vocabulary.items() if x.endswith(self.WORD_END)]] = True
        added = json.load(open(path))["added_tokens"]
        self.special = [x["content"] for x in added]
        self.between, self.between_id = added[-1]["content"], added[-1]["id"]

    def ids_of(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)

    def cut(self, ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[bytes]:
        whole, size = ids.tobytes(), self.kind.itemsize
        return [whole[a:b] for a, b in zip((size * starts).tolist(), (size * stops).tolist())]

    def ask(self, wanted: list[str]) -> list[bytes]:
        """Ids of each string, by one call of the library over runs of them: a special token, which none of them holds,
        stands between, and its id parts the result."""
        out: list[bytes] = []
        for at in range(0, len(wanted), RUN):
            ids = self.ids_of(self.between.join(wanted[at : at + RUN]))
            ends = np.flatnonzero(ids == self.between_id)
            out += self.cut(ids, np.r_[0, ends + 1], np.r_[ends, len(ids)])
        return out

    def ask_pieces(self, wanted: list[str]) -> list[bytes]:
        """The same for pieces that are cut already: the token that ends a word parts the result."""
        out: list[bytes] = []
        for at in range(0, len(wanted), RUN):
            run = wanted[at : at + RUN]
            ids = np.array(self.cutting.encode_batch_fast([" ".join(run)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.final[ids]) + 1
            out += self.cut(ids, np.r_[0, ends[:-1]], ends) if len(ends) == len(run) else self.ask(run)
        return out

    def known(self, memo: Memo, wanted: list[str], ask) -> list[bytes]:
        """Ids of each string, from the memory or asked for."""
        found = list(map(memo.get, wanted))
        if None in found:
            new = []
            for i, x in enumerate(found):
                if x is None:
                    found[i] = x = memo[wanted[i]]
                    if x is None:
                        new.append(i)
            for i, ids in zip(new, ask([wanted[i] for i in new])):
                found[i] = memo.keep(wanted[i], ids)
        return found

    def pieces_of(self, low: np.ndarray, kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where the pieces of plain texts, and the white space between them, start."""
        first = plain_text.runs(kind, rows)
        first |= (kind == plain_text.DIGIT) & (low & 0xC0 != 0x80)  # a digit of two bytes is one piece
        plain_text.contract(low, kind, rows, first)
        return np.flatnonzero(first)

    def encode_column(self, column: pa.Array, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts end to end, each text closed by the id `last`, and where each text starts and the last one stops."""
        tail = np.array([] if last is None else [last], self.kind)
        parts = [self.encode_group(x, tail) for x in groups_of(column, GROUP)]
        ids = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, self.kind)
        return ids, np.concatenate([[0], np.cumsum(np.concatenate([x for _, x in parts]), dtype=np.int64)]) if parts else np.zeros(1, np.int64)

    def encode_group(self, column: pa.Array, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, and how many each has."""
        column = column.cast(pa.large_string())
        rows = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[rows[0] : rows[-1]]
        rows = rows - rows[0]
        low, kind, odd = plain_text.classify(data, rows, True)
        whole = np.flatnonzero(reduce(pc.or_, [pc.match_substring(column, x) for x in self.special]).to_numpy(zero_copy_only=False))
        odd = np.union1d(odd, whole)
        for i in odd.tolist():  # these are white space here
            kind[rows[i] : rows[i + 1]] = plain_text.SPACE
        starts = self.pieces_of(low, kind, rows) if len(low) else np.zeros(0, np.int64)
        runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(low))), pa.py_buffer(low)])
        white = kind[starts] == plain_text.SPACE
        pieces = runs.filter(pa.array(~white)).dictionary_encode()
        found = self.known(self.pieces, [x.decode() for x in pieces.dictionary.to_pylist()], self.ask_pieces)
        code = pieces.indices.to_numpy()
        bounds = np.searchsorted(starts[~white], rows)
        # What closes a text is the last of the distinct pieces; the other texts' ids follow, each in its row's place.
        closing = len(found)
        found.append(tail.tobytes())
        for i in odd.tolist():
            found.append(self.other(column[i].as_py(), i in whole) + tail.tobytes())
        code = np.insert(code, bounds[1:], closing)
        ends = bounds[1:] + np.arange(1, len(rows))
        code[ends[odd] - 1] = closing + 1 + np.arange(len(odd))
        ids, stops = laid_out(found, code, self.kind)
        return ids, np.diff(stops[ends - 1], prepend=0)

    def other(self, text: str, whole: bool) -> bytes:
        """The ids of a text that is not plain."""
        return self.ids_of(text).tobytes() if whole else b"".join(self.known(self.units, text.split(" "), self.ask))

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, at = self.encode_column(pa.array(batch, pa.string()))
        return np.split(ids, at[1:-1]) if len(batch) else []


@cache
def encoder(name: str) -> Encoder:
    import public_tokenizers

    return Encoder(public_tokenizers.path(name))


def bounds(docs: DataFrame, id_col: str) -> list:
    """Quantiles of the id that cut the documents into buckets, one a shuffle partition; from the id column alone."""
    count = min(MOST_BUCKETS, partitions(docs.sparkSession))
    found = docs.agg(F.percentile_approx(F.col(id_col), [i / count for i in range(1, count)], 8 * count)).first()[0]
    return sorted(set(found or []))


SHARDS = "bucket int, seq long, local long, n_docs long, n_tokens long, blob binary"


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end: int = END) -> None:
    """Writes the ids of docs to path, in ascending order of id_col, a long."""
    spark = docs.sparkSession
    cuts = np.array(bounds(docs, id_col), np.int64)
    kind = encoder(tokenizer).kind  # of the ids; the driver reads the vocabulary for it
    size_of = kind.itemsize

    def encode(batches):
        own = encoder(tokenizer)
        for batch, group in ((x, g) for b in batches for x, g in with_groups(b, "text", GROUP)):
            ids, stops = own.encode_column(group, end)
            whole = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(stops * own.kind.itemsize), pa.py_buffer(ids)])
            at = batch.column("id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            bucket = np.where(batch.column("id").is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(cuts, at))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), batch.column("id"), whole.cast(pa.binary())], ["bucket", "id", "ids"])

    def shards(batches):
        state = {"bucket": None, "seq": 0, "local": 0}
        held: list[tuple] = []
        size = 0

        def close():
            ids = np.frombuffer(b"".join(x[1] for x in held), kind)
            index = np.array([-1 if x[0] is None else x[0] for x in held], "<i8").tobytes()
            null = np.packbits([x[0] is None for x in held]).tobytes()
            stops = np.cumsum([len(x[1]) // size_of for x in held]).astype("<i8").tobytes()
            head = zstandard.ZstdCompressor(level=1).compress(index + stops + null)
            blob = struct.pack("<Q", len(head)) + head + WaveletMatrix.build(ids).to_bytes()
            row = (state["bucket"], state["seq"], state["local"], len(held), len(ids), blob)
            state["seq"], state["local"] = state["seq"] + 1, state["local"] + len(ids)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["bucket", "seq", "local", "n_docs", "n_tokens", "blob"])

        for batch in batches:
            for bucket, key, ids in zip(batch.column("bucket").to_pylist(), batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
                if held and (bucket != state["bucket"] or size + len(ids) // size_of > SHARD):
                    yield close()
                    held, size = [], 0
                if bucket != state["bucket"]:
                    state.update(bucket=bucket, seq=0, local=0)
                held.append((key, ids))
                size += len(ids) // size_of
        if held:
            yield close()

    encoded = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, "bucket int, id long, ids binary")
    dealt = encoded.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "id", "ids")
    dealt.mapInArrow(shards, SHARDS).write.option("compression", "none").parquet(path)


def open_shard(blob: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """The documents' ids, where each ends, and the wavelet matrix of a shard."""
    (size,) = struct.unpack_from("<Q", blob)
    head = zstandard.ZstdDecompressor().decompress(blob[8 : 8 + size])
    n = len(head) // 16  # 16 bytes and a bit a document
    while 16 * n + (n + 7) // 8 > len(head):
        n -= 1
    keys, stops = (np.frombuffer(head, "<i8", n, 8 * n * k) for k in (0, 1))
    null = np.unpackbits(np.frombuffer(head, np.uint8, offset=16 * n), count=n)
    return [None if x else int(k) for k, x in zip(keys, null)], stops, WaveletMatrix.from_bytes(blob[8 + size :])


def read_shards(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """A row a document of the folder: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian unsigned
    32-bit integers)."""
    names = ["bucket", "doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches):
        for batch in rows_of(batches, 1):
            bucket, local, blob = (batch.column(k)[0].as_py() for k in ("bucket", "local", "blob"))
            keys, stops, matrix = open_shard(blob)
            whole, starts = memoryview(matrix.all().astype("<u4").tobytes()), np.concatenate([[0], stops[:-1]])
            ids = [whole[4 * a : 4 * b] for a, b in zip(starts.tolist(), stops.tolist())]
            out = [pa.array([bucket] * len(ids), pa.int32()), pa.array(keys, pa.int64()), pa.array(local + starts, pa.int64()), pa.array(stops - starts, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
            if with_ids:
                out.append(pa.array([x.tobytes() for x in ids], pa.binary()))
            yield from rows_of([pa.RecordBatch.from_arrays(out, names)], 256 if with_ids else 1 << 14)

    stored = spark.read.schema(SHARDS).parquet(path)
    sums = stored.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    # A row a bucket, of which there are MOST_BUCKETS at most.
    base = sums.select("bucket", (F.sum("n").over(Window.orderBy(F.col("bucket"))) - F.col("n")).alias("base"))
    found = stored.select("bucket", "local", "blob").mapInArrow(run, "bucket int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return found.join(F.broadcast(base), "bucket").select("doc_id", (F.col("base") + F.col("start")).alias("start"), *names[3:])


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_shards(spark, path, with_ids=False)
