"""Tokenizers against the public libraries, on awkward texts and random ones."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.llm import byte_bpe, token_count, token_shards

public_tokenizers = pytest.importorskip("public_tokenizers")
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "'s", "'S", "é", "ß", "Σ", "İ", "日本", "語", "١", "²", "½", "😀", "‍", "22", ".", "--", "_", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "▁", "ing", "\r\n", "́", "À", "ŉ", "ſ", "µ", "ª", "×", "÷"]
TEXTS = ["", " ", "   x ", "a" * 3000, "ab" * 2500, " " * 700, "日本語" * 700, "x \n y  \n\n z ", *["".join(random.Random(i).choices(PARTS, k=40)) for i in range(300)]]
DOCS = "doc_id long, text string, ids string, n_tokens string"


def tiktoken_encoder():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(byte_bpe.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def words_encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(token_shards.TOKENIZER))


def pieces_encoder():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_count.MODEL))


def pack(ids):
    return np.array(ids, "<u4").tobytes()


def test_byte_bpe_equals_the_library():
    own, library = byte_bpe.codec(byte_bpe.RANKS), tiktoken_encoder()
    for t in TEXTS:
        ids = own.encode(t)
        assert ids == pack(library.encode_ordinary(t))
        assert own.decode(ids) == t.encode()
    import pyarrow as pa

    assert own.encode_group(pa.array(TEXTS)) == [pack(library.encode_ordinary(t)) for t in TEXTS]


def test_piece_counts_equal_the_library():
    own = token_count.counter(token_count.MODEL)
    assert own.count(TEXTS) == [len(x) for x in pieces_encoder().encode(TEXTS, num_threads=1)]


def test_long_sequences_by_agenda_equal_those_by_rounds(monkeypatch):
    own = token_count.counter(token_count.MODEL)
    chunks = ["".join(random.Random(i).choices("abcdeinrst" * 3 + "é日", k=90)) for i in range(50)]
    by_rounds = own.merge(chunks).tolist()
    monkeypatch.setattr(token_count, "LONG", 1)
    assert own.merge(chunks).tolist() == by_rounds


def test_word_ids_equal_the_library():
    own, library = token_shards.encoder(token_shards.TOKENIZER), words_encoder()
    assert [x.tolist() for x in own.encode(TEXTS)] == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


def grouped(text):
    """The ids of a text among others, as batches have them."""
    import pyarrow as pa

    return byte_bpe.codec(byte_bpe.RANKS).encode_group(pa.array(["it's", text, "", text]))[1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab Zé'std\n\t 12²¼.-ÿÀ", max_size=40))
def test_plain_text(text):
    assert grouped(text) == pack(tiktoken_encoder_once().encode_ordinary(text))
    assert [x.tolist() for x in token_shards.encoder(token_shards.TOKENIZER).encode(["a", text, "b"])][1] == words_once().encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert byte_bpe.codec(byte_bpe.RANKS).encode(text) == pack(tiktoken_encoder_once().encode_ordinary(text))
    assert grouped(text) == pack(tiktoken_encoder_once().encode_ordinary(text))
    assert token_count.counter(token_count.MODEL).count([text]) == [len(pieces_once().encode(text))]
    assert [x.tolist() for x in token_shards.encoder(token_shards.TOKENIZER).encode([text])] == [words_once().encode(text, add_special_tokens=False).ids]


_kept = {}


def tiktoken_encoder_once():
    return _kept.setdefault("t", None) or _kept.__setitem__("t", tiktoken_encoder()) or _kept["t"]


def pieces_once():
    return _kept.setdefault("p", None) or _kept.__setitem__("p", pieces_encoder()) or _kept["p"]


def words_once():
    return _kept.setdefault("w", None) or _kept.__setitem__("w", words_encoder()) or _kept["w"]


def test_memory_is_bounded_and_keeps_what_is_asked_again():
    memo = byte_bpe.Memo(3)
    for i in range(10):
        memo.keep(i, i + 1)
        assert memo[i] == i + 1
    assert len(memo) + len(memo.old) <= 6 and memo[99] is None


def test_texts_without_spaces_leave_nothing_in_memory():
    texts = ["".join(random.Random(i).choices("abcdé日本語", k=3000)) for i in range(40)]
    for memo, work in (
        (token_shards.encoder(token_shards.TOKENIZER).units, token_shards.encoder(token_shards.TOKENIZER).encode),
        (token_shards.encoder(token_shards.TOKENIZER).pieces, token_shards.encoder(token_shards.TOKENIZER).encode),
    ):
        work(texts)
        assert max((len(x) for held in (memo, memo.old) for x in held), default=0) <= token_shards.LONGEST


def test_shards_are_looked_up_without_inflating_all(monkeypatch):
    monkeypatch.setattr(token_shards, "BLOCK", 1 << 10)
    ids = np.random.default_rng(5).integers(0, 49408, 40_000)
    w = token_shards.WaveletMatrix.from_bytes(token_shards.WaveletMatrix.build(ids).to_bytes())
    assert not w.planes.ready
    assert w.access(np.array([0, 777, 39_999])).tolist() == ids[[0, 777, 39_999]].tolist()
    assert len(w.planes.ready) <= 3 * 16 < 16 * 40
    token = int(ids[123])
    assert w.count(token) == (ids == token).sum() and w.locate(token).tolist() == np.flatnonzero(ids == token).tolist()


def rows(spark):
    texts = [None, "", "Hello  World", "long " * 50_000, "é日"]
    return texts, spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(2, "Hello  World", "clash", "clash"), (None, "null id", "", "")], DOCS)


def test_documents_through_spark(spark):
    texts, frame = rows(spark)
    library = tiktoken_encoder()
    got = {r.doc_id: r for r in byte_bpe.encode_documents(frame).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(pack(ids)).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in byte_bpe.decode_documents(byte_bpe.encode_documents(frame)).collect()}
    assert back == {**{i: t or "" for i, t in enumerate(texts)}, None: "null id"}
    counted = {r.doc_id: r for r in token_count.count_tokens(frame, limit=3).collect()}
    pieces = pieces_encoder()
    for i, t in enumerate(texts):
        n = len(pieces.encode(t or ""))
        assert (counted[i].n_bytes, counted[i].n_tokens, counted[i].over_limit) == (len((t or "").encode()), n, n > 3)
    assert byte_bpe.encode_documents(frame.where("false")).count() == token_count.count_tokens(frame.where("false")).count() == 0


def test_shards_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_shards, "SHARD", 50)
    _, frame = rows(spark)
    path = str(tmp_path / "w")
    token_shards.write_shards(frame, path)
    library, at = words_encoder(), 0
    got = sorted(token_shards.read_shards(spark, path).collect(), key=lambda r: r.start)
    want = sorted(frame.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    for r, w in zip(got, want):
        ids = [*library.encode(w.text or "", add_special_tokens=False).ids, token_shards.END]
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (at, len(ids), zlib.crc32(pack(ids)), pack(ids))
        at += len(ids)
    empty = str(tmp_path / "e")
    token_shards.write_shards(frame.where("false"), empty)
    assert token_shards.read_shards(spark, empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 3000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).zipf(1.4, n) % 49408
    w = token_shards.WaveletMatrix.from_bytes(token_shards.WaveletMatrix.build(ids).to_bytes())
    assert (w.all() == ids).all() and (w.access(np.arange(n)) == ids).all()
    for token in (0, 1, 2, 7, 49407, 70000):
        assert w.locate(token).tolist() == np.flatnonzero(ids == token).tolist()
        assert w.count(token, n // 4, n // 2) == int((ids[n // 4 : n // 2] == token).sum())
        assert w.locate(token, n // 4, n // 2).tolist() == (np.flatnonzero(ids[n // 4 : n // 2] == token) + n // 4).tolist()
