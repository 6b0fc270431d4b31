"""The pipeline's stages on planted cases."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import registry


def survivors(texts):
    """The least id of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in sets}


def test_stages_and_registry():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in registry.QUERIES}
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_planted_cases(spark, tmp_path):
    words = [f"{a}{b}" for a in ("the", "and", "of", "in", "that") for b in ("ing", "er", "ed", "ly", "tion", "ness", "able", "ful")]
    text = lambda i, n=400: " ".join(words[(i * 7 + j * (i % 13 + 1)) % len(words)] + str(i) * (j % 50 == 0) for j in range(n))
    clean = [(i, text(i), "en" if i % 2 else "de", f"s{i % 3}", 0) for i in range(60)]
    exact, near = text(100), text(101)
    planted = [(100, exact, "en", "s0", 0), (101, exact.upper(), "en", "s1", 0), (110, near, "en", "s0", 0), (111, near + " " + "x", "en", "s0", 0), (120, None, "en", "s0", 0), (121, "12 34", "en", "s0", 0)]
    docs = spark.createDataFrame(clean + planted, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.written(stage(spark, frame, str(tmp_path)), name)
        seen[name] = {r.doc_id for r in frame.select("doc_id").collect()}
        if name != "byte_bpe":
            assert frame.columns == docs.columns
    assert seen["language_id"] == {i for i, *_ in clean} | {100, 101, 110, 111}
    assert seen["exact_dedup"] == seen["language_id"] - {100}
    assert seen["simhash_near_dedup"] == survivors({i: t for i, t, *_ in clean + planted if i in seen["exact_dedup"]})
    assert 101 in seen["simhash_near_dedup"] and len({110, 111} & seen["simhash_near_dedup"]) == 1
    assert seen["mixing"] == seen["byte_bpe"] == seen["simhash_near_dedup"]
    texts = {i: t for i, t, *_ in clean + planted}
    for r in frame.collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.n_tokens == len(r.ids) // 4


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() == 0 and found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_odd_rows_through_the_whole_run(spark, tmp_path):
    """Null ids and sources, repeated rows, equal ids, a very long text and clashing columns."""
    words = [f"{a}{b}" for a in ("the", "and", "of", "in") for b in ("ing", "er", "ed", "ly", "tion")]
    text = lambda i: " ".join(words[(i * 7 + j * (i % 11 + 1)) % 20] + "x" * (j % (i + 2)) for j in range(90))
    rows = [(i, text(i), "en" if i % 2 else "de", "s", 0) for i in range(24)]
    odd = [(None, text(30), None, None, 0), (None, text(31), "en", None, 0), (50, text(32), "en", "t", 0), (50, text(32), "en", "t", 0), (51, text(33), "en", "t", 0), (51, text(34), "en", "t", 0), (52, text(35) * 3000, "en", "t", 0), (53, None, "en", "t", 0), (54, "", "en", "t", 0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({x: F.lit(1) for x in ("id", "h", "n", "node", "digest", "score", "block", "c0", "key")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.written(stage(spark, frame, ""), name)
        assert frame.columns == docs.columns
    want = {hashlib.sha256(t.encode()).hexdigest() for _, t, *_ in rows + odd if t}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.decoded_sha256 for r in found}
    assert kept <= want and kept == {hashlib.sha256(r.text.encode()).hexdigest() for r in frame.collect()}
    assert {hashlib.sha256(t.encode()).hexdigest() for _, t, *_ in odd if t} <= kept
    assert sorted({r.doc_id for r in found if (r.doc_id or 0) >= 50}) == [50, 51, 52] and None in {r.doc_id for r in found}
    assert len({(r.doc_id, r.ids_sha256) for r in found}) == len(kept)


def test_exact_survivors_of_near_duplicates(spark):
    """Clean texts that brute force shows to be unlinked all stay, and of each with its edited copies one does."""
    words = [f"w{i}" for i in range(997)]
    clean = [[words[(i * 101 + j * (i + 3)) % len(words)] for j in range(300)] for i in range(30)]
    edited = [[f"edit{i}" if j in (60, 140, 220) else w for j, w in enumerate(clean[i])] for i in range(10)]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in clean + edited]
    linked = {(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert linked == {(i, 30 + i) for i in range(10)}
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s0", 0) for i, t in enumerate(clean + edited)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.stage_near_dedup(spark, docs, "").collect()) == [*range(30)]
