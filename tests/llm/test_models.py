"""SimHash, nearest neighbours, language and toxicity: brute force, recall and held-out accuracy."""

import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helixframe.llm import ann, language_id, simhash, toxicity

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def slow_components(f):
    root = list(range(len(f)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(f)):
        for j in range(i + 1, len(f)):
            if (f[i] ^ f[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def test_fingerprints():
    for text in ("", " \t\n", "one", "one two", "A b C d", "É é É", "x " * 300, "a\x0bb\x1cc d", None):
        assert simhash.fingerprint(text or "") == slow_fingerprint(text)


@pytest.mark.parametrize("cell", [16, 1024])
def test_components_equal_brute_force(spark, monkeypatch, cell):
    """Balls of fingerprints around centres, chains and loners; small cells force cuts below the first level."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(cell)
    f = {0}
    for _ in range(3):
        centre = rng.getrandbits(64)
        f |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(22)}
    at = rng.getrandbits(64)
    for i in range(20):
        at ^= 0b111 << 3 * i
        f.add(at)
    f |= {rng.getrandbits(64) for _ in range(60)}
    f = sorted(f)
    edges = simhash.links(spark.createDataFrame([(simhash.signed(x),) for x in f], "f long"))
    roots = {r.f: r.root for r in simhash.components(edges).collect()}
    got = [roots.get(simhash.signed(x), simhash.signed(x)) for x in f]
    want = slow_components(f)
    pairs = {}
    for a, b in zip(got, want):
        assert pairs.setdefault(a, b) == b
    assert len(set(got)) == len(set(want))


def test_simhash_cases(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [(5, base), (3, base + " end"), (9, base), (1, None), (2, ""), (4, "other words here"), (4, "other words here"), (None, base), (None, "alone without id")]
    frame = spark.createDataFrame([(i, t, "en", "s") for i, t in texts], DOCS).withColumns({"f": F.lit(1), "h": F.lit(2), "n": F.lit(3), "root": F.lit(4)})
    got = simhash.simhash_groups(frame).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].component_id == by[2].component_id == 1 and by[1].fingerprint == "0" * 16
    f = {i: slow_fingerprint(t) for i, t in texts if i is not None}
    near = (f[5] ^ f[3]).bit_count() <= 3
    assert (by[5].component_id, by[9].component_id) == ((3, 3) if near else (5, 5))
    assert sorted(r.component_id or -1 for r in got if r.doc_id is None) == sorted([by[5].component_id, -1])
    left = simhash.near_dedup(frame)
    assert left.columns == frame.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted([-1, 1, 4, 4] + ([3] if near else [3, 5]))
    assert simhash.simhash_groups(frame.where("false")).count() == 0 and simhash.near_dedup(frame.where("false")).count() == 0


def slow_search(rows, queries, k):
    out = {}
    for q in queries:
        own = np.array(rows[q])
        near = sorted((float(np.sqrt(((np.array(v) - own) ** 2).sum())), i) for i, v in rows.items() if i != q)
        out[q] = near[:k]
    return out


def test_nearest_neighbours_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = {i: rng.standard_normal(16).astype(np.float32).astype(float).tolist() for i in range(600)}
    rows.update({i: rows[7] for i in range(600, 620)})
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [float("inf")] + [1.0] * 15), (1100, [None] + [1.0] * 15)]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in [*rows.items(), *odd]], "vec_id long, embedding array<double>, list string")
    got = ann.search(frame, F.col("id") % 100 == 0).collect()
    want = slow_search(rows, [i for i in rows if i % 100 == 0], 10)
    hit = 0
    for q, near in want.items():
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11))
        exact = {i: d for d, i in slow_search(rows, [q], 10**6)[q]}
        assert all(s == pytest.approx(exact[i], abs=1e-12) for _, i, s in own)
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        hit += len({i for _, i, _ in own} & {i for _, i in near})
    assert {r.query_id for r in got} == set(want)
    assert hit >= 0.9 * 10 * len(want)
    assert ann.search(frame.where("false"), F.col("id") % 100 == 0).count() == 0
    few = ann.search(frame.where("vec_id <= 4"), F.col("id") % 100 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]


def test_error_bound_chooses_few_but_the_right_ones(monkeypatch):
    """Of one list the bound leaves the nearest, and far fewer than all where near ones stand out."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 128))
    x[:40] = x[0] + 0.1 * rng.standard_normal((40, 128))
    index = ann.Index(np.zeros((1, 128)), ann.fit(x, len(x)).rotation, 1)
    bits, length, inner = ann.codes(x, index.centroids[0], index.rotation)
    assert bits.shape == (2000, 16) and (inner > 0.7).all()
    assert np.allclose(np.linalg.norm(x - index.centroids[0], axis=1), length)
    cell = ann.pd.DataFrame({"list": 0, "id": np.arange(2000), "v": list(x), "code": [b.tobytes() for b in bits], "length": length, "inner": inner})
    asked = ann.pd.DataFrame({"list": 0, "id": np.arange(30), "key": np.arange(30), "v": list(x[:30])})
    reranked, best = [], ann.best
    monkeypatch.setattr(ann, "best", lambda d, ids, k: reranked.append(len(d)) or best(d, ids, k))
    got = ann.search_block(asked, cell, index, 10)
    for q in range(30):
        far = np.linalg.norm(x - x[q], axis=1)
        far[q] = np.inf
        assert got[got.query_id == q].vec_id.tolist() == np.argsort(far)[:10].tolist()
    assert max(reranked) < 500


def test_repeated_query_rows(spark):
    """A query row that is there twice is one query; equal ids with other vectors are a query each."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(200)]
    twice = spark.createDataFrame([*rows, rows[0], rows[100], (100, rng.standard_normal(8).tolist())], "vec_id long, embedding array<double>")
    got = ann.search(twice, F.col("id") % 100 == 0).collect()
    want = slow_search(dict(rows), [0], 10)[0]
    own = sorted((r.rank, r.vec_id) for r in got if r.query_id == 0)
    assert [r for r, _ in own] == list(range(1, 11))
    assert len({i for _, i in own if i != 100} & {i for _, i in want if i != 100}) >= 8
    assert sorted(r.rank for r in got if r.query_id == 100) == sorted([*range(1, 11)] * 2)


def slow_margins(model, text):
    """Language and score by plain loops over the bytes."""
    raw = f" {re.sub(r'[^a-zA-ZÀ-ɏͰ-ϿЀ-ӿ]+', ' ', text.lower()).strip()} ".encode()
    counts = {}
    for size in (1, 2, 3, 4):
        for i in range(len(raw) - size + 1):
            code = 0
            for b in raw[i : i + size]:
                code = (code * 257 + b) % 2**32
            k = ((code * 2654435761 + size) % 2**32 >> 19) % language_id.FEATURES
            counts[k] = counts.get(k, 0) + 1
    total = sum(counts.values())
    margins = [float(w[-1]) + sum(float(w[k]) * (c / total) ** 0.5 for k, c in counts.items()) for w in model.weights]
    sure = [1 / (1 + np.exp(-2 * m)) for m in margins]
    families = max(model.family) + 1
    best = max(range(families), key=lambda f: (margins[f], -f))
    own = [i for i, f in enumerate(model.family) if f == best]
    votes = dict.fromkeys(own, 0.0)
    for (a, b), p in zip(model.pairs, sure[families:]):
        if a in votes:
            votes[a], votes[b] = votes[a] + p, votes[b] + 1 - p
    top = max(own, key=lambda i: (votes[i], -i))
    return model.languages[top], (sure[best] if families > 1 else 1.0) * (votes[top] / (len(own) - 1) if len(own) > 1 else 1.0)


@tables
def test_languages_equal_plain_loops(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.train(docs)
    some = docs.where("doc_id < 60").unionByName(docs.where("doc_id < 5"))
    got = language_id.predict(some, model).collect()
    assert len(got) >= 60
    for r in got:
        if language_id.has_letter(r.text or ""):
            lang, score = slow_margins(model, r.text)
            assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-6)
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


@tables
def test_severity_equals_plain_loops(spark):
    import math
    import zlib

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(docs, labels)
    long = spark.createDataFrame([(-1, "word " * 200_000)], "doc_id long, text string")
    some = docs.where("doc_id < 80").select("doc_id", "text").unionByName(docs.where("doc_id < 5").select("doc_id", "text")).unionByName(long)
    texts = {r.doc_id: r.text for r in some.collect()}
    for r in toxicity.severity(some, model).collect():
        words = re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower())
        counts = {}
        for w in words:
            for x in [w, *(f"{w[:n]}\x00" for n in (4, 5, 6) if len(w) >= n)]:
                k = zlib.crc32(x.encode()) % 2**20
                counts[k] = counts.get(k, 0) + 1
        z = sum(float(model.weights[model.number[k]]) * math.log1p(c) for k, c in counts.items() if k in model.number)
        above = [1 - 1 / (1 + math.exp(-(float(t) - z))) for t in model.thresholds] if words else [0.0]
        assert r.severity == pytest.approx(sum(above), abs=1e-9) and r.p_toxic == pytest.approx(above[0], abs=1e-9)


@tables
def test_recall_on_the_tables(spark):
    frame = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = {r.vec_id: [float(v) for v in r.embedding] for r in frame.collect()}
    want, got = slow_search(rows, [i for i in rows if i % 50 == 0], 10), {}
    for r in ann.search(frame, F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for _, i in near}) / 10 for q, near in want.items()]) >= 0.9


@tables
def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count()
    again = language_id.identify(docs.withColumns({"source": F.lit(None).cast("string"), "lang": F.when(language_id.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang"))}))
    assert again.exceptAll(language_id.identify(docs)).count() == 0


def test_language_cases(spark):
    rows = [(i, t, k, "s") for i, (t, k) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("el gato y el perro", "es"), ("anything", "xx")] * 12)]
    odd = [(900, None, None, "s"), (901, "", "en", "s"), (902, "123 !? ²", "en", "s"), (None, "the dog", "en", "s"), (904, "the cat " * 60_000, "en", "s")]
    frame = spark.createDataFrame(rows + odd, DOCS).withColumns({"row": F.lit(1), "score": F.lit("clash"), "label": F.lit(0)})
    got = {r.doc_id: r for r in language_id.identify(frame).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0.0 for i in (900, 901, 902))
    assert got[904].lang_pred == "en" and got[None].lang_pred == "en" and got[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].lang_pred == k for i, _, k, _ in rows]) > 0.95
    left = language_id.keep_identified(frame)
    assert left.columns == frame.columns and left.count() == len(rows) + 2
    assert {r.lang_pred for r in language_id.identify(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(frame.where("false")).count() == 0
    assert {r.lang_pred for r in language_id.identify(frame.withColumn("lang", F.lit("en"))).collect()} == {"en", "und"}


def test_runs_of_a_long_text_count_each_ngram_once(monkeypatch):
    text = "abcdefghij" * 50
    whole = np.sort(np.concatenate(list(language_id.buckets_of(text))))
    monkeypatch.setattr(language_id, "RUN", 37)
    assert (np.sort(np.concatenate(list(language_id.buckets_of(text)))) == whole).all()


@tables
def test_toxicity_held_out(spark):
    """Labelled rows of the larger tables would do better; here 200 rows teach, and the words of the others must be found."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    found = toxicity.severity(docs, model).join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").where("doc_id % 2 = 1")
    assert found.where("toxic AND label = 0").count() <= 0.03 * found.where("label = 0").count()
    assert found.where("toxic AND label = 1").count() >= 0.5 * found.where("label = 1").count()
    n = docs.count()
    assert toxicity.severity(docs, model).where("severity >= 0 AND severity <= 3 AND p_toxic BETWEEN 0 AND 1").count() == n


def test_toxicity_learns_ordered_grades(spark):
    rng = random.Random(0)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = rng.choices(words, k=60) + (["vile", "rotten", "nasty"] * rng.randint(1, 6) if bad else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 0, int(bad)))
    frame = spark.createDataFrame([*rows, (900, None, "en", "s"), (901, "123", "en", "s")], DOCS).withColumns({"severity": F.lit(0), "toxic": F.lit("clash")})
    marks = spark.createDataFrame([*labels, (5000, 0, 1), (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame, marks)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    got = {r.doc_id: r for r in toxicity.severity(frame, model).collect()}
    assert np.mean([got[i].toxic == bool(t) for i, _, t in labels]) > 0.98
    assert got[900].severity == got[901].severity == 0.0 and not got[900].toxic
    fresh = spark.createDataFrame([(1, " ".join(words[:60]), "en", "s"), (2, " ".join(words[:60]) + " vile rotten nasty", "en", "s"), (3, " ".join(words[:60]) + " vile rotten nasty" * 6, "en", "s")], DOCS)
    s = [r.severity for r in toxicity.severity(fresh, model).orderBy("doc_id").collect()]
    assert s[0] < 0.5 < s[1] < s[2]
    assert {r.severity for r in toxicity.severity(frame, toxicity.train(frame, marks.where("toxic = 0"))).collect()} == {0.0}
    assert toxicity.severity(frame.where("false"), model).count() == 0
