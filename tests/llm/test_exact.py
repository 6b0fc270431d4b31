"""Deduplication, sharding and mixing: awkward inputs with defined results, and brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.llm import exact_dedup as D
from helixframe.llm import mixing as M
from helixframe.llm import shard_store as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem Ipsum " * 40_000


def docs(spark, texts, ids=None, source="s"):
    return spark.createDataFrame([(i, t, "en", source, 0) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


AWKWARD = [None, "", "Ab", "aB", "É", "é", LONG, LONG.upper(), " ab", "ab", None]


def test_exact_dedup_cases(spark):
    got = {r.doc_id: r for r in D.exact_dedup(docs(spark, AWKWARD)).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(AWKWARD):
        groups[lower(t)].append(i)
    for i, t in enumerate(AWKWARD):
        own = groups[lower(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(own), len(own), i == max(own))
        assert got[i].text_sha256 == hashlib.sha256(lower(t).encode()).hexdigest()


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = docs(spark, ["a", "a", "A", "b"], [1, 1, None, None]).withColumns({"kept": F.lit(1), "digest": F.lit("x"), "id": F.lit(2), "n": F.lit(3)})
    got = D.exact_dedup(rows).collect()
    assert len(got) == 4 and sum(r.kept for r in got if r.doc_id == 1) == 2
    left = D.deduplicate(rows)
    assert left.columns == rows.columns
    assert sorted((r.doc_id or -1, r.text) for r in left.collect()) == [(-1, "b"), (1, "a")]


def test_empty_table(spark):
    none = docs(spark, ["a"]).where("false")
    assert D.exact_dedup(none).count() == 0 and D.deduplicate(none).count() == 0
    assert M.mix(none).count() == 0


def test_index_persists_over_batches(spark):
    index = D.DigestIndex(spark, buckets=4)
    assert D.deduplicate(docs(spark, ["a", "b", "b"]), index=index).count() == 2
    assert [r.text for r in D.deduplicate(docs(spark, ["B", "c"], [10, 11]), index=index).collect()] == ["c"]
    assert index.read().count() == 3
    index.drop()


def test_small_batch_on_a_larger_index(spark):
    """Each of 1,500 held digests has over a thousandth of the batch's rows; the batch's rows must all be decided."""
    index = D.DigestIndex(spark, buckets=4)
    assert D.exact_dedup(docs(spark, [f"t{i}" for i in range(1500)]), index=index).count() == 1500
    ids = [*range(10_000, 10_500)]
    got = {r.doc_id: r for r in D.exact_dedup(docs(spark, [f"T{3 * i}" if i < 400 else f"new{i % 50}" for i in range(500)], ids), index=index).collect()}
    assert sorted(got) == ids
    for i in range(400):
        assert (got[10_000 + i].keep_id, got[10_000 + i].group_size, got[10_000 + i].kept) == (3 * i, 2, False)
    for i in range(400, 500):
        assert (got[10_000 + i].keep_id, got[10_000 + i].group_size, got[10_000 + i].kept) == (10_450 + i % 50, 2, i >= 450)
    assert index.read().count() == 1550
    index.drop()


@pytest.mark.parametrize("batch", [1, 100, 10_000])
def test_batches_after_a_restart(spark, tmp_path, batch):
    """5,000 texts are indexed; the session's catalog forgets the table, another index opens the path."""
    first = D.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    D.exact_dedup(docs(spark, [f"t{i}" for i in range(5000)]), index=first).count()
    spark.sql(f"DROP TABLE {first.name}")
    again = D.DigestIndex(spark.newSession(), str(tmp_path / "index"), buckets=7)
    assert again.buckets == 4 and again.read().count() == 5000
    ids = [*range(100_000, 100_000 + batch)]
    rows = [f"T{i % 6000}" for i in range(batch)]
    got = {r.doc_id: r for r in D.exact_dedup(docs(again.spark, rows, ids), index=again).collect()}
    assert sorted(got) == ids
    last, many = {t: i for i, t in zip(ids, rows)}, Counter(rows)
    for i, t in zip(ids, rows):
        old = int(t[1:]) < 5000
        keep = int(t[1:]) if old else last[t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, many[t] + old, i == keep)
    again.drop()
    assert not (tmp_path / "index").exists()


def test_draws_of_any_share(spark):
    """Of ids to the count of rows, about the share is drawn, and the threshold of one in 1e11 is not empty."""
    from helixframe.llm.common import drawn

    n = 200_000
    for share in (0.5, 0.01, 0.0):
        got = spark.range(n).where(drawn(F.col("id"), F.lit(share))).count()
        assert abs(got - share * n) <= 5 * (share * n) ** 0.5
    # As many hashes lie below the bound of 1e-11 as should, of all that there are.
    bound = spark.range(1).select((F.lit(1e-11) * F.lit(2.0**64) - F.lit(2.0**63)).alias("b")).first().b
    assert (bound + 2.0**63) / 2.0**64 == pytest.approx(1e-11, rel=1e-3)


def test_vacuum_leaves_what_may_be_committed(spark, tmp_path):
    store = T.ShardStore(spark, str(tmp_path / "s"))
    store.append(docs(spark, ["a"]))
    waiting = store._write(docs(spark, ["b"], [1]), 0)
    store.vacuum()
    now = store.manifest()
    store._commit(now, [*now["runs"], waiting])
    assert store.read().count() == 2
    store._write(docs(spark, ["c"], [2]), 0)
    store.vacuum(older=0)
    assert len(list((tmp_path / "s" / "runs").iterdir())) == 2 and store.read().count() == 2


def test_append_is_tried_again_after_a_lost_race(spark, tmp_path, monkeypatch):
    store, other = (T.ShardStore(spark, str(tmp_path / "s")) for _ in range(2))
    store.append(docs(spark, ["a"]))
    stale, real = store.manifest(), store.manifest
    other.append(docs(spark, ["b"], [1]))
    seen = []
    monkeypatch.setattr(store, "manifest", lambda *x: stale if not seen and not seen.append(1) else real(*x))
    store.append(docs(spark, ["c"], [2]))
    monkeypatch.undo()
    assert sorted(r.text for r in store.read().collect()) == ["a", "b", "c"]


def test_sharding_query_rows(spark, tmp_path):
    texts = [*AWKWARD, *("x" * i for i in range(300))]
    docs(spark, texts).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in T.op9_sharding(spark, str(tmp_path)).collect()}
    assert {i: got[i].n_bytes for i in got} == {i: len((t or "").encode()) for i, t in enumerate(texts)}
    places = defaultdict(set)
    for r in got.values():
        places[r.run].add(r.level)
    assert all(len(x) == 1 for x in places.values()) and max(r.level for r in got.values()) >= 1


def test_mixing_with_many_sources_and_odd_ids(spark, monkeypatch):
    """More sources than are broadcast; repeated and null ids stay or go together."""
    rows = [(i % 40 if i % 50 else None, "w " * (1 + i % 7), "en", f"s{i % 60}", 0) for i in range(600)]
    frame = spark.createDataFrame(rows, DOCS)
    want = sorted(map(repr, M.mix(frame).collect()))
    monkeypatch.setattr(M, "FEW_SOURCES", 3)
    assert sorted(map(repr, M.mix(frame).collect())) == want
    copies = defaultdict(set)
    for r, n in Counter(map(tuple, M.mix(frame).collect())).items():
        copies[(r[0], r[3])].add(n / Counter(rows)[r])
    assert all(len(x) == 1 for x in copies.values())


def test_hot_text(spark):
    n = 3000
    rows = docs(spark, ["hot" if i % 3 == 0 else f"t{i % 1500}" for i in range(n)])
    got = D.exact_dedup(rows)
    want = Counter("hot" if i % 3 == 0 else f"t{i % 1500}" for i in range(n))
    assert got.where("kept").count() == len(want)
    assert got.agg(F.max("group_size")).first()[0] == 1000


def test_store_compacts_and_keeps_every_row(spark, tmp_path):
    store = T.ShardStore(spark, str(tmp_path / "s"), target=1 << 30)
    rows = docs(spark, [*AWKWARD, *map(str, range(200))])
    levels = []
    for k in range(9):
        store.append(rows.where(F.col("doc_id") % 9 == k))
        levels.append(sorted(r["level"] for r in store.compact()["runs"]))
    assert max(map(len, levels)) < 9 and max(map(max, levels)) >= 1
    assert sorted(map(repr, store.read().collect())) == sorted(map(repr, rows.collect()))
    store.vacuum()
    assert sorted(map(repr, store.read().collect())) == sorted(map(repr, rows.collect()))
    before = store.manifest()
    assert store.append(rows.where("false")) == before


def test_full_runs_are_left_alone(spark, tmp_path):
    store = T.ShardStore(spark, str(tmp_path / "s"), target=1)
    for k in range(5):
        store.append(docs(spark, [f"a{k}"], [k]))
    assert len(store.compact()["runs"]) == 5


def test_versions_do_not_overwrite_and_older_ones_stay_readable(spark, tmp_path):
    store = T.ShardStore(spark, str(tmp_path / "s"))
    first = store.append(docs(spark, ["a"]))
    store.append(docs(spark, ["b"], [1]))
    assert store.read(1).count() == 1 and store.read().count() == 2
    with pytest.raises(Exception, match="exist"):
        store._commit(first, [])
    assert store.read().count() == 2


def test_arrivals_hold_null_ids(spark, tmp_path):
    rows = docs(spark, ["a", "b", "c", "d"], [None, 5, 7, None])
    assert T.store_in_arrivals(rows, str(tmp_path / "s")).placed(["doc_id"]).count() == 4
    assert T.store_in_arrivals(rows.where("false"), str(tmp_path / "e")).read() is None


def brute_mix(rows, repetitions):
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    top = max(tokens.values())
    real = {s: n for s, n in tokens.items() if n}
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if max((n / top) ** (mid - 1) for n in real.values()) <= repetitions else (mid, hi)
    return {s: (n / top) ** (hi - 1) if n else 1.0 for s, n in tokens.items()}


def test_mixing_keeps_to_the_limit_and_budget(spark):
    rng = random.Random(1)
    sizes = {"a": 600, "b": 120, "c": 40, None: 15, "empty": 3}
    rows = [(i, None if s == "empty" else "w " * rng.randint(1, 30), s) for i, s in enumerate([s for s, n in sizes.items() for _ in range(n)])]
    frame = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS).withColumns({"tokens": F.lit(1), "block": F.lit(2), "share": F.lit(3)})
    epochs = brute_mix(rows, 2.0)
    mixed = M.mix(frame)
    assert mixed.columns == frame.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    for s in sizes:
        own = [(i, len((t or "").split())) for i, t, x in rows if x == s]
        total, read = sum(n for _, n in own), sum(copies[i] * n for i, n in own)
        assert {copies[i] for i, _ in own} <= {int(epochs[s] + 1e-9), int(epochs[s] + 1e-9) + 1}
        assert total * epochs[s] - 31 <= read <= total * epochs[s] + 1e-6
        assert min(copies[i] for i, _ in own) >= 1


def test_mixing_by_entropy_and_single_source(spark):
    frame = docs(spark, ["a b c", "d"], source="x")
    assert M.mix(frame).count() == 2
    two = docs(spark, ["a b c d e f g h"] * 8, source="x").unionByName(docs(spark, ["a"] * 8, [*range(8, 16)], source="y"))
    p = M.plan(two, entropy=0.6)
    shares = [r.weight for r in p.collect()]
    assert sum(shares) == pytest.approx(1)
    import math

    assert -sum(w * math.log(w) for w in shares) == pytest.approx(0.6, abs=1e-3)
