"""The near-duplicate stage of the pipeline: edited copies against brute force, and odd ids."""

import random

import pytest

import corpus_pipeline
from helixframe.llm import resemblance, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def grams(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def survivors(rows):
    """The least id of each component of pairs with a Jaccard similarity of 0.8 or more."""
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return set(least.values())


def edited(rng, words, edits):
    """Replaced words in mid-text, far from each other."""
    out, step = list(words), len(words) // (edits + 1)
    for k in range(edits):
        out[step * (k + 1)] = f"edit{rng.random()}"
    return out


@pytest.mark.parametrize("cell", [3, 512])
def test_edited_copies_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(resemblance, "CELL", cell)
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(500)]
    rows, texts = [], []
    for _ in range(40):
        texts.append(rng.choices(vocabulary, k=300))
    for t in texts[:15]:
        texts += [edited(rng, t, n) for n in (2, 4, 5, 9, 14)]
    chain = texts[20]
    for k in range(6):  # each a link of the next, the ends far apart
        chain = [*chain[:40 * k], *rng.choices(vocabulary, k=25), *chain[40 * k + 25 :]]
        texts.append(chain)
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    want = survivors(rows)
    assert len(want) < len(rows) - 40
    got = {r.doc_id for r in corpus_pipeline.stage_near_dedup(spark, docs, "").collect()}
    assert got == want
    assert len({r.component_id for r in simhash.simhash_groups(docs).collect()}) > len(want)  # three bits miss many


def test_a_failed_centre_does_not_hide_links():
    """Two pairs of near copies that lie apart, in one cell."""
    a, b = ([*range(k, k + 100)] for k in (0, 1000))
    sets = [resemblance.np.array(x, "u8") for x in (a, a[:95], b, b[:95])]
    found = resemblance.cell_links(resemblance.np.arange(4), resemblance.np.zeros(4, bool), sets)
    assert sorted(map(sorted, found)) == [[0, 1], [2, 3]]


def test_one_stays_whatever_its_ids_are(spark):
    base = " ".join(f"w{i}" for i in range(400))
    same, none = base.replace("w", "s"), base.replace("w", "n")
    rows = [(7, same), (7, same + " a"), (7, same + " b"), (None, none), (None, none + " a"), (None, base), (9, base + " a")]
    left = sorted((r.doc_id or -1, r.text) for r in simhash.near_dedup(frame(spark, rows)).collect())
    assert [i for i, _ in left] == [-1, 7, 9] and left[0][1].startswith(none) and left[2][1] == base + " a"
