"""Toxicity as an expected severity, by cumulative-link ordinal regression on sparse text features.

Features are logarithms of counts of a text's words and of the words' beginnings of `HEADS` letters, hashed. One
vector of weights serves all grades; ordered thresholds turn its product into the chance of each grade:
P(grade <= k) = s(threshold_k - w x). The result is the expected grade.

Labels say toxic or not. Grades of the toxic rows that are learnt from are 1 to `GRADES` - 1: by how often their
text holds features that mark toxic rows (a rate at least `MARK` times that of the others), cut at the
terciles. The model is fitted on a bounded sample of labelled rows, at most `SAMPLE`, drawn by a hash of the id in equal
numbers from both labels and weighted back; every row is then scored on its whole text.

Defined cases: a null text counts as empty; a text without a word, and every text if the labels lack one of the
two kinds, has severity 0 and is not toxic; null labels are not learnt from; of repeated labels of an id each is a row;
repeated rows get equal results; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, drawn, rows_of, table, texts, written

WORD = re.compile(r"[^\W\d_]+")
HEADS = (4, 5, 6)
SAMPLE, BITS, MARK, GRADES, MEMO_WORDS, LONGEST = 5000, 20, 8.0, 4, 400_000, 64
#: Features kept: one to two rows, within these bounds.
CHOSEN = 300, 1000


def keys_of(word: str) -> list[int]:
    """The hashed features of a word: itself and its beginnings."""
    own = [word, *(f"{word[:n]}\x00" for n in HEADS if len(word) >= n)]
    return [zlib.crc32(x.encode()) & (1 << BITS) - 1 for x in own]


def counts_of(text: str, keys) -> Counter:
    out: Counter = Counter()
    for word, c in Counter(WORD.findall(text.lower())).items():
        for k in keys(word):
            out[k] += c
    return out


@dataclass
class Severity:
    number: dict[int, int] = field(default_factory=dict)  # of a hashed feature
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        self.memo = Memo(MEMO_WORDS, LONGEST)

    def __reduce__(self):
        return Severity, (self.number, self.weights, self.thresholds)

    def known(self, word: str) -> tuple[int, ...]:
        found = self.memo[word]
        if found is None:
            found = self.memo.keep(word, tuple(self.number[k] for k in keys_of(word) if k in self.number))
        return found

    def predict(self, text: str) -> tuple[float, int, float]:
        """Expected severity, likeliest grade, chance of any grade above 0."""
        if not len(self.thresholds):
            return 0.0, 0, 0.0
        words = WORD.findall(text.lower())
        if not words:
            return 0.0, 0, 0.0
        sums: dict[int, int] = {}
        for word, c in Counter(words).items():
            for i in self.known(word):
                sums[i] = sums.get(i, 0) + c
        at = np.fromiter(sums.keys(), np.int64, len(sums))
        z = float(self.weights[at] @ np.log1p(np.fromiter(sums.values(), np.float64, len(sums)))) if len(at) else 0.0
        above = 1 - 1 / (1 + np.exp(-np.clip(self.thresholds - z, -40, 40)))  # chances of a grade above k
        grades = -np.diff(np.concatenate([[1.0], above, [0.0]]))
        return float(above.sum()), int(grades.argmax()), float(above[0])


def fit_ordinal(at: np.ndarray, row: np.ndarray, value: np.ndarray, grade: np.ndarray, weight: np.ndarray, features: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient steps with momentum (Adam) on the weighted likelihood with a small
    square penalty. Thresholds are a first one and the exponentials of steps, so they stay ordered."""
    n, cuts = len(grade), int(grade.max())
    w, t = np.zeros(features), np.concatenate([[2.0], np.zeros(cuts - 1)])
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, t)]
    weight = weight / weight.sum()
    s = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, rounds + 1):
        z = np.bincount(row, w[at] * value, n)
        cut = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        hi, lo = s(edge[grade + 1] - z), s(edge[grade] - z)
        chance = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / chance * weight, lo * (1 - lo) / chance * weight
        gw = np.bincount(at, (dhi - dlo)[row] * value, features) + 2e-5 * w
        gc = np.array([dlo[grade == k + 1].sum() - dhi[grade == k].sum() for k in range(cuts)])
        gt = np.concatenate([[gc.sum()], [gc[k:].sum() * np.exp(t[k]) for k in range(1, cuts)]])
        for x, g, (m, v) in zip((w, t), (gw, gt), moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    return w, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))


def features_of(rows: DataFrame, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """rows: toxic, keys. The hashed features that the model keeps, those that tell the two kinds apart best, and those
    that mark toxic rows. Counted by the cluster; at most CHOSEN and 2 ** BITS keys reach the driver."""
    each = rows.select("toxic", F.explode("keys").alias("key")).groupBy("key").agg(F.sum("toxic").cast("double").alias("bad"), F.sum(1 - F.col("toxic")).cast("double").alias("good"))
    bad, good, share = F.col("bad"), F.col("good"), (F.col("bad") + F.col("good")) / (n1 + n0)
    z = F.abs(bad / n1 - good / n0) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    rate = (bad + 0.5) / n1 / ((good + 0.5) / n0)
    each = written(each.where("bad + good >= 3").select("key", z.alias("z"), ((rate >= MARK) & (bad >= 3)).alias("mark")), "toxicity-features")
    most = min(CHOSEN[1], max(CHOSEN[0], (n1 + n0) // 2))
    chosen = [r[0] for r in each.orderBy(F.desc("z"), "key").limit(most).collect()]
    return np.array(chosen, np.int64), np.array([r[0] for r in each.where("mark").select("key").toLocalIterator()], np.int64)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray, int]], chosen: np.ndarray, prior: float) -> Severity:
    """rows: toxic 0 or 1, places of kept features, their counts, and how often the text holds marks. chosen: the features'
    keys. prior: the share of toxic rows among all labelled ones."""
    toxic, marks = np.array([r[0] for r in rows]), np.array([r[3] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    at, count = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]).astype(float)
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    cuts = np.quantile(marks[toxic == 1], [k / (GRADES - 1) for k in range(1, GRADES - 1)])
    grade = np.where(toxic == 1, 1 + (marks[:, None] > cuts[None, :]).sum(axis=1), 0)
    grade = np.searchsorted(np.unique(grade), grade)  # without grades that no row has
    weight = np.where(toxic == 1, prior / n1, (1 - prior) / n0)
    w, t = fit_ordinal(at, row, np.log1p(count), grade, weight, len(chosen))
    return Severity({int(k): i for i, k in enumerate(chosen)}, w, t)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE) -> Severity:
    """Fits on at most `most` labelled rows (twice that in a draw gone wide)."""
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull())
    counts = {r[0]: r[1] for r in named.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return Severity()
    share = {k: min(1.0, most / 2 / n) for k, n in counts.items()}
    sample = named.where(drawn(F.col("id"), F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))).limit(2 * most)  # bounded, so it may be broadcast

    def count(batches):
        for batch in rows_of(batches, 64):
            own = [sorted(counts_of(x, keys_of).items()) for x in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array([[x[k] for x in r] for r in own], pa.list_(pa.int32())) for k in (0, 1))], ["toxic", "keys", "counts"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("toxic", "text")
    rows = written(rows.mapInArrow(count, "toxic int, keys array<int>, counts array<int>").limit(2 * most), "toxicity-sample")
    size = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return Severity()
    chosen, marks = features_of(rows, size[1], size[0])
    place, mark = np.full(1 << BITS, -1, np.int32), np.zeros(1 << BITS, bool)
    place[chosen], mark[marks] = np.arange(len(chosen)), True

    def keep(batches):
        for batch in rows_of(batches, 64):
            out = []
            for keys, many in zip(*(batch.column(k).to_pylist() for k in ("keys", "counts"))):
                keys, many = np.array(keys, np.int64), np.array(many, np.int64)
                own = place[keys] >= 0
                out.append((place[keys[own]].tobytes(), many[own].astype(np.int32).tobytes(), int(many[mark[keys]].sum())))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int64())], ["toxic", "at", "counts", "marks"])

    kept = rows.mapInArrow(keep, "toxic int, at binary, counts binary, marks long")
    found = [(r[0], np.frombuffer(r[1], "<i4"), np.frombuffer(r[2], "<i4"), r[3]) for r in kept.toLocalIterator()]
    found.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    return fit(found, chosen, counts[1] / (counts[0] + counts[1]))


def severity(docs: DataFrame, model: Severity, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """A row a document: id_col, severity (expected grade), grade (the likeliest), p_toxic, toxic (p_toxic >= least)."""

    def run(batches):
        for batch in rows_of(batches, 512):
            out = [model.predict(x) for x in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.float64(), pa.int32(), pa.float64())))], ["id", "severity", "grade", "p_toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    done = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, severity double, grade int, p_toxic double")
    return done.select(F.col("id").alias(id_col), "severity", "grade", "p_toxic", (F.col("p_toxic") >= least).alias("toxic"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, train(docs, table(spark, sf_dir, "labels")))
