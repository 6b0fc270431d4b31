"""Language identification in two steps: the family first, then the language within it.

Texts become relative frequencies of hashed letter n-grams. A linear support vector machine for each family
against the others picks the family; within it, machines for each pair of languages vote. Families follow a
table of language codes; a language that the table lacks joins the family whose texts are nearest.

The model is fitted on a bounded sample of labelled rows: at most `SAMPLE` of them, drawn by a hash of the id
in equal numbers from each language; of more than `SAMPLE` / `EACH` languages the most frequent are learnt, others never
predicted. Everything else runs over all rows and whole texts.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any labelled row to learn
from every row is `und`; with one language every text with a letter gets it. Rows with a null id are never
learnt from and count as not held out. Repeated rows get equal results. Other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, released, rows_of, table, texts

UNKNOWN = "und"
#: Rows that the model is fitted on at most, features, bytes of text hashed at a time, and documents taken from a batch at a time.
SAMPLE, FEATURES, RUN, DOCS = 3000, 1 << 12, 1 << 20, 512
#: The fewest rows of the sample that a language is learnt from, where it has as many.
EACH = 8
SIZES = (1, 2, 3, 4)
GAPS = re.compile(r"[\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")
#: ISO 639 codes by family. Fixed values.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af yi fy lb",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr sl",
    "indic": "hi bn mr gu pa ur ne si",
    "semitic": "ar he am mt",
    "turkic": "tr az kk uz tt",
    "uralic": "fi et hu",
    "sinitic": "zh yue wuu",
    "japonic": "ja",
    "koreanic": "ko",
}


def has_letter(text: str) -> bool:
    return any(x.group().isalpha() for x in LETTER.finditer(text))


def buckets_of(text: str):
    """The hashed n-grams of a whole text, in runs."""
    raw = np.frombuffer(f" {GAPS.sub(' ', text.lower()).strip()} ".encode(), np.uint8)
    for at in range(0, len(raw), RUN):
        part = raw[max(0, at - SIZES[-1] + 1) : at + RUN].astype(np.uint32)
        code = np.zeros(len(part), np.uint32)
        for size in range(1, SIZES[-1] + 1):
            code = code[: len(part) - size + 1] * np.uint32(257) + part[size - 1 :]
            new = code[max(0, SIZES[-1] - size) :] if at else code  # what the run before has not seen
            if size in SIZES:
                yield (new * np.uint32(2654435761) + np.uint32(size) >> np.uint32(19)).astype(np.int64) % FEATURES


def features(text: str) -> np.ndarray:
    """Square roots of the n-grams' shares: a vector of length 1."""
    total = np.zeros(FEATURES)
    for x in buckets_of(text):
        total += np.bincount(x, minlength=FEATURES)
    return np.sqrt(total / max(1.0, total.sum()))


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine with squared hinge loss, by dual
    coordinate descent; classes weigh alike."""
    w, alpha = np.zeros(x.shape[1] + 1), np.zeros(len(x))
    share = {s: cost * len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}
    slack = np.array([0.5 / share[int(s)] for s in y])
    order, rng = np.arange(len(x)), np.random.default_rng(7)
    norms = np.einsum("ij,ij->i", x, x) + 1 + slack
    for _ in range(rounds):
        rng.shuffle(order)
        for i in order:
            slope = y[i] * (x[i] @ w[:-1] + w[-1]) - 1 + slack[i] * alpha[i]
            new = max(0.0, alpha[i] - slope / norms[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[:-1] += step * x[i]
                w[-1] += step
                alpha[i] = new
    return w


@dataclass
class LanguageModel:
    languages: list[str]
    family: list[int]  # of each language
    pairs: list[tuple[int, int]]  # languages of one family that a machine separates
    weights: np.ndarray  # families' machines, then the pairs'; the last column is the bias

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        count = max(self.family) + 1
        margins = self.weights[:, :-1] @ features(text) + self.weights[:, -1]
        sure = 1 / (1 + np.exp(-2 * margins))
        best = int(np.argmax(margins[:count]))
        score = float(sure[best]) if count > 1 else 1.0
        within = [i for i, f in enumerate(self.family) if f == best]
        votes = {i: 0.0 for i in within}
        for (a, b), p in zip(self.pairs, sure[count:].tolist()):
            if self.family[a] == best:
                votes[a] += p
                votes[b] += 1 - p
        top = max(within, key=lambda i: (votes[i], -i))
        return self.languages[top], score * (votes[top] / (len(within) - 1) if len(within) > 1 else 1.0)


def fit(rows: list[tuple[str, np.ndarray]]) -> LanguageModel:
    """rows: language and features; emptied on the way, to hold them once."""
    languages = sorted({x for x, _ in rows})
    if not languages:
        return LanguageModel([], [], [], np.zeros((0, FEATURES + 1)))
    rows.sort(key=lambda r: (r[0], zlib.crc32(r[1])))
    label = np.array([languages.index(k) for k, _ in rows])
    x = np.empty((len(rows), FEATURES), np.float32)
    for i, (_, v) in enumerate(rows):
        x[i] = v
    rows.clear()
    known = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
    names = [known.get(re.split("[-_]", k.lower())[0]) for k in languages]
    centre = np.stack([x[label == i].mean(axis=0) for i in range(len(languages))])
    for i, name in enumerate(names):
        if name is None:
            settled = [j for j, n in enumerate(names) if n and j != i]
            near = max(settled, key=lambda j: centre[i] @ centre[j]) if settled else None
            names[i] = names[near] if near is not None else f"family of {languages[i]}"
    order = list(dict.fromkeys(names))
    family = [order.index(n) for n in names]
    side = np.array(family)[label]
    machines = [fit_svm(x, np.where(side == f, 1, -1)) if len(order) > 1 else np.zeros(FEATURES + 1) for f in range(len(order))]
    pairs = [(a, b) for a in range(len(languages)) for b in range(a + 1, len(languages)) if family[a] == family[b]]
    for a, b in pairs:
        own = (label == a) | (label == b)
        machines.append(fit_svm(x[own], np.where(label[own] == a, 1, -1)))
    return LanguageModel(languages, family, pairs, np.stack(machines).astype(np.float32))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", most: int = SAMPLE) -> LanguageModel:
    """Fits on at most `most` rows (twice that in a draw gone wide) that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    rows = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    # A row a language, and at most as many languages as rows that may be learnt from.
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most // EACH).collect()}
    if not counts:
        return fit([])
    each = most / len(counts)
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, each / n))])
    sample = rows.where(drawn(F.col("id"), F.coalesce(share[F.col("label")], F.lit(0.0))))

    def run(batches):
        for batch in rows_of(batches, 64):
            own = [(k, features(t).astype(np.float16).tobytes()) for k, t in zip(batch.column("label").to_pylist(), texts(batch, "text")) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.string()), pa.array([v for _, v in own], pa.binary())], ["label", "x"])

    sample = sample.select("label", "text").mapInArrow(run, "label string, x binary").limit(2 * most)
    return fit([(r[0], np.frombuffer(r[1], np.float16)) for r in sample.toLocalIterator()])


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep, then lang_pred and score, in Arrow batches. Only the text decides."""
    keep = docs.columns if keep is None else keep
    source = docs.select(*[F.col(f"`{x}`").alias(f"c{i}") for i, x in enumerate(keep)], *([] if text_col in keep else [F.col(f"`{text_col}`").alias("text")]))
    text = f"c{keep.index(text_col)}" if text_col in keep else "text"
    kinds = ", ".join(f"c{i} {source.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches):
        for batch in rows_of(batches, DOCS):
            out = [model.predict(x) for x in texts(batch, text)]
            found = [pa.array([x for x, _ in out], pa.string()), pa.array([float(x) for _, x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"c{i}") for i in range(len(keep))), *found], [*(f"c{i}" for i in range(len(keep))), "lang_pred", "score"])

    return source.mapInArrow(released(run), f"{kinds}, lang_pred string, score double").toDF(*keep, "lang_pred", "score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """A row a document: id_col, held_out, lang_pred, score."""
    found = predict(docs, train(docs, id_col, text_col, label_col), text_col, [id_col])
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", least: float = 0.0) -> DataFrame:
    """The documents, with all their columns, in which a language is found with a score above `least`."""
    names = docs.columns
    own = predict(docs, train(docs, id_col, text_col, label_col), text_col).toDF(*names, "__hx_lang", "__hx_score")
    return own.where((F.col("__hx_lang") != UNKNOWN) & (F.col("__hx_score") > least)).drop("__hx_lang", "__hx_score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
