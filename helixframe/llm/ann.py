"""Nearest neighbours from randomly rotated one-bit codes.

Vectors are dealt to lists by the nearest of a few centroids. In a list each vector's residual is rotated at
random and kept as one bit a dimension, with two correction scalars: its length, and the inner product of the
code with the residual. A query meets the lists of its nearest centroids. There the bits and scalars give an
estimate of each distance and a bound of its error; only vectors whose lower bound does not lie beyond the
k-th smallest upper bound are reranked, exactly and in double precision, on the original vectors.

Centroids are fitted on at most `SAMPLE` vectors drawn by a hash of the id, and on them the number of lists that
a query meets is set: as many as hold a share of `RECALL` of the true neighbours of `TRIALS` of them. Every
vector is indexed. Lists are
cut into blocks of about `BLOCK` vectors and `QUERIES` queries, so a list that holds a third of all
vectors is many tasks' work. What meets in a task is a block of each; best lists are merged by rank.

Defined cases: vectors that are null, empty, zero, of another length than most of the sample, or hold null or
non-finite components take no part, as neither queries nor candidates; a row with the query's id is not its
neighbour; ties go to the smaller id; a query always meets lists that hold at least `LEAST` times k vectors, or
all lists; repeated rows are candidates each, and one query if their vectors are the same, else a query each under the
same query_id; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drawn, partitions, table, written

SAMPLE, MOST_LISTS, BLOCK, QUERIES, LEAST = 16384, 4096, 8192, 2048, 8
RECALL, TRIALS = 0.97, 256
#: Standard deviations of the error bound.
SURE = 3.0


@dataclass
class Index:
    centroids: np.ndarray  # lists x dimensions
    rotation: np.ndarray  # dimensions x dimensions, orthogonal
    probes: int

    @property
    def dimensions(self) -> int:
        return self.rotation.shape[0]


def whole(vector: Column) -> Column:
    """Whether a vector takes part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances to the centroids, up to a term of x alone."""
    return (centroids**2).sum(axis=1)[None, :] - 2 * (x @ centroids.T)


def fit(sample: np.ndarray, n: int, rounds: int = 8) -> Index:
    """Centroids by k-means over the sample; a random rotation."""
    rng = np.random.default_rng(11)
    lists = max(1, min(MOST_LISTS, len(sample) // 4, round(math.sqrt(n) / 8)))
    centroids = sample[rng.permutation(len(sample))[:lists]]
    for _ in range(rounds):
        own = np.concatenate([nearest(sample[i : i + 1024], centroids).argmin(axis=1) for i in range(0, len(sample), 1024)])
        sums, counts = np.zeros_like(centroids), np.bincount(own, minlength=lists)
        np.add.at(sums, own, sample)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], centroids)
    q, r = np.linalg.qr(rng.standard_normal((sample.shape[1], sample.shape[1])))
    return Index(centroids, q * np.sign(np.diag(r)), probes_for(sample, centroids, rng))


def probes_for(sample: np.ndarray, centroids: np.ndarray, rng: np.random.Generator, k: int = 10) -> int:
    """The lists that a query must meet to meet a share of RECALL of its k nearest, measured by brute force in the sample."""
    own = np.concatenate([nearest(sample[i : i + 1024], centroids).argmin(axis=1) for i in range(0, len(sample), 1024)])
    trials = rng.permutation(len(sample))[:TRIALS]
    place = np.argsort(np.argsort(nearest(sample[trials], centroids), axis=1, kind="stable"), axis=1)
    apart = (sample**2).sum(axis=1)[None, :] - 2 * (sample[trials] @ sample.T)
    apart[np.arange(len(trials)), trials] = np.inf
    near = np.argsort(apart, axis=1, kind="stable")[:, : max(1, min(k, len(sample) - 1))]
    return 1 + int(np.quantile(place[np.arange(len(trials))[:, None], own[near]], RECALL, method="higher"))


def build(vectors: DataFrame) -> Index | None:
    """vectors: id, v. None if there are none."""
    n = vectors.count()
    sample = vectors.where(drawn(F.col("id"), F.lit(min(1.0, SAMPLE / max(1, n))))).select("v").limit(SAMPLE)
    rows = [np.array(r[0], np.float64) for r in sample.toLocalIterator()] or [np.array(r[0], np.float64) for r in vectors.select("v").limit(SAMPLE).toLocalIterator()]
    if not rows:
        return None
    sizes = np.bincount([len(r) for r in rows])
    return fit(np.stack([r for r in rows if len(r) == sizes.argmax()]), n)


def rows_of_vectors(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as an array."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def codes(x: np.ndarray, centroid: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated residuals, their lengths, and the inner products of code and direction."""
    residual = (x - centroid) @ rotation.T
    length = np.linalg.norm(residual, axis=1)
    unit = residual / np.maximum(length, 1e-300)[:, None]
    return np.packbits(unit > 0, axis=1), length, np.abs(unit).sum(axis=1) / math.sqrt(x.shape[1])


def encode(vectors: DataFrame, index: Index) -> DataFrame:
    """A row a vector: its list, code and scalars."""

    def run(batches):
        for batch in batches:
            v = rows_of_vectors(batch.column("v"))
            own = nearest(v, index.centroids).argmin(axis=1)
            bits, length, inner = codes(v, index.centroids[own], index.rotation)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), batch.column("id"), batch.column("v"), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(length), pa.array(inner)],
                ["list", "id", "v", "code", "length", "inner"],
            )

    return vectors.mapInArrow(run, f"list int, id long, v {vectors.schema['v'].dataType.simpleString()}, code binary, length double, inner double")


def probe(queries: DataFrame, index: Index, held: np.ndarray, k: int) -> DataFrame:
    """A row a query and list that it meets."""

    def run(batches):
        for batch in batches:
            v = rows_of_vectors(batch.column("v"))
            order = np.argsort(nearest(v, index.centroids), axis=1, kind="stable")
            enough = np.cumsum(held[order], axis=1) < LEAST * (k + 1)
            count = np.maximum(index.probes, enough.sum(axis=1) + 1).clip(max=order.shape[1])
            at = np.repeat(np.arange(len(v)), count)
            lists = np.concatenate([o[:c] for o, c in zip(order, count)]) if len(v) else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *(batch.column(x).take(pa.array(at)) for x in ("id", "key", "v"))], ["list", "id", "key", "v"])

    return queries.mapInArrow(run, f"list int, id long, key long, v {queries.schema['v'].dataType.simpleString()}")


def best(distance: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, distance))[:k]


def search_block(q: pd.DataFrame, c: pd.DataFrame, index: Index, k: int) -> pd.DataFrame:
    """The k best candidates of a block for each of its queries."""
    names = ["query_id", "key", "vec_id", "score"]
    empty = pd.DataFrame({n: np.empty(0, np.float64 if n == "score" else np.int64) for n in names})
    if not len(q) or not len(c):
        return empty
    d, centroid = index.dimensions, index.centroids[int(c["list"].iloc[0])]
    ids, vectors, length = c["id"].to_numpy(), np.stack(c["v"].to_numpy()).astype(np.float64), c["length"].to_numpy()
    inner = np.maximum(c["inner"].to_numpy(), 1e-12)
    bits = np.unpackbits(np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c), -1), axis=1, count=d)
    signs = (2.0 * bits - 1).astype(np.float32) / np.float32(math.sqrt(d))
    queries = np.stack(q["v"].to_numpy()).astype(np.float64)
    turned = (queries - centroid) @ index.rotation.T
    far = np.linalg.norm(turned, axis=1)
    error = np.sqrt(np.maximum(0.0, 1 - inner**2)) / inner * SURE / math.sqrt(max(1, d - 1))
    out = []
    for lo in range(0, len(q), 256):
        span = slice(lo, lo + 256)
        product = (signs @ turned[span].T.astype(np.float32)).astype(np.float64) / inner[:, None]  # of residuals, but for the candidate's length
        middle = length[:, None] ** 2 + far[None, span] ** 2 - 2 * length[:, None] * product
        slack = 2 * (length * error)[:, None] * far[None, span] + 1e-6 * (1 + np.abs(middle))
        for i, (query, key) in enumerate(zip(q["id"].to_numpy()[span].tolist(), q["key"].to_numpy()[span].tolist())):
            other = ids != query
            upper = (middle[:, i] + slack[:, i])[other]
            limit = np.partition(upper, k - 1)[k - 1] if len(upper) > k else np.inf
            chosen = np.flatnonzero(other & (middle[:, i] - slack[:, i] <= limit))
            exact = np.sqrt(((vectors[chosen] - queries[lo + i]) ** 2).sum(axis=1))
            top = best(exact, ids[chosen], k)
            out.append((np.full(len(top), query), np.full(len(top), key), ids[chosen][top], exact[top]))
    return pd.DataFrame({n: np.concatenate([x[j] for x in out]) for j, n in enumerate(names)})


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that are found of each row for which is_query holds, a condition on `id`."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where(whole(F.col("v")) & F.col("id").isNotNull())
    index = build(clean)
    if index is None:
        return spark.createDataFrame([], schema)
    clean = clean.where(F.size("v") == index.dimensions)
    coded = written(encode(clean, index), "ann-codes")
    lists = len(index.centroids)
    held = np.zeros(lists, np.int64)
    for r in coded.groupBy("list").count().collect():  # a row a list, of which there are MOST_LISTS at most
        held[r[0]] = r[1]
    single = clean.where(is_query).dropDuplicates(["id", "v"]).withColumn("key", F.xxhash64("id", "v"))
    asked = written(probe(single, index, held, k), "ann-queries")
    sought = np.zeros(lists, np.int64)
    for r in asked.groupBy("list").count().collect():
        sought[r[0]] = r[1]
    cells, sets = (np.maximum(1, -(-x // size)) for x, size in ((held, BLOCK), (sought, QUERIES)))

    def by_list(values: np.ndarray) -> Column:
        return F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("list") + 1)

    own = F.pmod(F.xxhash64("id"), by_list(cells)).cast("int")
    to_sets = F.explode(F.sequence(F.lit(0), by_list(sets) - 1))
    c = coded.withColumn("block", own).withColumn("set", to_sets)
    q = asked.withColumn("set", F.pmod(F.xxhash64("id"), by_list(sets)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), by_list(cells) - 1)))
    key = ["list", "block", "set"]
    n = partitions(spark)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return search_block(a, b, index, k)

    found = q.repartition(n, *key).groupBy(*key).cogroup(c.repartition(n, *key).groupBy(*key)).applyInPandas(run, "query_id long, key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
