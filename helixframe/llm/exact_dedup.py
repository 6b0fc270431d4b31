"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, in a folder that later sessions open again. A batch of documents is reduced to one row a digest
(map-side first, so a text that fills a third of the corpus costs a few rows a task), sort-merge joined
to the index, and what is new is appended; for a digest that the index holds, the rows that the batch adds are
appended as a count, and reading adds the counts up. Decisions are read from the index afterwards, for the digests
of the batch alone. All of it is DataFrame work: no Python runs on executors.

Defined cases: a null text counts as empty; texts are equal when identical after lower-casing A-Z only. Of
equal texts the row with the largest id stays, unless an earlier batch already holds the text; a group's size is
that of all batches so far. Rows whose id is null stay only if no row of the text has an id. An empty batch leaves the index as it is. Rows that repeat
both id and text are one document: `decide` marks them all alike, `deduplicate` returns one of them. Other
columns are passed through, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh_path, lookup, partitions, remove, table, written


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(text), 256))


class DigestIndex:
    """A persistent table (digest, keep_id, keep_rows, n_rows), bucketed and sorted by digest, at a path that a later
    session opens again. Without a path it is a new one in the shared folder.

    A later batch's rows of a digest that is held have no keep_id and no keep_rows, only n_rows."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, (path or fresh_path(spark, "digest-index")).rstrip("/")
        self.name = f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()}"
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        # The folder's name says how many buckets there are; one that holds no data yet counts for nothing.
        held = [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []
        held = [int(x.removeprefix("buckets-")) for x in held if x.startswith("buckets-")]
        held = [n for n in held if any(x.getPath().getName().endswith(".parquet") for x in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/buckets-{n}")))]
        self.buckets = held[0] if held else buckets or max(8, partitions(spark))
        if held and not spark.catalog.tableExists(self.name):
            columns = spark.read.parquet(self.folder).schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
            spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'")

    @property
    def folder(self) -> str:
        return f"{self.path}/buckets-{self.buckets}"

    def read(self) -> DataFrame | None:
        """One row a digest; None before the first batch."""
        if not self.spark.catalog.tableExists(self.name):
            return None
        return self.spark.table(self.name).groupBy("digest").agg(*[f(x).alias(x) for f, x in ((F.max, "keep_id"), (F.max, "keep_rows"), (F.sum, "n_rows"))])

    def drop(self) -> None:
        """Removes the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)

    def ingest(self, digests: DataFrame) -> int:
        """Appends the digests that the index lacks, and the counts of those that it holds. digests: id, digest.
        Returns the rows of the batch."""
        each = digests.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("c"))
        groups = each.groupBy("digest").agg(F.max(F.struct("id", "c")).alias("top"), F.sum("c").alias("n_rows"))
        groups = groups.select("digest", F.col("top.id").alias("keep_id"), F.col("top.c").alias("keep_rows"), "n_rows")
        held = self.read()
        if held is not None:
            held = held.select("digest", F.lit(True).alias("held")).hint("merge")
            first = lambda x: F.when(F.col("held").isNull(), F.col(x)).alias(x)
            groups = groups.join(held, "digest", "left").select("digest", first("keep_id"), first("keep_rows"), "n_rows")
        groups.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").option("path", self.folder).saveAsTable(self.name)
        return digests.count()

    def decide(self, digests: DataFrame, total: int) -> DataFrame:
        """id, digest -> id, digest, keep_id, keep_rows, n_rows of the index.

        The index is reduced to the batch's digests, with the batch's own rows of each, which total counts: digests
        heavy in the batch are joined by broadcast, the others in a sort-merge join."""
        counts = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).hint("merge")
        return lookup(digests, written(self.read().join(counts, "digest"), "digest-decisions"), "digest", total)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """One row a document: id_col, keep_id, group_size, kept, text_sha256."""
    own = index or DigestIndex(docs.sparkSession)
    digests = written(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest")), "digests")
    decided = own.decide(digests, own.ingest(digests))
    if index is None:
        own.drop()  # the decisions are written
    return decided.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n_rows").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all their columns.

    Texts are shuffled once, by (digest, id): an id names one document, so no text is a hot key. Only if some
    row that stays is repeated whole are the staying rows shuffled again, to keep one of each."""
    at = index or DigestIndex(docs.sparkSession)
    digests = written(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest")), "digests")
    at.ingest(digests)
    held = at.read().select(F.col("digest").alias("__hx_digest"), F.col("keep_id").alias("__hx_keep"), F.col("keep_rows").alias("__hx_rows"))
    if index is None:
        held = written(held, "digests-kept")
        at.drop()
    own = docs.withColumn("__hx_own", text_digest(F.col(text_col)))
    on = (F.col("__hx_own") == F.col("__hx_digest")) & F.col(id_col).eqNullSafe(F.col("__hx_keep"))
    staying = own.join(held, on, "left_semi")
    if held.where("__hx_rows > 1").limit(1).count():
        staying = staying.dropDuplicates(["__hx_own"])
    return staying.drop("__hx_own")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""
