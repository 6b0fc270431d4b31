"""Sharding with size-tiered compaction and a versioned manifest.

Each arrival is appended as a run: a folder of small immutable Parquet files that nothing changes afterwards.
When `FANOUT` runs or more of similar size wait, they are merged into one run of files of the target size, by a read and a
write without a shuffle; runs whose files have reached the target are never written again, so a row is written as often as
sizes can grow by the fan-out. What exists is what the newest manifest lists: version N is written beside and
renamed to its name, which fails if another writer has made N meanwhile; this needs a file system whose rename does not
overwrite, as HDFS and local ones have and plain object stores lack. Readers hold a version; a lost executor or
a stopped job leaves files that no manifest lists, which `vacuum` removes when they are old.

All rows move by DataFrame reads and writes; the driver only handles the list of runs.

Defined cases: an empty arrival makes no run and no version; nulls, empty and very long texts, repeated rows and further
columns are stored as they are; a store without a version reads as None; arrivals need one schema.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, table

#: Bytes of a file, runs that are merged, how far from their mean runs of similar size may lie, and arrivals of the query.
TARGET, FANOUT, SIMILAR, ARRIVALS = 128 << 20, 4, (0.5, 1.5), 10
#: Tries to commit an arrival, and seconds for which vacuum leaves alone what no manifest lists.
TRIES, UNTOUCHED = 10, 86_400.0


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target, fanout
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @property
    def _fs(self):
        return self._at().getFileSystem(self.conf)

    def versions(self) -> list[int]:
        where = self._at("manifest")
        if not self._fs.exists(where):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(where)]
        return sorted(int(x[1:-5]) for x in names if x.startswith("v") and x.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version and runs: id, level, bytes, files, rows."""
        found = self.versions()
        if not found and version is None:
            return {"version": 0, "runs": []}
        stream = self._fs.open(self._at(f"manifest/v{version or found[-1]:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, before: dict, runs: list[dict]) -> dict:
        """Makes the next version, or raises if another writer has made it."""
        after = {"version": before["version"] + 1, "runs": runs}
        beside, name = self._at(f"manifest/.{uuid.uuid4().hex}"), self._at(f"manifest/v{after['version']:012d}.json")
        out = self._fs.create(beside, False)
        try:
            out.write(bytearray(json.dumps(after).encode()))
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self.conf)
        context.rename(self._fs.makeQualified(beside), self._fs.makeQualified(name), none)
        return after

    def _write(self, df: DataFrame, level: int) -> dict | None:
        run = uuid.uuid4().hex
        df.write.option("compression", "zstd").parquet(f"{self.path}/runs/{run}")
        rows = self.spark.read.schema(df.schema).parquet(f"{self.path}/runs/{run}").count()
        if not rows:
            self._fs.delete(self._at(f"runs/{run}"), True)
            return None
        files = [x for x in self._fs.listStatus(self._at(f"runs/{run}")) if x.getPath().getName().endswith(".parquet")]
        return {"id": run, "level": level, "rows": rows, "files": len(files), "bytes": sum(x.getLen() for x in files)}

    def append(self, df: DataFrame) -> dict:
        """Appends an arrival as a run of small files and commits; returns the manifest. An arrival is added to whatever
        version is the newest, so a commit that another writer was first to make is tried again."""
        run = self._write(df, 0)
        if not run:
            return self.manifest()
        for left in range(TRIES, 0, -1):
            before = self.manifest()
            try:
                return self._commit(before, [*before["runs"], run])
            except Py4JJavaError:
                if left == 1 or self.versions()[-1:] <= [before["version"]]:
                    raise

    def waiting(self, runs: list[dict]) -> list[dict]:
        """The smallest runs of similar size that are to be merged; empty if there are fewer than the fan-out."""
        open_runs = sorted((r for r in runs if r["bytes"] / r["files"] < self.target / 2), key=lambda r: (r["bytes"], r["id"]))
        group: list[dict] = []
        for r in open_runs:
            mean = sum(x["bytes"] for x in group) / len(group) if group else r["bytes"]
            if group and not SIMILAR[0] * mean <= r["bytes"] <= SIMILAR[1] * mean:
                if len(group) >= self.fanout:
                    break
                group = []
            group.append(r)
        return group if len(group) >= self.fanout else []

    def compact(self) -> dict:
        """Merges runs of similar size until none wait; each merge is a version."""
        now = self.manifest()
        while group := self.waiting(now["runs"]):
            files = max(1, math.ceil(sum(r["bytes"] for r in group) / self.target))
            merged = self._write(self._rows(group).coalesce(files), 1 + max(r["level"] for r in group))
            gone = {r["id"] for r in group}
            now = self._commit(now, [*(r for r in now["runs"] if r["id"] not in gone), merged])
        return now

    def vacuum(self, keep: int = 1, older: float = UNTOUCHED) -> None:
        """Removes the manifests but the newest `keep`, and the runs that none of these lists, if they were written more
        than `older` seconds ago: a run may be about to be committed by another writer, and a reader may hold an older
        version. Only one who knows that there are no others passes less."""
        found, now = self.versions(), time.time()
        gone = lambda x: x.getModificationTime() / 1000 <= now - older
        listed = {r["id"] for v in found[-keep:] for r in self.manifest(v)["runs"]}
        # A version goes when the one that followed it is old enough, and its runs with it.
        fresh = [v for v, after in zip(found[:-keep], found[1:]) if not gone(self._fs.getFileStatus(self._at(f"manifest/v{after:012d}.json")))]
        listed |= {r["id"] for v in fresh for r in self.manifest(v)["runs"]}
        for v in found[:-keep]:
            if v not in fresh:
                self._fs.delete(self._at(f"manifest/v{v:012d}.json"), False)
        for x in self._fs.listStatus(self._at("runs")):
            if x.getPath().getName() not in listed and gone(x):
                self._fs.delete(x.getPath(), True)

    def _rows(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/runs/{r['id']}" for r in runs])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version."""
        runs = self.manifest(version)["runs"]
        return self._rows(runs) if runs else None

    def placed(self, columns: list[str], version: int | None = None) -> DataFrame | None:
        """The named columns, and where each row lies: run (place in the manifest), level, shard (file of the run). Columns
        of the documents that bear these names are not to be asked for."""
        parts = []
        for i, r in enumerate(self.manifest(version)["runs"]):
            shard = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
            parts.append(self._rows([r]).select(*columns, F.lit(i).alias("run"), F.lit(r["level"]).alias("level"), shard.alias("shard")))
        return reduce(DataFrame.unionByName, parts) if parts else None


def store_in_arrivals(docs: DataFrame, path: str, id_col: str = "doc_id", arrivals: int = ARRIVALS, **options) -> ShardStore:
    """Stores docs in arrivals of ascending ids, compacting after each, as a feed would bring them."""
    store = ShardStore(docs.sparkSession, path, **options)
    cuts = docs.agg(F.percentile_approx(F.col(id_col), [i / arrivals for i in range(1, arrivals)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        own = F.lit(True)
        if lo is not None:
            own = own & (F.col(id_col) > lo)
        if hi is not None:
            own = own & (F.col(id_col) <= hi)
        if lo is None:
            own = F.coalesce(own, F.lit(True))  # rows without an id come first
        store.append(docs.where(own))
        store.compact()
        if store.versions():
            store.vacuum(older=0)  # nobody else knows of this store yet
    return store


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, read back from the store: doc_id, n_bytes (of the stored text), run, level, shard."""
    docs = table(spark, sf_dir, "documents")
    store = store_in_arrivals(docs, fresh_path(spark, "shards"))
    found = store.placed(["doc_id", "text"])
    if found is None:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).alias("run"), F.lit(0).alias("level"), F.lit(0).alias("shard"))
    return found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "run", "level", "shard")
