"""What the corpus operators share: tables, the shared folder and written steps."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one of our own where it is unset (local runs)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    own = getattr(sc, "_helixframe_dir", None)
    if own is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = sc._helixframe_dir = tempfile.mkdtemp(prefix="helixframe-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; `made` lists those of the session."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made(spark).append(path)
    return path


def made(spark: SparkSession) -> list[str]:
    """The paths of the shared folder that this session has made and not removed."""
    sc = spark.sparkContext
    if not hasattr(sc, "_helixframe_made"):
        sc._helixframe_made = []
    return sc._helixframe_made


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in made(spark):
        made(spark).remove(path)


def drawn(id_col: Column, share: Column) -> Column:
    """Whether a row is in a sample of a share of the ids, by a hash of all 64 bits: no share is too small to draw from."""
    # Hashes lie evenly in [-2 ** 63, 2 ** 63).
    return F.xxhash64(id_col.cast("string")).cast("double") < share * F.lit(2.0**64) - F.lit(2.0**63)


#: A key with more than 1 / HEAVY of the rows is heavy; there are fewer than HEAVY of them, however large the data.
HEAVY = 1000


def lookup(many: DataFrame, one: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """many joined to one on key, without a hot task. one: unique keys, and n, the rows of each key in many (total in all).

    As the n add up to total at most, heavy keys are fewer than HEAVY: the driver holds them, and their rows of one are
    broadcast. The others meet in a sort-merge join. Each key is in one of the two branches; n that add up to more
    than total are an error. n is dropped."""
    found = one.where((F.col(n) * HEAVY > F.lit(total)) & F.col(key).isNotNull()).select(key).limit(HEAVY + 1).collect()
    if len(found) > HEAVY:
        raise ValueError("the rows of the keys add up to more than the total")
    if not found:
        return many.join(one.hint("merge"), key).drop(n)
    heavy = F.col(key).isin([r[0] for r in found])
    hot = many.where(heavy).join(F.broadcast(one.where(heavy)), key)
    return hot.unionByName(many.where(~heavy).join(one.where(~heavy).hint("merge"), key)).drop(n)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, UPPER.lower()))


def texts(batch, name: str) -> list[str]:
    """A text column of an Arrow batch as strings, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def groups_of(column: pa.Array, size: int) -> Iterator[pa.Array]:
    """A column of texts cut to groups of about size bytes, or one text if that is longer; null as empty."""
    column = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield column.slice(at, stop - at)
        at = stop


def with_groups(batch: pa.RecordBatch, name: str, size: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """A batch cut to groups of rows, each with its texts."""
    at = 0
    for group in groups_of(batch.column(name), size):
        yield batch.slice(at, len(group)), group
        at += len(group)


def laid_out(found: list[bytes], code: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids that found holds for each code, end to end, and where each code's stop."""
    sizes = np.array([len(x) for x in found], np.int64) // kind.itemsize
    many = sizes[code]
    stops = np.cumsum(many)
    small = np.int32 if max(int(sizes.sum()), int(stops[-1]) if len(stops) else 0) < 1 << 31 else np.int64
    at = np.repeat(((np.cumsum(sizes) - sizes)[code] - stops + many).astype(small), many)
    at += np.arange(len(at), dtype=small)
    return np.frombuffer(b"".join(found), kind)[at], stops


def give_back() -> None:
    """Gives back what Arrow and the allocator hold idle."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def released(run):
    """run, a function of Arrow batches, that gives back idle memory when a task ends: a worker lives on for the stages behind."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def rows_of(batches: Iterable, size: int) -> Iterator:
    """Arrow batches cut to size rows at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


class Memo(dict):
    """What a worker remembers, in bounded memory: when `most` entries are full they become the old ones, and the
    old ones before them go; entries that are asked for again move up. Keys longer than `longest` are not kept, so
    neither the entries nor their bytes grow with the texts."""

    def __init__(self, most: int, longest: int | None = None):
        super().__init__()
        self.most, self.longest, self.old = most, longest, {}

    def keep(self, key, value):
        if self.longest is not None and len(key) > self.longest:
            return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def __missing__(self, key):
        """self[key]: the value, moved up if it is an old one, or None."""
        value = self.old.get(key)
        return None if value is None else self.keep(key, value)
