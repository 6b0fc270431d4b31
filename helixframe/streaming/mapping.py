"""Streaming forms: read pairs that arrive as files are mapped against a static index; counts are kept over all input.

There is no event time in the data: mapping is stateless apart from the reads of a micro-batch, and counts are complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import mapping as M
from ..plans.quant import count_states, state_records

READS = "read_id long, r1 string, seq string, qual string"


def reads_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Read pairs from Parquet files as they appear in a folder."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def map_stream(reads: DataFrame, index: DataFrame, k: int, out: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Appends each micro-batch's assignments to out/batch=<n>. A batch that is run again replaces its own folder, so each read is there once."""

    def write(batch: DataFrame, number: int) -> None:
        M.map_reads(batch, index, k, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def assignment_counts(assignments: DataFrame) -> DataFrame:
    """A streaming aggregate for complete mode: reads by type."""
    return assignments.groupBy("assignment_type").agg(F.count(F.lit(1)).alias("reads"))


def count_mapped(spark: SparkSession, out: str, whitelist: DataFrame | None, **options) -> DataFrame:
    """State counts over all batches mapped so far: a molecule's reads may lie in several."""
    return count_states(state_records(spark.read.parquet(out).drop("batch")), whitelist, **options)
