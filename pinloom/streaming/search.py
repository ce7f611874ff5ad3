"""Searching blobs as they arrive.

The search keeps no state between blobs, so a stream runs it as it stands, and nothing grows with the stream. Repeated deliveries
are settled where the matches lie: every micro-batch writes its own folder, as a whole or not at all, a batch tried again writes
the same folder anew, and whoever reads merges rows of one identity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pinloom.operators.ranking import merged_matches
from pinloom.plans.search import search
from pinloom.plans.spec import SearchSpec


def stream_matches(blobs: DataFrame, spec: SearchSpec) -> DataFrame:
    """The matches of a stream of blobs, in batches; ``read_matches`` settles repeated ones."""
    if not blobs.isStreaming:
        raise ValueError("the blobs must be a stream")
    return search(blobs, spec).matches


def run_available(matches: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes the matches of all that is there, each batch to its folder; the checkpoint remembers what was read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return run_batches(matches, checkpoint, write)


def read_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The matches written so far: one row for each identity, of the greatest score, with the kinds of all its rows."""
    return merged_matches(spark.read.parquet(folder).drop("batch"))


def run_batches(matches: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands each micro-batch to a sink with its number, so that a repeated batch can be recognised."""
    query = matches.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
