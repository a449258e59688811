"""Incremental stacks: batches of points are folded into a table of partial sums, each once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from tidegrid.functions.grid import GridSpec
from tidegrid.operators.stacks import finish_stack, merge_partials, partial_stack


def ingest(points: DataFrame, grid: GridSpec, folder: str) -> None:
    """Append the partial sums of whole datasets that `folder` does not have yet. The sums carry the dataset, so one write is both the
    data and the registry: a run that fails leaves neither. For datasets that come in parts see `ingest_batch`."""
    empty = partial_stack(points.limit(0), grid)
    empty.write.mode("append").parquet(f"{folder}/batch=whole")
    known = points.sparkSession.read.schema(empty.schema).parquet(f"{folder}/batch=*").select("dataset_id").distinct()
    partial_stack(points.join(known, "dataset_id", "left_anti"), grid).write.mode("append").parquet(f"{folder}/batch=whole")


def ingest_batch(points: DataFrame, grid: GridSpec, folder: str, batch: str) -> None:
    """Fold one batch in, whatever datasets its points belong to. A batch is written to a place of its own name, so that a batch that
    is run again replaces itself, and no other."""
    partial_stack(points, grid).write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def _query_id(spark, checkpoint: str) -> str:
    """The id of the streaming query that runs with this checkpoint; a new checkpoint is a new query."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def ingest_stream(stream: DataFrame, grid: GridSpec, folder: str, checkpoint: str, name: str = "stream", seconds: int | None = None, taps=()):
    """A streaming query that folds every micro-batch of points into `folder`. It runs over all that is there and ends, or every
    `seconds` and goes on. `taps`: further functions of (batch, batch id) that see each micro-batch before it is folded in.

    A batch is kept under the name, the query's id, which its checkpoint holds, and its number: a query that goes on after a loss
    replaces what it had begun, and other queries into the same folder, of the same name too, have places of their own."""

    def fold(batch: DataFrame, number: int) -> None:
        held = batch.persist() if taps else batch
        for tap in taps:
            tap(held, number)
        ingest_batch(held, grid, folder, f"{name}-{_query_id(batch.sparkSession, checkpoint)}-{number}")
        if taps:
            held.unpersist()

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def current(spark, folder: str, datasets: DataFrame, mode: str = "mean", thresholds=(1.0,)) -> DataFrame:
    """The statistical stack of all that was folded in."""
    partials = merge_partials(spark.read.parquet(f"{folder}/batch=*"))
    return finish_stack(partials.join(datasets.select("dataset_id", "ingest_order"), "dataset_id"), mode, thresholds)
