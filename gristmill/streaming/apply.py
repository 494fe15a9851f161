"""Replaying learned steps and fitted models on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.recipe import Step, replay

# Steps that need a total row order cannot run on an unbounded table.
ORDERED_ACTIONS = ("sort", "fill_forward")


def replay_stream(steps: Sequence[Step], stream: DataFrame) -> DataFrame:
    """The same steps, with the constants they learned, on an unbounded table."""
    for step in steps:
        if step.action in ORDERED_ACTIONS:
            raise ValueError(f"{step.action} needs a bounded table")
    return replay(list(steps), stream)


def score_stream(model: PipelineModel, stream: DataFrame) -> DataFrame:
    return model.transform(stream)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived as Parquet and stop; start again with the same checkpoint to
    go on from there."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
