"""A snapshot for each micro-batch of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from snapforge.operators.snapshot import BuildResult, build_snapshot
from snapforge.sources.manifest import ManifestStore


def publish_each_batch(stream: DataFrame, root: str, prepare: Callable[[DataFrame], DataFrame] | None = None, **build: object) -> DataStreamWriter:
    """stream's writer: each batch with rows becomes the current snapshot of root.

    The run is named by the batch, so a batch that is run again after a failure finds its own manifest and
    only has to be made current. Start it with a checkpoint folder and a trigger.
    """

    def publish(batch: DataFrame, number: int) -> BuildResult | None:
        store, run_id = ManifestStore(batch.sparkSession, root), f"batch-{number:012d}"
        if store.load(run_id) is not None:
            store.set_current(run_id)
            return None
        rows = prepare(batch) if prepare else batch
        if rows.isEmpty():
            return None
        store.files.delete(f"runs/run_id={run_id}")  # what a failed try left
        return build_snapshot(rows, root, run_id=run_id, **build)

    return stream.writeStream.foreachBatch(publish)
