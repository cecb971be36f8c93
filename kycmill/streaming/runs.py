"""Starting streams over files and keeping their results in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch_path
from ..sources.tables import SCHEMAS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """One of the driver's tables as a stream of files."""
    reader = spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def file_stream(like: DataFrame, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files below ``path``, of the schema of ``like``, as a stream."""
    reader = like.sparkSession.readStream.schema(like.schema)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(path)


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None, finite: bool = True) -> Iterator[None]:
    """State in RocksDB, in a number of partitions that is fixed for the life of the checkpoint."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    # A finite run ends with its last data: batches without data, which only serve timeouts, would keep it
    # going for ever. A lasting one needs them, so that a timeout fires in a quiet stream too.
    wanted["spark.sql.streaming.noDataMicroBatches.enabled"] = "false" if finite else "true"
    wanted["spark.sql.shuffle.partitions"] = str(partitions or 2 * spark.sparkContext.defaultParallelism)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, value in wanted.items():
        spark.conf.set(k, value)
    try:
        yield
    finally:
        for k, value in before.items():
            if value is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, value)


def start_to_files(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    trigger: Mapping[str, object],
    partitions: int | None = None,
    folders: Sequence[str] = (),
) -> StreamingQuery:
    """Start a stream that appends to Parquet files below ``path`` and goes on where ``checkpoint`` stopped.

    ``trigger`` is that of ``writeStream``: ``{"availableNow": True}`` for a finite run, or
    ``{"processingTime": "10 seconds"}`` for a lasting one. With ``folders=["tenant_id"]`` every tenant gets a
    folder of its own to listen to.
    """
    with state_settings(stream.sparkSession, partitions, finite="processingTime" not in trigger):
        writer = stream.writeStream.partitionBy(*folders) if folders else stream.writeStream
        return (
            writer.format("parquet")
            .option("checkpointLocation", checkpoint)
            .option("path", path)
            .outputMode("append")
            .trigger(**trigger)
            .start()
        )


def run_to_files(
    stream: DataFrame, name: str, partitions: int | None = None, folders: Sequence[str] = (), at: str | None = None
) -> DataFrame:
    """Process what is there, append the results to files, and read them back.

    ``at`` is a lasting folder for results and checkpoint: a later run with the same one goes on from there.
    Without it the run is on its own, in a fresh folder.
    """
    out = at or scratch_path(stream.sparkSession, name)
    start_to_files(
        stream, f"{out}/rows", f"{out}/checkpoint", {"availableNow": True}, partitions, folders
    ).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def run_batches(
    stream: DataFrame,
    name: str,
    each: Callable[[DataFrame, int, str], None],
    mode: str = "append",
    partitions: int | None = None,
    at: str | None = None,
    trigger: Mapping[str, object] | None = None,
) -> str | StreamingQuery:
    """Hand every micro-batch to ``each(batch, batch_id, path)`` and return ``path``; ``at`` as above.

    With a ``trigger`` for a lasting run, ``at`` is needed, and the running query is returned at once.

    ``each`` writes below ``batch=<id>`` with overwrite, so a batch that is repeated after a failure
    replaces its own earlier attempt.
    """
    if trigger is not None and at is None:
        raise ValueError("a lasting run needs a folder of its own")
    out = at or scratch_path(stream.sparkSession, name)
    with state_settings(stream.sparkSession, partitions, finite=trigger is None):
        q = (
            stream.writeStream.foreachBatch(lambda batch, n: each(batch, n, out))
            .option("checkpointLocation", f"{out}/checkpoint")
            .outputMode(mode)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
        if trigger is not None:
            return q
        q.awaitTermination()
    return out
