"""What the operators of this subpackage share: reading, private copies of rows, and cut lineage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, scratch_path, shared_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def short_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on Python gets fewer of them at a time, as texts are long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return df


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and all columns of the input in ``row``.

    The input may have columns of any other name; inside the struct they cannot clash with ours.
    """
    return short_batches(docs).select(
        F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"), F.struct("*").alias("row")
    )


def small(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, which bounds what a task holds for long texts."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows from a reliable checkpoint in the shared folder; for narrow tables and loops."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The rows from Parquet in the shared folder: compressed, and readable by column. For texts ``zstd`` needs less disk."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)
