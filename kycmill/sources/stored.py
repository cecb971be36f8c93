"""Tables at rest: by tenant, or by key so that a change rewrites the part it meets and no other."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.mutations import keyed_upsert
from ..session import scratch_path

BUCKETS = 64
_BUCKET = "__bucket"


def write_by_tenant(df: DataFrame, path: str) -> None:
    """Store a domain table in one folder per tenant; a tenant with many rows gets several files."""
    df.hint("rebalance", "tenant_id").write.mode("overwrite").partitionBy("tenant_id").parquet(path)


def read_by_tenant(like: DataFrame, path: str, tenant_id: object | None) -> DataFrame:
    """A tenant's rows of such a table: its folder is read and no other. Without a tenant there are no rows."""
    rows = like.sparkSession.read.schema(like.schema).parquet(path)
    return rows.filter(F.col("tenant_id") == F.lit(tenant_id)).select(*like.columns)


def read_for_tenants(like: DataFrame, path: str, tenants: DataFrame) -> DataFrame:
    """The rows of the tenants listed in a table.

    Where the list is selected by a condition and short enough for Spark to broadcast, partitions are pruned at run
    time: only the folders of these tenants are read.
    """
    rows = like.sparkSession.read.schema(like.schema).parquet(path)
    return rows.join(tenants.select("tenant_id"), "tenant_id", "left_semi").select(*like.columns)


def _bucket(keys: Sequence[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


@contextmanager
def _parts_only(spark: SparkSession):
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class KeyedTable:
    """A table in ``buckets`` folders by the hash of its keys, one row per key.

    Changes are worked out for the buckets whose keys they have, written aside, and then put in place of these
    buckets. One writer at a time; a reader may see some buckets new and others not yet.
    """

    def __init__(self, like: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.schema, self.path, self.keys, self.buckets = like.sparkSession, like.schema, path, list(keys), buckets

    def create(self, rows: DataFrame) -> None:
        self._write(rows, "errorifexists")

    def _write(self, rows: DataFrame, mode: str) -> None:
        placed = rows.select(*self.schema.names, _bucket(self.keys, self.buckets).alias(_BUCKET))
        placed.hint("rebalance", _BUCKET).write.mode(mode).partitionBy(_BUCKET).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)

    def change(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``apply(rows, changes)`` gives the new rows of the buckets met; it must not drop or move keys elsewhere."""
        met = sorted(r[0] for r in changes.select(_bucket(self.keys, self.buckets).alias("b")).distinct().collect())
        if not met:
            return
        full = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(_BUCKET, T.IntegerType())])).parquet(self.path)
        rows = full.filter(F.col(_BUCKET).isin(met)).drop(_BUCKET)
        # The new rows are written aside first: a bucket cannot be read and replaced at once.
        aside = scratch_path(self.spark, "keyed-table")
        apply(rows, changes).select(*self.schema.names).write.parquet(aside)
        with _parts_only(self.spark):
            self._write(self.spark.read.schema(self.schema).parquet(aside), "overwrite")

    def upsert(self, changes: DataFrame, order: Sequence[str] = ()) -> None:
        """``keyed_upsert`` into the stored rows."""
        self.change(changes, lambda rows, new: keyed_upsert(rows, new, self.keys, order))
